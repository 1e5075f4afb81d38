import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, spans int, bits string, text_crc32 double"


def prose(r, n, sounds):
    return " ".join("".join(r.choice(sounds) for _ in range(r.randint(1, 4))) for _ in range(n))


def some_documents():
    r = random.Random(11)
    en = ["the", "ing", "and", "wh", "tion", "ed", "ly", "sh", "er", "ou"]
    es = ["ción", "que", "ñ", "rr", "ll", "es", "os", "ie", "do", "as"]
    passage = "Shared " + prose(r, 60, en) + "."
    bench = prose(r, 30, en)
    rows = []
    for i in range(40):
        rows.append((i * 3, prose(r, r.choice((4, 30, 200)), en if i % 3 else es), "en" if i % 3 else "es"))
    base = prose(r, 300, en)
    rows += [(200 + i, base, "en") for i in range(12)]  # exact copies
    for i in range(6):  # near copies
        w = base.split()
        w[50 * i] = "changed"
        rows.append((300 + i, " ".join(w), "en"))
    rows += [(400 + i, prose(r, 40, en) + " " + passage + " " + prose(r, 25, en), "en") for i in range(5)]
    rows += [(500, prose(r, 20, en) + " " + bench.upper() + "! " + prose(r, 30, en), "en"), (501, prose(r, 600, en) + " " + bench + " tail", "en"), (502, bench, "en")]
    rows += [(600, "", "en"), (601, None, "en"), (602, " \n\t ", None), (603, "1234 5678 !!!", "en"), (604, "é" * 70, "fr"), (605, "日本語のテキスト" * 12, None), (606, "one", "en"), (607, "One  ", "en")]
    rows += [(650, prose(r, 9000, en), "en"), (700, "repeated row " * 20, "en"), (700, "repeated row " * 20, "en"), (701, "a" * 130, "en"), (702, "b" + "a" * 80, "en"), (703, "x" * 49, "en")]
    items = [(1, bench), (2, "One"), (3, None), (4, ""), (5, prose(r, 25, es)), (None, prose(r, 15, en)), (12, bench)]
    return rows, items


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder of small tables with nulls, empties, copies, ties, repeated rows and columns of clashing names; and their rows."""
    root = tmp_path_factory.mktemp("tables")
    rows, items = some_documents()
    full = [(d, t, lang, f"s{i % 3}" if i % 7 else None, None if t is None else len(t), "old", i, "x", 0.5) for i, (d, t, lang) in enumerate(rows)]
    spark.createDataFrame(full, DOCS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{root}/benchmark.parquet")
    pages = [(i, f"http://h/{i}", f"<nav><a href='/x'>Menu {i}</a></nav><article><h1>Title {i}.</h1><p>Some words here, for page {i % 4}, and more.</p></article><footer>&copy; us</footer>") for i in range(20)]
    pages += [(30, None, None), (31, "u", ""), (32, "u\n", "<p>é</p>"), (33, "u", "<p>é</p>"), (33, "u", "<p>é</p>"), (None, "n", "<p>é</p>"), (40, "x", "<article><p>" + "long text, " * 20000 + "</p></article>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).repartition(2).write.parquet(f"{root}/pages.parquet")
    return str(root), rows, items, pages


@pytest.fixture(scope="session")
def empty(spark, small, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{small[0]}/{t}.parquet").filter("false").write.parquet(f"{root}/{t}.parquet")
    return str(root)
