"""The registered queries on small tables of hard cases, against plain versions."""

import base64
import hashlib
import zlib
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vertexloom.llm import components, fmindex, langid, packing, sharding, simhash, suffixes
from vertexloom.llm.queries import QUERIES

NULL_FIRST = -(1 << 63)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def ordered(rows):
    return sorted(rows, key=lambda r: NULL_FIRST if r[0] is None else r[0])


def test_op1(spark, small):
    got = sorted(tuple(r) for r in QUERIES["op1_token_ids"](spark, small[0]).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    docs = ordered((d, t) for d, t, _ in small[1])
    start = 0
    for (at, d, n, crc), (e, _), ids in zip(got, docs, brute.token_ids([t for _, t in docs], 2), strict=True):
        assert (at, d, n, crc) == (start, e, len(ids), brute.crc_of(ids))
        start += n


def test_op1_tokens_and_small_shards(spark, small):
    from vertexloom.llm.wavelet import open_file, read_shards, write_shards

    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    shards = write_shards(docs, shard_tokens=200)
    rows = sorted(shards.collect(), key=lambda r: r.begin)
    assert max(r.number for r in rows) > 10 and [(r.part, r.number) for r in rows] == sorted((r.part, r.number) for r in rows)  # by number, not by name
    got = {r.start: r.tokens for r in read_shards(spark, shards).collect()}
    whole = [t for s in sorted(got) for t in got[s]]
    want = [i for ids in brute.token_ids([t for _, t in ordered((d, t) for d, t, _ in small[1])], 2) for i in ids]
    assert whole == want
    first = open_file(rows[0].file)
    assert first.locate(2) == [i for i, t in enumerate(whole[: first.n]) if t == 2]


def test_op2(spark, small):
    first = {}
    for p, _, h in small[3]:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = []
    for p, _, h in small[3]:
        data = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and p != f
        want.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    got = rows_of(QUERIES["op2_warc"](spark, small[0]), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == sorted(want, key=str)


def test_op2_keeps_payloads_and_small_ones(spark, small):
    from vertexloom.llm.warc import read_archives, write_archives

    pages = spark.read.parquet(f"{small[0]}/pages.parquet")
    written = write_archives(pages, min_bytes=1)
    records = read_archives(spark, [r.archive for r in written.collect()]).collect()
    assert {r.page_id: r.html.decode() for r in records if r.html is not None and r.page_id == 32} == {32: "<p>é</p>"}
    assert {r.record_type for r in records if r.payload_bytes == 0} == {"response"}
    assert sum(r.records for r in written.collect()) == len(records) == len(small[3])


def check_pieces(pieces, texts, length=2048):
    """pieces: (doc, start, length, crc, doc_tokens, sequence, offset) of documents with the texts."""
    want = Counter(brute.crc_of(x) for x in brute.token_ids(texts, 1))
    by_ids = {brute.crc_of(x): x for x in brute.token_ids(texts, 1)}
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
    assert sum(p[2] for p in pieces) == sum(len(by_ids[c]) * n for c, n in want.items())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p[5], []).append((p[6], p[2]))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return by_doc


def test_op3(spark, small):
    got = [tuple(r) for r in QUERIES["op3_packing"](spark, small[0]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    by_doc = check_pieces(got, [t for _, t, _ in small[1]])
    ids = {}
    for (d, _, _), x in zip(small[1], brute.token_ids([t for _, t, _ in small[1]], 1), strict=True):
        ids.setdefault(d, []).append(x)
    for d, pieces in by_doc.items():
        own = ids[d]
        assert {p[4] for p in pieces} == {len(x) for x in own}
        want = Counter((s, min(2048, len(x) - s), brute.crc_of(x[s : s + 2048])) for x in own for s in range(0, len(x), 2048))
        assert Counter((p[1], p[2], p[3]) for p in pieces) == want


def test_op3_cuts_long_rests_in_halves(spark):
    docs = spark.createDataFrame([(i, "word " * 1300) for i in range(9)], "doc_id long, text string")
    packed = packing.pack(docs)
    got = [tuple(r) for r in packed.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()]
    check_pieces(got, ["word " * 1300] * 9)
    assert packed.select("sequence_id").distinct().count() < 9 and {p[2] for p in got} == {1024, 277}


def test_op4(spark, small):
    got = {r.page_id: r for r in QUERIES["op4_html_text"](spark, small[0]).collect()}
    for i in range(20):
        assert got[i].text == f"Title {i}.\n\nSome words here, for page {i % 4}, and more." and got[i].n_chars == len(got[i].text)
    assert got[30].text == got[31].text == "" and got[30].url is None and got[31].n_chars == 0
    assert got[40].text == ("long text, " * 20000).strip()
    assert QUERIES["op4_html_text"](spark, small[0]).count() == len(small[3])


def test_op5(spark, small):
    got = QUERIES["op5_sharding"](spark, small[0]).collect()
    want = sorted(((d if d is not None else None), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in small[1])
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op5_keeps_columns_and_repeats_itself(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    a = sharding.shard_rows(docs, 3, cell_rows=5)
    assert a.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    one = spark.createDataFrame([(i,) for i in range(50)], "v long").coalesce(2)
    x, y = (rows_of(sharding.shard_rows(one, 4, cell_rows=4), "v", "shard", "slot") for _ in range(2))
    assert x == y != rows_of(sharding.shard_rows(one, 4, seed=7, cell_rows=4), "v", "shard", "slot")
    with pytest.raises(ValueError):
        sharding.shard_rows(one, 0)


def test_op6(spark, small):
    docs = ordered((d, t) for d, t, _ in small[1])
    got = {}
    for r in QUERIES["op6_fingerprints"](spark, small[0]).collect():
        got.setdefault(r.doc_id, []).append(r)

    def shingles(text):
        w = text.translate(brute.LOWER).encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def likeness(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    prints = {}
    for k, (d, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        many = len(text) // 4
        new = text[: len(text) - many] + after[:many]
        digest = hashlib.sha256(new.encode()).hexdigest()
        r = next(x for x in got[d] if x.edited_sha256 == digest)
        got[d].remove(r)
        assert r.n_chars == len(text)
        assert abs(r.near_edited - likeness(shingles(text), shingles(new))) < 0.12
        assert abs(r.near_next - likeness(shingles(text), shingles(after))) < 0.12
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert not any(got.values())


def test_op6_one_document(spark, tmp_path):
    spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = QUERIES["op6_fingerprints"](spark, str(tmp_path)).collect()
    assert r.near_next == 1.0 and r.n_chars == 15


def test_op7(spark, small):
    got = rows_of(QUERIES["op7_simhash"](spark, small[0]), "doc_id", "fingerprint", "component_id")
    label = brute.groups([(d, t) for d, t, _ in small[1]])
    assert got == sorted(((d, f"{brute.fingerprint(t):016x}", label[d]) for d, t, _ in small[1]), key=str)


def test_op7_deals_large_buckets_again(spark):
    import random

    r = random.Random(3)
    bits = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(20):
            x ^= 1 << r.randrange(64)
            bits.add(x)
    bits |= {(1 << 60) | i for i in range(150)}  # a bucket that stays large
    bits = sorted(bits)
    nodes = spark.createDataFrame([(simhash.signed(b), i) for i, b in enumerate(bits)], "bits long, node long")
    found = {x.node: x.component for x in components.components(simhash.links(nodes, bucket=8)).collect()}
    label = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert [found.get(i, i) for i in range(len(bits))] == label


def test_null_ids_join_their_copies(spark):
    docs = spark.createDataFrame([(None, "same text here"), (4, "same text here"), (2, "same text here"), (None, "quite another")], "doc_id long, text string")
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert got == [(2, 2), (4, 2), (None, 2), (None, None)]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 90, 1) if i % 30 != 29] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 3)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    want = {i: i // 30 * 30 for i in range(91) if i != 90 or True}
    want = {k: v for k, v in want.items() if k in got} | {i: 200 for i in range(200, 260)}
    assert got == want and len(got) == 91 + 60 - (1 if 90 not in got else 0)


def test_op8(spark, small):
    got = {r.doc_id: r for r in QUERIES["op8_language"](spark, small[0]).collect()}
    for d, t, lang in small[1]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1
        if d in (600, 601, 602, 603):
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
        elif d < 600:
            assert got[d].lang_pred == lang


def test_op8_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language"](spark, sf).filter("held_out").join(docs, "doc_id")
    assert got.filter("lang <> lang_pred").count() <= 0.02 * got.count()


def test_op8_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first().lang_pred == "und"


def test_op9(spark, small):
    got = rows_of(QUERIES["op9_suffixes"](spark, small[0]), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    want = brute.removal([(d, t) for d, t, _ in small[1]])
    assert got == sorted(want, key=str)
    assert sum(n > 0 for _, _, n, _, _ in want) > 15


def test_op9_random_texts_and_small_chunks(spark, monkeypatch):
    import random

    r = random.Random(8)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = [(i if i % 9 else None, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(60)] + [(7, parts[0] * 9), (7, parts[0] * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeats(docs, 32, chunk=700, digest=True)
    assert rows_of(got.withColumn("kept", F.lower(F.hex("kept"))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.removal(rows, 32), key=str)


@pytest.mark.parametrize("length", [64, 65, 100, 200])
def test_op9_long_windows(spark, length):
    import random

    r = random.Random(length)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = [word(length + 40) for _ in range(10)]
    rows = [(i, word(30) + shared[i % 10] + word(r.randint(0, 60)) + shared[(i * 3) % 10]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = suffixes.remove_repeats(docs, length, chunk=3000, digest=True)
    assert rows_of(got.withColumn("kept", F.lower(F.hex("kept"))), "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(brute.removal(rows, length), key=str)


def test_op10(spark, small):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute.contamination([(d, t) for d, t, _ in small[1]], small[2])
    assert rows_of(QUERIES["op10_decontaminate"](spark, small[0]), *cols) == sorted(want, key=str)
    assert sum(c for *_, c in want) >= 3


def test_op10_in_blocks(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small[0]}/benchmark.parquet")
    a, b = (rows_of(fmindex.contamination(docs, items, block_bytes=n), "doc_id", "n_words", "spans", "items") for n in (1, 1 << 20))
    assert a == b


def test_op10_holds_one_block_at_a_time(spark, monkeypatch):
    """A benchmark of many blocks: what a worker holds doesn't grow with their number, and results stay right."""
    import random

    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(3000)]
    rows = [(1, f"some words {items[7][1]} and {items[2900][1]} end"), (2, "clean words only"), (3, items[1500][1])]
    table = spark.createDataFrame(items, "item_id long, text string").repartition(4)
    path, many, shortest = fmindex.write_blocks(table, size=20_000)
    assert many > 40 and shortest == 13
    sizes = [len(p.words) for p in fmindex.read_blocks(path)]
    assert len(sizes) == many and max(sizes) < 4000
    found = fmindex.contamination(spark.createDataFrame(rows, "doc_id long, text string"), table, block_bytes=20_000)
    got = {x.doc_id: (x.n_words, [tuple(s) for s in x.spans], x["items"]) for x in found.collect()}
    assert got == {1: (84, [(2, 42), (43, 83)], [7, 2900]), 2: (3, [], []), 3: (40, [(0, 40)], [1500])}


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Null ids, very long texts, repeated rows, and columns whose names clash with results."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    long = " ".join(word() for _ in range(70_000))
    bench = " ".join(word() for _ in range(20))
    rows = [(None, "a text without an id " + bench), (None, None), (5, long), (6, "behind " + long[1000:] + " " + bench), (6, "behind " + long[1000:] + " " + bench), (7, ""), (8, long[::-1][:300_000])]
    root = tmp_path_factory.mktemp("hard")
    schema = "doc_id long, text string, lang string, score double, lang_pred string, n_words long, spans string, items int, begin long, slot long, n_chars long"
    spark.createDataFrame([(d, t, "en", 1000.0, "xx", 7, "s", 1, 2, 3, None) for d, t in rows], schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, bench), (None, "a text")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows


def test_hard_rows_in_the_queries(spark, hard):
    root, rows = hard
    got = sorted(tuple(x) for x in QUERIES["op1_token_ids"](spark, root).select("start", "n_tokens", "ids_crc32").collect())
    want = Counter((len(x), brute.crc_of(x)) for x in brute.token_ids([t for _, t in rows], 2))
    assert Counter((n, crc) for _, n, crc in got) == want and [x[0] for x in got] == [sum(n for _, n, _ in got[:i]) for i in range(len(got))]
    pieces = [tuple(x) for x in QUERIES["op3_packing"](spark, root).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    assert sum(p[2] for p in pieces) == sum(len(x) for x in brute.token_ids([t for _, t in rows], 1)) and {p[0] for p in pieces} == {d for d, _ in rows}
    sizes = Counter((x.doc_id, x.size) for x in QUERIES["op5_sharding"](spark, root).collect())
    assert sizes == Counter((d, len((t or "").encode()) + 8) for d, t in rows)
    assert Counter(x.n_chars for x in QUERIES["op6_fingerprints"](spark, root).collect()) == Counter(len(t or "") for _, t in rows)
    assert {(x.doc_id, x.fingerprint) for x in QUERIES["op7_simhash"](spark, root).collect()} == {(d, f"{brute.fingerprint(t):016x}") for d, t in rows}
    langs = QUERIES["op8_language"](spark, root).collect()
    assert sorted((str(x.doc_id), x.lang_pred) for x in langs) == sorted((str(d), "en" if t else "und") for d, t in rows)
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows_of(QUERIES["op9_suffixes"](spark, root), *cols) == sorted(brute.removal(rows), key=str)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(QUERIES["op10_decontaminate"](spark, root), *cols) == sorted(brute.contamination(rows, [(1, rows[0][1].removeprefix("a text without an id ")), (None, "a text")]), key=str)


def test_hard_rows_in_the_stages(spark, hard):
    root, rows = hard
    docs = spark.read.parquet(f"{root}/documents.parquet")
    clash = docs.withColumnRenamed("spans", "Text2").toDF(*[{"Text2": "Score", "items": "SPANS", "begin": "Lang_Pred"}.get(c, c) for c in docs.withColumnRenamed("spans", "Text2").columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, clash):
            out = stage(spark, table, root)
            assert out.dtypes == table.dtypes, name
            kept = [tuple(x)[3:10] for x in out.collect()]
            assert kept and set(kept) == {(1000.0, "xx", 7, "s", 1, 2, 3)}, name
    stay = {(x.doc_id, x.text) for x in corpus_pipeline.near_copies(spark, docs, root).collect()}
    assert stay == {rows[0], rows[1], rows[2], rows[5], rows[6]}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_no_benchmark_items(spark, small, empty):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    found = fmindex.contamination(docs, spark.read.parquet(f"{empty}/benchmark.parquet"))
    assert found.filter("size(spans) > 0 or size(items) > 0").count() == 0 and "spans" in found.columns


# The pipeline


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small[0])
        assert out.dtypes == docs.dtypes


def test_pipeline_against_brute_force(spark, small):
    rows = [(d, t) for d, t, _ in small[1]]
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["language"](spark, docs, small[0])
    texts = {(r.doc_id, r.text) for r in kept.collect()}
    assert texts <= set(rows) and not {d for d, _ in texts} & {600, 601, 602, 603}
    clear = {(d, t) for d, t, lang in small[1] if d < 600}
    assert clear <= texts

    kept = steps["near_copies"](spark, kept, small[0])
    label = brute.groups(list(texts))
    want = {(d, t) for d, t in texts if label[d] == d}
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)

    kept = steps["repeated_passages"](spark, kept, small[0])
    cut = {}
    for d, data, gone in brute.repeats(sorted(want)):
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip() or not any(gone):
            cut[d] = left
    assert {r.doc_id: r.text for r in kept.collect()} == cut
    assert {r.doc_id: r.n_chars for r in kept.collect()} == {d: len(t) for d, t in cut.items()}

    kept = steps["benchmark"](spark, kept, small[0])
    clean = {}
    for d, n, n_hit, _, _, bad in brute.contamination(sorted(cut.items()), small[2]):
        if not bad:
            clean[d] = brute.cut_hits(cut[d], small[2])
    assert {r.doc_id: r.text for r in kept.collect()} == clean
    assert 501 in clean and 500 not in clean and len(clean[501]) < len(cut[501])

    got = [tuple(r) for r in corpus_pipeline.run(spark, small[0]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    by_doc = check_pieces(got, list(clean.values()))
    assert set(by_doc) == set(clean)


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_null_texts_pass_the_later_stages(spark, small):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "x y z", "en", "s", 5), (None, "q r s", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("near_copies", "repeated_passages", "benchmark"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, small[0])
        assert rows_of(out, "doc_id", "text", "n_chars") == [(1, None, None), (2, "x y z", 5), (None, "q r s", 5)]


def shingles_of(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_groups(texts):
    """Smallest index of each one's group: components of pairs with a five-word Jaccard index of 0.8 or more."""
    sets, label = [shingles_of(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if label[i] != label[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_pipeline_near_copies_against_five_word_resemblance(spark, small, monkeypatch):
    """Copies edited so that they lie on both sides of 0.8, chains of them, and a dense group in large buckets."""
    import random

    from vertexloom.llm import likeness

    monkeypatch.setattr(likeness, "CELL", 8)
    monkeypatch.setattr(likeness, "SAMPLE", 2)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for size, copies in [(6, 4), (40, 12), (120, 20), (400, 20), (90, 80)]:
        for _ in range(4 if copies < 80 else 1):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(copies):
                w = list(base)
                for _ in range(r.randint(0, max(1, size // 25))):
                    w[r.randrange(size)] = word()
                texts.append(" ".join(w))
                if r.random() < 0.2:
                    base = w  # a chain
    texts += ["", None, " ", "one two", "One Two"]
    r.shuffle(texts)
    label = near_groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.near_copies(spark, docs.repartition(3), small[0]).collect()}
    assert got == set(label) and len(got) < len(texts) / 2
    simhash_keeps = {x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert simhash_keeps != got


def test_pipeline_near_copies_of_clashing_ids(spark, small):
    like = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, like), (1, "quite another text of some more words"), (2, like), (2, like.upper()), (3, "third text here"), (3, "third text here"), (None, like)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_copies(spark, docs, small[0]).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[1], rows[4], rows[6]], key=str)
