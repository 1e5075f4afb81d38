"""Corpus pipeline: language ID, near-dedup (SimHash and exact five-word resemblance), suffix dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. A stage that cuts a text sets n_chars to the new length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import fmindex, langid, likeness, packing, suffixes
from vertexloom.llm.common import stored, table, text_or_empty

LEAST_SCORE = 0.5
REPEAT_BYTES = 50


def plain(docs: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but the named ones called by their places, since names may clash; and the names it has."""
    names = [c if c in named else f"__c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language: not `und`, and a score of LEAST_SCORE or more. Without labels all with letters stay.

    A null text goes; a null doc_id or lang changes nothing; repeated rows are kept or go together.
    """
    rows, names = plain(docs, "doc_id", "text", "lang")
    langs, weights, prior = langid.train(rows, ~langid.held_out())
    marked = langid.predict(rows, langs, weights, prior)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return marked.filter(sure if langs else F.col("text").rlike(r"\p{L}")).select(names).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of near copies: components of a resemblance of five-word shingles of 0.8 or more.

    SimHash proposes the links and shared prefixes what it misses; the sets of shingles decide. Rows without a doc_id
    stay. Unlike texts under one doc_id are groups of their own and all stay; of like ones the
    text with the smallest hash stays, of repeated rows one. A null text is an empty one.
    """
    rows, names = plain(docs, "doc_id", "text")
    found = likeness.near_copies(rows)
    keep = found.groupBy("component").agg(F.min(F.struct("doc_id", "tie")).alias("row")).select("row.doc_id", "row.tie")
    keep = stored(keep.join(found, ["doc_id", "tie"]).groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n")), "keep")
    at = {"doc_id": F.col("doc_id").cast("long"), "tie": F.xxhash64(text_or_empty())}
    marked = rows.withColumns({f"near_{c}": x for c, x in at.items()})
    kept = marked.join(keep.toDF("near_doc_id", "near_tie", "near_n").drop("near_n").hint("shuffle_hash"), ["near_doc_id", "near_tie"], "left_semi")  # the same plan at every size
    if not keep.filter("n > 1").isEmpty():  # repeated rows: one of each text
        kept = kept.dropDuplicates(["near_doc_id", "near_tie"])
    return kept.select(names).union(rows.filter("doc_id is null")).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what repeats a passage of an earlier document; a document of which no visible character is left goes.

    A null text stays null and is kept; a null doc_id counts as the smallest; repeated rows have one id, so they don't cut each other.
    """
    rows, names = plain(docs, "doc_id", "text")
    rows = rows.withColumn("__whole", F.col("text").isNotNull())
    kept = suffixes.remove_repeats(rows, REPEAT_BYTES, text=True, carry=tuple(c for c in rows.columns if c not in ("doc_id", "text")))
    cut = kept.filter((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    cut = cut.withColumn("text", F.when(F.col("__whole"), F.col("kept")))
    return changed(cut, docs, names, F.col("n_removed") > 0)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents (a twentieth of the words hit, or more) and cuts hit words from the others.

    Null and empty texts have no words and are kept; repeated rows are kept or go together.
    """
    rows, names = plain(docs, "text")
    found = fmindex.contamination(rows, table(spark, sf_dir, "benchmark"), cut=True)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    clean = found.withColumn("n_hit", n_hit).filter("n_hit = 0 or 20 * n_hit < n_words")
    return changed(clean, docs, names, F.col("n_hit") > 0)


def changed(df: DataFrame, docs: DataFrame, names: list[str], cut: Column) -> DataFrame:
    """The columns of docs, which df has under other names; n_chars is counted anew where a text was cut."""
    out = []
    for f, name in zip(docs.schema, names, strict=True):
        c = F.col(name)
        if f.name == "n_chars":
            c = F.when(cut, F.length("text")).otherwise(c).cast(f.dataType)
        out.append(c.alias(name))
    return df.select(*out).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = packing.pack(docs, length=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("pack", pack),
]

# Packing and the model of languages have no counterpart in SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
