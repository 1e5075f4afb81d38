"""The thin queries over the operators: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wavelet import read_shards, write_shards

    shards = write_shards(table(spark, sf_dir, "documents"), end_id=2)
    return read_shards(spark, shards, tokens=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    written = write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    records = read_archives(spark, [r.archive for r in written.select("archive").collect()])
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    packed = pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    docs = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    body = F.encode(text_or_empty(), "UTF-8")
    return docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sketch import fingerprint_edits

    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), *train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), length=50, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import contamination

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=13)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    rows = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_html_text": op4_html_text,
    "op5_sharding": op5_sharding,
    "op6_fingerprints": op6_fingerprints,
    "op7_simhash": op7_simhash,
    "op8_language": op8_language,
    "op9_suffixes": op9_suffixes,
    "op10_decontaminate": op10_decontaminate,
}
ORACLE_SQL: dict[str, str] = {}
