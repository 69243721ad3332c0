"""From raw documents to packed token ids: five stages, each written as a table before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm import decontamination, lang_id, mixing, near_dedup, token_packing
from boxmill.llm.scratch import Scratch, shared_root
from boxmill.llm.tables import table, unused

#: A document goes if less than this share of its letters is in known languages, whichever they are.
LEAST_SCORE = 0.5
#: Documents with this percentage of their shingles in common are near-copies; with 24 bands of so many bins a pair at it is
#: found with probability 1 - (1 - 0.8**6)**24, above 0.999.
PERCENT, BAND_ROWS = 80, 6

#: Bytes of text that go to a Python worker at once; it, the JVM and what is worked out hold several times as much.
BATCH_BYTES = 8 << 20


_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Spark reads this setting when a stage's result is computed, which is after the stage function returned: it stays set until run() puts back what was there."""
    spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without letters, and those that no known languages explain for the most part, be it by script or by words; none if no document says its language.

    Null and empty texts have no letters and go; texts are judged whole, however long; repeated rows go or stay together, ids and other columns aren't looked at. An empty table stays one.
    """
    _bounded(spark)
    return lang_id.known_languages(docs, lang_id.train(docs), LEAST_SCORE)


def _with_row_key(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key of each row, and that column's name: doc_id where ids are all there and different.

    Otherwise of the rows with the same id and text the one whose other columns come first as JSON stays, and the rest, sorted by id with nulls last, is
    numbered and written to the shared folder, so that every later reading sees the same rows and keys.
    """
    key, others = unused(docs, "row", "others")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(key, F.col("doc_id")), key
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")])
    named = docs.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias(others)).select("doc_id", "text", f"{others}.*")
    once = named.select(*[f"`{c}`" for c in docs.columns]).union(docs.where("doc_id is null"))
    keyed = once.orderBy(F.col("doc_id").asc_nulls_last(), "text").withColumn(key, F.monotonically_increasing_id())
    return Scratch(spark, "pipeline-keyed").save(keyed, "keyed"), key


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-copies. Documents without an id, and different texts under
    one, are documents of their own.

    Of rows with the same id and text one stays. Null and empty texts are copies of nothing and stay; other columns stay as they are, whatever their names. An empty table stays one.
    """
    _bounded(spark)
    docs, key = _with_row_key(spark, docs)
    (gone,) = unused(docs, "gone")
    found = near_dedup.near_duplicates(docs, key, percent=PERCENT, rows=BAND_ROWS)
    copies = Scratch(spark, "pipeline-dedup").save(found.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(copies, docs[key] == copies[gone], "left_anti").drop(key)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item.

    Null, empty and short texts hold none and stay; long ones are searched whole. Documents without an id, and different texts under one, are judged each on its own; of rows with the
    same id and text one stays. Items without id or words are left out, an empty benchmark lets all stay. Other columns stay; an empty table stays one.
    """
    _bounded(spark)
    docs, key = _with_row_key(spark, docs)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), id_col=key).drop(key)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words meet their target weights.

    Null and empty texts have no words and are taken no times; a null source is a source, a null id an id. Of equal rows any may be the one taken once more. A text longer than
    its source's target is taken or not by the odds of its share. Other columns stay; an empty table stays one.
    """
    return mixing.mixed(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids.

    Null and empty texts are an end mark alone; a text longer than a row is split without loss. Repeated documents, as mixing makes them, are packed each; a null id stays
    null. Other columns don't matter; an empty table gives no rows.
    """
    _bounded(spark)
    return token_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("pack_tokens", pack_tokens),
]

#: Training, near-copies, edit distances, drawn copies and token ids are not SQL; tests/llm holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again, the last one's too; the session's settings are then as they were."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(_BATCH_CONF, None)
    base = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for number, (name, stage) in enumerate(STAGES):
            path = f"{base}/{number}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, before)
    return docs
