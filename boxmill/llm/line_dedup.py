"""Repeated lines across documents: range-partitioned line hashes, first occurrences, keep bitmaps. JVM-side throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boxmill.llm.scratch import Scratch
from boxmill.llm.tables import SPACES, ascii_lower, table

#: Keys shorter than this stay wherever they are.
MIN_CHARS = 10
#: A line's documents are dealt to 1 / SPREAD of the square root of the number of lines places before they meet; so neither what meets in one place
#: nor the number of places that then meet grows faster than that root, whatever share of the documents a line is in.
SPREAD = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, pos, h, h2) for each line that is long enough, with 128 bits of hash of its key."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(ascii_lower(text))).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACES))
    rows = rows.where(F.col("doc_id").isNotNull() & (F.length("line") >= min_chars)).select("doc_id", "text_hash", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    return rows.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, dropped) for each document that loses lines.

    `dropped` is a compressed bitmap of the lines to drop: a map from a block of 64 lines to a long with a bit for
    each; blocks without a dropped line are left out. text_hash tells rows of one doc_id with different texts apart.

    The lines' keys (trimmed, A-Z lower-cased) are hashed to 128 bits and written, so that texts are read and split once. The hashes are range-partitioned with a salt of the
    document and sorted by document and position. Streaming through a sorted run, every row of another document than
    the run's first is a later occurrence. The runs' first documents meet by hash alone;
    there too all but the first are later occurrences. The number of salts follows from the number of lines, so a hot line's runs, and
    its rows in the second exchange, are both of the order of its square root.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.save(_occurrences(docs, id_col, text_col, min_chars), "lines")
    salts = max(1, math.ceil(math.sqrt(lines.count()) / SPREAD))
    rows = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    run = W.partitionBy("h", "h2", "salt").orderBy("doc_id", "pos")
    rows = rows.repartitionByRange("h", "h2", "salt").withColumn("first", F.first("doc_id").over(run))
    rows = scratch.save(rows.drop("salt"), "runs")
    scratch.drop(lines)
    later = rows.where("doc_id > first").drop("first")
    firsts = rows.where("doc_id = first").withColumn("first", F.first("doc_id").over(W.partitionBy("h", "h2").orderBy("doc_id", "pos")))
    dropped = later.union(firsts.where("doc_id > first").drop("first"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    blocks = dropped.groupBy("doc_id", "text_hash", F.shiftright("pos", 6).alias("block")).agg(F.bit_or(bit).alias("bits"))
    return blocks.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("block", "bits"))).alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """The lines that a bitmap of keep_bitmaps() leaves, joined by newlines; all of them for null."""
    def stays(_: Column, i: Column) -> Column:
        bits = F.coalesce(F.try_element_at(dropped, F.shiftright(i, 6)), F.lit(0).cast("long"))
        return F.call_function("shiftrightunsigned", bits, i.bitwiseAND(63)).bitwiseAND(1) == 0

    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(_lines(text), stays), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for each row of docs, text being what stays.

    A null or empty text is one empty line, which stays. A line found in several documents stays in the smallest doc_id
    that holds it, there as often as it occurs. Repeated rows of a doc_id are one document.
    A row with a null doc_id keeps all its lines and doesn't count as holding them. An empty table gives
    no rows; other columns don't matter.
    """
    # Named so that no column of docs can clash.
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bitmaps = keep_bitmaps(docs, "doc_id", "text", min_chars)
    rows = docs.withColumn("text_hash", F.xxhash64("text")).join(bitmaps, ["doc_id", "text_hash"], "left")
    n = F.aggregate(F.map_values("dropped"), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    return rows.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"), kept_text(F.col("text"), F.col("dropped")).alias("text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line deduplication leaves of every document, as a digest."""
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), marked AS (
  SELECT doc_id, pos, line, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
