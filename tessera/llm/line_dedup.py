"""Line dedup: drop the lines that many documents share.

Built of DataFrame functions alone: lines are exploded, normalised and hashed, distinct documents
are counted for each hash, the places of lines over the threshold are gathered per document, and
the text is put together again from the places that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, save


def line_key(line: Column) -> Column:
    """The line without white space [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def drop_common_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents without the lines whose key `min_docs` documents or more hold.

    Returns doc_id, text (the whole text), kept_text, n_lines, n_dropped, one row per input row.
    Null or empty text: one empty line. A null id counts as one more document. Rows that share an
    id are one document for the counts; each keeps a row of its own. Ties do not arise: a key goes
    everywhere or nowhere. Other columns of the input are not carried. Empty table: empty result.

    The first scan keeps (id, text hash, place, key hash) in the shared folder, so normalising runs
    once; a key is known by 64 + 32 hash bits and its length. Distinct (key, document) pairs are
    counted in two steps, so a line of every document is already summed before its shuffle, and the
    join back to the places is a sort-merge join that adaptive execution splits at a hot key.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = rows.withColumn("row_hash", F.xxhash64("text"))
    keyed = row.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n")).alias("place", "line")).select(
        "doc_id", "row_hash", "place", line_key(F.col("line")).alias("key")
    )
    lines = save(
        keyed.filter(F.char_length("key") >= max(min_chars, 1)).select(
            "doc_id", "row_hash", "place", F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), F.char_length("key").alias("k3")
        ),
        "lines",
    )
    # distinct() first, then count: partial sums leave each task with one row per key. Saved, so that
    # the join below has an exchange on both sides, which adaptive execution needs to split a hot key
    counts = lines.select("k1", "k2", "k3", "doc_id").distinct().groupBy("k1", "k2", "k3").count()
    common = save(counts.filter(F.col("count") >= min_docs).select("k1", "k2", "k3"), "common-lines")
    gone = (
        lines.join(common, ["k1", "k2", "k3"])
        .groupBy("doc_id", "row_hash")
        .agg(F.collect_set("place").alias("gone"))
        .withColumnRenamed("doc_id", "gone_id")
        .withColumnRenamed("row_hash", "gone_hash")
    )
    joined = row.join(gone, row["doc_id"].eqNullSafe(gone["gone_id"]) & (row["row_hash"] == gone["gone_hash"]), "left")
    parts = F.split("text", "\n")
    # array_contains would be quadratic in a text of many lines; a map lookup table is not
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(
            F.transform(
                F.filter(F.arrays_zip(parts.alias("line"), _flags(parts).alias("drop")), lambda x: ~x["drop"]), lambda x: x["line"]
            ),
            "\n",
        )
    )
    return joined.select(
        "doc_id",
        "text",
        left.alias("kept_text"),
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _flags(parts: Column) -> Column:
    """For each place, whether it is in gone: one walk over the sorted places, by their gaps."""
    places = F.array_sort("gone")
    ends = F.concat(F.array(F.lit(-1)), places)
    gaps = F.zip_with(ends, F.concat(places, F.array(F.size(parts))), lambda a, b: b - a - 1)
    runs = F.transform(gaps, lambda g: F.concat(F.array_repeat(F.lit(False), g), F.array(F.lit(True))))
    return F.slice(F.flatten(runs), 1, F.size(parts))


def digest(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that stays."""
    return drop_common_lines(docs, min_docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), k AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), f AS (
  SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common ON k.key = common.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
