"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix holds as many words as all documents together. A source's target is its share by weight, at
most `max_repeat` times its size, with what is over shared again by weight. Those targets are votes:
blocks of `block_words` words go to the sources by highest quotients vote / (2 * seats + 1). Each
source deals its seats to its shards the same way, with the shards' sizes as votes. Inside a shard the
blocks run through the documents in a seeded order, around again as often as the quota says.

Sizes: a shard holds about the square root of its source's documents, so a source with a third of all
rows is as many shards as a shard has rows; neither a window nor a group grows faster than that
root. The list of sources, a row each, is the mixture's own table and comes to the driver.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import ceil, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .words import word_counts

#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000

SIZED = "doc_id long, source string, size long, key long"
SOURCES = "place int, src string, source_size long, target double, quota long, shards int"


def sainte_lague(votes: Sequence[int | Fraction], seats: int) -> list[int]:
    """Seats by highest quotients v / (2 s + 1); equal quotients go to the earlier entry.

    Starts from the seats of the divisor sum / seats, which differ from the answer by no more than
    the number of entries, and adds or takes the rest one by one.
    """
    total = sum(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    given = [int((2 * v * seats + total) // (2 * total)) for v in votes]
    left = seats - sum(given)
    if left > 0:
        heap = [(-Fraction(v, 2 * s + 1), k) for k, (v, s) in enumerate(zip(votes, given, strict=True)) if v]
        heapq.heapify(heap)
        for _ in range(left):
            _, k = heapq.heappop(heap)
            given[k] += 1
            heapq.heappush(heap, (-Fraction(votes[k], 2 * given[k] + 1), k))
    elif left < 0:
        heap = [(Fraction(v, 2 * s - 1), -k) for k, (v, s) in enumerate(zip(votes, given, strict=True)) if s]
        heapq.heapify(heap)
        for _ in range(-left):
            _, k = heapq.heappop(heap)
            given[-k] -= 1
            if given[-k]:
                heapq.heappush(heap, (Fraction(votes[-k], 2 * given[-k] - 1), k))
    return given


def targets(sizes: Sequence[int], weights: Sequence[int], max_repeat: int = 3) -> list[Fraction]:
    """min(max_repeat * size, level * weight) with the level that makes them sum to the sum of sizes."""
    rest, weight = Fraction(sum(sizes)), sum(weights)
    out = [Fraction(0)] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda k: Fraction(max_repeat * sizes[k], weights[k]))
    for at, k in enumerate(order):
        if max_repeat * sizes[k] <= rest * weights[k] / weight:
            out[k] = Fraction(max_repeat * sizes[k])
            rest -= out[k]
            weight -= weights[k]
        else:
            for j in order[at:]:
                out[j] = rest * weights[j] / weight
            break
    return out


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(word_counts(batch.column(2))), batch.column(3)],
            names=["doc_id", "source", "size", "key"],
        )


def _shard_quotas(block_words: int, max_repeat: int):
    def run(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        sizes = [int(x) for x in shards["shard_size"]]
        seats = sainte_lague(sizes, int(shards["quota"].iloc[0]))
        takes = [min(s * block_words, max_repeat * n) for s, n in zip(seats, sizes, strict=True)]
        return pd.DataFrame({"at_place": shards["place"], "at_shard": shards["shard"], "shard_words": sizes, "take": takes})

    return run


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    block_words: int = 8,
    seed: int = 42,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    key: str | None = None,
) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source, size, source_size, target, taken, one row per input row. Sources in
    code-point order, null last as a source of its own, have the weights in turn. Null or empty text:
    size 0, taken 0. A source's words come within block_words of its target, or half of that for
    each of its shards where the cap max_repeat * size binds. The order inside a shard is by a hash
    of seed and id, then id, then size, so reruns agree and rows that repeat an id (or have none) may
    only swap among equals. A column of longs named as `key` is carried as key, and settles the order of equals. Other columns are not read. Empty table: empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), (F.col(key) if key else F.lit(None)).cast("long").alias("key"))
    sized = save(rows.mapInArrow(_sized, SIZED), "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"]))
    sizes = [int(r["size"]) for r in found]
    aims = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], max_repeat)
    quotas = sainte_lague(aims, -(-sum(sizes) // block_words))
    listed = [
        (k, r["source"], size, float(aim), quota, ceil(sqrt(r["n"])))
        for k, (r, size, aim, quota) in enumerate(zip(found, sizes, aims, quotas, strict=True))
    ]
    sources = docs.sparkSession.createDataFrame(listed, SOURCES)
    if len(listed) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    placed = (
        sized.join(sources, sized["source"].eqNullSafe(sources["src"]))
        .withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
        .withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards"))
        .drop("src", "shards")
    )
    shards = placed.groupBy("place", "shard", "quota").agg(F.sum("size").alias("shard_size"))
    takes = shards.groupBy("place").applyInPandas(
        _shard_quotas(block_words, max_repeat), "at_place int, at_shard long, shard_words long, take long"
    )
    before = F.sum("size").over(
        Window.partitionBy("place", "shard").orderBy("order", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("size")
    laid = placed.withColumn("before", before)
    full = F.when(F.col("shard_words") > 0, F.floor(F.col("take") / F.col("shard_words"))).otherwise(0)
    rest = F.col("take") - full * F.col("shard_words")
    taken = full * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return laid.join(takes, (laid["place"] == takes["at_place"]) & (laid["shard"] == takes["at_shard"])).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["key"] if key else [])
    )


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes its text, to the nearest whole number of times
    (halves up); all columns are kept. Each row counts for itself, also rows that share an id or have none: docs is saved with a
    key for each row. Rows without words are taken no time."""
    keyed = save(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "mix-rows")
    taken = mix(keyed.select("row.doc_id", "row.source", "row.text", "key"), key="key", **options).filter("size > 0")
    times = taken.select(F.col("key").alias("mix_key"), F.floor(F.col("taken") / F.col("size") + 0.5).alias("times")).filter("times > 0")
    joined = keyed.join(times, keyed["key"] == times["mix_key"])
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("turn")).select("row.*")


ORACLE_SQL = r"""
WITH z AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS size, ceil(sqrt(count(*)))::BIGINT AS shards FROM z GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s
), r AS (  -- by size for each weight: those before a source are full, the rest share what is left
  SELECT *, sum(size) OVER () - coalesce(sum(3 * size) OVER up, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER up, 0) AS left_weight
  FROM w WINDOW up AS (ORDER BY 3 * size / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
  SELECT min_by(rest, 3 * size / weight::DOUBLE) AS rest, min_by(left_weight, 3 * size / weight::DOUBLE) AS left_weight FROM r WHERE 3 * size * left_weight > rest * weight
), t AS (
  SELECT w.*, CASE WHEN cut.rest IS NULL OR 3 * size * cut.left_weight <= cut.rest * weight THEN 3 * size * coalesce(cut.left_weight, 1) ELSE cut.rest * weight END AS vote,
         coalesce(cut.left_weight, 1) AS share FROM w, cut
), q AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place FROM t, (SELECT unnest(generate_series(0, (SELECT CAST(sum(size) // 8 + 1 AS BIGINT) FROM s))) AS k) WHERE vote > 0
    ORDER BY vote / (2 * k + 1)::DOUBLE DESC, place LIMIT (SELECT ceil(sum(size) / 8.0)::BIGINT FROM s)) GROUP BY place
), d AS (
  SELECT z.*, t.place, t.size AS source_size, vote / share::DOUBLE AS target, quota, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON q.place = t.place
), g AS (
  SELECT place, shard, any_value(quota) AS quota, sum(size)::BIGINT AS words FROM d GROUP BY place, shard
), b AS (
  SELECT place, shard, count(*) AS seats FROM (
    SELECT g.place, g.shard, g.quota, row_number() OVER (PARTITION BY g.place ORDER BY words / (2 * k + 1)::DOUBLE DESC, g.shard) AS i
    FROM g, LATERAL (SELECT unnest(generate_series(0, g.quota)) AS k) WHERE words > 0) WHERE i <= quota GROUP BY place, shard
), e AS (
  SELECT d.*, words, least(coalesce(seats, 0) * 8, 3 * words) AS take,
         sum(size) OVER (PARTITION BY d.place, d.shard ORDER BY h, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN g ON d.place = g.place AND d.shard = g.shard LEFT JOIN b ON b.place = d.place AND b.shard = d.shard
)
SELECT doc_id, size, source_size, target,
       CASE WHEN words = 0 THEN 0 ELSE CAST(take // words * size + greatest(0, least(size, take % words - before)) AS BIGINT) END AS taken FROM e
"""
