"""Exact top-k search by multi-resolution segment statistics.

Vectors are made integer, floor(scale * x), and scored by inner product, so a larger score is nearer.
For vectors cut into segments of length w with means m and standard deviations s,

    <q, x>  <=  sum over segments of  w * (m_q * m_x + s_q * s_x)

(Cauchy-Schwarz on what is left after the means), the counterpart for inner products of the lower
bound on distances. It is tighter the finer the segments. Each task goes from coarse to fine, 1, 4
and 16 segments, keeps for each query the candidates whose bound still reaches the query's k-th best
score, and computes exact scores for the survivors. Bounds are widened by a margin above their
rounding error, so no result is lost.

Queries are a stated set against all rows. They are packed into blocks of about QUERY_BLOCK, a row each, and
the rows into chunks, a row each too; a group of GROUP blocks meets every chunk in an equi-join. One
group of a measured size is broadcast, and the vectors are not shuffled; beyond that, chunks and blocks are
shuffled by group and lane, each lane holding a share of the chunks. One plan and one pass, whatever the
number of queries. A task returns k rows a query; the best k of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SCALE = 1024
#: Queries of a block, about: with vectors of some hundred components, a few MB.
QUERY_BLOCK = 2048
#: Blocks that a task holds at a time.
GROUP = 32
#: Blocks of one group are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
RESOLUTIONS = (1, 4, 16)
#: Candidates of a chunk at most, and of those worked at a time in a task.
CHUNK, CHUNK_BYTES, STEP = 4096, 16 << 20, 1024
LONG = np.iinfo(np.int64)

OUT = "query_id long, vec_id long, score long"
PACKED = [pa.field("ids", pa.binary()), pa.field("vectors", pa.binary())]


def integer_matrix(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer vectors as exact doubles, the shorter ones filled with zeros)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    with np.errstate(all="ignore"):
        whole = np.floor(scale * column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & (wrong[off[1:]] == wrong[off[:-1]]))
    width = size[rows].max(initial=1)
    inside = np.arange(width) < size[rows][:, None]
    out = np.zeros((len(rows), width))
    out[inside] = whole[(off[:-1][rows][:, None] + np.arange(width))[inside]]
    return rows, out


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """Candidates as wide as the queries: filled with zeros, or without what meets only zeros."""
    n = vectors.shape[1]
    return vectors[:, :width] if n >= width else np.pad(vectors, ((0, 0), (0, width - n)))


def unpacked(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids.as_buffer(), np.int64)
    return own, np.frombuffer(vectors.as_buffer(), np.float64).reshape(len(own), -1)


def features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(w) times means and deviations, so that a bound is an inner product of two rows."""
    parts = np.array_split(vectors, min(segments, vectors.shape[1]), axis=1)
    means = [p.mean(axis=1) * p.shape[1] ** 0.5 for p in parts]
    spreads = [p.std(axis=1) * p.shape[1] ** 0.5 for p in parts]
    return np.stack(means + spreads, axis=1)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row integer inner products: doubles while all partial sums are below 2**53, else Python's
    integers, held within the range of a long."""
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[1] < 2**53:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)]
    return np.array([min(max(s, LONG.min), LONG.max) for s in sums], np.int64)


class Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.score = np.full((n, k), LONG.min, np.int64)
        self.id = np.full((n, k), LONG.max, np.int64)
        self.count = np.zeros(n, np.int64)

    def floor(self) -> np.ndarray:
        """The score a candidate must reach, minus infinity while a query has fewer than k."""
        return np.where(self.count >= self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.lexsort((ids, -score.astype(float), query))
        query, ids, score = query[order], ids[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        for a, b in zip(first, np.append(first[1:], len(query)), strict=True):
            q = query[a]
            held = int(min(self.count[q], self.k))
            s, i = np.concatenate([self.score[q, :held], score[a:b]]), np.concatenate([self.id[q, :held], ids[a:b]])
            top = sorted(range(len(s)), key=lambda j: (-int(s[j]), int(i[j])))[: self.k] if len(s) < 256 else np.lexsort((i, ~s))[: self.k]
            self.score[q, : len(top)], self.id[q, : len(top)] = s[top], i[top]
            self.count[q] = min(self.k, held + b - a)


class Asked:
    """A block of queries in a task: its vectors, their statistics, and the best of what has come so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.best = ids, queries, Best(len(ids), k)
        self.bounds = [features(queries, r) for r in RESOLUTIONS]
        self.norm = np.linalg.norm(queries, axis=1)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates in: bounds from coarse to fine, exact scores for what is left."""
        width, best = self.queries.shape[1], self.best
        vectors = fitted(vectors, width)
        for at in range(0, len(ids), STEP):
            own, part = ids[at : at + STEP], vectors[at : at + STEP]
            least = best.floor() - 1e-9 * width * (1 + self.norm * np.linalg.norm(part, axis=1).max(initial=0))
            left = self.bounds[0] @ features(part, RESOLUTIONS[0]).T >= least[:, None]
            left &= self.ids[:, None] != own[None, :]
            query, cand = np.nonzero(left)
            for bound, r in zip(self.bounds[1:], RESOLUTIONS[1:], strict=True):
                fine = features(part, r)
                reach = np.empty(len(query))
                for lo in range(0, len(query), 1 << 16):
                    q, c = query[lo : lo + (1 << 16)], cand[lo : lo + (1 << 16)]
                    reach[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", bound[q], fine[c])
                keep = reach >= least[query]
                query, cand = query[keep], cand[keep]
            for lo in range(0, len(query), 1 << 16):
                q, c = query[lo : lo + (1 << 16)], cand[lo : lo + (1 << 16)]
                score = exact_scores(self.queries[q], part[c])
                good = (best.count[q] < best.k) | (score >= best.score[q, -1])
                if good.any():
                    best.add(q[good], own[c[good]], score[good])

    def result(self) -> pa.RecordBatch:
        best = self.best
        n = np.minimum(best.count, best.k)
        held = np.arange(best.k)[None, :] < n[:, None]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, n)), pa.array(best.id[held]), pa.array(best.score[held])], names=["query_id", "vec_id", "score"]
        )


def _search(k: int):
    """(group, lane, ids, vectors, block, query ids, queries), a group's rows together, to the task's best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Asked] = {}
        now = None
        for batch in batches:
            for row in range(batch.num_rows):
                place = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if place != now:
                    yield from (a.result() for a in held.values())
                    held.clear()
                    now = place
                block = batch.column(4)[row].as_py()
                if block not in held:
                    held[block] = Asked(*unpacked(batch.column(5)[row], batch.column(6)[row]), k)
                held[block].meet(*unpacked(batch.column(2)[row], batch.column(3)[row]))
        yield from (a.result() for a in held.values())

    return run


def _pack(scale: int):
    """(vec_id, embedding) to (ids, vectors), a row for up to CHUNK vectors of about the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.ceil(np.log2(np.maximum(1, pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())))
            for own in np.unique(kind):
                alike = batch.filter(pa.array(kind == own))
                step = int(min(CHUNK, max(1, CHUNK_BYTES // 2 ** (own + 3))))
                for at in range(0, alike.num_rows, step):
                    rows, vectors = integer_matrix(alike.column(1).slice(at, step), scale)
                    if len(rows):
                        ids = alike.column(0).slice(at, step).to_numpy(zero_copy_only=False)[rows].astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], schema=pa.schema(PACKED))

    return run


def _blocks(asked: DataFrame, scale: int) -> tuple[DataFrame, int, int]:
    """The queries packed, saved: block, ids, vectors; the number of blocks and their bytes. A block's vectors
    are of about the same length: the lowest 6 bits of its number."""
    n = -(-asked.count() // QUERY_BLOCK) or 1

    def pack(table: pa.Table) -> pa.Table:
        rows, vectors = integer_matrix(table["embedding"], scale)
        ids = table["vec_id"].to_numpy()[rows].astype(np.int64)
        out = [pa.array([table["block"][0].as_py()], pa.int64()), pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])]
        return pa.Table.from_arrays(out, schema=pa.schema([pa.field("block", pa.int64()), *PACKED])).slice(0, int(len(ids) > 0))

    placed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)) * 64 + F.ceil(F.log2(F.size("embedding"))))
    blocks = save(placed.groupBy("block").applyInArrow(pack, "block long, ids binary, vectors binary"), "queries")
    return blocks, n, blocks.agg(F.sum(F.octet_length("vectors") + F.octet_length("ids"))).first()[0] or 0


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest scores, ties to smaller ids.

    vectors(vec_id, embedding); other columns are not read. A vector that is null, empty, or holds a
    null or non-finite component (also once scaled) takes no part, nor does one with a null id. Of
    vectors of different lengths the shorter is filled with zeros. Candidates are the rows of all
    other ids; repeated rows are candidates each, and a query that repeats is asked once, with the
    vector first in order. Fewer than k candidates: all. Empty table: empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    valid = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("embedding") > 0)
    asked = rows.filter(is_query & valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks, n_blocks, n_bytes = _blocks(asked, scale)
    groups = -(-n_blocks // GROUP)
    few = groups == 1 and n_bytes <= BROADCAST_BYTES
    lanes = 1 if few else int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = rows.mapInArrow(_pack(scale), "ids binary, vectors binary").withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    chunks = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    sent = blocks.select("block", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"), F.pmod(F.shiftright("block", 6), F.lit(groups)).cast("int").alias("in_group"))
    sent = sent.withColumn("in_lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    met = chunks.join(F.broadcast(sent) if few else sent.hint("merge"), (F.col("group") == F.col("in_group")) & (F.col("lane") == F.col("in_lane")))
    found = met.select("group", "lane", "ids", "vectors", "block", "query_ids", "queries").mapInArrow(_search(k), OUT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
         CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
) WHERE rank <= 10
"""
