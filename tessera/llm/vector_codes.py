"""Vector code compression: product codes whose nearest entries are found by VA-file filtering.

A vector of integers, floor(scale * x), is cut into equal parts, and each part is stored as the index of the
nearest entry of its position's codebook. Codebooks begin as the parts of the first vectors in id order and
settle by rounds of assignment and integer means.

The entries of a codebook are held as a vector approximation file: each coordinate of an entry is known by
the cell it lies in, a few bits. For every part that asks, lookup tables hold the least and the greatest squared
difference to each cell of each coordinate; their sums over an entry's cells bound its distance from below and
above. Entries whose lower bound is above the least upper bound are out; the overlapping ones get their exact
integer distance.

Each round is one pass over the vectors: a task adds up its parts' sums and counts by entry, and those sums, not
vectors, meet. The codebooks (parts * entries * width numbers, whatever the number of vectors) pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Bits of a coordinate's cell.
CELL_BITS = 4
#: Vectors worked at a time in a task.
STEP = 2048
LONG = np.iinfo(np.int64)
#: Components are held within this, so that they are longs.
GREATEST = 2**62
SUMS = "part int, entry int, place int, n long, total decimal(38,0)"


def integer_vectors(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of lists without nulls or non-finite values, cut or filled with zeros to `width`."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(scale * values), -float(GREATEST), float(GREATEST)).astype(np.int64)
    inside = np.arange(width) < np.diff(off)[:, None]
    out = np.zeros((len(column), width), np.int64)
    out[inside] = whole[(off[:-1, None] + np.arange(width))[inside]]
    return out


class Cells:
    """One codebook (entries x coordinates) as a vector approximation file."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS) -> None:
        n = len(entries)
        self.entries = entries
        cells = min(n, 1 << bits)
        order = np.argsort(entries, axis=0, kind="stable")
        rank = np.empty(order.shape, np.int64)
        np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
        self.cell = rank * cells // n
        begin = -(-np.arange(cells + 1) * n // cells)
        ordered = np.take_along_axis(entries, order, axis=0)
        self.low, self.high = ordered[begin[:-1]], ordered[begin[1:] - 1]

    def candidates(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of asked, entry) of all pairs whose bounds overlap the least upper bound, in order."""
        below, above = self.low - asked[:, None, :], asked[:, None, :] - self.high
        least = np.maximum(np.maximum(below, above), 0)
        least *= least
        most = np.minimum(below, above)  # the farther end, its sign turned
        most *= most
        lower = upper = 0
        for k in range(asked.shape[1]):
            lower = lower + least[:, self.cell[:, k], k]
            upper = upper + most[:, self.cell[:, k], k]
        return np.nonzero(lower <= upper.min(axis=1)[:, None])

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, ties to the lower index, and its exact squared distance."""
        row, entry = self.candidates(asked)
        apart = asked[row] - self.entries[entry]
        distance = (apart * apart).sum(axis=1)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        best = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(first, len(row)))))
        own = row[hit]
        return entry[hit[np.append(True, own[1:] != own[:-1])]], best


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes (vectors x parts) and summed squared distances; Python's integers where longs could overflow."""
    parts, _, width = books.shape
    reach = 2 * max(abs(int(a)) for x in (vectors, books) for a in (x.max(initial=0), x.min(initial=0)))
    kind = np.int64 if parts * width * reach * reach < 2**62 else object
    books = books.astype(kind)
    cells = [Cells(book) for book in books]
    codes = np.empty((len(vectors), parts), np.uint8)
    errors = np.zeros(len(vectors), kind)
    for at in range(0, len(vectors), STEP):
        asked = vectors[at : at + STEP].astype(kind)
        for part, file in enumerate(cells):
            codes[at : at + STEP, part], near = file.nearest(asked[:, part * width : (part + 1) * width])
            errors[at : at + STEP] += near
    return codes, errors


def _round_sums(books: np.ndarray, scale: int):
    """(embedding) to the task's counts and sums of each entry's parts, by coordinate."""
    parts, n_entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, n_entries), np.int64)
        totals = np.zeros((parts, n_entries, width), object)
        for batch in batches:
            vectors = integer_vectors(batch.column(0), scale, parts * width)
            codes, _ = assign(vectors, books)
            safe = abs(vectors).max(initial=0) < 2**40
            for part in range(parts):
                own = codes[:, part].astype(np.int64)
                counts[part] += np.bincount(own, minlength=n_entries)
                sums = np.zeros((n_entries, width), np.int64 if safe else object)
                np.add.at(sums, own, vectors[:, part * width : (part + 1) * width].astype(sums.dtype))
                totals[part] += sums.astype(object)
        part, entry = np.nonzero(counts)
        if len(part):
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part, width), pa.int32()),
                    pa.array(np.repeat(entry, width), pa.int32()),
                    pa.array(np.tile(np.arange(width), n), pa.int32()),
                    pa.array(np.repeat(counts[part, entry], width), pa.int64()),
                    pa.array([Decimal(int(t)) for t in totals[part, entry].reshape(-1)], pa.decimal128(38, 0)),
                ],
                names=["part", "entry", "place", "n", "total"],
            )

    return run


def _coded(books: np.ndarray, scale: int, label: pa.DataType):
    """(vec_id, label, embedding) to vec_id, label, code, error."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assign(integer_vectors(batch.column(2), scale, parts * width), books)
            text = codes.tobytes().hex().encode()
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * 2 * parts
            code = pa.StringArray.from_buffers(batch.num_rows, pa.py_buffer(ends), pa.py_buffer(text))
            held = np.array([min(int(e), LONG.max) for e in errors], np.int64) if errors.dtype == object else errors
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(held)], names=["vec_id", "label", "code", "error"])

    return run


def fit_codebooks(kept: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width of a part) of kept(vec_id, embedding), vectors without nulls or
    non-finite components. Fewer vectors than entries: as many entries as vectors; no vector: no entry."""
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    start = integer_vectors(first["embedding"], scale, parts * width)
    books = start.reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(start) else 0):
        sums = kept.select("embedding").mapInArrow(_round_sums(books, scale), SUMS)
        for row in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[row["part"], row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return books


def digest_of(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of vectors(vec_id, embedding, label); other columns are not read.

    Rows whose vector is null or holds a null or non-finite component are left out. Vectors of other lengths than
    the longest, and lengths that `parts` does not divide, are filled with zeros (an empty vector is all zeros).
    Components beyond 2**62 and errors beyond a long are held at that. A null id comes after all others; rows that
    repeat an id are vectors each, in the order of their components. Null labels are one label. Ties between
    entries go to the lower index; an entry that no part has stays. Empty table: empty result.

    Labels' sums are a table that meets the coded rows by label: Spark broadcasts it while it is small by its
    files' size, and beyond that joins by shuffle, where it can split a hot label.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    wrong = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.filter(F.col("embedding").isNotNull() & ~wrong)
    books = fit_codebooks(kept, scale, parts, entries, rounds)
    label = rows.schema["label"].dataType
    out = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = save(kept.select("vec_id", "label", "embedding").mapInArrow(_coded(books, scale, label), out), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(int(LONG.max)))).cast("long")
    sums = save(coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")), "label-errors")
    met = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _assigned(vectors: str, books: str) -> str:
    """SQL of one assignment: r, p, e and d of each part's nearest entry. Inner products of doubles are exact here."""
    return f"""SELECT v.r, v.p, arg_min(b.e, apart * 64 + b.e) AS e, CAST(min(apart) AS BIGINT) AS d FROM {vectors} v JOIN {books} b ON v.p = b.p,
      LATERAL (SELECT list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, b.y) + list_inner_product(b.y, b.y) AS apart) GROUP BY v.r, v.p"""


def _moved(assigned: str, books: str) -> str:
    """SQL of the books after a round: floors of means, unused entries as they were."""
    return f"""SELECT b.p, b.e, coalesce(m.y, b.y) AS y FROM {books} b LEFT JOIN (
      SELECT p, e, list(mean ORDER BY place) AS y FROM (
        SELECT p, e, place, floor(sum(value) / count(*)) AS mean FROM (
          SELECT v.p, a.e, unnest(v.x) AS value, generate_subscripts(v.x, 1) AS place FROM parts v JOIN {assigned} a ON v.r = a.r AND v.p = a.p)
        GROUP BY p, e, place) GROUP BY p, e) m ON b.p = m.p AND b.e = m.e"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)
), b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= 64),
a1 AS MATERIALIZED ({_assigned("parts", "b0")}),
b1 AS MATERIALIZED ({_moved("a1", "b0")}),
a2 AS MATERIALIZED ({_assigned("parts", "b1")}),
b2 AS MATERIALIZED ({_moved("a2", "b1")}),
a3 AS MATERIALIZED ({_assigned("parts", "b2")}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY r),
books AS (
  SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, place)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(y) AS value, generate_subscripts(y, 1) AS place FROM b2)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""
