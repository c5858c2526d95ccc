"""Benchmark decontamination: short test items found inside documents of any length.

Both sides are sets of five-word shingles (words.py); an item of fewer words has one shingle, its
whole sequence, looked for among the documents' runs of as many words. An item is found where at
least `percent` of its shingles are in the document.

The MinHash sketch is one-sided. An ordinary sketch of a long document keeps next to nothing of a
short passage in it (their Jaccard similarity is about the ratio of their lengths), so the document
is not sketched: all its shingles are looked up. An item is sketched by its bottom-k MinHash values,
with k by size partition. Partitions are powers of two of the item's set size; in the one up to U, an
item at the threshold can lack (100 - percent) % of U shingles at most, so with one value more than
that in its sketch, at least one must occur in any document that contains it. Hence no containment
is missed. A partition is passed over for documents with fewer shingles than its smallest item needs.
What the sketches bring up is verified by the exact containment of the full sets.

Items of a measured size up to INDEX_BYTES of text are sent to all tasks as one index: one pass over the
documents without a shuffle. Beyond that they are a table of hashes. Documents then give the shingles that
pass a bitmap of fixed size of all items' shingles, and both meet by hash: first with the sketches, which
brings up pairs, then with the full sets, which are counted. No step depends on the number of items
but by its rows, and nothing of them but the bitmap reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import WIDTH, shingle_hashes, slabs, word_bounds, word_hashes

#: Text of the items that can go to the tasks as one index.
INDEX_BYTES = 8 << 20
_FILTER = 1 << 20
#: Bits of the bitmap beyond that.
BITMAP_BITS = 1 << 26
BITMAP_ROW = 1 << 15  # of Spark's bitmap functions

OUT = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def item_sets(texts: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """Each item's sorted distinct shingle hashes, and its shingles' width."""
    sets: list[np.ndarray] = []
    widths: list[int] = []
    with np.errstate(over="ignore"):
        for _, _, data, off in slabs(texts):
            start, end, first = word_bounds(data, off)
            hashes, at = shingle_hashes(word_hashes(data, start, end), first)
            sets += [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            widths += np.minimum(np.diff(first), WIDTH).tolist()
    return sets, widths


def sketch_size(n: int, percent: int) -> int:
    """Values in the sketch of a set of n: one more than what may be lacking from any set of its partition."""
    return (100 - percent) * (1 << (n - 1).bit_length()) // 100 + 1


class Index:
    """The sketches and full sets of items, by shingle width."""

    def __init__(self, ids: list[int | None], texts: pa.Array, percent: int) -> None:
        self.percent, self.ids = percent, ids
        self.sets, widths = item_sets(texts)
        #: (width, least shingles a document needs, sorted sketch values, their items, filter) by partition
        self.partitions = []
        of: dict[tuple[int, int], list[int]] = {}
        for k, s in enumerate(self.sets):
            if len(s):
                of.setdefault((widths[k], (len(s) - 1).bit_length()), []).append(k)
        for (width, power), items in sorted(of.items()):
            sketch = sketch_size(1 << power, percent)
            values = np.concatenate([self.sets[k][:sketch] for k in items])
            owner = np.concatenate([np.full(min(sketch, len(self.sets[k])), k) for k in items])
            order = np.argsort(values, kind="stable")
            quick = np.zeros(_FILTER, bool)
            quick[values & np.uint64(_FILTER - 1)] = True
            need = min(self.need(len(self.sets[k])) for k in items)
            self.partitions.append((width, need, values[order], owner[order], quick))

    def need(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def find(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the rows of one slab."""
        by_width = {w: shingle_hashes(words, first, w) for w in {p[0] for p in self.partitions}}
        for width, need, values, owner, quick in self.partitions:
            hashes, off = by_width[width]
            at = np.flatnonzero(quick[hashes & np.uint64(_FILTER - 1)])
            lo, hi = np.searchsorted(values, hashes[at], "left"), np.searchsorted(values, hashes[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            rows = np.searchsorted(off, at, "right") - 1
            large = off[rows + 1] - off[rows] >= need
            seen: dict[int, set[int]] = {}
            for row, a, b in zip(rows[large].tolist(), lo[large].tolist(), hi[large].tolist(), strict=True):
                seen.setdefault(row, set()).update(owner[a:b].tolist())
            for row, items in seen.items():
                own = np.unique(hashes[off[row] : off[row + 1]])
                for k in sorted(items):
                    place = np.minimum(np.searchsorted(own, self.sets[k]), len(own) - 1)
                    shared = int((own[place] == self.sets[k]).sum())
                    if shared >= self.need(len(self.sets[k])):
                        yield row, k, shared


def _search(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slabs(batch.column(1)):
                with np.errstate(over="ignore"):
                    start, end, first = word_bounds(data, off)
                    found = list(index.find(word_hashes(data, start, end), first))
                if found:
                    ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                    sizes = [len(index.sets[k]) for _, k, _ in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[r] for r, _, _ in found], pa.int64()),
                            pa.array([index.ids[k] for _, k, _ in found], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([s for _, _, s in found], pa.int64()),
                            pa.array([s / n for (_, _, s), n in zip(found, sizes, strict=True)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

    return run


def _item_rows(percent: int):
    """(item, item_id, text) to a row for each distinct shingle; `rank` counts an item's hashes from the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, widths = item_sets(batch.column(2))
            for lo in range(0, len(sets), 1024):
                own, size = sets[lo : lo + 1024], np.array([len(s) for s in sets[lo : lo + 1024]])
                if size.sum():
                    index = pa.array(np.repeat(np.arange(lo, lo + len(own)), size))
                    rank = np.concatenate([np.arange(n) for n in size])
                    sketch = np.array([sketch_size(int(n), percent) if n else 0 for n in size])
                    columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.repeat(np.array(widths[lo : lo + 1024], np.int32), size))]
                    columns += [pa.array(np.repeat(size, size)), pa.array(np.concatenate(own).view(np.int64)), pa.array(rank < np.repeat(sketch, size))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "width", "n_item", "value", "sketched"])

    return run


def _probes(widths: list[int], bitmap: np.ndarray):
    """(row, doc_id, text) to the distinct shingles of these widths that the bitmap lets pass; n_doc is the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slabs(batch.column(2)):
                with np.errstate(over="ignore"):
                    start, end, first = word_bounds(data, off)
                    words = word_hashes(data, start, end)
                    for width in widths:
                        hashes, at = shingle_hashes(words, first, width)
                        place = np.repeat(np.arange(hi - lo), np.diff(at))
                        spot = hashes & np.uint64(BITMAP_BITS - 1)
                        there = (bitmap[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        found = np.unique(np.stack([place[there].astype(np.uint64), hashes[there]], axis=1), axis=0)
                        if len(found):
                            index = pa.array(found[:, 0].astype(np.int64) + lo)
                            n_doc = np.diff(at)[found[:, 0].astype(np.int64)]
                            columns = [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.full(len(found), width, np.int32)), pa.array(n_doc)]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 1].view(np.int64))], names=["row", "doc_id", "width", "n_doc", "value"])

    return run


def _bitmap(values: DataFrame) -> np.ndarray:
    """The bits of all values' lowest bits, made by Spark's bitmap functions: at most BITMAP_BITS bits reach the driver."""
    spot = F.col("value").bitwiseAND(F.lit(BITMAP_BITS - 1)) + 1  # the functions count from 1
    rows = values.groupBy(F.bitmap_bucket_number(spot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row["at"] - 1) * (BITMAP_ROW // 8)
        out[at : at + BITMAP_ROW // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def _joined(rows: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Pairs by joins on hashes, for items of any number."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    full = save(numbered.mapInArrow(_item_rows(percent), "item long, item_id long, width int, n_item long, value long, sketched boolean"), "items")
    widths = sorted(r["width"] for r in full.select("width").distinct().collect())  # WIDTH of them at most
    docs = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    probes = save(docs.mapInArrow(_probes(widths, _bitmap(full)), "row long, doc_id long, width int, n_doc long, value long"), "probes")
    need = F.ceil(F.lit(percent) * F.col("n_item") / 100)
    sketches = full.filter("sketched").select("item", "width", "value", need.alias("need"))
    pairs = save(probes.join(sketches, ["width", "value"]).filter("n_doc >= need").select("row", "item").distinct(), "pairs")
    sets = full.select("item", "item_id", "n_item", "width", "value")
    shared = probes.select("row", "doc_id", "width", "value").join(pairs, "row").join(sets, ["item", "width", "value"])
    counted = shared.groupBy("row", "doc_id", "item", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    return counted.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def contaminated(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs of a document and a benchmark item it contains, with the sizes that say so.

    docs(doc_id, text), items(item_id, text); other columns are not read. Null or empty texts, or
    ones without words, are in no pair, on either side. A null id is carried as null. Repeated rows
    of either side give repeated pairs. Containment equal to the threshold counts. With either table
    empty the result is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked, index = _index(items, percent)
    if index is None:
        return _joined(rows, asked, percent)
    return rows.mapInArrow(_search(index), OUT)


def _index(items: DataFrame, percent: int) -> tuple[DataFrame, Index | None]:
    """The items with text, and their index where their measured size allows one."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text IS NOT NULL")
    if (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > INDEX_BYTES:
        return asked, None
    few = asked.toArrow()
    return asked, Index(few["item_id"].to_pylist(), few["text"], percent)


def clean(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose own text contains no item, with all their columns; an id, null or repeated, does not matter.

    With an index of the items this is one pass without a shuffle. Beyond its size the rows are numbered in
    a saved table, and those that are found are joined out.
    """
    asked, index = _index(items, percent)
    if index is None:
        number = "row"
        while number in docs.columns:
            number += "_"
        numbered = save(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
        found = _joined(numbered.select(F.col(number).alias("doc_id"), "text"), asked, percent).select(F.col("doc_id").alias(number)).distinct()
        return numbered.join(found, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, data, off in slabs(batch.column(at)):
                with np.errstate(over="ignore"):
                    start, end, first = word_bounds(data, off)
                    for row, _, _ in index.find(word_hashes(data, start, end), first):
                        keep[lo + row] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x20\x09-\x0D]+') AS w FROM benchmark
), m AS (
  SELECT item_id, least(len(w), 5) AS width, w FROM b WHERE len(w) > 0
), i AS (
  SELECT DISTINCT item_id, width, array_to_string(list_slice(w, k, k + width - 1), ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, len(w) - width + 1)) AS k FROM m)
), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
s AS (
  SELECT DISTINCT doc_id, width, array_to_string(list_slice(w, k, k + width - 1), ' ') AS s
  FROM (SELECT d.*, v.width, unnest(generate_series(1, len(w) - v.width + 1)) AS k
        FROM d, (SELECT DISTINCT width FROM m) v WHERE len(w) >= v.width)
)
SELECT s.doc_id, i.item_id, any_value(n.n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared,
       count(*) / any_value(n.n_item)::DOUBLE AS containment
FROM s JOIN i ON s.s = i.s AND s.width = i.width JOIN n ON n.item_id = i.item_id
GROUP BY s.doc_id, i.item_id HAVING 100 * count(*) >= 80 * any_value(n.n_item)
"""
