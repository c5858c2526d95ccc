"""Periodic runs of words: stretches in which words q apart are identical, found by a scan of all lags.

The words of a text are numbered and compared with themselves at each shift q up to a quarter of their number;
stretches of equal words of at least max(LEAST - q, (EXPONENT - 1) * q) are runs of period q. Such a stretch
holds a place that is a multiple of that length, so each shift is first compared at these places alone, for all texts of a
slab at once, and then, in a text with a hit, at all places, whose stretches are run-length coded.

A stretch that is found at several shifts has the smallest of them as its period: if its smallest period is d,
then d divides every other shift that finds it (Fine and Wilf, as it is four periods long), and what is found at d is
the same stretch. So shifts can be scanned apart: texts over LONG_BYTES become rows of a range of lags
each, of a bounded number of comparisons, dealt over all tasks; their stretches meet by text and place. Shorter
texts are scanned where they are read, without a shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save
from .words import slabs, word_bounds

#: A run is at least EXPONENT periods and LEAST words long.
EXPONENT, LEAST = 4, 6
#: Texts of more bytes are scanned in ranges of lags.
LONG_BYTES = 1 << 16
#: Comparisons of a range of lags, about.
RANGE_WORK = 1 << 24
#: Words joined at a time for a hash.
JOINED = 1 << 16
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False

FOUND = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
STRETCHES = "key long, start long, length long, period long"


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal where the words are."""
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data[_SOLID[data]])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32)


def repeated_places(doc_id: int | None, n: int) -> np.ndarray | None:
    """The original place of each of n words, for the tenth of the ids whose words repeat from a place on; None
    for the others, and for a null id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    place = np.arange(n)
    place[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return place


def stretches(ids: np.ndarray, first: np.ndarray, low: int = 1, high: int | None = None) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of the runs at the lags low to high (all) of rows of word numbers, `first`
    their bounds; ordered by row, start and period. Of equal stretches the smallest lag that was scanned stays."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")  # longest first, so that a lag concerns a prefix
    size = count[order]
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = ids[np.repeat(first[:-1][order] - begin[:-1], size) + np.arange(begin[-1])]
    row_of = np.repeat(np.arange(len(size)), size)
    found: list[tuple[int, np.ndarray, np.ndarray, int]] = []
    top = int(size[0]) // EXPONENT if len(size) else 0
    for q in range(low, min(top, top if high is None else high) + 1):
        need = max(LEAST, EXPONENT * q)
        rows = int(np.searchsorted(-size, -need, "right"))
        stop = int(begin[rows]) - q  # places that have a word q on
        if not rows:
            break
        step = need - q
        hit = np.flatnonzero(words[:stop:step] == words[q : stop + q : step]) * step
        if len(hit) and step > 2:  # two more at its sides, as a stretch of three or more has
            same = [words[at] == words[at + q] for at in (np.clip(hit + k, 0, stop - 1) for k in (-2, -1, 1, 2))]
            hit = hit[same[0] & same[1] | same[1] & same[2] | same[2] & same[3]]
        for row in np.unique(row_of[hit[row_of[hit] == row_of[hit + q]]]):
            own = words[begin[row] : begin[row + 1]]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own[:-q] == own[q:], [False]])))
            start, length = edge[::2], edge[1::2] - edge[::2]
            good = length >= step
            if good.any():
                found.append((int(order[row]), start[good], length[good] + q, q))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    n = [len(f[1]) for f in found]
    row, period = np.repeat([f[0] for f in found], n), np.repeat([f[3] for f in found], n)
    start, length = np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])
    return smallest_periods(row, start, length, period)


def smallest_periods(row: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One of equal stretches, that of the smallest period; ordered by row, start and period."""
    order = np.lexsort((period, length, start, row))
    row, start, length, period = row[order], start[order], length[order], period[order]
    new = np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(row)]
    row, start, length, period = row[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, row))
    return row[order], start[order], length[order], period[order]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    return np.flatnonzero(np.cumsum(cover[:n]) == 0)


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run of the greatest exact length / period, ties to the smallest start, then period."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(min(near, key=lambda k: (-Fraction(int(length[k]), int(period[k])), start[k], period[k])))


def _digest(raw: bytes, begin: np.ndarray, end: np.ndarray, place: np.ndarray | None, runs: tuple[np.ndarray, ...]) -> tuple:
    """What FOUND returns of a text, its words at begin to end, in the order of `place` if that is given."""
    start, length, period = runs
    n = len(begin) if place is None else len(place)
    best = strongest(start, length, period) if len(start) else None
    kept = kept_words(n, start, length, period) if len(start) else np.arange(n)
    kept = kept if place is None else place[kept]
    listed, joined = hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(start), JOINED):
        part = zip(start[at : at + JOINED].tolist(), length[at : at + JOINED].tolist(), period[at : at + JOINED].tolist(), strict=True)
        listed.update("".join(f"{s},{m},{p}\n" for s, m, p in part).encode())
    for at in range(0, len(kept), JOINED):
        own = kept[at : at + JOINED]
        joined.update(b" " * (at > 0) + b" ".join([raw[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True)]))
    of = (None,) * 4 if best is None else (int(start[best]), int(length[best]), int(period[best]), 1000 * int(length[best]) // int(period[best]))
    return (len(start), *of, listed.hexdigest(), joined.hexdigest())


def _table(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return pa.RecordBatch.from_arrays([ids, *columns], names=names)


def _slab_words(ids: list, data: np.ndarray, off: np.ndarray):
    """Of a slab: (word begins, ends, bounds of the rows, numbers of the words as they repeat, each row's places)."""
    begin, end, first = word_bounds(data, off)
    places = [repeated_places(doc_id, int(n)) for doc_id, n in zip(ids, np.diff(first), strict=True)]
    numbers = word_ids(data, begin, end)
    for row, place in enumerate(places):
        if place is not None:
            numbers[first[row] : first[row + 1]] = numbers[first[row] + place]
    return begin, end, first, numbers, places


def _scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to FOUND, all lags of whole texts."""
    for batch in batches:
        for lo, hi, data, off in slabs(batch.column(1)):
            ids = batch.column(0).slice(lo, hi - lo)
            begin, end, first, numbers, places = _slab_words(ids.to_pylist(), data, off)
            row, *runs = stretches(numbers, first)
            bound, raw = np.searchsorted(row, np.arange(hi - lo + 1)), data.tobytes()
            done = []
            for k, place in enumerate(places):
                own = slice(first[k], first[k + 1])
                done.append(_digest(raw, begin[own], end[own], place, tuple(r[bound[k] : bound[k + 1]] for r in runs)))
            yield _table(ids, done)


def _number_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, text, n and the words' numbers as 4-byte integers."""
    for batch in batches:
        for lo, hi, data, off in slabs(batch.column(1)):
            own = batch.slice(lo, hi - lo)
            _, _, first, numbers, _ = _slab_words(own.column(0).to_pylist(), data, off)
            packed = [numbers[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [own.column(0), own.column(1), pa.array(np.diff(first)), pa.array(packed, pa.binary())], names=["doc_id", "text", "n", "numbers"]
            )


def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, numbers, low, high) to STRETCHES at those lags."""
    for batch in batches:
        for k in range(batch.num_rows):
            numbers = np.frombuffer(batch.column(1)[k].as_buffer(), np.int32)
            row, start, length, period = stretches(numbers, np.array([0, len(numbers)]), batch.column(2)[k].as_py(), batch.column(3)[k].as_py())
            key = pa.array(np.full(len(row), batch.column(0)[k].as_py()), pa.int64())
            yield pa.RecordBatch.from_arrays([key, *(pa.array(x.astype(np.int64)) for x in (start, length, period))], names=["key", "start", "length", "period"])


def _digest_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) to FOUND."""
    for batch in batches:
        for lo, hi, data, off in slabs(batch.column(1)):
            ids, runs = batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo).to_pylist()
            begin, end, first = word_bounds(data, off)
            raw, done = data.tobytes(), []
            for k, doc_id in enumerate(ids.to_pylist()):
                own = slice(first[k], first[k + 1])
                found = np.array([(r["start"], r["length"], r["period"]) for r in runs[k] or []], np.int64).reshape(-1, 3)
                found = found[np.lexsort((found[:, 2], found[:, 0]))]
                done.append(_digest(raw, begin[own], end[own], repeated_places(doc_id, int(first[k + 1] - first[k])), tuple(found.T)))
            yield _table(ids, done)


def periodic_runs(docs: DataFrame, long_bytes: int = LONG_BYTES, range_work: int = RANGE_WORK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """FOUND of each row of docs: the number of runs, the strongest, and digests of all runs and of the words
    left once each run is cut down to its first period.

    Words are runs of characters other than [\\x20\\x09-\\x0D]; the words of a tenth of the ids repeat from a place on (repeated_places).
    Null or empty text: no words, no run, four nulls, the digests of the empty string. A null id: its words as they are.
    Rows that repeat an id have a row each. Equal exponents: the smaller start, then the smaller period. Other
    columns are not read. Empty table: empty result. `long_bytes` and `range_work` decide where lags are scanned,
    not what is found.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short = rows.filter(F.octet_length("text") <= long_bytes).mapInArrow(_scan_texts, FOUND)
    numbered = rows.filter(F.octet_length("text") > long_bytes).mapInArrow(_number_texts, "doc_id long, text string, n long, numbers binary")
    kept = save(numbered.withColumn("key", F.monotonically_increasing_id()), "long-texts")
    top, lags = F.floor(F.col("n") / EXPONENT), F.greatest(F.lit(1), F.floor(F.lit(range_work) / F.col("n")))
    dealt = kept.filter(F.col("n") >= LEAST).withColumn("lags", lags.cast("long")).withColumn("low", F.explode(F.sequence(F.lit(1).cast("long"), top.cast("long"), F.col("lags"))))
    dealt = dealt.select("key", "numbers", "low", (F.col("low") + F.col("lags") - 1).alias("high"))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "low")
    each = dealt.mapInArrow(_scan_ranges, STRETCHES).groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    runs = each.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    long = kept.select("key", "doc_id", "text").join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(_digest_long, FOUND)
    return short.unionByName(long)
