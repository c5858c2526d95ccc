r"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct five-word shingles (words.py says what a word is). Its signature
is K MinHash values of which 16 bits each are kept. Two signatures differ in few symbols when the
sets are alike, so the join looks for all pairs within `errors` differing symbols:

* The K symbols are split into chunks, errors // 2 + 1 of them. By the pigeonhole principle a pair
  within the limit has a chunk with one differing symbol at most.
* In each chunk every single symbol in turn is left out (the allowed chunk error), and the rest is a
  key. So each class has K keys, and a pair within the limit shares one: no such pair is missed.

`errors` is set so that a pair exactly at the threshold is beyond it with probability `miss`.

Bounds on work. Equal sets are one class first, so copies never meet each other. Each bucket then
links its members to its smallest member alone (a star), and links make components. Buckets whose
members have not all come into one component are open: pairs across their components may still be
linked. Buckets that share members are a region, and the shingles of more than half of its members are its
reference h. A member x is known by its difference from h, d(x) = h \ x with x \ h, and for two members

    |x & y| = |h| - |h \ x| - |h \ y| + |d(x) & d(y)|

So two members are linked if and only if their differences share as many shingles as their sizes ask for. Where
that is none, both are linked with the region's nearest member to h. Any other linked pair meets up to MEETINGS times,
but not more often than it must share, within the first of both differences, rarest in the region first (the prefix
principle); the more places a pair may meet at, the more often it must. So members are compared with the nearest one, then with the centre of each shingle they meet
at, which makes components of groups of near copies, and only pairs that are then still in
different components are compared each, by their differences. Documents of one template
that all differ a little too much from each other share few shingles of their differences, so such a family has
few pairs compared, not all; documents far from h meet as they would without it. No link between different
components is lost. Every link is confirmed on the full sets: from both texts, or by the equation above.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, save
from .graph import connected_components
from .words import mix, shingles_of

K = 64
MISS = 1e-6
#: Shingles of their differences that a pair must share among the first, at most: one, and one more for each so many places.
MEETINGS, PLACES = 16, 10
#: Pairs verified at a time in a task.
SLICE = 256

_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_WEIGHT = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = _rng.integers(0, 1 << 63, K, dtype=np.uint64)

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary"


def allowed_errors(percent: int, miss: float = MISS) -> int:
    """The least number of symbols such that a pair at the threshold differs in more with probability miss."""
    p = 1 - percent / 100
    tail, e = 1.0, -1
    while tail > miss and e < K:
        e += 1
        tail -= comb(K, e) * p**e * (1 - p) ** (K - e)
    return e


def distinct_sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct hashes, end to end, and the offsets."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return (np.concatenate(sets) if sets else hashes), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def signatures(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """K symbols of 16 bits for each non-empty row."""
    out = np.empty((len(starts), K), np.uint16)
    if len(starts):
        for k in range(K):
            least = np.minimum.reduceat(hashes * _MULT[k] + _ADD[k], starts)
            out[:, k] = mix(least) >> np.uint64(48)
    return out


def sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            for lo, hi, hashes, off in shingles_of(batch.column(1)):
                sets, at = distinct_sets(hashes, off)
                size = np.diff(at)
                full = size > 0
                starts = at[:-1][full]
                fp = np.zeros((2, hi - lo), np.int64)
                if len(starts):
                    for k, salt in enumerate((0x1B873593CC9E2D51, 0x38B34AE5A1E38B93)):
                        fp[k, full] = np.add.reduceat(mix(sets ^ np.uint64(salt)), starts).view(np.int64)
                sig = np.zeros((hi - lo, K), np.uint16)
                sig[full] = signatures(sets, starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(fp[0]),
                        pa.array(fp[1]),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig"],
                )


def symbols_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, K)


def key_batches(chunks: int):
    """A mapper from (rep, sig) to (rep, key), K keys a row."""
    where = [list(c) for c in np.array_split(np.arange(K), chunks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                with np.errstate(over="ignore"):
                    terms = mix(symbols_of(part.column(1)).astype(np.uint64) + np.uint64(1)) * _WEIGHT
                    keys = np.empty((len(terms), K), np.uint64)
                    for columns in where:
                        total = terms[:, columns].sum(axis=1)
                        for j in columns:
                            keys[:, j] = mix(total - terms[:, j] + _TAG[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), K)), pa.array(keys.reshape(-1).view(np.int64))], names=["rep", "key"]
                )

    return run


def within_batches(errors: int):
    """A filter of (a, b, sig_a, sig_b) to the pairs (a, b) within the signature limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (symbols_of(batch.column(2)) != symbols_of(batch.column(3))).sum(axis=1) <= errors
                yield batch.select([0, 1]).filter(pa.array(near))

    return run


def sets_of(column: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    return [np.unique(h[x:y]) for _, _, h, off in shingles_of(column) for x, y in zip(off[:-1], off[1:], strict=True)]


def confirm_batches(percent: int):
    """A filter of (a, b, text_a, text_b) to the pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                keep = []
                for x, y in zip(sets_of(part.column(2)), sets_of(part.column(3)), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _joined(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with side(rep, column) brought in for both ends."""
    for end in ("a", "b"):
        named = side.select(F.col("rep").alias(f"{end}_rep"), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(named, pairs[end] == named[f"{end}_rep"]).drop(f"{end}_rep")
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, errors: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs of class representatives within the signature limit whose texts reach the threshold."""
    near = scratch.save(_joined(pairs, classes, "sig").mapInArrow(within_batches(errors), "a long, b long"), f"{label}-near")
    checked = _joined(near, texts, "text").mapInArrow(confirm_batches(percent), "a long, b long")
    return scratch.save(checked.distinct(), f"{label}-links")


DIFFERENCE = "region long, rep long, t long, size long, lacks long, whole long, u long, tokens array<long>"


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(region, text) to (region, token), a row for each distinct shingle of each text."""
    for batch in batches:
        for lo, hi, hashes, off in shingles_of(batch.column(1)):
            sets, at = distinct_sets(hashes, off)
            regions = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(regions), pa.array(sets.view(np.int64))], names=["region", "token"])


def difference_batches(percent: int):
    """(region, rep, t, text, reference) to DIFFERENCE: the shingles in the text or the reference alone (`lacks` of
    them in the reference; the text has `whole`), and `u`: two
    members x and y of a region are linked if and only if (200 + 2 * percent) times the number of shingles that
    their differences share is at least u(x) + u(y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                u, tokens, lacks, whole = [], [], [], []
                for x, listed in zip(sets_of(part.column(3)), part.column(4), strict=True):
                    h = np.sort(listed.values.to_numpy().view(np.uint64))
                    both = len(np.intersect1d(x, h, assume_unique=True))
                    u.append(2 * percent * len(x) - (100 + percent) * len(h) + 2 * (100 + percent) * (len(h) - both))
                    tokens.append(np.setxor1d(x, h, assume_unique=True).view(np.int64))
                    lacks.append(len(h) - both)
                    whole.append(len(x))
                size = [len(t) for t in tokens]
                off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(off, pa.array(np.concatenate(tokens), pa.int64()))
                columns = [*part.columns[:3], *(pa.array(v, pa.int64()) for v in (size, lacks, whole, u)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["region", "rep", "t", "size", "lacks", "whole", "u", "tokens"])

    return run


def differences_of(members: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """members(region, rep, t, text) to their differences from their regions' references, with `inside`: linked with
    the region's nearest member, `nearest`. A reference is at most twice as large as its region's mean set."""
    n = scratch.save(members.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region-sizes")
    counted = members.select("region", "text").mapInArrow(shingle_rows, "region long, token long").groupBy("region", "token").agg(F.count(F.lit(1)).alias("df"))
    most = counted.filter("df > 1").join(n, "region").filter("2 * df > n").groupBy("region").agg(F.collect_list("token").alias("reference"))
    none = F.array().cast("array<long>")
    both = members.join(scratch.save(most, "references"), "region", "left").select("region", "rep", "t", "text", F.coalesce("reference", none).alias("reference"))
    found = scratch.save(both.mapInArrow(difference_batches(percent), DIFFERENCE), "differences")
    # saved, so that the join has an exchange on both sides, which adaptive execution needs to split a hot region
    nearest = scratch.save(found.groupBy("region").agg(F.min(F.struct("u", "rep", "t", "tokens")).alias("first")), "nearest")
    linked = (200 + 2 * percent) * F.size(F.array_intersect("tokens", "first.tokens")) >= F.col("u") + F.col("first.u")
    return found.join(nearest, "region").select(*found.columns, F.col("first.rep").alias("nearest"), linked.alias("inside"))


def rare_differences(differences: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """region, token, rep, t, sizes, u, inside, place, near, far, must_near, must_far: the shingles of each difference that another one of
    the region holds, by their place, rarest first, as far as a pair that is linked must have met `must` times. What
    only one holds counts as the places before, and is never sorted.

    Pairs are of two members outside, or of one outside and one inside; `near` and `far` say whether the
    place counts for either kind, and must_near and must_far how often such a pair must meet.
    """
    tokens = differences.select("region", "rep", "t", F.explode("tokens").alias("token"))
    shared = scratch.save(tokens.groupBy("region", "token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared")
    lists = tokens.join(shared, ["region", "token"]).groupBy("region", "rep", "t").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("list"))
    least = differences.filter("size > 0").groupBy("region").agg(
        F.min(F.when(F.col("inside"), F.col("u"))).alias("u_in"), F.min(F.when(~F.col("inside"), F.col("u"))).alias("u_out")
    )
    least = scratch.save(least, "least")
    share = {o: F.greatest(F.lit(1), F.ceil((F.col("u") + F.col(o)) / (200 + 2 * percent))) for o in ("u_in", "u_out")}  # at least
    some = {o: F.greatest(F.lit(1), 1 + F.floor((F.col("size") - n) / PLACES)) for o, n in share.items()}
    must = {o: F.when(n.isNull() | F.col(o).isNull(), 0).otherwise(F.least(F.lit(MEETINGS), n, some[o])).cast("int") for o, n in share.items()}
    first = {o: F.when(F.col(o).isNull(), 0).otherwise(F.col("size") - n + must[o]) for o, n in share.items()}  # none without such partners
    inside = F.col("inside")
    known = differences.drop("tokens", "nearest").join(least, "region").select(
        *[c for c in differences.columns if c not in ("tokens", "nearest")],
        F.when(inside, 0).otherwise(first["u_out"]).alias("near"),
        F.when(inside, first["u_out"]).otherwise(first["u_in"]).alias("far"),
        must["u_out"].alias("must_near"),
        F.when(inside, must["u_out"]).otherwise(must["u_in"]).alias("must_far"),
    )
    rows = lists.join(known, ["region", "rep", "t"]).withColumn("own", F.col("size") - F.size("list"))
    rows = rows.withColumn("take", (F.greatest("near", "far") - F.col("own")).cast("int")).filter("take > 0")
    kept = ("region", "rep", "t", "size", "lacks", "whole", "u", "inside", "must_near", "must_far")
    places = rows.select(*kept, "own", "near", "far", F.posexplode(F.slice("list", F.lit(1), F.col("take"))).alias("k", "at"))
    place = F.col("own") + F.col("k")
    return places.select(*kept, F.col("at.token").alias("token"), place.alias("place"), (place < F.col("near")).alias("near"), (place < F.col("far")).alias("far"))


def _mixed(rare: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """rare with each member's component, where a region's shingle is still held by several components; saved."""
    placed = rare.join(labels, rare["rep"] == labels["node"], "left").withColumn("comp", F.coalesce("comp", "rep")).drop("node")
    placed = scratch.save(placed, "placed-rare")
    mixed = placed.groupBy("region", "token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most")
    return scratch.save(placed.join(scratch.save(mixed.select("region", "token"), "mixed"), ["region", "token"], "left_semi"), "rare")


def _linked(pairs: DataFrame, differences: DataFrame, percent: int, scratch: Scratch, label: str) -> DataFrame:
    """The links (a, b) among pairs of members (region, rep_x, t_x, rep_y, t_y), by what their differences share; saved."""
    pairs = scratch.save(pairs, f"{label}-pairs")
    for end in "xy":
        side = differences.select("region", F.col("rep").alias(f"rep_{end}"), F.col("t").alias(f"t_{end}"), F.col("u").alias(f"u_{end}"), F.col("tokens").alias(f"tokens_{end}"))
        pairs = pairs.join(side, ["region", f"rep_{end}", f"t_{end}"])
    both = F.size(F.array_intersect("tokens_x", "tokens_y"))
    found = pairs.filter((200 + 2 * percent) * both >= F.col("u_x") + F.col("u_y"))
    return scratch.save(found.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")), f"{label}-links")


def _centred(rare: DataFrame) -> DataFrame:
    """Pairs of each member and the centres, nearest to the reference, of the shingles that it holds."""
    x = rare.alias("x")
    y = rare.groupBy("region", "token").agg(F.min(F.struct("u", "rep", "t", "comp")).alias("at")).alias("y")
    same = (F.col("x.region") == F.col("y.region")) & (F.col("x.token") == F.col("y.token"))
    met = x.join(y, same & (F.col("x.comp") != F.col("y.at.comp")))
    ends = [F.col("x.rep").alias("rep_x"), F.col("x.t").alias("t_x"), F.col("y.at.rep").alias("rep_y"), F.col("y.at.t").alias("t_y")]
    return met.select(F.col("x.region").alias("region"), *ends).distinct()


def _can_link(percent: int, must) -> Column:
    """Whether x and y can be linked, by the sizes of their sets and of both parts of their differences, and by what
    is left of both from one of the first `must` shingles that they share."""
    small, large = F.least("x.whole", "y.whole"), F.greatest("x.whole", "y.whole")
    share = F.least("x.lacks", "y.lacks") + F.least(F.col("x.size") - F.col("x.lacks"), F.col("y.size") - F.col("y.lacks"))
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + must - 1
    return (100 * small >= percent * large) & ((200 + 2 * percent) * F.least(share, left) >= F.col("x.u") + F.col("y.u"))


def _across(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs of members in different components that meet as often as they must."""
    x, y = rare.filter("NOT inside").alias("x"), rare.alias("y")
    other = F.col("y.inside")
    kinds = F.when(other, F.col("x.far") & F.col("y.far")).otherwise(F.col("x.near") & F.col("y.near") & (F.col("x.rep") < F.col("y.rep")))
    must = F.when(other, F.least("x.must_far", "y.must_far")).otherwise(F.least("x.must_near", "y.must_near"))
    same = (F.col("x.region") == F.col("y.region")) & (F.col("x.token") == F.col("y.token"))
    met = x.join(y, same & (F.col("x.comp") != F.col("y.comp")) & kinds & _can_link(percent, must))
    ends = [F.col(f"{end}.{c}").alias(f"{c}_{end}") for end in "xy" for c in ("rep", "t")]
    pairs = met.groupBy(F.col("x.region").alias("region"), *ends).agg(F.count(F.lit(1)).alias("n"), F.max(must).alias("must"))
    return pairs.filter("n >= must").drop("n", "must")


def _merged(labels: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """labels(node, comp) after further links(a, b), a saved table: only components that these join are worked on."""
    n = more.count()
    for end in "ab":
        at = labels.select(F.col("node").alias(f"{end}_node"), F.col("comp").alias(f"{end}_comp"))
        more = more.join(at, more[end] == at[f"{end}_node"], "left").withColumn(f"{end}_comp", F.coalesce(f"{end}_comp", end)).drop(f"{end}_node")
    joins = scratch.save(more.filter("a_comp != b_comp").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b")).distinct(), "joins", n)
    if joins.isEmpty():
        return labels
    merged = connected_components(joins, scratch).select(F.col("node").alias("was"), F.col("comp").alias("now"))
    alone = merged.join(labels, merged["was"] == labels["node"], "left_anti").select(F.col("was").alias("node"), F.col("was").alias("comp"))
    every = labels.unionByName(alone)
    return scratch.save(every.join(merged, every["comp"] == merged["was"], "left").select("node", F.coalesce("now", "comp").alias("comp")), "labels", labels.count() + 2 * n)


def _components(rows: DataFrame, classes: DataFrame, percent: int, errors: int, scratch: Scratch) -> DataFrame:
    """(node, comp) of the classes' representatives that are linked with any other."""
    keys = classes.select("rep", "sig").mapInArrow(key_batches(errors // 2 + 1), "rep long, key long")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last")
    buckets = scratch.save(keys.join(hubs, "key"), "buckets")
    members = buckets.select("rep").distinct()
    texts = rows.join(members, rows["doc_id"] == members["rep"], "left_semi").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("t"), "text")
    texts = scratch.save(texts, "texts")

    star = scratch.save(buckets.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    links = _confirmed(star, classes, texts, percent, errors, scratch, "star")
    labels = connected_components(links, scratch)

    placed = buckets.join(labels, buckets["rep"] == labels["node"], "left").select("key", "hub", "rep", F.coalesce("comp", "rep").alias("comp"))
    placed = scratch.save(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("key")
    edges = placed.join(scratch.save(mixed, "mixed"), "key", "left_semi").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    regions = connected_components(scratch.save(edges, "open"), scratch)
    if regions.isEmpty():
        return labels

    members = scratch.save(regions.join(texts, regions["node"] == texts["rep"]).select(F.col("comp").alias("region"), "rep", "t", "text"), "members")
    differences = scratch.save(differences_of(members, percent, scratch), "members-differences")
    inside = differences.filter("inside").select(F.col("nearest").alias("a"), F.col("rep").alias("b"))
    labels = _merged(labels, inside, scratch)
    rare = scratch.save(rare_differences(differences, percent, scratch), "rare-differences")
    for label in ("centred", "across"):
        mixed = _mixed(rare, labels, scratch)
        more = _linked(_centred(mixed) if label == "centred" else _across(mixed, percent), differences, percent, scratch, label)
        labels = _merged(labels, more, scratch)
    return labels


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Returns doc_id, n_shingles, component_id, kept, one row per input row. Null or empty text, or
    one without words: no shingles, linked with nothing, a component of its own. A null id takes no
    part: component_id null, kept false. Rows that share an id are texts of one document: a pair is
    linked if any of their texts is. Exact ties at the threshold are linked. Other columns are not
    carried, so clashing names do not matter. Empty table: empty result.
    """
    errors = allowed_errors(percent)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = save(rows.mapInArrow(sketch_batches, SKETCH), "sketch")
    full = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    with Scratch(docs.sparkSession, "near-dedup") as scratch:
        classes = scratch.save(full.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig")), "classes")
        labels = _components(rows, classes, percent, errors, scratch)
        named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
            F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.col("n_shingles").alias("cn"), F.coalesce("comp", "rep").alias("component")
        )
        named = save(named, "named")  # all that the result needs besides the sketches
    same = (sketch["fp1"] == named["c1"]) & (sketch["fp2"] == named["c2"]) & (sketch["n_shingles"] == named["cn"]) & sketch["doc_id"].isNotNull()
    return (
        sketch.drop("sig")
        .join(named, same, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs of which one row per component of near copies stays, the one of the smallest id (null last).

    All columns are kept. Rows are compared by their texts, each for itself: docs is saved with a key for each row. So of equal or near texts one row stays,
    whether they share an id, have ids of their own or none; rows that share an id with unlike texts all stay, as do rows without words.
    """
    keyed = save(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("key")), "dedup-rows")
    classes = near_duplicates(keyed.select("key", "row.text"), percent, doc_id="key").select(F.col("doc_id").alias("of_key"), "component_id")
    named = classes.join(keyed.select("key", F.col("row.doc_id").cast("long").alias("own_id")), F.col("of_key") == F.col("key"))
    first = F.min(F.struct(F.col("own_id").isNull(), "own_id", "key")).alias("first")
    stay = named.groupBy("component_id").agg(first).select(F.col("first.key").alias("kept_key"))
    return keyed.join(stay, F.col("key") == F.col("kept_key"), "left_semi").select("row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
