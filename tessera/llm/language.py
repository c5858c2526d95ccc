"""Language ID by multilingual mixture inference.

A document's words come from a mixture of languages. Each word has a likelihood in each language, the
product over its byte trigrams (with its edges marked) of their learned probabilities.
Expectation-maximisation over the words finds the proportions of a set of languages, until the
log-likelihood is within SETTLED of its maximum (for very long texts, SETTLED_A_WORD a word). Where a language is at the edge of the set EM
creeps, so after EM_ROUNDS a document goes on by Newton's steps on the same likelihood, a few whatever its length. Sets grow from the best one by the next largest
proportion up to all languages, and the set is kept whose log-likelihood, less a penalty of `penalty` *
log(words) for each further language, is largest. The prediction is that set's largest proportion,
which is also the score.

No mixture is likelier than an upper bound that each round gives, so a document is left as soon as no
larger set can pay its penalty.

Trigram counts cover all training documents: tasks count in arrays of BUCKETS numbers for each
language, and the sums, a row for each language and bucket at most, make the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .words import slabs, word_bounds

BUCKETS = 1 << 14
SMOOTH, PENALTY = 0.5, 3.0
#: Nats that a document's log-likelihood may at most lack when EM ends: so many, or so many a word.
SETTLED, SETTLED_A_WORD = 0.01, 1e-6
#: EM rounds of all documents of a slab together; those still open go on by Newton's steps, so many at most.
EM_ROUNDS, NEWTON_ROUNDS = 40, 60
#: Words seen in no training text say little: a word's likelihood ratios are held within this many nats.
WORD_LIMIT = 12.0

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def trigrams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offset of each word's first) of words' byte trigrams, a blank on either side."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size)])
    if not len(size):
        return np.zeros(0, np.int64), at
    place = np.repeat(start - at[:-1], size) + np.arange(at[-1])
    byte = _LOWER[data[place]]
    left, right = np.empty_like(byte), np.empty_like(byte)
    left[1:], right[:-1] = byte[:-1], byte[1:]
    left[at[:-1]] = right[at[1:] - 1] = np.uint64(32)
    code = (left << np.uint64(16)) | (byte << np.uint64(8)) | right
    code = code * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(50)).astype(np.int64), at


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), summed over the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lo, hi, data, off in slabs(batch.column(1)):
            start, end, first = word_bounds(data, off)
            with np.errstate(over="ignore"):
                bucket, at = trigrams(data, start, end)
            cut = at[first]
            here = np.array(langs[lo:hi])
            for lang in set(langs[lo:hi]):
                own = np.concatenate([bucket[a:b] for a, b, is_ in zip(cut[:-1], cut[1:], here == lang, strict=True) if is_])
                held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(own, minlength=BUCKETS)
    for lang, held in sums.items():
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(held[seen])], names=["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    #: log-probability of each bucket (rows) in each language
    table: np.ndarray


def train(docs: DataFrame, allowed: Column) -> Model:
    """Counts over all documents with text, a language and an id that passes `allowed`."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & allowed).select("lang", "text")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row a language: languages times BUCKETS numbers come to the driver, whatever the number of documents
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).toArrow()
    langs = found["lang"].to_pylist()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    table = np.empty((BUCKETS, len(langs)))
    for column, k in enumerate(order):
        counts = np.full(BUCKETS, SMOOTH)
        own = found["counts"][k].values
        counts[own.field("bucket").to_numpy()] += own.field("n").to_numpy()
        table[:, column] = np.log(counts / counts.sum())
    return Model([langs[k] for k in order], table)


def _proportions(like: np.ndarray, words: np.ndarray, share: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM for all documents of a slab at once, from `share`; a language at 0 stays there.

    A document ends within `settled` of its largest log-likelihood, or when that is known to be no more than
    its `bar`. Rounds are bounded: EM_ROUNDS for the slab, then NEWTON_ROUNDS for a document that is still open. Returns the proportions, the documents' log-likelihoods and upper bounds of the largest.
    """
    n_langs = like.shape[1]
    share, fit, upper = share.copy(), np.zeros(len(words)), np.zeros(len(words))
    docs = np.flatnonzero(words > 0)
    at = np.repeat(np.arange(len(docs)), words[docs])  # words are in the order of their documents
    for _ in range(EM_ROUNDS):
        if not len(docs):
            return share, fit, upper
        old, n = share[docs], words[docs]
        mixed = np.einsum("ij,ij->i", like, old[at])
        # by how much each proportion grows; the likelihood's maximum is at most n * log of the largest away
        growth = np.stack([np.bincount(at, like[:, k] / mixed, len(docs)) for k in range(n_langs)], axis=1) / n[:, None]
        fit[docs] = np.bincount(at, np.log(mixed), len(docs))
        lacks = n * np.log(np.maximum(np.where(old > 0, growth, 0).max(axis=1), 1.0))
        upper[docs] = fit[docs] + lacks
        more = (lacks > settled(n)) & (upper[docs] > bar[docs])
        share[docs[more]] = (old * growth)[more]
        if not more.all():
            keep = more[at]
            like, at, docs = like[keep], (np.cumsum(more) - 1)[at[keep]], docs[more]
    cut = np.searchsorted(at, np.arange(len(docs) + 1))
    for k, doc in enumerate(docs):
        share[doc], fit[doc], upper[doc] = _newton(like[cut[k] : cut[k + 1]], share[doc], bar[doc])
    return share, fit, upper


def settled(words: np.ndarray) -> np.ndarray:
    return np.maximum(SETTLED, SETTLED_A_WORD * words)


def _least_square(h: np.ndarray, g: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The y >= 0 of least (y - x)' h (y - x) / 2 + g' (y - x), coordinate by coordinate: as many as languages."""
    y, slope = x.copy(), g.copy()
    for _ in range(500):
        before = y.copy()
        for k in range(len(y)):
            to = max(0.0, y[k] - slope[k] / h[k, k])
            slope += (to - y[k]) * h[:, k]
            y[k] = to
        if np.abs(y - before).max() < 1e-12:
            break
    return y


def _newton(like: np.ndarray, share: np.ndarray, bar: float) -> tuple[np.ndarray, float, float]:
    """The proportions of one document by Newton's steps on its likelihood, held at 0 or above: the curvature is a matrix of
    languages by languages, and each step is as long as it makes the likelihood rise. A language at 0 stays there."""
    live = np.flatnonzero(share > 0)
    like, x, n = like[:, live], share[live], len(like)
    for rounds in range(NEWTON_ROUNDS + 1):
        mixed = like @ x
        ratio = like / mixed[:, None]
        growth, fit = ratio.mean(axis=0), float(np.log(mixed).sum())
        lacks = n * np.log(max(float(growth.max()), 1.0))
        if lacks <= settled(n) or fit + lacks <= bar or rounds == NEWTON_ROUNDS:
            break
        h = ratio.T @ ratio / n
        h[np.diag_indices(len(x))] += 1e-9 * np.trace(h)
        step = _least_square(h, 1 - growth, x) - x
        slope, scale = float((1 - growth) @ step), 1.0
        while scale > 1e-8:
            new = x + scale * step
            if new.sum() > 0 and (made := like @ new).min() > 0 and -np.log(made).sum() / n + new.sum() <= -fit / n + x.sum() + 1e-4 * scale * slope:
                break
            scale /= 2
        else:  # no step rises any more: rounding is all that is left
            break
        x = new / new.sum()
    out = np.zeros(len(share))
    out[live] = x
    return out, fit, fit + lacks


def infer(model: Model, data: np.ndarray, off: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(language index, proportion) of the largest part of each row of a slab."""
    value = infer_sets(model, data, off, penalty)
    lang = value.argmax(axis=1)
    return lang, value[np.arange(len(value)), lang]


def infer_sets(model: Model, data: np.ndarray, off: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The proportions of each row of a slab (rows by languages); languages outside the row's set are 0."""
    n, n_langs = len(off) - 1, len(model.langs)
    start, end, first = word_bounds(data, off)
    with np.errstate(over="ignore"):
        bucket, at = trigrams(data, start, end)
    words = np.diff(first)
    row = np.repeat(np.arange(n), words)
    logs = np.stack([np.add.reduceat(model.table[bucket, k], at[:-1]) for k in range(n_langs)], axis=1) if len(row) else np.zeros((0, n_langs))
    logs = np.maximum(logs - logs.max(axis=1, keepdims=True), -WORD_LIMIT) if len(row) else logs
    like = np.exp(logs)
    fits = np.stack([np.bincount(row, logs[:, k], n) for k in range(n_langs)], axis=1)  # of one language alone
    best, value = fits.max(axis=1), np.zeros((n, n_langs))
    value[np.arange(n), fits.argmax(axis=1)] = 1.0
    cost = penalty * np.log(np.maximum(words, 2))
    share, whole, upper = _proportions(like, words, np.full((n, n_langs), 1 / n_langs), best + cost)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    for size in range(2, n_langs + 1):
        can = upper - cost * (size - 1) > best
        docs = np.flatnonzero(can)
        if size < n_langs:
            begun = np.where(rank[docs] < size, np.maximum(share[docs], 1e-3), 0)
            begun /= begun.sum(axis=1, keepdims=True)
            own, fit, _ = _proportions(like[can[row]], words[docs], begun, best[docs] + cost[docs] * (size - 1))
        else:
            own, fit = share[docs], whole[docs]
        fit = fit - cost[docs] * (size - 1)
        better = fit > best[docs]
        best[docs[better]] = fit[better]
        value[docs[better]] = own[better]
    return value


def _predict(model: Model):
    langs = np.array([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            names, scores, members, parts, sizes = [], [], [], [], [np.zeros(1, np.int64)]
            for lo, hi, data, off in slabs(texts):
                letters = np.add.reduceat(np.append(_ASCII_LETTER[data], False), off[:-1]) * (np.diff(off) > 0)
                none = [k for k in np.flatnonzero(letters == 0) if not any(c.isalpha() for c in texts[lo + int(k)].as_py() or "")]
                value = infer_sets(model, data, off) if model.langs else np.zeros((hi - lo, 1))
                value[none] = 0.0
                # largest first; equal ones in the order of the languages
                order = np.argsort(-value, axis=1, kind="stable")
                sorted_ = np.clip(np.take_along_axis(value, order, axis=1), 0, 1)
                names += langs[np.where(sorted_[:, 0] > 0, order[:, 0], len(model.langs))].tolist()
                scores.append(sorted_[:, 0])
                inside = sorted_ > 0
                members += langs[order[inside]].tolist()
                parts.append(sorted_[inside])
                sizes.append(inside.sum(axis=1))
            off = pa.array(np.cumsum(np.concatenate(sizes)).astype(np.int32))
            joined = lambda x: pa.array(np.concatenate(x) if x else [], pa.float64())
            lists = [pa.ListArray.from_arrays(off, pa.array(members, pa.string())), pa.ListArray.from_arrays(off, joined(parts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), joined(scores), *lists],
                names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"],
            )

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages and proportions of every row of docs(doc_id, text, lang).

    languages is the inferred set, largest proportion first; lang_pred and score are its first.

    Learns from ids whose crc32 modulo 4 is not 2, with text and language; those with 2 are held out.
    lang_pred is `und`, score 0, where the text is null or has no letter (str.isalpha), or where
    nothing could be learned; the set is empty then. Equal proportions go to the language first in order. A null id is not held out
    and teaches nothing. Rows that repeat an id each count. Empty table: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(rows, remainder() != 2)
    return rows.select("doc_id", (remainder() == 2).alias("held_out"), "text").mapInArrow(
        _predict(model), "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"
    )
