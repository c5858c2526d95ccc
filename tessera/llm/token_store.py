"""Token-ID output: raw id payloads in shard files, found by a minimal perfect hash index.

File format. A store is a folder of shard files, written by Spark's own writer so that it can be in
any store Spark reaches. Documents are in ascending id order (null first) over the shards, by task and
file number of their names, and in each of them. A shard is

    payloads 0x0A payloads 0x0A ... footer 0x0A

Payloads are the ids of some documents end to end, little-endian, 2 bytes each (4 where the vocabulary
needs it), the end id last in each document. The footer holds

    levels    of the minimal perfect hash: bits and the slots before it, two 64-bit numbers each
    blocks    of its bits, 64 bytes each: the slots before the block, then 448 bits
    entries   a slot each, 16 bytes: a 32-bit fingerprint of the key, the id count, the payload's offset
    ids       of the documents in order, 64 bits each, and a byte each whether it is not null
    tail      TAIL: counts, first and last id, where the footer begins, MAGIC

Access by key reads a file's tail, its levels, one block a level (a key stops at the first or second
mostly), one entry and the payload: as much for a shard of any size. The fingerprint rejects keys that
are not in the shard. Which shard may hold an id is found by halving, a tail a step, or in a manifest.

A document's key is its id and how often that id came before in its shard, so rows that repeat an id are
all kept and all found. A task's output is cut into files of FILE_RECORDS records, so no file grows with
the table: a file holds about FILE_RECORDS * SLICE_BYTES bytes of text, or one longer text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save
from .words import mix, slabs, text_buffers

MAGIC = b"TSHARD02"
#: task, file, documents, those with an id, ids, first and last document id, bytes an id, levels, footer's place, MAGIC
TAIL = struct.Struct("<10q8s")
ENTRY_KIND = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("offset", "<u8")])
BLOCK, BLOCK_BITS = 64, 448
END_ID = 1
#: Distinct words whose ids a worker keeps, as many again from before. Only speed depends on it.
CACHE_WORDS = 200_000
#: Bytes of text encoded at a time, whose payloads are a record of the file; a longer text is one alone.
SLICE_BYTES = 2 << 20
#: Records of a file, the footer's among them.
FILE_RECORDS = 64
#: Documents of a file at most.
FILE_DOCS = 1 << 20
#: Bytes of text that a task writes, about, as one or several files.
TASK_BYTES = 1 << 30
#: Up to so many shards their starts are broadcast; beyond, joined by shuffle.
BROADCAST_SHARDS = 10_000
# The rules under which ids can be made word by word, and the marks that can be cut off after a letter.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MARKS = "!\"#$%&()*+,-./0123456789:;=?@[\\]^_`{}~"

ENTRY = "task long, file long, before long, doc_id long, n_tokens long, ids_crc32 long"


def byte_letters() -> list[str]:
    """The character that byte-level tokenizers write for each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def is_plain(word: str) -> bool:
    """Whether a word is one piece that nothing normalises: small letters, below U+017F, where all are composed."""
    return word.isalpha() and word.islower() and (word.isascii() or max(word) < "ſ")


class Words(dict):
    """Ids (as bytes) of words, made when first asked for, with those of the time before at hand."""

    def __init__(self, tokenizer, code: str) -> None:
        super().__init__()
        self.tokenizer, self.code, self.older, self.letters = tokenizer, code, {}, byte_letters()

    def __missing__(self, word: str) -> bytes:
        done = self.older.get(word)
        if done is None:
            if is_plain(word):
                ids = [t.id for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            done = array(self.code, ids).tobytes()
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = done
        return done

    def of(self, word: str) -> bytes:
        """Ids of a word, marks after a letter at its end on their own, so that words need no entry for each mark."""
        done = self.get(word)
        if done is not None:
            return done
        head = word.rstrip(MARKS)
        if head and len(head) < len(word) and "<|" not in word and ("a" <= head[-1] <= "z" or is_plain(head)):
            return self[head] + self[word[len(head) :]]
        return self[word]


class WordEncoder:
    """Ids of whole texts, from ids of words kept by word.

    This holds for tokenizers like the one named in the query: NFC, white space, lower case, then
    pieces of letters, single digits and marks. There none of these cuts or changes alters an id. Cutting at white
    space: the pieces never span it and the normaliser composes nothing
    across it. Lower-casing A-Z: the normaliser does so itself. Cutting marks off after a letter at a
    word's end: letters and marks are never in one piece (the apostrophe, which can be, is not cut
    off). A text with "<|" in it, which may be a special token's beginning, is not lower-cased.
    With any other tokenizer each text is encoded whole.
    """

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        rules = json.loads(tokenizer_json)
        self.by_word = (rules["normalizer"], rules["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and rules["model"]["type"] == "BPE"
        self.words = Words(self.tokenizer, "H" if self.kind.itemsize == 2 else "I")

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """The payloads of all texts end to end, and each one's number of ids, the end id counted."""
        data, off = text_buffers(texts)
        # an array of its own: Arrow's if_else mistakes the places of sliced strings
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(off - off[0]), pa.py_buffer(data[off[0] : off[-1]]))
        if not self.by_word:
            done = [[*d.ids, END_ID] for d in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return b"".join(np.array(d, self.kind).tobytes() for d in done), np.array([len(d) for d in done], np.int64)
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(texts)
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        distinct = split.flatten().dictionary_encode()
        ids = [*map(self.words.of, distinct.dictionary.to_pylist()), np.array([END_ID], self.kind).tobytes()]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        begin, pool = np.cumsum(size) - size, np.frombuffer(b"".join(ids), self.kind)
        order = np.insert(distinct.indices.to_numpy().astype(np.int64), ends, len(ids) - 1)  # an end after each text's words
        sizes = size[order]
        total = np.cumsum(sizes)
        out = []
        for lo in range(0, len(order), 1 << 18):
            own = sizes[lo : lo + (1 << 18)]
            at = np.repeat(begin[order[lo : lo + (1 << 18)]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            out.append(pool[at].tobytes())
        return b"".join(out), np.diff(total[ends + np.arange(len(ends))], prepend=0)


_encoders: dict[int, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """One encoder for each tokenizer and worker."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(tokenizer_json)
    return _encoders[key]


def document_keys(ids: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """64-bit keys of documents in order: id, and the number of equal ids right before it."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    begun = np.flatnonzero(new)
    nth = np.arange(n) - np.repeat(begun, np.diff(np.append(begun, n)))
    return key_of(ids, nth, valid)


def key_of(ids: np.ndarray, nth: np.ndarray, valid: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        base = np.where(valid, mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), np.uint64(0x5851F42D4C957F2D))
        return mix(base + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def spots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key at a level."""
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(level + 1) * np.uint64(0xA24BAED4963EE407)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: keys that share no bit with another at a level settle there, the rest go on."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = [np.concatenate([[0], np.cumsum(b)]) for b in levels]
        self.base = np.concatenate([[0], np.cumsum([int(b.sum()) for b in levels])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys
        while len(rest):
            size = 2 * len(rest)
            at = spots(rest, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that was not in the build may get any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        for level, bits in enumerate(self.levels):
            open_ = np.flatnonzero(out < 0)
            at = spots(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.base[level] + self.before[level][at[hit]]
        return out

    def blocks(self) -> bytes:
        """The levels' bits in blocks, each after the number of slots before it."""
        out = []
        for level, bits in enumerate(self.levels):
            n = -(-len(bits) // BLOCK_BITS)
            padded = np.zeros(n * BLOCK_BITS, bool)
            padded[: len(bits)] = bits
            rank = self.base[level] + self.before[level][np.arange(n) * BLOCK_BITS]
            out.append(np.hstack([rank.astype("<i8").view(np.uint8).reshape(n, 8), np.packbits(padded.reshape(n, BLOCK_BITS), axis=1)]).tobytes())
        return b"".join(out)


def make_footer(task: int, file: int, id_bytes: int, at: int, ids: np.ndarray, valid: np.ndarray, offset: np.ndarray, count: np.ndarray) -> bytes:
    keys = document_keys(ids, valid)
    hashed = PerfectHash.build(keys)
    entries = np.empty(len(keys), ENTRY_KIND)
    slot = hashed.slots(keys)
    for name, values in (("fingerprint", fingerprints(keys)), ("count", count), ("offset", offset)):
        entries[name][slot] = values
    levels = np.array([[len(b), base] for b, base in zip(hashed.levels, hashed.base, strict=False)], "<i8")
    known = ids[valid]
    first, last = (int(known[0]), int(known[-1])) if len(known) else (0, 0)
    body = levels.tobytes() + hashed.blocks() + entries.tobytes() + ids.astype("<i8").tobytes() + valid.astype(np.uint8).tobytes()
    return body + TAIL.pack(task, file, len(ids), len(known), int(count.sum()), first, last, id_bytes, len(hashed.levels), at, MAGIC)


class Content:
    """A file's bytes at hand, read like one in a store."""

    def __init__(self, content: bytes) -> None:
        self.content, self.size = content, len(content)

    def read(self, at: int, n: int) -> bytes:
        return self.content[at : at + n]


class StoredFile:
    """Ranges of a file in any store that Hadoop reaches, read through the driver's JVM. `n_read` counts the bytes."""

    def __init__(self, spark: SparkSession, path: str, size: int) -> None:
        self.jvm, self.size, self.n_read = spark.sparkContext._jvm, size, 0
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        self.stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)

    def read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        self.n_read += n
        return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.stream, n)) if n else b""

    def close(self) -> None:
        self.stream.close()


class Shard:
    """A shard file, opened by its tail."""

    def __init__(self, file: Content | StoredFile) -> None:
        self.file = file
        tail = file.read(max(0, file.size - TAIL.size - 1), TAIL.size)
        if len(tail) < TAIL.size or not tail.endswith(MAGIC):
            raise ValueError("not a shard file, or cut short")
        self.task, self.number, self.n, self.n_valid, self.n_tokens, self.first, self.last, id_bytes, self.n_levels, self.at, _ = TAIL.unpack(tail)
        self.kind = np.dtype(f"<u{id_bytes}")

    def levels(self) -> list[tuple[int, int, int]]:
        """(bits, slots before, place of its blocks) of each level."""
        listed = np.frombuffer(self.file.read(self.at, 16 * self.n_levels), "<i8").reshape(-1, 2).tolist()
        out, place = [], self.at + 16 * self.n_levels
        for bits, base in listed:
            out.append((bits, base, place))
            place += -(-bits // BLOCK_BITS) * BLOCK
        self.entries_at = place
        return out

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, whether not null, entries) of all documents in order, each entry found through the index."""
        hashed = []
        for bits, _, place in self.levels():
            blocks = np.frombuffer(self.file.read(place, -(-bits // BLOCK_BITS) * BLOCK), np.uint8).reshape(-1, BLOCK)
            hashed.append(np.unpackbits(blocks[:, 8:], axis=1).reshape(-1)[:bits].astype(bool))
        entries = np.frombuffer(self.file.read(self.entries_at, 16 * self.n), ENTRY_KIND)
        place = self.entries_at + 16 * self.n
        ids = np.frombuffer(self.file.read(place, 8 * self.n), "<i8")
        valid = np.frombuffer(self.file.read(place + 8 * self.n, self.n), np.uint8).astype(bool)
        keys = document_keys(ids, valid)
        own = entries[PerfectHash(hashed).slots(keys)]
        if (own["fingerprint"] != fingerprints(keys)).any():
            raise ValueError("a shard whose index does not fit its documents")
        return ids, valid, own

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document of this id, or None: a few short reads."""
        key = key_of(np.array([doc_id], np.int64), np.zeros(1, np.int64), np.ones(1, bool))
        for level, (bits, _, place) in enumerate(self.levels()):
            spot = int(spots(key, level, bits)[0])
            block = self.file.read(place + spot // BLOCK_BITS * BLOCK, BLOCK)
            inside = np.unpackbits(np.frombuffer(block, np.uint8, offset=8))
            if inside[spot % BLOCK_BITS]:
                slot = struct.unpack_from("<q", block)[0] + int(inside[: spot % BLOCK_BITS].sum())
                entry = np.frombuffer(self.file.read(self.entries_at + 16 * slot, 16), ENTRY_KIND)[0]
                return self.read(entry) if entry["fingerprint"] == fingerprints(key)[0] else None
        return None

    def read(self, entry: np.void) -> np.ndarray:
        return np.frombuffer(self.file.read(int(entry["offset"]), int(entry["count"]) * self.kind.itemsize), self.kind)


def _shard_records(tokenizer_json: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, file = encoder_of(tokenizer_json), TaskContext.get().partitionId(), 0
        width = encoder.kind.itemsize
        ids, valid, offset, count = [], [], [], []
        end = records = docs = 0

        def record(value: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

        def footer() -> bytes:
            return make_footer(task, file, width, end, *(np.concatenate(x) for x in (ids, valid, offset, count)))

        for batch in batches:
            for lo, hi, _, _ in slabs(batch.column(1), SLICE_BYTES):
                payload, n = encoder.encode(batch.column(1).slice(lo, hi - lo))
                own = batch.column(0).slice(lo, hi - lo)
                ids.append(own.fill_null(0).to_numpy())
                valid.append(own.is_valid().to_numpy(zero_copy_only=False))
                offset.append(end + width * (np.cumsum(n) - n))
                count.append(n)
                end, records, docs = end + len(payload) + 1, records + 1, docs + hi - lo
                yield record(payload)
                if records == FILE_RECORDS - 1 or docs >= FILE_DOCS:
                    while records < FILE_RECORDS - 1:  # Spark's writer ends a file after FILE_RECORDS records
                        end, records = end + 1, records + 1
                        yield record(b"")
                    yield record(footer())
                    file += 1
                    end = records = docs = 0
                    for x in (ids, valid, offset, count):
                        x.clear()
        if ids:
            yield record(footer())

    return run


def write_store(docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the store. The tokenizer's file is read by the driver and
    goes to the tasks by value. One range shuffle of the texts into as many tasks as their measured
    bytes need; rows of one id are spread by their text's hash, so that no id is a task of its own."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    measured = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-measured // TASK_BYTES))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = hashed.repartitionByRange(tasks, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    encoded = ordered.mapInArrow(_shard_records(tokenizer_json), "value binary")
    lines = encoded.select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            if not len(content.as_buffer()):
                continue  # Spark writes an empty file for an empty table
            shard = Shard(Content(content.as_py()))
            ids, valid, entries = shard.documents()
            n, counts = shard.n, entries["count"].astype(np.int64)
            crcs = [zlib.crc32(shard.read(e).astype("<u4").tobytes()) for e in entries]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard.task)),
                    pa.array(np.full(n, shard.number)),
                    pa.array(np.cumsum(counts) - counts),
                    pa.array(ids, mask=~valid),
                    pa.array(counts),
                    pa.array(crcs, pa.int64()),
                ],
                names=["task", "file", "before", "doc_id", "n_tokens", "ids_crc32"],
            )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each payload found through the index.

    `start` counts the ids of all documents before it: those of its shard, and the sums of the shards
    before (a row a shard comes to the driver). A file is read whole: its size is bounded.
    """
    shards = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    entries = save(shards.mapInArrow(_entries, ENTRY), "entries")
    base, starts = 0, []
    for row in entries.groupBy("task", "file").agg(F.sum("n_tokens").alias("n")).orderBy("task", "file").toLocalIterator():
        starts.append((row["task"], row["file"], base))
        base += row["n"]
    begun = spark.createDataFrame(starts, "in_task long, in_file long, base long")
    begun = F.broadcast(begun) if len(starts) <= BROADCAST_SHARDS else begun
    return entries.join(begun, (entries["task"] == begun["in_task"]) & (entries["file"] == begun["in_file"])).select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


class Store:
    """Keyed access from the driver: the files of a store, opened one by one as keys need them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.n_read = spark, 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        files = []
        for status in listed:
            named = re.match(r"part-(\d+)-.*-c(\d+)", status.getPath().getName())
            if named and status.getLen():
                files.append((int(named[1]), int(named[2]), status.getPath().toString(), status.getLen()))
        self.files = [(name, size) for _, _, name, size in sorted(files)]
        self.tails: dict[int, Shard] = {}

    def shard(self, k: int) -> Shard:
        """The k-th shard's tail, read once; its file is closed again."""
        if k not in self.tails:
            file = StoredFile(self.spark, *self.files[k])
            self.tails[k] = Shard(file)
            file.close()
            self.n_read += file.n_read
        return self.tails[k]

    def find(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document of this id, or None. Null ids come first, so last ids ascend."""
        low, high = 0, len(self.files)
        while low < high:
            middle = (low + high) // 2
            tail = self.shard(middle)
            low, high = (low, middle) if tail.n_valid and tail.last >= doc_id else (middle + 1, high)
        if low == len(self.files) or self.shard(low).first > doc_id:
            return None
        file = StoredFile(self.spark, *self.files[low])
        try:
            return Shard(file).find(doc_id)
        finally:
            file.close()
            self.n_read += file.n_read


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, task, number, first_id, last_id (null without ids), n_docs, n_tokens of each shard of a store, in order.
    The driver reads the tails of the files alone; a row a shard, for a caller to keep."""
    store, rows = Store(spark, path), []
    for k, (name, _) in enumerate(store.files):
        s = store.shard(k)
        rows.append((name, s.task, s.number, s.first if s.n_valid else None, s.last if s.n_valid else None, s.n, s.n_tokens))
    return spark.createDataFrame(rows, "file string, task long, number long, first_id long, last_id long, n_docs long, n_tokens long")


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (the end id last) of the documents asked for; of repeated ids the first one.

    Keyed access for a list that a caller holds: the driver reads some hundred bytes and the payload
    for each. An id that no shard holds passes a fingerprint with probability 2**-32.
    """
    store, rows = Store(spark, path), []
    for doc_id in doc_ids:
        ids = store.find(int(doc_id))
        if ids is not None:
            rows.append((int(doc_id), ids.tolist()))
    return spark.createDataFrame(rows, "doc_id long, ids array<long>")


def encode_and_read(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs as a store in the shared folder and return what read_store() finds there.

    Null text: empty, one end id. Empty table: empty result. Rows that repeat an id all appear, in
    the order of their texts' hashes; a null id comes first. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer_path)
    return read_store(spark, path)
