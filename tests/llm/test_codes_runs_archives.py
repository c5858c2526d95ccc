"""Vector codes, periodic runs and archives against plain versions of themselves, and their defined results at the edges."""

import gzip
import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs, vector_codes, warc
from tessera.llm.common import new_path

VECTORS = "vec_id long, embedding array<double>, label int"
PAGES = "page_id long, url string, html string"


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract in plain Python: rows of (vec_id, embedding, label) to (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(p, c[p])[1]].append(c[p])
            books[p] = [tuple(sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)) if e in groups else y for e, y in enumerate(books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    errors, labels = [sum(d for d, _ in f) for f in found], defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] += e
    return sorted(
        ((r[0], "".join(f"{e:02x}" for _, e in f), err, labels[r[2]], digest) for r, f, err in zip(kept, found, errors, strict=True)), key=repr
    )


def coded(df, **how):
    return sorted(map(tuple, vector_codes.compress(df, **how).collect()), key=repr)


@pytest.mark.parametrize("n, dim, spread", [(300, 32, 1.0), (40, 16, 1.0), (200, 20, 0.004), (90, 16, 1e7)])
def test_vector_codes_equal_the_plain_version(spark, n, dim, spread):
    """More and fewer vectors than entries, lengths that 16 does not divide, many ties, and squares beyond a long."""
    draw = random.Random(n)
    rows = [(i, [draw.gauss(0, spread) for _ in range(dim)], draw.choice([None, 1, 2])) for i in draw.sample(range(10_000), n)]
    assert coded(spark.createDataFrame(rows, VECTORS).repartition(5)) == plain_codes(rows)


def test_vector_codes_at_the_edges(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 1) for _ in range(16)], i % 3) for i in range(80)]
    rows += [(1, None, 1), (2, [1.0, None], 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, None), (5, [0.5, 0.25], 2), (6, [], 0), (None, [2.0] * 16, 0)]
    rows += [rows[0], rows[1]]
    df = spark.createDataFrame(rows, VECTORS)
    got = coded(df.withColumn("code", F.lit("x")).withColumn("error", F.lit(1)).withColumn("entry", F.lit(0)))
    assert got == plain_codes(rows) and len(got) == len(rows) - 4
    assert coded(df.limit(0)) == []
    assert coded(df.filter("embedding is null")) == []
    one = coded(df.filter("vec_id = 7"))
    assert one[0][1] == "00" * 16 and one[0][2] == 0
    assert coded(df.select("vec_id", F.array(F.lit(1e300)).alias("embedding"), "label"))[0][2] == 0  # held at 2**62


def test_cells_keep_every_nearest_entry_and_leave_others_out():
    draw = np.random.default_rng(1)
    entries, asked = draw.integers(-300, 300, (64, 4)), draw.integers(-400, 400, (500, 4))
    cells = vector_codes.Cells(entries)
    apart = ((asked[:, None, :] - entries[None]) ** 2).sum(axis=2)
    entry, distance = cells.nearest(asked)
    assert (entry == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    row, _ = cells.candidates(asked)
    assert len(row) < 0.35 * apart.size


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return [w.decode() for w in words]
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p].decode() for i in range(n)]


def plain_runs(words):
    """(start, length, period) of every run, straight from the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = words[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = plain_words(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts(n, seed):
    """Texts of few distinct words with planted repeats of all sorts."""
    draw = random.Random(seed)
    for i in range(n):
        words = []
        while len(words) < draw.choice([0, 5, 30, 120, 300]):
            unit = [draw.choice("abcde") for _ in range(draw.randint(1, 9))]
            words += unit * draw.choice([1, 1, 2, 4, 5, 9]) + unit[: draw.randint(0, len(unit))]
        yield i, "".join(w + draw.choice([" ", "  ", "\n", "\t\x0b"]) for w in words)


def runs_of(df, **how):
    return sorted(map(tuple, periodic_runs.periodic_runs(df, **how).collect()), key=repr)


def test_periodic_runs_equal_the_definition(spark):
    rows = list(texts(150, 5)) + [(1000, "x " * 400), (1001, "x y " * 150 + "x x"), (1002, ("a b a b a c " * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = sorted((plain_digest(*r) for r in rows), key=repr)
    assert runs_of(df) == expected
    # the same in ranges of lags, from one lag a task to all lags
    assert runs_of(df, long_bytes=40, range_work=1) == expected
    assert runs_of(df, long_bytes=0, range_work=3000) == expected


def test_periodic_runs_at_the_edges(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(12_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b\x0c\r "), (4, "a a a a a"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "b c b c b c b c"), (7, "É É É É É É"), (8, "a a " * 6)]
    df = spark.createDataFrame([*rows, (9, long_text)], "doc_id long, text string").withColumn("start", F.lit("s")).withColumn("runs", F.lit(1)).withColumn("key", F.lit(2))
    got = {r[0]: r for r in runs_of(df)}
    for r in rows:
        assert got[r[0]] == plain_digest(*r)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1][1:] == (0, None, None, None, None, empty, empty)
    assert got[5][1:6] == (1, 0, 6, 1, 6000) and got[None][1:6] == (1, 0, 8, 2, 4000)
    assert len(runs_of(df)) == 10 and got[9][1] >= 1
    assert got[9] in runs_of(df, long_bytes=1000)
    assert runs_of(df.limit(0)) == []


def test_periodic_runs_of_a_long_text_of_one_word(spark):
    """Every lag finds the same stretch, in every range: one run, of period one."""
    df = spark.createDataFrame([(1, "x " * 50_000)], "doc_id long, text string")
    assert runs_of(df)[0][1:6] == (1, 0, 50_000, 1, 50_000_000)


def plain_archive(rows):
    first = {}
    for page_id, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        first.setdefault(html or "", (page_id, url))
    out, seen = [], set()
    for page_id, url, html in rows:
        payload = (html or "").encode()
        twin = len(payload) >= 100 and (first[html] != (page_id, url) or html in seen)
        if first[html or ""] == (page_id, url):
            seen.add(html)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if twin else "response", first[html][0] if twin else None))
    return sorted(out, key=repr)


def odd_pages():
    hot = "<html>" + "hot page " * 40
    rows = [(i, f"http://a/{i}", hot) for i in range(60, 20, -1)]
    rows += [(i, f"http://b/{i}", f"<p>page {i} of its own</p>" * 9) for i in range(100, 130)]
    rows += [(200, "u", "short"), (201, "u", "short"), (202, "u", None), (203, None, ""), (204, "x", "é" * 49), (205, "x", "é" * 50), (206, None, "é" * 50)]
    rows += [(300, "http://c/\r\nWARC-Type: x  y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5), (None, "n", hot), (None, None, "é" * 60), (301, "z", "é" * 60)]
    rows += [(400, "same", "twice " * 30)] * 3 + [(401, "same", "twice " * 30)] * 2 + [(400, None, "twice " * 30)]
    rows += [(500, "big", "0123456789abcdef" * 200_000), (501, "big", "0123456789abcdef" * 200_000)]
    return rows


def test_archives_resolve_revisits(spark):
    rows = odd_pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("d")).withColumn("copies", F.lit(5)).repartition(7)
    got = sorted(map(tuple, warc.archive_and_read(df).collect()), key=repr)
    assert got == plain_archive(rows)
    assert warc.archive_and_read(df.limit(0)).collect() == []
    joined = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:  # originals that are not broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        assert sorted(map(tuple, warc.archive_and_read(df).collect()), key=repr) == got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joined)


def test_archives_hold_whole_records_with_fresh_headers(spark):
    rows = odd_pages()
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, date="2024-01-02T03:04:05Z")
    kinds, names, payloads, referred, stored = defaultdict(int), [], set(), set(), 0
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        stored += len(content)
        records = list(warc.parse(bytes(content)))
        assert records == list(warc.parse(gzip.compress(bytes(content))))
        assert not records or records[0][0]["warc-type"] == "warcinfo"
        for head, block in records:
            kinds[head["warc-type"]] += 1
            names.append(head["warc-record-id"])
            assert head["warc-date"] == "2024-01-02T03:04:05Z"
            assert head["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            if head["warc-type"] == "response":
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200") and int(http.rpartition(b": ")[2]) == len(payload)
                payloads.add(payload)
            elif head["warc-type"] == "revisit":
                assert head["warc-profile"] == warc.REVISIT_PROFILE and block.endswith(b"\r\n\r\n")
                referred.add(head["warc-refers-to"])
    expected = plain_archive(rows)
    assert kinds["revisit"] == sum(r[3] == "revisit" for r in expected) and kinds["response"] + kinds["revisit"] == len(rows)
    assert len(set(names)) == len(names) and referred <= set(names)
    assert payloads == {(r[2] or "").encode() for r in rows}
    assert stored < 2 * sum(len(p) for p in payloads)  # each payload of some size once


def test_archives_that_are_cut_or_changed_are_errors(spark):
    whole = warc.make_record("response", "<urn:x>", [("WARC-Payload-Digest", "sha256:00")], warc.http_head(1) + b"x")
    assert len(list(warc.parse(whole))) == 1
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(whole[:-3]))
    with pytest.raises(ValueError, match="not a WARC record"):
        list(warc.parse(whole + b"junk"))


def test_a_revisit_without_its_response_stays(spark):
    rows = [(1, "u", "revisit", "<b>", "<a>", "d", None), (2, "u", "response", "<c>", None, "d", 7)]
    got = {r["page_id"]: (r["payload_bytes"], r["refers_to"]) for r in warc.resolve(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {1: (None, None), 2: (7, None)}
