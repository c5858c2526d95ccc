"""The pipeline's stages against plain versions of their decisions."""

import sys
from pathlib import Path

import corpus_pipeline
import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import mixing, quality
from tessera.llm.common import remainder

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_text_operators import plain_components, plain_ids, shingles, words  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stage(spark, frame, SMALL)
        frame = frame.cache()
        seen[name] = (before.count(), frame.count())
        if name != "tokens":
            assert frame.columns == docs.columns
            assert frame.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("text <> t").count() == 0
    assert seen["quality"][1] < seen["quality"][0] and seen["near_dedup"][1] < seen["near_dedup"][0]
    assert seen["decontaminate"][1] <= seen["decontaminate"][0] and seen["tokens"][0] == seen["tokens"][1]


def test_each_stage_matches_a_brute_force_version(spark):
    """The rows that every stage keeps of its own input, from plain Python over the documents one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def ids(frame):
        return sorted(r["doc_id"] for r in frame.collect())

    model = quality.train(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), remainder() != 2)
    accepted = [i for i, t in sorted(rows.items()) if quality.scores_of(model, pa.array([t], pa.string()))[0] >= 0.7]
    assert ids(stages["quality"](spark, docs, SMALL)) == accepted and 0 < len(accepted) < len(rows)

    single = [i for i, _, _, kept in plain_components(sorted(rows.items()), 80) if kept]
    assert ids(stages["near_dedup"](spark, docs, SMALL)) == single and len(single) < len(rows)

    planted = docs.limit(0).union(spark.createDataFrame([(-1, words(30, 1) + " " + items[0] + " " + words(30, 2), None, None, None), (-2, words(90, 3), None, None, None)], docs.schema)).union(docs)
    clean = []
    for r in planted.collect():
        found = False
        for t in items:
            n = min(5, len(t.split()))
            found |= bool(n) and len(r["text"].split()) >= n and 100 * len(shingles(t) & shingles(r["text"], n)) >= 80 * len(shingles(t))
        clean += [] if found else [r["doc_id"]]
    assert ids(stages["decontaminate"](spark, planted, SMALL)) == sorted(clean) and -1 not in clean and -2 in clean

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    takes = con.sql(f"select doc_id, size, taken from ({mixing.ORACLE_SQL})").fetchall()
    assert ids(stages["mixing"](spark, docs, SMALL)) == sorted(i for i, size, taken in takes if size for _ in range(int(taken / size + 0.5)))

    got = sorted(tuple(r) for r in stages["tokens"](spark, docs, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == plain_ids(list(rows.items()))


def test_run_is_the_stages_in_order(spark):
    a = corpus_pipeline.run(spark, SMALL).toPandas().sort_values("start").reset_index(drop=True)
    assert len(a) and (a.start == (a.n_tokens.cumsum() - a.n_tokens)).all()
    assert a.doc_id.is_monotonic_increasing
    assert a.groupby("doc_id").size().max() <= 3


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    long_text = " ".join(f"word{k % 700}" for k in range(20_000))
    return [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, long_text, "en", None, 1), (4, long_text, None, "b", 1), (4, long_text, None, "b", 1),
        (None, "one two three four five six", "en", "a", 1), (5, "one", "en", "a", 1), (6, "one two three four five six seven", "en", "b", 1),
    ]


def test_every_stage_takes_odd_and_empty_tables(spark, monkeypatch):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    for name in ("times", "turn", "kept_id", "found_id", "mix_id", "rep", "size", "taken", "label", "score", "row", "gone"):
        odd = odd.withColumn(name, F.lit(None).cast("string"))
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, SMALL).collect()
            assert (len(got) > 0) == (docs is odd) or name == "quality", name
            if name not in ("tokens", "mixing"):
                assert len(got) <= len(odd_rows())
    columns = [stage(spark, odd, SMALL).columns for _, stage in corpus_pipeline.STAGES[:-1]]
    assert all(c == odd.columns for c in columns)


def test_near_dedup_stage_keeps_one_row_of_repeats(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS)
    got = sorted((r["doc_id"] or 0) for r in corpus_pipeline.keep_one_of_near_copies(spark, odd, SMALL).collect())
    assert got == [0, 1, 2, 3, 5, 6]


def test_rows_without_an_id_and_rows_that_share_one(spark):
    """No row is lost or kept by accident: the stages go by rows, not by ids."""
    a, b, c, d = (words(60, k) for k in (41, 42, 43, 44))
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 2), (None, c, "en", "a", 3), (None, c, "en", "b", 4), (None, d, None, None, 5), (7, d, "en", "a", 6), (None, None, "en", "a", 7)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = sorted(r["n_chars"] for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, SMALL).collect())
    assert kept in ([1, 2, 3, 6, 7], [1, 2, 4, 6, 7])  # both texts of id 1, one copy of c, of d that with an id
    mixed = [(r["n_chars"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SMALL).collect()]
    takes = {r["key"]: (r["size"], r["taken"]) for r in mixing.mix(docs, key="n_chars").collect()}
    assert len(takes) == 7 and takes[7] == (0, 0) and sum(taken for size, taken in takes.values()) > 300
    for n, (size, taken) in takes.items():
        assert sum(m == n for m, _ in mixed) == (int(taken / size + 0.5) if size else 0)
    assert any(n in (3, 4, 5) for n, _ in mixed)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()
    assert sorted(r["n_chars"] for r in clean) == [1, 2, 3, 4, 5, 6, 7]
    tokens = corpus_pipeline.write_tokens(spark, docs, SMALL).collect()
    assert len(tokens) == len(rows) and sum(t["doc_id"] is None for t in tokens) == 4
