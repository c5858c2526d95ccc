"""Secret scans with corpus-wide ownership frequency, of DataFrame functions alone.

One scan of the texts finds base spans (key assignments, access ids, long hex runs) and further
candidates: long tokens of mixed letters and digits without any such sign. All candidates' hashes are
counted over the corpus by distinct repositories and distinct owners. A value that many owners hold,
or that is in many repositories, even those of one owner, is a widely copied example; one that is in
few repositories of few owners is specific to them and looks live. Live candidates that no base span
covers become spans of kind `token`.

The scan keeps hashes and places, never the values, in the shared folder; texts are not shuffled.
Counts sum within each task before their shuffle, and the join back to the places is one that
adaptive execution can split at a value that a third of all rows hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

# The patterns of the base kinds and of the further candidates.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "token")

#: A value held by more distinct owners than this is a widely copied example.
MAX_OWNERS = 2
#: So is a value in more distinct repositories than this, however few their owners.
MAX_REPOS = 10


def _found(kind: int, pattern: str, value_group: int = 0) -> tuple[Column, Column, Column]:
    pat = F.lit(pattern)
    return F.regexp_extract_all("text", pat, F.lit(0)), F.split("text", pattern, -1), F.regexp_extract_all("text", pat, F.lit(value_group))


def _matches(kind: int, pattern: str, possible: Column, value_group: int = 0) -> Column:
    """An array of (kind, nth, gap before, length, value length, value hash) of a kind's matches."""
    whole, gaps, values = _found(kind, pattern, value_group)
    made = F.transform(
        whole,
        lambda m, k: F.struct(
            F.lit(kind).alias("kind"),
            k.alias("nth"),
            F.char_length(F.get(gaps, k)).alias("gap"),
            F.char_length(m).alias("size"),
            F.char_length(F.get(values, k)).alias("value_size"),
            F.md5(F.get(values, k).cast("binary")).alias("value"),
            m.rlike("[0-9]").__and__(m.rlike("[a-z]")).__and__(m.rlike("[A-Z]")).alias("varied"),
        ),
    )
    return F.when(possible, made)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None) -> DataFrame:
    """row, doc_id, owner, repo, kind, start, end, value of every candidate; a row without any has one
    line with null kind. Positions are code points, end exclusive."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repo or doc_id).cast("string").alias("repo"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    body = F.col("text")
    arrays = [
        _matches(0, ASSIGN, body.contains("=") | body.contains(":"), 2),
        _matches(1, ACCESS, body.contains("AKIA")),
        _matches(2, HEX, F.lit(True)),
        _matches(3, TOKEN, F.lit(True)),
    ]
    own = [F.coalesce(a, F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,value_size:int,value:string,varied:boolean>>")) for a in arrays]
    listed = rows.select("row", "doc_id", "owner", "repo", F.explode_outer(F.concat(*own)).alias("m")).select("row", "doc_id", "owner", "repo", "m.*")
    saved = save(listed, "secrets")
    so_far = F.sum(F.col("gap") + F.col("size")).over(
        Window.partitionBy("row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = saved.withColumn("end", so_far.cast("long")).withColumn("start", F.col("end") - F.col("size"))
    good = F.col("kind").isNull() | F.col("kind").isin(1, 2) | (F.col("kind") == 0) & (F.col("value_size") >= ASSIGN_MIN) | (F.col("kind") == 3) & F.col("varied")
    # a failing match leaves its row without a span, not without a line
    return placed.select(
        "row", "doc_id", "owner", "repo", *[F.when(good, F.col(c)).alias(c) for c in ("kind", "start", "end", "value")]
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """value, n_repos, n_owners: in how many distinct repositories and under how many owners it occurs;
    null ones, all together, count as one more."""
    some = candidates.filter("value IS NOT NULL")

    def distinct(c: str) -> Column:
        return F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))

    return some.groupBy("value").agg(distinct("repo").alias("n_repos"), distinct("owner").alias("n_owners"))


def _joined(spans: Column) -> Column:
    """kind:start:end of (start, kind, end) in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, one row per input row.

    spans holds the base spans and the live `token` spans. n_live and n_example count all candidates
    by what the corpus says of their values: live are those of at most `max_owners` owners and at most
    `max_repos` repositories. Without a `repo` column each document is a repository. Null or empty text:
    no span. A null id is carried; rows that repeat an id are each scanned. Spans that start together
    are in the order of KINDS. Other columns are not read. Empty table: empty result.
    """
    candidates = save(scan(docs, doc_id, text, owner, repo), "candidates")
    owners = save(ownership(candidates).withColumnRenamed("value", "known"), "owners")
    some = candidates.filter("kind IS NOT NULL")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = some.join(owners, some["value"] == owners["known"], "left").withColumn("live", few)
    base = F.col("kind") < 3
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = judged.withColumn("base_end", F.max(F.when(base, F.col("end"))).over(before)).withColumn(
        "base_start", F.min(F.when(base, F.col("start"))).over(after)
    )
    clear = (F.coalesce("base_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    # a base span that starts with the token sorts before it, so base_end covers that case
    kept = seen.filter(base | clear)
    place = F.struct("start", "kind", "end")
    per_row = kept.groupBy("row").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.collect_list(F.when(base, place)).alias("base"),
        F.collect_list(F.when(base | F.col("live"), place)).alias("all"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    )
    rows = candidates.select("row", "doc_id").distinct()
    whole = rows.join(per_row, "row", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return whole.select(
        "doc_id",
        *zero,
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("all")), F.lit("")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example")],
    )


def _sql_kind(kind: int, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, source, {kind} AS kind, regexp_extract_all(text, '{quoted}', 0) AS m, "
        f"string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}', {group}) AS v FROM d"
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(_sql_kind(n, p, 2 * (n == 0)) for n, p in enumerate((ASSIGN, ACCESS, HEX, TOKEN)))}),
e AS (SELECT doc_id, source, kind, generate_subscripts(m, 1) AS nth, unnest(m) AS m, unnest(gaps[1:len(m)]) AS gap, unnest(v) AS v FROM k WHERE len(m) > 0),
p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY nth)::BIGINT AS stop FROM e),
c AS (SELECT doc_id, source, kind, stop - length(m) AS start, stop, v FROM p
      WHERE kind IN (1, 2) OR kind = 0 AND length(v) >= {ASSIGN_MIN}
         OR kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')),
o AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) <= {MAX_OWNERS} AND count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) <= {MAX_REPOS} AS live FROM c GROUP BY v),
s AS (SELECT c.*, live FROM c JOIN o USING (v) WHERE kind < 3 OR NOT EXISTS
      (SELECT 1 FROM c b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.start < c.stop AND c.start < b.stop)),
t AS (SELECT *, ['assign', 'access', 'hex', 'token'][kind + 1] || ':' || start || ':' || stop AS span FROM s)
SELECT d.doc_id, (count(*) FILTER (WHERE kind = 0))::BIGINT AS n_assign, (count(*) FILTER (WHERE kind = 1))::BIGINT AS n_access,
       (count(*) FILTER (WHERE kind = 2))::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3 OR live), '') AS spans,
       (count(*) FILTER (WHERE live))::BIGINT AS n_live, (count(*) FILTER (WHERE NOT live))::BIGINT AS n_example
FROM d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id
"""
