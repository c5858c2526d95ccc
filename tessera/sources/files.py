"""Reading and writing: design files, bundles of named frames with attributes, and file manifests.

Everything goes through Spark's readers and writers, so paths may be in any store. A bundle is a
folder of Parquet tables and one JSON text of attributes; what the reference keeps in binary
containers (images, fits, matrices) is such a bundle here.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands for a missing number in a design file.
MISSING = ("n/a", "N/A", "NA", "")

ENTITIES = {"subject": r"sub-([A-Za-z0-9]+)", "session": r"ses-([A-Za-z0-9]+)", "task": r"task-([A-Za-z0-9]+)", "run": r"run-([0-9]+)", "space": r"space-([A-Za-z0-9]+)"}


def read_design(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A .csv or .tsv with a header: row_id in file order, all other columns doubles, missing ones null.

    Meant for a design, one file of a bounded number of rows: its order is that of one partition.
    """
    raw = spark.read.csv(path, sep="\t" if path.endswith((".tsv", ".tsv.gz")) else ",", header=True)
    names = columns or raw.columns
    numbered = raw.coalesce(1).withColumn("row_id", F.monotonically_increasing_id())
    return numbered.select("row_id", *[F.when(F.trim(c).isin(*MISSING), None).otherwise(F.trim(c)).try_cast("double").alias(c) for c in names])


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration, kind of an events file (trial_type or condition names the kind)."""
    raw = spark.read.csv(path, sep="\t" if path.endswith(".tsv") else ",", header=True)
    kind = next((c for c in ("trial_type", "condition", "kind", "Condition", "Stim") if c in raw.columns), None)
    if kind is None:
        raise ValueError(f"no column of {raw.columns} names the kind of an event")
    lower = {c.lower(): c for c in raw.columns}
    return raw.select(F.col(lower["onset"]).cast("double").alias("onset"), F.col(lower["duration"]).cast("double").alias("duration"), F.col(kind).alias("kind"))


def write_design(frame: DataFrame, path: str, sep: str = ",") -> None:
    """A header and rows in the order of row_id, which is not written."""
    frame.repartitionByRange("row_id").sortWithinPartitions("row_id").drop("row_id").write.mode("overwrite").csv(path, sep=sep, header=True)


def write_bundle(path: str, attributes: dict, **frames: DataFrame) -> None:
    """Each frame as Parquet under its name, and the attributes with the list of names."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(frames.values())).sparkSession
    text = json.dumps({"version": 1, "frames": sorted(frames), "attributes": attributes}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/attributes")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(attributes, frames) of a bundle."""
    held = json.loads(spark.read.text(f"{path}/attributes").first()["value"])
    return held["attributes"], {name: spark.read.parquet(f"{path}/{name}") for name in held["frames"]}


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and the entities that file names carry (sub-, ses-, task-, run-, space-), null where
    a name has none. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = {k: F.regexp_extract("path", p, 1) for k, p in ENTITIES.items()}
    return files.select("path", "length", *[F.when(c != "", c).alias(k) for k, c in found.items()])


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files with RepetitionTime of the JSON text of the same name: sidecars(path, text)."""
    stem = lambda c: F.regexp_replace(c, r"\.[A-Za-z.]+$", "")
    times = sidecars.select(stem(F.col("path")).alias("stem"), F.get_json_object("text", "$.RepetitionTime").cast("double").alias("tr"))
    return files.withColumn("stem", stem(F.col("path"))).join(times, "stem", "left").drop("stem")


def to_square(adj: DataFrame, nodes: Sequence[int]) -> DataFrame:
    """One row for each matrix and i, one column n_j for each node j; the diagonal of symmetric ones is 0."""
    wide = adj.groupBy("matrix_id", "i").pivot("j", list(nodes)).agg(F.first("value"))
    return wide.select("matrix_id", "i", *[F.coalesce(F.col(str(j)), F.lit(0.0)).alias(f"n_{j}") for j in nodes])


def from_square(square: DataFrame, nodes: Sequence[int], symmetric: bool = True) -> DataFrame:
    """Edges of to_square's form, i < j where symmetric."""
    pairs = F.explode(F.array(*[F.struct(F.lit(int(j)).alias("j"), F.col(f"n_{j}").alias("value")) for j in nodes]))
    long = square.select("matrix_id", "i", pairs.alias("p")).select("matrix_id", "i", "p.j", "p.value")
    return long.filter("i < j") if symmetric else long


def matrix_kind(square: DataFrame) -> DataFrame:
    """matrix_id, kind: distance (symmetric, zero diagonal), similarity (unit diagonal) or directed, of
    square(matrix_id, i, j, value)."""
    mirrored = square.select("matrix_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("other"))
    both = square.join(mirrored, ["matrix_id", "i", "j"], "left")
    s = both.groupBy("matrix_id").agg(
        F.bool_and(F.coalesce(F.abs(F.col("value") - F.col("other")) < 1e-9, F.lit(False))).alias("even"),
        F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("trace"),
        F.countDistinct("i").alias("n"),
    )
    kind = F.when(~F.col("even"), "directed").when(F.abs("trace") < 1e-9, "distance").when(F.abs(F.col("trace") - F.col("n")) < 1e-6, "similarity").otherwise("directed")
    return s.select("matrix_id", kind.alias("kind"))


def number_rows(frame: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_id") -> DataFrame:
    """An explicit row id from 0 inside each key."""
    return frame.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


#: How the files that belong to an image of a series end.
IMAGE_END, EVENTS_END, CONFOUNDS_END = r"_bold\.nii(\.gz)?$", r"_events\.tsv$", r"(_desc-confounds_(timeseries|regressors)|_confounds)\.tsv(\.gz)?$"
#: What an image and the files beside it share, where a name says it.
RUN = ["subject", "session", "task", "run"]


def pair_runs(files: DataFrame, only: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """path, length, subject, session, task, run, space, events_path, confounds_path: a row an image of a manifest.

    `only` keeps images by entity, as {"task": ["rest"]}; an image without the entity goes. A file of events or confounds
    belongs to the images of equal subject, session, task and run, where what both names lack is equal. An events file
    without a subject is its task's, for images that have none of their own. Of several files for one image that of the
    smallest path is taken; without any the path is null. An image without a subject is kept, with nulls.
    """
    images = files.filter(F.col("path").rlike(IMAGE_END)).select("path", "length", *ENTITIES)
    for entity, values in (only or {}).items():
        images = images.filter(F.col(entity).isin(*values))

    def beside(end: str, name: str, keys: Sequence[str]) -> DataFrame:
        return files.filter(F.col("path").rlike(end)).groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.min("path").alias(name))

    def met(images: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        return images.join(found, same, "left").drop(*[f"{k}_" for k in keys])

    shared = files.filter(F.col("path").rlike(EVENTS_END) & F.col("subject").isNull() & F.col("task").isNotNull())
    shared = shared.groupBy(F.col("task").alias("task_")).agg(F.min("path").alias("shared_"))
    made = met(images, beside(EVENTS_END, "events_path", RUN), RUN)
    made = made.join(shared, F.col("task") == F.col("task_"), "left").withColumn("events_path", F.coalesce("events_path", "shared_")).drop("task_", "shared_")
    return met(made, beside(CONFOUNDS_END, "confounds_path", RUN), RUN)


def read_runs(spark: SparkSession, runs: DataFrame, column: str, sep: str = "\t") -> DataFrame:
    """path (of the image), row_id, values: a map of column names to doubles, null where missing, of the design files
    that `column` of pair_runs names, whatever their columns are. Each file is split where it lies, by one task; images
    without a file, and files of a header alone, have no rows.
    """
    named = runs.filter(F.col(column).isNotNull()).select(F.col("path").alias("image_"), F.col(column).alias("file_"))
    paths = [r["file_"] for r in named.select("file_").distinct().toLocalIterator()]  # names of files, no contents
    if not paths:
        return spark.createDataFrame([], "path string, row_id int, values map<string, double>")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("at_"), "value")
    plain = lambda c: F.regexp_replace(F.url_decode(c), r"^file:/+", "/")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    header = F.split(F.get("lines", F.lit(0)), sep)
    rows = whole.withColumn("lines", lines).select("at_", header.alias("header"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("row_id", "line"))
    number = lambda x: F.when(F.trim(x).isin(*MISSING), None).otherwise(F.trim(x)).try_cast("double")
    cells = F.zip_with("header", F.split("line", sep), lambda h, x: F.struct(F.trim(h).alias("k"), number(x).alias("v")))
    values = F.map_from_entries(F.filter(cells, lambda c: c["k"].isNotNull()))
    return rows.select("at_", "row_id", values.alias("values")).join(named, plain(F.col("at_")) == plain(F.col("file_"))).select(F.col("image_").alias("path"), "row_id", "values")
