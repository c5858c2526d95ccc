"""Image volumes in the public single-file format (a 348-byte header, then numbers, i running fastest), as a data source.

    spark.dataSource.register(Volumes)
    spark.read.format("volumes").load("/shared/study")          # series, t, shape, affine, values
    frame.write.format("volumes").option("shape", "4,4,4").mode("append").save("/shared/study")

A file is a series of volumes over time. Reading: a partition is a slab of a file's times of about SLAB_BYTES, so a large file is many
tasks, and only its bytes are read (a gzipped file is one partition, read as a stream); filters on series and t by equality, In and
comparisons choose files and slabs before any number is read, and with the option columns="series,t,..." numbers are only read where `values` is
listed. Writing: a task writes each run of rows of one series to a file of its own, under a hidden
name until the job commits; so rows go in repartitioned by series and sorted by series and t (`write_volumes`
does so). Vectors are in the order of voxel ids, k running fastest. The folder must be one that all executors mount.
"""

from __future__ import annotations

import glob
import gzip
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "series string, t long, shape array<int>, affine array<double>, values array<double>"
SLAB_BYTES = 32 << 20
# The format's header size, its magic and the codes of its numbers.
HEADER, MAGIC, DATA_AT = 348, b"n+1\x00", 352
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


@dataclass
class Header:
    """What a file says of its volumes: shape, times, numbers, where they begin, scaling, and the affine to millimetres."""

    shape: tuple[int, int, int]
    times: int
    kind: str
    at: int
    slope: float
    inter: float
    affine: list[float]

    @property
    def volume_bytes(self) -> int:
        return math.prod(self.shape) * np.dtype(self.kind).itemsize


def parse_header(raw: bytes) -> Header:
    order = next((o for o in "<>" if len(raw) >= HEADER and struct.unpack_from(f"{o}i", raw)[0] == HEADER), None)
    if order is None or raw[344:348] != MAGIC:
        raise ValueError("not a single-file volume")
    dim = struct.unpack_from(f"{order}8h", raw, 40)
    if not 1 <= dim[0] <= 7 or any(d < 1 for d in dim[1 : dim[0] + 1]) or any(d > 1 for d in dim[5 : dim[0] + 1]):
        raise ValueError(f"volumes of up to three axes and time are read, not {dim}")
    size = [dim[k] if k <= dim[0] else 1 for k in range(1, 5)]
    code = struct.unpack_from(f"{order}h", raw, 70)[0]
    if code not in KINDS:
        raise ValueError(f"numbers of code {code} are not read")
    pixdim = struct.unpack_from(f"{order}8f", raw, 76)
    at, slope, inter = struct.unpack_from(f"{order}3f", raw, 108)
    qform, sform = struct.unpack_from(f"{order}2h", raw, 252)
    if sform > 0:
        affine = [*struct.unpack_from(f"{order}12f", raw, 280), 0.0, 0.0, 0.0, 1.0]
    elif qform > 0:
        affine = _of_quaternion(*struct.unpack_from(f"{order}6f", raw, 256), pixdim)
    else:
        affine = np.diag([*pixdim[1:4], 1.0]).reshape(-1).tolist()
    if slope == 0 or not math.isfinite(slope):
        slope, inter = 1.0, 0.0
    return Header(tuple(size[:3]), size[3], order + KINDS[code], int(at), slope, inter, affine)


def _of_quaternion(b: float, c: float, d: float, x: float, y: float, z: float, pixdim: tuple) -> list[float]:
    a = math.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    turn = np.array(
        [
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
            [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ]
    )
    out = np.eye(4)
    out[:3, :3] = turn * [pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)]
    out[:3, 3] = x, y, z
    return out.reshape(-1).tolist()


def make_header(shape: tuple[int, int, int], times: int, affine: list[float]) -> bytes:
    """A header of little-endian doubles in millimetres, and the four bytes that end it."""
    raw = bytearray(DATA_AT)
    struct.pack_into("<i", raw, 0, HEADER)
    struct.pack_into("<8h", raw, 40, 4 if times > 1 else 3, *shape, times, 1, 1, 1)
    struct.pack_into("<2h", raw, 70, 64, 64)
    sides = np.sqrt((np.array(affine).reshape(4, 4)[:3, :3] ** 2).sum(axis=0))
    struct.pack_into("<8f", raw, 76, 1.0, *sides, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", raw, 108, float(DATA_AT), 1.0, 0.0)
    raw[123] = 2  # millimetres
    struct.pack_into("<2h", raw, 252, 0, 1)
    struct.pack_into("<12f", raw, 280, *affine[:12])
    raw[344:348] = MAGIC
    return bytes(raw)


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")  # noqa: SIM115


def local_path(path: str) -> str:
    """A mounted folder's path; other stores than mounted ones are an error."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"volumes are read and written through a mounted folder, not {path}")
    return path.removeprefix("file://") if "://" in path else path.removeprefix("file:")


def series_of(path: str) -> str:
    name = os.path.basename(path)
    return name.removesuffix(".gz").removesuffix(".nii")


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    last: int


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = local_path(options["path"])
        self.wanted = [c.strip() for c in options.get("columns", "series,t,shape,affine,values").split(",")]
        self.slab_bytes = int(options.get("slabbytes", SLAB_BYTES))
        self.series: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list) -> Iterator:
        """Filters on series and t choose files and slabs; all are left to Spark too, which checks each row."""
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if name == ("series",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.series = asked if self.series is None else self.series & asked
            elif name == ("t",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    last = f.value - isinstance(f, LessThan)
                    self.high = last if self.high is None else min(self.high, last)
            yield f

    def files(self) -> list[str]:
        found = [p for end in ("nii", "nii.gz") for p in glob.glob(os.path.join(self.path, f"*.{end}"))] if os.path.isdir(self.path) else glob.glob(self.path)
        return sorted(p for p in found if not os.path.basename(p).startswith((".", "_")))

    def partitions(self) -> list[Slab]:
        out = []
        for path in self.files():
            if self.series is not None and series_of(path) not in self.series:
                continue
            with _open(path) as file:
                head = parse_header(file.read(DATA_AT))
            low, high = self.low, head.times if self.high is None else min(head.times, self.high + 1)
            step = head.times if path.endswith(".gz") else max(1, self.slab_bytes // max(1, head.volume_bytes))
            out += [Slab(path, a, min(a + step, high)) for a in range(low, high, step)]
        return out or [Slab("", 0, 0)]

    def read(self, partition: Slab) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with _open(partition.path) as file:
            head = parse_header(file.read(DATA_AT))
            if "values" in self.wanted:
                file.seek(head.at + partition.first * head.volume_bytes)
            for t in range(partition.first, partition.last):
                values = None
                if "values" in self.wanted:
                    raw = file.read(head.volume_bytes)
                    if len(raw) < head.volume_bytes:
                        raise ValueError(f"{partition.path} is cut short")
                    cube = np.frombuffer(raw, head.kind).astype(float).reshape(head.shape, order="F")
                    values = cube.reshape(-1) * head.slope + head.inter
                columns = [[series_of(partition.path)], [t], [list(head.shape)], [head.affine], [values]]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["series", "t", "shape", "affine", "values"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = local_path(options["path"])
        self.shape = tuple(int(x) for x in options["shape"].split(","))
        self.affine = [float(x) for x in options["affine"].split(",")] if "affine" in options else np.eye(4).reshape(-1).tolist()
        if overwrite:
            raise ValueError("volumes are appended to a folder; overwriting it is left to the caller")
        if len(self.shape) != 3 or len(self.affine) != 16:
            raise ValueError("shape takes three numbers, affine sixteen")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done: list[tuple[str, str]] = []
        now = file = None
        times = 0

        def close() -> None:
            if file is not None:
                file.seek(0)
                file.write(make_header(self.shape, times, self.affine))
                file.close()

        for batch in iterator:
            rows = batch.to_pydict()
            for series, values in zip(rows["series"], rows["values"], strict=True):
                if not series or "/" in series or series.startswith((".", "_")):
                    raise ValueError(f"a series cannot be named {series!r}")
                if values is None or len(values) != math.prod(self.shape):
                    raise ValueError(f"a volume of {series} is not of shape {self.shape}")
                if series != now:
                    close()
                    hidden = os.path.join(self.path, f".{series}-{uuid.uuid4().hex}")
                    done.append((hidden, os.path.join(self.path, f"{series}.nii")))
                    file, now, times = open(hidden, "wb"), series, 0  # noqa: SIM115
                    file.write(bytes(DATA_AT))
                file.write(np.asarray(values, "<f8").reshape(self.shape).tobytes(order="F"))
                times += 1
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a series came to more than one task, or in parts: write rows repartitioned and sorted by series")
        for hidden, name in files:
            os.replace(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.files if m is not None else []:
                if os.path.exists(hidden):
                    os.remove(hidden)


class Volumes(DataSource):
    """format("volumes"); options: path, and for reading columns and slabBytes, for writing shape and affine (row by row)."""

    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_volumes(spark: SparkSession, path: str, columns: str | None = None, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """SCHEMA of all volumes of a folder, or of the files that a pattern names; no file: empty. `values` is null where `columns`
    does not list it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Volumes)
    reader = spark.read.format("volumes").option("slabBytes", slab_bytes)
    return (reader.option("columns", columns) if columns else reader).load(path)


def write_volumes(frame: DataFrame, path: str, shape: tuple[int, int, int], affine: list[float] | None = None) -> None:
    """frame(series, t, values) as one file a series, volumes in the order of t. A series goes to one task, which writes it volume by
    volume. Null vectors and vectors of another size are errors; a file of the same name is replaced."""
    frame.sparkSession.dataSource.register(Volumes)
    rows = frame.select(F.col("series").cast("string").alias("series"), F.col("t").cast("long").alias("t"), F.array().cast("array<int>").alias("shape"), F.array().cast("array<double>").alias("affine"), F.col("values").cast("array<double>").alias("values"))
    writer = rows.repartition("series").sortWithinPartitions("series", "t").write.format("volumes").option("shape", ",".join(map(str, shape)))
    if affine is not None:
        writer = writer.option("affine", ",".join(map(str, affine)))
    writer.mode("append").save(path)


def spaces(volumes: DataFrame) -> DataFrame:
    """shape, affine, series (how many), volumes: the spaces that a study's volumes are in; one row if all match."""
    return volumes.groupBy("shape", "affine").agg(F.count_distinct("series").alias("series"), F.count(F.lit(1)).alias("volumes"))


def check_space(volumes: DataFrame, shape: tuple[int, int, int] | None = None, affine: list[float] | None = None, tolerance: float = 1e-3) -> tuple[list[int], list[float]]:
    """The one space of all volumes (the first in order, where affines differ by no more than tolerance); an error if they differ, or are
    not as given."""
    found = spaces(volumes).orderBy(F.col("volumes").desc(), "shape", "affine").limit(100).collect()
    if not found:
        raise ValueError("there are no volumes")
    shape, affine = list(shape or found[0]["shape"]), list(affine or found[0]["affine"])
    for row in found:
        if row["shape"] != shape or np.abs(np.array(row["affine"]) - affine).max() > tolerance:
            raise ValueError(f"{row['series']} series are in another space: shape {row['shape']}, affine {row['affine']}")
    return shape, affine
