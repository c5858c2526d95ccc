"""Volumes written, read back, and read where another program wrote them."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import volumes as vo

AFFINE = [2.0, 0, 0, -10.0, 0, 3.0, 0, 5.0, 0, 0, 4.0, 1.0, 0, 0, 0, 1.0]


@pytest.fixture
def study(spark, tmp_path):
    r = np.random.default_rng(1)
    cubes = {f"sub-{s}": r.normal(size=(n, 24)) for s, n in (("a", 5), ("b", 1), ("c", 9))}
    rows = [(s, t, x.tolist()) for s, c in cubes.items() for t, x in enumerate(c)]
    frame = spark.createDataFrame(rows, "series string, t long, values array<double>").repartition(7)
    vo.write_volumes(frame, str(tmp_path / "study"), (2, 3, 4), AFFINE)
    return cubes, tmp_path / "study"


def test_volumes_come_back(spark, study):
    cubes, path = study
    assert sorted(p.name for p in path.iterdir()) == ["sub-a.nii", "sub-b.nii", "sub-c.nii"]
    frame = vo.read_volumes(spark, f"file://{path}", slab_bytes=400)  # two volumes a partition
    assert frame.rdd.getNumPartitions() == 3 + 1 + 5
    got = {(g["series"], g["t"]): g for g in frame.collect()}
    assert set(got) == {(s, t) for s, c in cubes.items() for t in range(len(c))}
    for (s, t), g in got.items():
        assert g["values"] == cubes[s][t].tolist() and g["shape"] == [2, 3, 4] and g["affine"] == AFFINE
    raw = (path / "sub-a.nii").read_bytes()  # i runs fastest in the file, k in the vectors
    assert np.frombuffer(raw, "<f8", 24, 352).reshape(2, 3, 4, order="F").reshape(-1).tolist() == cubes["sub-a"][0].tolist()
    assert vo.check_space(frame) == ([2, 3, 4], AFFINE)
    assert vo.spaces(vo.read_volumes(spark, str(path), "series,t,shape,affine")).collect()[0]["volumes"] == 15


def test_filters_choose_files_and_slabs(spark, study):
    _, path = study
    frame = vo.read_volumes(spark, str(path), slab_bytes=400)
    some = frame.filter((F.col("series") == "sub-c") & (F.col("t") >= 3) & (F.col("t") < 6))
    assert some.rdd.getNumPartitions() == 2 and sorted(g["t"] for g in some.collect()) == [3, 4, 5]
    assert frame.filter(F.col("series").isin("sub-a", "sub-b") & (F.col("t") == 0)).count() == 2
    assert frame.filter("series = 'sub-x'").collect() == [] and frame.filter("t > 100").collect() == []
    light = vo.read_volumes(spark, str(path), "series,t").collect()
    assert len(light) == 15 and all(g["values"] is None for g in light)


def test_files_of_other_programs(spark, tmp_path):
    cube = np.arange(24, dtype=">i2").reshape(2, 3, 4)
    raw = bytearray(vo.DATA_AT)
    struct.pack_into(">i", raw, 0, 348)
    struct.pack_into(">8h", raw, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into(">2h", raw, 70, 4, 16)
    struct.pack_into(">8f", raw, 76, -1.0, 2.0, 2.0, 2.0, 0, 0, 0, 0)
    struct.pack_into(">3f", raw, 108, 352.0, 0.5, 10.0)
    struct.pack_into(">2h", raw, 252, 1, 0)
    struct.pack_into(">6f", raw, 256, 0.0, 0.0, 1.0, 7.0, 8.0, 9.0)  # half a turn around k
    raw[344:348] = vo.MAGIC
    with gzip.open(tmp_path / "big.nii.gz", "wb") as f:
        f.write(bytes(raw) + cube.tobytes(order="F"))
    (tmp_path / "_hidden.nii").write_bytes(b"x")
    (g,) = vo.read_volumes(spark, str(tmp_path)).collect()
    assert g["series"] == "big" and g["values"] == (np.arange(24) * 0.5 + 10).tolist()
    np.testing.assert_allclose(np.array(g["affine"]).reshape(4, 4), [[-2, 0, 0, 7], [0, -2, 0, 8], [0, 0, -2, 9], [0, 0, 0, 1]], atol=1e-6)
    (tmp_path / "bad.nii").write_bytes(bytes(400))
    with pytest.raises(Exception, match="not a single-file volume"):
        vo.read_volumes(spark, str(tmp_path)).collect()


def test_what_cannot_be_written_or_matched(spark, study, tmp_path):
    cubes, path = study
    one = spark.createDataFrame([("x", 0, [1.0] * 8)], "series string, t long, values array<double>")
    with pytest.raises(Exception, match="not of shape"):
        vo.write_volumes(one, str(tmp_path / "other"), (2, 2, 3))
    with pytest.raises(Exception, match="cannot be named"):
        vo.write_volumes(one.withColumn("series", F.lit("a/b")), str(tmp_path / "other"), (2, 2, 2))
    with pytest.raises(ValueError, match="mounted folder"):
        vo.local_path("hdfs://x/y")
    vo.write_volumes(one, str(path), (2, 2, 2), AFFINE)
    with pytest.raises(ValueError, match="another space"):
        vo.check_space(vo.read_volumes(spark, str(path)))
    with pytest.raises(ValueError, match="no volumes"):
        vo.check_space(vo.read_volumes(spark, str(tmp_path / "nothing")))
    twice = one.unionByName(one.withColumn("series", F.lit("y"))).unionByName(one).coalesce(1)
    vo.write_volumes(twice, str(tmp_path / "two"), (2, 2, 2))
    assert sorted(p.name for p in (tmp_path / "two").iterdir()) == ["x.nii", "y.nii"]
