"""Manifests that pair images with their files, and labels of a probabilistic atlas."""

import pytest

from tessera.operators import spatial
from tessera.sources import files


@pytest.fixture
def tree(tmp_path):
    def put(name, text="x"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)

    for s in ("01", "02"):
        for r in ("1", "2"):
            put(f"sub-{s}/func/sub-{s}_task-look_run-{r}_bold.nii.gz")
            put(f"sub-{s}/func/sub-{s}_task-look_run-{r}_desc-confounds_timeseries.tsv", f"csf\tmotion\nn/a\t0.5\n{s}\t{r}\n")
    put("sub-01/func/sub-01_task-look_run-1_events.tsv", "onset\tduration\n1\t2\n")
    put("task-look_events.tsv", "onset\tduration\n")
    put("sub-02/func/sub-02_task-rest_bold.nii")
    put("sub-02/func/sub-02_task-rest_confounds.tsv", "gray level\tcsf\r\n7\t\r\n\r\n")
    put("sub-02/func/notes_bold.txt")
    put("stray_bold.nii")
    return str(tmp_path)


def runs(spark, tree, only=None):
    return files.pair_runs(files.manifest(spark, tree), only)


def test_images_meet_the_files_of_their_run(spark, tree):
    name = lambda p: p and p.rsplit("/", 1)[1]
    got = {name(r["path"]): (name(r["events_path"]), name(r["confounds_path"])) for r in runs(spark, tree).collect()}
    want = {
        f"sub-{s}_task-look_run-{r}_bold.nii.gz": ("task-look_events.tsv", f"sub-{s}_task-look_run-{r}_desc-confounds_timeseries.tsv") for s in ("01", "02") for r in "12"
    }
    want["sub-01_task-look_run-1_bold.nii.gz"] = ("sub-01_task-look_run-1_events.tsv", "sub-01_task-look_run-1_desc-confounds_timeseries.tsv")
    want |= {"sub-02_task-rest_bold.nii": (None, "sub-02_task-rest_confounds.tsv"), "stray_bold.nii": (None, None)}
    assert got == want


def test_images_are_kept_by_entity(spark, tree):
    assert runs(spark, tree, {"task": ["look"], "subject": ["02"]}).count() == 2
    assert runs(spark, tree, {"task": ["none"]}).count() == 0
    assert runs(spark, tree, {"subject": ["01", "02"]}).count() == 5


def test_confounds_of_all_runs_are_one_table(spark, tree):
    got = {(r["path"].rsplit("/", 1)[1], r["row_id"]): r["values"] for r in files.read_runs(spark, runs(spark, tree), "confounds_path").collect()}
    assert len(got) == 9
    assert got["sub-01_task-look_run-2_bold.nii.gz", 0] == {"csf": None, "motion": 0.5}
    assert got["sub-02_task-look_run-1_bold.nii.gz", 1] == {"csf": 2.0, "motion": 1.0}
    assert got["sub-02_task-rest_bold.nii", 0] == {"gray level": 7.0, "csf": None}
    # the shared file has a header only, and most images share it
    assert files.read_runs(spark, runs(spark, tree), "events_path").count() == 1
    assert files.read_runs(spark, runs(spark, tree, {"task": ["none"]}), "events_path").count() == 0


def test_regions_of_a_probabilistic_atlas(spark):
    atlas = spark.createDataFrame(
        [(0, 0, 0, "low", 4.9), (1, 0, 0, "b", 20.0), (1, 0, 0, "a", 20.0), (1, 0, 0, "c", 55.55), (1, 0, 0, "d", 4.0), (0, 1, 0, None, 5.0)],
        "i int, j int, k int, label string, percent double",
    )
    points = spark.createDataFrame([(1, 2.0, 0.0, 0.0), (2, 0.0, 2.1, 0.0), (3, 0.0, 0.0, 0.0), (4, 99.0, 0.0, 0.0), (5, None, 0.0, 0.0)], "point_id int, x double, y double, z double")
    got = {r["point_id"]: r["label"] for r in spatial.label_probabilities(points, atlas, 2, 2.0, (0.0, 0.0, 0.0)).collect()}
    assert got == {1: "55.6% c; 20.0% a; 20.0% b", 2: "5.0% no label", 3: "no label", 4: "no label", 5: "no label"}
    assert {r["label"] for r in spatial.label_probabilities(points, atlas.limit(0), 2, 2.0, (0.0, 0.0, 0.0)).collect()} == {"no label"}
