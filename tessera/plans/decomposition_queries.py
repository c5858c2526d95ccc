"""Queries of decompositions: all images, all voxels. tests/test_decomposition.py holds the operators against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import decomposition as dc
from tessera.plans.registry import query
from tessera.sources.tables import images

PARTS = "component int, variance double, loading array<double>"


def positive(spark, d):
    """The images' values above zero, others zero."""
    return images(spark, d).withColumn("values", F.transform("values", lambda x: F.greatest(x, F.lit(0.0))))


def folded(spark, d):
    return images(spark, d).withColumn("fold", (F.col("image_id") % 3).cast("int"))


def _parts(spark, variance, parts):
    return spark.createDataFrame([(k, float(v), [float(x) for x in p]) for k, (v, p) in enumerate(zip(variance, parts, strict=True))], PARTS)


@query("decompose_ica")
def decompose_ica(spark, d):
    model = dc.independent_components(images(spark, d), 4, rounds=60)[None]
    return _parts(spark, model.variance, model.back)


@query("decompose_ica_scores")
def decompose_ica_scores(spark, d):
    frame = images(spark, d)
    return dc.transform(frame, dc.independent_components(frame, 4, rounds=60)[None])


@query("decompose_nnmf")
def decompose_nnmf(spark, d):
    """Each image's non-negative factor."""
    frame = positive(spark, d)
    return dc.encode(frame, dc.non_negative_factors(frame, 4, rounds=15))


@query("decompose_nnmf_parts")
def decompose_nnmf_parts(spark, d):
    parts = dc.non_negative_factors(positive(spark, d), 4, rounds=15).parts
    return _parts(spark, (parts**2).sum(axis=1), parts)


@query("decompose_dictionary")
def decompose_dictionary(spark, d):
    """Each image's sparse code."""
    frame = images(spark, d)
    return dc.encode(frame, dc.dictionary(frame, 6, penalty=0.05, rounds=15))


@query("decompose_fa")
def decompose_fa(spark, d):
    """Each image's expected factors."""
    frame = images(spark, d)
    return dc.transform(frame, dc.factor_analysis(frame, 3, rounds=30).as_model())


@query("reduce_components")
def reduce_components(spark, d):
    """fold, component, variance, loading: components that each training set has without the fold."""
    models = dc.components_by_fold(folded(spark, d), 5, "fold")
    rows = [(f, k, float(v), [float(x) for x in p]) for f, m in models.items() for k, (v, p) in enumerate(zip(m.variance, m.forward, strict=True))]
    return spark.createDataFrame(rows, "fold int, component int, variance double, loading array<double>")


for _method in ("pca", "ica"):

    def _reduced(spark, d, method=_method):
        return dc.reduced_ridge(folded(spark, d).filter("label IS NOT NULL"), "label", "fold", 4, method=method)

    query(f"reduce_{_method}_ridge")(_reduced)
