import math

import pytest
from pyspark.sql import functions as F

from fringe.operators import images
from fringe.operators.quantiles import exact_quantile


@pytest.mark.parametrize(("share", "parts", "few"), [(0.5, 1024, 10_000), (0.5, 3, 2), (0.0, 4, 3), (1.0, 4, 3), (0.9, 7, 5)])
def test_equals_sorting(spark, share, parts, few):
    rows = spark.range(3_000).selectExpr("id % 4 as a", "cast(id % 3 as string) as b", "case when id % 11 = 0 then null when id % 13 = 0 then double('nan') when id % 4 = 3 then 5.0d when id % 7 = 0 then exp(id % 600) else sin(id) end as x")
    got = {(r.a, r.b): r.q for r in exact_quantile(rows, ["a", "b"], "x", share, "q", parts, few).collect()}
    good = rows.where("x is not null and not isnan(x)").groupBy("a", "b").agg(F.array_sort(F.collect_list("x")).alias("v")).collect()
    assert got == {(r.a, r.b): r.v[max(1, math.ceil(len(r.v) * share)) - 1] for r in good}


def test_extremes(spark):
    rows = spark.createDataFrame([(1, float("inf")), (1, -float("inf")), (1, 0.0), (2, None), (3, 1.7e308), (3, -1.7e308), (3, 2.0)], "k int, x double")
    got = {r.k: r.quantile for r in exact_quantile(rows, ["k"], "x", parts=2, few=1).collect()}
    assert got == {1: 0.0, 3: 2.0}
    assert exact_quantile(rows.limit(0), ["k"], "x").count() == 0


def test_noise_of_many_images(spark):
    px = spark.range(2 * 5 * 40).selectExpr("id % 2 as image", "id div 2 % 5 as y", "id div 10 as x", "case when id % 17 = 3 then null else sin(id * id) end as value")
    both = {r.image: r for r in images.statistics(px, ("noise1", "noise5"), ["image"]).collect()}
    for image in (0, 1):
        one = images.statistics(px.where(F.col("image") == image), ("noise1", "noise5")).first()
        assert both[image][1:] == tuple(one)
    assert images.statistics(px.where("image = 0 and x < 1"), ("noise1",)).first().noise1 is None
