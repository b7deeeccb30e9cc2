"""Queries over the test tables, one or more for each operator, with the same in SQL.

Samples for gridding are made of ``lineitem``, events of ``events``, images and vectors of
``embeddings``. Sums of doubles are taken over whole multiples of a millionth, so that no result
depends on the order of a sum.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringe.functions import bits, masked_bits, nulls, sky, strings, vectors
from fringe.operators import checksum, gridding, groups, headers, histogram, images, intervals, ordered, quantiles, regions, rows
from fringe.sources import container, container_source, fits, fits_source, region_files
from fringe.streaming import blocks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
UNIT = 1e-6
GRID = gridding.Grid(size=256, cell=0.2 / 256, oversample=4, w_scale=0.2, planes=8)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(table(spark, sf_dir, "lineitem"))


def as_samples(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        ((F.col("l_extendedprice") - 50000.0) / 100.0).alias("uu"),
        ((F.col("l_quantity") - 25.0) * 20.0).alias("vv"),
        ((F.col("l_discount") - 0.05) * 4000.0).alias("ww"),
        F.col("l_tax").alias("re"),
        F.col("l_discount").alias("im"),
        F.lit(1.0).alias("weight"),
    )


def support(spark: SparkSession) -> DataFrame:
    return spark.range(GRID.planes).select(F.col("id").cast("int").alias("w"), (F.col("id") + 1).cast("int").alias("support"))


def kernel(spark: SparkSession) -> DataFrame:
    """A Gaussian, the same for all planes, with an imaginary part that grows with the plane."""
    reach = GRID.planes * GRID.oversample + GRID.oversample // 2 + 1
    cells = spark.range(GRID.planes * reach * reach)
    at = cells.select(F.floor(F.col("id") / (reach * reach)).cast("int").alias("w"), (F.floor(F.col("id") / reach) % reach).cast("int").alias("y"), (F.col("id") % reach).cast("int").alias("x"))
    return at.withColumns({"re": F.exp(-(F.col("x") * F.col("x") + F.col("y") * F.col("y")).cast("double") / 64.0), "im": F.col("w") * 0.1})


def supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.with_support(gridding.locate(samples(spark, sf_dir), GRID), support(spark), GRID)


_VIS = """
vis as (select (l_extendedprice - 50000.0e0) / 100.0e0 as uu, (l_quantity - 25.0e0) * 20.0e0 as vv, (l_discount - 0.05e0) * 4000.0e0 as ww, l_tax as re, l_discount as im, 1.0e0 as weight from lineitem),
pos as (select *, -uu * 0.2e0 as pu, vv * 0.2e0 as pv from vis),
loc as (select *, cast(round(pu) as int) + 128 as gu, cast(round(pv) as int) + 128 as gv, cast(round((round(pu) - pu) * 4) as int) as off_u, cast(round((round(pv) - pv) * 4) as int) as off_v,
  least(cast(round(sqrt(abs(ww * 0.2e0))) as int), 7) as w, case when ww > 0 then -1 else 1 end as sgn from pos),
sup as (select *, w + 1 as support, gu + (w + 1) < 256 and gu - (w + 1) >= 0 and gv + (w + 1) < 256 and gv - (w + 1) >= 0 as fits from loc)
"""
_CONTRIBUTIONS = f"""{_VIS},
cells as (select sup.*, j, k, abs(off_v + j * 4) as ky, abs(off_u + k * 4) as kx from sup, range(-8, 9) a(j), range(-8, 9) b(k) where fits and abs(j) <= support and abs(k) <= support),
parts as (select gv + j as v, gu + k as u, weight * re as vr, weight * im as vi, exp(-(kx * kx + ky * ky)::double / 64.0e0) as c, w * 0.1e0 * sgn as ci, weight from cells)
"""


@query(f"""with {_CONTRIBUTIONS} select cast(v as int) as v, cast(u as int) as u, cast(sum(cast(round((vr * c - vi * ci) * 1000000) as bigint)) as bigint) as re,
  cast(sum(cast(round((vi * c + vr * ci) * 1000000) as bigint)) as bigint) as im, count(*) as hits from parts group by v, u""")
def grid_wproj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all samples gridded, in millionths."""
    return gridding.grid_samples(samples(spark, sf_dir), kernel(spark), support(spark), GRID, unit=UNIT)


@query(ORACLES["grid_wproj"])
def grid_wproj_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by explode, broadcast join and aggregate."""
    return gridding.grid_samples(samples(spark, sf_dir), kernel(spark), support(spark), GRID, "join", UNIT)


@query(f"with {_CONTRIBUTIONS} select cast(sum(cast(round(weight * c * 1000000) as bigint)) as bigint) as norm from parts")
def grid_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.norm(samples(spark, sf_dir), kernel(spark), support(spark), GRID, UNIT)


@query(f"with {_VIS} select cast(sum(case when fits then 0 else 1 end) as bigint) as num_skipped, count(*) as num_samples from sup")
def grid_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.skipped(supported(spark, sf_dir), GRID)


@query(f"""with {_VIS} select min(gu - support) filter (fits) as u_min, min(gv - support) filter (fits) as v_min, max(gu + support) filter (fits) as u_max, max(gv + support) filter (fits) as v_max,
  cast(sum(case when fits then 0 else 1 end) as bigint) as num_skipped from sup""")
def grid_bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.bounding_box(supported(spark, sf_dir), GRID)


@query(f"with {_CONTRIBUTIONS} select cast(v as int) as v, cast(u as int) as u, count(*) as hits from parts group by v, u")
def grid_hit_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.hit_intensity(supported(spark, sf_dir), GRID)


@query(f"with {_VIS} select gv as v, gu as u, count(*) as hits from sup where fits group by 1, 2")
def grid_hit_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.hit_intensity(supported(spark, sf_dir), GRID, centre_only=True)


@query(f"with {_VIS} select gv, gu, sum(weight) as density from loc where gu between 0 and 255 and gv between 0 and 255 group by 1, 2")
def grid_weights_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.weights_density(samples(spark, sf_dir), GRID)


@query(f"""with {_VIS}, d as (select gv, gu, sum(weight) as density from loc where gu between 0 and 255 and gv between 0 and 255 group by 1, 2)
select loc.gv, loc.gu, round(weight / density, 9) as weight_out, count(*) as n from loc left join d on loc.gv = d.gv and loc.gu = d.gu group by 1, 2, 3""")
def grid_weights_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gridding.weights_uniform(samples(spark, sf_dir), GRID)
    return out.groupBy("gv", "gu", F.round("weight_out", 9).alias("weight_out")).agg(F.count("*").alias("n"))


_TILES = f"""{_VIS}, tiles as (select cast(tu as int) as pu, cast(tv as int) as pv from sup, range(-1, 9) a(tu), range(-1, 17) b(tv) where fits
  and tu between floor((gu - support) / 32.0e0) and ceil((gu + support + 1) / 32.0e0) - 1 and tv between floor((gv - support) / 16.0e0) and ceil((gv + support + 1) / 16.0e0) - 1)"""


@query(f"with {_TILES} select pu, pv, count(*) as n from tiles group by 1, 2")
def grid_tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.tile_counts(gridding.tiles(supported(spark, sf_dir), GRID))


@query(f"""with {_TILES}, c as (select pu, pv, count(*) as n from tiles group by 1, 2)
select pu, pv, n, cast(coalesce(sum(n) over (order by pv, pu rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from c""")
def grid_tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.exclusive_offsets(gridding.tile_counts(gridding.tiles(supported(spark, sf_dir), GRID)), ["pv", "pu"])


@query(f"with {_VIS}, c as (select w, count(*) as n from loc group by w) select w, n, cast(sum(n) over (order by w) as bigint) as upto from c")
def grid_plane_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.plane_histogram(gridding.locate(samples(spark, sf_dir), GRID))


@query(f"""with {_VIS}, h as (select gv as v, gu as u, count(*) as n from sup where fits group by 1, 2)
select cast(v as int) as v, cast(u as int) as u, case when v % 7 = 0 then 0.5e0 else 1.0e0 end as error from h where v % 7 = 0 or u % 11 = 0""")
def grid_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of both engines that differ once one grid's are doubled in some rows and missing in some columns."""
    centres = gridding.hit_intensity(supported(spark, sf_dir), GRID, centre_only=True)
    a = centres.select("v", "u", F.col("hits").cast("double").alias("re"), F.lit(0.0).alias("im"))
    b = a.where("u % 11 <> 0 or v % 7 = 0").withColumn("re", F.when(F.col("v") % 7 == 0, F.col("re") * 2).otherwise(F.col("re")))
    return gridding.compare_grids(a, b)


@query("select 0 as cells")
def grid_engines_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both engines in double precision: no cell differs."""
    args = (samples(spark, sf_dir), kernel(spark), support(spark), GRID)
    return gridding.compare_grids(gridding.grid_samples(*args), gridding.grid_samples(*args, engine="join")).agg(F.count("*").cast("int").alias("cells"))


@query("select l_orderkey, l_linenumber, round(l_quantity * (150e6 / 299792458.0e0), 9) as uu from lineitem")
def to_wavelengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("uu"))
    return gridding.to_wavelengths(rows_, 150e6, "uu").withColumn("uu", F.round("uu", 9))


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_suppkey < b.s_suppkey")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.baselines(table(spark, sf_dir, "supplier"), "s_suppkey")


# Order: running totals, differences, offsets, first row.


@query("select event_id, cast(sum(cast(round(value * 1000000) as bigint)) over (order by event_id) as bigint) as accum from events")
def accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.accumulate(table(spark, sf_dir, "events"), F.round(F.col("value") * 1000000).cast("long"), "event_id").select("event_id", "accum")


@query("select event_id, round(value - lag(value, 1, 0.0e0) over (order by event_id), 9) + 0.0e0 as seqdiff from events")
def seqdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.sequence_difference(table(spark, sf_dir, "events"), F.col("value"), "event_id")
    return out.select("event_id", (F.round("seqdiff", 9) + 0.0).alias("seqdiff"))


@query("select event_id, lag(value, 2) over (order by event_id) as before, lead(value, 3) over (order by event_id) as after from events")
def row_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "events").select("event_id", "value")
    out = ordered.row_offset(rows_, "value", -2, "event_id", "before")
    return ordered.row_offset(out, "value", 3, "event_id", "after").select("event_id", "before", "after")


@query("select event_id, row_number() over (order by event_id) as row from events")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.number_rows(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query("select event_id, value from events where value > 50 order by event_id limit 1")
def first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.first_row(table(spark, sf_dir, "events"), F.col("value") > 50, "event_id").select("event_id", "value")


# Rows and columns.


@query("select event_id, coalesce(value > 50 and event_type = 'click', false) as good from events")
def row_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.flag_rows(table(spark, sf_dir, "events"), (F.col("value") > 50) & (F.col("event_type") == "click")).select("event_id", "good")


@query("select event_id, value from events where value between 20 and 60 or user_id < 10")
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.select_rows(table(spark, sf_dir, "events"), nulls.in_range(F.col("value"), F.lit(20), F.lit(60)) | (F.col("user_id") < 10)).select("event_id", "value")


@query("select event_id from events where not (event_id between 10 and 20 or event_id between 30 and 35 or event_id = 50)")
def delete_row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.delete_rows(table(spark, sf_dir, "events"), "event_id", rows.row_ranges("10-20, 30-35, 50")).select("event_id")


@query("select event_id, case when event_id between 1 and 100 or event_id >= 500 then value * 2 else value end as value from events")
def calculator_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.calculate(table(spark, sf_dir, "events"), "value", F.col("value") * 2, "event_id", rows.row_ranges("1-100, 500-")).select("event_id", "value")


@query("select l_orderkey, l_quantity as quantity, l_extendedprice, l_discount + 0.0e0 as l_discount, l_extendedprice * (1 - l_discount) as net from lineitem")
def column_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rows.keep_columns(table(spark, sf_dir, "lineitem"), "L_ORDER*", "l_quantity", "l_extended?rice", "l_dis*", "l_tax")
    out = rows.calculate(rows.drop_columns(out, "*tax"), "net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.rename_columns(out, {"l_quantity": "quantity"}).withColumn("l_discount", F.col("l_discount") + 0.0)


@query("""with wide as (select epoch_ms(ts) // 3600000 as hour, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view from (
  select ts, event_type, max(value) as value from events where event_type in ('click', 'view') group by ts, event_type) group by 1)
select hour, last_value(click ignore nulls) over w as click, last_value(view ignore nulls) over w as view from wide window w as (order by hour rows unbounded preceding)""")
def housekeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = table(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3600000)).groupBy("hour", "event_type").agg(F.max("value").alias("value"))
    return rows.housekeeping(hourly, "hour", "event_type", "value", ["click", "view"])


@query("select l_orderkey, l_linenumber, nullif(l_quantity, 7) * 0.5e0 + 3 as scaled from lineitem")
def column_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rows.scale_column(F.col("l_quantity"), 0.5, 3.0, 7.0).alias("scaled"))


@query("select n_nationkey as key, n_name as name from nation union all select r_regionkey, r_name from region")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return rows.append_rows(n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), r.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


# Scalar functions.


@query("""select l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) as ratio, cast(trunc(cast(l_orderkey as double) / nullif(l_linenumber - 2, 0)) as bigint) as whole,
  l_orderkey % nullif(l_linenumber - 2, 0) as rest, cast(trunc(l_extendedprice) as bigint) as truncated from lineitem""")
def safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.col("l_linenumber") - 2
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        nulls.safe_div(F.col("l_extendedprice"), F.col("l_discount")).alias("ratio"),
        nulls.int_div(F.col("l_orderkey"), zero).alias("whole"),
        nulls.int_mod(F.col("l_orderkey"), zero.cast("long")).alias("rest"),
        nulls.to_int(F.col("l_extendedprice")).alias("truncated"),
    )


@query("""with a as (select event_id, value - 50 as x, (value - 50) / 25.0e0 as y from events) select event_id, floor(x + 0.5) as half_up, round(x) + 0.0e0 as half_away, round(case when abs(y) <= 1 then asin(y) end, 9) + 0.0e0 as arcsin,
  round(case when abs(y) <= 1 then acos(y) end, 9) as arccos, round(case when x > 0 then ln(x) end, 9) + 0.0e0 as log, round(case when x > 0 then log10(x) end, 9) + 0.0e0 as log10, round(case when x >= 0 then sqrt(x) end, 9) as sqrt from a""")
def domain_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    a = table(spark, sf_dir, "events").select("event_id", (F.col("value") - 50).alias("x"), ((F.col("value") - 50) / 25.0).alias("y"))
    r = lambda c: F.round(c, 9) + 0.0
    return a.select(
        "event_id", nulls.round_half_up(x).alias("half_up"), (nulls.round_half_away(x) + 0.0).alias("half_away"), r(nulls.arcsin(y)).alias("arcsin"), F.round(nulls.arccos(y), 9).alias("arccos"),
        r(nulls.log(x)).alias("log"), r(nulls.log10(x)).alias("log10"), F.round(nulls.sqrt(x), 9).alias("sqrt"),
    )


@query("""with a as (select event_id, value as x, radians(value) as r from events) select event_id, round(sin(r), 9) + 0.0e0 as sin, round(cos(r), 9) + 0.0e0 as cos, round(tan(r / 4), 9) + 0.0e0 as tan, round(atan(x), 9) + 0.0e0 as arctan,
  round(atan2(x - 50, x), 9) + 0.0e0 as arctan2, round(sinh(r), 6) + 0.0e0 as sinh, round(cosh(r), 6) as cosh, round(tanh(r), 9) + 0.0e0 as tanh, round(exp(-x / 10), 9) as exp, abs(x - 50) as abs, floor(x) as floor, ceil(x) as ceil, round(power(x / 10, 2), 9) as power from a""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, r = F.col("value"), F.radians("value")
    f = lambda c, n=9: F.round(c, n) + 0.0
    return table(spark, sf_dir, "events").select(
        "event_id", f(F.sin(r)).alias("sin"), f(F.cos(r)).alias("cos"), f(F.tan(r / 4)).alias("tan"), f(F.atan(x)).alias("arctan"), f(F.atan2(x - 50, x)).alias("arctan2"), f(F.sinh(r), 6).alias("sinh"), f(F.cosh(r), 6).alias("cosh"),
        f(F.tanh(r)).alias("tanh"), f(F.exp(-x / 10)).alias("exp"), F.abs(x - 50).alias("abs"), F.floor(x).cast("double").alias("floor"), F.ceil(x).cast("double").alias("ceil"), f(F.pow(x / 10, F.lit(2))).alias("power"),
    )


@query("""select event_id, abs(value - 50) < 5 as near, case when value > 50 then 'high' else 'low' end as side, abs(value - 10.5e0) < 1e-7 as about, least(value, nullif(cast(user_id as double), 3)) as least,
  greatest(value, nullif(cast(user_id as double), 3)) as greatest, nullif(user_id, 3) is null as missing, coalesce(nullif(user_id, 3), -1) as filled from events""")
def near_range_ifelse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, user = F.col("value"), F.nullif(F.col("user_id"), F.lit(3))
    return table(spark, sf_dir, "events").select(
        "event_id", nulls.near(x, F.lit(50), F.lit(5)).alias("near"), nulls.if_else(x > 50, F.lit("high"), F.lit("low")).alias("side"), nulls.approx_equal(x, F.lit(10.5)).alias("about"),
        nulls.least_of(x, user.cast("double")).alias("least"), nulls.greatest_of(x, user.cast("double")).alias("greatest"), user.isNull().alias("missing"), F.coalesce(user, F.lit(-1)).alias("filled"),
    )


@query("""select o_orderkey, substring(o_orderpriority, 3, 4) as part, cast(nullif(instr(o_orderpriority, 'E'), 0) as int) as place, o_orderstatus || '-' || o_orderpriority as joined, o_orderstatus < 'P' as before from orders""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.str_mid(p, 3, 4).alias("part"), strings.str_find(p, "E").alias("place"), F.concat("o_orderstatus", F.lit("-"), p).alias("joined"), (F.col("o_orderstatus") < "P").alias("before"))


@query("""select event_id, user_id & 12 as both, user_id | 3 as either, cast(bit_count(user_id) as int) as ones, xor(user_id, 5) & 13 = 0 as fits, ~user_id & 255 as inverse, (user_id << 3) | 5 as joined from events""")
def bit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    known = bits.literal("01x1")
    return table(spark, sf_dir, "events").select(
        "event_id", bits.both(u, F.lit(12)).alias("both"), bits.either(u, F.lit(3)).alias("either"), bits.count_ones(u).alias("ones"),
        (u.bitwiseXOR(F.lit(known[0])).bitwiseAND(F.lit(13)) == 0).alias("fits"), bits.inverse(u, 8).alias("inverse"), bits.join(u, F.lit(5).cast("long"), 3).alias("joined"),
    )


# Vectors.

_DOUBLES = "with a as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"


@query(f"""{_DOUBLES} select vec_id, round(list_sum(v), 6) + 0.0e0 as total, round(list_avg(v), 6) + 0.0e0 as average, list_min(v) as smallest, list_max(v) as largest, round(list_stddev_samp(v), 5) as stddev,
  list_sort(v)[(len(v) - 1) // 2 + 1] as median, cast(len(v) as int) as n, cast(len(list_filter(v, lambda x: x is not null)) as int) as n_valid, v[3] as third, v[65] as beyond from a""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = F.col("v")
    return a.select(
        "vec_id", (F.round(vectors.total(v), 6) + 0.0).alias("total"), (F.round(vectors.average(v), 6) + 0.0).alias("average"), vectors.smallest(v).alias("smallest"), vectors.largest(v).alias("largest"), F.round(vectors.stddev(v), 5).alias("stddev"),
        vectors.median(v).alias("median"), vectors.n_elements(v).alias("n"), vectors.n_valid(v).alias("n_valid"), vectors.element(v, 3).alias("third"), vectors.element(v, 65).alias("beyond"),
    )


@query(f"{_DOUBLES} select vec_id, v[1 + (3 - 1) + 8 * (2 - 1) - 0] as cell, round(list_sum(list_transform(v, lambda x: x * 2 + 1)), 6) as mapped from a")
def vector_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as a block of 8 by 8 and as an operand beside a scalar."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return a.select("vec_id", vectors.element(F.col("v"), 3, 2, dims=(8, 8)).alias("cell"), F.round(vectors.total(F.transform("v", lambda x: x * 2 + 1)), 6).alias("mapped"))


# Histograms.


@query("select cast(floor((value - 0) / 10) as bigint) as bin_1, cast(count(*) as bigint) as total, count(*) as n from events where value >= 0 and value < 100 group by 1")
def histogram_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.histogram(table(spark, sf_dir, "events"), [histogram.Axis("value", 0, 100, 10)])


@query("""select cast(floor(l_quantity - 0.5e0) as bigint) as bin_1, cast(floor((l_discount - 0.0e0) / 0.02e0) as bigint) as bin_2, cast(sum(cast(trunc(l_extendedprice) as bigint)) as bigint) as total, count(*) as n from lineitem
  where l_quantity >= 0.5 and l_quantity <= 50.5 and l_discount >= 0 and l_discount < 0.1 and l_returnflag <> 'N' group by 1, 2""")
def histogram_2d_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [histogram.Axis("l_quantity", 1, 50, 1, integer=True), histogram.Axis("l_discount", 0.0, 0.1, 0.02)]
    return histogram.histogram(table(spark, sf_dir, "lineitem"), axes, F.col("l_extendedprice"), where=F.col("l_returnflag") != "N", cast="bigint")


@query("""select cast(l_linenumber - 1 as bigint) as bin_1, cast(floor((l_quantity - 0.5e0) / 10) as bigint) as bin_2, cast(floor((l_tax - 0.0e0) / 0.05e0) as bigint) as bin_3, round(sum(1.0e0 / l_quantity), 6) as total, count(*) as n
  from lineitem where l_tax < 0.1 and l_quantity >= 0.5 and floor((l_quantity - 0.5e0) / 10) < 5 group by 1, 2, 3""")
def histogram_3d_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [histogram.Axis("l_linenumber", 1, 7, 1, integer=True), histogram.Axis("l_quantity", 1, 50, 10, integer=True), histogram.Axis("l_tax", 0.0, 0.1, 0.05)]
    return histogram.histogram(table(spark, sf_dir, "lineitem"), axes, F.col("l_quantity"), reciprocal=True).withColumn("total", F.round("total", 6))


# Intervals and regions.

_GTI = "select n_nationkey, n_nationkey * 4.0e0 as start, n_nationkey * 4.0e0 + 1.5e0 as stop from nation"


def _gti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4.0).alias("start"), (F.col("n_nationkey") * 4.0 + 1.5).alias("stop"))


@query(f"select event_id, value from events where exists (select 1 from ({_GTI}) where value between start and stop)")
def gti_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.in_intervals(table(spark, sf_dir, "events"), _gti(spark, sf_dir), F.col("value")).select("event_id", "value")


@query(f"select event_id, value from events where not exists (select 1 from ({_GTI}) where value between start + 0.25e0 and stop + 0.25e0)")
def gti_filter_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.in_intervals(table(spark, sf_dir, "events"), _gti(spark, sf_dir), F.col("value"), shift=0.25, inside=False).select("event_id", "value")


@query("""with a as (select p_partkey, p_size as x, p_retailprice / 40.0e0 as y from part) select p_partkey, (x - 25) * (x - 25) + (y - 35) * (y - 35) <= 225 as circle,
  abs((x - 25) * cos(radians(30)) + (y - 35) * sin(radians(30))) <= 10 and abs((y - 35) * cos(radians(30)) - (x - 25) * sin(radians(30))) <= 5 as box,
  power(((x - 25) * cos(radians(20)) + (y - 35) * sin(radians(20))) / 20, 2) + power(((y - 35) * cos(radians(20)) - (x - 25) * sin(radians(20))) / 8, 2) <= 1 as ellipse,
  (x - 25) * (x - 25) + (y - 35) * (y - 35) between 25 and 225 as annulus, abs(2 * (x - 25.0e0) / 30) + abs(2 * (y - 35) / 20) <= 1 as diamond, abs(x - 25) <= 10 and abs(y - 35) <= 6 as rectangle from a""")
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40.0).alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.select(
        "p_partkey", regions.circle(x, y, 25, 35, 15).alias("circle"), regions.box(x, y, 25, 35, 20, 10, 30).alias("box"), regions.ellipse(x, y, 25, 35, 20, 8, 20).alias("ellipse"), regions.annulus(x, y, 25, 35, 5, 15).alias("annulus"),
        regions.diamond(x, y, 25, 35, 30, 20).alias("diamond"), regions.rectangle(x, y, 15, 29, 35, 41).alias("rectangle"),
    )


@query("""with a as (select p_partkey, p_size as x, p_retailprice / 40.0e0 as y from part) select p_partkey from a
  where ((x - 25) * (x - 25) + (y - 35) * (y - 35) <= 225 and not ((x - 25) * (x - 25) + (y - 35) * (y - 35) <= 25)) or (abs(x - 5) <= 4 and abs(y - 30) <= 8)""")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = [regions.Shape("circle", (25, 35, 15)), regions.Shape("circle", (25, 35, 5), include=False), regions.Shape("box", (5, 30, 8, 16), component=2)]
    a = table(spark, sf_dir, "part")
    return rows.select_rows(a, regions.inside(F.col("p_size").cast("double"), F.col("p_retailprice") / 40.0, shapes)).select("p_partkey")


@query("select p_partkey from part where p_size between 10 and 20 and not (p_size between 14 and 15)")
def region_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter by a table of shapes."""
    table_ = spark.createDataFrame([(2, "!Box", [14.5, 0.0, 1.0, 1e9], True, None), (1, "box", [15.0, 0.0, 10.0, 1e9], True, 1)], "n int, shape string, parameters array<double>, include boolean, component int")
    return regions.in_region(table(spark, sf_dir, "part"), table_, F.col("p_size").cast("double"), F.col("p_retailprice")).select("p_partkey")


@query("""with a as (select p_partkey, p_size * 7.0e0 as ra1, p_size - 25.0e0 as dec1, p_retailprice / 10.0e0 as ra2, p_retailprice / 100.0e0 as dec2 from part),
b as (select *, sin(radians(dec2 - dec1) / 2) as sd, sin(radians(ra2 - ra1) / 2) as sr from a), c as (select *, greatest(0, least(1, sd * sd + cos(radians(dec1)) * cos(radians(dec2)) * sr * sr)) as h from b)
select p_partkey, round(degrees(2 * atan2(sqrt(h), sqrt(1 - h))), 6) as angle from c""")
def angular_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sky.angular_separation(size * 7.0, size - 25.0, price / 10.0, price / 100.0), 6).alias("angle"))


def _wcs_oracle() -> str:
    """Every projection returns the pixel that it was given."""
    kinds = " union all ".join(f"select '{k}' as kind" for k in sky.PROJECTIONS)
    return f"select kind, count(*) as n, count(*) as back from part, ({kinds}) group by kind"


@query(_wcs_oracle())
def wcs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to the sky and back, in all projections: how many return."""
    a = table(spark, sf_dir, "part").select((F.col("p_size") - 25.0).alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    out = None
    for kind in sky.PROJECTIONS:
        p = sky.Projection(120.0, 40.0, 1.5, -2.5, -0.1, 0.1, 15.0, kind)
        ra, dec = p.to_sky(F.col("x"), F.col("y"))
        x, y = p.to_pixel(F.col("ra"), F.col("dec"))
        back = F.sum(F.when((F.abs(x - F.col("x")) < 1e-5) & (F.abs(y - F.col("y")) < 1e-5), 1).otherwise(0))
        one = a.withColumns({"ra": ra, "dec": dec}).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), back.alias("back"))
        out = one if out is None else out.unionByName(one)
    return out


# Images, groups, headers, checksums.

_PIXELS = "(select vec_id as y, cast(x as int) as x, cast(embedding[x] as double) as value from embeddings, range(1, 65) g(x))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.posexplode("embedding").alias("at", "value")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), at).select("y", (F.col("at") + 1).alias("x"), F.col("value").cast("double").alias("value"))


@query(f"select cast((y - 10) // 5 as int) + 1 as y, 10 - cast((x - 3) // 3 as int) + 1 as x, value from {_PIXELS} where y between 10 and 200 and (y - 10) % 5 = 0 and x between 3 and 33 and (x - 3) % 3 = 0")
def image_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.section(_pixels(spark, sf_dir), y=images.Span(10, 200, 5), x=images.Span(3, 33, 3, flip=True))


@query(f"select a.y, a.x, a.value + 2 * b.value as value from {_PIXELS} a join (select y, cast(65 - x as int) as x, value from {_PIXELS}) b on a.y = b.y and a.x = b.x")
def image_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _pixels(spark, sf_dir)
    flipped = images.section(_pixels(spark, sf_dir), x=images.Span(1, 64, 1, flip=True))
    return images.combine({"a": a, "b": flipped}, ["y", "x"], F.col("a") + 2 * F.col("b"))


def _noise_sql(name: str, scale: str, difference: str) -> str:
    return f"""{name}_d as (select y, abs({difference}) as d from p window w as (partition by y order by x)), {name}_l as (select y, quantile_disc(d, 0.5) as m from {name}_d where d is not null group by y),
{name} as (select round(quantile_disc(m, 0.5) * 1.4826e0 / sqrt({scale}), 9) as {name} from {name}_l)"""


@query(f"""with p as {_PIXELS}, {_noise_sql("noise1", "2", "value - lead(value, 1) over w")}, {_noise_sql("noise2", "2", "value - lead(value, 2) over w")}, {_noise_sql("noise3", "6", "2 * value - lag(value, 2) over w - lead(value, 2) over w")},
{_noise_sql("noise5", "70", "6 * value - 4 * lag(value, 2) over w - 4 * lead(value, 2) over w + lag(value, 4) over w + lead(value, 4) over w")}
select (select count(value) from p) as n_good, (select min(value) from p) as low, (select max(value) from p) as high, round((select avg(value) from p), 9) + 0.0e0 as mean, round((select stddev_pop(value) from p), 9) as sigma, noise1, noise2, noise3, noise5
from noise1, noise2, noise3, noise5""")
def image_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = tuple(images.DIFFERENCES)
    out = images.statistics(_pixels(spark, sf_dir), kinds)
    return out.withColumns({"mean": F.round("mean", 9) + 0.0, "sigma": F.round("sigma", 9), **{k: F.round(k, 9) for k in kinds}})


@query(f"""with p as (select y % 7 as image, y, x, value from {_PIXELS}), d as (select image, y, abs(2 * value - lag(value, 2) over w - lead(value, 2) over w) as d from p window w as (partition by image, y order by x)),
l as (select image, y, quantile_disc(d, 0.5) as m from d where d is not null group by 1, 2), n as (select image, quantile_disc(m, 0.5) * 1.4826e0 / sqrt(6) as noise3 from l group by 1)
select p.image, count(value) as n_good, min(value) as low, max(value) as high, round(avg(value), 9) + 0.0e0 as mean, round(stddev_pop(value), 9) as sigma, round(any_value(noise3), 9) as noise3 from p join n on p.image = n.image group by 1""")
def image_statistics_by_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and noise of seven images at once."""
    out = images.statistics(_pixels(spark, sf_dir).withColumn("image", F.col("y") % 7), ("noise3",), ["image"])
    return out.withColumns({"mean": F.round("mean", 9) + 0.0, "sigma": F.round("sigma", 9), "noise3": F.round("noise3", 9)})


@query("select l_returnflag, l_linestatus, quantile_disc(l_extendedprice, 0.9) as q90 from lineitem group by 1, 2")
def quantile_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of large groups: narrowed in passes, with few values sorted at the end."""
    return quantiles.exact_quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", 0.9, "q90", few=1_000)


@query("select vec_id, list_transform(embedding, lambda x: cast(x as double)) as cell from embeddings")
def image_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to pixels and back."""
    rows_ = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("cell"))
    return images.pixels_to_cells(images.cells_to_pixels(rows_, "cell", 8, ["vec_id"]), ["vec_id"])


@query(f"select y, x, cast(floor(value / 0.01e0 + 0.5) as int) as stored, round(floor(value / 0.01e0 + 0.5) * 0.01e0, 9) + 0.0e0 as restored from {_PIXELS}")
def image_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("stored", images.quantize(F.col("value"), 0.01))
    return p.select("y", "x", "stored", (F.round(images.restore(F.col("stored"), 0.01), 9) + 0.0).alias("restored"))


_EDGES = "select n_regionkey + 100 as group_id, n_nationkey as member_id from nation union all select 999, r_regionkey + 100 from region union all select 101, 999"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 100).alias("group_id"), F.col("n_nationkey").alias("member_id"))
    r = table(spark, sf_dir, "region").select(F.lit(999).alias("group_id"), (F.col("r_regionkey") + 100).alias("member_id"))
    return n.unionByName(r).unionByName(spark.createDataFrame([(101, 999)], "group_id int, member_id int"))


@query(f"""with recursive e as ({_EDGES}), r(group_id, member_id, depth) as (select group_id, member_id, 1 from e union select r.group_id, e.member_id, r.depth + 1 from r join e on r.member_id = e.group_id where r.depth < 8)
select group_id, member_id, min(depth) as depth from r group by 1, 2""")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy with a cycle: region 101 holds the top again."""
    return groups.reachable(_edges(spark, sf_dir))


@query(f"select group_id, count(distinct member_id) as n_members from ({_EDGES}) group by 1")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.count_members(_edges(spark, sf_dir))


@query("""select 'TFORM' || n_nationkey as key, case when n_nationkey % 5 = 0 then 'new' else n_name end as value, 'structural' as class from nation union all select 'OBJECT', 'x', 'user'""")
def header_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    header = n.select((F.col("n_nationkey") + 1).alias("pos"), F.concat(F.lit("TFORM"), "n_nationkey").alias("key"), F.col("n_name").alias("value"), F.lit("").alias("comment"))
    changes = header.where("pos % 5 = 1").select("key", F.lit("new").alias("value"), "comment").unionByName(spark.createDataFrame([("OBJECT", "x", "")], "key string, value string, comment string"))
    return headers.upsert(header, changes).select("key", "value", headers.keyword_class(F.col("key")).alias("class"))


def _checksum_oracle() -> str:
    word = " + ".join(f"coalesce(ascii(nullif(substr(t, 4 * i + {k}, 1), '')), 0) * {256 ** (4 - k)}" for k in range(1, 5))
    total = f"select sum({word})::hugeint as s from (select n_name as t from nation), range(0, 10) g(i) where 4 * i < length(t)"
    return f"with a as ({total}), b as (select s % 4294967296 + s // 4294967296 as s from a) select cast(s % 4294967296 + s // 4294967296 as bigint) as checksum from b"


@query(_checksum_oracle())
def block_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum.checksum(table(spark, sf_dir, "nation").select(F.col("n_name").cast("binary").alias("data")))


# Streams and sources.


def _stream_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; only a local session without one takes its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='fringe-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(ORACLES["grid_wproj"])
def streaming_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over a stream of the table's files: the state is the grid, a row for each cell."""
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/lineitem.parquet*")
    grid = blocks.streaming_grid(as_samples(stream), kernel(spark), support(spark), GRID, UNIT)
    path = _stream_path(spark, "grid")
    blocks.run_to_files(grid, path, ["v", "u"]).awaitTermination()
    return blocks.latest(spark, path, grid.schema, ["v", "u"])


@query("select date_trunc('hour', ts) as start, cast(floor(value / 10) as bigint) as bin, count(*) as n from events group by 1, 2")
def streaming_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts by hour and bin over a stream of the table's files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = blocks.windowed_histogram(stream, "ts", "1 hour", "400 days", F.floor(F.col("value") / 10))
    flat = counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "bin", "n")
    path = _stream_path(spark, "windows")
    blocks.run_to_files(flat, path, ["start", "bin"]).awaitTermination()
    return blocks.latest(spark, path, flat.schema, ["start", "bin"])


@query("select n_regionkey as group_id, n_nationkey as user_index, cast(length(n_name) + 1 as bigint) as size, true as crc_ok, n_name as text from nation")
def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each nation, written to containers by all tasks at once, read by byte ranges and checked."""
    container_source.register(spark)
    path = _stream_path(spark, "containers")
    chunks = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("int").alias("group_id"), F.lit(7).alias("tag_id"), F.col("n_nationkey").cast("int").alias("user_index"), F.lit(container.CHAR).alias("data_type"),
        F.concat(F.col("n_name").cast("binary"), F.lit(b"\0")).alias("payload"),
    )
    chunks.repartition(3).write.format("container").option("max_bytes", 512).mode("append").save(path)
    out = spark.read.format("container").option("split_bytes", 200).load(path)
    return out.select("group_id", "user_index", "size", "crc_ok", F.expr("substring(cast(payload as string), 1, size - 1)").alias("text"))


@query(ORACLES["grid_wproj"])
def grid_from_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship from visibility blocks: samples written as blocks of containers and read back, some times at a time."""
    container_source.register(spark)
    path = _stream_path(spark, "blocks")
    _as_blocks(samples(spark, sf_dir).select("uu", "vv", "ww", "re", "im")).write.format("container").option("max_bytes", 1 << 20).mode("append").save(path)
    read = spark.read.format("visibility_blocks").option("split_bytes", 1 << 19).load(path)
    return gridding.grid_samples(read.where("problem is null").withColumn("weight", F.lit(1.0)), kernel(spark), support(spark), GRID, unit=UNIT)


def _as_blocks(rows_: DataFrame, baselines: int = 16) -> DataFrame:
    """Chunks of blocks of samples, one block or two for each batch of rows: whole times of ``baselines`` samples, and what is left as times of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 16
        for batch in batches:
            c = {name: batch.column(name).to_numpy() for name in batch.schema.names}
            whole = batch.num_rows // baselines * baselines
            for first, n, width in ((0, whole, baselines), (whole, batch.num_rows - whole, 1)):
                if not n:
                    continue
                part = slice(first, first + n)
                amplitudes = (c["re"][part] + 1j * c["im"][part]).astype("<c16")
                dims = np.array([0, 0, n // width, 1, width, 2], "<i4")
                rows = [(1, container.INT, dims), (3, container.DOUBLE | container.COMPLEX, amplitudes), *((4 + i, container.DOUBLE, c[name][part].astype("<f8")) for i, name in enumerate(("uu", "vv", "ww")))]
                yield pa.RecordBatch.from_pylist([{"group_id": 12, "tag_id": tag, "user_index": block, "data_type": kind, "payload": x.tobytes()} for tag, kind, x in rows], _CHUNKS)
                block += 1

    return rows_.mapInArrow(run, "group_id int, tag_id int, user_index int, data_type int, payload binary")


_CHUNKS = pa.schema([("group_id", pa.int32()), ("tag_id", pa.int32()), ("user_index", pa.int32()), ("data_type", pa.int32()), ("payload", pa.binary())])


@query(f"select y, x, value from {_PIXELS}")
def fits_image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image of one line for each vector, encoded and read."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            yield pd.DataFrame({"path": rows_["vec_id"].astype(str), "content": [fits.encode_image(np.asarray(v, "float32")[None, :]) for v in rows_["embedding"]]})

    files = table(spark, sf_dir, "embeddings").mapInPandas(encode, "path string, content binary")
    return fits.image_of(files).select(F.col("path").cast("long").alias("y"), "x", "value")


@query("select p_partkey, p_name, p_size, p_retailprice, p_size > 25 as large from part")
def fits_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary tables of bounded size, written by all tasks at once and read by byte ranges."""
    fits_source.register(spark)
    path = _stream_path(spark, "tables")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"))
    parts.repartition(4).write.format("fits_table").option("max_bytes", 1 << 16).mode("append").save(path)
    return spark.read.format("fits_table").option("split_bytes", 1 << 15).load(path).where("_problem is null").drop("_row", "_problem")


@query("select p_partkey, p_retailprice from part where p_partkey between 200 and 700")
def fits_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of some rows of a table: other rows aren't read."""
    fits_source.register(spark)
    path = _stream_path(spark, "rows")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").repartitionByRange(2, "p_partkey").sortWithinPartitions("p_partkey")
    parts.write.format("fits_table").mode("append").save(path)
    rows_ = spark.read.format("fits_table").options(columns="p_partkey,p_retailprice").load(path)
    return rows_.where("p_partkey between 200 and 700").select("p_partkey", "p_retailprice")


# Further cases of the operators above.


@query("select l_orderkey, l_linenumber, (9007199254740993 + l_orderkey) // l_linenumber as whole, -(9007199254740993 + l_orderkey) // 1 as negative, cast(l_linenumber * l_linenumber * l_linenumber as bigint) as cube from lineitem")
def integer_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers above 2^53 stay exact."""
    large = F.lit(9007199254740993) + F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", nulls.int_div(large, F.col("l_linenumber")).alias("whole"), nulls.int_div(-large, F.lit(1)).alias("negative"), nulls.int_power(F.col("l_linenumber"), F.lit(3)).alias("cube")
    )


@query(f"""with e as (select event_id, value as row_time, user_id as row_bucket, event_id * 2 as part from events),
f as (select *, cast(sum(row_bucket) over (order by event_id) as bigint) as tie from e) select * from f where exists (select 1 from ({_GTI}) where row_time between start and stop)""")
def clashing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose columns bear the names that the operators use inside stay whole."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("row_time"), F.col("user_id").alias("row_bucket"), (F.col("event_id") * 2).alias("part"))
    return intervals.in_intervals(ordered.accumulate(e, F.col("row_bucket"), "event_id", "tie"), _gti(spark, sf_dir), F.col("row_time"))


@query(f"{_DOUBLES}, b as (select vec_id, generate_subscripts(v, 1) as k, unnest(v) as x from a), c as (select vec_id, k, sum(cast(round(x * 1000000) as bigint)) over (order by vec_id, k) as upto from b) select vec_id, list(cast(upto as double) order by k) as accum from c group by vec_id")
def accum_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running sum over all elements of all rows, in millionths."""
    a = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ordered.accumulate_vectors(a, F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000)), "vec_id").select("vec_id", "accum")


@query("select n_regionkey as group_id, n_nationkey as user_index, n_name as text from nation where n_nationkey % 3 = 0")
def container_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks looked up by extended names and index in big-endian and in other files; no row for a name that isn't there."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            content = [container.encode([(0, 1, 0, container.CHAR, b"x"), ("names", "nation", int(k), container.CHAR, n.encode())], big_endian=k % 2 == 0) for k, n in zip(rows_["n_nationkey"], rows_["n_name"], strict=True)]
            yield pd.DataFrame({"path": rows_["n_regionkey"].astype(str), "content": content})

    index = container.chunks_of(table(spark, sf_dir, "nation").mapInPandas(encode, "path string, content binary"))
    wanted = spark.createDataFrame([("names", "nation", key) for key in [*range(0, 25, 3), 99]], "group_name string, tag_name string, user_index int")
    return container.find_each(index, wanted).select(F.col("path").cast("int").alias("group_id"), "user_index", F.col("payload").cast("string").alias("text"))


@query("select c_nationkey as nation, count(*) as n, cast(sum(c_custkey) as double) as total, max(c_custkey)::double as last from customer group by 1")
def container_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles of containers in both byte orders, a file of up to 500 customers of a nation each, as typed arrays."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            payload = [np.array(keys, "<f8").tobytes() for keys in rows_["keys"]]
            yield pd.DataFrame({"path": rows_["c_nationkey"].astype(str), "content": [container.encode([(1, 2, 0, container.DOUBLE, x)], big_endian=len(x) % 16 == 0) for x in payload]})

    blocks_ = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 500).alias("block")).agg(F.collect_list("c_custkey").alias("keys"))
    chunks = container.chunks_of(blocks_.select("c_nationkey", "keys").mapInPandas(encode, "path string, content binary")).where("crc_ok")
    v = chunks.select(F.col("path").cast("int").alias("nation"), F.explode(container.values(F.col("payload"), container.DOUBLE)).alias("x"))
    return v.groupBy("nation").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.max("x").alias("last"))


@query("""with a as (select p_partkey, p_size::double as x, p_retailprice / 40.0e0 as y from part), b as (select *, x - 25 as dx, y - 35 as dy, fmod(degrees(atan2(y - 35, x - 25)) + 360, 360) as turn, power((x - 25) / 8, 2) + power((y - 35) / 4, 2) as e1, power((x - 25) / 20, 2) + power((y - 35) / 9, 2) as e2 from a)
select p_partkey, turn between 20 and 130 as sector, turn >= 300 or turn <= 40 as pie_over_zero, e1 >= 1 and e2 <= 1 as elliptannulus, abs(dx) <= 15 and abs(dy) <= 8 and not (abs(dx) <= 5 and abs(dy) <= 3) as boxannulus,
  turn between 20 and 130 and dx * dx + dy * dy between 16 and 144 as panda, abs(x - 20) < 0.5 and abs(y - 30) < 0.5 as point, x between 10 and 40 and abs(y - 30) < 0.5 or (x >= 9.5 and x <= 40.5 and abs(y - 30) < 0.5) as line,
  y >= 20 and y < 40 and x < 5 + (y - 20) * 2 and x >= 5 as polygon from b""")
def region_more_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40.0).alias("y"))
    x, y = F.col("x"), F.col("y")
    return a.select(
        "p_partkey", regions.sector(x, y, 25, 35, 20, 130).alias("sector"), regions.sector(x, y, 25, 35, 300, 40).alias("pie_over_zero"), regions.elliptannulus(x, y, 25, 35, 8, 4, 20, 9).alias("elliptannulus"),
        regions.boxannulus(x, y, 25, 35, 10, 6, 30, 16).alias("boxannulus"), regions.panda(x, y, 25, 35, 20, 130, 4, 12).alias("panda"), regions.point(x, y, 20, 30).alias("point"), regions.line(x, y, 10, 30, 40, 30).alias("line"),
        regions.polygon(x, y, 5, 20, 5, 40, 45, 40).alias("polygon"),
    )


_REGION_SHAPES = """select o_orderkey as n, o_orderkey % 4 as kind, (o_custkey % 500) * 1.0e0 as cx, (o_orderkey % 390) * 2.5e0 as cy, 1 + (o_custkey % 7) * 0.5e0 as r, o_orderkey % 5 <> 0 as include, 1 + o_orderkey % 3 as component from orders"""


_REGION_TEXTS = """select n, kind, cx, cy, r, include, (n % 2) * 2 + case when n >= min(case when include then n end) over (partition by n % 2) then 1 else 0 end as component from (select *, o_orderkey as n, o_orderkey % 4 as kind, (o_custkey % 500) * 1.0e0 as cx, (o_orderkey % 390) * 2.5e0 as cy, 1 + (o_custkey % 7) * 0.5e0 as r, o_orderkey % 5 <> 3 as include from orders)"""


def _in_region_sql(shapes: str) -> str:
    """The parts in a region, by all pairs of parts and shapes."""
    return f"""with s as ({shapes}), p as (select distinct p_partkey, (p_partkey * 7 % 500) + p_size / 100.0e0 as x, p_retailprice / 2.0e0 as y from part),
h as (select p_partkey, component, arg_max(include, n) as held from p join s on case kind when 0 then (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r when 1 then abs(x - cx) <= r and abs(y - cy) <= r / 2
  when 2 then (x - cx) * (x - cx) / (r * r) + (y - cy) * (y - cy) / (4 * r * r) <= 1 else abs(2 * (x - cx) / (2 * r)) + abs(2 * (y - cy) / (3 * r)) <= 1 end group by 1, 2),
o as (select component from s group by component having not arg_min(include, n)),
v as (select p_partkey, bool_or(held) or count(*) filter (component in (select component from o)) < (select count(*) from o) as inside from h group by 1)
select p_partkey from p left join v using (p_partkey) where coalesce(inside, (select count(*) from o) > 0)"""


def _order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("o_orderkey"), F.col("o_orderkey") % 4
    cx, cy, r = (F.col("o_custkey") % 500) * 1.0, (n % 390) * 2.5, 1 + (F.col("o_custkey") % 7) * 0.5
    sizes = F.when(kind == 0, F.array(r)).when(kind == 1, F.array(2 * r, r)).when(kind == 2, F.array(r, 2 * r)).otherwise(F.array(2 * r, 3 * r))
    return table(spark, sf_dir, "orders").select(
        n.alias("n"), F.element_at(F.array(*map(F.lit, ("circle", "box", "ellipse", "diamond"))), (kind + 1).cast("int")).alias("shape"), F.concat(F.array(cx, cy), sizes).alias("parameters"),
        (n % 5 != 0).alias("include"), (1 + n % 3).alias("component"),
    )


def _region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * 7 % 500) + F.col("p_size") / 100.0).alias("x"), (F.col("p_retailprice") / 2.0).alias("y"))


@query(_in_region_sql(_REGION_SHAPES))
def region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in a region of as many shapes as there are orders, in three components, of which some begin with an exclusion."""
    return regions.in_region(_region_points(spark, sf_dir), _order_shapes(spark, sf_dir), F.col("x"), F.col("y")).select("p_partkey")


@query(_in_region_sql(_REGION_TEXTS))
def region_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the region that two texts describe together, with a shape for each order."""
    sign, numbers = F.when(F.col("include"), F.when(F.col("n") % 3 == 0, "+").otherwise("")).otherwise(" -"), F.array_join(F.transform("parameters", lambda v: v.cast("string")), ", ")
    text = F.concat(F.when(F.col("n") % 7 == 0, "image;").otherwise(""), sign, F.initcap("shape"), F.lit("("), numbers, F.lit(") # color=red"))
    shapes = _order_shapes(spark, sf_dir).withColumn("include", F.col("n") % 5 != 3)
    lines = shapes.select((F.col("n") % 2).cast("string").alias("path"), F.col("n").alias("line"), text.alias("value"))
    return regions.in_region(_region_points(spark, sf_dir), region_files.shapes_of_lines(lines), F.col("x"), F.col("y")).select("p_partkey")


_SKY_POINTS = "select p_partkey, (p_size - 25.0e0) as x, p_retailprice / 100.0e0 as y from part"


@query(f"""with a as ({_SKY_POINTS}), b as (select p_partkey, radians((x - 1.5e0) * -0.1e0) as el, radians((y + 2.5e0) * 0.1e0) as em, radians(40.0e0) as d0 from a),
c as (select *, sqrt(1 + el * el + em * em) as r, sqrt(1 - el * el - em * em) as z from b),
d as (select p_partkey, el, em, el / r as tx, (cos(d0) - em * sin(d0)) / r as ty, (sin(d0) + em * cos(d0)) / r as tz, z * cos(d0) - em * sin(d0) as sy, z * sin(d0) + em * cos(d0) as sz from c)
select p_partkey, round(fmod(degrees(atan2(tx, ty)) + 480, 360), 8) as tan_ra, round(degrees(asin(tz)), 8) as tan_dec, round(fmod(degrees(atan2(el, sy)) + 480, 360), 8) as sin_ra, round(degrees(asin(sz)), 8) as sin_dec,
  round(fmod(degrees(el) + 480, 360), 8) as car_ra, round(40 + degrees(em), 8) as car_dec from d""")
def wcs_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky positions by three projections, in SQL by unit vectors: an error made in both directions shows."""
    a = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    names = []
    for kind in ("TAN", "SIN", "CAR"):
        ra, dec = sky.Projection(120.0, 40.0, 1.5, -2.5, -0.1, 0.1, 0.0, kind).to_sky(F.col("x"), F.col("y"))
        names += [F.round(ra, 8).alias(f"{kind.lower()}_ra"), F.round(dec, 8).alias(f"{kind.lower()}_dec")]
    return a.select("p_partkey", *names)


@query("with k as (select w, y, x from range(8) a(w), range(35) b(y), range(35) c(x)) select cast(w as int) as w, count(*) as n, cast(max(x) as int) as reach from k where y <= (w + 1) * 4 + 2 and x <= (w + 1) * 4 + 2 group by w")
def kernel_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridding.compact_kernel(kernel(spark), support(spark), GRID.oversample).groupBy("w").agg(F.count("*").alias("n"), F.max("x").alias("reach"))


@query(f"with {_TILES} select pu, pv, count(*) as n, 1 as runs from tiles group by 1, 2")
def grid_bucket_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples gathered by tile: within a partition each tile is one run of rows."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # of the batch before
        for rows_ in batches:
            pairs = rows_[["pu", "pv"]]
            if not len(pairs):
                continue
            starts = (pairs != pairs.shift()).any(axis=1).astype("int64")
            starts.iloc[0] = int(tuple(pairs.iloc[0]) != last)
            last = tuple(pairs.iloc[-1])
            yield pairs.assign(runs=starts, n=1).groupby(["pu", "pv"], as_index=False).agg(n=("n", "sum"), runs=("runs", "sum"))

    sorted_ = gridding.bucket_by_tile(gridding.tiles(supported(spark, sf_dir), GRID)).select("pu", "pv").mapInPandas(runs, "pu int, pv int, n long, runs long")
    by_task = sorted_.withColumn("task", F.spark_partition_id()).groupBy("pu", "pv", "task").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    return by_task.groupBy("pu", "pv").agg(F.sum("n").alias("n"), F.max("runs").cast("int").alias("runs"))


_TOP = "select 100 + n_regionkey as group_id, n_nationkey as member_id from nation"


@query(f"""with e as ({_TOP}) select 'add' as what, group_id, member_id from e union all select 'add', 100, 77 union all select 'remove', group_id, member_id from e where not (group_id = 101 and member_id = 1)
union all select 'merge', case when group_id = 102 then 103 else group_id end, member_id from e union all select 'copy', group_id, member_id from e union all select 'copy', 500, member_id from e where group_id = 104
union all select 'drop', group_id, member_id from e where group_id <> 100 union all select 'broken', group_id, member_id from e where member_id >= 20
union all select 'holders', member_id, 1 from e""")
def group_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members added and removed, groups merged, copied and removed, links to missing tables, and how many groups hold a member."""
    e = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 100).alias("group_id"), F.col("n_nationkey").alias("member_id"))
    tables = e.where("member_id < 20").select(F.col("member_id").alias("table_id"))
    parts = {
        "add": groups.add_member(e, 100, 77), "remove": groups.remove_member(e, 101, 1), "merge": groups.merge(e, 102, 103), "copy": groups.copy_group(e, 104, 500), "drop": groups.remove_group(e, 100), "broken": groups.broken_links(e, tables),
        "holders": groups.count_groups(e).select(F.col("member_id").alias("group_id"), F.col("n_groups").cast("int").alias("member_id")),
    }
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("what"), "group_id", "member_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("select 999 as group_id, n_nationkey as member_id from nation union all select n_regionkey + 100, n_nationkey from nation")
def group_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top of a hierarchy holding its tables directly."""
    n = table(spark, sf_dir, "nation").select((F.col("n_regionkey") + 100).alias("group_id"), F.col("n_nationkey").alias("member_id"))
    r = table(spark, sf_dir, "region").select(F.lit(999).alias("group_id"), (F.col("r_regionkey") + 100).alias("member_id"))
    return groups.compact(n.unionByName(r), 999)


@query("select vec_id, list_resize(list_transform(embedding, lambda x: cast(x as double)), 70)[65:70] as tail, list_transform(embedding, lambda x: cast(x as double))[1:3] as head from embeddings")
def vector_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice(vectors.resize(v, 70), 65, 6).alias("tail"), vectors.resize(v, 3).alias("head"))


@query(f"with p as (select *, ((y * 64 + x) % 97) / 97.0e0 as dither from {_PIXELS}), q as (select *, cast(floor(value / 0.05e0 + (dither - 0.5e0) + 0.5) as int) as stored from p) select y, x, stored, round((stored - (dither - 0.5e0)) * 0.05e0, 9) + 0.0e0 as restored from q")
def image_quantize_dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir).withColumn("dither", ((F.col("y") * 64 + F.col("x")) % 97) / F.lit(97.0))
    p = p.withColumn("stored", images.quantize(F.col("value"), 0.05, dither=F.col("dither")))
    return p.select("y", "x", "stored", (F.round(images.restore(F.col("stored"), 0.05, dither=F.col("dither")), 9) + 0.0).alias("restored"))


@query(f"select y % 10 as y, x, round(sum(value), 5) + 0.0e0 as total, count(*) as n from {_PIXELS} group by 1, 2")
def image_of_known_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images whose bytes numpy wrote by itself, in big-endian order behind a header of plain text."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows_ in batches:
            cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", "NAXIS   =                    1", "NAXIS1  =                   64", "END"]
            head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
            yield pd.DataFrame({"path": rows_["vec_id"].astype(str), "content": [head + np.asarray(v).astype(">f8").tobytes().ljust(2880, b"\0") for v in rows_["embedding"]]})

    pixels = fits.image_of(table(spark, sf_dir, "embeddings").mapInPandas(encode, "path string, content binary"))
    return pixels.groupBy((F.col("path").cast("long") % 10).alias("y"), "x").agg((F.round(F.sum("value"), 5) + 0.0).alias("total"), F.count("*").alias("n"))


_SAMPLE_BYTES = """t as (select p_brand, p_partkey % 4 as place, case when p_partkey % 10 = 0 then upper(p_name) else p_name end as t from part),
b as (select p_brand, ascii(substr(t, k::int, 1)) * case (place + k - 1) % 4 when 0 then 16777216 when 1 then 65536 when 2 then 256 else 1 end as v from t, range(1, 200) g(k) where k <= length(t)),
s as (select p_brand, sum(v)::hugeint as s from b group by 1)"""


@query(f"with {_SAMPLE_BYTES} select p_brand, (s % 4294967295)::bigint as checksum from s")
def checksum_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all names of a brand, at odd places, after a tenth of them has changed: from the changes alone, in SQL from everything."""
    names = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 4).alias("place"), "p_partkey", F.col("p_name").cast("binary").alias("old"))
    changes = names.where("p_partkey % 10 = 0").withColumn("new", F.upper(F.col("old").cast("string")).cast("binary"))
    sums = checksum.checksum(names, "old", ["p_brand"], "place")
    return checksum.updated(sums, changes, ["p_brand"]).select("p_brand", (F.col("checksum") % checksum.ONES).alias("checksum"))


@query("select p_partkey, true as ok, p_partkey % 2 <> 0 as whole from part")
def checksum_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that carry their checksum's text verify, and don't with one bit flipped, which every second has."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("'"), F.lit("0" * 16), F.lit("' "), "p_name").alias("text"))
    p = p.withColumn("sum", checksum.block_sum(F.col("text").cast("binary"), 3))
    signed = p.withColumn("sign", checksum.to_text(F.col("sum")))
    turned = F.concat(F.substring("sign", 2, 15), F.substring("sign", 1, 1))
    signed = signed.withColumn("text", F.concat(F.lit("'"), turned, F.expr("substring(text, 18)")))
    flipped = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.expr("substring(text, 1, 20)"), F.lit("~"), F.expr("substring(text, 22)"))).otherwise(F.col("text"))
    good = lambda text: checksum.block_sum(text.cast("binary"), 3) % checksum.ONES == 0
    return signed.select("p_partkey", good(F.col("text")).alias("ok"), good(flipped).alias("whole"))


@query("""with a as (select event_id, replace(lpad(bin(event_id * 7919), 66, '0'), '11', '1x') as a, replace(lpad(bin(user_id * 37 + 5), 61, '0'), '101', 'x0x') as b from events),
p as (select event_id, a, b, list_transform(range(1, 67), lambda i: substr(a, i::int, 1) || substr(lpad(b, 66, '0'), i::int, 1)) as p from a),
k as (select *, list_filter(p, lambda q: not contains(q, 'x')) as known from p)
select event_id, array_to_string(list_transform(p, lambda q: case when contains(q, 'x') then 'x' when q = '11' then '1' else '0' end), '') as both, array_to_string(list_transform(p, lambda q: case when contains(q, '1') then '1' when contains(q, '0') then '0' else 'x' end), '') as either,
  translate(a, '01', '10') as inverse, a || b as joined, not (list_contains(p, '01') or list_contains(p, '10')) as equal, array_to_string(list_transform(known, lambda q: q[1]), '') < array_to_string(list_transform(known, lambda q: q[2]), '') as less,
  array_to_string(list_transform(known, lambda q: q[1]), '') >= array_to_string(list_transform(known, lambda q: q[2]), '') as at_least, (length(a) - length(replace(a, '1', '')))::int as ones from k""")
def bit_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit strings of 66 and 61 places, some of them unknown, under every operator."""
    e = table(spark, sf_dir, "events")
    texts = e.select("event_id", F.regexp_replace(F.lpad(F.bin(F.col("event_id") * 7919), 66, "0"), "11", "1x").alias("a"), F.regexp_replace(F.lpad(F.bin(F.col("user_id") * 37 + 5), 61, "0"), "101", "x0x").alias("b"))
    p = texts.withColumns({"a": masked_bits.parse(F.col("a")), "b": masked_bits.parse(F.col("b"))})
    a, b = F.col("a"), F.col("b")
    return p.select(
        "event_id", masked_bits.both(a, b).alias("both"), masked_bits.either(a, b).alias("either"), masked_bits.inverse(a).alias("inverse"), masked_bits.join(a, b).alias("joined"),
        masked_bits.equal(a, b).alias("equal"), masked_bits.less(a, b).alias("less"), masked_bits.less_or_equal(b, a).alias("at_least"), masked_bits.count_ones(a).alias("ones"),
    )


_HDUS = """h as (select c_custkey as table_id, '/n/' || c_nationkey || '.fits' as location, case when c_custkey % 3 = 0 then 'IMAGE' else 'BINTABLE' end as type, 'T' || (c_custkey % 20) as name, 1 + c_custkey % 2 as version, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as position from customer)"""


@query(f"""with {_HDUS}, m as (select s_suppkey, '/n/' || s_nationkey || '.fits' as g, case when s_suppkey % 4 = 0 then './' || (s_suppkey % 25) || '.fits' when s_suppkey % 4 = 1 then '../n/' || (s_suppkey % 25) || '.fits' end as l,
  case when s_suppkey % 2 = 0 then 'bintable' else 'image' end as type, case when s_suppkey % 5 <> 0 then 't' || (s_suppkey % 23) end as name, cast(1 + s_suppkey % 30 as int) as position from supplier),
r as (select *, case when s_suppkey % 4 <= 1 then '/n/' || (s_suppkey % 25) || '.fits' else g end as location from m),
n as (select s_suppkey, table_id, row_number() over (partition by s_suppkey order by h.position <> r.position, h.position, table_id) as nth from r join h on h.location = r.location and upper(r.type) = h.type and upper(r.name) = h.name and h.version = 1),
b as (select s_suppkey, table_id, 'name' as matched_by from n where nth = 1 union all select s_suppkey, min(table_id), 'position' from r join h on h.location = r.location and upper(r.type) = h.type and h.position = r.position where s_suppkey not in (select s_suppkey from n) group by 1),
o as (select b.*, row_number() over (partition by r.g, table_id order by matched_by <> 'name', r.position, s_suppkey) as nth from b join r using (s_suppkey))
select r.s_suppkey, o.table_id, o.matched_by from r left join o on r.s_suppkey = o.s_suppkey and o.nth = 1""")
def group_member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups found by reference: ambiguous names, moved tables, relative locations, missing ones."""
    c = table(spark, sf_dir, "customer")
    location = lambda n: F.concat(F.lit("/n/"), n.cast("string"), F.lit(".fits"))
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    tables = c.select(F.col("c_custkey").alias("table_id"), location(F.col("c_nationkey")).alias("location"), F.when(F.col("c_custkey") % 3 == 0, "IMAGE").otherwise("BINTABLE").alias("type"),
                      F.concat(F.lit("T"), F.col("c_custkey") % 20).alias("name"), (1 + F.col("c_custkey") % 2).cast("int").alias("version"), place.alias("position"))
    k = F.col("s_suppkey")
    file = F.concat((k % 25).cast("string"), F.lit(".fits"))
    asked = table(spark, sf_dir, "supplier").repartition(1).sortWithinPartitions("s_suppkey").select(
        "s_suppkey", location(F.col("s_nationkey")).alias("group_location"), F.when(k % 4 == 0, F.concat(F.lit("./"), file)).when(k % 4 == 1, F.concat(F.lit("../n/"), file)).alias("member_location"),
        F.when(k % 2 == 0, "bintable").otherwise("image").alias("type"), F.when(k % 5 != 0, F.concat(F.lit("t"), k % 23)).alias("name"), F.lit(1).alias("version"), (1 + k % 30).cast("int").alias("position"),
    )
    return groups.find_members(asked, tables).select("s_suppkey", "table_id", "matched_by")


@query("""with a as (select event_id, user_id, cast(sum(user_id) over (order by event_id) as bigint) as upto, row_number() over (order by event_id) - 1 as nth, (select sum(user_id) from events) as whole, (select count(*) from events) as total from events)
select event_id, upto, nth, total from a where upto - user_id <= whole / 2""")
def work_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A work function over chunks of 500 rows with a running sum as its state, which stops where half of the whole is passed."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    half = e.agg(F.sum("user_id")).first()[0] / 2

    def work(chunk: pd.DataFrame, first: int, total: int, before: int) -> tuple[pd.DataFrame, bool]:
        upto = before + chunk["user_id"].cumsum()
        wanted = upto - chunk["user_id"] <= half
        return pd.DataFrame({"event_id": chunk["event_id"], "upto": upto, "nth": first + np.arange(len(chunk)), "total": total})[wanted], not wanted.all()

    total_of = ordered.Carried(0, lambda chunk: int(chunk["user_id"].sum()), lambda a, b: a + b)
    return ordered.work_in_chunks(e, "event_id", work, "event_id long, upto long, nth long, total long", 500, total_of)


_PLANE = f"a as ({_SKY_POINTS}), b as (select p_partkey, radians((x - 1.5e0) * -0.1e0) as el, radians((y + 2.5e0) * 0.1e0) as em, radians(40.0e0) as d0 from a)"


def _by_direction(name: str, distance: str) -> str:
    """SQL of a sky position by the direction at an angular distance from the middle."""
    return f"""{name} as (select *, sin({distance}) * el / greatest(sqrt(el * el + em * em), 1e-30) as tx, sin({distance}) * em / greatest(sqrt(el * el + em * em), 1e-30) as tn, cos({distance}) as tr from b)"""


@query(f"""with {_PLANE}, {_by_direction("arc", "sqrt(el * el + em * em)")}, {_by_direction("stg", "2 * atan(sqrt(el * el + em * em) / 2)")},
other as (select p_partkey, d0 + em as gls_dec, el / cos(d0 + em) as gls_ra, asin(tanh(em + atanh(sin(d0)))) as mer_dec, el as mer_ra, cos(d0) - em * sin(d0) as nx, el as ny from b)
select arc.p_partkey, round(fmod(degrees(atan2(arc.tx, arc.tr * cos(arc.d0) - arc.tn * sin(arc.d0))) + 480, 360), 8) as arc_ra, round(degrees(asin(arc.tr * sin(arc.d0) + arc.tn * cos(arc.d0))), 8) as arc_dec,
  round(fmod(degrees(atan2(stg.tx, stg.tr * cos(stg.d0) - stg.tn * sin(stg.d0))) + 480, 360), 8) as stg_ra, round(degrees(asin(stg.tr * sin(stg.d0) + stg.tn * cos(stg.d0))), 8) as stg_dec,
  round(fmod(degrees(gls_ra) + 480, 360), 8) as gls_ra, round(degrees(gls_dec), 8) as gls_dec, round(fmod(degrees(mer_ra) + 480, 360), 8) as mer_ra, round(degrees(mer_dec), 8) as mer_dec,
  round(fmod(degrees(atan2(ny, nx)) + 480, 360), 8) as ncp_ra, round(degrees(acos(sqrt(nx * nx + ny * ny))), 8) as ncp_dec
from arc join stg using (p_partkey) join other using (p_partkey)""")
def wcs_more_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky positions by five further projections, in SQL by directions and closed forms of another kind."""
    a = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    names = []
    for kind in ("ARC", "STG", "GLS", "MER", "NCP"):
        ra, dec = sky.Projection(120.0, 40.0, 1.5, -2.5, -0.1, 0.1, 0.0, kind).to_sky(F.col("x"), F.col("y"))
        names += [F.round(ra, 8).alias(f"{kind.lower()}_ra"), F.round(dec, 8).alias(f"{kind.lower()}_dec")]
    return a.select("p_partkey", *names)


@query(f"""with a as ({_SKY_POINTS}), b as (select p_partkey, x - 1.5e0 as dx, y + 2.5e0 as dy from a), c as (select p_partkey, radians(-0.1e0 * dx + 0.02e0 * dy) as p, radians(0.03e0 * dx + 0.12e0 * dy) as q from b),
t as (select p_partkey, p * cos(radians(30e0)) - q * sin(radians(30e0)) as el, q * cos(radians(30e0)) + p * sin(radians(30e0)) as em from c),
d as (select p_partkey, el / sqrt(1 + el * el + em * em) as tx, (cos(radians(40e0)) - em * sin(radians(40e0))) / sqrt(1 + el * el + em * em) as ty, (sin(radians(40e0)) + em * cos(radians(40e0))) / sqrt(1 + el * el + em * em) as tz from t),
e as (select p_partkey, (el_ait - 0) as l, em_ait as m from (select p_partkey, radians(dx * -0.1e0) as el_ait, radians(dy * 0.1e0) as em_ait from b))
select d.p_partkey, round(fmod(degrees(atan2(tx, ty)) + 480, 360), 8) as ra, round(degrees(asin(tz)), 8) as dec, round(fmod(degrees(2 * atan(l * sqrt(1 - l * l / 16 - m * m / 4) / (2 * (2 * (1 - l * l / 16 - m * m / 4) - 1)))) + 480, 360), 8) as ait_ra,
  round(degrees(asin(m * sqrt(1 - l * l / 16 - m * m / 4))), 8) as ait_dec from d join e using (p_partkey)""")
def wcs_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of two columns of a table by a skewed matrix with the pole turned, as its header says, and by the ninth projection."""
    a = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("x"), (F.col("p_retailprice") / 100.0).alias("y"))
    keys = {"TTYPE1": "T", "TTYPE2": "X", "TTYPE3": "Y", "TCRVL2": 120.0, "TCRVL3": 40.0, "TCRPX2": 1.5, "TCRPX3": -2.5, "TC2_2": -0.1, "TC2_3": 0.02, "TC3_2": 0.03, "TC3_3": 0.12, "TCTYP2": "RA---TAN", "LONPOLE": 150.0}
    ra, dec = sky.Projection.from_table_header(keys, "x", "y").to_sky(F.col("x"), F.col("y"))
    ait_ra, ait_dec = sky.Projection(120.0, 0.0, 1.5, -2.5, -0.1, 0.1, 0.0, "AIT").to_sky(F.col("x"), F.col("y"))
    return a.select("p_partkey", F.round(ra, 8).alias("ra"), F.round(dec, 8).alias("dec"), F.round(ait_ra, 8).alias("ait_ra"), F.round(ait_dec, 8).alias("ait_dec"))


@query(f"""with {_VIS}, t as (select gu, gv, support, cast(floor((gu - support - 32) / 32.0e0) as int) as u1, cast(ceil((gu + support + 1 - 32) / 32.0e0) as int) - 1 as u2, cast(floor((gv - support - 16) / 16.0e0) as int) as v1, cast(ceil((gv + support + 1 - 16) / 16.0e0) as int) - 1 as v2 from sup where fits),
met as (select cast(pu as int) as pu, cast(pv as int) as pv from t, range(0, 5) a(pu), range(0, 12) b(pv) where pu between u1 and u2 and pv between v1 and v2 union all select -1, -1 from t where gu - support < 32 or gu + support >= 192 or gv - support < 16 or gv + support >= 208)
select pu, pv, count(*) as n from met group by 1, 2""")
def grid_tiles_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by the tiles of a box, and those that also lie outside of it."""
    return gridding.tile_counts(gridding.tiles_in_box(supported(spark, sf_dir), GRID, (32, 16, 5, 12)))


@query(f"""with s as (select p_partkey % 8 as w, p_size % 9 as y, p_partkey % 7 as x, avg(p_size) as re, 0.0e0 as im from part group by 1, 2, 3),
b as (select coalesce(a.w, b.w) as w, coalesce(a.y, b.x) as y, coalesce(a.x, b.y) as x, greatest(abs(coalesce(a.re, 0) - coalesce(b.re, 0)), 0) as error from s a full join s b on a.w = b.w and a.y = b.x and a.x = b.y)
select cast(w as int) as w, cast(y as int) as y, cast(x as int) as x, round(error, 9) as error from b where error > 1e-9""")
def kernel_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table of kernels that differ from their mirror."""
    k = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 8).cast("int").alias("w"), (F.col("p_size") % 9).cast("int").alias("y"), (F.col("p_partkey") % 7).cast("int").alias("x")).agg(F.avg("p_size").alias("re"), F.lit(0.0).alias("im"))
    return gridding.mirror_differences(k).withColumn("error", F.round("error", 9))


@query("select vec_id, cast((i - 1) // 8 + 1 as int) as line, cast((i - 1) % 8 + 1 as int) as place, x as value from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings)")
def fits_table_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of arrays as cells of tables, written and read with their dimensions."""
    fits_source.register(spark)
    path = _stream_path(spark, "nested")
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("embedding") - 1) / 8).cast("int")), lambda i: F.slice("embedding", i * 8 + 1, 8))
    table(spark, sf_dir, "embeddings").select("vec_id", lines.alias("cell")).write.format("fits_table").option("max_bytes", 1 << 18).mode("append").save(path)
    cells = spark.read.format("fits_table").option("split_bytes", 1 << 17).load(path)
    return cells.select("vec_id", F.posexplode("cell").alias("line", "values")).select("vec_id", (F.col("line") + 1).alias("line"), F.posexplode("values").alias("place", "value")).withColumn("place", F.col("place") + 1)


def _part_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts in tables of bounded size, read with their files' names, and the files' cards."""
    fits_source.register(spark)
    path = _stream_path(spark, "parts")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))
    parts.repartition(4).write.format("fits_table").option("max_bytes", 1 << 13).mode("append").save(path)
    return spark.read.format("fits_table").options(file="true", raw="true").load(path), spark.read.format("fits_header").load(path)


@query("select p_partkey, cast(p_size * 12 as bigint) as scaled, 'p_size' as name, cast(null as double) as missing, lower(printf('%016x%08x', p_partkey, p_size)) as bytes from part")
def keyword_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with keywords of their files in expressions, and with their own bytes."""
    parts, cards = _part_files(spark, sf_dir)
    keyed = headers.with_keywords(parts, cards.where("hdu = 1"), {"width": ("NAXIS1", "long"), "name": ("TTYPE2", "string"), "missing": ("EXPTIME", "double")})
    return keyed.select("p_partkey", (F.col("p_size") * F.col("width")).alias("scaled"), "name", "missing", F.lower(F.hex("_raw")).alias("bytes"))


@query("select 'ROWS' as key, cast(count(*) as double) as value from part union all select 'LARGEST', max(p_size) from part union all select 'NAXIS2', count(*) from part")
def keyword_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates of each file's rows as its keywords, which are then put together over the files."""
    parts, cards = _part_files(spark, sf_dir)
    done = headers.calculate_keywords(cards, parts, {"ROWS": (F.count("*"), "long"), "LARGEST": (F.max("p_size").cast("double"), "double")}).where("hdu = 1")
    number = headers.typed_value(F.col("value"), "double")
    return done.where(F.col("key").isin("ROWS", "LARGEST", "NAXIS2")).groupBy("key").agg(F.when(F.col("key") == "LARGEST", F.max(number)).otherwise(F.sum(number)).alias("value"))


@query("""with a as (select p_partkey % 7 + 1 as plane, p_size as y, p_partkey % 30 + 1 as x, max(p_retailprice)::double as value from part group by 1, 2, 3)
select cast(f.plane as int) as plane, cast(g.y as int) as y, cast(h.x as int) as x, a.value from range(1, 8) f(plane), range(1, 51) g(y), range(1, 31) h(x) left join a on a.plane = f.plane and a.y = g.y and a.x = h.x""")
def fits_cube_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube of the dearest parts in files of two planes, written as sorted streams and read with their planes' numbers."""
    fits_source.register(spark)
    path = _stream_path(spark, "cube")
    pixels = table(spark, sf_dir, "part").select((F.col("p_partkey") % 7 + 1).alias("plane"), F.col("p_size").alias("y"), (F.col("p_partkey") % 30 + 1).alias("x"), F.col("p_retailprice").alias("value"))
    fits_source.write_images(pixels, path, 30, 50, 7, "f8", max_bytes=2 * 30 * 50 * 8)
    cards = spark.read.format("fits_header").load(path)
    read = headers.with_keywords(spark.read.format("fits_image").load(path), cards, {"first": ("CRVAL3", "long")}, file="path")
    return read.select((F.col("plane") + F.col("first") - 1).cast("int").alias("plane"), "y", "x", "value")
