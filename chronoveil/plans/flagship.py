"""End-to-end query: series -> time split -> scaling -> windows -> labels -> private batches -> class mix per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoveil.operators import clean, sampling, split, windows
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query
from chronoveil.plans.sampling_queries import hits_sql

K = fx.KEYS
LENGTH, STRIDE, BATCH, LAM = 20, 5, 4, 0.5


@query("flagship_batch_class_mix", f"""
WITH RECURSIVE {fx.CODED_SQL},
sz AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM coded),
tr AS (SELECT * FROM sz WHERE pos < floor(n * 0.7::DOUBLE)),
fit AS (SELECT series_id, avg(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS sd FROM tr GROUP BY 1),
z AS (SELECT tr.*, (value - mu) / sd AS zv FROM tr JOIN fit USING (series_id)),
cn AS (SELECT series_id, (count(*) - {LENGTH}) // {STRIDE} + 1 AS candidates FROM tr GROUP BY 1 HAVING (count(*) - {LENGTH}) // {STRIDE} + 1 >= {BATCH}),
lay AS (SELECT series_id, ceil(candidates / {BATCH})::BIGINT AS steps, candidates // 8 AS base, candidates % 8 AS rem, unnest(generate_series(0, 7)) AS unit FROM cn),
iv AS (SELECT *, unit * base + least(unit, rem) AS lo, base + (unit < rem)::INT AS size FROM lay),
units AS (SELECT series_id, unit, {LAM}::DOUBLE AS p, steps FROM iv WHERE size > 0),
{hits_sql()},
dr AS (SELECT h.series_id, step, lo + floor({fx.u_sql("'member'", "h.series_id", "unit", "step")} * size)::BIGINT AS win_id FROM hits h JOIN iv USING (series_id, unit)),
ct AS (SELECT d.series_id, d.step, d.win_id, label, count(*) AS c FROM dr d JOIN z ON z.series_id = d.series_id AND z.pos >= d.win_id * {STRIDE} AND z.pos < d.win_id * {STRIDE} + {LENGTH} GROUP BY 1, 2, 3, 4),
mj AS (SELECT series_id, step, win_id, label FROM ct QUALIFY row_number() OVER (PARTITION BY series_id, step, win_id ORDER BY c DESC, label) = 1),
en AS (SELECT d.series_id, d.step, d.win_id, avg(zv) AS level FROM dr d JOIN z ON z.series_id = d.series_id AND z.pos >= d.win_id * {STRIDE} AND z.pos < d.win_id * {STRIDE} + {LENGTH} GROUP BY 1, 2, 3)
SELECT step, label, count(*) AS windows, round(avg(level), 6) AS level FROM mj JOIN en USING (series_id, step, win_id) GROUP BY 1, 2
""")
def batch_class_mix(spark: SparkSession, sf: str) -> DataFrame:
    parts = split.split_ratio(fx.coded_series(spark, sf), K, "pos")
    train = parts.filter(F.col("split") == "train").select("series_id", "pos", "value", "label")
    fit = clean.fit_scale(train, K, ["value"], F.lit(True))
    scaled = clean.apply_scale(train, fit, K, ["value"])

    # Windows are labelled once; batches of all steps are one table of window ids joined to them.
    rows = windows.window_rows(scaled.select("series_id", "pos", "value_s", "label"), K, "pos", LENGTH, STRIDE)
    win = ["series_id", "win_id"]
    per_label = rows.groupBy(*win, "label").agg(F.count(F.lit(1)).alias("c"), F.sum("value_s").alias("s"))
    labelled = per_label.groupBy(*win).agg(
        F.max_by(F.col("label"), F.struct(F.col("c"), -F.col("label"))).alias("label"), (F.sum("s") / F.sum("c")).alias("level"))

    # Series whose training part has fewer windows than a batch take no part.
    draws = sampling.spaced(train, K, LENGTH, STRIDE, BATCH, LAM, fx.SEED, empty="skip", short="drop").select(
        "series_id", "step", F.col("cand_id").alias("win_id"))
    return (draws.join(labelled, win).groupBy("step", "label")
            .agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg("level"), 6).alias("level")))
