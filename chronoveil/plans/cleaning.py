"""Cleaning, normalising, resampling and splitting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.operators import clean, split
from chronoveil.operators.relational import common_range
from chronoveil.operators.position import group_bound, join_sized, with_position
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS
HOUR_US = 3_600_000_000


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("interp_linear", f"""
WITH {fx.GAPPY_SQL},
known AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS p0,
  last_value(value IGNORE NULLS) OVER w1 AS v0,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS p1,
  first_value(value IGNORE NULLS) OVER w2 AS v1 FROM gappy
  WINDOW w1 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, pos, round(CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 WHEN p1 = p0 THEN v0
  ELSE v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END, 6) AS value FROM known
""")
def interp_linear(spark, sf):
    out = clean.interpolate_index(fx.gappy_series(spark, sf), K, "pos", "value")
    return out.select("series_id", "pos", r6(F.col("value"), "value"))


@query("ffill_bfill", f"""
WITH {fx.GAPPY_SQL}
SELECT series_id, pos, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(value IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS value FROM gappy
""")
def ffill_bfill(spark, sf):
    out = clean.fill_forward_back(fx.gappy_series(spark, sf), K, "pos", "value")
    return out.select("series_id", "pos", "value")


@query("resample_mean", f"""
WITH {fx.EVENTS_SQL},
st AS (SELECT series_id, avg(value) m, stddev_pop(value) s FROM ev GROUP BY 1),
z AS (SELECT e.series_id, t_us // {HOUR_US} AS bin, CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END AS z
      FROM ev e JOIN st USING (series_id)),
bins AS (SELECT series_id, bin, avg(z) z FROM z GROUP BY 1, 2),
grid AS (SELECT series_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM bins GROUP BY 1)
SELECT g.series_id, g.bin::BIGINT AS bin, b.z IS NULL AS filled,
  round(last_value(b.z IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.bin), 6) AS z
FROM grid g LEFT JOIN bins b ON g.series_id = b.series_id AND g.bin = b.bin
""")
def resample_mean(spark, sf):
    z = clean.zscore(fx.events(spark, sf), K, ["value"])
    out = clean.resample_mean(z, K, "t_us", ["value_z"], HOUR_US)
    return out.select("series_id", "bin", "filled", r6(F.col("value_z"), "z"))


@query("regrid_interp", f"""
WITH {fx.EVENTS_SQL},
rng AS (SELECT series_id, event_type, min(t_us) lo, max(t_us) hi FROM ev GROUP BY 1, 2),
com AS (SELECT series_id, max(lo) lo, min(hi) hi FROM rng GROUP BY 1 HAVING min(hi) > max(lo)),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, {HOUR_US})) AS grid FROM com),
full_grid AS (SELECT g.series_id, r.event_type, g.grid FROM grid g JOIN rng r USING (series_id)),
p AS (SELECT g.*, a.t_us t0, a.value v0 FROM full_grid g ASOF JOIN ev a
      ON g.series_id = a.series_id AND g.event_type = a.event_type AND g.grid >= a.t_us),
n AS (SELECT p.*, b.t_us t1, b.value v1 FROM p ASOF JOIN ev b
      ON p.series_id = b.series_id AND p.event_type = b.event_type AND p.grid <= b.t_us)
SELECT series_id, event_type, grid::BIGINT AS grid,
  round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((grid - t0) / (t1 - t0)::DOUBLE) END, 6) AS value FROM n
""")
def regrid_interp(spark, sf):
    ev = fx.events(spark, sf)
    rng = common_range(ev, K, ["event_type"], "t_us")
    sensor = ["series_id", "event_type"]
    placed = with_position(ev.select(*sensor, "t_us", "event_id", "value"), sensor, "t_us", ["event_id"])
    out = clean.regrid(join_sized(placed, rng, K, group_bound(placed, K)), sensor, "pos", "t_us", ["value"], HOUR_US, "t_start", "t_start", "t_end")
    return out.select("series_id", "event_type", "grid", r6(F.col("value"), "value"))


@query("asof_interp_join", f"""
WITH {fx.EVENTS_SQL},
b AS (SELECT series_id, min(t_us) lo, max(t_us) hi FROM ev GROUP BY 1),
grid AS (SELECT series_id, unnest(generate_series(lo - lo % {HOUR_US} + {HOUR_US}, hi, {HOUR_US})) AS grid FROM b),
p AS (SELECT g.*, a.t_us t_prev, a.value v_prev FROM grid g ASOF JOIN ev a
      ON g.series_id = a.series_id AND g.grid >= a.t_us)
SELECT p.series_id, p.grid::BIGINT AS grid, p.t_prev, n.t_us AS t_next,
  round(CASE WHEN p.grid = p.t_prev THEN v_prev
        ELSE v_prev + (n.value - v_prev) * ((p.grid - p.t_prev) / (n.t_us - p.t_prev)::DOUBLE) END, 6) AS value
FROM p ASOF JOIN ev n ON p.series_id = n.series_id AND p.grid < n.t_us
""")
def asof_interp_join(spark, sf):
    ev = fx.series(spark, sf).select("series_id", "pos", "t_us", "value")
    wide = ev.withColumn("zero", F.lit(0).cast("bigint")).withColumn("top", F.lit(2 ** 62))
    out = clean.regrid(wide, K, "pos", "t_us", ["value"], HOUR_US, "zero", "zero", "top")
    return (out.filter(F.col("t_next").isNotNull())
            .select("series_id", "grid", "t_prev", "t_next", r6(F.col("value"), "value")))


@query("zscore_pop", f"""
WITH {fx.EVENTS_SQL},
g AS (SELECT event_id, series_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM ev),
st AS (SELECT series_id, avg(value) m, stddev_pop(value) s FROM g GROUP BY 1)
SELECT event_id, round(coalesce(CASE WHEN s = 0 THEN 0 ELSE (value - m) / s END, 0), 6) AS z FROM g JOIN st USING (series_id)
""")
def zscore_pop(spark, sf):
    ev = fx.events(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    return clean.zscore(ev, K, ["value"]).select("event_id", r6(F.col("value_z"), "z"))


@query("zscore_sample", f"""
WITH {fx.EVENTS_SQL},
st AS (SELECT series_id, avg(value) m, stddev_samp(value) s FROM ev GROUP BY 1)
SELECT event_id, round((value - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z FROM ev JOIN st USING (series_id)
""")
def zscore_sample(spark, sf):
    out = clean.zscore(fx.events(spark, sf), K, ["value"], population=False, zero_scale=1.0, missing=None)
    return out.select("event_id", r6(F.col("value_z"), "z"))


@query("minmax", f"""
WITH {fx.EVENTS_SQL},
g AS (SELECT event_id, series_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value, k FROM ev),
st AS (SELECT series_id, min(value) lo, max(value) hi, min(k) klo, max(k) khi FROM g GROUP BY 1)
SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) AS value_mm,
  round(coalesce((k - klo) / nullif(khi - klo, 0), 0), 6) AS k_mm FROM g JOIN st USING (series_id)
""")
def minmax(spark, sf):
    ev = fx.events(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))
    return clean.minmax(ev, K, ["value", "k"]).select(
        "event_id", r6(F.col("value_mm"), "value_mm"), r6(F.col("k_mm"), "k_mm"))


@query("norm_params", f"""
WITH {fx.EVENTS_SQL}, l AS (SELECT series_id, 'value' AS channel, value FROM ev UNION ALL SELECT series_id, 'k', k FROM ev)
SELECT series_id, channel, round(avg(value), 8) AS mean, round(stddev_pop(value), 8) AS std, min(value) AS min,
  max(value) AS max FROM l GROUP BY 1, 2
""")
def norm_params(spark, sf):
    out = clean.norm_params(fx.events(spark, sf), K, ["value", "k"])
    return out.select("series_id", "channel", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "min", "max")


SPLIT_SQL = fx.SERIES_SQL + """,
sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series),
sp AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
   WHEN pos < n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)
"""
SCALE_SQL = SPLIT_SQL + """,
fit AS (SELECT series_id, avg(value) FILTER (split = 'train') mu,
   CASE WHEN stddev_pop(value) FILTER (split = 'train') = 0 THEN 1 ELSE stddev_pop(value) FILTER (split = 'train') END sd
   FROM sp GROUP BY 1)
"""


@query("split_70_10_20", f"""
WITH {SPLIT_SQL} SELECT series_id, pos, split FROM sp
""")
def split_70_10_20(spark, sf):
    return split.split_ratio(fx.series(spark, sf), K, "pos").select("series_id", "pos", "split")


def scaled(spark, sf):
    parts = split.split_ratio(fx.series(spark, sf), K, "pos")
    fit = clean.fit_scale(parts, K, ["value"], F.col("split") == "train")
    return clean.apply_scale(parts, fit, K, ["value"])


@query("standard_scale_fit", f"""
WITH {SCALE_SQL}
SELECT series_id, pos, split, round((value - mu) / sd, 6) AS scaled FROM sp JOIN fit USING (series_id)
""")
def standard_scale_fit(spark, sf):
    return scaled(spark, sf).select("series_id", "pos", "split", r6(F.col("value_s"), "scaled"))


@query("inverse_scale", f"""
WITH {SCALE_SQL}
SELECT series_id, pos, round(((value - mu) / sd) * sd + mu, 6) AS back FROM sp JOIN fit USING (series_id)
""")
def inverse_scale(spark, sf):
    return clean.invert_scale(scaled(spark, sf), ["value"]).select("series_id", "pos", r6(F.col("value_back"), "back"))


@query("gaussian_norm", f"""
WITH {fx.EVENTS_SQL}, g AS (SELECT avg(value) m, stddev_samp(value) + 1e-5::DOUBLE s FROM ev),
p AS (SELECT event_type, avg(value) m, stddev_samp(value) + 1e-5::DOUBLE s FROM ev GROUP BY 1)
SELECT event_id, round((value - g.m) / g.s, 6) AS enc, round(((value - g.m) / g.s) * g.s + g.m, 6) AS dec,
  round((value - p.m) / p.s, 6) AS enc_point FROM ev, g, p WHERE p.event_type = ev.event_type
""")
def gaussian_norm(spark, sf):
    ev = fx.events(spark, sf).select("event_id", "event_type", "value")
    whole = clean.gaussian_norm(ev, [], "value")
    whole = whole.withColumnsRenamed({"enc": "enc_all", "dec": "dec_all"})
    out = clean.gaussian_norm(whole, ["event_type"], "value")
    return out.select("event_id", r6(F.col("enc_all"), "enc"), r6(F.col("dec_all"), "dec"), r6(F.col("enc"), "enc_point"))


@query("range_norm", f"""
WITH {fx.EVENTS_SQL}, st AS (SELECT event_type, min(value) lo, max(value) hi FROM ev GROUP BY 1),
c AS (SELECT event_type, 2.0::DOUBLE / (hi - lo) a, 1.0::DOUBLE - (2.0::DOUBLE / (hi - lo)) * hi b FROM st WHERE hi <> lo)
SELECT event_id, round(a * value + b, 6) AS enc, round(((a * value + b) - b) / a, 6) AS dec FROM ev JOIN c USING (event_type)
""")
def range_norm(spark, sf):
    out = clean.range_norm(fx.events(spark, sf), ["event_type"], "value", low=-1.0, high=1.0)
    return out.select("event_id", r6(F.col("enc"), "enc"), r6(F.col("dec"), "dec"))


@query("instance_norm", f"""
WITH {fx.SERIES_SQL},
w AS (SELECT *, pos // 16 AS win_id FROM series),
st AS (SELECT series_id, win_id, avg(value) m, sqrt(var_pop(value) + 1e-5::DOUBLE) s, arg_max(value, pos) l FROM w GROUP BY 1, 2)
SELECT series_id, pos, round((value - m) / s, 6) AS norm_mean, round((value - l) / s, 6) AS norm_last,
  round(((value - m) / s) * s + m, 6) AS denorm FROM w JOIN st USING (series_id, win_id)
""")
def instance_norm(spark, sf):
    w = fx.series(spark, sf).withColumn("win_id", F.floor(F.col("pos") / 16))
    keys = ["series_id", "win_id"]
    by_mean = clean.instance_norm(w, keys, "pos", "value").withColumnsRenamed({"norm": "nm", "denorm": "dm"})
    out = clean.instance_norm(by_mean, keys, "pos", "value", subtract_last=True)
    return out.select("series_id", "pos", r6(F.col("nm"), "norm_mean"), r6(F.col("norm"), "norm_last"),
                      r6(F.col("dm"), "denorm"))


@query("split_with_context", f"""
WITH {fx.SERIES_SQL},
n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
b AS (SELECT series_id, 'train' split, 0 lo, floor(n * 0.7::DOUBLE) hi FROM n
 UNION ALL SELECT series_id, 'val', floor(n * 0.7::DOUBLE) - 10, n - floor(n * 0.2::DOUBLE) FROM n
 UNION ALL SELECT series_id, 'test', n - floor(n * 0.2::DOUBLE) - 10, n FROM n
 UNION ALL SELECT series_id, 'train_fixed_val', 0, floor(n * 0.7::DOUBLE) FROM n
 UNION ALL SELECT series_id, 'val_fixed_val', floor(n * 0.7::DOUBLE) - 10, floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) FROM n
 UNION ALL SELECT series_id, 'test_fixed_val', n - floor(n * 0.2::DOUBLE) - 10, n FROM n)
SELECT s.series_id, s.pos, b.split FROM series s JOIN b ON s.series_id = b.series_id AND s.pos >= b.lo AND s.pos < b.hi
""")
def split_with_context(spark, sf):
    s = fx.series(spark, sf)
    rest = split.split_with_context(s, K, "pos", seq_len=10)
    fixed = split.split_with_context(s, K, "pos", seq_len=10, val=0.1).withColumn(
        "split", F.concat("split", F.lit("_fixed_val")))
    return rest.unionByName(fixed).select("series_id", "pos", "split")


@query("split_fixed", f"""
WITH {fx.DAILY_SQL}, s AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS pos FROM daily),
b AS (SELECT * FROM (VALUES ('train', 0, 360), ('val', 330, 480), ('test', 450, 600)) AS t(split, lo, hi))
SELECT s.pos, s.day, b.split FROM s JOIN b ON s.pos >= b.lo AND s.pos < b.hi
""")
def split_fixed(spark, sf):
    """12/4/4 months of 30 days on the daily order series, 30 rows of context."""
    days = with_position(fx.daily_orders(spark, sf), K, "day")
    return split.split_fixed(days, "pos", seq_len=30, train=12 * 30, val=4 * 30, test=4 * 30).select("pos", "day", "split")


@query("split_by_key", f"""
WITH {fx.EVENTS_SQL}
SELECT event_id, CASE WHEN series_id % 10 < 7 THEN 'train' WHEN series_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM ev
""")
def split_by_key(spark, sf):
    slot = F.col("series_id") % 10
    return split.split_by_key(fx.events(spark, sf), "series_id", {
        "train": slot < 7, "val": slot == 7, "test": slot > 7}).select("event_id", "split")


@query("split_eval_gap", f"""
WITH {fx.SERIES_SQL}, sized AS (SELECT *, floor(count(*) OVER (PARTITION BY series_id) * 0.3::DOUBLE)::BIGINT AS cut FROM series),
p AS (SELECT *, CASE WHEN pos < cut THEN 'development' WHEN pos >= cut + 5 THEN 'held_out' END AS split FROM sized),
q AS (SELECT series_id, event_id, split, row_number() OVER (PARTITION BY series_id, split ORDER BY pos) - 1 AS new_pos,
  event_type FROM p WHERE split IS NOT NULL)
SELECT series_id, event_id, split, new_pos,
  min(event_type = 'error') OVER (PARTITION BY split) <> max(event_type = 'error') OVER (PARTITION BY split) AS both_classes FROM q
""")
def split_eval_gap(spark, sf):
    parts = split.split_eval_gap(fx.series(spark, sf), K, "pos", fraction=0.3, gap=5)
    flag = F.col("event_type") == "error"
    out = clean.group_stats(parts, ["split"], {"both_classes": F.bool_or(flag) & ~F.bool_and(flag)}, groups=2)
    return out.select("series_id", "event_id", "split", "new_pos", "both_classes")


@query("forecast_tail", f"""
WITH {fx.SERIES_SQL}, l AS (SELECT series_id, max(pos) last, arg_max(t_us, pos) t FROM series GROUP BY 1)
SELECT s.series_id, s.pos, t_us AS t, value, 'context' AS part FROM series s JOIN l USING (series_id) WHERE s.pos > l.last - 12
UNION ALL
SELECT series_id, last + h, t + h * {HOUR_US}, NULL, 'future' FROM l, (SELECT unnest(generate_series(1, 4)) AS h)
""")
def forecast_tail(spark, sf):
    return split.forecast_tail(fx.series(spark, sf), K, "pos", "t_us", "value", 12, 4, HOUR_US)
