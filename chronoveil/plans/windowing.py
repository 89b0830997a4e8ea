"""Window construction, window labels and time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.functions import timefeat
from chronoveil.functions.rng import uniform
from chronoveil.operators import windows as wn
from chronoveil.operators.position import spread_sequence
from chronoveil.operators.split import pooled_position
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS


def r6(c, name):
    return F.round(c, 6).alias(name)


def weighted(arr):
    """Position-weighted checksum of an array, so that order and content are both compared."""
    return F.round(F.aggregate(F.zip_with(arr, F.sequence(F.lit(1), F.size(arr)), lambda v, i: v * i),
                               F.lit(0.0), lambda acc, x: acc + x), 6)


@query("win_unit_stride", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1)
SELECT a.series_id, a.pos AS start_pos, round(sum(CASE WHEN b.pos < a.pos + 12 THEN b.value * (b.pos - a.pos + 1) END), 6) AS x_sum,
  round(sum(CASE WHEN b.pos >= a.pos + 12 THEN b.value * (b.pos - a.pos - 11) END), 6) AS y_sum
FROM series a JOIN n USING (series_id) JOIN series b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos AND a.pos + 15
WHERE a.pos + 16 <= n GROUP BY 1, 2
""")
def win_unit_stride(spark, sf):
    out = wn.unit_windows(fx.series(spark, sf), K, "pos", F.col("value"), 12, 4)
    return out.select("series_id", "start_pos", weighted(F.col("x")).alias("x_sum"), weighted(F.col("y")).alias("y_sum"))


@query("win_strided", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
st AS (SELECT series_id, unnest(generate_series(0, (n - 20) // 10)) AS win_id FROM n WHERE n >= 20)
SELECT st.series_id, st.win_id, win_id * 10 AS start_pos, round(sum(value * (pos - win_id * 10 + 1)), 6) AS x_sum
FROM st JOIN series s ON s.series_id = st.series_id AND pos >= win_id * 10 AND pos < win_id * 10 + 20 GROUP BY 1, 2
""")
def win_strided(spark, sf):
    rows = wn.window_rows(fx.series(spark, sf), K, "pos", 20, 10)
    out = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value"))
    return out.select("series_id", "win_id", (F.col("win_id") * 10).alias("start_pos"), weighted(F.col("x")).alias("x_sum"))


@query("win_drop_tail", f"""
WITH {fx.SERIES_SQL}, t AS (SELECT *, pos // 16 AS win_id FROM series)
SELECT series_id, win_id, round(sum(value * (pos % 16 + 1)), 6) AS x_sum, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) = 16
""")
def win_drop_tail(spark, sf):
    rows = wn.tumbling_rows(fx.series(spark, sf), K, "pos", 16)
    out = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value"))
    return out.select("series_id", "win_id", weighted(F.col("x")).alias("x_sum"), F.size("x").cast("bigint").alias("n"))


@query("win_label_overlap", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1)
SELECT a.series_id, a.pos AS start_pos, round(sum(b.value * (b.pos - a.pos - 5)), 6) AS y_sum, count(*) AS y_len
FROM series a JOIN n USING (series_id) JOIN series b ON a.series_id = b.series_id AND b.pos BETWEEN a.pos + 6 AND a.pos + 15
WHERE a.pos + 16 <= n GROUP BY 1, 2
""")
def win_label_overlap(spark, sf):
    out = wn.unit_windows(fx.series(spark, sf), K, "pos", F.col("value"), 12, 4, overlap=6)
    return out.select("series_id", "start_pos", weighted(F.col("y")).alias("y_sum"), F.size("y").cast("bigint").alias("y_len"))


@query("win_per_sequence", f"""
WITH {fx.SERIES_SQL}, b AS (SELECT series_id, count(*) len FROM series GROUP BY 1),
c AS (SELECT series_id, sum(len) OVER (ORDER BY series_id) - len AS start, sum(len) OVER (ORDER BY series_id) AS stop FROM b)
SELECT series_id, unnest(generate_series(start::BIGINT, (stop - 25)::BIGINT, 13)) AS start_pos FROM c
""")
def win_per_sequence(spark, sf):
    pooled = pooled_position(fx.series(spark, sf), K, "pos")
    bounds = pooled.groupBy("series_id").agg(F.min("pool_pos").alias("start"), (F.max("pool_pos") + 1).alias("stop"))
    return wn.starts_in_intervals(bounds, "start", "stop", 25, 13).select("series_id", "start_pos")


@query("win_label_runs", f"""
WITH {fx.CODED_SQL}, f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY series_id ORDER BY pos) = label THEN 0 ELSE 1 END AS ch FROM coded),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM f),
r AS (SELECT series_id, run, label, min(pos) AS a, max(pos) + 1 AS b FROM g GROUP BY 1, 2, 3)
SELECT series_id, label, a AS run_start, b AS run_stop, unnest(generate_series(a, b - 2, 2)) AS start_pos FROM r WHERE b - a >= 2
""")
def win_label_runs(spark, sf):
    runs = wn.label_runs(fx.coded_series(spark, sf), K, "pos", "label")
    return wn.windows_in_runs(runs, 2).select("series_id", "label", "run_start", "run_stop", "start_pos")


@query("win_zero_padded", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
st AS (SELECT series_id, unnest(generate_series(0, (n - 4) // 5)) AS win_id FROM n WHERE n >= 4),
o AS (SELECT *, unnest(generate_series(0, 15)) AS off FROM st),
v AS (SELECT o.*, coalesce(s.value, 0) AS v, s.value IS NULL AS pad FROM o LEFT JOIN series s
  ON s.series_id = o.series_id AND s.pos = o.win_id * 5 + off - 12)
SELECT series_id, win_id, win_id * 5 AS start_pos, count_if(pad)::INT AS padded,
  round(sum(CASE WHEN off < 12 THEN v * (off + 1) END), 6) AS x_sum,
  round(sum(CASE WHEN off >= 12 THEN v * (off - 11) END), 6) AS y_sum FROM v GROUP BY 1, 2
""")
def win_zero_padded(spark, sf):
    out = wn.zero_padded_windows(fx.series(spark, sf), K, "pos", F.col("value"), 12, 4, 5)
    return out.select("series_id", "win_id", "start_pos", F.col("padded").cast("int").alias("padded"),
                      weighted(F.col("x")).alias("x_sum"), weighted(F.col("y")).alias("y_sum"))


@query("win_gather", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
d AS (SELECT series_id, draw, (floor({fx.u_sql("'gather'", "series_id", "draw")} * (n - 7)))::BIGINT AS start_pos
      FROM n, (SELECT unnest(generate_series(0, 4)) AS draw))
SELECT d.series_id, d.draw, d.start_pos, s.pos - d.start_pos AS "offset", s.value FROM d JOIN series s
  ON s.series_id = d.series_id AND s.pos BETWEEN d.start_pos AND d.start_pos + 7
""")
def win_gather(spark, sf):
    s = fx.series(spark, sf)
    draws = (s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
             .select("series_id", "draw", F.floor(
                 uniform(fx.SEED, "gather", F.col("series_id"), F.col("draw")) * (F.col("n") - 7)).alias("start_pos")))
    out = wn.gather(draws, s.select("series_id", "pos", "value"), K, "pos", 8)
    return out.select("series_id", "draw", "start_pos", F.col("offset").cast("bigint").alias("offset"), "value")


@query("patch_unfold", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) // 40 AS wins FROM series GROUP BY 1),
w AS (SELECT s.series_id, pos // 40 AS win_id, list(value ORDER BY pos) AS x FROM series s JOIN n USING (series_id)
      WHERE pos // 40 < wins GROUP BY 1, 2),
f AS (SELECT *, list_concat(x, [x[40] for i in range(8)]) AS xr FROM w),
p AS (SELECT *, unnest(generate_series(0, 4)) AS patch FROM f),
e AS (SELECT series_id, win_id, patch, unnest(generate_series(1, 16)) AS i, xr FROM p)
SELECT series_id, win_id, patch::INT AS patch, round(sum(xr[patch * 8 + i] * i), 6) AS x_sum FROM e
WHERE patch * 8 + 16 <= 48 GROUP BY 1, 2, 3
""")
def patch_unfold(spark, sf):
    rows = wn.tumbling_rows(fx.series(spark, sf), K, "pos", 40)
    arr = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value"))
    out = arr.select("series_id", "win_id", F.posexplode(wn.patches(F.col("x"), 40, 16, 8, repeat_last=True)))
    return out.select("series_id", "win_id", F.col("pos").alias("patch"), weighted(F.col("col")).alias("x_sum"))


@query("candidate_indices", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
w AS (SELECT series_id, unnest(generate_series(0, n - 16)) AS win_id FROM n WHERE n >= 16)
SELECT series_id, win_id, count(*) OVER (PARTITION BY series_id) AS candidates FROM w WHERE win_id % 4 = 0
""")
def candidate_indices(spark, sf):
    lengths = fx.series(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    wins = spread_sequence(lengths.withColumn("wins", F.col("n") - 15), K, "wins", "win_id")
    return wn.strided_candidates(wins, "win_id", 4, K).select("series_id", "win_id", "candidates")


@query("majority_label", f"""
WITH {fx.CODED_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1),
st AS (SELECT series_id, unnest(generate_series(0, (n - 20) // 10)) AS win_id FROM n WHERE n >= 20),
c AS (SELECT st.series_id, win_id, label, count(*) AS c FROM st JOIN coded s ON s.series_id = st.series_id
      AND pos >= win_id * 10 AND pos < win_id * 10 + 20 GROUP BY 1, 2, 3)
SELECT series_id, win_id, label, c AS votes FROM c
QUALIFY row_number() OVER (PARTITION BY series_id, win_id ORDER BY c DESC, label) = 1
""")
def majority_label(spark, sf):
    rows = wn.window_rows(fx.coded_series(spark, sf).select("series_id", "pos", "label"), K, "pos", 20, 10)
    return wn.majority_label(rows, ["series_id", "win_id"], "label")


@query("point_labels", f"""
WITH {fx.CODED_SQL}, t AS (SELECT series_id, pos // 20 AS win_id, label, pos FROM coded)
SELECT series_id, win_id, string_agg(label::VARCHAR, ',' ORDER BY pos) AS labels FROM t GROUP BY 1, 2 HAVING count(*) = 20
""")
def point_labels(spark, sf):
    rows = wn.tumbling_rows(fx.coded_series(spark, sf).select("series_id", "pos", "label"), K, "pos", 20)
    arr = wn.gather_arrays(rows, ["series_id", "win_id"], F.col("label"), "labels")
    return arr.select("series_id", "win_id", F.concat_ws(",", F.col("labels").cast("array<string>")).alias("labels"))


@query("dense_label_map", """
SELECT p_partkey, p_size AS label, (dense_rank() OVER (ORDER BY p_size) - 1)::INT AS dense FROM part
""")
def dense_label_map(spark, sf):
    part = fx.read_table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("label"))
    return wn.dense_labels(part, "label")


@query("stratum_weekday", """
SELECT event_id, (isodow(ts) - 1)::INT AS stratum, count(*) OVER (PARTITION BY isodow(ts)) AS stratum_size FROM events
""")
def stratum_weekday(spark, sf):
    ev = fx.events(spark, sf).select("event_id", F.weekday("ts").alias("stratum"))
    return wn.group_stats(ev, ["stratum"], {"stratum_size": F.count(F.lit(1))})


@query("time_fields", """
SELECT event_id, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS weekday, hour(ts)::INT AS hour,
  minute(ts)::INT AS minute, (minute(ts) // 15)::INT AS quarter_hour FROM events
""")
def time_fields(spark, sf):
    cols = timefeat.fields(F.col("ts"))
    quarter = timefeat.fields(F.col("ts"), quarter_hour=True)["minute"].alias("quarter_hour")
    return fx.events(spark, sf).select("event_id", *[c.alias(n) for n, c in cols.items()], quarter)


def _features(names):
    def run(spark, sf):
        return fx.events(spark, sf).select("event_id", *[r6(timefeat.FEATURES[n](F.col("ts")), n) for n in names])
    return run


FEATURE_SQL = {
    "second": "second(ts) / 59.0 - 0.5", "minute": "minute(ts) / 59.0 - 0.5", "hour": "hour(ts) / 23.0 - 0.5",
    "dow": "(isodow(ts) - 1) / 6.0 - 0.5", "dom": "(day(ts) - 1) / 30.0 - 0.5", "doy": "(dayofyear(ts) - 1) / 365.0 - 0.5",
    "month": "(month(ts) - 1) / 11.0 - 0.5", "week": "(weekofyear(ts) - 1) / 52.0 - 0.5",
}


def _feature_sql(names):
    cols = ", ".join(f"round(({FEATURE_SQL[n]})::DOUBLE, 6) AS {n}" for n in names)
    return f"SELECT event_id, {cols} FROM events"


for _name, _parts in {"time_feat_second_minute_hour": ["second", "minute", "hour"],
                      "time_feat_dow_dom_doy": ["dow", "dom", "doy"],
                      "time_feat_month_week": ["month", "week"]}.items():
    query(_name, _feature_sql(_parts))(_features(_parts))


@query("time_feat_by_freq", "\nUNION ALL\n".join(
    "SELECT o_orderkey, '%s' AS freq, %d AS i, round((%s)::DOUBLE, 6) AS x FROM orders" % (
        f, i, FEATURE_SQL[n].replace("(ts)", "(o_orderdate)"))
    for f in timefeat.BY_FREQ for i, n in enumerate(timefeat.BY_FREQ[f])))
def time_feat_by_freq(spark, sf):
    orders = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    per_freq = F.explode(F.array(*[
        F.struct(F.lit(f).alias("freq"), timefeat.by_frequency(F.col("o_orderdate"), f).alias("xs"))
        for f in timefeat.BY_FREQ if timefeat.BY_FREQ[f]])).alias("e")
    out = orders.select("o_orderkey", per_freq)
    return (out.select("o_orderkey", F.col("e.freq").alias("freq"), F.posexplode("e.xs"))
            .select("o_orderkey", "freq", F.col("pos").alias("i"), r6(F.col("col"), "x")))


@query("window_moments", f"""
WITH {fx.SERIES_SQL}, t AS (SELECT *, pos // 16 AS win_id FROM series),
d AS (SELECT *, abs(value - lag(value) OVER w) AS dv, abs(k - lag(k) OVER w) AS dk, count(*) OVER (PARTITION BY series_id, win_id) AS c
      FROM t WINDOW w AS (PARTITION BY series_id, win_id ORDER BY pos))
SELECT series_id, win_id, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, round(avg(dv), 6) AS value_var1,
  round(avg(k), 6) AS k_mean, round(stddev_pop(k), 6) AS k_std, round(avg(dk), 6) AS k_var1,
  round(avg(value) * avg(value), 4) AS value_mean_sq
FROM d WHERE c = 16 GROUP BY 1, 2
""")
def window_moments(spark, sf):
    rows = wn.tumbling_rows(fx.series(spark, sf), K, "pos", 16)
    out = wn.window_moments(rows, ["series_id", "win_id"], ["value", "k"])
    cols = [f"{c}_{s}" for c in ("value", "k") for s in ("mean", "std", "var1")]
    return out.select("series_id", "win_id", *[r6(F.col(c), c) for c in cols],
                      F.round(F.col("value_mean") * F.col("value_mean"), 4).alias("value_mean_sq"))
