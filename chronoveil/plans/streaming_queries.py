"""Streaming queries: the events table is replayed as a stream and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.plans import fixtures as fx
from chronoveil.plans.mechanism_queries import VALUE_RANGE, grr_sql, release_sql
from chronoveil.plans.registry import query
from chronoveil.session import prepare
from chronoveil.streaming import streams as st

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def event_stream(spark, sf):
    prepare(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", st.ROCKSDB)
    raw = st.replay(spark, sf, EVENT_SCHEMA, "events.parquet")
    return raw.select(F.col("user_id").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value",
                      F.get_json_object("props", "$.k").cast("double").alias("k"), (fx.event_code() + 1).alias("label"))


@query("stream_resample", """
WITH w AS (SELECT user_id AS series_id, epoch_us(ts) // 86400000000 * 86400000000 AS start_us, value, epoch_us(ts) AS t FROM events)
SELECT series_id, start_us, round(avg(value), 6) AS mean, count(*) AS n FROM w
WHERE start_us + 86400000000 <= (SELECT max(t) - 3600000000 FROM w) GROUP BY 1, 2
""")
def stream_resample(spark, sf):
    """Daily means; only windows closed by the watermark are emitted."""
    out = st.run_available(st.resample(event_stream(spark, sf), ["series_id"], "ts", "value", "1 day", "1 hour"), "resample")
    return out.select("series_id", "start_us", F.round("mean", 6).alias("mean"), "n")


@query("stream_resample_filled", """
WITH e AS (SELECT user_id AS series_id, epoch_us(ts) // 21600000000 AS bin, value, epoch_us(ts) // 1000 AS ms FROM events),
m AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS ms FROM events),
b AS (SELECT series_id, bin, avg(value) AS mean FROM e, m WHERE e.ms <= m.ms GROUP BY 1, 2),
grid AS (SELECT series_id, max(bin) AS last, unnest(generate_series(min(bin), max(bin))) AS bin FROM b GROUP BY 1),
f AS (SELECT g.series_id, g.bin, last, last_value(mean IGNORE NULLS) OVER (PARTITION BY g.series_id ORDER BY g.bin) AS mean, mean IS NULL AS filled
  FROM grid g LEFT JOIN b ON g.series_id = b.series_id AND g.bin = b.bin)
SELECT series_id, bin::BIGINT AS bin, round(mean, 6) AS mean, filled FROM f, m WHERE bin < last OR (bin + 1) * 21600000 <= m.ms
""")
def stream_resample_filled(spark, sf):
    """Means of six hours, empty bins filled forward: those closed by the next row or by an hour's watermark."""
    out = st.run_available(st.resample_filled(event_stream(spark, sf), "series_id", "event_id", "ts", "value", 21_600_000, "1 hour"), "filled")
    return out.select("series_id", "bin", F.round("mean", 6).alias("mean"), "filled")


@query("stream_count_windows", f"""
WITH {fx.SERIES_SQL}, t AS (SELECT *, pos // 16 AS win_id FROM series)
SELECT series_id, win_id, round(sum(value * (pos % 16 + 1)), 6) AS x_sum FROM t GROUP BY 1, 2 HAVING count(*) = 16
""")
def stream_count_windows(spark, sf):
    out = st.run_available(st.count_windows(event_stream(spark, sf), "series_id", "event_id", "value", 16), "count-windows")
    total = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return out.select("series_id", "win_id", F.round(total, 6).alias("x_sum"))


PASSED_SQL = """
passed AS (SELECT * REPLACE (row_number() OVER (PARTITION BY series_id ORDER BY t_us, event_id) - 1 AS pos) FROM series
  WHERE t_us // 1000 <= (SELECT max(t_us) // 1000 - 3600000 FROM series))
"""


@query("stream_count_windows_ordered", f"""
WITH {fx.SERIES_SQL}, {PASSED_SQL}, t AS (SELECT *, pos // 16 AS win_id FROM passed)
SELECT series_id, win_id, round(sum(value * (pos % 16 + 1)), 6) AS x_sum FROM t GROUP BY 1, 2 HAVING count(*) = 16
""")
def stream_count_windows_ordered(spark, sf):
    """Windows of what an hour's watermark has passed, whatever the order of arrival."""
    out = st.run_available(st.count_windows(event_stream(spark, sf), "series_id", "event_id", "value", 16, "ts", "1 hour"), "count-windows")
    total = F.aggregate(F.zip_with("x", F.sequence(F.lit(1), F.size("x")), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return out.select("series_id", "win_id", F.round(total, 6).alias("x_sum"))


@query("stream_grr", f"""
WITH lab AS (SELECT event_id, ({fx.CODE_SQL} + 1)::INT AS label FROM events), {grr_sql('1.0::DOUBLE')} SELECT event_id, label, noisy_label FROM grr
""")
def stream_grr(spark, sf):
    noisy = st.randomised_labels(event_stream(spark, sf).select("event_id", "label"), ["event_id"], "label", 1.0, 5, fx.SEED)
    return st.run_available(noisy, "grr").select("event_id", "label", "noisy_label")


@query("stream_change_runs", f"""
WITH {fx.CODED_SQL}, f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY series_id ORDER BY pos) = label THEN 0 ELSE 1 END AS ch FROM coded),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM f),
r AS (SELECT series_id, run, label + 1 AS label, min(pos) AS run_start, max(pos) + 1 AS run_stop FROM g GROUP BY 1, 2, 3)
SELECT series_id, label::INT AS label, run_start, run_stop FROM r QUALIFY run < max(run) OVER (PARTITION BY series_id)
""")
def stream_change_runs(spark, sf):
    """Closed runs; the last run of each series is still open."""
    return st.run_available(st.change_runs(event_stream(spark, sf), "series_id", "event_id", "label"), "runs")


@query("stream_spas", f"""
WITH RECURSIVE {fx.SERIES_SQL}, {release_sql(['seed', 'event_id'], '(VALUES (1.0, 42))')}
SELECT series_id, pos, round(pv[pos + 1], 6) AS value, round(pk[pos + 1], 6) AS k, round(eps[pos + 1], 9) AS eps_used, round(svt[pos + 1], 9) AS svt_used FROM rec
""")
def stream_spas(spark, sf):
    out = st.private_release(event_stream(spark, sf), "series_id", "event_id", "event_id", ["value", "k"], 1.0, VALUE_RANGE,
                             VALUE_RANGE, 20)
    done = st.run_available(out, "spas")
    return done.select("series_id", "pos", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"),
                       F.round("eps_used", 9).alias("eps_used"), F.round("svt_used", 9).alias("svt_used"))


@query("stream_spas_ordered", f"""
WITH RECURSIVE {fx.SERIES_SQL.replace("series AS", "all_series AS")}, series AS (
  SELECT * REPLACE (row_number() OVER (PARTITION BY series_id ORDER BY event_id) - 1 AS pos) FROM all_series
  WHERE t_us // 1000 <= (SELECT max(t_us) // 1000 - 3600000 FROM all_series)), {release_sql(['seed', 'event_id'], '(VALUES (1.0, 42))')}
SELECT series_id, pos, round(pv[pos + 1], 6) AS value, round(pk[pos + 1], 6) AS k, round(eps[pos + 1], 9) AS eps_used, round(svt[pos + 1], 9) AS svt_used FROM rec
""")
def stream_spas_ordered(spark, sf):
    """The release of what an hour's watermark has passed, whatever the order of arrival."""
    out = st.private_release(event_stream(spark, sf), "series_id", "event_id", "event_id", ["value", "k"], 1.0, VALUE_RANGE,
                             VALUE_RANGE, 20, ts="ts", delay="1 hour")
    done = st.run_available(out, "spas-ordered")
    return done.select("series_id", "pos", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"),
                       F.round("eps_used", 9).alias("eps_used"), F.round("svt_used", 9).alias("svt_used"))
