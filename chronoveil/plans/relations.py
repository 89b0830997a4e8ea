"""Sources, sinks, projections, validation and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoveil.operators import checks, clean, geo, relational as rel, split, textscan, windows as wn
from chronoveil.operators.position import ROWS, framed, group_bound, join_sized, spread, with_position
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query
from chronoveil.session import scratch_path
from chronoveil.sources import series as src
from chronoveil.sources import sinks

K = fx.KEYS
HOUR_US = 3_600_000_000


def r6(c, name):
    return F.round(c, 6).alias(name)


# ---- sources -------------------------------------------------------------------------------------------------

@query("scan_series", f"""
WITH {fx.EVENTS_SQL} SELECT event_id, t_us, CASE WHEN event_id % 11 = 0 THEN 0 ELSE value END AS value, k FROM ev
""")
def scan_series(spark, sf):
    raw = fx.events(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan")))
                                          .otherwise(F.col("value")))
    return src.clean_series(raw, "t_us", ["value", "k"], ["event_id"])


@query("scan_pruned", """
SELECT l_orderkey, l_linenumber, l_quantity::FLOAT::DOUBLE AS l_quantity, l_extendedprice::FLOAT::DOUBLE AS l_extendedprice FROM lineitem
""")
def scan_pruned(spark, sf):
    out = src.pruned(fx.read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity"),
                      F.col("l_extendedprice").cast("double").alias("l_extendedprice"))


@query("scan_labelled", f"""
WITH {fx.EVENTS_SQL} SELECT 'events' AS source, event_id AS id, {fx.CODE_SQL} AS label FROM ev
UNION ALL SELECT 'labels', doc_id, quality FROM labels
""")
def scan_labelled(spark, sf):
    ev = fx.events(spark, sf).select(F.lit("events").alias("source"), F.col("event_id").alias("id"),
                                     (fx.event_code() + 1).alias("label"))
    lab = fx.read_table(spark, sf, "labels").select(F.lit("labels").alias("source"), F.col("doc_id").alias("id"),
                                                    F.col("quality").alias("label"))
    return src.labelled(ev, "label").unionByName(src.labelled(lab, "label"))


@query("scan_headerless", """
SELECT count(*) AS n, round(sum(l_quantity), 2) AS c0, round(sum(l_discount), 2) AS c1, round(max(l_tax), 6) AS c2 FROM lineitem
""")
def scan_headerless(spark, sf):
    path = scratch_path(spark, "headerless")
    fx.read_table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax").write.csv(path, header=False)
    df = src.read_headerless(spark, path, 3)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c0"), 2).alias("c0"),
                  F.round(F.sum("c1"), 2).alias("c1"), r6(F.max("c2"), "c2"))


POSITIONS = ["chest", "forearm", "head", "shin", "thigh", "upperarm", "waist"]
POS_SQL = "(['chest','forearm','head','shin','thigh','upperarm','waist'])[(user_id % 7 + 1)::INT]"


def position_name(col="series_id"):
    return F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col(col) % 7 + 1).cast("int"))


@query("scan_files_by_name", f"""
SELECT CASE WHEN event_id % 2 = 0 THEN 'acc' ELSE 'Gyroscope' END AS sensor, event_type AS action, {POS_SQL} AS position,
  count(*) AS n, min(event_id) AS attr_time, round(sum(value), 2) AS attr_x FROM events WHERE event_id % 13 <> 0 GROUP BY 1, 2, 3
""")
def scan_files_by_name(spark, sf):
    """Sensor files are written under the names they are then told apart by; text files beside them are not read."""
    ev = fx.events(spark, sf)
    sensor = F.when(F.col("event_id") % 2 == 0, "acc").otherwise("Gyroscope")
    ext = F.when(F.col("event_id") % 13 == 0, ".txt").otherwise(".csv")
    name = F.concat(F.concat_ws("_", sensor, F.upper("event_type"), position_name()), ext)
    path = scratch_path(spark, "sensor-files")
    sinks.write_named(ev.select(F.col("event_id").alias("attr_time"), F.col("value").alias("attr_x"), name.alias("file")), path, "file")
    schema = T.StructType([T.StructField("attr_time", T.LongType()), T.StructField("attr_x", T.DoubleType())])
    return src.read_sensor_files(spark, [path], schema).groupBy("sensor", "action", "position").agg(
        F.count(F.lit(1)).alias("n"), F.min("attr_time").alias("attr_time"), F.round(F.sum("attr_x"), 2).alias("attr_x"))


@query("label_from_path", f"""
WITH {fx.EVENTS_SQL} SELECT event_id, ({fx.CODE_SQL} + 1)::INT AS activity FROM ev
""")
def label_from_path(spark, sf):
    ev = fx.events(spark, sf)
    path = F.concat(F.lit("/data/Subject"), F.col("series_id"), F.lit("/a"), fx.event_code() + 1, F.lit("t"),
                    F.col("event_id") % 5 + 1, F.lit(".mat"))
    return ev.select("event_id", src.activity_of(path).alias("activity"))


@query("scan_run_json", """
SELECT event_type AS dataset, user_id % 30 + 42 AS seed, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k, count(*) AS n FROM events GROUP BY 1, 2
""")
def scan_run_json(spark, sf):
    """A tree of result folders, each with its configuration and its metrics."""
    ev = fx.events(spark, sf).withColumn("seed", F.col("series_id") % 30 + 42)
    found = ev.groupBy(F.col("event_type").alias("dataset"), "seed").agg(F.avg("k").alias("k"), F.count(F.lit(1)).alias("n"))
    folder = F.concat_ws("/", "dataset", F.concat(F.lit("seed_"), "seed"))
    path = scratch_path(spark, "run-tree")
    documents = found.select(F.explode(F.array(
        F.struct(F.concat(folder, F.lit("/config.json")).alias("file"), F.to_json(F.struct("dataset", "seed")).alias("value")),
        F.struct(F.concat(folder, F.lit("/metrics.json")).alias("file"), F.to_json(F.struct("k", "n")).alias("value")))).alias("d"))
    sinks.write_named(documents.select("d.*"), path, "file", "text")
    config = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("seed", T.LongType())])
    metrics = T.StructType([T.StructField("k", T.DoubleType()), T.StructField("n", T.LongType())])
    runs = src.read_run_json(spark, path, "config.json", config).join(src.read_run_json(spark, path, "metrics.json", metrics), "run_dir")
    return runs.select("dataset", "seed", r6(F.col("k"), "k"), "n")


@query("scan_sidecar_bounds", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) n FROM series GROUP BY 1)
SELECT series_id, 'train' AS split, 'a' AS sequence_id, 0 AS start, n // 2 AS stop FROM n
UNION ALL SELECT series_id, 'train', 'b', n // 2, n FROM n
UNION ALL SELECT series_id, 'test', 'c', 0, n FROM n
""")
def scan_sidecar_bounds(spark, sf):
    n = fx.events(spark, sf).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    half = F.floor(F.col("n") / 2)

    def item(name, a, b):
        return F.struct(F.lit(name).alias("sequence_id"), a.cast("bigint").alias("start"), b.alias("stop"))

    doc = F.to_json(F.struct(F.lit(1).alias("version"), F.struct(
        F.array(item("a", F.lit(0), half), item("b", half, F.col("n"))).alias("train"),
        F.array(item("c", F.lit(0), F.col("n"))).alias("test")).alias("splits")))
    return src.explode_bounds(n.withColumn("doc", doc), "doc", ["series_id"])


def split_events(spark, sf):
    return split.split_ratio(fx.series(spark, sf), K, "pos").select("series_id", "pos", "value", "event_type", "split")


SPLIT_COUNT_SQL = f"""
WITH {fx.SERIES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series),
sp AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train'
   WHEN pos < n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)
SELECT split, count(*) AS rows, round(sum(value), 2) AS total FROM sp GROUP BY 1
"""


def split_counts(df):
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query("sink_split_csv", SPLIT_COUNT_SQL)
def sink_split_csv(spark, sf):
    path = scratch_path(spark, "split-csv")
    sinks.write_splits(split_events(spark, sf), path)
    back = spark.read.schema("series_id BIGINT, pos BIGINT, value DOUBLE, event_type STRING, split STRING").option(
        "header", True).csv(path)
    return split_counts(back)


@query("sink_per_key", """
SELECT year(o_orderdate)::INT AS year, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def sink_per_key(spark, sf):
    path = scratch_path(spark, "per-year")
    orders = fx.read_table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    sinks.write_per_key(orders, path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"),
                                                        F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("sink_cache", SPLIT_COUNT_SQL)
def sink_cache(spark, sf):
    path = scratch_path(spark, "cache")
    sinks.cache_splits(split_events(spark, sf), path, "split", "events")
    return split_counts(sinks.load_cached(spark, path, "split", "events"))


@query("sink_cache_series", f"""
WITH {fx.SERIES_SQL} SELECT series_id, pos, round(avg(value) OVER w, 6) AS mean, value - lag(value) OVER o AS step FROM series
WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), o AS (PARTITION BY series_id ORDER BY pos)
""")
def sink_cache_series(spark, sf):
    """Frames over a stored series: its buckets and its longest series are known, so nothing is counted or shuffled again."""
    path = scratch_path(spark, "series-cache")
    sinks.cache_series(fx.series(spark, sf).select("series_id", "pos", "value"), path, f"series_{path.rsplit('-', 1)[-1]}", K, "pos", 8)
    frames = {"mean": lambda w: F.avg("value").over(w.rowsBetween(-4, 0)), "step": lambda w: F.col("value") - F.lag("value").over(w)}
    out = framed(sinks.load_series(spark, path), K, "pos", 4, 0, frames)
    return out.select("series_id", "pos", r6(F.col("mean"), "mean"), "step")


@query("table_identity", """
WITH t AS (SELECT o_orderkey AS i, [o_orderkey::VARCHAR, CASE WHEN o_custkey % 7 > 0 THEN o_custkey::VARCHAR END, o_orderstatus, o_orderpriority,
   round(o_totalprice * 100)::BIGINT::VARCHAR] AS v FROM orders),
r AS (SELECT i, sha256(array_to_string(list_transform(v, lambda x: CASE WHEN x IS NULL THEN 'n' ELSE length(x) || ':' || x END), '')) AS h FROM t),
a AS (SELECT i // 256 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM r GROUP BY 1),
b AS (SELECT i // 256 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM a GROUP BY 1),
c AS (SELECT i // 256 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM b GROUP BY 1)
SELECT sha256('10:o_orderkey6:bigint9:o_custkey6:bigint13:o_orderstatus6:string15:o_orderpriority6:string5:cents6:bigint' || (SELECT count(*) FROM orders)
  || ':' || sha256(string_agg(h, '' ORDER BY i))) AS identity FROM c
""")
def table_identity(spark, sf):
    orders = fx.read_table(spark, sf, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    orders = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")))
    return sinks.table_identity(orders, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "cents"],
                                fanout=256, levels=3)


# ---- projections and validation ------------------------------------------------------------------------------

@query("select_reorder", """
SELECT epoch(o_orderdate)::BIGINT AS date, o_orderkey, o_custkey, o_totalprice AS target FROM orders
""")
def select_reorder(spark, sf):
    orders = fx.read_table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("target"), "o_orderkey", "o_custkey", F.unix_seconds("o_orderdate").alias("date"))
    rest = [c for c in orders.columns if c not in ("date", "target")]
    return orders.select("date", *rest, "target")


@query("feature_mode", """
SELECT 'S' AS mode, 'input' AS role, 'o_totalprice' AS channel, round(sum(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'S', 'output', 'o_totalprice', round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'M', r, 'o_totalprice', round(sum(o_totalprice), 2) FROM orders, (VALUES ('input'), ('output')) t(r) GROUP BY 2
UNION ALL SELECT 'M', r, 'o_custkey', sum(o_custkey)::DOUBLE FROM orders, (VALUES ('input'), ('output')) t(r) GROUP BY 2
UNION ALL SELECT 'MS', 'input', 'o_totalprice', round(sum(o_totalprice), 2) FROM orders
UNION ALL SELECT 'MS', 'input', 'o_custkey', sum(o_custkey)::DOUBLE FROM orders
UNION ALL SELECT 'MS', 'output', 'o_totalprice', round(sum(o_totalprice), 2) FROM orders
""")
def feature_mode(spark, sf):
    cols = ["o_totalprice", "o_custkey"]
    orders = fx.read_table(spark, sf, "orders").select(*[F.col(c).cast("double").alias(c) for c in cols])
    sums = clean.long_channels(orders.agg(*[F.round(F.sum(c), 2).alias(c) for c in cols]), [], cols)
    wanted = []
    for mode in ("S", "M", "MS"):
        for role, names in zip(("input", "output"), checks.feature_mode(cols, "o_totalprice", mode)):
            wanted.append(F.struct(F.lit(mode).alias("mode"), F.lit(role).alias("role"),
                                   F.array(*[F.lit(n) for n in names]).alias("names")))
    picked = sums.withColumn("w", F.explode(F.array(*wanted))).filter(F.array_contains("w.names", F.col("channel")))
    return picked.select("w.mode", "w.role", "channel", F.col("value").alias("total"))


@query("rename_by_sensor", f"""
SELECT CASE WHEN event_id % 2 = 0 THEN 'acc' ELSE 'gyro' END || '_' || {POS_SQL} || '_' || axis AS channel,
  count(*) AS n, round(sum(CASE axis WHEN 'x' THEN value ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END), 2) AS total
FROM events, (VALUES ('x'), ('y')) t(axis) GROUP BY 1
""")
def rename_by_sensor(spark, sf):
    ev = fx.events(spark, sf).withColumnsRenamed({"value": "x", "k": "y"})
    long = clean.long_channels(ev, ["series_id", "event_id"], ["x", "y"])
    sensor = F.when(F.col("event_id") % 2 == 0, "acc").otherwise("gyro")
    name = F.concat_ws("_", sensor, position_name(), F.col("channel"))
    return long.groupBy(name.alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("filter_unit_columns", """
SELECT 'l_discount' AS channel, 0 AS rank, round(sum(l_discount), 2) AS total FROM lineitem
UNION ALL SELECT 'l_tax', 1, round(sum(l_tax), 2) FROM lineitem
""")
def filter_unit_columns(spark, sf):
    line = fx.read_table(spark, sf, "lineitem")
    cols = checks.unit_columns(line.columns, ["l_dis", "l_tax"])
    sums = line.agg(*[F.round(F.sum(c), 2).alias(c) for c in cols])
    rank = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("channel")) - 1
    return clean.long_channels(sums, [], cols).select("channel", rank.cast("int").alias("rank"), F.col("value").alias("total"))


@query("parse_id_ranges", """
SELECT DISTINCT c_custkey, id FROM (
  SELECT c_custkey, c_custkey % 50 AS id FROM customer
  UNION ALL SELECT c_custkey, unnest(generate_series(c_custkey % 20, c_custkey % 20 + c_nationkey % 5)) FROM customer)
""")
def parse_id_ranges(spark, sf):
    key = F.col("c_custkey")
    text = F.concat(key % 50, F.lit(", "), key % 20, F.lit("-"), key % 20 + F.col("c_nationkey") % 5, F.lit(",x,,7-y"))
    cust = fx.read_table(spark, sf, "customer").select("c_custkey", text.alias("text"))
    return cust.select("c_custkey", F.explode(checks.id_ranges(F.col("text"))).alias("id"))


@query("detect_time_column", """
SELECT 'ts' AS time_column, count(*) AS n, epoch(min(ts))::BIGINT AS first_s, epoch(max(ts))::BIGINT AS last_s FROM events
""")
def detect_time_column(spark, sf):
    ev = fx.read_table(spark, sf, "events")
    t = checks.time_column(ev.columns)
    return ev.agg(F.lit(t).alias("time_column"), F.count(F.lit(1)).alias("n"),
                  F.unix_seconds(F.min(t)).alias("first_s"), F.unix_seconds(F.max(t)).alias("last_s"))


@query("detect_time_unit", f"""
WITH {fx.EVENTS_SQL}, raw AS (SELECT event_id, series_id, CASE series_id % 4 WHEN 0 THEN t_us WHEN 1 THEN t_us // 1000
  WHEN 2 THEN t_us // 1000000 ELSE t_us // 1000000000000 END AS t FROM ev),
f AS (SELECT series_id, arg_min(t, event_id) AS t0 FROM raw GROUP BY 1)
SELECT event_id, CASE WHEN t0 > 1e15 THEN 'us' WHEN t0 > 1e12 THEN 'ms' WHEN t0 > 1e9 THEN 's' ELSE 'ms' END AS unit,
 CASE WHEN t0 > 1e15 THEN t // 1000 WHEN t0 > 1e12 THEN t WHEN t0 > 1e9 THEN t * 1000 ELSE t END AS ms FROM raw JOIN f USING (series_id)
""")
def detect_time_unit(spark, sf):
    t = F.col("t_us")
    case = F.col("series_id") % 4
    raw = fx.events(spark, sf).select("event_id", "series_id", F.when(case == 0, t).when(case == 1, F.floor(t / 1000))
                                      .when(case == 2, F.floor(t / 1e6)).otherwise(F.floor(t / 1e12)).alias("t"))
    first = clean.group_stats(raw, K, {"t0": F.min_by("t", "event_id")})
    unit, ms = checks.time_unit_ms(F.col("t0"), F.col("t"))
    return first.select("event_id", unit.alias("unit"), ms.alias("ms"))


@query("parse_ts_strict", "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def parse_ts_strict(spark, sf):
    ev = fx.read_table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return ev.select("event_id", F.unix_seconds(checks.strict_timestamp(F.col("text"))).alias("seconds"))


@query("to_numeric_coerce", """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events
""")
def to_numeric_coerce(spark, sf):
    ev = fx.read_table(spark, sf, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return ev.select("event_id", checks.to_numeric(text).alias("k"))


# Fixed encoding used by the label queries; one event type is left out on purpose.
LABEL_CODES = {"click": 1, "error": 2, "purchase": 3, "signup": 4}


@query("drop_unmapped", """
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS label
FROM events WHERE event_type <> 'view'
""")
def drop_unmapped(spark, sf):
    codes = F.create_map(*[x for k, v in LABEL_CODES.items() for x in (F.lit(k), F.lit(v))])
    ev = fx.read_table(spark, sf, "events")
    return ev.select("event_id", F.try_element_at(codes, F.col("event_type")).alias("label")).filter("label IS NOT NULL")


@query("dup_report", """
SELECT c_custkey, c_nationkey, c_mktsegment FROM customer
QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1
""")
def dup_report(spark, sf):
    cust = fx.read_table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return rel.duplicate_report(cust, ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("dedup_keep_first", f"""
WITH {fx.EVENTS_SQL} SELECT t_us // {HOUR_US} AS hour, event_id, value FROM ev
QUALIFY row_number() OVER (PARTITION BY t_us // {HOUR_US} ORDER BY event_id) = 1
""")
def dedup_keep_first(spark, sf):
    ev = fx.events(spark, sf).select(F.floor(F.col("t_us") / HOUR_US).alias("hour"), "event_id", "value")
    return rel.dedup_first(ev, ["hour"], "event_id")


@query("check_tiling", f"""
WITH {fx.CODED_SQL}, f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY series_id ORDER BY pos) = label THEN 0 ELSE 1 END AS ch FROM coded),
g AS (SELECT *, sum(ch) OVER (PARTITION BY series_id ORDER BY pos) AS run FROM f),
r AS (SELECT series_id, run, min(pos) AS a, max(pos) + 1 AS b FROM g GROUP BY 1, 2),
b AS (SELECT series_id, CASE WHEN series_id % 17 = 0 AND a > 0 THEN a + 1 ELSE a END AS a, b FROM r WHERE NOT (series_id % 19 = 0 AND a = 0)),
l AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY series_id ORDER BY a), 0) AS prev FROM b),
n AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1)
SELECT series_id, bool_and(prev = a) AND bool_and(a < b) AND max(b) = max(n) AS ok, max(b) AS covered, max(n) AS n
FROM l JOIN n USING (series_id) GROUP BY 1
""")
def check_tiling(spark, sf):
    coded = fx.coded_series(spark, sf)
    runs = wn.label_runs(coded, K, "pos", "label")
    bent = (runs.filter(~((F.col("series_id") % 19 == 0) & (F.col("run_start") == 0)))
            .withColumn("name", F.col("run_stop"))
            .withColumn("run_start", F.when((F.col("series_id") % 17 == 0) & (F.col("run_start") > 0),
                                            F.col("run_start") + 1).otherwise(F.col("run_start"))))
    rows = coded.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    return checks.tiling(bent, K, "run_start", "run_stop", "name", rows).select("series_id", "ok", "covered", "n")


@query("check_monotonic", f"""
WITH {fx.SERIES_SQL}, g AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN value END AS value) FROM series),
d AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM g)
SELECT series_id, coalesce(min(d) > 0, true) AS increasing, round(quantile_cont(d::DOUBLE, 0.5), 1) AS median_step,
  abs(quantile_cont(d::DOUBLE, 0.5) - 25200000000) <= 3600000000 AS step_ok, count_if(value IS NULL)::BIGINT AS null_value FROM d GROUP BY 1
""")
def check_monotonic(spark, sf):
    out = checks.monotonic(fx.gappy_series(spark, sf), K, "pos", "t_us", 7 * HOUR_US, HOUR_US, ["value"])
    return out.select("series_id", "increasing", F.round("median_step", 1).alias("median_step"), "step_ok", "null_value")


@query("check_aligned", f"""
WITH {fx.SERIES_SQL}, r AS (SELECT series_id, pos, CASE WHEN event_id % 50 = 0 THEN t_us + 1 ELSE t_us END AS t FROM series WHERE event_id % 97 <> 0)
SELECT coalesce(s.series_id, r.series_id) AS series_id, count(s.t_us) AS left_rows, count(r.t) AS right_rows,
  count_if(s.t_us IS DISTINCT FROM r.t)::BIGINT AS mismatches FROM series s FULL JOIN r ON s.series_id = r.series_id AND s.pos = r.pos GROUP BY 1
""")
def check_aligned(spark, sf):
    s = fx.series(spark, sf).select("series_id", "pos", "t_us", "event_id")
    moved = s.filter(F.col("event_id") % 97 != 0).withColumn(
        "t_us", F.when(F.col("event_id") % 50 == 0, F.col("t_us") + 1).otherwise(F.col("t_us")))
    return checks.aligned(s, moved, K, "pos", "t_us")


@query("check_binary_labels", """
SELECT doc_id % 5 AS part, count_if(toxic NOT IN (0, 1) OR toxic IS NULL)::BIGINT AS invalid, count(DISTINCT toxic) AS classes,
  count_if(toxic NOT IN (0, 1)) = 0 AND count(DISTINCT toxic) = 2 AS ok FROM labels GROUP BY 1
""")
def check_binary_labels(spark, sf):
    lab = fx.read_table(spark, sf, "labels").select((F.col("doc_id") % 5).alias("part"), "toxic")
    return checks.binary_labels(lab, ["part"], "toxic")


@query("check_unseen_classes", """
SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'
EXCEPT SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'
""")
def check_unseen_classes(spark, sf):
    orders = fx.read_table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    return rel.unseen_classes(orders.filter(F.col("o_orderdate") < cut), orders.filter(F.col("o_orderdate") >= cut), "o_custkey")


@query("require_all_labels", """
WITH h AS (SELECT user_id * 100 + day(ts) // 8 AS unit, list(DISTINCT event_type) AS h FROM events GROUP BY 1)
SELECT unit, len(h) = 5 AS complete, array_to_string(list_sort(list_filter(['click','error','purchase','signup','view'],
   lambda x: NOT list_contains(h, x))), ',') AS missing FROM h
""")
def require_all_labels(spark, sf):
    ev = fx.events(spark, sf).select((F.col("series_id") * 100 + F.floor(F.dayofmonth("ts") / 8)).alias("unit"), "event_type")
    return rel.both_sides(ev, ["unit"], "event_type", fx.EVENT_TYPES)


@query("check_finite_runs", """
SELECT event_type, count(*) AS runs, count_if(event_id % 9 = 0 OR event_id % 10 = 0)::BIGINT AS bad FROM events GROUP BY 1
""")
def check_finite_runs(spark, sf):
    ev = fx.read_table(spark, sf, "events")
    text = (F.when(F.col("event_id") % 9 == 0, "nan").when(F.col("event_id") % 10 == 0, "Infinity")
            .otherwise(F.col("value").cast("string")))
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"),
                                        F.count_if(checks.is_bad_number(checks.to_numeric(text))).alias("bad"))


TEXT_PATTERNS = {"license": r"(?i)licen[cs]e", "email": r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", "number": r"[0-9]{4,}"}


NOISE_NAMES = {name: name.replace(".", "_") for name in textscan.NOISE_PATTERNS}
NOISE_FLAGS = ",\n".join(f"  regexp_matches(text, '{p}') AS {NOISE_NAMES[n]}" for n, p in textscan.NOISE_PATTERNS.items())
NOISE_COUNTS = ",\n".join(f"  count_if({n})::BIGINT AS {n}" for n in NOISE_NAMES.values())


@query("pattern_scan", r"""
WITH f AS (SELECT lang, regexp_matches(text, '(?i)licen[cs]e') AS license, regexp_matches(text, '[a-z0-9.]+@[a-z0-9]+\.[a-z]+') AS email,
  regexp_matches(text, '[0-9]{4,}') AS number,
FLAGS,
  CASE WHEN regexp_matches(text, 'token\s*=\s*"([0-9a-f]+)"') THEN regexp_extract(text, 'token\s*=\s*"([0-9a-f]+)"', 1) END AS formula
  FROM documents)
SELECT lang, count(*) AS files, count_if(license)::BIGINT AS license, count_if(email)::BIGINT AS email, count_if(number)::BIGINT AS number,
COUNTS, count(formula) AS formulas,
  count_if(coalesce(contains(formula, '00') OR contains(formula, 'ff'), false))::BIGINT AS doubled,
  count_if(coalesce(contains(formula, 'a') AND contains(formula, '7') AND NOT contains(formula, '00') AND NOT contains(formula, 'ff'), false))::BIGINT AS plain
FROM f GROUP BY 1
""".replace("FLAGS", NOISE_FLAGS).replace("COUNTS", NOISE_COUNTS))
def pattern_scan(spark, sf):
    docs = fx.read_table(spark, sf, "documents").select("lang", "text")
    noise = {NOISE_NAMES[n]: p for n, p in textscan.NOISE_PATTERNS.items()}
    flags = textscan.flag_patterns(docs, "text", {**TEXT_PATTERNS, **noise})
    kinds = textscan.classify_formula(flags, "text", r'token\s*=\s*"([0-9a-f]+)"', ["00", "ff"], ["a", "7"])
    kinds = kinds.withColumns({"formulas": F.col("formula").isNotNull(), "doubled": F.col("kind").eqNullSafe("doubled"),
                               "plain": F.col("kind").eqNullSafe("plain")})
    return textscan.summarise_flags(kinds, ["lang"], [*TEXT_PATTERNS, *noise, "formulas", "doubled", "plain"])


# ---- joins, unions, sorts ------------------------------------------------------------------------------------

@query("overlap_range", f"""
WITH {fx.EVENTS_SQL}, p AS (SELECT series_id, event_id % 2 AS sensor, min(t_us) lo, max(t_us) hi FROM ev GROUP BY 1, 2)
SELECT series_id, max(lo) AS t_start, min(hi) AS t_end FROM p GROUP BY 1 HAVING min(hi) > max(lo)
""")
def overlap_range(spark, sf):
    ev = fx.events(spark, sf).withColumn("sensor", F.col("event_id") % 2)
    return rel.common_range(ev, K, ["sensor"], "t_us")


@query("both_sides_required", f"""
WITH e AS (SELECT user_id // 10 AS unit, event_type AS action, {POS_SQL} AS position, CASE WHEN event_id % 5 = 0 THEN 'acc' ELSE 'Gyroscope' END AS sensor, value FROM events),
c AS (SELECT unit, action, position FROM e GROUP BY 1, 2, 3 HAVING count(DISTINCT sensor) = 2)
SELECT e.unit, e.action, e.position, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN c USING (unit, action, position) GROUP BY 1, 2, 3
""")
def both_sides_required(spark, sf):
    ev = fx.events(spark, sf).select(
        F.floor(F.col("series_id") / 10).alias("unit"), F.col("event_type").alias("action"),
        position_name().alias("position"), F.when(F.col("event_id") % 5 == 0, "acc").otherwise("Gyroscope").alias("sensor"), "value")
    keys = ["unit", "action", "position"]
    kept = rel.keep_complete(ev, keys, "sensor", ["acc", "Gyroscope"])
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("align_positions", f"""
WITH {fx.EVENTS_SQL},
rng AS (SELECT series_id, event_type, min(t_us) lo, max(t_us) hi FROM ev GROUP BY 1, 2),
com AS (SELECT series_id, max(lo) lo, min(hi) hi FROM rng GROUP BY 1 HAVING min(hi) > max(lo)),
grid AS (SELECT series_id, unnest(generate_series(lo, hi, {6 * HOUR_US})) AS grid FROM com),
full_grid AS (SELECT g.series_id, r.event_type, g.grid FROM grid g JOIN rng r USING (series_id)),
p AS (SELECT g.*, a.t_us t0, a.value v0 FROM full_grid g ASOF JOIN ev a
      ON g.series_id = a.series_id AND g.event_type = a.event_type AND g.grid >= a.t_us),
n AS (SELECT p.*, b.t_us t1, b.value v1 FROM p ASOF JOIN ev b
      ON p.series_id = b.series_id AND p.event_type = b.event_type AND p.grid <= b.t_us),
l AS (SELECT series_id, grid, event_type, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((grid - t0) / (t1 - t0)::DOUBLE) END, 6) AS v FROM n)
SELECT series_id, grid::BIGINT AS grid, max(v) FILTER (event_type = 'click') AS click, max(v) FILTER (event_type = 'error') AS error,
  max(v) FILTER (event_type = 'purchase') AS purchase, max(v) FILTER (event_type = 'signup') AS signup, max(v) FILTER (event_type = 'view') AS "view"
FROM l GROUP BY 1, 2
""")
def align_positions(spark, sf):
    ev = fx.events(spark, sf)
    rng = rel.common_range(ev, K, ["event_type"], "t_us")
    sensor = ["series_id", "event_type"]
    placed = with_position(ev.select(*sensor, "t_us", "event_id", "value"), sensor, "t_us", ["event_id"])
    # Neighbours, bins and channels of a series all meet where its rows are.
    ranged = spread(join_sized(placed, rng, K, group_bound(placed, K)), K, placed.schema["pos"].metadata[ROWS])
    grid = clean.regrid(ranged, sensor, "pos", "t_us", ["value"], 6 * HOUR_US, "t_start", "t_start", "t_end")
    wide = rel.align_columns(grid, ["series_id", "grid"], "event_type", "value", fx.EVENT_TYPES)
    return wide.select("series_id", "grid", *[r6(F.col(c), c) for c in fx.EVENT_TYPES])


POINTS_SQL = """
pts AS (SELECT c_custkey AS id, 32 + (c_custkey * 37 % 1000) / 100::DOUBLE AS lat, -124 + (c_custkey * 91 % 1000) / 100::DOUBLE AS lng FROM customer)
"""
MILES_SQL = """(2 * 3958.8::DOUBLE * atan2(sqrt({h}), sqrt(1.0::DOUBLE - ({h}))))"""
HAV_SQL = ("(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * "
           "pow(sin((radians({b}.lng) - radians({a}.lng)) / 2), 2))")


def miles_sql(a, b):
    return MILES_SQL.format(h=HAV_SQL.format(a=a, b=b))


def points(spark, sf):
    key = F.col("c_custkey")
    return fx.read_table(spark, sf, "customer").select(
        key.alias("id"), (F.lit(32.0) + (key * 37 % 1000) / F.lit(100.0)).alias("lat"),
        (F.lit(-124.0) + (key * 91 % 1000) / F.lit(100.0)).alias("lng"))


@query("geo_range_join", f"""
WITH {POINTS_SQL}
SELECT a.id AS id_a, b.id AS id_b, round({miles_sql('a', 'b')}, 6) AS miles FROM pts a JOIN pts b ON a.id < b.id
  AND abs(a.lat - b.lat) < 0.1 WHERE {miles_sql('a', 'b')} < 5
""")
def geo_range_join(spark, sf):
    return geo.close_pairs(points(spark, sf), 5.0).select("id_a", "id_b", r6(F.col("miles"), "miles"))


@query("greedy_separated", f"""
WITH RECURSIVE {POINTS_SQL},
ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM pts),
conf AS MATERIALIZED (SELECT b.rn AS rn, list(a.rn) AS earlier FROM ord a JOIN ord b ON a.rn < b.rn AND abs(a.lat - b.lat) < 0.3
         WHERE {miles_sql('a', 'b')} < 20 GROUP BY 1),
scan AS (SELECT 1::BIGINT AS rn, [1::BIGINT] AS kept
  UNION ALL
  SELECT s.rn + 1, CASE WHEN c.rn IS NULL OR NOT list_has_any(c.earlier, s.kept) THEN list_append(s.kept, s.rn + 1) ELSE s.kept END
  FROM scan s LEFT JOIN conf c ON c.rn = s.rn + 1 WHERE s.rn < (SELECT count(*) FROM ord))
SELECT o.id FROM ord o JOIN (SELECT unnest(kept) AS rn FROM scan WHERE rn = (SELECT count(*) FROM ord)) k USING (rn)
""")
def greedy_separated(spark, sf):
    return geo.separated_subset(points(spark, sf), 20.0)


@query("submatrix", """
WITH e AS (SELECT l_suppkey AS src, l_partkey % 100 AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
n AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
SELECT src, dst, w FROM e WHERE src IN (SELECT s_suppkey FROM n) AND dst IN (SELECT s_suppkey FROM n)
""")
def submatrix(spark, sf):
    edges = (fx.read_table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst"))
             .agg(F.sum("l_quantity").alias("w")))
    nodes = fx.read_table(spark, sf, "supplier").filter(F.col("s_acctbal") > 0)
    return rel.submatrix(edges, nodes, "s_suppkey").select("src", "dst", "w")


@query("align_columns_union", """
SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS acctbal, 0.0::DOUBLE AS retailprice FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, 0.0 FROM supplier
UNION ALL SELECT 'part', p_partkey, 0.0, p_retailprice FROM part
""")
def align_columns_union(spark, sf):
    c = fx.read_table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"))
    s = fx.read_table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"))
    p = fx.read_table(spark, sf, "part").select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("retailprice"))
    return rel.union_fill([c, s, p])


@query("concat_ordered", f"""
WITH {fx.SERIES_SQL} SELECT series_id, pos, row_number() OVER (ORDER BY series_id, pos) - 1 AS pool_pos FROM series
""")
def concat_ordered(spark, sf):
    return split.pooled_position(fx.series(spark, sf), K, "pos").select("series_id", "pos", "pool_pos")


@query("concat_years", """
SELECT o_orderkey, year(o_orderdate)::INT AS year, o_totalprice FROM orders
""")
def concat_years(spark, sf):
    orders = fx.read_table(spark, sf, "orders")
    first, last = orders.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    years = [orders.filter((F.col("o_orderdate") >= F.lit(f"{y}-01-01").cast("timestamp"))
                           & (F.col("o_orderdate") < F.lit(f"{y + 1}-01-01").cast("timestamp")))
             .select("o_orderkey", F.lit(y).alias("year"), "o_totalprice") for y in range(first, last + 1)]
    return rel.union_fill(years, fill=None)


@query("sweep_grid", """
SELECT s_name AS dataset, model, method, epsilon::DOUBLE AS epsilon, seed::INT AS seed FROM supplier,
 (VALUES ('patch'), ('linear')) a(model), (VALUES ('poisson'), ('spaced'), ('structured')) b(method),
 (VALUES (0.5), (1.0), (2.0), (4.0), (8.0)) c(epsilon), (SELECT unnest(generate_series(42, 51)) AS seed) d
""")
def sweep_grid(spark, sf):
    base = fx.read_table(spark, sf, "supplier").select(F.col("s_name").alias("dataset"))
    return rel.sweep(base, {"model": ["patch", "linear"], "method": ["poisson", "spaced", "structured"],
                            "epsilon": [0.5, 1.0, 2.0, 4.0, 8.0], "seed": list(range(42, 52))})


@query("top_range_dims", """
WITH e AS (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT d::INT AS d, round(max(x) - min(x), 9) AS span FROM e GROUP BY 1 ORDER BY max(x) - min(x) DESC, d LIMIT 5
""")
def top_range_dims(spark, sf):
    dims = fx.vectors(spark, sf).select(F.posexplode("v").alias("d", "x"))
    spans = dims.groupBy("d").agg((F.max("x") - F.min("x")).alias("s"))
    return spans.orderBy(F.desc("s"), "d").limit(5).select("d", F.round("s", 9).alias("span"))
