"""Nulls, NaN, spikes, long frames and short series, on the plain path and on the path of long series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from chronoveil.operators import anomaly, checks, clean, forecast, relational, runs, split, windows
from chronoveil.operators import sampling as sp
from chronoveil.operators.position import BLOCK_ROWS, carry, block_of, framed, running_sum, series_stats, trailing_scratch, trailing_sum, with_position
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query
from chronoveil.plans.sampling_queries import BATCH, L, R, hits_sql

K = fx.KEYS
# Every operator runs with its own block size and with blocks of a few rows, where every series is a long one.
PATHS = {"plain": BLOCK_ROWS, "blocks": 16}


def both_paths(build):
    parts = [build(rows).withColumn("path", F.lit(name)) for name, rows in PATHS.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def spiky(spark, sf, rows):
    """A value of 1e16 and a NaN now and then."""
    x = F.when(F.col("event_id") % 211 == 5, F.lit(1e16)).when(F.col("event_id") % 307 == 7, F.lit(float("nan"))).otherwise(F.col("value"))
    return with_position(fx.events(spark, sf), K, "t_us", ["event_id"], block_rows=rows).select("series_id", "event_id", "pos", x.alias("x"))


SPIKY_SQL = fx.SERIES_SQL + """,
spiky AS (SELECT series_id, event_id, pos, CASE WHEN event_id % 211 = 5 THEN 1e16::DOUBLE WHEN event_id % 307 = 7 THEN 'nan'::DOUBLE ELSE value END AS x FROM series),
paths AS (SELECT unnest(['plain', 'blocks']) AS path)
"""
FRAMES = (3, 64, 65, 70)


def frame_sql(rows: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY pos ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    total = f"sum(CASE WHEN isnan(x) THEN 0 ELSE x END) OVER {frame}"
    return (f"CASE WHEN count(CASE WHEN isnan(x) THEN 1 END) OVER {frame} = 0 THEN {total} END AS s{rows}")


@query("trailing_sum_spikes", f"""
WITH {SPIKY_SQL}
SELECT path, f.* FROM (SELECT event_id, {', '.join(frame_sql(r) for r in FRAMES)} FROM spiky) f, paths
""")
def trailing_sum_spikes(spark, sf):
    def build(rows):
        out = spiky(spark, sf, rows)
        for frame in FRAMES:
            out = framed(out, K, "pos", frame, 0, trailing_sum(f"s{frame}", F.col("x"), frame), rows).drop(*trailing_scratch(f"s{frame}"))
        return out.select("event_id", *[F.when(~F.isnan(f"s{r}"), F.col(f"s{r}")).alias(f"s{r}") for r in FRAMES])
    return both_paths(build)


@query("score_timestamps_blocks", f"""
WITH {fx.SERIES_SQL}, paths AS (SELECT unnest(['plain', 'blocks']) AS path), sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series),
w AS (SELECT a.series_id, a.pos AS win_id, avg(b.value) AS m FROM sized a JOIN sized b ON a.series_id = b.series_id AND b.pos >= a.pos AND b.pos < a.pos + 40
  WHERE a.pos + 40 <= a.n GROUP BY 1, 2)
SELECT path, s.series_id, s.pos, round(avg((s.value - m) ^ 2), 3) AS score, count(*) AS windows FROM sized s JOIN w ON w.series_id = s.series_id
  AND s.pos >= w.win_id AND s.pos < w.win_id + 40, paths GROUP BY 1, 2, 3
""")
def score_timestamps_blocks(spark, sf):
    def build(rows):
        series = with_position(fx.events(spark, sf), K, "t_us", ["event_id"], block_rows=rows)
        out = anomaly.window_mean_scores(series, K, "pos", ["value"], 40, rows)
        return out.select("series_id", "pos", F.round("score", 3).alias("score"), "windows")
    return both_paths(build)


def keyed(spark, sf):
    """Events whose key is missing for a tenth of the users, and a value that is missing on every 11th."""
    return fx.events(spark, sf).select(
        F.when(F.col("series_id") % 10 != 0, F.col("series_id")).alias("series_id"), "t_us", "event_id",
        F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"))


KEYED_SQL = fx.EVENTS_SQL + """,
keyed AS (SELECT CASE WHEN series_id % 10 <> 0 THEN series_id END AS series_id, t_us, event_id, CASE WHEN event_id % 11 <> 0 THEN value END AS value FROM ev),
paths AS (SELECT unnest(['plain', 'blocks']) AS path)
"""


@query("null_key_positions", f"""
WITH {KEYED_SQL}, p AS (SELECT *, row_number() OVER w - 1 AS pos, sum(value) OVER w AS total, max(event_id) OVER (PARTITION BY series_id) AS last_id,
  last_value(value IGNORE NULLS) OVER w AS filled FROM keyed WINDOW w AS (PARTITION BY series_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING))
SELECT path, event_id, pos, round(total, 4) AS total, last_id, filled FROM p, paths
""")
def null_key_positions(spark, sf):
    def build(rows):
        placed = with_position(keyed(spark, sf), K, "t_us", ["event_id"], block_rows=rows)
        block = block_of(placed, K, "pos", rows)
        out = series_stats(placed, K, "pos", {"last_id": F.max("event_id")}, rows)
        out = running_sum(out, K, ["pos"], block, {"total": F.col("value")})
        out = carry(out, K, "pos", block, {"filled": F.col("value")})
        return out.select("event_id", "pos", F.round("total", 4).alias("total"), "last_id", "filled")
    return both_paths(build)


@query("null_key_zscore", f"""
WITH {KEYED_SQL} SELECT event_id, round(coalesce((value - avg(value) OVER w) / stddev_pop(value) OVER w, 0), 6) AS z
FROM keyed WINDOW w AS (PARTITION BY series_id)
""")
def null_key_zscore(spark, sf):
    out = clean.zscore(keyed(spark, sf), K, ["value"])
    return out.select("event_id", F.round("value_z", 6).alias("z"))


@query("null_key_duplicates", f"""
WITH {KEYED_SQL}, r AS (SELECT series_id, event_id // 3 AS step, event_id % 2 AS side FROM keyed),
n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY step, side) AS rn FROM r)
SELECT series_id, step, side FROM n WHERE rn > 1
""")
def null_key_duplicates(spark, sf):
    rows = keyed(spark, sf).select("series_id", F.floor(F.col("event_id") / 3).cast("bigint").alias("step"), (F.col("event_id") % 2).alias("side"))
    return relational.duplicate_report(rows, K, "step")


@query("sides_of_every_group", f"""
WITH {KEYED_SQL}, r AS (SELECT series_id, CASE WHEN coalesce(series_id, 1) % 3 = 1 OR event_id % 2 = 0 THEN event_id % 2 END AS side FROM keyed)
SELECT series_id, count(DISTINCT CASE WHEN side = 1 THEN side END) = 1 AS complete, CASE WHEN count(CASE WHEN side = 1 THEN 1 END) = 0 THEN '1' ELSE '' END AS missing
FROM r GROUP BY 1
""")
def sides_of_every_group(spark, sf):
    side = (F.col("event_id") % 2).cast("int")
    rows = keyed(spark, sf).select("series_id", F.when((F.coalesce("series_id", F.lit(1)) % 3 == 1) | (side == 0), side).alias("side"))
    return relational.both_sides(rows, K, "side", [1])


PLACED_SQL = KEYED_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_us, event_id) - 1 AS pos FROM keyed)
"""


def placed_keys(spark, sf):
    return with_position(keyed(spark, sf), K, "t_us", ["event_id"])


@query("null_key_forecast_tail", f"""
WITH {PLACED_SQL}, l AS (SELECT series_id, max(pos) AS last, max(t_us) AS t FROM placed GROUP BY 1)
SELECT p.series_id, p.pos, t_us AS t, value, 'context' AS part FROM placed p JOIN l ON p.series_id IS NOT DISTINCT FROM l.series_id WHERE p.pos > l.last - 5
UNION ALL SELECT series_id, last + h, t + h * 1000, NULL, 'future' FROM l, (SELECT unnest(generate_series(1, 3)) AS h)
""")
def null_key_forecast_tail(spark, sf):
    return split.forecast_tail(placed_keys(spark, sf), K, "pos", "t_us", "value", 5, 3, 1000)


@query("null_key_dense_labels", f"""
WITH {KEYED_SQL} SELECT event_id, series_id, (dense_rank() OVER (ORDER BY series_id NULLS FIRST) - 1)::INT AS dense FROM keyed
""")
def null_key_dense_labels(spark, sf):
    return windows.dense_labels(keyed(spark, sf).select("event_id", "series_id"), "series_id")


@query("null_key_aligned", f"""
WITH {PLACED_SQL}, r AS (SELECT series_id, pos, t_us + (event_id % 50 = 0)::INT AS t FROM placed)
SELECT p.series_id, count(*) AS left_rows, count(*) AS right_rows, count_if(p.t_us <> r.t)::BIGINT AS mismatches
FROM placed p JOIN r ON p.series_id IS NOT DISTINCT FROM r.series_id AND p.pos = r.pos GROUP BY 1
""")
def null_key_aligned(spark, sf):
    placed = placed_keys(spark, sf)
    moved = placed.withColumn("t_us", F.col("t_us") + (F.col("event_id") % 50 == 0).cast("int"))
    return checks.aligned(placed, moved, K, "pos", "t_us")


@query("null_key_completion", f"""
WITH {KEYED_SQL}, grid AS (SELECT DISTINCT series_id, event_id % 4 AS seed FROM keyed), done AS (SELECT DISTINCT series_id, event_id % 4 AS seed FROM keyed WHERE value > 40)
SELECT g.series_id, count(*) AS expected, count(d.seed) AS completed, count(*) = count(d.seed) AS complete,
  coalesce(string_agg(g.seed::VARCHAR, ',' ORDER BY g.seed) FILTER (d.seed IS NULL), '') AS missing
FROM grid g LEFT JOIN done d ON g.series_id IS NOT DISTINCT FROM d.series_id AND g.seed = d.seed GROUP BY 1
""")
def null_key_completion(spark, sf):
    """A cell is finished where one of its values is large."""
    rows = keyed(spark, sf).withColumn("seed", F.col("event_id") % 4)
    return runs.completion(rows.select("series_id", "seed").distinct(), rows.filter("value > 40"), ["series_id", "seed"], K, "seed")


@query("null_key_early_stop", f"""
WITH RECURSIVE {PLACED_SQL}, best AS (SELECT *, min(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM placed),
last AS (SELECT *, max(CASE WHEN prior IS NULL OR value <= prior THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS last FROM best),
stop AS (SELECT *, min(CASE WHEN pos - last >= 6 THEN pos END) OVER (PARTITION BY series_id) AS stop FROM last)
SELECT series_id, max(pos) AS stop_step, min(value) AS best, max(last) AS best_step, bool_or(stop IS NOT NULL) AS stopped FROM stop WHERE stop IS NULL OR pos <= stop GROUP BY 1
""")
def null_key_early_stop(spark, sf):
    """Losses and a key that are missing now and then."""
    return runs.early_stop(placed_keys(spark, sf), K, "pos", "value", 6).select("series_id", "stop_step", "best", "best_step", "stopped")


SHORT_SQL = fx.SERIES_SQL + f""",
short AS (SELECT series_id * 100000 + pos // ({L - 1} + series_id % 14) AS series_id, pos % ({L - 1} + series_id % 14) AS pos FROM series),
n AS (SELECT series_id, count(*) AS n FROM short GROUP BY 1),
sized AS (SELECT series_id, n, (n - {L}) // {R} + 1 AS candidates, greatest(1, ceil(((n - {L}) // {R} + 1) / {BATCH}))::BIGINT AS steps
  FROM n WHERE (n - {L}) // {R} + 1 >= 1)
"""


def short_series(spark, sf):
    """All series, cut into pieces of 0 to 13 candidate windows, each a series; most have fewer than a batch needs."""
    piece = F.floor(F.col("pos") / (L - 1 + F.col("series_id") % 14))
    rows = fx.series(spark, sf).select((F.col("series_id") * 100000 + piece).cast("bigint").alias("series_id"), "t_us", "event_id")
    return with_position(rows, K, "t_us", ["event_id"])


@query("sample_poisson_short", f"""
WITH RECURSIVE {SHORT_SQL},
units AS (SELECT series_id, unnest(generate_series(0, candidates - 1)) AS unit, least(1.0, {BATCH}.0::DOUBLE / candidates) AS p, steps FROM sized),
{hits_sql()}
SELECT series_id, step, unit AS cand_id, unit * {R} AS start_pos FROM hits
""")
def sample_poisson_short(spark, sf):
    return sp.poisson(short_series(spark, sf), K, "pos", L, R, BATCH, fx.SEED)


@query("sample_structured_short", f"""
WITH {SHORT_SQL}, d AS (SELECT series_id, candidates, unnest(generate_series(0, steps * {BATCH} - 1)) AS d FROM sized)
SELECT series_id, d // {BATCH} AS step, d % {BATCH} AS slot, floor({fx.u_sql("'slot'", "series_id", "d")} * candidates)::BIGINT AS cand_id FROM d
""")
def sample_structured_short(spark, sf):
    return sp.structured_wr(short_series(spark, sf), K, L, R, BATCH, fx.SEED).select("series_id", "step", "slot", "cand_id")


# Fit on the first 70 % of each series, score the rest.
TRAIN_SQL = fx.SERIES_SQL + """,
tr AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n, lag(value) OVER w AS pv, lag(k) OVER w AS pk FROM series
  WINDOW w AS (PARTITION BY series_id ORDER BY pos))
"""
TRAIN_ROW = "pos < floor(n * 0.7::DOUBLE)"


def train_rows(spark, sf):
    return series_stats(fx.series(spark, sf), K, "pos", {"n": F.count(F.lit(1))}), F.col("pos") < F.floor(F.col("n") * F.lit(0.7))


@query("anomaly_mean_split", f"""
WITH {TRAIN_SQL}, m AS (SELECT series_id, avg(value) AS mv, avg(k) AS mk FROM tr WHERE {TRAIN_ROW} GROUP BY 1)
SELECT event_id, round(((value - mv) ^ 2 + (k - mk) ^ 2) / 2, 5) AS score FROM tr JOIN m USING (series_id) WHERE NOT {TRAIN_ROW}
""")
def anomaly_mean_split(spark, sf):
    rows, train = train_rows(spark, sf)
    return anomaly.mean_scores(rows, K, ["value", "k"], train).filter(~train).select("event_id", F.round("score", 5).alias("score"))


@query("anomaly_ar1_split", f"""
WITH {TRAIN_SQL}, p AS (SELECT series_id, coalesce(pv, 0) AS x, value AS y FROM tr WHERE {TRAIN_ROW} UNION ALL
  SELECT series_id, coalesce(pk, 0), k FROM tr WHERE {TRAIN_ROW}),
f AS (SELECT series_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p GROUP BY 1)
SELECT event_id, round(((value - a * coalesce(pv, 0) - b) ^ 2 + (k - a * coalesce(pk, 0) - b) ^ 2) / 2, 4) AS score
FROM tr JOIN f USING (series_id) WHERE NOT {TRAIN_ROW}
""")
def anomaly_ar1_split(spark, sf):
    rows, train = train_rows(spark, sf)
    out = anomaly.ar1_scores(rows, K, "pos", ["value", "k"], train=train).filter(~train)
    return out.select("event_id", F.round("score", 4).alias("score"))


@query("linear_forecast_split", f"""
WITH {fx.SERIES_SQL}, l AS (SELECT series_id, pos, value AS x, lead(value, 1) OVER w AS y FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
c AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM l WHERE y IS NOT NULL AND pos < 35)
SELECT series_id, pos, round(s * x + i, 6) AS f1 FROM l, c WHERE y IS NOT NULL AND pos >= 35
""")
def linear_forecast_split(spark, sf):
    out = forecast.linear_forecast(fx.series(spark, sf), K, "pos", "value", 1, 1, F.col("pos") < 35).filter("pos >= 35")
    return out.select("series_id", "pos", F.round("f1", 6).alias("f1"))


@query("concat_ordered_any_key", f"""
WITH {fx.SERIES_SQL} SELECT event_id, row_number() OVER (ORDER BY chr((65 + series_id % 7)::INT), series_id, pos) - 1 AS pool_pos FROM series
""")
def concat_ordered_any_key(spark, sf):
    """A text and a number as keys, and ranges of a few series."""
    rows = fx.series(spark, sf).withColumn("name", F.char(65 + F.col("series_id") % 7))
    return split.pooled_position(rows, ["name", "series_id"], "pos", block_rows=16).select("event_id", "pool_pos")


@query("both_sides_report", """
WITH e AS (SELECT user_id // 10 AS unit, event_type AS action, CASE WHEN event_id % 3 <> 0 AND user_id % 2 <> 0 THEN NULL
  WHEN event_id % 5 = 0 THEN 'acc' ELSE 'Gyroscope' END AS sensor FROM events),
h AS (SELECT unit, action, coalesce(list_sort(list(DISTINCT sensor) FILTER (sensor IS NOT NULL)), []) AS h FROM e GROUP BY 1, 2)
SELECT unit, action, len(h) = 2 AS complete, array_to_string(list_sort(list_filter(['acc', 'Gyroscope'], lambda s: NOT list_contains(h, s))), ',') AS missing FROM h
""")
def both_sides_report(spark, sf):
    """Which units are skipped, and for want of what."""
    known = (F.col("event_id") % 3 == 0) | (F.col("series_id") % 2 == 0)
    ev = fx.events(spark, sf).select(
        F.floor(F.col("series_id") / 10).alias("unit"), F.col("event_type").alias("action"),
        F.when(known, F.when(F.col("event_id") % 5 == 0, "acc").otherwise("Gyroscope")).alias("sensor"))
    return relational.both_sides(ev, ["unit", "action"], "sensor", ["acc", "Gyroscope"])
