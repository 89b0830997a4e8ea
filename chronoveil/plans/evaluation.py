"""Forecasters, anomaly scores, metrics and run tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chronoveil.functions import vectors as vec
from chronoveil.operators import anomaly as an
from chronoveil.operators import forecast as fc
from chronoveil.operators import metrics as mt
from chronoveil.operators import relational as rel
from chronoveil.operators import runs as rn
from chronoveil.operators import split, windows as wn
from chronoveil.operators.position import previous
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS


def r6(c, name):
    return F.round(c, 6).alias(name)


def r6_all(df, keys):
    return df.select(*keys, *[r6(F.col(c), c) for c in df.columns if c not in keys])


def r8_all(df, keys):
    return df.select(*keys, *[F.round(c, 8).alias(c) for c in df.columns if c not in keys])


# ---- forecasters ---------------------------------------------------------------------------------------------

def trend_sql(k: int) -> str:
    h = k // 2
    return f"""round((coalesce(sum(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING), 0)
  + greatest(0, {h} - pos) * first_value(value) OVER full_w + greatest(0, pos + {h} - (n - 1)) * last_value(value) OVER full_w) / {k}, 6)"""


NSERIES_SQL = fx.SERIES_SQL + ", ns AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series)"
FULL_W = "WINDOW full_w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query("decompose_trend", f"""
WITH {NSERIES_SQL}, t AS (SELECT series_id, pos, value, {trend_sql(25)} AS trend FROM ns {FULL_W})
SELECT series_id, pos, trend, round(value - trend, 4) AS seasonal FROM t
""")
def decompose_trend(spark, sf):
    out = fc.decompose(fx.series(spark, sf), K, "pos", "value", 25)
    return out.select("series_id", "pos", r6(F.col("trend"), "trend"),
                      F.round(F.col("value") - F.round("trend", 6), 4).alias("seasonal"))


@query("decompose_multi", f"""
WITH {NSERIES_SQL} SELECT series_id, pos, {trend_sql(5)} AS trend_5, {trend_sql(13)} AS trend_13, {trend_sql(25)} AS trend_25 FROM ns {FULL_W}
""")
def decompose_multi(spark, sf):
    out = fc.moving_trends(fx.series(spark, sf), K, "pos", "value", [5, 13, 25])
    return out.select("series_id", "pos", *[r6(F.col(f"trend_{k}"), f"trend_{k}") for k in (5, 13, 25)])


@query("naive_forecast", f"""
WITH {fx.SERIES_SQL} SELECT series_id, max(pos) + h AS pos, h::INT AS h, arg_max(value, pos) AS forecast
FROM series, (SELECT unnest(generate_series(1, 4)) AS h) GROUP BY series_id, h
""")
def naive_forecast(spark, sf):
    return fc.naive(fx.series(spark, sf), K, "pos", "value", 4)


@query("mean_init_forecast", f"""
WITH {fx.SERIES_SQL}, f AS (SELECT series_id, pos, avg(value) OVER w AS f, count(*) OVER w AS c FROM series
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT series_id, pos, round(f, 6) AS forecast FROM f WHERE c = 12
""")
def mean_init_forecast(spark, sf):
    out = fc.window_mean(fx.series(spark, sf), K, "pos", "value", 12)
    return out.select("series_id", "pos", r6(F.col("forecast"), "forecast"))


#: Windows with centred lags (xs), and the least-squares weights of four lags for two horizons (b).
FIT_SQL = f"""
WITH RECURSIVE {fx.SERIES_SQL}, l AS (SELECT series_id, pos, lag(value, 3) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 1) OVER w AS x3,
  value AS x4, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
t AS MATERIALIZED (SELECT * FROM l WHERE x1 IS NOT NULL AND y2 IS NOT NULL),
xs AS MATERIALIZED (SELECT series_id, pos, unnest([1, 2, 3, 4]) AS i, unnest([x1 - m1, x2 - m2, x3 - m3, x4 - m4]) AS x, y1, y2 FROM t,
  (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(x4) AS m4 FROM t)),
a AS MATERIALIZED (SELECT p.i AS i, q.i AS j, avg(p.x * q.x) AS v FROM xs p JOIN xs q USING (series_id, pos) GROUP BY 1, 2),
-- Inverse of the 4x4 lag covariance by Newton's iteration.
inv AS (SELECT 0 AS k, i, j, CASE WHEN i = j THEN 1.0::DOUBLE / (SELECT sum(v) FROM a WHERE i = j) ELSE 0 END AS v FROM a
  UNION ALL SELECT z.k + 1, z.i, z.j, 2 * z.v - y.v FROM inv z JOIN (
    SELECT u.k AS k, u.i AS i, w.j AS j, sum(u.v * a.v * w.v) AS v FROM inv u JOIN a ON u.j = a.i JOIN inv w ON a.j = w.i AND u.k = w.k GROUP BY 1, 2, 3) y
    ON z.k = y.k AND z.i = y.i AND z.j = y.j WHERE z.k < 30),
b AS (SELECT inv.i AS i, sum(inv.v * c.c1) AS b1, sum(inv.v * c.c2) AS b2 FROM inv JOIN (
  SELECT i, avg(x * y1) AS c1, avg(x * y2) AS c2 FROM xs GROUP BY 1) c ON inv.j = c.i WHERE k = 30 GROUP BY 1)
"""


@query("linear_forecast", FIT_SQL + """
SELECT series_id, pos, round(any_value(m.y1) + sum(x * b1), 6) AS f1, round(any_value(m.y2) + sum(x * b2), 6) AS f2
FROM xs JOIN b USING (i), (SELECT avg(y1) AS y1, avg(y2) AS y2 FROM t) m GROUP BY 1, 2
""")
def linear_forecast(spark, sf):
    out = fc.linear_forecast(fx.series(spark, sf), K, "pos", "value", 4, 2)
    return out.select("series_id", "pos", r6(F.col("f1"), "f1"), r6(F.col("f2"), "f2"))


def smoothing_sql(lags: int, kernel: int) -> str:
    """Values (i, j, s, t): what weight i of the undivided fit adds to weight j of the seasonal and of the trend part."""
    smooth = [[sum(min(max(k, 0), lags - 1) == j for k in range(i - kernel // 2, i + kernel // 2 + 1)) / kernel for j in range(lags)] for i in range(lags)]
    low = np.array(smooth)
    high = np.eye(lags) - low
    inverse = np.linalg.inv(high.T @ high + low.T @ low)
    parts = inverse @ high.T @ high, inverse @ low.T @ low
    return "VALUES " + ", ".join(f"({i + 1}, {j + 1}, {parts[0][i, j]!r}::DOUBLE, {parts[1][i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::")
                                 for i in range(lags) for j in range(lags))


@query("linear_forecast_decomposed", FIT_SQL + f""",
w AS (SELECT q.j AS i, sum(b1 * q.s) AS s1, sum(b2 * q.s) AS s2, sum(b1 * q.t) AS t1, sum(b2 * q.t) AS t2
  FROM b JOIN ({smoothing_sql(4, 25)}) q(i, j, s, t) ON b.i = q.i GROUP BY 1)
SELECT series_id, pos, round(sum(x * s1), 6) AS seasonal1, round(sum(x * s2), 6) AS seasonal2, round(any_value(m.y1) + sum(x * t1), 6) AS trend1,
  round(any_value(m.y2) + sum(x * t2), 6) AS trend2, round(any_value(m.y1) + sum(x * (s1 + t1)), 6) AS f1, round(any_value(m.y2) + sum(x * (s2 + t2)), 6) AS f2
FROM xs JOIN w USING (i), (SELECT avg(y1) AS y1, avg(y2) AS y2 FROM t) m GROUP BY 1, 2
""")
def linear_forecast_decomposed(spark, sf):
    """Moving average over 25 values and the rest, each with weights of its own."""
    out = fc.linear_forecast(fx.series(spark, sf), K, "pos", "value", 4, 2, kernel=25)
    return r6_all(out.drop("x", "y"), ["series_id", "pos"])


@query("linear_forecast_one_lag", f"""
WITH {fx.SERIES_SQL}, l AS (SELECT series_id, pos, value AS x, lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2 FROM series
  WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
t AS (SELECT * FROM l WHERE y2 IS NOT NULL),
c AS (SELECT regr_slope(y1, x) AS s1, regr_intercept(y1, x) AS i1, regr_slope(y2, x) AS s2, regr_intercept(y2, x) AS i2 FROM t)
SELECT series_id, pos, round(s1 * x + i1, 6) AS f1, round(s2 * x + i2, 6) AS f2 FROM t, c
""")
def linear_forecast_one_lag(spark, sf):
    """The same fit with one lag, where least squares has a closed form in SQL."""
    out = fc.linear_forecast(fx.series(spark, sf), K, "pos", "value", 1, 2)
    return out.select("series_id", "pos", r6(F.col("f1"), "f1"), r6(F.col("f2"), "f2"))


def boost_sql(rounds: int, rate: float) -> str:
    """CTEs b0(series_id, pos, n, r, f) to b<rounds>: residual and forecast behind the series after each round."""
    out = "b0 AS (SELECT series_id, pos, count(*) OVER s AS n, value - avg(value) OVER s AS r, avg(value) OVER s AS f FROM series WINDOW s AS (PARTITION BY series_id))"
    for k in range(rounds):
        out += f""",
p{k} AS (SELECT series_id, pos, n, sum(r) OVER (PARTITION BY series_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s, sum(r) OVER (PARTITION BY series_id) AS t FROM b{k}),
m{k} AS (SELECT series_id, pos AS cut, s / (pos + 1) AS low, (t - s) / (n - pos - 1) AS high FROM p{k} WHERE pos < n - 1
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY round(s * s / (pos + 1) + (t - s) * (t - s) / (n - pos - 1), 6) DESC, pos) = 1),
b{k + 1} AS (SELECT b.series_id, pos, n, r - coalesce({rate}::DOUBLE * CASE WHEN pos <= cut THEN low ELSE high END, 0) AS r, f + coalesce({rate}::DOUBLE * high, 0) AS f
  FROM b{k} b LEFT JOIN m{k} m USING (series_id))"""
    return out


@query("gbt_forecast", f"""
WITH {fx.SERIES_SQL}, {boost_sql(3, 0.5)}
SELECT series_id, n + h AS pos, round(f, 6) AS forecast FROM (SELECT DISTINCT series_id, n, round(f, 9) AS f FROM b3), (SELECT unnest([0, 1, 2]) AS h)
""")
def gbt_forecast(spark, sf):
    out = fc.boosted_forecast(fx.series(spark, sf).select("series_id", "pos", "value"), K, "pos", "value", horizon=3, rounds=3, rate=0.5)
    return out.select("series_id", "pos", r6(F.round("forecast", 9), "forecast"))


WIN24_SQL = fx.SERIES_SQL + """,
w24 AS (SELECT *, pos // 24 AS win_id, pos % 24 AS o, count(*) OVER (PARTITION BY series_id, pos // 24) AS c FROM series),
win AS (SELECT series_id, win_id, o, value FROM w24 WHERE c = 24)
"""


def win24(spark, sf):
    rows = wn.tumbling_rows(fx.series(spark, sf).select("series_id", "pos", "value"), K, "pos", 24)
    return wn.gather_arrays(rows, ["series_id", "win_id"], F.col("value"))


@query("sparse_period", f"""
WITH {WIN24_SQL}, m AS (SELECT series_id, win_id, avg(value) AS m FROM win GROUP BY 1, 2),
c AS (SELECT series_id, win_id, o, m, value - m AS c FROM win JOIN m USING (series_id, win_id)),
s AS (SELECT *, c + sum(c) OVER (PARTITION BY series_id, win_id ORDER BY o ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS v FROM c)
SELECT series_id, win_id, round(m, 6) AS mean, (o % 6)::INT AS phase, (o // 6)::INT AS segment, round(v, 6) AS value FROM s
""")
def sparse_period(spark, sf):
    out = fc.periodic_rows(win24(spark, sf), ["series_id", "win_id"], "x", 24, 6)
    return out.select("series_id", "win_id", r6(F.col("mean"), "mean"), F.col("phase").cast("int").alias("phase"), "segment",
                      r6(F.col("value"), "value"))


CORR_SQL = WIN24_SQL + """,
corr AS (SELECT a.series_id, a.win_id, l.lag, sum(a.value * b.value) AS corr FROM win a, (SELECT unnest(generate_series(0, 23)) AS lag) l, win b
  WHERE b.series_id = a.series_id AND b.win_id = a.win_id AND b.o = (a.o + l.lag) % 24 GROUP BY 1, 2, 3)
"""


@query("autocorrelation", f"WITH {CORR_SQL} SELECT series_id, win_id, lag::INT AS lag, round(corr, 4) AS corr FROM corr")
def autocorrelation(spark, sf):
    out = fc.autocorrelation(win24(spark, sf), ["series_id", "win_id"], "x", 24)
    return out.select("series_id", "win_id", "lag", F.round("corr", 4).alias("corr"))


@query("top_k_lags", f"""
WITH {CORR_SQL}, m AS (SELECT series_id, lag, round(avg(corr), 6) AS corr FROM corr GROUP BY 1, 2)
SELECT series_id, lag::INT AS lag, corr, (row_number() OVER (PARTITION BY series_id ORDER BY corr DESC, lag))::INT AS rank FROM m
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY corr DESC, lag) <= 3
""")
def top_k_lags(spark, sf):
    corr = fc.autocorrelation(win24(spark, sf), ["series_id", "win_id"], "x", 24)
    return fc.top_lags(corr, K, 24, digits=6).select("series_id", "lag", "corr", "rank")


# ---- anomaly scores ------------------------------------------------------------------------------------------

@query("anomaly_mean", f"""
WITH {fx.SERIES_SQL}, m AS (SELECT series_id, avg(value) mv, avg(k) mk FROM series GROUP BY 1)
SELECT event_id, round(((value - mv) ^ 2 + (k - mk) ^ 2) / 2, 6) AS score FROM series JOIN m USING (series_id)
""")
def anomaly_mean(spark, sf):
    return an.mean_scores(fx.events(spark, sf), K, ["value", "k"]).select("event_id", F.round("score", 6).alias("score"))


@query("anomaly_ar1", f"""
WITH {fx.SERIES_SQL}, l AS (SELECT *, coalesce(lag(value) OVER w, 0) AS pv, coalesce(lag(k) OVER w, 0) AS pk FROM series
  WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
x AS (SELECT series_id, pv AS x, value AS y FROM l UNION ALL SELECT series_id, pk, k FROM l),
f AS (SELECT series_id, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM x GROUP BY 1)
SELECT event_id, round(((value - s * pv - i) ^ 2 + (k - s * pk - i) ^ 2) / 2, 6) AS score FROM l JOIN f USING (series_id)
""")
def anomaly_ar1(spark, sf):
    out = an.ar1_scores(fx.series(spark, sf), K, "pos", ["value", "k"])
    return out.select("event_id", F.round("score", 6).alias("score"))


def _deflated(rank: int) -> str:
    """CTEs p1..p<rank>: projectors on the leading eigenvectors, each matrix without the ones before."""
    parts, matrix = [], "c0"
    for r in range(1, rank + 1):
        parts.append(fx.projector_sql(f"p{r}", matrix))
        parts.append(f"c{r} AS MATERIALIZED (SELECT m.part, m.i, m.j, m.v - e.ev * p.v AS v FROM {matrix} m JOIN p{r} p USING (part, i, j) "
                     f"JOIN {fx.eigenvalue_sql(matrix, f'p{r}')} e USING (part))")
        matrix = f"c{r}"
    return ", ".join(parts)


@query("anomaly_linear_rank", f"""
WITH RECURSIVE {fx.VECTORS_SQL}, mu AS (SELECT d, avg(x) AS m FROM dims GROUP BY 1),
ce AS MATERIALIZED (SELECT vec_id, dims.d AS d, x - m AS x FROM dims JOIN mu USING (d)),
c0 AS MATERIALIZED (SELECT 0 AS part, a.d AS i, b.d AS j, avg(a.x * b.x) AS v FROM ce a JOIN ce b ON a.vec_id = b.vec_id GROUP BY 2, 3),
{_deflated(4)},
kept AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM p1 UNION ALL SELECT i, j, v FROM p2 UNION ALL SELECT i, j, v FROM p3 UNION ALL SELECT i, j, v FROM p4) GROUP BY 1, 2),
pe AS (SELECT a.vec_id AS vec_id, sum(a.x * b.x * k.v) AS e FROM ce a JOIN kept k ON a.d = k.i JOIN ce b ON b.vec_id = a.vec_id AND b.d = k.j GROUP BY 1),
te AS (SELECT vec_id, sum(x * x) AS e FROM ce GROUP BY 1)
SELECT vec_id, round((te.e - pe.e) / 64, 6) AS score FROM te JOIN pe USING (vec_id)
""")
def anomaly_linear_rank(spark, sf):
    return an.rank_scores(fx.vectors(spark, sf), "v", 4).select("vec_id", r6(F.col("score"), "score"))


@query("score_timestamps", f"""
WITH {NSERIES_SQL}, st AS (SELECT series_id, unnest(generate_series(0, n - 12)) AS s FROM (SELECT DISTINCT series_id, n FROM ns WHERE n >= 12)),
r AS (SELECT st.series_id, s, pos, value, k FROM st JOIN series ON series.series_id = st.series_id AND pos BETWEEN s AND s + 11),
e AS (SELECT *, ((value - avg(value) OVER w) ^ 2 + (k - avg(k) OVER w) ^ 2) / 2 AS e FROM r WINDOW w AS (PARTITION BY series_id, s))
SELECT series_id, pos, round(sqrt(avg(e)), 6) AS root_score, count(*) AS windows FROM e GROUP BY 1, 2
""")
def score_timestamps(spark, sf):
    out = an.window_mean_scores(fx.series(spark, sf), K, "pos", ["value", "k"], 12)
    return out.select("series_id", "pos", r6(F.sqrt("score"), "root_score"), "windows")


def error_scores(spark, sf):
    """Squared deviation of the value as score, 'is an error event' as truth."""
    ev = fx.events(spark, sf).select("event_id", "series_id", "value", (F.col("event_type") == "error").cast("int").alias("truth"))
    return ev.withColumn("score", F.round((F.col("value") - 100.0) * (F.col("value") - 100.0), 6)).withColumn(
        "part", F.col("series_id") % 3)


SCORE_SQL = "sc AS (SELECT event_id, user_id % 3 AS part, value, (event_type = 'error')::INT AS truth, round((value - 100.0::DOUBLE) * (value - 100.0::DOUBLE), 6) AS score FROM events)"
RANK_SQL = SCORE_SQL + """,
cnt AS (SELECT part, score, sum(truth) AS p, sum(1 - truth) AS n FROM sc GROUP BY 1, 2),
cum AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY part) AS tp, sum(n) OVER (PARTITION BY part) AS tn FROM cnt
  WINDOW w AS (PARTITION BY part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query("auroc", f"""
WITH {SCORE_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY score) + (count(*) OVER (PARTITION BY part, score) - 1) / 2.0::DOUBLE AS r FROM sc)
SELECT part, round((sum(CASE WHEN truth = 1 THEN r END) - sum(truth) * (sum(truth) + 1) / 2.0::DOUBLE) / (sum(truth)::DOUBLE * sum(1 - truth)), 6) AS auroc FROM rk GROUP BY 1
""")
def auroc(spark, sf):
    return mt.ranking_metrics(error_scores(spark, sf), ["part"], "score", "truth").select("part", r6(F.col("auroc"), "auroc"))


@query("average_precision", f"""
WITH {RANK_SQL} SELECT part, round(sum(p / tp::DOUBLE * (tp - cp + p) / (tp - cp + p + tn - cn + n)::DOUBLE), 6) AS ap FROM cum GROUP BY 1
""")
def average_precision(spark, sf):
    return mt.ranking_metrics(error_scores(spark, sf), ["part"], "score", "truth").select("part", r6(F.col("ap"), "ap"))


@query("toxicity_ranking", """
WITH sc AS (SELECT toxic AS truth, n_chars AS score FROM labels JOIN documents USING (doc_id)),
rk AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc)
SELECT round((sum(CASE WHEN truth = 1 THEN r END) - sum(truth) * (sum(truth) + 1) / 2.0::DOUBLE) / (sum(truth)::DOUBLE * sum(1 - truth)), 6) AS auroc FROM rk
""")
def toxicity_ranking(spark, sf):
    """The same ranking metric without a group key: labels joined with documents."""
    docs = fx.read_table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    rows = fx.read_table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("truth")).join(docs, "doc_id")
    return mt.ranking_metrics(rows, [], "score", "truth").select(r6(F.col("auroc"), "auroc"))


@query("f1_threshold", f"""
WITH {SCORE_SQL} SELECT part, round(coalesce(2 * count_if(score > 5000 AND truth = 1) / nullif(2 * count_if(score > 5000 AND truth = 1)
  + count_if(score > 5000 AND truth = 0) + count_if(score <= 5000 AND truth = 1), 0)::DOUBLE, 0), 6) AS f1 FROM sc GROUP BY 1
""")
def f1_threshold(spark, sf):
    return mt.f1_at(error_scores(spark, sf), ["part"], "score", "truth", 5000.0).select("part", r6(F.col("f1"), "f1"))


# ---- forecast and classification metrics ---------------------------------------------------------------------

PAIR_SQL = NSERIES_SQL + """,
pr AS (SELECT s.series_id, s.pos - 11 AS start_pos, y.pos - s.pos AS h, u.channel, CASE u.channel WHEN 'value' THEN y.value ELSE y.k END AS t,
   CASE u.channel WHEN 'value' THEN s.value ELSE s.k END AS p FROM ns s JOIN series y ON y.series_id = s.series_id AND y.pos BETWEEN s.pos + 1 AND s.pos + 4,
   (VALUES ('value'), ('k')) u(channel) WHERE s.pos >= 11 AND s.pos + 4 < n)
"""


def forecast_pairs(spark, sf):
    return fc.pairs(fx.series(spark, sf), K, "pos", ["value", "k"], 12, 4)


@query("forecast_metrics", f"""
WITH {PAIR_SQL}, m AS (SELECT channel, h, avg(t) OVER (PARTITION BY channel, h) AS mt, t, p FROM pr)
SELECT channel, h::INT AS h, round(avg(abs(p - t)), 6) AS mae, round(avg((p - t) ^ 2), 6) AS mse, round(sqrt(avg((p - t) ^ 2)), 6) AS rmse,
  round(avg(CASE WHEN t <> 0 THEN abs((p - t) / t) WHEN p = t THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END), 6) AS mape,
  round(avg(CASE WHEN t <> 0 THEN ((p - t) / t) ^ 2 WHEN p = t THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END), 4) AS mspe,
  round(sqrt(sum((p - t) ^ 2)) / sqrt(sum((t - mt) ^ 2)), 6) AS rse FROM m GROUP BY 1, 2
""")
def forecast_metrics(spark, sf):
    out = mt.forecast_metrics(forecast_pairs(spark, sf), ["channel", "h"], "true", "pred")
    return out.select("channel", "h", *[r6(F.col(c), c) for c in ("mae", "mse", "rmse", "mape", "rse")],
                      F.round("mspe", 4).alias("mspe"))


@query("corr_metric", f"""
WITH {PAIR_SQL}, d AS (SELECT h, channel, t - avg(t) OVER w AS dt, p - avg(p) OVER w AS dp FROM pr WINDOW w AS (PARTITION BY h, channel)),
u AS (SELECT h, channel, sum(dt * dp) / (sqrt(sum(dt * dt * dp * dp)) + 1e-12::DOUBLE) AS u FROM d GROUP BY 1, 2)
SELECT h::INT AS h, round(0.01::DOUBLE * avg(u), 6) AS corr FROM u GROUP BY 1
""")
def corr_metric(spark, sf):
    out = mt.scaled_correlation(forecast_pairs(spark, sf), ["h"], ["channel"], "true", "pred", cells=4 * 2)
    return out.select("h", r6(F.col("corr"), "corr"))


@query("lp_loss", f"""
WITH {fx.VECTORS_SQL}, l AS (SELECT label, list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] - z[2]) AS d, v, list_reverse(v) AS y FROM vecs),
n AS (SELECT label, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS d2, sqrt(list_sum(list_transform(y, lambda x: x * x))) AS y2,
  list_sum(list_transform(d, lambda x: abs(x))) AS d1, list_sum(list_transform(y, lambda x: abs(x))) AS y1 FROM l)
SELECT label, 2 AS p, round(avg(d2 / y2), 6) AS rel_mean, round(sum(d2 / y2), 6) AS rel_sum, round(avg(d2 / 63), 6) AS abs_mean, round(sum(d2 / 63), 6) AS abs_sum FROM n GROUP BY 1
UNION ALL SELECT label, 1, round(avg(d1 / y1), 6), round(sum(d1 / y1), 6), round(avg(d1 / (63 * 63)), 6), round(sum(d1 / (63 * 63)), 6) FROM n GROUP BY 1
""")
def lp_loss(spark, sf):
    v = fx.vectors(spark, sf).withColumn("y", F.reverse("v"))
    parts = [mt.reduce_losses(mt.lp_losses(v, "v", "y", float(p)), ["label"], ["rel", "abs"]).withColumn("p", F.lit(p)) for p in (2, 1)]
    out = parts[0].unionByName(parts[1])
    return out.select("label", "p", *[r6(F.col(c), c) for c in ("rel_mean", "rel_sum", "abs_mean", "abs_sum")])


@query("eval_mse_elementwise", f"""
WITH {PAIR_SQL} SELECT channel, round(sum((t - p) ^ 2) / count(*), 6) AS mse, count(*) AS elements FROM pr GROUP BY 1
""")
def eval_mse_elementwise(spark, sf):
    out = mt.elementwise_mse(forecast_pairs(spark, sf), ["channel"], "true", "pred")
    return out.select("channel", r6(F.col("mse"), "mse"), "elements")


@query("eval_loss_batchweighted", """
WITH b AS (SELECT event_type, event_id // 32 AS b, avg(abs(value - 100)) AS l, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, round(sum(l * n) / sum(n), 6) AS loss, count(*) AS batches FROM b GROUP BY 1
""")
def eval_loss_batchweighted(spark, sf):
    ev = fx.events(spark, sf).withColumn("loss", F.abs(F.col("value") - 100.0))
    out = mt.batch_weighted(ev, ["event_type"], F.floor(F.col("event_id") / 32), "loss")
    return out.select("event_type", r6(F.col("loss"), "loss"), "batches")


CONF_SQL = fx.CODED_SQL + """,
lp AS (SELECT series_id, label AS truth, lag(label) OVER (PARTITION BY series_id ORDER BY pos) AS pred FROM coded),
cf AS (SELECT truth, pred, count(*) AS n FROM lp WHERE pred IS NOT NULL GROUP BY 1, 2),
cl AS (SELECT l AS label, sum(CASE WHEN truth = l THEN n ELSE 0 END) AS sup, sum(CASE WHEN pred = l THEN n ELSE 0 END) AS pre,
   sum(CASE WHEN truth = l AND pred = l THEN n ELSE 0 END) AS tp FROM cf, (SELECT unnest(generate_series(0, 4)) AS l) GROUP BY 1),
rp AS (SELECT *, coalesce(tp / nullif(pre, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(sup, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(sup + pre, 0)::DOUBLE, 0) AS f1 FROM cl)
"""


def class_confusion(spark, sf):
    """Previous label as the prediction of the current one."""
    s = previous(fx.coded_series(spark, sf).select("series_id", "pos", "label"), K, "pos", {"pred": "label"})
    return mt.confusion(s.filter(F.col("pred").isNotNull()), [], "label", "pred")


@query("class_metrics", f"""
WITH {CONF_SQL} SELECT round(sum(tp) / sum(sup), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1 FROM rp
""")
def class_metrics(spark, sf):
    return r6_all(mt.class_metrics(class_confusion(spark, sf), []), [])


@query("confusion_report", f"""
WITH {CONF_SQL}, mx AS (SELECT truth AS label, sum(CASE WHEN pred = 0 THEN n ELSE 0 END)::BIGINT AS p0, sum(CASE WHEN pred = 1 THEN n ELSE 0 END)::BIGINT AS p1,
 sum(CASE WHEN pred = 2 THEN n ELSE 0 END)::BIGINT AS p2, sum(CASE WHEN pred = 3 THEN n ELSE 0 END)::BIGINT AS p3, sum(CASE WHEN pred = 4 THEN n ELSE 0 END)::BIGINT AS p4 FROM cf GROUP BY 1)
SELECT label::INT AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, sup::BIGINT AS support, p0, p1, p2, p3, p4 FROM rp JOIN mx USING (label)
""")
def confusion_report(spark, sf):
    conf = class_confusion(spark, sf)
    matrix = mt.confusion_matrix(conf, [0, 1, 2, 3, 4]).withColumnsRenamed({"truth": "label", **{str(i): f"p{i}" for i in range(5)}})
    rep = mt.class_report(conf, []).join(matrix, "label")
    return rep.select("label", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"), r6(F.col("f1"), "f1"), "support",
                      *[f"p{i}" for i in range(5)])


LOGIT_SQL = fx.VECTORS_SQL + ", lg AS (SELECT vec_id, label, v AS z FROM vecs)"


def logits(spark, sf):
    return fx.vectors(spark, sf).select("vec_id", "label", F.col("v").alias("z"))


@query("cross_entropy", f"""
WITH {LOGIT_SQL} SELECT label, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1]), 6) AS loss, count(*) AS n FROM lg GROUP BY 1
""")
def cross_entropy(spark, sf):
    out = logits(spark, sf).withColumn("l", mt.cross_entropy(F.col("z"), F.col("label")))
    return out.groupBy("label").agg(F.round(F.avg("l"), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("argmax_predict", f"""
WITH {LOGIT_SQL} SELECT vec_id, (list_position(z, list_max(z)) - 1)::BIGINT AS pred FROM lg
""")
def argmax_predict(spark, sf):
    return logits(spark, sf).select("vec_id", vec.argmax(F.col("z")).alias("pred"))


# ---- run tables ----------------------------------------------------------------------------------------------

@query("activity_file_count", """
WITH f AS (SELECT (user_id % 30)::INT AS a, user_id AS s FROM events)
SELECT a::VARCHAR AS activity, coalesce(n_name, 'Unknown') AS name, count(*) AS files, count(DISTINCT s) AS subjects FROM f LEFT JOIN nation ON n_nationkey = a GROUP BY 1, 2
UNION ALL SELECT 'Total', '', count(*), count(DISTINCT s) FROM f
""")
def activity_file_count(spark, sf):
    files = fx.events(spark, sf).select((F.col("series_id") % 30).cast("int").alias("activity_id"), "series_id")
    names = fx.read_table(spark, sf, "nation").select(F.col("n_nationkey").alias("activity_id"), "n_name")
    return rn.counts_with_total(files, "activity_id", "series_id", names, "n_name")


@query("class_distribution", f"""
WITH {fx.SERIES_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series),
sp AS (SELECT *, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 'train' WHEN pos < n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM sized)
SELECT split, event_type AS label, count(*) AS rows FROM sp GROUP BY 1, 2
""")
def class_distribution(spark, sf):
    parts = split.split_ratio(fx.series(spark, sf), K, "pos").select("split", F.col("event_type").alias("label"))
    return rn.class_distribution(parts, "split", "label")


@query("user_row_stats", """
SELECT user_id AS series_id, count(*) AS rows, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS labels FROM events GROUP BY 1
""")
def user_row_stats(spark, sf):
    return rn.key_row_stats(fx.events(spark, sf), "series_id", "event_type")


RUN_KEYS = ["method", "epsilon", "seed"]
RUNS_SQL = """
runs AS (SELECT (user_id % 3)::INT AS method, (list_position(['click','error','purchase','signup','view'], event_type))::INT AS epsilon,
  (event_id % 30 + 42)::INT AS seed, avg(value) AS accuracy, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS f1, count(*) AS steps
  FROM events GROUP BY 1, 2, 3)
"""


def runs(spark, sf):
    """One run per (method, epsilon level, seed) with two metrics."""
    ev = fx.events(spark, sf)
    return ev.groupBy((F.col("series_id") % 3).cast("int").alias("method"), (fx.event_code() + 1).alias("epsilon"),
                      (F.col("event_id") % 30 + 42).cast("int").alias("seed")).agg(
        F.avg("value").alias("accuracy"), F.avg("k").alias("f1"), F.count(F.lit(1)).alias("steps"))


def finished(df):
    """Some runs have not finished."""
    return df.filter((F.col("seed") * 7 + F.col("epsilon") * 3 + F.col("method")) % 11 != 0)


DONE_SQL = RUNS_SQL + ", done AS (SELECT * FROM runs WHERE (seed * 7 + epsilon * 3 + method) % 11 <> 0)"
GRID_SQL = """grid AS (SELECT m::INT AS method, e::INT AS epsilon, s::INT AS seed FROM (SELECT DISTINCT user_id % 3 AS m FROM events),
  (SELECT unnest(generate_series(1, 5)) AS e), (SELECT unnest(generate_series(42, 71)) AS s))"""


def grid(spark, sf):
    methods = fx.events(spark, sf).select((F.col("series_id") % 3).cast("int").alias("method")).distinct()
    return rel.sweep(methods, {"epsilon": [1, 2, 3, 4, 5], "seed": list(range(42, 72))})


@query("run_summary", f"""
WITH {DONE_SQL} SELECT method, epsilon, count(*) AS n, 30::BIGINT AS expected_n, count(*) = 30 AS complete, arg_min(steps, seed) AS steps, round(avg(accuracy), 8) AS accuracy_mean,
  round(stddev_samp(accuracy), 8) AS accuracy_std, round(avg(f1), 8) AS f1_mean, round(stddev_samp(f1), 8) AS f1_std FROM done GROUP BY 1, 2
""")
def run_summary(spark, sf):
    out = rn.summary(finished(runs(spark, sf)), ["method", "epsilon"], ["accuracy", "f1"], 30, "seed", "steps")
    return r8_all(out, ["method", "epsilon", "n", "expected_n", "complete", "steps"])


@query("run_summary_strict", f"""
WITH {DONE_SQL} SELECT method, epsilon, count(*) AS num_runs, (epsilon * 100)::BIGINT AS optimizer_steps, round(avg(accuracy), 8) AS mean_accuracy,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(accuracy) ELSE 0 END, 8) AS std_accuracy FROM done GROUP BY 1, 2
""")
def run_summary_strict(spark, sf):
    some = finished(runs(spark, sf)).withColumn("optimizer_steps", (F.col("epsilon") * 100).cast("bigint"))
    out = rn.summary_strict(some, ["method", "epsilon"], ["accuracy"], ["optimizer_steps"])
    return r8_all(out, ["method", "epsilon", "num_runs", "optimizer_steps"])


@query("run_summary_pop", f"""
WITH {RUNS_SQL} SELECT method, epsilon, round(avg(accuracy), 8) AS accuracy_mean, round(stddev_pop(accuracy), 8) AS accuracy_std, round(avg(f1), 8) AS f1_mean,
  round(stddev_pop(f1), 8) AS f1_std FROM runs GROUP BY 1, 2
""")
def run_summary_pop(spark, sf):
    return r8_all(rn.summary_population(runs(spark, sf), ["method", "epsilon"], ["accuracy", "f1"]), ["method", "epsilon"])


@query("completion", f"""
WITH {DONE_SQL}, {GRID_SQL} SELECT g.method, g.epsilon, count(*) AS expected, count(d.seed) AS completed, count(*) = count(d.seed) AS complete,
  coalesce(string_agg(CASE WHEN d.seed IS NULL THEN g.seed::VARCHAR END, ',' ORDER BY g.seed), '') AS missing
FROM grid g LEFT JOIN done d ON g.method = d.method AND g.epsilon = d.epsilon AND g.seed = d.seed GROUP BY 1, 2
""")
def completion(spark, sf):
    return rn.completion(grid(spark, sf), finished(runs(spark, sf)), RUN_KEYS, ["method", "epsilon"], "seed")


@query("missing_runs", f"""
WITH {DONE_SQL}, {GRID_SQL}, r AS (SELECT method, epsilon, seed FROM done UNION ALL SELECT method, epsilon, seed FROM done WHERE seed % 9 = 0
   UNION ALL SELECT method, epsilon, seed + 100 FROM done WHERE seed = 50),
c AS (SELECT method, epsilon, seed, count(*) AS runs FROM r GROUP BY 1, 2, 3)
SELECT coalesce(g.method, c.method) AS method, coalesce(g.epsilon, c.epsilon) AS epsilon, coalesce(g.seed, c.seed) AS seed, coalesce(runs, 0) AS runs,
  CASE WHEN g.seed IS NULL THEN 'unexpected' WHEN runs IS NULL THEN 'missing' WHEN runs > 1 THEN 'duplicate' ELSE 'ok' END AS status
FROM grid g FULL JOIN c ON g.method = c.method AND g.epsilon = c.epsilon AND g.seed = c.seed
""")
def missing_runs(spark, sf):
    done = finished(runs(spark, sf)).select(*RUN_KEYS)
    twice = done.filter("seed % 9 = 0")
    extra = done.filter("seed = 50").withColumn("seed", F.col("seed") + 100)
    return rel.missing_from_grid(grid(spark, sf), done.unionByName(twice).unionByName(extra), RUN_KEYS)


@query("sort_runs", f"WITH {RUNS_SQL} SELECT method, epsilon, seed, round(accuracy, 8) AS accuracy FROM runs ORDER BY method, epsilon, seed")
def sort_runs(spark, sf):
    return runs(spark, sf).select(*RUN_KEYS, F.round("accuracy", 8).alias("accuracy")).orderBy(*RUN_KEYS)


@query("split_join", f"""
WITH {RUNS_SQL}, b AS (SELECT method, epsilon, max(steps) AS budget FROM runs GROUP BY 1, 2)
SELECT method, epsilon, seed, round(accuracy, 8) AS accuracy, steps, budget, steps <= budget AS within FROM runs JOIN b USING (method, epsilon)
""")
def split_join(spark, sf):
    r = runs(spark, sf)
    budgets = r.groupBy("method", "epsilon").agg(F.max("steps").alias("budget"))
    return r.join(budgets, ["method", "epsilon"]).select(*RUN_KEYS, F.round("accuracy", 8).alias("accuracy"), "steps", "budget",
                                                         (F.col("steps") <= F.col("budget")).alias("within"))


@query("best_by", f"""
WITH {RUNS_SQL} SELECT epsilon, method, seed, steps FROM runs QUALIFY row_number() OVER (PARTITION BY epsilon ORDER BY steps DESC, method DESC, seed DESC) = 1
""")
def best_by(spark, sf):
    return rel.best_by(runs(spark, sf), ["epsilon"], [F.col("steps"), F.col("method"), F.col("seed")], ["method", "seed", "steps"])


@query("homogeneity_check", f"""
WITH {RUNS_SQL} SELECT method, epsilon, count(DISTINCT seed % 1) = 1 AS same_test_id, count(DISTINCT steps) = 1 AS same_steps FROM runs GROUP BY 1, 2
""")
def homogeneity_check(spark, sf):
    r = runs(spark, sf).withColumn("test_id", F.col("seed") % 1)
    return rn.homogeneity(r, ["method", "epsilon"], ["test_id", "steps"])


@query("paired_ratios", f"""
WITH {RUNS_SQL}, b AS (SELECT epsilon, seed, accuracy AS b FROM runs WHERE method = 0)
SELECT epsilon, method, round(avg(accuracy) / avg(b), 6) AS ratio_of_means, round(avg(accuracy / b), 6) AS paired_mean, round(stddev_pop(accuracy / b), 6) AS paired_std,
  count_if(accuracy < b)::BIGINT AS below FROM runs JOIN b USING (epsilon, seed) GROUP BY 1, 2
""")
def paired_ratios(spark, sf):
    out = rn.paired_ratios(runs(spark, sf), ["epsilon"], "seed", "method", "accuracy", 0)
    return r6_all(out, ["epsilon", "method", "below"])


def early_sql(op: str, kind: str) -> str:
    return f"""
SELECT '{kind}' AS kind, series_id, max(pos) AS stop_step, min(value) AS best, max(last) AS best_step, bool_or(stop IS NOT NULL) AS stopped FROM (
  SELECT *, min(CASE WHEN pos - last >= 5 THEN pos END) OVER (PARTITION BY series_id) AS stop FROM (
    SELECT *, max(CASE WHEN prior IS NULL OR value {op} prior THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS last FROM (
      SELECT *, min(value) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM series)))
WHERE stop IS NULL OR pos <= stop GROUP BY 2"""


def chain_sql(name: str, op: str, delta: float) -> str:
    """CTE of the records of a run, each better than the one before by ``delta``, and at most 5 steps behind it."""
    return f"""{name} AS (SELECT series_id, 0::BIGINT AS pos, value FROM series WHERE pos = 0
  UNION ALL SELECT c.series_id, min(s.pos), arg_min(s.value, s.pos) FROM {name} c JOIN series s ON s.series_id = c.series_id AND s.pos > c.pos
    AND s.pos <= c.pos + 5 AND s.value {op} c.value - {delta}::DOUBLE GROUP BY c.series_id, c.pos)"""


def chain_end_sql(name: str, kind: str) -> str:
    return f"""SELECT '{kind}' AS kind, series_id, least(max(c.pos) + 5, any_value(n)) AS stop_step, arg_max(c.value, c.pos) AS best, max(c.pos) AS best_step,
  max(c.pos) + 5 <= any_value(n) AS stopped FROM {name} c JOIN (SELECT series_id, max(pos) AS n FROM series GROUP BY 1) USING (series_id) GROUP BY series_id"""


@query("early_stop_scan", f"""WITH RECURSIVE {fx.SERIES_SQL}, {chain_sql('wide', '<=', 2.5)}, {chain_sql('narrow', '<', 0.01)}
{early_sql('<=', 'loose')} UNION ALL {early_sql('<', 'strict')} UNION ALL {chain_end_sql('wide', 'by 2.5')} UNION ALL {chain_end_sql('narrow', 'by 0.01')}
UNION ALL {chain_end_sql('wide', 'by 2.5, blocks')}""")
def early_stop_scan(spark, sf):
    s = fx.series(spark, sf)
    loose = rn.early_stop(s, K, "pos", "value", 5).withColumn("kind", F.lit("loose"))
    strict = rn.early_stop(s, K, "pos", "value", 5, strict=True).withColumn("kind", F.lit("strict"))
    out = loose.unionByName(strict)
    for kind, delta, strictly, rows in (("by 2.5", 2.5, False, {}), ("by 0.01", 0.01, True, {}), ("by 2.5, blocks", 2.5, False, {"block_rows": 8})):
        out = out.unionByName(rn.early_stop(s, K, "pos", "value", 5, strictly, delta=delta, **rows).withColumn("kind", F.lit(kind)))
    return out.select("kind", "series_id", "stop_step", "best", "best_step", "stopped")


@query("best_checkpoint", f"""
WITH {fx.SERIES_SQL}, r AS (SELECT *, floor(value / 10) AS loss, floor(k / 10) AS score FROM series)
SELECT series_id, max(CASE WHEN loss = ml THEN pos END) AS best_loss_step, min(CASE WHEN score = ms THEN pos END) AS best_score_step FROM (
 SELECT *, min(loss) OVER (PARTITION BY series_id) AS ml, max(score) OVER (PARTITION BY series_id) AS ms FROM r) GROUP BY 1
""")
def best_checkpoint(spark, sf):
    s = fx.series(spark, sf).withColumn("loss", F.floor(F.col("value") / 10)).withColumn("score", F.floor(F.col("k") / 10))
    return rn.best_checkpoint(s, K, "pos", "loss", "score")


@query("budget_cutoff", f"""
WITH {fx.SERIES_SQL}, e AS (SELECT series_id, pos, sqrt((pos + 1)::DOUBLE) * (1 + series_id % 3) / 4 AS epsilon FROM series),
n AS (SELECT *, lead(epsilon) OVER (PARTITION BY series_id ORDER BY pos) AS nxt FROM e),
c AS (SELECT series_id, min(pos) FILTER (nxt >= 3) AS last FROM n GROUP BY 1)
SELECT series_id, pos, round(epsilon, 6) AS epsilon FROM e JOIN c USING (series_id) WHERE last IS NULL OR pos <= last
""")
def budget_cutoff(spark, sf):
    eps = F.sqrt((F.col("pos") + 1).cast("double")) * (1 + F.col("series_id") % 3) / 4
    out = rn.budget_cutoff(fx.series(spark, sf).select("series_id", "pos"), K, "pos", eps, 3.0)
    return out.select("series_id", "pos", r6(F.col("epsilon"), "epsilon"))
