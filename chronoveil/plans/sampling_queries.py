"""Sampler queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.operators import sampling as sp
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS
L, R, BATCH = 8, 1, 10


def r6(c, name):
    return F.round(c, 6).alias(name)


SIZED_SQL = fx.EVENTS_SQL + f""",
n AS (SELECT series_id, count(*) AS n FROM ev GROUP BY 1),
sized AS (SELECT series_id, n, (n - {L}) // {R} + 1 AS candidates,
  greatest(1, ceil(((n - {L}) // {R} + 1) / {BATCH}))::BIGINT AS steps FROM n WHERE (n - {L}) // {R} + 1 >= {BATCH})
"""


def hits_sql(keys: str = "series_id") -> str:
    """SQL twin of ``bernoulli_hits`` on a CTE ``units(<keys>, unit, p, steps)``; defines ``hits(<keys>, unit, step)``."""
    u = fx.u_sql("'count'", keys, "unit", "i")
    v = fx.u_sql("'step'", keys, "unit", "i", "j")
    return f"""
sizes AS (SELECT *, CASE WHEN p >= 1 THEN 1 ELSE greatest(1, floor(1.0::DOUBLE / p))::BIGINT END AS csize FROM units),
chunks AS (SELECT *, least(csize, steps - i * csize) AS c, {u} AS u FROM (
  SELECT *, unnest(generate_series(0, ceil(steps / csize)::BIGINT - 1)) AS i FROM sizes)),
pm AS (SELECT DISTINCT c, p, 0 AS k, pow(1.0::DOUBLE - p, c) AS pmf, pow(1.0::DOUBLE - p, c) AS cdf FROM chunks WHERE p < 1
  UNION ALL SELECT c, p, k + 1, pmf * (c - k) / (k + 1) * (p / (1.0::DOUBLE - p)),
    cdf + pmf * (c - k) / (k + 1) * (p / (1.0::DOUBLE - p)) FROM pm WHERE k + 1 < least(c, 24)),
counted AS (SELECT {keys}, unit, i, csize, c, CASE WHEN p >= 1 THEN c ELSE
  (SELECT count(*) FROM pm WHERE pm.c = chunks.c AND pm.p = chunks.p AND chunks.u >= pm.cdf) END AS h FROM chunks),
floyd AS (SELECT {keys}, unit, i, csize, c, c - h + 1 AS j, []::BIGINT[] AS acc FROM counted WHERE h > 0
  UNION ALL SELECT {keys}, unit, i, csize, c, j + 1, list_append(acc, CASE WHEN list_contains(acc, (floor({v} * j) + 1)::BIGINT)
    THEN j ELSE (floor({v} * j) + 1)::BIGINT END) FROM floyd WHERE j <= c),
hits AS (SELECT {keys}, unit, (i * csize + pick - 1)::BIGINT AS step FROM (
  SELECT *, unnest(acc) AS pick FROM floyd WHERE j = c + 1))
"""


@query("sample_poisson", f"""
WITH RECURSIVE {SIZED_SQL},
units AS (SELECT series_id, unnest(generate_series(0, candidates - 1)) AS unit, least(1.0, {BATCH}.0::DOUBLE / candidates) AS p, steps FROM sized),
{hits_sql()}
SELECT series_id, step, unit AS cand_id, unit * {R} AS start_pos FROM hits
""")
def sample_poisson(spark, sf):
    return sp.poisson(fx.series(spark, sf), K, "pos", L, R, BATCH, fx.SEED)


def spaced_sql(count: int, lam: float) -> str:
    member = fx.u_sql("'member'", "h.series_id", "unit", "step")
    return f"""
WITH RECURSIVE {SIZED_SQL},
lay AS (SELECT series_id, steps, candidates // {count} AS base, candidates % {count} AS rem,
  unnest(generate_series(0, {count} - 1)) AS unit FROM sized),
iv AS (SELECT series_id, steps, unit, unit * base + least(unit, rem) AS lo, base + (unit < rem)::INT AS size FROM lay),
units AS (SELECT series_id, unit, {lam}::DOUBLE AS p, steps FROM iv WHERE size > 0),
{hits_sql()}
SELECT h.series_id, step, unit AS interval_id, lo + floor({member} * size)::BIGINT AS cand_id,
  (lo + floor({member} * size)::BIGINT) * {R} AS start_pos FROM hits h JOIN iv USING (series_id, unit)
"""


@query("sample_spaced_forecast", spaced_sql(25, 0.4))
def sample_spaced_forecast(spark, sf):
    return sp.spaced(fx.events(spark, sf), K, L, R, BATCH, 0.4, fx.SEED, rounding="ceil")


@query("sample_spaced_class", spaced_sql(33, 0.3))
def sample_spaced_class(spark, sf):
    return sp.spaced(fx.events(spark, sf), K, L, R, BATCH, 0.3, fx.SEED, rounding="floor", empty="skip")


@query("sample_fixed_spaced", spaced_sql(10, 1.0))
def sample_fixed_spaced(spark, sf):
    return sp.spaced(fx.events(spark, sf), K, L, R, BATCH, 1.0, fx.SEED)


@query("pss_partition", f"""
WITH {SIZED_SQL},
f AS (SELECT series_id, 'forecasting' AS mode, candidates // 25 AS base, candidates % 25 AS rem, unnest(generate_series(0, 24)) AS i FROM sized),
p AS (SELECT series_id, 'paper' AS mode, candidates // 25 AS base, candidates % 25 AS rem, unnest(generate_series(0, 24)) AS i FROM sized)
SELECT series_id, mode, i AS interval_id, i * base + least(i, rem) AS lo, (base + (i < rem)::INT)::BIGINT AS size, 0.4::DOUBLE AS activation FROM f
UNION ALL SELECT series_id, mode, i, i * base + greatest(0, i - (25 - rem)), (base + (i >= 25 - rem)::INT)::BIGINT, 0.4::DOUBLE FROM p
""")
def pss_partition(spark, sf):
    sized = sp.candidate_counts(fx.events(spark, sf), K, L, R, BATCH)
    parts = [sp.pss_partition(sized, K, BATCH, 0.4, m).withColumn("mode", F.lit(m)) for m in ("forecasting", "paper")]
    out = parts[0].unionByName(parts[1])
    return out.select("series_id", "mode", "interval_id", "lo", "size", "activation")


@query("pss_draw", spaced_sql(25, 0.4).replace(
    "unit * base + least(unit, rem) AS lo, base + (unit < rem)::INT AS size",
    "unit * base + greatest(0, unit - (25 - rem)) AS lo, base + (unit >= 25 - rem)::INT AS size"))
def pss_draw(spark, sf):
    sized = sp.candidate_counts(fx.events(spark, sf), K, L, R, BATCH)
    return sp.draw_members(sp.pss_partition(sized, K, BATCH, 0.4, "paper"), K, R, fx.SEED)


@query("sample_structured_wr", f"""
WITH {SIZED_SQL}, d AS (SELECT series_id, candidates, unnest(generate_series(0, steps * {BATCH} - 1)) AS d FROM sized)
SELECT series_id, d // {BATCH} AS step, d % {BATCH} AS slot, floor({fx.u_sql("'slot'", "series_id", "d")} * candidates)::BIGINT AS cand_id,
  floor({fx.u_sql("'slot'", "series_id", "d")} * candidates)::BIGINT * {R} AS start_pos FROM d
""")
def sample_structured_wr(spark, sf):
    return sp.structured_wr(fx.events(spark, sf), K, L, R, BATCH, fx.SEED)


@query("balanced_intervals", f"""
WITH {fx.SERIES_SQL}, n AS (SELECT series_id, count(*) AS n FROM series GROUP BY 1),
c AS (SELECT series_id, pos AS cand_id FROM series JOIN n USING (series_id) WHERE pos <= n - {L} AND n - {L} + 1 >= {BATCH})
SELECT series_id, cand_id, ntile(12) OVER (PARTITION BY series_id ORDER BY cand_id) - 1 AS interval_id FROM c
""")
def balanced_intervals(spark, sf):
    cand = sp.candidates(fx.series(spark, sf), K, "pos", L, R, BATCH)
    return sp.balanced_intervals(cand, 12, "cand_id", "candidates").select("series_id", "cand_id", "interval_id")


@query("lambda_grid", f"""
WITH {SIZED_SQL}, g AS (SELECT series_id, 1.0::DOUBLE / (candidates // {BATCH}) AS lower FROM sized),
v AS (SELECT series_id, least(1.0::DOUBLE, lower + i * 0.05::DOUBLE) AS lam FROM (
  SELECT *, unnest(generate_series(0, floor((1.0::DOUBLE - lower) / 0.05::DOUBLE)::BIGINT)) AS i FROM g)
  UNION ALL SELECT series_id, 1.0 FROM g)
SELECT series_id, round(lam, 9) AS lam FROM (SELECT DISTINCT series_id, lam FROM v)
""")
def lambda_grid(spark, sf):
    sized = sp.candidate_counts(fx.events(spark, sf), K, L, R, BATCH)
    return sp.lambda_grid(sized, "candidates", BATCH, 0.05).select("series_id", F.round("lam", 9).alias("lam"))


def geometry_sql(tag, event, span):
    return f"""SELECT '{tag}' AS kind, series_id, n, greatest((n - {span}) // 3 + 1, 0) AS candidates, {event} AS event_length,
  least(greatest((n - {span}) // 3 + 1, 0), ({event} + {span} - 2) // 3 + 1) AS affected FROM n"""


CEIL_SQL = "greatest(1, ceil(0.05::DOUBLE * n))::BIGINT"
INT_SQL = "floor(0.05::DOUBLE * n)::BIGINT"


@query("sampling_geometry", f"""
WITH n AS (SELECT user_id AS series_id, count(*) AS n FROM events GROUP BY 1),
o AS (SELECT o_custkey AS series_id, count(*) AS n FROM orders GROUP BY 1),
g AS ({geometry_sql('ceil', CEIL_SQL, 10)} UNION ALL {geometry_sql('int', INT_SQL, 10)} UNION ALL {geometry_sql('forecast', CEIL_SQL, 14)}),
p AS (SELECT sum(n)::BIGINT AS n, sum(candidates)::BIGINT AS candidates, max(candidates) AS most FROM g WHERE kind = 'ceil')
SELECT * FROM g
UNION ALL SELECT 'pooled', NULL, n, candidates, {CEIL_SQL}, least(most, ({CEIL_SQL} + 8) // 3 + 1) FROM p
UNION ALL SELECT 'orders', series_id, n, n, {CEIL_SQL}, least(n, {CEIL_SQL}) FROM o
""")
def sampling_geometry(spark, sf):
    ev = fx.events(spark, sf)
    ceil = sp.geometry(ev, K, 10, 3, 0.05)
    parts = [ceil.withColumn("kind", F.lit("ceil")),
             sp.geometry(ev, K, 10, 3, 0.05, event_rounding="int").withColumn("kind", F.lit("int")),
             sp.geometry(ev, K, 10, 3, 0.05, horizon=4).withColumn("kind", F.lit("forecast")),
             sp.pooled_geometry(ceil, 10, 3, 0.05).withColumn("kind", F.lit("pooled"))
             .withColumn("series_id", F.lit(None).cast("bigint"))]
    orders = fx.read_table(spark, sf, "orders").select(F.col("o_custkey").alias("series_id"))
    parts.append(sp.geometry(orders, K, 1, 1, 0.05).withColumn("kind", F.lit("orders")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "series_id", "n", "candidates", "event_length", "affected")


@query("batch_stats", f"""
WITH RECURSIVE draws AS ({spaced_sql(25, 0.4)}), {SIZED_SQL},
st AS (SELECT series_id, steps, unnest(generate_series(0, steps - 1)) AS step FROM sized),
c AS (SELECT st.series_id, st.steps, st.step, count(d.cand_id) AS c FROM st LEFT JOIN draws d ON d.series_id = st.series_id AND d.step = st.step GROUP BY 1, 2, 3)
SELECT series_id, steps, round(avg(c), 6) AS size_mean, round(stddev_pop(c), 6) AS size_std, min(c) AS size_min, max(c) AS size_max,
  round(pow(0.6::DOUBLE, 25), 12) AS p_empty, round(25 * 0.4::DOUBLE, 6) AS expected FROM c GROUP BY 1, 2
""")
def batch_stats(spark, sf):
    ev = fx.events(spark, sf)
    sized = sp.candidate_counts(ev, K, L, R, BATCH).select("series_id", "steps")
    draws = sp.spaced(ev, K, L, R, BATCH, 0.4, fx.SEED)
    out = sp.batch_stats(draws, sized, K)
    count = sp.interval_count(BATCH, 0.4, "ceil")
    return out.select("series_id", "steps", r6(F.col("size_mean"), "size_mean"), r6(F.col("size_std"), "size_std"), "size_min",
                      "size_max", F.round(F.pow(F.lit(1.0 - 0.4), F.lit(float(count))), 12).alias("p_empty"),
                      r6(F.lit(count * 0.4), "expected"))
