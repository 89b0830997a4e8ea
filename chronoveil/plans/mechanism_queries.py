"""Clipping, noise, randomised response and private stream release."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.operators import mechanisms as me
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS
# Public bounds of the released channel: its range and its largest step.
VALUE_RANGE = 500.0


def r6(c, name):
    return F.round(c, 6).alias(name)


NORM_SQL = "sqrt(list_sum(list_transform(v, lambda x: x * x)))"
CLIP_SQL = fx.VECTORS_SQL + f""",
nrm AS (SELECT vec_id, label, {NORM_SQL} AS norm FROM vecs),
fac AS (SELECT *, least(1.0, 0.9::DOUBLE / (norm + 1e-12::DOUBLE)) AS factor FROM nrm)
"""


@query("clip_l2", f"""
WITH {CLIP_SQL} SELECT vec_id, d::INT AS d, round(x * factor, 6) AS x FROM dims JOIN fac USING (vec_id)
""")
def clip_l2(spark, sf):
    out = me.clip_l2(fx.vectors(spark, sf), "v", 0.9)
    return out.select("vec_id", F.posexplode("clipped").alias("d", "x")).select("vec_id", "d", r6(F.col("x"), "x"))


@query("private_vector_mean", f"""
WITH {CLIP_SQL}, s AS (SELECT dims.label, d, sum(x * factor) AS s FROM dims JOIN fac USING (vec_id) GROUP BY 1, 2)
SELECT label, d::INT AS d, round(s / 40, 6) AS mean, round((s + {fx.gaussian_sql(fx.u_sql("'noise1'", 'label', 'd'), fx.u_sql("'noise2'", 'label', 'd'))} * 0.9::DOUBLE) / 40, 6) AS private_mean,
 round((s + {fx.gaussian_sql(fx.u_sql("'noise1'", 'label', 'd'), fx.u_sql("'noise2'", 'label', 'd'))} * 1.8::DOUBLE) / 40, 6) AS private_mean_2c FROM s
""")
def private_vector_mean(spark, sf):
    v = fx.vectors(spark, sf)
    one = me.private_vector_mean(v, ["label"], "v", 0.9, 1.0, 40, fx.SEED)
    two = me.private_vector_mean(v, ["label"], "v", 0.9, 1.0, 40, fx.SEED, noise_scale=2.0)
    both = one.join(two.select("label", "d", F.col("private_mean").alias("p2")), ["label", "d"])
    return both.select("label", "d", r6(F.col("mean"), "mean"), r6(F.col("private_mean"), "private_mean"),
                       r6(F.col("p2"), "private_mean_2c"))


@query("clip_stats", f"""
WITH {CLIP_SQL} SELECT label, round(avg((norm > 0.9)::INT), 6) AS clipped_fraction, round(avg(norm), 6) AS norm_mean,
  round(avg(norm * factor), 6) AS clipped_norm_mean, round(avg(abs(v[1])), 6) AS loss_mean FROM fac JOIN vecs USING (vec_id, label) GROUP BY 1
""")
def clip_stats(spark, sf):
    v = fx.vectors(spark, sf).withColumn("loss", F.abs(F.col("v")[0]))
    out = me.clip_stats(v, ["label"], "v", "loss", 0.9)
    return out.select("label", *[r6(F.col(c), c) for c in out.columns if c != "label"])


@query("laplace_release", f"""
WITH {fx.EVENTS_SQL} SELECT event_id, round(value + {fx.laplace_sql(fx.u_sql("'laplace'", "'value'", 'event_id'), '250.0::DOUBLE')}, 6) AS value_noisy,
  round(k + {fx.laplace_sql(fx.u_sql("'laplace'", "'k'", 'event_id'), '250.0::DOUBLE')}, 6) AS k_noisy FROM ev
""")
def laplace_release(spark, sf):
    out = me.laplace_release(fx.events(spark, sf), ["event_id"], ["value", "k"], VALUE_RANGE, 2.0, fx.SEED)
    return out.select("event_id", r6(F.col("value_noisy"), "value_noisy"), r6(F.col("k_noisy"), "k_noisy"))


@query("stream_sensitivity", f"""
WITH {fx.SERIES_SQL}, d AS (SELECT *, abs(value - lag(value) OVER w) AS dv, abs(k - lag(k) OVER w) AS dk FROM series
  WINDOW w AS (PARTITION BY series_id ORDER BY pos))
SELECT series_id, round(greatest(max(value) - min(value), max(k) - min(k)), 6) AS s_p, round(greatest(max(dv), max(dk)), 6) AS s_s FROM d GROUP BY 1
""")
def stream_sensitivity(spark, sf):
    out = me.stream_sensitivity(fx.series(spark, sf), K, "pos", ["value", "k"])
    return out.select("series_id", r6(F.col("s_p"), "s_p"), r6(F.col("s_s"), "s_s"))


DIS_SQL = fx.SERIES_SQL + """,
lg AS (SELECT *, value - lag(value) OVER w AS dv, k - lag(k) OVER w AS dk FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
dd AS (SELECT *, (abs(dv) + abs(dk)) / 2 AS dis, (dv * dv + dk * dk) / 2 AS sq FROM lg),
pr AS (SELECT *, count(CASE WHEN pos >= 2 AND sq > 0 THEN 1 END) OVER w AS c, sum(CASE WHEN pos >= 2 AND sq > 0 THEN sq END) OVER w AS q,
  sum(CASE WHEN pos >= 2 AND sq > 0 THEN dis END) OVER w AS a FROM dd
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 18 PRECEDING AND CURRENT ROW)),
proxied AS (SELECT *, CASE WHEN c > 0 THEN q / c - (a / c) * (a / c) ELSE 0 END AS proxy FROM pr)
"""


@query("stream_dissimilarity", f"""
WITH {DIS_SQL} SELECT series_id, pos, round(dis, 6) AS dis, round(sq, 6) AS sq, round(proxy, 6) AS proxy FROM proxied
""")
def stream_dissimilarity(spark, sf):
    out = me.stream_dissimilarity(fx.series(spark, sf), K, "pos", ["value", "k"], 10, 2)
    return out.select("series_id", "pos", r6(F.col("dis"), "dis"), F.round("sq", 6).alias("sq"), F.round("proxy", 6).alias("proxy"))


@query("optimal_c", f"""
WITH {DIS_SQL} SELECT series_id, pos, greatest(floor(sqrt(0.75::DOUBLE * 900 * proxy / (500.0::DOUBLE * 500.0)) / 3), 1)::BIGINT AS c FROM proxied
""")
def optimal_c(spark, sf):
    out = me.stream_dissimilarity(fx.series(spark, sf), K, "pos", ["value", "k"], 10, 2)
    return out.select("series_id", "pos", me.optimal_c(F.col("proxy"), 30.0, VALUE_RANGE, 10).alias("c"))


@query("budget_window_ledger", f"""
WITH {fx.SERIES_SQL}, e AS (SELECT series_id, pos, CASE WHEN event_id % 7 = 0 THEN 0.05::DOUBLE ELSE 0 END AS eps FROM series)
SELECT series_id, pos, round(0.75::DOUBLE - coalesce(sum(eps) OVER w, 0), 6) AS eps_remain,
  coalesce(min(CASE WHEN eps > 0 THEN pos END) OVER w, pos) AS first_sampled FROM e
WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)
""")
def budget_window_ledger(spark, sf):
    spent = fx.series(spark, sf).select("series_id", "pos", F.when(F.col("event_id") % 7 == 0, 0.05).otherwise(0.0).alias("eps"))
    out = me.budget_window_ledger(spent, K, "pos", "eps", 0.75, 20)
    return out.select("series_id", "pos", r6(F.col("eps_remain"), "eps_remain"), "first_sampled")


def release_sql(noise_ids: list[str], grid: str) -> str:
    """CTE ``rec``: the private release by recursion over positions, all streams in lockstep; W = 20, two windows of history.

    ``grid`` lists (epsilon, seed); ``noise_ids`` are the SQL identifiers behind the noise."""
    def unit(role: str) -> str:
        return fx.laplace_sql(fx.u_sql(f"'{role}'", *noise_ids, seed="spas"), "1.0::DOUBLE")

    ep, eq, r = "(0.75::DOUBLE * epsilon)", "(0.125::DOUBLE * epsilon)", f"{VALUE_RANGE}::DOUBLE"
    return f"""
base AS MATERIALIZED (SELECT series_id, epsilon::DOUBLE AS epsilon, seed, pos, value AS xv, k AS xk, {unit('value')} AS nv, {unit('k')} AS nk,
  {unit('query')} AS uq, {unit('threshold')} AS ut, (abs(value - pv0) + abs(k - pk0)) / 2 AS drift
  FROM (SELECT *, lag(value) OVER w AS pv0, lag(k) OVER w AS pk0 FROM series WINDOW w AS (PARTITION BY series_id ORDER BY pos)), {grid} g(epsilon, seed)),
rec AS (
  SELECT series_id, epsilon, seed, pos, [{ep}] AS eps, [0.0::DOUBLE] AS svt, [xv + nv * ({r} / {ep})] AS pv, [xk + nk * ({r} / {ep})] AS pk,
    1::BIGINT AS c, 0.0::DOUBLE AS rho FROM base WHERE pos = 0
  UNION ALL
  SELECT series_id, epsilon, seed, pos, eps, svt, pv, pk, CASE WHEN pos < 19 THEN 1 ELSE greatest(1, floor(sqrt(0.75::DOUBLE * greatest(0,
      coalesce(list_avg(list_transform(moved, lambda d: d.sq)) - list_avg(list_transform(moved, lambda d: d.ab)) ^ 2, 0))) * {ep} / {r} / 3)) END::BIGINT AS c, rho
  FROM (SELECT *, list_filter(list_transform(generate_series(greatest(2, pos - 38), pos), lambda q: {{
        'sq': ((pv[q + 1] - pv[q]) ^ 2 + (pk[q + 1] - pk[q]) ^ 2) / 2, 'ab': (abs(pv[q + 1] - pv[q]) + abs(pk[q + 1] - pk[q])) / 2}}), lambda d: d.sq > 0) AS moved
  FROM (SELECT series_id, epsilon, seed, pos, rho,
      list_append(eps, CASE mode WHEN 1 THEN remain / togo WHEN 2 THEN least(share, remain) ELSE 0 END) AS eps,
      list_append(svt, CASE mode WHEN 1 THEN rest WHEN 2 THEN {eq} / c ELSE 0 END) AS svt,
      list_append(pv, CASE mode WHEN 0 THEN pv[pos] ELSE xv + nv * ({r} / eff) END) AS pv, list_append(pk, CASE mode WHEN 0 THEN pk[pos] ELSE xk + nk * ({r} / eff) END) AS pk
    FROM (SELECT *, CASE mode WHEN 1 THEN remain / togo + rest ELSE least(share, remain) END AS eff
    FROM (SELECT *, greatest(0, {eq} - CASE WHEN first_used > 0 THEN coalesce(list_sum(hs[first_used:]), 0) ELSE 0 END) / c AS rest,
      CASE WHEN pos < 20 THEN 0 WHEN togo <= floor(remain / share + 1e-9::DOUBLE) THEN 1
        WHEN drift + uq * {r} * 2 * c / {eq} > c * {r} / {ep} + rho AND remain >= share * (1 - 1e-9::DOUBLE) THEN 2 ELSE 0 END AS mode
    FROM (SELECT *, CASE WHEN first_used > 0 THEN first_used ELSE 20 END AS togo
    FROM (SELECT *, {ep} - coalesce(list_sum(h), 0) AS remain, {ep} / c AS share, list_position(list_transform(h, lambda e: e > 0), true) AS first_used
    FROM (SELECT b.series_id AS series_id, b.epsilon AS epsilon, b.seed AS seed, b.pos AS pos, b.xv AS xv, b.xk AS xk, b.nv AS nv, b.nk AS nk, b.uq AS uq, b.drift AS drift,
        p.eps AS eps, p.svt AS svt, p.pv AS pv, p.pk AS pk, p.c AS c, CASE WHEN b.pos = 20 THEN b.ut * {r} / (0.125::DOUBLE * b.epsilon) ELSE p.rho END AS rho,
        list_slice(p.eps, greatest(1, b.pos - 18), b.pos) AS h, list_slice(p.svt, greatest(1, b.pos - 18), b.pos) AS hs
      FROM rec p JOIN base b ON b.series_id = p.series_id AND b.epsilon = p.epsilon AND b.seed = p.seed AND b.pos = p.pos + 1))))))))
"""


@query("spas_publish", f"""
WITH RECURSIVE {fx.SERIES_SQL}, {release_sql(['seed', '(epsilon * 1e6)::BIGINT', 'series_id', 'pos'], '(VALUES (1.0, 42), (1.0, 43), (4.0, 42), (4.0, 43))')}
SELECT series_id, epsilon, seed, pos, round(pv[pos + 1], 6) AS value, round(pk[pos + 1], 6) AS k, round(eps[pos + 1], 9) AS eps_used, round(svt[pos + 1], 9) AS svt_used FROM rec
""")
def spas_publish(spark, sf):
    out = me.publish_streams(fx.series(spark, sf), K, "pos", ["value", "k"], [1.0, 4.0], [42, 43], VALUE_RANGE, VALUE_RANGE, 20)
    return out.select("series_id", "epsilon", "seed", "pos", r6(F.col("value"), "value"), r6(F.col("k"), "k"),
                      F.round("eps_used", 9).alias("eps_used"), F.round("svt_used", 9).alias("svt_used"))


@query("spas_publish_active", f"""
WITH RECURSIVE {fx.SERIES_SQL}, {release_sql(['seed', '(epsilon * 1e6)::BIGINT', 'series_id', 'pos'], '(VALUES (200.0, 42), (1000.0, 42))')}
SELECT series_id, epsilon, seed, pos, round(pv[pos + 1], 4) AS value, round(eps[pos + 1], 6) AS eps_used, round(svt[pos + 1], 6) AS svt_used, (eps[pos + 1] > 0) AS released FROM rec
""")
def spas_publish_active(spark, sf):
    """Budgets at which a window holds several releases."""
    out = me.publish_streams(fx.series(spark, sf), K, "pos", ["value", "k"], [200.0, 1000.0], [42], VALUE_RANGE, VALUE_RANGE, 20)
    return out.select("series_id", "epsilon", "seed", "pos", F.round("value", 4).alias("value"), F.round("eps_used", 6).alias("eps_used"),
                      F.round("svt_used", 6).alias("svt_used"), (F.col("eps_used") > 0).alias("released"))


GRR_SQL = fx.SERIES_SQL + f""",
lab AS (SELECT event_id, event_type, ({fx.CODE_SQL} + 1)::INT AS label, count(*) OVER (PARTITION BY series_id) AS n FROM series)
"""


def grr_sql(eps: str) -> str:
    keep, other = fx.u_sql("'keep'", "event_id"), fx.u_sql("'other'", "event_id")
    return f"""grr AS (SELECT *, CASE WHEN {keep} < exp({eps}) / (exp({eps}) + 4) THEN label
  ELSE (floor({other} * 4) + 1 + (floor({other} * 4) + 1 >= label)::INT)::INT END AS noisy_label FROM lab)"""


@query("grr_label", f"""
WITH {GRR_SQL}, {grr_sql('(2.0::DOUBLE / ceil(n * 0.005::DOUBLE / 20))')} SELECT event_id, label, noisy_label FROM grr
""")
def grr_label(spark, sf):
    ev = fx.events(spark, sf).select("series_id", "event_id", (fx.event_code() + 1).alias("label"))
    sized = ev.join(ev.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")), K)
    out = me.randomised_response(sized, ["event_id"], "label", me.grr_row_epsilon(2.0, F.col("n"), 20), 5, fx.SEED)
    return out.select("event_id", "label", "noisy_label")


@query("grr_debias", f"""
WITH {GRR_SQL}, {grr_sql('1.0::DOUBLE')}, c AS (SELECT noisy_label, count(*) AS observed FROM grr GROUP BY 1),
p AS (SELECT exp(1.0::DOUBLE) / (exp(1.0::DOUBLE) + 4) AS p, (1 - exp(1.0::DOUBLE) / (exp(1.0::DOUBLE) + 4)) / 4 AS q, sum(observed) AS n FROM c)
SELECT noisy_label, observed, round((observed - n * q) / (p - q), 4) AS estimate FROM c, p
""")
def grr_debias(spark, sf):
    ev = fx.events(spark, sf).select("event_id", (fx.event_code() + 1).alias("label"))
    noisy = me.randomised_response(ev, ["event_id"], "label", 1.0, 5, fx.SEED)
    out = me.debias_counts(noisy, [], "noisy_label", 1.0, 5)
    return out.select("noisy_label", "observed", F.round("estimate", 4).alias("estimate"))
