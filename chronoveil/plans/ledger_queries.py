"""Per-tenant privacy ledgers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chronoveil.operators import ledger as lg
from chronoveil.operators import sampling as sp
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query

K = fx.KEYS
GEO = ["candidates", "affected"]
L, R, BATCH, SIGMA, DELTA = 8, 1, 5, 4.0, 1e-5
LOG_DELTA = math.log(1.0 / DELTA)


def r6(c, name):
    return F.round(c, 6).alias(name)


def tenants(spark, sf):
    """One row per user: candidates and affected windows. Users with fewer windows than a batch are not sampled and have no ledger."""
    return sp.geometry(fx.events(spark, sf), K, L, R, 0.04, short="drop", batch=BATCH)


def geometries(spark, sf):
    return tenants(spark, sf).select(*GEO).distinct()


TENANT_SQL = f"""
n AS (SELECT user_id AS series_id, count(*) AS n FROM events GROUP BY 1),
tn AS (SELECT series_id, (n - {L}) // {R} + 1 AS candidates,
  least((n - {L}) // {R} + 1, (greatest(1, ceil(0.04::DOUBLE * n))::BIGINT + {L} - 2) // {R} + 1) AS affected FROM n
  WHERE (n - {L}) // {R} + 1 >= {BATCH}),
geo AS (SELECT DISTINCT candidates, affected FROM tn)
"""


def alphas(high: int) -> str:
    return f"(SELECT unnest(generate_series(2, {high})) AS alpha)"


CONV_SQL = f"(({LOG_DELTA}::DOUBLE + (alpha - 1) * ln(1.0::DOUBLE - 1.0::DOUBLE / alpha) - ln(alpha::DOUBLE)) / (alpha - 1))"
LNC_SQL = "(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1))"


def poisson_sql(high: int, coef: str) -> str:
    """CTE ``rp(candidates, affected, alpha, rdp)``."""
    return f"""
t0 AS (SELECT candidates, affected, affected AS m, least(1.0, {BATCH}.0::DOUBLE / candidates) AS q FROM geo),
t1 AS (SELECT *, unnest(generate_series(0, m)) AS k FROM t0, {alphas(high)}),
t2 AS (SELECT *, {LNC_SQL} + (m - k) * ln(1.0::DOUBLE - q) + k * ln(q) + {coef} * alpha * (alpha - 1) * k * k / ({SIGMA}::DOUBLE * {SIGMA}::DOUBLE) AS x FROM t1),
t3 AS (SELECT *, max(x) OVER (PARTITION BY candidates, affected, alpha) AS top FROM t2),
rp AS (SELECT candidates, affected, alpha, greatest(0, (any_value(top) + ln(sum(exp(x - top)))) / (alpha - 1)) AS rdp FROM t3 GROUP BY 1, 2, 3)
"""


def poisson_rdp(geo, high=63, distance=1):
    return lg.rdp_poisson(geo.withColumn("q", F.lit(float(BATCH)) / F.col("candidates")), "q", "affected", SIGMA, 2, high,
                          distance)


@query("rdp_poisson", f"""
WITH {TENANT_SQL}, {poisson_sql(63, '0.5::DOUBLE')}
SELECT series_id, alpha::INT AS alpha, round(rdp, 6) AS rdp FROM tn JOIN rp USING (candidates, affected)
""")
def rdp_poisson(spark, sf):
    out = lg.memoised(tenants(spark, sf), GEO, poisson_rdp)
    return out.select("series_id", "alpha", r6(F.col("rdp"), "rdp"))


# Per tenant, one hit probability per label: the share of that label among the rows of the tenant.
SHARE_SQL = fx.EVENTS_SQL + """,
c AS (SELECT series_id, event_type, count(*) AS c FROM ev GROUP BY 1, 2),
s AS (SELECT series_id, list(c / t::DOUBLE ORDER BY event_type) AS ps FROM (SELECT *, sum(c) OVER (PARTITION BY series_id) AS t FROM c) GROUP BY 1)
"""
PMF_SQL = """
pmf AS (SELECT series_id, ps, 0 AS i, 0 AS j, 1.0::DOUBLE AS p FROM s
  UNION ALL SELECT series_id, ps, i, j, sum(p) AS p FROM (
    SELECT series_id, ps, i + 1 AS i, j + h AS j, p * CASE h WHEN 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END AS p
    FROM pmf, (VALUES (0), (1)) t(h) WHERE i < len(ps)) GROUP BY 1, 2, 3, 4)
"""


def label_shares(spark, sf):
    counts = fx.events(spark, sf).groupBy("series_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    packed = counts.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "c"))).alias("e"),
                                             F.sum("c").alias("t"))
    return packed.select("series_id", F.transform("e", lambda x: x["c"] / F.col("t")).alias("ps"))


@query("bernoulli_sum_pmf", f"""
WITH RECURSIVE {SHARE_SQL}, {PMF_SQL}
SELECT series_id, j::INT AS j, round(p, 9) AS p FROM pmf WHERE i = len(ps)
""")
def bernoulli_sum_pmf(spark, sf):
    pmf = label_shares(spark, sf).select("series_id", F.posexplode(lg.bernoulli_sum_pmf(F.col("ps"))).alias("j", "p"))
    return pmf.select("series_id", "j", F.round("p", 9).alias("p"))


@query("rdp_moment", f"""
WITH RECURSIVE {SHARE_SQL}, {PMF_SQL},
x AS (SELECT series_id, alpha, ln(p) + 2.0::DOUBLE * alpha * (alpha - 1) * j * j / 100.0::DOUBLE AS x FROM pmf, {alphas(64)} WHERE i = len(ps) AND p > 0),
t AS (SELECT *, max(x) OVER (PARTITION BY series_id, alpha) AS top FROM x)
SELECT series_id, t.alpha::INT AS alpha, round(greatest(0, (any_value(top) + ln(sum(exp(x - top)))) / (t.alpha - 1)), 6) AS rdp FROM t GROUP BY series_id, t.alpha
""")
def rdp_moment(spark, sf):
    pmf = label_shares(spark, sf).select("series_id", lg.bernoulli_sum_pmf(F.col("ps")).alias("pmf"))
    rows = lg.with_orders(pmf, 2, 64)
    return rows.select("series_id", "alpha", r6(lg.moment_rdp(F.col("pmf"), F.col("alpha"), 10.0), "rdp"))


def patterns_sql(count: str) -> str:
    """CTE ``pat(candidates, affected, cnt, pattern)`` from ``shape(candidates, affected, cnt)``."""
    return f"""
b AS (SELECT candidates, affected, cnt, i, i * (candidates // cnt) + least(i, candidates % cnt) AS lo,
  (i + 1) * (candidates // cnt) + least(i + 1, candidates % cnt) AS hi FROM (SELECT *, unnest(generate_series(0, {count} - 1)) AS i FROM shape)),
st AS (SELECT *, unnest(generate_series(0, candidates - affected)) AS s FROM shape),
hit AS (SELECT st.candidates, st.affected, st.cnt, s, least(hi, s + st.affected) - greatest(lo, s) AS h, hi - lo AS size
  FROM st JOIN b ON st.candidates = b.candidates AND st.affected = b.affected AND st.cnt = b.cnt AND lo < s + st.affected AND hi > s),
pat AS (SELECT DISTINCT candidates, affected, cnt, pattern FROM (
  SELECT candidates, affected, cnt, s, list({{'h': h, 'size': size}} ORDER BY h, size) AS pattern FROM hit GROUP BY 1, 2, 3, 4))
"""


@query("affected_patterns", f"""
WITH {TENANT_SQL}, shape AS (SELECT candidates, affected, 13 AS cnt FROM geo), {patterns_sql('cnt')}
SELECT candidates, affected, list_aggregate(list_transform(pattern, lambda e: e.h::VARCHAR || '/' || e.size::VARCHAR), 'string_agg', ',') AS pattern FROM pat
""")
def affected_patterns(spark, sf):
    out = lg.affected_patterns(geometries(spark, sf), GEO, "candidates", "affected", F.lit(13))
    text = F.array_join(F.transform("pattern", lambda e: F.concat_ws("/", e["hits"], e["size"])), ",")
    return out.select(*GEO, text.alias("pattern"))


def pss_sql(lam: str) -> str:
    """CTE ``rs(candidates, affected, lam, alpha, rdp)`` from ``rated(candidates, affected, cnt, lam, pattern)``."""
    return f"""
pp AS (SELECT row_number() OVER () AS id, candidates, affected, lam, list_transform(pattern, lambda e: {lam} * e.h / e.size::DOUBLE) AS ps FROM rated),
cv AS (SELECT id, ps, 0 AS i, 0 AS j, 1.0::DOUBLE AS p FROM pp
  UNION ALL SELECT id, ps, i, j, sum(p) AS p FROM (
    SELECT id, ps, i + 1 AS i, j + h AS j, p * CASE h WHEN 1 THEN ps[i + 1] ELSE 1 - ps[i + 1] END AS p
    FROM cv, (VALUES (0), (1)) t(h) WHERE i < len(ps)) GROUP BY 1, 2, 3, 4),
mx AS (SELECT id, alpha, ln(p) + 2.0::DOUBLE * alpha * (alpha - 1) * j * j / ({SIGMA}::DOUBLE * {SIGMA}::DOUBLE) AS x FROM cv, {alphas(64)} WHERE i = len(ps) AND p > 0),
my AS (SELECT *, max(x) OVER (PARTITION BY id, alpha) AS top FROM mx),
mz AS (SELECT id, alpha, greatest(0, (any_value(top) + ln(sum(exp(x - top)))) / (alpha - 1)) AS r FROM my GROUP BY 1, 2),
rs AS (SELECT candidates, affected, lam, alpha, max(r) AS rdp FROM mz JOIN pp USING (id) GROUP BY 1, 2, 3, 4)
"""


@query("rdp_pss", f"""
WITH RECURSIVE {TENANT_SQL}, shape AS (SELECT candidates, affected, 13 AS cnt FROM geo), {patterns_sql('cnt')},
rated AS (SELECT *, 0.4::DOUBLE AS lam FROM pat), {pss_sql('lam')}
SELECT candidates, affected, alpha::INT AS alpha, round(rdp, 6) AS rdp FROM rs
""")
def rdp_pss(spark, sf):
    pats = lg.affected_patterns(geometries(spark, sf), GEO, "candidates", "affected", F.lit(13))
    out = lg.rdp_pss(pats, GEO, F.lit(0.4), SIGMA)
    return out.select(*GEO, "alpha", r6(F.col("rdp"), "rdp"))


def b0_sql(sigma: float) -> str:
    """CTE ``bm(…, alpha, c, m)`` from ``sp(…, z, w)`` (spacing and affected windows)."""
    return f"""
ba AS (SELECT *, alpha * (alpha - 1) / (2.0::DOUBLE * {sigma} * {sigma}) AS c,
  ceil(w / 2.0::DOUBLE) / z - ceil((w - z) / 2.0::DOUBLE) / z - 0.5::DOUBLE AS rho FROM sp),
bb AS (SELECT *, exp(-9 * c) - 3 * exp(-8 * c) + 3 * exp(-5 * c) - 1 AS qa,
  (2 * rho - 1) * (exp(-9 * c) - 2 * exp(-8 * c) + exp(-5 * c)) AS qb,
  exp(-9 * c) * (rho - 0.5::DOUBLE) ^ 2 - (2 * rho * rho + 0.5::DOUBLE) * exp(-8 * c) + (rho + 0.5::DOUBLE) ^ 2 * exp(-5 * c) AS qc FROM ba),
bc AS (SELECT *, CASE WHEN z > w THEN 0.5::DOUBLE WHEN qb * qb - 4 * qa * qc < 0 OR qa = 0 THEN 0
  ELSE greatest(0, (-qb - sqrt(greatest(0, qb * qb - 4 * qa * qc))) / (2 * qa)) END AS b0 FROM bb),
bm AS (SELECT *, greatest(floor((w - (2 * ceil(b0 * z) - 1)) / z), 0) AS m FROM bc)
"""


@query("rdp_spaced_fixed", f"""
WITH {TENANT_SQL},
sp AS (SELECT candidates, affected, alpha, (candidates // {BATCH})::DOUBLE AS z, affected::DOUBLE AS w FROM geo, {alphas(63)}), {b0_sql(SIGMA)},
x AS (SELECT *, ((m + 2) * z - w) ^ 2 / (4 * z * z) AS c1, ((m + 2) * z - w) * (w - m * z) / (2 * z * z) AS c2, (w - m * z) ^ 2 / (4 * z * z) AS c3 FROM bm)
SELECT candidates, affected, alpha::INT AS alpha, round((c * (m + 2) ^ 2 + ln(c1 * exp(c * (m ^ 2 - (m + 2) ^ 2)) + c2 * exp(c * ((m + 1) ^ 2 - (m + 2) ^ 2)) + c3)) / (alpha - 1), 6) AS rdp FROM x
""")
def rdp_spaced_fixed(spark, sf):
    geo = geometries(spark, sf).withColumn("spacing", F.floor(F.col("candidates") / BATCH))
    out = lg.rdp_spaced_fixed(geo, "spacing", "affected", SIGMA)
    return out.select(*GEO, "alpha", r6(F.col("rdp"), "rdp"))


def spaced_rdp_sql(high: int) -> str:
    """CTE ``rd(candidates, affected, lam, alpha, log_base)`` from ``grid(candidates, affected, lam)``."""
    return f"""
sp AS (SELECT candidates, affected, lam, alpha, affected::DOUBLE AS w, greatest(1, floor({BATCH} / lam)) AS cnt,
  greatest(1, floor(candidates / greatest(1, floor({BATCH} / lam))))::DOUBLE AS z, {BATCH} / greatest(1, floor({BATCH} / lam)) AS xi FROM grid, {alphas(high)}),
{b0_sql(SIGMA)},
sw AS (SELECT *, floor((w - m * z) / 2) / z AS a1, ceil((w - m * z) / 2) / z AS a2 FROM bm),
sv AS (SELECT *, (1 - xi) ^ 2 + (1 - xi) * xi * (2 - a1 - a2) + xi * xi * (1 - a1) * (1 - a2) AS w0,
  (1 - xi) * xi * (a1 + a2) + xi * xi * ((1 - a1) * a2 + (1 - a2) * a1) AS w1, xi * xi * a1 * a2 AS w2 FROM sw),
sr AS (SELECT *, unnest(generate_series(0, m::BIGINT)) AS k FROM sv),
sb AS (SELECT *, CASE WHEN xi = 1 THEN 0 ELSE {LNC_SQL} + (m - k) * ln(1 - xi) + k * ln(xi) END AS lb FROM sr),
sl AS (SELECT candidates, affected, lam, alpha, h, lb + ln(wt) + c * (k + h) * (k + h) AS x FROM (
   SELECT *, 0 AS h, w0 AS wt FROM sb UNION ALL SELECT *, 1, w1 FROM sb UNION ALL SELECT *, 2, w2 FROM sb) WHERE wt > 0),
sm AS (SELECT *, max(x) OVER (PARTITION BY candidates, affected, lam, alpha) AS top FROM sl),
rd AS (SELECT candidates, affected, lam, alpha, any_value(top) + ln(sum(exp(x - top))) AS log_base FROM sm GROUP BY 1, 2, 3, 4)
"""


@query("rdp_spaced_poisson", f"""
WITH {TENANT_SQL}, grid AS (SELECT *, unnest([0.5::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE]) AS lam FROM geo), {spaced_rdp_sql(63)}
SELECT candidates, affected, lam, alpha::INT AS alpha, round(log_base / (alpha - 1), 6) AS rdp FROM rd
""")
def rdp_spaced_poisson(spark, sf):
    geo = geometries(spark, sf).withColumn("lam", F.explode(F.array(F.lit(0.5), F.lit(0.8), F.lit(1.0))))
    out = lg.rdp_spaced_poisson(geo, "candidates", "affected", BATCH, "lam", SIGMA)
    return out.select(*GEO, "lam", "alpha", r6(F.col("rdp"), "rdp"))


@query("rdp_to_eps", f"""
WITH {TENANT_SQL}, {poisson_sql(63, '0.5::DOUBLE')},
e AS (SELECT candidates, affected, steps, CASE WHEN steps = 0 THEN 0 ELSE greatest(0, min(steps * rdp + {CONV_SQL})) END AS epsilon
  FROM rp, (VALUES (0), (1), (10), (100)) t(steps) GROUP BY 1, 2, 3)
SELECT series_id, steps::INT AS steps, round(epsilon, 6) AS epsilon FROM tn JOIN e USING (candidates, affected)
""")
def rdp_to_eps(spark, sf):
    packed = lg.memoised(tenants(spark, sf), GEO, lambda g: lg.collapse(poisson_rdp(g), GEO, DELTA))
    rows = packed.withColumn("steps", F.explode(F.array(*[F.lit(s) for s in (0, 1, 10, 100)])))
    return rows.select("series_id", "steps", r6(lg.epsilon_at(F.col("orders"), F.col("steps")), "epsilon"))


def steps_sql(source: str, keys: str, cap: str, rdp: str = "rdp") -> str:
    """CTE ``ms(<keys>, target, steps)``: largest step count by bisection-free search over the closed form."""
    return f"""
g0 AS (SELECT {keys}, target, least({cap}, floor(greatest(0, max(CASE WHEN {rdp} > 0 THEN (target - {CONV_SQL}) / {rdp}
   WHEN target >= {CONV_SQL} THEN 9e15::DOUBLE ELSE 0 END))))::BIGINT AS guess FROM {source} GROUP BY {keys}, target),
g1 AS (SELECT *, guess + dx AS t FROM g0, (VALUES (-1), (0), (1), (2)) v(dx) WHERE guess + dx >= 0),
g2 AS (SELECT {keys}, target, guess, t, CASE WHEN t = 0 THEN 0 ELSE greatest(0, min(t * {rdp} + {CONV_SQL})) END AS eps
   FROM g1 JOIN {source} USING ({keys}, target) GROUP BY {keys}, target, guess, t),
ms AS (SELECT {keys}, target, max(t) FILTER (eps <= target AND t <= guess + 1) AS steps FROM g2 GROUP BY {keys}, target)
"""


TARGETS = [1.0, 2.0, 4.0, 8.0]
TARGET_SQL = "(SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 4.0::DOUBLE, 8.0::DOUBLE]) AS target)"


@query("max_steps", f"""
WITH {TENANT_SQL}, {poisson_sql(63, '0.5::DOUBLE')}, src AS (SELECT * FROM rp, {TARGET_SQL}), {steps_sql('src', 'candidates, affected', '1000000')},
ev AS (SELECT ms.candidates, ms.affected, ms.target, steps, CASE WHEN steps = 0 THEN 0 ELSE greatest(0, min(steps * rdp + {CONV_SQL})) END AS e0,
   greatest(0, min((steps + 1) * rdp + {CONV_SQL})) AS e1 FROM ms JOIN rp USING (candidates, affected) GROUP BY 1, 2, 3, 4)
SELECT series_id, target, steps, round(e0, 6) AS epsilon, round(e1, 6) AS next_epsilon, e1 > target AS exhausted FROM tn JOIN ev USING (candidates, affected)
""")
def max_steps(spark, sf):
    def plan(geo):
        packed = lg.collapse(poisson_rdp(geo), GEO, DELTA)
        targets = packed.withColumn("target", F.explode(F.array(*[F.lit(t) for t in TARGETS])))
        return lg.max_steps(targets, "orders", F.col("target"), 1_000_000).drop("orders")
    out = lg.memoised(tenants(spark, sf), GEO, plan)
    return out.select("series_id", "target", "steps", r6(F.col("epsilon"), "epsilon"),
                      r6(F.col("next_epsilon"), "next_epsilon"), "exhausted")


GRID_SQL = f"""
g_t AS (SELECT *, candidates // {BATCH} AS t FROM geo WHERE candidates // {BATCH} >= 2),
g_l AS (SELECT *, 1.0::DOUBLE / t + i * 0.01::DOUBLE AS lam FROM (SELECT *, unnest(generate_series(0, ceil((1.0::DOUBLE - 1.0::DOUBLE / t) / 0.01::DOUBLE)::BIGINT - 1)) AS i FROM g_t)),
grid AS (SELECT candidates, affected, lam FROM g_l WHERE greatest(1, floor({BATCH} / lam)) <= candidates AND floor(candidates / greatest(1, floor({BATCH} / lam))) >= 7)
"""


@query("select_lambda", f"""
WITH {TENANT_SQL}, {GRID_SQL}, {spaced_rdp_sql(64)},
src AS (SELECT candidates, affected, lam, alpha, log_base / (alpha - 1) AS rdp, 4.0::DOUBLE AS target FROM rd),
{steps_sql('src', 'candidates, affected, lam', f'100 * (any_value(candidates) // {BATCH})')},
be AS (SELECT candidates, affected, arg_max(lam, {{'s': steps, 'l': lam}}) AS lam, max(steps) AS steps, count(*) AS evaluated FROM ms GROUP BY 1, 2)
SELECT series_id, round(CASE WHEN steps > 0 THEN lam ELSE 1.0::DOUBLE / (candidates // {BATCH}) END, 6) AS lam, coalesce(steps, 0) AS max_steps,
  coalesce(evaluated, 0) AS evaluated, coalesce(steps, 0) > 0 AS feasible FROM tn LEFT JOIN be USING (candidates, affected)
""")
def select_lambda(spark, sf):
    out = lg.memoised(tenants(spark, sf), GEO, lambda g: lg.select_lambda(
        g, GEO, "candidates", "affected", BATCH, SIGMA, DELTA, 4.0))
    return out.select("series_id", r6(F.col("lam"), "lam"), "max_steps", "evaluated", "feasible")


@query("select_lambda_fixed_steps", f"""
WITH {TENANT_SQL}, {GRID_SQL}, {spaced_rdp_sql(63)},
lo AS (SELECT candidates, affected, lam, min(50 * log_base / (alpha - 1) + {CONV_SQL}) AS loss FROM rd GROUP BY 1, 2, 3)
SELECT candidates, affected, round(min(loss), 6) AS epsilon FROM lo GROUP BY 1, 2
""")
def select_lambda_fixed_steps(spark, sf):
    out = lg.select_lambda_fixed_steps(geometries(spark, sf), GEO, "candidates", "affected", BATCH, SIGMA, DELTA, 50)
    return out.select(*GEO, r6(F.col("epsilon"), "epsilon"))


@query("wr_hit_weights", f"""
WITH {TENANT_SQL}, h AS (SELECT *, affected / candidates::DOUBLE AS hit_probability, {BATCH} AS m, unnest(generate_series(0, {BATCH})) AS k FROM tn)
SELECT series_id, k::INT AS hits, round(hit_probability, 9) AS hit_probability, round(CASE WHEN hit_probability >= 1 THEN (k = m)::INT ELSE
  exp({LNC_SQL} + k * ln(hit_probability) + (m - k) * ln(1.0::DOUBLE - hit_probability)) END, 9) AS weight, (-2 * k)::DOUBLE AS mean_p, (2 * k)::DOUBLE AS mean_q FROM h
""")
def wr_hit_weights(spark, sf):
    out = lg.binomial_weights(tenants(spark, sf), F.col("affected") / F.col("candidates"), BATCH)
    return out.select("series_id", "hits", F.round("hit_probability", 9).alias("hit_probability"),
                      F.round("weight", 9).alias("weight"), "mean_p", "mean_q")


@query("budget_plan", f"""
WITH RECURSIVE {TENANT_SQL}, {poisson_sql(64, '2.0::DOUBLE')},
lr AS (SELECT *, 1.0::DOUBLE / (candidates // {BATCH}) AS lower FROM geo),
lv AS (SELECT candidates, affected, least(1.0::DOUBLE, lower + i * 0.2::DOUBLE) AS lam FROM (SELECT *, unnest(generate_series(0, floor((1.0::DOUBLE - lower) / 0.2::DOUBLE)::BIGINT)) AS i FROM lr)
  UNION SELECT candidates, affected, 1.0::DOUBLE FROM geo),
tried AS (SELECT *, ceil({BATCH} / lam)::BIGINT AS cnt FROM lv WHERE ceil({BATCH} / lam) BETWEEN {BATCH} AND candidates),
shape AS (SELECT DISTINCT candidates, affected, cnt FROM tried), {patterns_sql('cnt')},
rated AS (SELECT pat.*, lam FROM pat JOIN tried USING (candidates, affected, cnt)), {pss_sql('lam')},
allr AS (SELECT 'poisson' AS method, candidates, affected, -1.0::DOUBLE AS lam, alpha, rdp FROM rp UNION ALL SELECT 'pss', candidates, affected, lam, alpha, rdp FROM rs),
src AS (SELECT * FROM allr, {TARGET_SQL}), {steps_sql('src', 'method, candidates, affected, lam', '100000')},
be AS (SELECT method, candidates, affected, target, arg_max(lam, {{'s': steps, 'l': lam}}) AS lam, max(steps) AS steps FROM ms GROUP BY 1, 2, 3, 4),
ev AS (SELECT be.method, be.candidates, be.affected, be.target, be.lam, steps, CASE WHEN steps = 0 THEN 0 ELSE greatest(0, min(steps * rdp + {CONV_SQL})) END AS e0,
   greatest(0, min((steps + 1) * rdp + {CONV_SQL})) AS e1 FROM be JOIN allr ON be.method = allr.method AND be.candidates = allr.candidates AND be.affected = allr.affected AND be.lam = allr.lam GROUP BY 1, 2, 3, 4, 5, 6)
SELECT series_id, method, target, round(CASE WHEN lam >= 0 THEN lam END, 6) AS lam, steps, round(e0, 6) AS epsilon, round(e1, 6) AS next_epsilon, e1 > target AS exhausted
FROM tn JOIN ev USING (candidates, affected)
""")
def budget_plan(spark, sf):
    out = lg.memoised(tenants(spark, sf), GEO, lambda g: lg.budget_plan(
        g, GEO, BATCH, SIGMA, DELTA, TARGETS, 100_000, 0.2))
    return out.select("series_id", "method", "target", r6(F.col("lam"), "lam"), "steps", r6(F.col("epsilon"), "epsilon"),
                      r6(F.col("next_epsilon"), "next_epsilon"), "exhausted")
