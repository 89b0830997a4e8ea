"""Vector statistics and the sampler covariance study."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.operators import moments as mo
from chronoveil.operators.split import pooled_position
from chronoveil.plans import fixtures as fx
from chronoveil.plans.registry import query
from chronoveil.plans.sampling_queries import hits_sql

DIMS, BUCKETS, BATCH, TRIALS, INTERVALS, LAM, REPS = 64, 16, 20, 50, 40, 0.5, 20


def r6(c, name):
    return F.round(c, 6).alias(name)


def r9(c, name):
    return F.round(c, 9).alias(name)


def population(spark, sf):
    """Vectors with their index 0..n-1 and the population size."""
    v = fx.vectors(spark, sf)
    return v.withColumn("n", v.agg(F.count(F.lit(1))).scalar())


SKETCH_SQL = fx.VECTORS_SQL + f""",
sk AS (SELECT vec_id, label, seed, floor({fx.u_sql("'bucket'", 'seed', "'v'", 'd', seed='sketch')} * {BUCKETS})::INT AS bucket,
  x * CASE WHEN {fx.u_sql("'sign'", 'seed', "'v'", 'd', seed='sketch')} < 0.5 THEN -1.0::DOUBLE ELSE 1.0 END AS x FROM dims, (VALUES (42), (43), (44)) t(seed)),
sketch AS (SELECT vec_id, label, seed, bucket, sum(x) AS x FROM sk GROUP BY 1, 2, 3, 4)
"""


def sketched(spark, sf, keys=("vec_id",)):
    return mo.count_sketch(fx.vectors(spark, sf), list(keys), "v", DIMS, BUCKETS, [42, 43, 44])


@query("count_sketch", f"""
WITH {SKETCH_SQL} SELECT vec_id, seed, bucket, round(x, 6) AS x FROM sketch
""")
def count_sketch(spark, sf):
    return sketched(spark, sf).select("vec_id", "seed", "bucket", r6(F.col("x"), "x"))


@query("vec_norms", f"""
WITH {fx.VECTORS_SQL}, nn AS (SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n, abs(v[1]) AS l FROM vecs),
c AS (SELECT *, n * least(1.0, 0.9::DOUBLE / (n + 1e-12::DOUBLE)) AS cn FROM nn)
SELECT label, round(avg(n), 6) AS raw_norm_mean, round(stddev_pop(n), 6) AS raw_norm_std, round(avg(cn), 6) AS clipped_norm_mean,
  round(stddev_pop(cn), 6) AS clipped_norm_std, round(avg(l), 6) AS loss_mean, round(stddev_pop(l), 6) AS loss_std FROM c GROUP BY 1
""")
def vec_norms(spark, sf):
    v = fx.vectors(spark, sf).withColumn("loss", F.abs(F.col("v")[0]))
    out = mo.norm_summary(v, ["label"], "v", "loss", 0.9)
    return out.select("label", *[r6(F.col(c), c) for c in out.columns if c != "label"])


COV_SQL = fx.VECTORS_SQL + """,
mu AS (SELECT d, avg(x) AS m FROM dims GROUP BY 1), ce AS (SELECT vec_id, dims.d, x - m AS x FROM dims JOIN mu USING (d)),
cov AS (SELECT a.d AS i, b.d AS j, avg(a.x * b.x) AS cov FROM ce a JOIN ce b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY 1, 2)
"""


@query("covariance_pop", f"""
WITH {COV_SQL} SELECT i::INT AS i, j::INT AS j, round(cov, 9) AS cov FROM cov
""")
def covariance_pop(spark, sf):
    return mo.covariance(fx.vectors(spark, sf), [], "v").select("i", "j", r9(F.col("cov"), "cov"))


@query("cov_metrics", f"""
WITH {COV_SQL} SELECT round(sum(CASE WHEN i = j THEN cov END), 9) AS trace, round(sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * cov * cov)), 9) AS frobenius FROM cov
""")
def cov_metrics(spark, sf):
    out = mo.trace_frobenius(mo.covariance(fx.vectors(spark, sf), [], "v"), [])
    return out.select(r9(F.col("trace"), "trace"), r9(F.col("frobenius"), "frobenius"))


@query("cov_spectrum", f"""
WITH RECURSIVE {fx.VECTORS_SQL}, pd AS (SELECT vec_id, vec_id % 2 AS part, d, x FROM dims), mu AS (SELECT part, d, avg(x) AS m FROM pd GROUP BY 1, 2),
ce AS (SELECT vec_id, part, d, x - m AS x FROM pd JOIN mu USING (part, d)),
mt AS MATERIALIZED (SELECT a.part AS part, a.d AS i, b.d AS j, avg(a.x * b.x) AS v FROM ce a JOIN ce b ON a.vec_id = b.vec_id GROUP BY 1, 2, 3),
{fx.projector_sql('hi', 'mt')}, top AS MATERIALIZED {fx.eigenvalue_sql('mt', 'hi')},
sh AS MATERIALIZED (SELECT part, i, j, CASE WHEN i = j THEN ev ELSE 0 END - v AS v FROM mt JOIN top USING (part)),
{fx.projector_sql('lo', 'sh')}, bot AS {fx.eigenvalue_sql('mt', 'lo')},
tf AS (SELECT part, sum(CASE WHEN i = j THEN v END) AS tr, sum(v * v) AS sq FROM mt GROUP BY 1)
SELECT part, round(tr, 6) AS trace, round(sqrt(sq), 6) AS frobenius, round(top.ev, 6) AS spectral, round(bot.ev, 6) AS minimum_eigenvalue,
  round(tr * tr / sq, 6) AS effective_rank FROM tf JOIN top USING (part) JOIN bot USING (part)
""")
def cov_spectrum(spark, sf):
    v = fx.vectors(spark, sf).withColumn("part", F.col("vec_id") % 2)
    out = mo.spectrum(mo.covariance(v, ["part"], "v"), ["part"])
    return out.select("part", *[r6(F.col(c), c) for c in out.columns if c != "part"])


BASE_UNITS = f"""pn AS (SELECT count(*) AS n FROM vecs),
units AS (SELECT 0 AS g, vec_id AS unit, least(1.0, {BATCH}.0::DOUBLE / n) AS p, {TRIALS}::BIGINT AS steps FROM vecs, pn)"""
POIS_UNITS = f"""pn AS (SELECT count(*) AS n FROM vecs),
iv AS (SELECT vec_id, ntile({INTERVALS}) OVER (ORDER BY vec_id) - 1 AS unit FROM vecs),
sp AS (SELECT unit, min(vec_id) AS lo, count(*) AS size FROM iv GROUP BY 1),
units AS (SELECT 0 AS g, unit, {LAM}::DOUBLE AS p, {TRIALS}::BIGINT AS steps FROM sp)"""
MEMBER = fx.u_sql("'trial_member'", "unit", "step")
DRAWS = {
    "baseline": (BASE_UNITS, "dr AS (SELECT step AS trial, unit AS vec_id FROM hits)"),
    "poisson": (POIS_UNITS, f"dr AS (SELECT step AS trial, lo + floor({MEMBER} * size)::BIGINT AS vec_id FROM hits JOIN sp USING (unit))"),
}


def estimator_sql(method: str) -> str:
    units, draws = DRAWS[method]
    return f"""
WITH RECURSIVE {fx.VECTORS_SQL}, {units}, {hits_sql('g')}, {draws},
est AS (SELECT trial, d, sum(x) / {BATCH} AS x FROM dr JOIN dims USING (vec_id) GROUP BY 1, 2)
SELECT '{method}' AS method, trial, d::INT AS d, round(x, 6) AS x FROM est
"""


def draws(spark, sf, method):
    return mo.trial_draws(population(spark, sf), "vec_id", "n", method, BATCH, TRIALS, fx.SEED, LAM, INTERVALS)


def estimator(spark, sf, method):
    return mo.estimators(fx.vectors(spark, sf), draws(spark, sf, method), "vec_id", "v", BATCH)


@query("sampling_estimators", f"""
SELECT * FROM ({estimator_sql('baseline')}) UNION ALL SELECT * FROM ({estimator_sql('poisson')})
""")
def sampling_estimators(spark, sf):
    both = [estimator(spark, sf, m).select(F.lit(m).alias("method"), "trial", "d", r6(F.col("x"), "x")) for m in ("baseline", "poisson")]
    return both[0].unionByName(both[1])


ANALYTIC_SQL = f"""
pn AS (SELECT count(*) AS n FROM vecs), iv AS (SELECT vec_id, ntile({INTERVALS}) OVER (ORDER BY vec_id) - 1 AS w FROM vecs),
sq AS (SELECT vec_id, sum(x * x) AS s FROM dims GROUP BY 1),
ms AS (SELECT w, avg(s) AS msq FROM sq JOIN iv USING (vec_id) GROUP BY 1),
mm AS (SELECT w, sum(m * m) AS mm FROM (SELECT w, d, avg(x) AS m FROM dims JOIN iv USING (vec_id) GROUP BY 1, 2) GROUP BY 1),
traces AS (SELECT 'baseline' AS method, ({BATCH} / any_value(n)::DOUBLE) * (1 - {BATCH} / any_value(n)::DOUBLE) * sum(s) / ({BATCH} * {BATCH}) AS trace FROM sq, pn
 UNION ALL SELECT 'poisson', greatest(0, sum({LAM} * msq - {LAM} * {LAM} * mm) / ({BATCH} * {BATCH})) FROM ms JOIN mm USING (w))
"""


def analytic(spark, sf):
    return mo.analytic_traces(population(spark, sf), "vec_id", "n", "v", BATCH, LAM, INTERVALS)


@query("analytic_traces", f"WITH {fx.VECTORS_SQL}, {ANALYTIC_SQL} SELECT method, round(trace, 9) AS trace FROM traces")
def analytic_traces(spark, sf):
    return analytic(spark, sf).select("method", r9(F.col("trace"), "trace"))


@query("method_report", f"""
WITH {fx.VECTORS_SQL}, {ANALYTIC_SQL}, b AS (SELECT trace AS b FROM traces WHERE method = 'baseline')
SELECT method, round(trace, 9) AS trace, round(trace / b, 6) AS ratio, round(1 - trace / b, 6) AS reduction FROM traces, b
""")
def method_report(spark, sf):
    out = mo.against_baseline(analytic(spark, sf), [], "method", "trace", "baseline")
    return out.select("method", r9(F.col("trace"), "trace"), r6(F.col("ratio"), "ratio"), r6(F.col("reduction"), "reduction"))


def boot_sql(role: str, name: str, cond: str) -> str:
    """CTE ``<name>(rep, trace)`` of the vectors whose label satisfies ``cond`` (index = rank inside the part)."""
    return f"""
v_{name} AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS idx, count(*) OVER () AS n FROM vecs WHERE {cond}),
t_{name} AS (SELECT rep, 0::BIGINT AS lo, greatest(10, ceil(log2(n)))::BIGINT AS l, n AS size, n AS t, n FROM (SELECT DISTINCT n FROM v_{name}), (SELECT unnest(generate_series(0, {REPS - 1})) AS rep)
  UNION ALL SELECT rep, lo + c * least(size, 1 << (l - 1)), l - 1, CASE c WHEN 0 THEN least(size, 1 << (l - 1)) ELSE size - least(size, 1 << (l - 1)) END,
    CASE c WHEN 0 THEN k ELSE t - k END, n
  FROM (SELECT *, CASE WHEN t = 0 OR part = size THEN t ELSE list_reduce(list_prepend({{'s': 0.0::DOUBLE, 'n': 0::BIGINT}}, list_transform(range(0, t), lambda j: {{
      's': exp(lgamma(t + 1) - lgamma(j + 1) - lgamma(t - j + 1) + j * ln(part / size) + (t - j) * ln((size - part) / size)), 'n': 0::BIGINT}})),
      lambda a, x: {{'s': a.s + x.s, 'n': a.n + (a.s + x.s <= u)::BIGINT}}).n END AS k
    FROM (SELECT *, least(size, 1 << (l - 1)) AS part, {fx.u_sql(f"'{role}'", 'rep', 'lo', 'l')} AS u FROM t_{name} WHERE l > 0)), (VALUES (0), (1)) v(c)
  WHERE c = 0 OR size > least(size, 1 << (l - 1))),
c_{name} AS (SELECT rep, n, lo AS idx, t AS c FROM t_{name} WHERE l = 0),
e_{name} AS (SELECT idx, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v_{name}),
d_{name} AS (SELECT rep, any_value(n) AS n, d, sum(c * x) AS s, sum(c * x * x) AS q FROM c_{name} JOIN e_{name} USING (idx) GROUP BY rep, d),
{name} AS (SELECT rep, greatest(0, sum(q / n - (s / n) * (s / n))) AS trace FROM d_{name} GROUP BY 1)
"""


def half(spark, sf, parity):
    """Vectors of even or odd labels (all without ``parity``) with their own index and size."""

    v = fx.vectors(spark, sf)
    if parity is not None:
        v = v.filter(F.col("label") % 2 == parity)
    placed = pooled_position(v.withColumn("one", F.lit(0).cast("bigint")), ["vec_id"], "one").withColumnRenamed("pool_pos", "idx")
    return placed.withColumn("n", v.agg(F.count(F.lit(1))).scalar()).select("idx", "n", "v")


@query("bootstrap_trace", f"""
WITH RECURSIVE {fx.VECTORS_SQL}, {boot_sql('boot', 'bt', 'true')}
SELECT round(quantile_cont(trace, 0.025), 6) AS low, round(quantile_cont(trace, 0.975), 6) AS high FROM bt
""")
def bootstrap_trace(spark, sf):
    traces = mo.bootstrap_traces(half(spark, sf, None), "idx", "n", "v", REPS, fx.SEED)
    return mo.interval_95(traces, []).select(r6(F.col("low"), "low"), r6(F.col("high"), "high"))


@query("bootstrap_compare", f"""
WITH RECURSIVE {fx.VECTORS_SQL}, {boot_sql('boot_a', 'ba', 'label % 2 = 0')}, {boot_sql('boot_b', 'bb', 'label % 2 = 1')},
p AS (SELECT bb.trace - ba.trace AS df, CASE WHEN ba.trace > 0 THEN bb.trace / ba.trace END AS rt FROM ba JOIN bb USING (rep))
SELECT round(quantile_cont(df, 0.025), 6) AS difference_low, round(quantile_cont(df, 0.975), 6) AS difference_high,
  round(quantile_cont(rt, 0.025), 6) AS ratio_low, round(quantile_cont(rt, 0.975), 6) AS ratio_high, round(avg((df < 0)::INT), 6) AS p_below FROM p
""")
def bootstrap_compare(spark, sf):
    a = mo.bootstrap_traces(half(spark, sf, 0), "idx", "n", "v", REPS, fx.SEED, role="boot_a")
    b = mo.bootstrap_traces(half(spark, sf, 1), "idx", "n", "v", REPS, fx.SEED, role="boot_b")
    out = mo.compare_traces(a, b)
    return out.select(*[r6(F.col(c), c) for c in out.columns])


SEED_SQL = SKETCH_SQL + """,
full_s AS (SELECT v.vec_id, v.label % 2 AS part, s.seed, b.bucket, coalesce(k.x, 0) AS x FROM vecs v, (VALUES (42), (43), (44)) s(seed),
  (SELECT unnest(generate_series(0, 15)) AS bucket) b LEFT JOIN sketch k ON k.vec_id = v.vec_id AND k.seed = s.seed AND k.bucket = b.bucket),
tr AS (SELECT seed, part, sum(v) AS trace FROM (SELECT seed, part, bucket, var_pop(x) AS v FROM full_s GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""


def seed_traces(spark, sf):
    """Trace of the sketched covariance per (seed, label parity); absent buckets are zeros."""
    v = fx.vectors(spark, sf).withColumn("part", (F.col("label") % 2).cast("int"))
    rows = mo.count_sketch(v, ["vec_id", "part"], "v", DIMS, BUCKETS, [42, 43, 44])
    sizes = v.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    per = rows.groupBy("seed", "part", "bucket").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = F.col("n")
    return per.join(sizes, "part").groupBy("seed", "part").agg(
        F.sum(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)).alias("trace"))


@query("seed_aggregate", f"""
WITH {SEED_SQL} SELECT part::INT AS part, round(avg(trace), 6) AS mean, round(stddev_pop(trace), 6) AS std, round(min(trace), 6) AS min, round(max(trace), 6) AS max FROM tr GROUP BY 1
""")
def seed_aggregate(spark, sf):
    out = mo.seed_aggregate(seed_traces(spark, sf), ["part"], ["trace"])
    return out.select("part", *[r6(F.col(c), c) for c in ("mean", "std", "min", "max")])


@query("seed_comparison", f"""
WITH {SEED_SQL}, raw AS (SELECT part, sum(v) AS t FROM (SELECT vecs.label % 2 AS part, d, var_pop(x) AS v FROM dims JOIN vecs USING (vec_id) GROUP BY 1, 2) GROUP BY 1),
rr AS (SELECT 1 - max(t) FILTER (part = 1) / max(t) FILTER (part = 0) AS r FROM raw),
w AS (SELECT seed, max(trace) FILTER (part = 0) AS b, max(trace) FILTER (part = 1) AS m FROM tr GROUP BY 1)
SELECT count(*) AS seeds, count_if(b > m)::BIGINT AS worse, round(avg((b > m)::INT), 6) AS worse_fraction, bool_and(b > m) AS worse_always,
  round(avg(1 - m / b - r), 6) AS bias_mean, round(stddev_pop(1 - m / b - r), 6) AS bias_std, count_if(1 - m / b - r > 0)::BIGINT AS favourable FROM w, rr
""")
def seed_comparison(spark, sf):
    wide = seed_traces(spark, sf).groupBy("seed").pivot("part", [0, 1]).agg(F.first("trace"))
    v = fx.vectors(spark, sf).withColumn("part", F.col("label") % 2)
    raw = (mo.exploded(v, ["part"], "v").groupBy("part", "d").agg(F.var_pop("x").alias("x")).groupBy("part").agg(F.sum("x").alias("t")))
    reduction = raw.agg((1.0 - F.max(F.when(F.col("part") == 1, F.col("t"))) / F.max(F.when(F.col("part") == 0, F.col("t"))))).scalar()
    out = mo.seed_comparison(wide.withColumn("raw", reduction), [], "0", "1", F.col("raw"))
    return out.select("seeds", "worse", r6(F.col("worse_fraction"), "worse_fraction"), "worse_always",
                      r6(F.col("bias_mean"), "bias_mean"), r6(F.col("bias_std"), "bias_std"), "favourable")
