"""Augmentation queries on 24-row windows (16 of context, 8 of target)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoveil.operators import augment as au
from chronoveil.plans import fixtures as fx
from chronoveil.plans.evaluation import WIN24_SQL, win24
from chronoveil.plans.registry import query

ID = ["series_id", "win_id"]


def long_rows(df, extra=()):
    rows = df.select(*ID, *extra, F.posexplode("x").alias("o", "value"))
    return rows.select(*ID, *extra, "o", F.round("value", 6).alias("value"))


def ids():
    return [F.col(c) for c in ID]


@query("aug_vflip", f"WITH {WIN24_SQL} SELECT series_id, win_id, o::INT AS o, -value AS value FROM win")
def aug_vflip(spark, sf):
    return long_rows(win24(spark, sf).withColumn("x", au.vertical_flip(F.col("x"))))


@query("aug_hflip", f"WITH {WIN24_SQL} SELECT series_id, win_id, (23 - o)::INT AS o, value FROM win")
def aug_hflip(spark, sf):
    return long_rows(win24(spark, sf).withColumn("x", au.horizontal_flip(F.col("x"))))


JITTER = f"({fx.u_sql(chr(39) + 'jitter' + chr(39), 'series_id', 'win_id', 'o')} - 0.5::DOUBLE) * 0.1::DOUBLE"


@query("aug_noise", f"WITH {WIN24_SQL} SELECT series_id, win_id, o::INT AS o, round(value + {JITTER}, 6) AS value FROM win")
def aug_noise(spark, sf):
    return long_rows(win24(spark, sf).withColumn("x", au.jitter(F.col("x"), ids(), fx.SEED)))


@query("aug_noise_input", f"""
WITH {WIN24_SQL} SELECT series_id, win_id, o::INT AS o, round(CASE WHEN o < 16 THEN value + {JITTER} ELSE value END, 6) AS value FROM win
""")
def aug_noise_input(spark, sf):
    return long_rows(win24(spark, sf).withColumn("x", au.jitter(F.col("x"), ids(), fx.SEED, upto=16)))


PARTNER_SQL = f"""
ids AS (SELECT DISTINCT series_id, win_id FROM win),
pa AS (SELECT *, row_number() OVER (ORDER BY {fx.u_sql("'first'", 'series_id', 'win_id')}) AS r FROM ids),
pb AS (SELECT series_id AS other_series_id, win_id AS other_win_id, row_number() OVER (ORDER BY {fx.u_sql("'second'", 'series_id', 'win_id')}) AS r FROM ids),
partner AS (SELECT * FROM pa JOIN pb USING (r))
"""


@query("aug_mix_pairs", f"""
WITH {WIN24_SQL}, {PARTNER_SQL}
SELECT p.series_id, p.win_id, other_series_id, other_win_id, x.o::INT AS o, round((x.value + y.value) / 2, 6) AS value FROM partner p
 JOIN win x ON x.series_id = p.series_id AND x.win_id = p.win_id JOIN win y ON y.series_id = other_series_id AND y.win_id = other_win_id AND y.o = x.o
""")
def aug_mix_pairs(spark, sf):
    return long_rows(au.mix_pairs(win24(spark, sf), ID, "x", fx.SEED), ["other_series_id", "other_win_id"])


@query("aug_upsample", f"""
WITH {WIN24_SQL}, s AS (SELECT DISTINCT series_id, win_id, floor({fx.u_sql("'segment'", 'series_id', 'win_id')} * 12)::INT AS st FROM win),
g AS (SELECT *, i, greatest(0.0::DOUBLE, (i + 0.5::DOUBLE) / 2 - 0.5::DOUBLE) AS q FROM s, (SELECT unnest(generate_series(0, 23)) AS i)),
h AS (SELECT *, floor(q)::INT AS lo, least(floor(q)::INT + 1, 11) AS hi, q - floor(q) AS w FROM g)
SELECT h.series_id, h.win_id, st AS start, i::INT AS o, round(a.value * (1 - w) + b.value * w, 6) AS value FROM h
 JOIN win a ON a.series_id = h.series_id AND a.win_id = h.win_id AND a.o = st + lo JOIN win b ON b.series_id = h.series_id AND b.win_id = h.win_id AND b.o = st + hi
""")
def aug_upsample(spark, sf):
    w = win24(spark, sf).withColumn("start", au.random_start(ids(), 24, fx.SEED))
    return long_rows(w.withColumn("x", au.upsample_half(F.col("x"), 24, F.col("start"))), ["start"])


ANGLE = "(2 * pi() * f * o / 24)"
# rfft bins f = 0..12 of each window as (re, im); a real signal is rebuilt with weight 2 on the inner bins.
DFT_SQL = WIN24_SQL + f""",
bins AS (SELECT series_id, win_id, f, sum(value * cos{ANGLE}) AS re, -sum(value * sin{ANGLE}) AS im
  FROM win, (SELECT unnest(generate_series(0, 12)) AS f) GROUP BY 1, 2, 3)
"""


def inverse_sql(bins: str, extra: str = "") -> str:
    return f"""SELECT series_id, win_id{extra}, o::INT AS o, round(sum(CASE WHEN f IN (0, 12) THEN 1 ELSE 2 END * (re * cos{ANGLE} - im * sin{ANGLE})) / 24, 6) AS value
FROM {bins}, (SELECT unnest(generate_series(0, 23)) AS o) GROUP BY series_id, win_id{extra}, o"""


def mask_sql(rate: float, seed: int) -> str:
    u = fx.u_sql("'bin'", "series_id", "win_id", "f", seed=seed)
    return f"""WITH {DFT_SQL}, kept AS (SELECT series_id, win_id, f, CASE WHEN {u} < {rate} THEN 0 ELSE re END AS re,
  CASE WHEN {u} < {rate} THEN 0 ELSE im END AS im FROM bins) {inverse_sql('kept')}"""


@query("aug_freq_mask", mask_sql(0.5, fx.SEED))
def aug_freq_mask(spark, sf):
    return long_rows(au.frequency_mask(win24(spark, sf), ID, "x", 24, 0.5, fx.SEED))


@query("aug_freq_dropout", mask_sql(0.2, fx.SEED + 1))
def aug_freq_dropout(spark, sf):
    return long_rows(au.frequency_mask(win24(spark, sf), ID, "x", 24, 0.2, fx.SEED + 1))


@query("aug_freq_mix", f"""
WITH {DFT_SQL}, {PARTNER_SQL},
od AS (SELECT series_id, win_id, f, row_number() OVER (PARTITION BY series_id, win_id ORDER BY re * re + im * im DESC) - 1 AS slot FROM bins),
mixed AS (SELECT a.series_id, a.win_id, p.other_series_id, p.other_win_id, a.f,
   CASE WHEN {fx.u_sql("'bin'", "a.series_id", "a.win_id", "a.f")} < 0.5 AND od.f > 2 THEN b.re ELSE a.re END AS re,
   CASE WHEN {fx.u_sql("'bin'", "a.series_id", "a.win_id", "a.f")} < 0.5 AND od.f > 2 THEN b.im ELSE a.im END AS im
   FROM bins a JOIN partner p ON p.series_id = a.series_id AND p.win_id = a.win_id
   JOIN bins b ON b.series_id = p.other_series_id AND b.win_id = p.other_win_id AND b.f = a.f
   JOIN od ON od.series_id = a.series_id AND od.win_id = a.win_id AND od.slot = a.f)
{inverse_sql('mixed', ', other_series_id, other_win_id')}
""")
def aug_freq_mix(spark, sf):
    return long_rows(au.frequency_mix(win24(spark, sf), ID, "x", 24, 0.5, fx.SEED), ["other_series_id", "other_win_id"])
