"""Role of each test table, as a DataFrame and as the matching SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoveil.operators.position import with_position
from chronoveil.sources.tables import read_table

SEED = 42
KEYS = ["series_id"]


def u_sql(*parts: str, seed: int = SEED) -> str:
    """SQL twin of ``functions.rng.uniform``."""
    inner = ", ".join(["'%s'" % seed, *parts])
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), 1, 13))::BIGINT / 4503599627370496::DOUBLE)"


def open_sql(u: str) -> str:
    return f"({u} + 1.1102230246251565e-16::DOUBLE)"


def laplace_sql(u: str, scale: str) -> str:
    c = f"({open_sql(u)} - 0.5::DOUBLE)"
    return f"(-({scale}) * sign({c}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs({c})))"


def gaussian_sql(u1: str, u2: str) -> str:
    return f"(sqrt(-2.0::DOUBLE * ln({open_sql(u1)})) * cos(6.283185307179586::DOUBLE * {u2}))"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with ``t_us`` (epoch microseconds) and the second channel ``k`` taken from the JSON column."""
    return (read_table(spark, sf, "events")
            .select(F.col("user_id").alias("series_id"), F.unix_micros("ts").alias("t_us"), "ts", "event_id",
                    "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k")))


EVENTS_SQL = """
ev AS (SELECT user_id AS series_id, epoch_us(ts) AS t_us, ts, event_id, event_type, value,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Events as one series per user with explicit positions."""
    return with_position(events(spark, sf), KEYS, "t_us", ["event_id"])


SERIES_SQL = EVENTS_SQL + """,
series AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t_us, event_id) - 1 AS pos FROM ev)
"""

# Fixed class codes: the event types in sorted order.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def event_code(col: str = "event_type"):
    return (F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col(col)) - 1).cast("int")


CODE_SQL = "(list_position(['click','error','purchase','signup','view'], event_type) - 1)::INT"


def coded_series(spark: SparkSession, sf: str) -> DataFrame:
    return series(spark, sf).withColumn("label", event_code())


CODED_SQL = SERIES_SQL + f", coded AS (SELECT *, {CODE_SQL} AS label FROM series)\n"


def gappy_series(spark: SparkSession, sf: str) -> DataFrame:
    """Series whose value is missing on every 11th event."""
    return series(spark, sf).withColumn("value", F.when(F.col("event_id") % 11 != 0, F.col("value")))


GAPPY_SQL = SERIES_SQL + """,
gappy AS (SELECT * REPLACE (CASE WHEN event_id % 11 <> 0 THEN value END AS value) FROM series)
"""


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One long series: total price per order date, as day number and value."""
    return (read_table(spark, sf, "orders")
            .groupBy(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
                     .cast("bigint").alias("day"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
            .withColumn("series_id", F.lit("orders")))


DAILY_SQL = """
daily AS (SELECT 'orders' AS series_id, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day,
                 round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2)
"""


def projector_sql(name: str, matrix: str, squarings: int = 13) -> str:
    """CTE ``<name>(part, i, j, v)``: projector on the top eigenvector of a symmetric ``matrix(part, i, j, v)``.

    The matrix is squared again and again and kept at trace 1; 13 squarings are its 8192nd power."""
    return f"""
{name}_p AS (SELECT 0 AS k, part, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY part) AS v FROM {matrix}
  UNION ALL SELECT k, part, i, j, v / sum(CASE WHEN i = j THEN v END) OVER (PARTITION BY part) AS v FROM (
    SELECT a.k + 1 AS k, a.part AS part, a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM {name}_p a JOIN {name}_p b ON a.part = b.part AND a.j = b.i
    WHERE a.k < {squarings} GROUP BY a.k, a.part, a.i, b.j)),
{name} AS MATERIALIZED (SELECT part, i, j, v FROM {name}_p WHERE k = {squarings})"""


def eigenvalue_sql(matrix: str, projector: str) -> str:
    """Subquery (part, ev): Rayleigh quotient of a matrix on a projector."""
    return f"(SELECT part, sum(m.v * p.v) AS ev FROM {matrix} m JOIN {projector} p USING (part, i, j) GROUP BY part)"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


VECTORS_SQL = """
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM vecs)
"""
