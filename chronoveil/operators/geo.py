"""Great-circle neighbourhoods on a cell grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoveil.operators.position import join_sized
from chronoveil.session import scratch_path

EARTH_MILES = 3958.8
MILES_PER_DEGREE = EARTH_MILES * math.pi / 180.0


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = (F.pow(F.sin((b - a) / 2.0), 2)
         + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2.0), 2))
    return 2.0 * F.lit(EARTH_MILES) * F.atan2(F.sqrt(h), F.sqrt(1.0 - h))


class Grid:
    """Latitude/longitude cells not wider than ``side`` miles anywhere (longitude cells divide the full circle)."""

    def __init__(self, side: float, reach_miles: float):
        self.dlat = side / MILES_PER_DEGREE
        self.columns = math.ceil(360.0 / self.dlat)
        self.dlng = 360.0 / self.columns
        self.reach_lat = math.ceil(reach_miles / MILES_PER_DEGREE / self.dlat)
        self.reach_degrees = reach_miles / MILES_PER_DEGREE

    def cell(self, lat: Column, lng: Column) -> tuple[Column, Column]:
        row = F.floor((lat + 90.0) / self.dlat).cast("bigint")
        col = F.pmod(F.floor((lng + 180.0) / self.dlng).cast("bigint"), F.lit(self.columns))
        return row, col

    def around(self, df: DataFrame, lat: str, lng: str) -> DataFrame:
        """Copy each row to every cell that can hold a point within reach (``_row``, ``_col``)."""
        row, col = self.cell(F.col(lat), F.col(lng))
        # A degree of longitude shrinks with latitude; use the widest latitude in reach.
        edge = F.least(F.lit(89.9), F.abs(F.col(lat)) + self.reach_degrees)
        wide = F.ceil(self.reach_degrees / (F.cos(F.radians(edge)) * self.dlng)).cast("bigint")
        wide = F.least(wide, F.lit((self.columns - 1) // 2).cast("bigint"))
        rows = F.explode(F.sequence(row - self.reach_lat, row + self.reach_lat)).alias("_row")
        spread = df.select("*", rows, col.alias("_c0"), wide.alias("_w"))
        return (spread.withColumn("_col", F.explode(F.sequence(F.col("_c0") - F.col("_w"), F.col("_c0") + F.col("_w"))))
                .withColumn("_col", F.pmod("_col", F.lit(self.columns))).drop("_c0", "_w"))

    def tag(self, df: DataFrame, lat: str, lng: str) -> DataFrame:
        row, col = self.cell(F.col(lat), F.col(lng))
        return df.withColumn("_row", row).withColumn("_col", col)


#: Places of a cell, or points of a place, that are joined as one group.
_CELL_POINTS = 4096


def _in_parts(a: DataFrame, b: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part (``_i``, ``_j``) of their cell. A cell with more than ``bound`` places of ``b`` is cut into n parts of each side,
    and every part of one side meets every part of the other: n * n groups of a bounded size in place of one."""
    crowded = b.groupBy("_row", "_col").agg(F.count("*").alias("_n")).filter(F.col("_n") > bound)
    crowded = crowded.withColumn("_n", F.ceil(F.col("_n") / bound).cast("int"))
    hot = crowded.count()

    def cut(side: DataFrame, own: str, other: str, place: list[str]) -> DataFrame:
        tagged = join_sized(side, crowded, ["_row", "_col"], hot, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
        return tagged.withColumns({own: F.pmod(F.xxhash64(*place), F.col("_n")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col("_n") - 1))}).drop("_n")
    return cut(a, "_i", "_j", ["lat_a", "lng_a"]), cut(b, "_j", "_i", ["lat_b", "lng_b"])


def _close_places(places: DataFrame, miles: float, bound: int) -> DataFrame:
    """Places with each place in reach, itself included, their distance and the parts of their points: equi-join on cells, then the exact distance."""
    grid = Grid(miles, miles)
    side = lambda s: places.select(*[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lng", "n")])
    a, b = _in_parts(grid.around(side("a"), "lat_a", "lng_a"), grid.tag(side("b"), "lat_b", "lng_b"), bound)
    d = haversine_miles(F.col("lat_a"), F.col("lng_a"), F.col("lat_b"), F.col("lng_b"))
    # A join hint, as a broadcast of places or points would pass through the driver.
    met = a.join(b.hint("merge"), ["_row", "_col", "_i", "_j"]).withColumn("miles", d).filter(F.col("miles") < miles)
    alone = (F.col("n_a") == 1) & (F.col("lat_a") == F.col("lat_b")) & (F.col("lng_a") == F.col("lng_b"))
    parts = {f"_part_{s}": F.explode(F.sequence(F.lit(0), _parts(F.col(f"n_{s}"), bound) - 1)) for s in "ab"}
    out = met.filter(~alone).select("lat_a", "lng_a", "n_a", "lat_b", "lng_b", "n_b", "miles")
    for name, part in parts.items():
        out = out.withColumn(name, part)
    return out.drop("n_a", "n_b")


def _parts(n: Column, bound: int) -> Column:
    return F.ceil(n / F.lit(bound)).cast("int")


def close_pairs(points: DataFrame, miles: float, id: str = "id", lat: str = "lat", lng: str = "lng", cell_points: int = _CELL_POINTS) -> DataFrame:
    """All pairs (id_a < id_b) strictly closer than ``miles``.

    Distances are those of distinct places; the points of two places in reach of each other then meet, so points at one place cost a comparison
    of ids each, not a distance. Crowded cells and places are joined in parts: no task gets more than ``cell_points`` points against each other
    in a group, however many there are, and neither points nor places pass through the driver.
    """
    own = points.select(F.col(id).alias("id"), F.col(lat).alias("lat"), F.col(lng).alias("lng")).filter("lat IS NOT NULL AND lng IS NOT NULL")
    places = own.groupBy("lat", "lng").agg(F.count(F.lit(1)).alias("n"))
    links = _close_places(places, miles, cell_points)
    link = ["lat_a", "lng_a", "_part_a", "lat_b", "lng_b", "_part_b"]
    sizes = places.filter(F.col("n") > cell_points)

    def members(s: str) -> DataFrame:
        placed = own.join(sizes.hint("merge"), ["lat", "lng"], "left").select(
            F.col("id").alias(f"id_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lng").alias(f"lng_{s}"),
            F.pmod(F.xxhash64("id"), _parts(F.coalesce("n", F.lit(1)), cell_points)).cast("int").alias(f"_part_{s}"))
        return placed.join(links.hint("merge"), [f"lat_{s}", f"lng_{s}", f"_part_{s}"]).select(f"id_{s}", *link, *(["miles"] if s == "a" else []))
    return members("a").join(members("b").hint("merge"), link).filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b", "miles")


#: Points of a cell that a round looks at, the smallest ids first.
_PER_CELL = 16
#: Cells a tile is wide in the first round, how much wider each next round's are, and the widest.
_TILE, _WIDER, _WIDEST = 32, 8, 2048


def _distances(lat: float, lng: float, lats: np.ndarray, lngs: np.ndarray) -> np.ndarray:
    a, b = math.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + math.cos(a) * np.cos(b) * np.sin((np.radians(lngs) - math.radians(lng)) / 2) ** 2
    return 2 * EARTH_MILES * np.arctan2(np.sqrt(h), np.sqrt(1 - h))


class _Band:
    """Points of one row of cells."""

    def __init__(self):
        self.lat, self.lng, self.open = [], [], []

    def add(self, lat: float, lng: float, is_open: bool) -> None:
        self.lat.append(lat)
        self.lng.append(lng)
        self.open.append(is_open)


def _resolve(points: list[dict], reach_lat: int, miles: float) -> list[dict]:
    """Points of a tile that are certain to be kept, scanned by id. What lies outside of the tile, or was not sent, is open; a point is
    decided when no open point before it is in reach."""
    bands: dict[int, _Band] = {}
    taken: set = set()
    unsent: dict[int, list] = {}
    kept = []
    for p in sorted(points, key=lambda r: r["id"]):
        cell = (p["_row"], p["_col"])
        if cell in taken:  # two points of a cell are always too close
            continue
        near = range(p["_row"] - reach_lat, p["_row"] + reach_lat + 1)
        if p["marker"]:
            unsent.setdefault(p["_row"], []).append((p["lat"], p["lng"], cell))
            continue
        beaten = is_open = not p["own"]
        if p["own"]:
            for row in near:
                band = bands.get(row)
                if band:
                    close = _distances(p["lat"], p["lng"], np.array(band.lat), np.array(band.lng)) < miles
                    opened = np.array(band.open)
                    beaten = beaten or bool((close & ~opened).any())
                    is_open = is_open or bool((close & opened).any())
                # Unsent points of a cell are in reach of its marker, so they matter up to twice as far.
                for lat, lng, other in unsent.get(row, ()):
                    is_open = is_open or (other not in taken and _distances(p["lat"], p["lng"], np.array([lat]), np.array([lng]))[0] < 2 * miles)
            if beaten:
                continue
            if not is_open:
                kept.append(p)
                taken.add(cell)
        bands.setdefault(p["_row"], _Band()).add(p["lat"], p["lng"], is_open)
    return kept


def _round(undecided: DataFrame, grid: Grid, miles: float, side: int) -> DataFrame:
    """Points that this round finds kept: (id, lat, lng). A tile of ``side`` cells is one task's work, and gets a bounded number of
    points of each of its cells and of the cells around it."""
    spec = Window.partitionBy("_row", "_col").orderBy("id")
    first = undecided.withColumn("_n", F.row_number().over(spec)).filter(F.col("_n") <= _PER_CELL + 1)
    sent = first.withColumn("marker", F.col("_n") > _PER_CELL).drop("_n")
    copies = grid.around(sent.withColumns({"_r": F.col("_row"), "_c": F.col("_col")}).drop("_row", "_col"), "lat", "lng")
    tile = lambda row, col: F.struct(F.floor(row / side).alias("r"), F.floor(col / side).alias("c"))
    copies = copies.select("id", "lat", "lng", "marker", F.col("_r").alias("_row"), F.col("_c").alias("_col"), tile(F.col("_row"), F.col("_col")).alias("tile"))
    copies = copies.distinct().withColumn("own", F.col("tile") == tile(F.col("_row"), F.col("_col")))
    # A tile that only has copies of points around it has nothing to decide.
    tiles = copies.groupBy("tile").agg(F.collect_list(F.struct("id", "lat", "lng", "marker", "_row", "_col", "own")).alias("points")).filter(
        F.exists("points", lambda x: x["own"]))
    reach = grid.reach_lat

    @F.arrow_udf("array<struct<id:bigint,lat:double,lng:double>>")
    def resolve(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64())]))
        return pa.array([[{k: p[k] for k in ("id", "lat", "lng")} for p in _resolve(points, reach, miles)] for points in column.to_pylist()], kind)

    return tiles.select(F.inline(resolve("points")))


def separated_subset(points: DataFrame, miles: float, id: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Ids kept when points are scanned in id order and each kept point removes all points closer than ``miles``.

    The scan is replayed in rounds without building the pair table. Cells are so small that two points of a cell are
    always too close. A round scans the smallest undecided ids of the cells of a tile in one task, as far as no undecided
    point outside of the tile matters; kept points then remove their neighbours. A chain of points that decide each other is
    followed through a whole tile at once, and tiles grow from round to round as points get fewer. A spot that holds a third of all
    points sends a bounded number of them, so it costs linear work. Kept points are written to a table by each round.
    """
    spark = points.sparkSession
    grid = Grid(miles / math.sqrt(2.0) * 0.999, miles)
    folder = scratch_path(spark, "separated")
    schema = "id bigint, lat double, lng double, _row bigint, _col bigint"
    wide = points.select(F.col(id).cast("bigint").alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
    grid.tag(wide, "lat", "lng").write.parquet(f"{folder}/undecided-0")
    side, number = _TILE, 0
    while True:
        undecided = spark.read.schema(schema).parquet(f"{folder}/undecided-{number}")
        if number and undecided.isEmpty():
            return spark.read.schema("id bigint, lat double, lng double").parquet(f"{folder}/kept").select("id")
        _round(undecided, grid, miles, side).write.parquet(f"{folder}/kept/round={number}")
        winners = spark.read.schema("id bigint, lat double, lng double").parquet(f"{folder}/kept/round={number}").select(
            F.col("id").alias("hid"), F.col("lat").alias("hlat"), F.col("lng").alias("hlng"))
        close = haversine_miles(F.col("hlat"), F.col("hlng"), F.col("lat"), F.col("lng")) < miles
        gone = (grid.around(winners, "hlat", "hlng").join(undecided, ["_row", "_col"])
                .filter(close | (F.col("id") == F.col("hid"))).select("id").distinct())
        number, side = number + 1, min(side * _WIDER, _WIDEST)
        undecided.join(gone, "id", "left_anti").write.parquet(f"{folder}/undecided-{number}")
