"""Joins with polygons that a GeoPackage holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.operators.polygons import edges_of, hulls, lines_meeting, lines_within, nearest_hulls, polygons_of
from riverspark.plans.base import Catalog, basins, dams
from riverspark.plans.joins import CELL, lines
from riverspark.plans.scans import _local
from riverspark.session import shared_folder
from riverspark.sources.geopackage import GeoPackageSource

C = Catalog()

#: Each basin's box with a notch from the right side to its centre, as the tables have boxes only.
_E = """pe AS (SELECT hybas_id, continent, e.* FROM (SELECT hybas_id, continent, unnest([
  {'x1': min_x, 'y1': min_y, 'x2': max_x, 'y2': min_y}, {'x1': max_x, 'y1': min_y, 'x2': (min_x + max_x) / 2, 'y2': (min_y + max_y) / 2},
  {'x1': (min_x + max_x) / 2, 'y1': (min_y + max_y) / 2, 'x2': max_x, 'y2': max_y}, {'x1': max_x, 'y1': max_y, 'x2': min_x, 'y2': max_y}, {'x1': min_x, 'y1': max_y, 'x2': min_x, 'y2': min_y}]) AS e FROM basins))"""


def _in_sql(points: str, pid: str, x: str, y: str) -> str:
    """Ray casting: points with the polygons whose edges a ray to the right meets an odd number of times."""
    return f"SELECT {pid}, pe.hybas_id, pe.continent FROM {points} JOIN pe ON (y1 > {y}) <> (y2 > {y}) AND {x} < x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1"


_PIN = _E + ", pin AS (" + _in_sql("da", "dam_id", "x", "y") + ")"


def _side(a: tuple[str, str], b: tuple[str, str], p: tuple[str, str]) -> str:
    return f"sign(({b[0]} - {a[0]}) * ({p[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({p[0]} - {a[0]}))"


_A, _B, _P, _Q = ("ax", "ay"), ("bx", "by_"), ("x1", "y1"), ("x2", "y2")
_LINES = _E + f""", lm AS (SELECT goid * 1000 + seg_no AS sid, from_x AS ax, from_y AS ay, to_x AS bx, to_y AS by_ FROM mainstems),
lin AS ({_in_sql("lm", "sid", "ax", "ay")}),
lx AS (SELECT DISTINCT sid, hybas_id FROM lm JOIN pe ON least(ax, bx) <= greatest(x1, x2) AND least(x1, x2) <= greatest(ax, bx) AND least(ay, by_) <= greatest(y1, y2) AND least(y1, y2) <= greatest(ay, by_)
  AND {_side(_A, _B, _P)} * {_side(_A, _B, _Q)} <= 0 AND {_side(_P, _Q, _A)} * {_side(_P, _Q, _B)} <= 0)"""


def layer(spark: SparkSession, d: str, **options: str) -> DataFrame:
    """The polygons as the GeoPackage source reads them; 180 of them, written on the driver."""
    spark.dataSource.register(GeoPackageSource)
    path = _local(shared_folder(spark)) / "polygons.gpkg"
    rows = []
    for r in basins(spark, d).select("hybas_id", "continent", "min_x", "min_y", "max_x", "max_y").toLocalIterator():
        x0, y0, x1, y1 = r["min_x"], r["min_y"], r["max_x"], r["max_y"]
        rows.append((r["hybas_id"], r["continent"], [[(x0, y0), (x1, y0), ((x0 + x1) / 2, (y0 + y1) / 2), (x1, y1), (x0, y1), (x0, y0)]]))
    GeoPackageSource.write_polygons(str(path), "basins", rows)
    return spark.read.format("geopackage").option("layer", "basins").options(**options).load(str(path))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return edges_of(layer(spark, d), "hybas_id")


def inside(spark: SparkSession, d: str) -> DataFrame:
    return polygons_of(dams(spark, d).select("dam_id", "x", "y"), edges(spark, d), "hybas_id", "x", "y", CELL)


@C.add("WITH " + _PIN + " SELECT d.dam_id, coalesce(continent, 'Unknown') AS continent FROM da d LEFT JOIN pin USING (dam_id)", "da")
def jon1_points_in_polygons(spark, d):
    """Dams with the continent of the polygon that holds them, else Unknown."""
    named = inside(spark, d).join(basins(spark, d).select("hybas_id", "continent"), "hybas_id").select("dam_id", "continent")
    return dams(spark, d).select("dam_id").join(named, "dam_id", "left").select("dam_id", F.coalesce("continent", F.lit("Unknown")).alias("continent"))


@C.add("WITH " + _PIN + " SELECT hybas_id, dam_id FROM pin", "da")
def jon2_points_in_polygon_basins(spark, d):
    """Dams inside polygons, the others left out."""
    return inside(spark, d).select("hybas_id", "dam_id")


@C.add("WITH " + _PIN + " SELECT d.dam_id, pin.hybas_id AS part_id FROM da d LEFT JOIN pin USING (dam_id)", "da")
def jon3_polygon_partition_ids(spark, d):
    """All dams, with only the id of their polygon."""
    return dams(spark, d).select("dam_id").join(inside(spark, d).select("dam_id", F.col("hybas_id").alias("part_id")), "dam_id", "left")


@C.add("WITH " + _LINES + " SELECT sid, hybas_id FROM lx UNION SELECT sid, hybas_id FROM lin")
def jon4_lines_meeting_polygons(spark, d):
    """Pieces of mainstems with the polygons they touch, cross or lie in."""
    return lines_meeting(lines(spark, d), edges(spark, d), "hybas_id", CELL)


@C.add("WITH " + _LINES + " SELECT sid FROM lm WHERE sid NOT IN (SELECT sid FROM lin WHERE (sid, hybas_id) NOT IN (SELECT (sid, hybas_id) FROM lx))")
def jon5_lines_within_no_polygon(spark, d):
    """Pieces of mainstems that lie in no polygon whole."""
    s = lines(spark, d)
    return s.select("sid").join(lines_within(s, edges(spark, d), "hybas_id", CELL), "sid", "left_anti")


@C.add()
def jon6_nearest_hull(spark, d):
    """The continent whose convex hull is nearest to each dam; a tie goes to the first name. Without SQL, which lacks hulls; tests hold it against brute force."""
    b = basins(spark, d).where("continent IS NOT NULL")
    corner = b.select("continent", F.inline(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("min_x", "max_x") for y in ("min_y", "max_y")])))
    return nearest_hulls(dams(spark, d).select("dam_id", "x", "y"), hulls(corner, "continent", "x", "y"), "dam_id", "x", "y", "continent")


@C.add("SELECT hybas_id, 5 AS n_edges, round((max_x - min_x) * (max_y - min_y) * 0.75::DOUBLE / 1e6, 1) AS area FROM basins")
def src1_geopackage_polygons(spark, d):
    """Polygons out of the GeoPackage's geometries, with their edges and areas."""
    twice = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))
    return edges(spark, d).groupBy("hybas_id").agg(F.count(F.lit(1)).cast("int").alias("n_edges"), F.round(F.abs(twice) / 2 / 1e6, 1).alias("area"))


@C.add("SELECT hybas_id, min_x, max_y FROM basins WHERE continent IN ('Asia', 'Africa')")
def src4_geopackage_where(spark, d):
    """One column of a layer's rows that meet a condition; both are left to the file's own engine."""
    return layer(spark, d, columns="hybas_id", where="continent IN ('Asia', 'Africa')").select("hybas_id", "min_x", "max_y")
