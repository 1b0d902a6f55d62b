"""Joins by place, by key and by range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.operators.nearest import nearest_segments
from riverspark.operators.network import dense_ids
from riverspark.operators.proximity import near_pairs
from riverspark.operators.skew import salted_join
from riverspark.operators.spatial import knn, nearest_regions, overlaps, regions_of, segments_meeting
from riverspark.operators.tables import copy_by_key
from riverspark.plans.base import Catalog, basin_table, basins, dams, layer, reaches, settled, table
from riverspark.plans.columns import corners
from riverspark.plans.scans import OBB, RASTER, cells
from riverspark.sources.raster import align_nearest, pixel_latitudes

C = Catalog()
CELL = 1_000_000.0


def continents(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of each continent's basins; they may overlap."""
    return basins(spark, d).where("continent IS NOT NULL").groupBy("continent").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


CONT = "ct AS (SELECT continent, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM basins WHERE continent IS NOT NULL GROUP BY 1)"


@C.add("SELECT d.dam_id, coalesce(b.continent, 'Unknown') AS continent FROM da d LEFT JOIN basins b ON d.x > min_x AND d.x < max_x AND d.y > min_y AND d.y < max_y", "da")
def jon1_points_in_regions(spark, d):
    """Dams with the continent of the box that holds them, else Unknown."""
    p = dams(spark, d).select("dam_id", "x", "y")
    inside = regions_of(p, basins(spark, d), "hybas_id", "x", "y", CELL)
    named = inside.join(basins(spark, d).select("hybas_id", "continent"), "hybas_id").select("dam_id", "continent")
    return p.select("dam_id").join(named, "dam_id", "left").select("dam_id", F.coalesce("continent", F.lit("Unknown")).alias("continent"))


@C.add("SELECT b.hybas_id, d.dam_id FROM da d JOIN basins b ON d.x > min_x AND d.x < max_x AND d.y > min_y AND d.y < max_y", "da")
def jon2_points_in_basins(spark, d):
    return regions_of(dams(spark, d).select("dam_id", "x", "y"), basins(spark, d), "hybas_id", "x", "y", CELL).select("hybas_id", "dam_id")


@C.add("SELECT d.dam_id, b.hybas_id AS part_id FROM da d LEFT JOIN basins b ON d.x > min_x AND d.x < max_x AND d.y > min_y AND d.y < max_y", "da")
def jon3_partition_ids(spark, d):
    """All dams, with only the id of their basin."""
    p = dams(spark, d).select("dam_id", "x", "y")
    inside = regions_of(p, basins(spark, d), "hybas_id", "x", "y", CELL).select("dam_id", F.col("hybas_id").alias("part_id"))
    return p.select("dam_id").join(inside, "dam_id", "left")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mainstems").select((F.col("goid") * 1000 + F.col("seg_no")).alias("sid"), F.col("from_x").alias("ax"), F.col("from_y").alias("ay"), F.col("to_x").alias("bx"), F.col("to_y").alias("by"))


_HIT = """lm AS (SELECT goid * 1000 + seg_no AS sid, from_x AS ax, from_y AS ay, to_x AS bx, to_y AS by_, goid FROM mainstems),
lt AS (SELECT sid, goid, hybas_id, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN min_x AND max_x THEN 0 ELSE 2 END ELSE least((min_x-ax)/(bx-ax), (max_x-ax)/(bx-ax)) END AS e1, CASE WHEN bx = ax THEN 1 ELSE greatest((min_x-ax)/(bx-ax), (max_x-ax)/(bx-ax)) END AS l1,
  CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN min_y AND max_y THEN 0 ELSE 2 END ELSE least((min_y-ay)/(by_-ay), (max_y-ay)/(by_-ay)) END AS e2, CASE WHEN by_ = ay THEN 1 ELSE greatest((min_y-ay)/(by_-ay), (max_y-ay)/(by_-ay)) END AS l2 FROM lm, basins),
lh AS (SELECT DISTINCT sid, goid, hybas_id FROM lt WHERE greatest(0, e1, e2) <= least(1, l1, l2))"""


@C.add("WITH " + _HIT + " SELECT sid, hybas_id FROM lh")
def jon4_lines_meeting_basins(spark, d):
    """Pieces of mainstems with the basins they touch; one may touch several."""
    return segments_meeting(lines(spark, d), basins(spark, d), "hybas_id", CELL)


@C.add("WITH " + _HIT + " SELECT sid FROM lm WHERE NOT EXISTS (SELECT 1 FROM basins WHERE ax BETWEEN min_x AND max_x AND bx BETWEEN min_x AND max_x AND ay BETWEEN min_y AND max_y AND by_ BETWEEN min_y AND max_y)")
def jon5_lines_within_no_basin(spark, d):
    """Pieces of mainstems that lie in no basin whole."""
    s = lines(spark, d)
    a = regions_of(s, basins(spark, d), "hybas_id", "ax", "ay", CELL, strict=False).select("sid", "hybas_id")
    b = regions_of(s, basins(spark, d), "hybas_id", "bx", "by", CELL, strict=False).select("sid", "hybas_id")
    return s.select("sid").join(a.join(b, ["sid", "hybas_id"]), "sid", "left_anti")


@C.add("WITH " + _HIT + " SELECT goid, count(DISTINCT hybas_id) AS n FROM lh GROUP BY 1 HAVING count(DISTINCT hybas_id) > 1")
def net16_rivers_in_several_basins(spark, d):
    """Rivers that touch more than one basin."""
    m = segments_meeting(lines(spark, d), basins(spark, d), "hybas_id", CELL).select(F.floor(F.col("sid") / 1000).alias("goid"), "hybas_id").distinct()
    return m.groupBy("goid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@C.add("WITH " + CONT + ", q AS (SELECT dam_id, continent, power(greatest(min_x - x, x - max_x, 0), 2) + power(greatest(min_y - y, y - max_y, 0), 2) AS d FROM da, ct WHERE x IS NOT NULL) SELECT dam_id, m.c AS continent FROM (SELECT dam_id, min({'d': d, 'c': continent}) AS m FROM q GROUP BY 1)", "da")
def jon6_nearest_continent(spark, d):
    """The nearest continent of every dam; a tie goes to the first name."""
    return nearest_regions(dams(spark, d).select("dam_id", "x", "y"), continents(spark, d), "dam_id", "x", "y", "continent")


_SEG = "CASE WHEN (to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y) > 0 THEN least(greatest(((x-from_x)*(to_x-from_x)+(y-from_y)*(to_y-from_y))/((to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y)), 0), 1) ELSE 0 END"


def _nearest_sql(where: str) -> str:
    return f"""WITH q AS (SELECT dam_id, r.goid, sqrt(power(x - (from_x + t*(to_x-from_x)), 2) + power(y - (from_y + t*(to_y-from_y)), 2)) AS d FROM (SELECT d.dam_id, x, y, r.*, {_SEG} AS t FROM (SELECT dam_id, x, y FROM da WHERE x IS NOT NULL) d JOIN re r ON {where}) r),
m AS (SELECT dam_id, min({{'d': d, 'g': goid}}) AS m FROM q {{cap}} GROUP BY 1)"""


def _shapes(r: DataFrame) -> DataFrame:
    return r.select(F.col("goid").alias("sid"), F.col("from_x").alias("ax"), F.col("from_y").alias("ay"), F.col("to_x").alias("bx"), F.col("to_y").alias("by"))


def _river_shapes(spark: SparkSession, d: str) -> DataFrame:
    return _shapes(reaches(spark, d))


@C.add(_nearest_sql("y BETWEEN least(from_y, to_y) - 5000 AND greatest(from_y, to_y) + 5000").replace("{cap}", "WHERE d <= 5000") + " SELECT dam_id, coalesce(m.g, -1) AS goid, coalesce(round(m.d + 1e-6, 3), -1) AS distance FROM da LEFT JOIN m USING (dam_id)", "da re")
def jon7_nearest_reach(spark, d):
    """The nearest reach within 5000 units; none: -1 and -1.0."""
    p = dams(spark, d).select("dam_id", "x", "y")
    near = near_pairs(p.select(F.col("dam_id").alias("pid"), "x", "y"), _river_shapes(spark, d), 5000.0)
    j = p.select("dam_id").join(near, F.col("dam_id") == F.col("pid"), "left")
    return j.select("dam_id", F.coalesce("sid", F.lit(-1).cast("long")).alias("goid"), F.coalesce(settled("distance", 3), F.lit(-1.0)).alias("distance"))


@C.add(_nearest_sql("true").replace("{cap}", "") + " SELECT dam_id, m.g AS goid, round(m.d + 1e-6, 3) AS distance FROM m", "da re")
def jon8_nearest_reach_any_distance(spark, d):
    """The nearest reach however far; repeated rows of dams and reaches don't matter to the nearest."""
    p = table(spark, d, "dams").select(F.col("dam_id").alias("pid"), "x", "y")
    near = nearest_segments(p, _shapes(table(spark, d, "reaches")))
    return near.select(F.col("pid").alias("dam_id"), F.col("sid").alias("goid"), settled("distance", 3).alias("distance"))


@C.add("WITH m AS (SELECT b.hybas_id, d.dam_id, sqrt(power(d.x - (min_x + max_x) / 2, 2) + power(d.y - (min_y + max_y) / 2, 2)) AS dist FROM da d JOIN basins b ON d.hybas_id = b.hybas_id WHERE d.x IS NOT NULL) SELECT hybas_id, m.i AS dam_id FROM (SELECT hybas_id, min({'d': dist, 'i': dam_id}) AS m FROM m GROUP BY 1)", "da")
def jon9_nearest_of_group(spark, d):
    """Of each basin the dam nearest to its middle, with the lowest id on a tie."""
    j = dams(spark, d).where("x IS NOT NULL").join(basins(spark, d).select("hybas_id", ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy")), "hybas_id")
    dist = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))
    return j.groupBy("hybas_id").agg(F.min(F.struct(dist.alias("d"), "dam_id")).alias("m")).select("hybas_id", "m.dam_id")


@C.add("SELECT dam_id, d.goid, d.dist, r.riv_ord, r.dis, r.hybas_id AS river_basin FROM da d LEFT JOIN re r ON d.goid = r.goid", "da re")
def jon10_dam_river_mapping(spark, d):
    """Dams with the attributes of their river; rivers that hold a third of the dams are salted."""
    r = reaches(spark, d).select("goid", "riv_ord", "dis", F.col("hybas_id").alias("river_basin"))
    return salted_join(dams(spark, d).select("dam_id", "goid", "dist"), r, ["goid"], "left")


@C.add("SELECT a.goid, a.snap_year, a.dof_all, b.dof FROM la a LEFT JOIN (SELECT CAST(goid AS VARCHAR) AS g, snap_year AS s, dof FROM la WHERE riv_ord <= 3) b ON CAST(a.goid AS VARCHAR) = b.g AND a.snap_year = b.s", "la")
def jon11_composite_key(spark, d):
    """A left join on two keys after casts."""
    a = layer(spark, d)
    b = a.where("riv_ord <= 3").select(F.col("goid").cast("string").alias("k"), "snap_year", "dof")
    return a.select("goid", F.col("goid").cast("string").alias("k"), "snap_year", "dof_all").join(b, ["k", "snap_year"], "left").drop("k")


@C.add("SELECT b.ffrid, r.goid, r.dis FROM re r JOIN (SELECT s_suppkey * 7 + 10000104 AS goid, s_suppkey % 10 AS ffrid FROM supplier) b USING (goid)", "re")
def jon12_benchmark_join(spark, d):
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 7 + 10000104).alias("goid"), (F.col("s_suppkey") % 10).alias("ffrid"))
    return reaches(spark, d).select("goid", "dis").join(b, "goid").select("ffrid", "goid", "dis")


@C.add("SELECT r.goid, coalesce(l.dof_all, 0) AS dof_all FROM re r LEFT JOIN (SELECT goid, dof_all FROM la WHERE snap_year = 2015) l USING (goid)", "re la")
def jon13_copy_by_key(spark, d):
    """A value copied by key; without a partner it is 0."""
    r = reaches(spark, d).select("goid").withColumn("dof_all", F.lit(5.0))
    return copy_by_key(r, layer(spark, d).where("snap_year = 2015"), "goid", "dof_all", 0.0).select("goid", "dof_all")


@C.add("SELECT r.goid, l.dof AS dof_x, m.dof AS dof_y FROM re r LEFT JOIN (SELECT goid, dof FROM la WHERE snap_year = 2010) l USING (goid) LEFT JOIN (SELECT goid, dof FROM la WHERE snap_year = 2020) m USING (goid)", "re la")
def jon14_result_merge(spark, d):
    """Results merged by key; equal names get suffixes."""
    a = layer(spark, d)
    of = lambda y, s: a.where(F.col("snap_year") == y).select("goid", F.col("dof").alias(f"dof{s}"))
    return reaches(spark, d).select("goid").join(of(2010, "_x"), "goid", "left").join(of(2020, "_y"), "goid", "left")


@C.add("SELECT b.goid, round(coalesce(b.v, 0) - coalesce(a.v, 0) + 1e-7, 4) AS diff, CASE WHEN a.goid IS NULL THEN 'new' WHEN coalesce(b.v, 0) - coalesce(a.v, 0) > 0.5 THEN 'increased' WHEN coalesce(b.v, 0) - coalesce(a.v, 0) < -0.5 THEN 'decreased' ELSE 'unchanged' END AS kind FROM (SELECT goid, dof_all AS v FROM la WHERE snap_year = 2020) b LEFT JOIN (SELECT goid, dof_all AS v FROM la WHERE snap_year = 2010) a USING (goid)", "la")
def jon15_snapshot_difference(spark, d):
    a = layer(spark, d)
    new = a.where("snap_year = 2020").select("goid", F.coalesce("dof_all", F.lit(0.0)).alias("v"))
    old = a.where("snap_year = 2010").select("goid", F.coalesce("dof_all", F.lit(0.0)).alias("o"))
    diff = F.col("v") - F.coalesce("o", F.lit(0.0))
    kind = F.when(F.col("o").isNull(), "new").when(diff > 0.5, "increased").when(diff < -0.5, "decreased").otherwise("unchanged")
    return new.join(old, "goid", "left").select("goid", settled(diff, 4).alias("diff"), kind.alias("kind"))


_PAIRED = "p AS (SELECT hybas_id, avg(dof_all) FILTER (WHERE snap_year = 2010 AND riv_ord <= 4) AS a, avg(dof_all) FILTER (WHERE snap_year = 2020) AS b FROM la WHERE hybas_id IS NOT NULL GROUP BY 1)"


def paired(spark: SparkSession, d: str) -> DataFrame:
    a = layer(spark, d).where("hybas_id IS NOT NULL")
    old = a.where("snap_year = 2010 AND riv_ord <= 4").groupBy("hybas_id").agg(F.avg("dof_all").alias("a"))
    new = a.where("snap_year = 2020").groupBy("hybas_id").agg(F.avg("dof_all").alias("b"))
    return old.join(new, "hybas_id", "full_outer")


@C.add("WITH " + _PAIRED + " SELECT hybas_id, round(a + 1e-7, 4) AS d10, round(b + 1e-7, 4) AS d20, round(b - a + 1e-7, 4) AS diff FROM p WHERE a IS NOT NULL OR b IS NOT NULL", "la")
def jon16_basin_pairing(spark, d):
    """Both years of each basin; the difference is null where one is missing."""
    return paired(spark, d).where("a IS NOT NULL OR b IS NOT NULL").select("hybas_id", settled("a", 4).alias("d10"), settled("b", 4).alias("d20"), settled(F.col("b") - F.col("a"), 4).alias("diff"))


@C.add("WITH " + _PAIRED + " SELECT b.hybas_id, b.continent, round(p.b - p.a + 1e-7, 4) AS diff FROM basins b JOIN p USING (hybas_id) WHERE p.b - p.a IS NOT NULL", "la")
def jon17_map_by_key(spark, d):
    p = paired(spark, d).select("hybas_id", (F.col("b") - F.col("a")).alias("v")).where("v IS NOT NULL")
    return basins(spark, d).select("hybas_id", "continent").join(p, "hybas_id").select("hybas_id", "continent", settled("v", 4).alias("diff"))


_BANDS = ", ".join(f"coalesce(CAST(sum(CASE WHEN first_year = {y} THEN 1 END) AS BIGINT), 0) AS n{y}" for y in (2010, 2015, 2020))


@C.add(f"SELECT b.band, {_BANDS} FROM range(0, 36) b(band) LEFT JOIN da ON floor((lat + 90) / 5) = b.band GROUP BY 1", "da")
def jon18_bands_by_year(spark, d):
    """Dams by 5-degree band and year, with empty bands."""
    p = dams(spark, d).where("lat IS NOT NULL").groupBy(F.floor((F.col("lat") + 90) / 5).alias("band")).pivot("first_year", [2010, 2015, 2020]).count()
    return spark.range(36).withColumnRenamed("id", "band").join(p, "band", "left").select("band", *[F.coalesce(F.col(str(y)), F.lit(0)).alias(f"n{y}") for y in (2010, 2015, 2020)])


_SHARES = "SELECT band, dam_type, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY band) + 1e-7, 4) AS pct FROM (SELECT CAST(floor((lat + 90) / 10) AS BIGINT) AS band, dam_type, count(*) AS n FROM da WHERE lat IS NOT NULL AND dam_type IS NOT NULL GROUP BY 1, 2)"


@C.add(_SHARES, "da")
def jon19_share_of_band(spark, d):
    """Types by latitude band, with their share of the band."""
    g = dams(spark, d).where("lat IS NOT NULL AND dam_type IS NOT NULL").groupBy(F.floor((F.col("lat") + 90) / 10).alias("band"), "dam_type").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", settled(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("band")), 4))


@C.add("WITH i AS (SELECT goid, row_number() OVER (PARTITION BY hybas_id ORDER BY upland_skm NULLS LAST, goid) AS idx FROM re) SELECT d.dam_id, i.idx FROM da d JOIN i USING (goid)", "da re")
def jon20_routing_ids(spark, d):
    """Dams by the dense id of their reach."""
    return salted_join(dams(spark, d).where("goid IS NOT NULL").select("dam_id", "goid"), dense_ids(reaches(spark, d), "hybas_id", ["upland_skm"], "goid").select("goid", "idx"), ["goid"]).select("dam_id", "idx")


@C.add("WITH f AS (SELECT DISTINCT bb_id, riv_ord FROM re WHERE dis < 1) SELECT goid, CAST(f.bb_id IS NOT NULL AS INT) AS filtered FROM re LEFT JOIN f USING (bb_id, riv_ord)", "re")
def jon21_composite_semi_join(spark, d):
    """Reaches marked by a pair of keys."""
    r = reaches(spark, d)
    f = r.where("dis < 1").select("bb_id", "riv_ord").distinct().withColumn("_f", F.lit(1))
    return r.select("goid", "bb_id", "riv_ord").join(f, ["bb_id", "riv_ord"], "left").select("goid", F.coalesce("_f", F.lit(0)).alias("filtered"))


@C.add("SELECT r.goid, b.bb_id AS stretch FROM re r JOIN re b USING (goid)", "re")
def jon22_copy_ids(spark, d):
    """A column copied between tables of one key."""
    r = reaches(spark, d)
    return r.select("goid").join(r.select("goid", F.col("bb_id").alias("stretch")), "goid")


@C.add("WITH s AS (SELECT bb_id, CAST(max(riv_ord) AS INT) AS st FROM re WHERE bb_ocean = 1 GROUP BY 1) SELECT goid, coalesce(st, 0) AS st FROM re LEFT JOIN s USING (bb_id)", "re")
def jon23_lookup_default(spark, d):
    """A lookup whose default is 0."""
    r = reaches(spark, d)
    s = r.where("bb_ocean = 1").groupBy("bb_id").agg(F.max("riv_ord").cast("int").alias("st"))
    return r.select("goid", "bb_id").join(s, "bb_id", "left").select("goid", F.coalesce("st", F.lit(0)).alias("st"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """Middles of the basins in degrees."""
    return basins(spark, d).select(F.col("hybas_id").alias("id"), ((F.col("min_x") + F.col("max_x")) / 200000 - 180).alias("lon"), ((F.col("min_y") + F.col("max_y")) / 200000 - 90).alias("lat"), "continent")


PLACES = "pl AS (SELECT hybas_id AS id, (min_x + max_x) / 200000 - 180 AS lon, (min_y + max_y) / 200000 - 90 AS lat, continent FROM basins)"
_HAV = "2 * 6371.0088 * asin(sqrt(least(1, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"
KNN = f"{PLACES}, ds AS (SELECT a.id AS i, b.id AS j, round({_HAV}, 6) AS d FROM pl a JOIN pl b ON a.id <> b.id), kn AS (SELECT i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM ds) WHERE r <= 5)"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return knn(places(spark, d), 5)


@C.add("WITH " + KNN + " SELECT i, j, round(d, 4) AS d, 0.2::DOUBLE AS w FROM kn")
def jon24_nearest_places(spark, d):
    """The five nearest basins of each, by great-circle distance."""
    return neighbours(spark, d).select("i", "j", F.round("d", 4).alias("d"), "w")


@C.add("WITH " + KNN + " SELECT i, round(avg(e20) + 1e-7, 4) AS lag FROM kn JOIN bsn ON j = hybas_id GROUP BY 1", "bsn")
def jon25_spatial_lag(spark, d):
    """Mean of the neighbours' values."""
    y = basin_table(spark, d).select(F.col("hybas_id").alias("j"), "e20")
    return neighbours(spark, d).join(y, "j").groupBy("i").agg(settled(F.sum(F.col("e20") * F.col("w")) / F.sum("w"), 4).alias("lag"))


_BOX = OBB + ", bx AS (SELECT doc_id, pos, least(x1,x2,x3,x4) AS xmin, least(y1,y2,y3,y4) AS ymin, greatest(x1,x2,x3,x4) AS xmax, greatest(y1,y2,y3,y4) AS ymax FROM ob)"


@C.add("WITH " + _BOX + ", bg AS (SELECT bx.*, hybas_id AS g, year(collected_at) AS yr FROM bx JOIN documents USING (doc_id)) SELECT a.doc_id AS a_doc, a.pos AS a_pos, b.doc_id AS b_doc, b.pos AS b_pos FROM bg a JOIN bg b ON a.g = b.g AND a.yr < b.yr AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax")
def jon26_box_overlaps(spark, d):
    """Boxes of a basin that overlap one of a later year."""
    c = corners(spark, d).join(table(spark, d, "documents").where("hybas_id IS NOT NULL").select("doc_id", F.col("hybas_id").alias("g"), F.year("collected_at").alias("yr")), "doc_id")
    xs, ys = [f"x{i}" for i in range(1, 5)], [f"y{i}" for i in range(1, 5)]
    b = c.select("g", F.struct("doc_id", "pos", "yr").alias("id"), F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))
    met = overlaps(b, b, ["g"], 100.0).where(F.col("a_id.yr") < F.col("b_id.yr"))
    return met.select(F.col("a_id.doc_id").alias("a_doc"), F.col("a_id.pos").alias("a_pos"), F.col("b_id.doc_id").alias("b_doc"), F.col("b_id.pos").alias("b_pos"))


@C.add("WITH " + RASTER + ", z(zone, lo, hi) AS (VALUES ('south', -90, -30), ('middle', -30, 30), ('north', 30, 91)) SELECT zone, CAST(sum(n) AS BIGINT) AS n FROM rs JOIN z ON 90 - row * (180.0::DOUBLE / 89) >= lo AND 90 - row * (180.0::DOUBLE / 89) < hi GROUP BY 1", "da")
def jon27_zonal_sum(spark, d):
    """Cells summed by boxes of latitude; the zones are a fixed list, tested in place."""
    p = pixel_latitudes(cells(spark, d), 90.0, -90.0, 90)
    zone = F.when(F.col("lat") < -30, "south").when(F.col("lat") < 30, "middle").otherwise("north")
    return p.groupBy(zone.alias("zone")).agg(F.sum("n").alias("n"))


@C.add("WITH " + RASTER + ", t AS (SELECT r.range AS row, c.range AS col FROM range(0, 120) r, range(0, 240) c) SELECT t.row, t.col, rs.n FROM t JOIN rs ON rs.row = floor((t.row + 0.5) * 1.5 / 2) AND rs.col = floor((t.col + 0.5) * 1.5 / 2)", "da")
def jon28_align_rasters(spark, d):
    """Cells of 2 degrees on a grid of 1.5 degrees, by the nearest centre."""
    return align_nearest(cells(spark, d), 2.0, 1.5, 120, 240).select("row", "col", "n")
