"""Scans, sinks and row shapes."""

from __future__ import annotations

import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.plans.base import Catalog, basins, dams, dim, layer, settled, table, units
from riverspark.session import shared_folder
from riverspark.sources.voc import voc_documents, voc_objects
from riverspark.sources.config import parse_flag, scenario_rows
from riverspark.sources.geopackage import GeoPackageSource
from riverspark.sources.layers import layer_overview, load_layers
from riverspark.sources.obb import obb_points, obb_tokens
from riverspark.sources.raster import pixel_latitudes
from riverspark.sources.shapefile import ShapefileSource

C = Catalog()

#: Annotation lines inside the documents: eight corner coordinates, a type, a flag.
LINE = r"(?m)^((?:[0-9]+\.[0-9]+ ){8}[A-Za-z]+_dam [0-9])[ ]*$"


def annotation_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, pos, line): the annotation lines of all documents."""
    t = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), F.lit(1))).alias("pos", "line"))
    return t


LINES = r"""ln AS (SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS pos, unnest(ls) AS line FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^((?:[0-9]+\.[0-9]+ ){8}[A-Za-z]+_dam [0-9])[ ]*$', 1) AS ls FROM documents)),
tk AS (SELECT doc_id, pos, line, string_split(line, ' ') AS k FROM ln)"""
_CENTRE = """CAST(k[1] AS DOUBLE) AS x1, CAST(k[2] AS DOUBLE) AS y1, CAST(k[3] AS DOUBLE) AS x2, CAST(k[4] AS DOUBLE) AS y2, CAST(k[5] AS DOUBLE) AS x3, CAST(k[6] AS DOUBLE) AS y3, CAST(k[7] AS DOUBLE) AS x4, CAST(k[8] AS DOUBLE) AS y4, k[9] AS dam_type"""
OBB = f"""{LINES}, ob AS (SELECT doc_id, pos, {_CENTRE} FROM tk), oa AS (SELECT *, (x1*y2-x2*y1)+(x2*y3-x3*y2)+(x3*y4-x4*y3)+(x4*y1-x1*y4) AS a2 FROM ob),
oc AS (SELECT doc_id, pos, dam_type, ((x1+x2)*(x1*y2-x2*y1)+(x2+x3)*(x2*y3-x3*y2)+(x3+x4)*(x3*y4-x4*y3)+(x4+x1)*(x4*y1-x1*y4))/(3*a2) AS cx, ((y1+y2)*(x1*y2-x2*y1)+(y2+y3)*(x2*y3-x3*y2)+(y3+y4)*(x3*y4-x4*y3)+(y4+y1)*(x4*y1-x1*y4))/(3*a2) AS cy FROM oa WHERE a2 <> 0)"""


def _local(folder: str) -> Path:
    """A folder of the shared file system as a path."""
    u = urlparse(folder)
    if u.scheme not in ("", "file"):
        raise ValueError(f"needs a mounted folder, not {folder}")
    p = Path(u.path) / uuid.uuid4().hex
    p.mkdir(parents=True)
    return p


@C.add("SELECT hybas_id, continent, min_x, min_y, max_x, max_y FROM basins")
def src1_geopackage_scan(spark, d):
    """The basins, written as a GeoPackage layer of polygons and read by the GeoPackage source."""
    spark.dataSource.register(GeoPackageSource)
    path = _local(shared_folder(spark)) / "basins.gpkg"
    GeoPackageSource.write_boxes(str(path), "basins", [(r["hybas_id"], r["continent"], r["min_x"], r["min_y"], r["max_x"], r["max_y"]) for r in basins(spark, d).select("hybas_id", "continent", "min_x", "min_y", "max_x", "max_y").toLocalIterator()])
    return spark.read.format("geopackage").option("layer", "basins").load(str(path)).select("hybas_id", "continent", "min_x", "min_y", "max_x", "max_y")


@C.add("SELECT hybas_id, (min_x + max_x) / 2 AS x, (min_y + max_y) / 2 AS y FROM basins")
def src1_shapefile_scan(spark, d):
    """Basin centres, written as a shapefile of points and read by the shapefile source."""
    spark.dataSource.register(ShapefileSource)
    path = _local(shared_folder(spark)) / "centres.shp"
    ShapefileSource.write_points(str(path), "hybas_id", [(r["hybas_id"], (r["min_x"] + r["max_x"]) / 2, (r["min_y"] + r["max_y"]) / 2) for r in basins(spark, d).select("hybas_id", "min_x", "min_y", "max_x", "max_y").toLocalIterator()])
    return spark.read.format("shapefile").load(str(path)).select(F.col("hybas_id").cast("long").alias("hybas_id"), "x", "y")


@C.add("SELECT 'streams' AS layer, true AS present, (SELECT count(*) FROM reaches) AS n UNION ALL SELECT 'dams', true, (SELECT count(*) FROM dams) UNION ALL SELECT 'basins', true, (SELECT count(*) FROM basins) UNION ALL SELECT 'lakes', false, 0")
def src2_layers(spark, d):
    """Named layers with their rows; an absent one is tolerated."""
    return layer_overview(spark, load_layers(spark, d, {"streams": "reaches", "dams": "dams", "basins": "basins", "lakes": "lakes"}))


@C.add("SELECT goid, hybas_id, riv_ord FROM reaches")
def src3_pruned_scan(spark, d):
    return table(spark, d, "reaches").select("goid", "hybas_id", "riv_ord")


@C.add("SELECT dam_id, dam_type, first_year, x, y FROM dams WHERE dam_type IN ('gravity_dam', 'arch_dam') AND first_year <= 2015")
def src4_pushed_filter(spark, d):
    return table(spark, d, "dams").where(F.col("dam_type").isin("gravity_dam", "arch_dam") & (F.col("first_year") <= 2015)).select("dam_id", "dam_type", "first_year", "x", "y")


@C.add("WITH " + OBB + " SELECT doc_id, pos, dam_type, round(cx + 1e-9, 4) AS cx, round(cy + 1e-9, 4) AS cy FROM oc")
def src5_obb_centroids(spark, d):
    """Centroids of annotated boxes, with their type."""
    return obb_points(annotation_lines(spark, d), "line").select("doc_id", "pos", "dam_type", settled("cx", 4).alias("cx"), settled("cy", 4).alias("cy"))


@C.add("WITH " + OBB + " SELECT count(*) AS n, round(sum(cx), 2) AS sum_x, round(sum(cy), 2) AS sum_y FROM oc")
def src6_obb_points_untyped(spark, d):
    """Points of the lines with at least ten tokens, whatever their type."""
    p = obb_points(annotation_lines(spark, d), "line", least=10)
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cx"), 2).alias("sum_x"), F.round(F.sum("cy"), 2).alias("sum_y"))


@C.add("WITH " + OBB + " SELECT CASE dam_type WHEN 'other_dam' THEN 'Barrage_dam' ELSE dam_type END AS dam_type, count(*) AS n FROM oc WHERE dam_type IN ('Barrage_dam', 'other_dam', 'gravity_dam') GROUP BY 1")
def src7_obb_typed(spark, d):
    """Points of some types; other_dam counts as Barrage_dam, and is rewritten before the filter."""
    p = obb_points(annotation_lines(spark, d), "line").withColumn("dam_type", F.when(F.col("dam_type") == "other_dam", "Barrage_dam").otherwise(F.col("dam_type")))
    return p.where(F.col("dam_type").isin("Barrage_dam", "gravity_dam")).groupBy("dam_type").agg(F.count(F.lit(1)).alias("n"))


@C.add("WITH " + LINES + ", f AS (SELECT * FROM tk ORDER BY doc_id, pos LIMIT 5) SELECT doc_id, pos, CAST(generate_subscripts(k, 1) - 1 AS INT) AS field, unnest(k) AS value FROM f")
def src8_peek(spark, d):
    """The first five lines, field by field."""
    return annotation_lines(spark, d).orderBy("doc_id", "pos").limit(5).select("doc_id", "pos", F.posexplode(F.split("line", " ")).alias("field", "value"))


RASTER = "rs AS (SELECT CAST(floor((lon + 180) / 2) AS BIGINT) AS col, CAST(floor((90 - lat) / 2) AS BIGINT) AS row, count(*) AS n FROM da WHERE lon IS NOT NULL GROUP BY 1, 2)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Dams on a sparse grid of 2 degrees: (row, col, n)."""
    p = dams(spark, d).where("lon IS NOT NULL")
    return p.groupBy(F.floor((F.col("lon") + 180) / 2).alias("col"), F.floor((90 - F.col("lat")) / 2).alias("row")).agg(F.count(F.lit(1)).alias("n"))


@C.add("WITH " + RASTER + " SELECT row, round(90 - row * (180.0::DOUBLE / 89), 6) AS lat, CAST(sum(n) AS BIGINT) AS n FROM rs GROUP BY 1", "da")
def src9_pixel_latitudes(spark, d):
    """Pixels with the latitude of an evenly spaced mesh whose ends lie on the edges."""
    return pixel_latitudes(cells(spark, d), top=90.0, bottom=-90.0, height=90).groupBy("row", F.round("lat", 6).alias("lat")).agg(F.sum("n").alias("n"))


@C.add("WITH " + RASTER + " SELECT CAST(90 AS INT) AS height, CAST(180 AS INT) AS width, 2.0::DOUBLE AS resolution, 'EPSG:4326' AS crs, count(*) AS filled, CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM rs", "da")
def src10_raster_metadata(spark, d):
    c = cells(spark, d).agg(F.count(F.lit(1)).alias("filled"), F.sum("n").alias("total"), F.max("n").alias("most"))
    return c.select(F.lit(90).alias("height"), F.lit(180).alias("width"), F.lit(2.0).alias("resolution"), F.lit("EPSG:4326").alias("crs"), "filled", "total", "most")


SHEET = [{"scenario_name": "base", "indicator_1": "DOF", "weight_1": 60.0, "indicator_2": "DOR", "weight_2": 40.0, "csi_thresh": 95.0, "to_process": 1}, {"scenario_name": "off", "indicator_1": "DOF", "weight_1": 100.0, "indicator_2": "DOR", "weight_2": 0.0, "csi_thresh": 95.0, "to_process": 0}]


@C.add("SELECT * FROM (VALUES ('base', 'DOF', 60.0::DOUBLE, 95.0::DOUBLE), ('base', 'DOR', 40.0::DOUBLE, 95.0::DOUBLE)) t(scenario, indicator, weight, csi_thresh)")
def src11_scenario_sheet(spark, d):
    """Scenario sheets in long form; those not to be processed are left out."""
    return dim(spark, scenario_rows(SHEET), "scenario string, indicator string, weight double, csi_thresh double")


@C.add("SELECT * FROM (VALUES ('YES', true), ('no', false), ('1', true), ('off', false), ('', false)) t(raw, flag)")
def src12_flags(spark, d):
    """Flags of settings, parsed."""
    return dim(spark, [(x, parse_flag(x)) for x in ("YES", "no", "1", "off", "")], "raw string, flag boolean")


@C.add("SELECT hybas_id, first_year AS yr, dam_id, confidence, z_level FROM da WHERE dam_type = 'embankment_dam' AND hybas_id IS NOT NULL", "da")
def src13_precision_rows(spark, d):
    """Confidence of each embankment dam, by year and basin: one row per dam instead of arrays per basin."""
    return dams(spark, d).where("dam_type = 'embankment_dam' AND hybas_id IS NOT NULL").select("hybas_id", F.col("first_year").alias("yr"), "dam_id", "confidence", "z_level")


@C.add("SELECT CAST(hybas_id AS BIGINT) AS hybas_id, count(*) AS n FROM da WHERE hybas_id IS NOT NULL GROUP BY 1", "da")
def src14_partitioned_scan(spark, d):
    """A table written by basin and read back with its partitions."""
    path = f"{shared_folder(spark)}/by-basin-{uuid.uuid4().hex}"
    dams(spark, d).where("hybas_id IS NOT NULL").select("hybas_id", "dam_id").repartition("hybas_id").write.partitionBy("hybas_id").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("hybas_id").cast("long").alias("hybas_id")).agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src15_json_scan(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@C.add("SELECT goid, riv_ord FROM re ORDER BY goid LIMIT 5000", "re")
def src16_capped_scan(spark, d):
    """The first 5000 reaches by key; the limit is the feature."""
    return table(spark, d, "reaches").select("goid", "riv_ord").distinct().orderBy("goid").limit(5000)


@C.add("SELECT count(*) AS n, count(x) AS with_x FROM dams")
def src17_counted_scan(spark, d):
    return table(spark, d, "dams").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("with_x"))


@C.add("SELECT 'hdi' AS col, count(hdi) AS n, round(avg(hdi) + 1e-7, 4) AS mean, round(stddev_samp(hdi) + 1e-7, 4) AS sd, min(hdi) AS lo, max(hdi) AS hi FROM un UNION ALL SELECT 'lka', count(lka), round(avg(lka) + 1e-7, 4), round(stddev_samp(lka) + 1e-7, 4), min(lka), max(lka) FROM un", "un")
def src18_describe(spark, d):
    """Summary of numeric columns in one pass."""
    u = units(spark, d)
    one = u.agg(F.array(*[F.struct(F.lit(c).alias("col"), F.count(c).alias("n"), settled(F.avg(c), 4).alias("mean"), settled(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("lo"), F.max(c).alias("hi")) for c in ("hdi", "lka")]).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.*")


@C.add("WITH " + OBB + ", m AS (SELECT doc_id, pos, dam_type, least(x1, x2, x3, x4) AS xmin, least(y1, y2, y3, y4) AS ymin, greatest(x1, x2, x3, x4) AS xmax, greatest(y1, y2, y3, y4) AS ymax FROM ob) SELECT * FROM m")
def src19_voc_xml(spark, d):
    """Boxes written as annotation XML and read back by XPath."""
    b = obb_tokens(annotation_lines(spark, d), "line")
    num = lambda i: F.col("t")[i].cast("double")
    xs, ys = [num(i) for i in (0, 2, 4, 6)], [num(i) for i in (1, 3, 5, 7)]
    x = b.select("doc_id", "pos", F.format_string("<annotation><object><name>%s</name><bndbox><xmin>%s</xmin><ymin>%s</ymin><xmax>%s</xmax><ymax>%s</ymax></bndbox></object></annotation>", F.col("t")[8], F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).alias("xml"))
    return x.selectExpr("doc_id", "pos", "xpath_string(xml, 'annotation/object/name') AS dam_type", *[f"xpath_double(xml, 'annotation/object/bndbox/{c}') AS {c}" for c in ("xmin", "ymin", "xmax", "ymax")])


@C.add("WITH " + OBB + """, m AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INT) AS place, pos % 2 = 1 AS turned, dam_type AS name, least(x1, x2, x3, x4) AS a, least(y1, y2, y3, y4) AS b, greatest(x1, x2, x3, x4) AS c, greatest(y1, y2, y3, y4) AS d FROM ob),
h AS (SELECT *, (a + c) / 2 AS cx, (b + d) / 2 AS cy, (c - a) / 2 AS w, (d - b) / 2 AS h FROM m)
SELECT doc_id, place, CASE WHEN turned THEN 'robndbox' ELSE 'bndbox' END AS type, name, round(CASE WHEN turned THEN cx - w * cos(0.5::DOUBLE) + h * sin(0.5::DOUBLE) ELSE a END, 4) AS x1, round(CASE WHEN turned THEN cy - w * sin(0.5::DOUBLE) - h * cos(0.5::DOUBLE) ELSE b END, 4) AS y1,
  round(CASE WHEN turned THEN cx + w * cos(0.5::DOUBLE) - h * sin(0.5::DOUBLE) ELSE c END, 4) AS x3, round(CASE WHEN turned THEN cy + w * sin(0.5::DOUBLE) + h * cos(0.5::DOUBLE) ELSE d END, 4) AS y3 FROM h""")
def src19_voc_objects(spark, d):
    """Documents of several objects, every second box turned by half a radian, written as annotation XML and read back."""
    b = obb_tokens(annotation_lines(spark, d), "line")
    num = lambda i: F.col("t")[i].cast("double")
    xs, ys = [num(i) for i in (0, 2, 4, 6)], [num(i) for i in (1, 3, 5, 7)]
    o = b.select("doc_id", "pos", F.col("t")[8].alias("name"), F.lit(0).alias("truncated"), F.lit(0).alias("difficult"), F.least(*xs).alias("xmin"), F.least(*ys).alias("ymin"), F.greatest(*xs).alias("xmax"), F.greatest(*ys).alias("ymax"))
    mid, size = (lambda lo, hi: (F.col(lo) + F.col(hi)) / 2), (lambda lo, hi: F.col(hi) - F.col(lo))
    o = o.withColumns({"cx": mid("xmin", "xmax"), "cy": mid("ymin", "ymax"), "w": size("xmin", "xmax"), "h": size("ymin", "ymax"), "angle": F.when(F.col("pos") % 2 == 1, 0.5)})
    return voc_objects(voc_documents(o, "doc_id", "pos")).select("doc_id", "place", "type", "name", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x3", "y3")])


@C.add("WITH " + LINES + " SELECT doc_id, pos, k[9] AS label, CAST(k[10] AS INT) AS difficult FROM tk WHERE len(k) IN (9, 10)")
def src20_dota_reader(spark, d):
    """Lines of nine or ten tokens as labels with a flag; others are skipped."""
    return annotation_lines(spark, d).withColumn("t", F.split("line", " ")).where(F.size("t").isin(9, 10)).select("doc_id", "pos", F.col("t")[8].alias("label"), F.try_element_at("t", F.lit(10)).cast("int").alias("difficult"))


@C.add("SELECT prefix, list_reduce(list(yr ORDER BY yr), lambda a, b: a || ',' || b) AS years FROM (SELECT 'basin' || hybas_id AS prefix, CAST(stat_year AS VARCHAR) AS yr FROM (SELECT DISTINCT hybas_id, stat_year FROM basin_units WHERE hybas_id IS NOT NULL)) GROUP BY prefix HAVING count(*) = 3")
def src21_image_groups(spark, d):
    """File names prefix_year.jpg in groups of exactly three, ordered by year."""
    names = table(spark, d, "basin_units").where("hybas_id IS NOT NULL").select(F.format_string("basin%d_%d.jpg", "hybas_id", "stat_year").alias("path")).distinct()
    pattern = r"^(.+?)_(\d{4})\.(jpg|jpeg|png|bmp)$"
    p = names.select(F.regexp_extract("path", pattern, 1).alias("prefix"), F.regexp_extract("path", pattern, 2).alias("yr"))
    return p.where("prefix <> ''").groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("yr")), ",").alias("years")).where("n = 3").select("prefix", "years")


@C.add("SELECT hybas_id, min_x AS x0, max_y AS y0 FROM basins")
def src22_geotransform(spark, d):
    """The upper left corner out of the GeoTransform of side-car XML."""
    x = basins(spark, d).select("hybas_id", F.concat(F.lit("<PAMDataset><GeoTransform> "), F.concat_ws(", ", F.col("min_x").cast("string"), F.lit("1.0"), F.lit("0.0"), F.col("max_y").cast("string"), F.lit("0.0"), F.lit("-1.0")), F.lit("</GeoTransform></PAMDataset>")).alias("xml"))
    g = x.select("hybas_id", F.split(F.expr("xpath_string(xml, 'PAMDataset/GeoTransform')"), ",").alias("g"))
    return g.select("hybas_id", F.trim(F.col("g")[0]).cast("double").alias("x0"), F.trim(F.col("g")[3]).cast("double").alias("y0"))


def _written(df: DataFrame, kind: str, **options: str) -> str:
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


@C.add("SELECT 'DOF' AS layer, count(*) AS n FROM la WHERE dof IS NOT NULL UNION ALL SELECT 'COMBINED_RESULT', count(*) FROM la WHERE dof_all IS NOT NULL", "la")
def snk1_layered_sink(spark, d):
    """Several layers in one store, by partition."""
    a = layer(spark, d)
    rows = a.where("dof IS NOT NULL").select(F.lit("DOF").alias("layer"), "goid", F.col("dof").alias("v")).unionByName(a.where("dof_all IS NOT NULL").select(F.lit("COMBINED_RESULT").alias("layer"), "goid", F.col("dof_all").alias("v")))
    path = f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
    rows.write.partitionBy("layer").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("layer").cast("string").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT * FROM (VALUES ('col_1', '政策类型'), ('hybas_id', 'hybas_id')) t(safe, original)")
def snk2_safe_names(spark, d):
    """Columns with other than ASCII names are renamed; the mapping is kept."""
    from riverspark.sources.sinks import safe_columns

    df = basins(spark, d).select("hybas_id", F.lit("a").alias("政策类型"))
    return dim(spark, sorted((s, o) for s, o in safe_columns(df)[1].items()), "safe string, original string")


@C.add("SELECT 'Global_stats' AS sheet, count(*) AS n FROM la UNION ALL SELECT 'River_stats_1', count(DISTINCT goid) FROM la", "la")
def snk3_sheets(spark, d):
    """One table per sheet of a report."""
    a = layer(spark, d)
    sheets = {"Global_stats": a.select("goid", "dof_all"), "River_stats_1": a.select("goid").distinct()}
    out = None
    for name, df in sheets.items():
        one = spark.read.schema(df.schema).parquet(_written(df, "parquet")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@C.add("SELECT goid, snap_year, dof_all FROM la", "la")
def snk4_csv(spark, d):
    a = layer(spark, d).select("goid", "snap_year", "dof_all")
    return spark.read.schema(a.schema).option("header", True).csv(_written(a, "csv", header="true"))


@C.add("WITH " + RASTER + " SELECT row, col, n FROM rs", "da")
def snk5_sparse_raster(spark, d):
    c = cells(spark, d).select("row", "col", "n")
    return spark.read.schema(c.schema).parquet(_written(c, "parquet"))


@C.add("SELECT hybas_id, round(avg(dof_all) FILTER (WHERE snap_year = 2010) + 1e-7, 4) AS d10, round(avg(dof_all) FILTER (WHERE snap_year = 2020) + 1e-7, 4) AS d20 FROM la WHERE hybas_id IS NOT NULL GROUP BY 1", "la")
def snk6_json(spark, d):
    """A comparison per basin as JSON, read back."""
    a = layer(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(settled(F.avg(F.when(F.col("snap_year") == 2010, F.col("dof_all"))), 4).alias("d10"), settled(F.avg(F.when(F.col("snap_year") == 2020, F.col("dof_all"))), 4).alias("d20"))
    return spark.read.schema(a.schema).json(_written(a, "json"))


@C.add("SELECT hybas_id, count(*) AS n FROM re WHERE hybas_id IS NOT NULL GROUP BY 1", "re")
def snk8_partitioned_sink(spark, d):
    """A store by basin that keeps all columns; a second write of a finished basin is skipped."""
    from riverspark.plans.base import reaches
    from riverspark.sources.sinks import write_missing

    path = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    r = reaches(spark, d).where("hybas_id IS NOT NULL")
    write_missing(r.where("hybas_id % 2 = 0"), path, "hybas_id")
    write_missing(r, path, "hybas_id")
    return spark.read.parquet(path).groupBy(F.col("hybas_id").cast("long").alias("hybas_id")).agg(F.count(F.lit(1)).alias("n"))


@C.add("WITH " + LINES + " SELECT doc_id, array_to_string(list(line ORDER BY pos), chr(10)) AS body FROM ln GROUP BY 1")
def snk10_annotation_text(spark, d):
    """The annotation file of each document."""
    g = annotation_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))
