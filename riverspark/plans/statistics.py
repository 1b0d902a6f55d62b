"""Tests, spatial statistics and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.functions.classes import moran_label, stars
from riverspark.functions.special import gaussian_weights
from riverspark.operators.spatial import knn
from riverspark.operators.statistics import effects, fdr, independence, moran, ols, spatial_lag, vif, welch
from riverspark.plans.base import Catalog, basin_table, dams, settled, units
from riverspark.plans.joins import KNN, PLACES, neighbours, places
from riverspark.plans.scans import RASTER, cells

C = Catalog()
XS = ["hdi", "lka", "area"]


@C.add("WITH m AS (SELECT median(hdi) AS m FROM bsn) SELECT hybas_id, CASE WHEN hdi >= m THEN 'High' ELSE 'Low' END AS grp FROM bsn, m", "bsn")
def sta1_median_split(spark, d):
    """High from the median on; no value is Low."""
    b = basin_table(spark, d)
    return b.select("hybas_id", F.when(F.col("hdi") >= b.agg(F.median("hdi")).scalar(), "High").otherwise("Low").alias("grp"))


_WELCH = """WITH m AS (SELECT median(hdi) AS m FROM bsn), v AS (SELECT hdi >= m AS h, CAST(e20 AS DOUBLE) AS e20, CAST(a20 AS DOUBLE) AS a20 FROM bsn, m WHERE hdi IS NOT NULL), u AS (SELECT h, 'e20' AS metric, e20 AS v FROM v UNION ALL SELECT h, 'a20', a20 FROM v),
g AS (SELECT metric, count(*) FILTER (WHERE h) AS n1, count(*) FILTER (WHERE NOT h) AS n0, avg(v) FILTER (WHERE h) AS m1, avg(v) FILTER (WHERE NOT h) AS m0, var_samp(v) FILTER (WHERE h) AS s1, var_samp(v) FILTER (WHERE NOT h) AS s0 FROM u GROUP BY 1)
SELECT metric, n1 AS n_high, n0 AS n_low, round(m1 + 1e-7, 4) AS mean_high, round((m1 - m0) / sqrt(s1 / n1 + s0 / n0) + 1e-8, 5) AS t, round(power(s1 / n1 + s0 / n0, 2) / (power(s1 / n1, 2) / (n1 - 1) + power(s0 / n0, 2) / (n0 - 1)) + 1e-7, 4) AS dof FROM g"""


def split(spark: SparkSession, d: str) -> DataFrame:
    b = basin_table(spark, d).where("hdi IS NOT NULL")
    return b.withColumn("h", F.col("hdi") >= b.agg(F.median("hdi")).scalar())


@C.add(_WELCH, "bsn")
def sta2_welch(spark, d):
    """Welch's test between basins of high and low HDI."""
    w = welch(split(spark, d), F.col("h"), ["e20", "a20"])
    return w.select("metric", "n_high", "n_low", settled("mean_high", 4).alias("mean_high"), settled("t", 5).alias("t"), settled("dof", 4).alias("dof"))


@C.add()
def sta2_welch_p(spark, d):
    """The p-values of the same tests; tests hold them against tabulated values."""
    return welch(split(spark, d), F.col("h"), ["e20", "a20"]).select("metric", F.round("p", 6).alias("p"), (F.col("p") < 0.05).alias("significant"))


@C.add("SELECT continent, min(e20) AS lo, quantile_cont(e20, 0.25) AS q1, median(e20) AS q2, quantile_cont(e20, 0.75) AS q3, max(e20) AS hi, arg_max(hybas_id, struct_pack(a := e20, b := -hybas_id)) AS most FROM bsn WHERE continent IS NOT NULL GROUP BY 1", "bsn")
def sta3_boxplots(spark, d):
    """Five numbers per group, and the outlying basin."""
    q = F.percentile("e20", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = basin_table(spark, d).where("continent IS NOT NULL").groupBy("continent").agg(F.min("e20").alias("lo"), q.alias("q"), F.max("e20").alias("hi"), F.max_by("hybas_id", F.struct("e20", -F.col("hybas_id"))).alias("most"))
    return g.select("continent", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi", "most")


_CHI = """WITH o AS (SELECT CAST(floor((lat + 90) / 30) AS BIGINT) AS band, dam_type, count(*) AS n FROM da WHERE lat IS NOT NULL AND dam_type IS NOT NULL GROUP BY 1, 2),
g AS (SELECT b.band, t.dam_type, coalesce(o.n, 0) AS n FROM (SELECT DISTINCT band FROM o) b CROSS JOIN (SELECT DISTINCT dam_type FROM o) t LEFT JOIN o ON o.band = b.band AND o.dam_type = t.dam_type),
e AS (SELECT n, sum(n) OVER (PARTITION BY band) * sum(n) OVER (PARTITION BY dam_type) / CAST(sum(n) OVER () AS DOUBLE) AS e FROM g)
SELECT round(sum(power(n - e, 2) / e) + 1e-6, 3) AS chi2, (SELECT (count(DISTINCT band) - 1) * (count(DISTINCT dam_type) - 1) FROM g) AS dof FROM e"""


@C.add(_CHI, "da")
def sta4_independence(spark, d):
    """Whether the type depends on the latitude band."""
    c = dams(spark, d).where("lat IS NOT NULL AND dam_type IS NOT NULL").groupBy(F.floor((F.col("lat") + 90) / 30).alias("band"), "dam_type").agg(F.count(F.lit(1)).alias("n"))
    return independence(c, "band", "dam_type", "n").select(settled("chi2", 3).alias("chi2"), "dof")


@C.add("SELECT band, arg_max(dam_type, struct_pack(n := n, t := dam_type)) AS dam_type FROM (SELECT CAST(floor((lat + 90) / 10) AS BIGINT) AS band, dam_type, count(*) AS n FROM da WHERE lat IS NOT NULL AND dam_type IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "da")
def sta5_predominant_type(spark, d):
    c = dams(spark, d).where("lat IS NOT NULL AND dam_type IS NOT NULL").groupBy(F.floor((F.col("lat") + 90) / 10).alias("band"), "dam_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("band").agg(F.max_by("dam_type", F.struct("n", "dam_type")).alias("dam_type"))


@C.add("SELECT unit_id, stat_year, round(hdi - avg(hdi) OVER (PARTITION BY continent) + 1e-8, 5) AS within FROM un", "un")
def sta6_within_transform(spark, d):
    """Values less the mean of their group; the means, a row per group, are joined back, so no group is one task."""
    u = units(spark, d)
    m = u.groupBy("continent").agg(F.avg("hdi").alias("m"))
    return u.join(m, "continent").select("unit_id", "stat_year", settled(F.col("hdi") - F.col("m"), 5).alias("within"))


@C.add("WITH m AS (SELECT avg(hdi) AS m, stddev_pop(hdi) AS s FROM un) SELECT unit_id, stat_year, round((hdi - m) / s + 1e-8, 5) AS z, 1.0::DOUBLE AS const FROM un, m", "un")
def sta7_standardise(spark, d):
    u = units(spark, d)
    return u.select("unit_id", "stat_year", settled((F.col("hdi") - u.agg(F.avg("hdi")).scalar()) / u.agg(F.stddev_pop("hdi")).scalar(), 5).alias("z"), F.lit(1.0).alias("const"))


@C.add("WITH c AS (SELECT corr(hdi, lka) AS a, corr(hdi, sub_area) AS b, corr(lka, sub_area) AS c FROM un WHERE hdi IS NOT NULL AND lka IS NOT NULL AND sub_area IS NOT NULL), t AS (SELECT *, 1 - a*a - b*b - c*c + 2*a*b*c AS det FROM c) SELECT 'hdi' AS name, round((1 - c*c) / det + 1e-8, 5) AS vif FROM t UNION ALL SELECT 'lka', round((1 - b*b) / det + 1e-8, 5) FROM t UNION ALL SELECT 'sub_area', round((1 - a*a) / det + 1e-8, 5) FROM t", "un")
def sta8_vif(spark, d):
    return spark.createDataFrame([(k, round(v + 1e-8, 5)) for k, v in vif(units(spark, d), ["hdi", "lka", "sub_area"]).items()], "name string, vif double")


_MORAN = KNN + """, z AS (SELECT hybas_id AS id, e20 - avg(e20) OVER () AS z FROM bsn), pw AS (SELECT a.z AS zi, b.z AS zj, 0.2::DOUBLE AS w FROM kn JOIN z a ON a.id = i JOIN z b ON b.id = j)
SELECT (SELECT count(*) FROM z) AS n, round((SELECT count(*) FROM z) / sum(w) * sum(w * zi * zj) / (SELECT sum(z * z) FROM z) + 1e-8, 5) AS i FROM pw"""


@C.add("WITH " + _MORAN, "bsn")
def sta9_moran(spark, d):
    """Moran's I of the dams of a basin over its five nearest neighbours."""
    v = basin_table(spark, d).select(F.col("hybas_id").alias("id"), F.col("e20").cast("double").alias("v"))
    return moran(v, neighbours(spark, d)).select("n", settled("i", 5).alias("i"))


def complete(spark: SparkSession, d: str) -> DataFrame:
    return basin_table(spark, d).select(F.col("hybas_id").alias("id"), F.col("e20").cast("double").alias("y"), *XS).na.drop()


@C.add()
def sta9_moran_by_class(spark, d):
    """Moran's I per region, adjusted for the number of tests."""
    p = places(spark, d).where("continent IS NOT NULL")
    w = knn(p, 5, ["continent"]).select("i", "j", "w")
    b = basin_table(spark, d).drop("continent").join(p.select(F.col("id").alias("hybas_id"), "continent"), "hybas_id")
    long = b.select("continent", F.col("hybas_id").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in ("e20", "hdi", "lka")])).alias("s")).select("continent", "id", "s.*")
    m = moran(long, w, ["continent", "variable"])
    f = fdr(m, "continent", "p", "variable")
    return f.select("continent", "variable", F.round("i", 5).alias("i"), F.round("z", 4).alias("z"), F.round("p_adj", 5).alias("p_adj"), stars(F.col("p_adj")).alias("marks"), moran_label(F.col("i"), F.col("p_adj")).alias("label"))


@C.add("SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_r2(y, x) + 1e-7, 4) AS r2, round(regr_slope(y, x) + 1e-6, 3) AS slope, round(regr_intercept(y, x) + 1e-6, 3) AS intercept FROM (SELECT CAST(e20 AS DOUBLE) AS y, hdi AS x FROM bsn WHERE hdi IS NOT NULL)", "bsn")
def sta10_ols_one(spark, d):
    """Least squares on one column, against the engine's own regression in SQL."""
    f = ols(basin_table(spark, d).withColumn("e20", F.col("e20").cast("double")), "e20", ["hdi"])
    return spark.createDataFrame([(f.n, round(f.r2 + 1e-7, 4), round(float(f.coefficients[1]) + 1e-6, 3), round(float(f.coefficients[0]) + 1e-6, 3))], "n long, r2 double, slope double, intercept double")


@C.add()
def sta10_ols(spark, d):
    """Least squares on all columns: fit and coefficients."""
    f = ols(complete(spark, d), "y", XS)
    return spark.createDataFrame([("intercept", float(f.coefficients[0])), *[(x, float(b)) for x, b in zip(XS, f.coefficients[1:])], ("r2", f.r2), ("adjusted_r2", f.adjusted), ("aic", f.aic)], "name string, value double")


@C.add()
def sta11_spatial_lag(spark, d):
    """The spatial lag model by maximum likelihood."""
    f, _ = spatial_lag(complete(spark, d), neighbours(spark, d), "y", XS)
    return spark.createDataFrame([("rho", f.rho), ("z", f.rho_z), ("p", f.rho_p), ("pseudo_r2", f.r2), ("aic", f.aic), *[(x, float(b)) for x, b in zip(XS, f.coefficients[1:])]], "name string, value double")


@C.add()
def sta12_effects(spark, d):
    """Direct, indirect and total effects of the lag model."""
    f, t = spatial_lag(complete(spark, d), neighbours(spark, d), "y", XS)
    return spark.createDataFrame([(x, *e) for x, e in zip(XS, effects(f, t))], "name string, direct double, indirect double, total double")


@C.add("WITH p AS (SELECT hybas_id, continent, confidence_p AS p FROM (SELECT d.hybas_id, min(b.continent) AS continent, 1 - avg(confidence) AS confidence_p FROM da d JOIN basins b ON d.hybas_id = b.hybas_id GROUP BY 1) WHERE continent IS NOT NULL), r AS (SELECT *, p * count(*) OVER (PARTITION BY continent) / row_number() OVER (PARTITION BY continent ORDER BY p, hybas_id) AS q, row_number() OVER (PARTITION BY continent ORDER BY p, hybas_id) AS k FROM p) SELECT hybas_id, round(least(1, min(q) OVER (PARTITION BY continent ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 1e-8, 5) AS p_adj FROM r", "da")
def sta13_fdr(spark, d):
    """Adjusted p-values (of a made-up test per basin)."""
    from riverspark.plans.base import basins

    p = dams(spark, d).join(basins(spark, d).select("hybas_id", "continent"), "hybas_id").where("continent IS NOT NULL").groupBy("hybas_id").agg(F.min("continent").alias("continent"), (F.lit(1) - F.avg("confidence")).alias("p"))
    return fdr(p, "continent", "p", "hybas_id").select("hybas_id", settled("p_adj", 5).alias("p_adj"))


@C.add("WITH n AS (SELECT hybas_id, count(*) FILTER (WHERE NOT is_certain) AS n FROM da WHERE hybas_id IS NOT NULL GROUP BY 1), s AS (SELECT hybas_id, CASE WHEN n = 0 THEN 0 WHEN n <= 5 THEN 1 WHEN n <= 20 THEN 2 WHEN n <= 100 THEN 3 ELSE 4 END AS stratum FROM n) SELECT hybas_id, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY (hybas_id * 48271) % 2147483647, hybas_id) AS r FROM s) WHERE r <= 5", "da")
def sta14_stratified_sample(spark, d):
    """Five basins of each stratum by uncertain dams, without replacement; the sample is the feature."""
    n = dams(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count_if(~F.col("is_certain")).alias("n"))
    s = n.select("hybas_id", F.when(F.col("n") == 0, 0).when(F.col("n") <= 5, 1).when(F.col("n") <= 20, 2).when(F.col("n") <= 100, 3).otherwise(4).alias("stratum"))
    w = Window.partitionBy("stratum").orderBy((F.col("hybas_id") * 48271) % 2147483647, "hybas_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


_GAUSS = [float(x) for x in gaussian_weights(1.0)]


@C.add("WITH " + RASTER + ", k(o, w) AS (VALUES " + ", ".join(f"({i - len(_GAUSS) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(_GAUSS)) + ") SELECT row + a.o AS row, col + b.o AS col, round(sum(n * a.w * b.w) + 1e-8, 5) AS v FROM rs, k a, k b GROUP BY 1, 2", "da")
def sta15_gaussian(spark, d):
    """Cells smoothed by a Gaussian of one cell: each spreads over the kernel, a fixed number of cells."""
    k = F.array(*[F.struct(F.lit(i - len(_GAUSS) // 2).alias("o"), F.lit(w).alias("w")) for i, w in enumerate(_GAUSS)])
    c = cells(spark, d).withColumn("a", F.explode(k)).withColumn("b", F.explode(k))
    return c.groupBy((F.col("row") + F.col("a.o")).alias("row"), (F.col("col") + F.col("b.o")).alias("col")).agg(settled(F.sum(F.col("n") * F.col("a.w") * F.col("b.w")), 5).alias("v"))
