"""Whole assessments, from base tables to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.operators.network import dissolve, fragmentation, regulation, river_status, small_stretches, trapping
from riverspark.operators.proximity import near_pairs
from riverspark.operators.spatial import regions_of
from riverspark.plans.base import Catalog, basins, dams, reaches, settled
from riverspark.plans.routing import DOF, DOR, NETWORK, SED, included, lake_sums, network
from riverspark.session import cut

C = Catalog()
#: Weights of DOF, DOR, SED, USE, RDD and URB in percent, the score's threshold, the flood weight and the volume filter.
WEIGHTS, THRESHOLD, FLOOD, SMALL = (30.0, 30.0, 4.0, 8.0, 18.0, 10.0), 95.0, 50.0, 25.0


def score(terms: list, weights=WEIGHTS):
    """Connectivity score of weighted pressures (0 to 100 each); weighted terms below 0.1 are 0."""
    weighted = [t * F.lit(w) for t, w in zip(terms, weights)]
    kept = [F.when(x < 0.1, 0.0).otherwise(x) for x in weighted]
    return settled(F.lit(100.0) - sum(kept[1:], kept[0]) / F.lit(100.0), 5)


def free_flowing(spark: SparkSession, d: str) -> DataFrame:
    """The assessment: fragmentation, regulation, trapping, score, stretches, filter and status of every reach."""
    n = cut(network(spark, d), "assessed")
    held = dams(spark, d).where("inc = 1 AND goid IS NOT NULL").select(F.col("goid").alias("node"), "stor_mcm")
    dof = fragmentation(n, included(spark, d, 2020).select(F.col("goid").alias("node")))
    dor = regulation(n, held)
    sed = trapping(n, held.withColumnRenamed("stor_mcm", "volume"), lake_sums(spark, d)).select("node", "sed")
    j = n.join(dof, "node").join(dor, "node").join(sed, "node", "left").na.fill(0.0, ["sed"])
    extra = F.lit(1.0) + F.col("fld") / F.lit(100.0) * F.lit(FLOOD / 100)
    rdd, urb = F.least(F.col("rdd") * extra, F.lit(100.0)), F.least(F.col("urb") * extra * F.lit(100.0), F.lit(100.0))
    s = j.withColumn("csi", score([F.col("dof"), F.col("dor"), F.col("sed"), F.col("use_"), rdd, urb])).withColumn("ff", F.when(F.col("csi") < THRESHOLD, 0).otherwise(1))
    sums = n.groupBy("bb_id").agg(F.sum("length_km").alias("bb_len"), F.sum("volume_tcm").alias("bb_vol"))
    s = cut(s.select("node", "down", "hybas_id", "bb_id", "length_km", "volume_tcm", "csi", "ff").join(sums, "bb_id"), "scored")
    first = s.join(dissolve(s.select("node", "down", "bb_id", "ff"), ["bb_id", "ff"]), "node")
    few = small_stretches(first.select("bb_id", "stretch", "ff", F.col("volume_tcm").alias("volume"), F.col("bb_vol").alias("bb_volume")), SMALL).withColumn("few", F.lit(True))
    o = first.join(few, ["bb_id", "stretch"], "left").drop("stretch").withColumn("ff2", F.when(F.col("few"), 1).otherwise(F.col("ff")))
    o = cut(o, "overwritten")
    again = o.join(dissolve(o.select("node", "down", "bb_id", "ff2"), ["bb_id", "ff2"]), "node")
    st = river_status(again.select("bb_id", "stretch", F.col("ff2").alias("ff"), F.col("length_km").alias("length"), F.col("bb_len").alias("bb_length"))).withColumnRenamed("ff", "ff2")
    return again.join(st, ["bb_id", "stretch", "ff2"])


_T = "CASE WHEN {x} < 0.1 THEN 0 ELSE {x} END"
_TERMS = ["dof * 30", "dor * 30", "sed * 4", "use_ * 8", "least(rdd * (1 + fld / 100 * 0.5::DOUBLE), 100) * 18", "least(urb * (1 + fld / 100 * 0.5::DOUBLE) * 100, 100) * 10"]
_SED = SED.removeprefix(NETWORK + ", ")
_DOR = DOR.removeprefix(NETWORK + ", ")
_DOF = DOF.format(year=2020).removeprefix(NETWORK + ", ")
_ONE = f"""{NETWORK}, {_DOF}, {_DOR.replace('pa AS', 'pq AS').replace('FROM pa', 'FROM pq').replace('pa.', 'pq.')}, {_SED},
al AS (SELECT nt.*, df.dof, CASE WHEN dr.r < 0.1 THEN 0 ELSE least(dr.r, 100) END AS dor, coalesce(sd.sed, 0) AS sed FROM nt JOIN df USING (goid) JOIN dr USING (goid) LEFT JOIN sd USING (goid)),
sx AS (SELECT *, round(100 - ({' + '.join(_T.format(x=x) for x in _TERMS)}) / 100 + 1e-8, 5) AS csi FROM al),
fx AS (SELECT *, CASE WHEN csi < 95 THEN 0 ELSE 1 END AS ff, sum(length_km) OVER (PARTITION BY bb_id) AS bb_len, sum(volume_tcm) OVER (PARTITION BY bb_id) AS bb_vol FROM sx),
h1 AS (SELECT a.goid, a.goid AS stretch FROM fx a LEFT JOIN fx b ON a.down = b.goid AND a.bb_id = b.bb_id AND a.ff = b.ff WHERE b.goid IS NULL UNION ALL SELECT c.goid, h1.stretch FROM h1 JOIN fx p ON p.goid = h1.goid JOIN fx c ON c.down = p.goid AND c.bb_id = p.bb_id AND c.ff = p.ff),
sl AS (SELECT bb_id, stretch FROM fx JOIN h1 USING (goid) WHERE ff = 0 GROUP BY 1, 2 HAVING sum(volume_tcm) / max(bb_vol) * 100 < 25),
gx AS (SELECT fx.*, CASE WHEN sl.stretch IS NULL THEN ff ELSE 1 END AS ff2 FROM fx JOIN h1 USING (goid) LEFT JOIN sl ON sl.bb_id = fx.bb_id AND sl.stretch = h1.stretch),
h2 AS (SELECT a.goid, a.goid AS stretch FROM gx a LEFT JOIN gx b ON a.down = b.goid AND a.bb_id = b.bb_id AND a.ff2 = b.ff2 WHERE b.goid IS NULL UNION ALL SELECT c.goid, h2.stretch FROM h2 JOIN gx p ON p.goid = h2.goid JOIN gx c ON c.down = p.goid AND c.bb_id = p.bb_id AND c.ff2 = p.ff2),
sg AS (SELECT bb_id, stretch, ff2, sum(length_km) / max(bb_len) * 100 AS pct FROM gx JOIN h2 USING (goid) GROUP BY ALL),
st2 AS (SELECT *, CASE WHEN pct IS NULL THEN 0 WHEN ff2 = 1 AND pct >= 99.999 THEN 1 WHEN ff2 = 1 THEN 2 ELSE 3 END AS status2 FROM sg)
SELECT goid, csi, status2 FROM gx JOIN h2 USING (goid) JOIN st2 ON st2.bb_id = gx.bb_id AND st2.stretch = h2.stretch AND st2.ff2 = gx.ff2"""


@C.add("WITH RECURSIVE " + _ONE, "re da")
def pipe1_free_flowing_rivers(spark, d):
    """Score and status of every reach, from barriers to classes."""
    return free_flowing(spark, d).select(F.col("node").alias("goid"), "csi", "status2")


_SEG = "CASE WHEN (to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y) > 0 THEN least(greatest(((x-from_x)*(to_x-from_x)+(y-from_y)*(to_y-from_y))/((to_x-from_x)*(to_x-from_x)+(to_y-from_y)*(to_y-from_y)), 0), 1) ELSE 0 END"
_ASSIGNED = f"""pi AS (SELECT d.dam_id, x, y FROM da d JOIN basins b ON d.x > min_x AND d.x < max_x AND d.y > min_y AND d.y < max_y WHERE inc = 1 AND first_year <= 2015),
qd AS (SELECT dam_id, r.goid, sqrt(power(x - (from_x + t*(to_x-from_x)), 2) + power(y - (from_y + t*(to_y-from_y)), 2)) AS d FROM (SELECT pi.dam_id, x, y, r.*, {_SEG} AS t FROM pi JOIN re r ON y BETWEEN least(from_y, to_y) - 5000 AND greatest(from_y, to_y) + 5000) r),
asg AS (SELECT DISTINCT m.g AS goid FROM (SELECT dam_id, min({{'d': d, 'g': goid}}) AS m FROM qd WHERE d <= 5000 GROUP BY 1))"""
_DOF2 = DOF.format(year=2015).removeprefix(NETWORK + ", ")
_TWO = f"""{NETWORK}, {_ASSIGNED}, {_DOF2[_DOF2.index("bq AS"):].replace("FROM br JOIN", "FROM asg JOIN")}
SELECT hybas_id, count(*) AS n, count(*) FILTER (WHERE dof > 0) AS touched, round(avg(dof) + 1e-6, 3) AS mean_dof FROM df JOIN re USING (goid) WHERE hybas_id IS NOT NULL GROUP BY 1"""


@C.add("WITH RECURSIVE " + _TWO, "re da")
def pipe2_fragmentation(spark, d):
    """Dams of 2015 inside basins, put on their nearest reach, routed, and averaged per basin: one lineage."""
    p = dams(spark, d).where("inc = 1 AND first_year <= 2015").select("dam_id", "x", "y")
    inside = regions_of(p, basins(spark, d), "hybas_id", "x", "y", 1_000_000.0)
    shapes = reaches(spark, d).select(F.col("goid").alias("sid"), F.col("from_x").alias("ax"), F.col("from_y").alias("ay"), F.col("to_x").alias("bx"), F.col("to_y").alias("by"))
    near = near_pairs(inside.select(F.col("dam_id").alias("pid"), "x", "y"), shapes, 5000.0)
    n = cut(network(spark, d), "routed")
    dof = fragmentation(n, near.select(F.col("sid").alias("node")))
    g = dof.join(n.select("node", "hybas_id"), "node").where("hybas_id IS NOT NULL").groupBy("hybas_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dof") > 0).alias("touched"), settled(F.avg("dof"), 3).alias("mean_dof"))


#: Attributes that explain, and dam types: e and total change with each simulation.
EXPLAIN, MOVING, STILL = ["hdi", "lka", "area"], ["e", "total"], ["g", "b", "a"]


def simulated_growth(spark: SparkSession, d: str, sims: int, seed: int) -> DataFrame:
    """(sim, hybas_id, grown): embankment dams of 2020 less those of 2010, kept and missed, where a basin has any."""
    from riverspark.functions.special import poisson_draw
    from riverspark.operators.simulation import RECALL_ELSE, recall_of, strong_uniform, thinned

    years = (2010, 2020)
    e = dams(spark, d).where("hybas_id IS NOT NULL AND dam_type = 'embankment_dam'").select("dam_id", "hybas_id", "first_year", "is_certain", "confidence", "z_level")
    r = e.groupBy("hybas_id").agg(*[F.coalesce(F.avg(F.when(F.col("first_year") <= y, recall_of(F.col("z_level")))), F.lit(RECALL_ELSE)).alias(f"r{y}") for y in years])
    n = thinned(e, "dam_id", F.col("is_certain"), F.col("confidence"), sims, seed, strong_uniform).groupBy("hybas_id", "sim").agg(*[F.count_if(F.col("first_year") <= y).alias(f"n{y}") for y in years])
    missed = lambda y: poisson_draw(F.col(f"n{y}") * (F.lit(1.0) - F.col(f"r{y}")) / F.col(f"r{y}"), strong_uniform(F.col("hybas_id"), F.col("sim"), seed + y))
    return n.join(r, "hybas_id").select("sim", "hybas_id", (F.col("n2020") + missed(2020) - F.col("n2010") - missed(2010)).cast("double").alias("grown"))


def models(spark: SparkSession, d: str):
    """Per region its places of each set, its model and attributes: fixed, since the basins are (180 rows)."""
    import numpy as np

    from riverspark.functions.classes import latitude_class
    from riverspark.operators.propagation import LEAST, Model, Places
    from riverspark.operators.spatial import knn
    from riverspark.plans.base import basin_table
    from riverspark.plans.joins import places

    p = places(spark, d).select("id", "lon", "lat", F.explode(F.array(F.lit("Global"), latitude_class(F.col("lat")))).alias("region")).where("region IS NOT NULL")
    change = [(F.col(f"{t}20") - F.col(f"{t}10")).cast("double").alias(t) for t in STILL]
    b = basin_table(spark, d).select(F.col("hybas_id").alias("id"), *change, *[F.col(c).cast("double").alias(c) for c in EXPLAIN]).withColumn("land", F.when(F.col("area") > 0, F.col("area")))
    known = {"dams": F.col("land").isNotNull(), **{c: F.col(c).isNotNull() for c in EXPLAIN}, "model": F.col("land").isNotNull() & F.col("hdi").isNotNull() & F.col("lka").isNotNull()}
    sets = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in known.items()]))).alias("set")
    rows = cut(p.join(b, "id").select("*", sets), "places")
    pairs, members, values = {}, {}, {}
    for x in rows.collect():
        members.setdefault((x["region"], x["set"]), []).append(x["id"])
        values[x["id"]] = x.asDict()
    for x in knn(rows.select("region", "set", "id", "lon", "lat"), 5, ["region", "set"]).collect():
        pairs.setdefault((x["region"], x["set"]), []).append((x["i"], x["j"], x["w"]))
    out = {}
    for (region, kind), ids in members.items():
        ids.sort()
        if len(ids) >= (LEAST if kind != "model" else len(EXPLAIN) + LEAST):
            x = np.array([[values[i][c] for c in EXPLAIN] for i in ids]) if kind == "model" else None
            out[region, kind] = Places(ids, pairs[region, kind]) if x is None else Model(ids, pairs[region, kind], x)
    return out, values


def assessed(fixed: dict, types: dict) -> list[tuple]:
    """(kind, region, dam_type, variable, measure, value) of the densities of each type {id: value}."""
    import numpy as np

    out = []
    for (region, kind), m in fixed.items():
        for t, v in types.items() if kind in ("dams", "model") else ():
            y = np.array([v[i] for i in m.ids])
            if kind == "dams":
                out += [("moran", region, t, None, k, float(x)) for k, x in m.moran(y).items()]
            else:
                quality, columns = m.fit(y)
                out += [("fit", region, t, None, k, float(x)) for k, x in quality.items()]
                out += [("effects", region, t, c, k, float(x)) for c, own in zip(EXPLAIN, columns) for k, x in own.items()]
    return out


@C.add()
def pipe3_regression_with_uncertainty(spark, d):
    """Moran's I, fits of least squares and of the lag model, and effects of basin attributes on the growth of dam density
    from 2010 to 2020, by region and dam type: mean and 95 % interval over 1000 simulations of uncertain and missed dams.

    kind, region, dam_type (of Moran's I also the attributes), variable, measure; p_adj and marks stand beside p-values,
    label beside i (and resid_i). Weights, inverses and eigenvalues are made once; what no simulation changes is fitted once.
    """
    import numpy as np
    import pandas as pd

    from riverspark.functions.classes import moran_label, stars
    from riverspark.operators.simulation import empirical
    from riverspark.operators.statistics import fdr
    from riverspark.plans.simulation import SEED, WHOLE

    fixed, values = models(spark, d)
    area = {i: v["land"] for i, v in values.items() if v["land"]}
    still = {t: {i: values[i][t] / a for i, a in area.items()} for t in STILL}
    once = assessed(fixed, still)
    for (region, kind), m in fixed.items():
        if kind in EXPLAIN:
            once += [("moran", region, kind, None, k, float(x)) for k, x in m.moran(np.array([values[i][kind] for i in m.ids])).items()]
    shape = "kind string, region string, dam_type string, variable string, measure string, value double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        grown = dict(zip(g["hybas_id"], g["grown"]))
        e = {i: grown.get(i, 0.0) / a for i, a in area.items()}
        return pd.DataFrame(assessed(fixed, {"e": e, "total": {i: v + sum(still[t][i] for t in STILL) for i, v in e.items()}}), columns=[c.split()[0] for c in shape.split(", ")])

    keys = ["kind", "region", "dam_type", "variable", "measure"]
    # a row of no basin for each simulation, so that one without dams counts too
    every = spark.range(1, WHOLE + 1).select(F.col("id").cast("int").alias("sim"), F.lit(-1).cast("long").alias("hybas_id"), F.lit(0.0).alias("grown"))
    moving = empirical(simulated_growth(spark, d, WHOLE, SEED).unionByName(every).groupBy("sim").applyInPandas(run, shape), keys, "value")
    same = spark.createDataFrame(once, shape).withColumn("v", F.when(~F.isnan("value"), F.col("value")))
    r = cut(moving.unionByName(same.select(*keys, F.when(F.col("v").isNull(), 0).otherwise(WHOLE).cast("long").alias("n"), F.col("v").alias("mean"), F.col("v").alias("low"), F.col("v").alias("high"))), "assessed")
    tests = r.where("measure = 'p_value'").select("kind", "region", "dam_type", "variable", "mean", F.concat_ws("|", "kind", "region").alias("family"), F.concat_ws("|", "dam_type", "variable").alias("test"))
    adjusted = fdr(tests, "family", "mean", "test").select(F.concat_ws("|", "family", "test").alias("t"), "p_adj")
    p_of = r.where("measure IN ('p_value', 'resid_p')").select(F.concat_ws("|", "kind", "region", "dam_type", "variable", F.when(F.col("measure") == "resid_p", "resid_i").otherwise("i")).alias("l"), F.col("mean").alias("_p"))
    j = r.join(adjusted, (F.col("measure") == "p_value") & (F.concat_ws("|", "kind", "region", "dam_type", "variable") == F.col("t")), "left").join(p_of, F.concat_ws("|", *keys) == F.col("l"), "left")
    marks = F.when(F.col("measure") == "p_value", stars(F.col("p_adj"))).when(F.col("measure") == "rho_p", stars(F.col("mean")))
    return j.select(*keys, "n", "mean", "low", "high", "p_adj", marks.alias("marks"), F.when(F.col("measure").isin("i", "resid_i"), moran_label(F.col("mean"), F.col("_p"))).alias("label"))
