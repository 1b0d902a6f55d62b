"""Network routing, indices and status of free-flowing rivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverspark.operators.network import accumulate, dense_ids, dissolve, dof_score, fragmentation, pass_ratio, regulation, river_status, small_stretches, trapping
from riverspark.operators.ordering import running_sum
from riverspark.plans.base import Catalog, dams, layer, reaches, settled
from riverspark.session import cut

C = Catalog()
WATERFALL = "fall"


def network(spark: SparkSession, d: str) -> DataFrame:
    """Reaches as nodes (goid); the reach below is that of the same basin with noid = ndoid."""
    r = reaches(spark, d)
    below = r.select(F.col("hybas_id").alias("_b"), F.col("noid").alias("_n"), F.col("goid").alias("down"))
    return r.join(below, (F.col("hybas_id") == F.col("_b")) & (F.col("ndoid") == F.col("_n")), "left").drop("_b", "_n").withColumnRenamed("goid", "node").withColumnRenamed("dis", "q").withColumnRenamed("hyfall", "fall")


def included(spark: SparkSession, d: str, year: int) -> DataFrame:
    """Barriers that count (INC = 1) and stand in a year, by river."""
    return dams(spark, d).where((F.col("inc") == 1) & (F.col("first_year") <= year) & F.col("goid").isNotNull())


NETWORK = """nt AS (SELECT a.*, b.goid AS down FROM re a LEFT JOIN (SELECT hybas_id AS bh, noid AS bn, goid FROM re) b ON a.hybas_id = b.bh AND a.ndoid = b.bn)"""
DOF = f"""{NETWORK}, br AS (SELECT DISTINCT goid FROM da WHERE inc = 1 AND first_year <= {{year}} AND goid IS NOT NULL), bq AS (SELECT goid, dis AS qb, hyfall FROM br JOIN re USING (goid)),
up AS (SELECT goid AS node, qb AS q, qb FROM bq WHERE qb > 0 AND hyfall = 0 UNION SELECT c.goid, c.dis, u.qb FROM up u JOIN nt c ON c.down = u.node WHERE c.hyfall = 0 AND c.dis >= u.qb / 5::DOUBLE AND c.dis > 0),
dn AS (SELECT goid AS node, qb AS q, qb FROM bq WHERE qb > 0 UNION SELECT c.goid, c.dis, u.qb FROM dn u JOIN nt s ON s.goid = u.node JOIN re c ON c.goid = s.down WHERE c.dis <= u.qb * 5::DOUBLE AND c.dis > 0),
sc AS (SELECT goid AS node, 100::DOUBLE AS s FROM bq WHERE qb <= 0 UNION ALL SELECT node, least(100, greatest(0, 100 - abs(log10(least(q, qb)) - log10(qb)) * 100 / log10(5::DOUBLE))) FROM up
  UNION ALL SELECT node, least(100, greatest(0, 100 - abs(log10(greatest(q, qb)) - log10(qb)) * 100 / log10(5::DOUBLE))) FROM dn),
df AS (SELECT goid, coalesce(m, 0) AS dof FROM re LEFT JOIN (SELECT node, max(s) AS m FROM sc GROUP BY 1) ON node = goid)"""


@C.add("WITH RECURSIVE " + DOF.format(year=2020) + " SELECT goid, round(dof + 1e-7, 4) AS dof FROM df", "re da")
def net1_dof(spark, d):
    """Degree of fragmentation of every reach in 2020."""
    return fragmentation(network(spark, d), included(spark, d, 2020).select(F.col("goid").alias("node"))).select(F.col("node").alias("goid"), settled("dof", 4).alias("dof"))


@C.add("WITH RECURSIVE " + DOF.format(year=2010) + " SELECT hybas_id, count(*) AS n, round(avg(dof) + 1e-6, 3) AS mean_dof FROM df JOIN re USING (goid) WHERE hybas_id IS NOT NULL GROUP BY 1", "re da")
def net1b_dof_by_basin(spark, d):
    """Mean DOF of each basin in 2010."""
    n = network(spark, d)
    f = fragmentation(n, included(spark, d, 2010).select(F.col("goid").alias("node")))
    return f.join(n.select("node", "hybas_id"), "node").where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count(F.lit(1)).alias("n"), settled(F.avg("dof"), 3).alias("mean_dof"))


_PAIR = "least(100, greatest(0, 100 - abs(log10({f}(dis, 100::DOUBLE)) - log10(100::DOUBLE)) * 100 / log10(5::DOUBLE)))"


@C.add(f"SELECT goid, round({_PAIR.format(f='least')} + 1e-9, 6) AS up, round({_PAIR.format(f='greatest')} + 1e-9, 6) AS down FROM re WHERE dis > 0", "re")
def net2_decay(spark, d):
    """Both decay functions at a barrier of discharge 100."""
    q, b = F.col("dis"), F.lit(100.0)
    return reaches(spark, d).where("dis > 0").select("goid", settled(dof_score(q, b, 5.0, True), 6).alias("up"), settled(dof_score(q, b, 5.0, False), 6).alias("down"))


DOF_OWN = DOF.format(year=2020).replace("SELECT DISTINCT goid FROM da", "SELECT DISTINCT goid, 2 + z_level % 4 AS f FROM da").replace("SELECT goid, dis AS qb, hyfall", "SELECT goid, dis AS qb, hyfall, f").replace("qb AS q, qb FROM", "qb AS q, qb, f FROM").replace("c.dis, u.qb FROM", "c.dis, u.qb, u.f FROM").replace("/ 5::DOUBLE", "/ u.f::DOUBLE").replace("* 5::DOUBLE", "* u.f::DOUBLE").replace("log10(5::DOUBLE)", "log10(f::DOUBLE)")


@C.add("WITH RECURSIVE " + DOF_OWN + " SELECT goid, round(dof + 1e-7, 4) AS dof FROM df", "re da")
def net3_dof_own_factors(spark, d):
    """DOF with factors of each dam (here 2 to 5 by its zoom level)."""
    b = included(spark, d, 2020).select(F.col("goid").alias("node"), (F.lit(2) + F.col("z_level") % 4).cast("double").alias("dfu"), (F.lit(2) + F.col("z_level") % 4).cast("double").alias("dfd"))
    return fragmentation(network(spark, d), b).select(F.col("node").alias("goid"), settled("dof", 4).alias("dof"))


@C.add("WITH z AS (SELECT r.hybas_id, r.goid, CASE WHEN d.goid IS NULL THEN 0::DOUBLE ELSE 100::DOUBLE END AS s FROM re r LEFT JOIN (SELECT DISTINCT goid FROM da WHERE inc = 1) d USING (goid)) SELECT hybas_id, count(*) AS n, max(s) AS dof FROM z WHERE hybas_id IS NOT NULL GROUP BY 1", "re da")
def net4_zero_dam_fill(spark, d):
    """Basins without dams keep their reaches, with 0; partial scores merge by maximum."""
    own = dams(spark, d).where("inc = 1 AND goid IS NOT NULL").select("goid", F.lit(100.0).alias("s")).groupBy("goid").agg(F.max("s").alias("s"))
    return reaches(spark, d).join(own, "goid", "left").where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("s", F.lit(0.0))).alias("dof"))


DOR = f"""{NETWORK}, st AS (SELECT goid, sum(stor_mcm) AS v FROM da WHERE inc = 1 AND goid IS NOT NULL GROUP BY 1), pa AS (SELECT st.goid AS node, v FROM st JOIN re USING (goid) UNION ALL SELECT s.down, pa.v FROM pa JOIN nt s ON s.goid = pa.node WHERE s.down IS NOT NULL),
tt AS (SELECT node, sum(v) AS v FROM pa GROUP BY 1), dr AS (SELECT goid, dis, CASE WHEN dis > 0 AND v IS NOT NULL THEN 100 * v * 1e6 / (dis * 31536000) ELSE 0 END AS r FROM re LEFT JOIN tt ON node = goid)"""


@C.add("WITH RECURSIVE " + DOR + " SELECT goid, round(CASE WHEN r < 0.1 THEN 0 ELSE least(r, 100) END + 1e-7, 4) AS dor FROM dr", "re da")
def net5_dor(spark, d):
    """Degree of regulation of every reach."""
    s = dams(spark, d).where("inc = 1 AND goid IS NOT NULL").select(F.col("goid").alias("node"), "stor_mcm")
    return regulation(network(spark, d), s).select(F.col("node").alias("goid"), settled("dor", 4).alias("dor"))


TE = "CASE WHEN abs({q}) < 1e-9 THEN 1.0 WHEN sqrt({v} * 1e6 / ({q} * 31.536e6)) < 1e-8 THEN 1.0 ELSE 1 - greatest(0, 1 - 0.05 / sqrt({v} * 1e6 / ({q} * 31.536e6))) END"


@C.add(f"SELECT goid, round({TE.format(v='volume_tcm', q='dis')} + 1e-9, 6) AS pass_ratio FROM re", "re")
def net6_pass_ratio(spark, d):
    return reaches(spark, d).select("goid", settled(pass_ratio(F.col("volume_tcm"), F.col("dis")), 6).alias("pass_ratio"))


def lakes(spark: SparkSession, d: str) -> DataFrame:
    """Lakes for routing: every 7th reach has one; of these every other lies off the network."""
    r = reaches(spark, d).where(F.col("goid") % 7 == 0)
    return r.select(F.col("goid").alias("node"), (F.col("volume_tcm") / F.lit(50.0)).alias("vol"), F.col("dis").alias("q"), (F.col("ero") / F.lit(4.0)).alias("acc"), (F.col("goid") % 2).alias("in_stream"), (F.lit(1) + F.col("goid") % 3).alias("lake_type"), (F.col("goid") % 5 == 0).cast("int").alias("good"))


LAKES = "lk AS (SELECT goid AS node, volume_tcm / 50.0::DOUBLE AS vol, dis AS q, ero / 4.0::DOUBLE AS acc, goid % 2 AS in_stream, 1 + goid % 3 AS lake_type, CAST(goid % 5 = 0 AS INT) AS good FROM re WHERE goid % 7 = 0)"
LAKES_BY = f"{LAKES}, lb AS (SELECT node, coalesce(sum(vol) FILTER (WHERE in_stream = 1), 0) AS volume, coalesce(sum(t * acc) FILTER (WHERE in_stream = 0), 0) AS loss FROM (SELECT *, {TE.format(v='vol', q='q')} AS t FROM lk WHERE lake_type = 1 AND good = 0) GROUP BY 1)"


def lake_sums(spark: SparkSession, d: str) -> DataFrame:
    k = lakes(spark, d).where("lake_type = 1 AND good = 0")
    return k.groupBy("node").agg(F.coalesce(F.sum(F.when(F.col("in_stream") == 1, F.col("vol"))), F.lit(0.0)).alias("volume"), F.coalesce(F.sum(F.when(F.col("in_stream") == 0, pass_ratio(F.col("vol"), F.col("q")) * F.col("acc"))), F.lit(0.0)).alias("loss"))


@C.add("WITH " + LAKES_BY + " SELECT node AS goid, round(volume + 1e-9, 6) AS volume, round(loss + 1e-9, 6) AS loss FROM lb", "re")
def net7_lake_sums(spark, d):
    """Lakes of a reach: volume on the network, loss off it."""
    return lake_sums(spark, d).select(F.col("node").alias("goid"), settled("volume", 6).alias("volume"), settled("loss", 6).alias("loss"))


SED = f"""{NETWORK}, {LAKES_BY}, dv AS (SELECT goid, sum(stor_mcm) AS v FROM da WHERE inc = 1 AND goid IS NOT NULL GROUP BY 1),
ts AS (SELECT goid, down, ero - l AS own, tl, tl * td AS ta FROM (SELECT nt.goid, down, ero, coalesce(loss, 0) AS l, {TE.format(v='coalesce(volume, 0)', q='dis')} AS tl, {TE.format(v='coalesce(dv.v, 0)', q='dis')} AS td FROM nt LEFT JOIN lb ON lb.node = nt.goid LEFT JOIN dv ON dv.goid = nt.goid)),
sp AS (SELECT goid AS node, own * tl AS n, own * ta AS a FROM ts UNION ALL SELECT t.goid, sp.n * t.tl, sp.a * t.ta FROM sp JOIN ts s ON s.goid = sp.node JOIN ts t ON t.goid = s.down),
ss AS (SELECT node AS goid, sum(n) AS n, sum(a) AS a FROM sp GROUP BY 1), sd AS (SELECT goid, n, a, CASE WHEN n > 1e-9 THEN CASE WHEN 100 * (n - a) / n < 0.1 THEN 0 ELSE 100 * (n - a) / n END ELSE 0 END AS sed FROM ss)"""


@C.add("WITH RECURSIVE " + SED + " SELECT goid, round(n + 1e-6, 3) AS natural, round(a + 1e-6, 3) AS anthropogenic, round(sed + 1e-7, 4) AS sed FROM sd", "re da")
def net8_sed(spark, d):
    """Sediment trapping of every reach."""
    s = dams(spark, d).where("inc = 1 AND goid IS NOT NULL").select(F.col("goid").alias("node"), F.col("stor_mcm").alias("volume"))
    t = trapping(network(spark, d), s, lake_sums(spark, d))
    return t.select(F.col("node").alias("goid"), settled("natural", 3).alias("natural"), settled("anthropogenic", 3).alias("anthropogenic"), settled("sed", 4).alias("sed"))


@C.add("SELECT goid, hybas_id, row_number() OVER (PARTITION BY hybas_id ORDER BY upland_skm NULLS LAST, goid) AS idx FROM re", "re")
def net9_topological_ids(spark, d):
    """Ids from the headwaters on: by basin and upland area."""
    return dense_ids(reaches(spark, d), "hybas_id", ["upland_skm"], "goid")


@C.add("SELECT goid, round(sum(stor_mcm) + 1e-7, 3) AS volume, count(*) AS n FROM da WHERE inc = 1 AND goid IS NOT NULL GROUP BY 1", "da")
def net10_reservoir_volume(spark, d):
    return dams(spark, d).where("inc = 1 AND goid IS NOT NULL").groupBy("goid").agg(F.round(F.sum("stor_mcm") + F.lit(1e-7), 3).alias("volume"), F.count(F.lit(1)).alias("n"))


# connectivity scores; the pressures dor and sed are derived from the key here, so that each query tests one operator
SCENARIOS = [("base", [30.0, 30.0, 4.0, 8.0, 18.0, 10.0], 95.0, 50.0), ("dams", [50.0, 40.0, 10.0, 0.0, 0.0, 0.0], 95.0, 50.0), ("land", [5.0, 5.0, 5.0, 40.0, 30.0, 15.0], 90.0, 25.0)]
LABELS = ["DOF", "DOR", "SED", "USE", "RDD", "URB"]


def pressures(spark: SparkSession, d: str) -> DataFrame:
    r = reaches(spark, d)
    f = lambda k, m: (F.pmod(F.col("goid") * k, F.lit(m)).cast("double") * F.lit(0.5))
    return r.withColumn("dof", F.when(F.col("goid") % 3 == 0, f(11, 201)).otherwise(0.0)).withColumn("dor", F.when(F.col("goid") % 4 == 0, f(17, 201)).otherwise(0.0)).withColumn("sed", F.when(F.col("goid") % 5 == 0, f(23, 201)).otherwise(0.0))


PRESSURES = """pr AS (SELECT *, CASE WHEN goid % 3 = 0 THEN CAST((goid * 11) % 201 AS DOUBLE) * 0.5::DOUBLE ELSE 0 END AS dof, CASE WHEN goid % 4 = 0 THEN CAST((goid * 17) % 201 AS DOUBLE) * 0.5::DOUBLE ELSE 0 END AS dor, CASE WHEN goid % 5 = 0 THEN CAST((goid * 23) % 201 AS DOUBLE) * 0.5::DOUBLE ELSE 0 END AS sed FROM re)"""
_SCEN_SQL = "sn(scenario, w0, w1, w2, w3, w4, w5, thr, fw) AS (VALUES " + ", ".join(f"('{n}', {', '.join(f'{x}::DOUBLE' for x in w)}, {t}::DOUBLE, {f}::DOUBLE)" for n, w, t, f in SCENARIOS) + ")"
_T = "CASE WHEN {x} < 0.1 THEN 0 ELSE {x} END"
CSI = f"""{PRESSURES}, {_SCEN_SQL}, wt AS (SELECT goid, scenario, thr, {', '.join(f"{_T.format(x=x)} AS t{i}" for i, x in enumerate(['dof * w0', 'dor * w1', 'sed * w2', 'use_ * w3', 'least(rdd + rdd * (fld / 100) * (fw / 100), 100) * w4', 'least((urb + urb * (fld / 100) * (fw / 100)) * 100, 100) * w5']))} FROM pr, sn),
cs AS (SELECT goid, scenario, thr, round(100 - (t0 + t1 + t2 + t3 + t4 + t5) / 100 + 1e-8, 5) AS csi, t0, t1, t2, t3, t4, t5, greatest(t0, t1, t2, t3, t4, t5) AS tm FROM wt),
ci AS (SELECT goid, scenario, csi, CASE WHEN csi < thr THEN 0 ELSE 1 END AS ff, CASE WHEN tm = 0 THEN 'NAN' WHEN t0 = tm THEN 'DOF' WHEN t1 = tm THEN 'DOR' WHEN t2 = tm THEN 'SED' WHEN t3 = tm THEN 'USE' WHEN t4 = tm THEN 'RDD' ELSE 'URB' END AS dom FROM cs)"""


def connectivity(spark: SparkSession, d: str) -> DataFrame:
    """(goid, scenario, csi, ff, dom): weighted overlay of six pressures and the dominant one, all scenarios in one pass."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.array(*map(F.lit, w)).alias("w"), F.lit(t).alias("thr"), F.lit(f).alias("fw")) for n, w, t, f in SCENARIOS])
    p = pressures(spark, d).withColumn("_s", F.explode(rows)).select("*", "_s.*")
    flood = (F.col("fld") / F.lit(100.0)) * (F.col("fw") / F.lit(100.0))
    rdd = F.least(F.col("rdd") + F.col("rdd") * (F.col("fld") / F.lit(100.0)) * (F.col("fw") / F.lit(100.0)), F.lit(100.0))
    urb = F.least((F.col("urb") + F.col("urb") * (F.col("fld") / F.lit(100.0)) * (F.col("fw") / F.lit(100.0))) * F.lit(100.0), F.lit(100.0))
    terms = [x * F.col("w")[i] for i, x in enumerate([F.col("dof"), F.col("dor"), F.col("sed"), F.col("use_"), rdd, urb])]
    t = p.withColumn("_t", F.array(*[F.when(x < 0.1, 0.0).otherwise(x) for x in terms]))
    total = sum((F.col("_t")[i] for i in range(1, 6)), F.col("_t")[0])
    top = F.array_max("_t")
    csi = settled(F.lit(100.0) - total / F.lit(100.0), 5)
    dom = F.when(top == 0, "NAN").otherwise(F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("_t", top).cast("int")))
    return t.select("goid", "scenario", csi.alias("csi"), "thr", dom.alias("dom")).select("goid", "scenario", "csi", F.when(F.col("csi") < F.col("thr"), 0).otherwise(1).alias("ff"), "dom")


@C.add("WITH " + CSI + " SELECT goid, csi, ff FROM ci WHERE scenario = 'base'", "re")
def idx1_csi(spark, d):
    return connectivity(spark, d).where("scenario = 'base'").select("goid", "csi", "ff")


@C.add("WITH " + CSI + " SELECT goid, dom FROM ci WHERE scenario = 'base'", "re")
def idx2_dominant_pressure(spark, d):
    return connectivity(spark, d).where("scenario = 'base'").select("goid", "dom")


@C.add("WITH " + CSI + " SELECT goid, scenario, csi, ff, dom FROM ci", "re")
def idx3_scenarios(spark, d):
    return connectivity(spark, d)


BACKBONE = f"""{CSI}, {NETWORK}, bb AS (SELECT bb_id, sum(length_km) AS bb_len, sum(volume_tcm) AS bb_vol FROM re GROUP BY 1),
fr AS (SELECT nt.*, ff, csi, dom, bb_len, bb_vol FROM nt JOIN ci USING (goid) JOIN bb USING (bb_id) WHERE scenario = 'base')"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """The network with csi, ff and dom of the base scenario and the sums of each backbone."""
    n = network(spark, d)
    c = connectivity(spark, d).where("scenario = 'base'").select(F.col("goid").alias("node"), "csi", "ff", "dom")
    b = n.groupBy("bb_id").agg(F.sum("length_km").alias("bb_len"), F.sum("volume_tcm").alias("bb_vol"))
    return n.join(c, "node").join(b, "bb_id")


HEADS = """hd AS (SELECT a.goid, a.goid AS stretch FROM fr a LEFT JOIN fr b ON a.down = b.goid AND a.bb_id = b.bb_id AND a.{ff} = b.{ff} WHERE b.goid IS NULL
  UNION ALL SELECT c.goid, hd.stretch FROM hd JOIN fr p ON p.goid = hd.goid JOIN fr c ON c.down = p.goid AND c.bb_id = p.bb_id AND c.{ff} = p.{ff})"""
_H1 = HEADS.format(ff="ff")


@C.add("WITH RECURSIVE " + BACKBONE + ", " + _H1 + " SELECT goid, stretch FROM hd", "re")
def net11_dissolve(spark, d):
    """Stretches of equal backbone and flag."""
    return dissolve(flagged(spark, d).select("node", "down", "bb_id", "ff"), ["bb_id", "ff"]).select(F.col("node").alias("goid"), "stretch")


SMALL = f"""{BACKBONE}, {_H1}, sm AS (SELECT bb_id, stretch FROM fr JOIN hd USING (goid) WHERE ff = 0 GROUP BY 1, 2 HAVING sum(volume_tcm) / max(bb_vol) * 100 < 25)"""


def small(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = cut(flagged(spark, d), "flagged")
    s = f.join(dissolve(f.select("node", "down", "bb_id", "ff"), ["bb_id", "ff"]), "node")
    return s, small_stretches(s.select("bb_id", "stretch", "ff", F.col("volume_tcm").alias("volume"), F.col("bb_vol").alias("bb_volume")), 25.0)


@C.add("WITH RECURSIVE " + SMALL + " SELECT bb_id, stretch FROM sm", "re")
def net12_volume_filter(spark, d):
    """Stretches that are not free-flowing and hold less than 25 % of their backbone's volume."""
    return small(spark, d)[1]


FILTERED = f"""{SMALL}, f2 AS (SELECT fr.* EXCLUDE (ff, csi), CASE WHEN sm.stretch IS NULL THEN ff ELSE 1 END AS ff2, CASE WHEN sm.stretch IS NULL THEN csi ELSE 100 END AS csi2 FROM fr JOIN hd USING (goid) LEFT JOIN sm ON sm.bb_id = fr.bb_id AND sm.stretch = hd.stretch),
h2 AS (SELECT a.goid, a.goid AS stretch FROM f2 a LEFT JOIN f2 b ON a.down = b.goid AND a.bb_id = b.bb_id AND a.ff2 = b.ff2 WHERE b.goid IS NULL UNION ALL SELECT c.goid, h2.stretch FROM h2 JOIN f2 p ON p.goid = h2.goid JOIN f2 c ON c.down = p.goid AND c.bb_id = p.bb_id AND c.ff2 = p.ff2)"""


def filtered(spark: SparkSession, d: str) -> DataFrame:
    """The network after the filter: csi2 = 100 and ff2 = 1 on small stretches, dissolved again."""
    s, few = small(spark, d)
    o = s.join(few.withColumn("_few", F.lit(True)), ["bb_id", "stretch"], "left").drop("stretch")
    o = o.withColumn("ff2", F.when(F.col("_few"), 1).otherwise(F.col("ff"))).withColumn("csi2", F.when(F.col("_few"), 100.0).otherwise(F.col("csi"))).drop("_few")
    o = cut(o, "filtered")
    return o.join(dissolve(o.select("node", "down", "bb_id", "ff2"), ["bb_id", "ff2"]), "node")


@C.add("WITH RECURSIVE " + FILTERED + " SELECT goid, CAST(csi2 AS DOUBLE) AS csi2, ff2, stretch FROM f2 JOIN h2 USING (goid)", "re")
def net13_overwrite_and_dissolve(spark, d):
    return filtered(spark, d).select(F.col("node").alias("goid"), "csi2", "ff2", "stretch")


STATUS = f"""{FILTERED}, sg AS (SELECT bb_id, stretch, ff2, sum(length_km) / max(bb_len) * 100 AS pct FROM f2 JOIN h2 USING (goid) GROUP BY ALL),
sv AS (SELECT bb_id, stretch, ff2, pct, CASE WHEN pct IS NULL THEN 0 WHEN ff2 = 1 AND pct >= 99.999 THEN 1 WHEN ff2 = 1 THEN 2 ELSE 3 END AS status2 FROM sg),
so AS (SELECT f2.*, sv.stretch, status2, CASE status2 WHEN 2 THEN 3 ELSE status2 END AS status1 FROM f2 JOIN h2 USING (goid) JOIN sv ON sv.bb_id = f2.bb_id AND sv.stretch = h2.stretch AND sv.ff2 = f2.ff2)"""


def status(spark: SparkSession, d: str) -> DataFrame:
    f = filtered(spark, d)
    s = river_status(f.select("bb_id", "stretch", F.col("ff2").alias("ff"), F.col("length_km").alias("length"), F.col("bb_len").alias("bb_length")))
    return f.join(s.withColumnRenamed("ff", "ff2"), ["bb_id", "stretch", "ff2"])


@C.add("WITH RECURSIVE " + STATUS + " SELECT goid, stretch, status1, status2 FROM so", "re")
def net14_river_status(spark, d):
    """Free-flowing status of every reach in two and three classes."""
    return status(spark, d).select(F.col("node").alias("goid"), "stretch", "status1", "status2")


@C.add("SELECT hybas_id, node, up_ptr, n_up FROM (SELECT hybas_id, noid AS node, n_up, CAST(coalesce(sum(n_up) OVER (PARTITION BY hybas_id ORDER BY noid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS up_ptr FROM (SELECT r.hybas_id, r.noid, count(u.noid) AS n_up FROM re r LEFT JOIN re u ON u.hybas_id = r.hybas_id AND u.ndoid = r.noid WHERE r.hybas_id IS NOT NULL GROUP BY 1, 2))", "re")
def net15_upstream_index(spark, d):
    """Compressed adjacency: per node the start and number of its upstream neighbours."""
    r = reaches(spark, d).where("hybas_id IS NOT NULL")
    ups = r.groupBy("hybas_id", F.col("ndoid").alias("noid")).agg(F.count("noid").alias("n_up"))
    j = r.select("hybas_id", "noid").join(ups, ["hybas_id", "noid"], "left").na.fill(0, ["n_up"])
    return running_sum(j, ["hybas_id"], ["noid"], "n_up", "up_ptr").select("hybas_id", F.col("noid").alias("node"), "n_up", "up_ptr")


@C.add("WITH RECURSIVE " + NETWORK + ", ac AS (SELECT goid AS node, length_km AS v FROM re UNION ALL SELECT s.down, ac.v FROM ac JOIN nt s ON s.goid = ac.node WHERE s.down IS NOT NULL) SELECT node AS goid, round(sum(v) + 1e-7, 3) AS upstream_km FROM ac GROUP BY 1", "re")
def net17_upstream_length(spark, d):
    """Length of all reaches upstream of a reach, itself included."""
    n = network(spark, d)
    return accumulate(n, n.select("node", F.col("length_km").alias("amount"))).select(F.col("node").alias("goid"), settled("total", 3).alias("upstream_km"))


@C.add("SELECT snap_year, hybas_id, round(avg(dof_all) + 1e-7, 4) AS mean_dof FROM la WHERE hybas_id IS NOT NULL GROUP BY 1, 2", "la")
def net18_layer_mean(spark, d):
    """Mean stored DOF by snapshot and basin."""
    return layer(spark, d).where("hybas_id IS NOT NULL").groupBy("snap_year", "hybas_id").agg(settled(F.avg("dof_all"), 4).alias("mean_dof"))
