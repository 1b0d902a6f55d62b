"""Monte Carlo of uncertain dams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverspark.operators.network import barrier_scores
from riverspark.operators.simulation import RECALL, RECALL_ELSE, convergence, empirical, first_present, group_means, recall_of, running_error, segment_statistics, strong_uniform, thinned, uniform, with_missed
from riverspark.plans.base import YEARS, Catalog, basin_table, dams, settled
from riverspark.plans.routing import NETWORK, network
from riverspark.session import cut

C = Catalog()
SIMS, SEED = 20, 42
#: Simulations of the whole assessment. Queries beside SQL run SIMS or 10 of them, as their SQL says; mcN_whole run all, with independent draws.
WHOLE = 1000

_U = "((((({k} % 2147483647) * 48271 + sim * 69621 + 42 * 16807) % 2147483647 * 48271 % 2147483647) + sim * 40692) * 69621 % 2147483647) / CAST(2147483647 AS DOUBLE)"
KEPT = f"kp AS (SELECT d.*, sim FROM da d, (SELECT range AS sim FROM range(1, {SIMS + 1})) s WHERE coalesce(is_certain, false) OR {_U.format(k='dam_id')} < confidence)"


def kept(spark: SparkSession, d: str, sims: int = SIMS, draw=uniform) -> DataFrame:
    return thinned(dams(spark, d).select("dam_id", "dam_type", "hybas_id", "goid", "first_year", "is_certain", "confidence", "z_level", "inc"), "dam_id", F.col("is_certain"), F.col("confidence"), sims, SEED, draw)


@C.add("WITH " + KEPT + " SELECT CAST(sim AS INT) AS sim, first_year, count(*) AS n FROM kp GROUP BY 1, 2", "da")
def mc1_thinning(spark, d):
    """Dams kept by each simulation and year."""
    return kept(spark, d).groupBy("sim", "first_year").agg(F.count(F.lit(1)).alias("n"))


def basin_recall(spark: SparkSession, d: str) -> DataFrame:
    return dams(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.avg(recall_of(F.col("z_level"))).alias("recall"))


@C.add()
def mc2_missed(spark, d):
    """Dams kept and missed per basin and simulation, and their density."""
    m = with_missed(kept(spark, d).where("hybas_id IS NOT NULL"), basin_recall(spark, d), "hybas_id", SEED)
    a = basin_table(spark, d).select("hybas_id", F.when(F.col("area") > 0, F.col("area")).alias("area"))
    return m.join(a, "hybas_id", "left").select("hybas_id", "sim", "n_true", "n_missed", F.round((F.col("n_true") + F.col("n_missed")) / F.col("area"), 6).alias("density"))


_R = "CASE z_level " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in RECALL.items()) + f" ELSE {RECALL_ELSE}::DOUBLE END"


@C.add(f"SELECT hybas_id, round(avg({_R}) + 1e-9, 6) AS recall FROM da WHERE hybas_id IS NOT NULL GROUP BY 1", "da")
def mc3_basin_recall(spark, d):
    return basin_recall(spark, d).select("hybas_id", settled("recall", 6).alias("recall"))


_MC4 = f"""WITH RECURSIVE {NETWORK}, {KEPT}, br AS (SELECT DISTINCT goid FROM da WHERE inc = 1 AND goid IS NOT NULL), bq AS (SELECT goid, dis AS qb, hyfall FROM br JOIN re USING (goid)),
up AS (SELECT goid AS src, goid AS node, qb AS q, qb FROM bq WHERE qb > 0 AND hyfall = 0 UNION ALL SELECT u.src, c.goid, c.dis, u.qb FROM up u JOIN nt c ON c.down = u.node WHERE c.hyfall = 0 AND c.dis >= u.qb / 5::DOUBLE AND c.dis > 0),
dn AS (SELECT goid AS src, goid AS node, qb AS q, qb FROM bq WHERE qb > 0 UNION ALL SELECT u.src, c.goid, c.dis, u.qb FROM dn u JOIN nt s ON s.goid = u.node JOIN re c ON c.goid = s.down WHERE c.dis <= u.qb * 5::DOUBLE AND c.dis > 0),
sc AS (SELECT goid AS src, goid AS node, 100::DOUBLE AS s FROM bq WHERE qb <= 0 UNION ALL SELECT src, node, least(100, greatest(0, 100 - abs(log10(least(q, qb)) - log10(qb)) * 100 / log10(5::DOUBLE))) FROM up UNION ALL SELECT src, node, least(100, greatest(0, 100 - abs(log10(greatest(q, qb)) - log10(qb)) * 100 / log10(5::DOUBLE))) FROM dn),
ps AS (SELECT DISTINCT sim, goid FROM kp WHERE inc = 1 AND goid IS NOT NULL AND sim <= 10), bs AS (SELECT sim, node, max(s) AS s FROM sc JOIN ps ON ps.goid = sc.src GROUP BY 1, 2),
nn AS (SELECT hybas_id, count(*) AS n FROM re WHERE hybas_id IS NOT NULL GROUP BY 1), ms AS (SELECT sim, hybas_id, sum(s) AS t FROM bs JOIN re ON re.goid = node WHERE hybas_id IS NOT NULL GROUP BY 1, 2),
md AS (SELECT nn.hybas_id, g.range AS sim, coalesce(t, 0) / n AS dof FROM nn CROSS JOIN range(1, 11) g LEFT JOIN ms ON ms.hybas_id = nn.hybas_id AND ms.sim = g.range)"""


def simulated_dof(spark: SparkSession, d: str, sims: int = 10) -> DataFrame:
    """(hybas_id, sim, dof): mean DOF of each basin and simulation; 0 where a simulation has no dam.

    Walks don't depend on the simulation: they are made once, with the barrier's reach; each simulation takes the
    maximum over the barriers it kept.
    """
    n = network(spark, d)
    b = dams(spark, d).where("inc = 1 AND goid IS NOT NULL").select(F.col("goid").alias("node"), F.col("goid").alias("src")).distinct()
    scores = barrier_scores(n, b, carry=["src"]).groupBy("src", "node").agg(F.max("s").alias("s"))
    present = kept(spark, d, sims).where("inc = 1 AND goid IS NOT NULL").select("sim", F.col("goid").alias("src")).distinct()
    best = present.join(scores, "src").groupBy("sim", "node").agg(F.max("s").alias("s"))
    sums = best.join(n.where("hybas_id IS NOT NULL").select("node", "hybas_id"), "node").groupBy("sim", "hybas_id").agg(F.sum("s").alias("t"))
    every = n.where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count(F.lit(1)).alias("n")).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims))))
    return every.join(sums, ["sim", "hybas_id"], "left").select("hybas_id", "sim", (F.coalesce("t", F.lit(0.0)) / F.col("n")).alias("dof"))


@C.add(_MC4 + " SELECT hybas_id, CAST(sim AS INT) AS sim, round(dof + 1e-7, 4) AS dof FROM md", "re da")
def mc4_simulated_dof(spark, d):
    return simulated_dof(spark, d).select("hybas_id", "sim", settled("dof", 4).alias("dof"))


@C.add(_MC4 + " SELECT hybas_id, count(*) AS n, round(avg(dof) + 1e-7, 4) AS mean, round(quantile_cont(dof, 0.025) + 1e-7, 4) AS low, round(quantile_cont(dof, 0.975) + 1e-7, 4) AS high FROM md GROUP BY 1", "re da")
def mc5_empirical(spark, d):
    """Mean and interval of each basin's DOF over the simulations."""
    e = empirical(simulated_dof(spark, d), ["hybas_id"], "dof")
    return e.select("hybas_id", "n", settled("mean", 4).alias("mean"), settled("low", 4).alias("low"), settled("high", 4).alias("high"))


COUNTS = KEPT + ", ct AS (SELECT b.hybas_id, CAST(s.range AS INT) AS sim, CAST(coalesce(n, 0) AS DOUBLE) AS v FROM (SELECT DISTINCT hybas_id FROM da WHERE hybas_id IS NOT NULL) b CROSS JOIN range(1, 21) s LEFT JOIN (SELECT hybas_id, sim, count(*) AS n FROM kp GROUP BY 1, 2) k ON k.hybas_id = b.hybas_id AND k.sim = s.range)"


def counts(spark: SparkSession, d: str, sims: int = SIMS, draw=uniform) -> DataFrame:
    """(hybas_id, sim, v): dams kept, 0 where none is."""
    n = kept(spark, d, sims, draw).where("hybas_id IS NOT NULL").groupBy("hybas_id", "sim").agg(F.count(F.lit(1)).alias("n"))
    every = dams(spark, d).where("hybas_id IS NOT NULL").select("hybas_id").distinct().withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims))))
    return every.join(n, ["hybas_id", "sim"], "left").select("hybas_id", "sim", F.coalesce("n", F.lit(0)).cast("double").alias("v"))


@C.add("WITH " + COUNTS + " SELECT hybas_id, round(avg(v) + 1e-7, 4) AS mean, round(quantile_cont(v, 0.025) + 1e-7, 4) AS low, round(quantile_cont(v, 0.975) + 1e-7, 4) AS high FROM ct GROUP BY 1", "da")
def mc6_aggregate(spark, d):
    e = empirical(counts(spark, d), ["hybas_id"], "v")
    return e.select("hybas_id", settled("mean", 4).alias("mean"), settled("low", 4).alias("low"), settled("high", 4).alias("high"))


_RUN = COUNTS + ", rn AS (SELECT hybas_id, sim, count(*) OVER w AS k, avg(v) OVER w AS mean, stddev_pop(v) OVER w / sqrt(count(*) OVER w) AS se FROM ct WINDOW w AS (PARTITION BY hybas_id ORDER BY sim ROWS UNBOUNDED PRECEDING))"


@C.add("WITH " + _RUN + " SELECT hybas_id, sim, k, round(mean + 1e-7, 4) AS mean, round(se + 1e-7, 4) AS se FROM rn", "da")
def mc7_running_error(spark, d):
    r = running_error(counts(spark, d), ["hybas_id"], "v")
    return r.select("hybas_id", "sim", "k", settled("mean", 4).alias("mean"), settled("se", 4).alias("se"))


@C.add("WITH " + _RUN + ", tp AS (SELECT hybas_id, max(se) AS t FROM rn GROUP BY 1) SELECT hybas_id, s AS share, min(k) FILTER (WHERE round(se, 9) <= round(t * s, 9)) AS k FROM rn JOIN tp USING (hybas_id), (VALUES (0.5::DOUBLE), (0.2::DOUBLE), (0.1::DOUBLE)) x(s) GROUP BY 1, 2", "da")
def mc8_convergence(spark, d):
    """First simulation from which the error is a share of the largest early one."""
    r = running_error(counts(spark, d), ["hybas_id"], "v").withColumn("se", F.round("se", 9))
    return convergence(r, ["hybas_id"], [0.5, 0.2, 0.1])


@C.add("WITH " + _RUN + ", st AS (SELECT hybas_id, CASE WHEN count(*) FILTER (WHERE NOT is_certain) = 0 THEN 0 WHEN count(*) FILTER (WHERE NOT is_certain) <= 20 THEN 1 ELSE 2 END AS stratum FROM da WHERE hybas_id IS NOT NULL GROUP BY 1) SELECT stratum, k, round(quantile_cont(se, 0.25) + 1e-7, 4) AS q1, round(median(se) + 1e-7, 4) AS q2, round(quantile_cont(se, 0.75) + 1e-7, 4) AS q3 FROM rn JOIN st USING (hybas_id) GROUP BY 1, 2", "da")
def mc9_error_by_stratum(spark, d):
    """Quartiles of the error by stratum of uncertain dams."""
    n = F.count_if(~F.col("is_certain"))
    st = dams(spark, d).where("hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.when(n == 0, 0).when(n <= 20, 1).otherwise(2).alias("stratum"))
    g = running_error(counts(spark, d), ["hybas_id"], "v").join(st, "hybas_id").groupBy("stratum", "k").agg(F.percentile("se", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("stratum", "k", *[settled(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@C.add("WITH " + COUNTS + " SELECT hybas_id, v AS n, 'sim' AS kind, sim FROM ct UNION ALL SELECT hybas_id, CAST(count(*) AS DOUBLE), 'static', NULL FROM da WHERE hybas_id IS NOT NULL AND is_certain GROUP BY 1", "da")
def mc10_static_and_simulated(spark, d):
    """Columns that no simulation changes are computed once and put beside the simulated ones."""
    s = dams(spark, d).where("hybas_id IS NOT NULL AND is_certain").groupBy("hybas_id").agg(F.count(F.lit(1)).cast("double").alias("n")).select("hybas_id", "n", F.lit("static").alias("kind"), F.lit(None).cast("int").alias("sim"))
    return counts(spark, d).select("hybas_id", F.col("v").alias("n"), F.lit("sim").alias("kind"), "sim").unionByName(s)


@C.add(f"SELECT dam_id, CAST(sim AS INT) AS sim, {_U.format(k='dam_id')} AS u FROM da, (SELECT range AS sim FROM range(1, 4)) s", "da")
def mc11_uniforms(spark, d):
    """The uniforms themselves, from (seed, simulation, dam)."""
    return dams(spark, d).select("dam_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("sim")).select("dam_id", "sim", uniform(F.col("dam_id"), F.col("sim"), SEED).alias("u"))


@C.add()
def mc1_whole(spark, d):
    """Dams kept by each of all simulations and year."""
    return kept(spark, d, WHOLE, strong_uniform).groupBy("sim", "first_year").agg(F.count(F.lit(1)).alias("n"))


@C.add()
def mc2_whole(spark, d):
    """Dams kept and missed per basin over all simulations, and their density."""
    m = with_missed(kept(spark, d, WHOLE, strong_uniform).where("hybas_id IS NOT NULL"), basin_recall(spark, d), "hybas_id", SEED)
    a = basin_table(spark, d).select("hybas_id", F.when(F.col("area") > 0, F.col("area")).alias("area"))
    return m.join(a, "hybas_id", "left").select("hybas_id", "sim", "n_true", "n_missed", F.round((F.col("n_true") + F.col("n_missed")) / F.col("area"), 6).alias("density"))


def presence(spark: SparkSession, d: str, sims: int, years: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The network, and floors and hits of its reaches (first_present). A dam counts from its first_year on; walks are made once."""
    n = cut(network(spark, d), "routed")
    inc = dams(spark, d).where("inc = 1 AND goid IS NOT NULL")
    scores = barrier_scores(n, inc.select(F.col("goid").alias("node"), F.col("goid").alias("src")).distinct(), carry=["src"]).groupBy("src", "node").agg(F.max("s").alias("s"))
    records = inc.select(F.col("dam_id").alias("key"), F.col("goid").alias("src"), "first_year", F.col("is_certain").alias("certain"), "confidence")
    return n, *first_present(scores, records, years, sims, SEED)


def whole_dof(spark: SparkSession, d: str, sims: int = WHOLE, years: tuple[int, ...] = YEARS) -> DataFrame:
    """(hybas_id, year, sim, dof): mean DOF of each basin, year and simulation; 0 where a simulation has no dam."""
    n, floors, hits = presence(spark, d, sims, years)
    return group_means(n, "hybas_id", floors, hits, years, sims).withColumnRenamed("mean", "dof")


@C.add()
def mc4_whole(spark, d):
    """Mean DOF of each basin, year and simulation."""
    return whole_dof(spark, d).select("hybas_id", "year", "sim", settled("dof", 4).alias("dof"))


@C.add()
def mc5_whole_basins(spark, d):
    """Mean and interval of each basin's DOF in each year, over all simulations."""
    e = empirical(whole_dof(spark, d), ["hybas_id", "year"], "dof")
    return e.select("hybas_id", "year", "n", settled("mean", 4).alias("mean"), settled("low", 4).alias("low"), settled("high", 4).alias("high"))


@C.add()
def mc5_whole_reaches(spark, d):
    """Mean and interval of each reach's DOF in each year, over all simulations."""
    e = segment_statistics(*presence(spark, d, WHOLE, YEARS), YEARS, WHOLE)
    return e.select(F.col("node").alias("goid"), "year", "n", settled("mean", 4).alias("mean"), settled("low", 4).alias("low"), settled("high", 4).alias("high"))


@C.add()
def mc6_whole(spark, d):
    """Mean and interval of each basin's dams over all simulations."""
    e = empirical(counts(spark, d, WHOLE, strong_uniform), ["hybas_id"], "v")
    return e.select("hybas_id", settled("mean", 4).alias("mean"), settled("low", 4).alias("low"), settled("high", 4).alias("high"))


@C.add()
def mc10_whole(spark, d):
    """Fixed counts once, beside those of all simulations."""
    s = dams(spark, d).where("hybas_id IS NOT NULL AND is_certain").groupBy("hybas_id").agg(F.count(F.lit(1)).cast("double").alias("n")).select("hybas_id", "n", F.lit("static").alias("kind"), F.lit(None).cast("int").alias("sim"))
    return counts(spark, d, WHOLE, strong_uniform).select("hybas_id", F.col("v").alias("n"), F.lit("sim").alias("kind"), "sim").unionByName(s)


#: Uncertain dams of 2020 in a basin from which a stratum begins; basins without any are in none.
STRATA = (1, 10, 100, 1000, 10000)
CONVERGENCE, SHARES = 2000, [0.5, 0.2, 0.1, 0.05, 0.01]


def whole_errors(spark: SparkSession, d: str) -> DataFrame:
    """(scope, hybas_id, sim, k, mean, se) of the DOF of 2020: of each basin, and of the mean over all basins (hybas_id null)."""
    dof = cut(whole_dof(spark, d, CONVERGENCE, (2020,)).select("hybas_id", "sim", "dof"), "dof2020")
    own = running_error(dof, ["hybas_id"], "dof").withColumn("scope", F.lit("basin"))
    mean = dof.groupBy("sim").agg(F.avg("dof").alias("dof")).select(F.lit("all").alias("scope"), F.lit(None).cast("long").alias("hybas_id"), "sim", "dof")
    return own.unionByName(running_error(mean, ["scope", "hybas_id"], "dof")).withColumn("se", F.round("se", 9))


@C.add()
def mc7_whole(spark, d):
    """Running mean and error of DOF over 2000 simulations of 2020, per basin and over all basins."""
    return whole_errors(spark, d).select("scope", "hybas_id", "sim", "k", settled("mean", 4).alias("mean"), settled("se", 6).alias("se"))


def converged(errors: DataFrame) -> DataFrame:
    """(scope, hybas_id, share, k): the first simulation whose error is at most a share of the largest of the first 20; null if none is.

    An error of 0 (the first simulation's, or of a basin that doesn't vary) is no error yet.
    """
    keys = errors.select("scope", "hybas_id").distinct().withColumn("share", F.explode(F.array(*[F.lit(s) for s in SHARES])))
    some = errors.where("se > 0").withColumn("basin", F.coalesce("hybas_id", F.lit(-1)))
    k = convergence(some, ["scope", "basin"], SHARES)
    return keys.join(k.withColumnRenamed("scope", "_s").withColumnRenamed("share", "_f"), (F.col("scope") == F.col("_s")) & (F.col("share") == F.col("_f")) & (F.coalesce("hybas_id", F.lit(-1)) == F.col("basin")), "left").select("scope", "hybas_id", "share", "k")


@C.add()
def mc8_whole(spark, d):
    """First simulation of 2000 from which the error is 50, 20, 10, 5 and 1 % of the largest early one, per basin and over all basins."""
    return converged(whole_errors(spark, d))


def uncertain(spark: SparkSession, d: str) -> DataFrame:
    """(hybas_id, n): uncertain dams of 2020."""
    return dams(spark, d).where("inc = 1 AND first_year <= 2020 AND hybas_id IS NOT NULL").groupBy("hybas_id").agg(F.count_if(~F.coalesce("is_certain", F.lit(False))).alias("n"))


@C.add()
def mc9_whole(spark, d):
    """Quartiles of the error of 2020 by stratum of uncertain dams and k, from the second simulation on; errors of 0 don't count."""
    stratum = sum((F.col("n") >= low).cast("int") for low in STRATA)
    st = uncertain(spark, d).withColumn("stratum", stratum).where("stratum > 0").select("hybas_id", "stratum")
    e = whole_errors(spark, d).where("scope = 'basin' AND k > 1").join(st, "hybas_id")
    g = e.groupBy("stratum", "k").agg(F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("se") > 0, F.col("se")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("stratum", "k", "n", *[settled(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)])
