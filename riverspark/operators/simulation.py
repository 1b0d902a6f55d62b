"""Monte Carlo over uncertain records, with uniforms that depend on (seed, simulation, record) only: no partitioning changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.functions.special import poisson_draw
from riverspark.sources.config import positive

#: Recall by zoom level, and where the level is unknown.
RECALL, RECALL_ELSE = {13: 0.8671, 14: 0.8754, 15: 0.8551, 16: 0.9011}, 0.9011
_P = 2147483647


def uniform(key: Column, sim: Column, seed: int) -> Column:
    """A number in (0, 1) by multiplicative steps modulo 2^31-1, which any SQL engine can repeat exactly."""
    k = F.pmod(key.cast("long"), F.lit(_P))
    x = (k * 48271 + sim.cast("long") * 69621 + F.lit(seed * 16807)) % _P
    x = (x * 48271 % _P + sim.cast("long") * 40692) * 69621 % _P
    return x / F.lit(float(_P))


def strong_uniform(key: Column, sim: Column, seed: int) -> Column:
    """A number in [0, 1) by a 64-bit hash, for statistics."""
    return F.shiftrightunsigned(F.xxhash64(key, sim, F.lit(seed)), 11) / F.lit(float(2**53))


def thinned(rows: DataFrame, key: str, certain: Column, keep: Column, n_sim: int, seed: int = 42, draw=uniform) -> DataFrame:
    """rows once per simulation that keeps them: certain rows always, others if their uniform is below keep (null: never)."""
    sims = rows.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(positive("n_sim", n_sim)))))
    return sims.where(F.coalesce(certain, F.lit(False)) | (draw(F.col(key), F.col("sim"), seed) < keep))


def recall_of(level: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in RECALL.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, level), F.lit(RECALL_ELSE))


def with_missed(kept: DataFrame, recall: DataFrame, group: str, seed: int = 42) -> DataFrame:
    """(group, sim, n_true, n_missed): records kept, and those a recall below 1 missed, Poisson with mean n (1-r)/r.

    recall (group, recall); a group without one has the default.
    """
    n = kept.groupBy(group, "sim").agg(F.count(F.lit(1)).alias("n_true"))
    r = F.coalesce("recall", F.lit(RECALL_ELSE))
    j = n.join(recall, group, "left").withColumn("_m", F.col("n_true") * (F.lit(1.0) - r) / r)
    return j.select(group, "sim", "n_true", poisson_draw("_m", strong_uniform(F.col(group), F.col("sim"), seed)).cast("long").alias("n_missed"))


def empirical(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, low, high): mean and the 2.5 and 97.5 percentiles (linear) of simulated values; nulls and NaN don't count."""
    v = F.when(~F.isnan(value), F.col(value))
    g = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return g.select(*keys, "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def running_error(rows: DataFrame, keys: list[str], value: str, sim: str = "sim") -> DataFrame:
    """rows with k, the running mean and standard error (ddof 0) over the simulations so far."""
    w = Window.partitionBy(*keys).orderBy(sim).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(w)
    return rows.select(*keys, sim, n.alias("k"), F.avg(value).over(w).alias("mean"), (F.stddev_pop(value).over(w) / F.sqrt(n.cast("double"))).alias("se"))


def convergence(running: DataFrame, keys: list[str], shares: list[float], first: int = 20, sim: str = "sim") -> DataFrame:
    """(keys, share, k): the first simulation whose error is at most a share of the largest among the first ones; none: null."""
    top = running.where(F.col("k") <= first).groupBy(*keys).agg(F.max("se").alias("_top"))
    j = running.join(top, keys) if keys else running.join(F.broadcast(top), F.lit(True))
    each = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    x = j.select(*keys, "k", "se", "_top", each)
    return x.groupBy(*keys, "share").agg(F.min(F.when(F.col("se") <= F.col("_top") * F.col("share"), F.col("k"))).alias("k"))


def _word_columns(n_sim: int) -> list[str]:
    return [f"w{k}" for k in range(-(-n_sim // 64))]


def first_present(scores: DataFrame, records: DataFrame, years: tuple[int, ...], n_sim: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Which score a node has in each simulation and year: floors (node, year, floor) and hits (node, year, s, floor, words).

    scores (src, node, s): of each source; records (key, src, first_year, certain, confidence): a source is present in a
    year if a record of it that began by then is kept. A node has the largest score of its present sources, else 0.
    Sources of certain records are always present, so their largest score is the node's floor. Of the others only
    scores above the floor count: their simulations are bits of words, and going down the scores, each takes the bits
    that no larger one has. hits holds those (simulation i is bit (i-1) % 64 of word (i-1) // 64); all other simulations
    have the floor, which is 0 where floors has no row.
    """
    from riverspark.session import cut

    columns, every = _word_columns(positive("n_sim", n_sim)), F.array(*[F.lit(y) for y in years])
    since = lambda first: F.explode(F.filter(every, lambda y: y >= first))
    r = records.where("src IS NOT NULL").select("key", "src", "first_year", F.coalesce("certain", F.lit(False)).alias("certain"), "confidence")
    sure = r.where("certain").groupBy("src").agg(F.min("first_year").alias("since"))
    pairs = cut(scores.where("s > 0").select("src", "node", "s"), "pairs")
    floors = cut(pairs.join(sure, "src").select("node", "s", since(F.col("since")).alias("year")).groupBy("node", "year").agg(F.max("s").alias("floor")), "floors")
    # records of a source that is present anyway change nothing
    open_ = r.where("NOT certain AND confidence > 0").join(sure, "src", "left").where("since IS NULL OR first_year < since")
    begun = open_.groupBy("src").agg(F.min("first_year").alias("begun"), F.max("since").alias("since"))
    live = pairs.join(begun, "src").select("src", "node", "s", "since", since(F.col("begun")).alias("year")).where("since IS NULL OR year < since")
    live = live.join(floors, ["node", "year"], "left").na.fill(0.0, ["floor"]).where("s > floor")
    live = cut(live.select("src", "node", "year", "s", "floor"), "live")
    drawn = thinned(open_.join(live.select("src").distinct(), "src", "left_semi"), "key", F.lit(False), F.col("confidence"), n_sim, seed, strong_uniform)
    words = drawn.groupBy("src", "first_year", F.expr("CAST((sim - 1) DIV 64 AS INT)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, (sim - 1) % 64)")).alias("m"))
    wide = words.select("*", since(F.col("first_year")).alias("year")).groupBy("src", "year").agg(*[F.coalesce(F.bit_or(F.when(F.col("w") == k, F.col("m"))), F.lit(0).cast("long")).alias(c) for k, c in enumerate(columns)])
    above = Window.partitionBy("node", "year").orderBy(F.desc("s"), "src").rowsBetween(Window.unboundedPreceding, -1)
    taken = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(F.bit_or(c).over(above), F.lit(0).cast("long")))).alias(c) for c in columns]
    hits = live.join(wide, ["src", "year"]).select("node", "year", "s", "floor", *taken)
    return floors, cut(hits.select("node", "year", "s", "floor", F.array(*columns).alias("words")).where(F.exists("words", lambda m: m != 0)), "hits")


def segment_statistics(nodes: DataFrame, floors: DataFrame, hits: DataFrame, years: tuple[int, ...], n_sim: int) -> DataFrame:
    """(node, year, n, mean, low, high) of every node: mean and the 2.5 and 97.5 percentiles (linear) over the simulations; absent is 0."""
    bits = F.aggregate("words", F.lit(0), lambda a, m: a + F.bit_count(m))
    some = hits.select("node", "year", "s", bits.alias("n"), "floor")
    rest = some.groupBy("node", "year").agg(F.max("floor").alias("s"), (F.lit(n_sim) - F.sum("n")).alias("n"))
    all_ = some.select("node", "year", "s", "n").unionByName(rest.select("node", "year", "s", F.col("n").cast("int").alias("n"))).where("n > 0")
    g = all_.groupBy("node", "year").agg((F.sum(F.col("s") * F.col("n")) / F.lit(float(n_sim))).alias("mean"), F.percentile("s", F.array(F.lit(0.025), F.lit(0.975)), F.col("n")).alias("q"))
    every = nodes.select("node", F.explode(F.array(*[F.lit(y) for y in years])).alias("year")).join(floors, ["node", "year"], "left").join(g, ["node", "year"], "left")
    value = lambda c: F.coalesce(c, "floor", F.lit(0.0))
    return every.select("node", "year", F.lit(n_sim).alias("n"), value("mean").alias("mean"), value(F.col("q")[0]).alias("low"), value(F.col("q")[1]).alias("high"))


def group_means(nodes: DataFrame, group: str, floors: DataFrame, hits: DataFrame, years: tuple[int, ...], n_sim: int) -> DataFrame:
    """(group, year, sim, mean) of the nodes (node, group) of each group and simulation; absent is 0.

    A group's sum is that of the floors plus what hits add; these are summed by bit, a word at a time.
    """
    by = nodes.where(F.col(group).isNotNull()).select("node", group)
    base = by.join(floors, "node").groupBy(group, "year").agg(F.sum("floor").alias("base"))
    words = hits.join(by, "node").select(group, "year", (F.col("s") - F.col("floor")).alias("more"), F.posexplode("words").alias("w", "m")).where("m != 0")
    sums = words.groupBy(group, "year", "w").agg(*[F.expr(f"sum(IF(shiftrightunsigned(m, {b}) & 1L = 1L, more, 0D))").alias(f"b{b}") for b in range(64)])
    more = sums.select(group, "year", "w", F.posexplode(F.array(*[f"b{b}" for b in range(64)])).alias("b", "more")).select(group, "year", (F.col("w") * 64 + F.col("b") + 1).alias("sim"), "more")
    every = by.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("year", F.explode(F.array(*[F.lit(y) for y in years]))).join(base, [group, "year"], "left")
    every = every.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(n_sim)))).join(more, [group, "year", "sim"], "left")
    return every.select(group, "year", "sim", ((F.coalesce("base", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("mean"))
