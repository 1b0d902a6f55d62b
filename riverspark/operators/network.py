"""Routing on river forests: every reach drains into at most one other.

All operators double their steps: round k has a table of jumps over 2^k reaches, made by joining the jumps of the round
before to themselves, with what holds along the way (smallest and largest discharge, products of pass ratios). What is
routed moves by 2^k at once, so rounds are the logarithm of the longest walk: 13 for a river of 5,000 reaches. No basin is
handled by one task. Each round is written to the shared folder. A cycle shows when a jump is longer than the network
has edges, after as few rounds.

Common columns of `net`: node (unique), down (the node it drains into; null or unknown: sink).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverspark.operators.ordering import positions
from riverspark.session import cut

def dof_score(q: Column, qb: Column, factor: float | Column, upstream: bool) -> Column:
    """DOF of a barrier at discharge qb for a reach of discharge q: 100 at qb, falling with the logarithm to 0 at qb/factor or qb*factor."""
    factor = F.lit(float(factor)) if not isinstance(factor, Column) else factor
    near = F.least(q, qb) if upstream else F.greatest(q, qb)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(F.log10(near) - F.log10(qb)) * F.lit(100.0) / F.log10(factor)))


def decay(mode: int) -> Callable[..., Column]:
    """The decay of a mode; 1, logarithmic, is the only one."""
    if mode != 1:
        raise ValueError(f"unknown decay mode {mode}")
    return dof_score


def doubled(edges: DataFrame, merge: dict[str, Callable[[Column, Column], Column]], name: str) -> Iterator[DataFrame]:
    """Tables of jumps (node, to, values) over 1, 2, 4, … edges, until none is left.

    edges: (node, to, values), node unique. A value of two jumps in a row comes from merge (first, second).
    """
    jumps, length = cut(edges.select("node", "to", *merge), f"{name}-jumps"), 1
    n = jumps.count()
    while not jumps.isEmpty():
        if length > n:
            raise ValueError("the network has a cycle")
        yield jumps
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("_to"), *[F.col(c).alias(f"_{c}") for c in merge])
        jumps = cut(jumps.join(further, "to").select("node", F.col("_to").alias("to"), *[f(F.col(c), F.col(f"_{c}")).alias(c) for c, f in merge.items()]), f"{name}-jumps")
        length *= 2


def _edges(net: DataFrame) -> DataFrame:
    """(node, to) of reaches that drain into a known one."""
    return net.where("down IS NOT NULL").select("node", F.col("down").alias("to")).join(net.select(F.col("node").alias("to")), "to", "left_semi")


def barrier_scores(net: DataFrame, barriers: DataFrame, up: float = 5.0, down: float = 5.0, mode: int = 1, carry: list[str] | None = None) -> DataFrame:
    """(node, s, carry): the scores that barriers give to the reaches they reach, as fragmentation describes.

    carry: further columns of barriers that stay with their scores (such as the barrier's own reach, for simulations).
    """
    score, carry = decay(mode), carry or []
    own = [F.greatest(F.coalesce(F.col(c).cast("double") if c in barriers.columns else F.lit(None).cast("double"), F.lit(v)), F.lit(1 + 1e-15)).alias(c) for c, v in (("dfu", up), ("dfd", down))]
    n = cut(net.select("node", "down", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("fall", F.lit(0)).alias("fall")), "dofnet")
    b = barriers.select("node", *own, *carry).distinct().join(n.select("node", F.col("q").alias("qb"), "fall"), "node")
    b = cut(b, "barriers")
    still = b.where("qb <= 0").select("node", F.lit(100.0).alias("s"), *carry)
    live = b.where("qb > 0")
    below = n.select(F.col("node").alias("down"), F.col("q").alias("_q"))
    # lo, hi: discharges after node up to and with `to`; least, falls: from node up to but without `to`
    edges = n.join(below, "down").select("node", F.col("down").alias("to"), F.col("_q").alias("lo"), F.col("_q").alias("hi"), F.col("q").alias("least"), F.col("fall").alias("falls"))
    merge = {"lo": F.least, "hi": F.greatest, "least": F.least, "falls": F.greatest}
    state = ["qb", "factor", "climbs", *carry]
    at_barrier = lambda rows, factor, climbs: rows.select("node", F.col("qb").alias("q"), "qb", F.col(factor).alias("factor"), F.lit(climbs).alias("climbs"), *carry)
    reached = cut(at_barrier(live.where("fall = 0"), "dfu", True).unionByName(at_barrier(live, "dfd", False)).distinct(), "dof")
    of_node = n.select("node", "q")
    for jumps in doubled(edges.where("lo > 0 OR (least > 0 AND falls = 0)"), merge, "dof"):
        at = reached.select("node", *state)
        up_ = at.where("climbs").withColumnRenamed("node", "to").join(jumps, "to").where((F.col("falls") == 0) & (F.col("least") >= F.col("qb") / F.col("factor")) & (F.col("least") > 0)).select("node", *state)
        down_ = at.where(~F.col("climbs")).join(jumps, "node").where((F.col("hi") <= F.col("qb") * F.col("factor")) & (F.col("lo") > 0)).select(F.col("to").alias("node"), *state)
        moved = cut(up_.unionByName(down_).distinct().join(of_node, "node").select("node", "q", *state), "dof")
        if moved.isEmpty():  # what doesn't get 2^k reaches far gets no further
            break
        reached = reached.unionByName(moved)
    s = F.when(F.col("climbs"), score(F.col("q"), F.col("qb"), F.col("factor"), True)).otherwise(score(F.col("q"), F.col("qb"), F.col("factor"), False))
    return still.unionByName(reached.select("node", s.alias("s"), *carry))


def fragmentation(net: DataFrame, barriers: DataFrame, up: float = 5.0, down: float = 5.0, mode: int = 1) -> DataFrame:
    """(node, dof): degree of fragmentation of every reach of net (node, down, q, fall), 0 where no barrier reaches.

    barriers (node, and optionally dfu, dfd: own factors). From a barrier at discharge qb the effect goes upstream while
    q >= qb/up and no waterfall (fall = 1) is met, and downstream while q <= qb*down; factors are at least 1+1e-15. A
    reach has the maximum of its barriers. A barrier on a reach without discharge (0 or null) gives that reach 100 and
    isn't routed. Equal barriers on a reach are one; barriers on unknown reaches are ignored.
    """
    best = barrier_scores(net, barriers, up, down, mode).groupBy("node").agg(F.max("s").alias("dof"))
    return net.select("node").join(best, "node", "left").withColumn("dof", F.coalesce("dof", F.lit(0.0)))


def accumulate(net: DataFrame, amounts: DataFrame) -> DataFrame:
    """(node, total): of every reach that water of an amount passes, the sum of the amounts on it and upstream of it.

    What meets on a reach in one round is added up there, so a round has at most one row per reach.
    """
    n = cut(net.select("node", "down"), "net")
    total = cut(amounts.groupBy("node").agg(F.sum("amount").alias("total")).join(n.select("node"), "node", "left_semi"), "accumulated")
    for jumps in doubled(_edges(n), {}, "net"):
        arrived = jumps.join(total, "node").groupBy(F.col("to").alias("node")).agg(F.sum("total").alias("total"))
        total = cut(total.unionByName(arrived).groupBy("node").agg(F.sum("total").alias("total")), "accumulated")
    return total


def regulation(net: DataFrame, storage: DataFrame) -> DataFrame:
    """(node, dor) of every reach of net (node, down, q): storage (node, stor_mcm) upstream of it against its yearly discharge.

    In percent, at most 100, below 0.1 is 0; 0 without discharge or without storage upstream.
    """
    net = cut(net.select("node", "down", "q"), "net")
    total = accumulate(net, storage.select("node", F.coalesce("stor_mcm", F.lit(0.0)).alias("amount")))
    r = F.lit(100.0) * F.col("total") * F.lit(1e6) / (F.col("q") * F.lit(31_536_000.0))
    dor = F.when((F.col("q") > 0) & F.col("total").isNotNull(), F.when(r < 0.1, 0.0).otherwise(F.least(r, F.lit(100.0)))).otherwise(0.0)
    return net.select("node", F.coalesce("q", F.lit(0.0)).alias("q")).join(total, "node", "left").select("node", dor.alias("dor"))


def pass_ratio(volume: Column, q: Column) -> Column:
    """Share of the sediment that a water body of volume (MCM) at discharge q lets pass; 1 without discharge or volume."""
    tau = F.sqrt(volume * F.lit(1e6) / (q * F.lit(31.536e6)))
    return F.when(F.abs(q) < 1e-9, 1.0).otherwise(F.when(tau < 1e-8, 1.0).otherwise(F.lit(1.0) - F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(0.05) / tau)))


def trapping(net: DataFrame, dams: DataFrame, lakes: DataFrame) -> DataFrame:
    """(node, natural, anthropogenic, sed) of every reach of net (node, down, q, ero).

    dams (node, volume); lakes (node, volume, loss): volume of lakes on the network, loss of those off it. The load of a
    reach is its own (ero - loss) and that from upstream, times the pass ratio of its lakes, and for the anthropogenic
    load of its dams too. sed = 100 * (natural - anthropogenic) / natural; below 0.1 and without natural load 0.
    """
    d = dams.groupBy("node").agg(F.sum("volume").alias("dv"))
    k = lakes.groupBy("node").agg(F.sum("volume").alias("lv"), F.sum("loss").alias("loss"))
    n = net.select("node", "down", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("ero", F.lit(0.0)).alias("ero")).join(d, "node", "left").join(k, "node", "left").na.fill(0.0, ["dv", "lv", "loss"])
    t = n.withColumn("tl", pass_ratio(F.col("lv"), F.col("q"))).withColumn("td", pass_ratio(F.col("dv"), F.col("q")))
    t = cut(t.select("node", "down", (F.col("ero") - F.col("loss")).alias("own"), "tl", (F.col("tl") * F.col("td")).alias("ta")), "sednet")

    loads = ("natural", "anthropogenic")
    s = cut(t.select("node", (F.col("own") * F.col("tl")).alias("natural"), (F.col("own") * F.col("ta")).alias("anthropogenic")), "sed")
    # tl, ta of a jump: what the reaches after node, up to and with `to`, let pass
    edges = _edges(t).join(t.select(F.col("node").alias("to"), "tl", "ta"), "to")
    product = lambda a, b: a * b
    for jumps in doubled(edges, {"tl": product, "ta": product}, "sed"):
        arrived = jumps.join(s, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("natural") * F.col("tl")).alias("natural"), F.sum(F.col("anthropogenic") * F.col("ta")).alias("anthropogenic"))
        s = cut(s.unionByName(arrived).groupBy("node").agg(*[F.sum(c).alias(c) for c in loads]), "sed")
    share = F.lit(100.0) * (F.col("natural") - F.col("anthropogenic")) / F.col("natural")
    return s.withColumn("sed", F.when(F.col("natural") > 1e-9, F.when(share < 0.1, 0.0).otherwise(share)).otherwise(0.0))


def dissolve(net: DataFrame, same: list[str]) -> DataFrame:
    """(node, stretch): stretches of reaches that follow each other with equal columns `same`; the id is the most downstream node.

    Pointer jumping: each round a reach takes over the pointer of the reach it points to, so rounds are the logarithm of
    the longest stretch. Nulls in `same` equal each other.
    """
    keys = [F.col(f"d_{c}").eqNullSafe(F.col(c)) for c in same]
    below = net.select(F.col("node").alias("down"), *[F.col(c).alias(f"d_{c}") for c in same])
    together = F.col("d_known")
    for k in keys:
        together = together & k
    j = net.join(below.withColumn("d_known", F.lit(True)), "down", "left")
    first = p = cut(j.select("node", F.when(F.coalesce(together, F.lit(False)), F.col("down")).otherwise(F.col("node")).alias("stretch")), "stretch0")
    for k in range(p.count().bit_length() + 1):
        q = p.select(F.col("node").alias("stretch"), F.col("stretch").alias("next"))
        jumped = cut(p.join(q, "stretch").select("node", F.col("next").alias("new"), (F.col("next") != F.col("stretch")).alias("moved")), f"stretch{k + 1}")
        p = jumped.select("node", F.col("new").alias("stretch"))
        if jumped.where("moved").isEmpty():
            if not p.join(first.where("node = stretch").select("stretch"), "stretch", "left_anti").isEmpty():
                break
            return p
    raise ValueError("the network has a cycle")


def small_stretches(rows: DataFrame, threshold: float) -> DataFrame:
    """(bb_id, stretch) not free-flowing (ff = 0) whose volume is below threshold percent of the backbone's. rows: bb_id, stretch, ff, volume, bb_volume."""
    s = rows.where("ff = 0").groupBy("bb_id", "stretch").agg(F.sum("volume").alias("v"), F.max("bb_volume").alias("b"))
    return s.where(F.try_divide(F.col("v"), F.col("b")) * F.lit(100.0) < F.lit(threshold)).select("bb_id", "stretch")


def river_status(rows: DataFrame) -> DataFrame:
    """(bb_id, stretch, ff, pct_ff, status2, status1) per stretch. rows: bb_id, stretch, ff, length, bb_length.

    status2: 1 free-flowing (ff = 1 over at least 99.999 % of the backbone), 2 good status (ff = 1), 3 impacted, 0 if the
    share is unknown; status1 has 3 for 2.
    """
    s = rows.groupBy("bb_id", "stretch", "ff").agg(F.sum("length").alias("len"), F.max("bb_length").alias("bb"))
    s = s.withColumn("pct_ff", F.try_divide(F.col("len"), F.col("bb")) * F.lit(100.0))
    st = F.when(F.col("pct_ff").isNull(), 0).when((F.col("ff") == 1) & (F.col("pct_ff") >= 99.999), 1).when(F.col("ff") == 1, 2).otherwise(3)
    return s.select("bb_id", "stretch", "ff", "pct_ff", st.alias("status2")).withColumn("status1", F.when(F.col("status2") == 2, 3).otherwise(F.col("status2")))


def dense_ids(net: DataFrame, basin: str, order: list[str], key: str) -> DataFrame:
    """(key, basin, idx): 1, 2, … per basin in the given order; nulls last, ties by key; null basins are one group.

    Positions in the order of (basin, order, key) less the basin's first one: no basin is sorted by one task.
    """
    p = positions(net.select(key, basin, *order), [basin, *order, key])
    first = p.groupBy(F.col(basin).alias("_b")).agg(F.min("pos").alias("_first"))
    return p.join(first, F.col(basin).eqNullSafe(F.col("_b"))).select(key, basin, (F.col("pos") - F.col("_first") + 1).alias("idx"))
