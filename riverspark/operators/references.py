"""References to records that do not exist: direct orphans, and the cascade of inherited ones."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverspark.operators.skew import salted_join
from riverspark.session import cut

#: Stands for a null period in joins.
NO_PERIOD = -(2**62)


@dataclass(frozen=True)
class ForeignKey:
    """child.ref -> parent.own: names of tables of orphan_cascade and of their columns."""

    child: str
    ref: str
    parent: str
    own: str


def _period() -> Column:
    return F.coalesce(F.col("period").cast("long"), F.lit(NO_PERIOD)).alias("_p")


def _holds(low: str, high: str) -> Column:
    """A validity range holds the period; null bounds are open, and any range holds a null period."""
    p = F.col("_p")
    return (p == NO_PERIOD) | ((F.col(low).isNull() | (F.col(low) <= p)) & (F.col(high).isNull() | (F.col(high) >= p)))


def missing_parents(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Of distinct (ref, _p) pairs, those without a row of parents (own, valid_from, valid_to) that holds them."""
    p = parents.where("own IS NOT NULL").select("own", "valid_from", "valid_to").distinct()
    return pairs.join(p, (F.col("ref") == F.col("own")) & _holds("valid_from", "valid_to"), "left_anti")


def orphan_cascade(tables: Mapping[str, DataFrame], keys: list[ForeignKey], max_rounds: int = 1_000) -> DataFrame:
    """(src_table, period, rec_id, ref, level, kind): level 0 are direct orphans, level k inherit from an orphan of level k-1.

    Every table has rec_id (its record), period, valid_from, valid_to (null: open) and the columns that keys name. A
    reference holds if a parent row has that own key and is valid in the child's period. Round 0 anti-joins each foreign
    key to its parent: over distinct (ref, period) pairs, combined before the shuffle, so a parent to which a third of
    all rows refer is one pair a period. Each further round semi-joins the children of the records that became orphans
    before, and the fixpoint is reached when none is new; without a key whose parent is itself a child, that is round 0.
    Children that nothing refers to take no part in the rounds; they inherit in one join at the end. A child inherits
    only if every valid parent row of its reference is an orphan in that period; its level is that of the last of them,
    plus one.

    Where every record has one parent row, the links from child to parent are doubled each round, so that round k reaches
    the descendants less than 2^k levels down: rounds are the logarithm of the depth. Otherwise a round is one level, and
    more than max_rounds levels are an error.

    A null ref is no reference. Equal rows give one result row. Self references and cycles end, as a record becomes an
    orphan once per period. Empty tables give no rows. Columns that aren't named above are ignored. What is used again
    in every round is written to the shared folder once, as are the rounds.
    """
    if not keys:
        raise ValueError("no foreign key")
    parents, children = {k.parent for k in keys}, {k.child for k in keys}
    if both := parents & children:  # read many times: written once, with what is needed of them
        used = {t: sorted({k.ref for k in keys if k.child == t} | {k.own for k in keys if k.parent == t}) for t in both}
        tables = {t: cut(df.select("rec_id", "period", "valid_from", "valid_to", *[c for c in used[t] if c not in ("rec_id", "period", "valid_from", "valid_to")]), "table") if t in both else df for t, df in tables.items()}

    def refs(k: ForeignKey) -> DataFrame:
        return tables[k.child].where(F.col(k.ref).isNotNull()).select("period", _period(), "rec_id", F.col(k.ref).alias("ref"))

    def owners(k: ForeignKey) -> DataFrame:
        return tables[k.parent].where(F.col(k.own).isNotNull()).select("rec_id", F.col(k.own).alias("ref"), "valid_from", "valid_to").distinct()

    def shaped(rows: DataFrame, k: ForeignKey, level) -> DataFrame:
        return rows.select(F.lit(k.child).alias("src_table"), "period", "_p", "rec_id", "ref", level.cast("int").alias("level"))

    found = None
    for k in keys:
        pairs = refs(k).select("ref", "_p").distinct()
        gone = missing_parents(pairs, tables[k.parent].select(F.col(k.own).alias("own"), "valid_from", "valid_to"))
        direct = shaped(salted_join(refs(k), gone, ["ref", "_p"], "left_semi"), k, F.lit(0)).distinct()
        found = direct if found is None else found.unionByName(direct)
    if not parents & children:  # no orphan has children: round 0 is the fixpoint
        return _finished(found)
    found = cut(found, "orphans0")
    inner, leaves = [k for k in keys if k.child in parents], [k for k in keys if k.child not in parents and k.parent in children]
    first = cut(found.where(F.col("src_table").isin(list(parents))).select("src_table", "rec_id", "_p", "level").distinct(), "orphan-records0")
    names = sorted(tables)
    links = _links([(k, refs(k), owners(k)) for k in inner], names)
    if links is not None:
        coded = _doubled_records(links, first.select(_code(names, F.col("src_table")).alias("_t"), "rec_id", "_p", "level"))
        lost = coded.select(F.col("_t").alias("_table"), F.col("rec_id").alias("_parent"), "_p", F.col("level").alias("_l"))
        found = found.unionByName(links.join(lost, ["_table", "_parent", "_p"]).select(_name(names, F.col("_t")).alias("src_table"), "period", "_p", "rec_id", "ref", (F.col("_l") + 1).alias("level")))
        seen = coded.select(_name(names, F.col("_t")).alias("src_table"), "rec_id", "_p", "level")
    else:
        edges = [(k, cut(refs(k).distinct(), "refs"), cut(owners(k), "owners")) for k in inner]
        more, seen = _records_by_level(edges, first, shaped, max_rounds)
        # a reference that was reached in several rounds keeps its lowest level
        found = found.unionByName(more).groupBy("src_table", "period", "_p", "rec_id", "ref").agg(F.min("level").alias("level"))
    for k in leaves:
        bad = seen.where(F.col("src_table") == k.parent).select("rec_id", "_p", "level")
        own = owners(k)
        lost = own.join(bad, "rec_id").where(_holds("valid_from", "valid_to")).groupBy("ref", "_p").agg(F.max("level").alias("_l"), F.countDistinct("rec_id").alias("_n"))
        holders = own.join(lost.select("ref", "_p"), "ref").where(_holds("valid_from", "valid_to")).groupBy("ref", "_p").agg(F.countDistinct("rec_id").alias("_all"))
        dead = lost.join(holders, ["ref", "_p"]).where("_n = _all").select("ref", "_p", "_l")
        found = found.unionByName(shaped(salted_join(refs(k), dead, ["ref", "_p"], "inner"), k, F.col("_l") + 1).distinct())
    return _finished(found)


def _code(names: list[str], table: Column) -> Column:
    """The number of a table's name: whole numbers join faster."""
    return (F.array_position(F.array(*[F.lit(n) for n in names]), table) - 1).cast("int")


def _name(names: list[str], code: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), code)


def _links(edges: list[tuple[ForeignKey, DataFrame, DataFrame]], names: list[str]) -> DataFrame | None:
    """Each reference that holds, with its one parent record; None if a reference holds several, or a record has several references."""
    links = None
    for k, ref, own in edges:
        holder = own.select(F.col("ref").alias("_own"), F.col("rec_id").alias("_parent"), "valid_from", "valid_to")
        held = ref.join(holder, F.col("ref") == F.col("_own")).where(_holds("valid_from", "valid_to"))
        one = held.select(F.lit(names.index(k.child)).alias("_t"), "period", "_p", "rec_id", "ref", F.lit(names.index(k.parent)).alias("_table"), "_parent").distinct()
        links = one if links is None else links.unionByName(one)
    links = cut(links, "links")
    several = links.groupBy("_t", "rec_id", "_p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return links if several.isEmpty() else None


def _doubled_records(links: DataFrame, first: DataFrame) -> DataFrame:
    """Orphaned records (_t, rec_id, _p, level): those of first and all that descend from them.

    A record leaves the links once it is an orphan: what descends from it is found through it.
    """
    record, above = ["_t", "rec_id", "_p"], ["_table", "_parent", "_p"]
    seen, length = first, 1
    jumps = links.select("_t", "rec_id", *above).join(first.select(record), record, "left_anti")
    end = lambda df, level, t, r: df.select(F.col("_t").alias("_table"), F.col("rec_id").alias("_parent"), "_p", level.cast("int").alias("level"), t.cast("int").alias("_t2"), r.cast(kind).alias("_r2"))
    none, kind = F.lit(None), links.schema["_parent"].dataType
    while True:
        # where a link ends: at an orphan, or at a record with a link of its own, which lengthens it; else the chain is sound
        ends = end(seen, F.col("level"), none, none).unionByName(end(jumps, none, F.col("_table"), F.col("_parent")))
        met = cut(jumps.join(ends, above).select(*record, "level", F.col("_t2").alias("_table"), F.col("_r2").alias("_parent")), "links")
        new = met.where("level IS NOT NULL").select(*record, (F.col("level") + length).cast("int").alias("level"))
        if new.isEmpty():  # a record further away would have an ancestor at this distance
            return seen
        seen, length = seen.unionByName(new), length * 2
        jumps = met.where("level IS NULL").select(*record, "_table", "_parent")


def _records_by_level(edges: list[tuple[ForeignKey, DataFrame, DataFrame]], first: DataFrame, shaped, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Inherited references, and all orphaned records, a level a round."""
    found = None
    seen = frontier = first
    level = 0
    while not frontier.isEmpty():
        level += 1
        if level > max_rounds:
            raise ValueError(f"references are more than {max_rounds} levels deep")
        new = None
        for k, ref, own in edges:
            # a key of several rows is lost when the last of them is
            fresh = frontier.where(F.col("src_table") == k.parent).select("rec_id", "_p")
            dead = own.join(fresh, "rec_id").where(_holds("valid_from", "valid_to")).select("ref", "_p").distinct()
            bad = seen.where(F.col("src_table") == k.parent).select("rec_id", "_p")
            holders = own.join(dead, "ref").where(_holds("valid_from", "valid_to")).select("rec_id", "ref", "_p")
            dead = dead.join(holders.join(bad, ["rec_id", "_p"], "left_anti").select("ref", "_p").distinct(), ["ref", "_p"], "left_anti")
            one = shaped(ref.join(dead, ["ref", "_p"], "left_semi"), k, F.lit(level))
            new = one if new is None else new.unionByName(one)
        rows = cut(new, f"orphans{level}")
        found = rows if found is None else found.unionByName(rows)
        known = seen.select("src_table", "rec_id", "_p")
        frontier = cut(rows.select("src_table", "rec_id", "_p", "level").distinct().join(known, ["src_table", "rec_id", "_p"], "left_anti"), f"orphan-records{level}")
        seen = seen.unionByName(frontier)
    if found is None:
        k, ref, _ = edges[0]
        found = shaped(ref.limit(0), k, F.lit(0))
    return found, seen


def _finished(found: DataFrame) -> DataFrame:
    return found.drop("_p").withColumn("kind", F.when(F.col("level") == 0, "direct").otherwise("inherited"))
