"""What changed between full snapshots: content-defined chunks of key-sorted snapshots.

Every snapshot is sorted by key inside ranges of the key and cut into chunks where a hash of the key says so. The cut
doesn't depend on positions, so a record that is added or removed disturbs one chunk only. A chunk becomes one row: its
digest, and its records packed beside it. Digests of consecutive snapshots are compared chunk by chunk; only chunks
without a match are unpacked, joined by key and classified. All snapshots of a range lie in one partition, so after the
records have been placed by range nothing is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean rows of a chunk, and keys of one range (a range always starts a chunk, which bounds what one chunk can pack).
CHUNK_ROWS, RANGE_KEYS = 8, 4096


def tolerant_equal(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(tolerance), a.isNull() & b.isNull())


def chunked(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, range_keys: int = RANGE_KEYS, tolerance: float = 1e-6) -> DataFrame:
    """rows (snap, key, val), key unique in its snap, as one row a chunk: range, snap, chunk (its first cut key), digest (size and two hashes), records (key, val)."""
    # |a-b| > tolerance puts a and b in different cells, so equal digests never hide a change
    cell = F.coalesce(F.round(F.col("val") / F.lit(tolerance)).cast("string"), F.lit("-"))
    r = rows.withColumn("_range", F.floor(F.col("key") / F.lit(range_keys))).repartition("_range")
    in_range = Window.partitionBy("_range", "snap").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    cut_here = F.pmod(F.xxhash64(F.col("key"), F.lit(11)), F.lit(chunk_rows)) == 0
    r = r.withColumn("_chunk", F.coalesce(F.last(F.when(cut_here, F.col("key")), ignorenulls=True).over(in_range), F.lit(-(2**63))))
    # the sum of numbers below 2^31 stays exact and doesn't overflow
    low = F.sum(F.pmod(F.xxhash64(F.col("key"), cell), F.lit(2**31 - 1)))
    digest = F.struct(F.count(F.lit(1)).alias("n"), low.alias("a"), F.bit_xor(F.xxhash64(cell, F.col("key"), F.lit(7))).alias("b"))
    return r.groupBy("_range", "snap", "_chunk").agg(digest.alias("digest"), F.collect_list(F.struct("key", "val")).alias("records"))


def _held(rows: DataFrame, snap: str, key: str, value: Column, order: str | None, snapshots: list | None) -> tuple[DataFrame, list]:
    """One row (snap, key, val) per record of the snapshots, and the snapshots in their order."""
    slim = rows.select(F.col(snap).alias("snap"), F.col(key).cast("long").alias("key"), value.cast("double").alias("val"), (F.col(order) if order else F.lit(0)).alias("_o")).where("snap IS NOT NULL AND key IS NOT NULL")
    if snapshots is None:
        snapshots = sorted(r[0] for r in slim.select("snap").distinct().collect())
    # combined on the map side, so a record delivered very often is no hot spot
    held = slim.groupBy("snap", "key").agg(F.max(F.struct("_o", F.col("val"))).alias("_m")).select("snap", "key", F.col("_m.val").alias("val"))
    return held.where(F.col("snap").isin(snapshots)), snapshots


def _sides(chunks: DataFrame, snapshots: list) -> DataFrame:
    """The chunks of a range and cut key as (pair, side, digest, records, open): side 1 in snapshot `pair`, side 0 in the one before; open without an equal digest."""
    kind = chunks.schema["snap"].dataType
    by_cut = chunks.groupBy("_range", "_chunk").agg(F.collect_list(F.struct("snap", "digest", "records")).alias("all"))
    pairs = []

    def of(snapshot: object) -> Column:
        return F.get(F.filter("all", lambda c: c["snap"] == F.lit(snapshot).cast(kind)), F.lit(0))

    for a, b in zip(snapshots, snapshots[1:]):
        old, new = of(a), of(b)
        is_open = ~old["digest"].eqNullSafe(new["digest"])
        pairs += [F.when(c.isNotNull(), F.struct(F.lit(b).cast(kind).alias("pair"), F.lit(side).alias("side"), c["digest"]["n"].alias("n"), is_open.alias("open"), F.when(is_open, c["records"]).alias("records"))) for side, c in ((0, old), (1, new))]
    return by_cut.select("_range", F.inline(F.array_compact(F.array(*pairs))))


def snapshot_changes(rows: DataFrame, snap: str, key: str, value: Column, order: str | None = None, snapshots: list | None = None, tolerance: float = 1e-6, chunk_rows: int = CHUNK_ROWS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(snap, key, change_kind) of consecutive snapshots, with snap the later one and change_kind added, removed or changed.

    rows: full snapshots; value: the compared value, null where there is none (null against null is no change, null against
    a value is one). Of several rows with one (snap, key) those with the largest `order` hold; without order, or on a
    tie, the largest value holds. Rows with a null snap or key are no records and are ignored; integer keys are needed.
    snapshots: the snapshots in their order; None takes the distinct ones (their number is the number of deliveries).
    The first snapshot has no changes; an empty table, or one snapshot, gives an empty result. Other columns are ignored.
    """
    held, snapshots = _held(rows, snap, key, value, order, snapshots)
    if len(snapshots) < 2:
        return held.select(F.col("snap").alias(snap), F.col("key").alias(key), F.lit("").alias("change_kind")).limit(0)
    sides = _sides(chunked(held, chunk_rows, range_keys, tolerance), snapshots)
    open_rows = sides.where("open").select("_range", "pair", "side", F.inline("records"))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("val")))
    both = open_rows.groupBy("_range", "pair", "key").agg(of(0).alias("old"), of(1).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~tolerant_equal(F.col("old.val"), F.col("new.val"), tolerance), "changed")
    return both.withColumn("change_kind", kind).where("change_kind IS NOT NULL").select(F.col("pair").alias(snap), F.col("key").alias(key), "change_kind")


def chunk_report(rows: DataFrame, snap: str, key: str, value: Column, order: str | None = None, snapshots: list | None = None, tolerance: float = 1e-6, chunk_rows: int = CHUNK_ROWS, range_keys: int = RANGE_KEYS) -> DataFrame:
    """(snap, n_chunks, n_open_chunks, n_rows, n_open_rows): how much of each later snapshot the digests leave to be joined. Arguments as of snapshot_changes."""
    held, snapshots = _held(rows, snap, key, value, order, snapshots)
    if len(snapshots) < 2:
        return held.groupBy(F.col("snap").alias(snap)).agg(*[F.lit(0).cast("long").alias(c) for c in ("n_chunks", "n_open_chunks", "n_rows", "n_open_rows")]).limit(0)
    later = _sides(chunked(held, chunk_rows, range_keys, tolerance), snapshots).where("side = 1")
    return later.groupBy(F.col("pair").alias(snap)).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("open").alias("n_open_chunks"), F.sum("n").alias("n_rows"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("n_open_rows"))
