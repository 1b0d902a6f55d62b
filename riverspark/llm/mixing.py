"""Mixing sources to target weights, by Pfair scheduling.

Sizes are tokens of a public tokenizer. Each source is a task whose weight is its share; its i-th block may start at
floor((i-1)/w) and is due at ceil(i/w). Earliest deadline first among the released blocks keeps every source less than
one block off its share at every position. The schedule repeats after CYCLE blocks (up to MAX_CYCLE for a source with too
small a share for one block of CYCLE), so it is computed once for a cycle, and documents find their position by arithmetic.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverspark.session import cut

CYCLE, BLOCK_TOKENS, MAX_SOURCES = 10_000, 1_024, 5_000
#: Blocks of the longest cycle; shares under one block of it can't be met.
MAX_CYCLE = 200_000
#: Documents of a source in one range of the order, about.
RANGE_DOCS = 4_096
#: Positions of the mixture that are summed in one range.
RANGE_POSITIONS = 65_536
_encodings: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer of a rank file (token in base64, rank), loaded once a process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, tokenizer: str, columns: list[str], text: str = "text") -> DataFrame:
    """columns and n_tokens of the whole text (0 for null and empty texts), without the text."""
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for b in batches:
            out = b[columns].copy()
            out["n_tokens"] = np.fromiter((len(encode(t)) if t else 0 for t in b["_text"]), np.int64, len(b))
            yield out

    return docs.select(*columns, F.col(text).alias("_text")).mapInPandas(count, f"{types}, n_tokens long")


def source_name(c: Column | str) -> Column:
    """One spelling for variants of case, blanks, hyphens and underscores; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s\-_]+", "_"), r"^_+|_+$", "")


@dataclass(frozen=True)
class Plan:
    """Blocks of each source in a cycle, its tokens in the mixture, and the size of a block."""

    blocks: dict[str, int]
    quota: dict[str, int]
    block_tokens: int
    cycle: int


def plan_mixture(available: dict[str, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None, block_tokens: int = BLOCK_TOKENS, cycle: int = CYCLE) -> Plan:
    """How much of each source goes into the mixture.

    Without total, the mixture is as large as it can be with all shares met; a source without tokens (or with a share or
    a repeat count of 0 or null) is left out and the others share its weight in proportion. With a larger total, sources
    that run out give all they may (tokens times repeats), and the rest is shared by the others. Where a source's share
    is less than a block of the cycle, the cycle grows to give it ten (at most to MAX_CYCLE), of fewer tokens if need be.
    """
    most = {s: available.get(s, 0) * max(0, repeats.get(s) or 0) for s in targets}
    live = {s: float(w) for s, w in targets.items() if w and w > 0 and most[s] > 0}
    if not live:
        return Plan({}, {}, block_tokens, 0)
    whole = sum(live.values())
    feasible = min(most[s] * whole / w for s, w in live.items())
    size = feasible if total is None else min(float(total), float(sum(most[s] for s in live)))
    share: dict[str, float] = {}
    rest, open_ = size, dict(live)
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if rest * w / weight >= most[s]] if total is not None else []
        if not full:
            share |= {s: rest * w / weight for s, w in open_.items()}
            break
        for s in full:
            share[s] = float(most[s])
            rest -= most[s]
            del open_[s]
    rounds = max(1, int(size // (block_tokens * cycle)))
    cycle = max(len(live), min(cycle, int(size // block_tokens)))
    least = min(share.values()) / size
    if least * cycle < 1:
        cycle = max(cycle, min(MAX_CYCLE, math.ceil(10 / least)))
        rounds = max(1, int(size // (block_tokens * cycle)))
    while True:
        # largest remainder, at least one block each
        exact = {s: share[s] / size * cycle for s in share}
        blocks = {s: max(1, int(x)) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s)):
            if sum(blocks.values()) < cycle:
                blocks[s] += 1
        whole = sum(blocks.values())
        each = min([size / (rounds * whole), *[most[s] / (rounds * b) for s, b in blocks.items()]])
        if each >= 1 or cycle <= len(live):
            break
        cycle = max(len(live), cycle // 2)
    # whole tokens; one block of one token each is always there
    tokens = max(1, int(each))
    return Plan(blocks, {s: tokens * rounds * b for s, b in blocks.items()}, tokens, whole)


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The source and its block number (from 0) at each position of a cycle, by earliest deadline first.

    Equal deadlines: the larger weight, then the name. Every source is less than one block off its share at any position.
    """
    cycle = sum(blocks.values())
    done = dict.fromkeys(blocks, 0)
    order = []
    for t in range(cycle):
        ready = [s for s, n in blocks.items() if done[s] < n and done[s] * cycle // n <= t]
        s = min(ready, key=lambda s: (-(-(done[s] + 1) * cycle // blocks[s]), -blocks[s], s))
        order.append((s, done[s]))
        done[s] += 1
    return order


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, block_tokens: int = BLOCK_TOKENS, cycle: int = CYCLE, seed: int = 7) -> DataFrame:
    """The mixture, one row per piece of a use of a document: position (of its block), start (token offset within its source's stream), source, doc_id, use_no, from_token (the piece's first token in the document), n_tokens.

    targets (source, target_share, max_repeats). A source's stream holds its documents in a hashed order, again and
    again; its first quota tokens are in the mixture, so a document is used at most max_repeats times and uses of it are
    a whole source apart. Documents are cut at the borders of blocks: every block is full, and in the order of position
    and start each source is less than one block off its share at every token. Spellings of a source count as one
    (source_name); documents of a null or untargeted source, and null or empty texts, aren't used. Rows with one doc_id
    are used as rows of their own. With empty tables, or no source with tokens, the result is empty.

    No source is handled by one task: the running size is taken in ranges of the hashed order, plus the ranges' offsets.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), source_name(source).alias("source"), F.col(text).alias("text"))
    sized = cut(token_counts(own.where(F.col("source").isNotNull() & F.col("text").isNotNull()), tokenizer, ["doc_id", "source"]).where("n_tokens > 0"), "tokens")
    wanted = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").distinct().limit(MAX_SOURCES + 1).collect()
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = spark.createDataFrame([(r["source"],) for r in wanted], "source string")
    have = {r["source"]: r for r in sized.join(F.broadcast(named.distinct()), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_mixture({s: r["t"] for s, r in have.items()}, {r["source"]: r["target_share"] or 0.0 for r in wanted}, {r["source"]: r["max_repeats"] or 0 for r in wanted}, total, block_tokens, cycle)
    quotas = spark.createDataFrame([(s, q, plan.blocks[s], int(have[s]["t"])) for s, q in plan.quota.items()], "source string, quota long, blocks int, stream long")
    slots = spark.createDataFrame([(s, k, p) for p, (s, k) in enumerate(pfair(plan.blocks))], "source string, k int, slot int")
    bits = int(np.clip(np.ceil(np.log2(max([2, *[r["n"] / RANGE_DOCS for r in have.values()]]))), 1, 30))
    hashed = sized.join(F.broadcast(quotas), "source").withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_range", F.shiftright("_h", 64 - bits))
    totals = hashed.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_t"))
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inner = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(offsets, ["source", "_range"])
    placed = placed.withColumn("first", F.col("_in") + F.col("_before"))
    uses = F.ceil((F.col("quota") - F.col("first")) / F.col("stream")).cast("int")
    used = placed.withColumn("_uses", uses).where("_uses > 0").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("_uses"))))
    used = used.withColumn("_first", F.col("first") + (F.col("use_no") - 1) * F.col("stream")).withColumn("_end", F.least(F.col("_first") + F.col("n_tokens"), F.col("quota")))
    size = F.lit(plan.block_tokens).cast("long")
    block = lambda token: F.floor(token / size).cast("long")
    used = used.withColumn("_b", F.explode(F.sequence(block(F.col("_first")), block(F.col("_end") - 1))))
    used = used.withColumn("start", F.greatest("_first", F.col("_b") * size)).withColumn("n_tokens", F.least("_end", (F.col("_b") + 1) * size) - F.col("start"))
    used = used.withColumn("k", F.pmod("_b", F.col("blocks")).cast("int")).withColumn("_round", F.floor(F.col("_b") / F.col("blocks")).cast("long"))
    # slots has cycle rows at most, whatever the input
    timed = used.join(F.broadcast(slots), ["source", "k"]).withColumn("position", F.col("_round") * F.lit(plan.cycle) + F.col("slot"))
    return timed.select("position", "start", "source", F.col("doc_id").alias(doc_id), "use_no", (F.col("start") - F.col("_first")).alias("from_token"), "n_tokens")


def deviations(mixture: DataFrame) -> DataFrame:
    """(source, max_deviation_blocks): how far a source gets off its actual share of the tokens before or after any position, in blocks (of the tokens of the fullest position).

    A source is furthest off just before or after a block of its own, so its own positions are enough. Sums run in ranges
    of positions, plus the ranges' offsets.
    """
    at = mixture.groupBy("position", "source").agg(F.sum("n_tokens").alias("_n")).withColumn("_range", F.floor(F.col("position") / F.lit(RANGE_POSITIONS)))
    sizes = at.groupBy("source", "_range").agg(F.sum("_n").alias("_t"), F.max("_n").alias("_most"))
    of_source = Window.partitionBy("source")
    offsets = sizes.select("source", "_range", (F.sum("_t").over(of_source.orderBy("_range")) - F.col("_t")).alias("_before"), F.sum("_t").over(of_source).alias("_all"))
    whole = sizes.agg(F.sum("_t").alias("_whole"), F.max("_most").alias("_block"))
    inner = Window.partitionBy("source", "_range").orderBy("position")
    r = at.withColumn("_in", F.sum("_n").over(inner)).join(offsets, ["source", "_range"]).crossJoin(F.broadcast(whole))
    share = F.col("_all") / F.col("_whole")
    after = F.col("_before") + F.col("_in") - share * (F.col("position") + 1) * F.col("_block")
    before = F.col("_before") + F.col("_in") - F.col("_n") - share * F.col("position") * F.col("_block")
    return r.groupBy("source").agg(F.max(F.greatest(F.abs(before), F.abs(after)) / F.col("_block")).alias("max_deviation_blocks"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: target_share, max_repeats, and n_docs, n_uses, most_uses, n_tokens, actual_share, max_deviation_blocks of the mixture (0 for a source not in it)."""
    written = cut(mixture, "mixture")
    by_doc = written.groupBy("source", "doc_id").agg(F.count_if(F.col("from_token") == 0).alias("u"), F.sum("n_tokens").alias("t"))
    got = by_doc.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("u").alias("n_uses"), F.max("u").alias("most_uses"), F.sum("t").alias("n_tokens"))
    t = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source IS NOT NULL").distinct()
    j = t.join(got, "source", "left").join(deviations(written), "source", "left").na.fill(0, ["n_docs", "n_uses", "most_uses", "n_tokens", "max_deviation_blocks"])
    whole = Window.partitionBy()  # as many rows as targets, which mix bounds
    return j.withColumn("actual_share", F.coalesce(F.round(F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(whole)), 6), F.lit(0.0))).withColumn("max_deviation_blocks", F.round("max_deviation_blocks", 4))
