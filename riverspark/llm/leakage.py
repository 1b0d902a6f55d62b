"""Evaluation texts inside training texts: size-partitioned MinHash containment search.

Test items (short) are searched in documents (long). The Jaccard similarity of a short item with a long document is near 0
even if it is contained whole; what is bounded from below is the containment of a window of the item: a window that a
case covers shares at least `common` of its shingles with the document. So items are cut into windows by size class, a
window's signature is its minima under `minima` hash functions, and the minima are looked up in the shingles of the
documents: the share that is found estimates the containment. Pairs with `need` different minima in place are verified by
exact shingle containment around them, and then word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.text import WordIds, pieces, shingles, word_ids
from riverspark.operators.skew import salted_join
from riverspark.session import cut

#: Fixed values from the definition of a case.
EXACT_WORDS, LOOSE_WORDS, LOOSE_SHARE = 16, 25, 6
#: Words of a run that several items share from which on it is shared wording, no part of an item.
SHARED_WORDS = EXACT_WORDS
#: Words of a shingle. One edit in six words leaves 1 of the 21 shingles of five words in a window of 25 words, but 6 of the 22 of four.
SHINGLE = 4
#: Most words and edits of a stretch that has no half which is a case itself, and words around a hit that are looked at.
LONGEST = 2 * LOOSE_WORDS - 1
SHIFT = LONGEST // LOOSE_SHARE
BUCKET = 8
REACH = LONGEST + SHIFT + BUCKET
#: Words of all items up to which their sketch is broadcast (about 24 bytes a word); beyond, hits are joined to the sketch.
BROADCAST_WORDS = 8_000_000
RECALL = 0.99


@dataclass(frozen=True)
class SizeClass:
    """Pieces of `least` words and more: windows of `window` words, of whose shingles a case shares `common` at least."""

    least: int
    window: int
    common: int
    need: int

    def minima(self, recall: float = RECALL) -> int:
        """Hash functions with which some minimum of a window that holds a case is found, at this probability."""
        share = self.common / (self.window - SHINGLE + 1)
        return 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - share))


def common_shingles(words: int, edits: int) -> int:
    """Shingles of a stretch that so many edits leave at least: an edit touches SHINGLE of them."""
    return words - SHINGLE + 1 - edits * SHINGLE


#: In pieces below LOOSE_WORDS only whole runs of EXACT_WORDS count; a window of one is contained whole.
CLASSES = (SizeClass(EXACT_WORDS, EXACT_WORDS, common_shingles(EXACT_WORDS, 0), 1), SizeClass(LOOSE_WORDS, LOOSE_WORDS, common_shingles(LOOSE_WORDS, LOOSE_WORDS // LOOSE_SHARE), 2))


def _class(words: int) -> SizeClass:
    return max((c for c in CLASSES if c.least <= words), key=lambda c: c.least)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64((0xD6E8FEB86659FD93 * (k + 1)) % 2**64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(31))


def signature(words: np.ndarray, exact: bool = False) -> np.ndarray:
    """Places of the shingles that are a minimum of some window of a piece; all places if exact."""
    h = shingles(words, SHINGLE)
    c = _class(len(words))
    if exact:
        return np.arange(len(h))
    w = c.window - SHINGLE + 1
    keep = np.zeros(len(h), bool)
    for k in range(c.minima()):
        keep[np.lib.stride_tricks.sliding_window_view(_mixed(h, k), w).argmin(axis=1) + np.arange(len(h) - w + 1)] = True
    return np.flatnonzero(keep)


def item_pieces(items: DataFrame, item_id: str, parts: tuple[str, ...]) -> DataFrame:
    """(piece, item_id, words): the items' runs of at least EXACT_WORDS words, without wording that several items share."""
    slim = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.explode(F.array_distinct(F.array(*[F.col(p).cast("string") for p in parts]))).alias("text")).where("text <> ''").distinct()

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for b in batches:
            words = word_ids(list(b["text"]), ids)
            ends = np.flatnonzero(words == 0)
            yield pd.DataFrame({"item_id": b["item_id"].to_numpy(), "words": [x[x != 0].view(np.int64) for x in np.split(words, ends[:-1] + 1)]})

    texts = cut(slim.mapInPandas(tokenise, "item_id long, words array<long>").where(F.size("words") >= EXACT_WORDS).withColumn("text", F.monotonically_increasing_id()), "items")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, i, w in zip(b["text"], b["item_id"], b["words"]):
                h = shingles(np.asarray(w, np.int64).view(np.uint64), SHARED_WORDS).view(np.int64)
                yield pd.DataFrame({"text": t, "item_id": i, "at": np.arange(len(h)), "h": h})

    each = texts.mapInPandas(runs, "text long, item_id long, at int, h long")
    shared = each.groupBy("h").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a <> b").select("h")
    gaps = each.join(shared, "h", "left_semi").groupBy("text").agg(F.collect_list("at").alias("gaps"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, w, g in zip(b["item_id"], b["words"], b["gaps"]):
                own = np.ones(len(w) + 2, np.int8)
                own[0] = own[-1] = 0
                if g is not None:
                    for a in g:
                        own[1 + a : 1 + a + SHARED_WORDS] = 0
                turn = np.flatnonzero(np.diff(own))
                out += [(i, np.asarray(w)[a:e]) for a, e in zip(turn[::2], turn[1::2]) if e - a >= EXACT_WORDS]
            yield pd.DataFrame(out, columns=["item_id", "words"])

    own = texts.join(gaps, "text", "left").select("item_id", "words", "gaps").mapInPandas(split, "item_id long, words array<long>")
    return cut(own.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def sketches(parts: DataFrame, exact: bool = False) -> DataFrame:
    """(key, piece, at, need): the signatures of all windows of the pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, w in zip(b["piece"], b["words"]):
                w = np.asarray(w, np.int64).view(np.uint64)
                at = signature(w, exact)
                yield pd.DataFrame({"key": shingles(w, SHINGLE)[at].view(np.int64), "piece": p, "at": at.astype(np.int32), "need": _class(len(w)).need})

    return parts.select("piece", "words").mapInPandas(run, "key long, piece long, at int, need int")


@dataclass
class Sketch:
    """Pieces as one run of words (0 between pieces), their items and needs by place, and the sorted keys with their places."""

    words: np.ndarray
    item: np.ndarray
    number: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    need: np.ndarray
    bits: np.ndarray


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys >> np.uint64(7)) & np.uint64(size - 1)


def _packed(parts: pd.DataFrame, keys: pd.DataFrame) -> Sketch:
    pad = np.zeros(REACH + SHIFT + EXACT_WORDS + 2, np.uint64)
    order = {p: k for k, p in enumerate(parts["piece"])}
    words = [np.asarray(w, np.int64).view(np.uint64) for w in parts["words"]]
    start = len(pad) + np.cumsum([0] + [len(w) + 1 for w in words])
    flat = np.concatenate([pad, *[x for w in words for x in (w, pad[:1])], pad])
    number = np.searchsorted(start, np.arange(len(flat)), "right") - 1
    item = parts["item_id"].to_numpy(np.int64)[np.clip(number, 0, max(len(parts) - 1, 0))] if len(parts) else np.zeros(len(flat), np.int64)
    k = keys["key"].to_numpy(np.int64).view(np.uint64)
    o = np.argsort(k, kind="stable")
    at = start[keys["piece"].map(order).to_numpy(np.int64)] + keys["at"].to_numpy(np.int64) if len(keys) else np.zeros(0, np.int64)
    bits = np.zeros(1 << max(16, math.ceil(math.log2(max(1, len(k)) * 16))), bool)
    bits[_slots(k, len(bits))] = True
    return Sketch(flat, item, number, k[o], at[o], keys["need"].to_numpy(np.int64)[o], bits)


def _loose(doc: np.ndarray, piece: np.ndarray) -> bool:
    """A stretch of at least LOOSE_WORDS words of piece occurs in doc with at most one edit in LOOSE_SHARE words.

    A stretch of twice that length has a half that meets the bound as well, so lengths below that suffice.
    """
    n, m = len(piece), len(doc)
    if n < LOOSE_WORDS:
        return False
    starts = np.arange(n - LOOSE_WORDS + 1)
    ramp = np.arange(m + 1)
    d = np.zeros((len(starts), m + 1), np.int32)  # edits of piece[start:start+k] against the best run of doc that ends at j
    for k in range(1, 2 * LOOSE_WORDS):
        live = starts + k <= n
        if not live.any():
            return False
        starts, d = starts[live], d[live]
        other = (doc[None, :] != piece[starts + k - 1][:, None]).astype(np.int32)
        new = d + 1
        new[:, 1:] = np.minimum(new[:, 1:], d[:, :-1] + other)
        d = np.minimum.accumulate(new - ramp, axis=1) + ramp
        best = d.min(axis=1)
        if k >= LOOSE_WORDS and (best * LOOSE_SHARE <= k).any():
            return True
        good = best * LOOSE_SHARE <= 2 * LOOSE_WORDS
        starts, d = starts[good], d[good]
        if not len(starts):
            return False
    return False


def candidates(group: np.ndarray, p: np.ndarray, q: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Of hits (place p of a document, place q of a piece; group: document and piece) those to verify.

    Hits whose diagonals p-q differ by SHIFT at most, from one to the next, belong together; a case has `need` different
    ones. Of those, one in BUCKET places of a diagonal is verified: REACH covers what lies around the others.
    """
    diagonal = p - q
    o = np.lexsort((p, diagonal, group))
    g, d, a = group[o], diagonal[o], p[o]
    cluster = np.cumsum(np.r_[True, (g[1:] != g[:-1]) | (d[1:] - d[:-1] > SHIFT)]) - 1
    fresh = np.r_[True, (cluster[1:] != cluster[:-1]) | (d[1:] != d[:-1]) | (a[1:] // BUCKET != a[:-1] // BUCKET)]
    return o[fresh & (np.bincount(cluster)[cluster] >= need[o])]


def verified(doc: np.ndarray, piece: np.ndarray, p: np.ndarray, q: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Of hits (shingle at doc[p] = shingle at piece[q]): whether a case lies around it; of one pair, one case is enough. doc and piece hold 0 between texts and are padded."""
    back = np.arange(-1, -EXACT_WORDS - 1, -1)
    ahead = np.arange(SHINGLE, SHINGLE + EXACT_WORDS)
    same = lambda o: (doc[p[:, None] + o] == piece[q[:, None] + o]) & (piece[q[:, None] + o] != 0)
    run = SHINGLE + np.cumprod(same(back), axis=1).sum(axis=1) + np.cumprod(same(ahead), axis=1).sum(axis=1)
    ok = run >= EXACT_WORDS
    found = set(pair[ok].tolist())
    rest = np.flatnonzero(~np.isin(pair, pair[ok]))
    # exact shingle containment: the document's shingles that the piece has, at most SHIFT places off the hit's diagonal
    span = LONGEST + SHIFT
    o = np.arange(-REACH, REACH)
    for k in range(0, len(rest), 2048):
        r = rest[k : k + 2048]
        d = doc[p[r][:, None] + o]
        whole = np.zeros((len(r), len(o) - SHINGLE + 1), bool)
        for shift in range(-SHIFT, SHIFT + 1):
            e = (d == piece[q[r][:, None] + o + shift]) & (d != 0)
            whole |= np.logical_and.reduce([e[:, j : j + whole.shape[1]] for j in range(SHINGLE)])
        total = np.cumsum(np.c_[np.zeros(len(r), int), whole], axis=1)
        most = (total[:, span:] - total[:, :-span]).max(axis=1)
        for i in r[most >= CLASSES[-1].common]:
            if int(pair[i]) in found:
                continue
            lo, hi = _within(doc, int(p[i])), _within(piece, int(q[i]))
            if _loose(doc[lo[0] : lo[1]], piece[hi[0] : hi[1]]):
                ok[i] = True
                found.add(int(pair[i]))
    return ok


def _within(words: np.ndarray, at: int) -> tuple[int, int]:
    """The range of at most REACH words to either side that doesn't cross a 0."""
    a, b = max(0, at - REACH), min(len(words), at + REACH + SHINGLE)
    z = np.flatnonzero(words[a:b] == 0) + a
    before, after = z[z < at], z[z >= at]
    return (int(before[-1]) + 1 if len(before) else a), (int(after[0]) if len(after) else b)


def search(texts: list[str | None], s: Sketch, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(index of text, item_id) of the cases in texts."""
    out_doc, out_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    pad = np.zeros(REACH + SHIFT + EXACT_WORDS + 2, np.uint64)
    for a, b in pieces(texts) if len(s.keys) else ():
        words = word_ids(texts[a:b], ids)
        h = shingles(words, SHINGLE)
        place = np.flatnonzero(s.bits[_slots(h, len(s.bits))] & (h != 0))
        lo, hi = np.searchsorted(s.keys, h[place], "left"), np.searchsorted(s.keys, h[place], "right")
        n = hi - lo
        which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        p, q = np.repeat(place, n), s.at[which]
        if not len(p):
            continue
        doc_of = np.cumsum(words == 0)
        group = doc_of[p] * (s.number[-1] + 2) + s.number[q]
        few = candidates(group, p, q, s.need[which])
        p, q = p[few], q[few]
        ok = verified(np.r_[pad, words, pad], s.words, p + len(pad), q, group[few])
        out_doc.append(doc_of[p[ok]] + a)
        out_item.append(s.item[q[ok]])
    return np.concatenate(out_doc), np.concatenate(out_item)


def _broadcast_search(own: DataFrame, parts: DataFrame, keys: DataFrame) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(_packed(parts.toPandas(), keys.toPandas()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for b in batches:
            d, i = search(list(b["text"]), sent.value, ids)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(np.int64)[d], "item_id": i}).drop_duplicates()

    return own.mapInPandas(run, "doc_id long, item_id long")


#: Slots of the filter of keys (32 MB), whatever the number of keys.
FILTER_BITS = 1 << 28


def _joined_search(own: DataFrame, parts: DataFrame, keys: DataFrame) -> DataFrame:
    """The same search with a sketch of any size: one pass makes hits, which are joined to the sketch by key; a second takes the documents with enough of them."""
    keys = cut(keys, "sketch")
    slot = F.shiftrightunsigned("key", 7).bitwiseAND(F.lit(FILTER_BITS - 1))
    chunks = keys.groupBy(F.shiftright(slot, 15).alias("chunk")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for c in chunks:
        bits[c["chunk"] * 4096 : c["chunk"] * 4096 + len(c["bits"])] = np.frombuffer(c["bits"], np.uint8)
    sent = own.sparkSession.sparkContext.broadcast(bits)
    named = own.withColumn("hash", F.xxhash64("text"))  # documents that share an id stay apart

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, known = WordIds(), sent.value
        for b in batches:
            texts = list(b["text"])
            for i, j in pieces(texts):
                words = word_ids(texts[i:j], ids)
                h = shingles(words, SHINGLE)
                s = _slots(h, FILTER_BITS).astype(np.int64)
                at = np.flatnonzero((known[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool) & (h != 0))
                row = np.cumsum(words == 0)
                start = np.r_[0, np.flatnonzero(words == 0) + 1]
                r = row[at]
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r + i], "hash": b["hash"].to_numpy()[r + i], "p": at - start[r], "key": h[at].view(np.int64)})

    found = named.mapInPandas(hits, "doc_id long, hash long, p long, key long").distinct()
    pairs = salted_join(found, keys, ["key"]).groupBy("doc_id", "hash", "piece").agg(F.collect_list(F.struct("p", "at")).alias("hits"), F.max("need").alias("need"))
    pairs = cut(pairs.where(F.size("hits") >= F.col("need")), "pairs")

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for b in batches:
            texts = list(b["text"])
            for i, j in pieces(texts):
                words = word_ids(texts[i:j], ids)
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i:j], "hash": b["hash"].to_numpy()[i:j], "doc": [x[x != 0].view(np.int64) for x in np.split(words, np.flatnonzero(words == 0)[:-1] + 1)]})

    chosen = named.join(pairs.select("doc_id", "hash").distinct(), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    docs = chosen.mapInPandas(tokenise, "doc_id long, hash long, doc array<long>")
    whole = pairs.join(parts.withColumnRenamed("words", "piece_words"), "piece").join(docs, ["doc_id", "hash"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pad = np.zeros(REACH + SHIFT + EXACT_WORDS + 2, np.uint64)
        padded = lambda w: np.r_[pad, np.asarray(w, np.int64).view(np.uint64), pad]
        for b in batches:
            good = []
            for d, w, h, n in zip(b["doc"], b["piece_words"], b["hits"], b["need"]):
                p, q = np.array([x["p"] for x in h], np.int64), np.array([x["at"] for x in h], np.int64)
                few = candidates(np.zeros(len(p), np.int64), p, q, np.full(len(p), n))
                good.append(bool(verified(padded(d), padded(w), p[few] + len(pad), q[few] + len(pad), np.zeros(len(few), np.int64)).any()))
            yield b.loc[good, ["doc_id", "item_id"]]

    return whole.select("doc_id", "item_id", "doc", "piece_words", "hits", "need").mapInPandas(verify, "doc_id long, item_id long")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", parts: tuple[str, ...] = ("passage", "question"), exact: bool = False, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id), once each: documents that hold a stretch of an item's parts.

    A stretch is at least 16 consecutive words, or at least 25 of which at most one in six was changed, dropped or added,
    after markup, case, punctuation, line breaks and invisible characters are taken away. Wording that several items
    share (16 words or more) is no part of an item, so equal items yield nothing. Null and empty texts hold nothing and
    are held by nothing; parts and texts below 16 words can't be cases. Whole texts of any length are searched, copies of
    a document are documents of their own, and repeated rows give one row. Columns not named are ignored.

    exact sketches every shingle of the items: then no case is missed, as a stretch keeps `common` of them. Items of up to
    broadcast_words words are sent to the tasks, and one pass over the documents without a shuffle of texts finds all;
    beyond, one pass makes hits and another verifies, for any number of items.
    """
    own = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs = item_pieces(items, item_id, parts)
    keys = sketches(runs, exact)
    few = (runs.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0) <= broadcast_words
    found = _broadcast_search(own, runs, keys) if few else _joined_search(own, runs, keys)
    return found.distinct().select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
