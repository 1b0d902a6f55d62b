"""Leak search against a brute-force alignment, planted cases and edges."""

import random

import numpy as np
import pandas as pd
import pytest

from riverspark.llm.leakage import CLASSES, EXACT_WORDS, LOOSE_SHARE, LOOSE_WORDS, SHINGLE, _loose, _packed, leaks, search, signature
from riverspark.llm.text import WordIds, clean, shingles, word_ids

WORDS = [a + b for a in "ba ke li mo nu pra sti tro vel wen".split() for b in "dan fel gor him jut lak mir nos pel rit sov tum".split()]


def text(r, n):
    return [r.choice(WORDS) for _ in range(n)]


def edited(r, words, edits):
    """words with so many words changed, dropped or added, well spread."""
    out, at = [], set(r.sample(range(1, len(words) - 1), edits))
    for i, w in enumerate(words):
        kind = r.choice("cda") if i in at else ""
        if kind == "c":
            out.append("zz" + w)
        elif kind == "a":
            out += [w, "zzadded"]
        elif kind != "d":
            out.append(w)
    return out


def distance_ok(doc, piece):
    """Brute force: any stretch of piece of at least 25 words within its edits of any run of doc."""
    for a in range(len(piece)):
        row = [0] * (len(doc) + 1)
        for k, w in enumerate(piece[a:], 1):
            new = [row[0] + 1]
            for j, v in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (v != w)))
            row = new
            if k >= LOOSE_WORDS and min(row) * LOOSE_SHARE <= k:
                return True
    return False


def exact_ok(doc, piece):
    runs = {tuple(doc[i : i + EXACT_WORDS]) for i in range(len(doc) - EXACT_WORDS + 1)}
    return any(tuple(piece[i : i + EXACT_WORDS]) in runs for i in range(len(piece) - EXACT_WORDS + 1))


def test_loose_equals_brute_force():
    r = random.Random(1)
    for n, edits in [(25, 4), (25, 5), (30, 5), (30, 6), (40, 6), (40, 7), (60, 10), (60, 12)] * 4:
        piece = text(r, n)
        doc = text(r, 15) + edited(r, piece, edits) + text(r, 15)
        ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(piece + doc))}
        as_ids = lambda ws: np.array([ids[w] for w in ws], np.uint64)
        assert _loose(as_ids(doc), as_ids(piece)) == distance_ok(doc, piece), (n, edits)


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    items = [(k, " ".join(text(r, 60)), " ".join(text(r, 26))) for k in range(12)]
    docs = []
    for k in range(160):
        body = text(r, r.choice([0, 5, 80, 400]))
        i = items[k % 12]
        piece = i[1 + k % 2].split()
        n = r.choice([8, 15, 16, 17, 25, 26])
        a = r.randrange(max(1, len(piece) - n))
        part = piece[a : a + n]
        part = r.choice([part, edited(r, part, min(4, max(1, n // 6)))]) if n > 8 else part
        docs.append((k, " ".join(body + part + text(r, 30))))
    want = sorted((d, i) for d, t in docs for i, *ps in items if any(exact_ok(t.split(), p.split()) or distance_ok(t.split(), p.split()) for p in ps))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(items, "item_id long, passage string, question string")
    got = sorted(map(tuple, leaks(d, t).collect()))
    assert got == want and len(want) > 40
    assert sorted(map(tuple, leaks(d, t, exact=True).collect())) == want
    assert sorted(map(tuple, leaks(d.withColumn("hash", d_col()), t, broadcast_words=0).collect())) == want  # sketch joined instead of sent


def spaced(words, edits, kind, first=None):
    """words with edits at even distances, from the middle of the first gap."""
    out, gap = [], len(words) / (edits + 1)
    at = {round(gap * (k + 1)) for k in range(edits)} if first is None else {first + 6 * k for k in range(edits)}
    for i, w in enumerate(words):
        if i not in at or kind == "a":
            out.append(w)
        if i in at and kind in "ca":
            out.append(f"zz{i}")
    return out


@pytest.mark.parametrize("exact, least", [(False, 0.99), (True, 1.0)])
def test_recall_of_edited_stretches(exact, least):
    r = random.Random(12)
    ids, cases, hit = WordIds(), 0, 0
    for n in (25, 29, 30, 35, 36, 41, 48, 49):
        for kind in "cda":
            for way in ("even", "six", "random"):
                parts, texts = [], []
                for _ in range(12):
                    piece = text(r, 120)
                    a, k = r.randrange(120 - n), n // 6
                    part = piece[a : a + n]
                    part = spaced(part, k, kind) if way == "even" else spaced(part, k, kind, r.randrange(6)) if way == "six" and k * 6 < n + 5 else edited(r, part, k)
                    parts.append(word_ids([" ".join(piece)], ids)[:-1].view(np.int64))
                    texts.append(" ".join(text(r, 30) + part + text(r, 30)))
                p = pd.DataFrame({"piece": range(12), "item_id": range(12), "words": parts})
                at = [signature(w.view(np.uint64), exact) for w in parts]
                keys = pd.DataFrame({"key": np.concatenate([shingles(w.view(np.uint64), SHINGLE)[i].view(np.int64) for w, i in zip(parts, at)]), "piece": np.repeat(range(12), [len(i) for i in at]), "at": np.concatenate(at), "need": 2})
                d, i = search(texts, _packed(p, keys), ids)
                hit += len({x for x, y in zip(d, i) if x == y})
                cases += 12
    assert hit >= least * cases


def test_signatures():
    short, long = CLASSES
    assert (short.common, long.common) == (13, 6) and short.minima() == 1 and long.minima() == 15
    w = np.arange(1, 200, dtype=np.uint64)
    assert len(signature(w[:20])) <= 8 < len(signature(w)) < len(signature(w, exact=True)) == 196


def test_typeset_and_shared_wording(spark):
    r = random.Random(9)
    shared = " ".join(text(r, 20))
    a, b = text(r, 40), text(r, 40)
    items = [(1, shared + " " + " ".join(a), None), (2, shared + " " + " ".join(b), ""), (3, None, " ".join(text(r, 30)))]
    p = a[5:23]
    html = "<p>" + " ".join(f"<b>{w}</b>[{i}]" if i % 2 else f"**{w.upper()}**" for i, w in enumerate(p)) + "</p>"
    wrapped = "> " + " ".join(p[:9]) + " " + p[9][:2] + "-\n> " + p[9][2:] + "\n> " + " ".join(p[10:])
    soft = "​".join(w[:2] + "­" + w[2:] + " " for w in p)
    docs = [(1, html), (2, wrapped), (3, soft.replace(" ", " ")), (4, shared), (5, shared + " " + " ".join(a[:12])), (6, None), (7, ""), (8, ", ".join(p) + "."), (8, ", ".join(p) + "."), (9, " ".join(p[:15])), (10, " ".join(text(r, 60_000) + p))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", d_col()).withColumn("h", d_col())
    t = spark.createDataFrame(items, "item_id long, passage string, question string")
    assert sorted(map(tuple, leaks(d, t).collect())) == [(k, 1) for k in (1, 2, 3, 8, 10)]
    assert leaks(d.limit(0), t).count() == 0 and leaks(d, t.limit(0)).count() == 0
    twice = t.where("item_id = 1").unionByName(t.where("item_id = 1").selectExpr("item_id + 10 AS item_id", "passage", "question"))
    assert leaks(d, twice).count() == 0  # equal items: all wording is shared


def d_col():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_clean_numbers_and_compounds():
    assert clean(["4,673 a 2 ,495 well-\nknown x-y <i>b</i>[3]", None]).split("\0")[:2] == ["4673 a 2495 wellknown xy b", ""]
