"""Pfair order, plans and mixtures."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riverspark.llm.mixing import mix, pfair, plan_mixture, shares, source_name, token_counts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.mark.parametrize("blocks", [{"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1}, {"a": 1}, {"a": 313, "b": 211, "c": 101, "d": 7, "e": 1, "f": 57}])
def test_pfair_deviates_by_less_than_a_block(blocks):
    order = pfair(blocks)
    n, seen = sum(blocks.values()), Counter()
    assert Counter(s for s, _ in order) == blocks
    for t, (s, k) in enumerate(order, 1):
        assert k == seen[s]
        seen[s] += 1
        for x, b in blocks.items():
            assert abs(seen[x] - t * b / n) < 1


def test_plan_meets_shares_and_caps():
    have, target, rep = {"a": 100_000, "b": 5_000, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 4, "c": 9}
    p = plan_mixture(have, target, rep, block_tokens=100, cycle=1000)
    assert set(p.quota) == {"a", "b"} and p.quota["b"] <= 20_000
    assert p.quota["a"] / sum(p.quota.values()) == pytest.approx(0.625, abs=0.005)
    big = plan_mixture(have, target, rep, total=60_000, block_tokens=100, cycle=1000)
    assert big.quota["b"] == pytest.approx(20_000, rel=0.01) and big.quota["a"] == pytest.approx(40_000, rel=0.01)
    assert plan_mixture({}, target, rep).quota == {} and plan_mixture(have, {"a": 0.0}, rep).quota == {}


@pytest.mark.parametrize("rare", [0.00001, 0.00005])
def test_plan_meets_a_small_share_of_a_limiting_source(rare):
    have, target = {"a": 10**9, "rare": 5_000}, {"a": 1 - rare, "rare": rare}
    p = plan_mixture(have, target, {"a": 1, "rare": 1})
    whole = sum(p.quota.values())
    assert p.quota["rare"] / whole == pytest.approx(rare, rel=0.06) and whole == pytest.approx(5_000 / rare, rel=0.06)


def corpus(spark, n=600):
    r = random.Random(2)
    data = [(k, " ".join(r.choice(["river", "dam", "fish", "reservoirs"]) for _ in range(r.randrange(1, 120))), r.choice(["Web Text"] * 5 + ["web-text", "books", "BOOKS ", None, "other"])) for k in range(n)]
    data += [(n, None, "books"), (n + 1, "", "books"), (0, "again", "books")]
    return spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(-1)).withColumn("quota", F.lit("x"))


def test_mixture(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("web_text", 0.4, 1), ("books", 0.5, 3), ("empty", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = mix(docs, targets, TOKENIZER, block_tokens=64).collect()
    assert rows
    uses = Counter((r["source"], r["doc_id"]) for r in rows if r["from_token"] == 0)
    assert max(v for (s, d), v in uses.items() if s == "books" and d) <= 3 and max(v for (s, *_), v in uses.items() if s == "web_text") == 1
    total = Counter()
    for r in rows:
        total[r["source"]] += r["n_tokens"]
    assert set(total) == {"web_text", "books"}
    whole = sum(total.values())
    assert total["books"] / whole == pytest.approx(5 / 9, abs=0.02)
    # streams are gapless: each use begins where the last ended
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["start"], r["n_tokens"], r["position"]))
    for xs in by.values():
        xs.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(xs, xs[1:]))
        assert [p for *_, p in xs] == sorted(p for *_, p in xs)
    # at every token each source is less than a block off its share, and every block is full
    xs = sorted((r["position"], r["start"], r["source"], r["n_tokens"]) for r in rows)
    full = Counter()
    for p, _, _, n in xs:
        full[p] += n
    block = max(full.values())
    assert set(full.values()) == {block} and sorted(full) == list(range(len(full)))
    run = Counter()
    for _, _, s, n in xs:
        run[s] += n
        t = sum(run.values())
        assert all(abs(run[k] - t * total[k] / whole) < block for k in total)
    out = {r["source"]: r for r in shares(mix(docs, targets, TOKENIZER, block_tokens=64), targets).collect()}
    assert out["empty"]["n_tokens"] == 0 and out["empty"]["actual_share"] == 0.0
    assert out["books"]["n_tokens"] == total["books"] and out["books"]["most_uses"] <= 3
    assert 0 < out["books"]["max_deviation_blocks"] < 1 and out["empty"]["max_deviation_blocks"] == 0


def test_documents_of_many_blocks_are_cut(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(k, "river dam " * r.randrange(1, 400), "abc"[k % 3]) for k in range(60)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mix(docs, targets, TOKENIZER, block_tokens=32)
    pieces = defaultdict(list)
    for x in m.collect():
        pieces[x["doc_id"], x["use_no"]].append((x["from_token"], x["n_tokens"]))
    assert max(map(len, pieces.values())) > 10
    for xs in pieces.values():
        xs.sort()
        assert xs[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(xs, xs[1:]))
    assert all(x["max_deviation_blocks"] < 1 for x in shares(m, targets).collect())


def test_mixture_does_not_depend_on_partitions(spark):
    docs = corpus(spark, 200)
    targets = spark.createDataFrame([("web_text", 0.4, 1), ("books", 0.6, 3)], "source string, target_share double, max_repeats int")
    key = lambda d: sorted(map(tuple, mix(d, targets, TOKENIZER, block_tokens=64).collect()))
    assert key(docs.repartition(1)) == key(docs.repartition(7))


def test_mixture_edges(spark):
    docs = corpus(spark, 50)
    targets = spark.createDataFrame([("web_text", 1.0, 1), (None, 0.5, 1), ("web text", None, None)], "source string, target_share double, max_repeats int")
    assert mix(docs.limit(0), targets, TOKENIZER).count() == 0 and mix(docs, targets.limit(0), TOKENIZER).count() == 0
    one = spark.createDataFrame([("Web Text", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(docs, one, TOKENIZER).count() > 0


def test_token_counts_are_those_of_the_tokenizer(spark):
    import tiktoken  # noqa: F401

    from riverspark.llm.mixing import _encoding

    texts = ["", None, "The river <|endoftext|> naïve 4,673", "word " * 40_000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(d, TOKENIZER, ["doc_id"]).collect()}
    assert got == {k: len(_encoding(TOKENIZER).encode_ordinary(t)) if t else 0 for k, t in enumerate(texts)}


def test_source_names(spark):
    d = spark.createDataFrame([(" Field-Notes ",), ("FIELD_NOTES",), ("field  notes",), (None,)], "s string")
    assert {r[0] for r in d.select(source_name("s")).collect()} == {"field_notes", None}
