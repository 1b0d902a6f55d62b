"""Reading levels: held-out accuracy, and edges."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverspark.llm.reading import CUTOFFS, Lexicon, document_frequencies, familiar_words, fit_samples, fitted, formula_table, reading_levels, stretches, term_names, tokens

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def data(spark):
    if not DATA.exists():
        pytest.skip("no test data")
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/read_levels.parquet")


def test_held_out_accuracy(data):
    docs, samples = data
    familiar = familiar_words(document_frequencies(docs))
    rows = samples.orderBy(F.xxhash64("sample_text")).select("sample_text", "read_level").collect()
    right = near = n5 = right5 = 0
    for fold in range(4):
        f = fit_samples([tuple(r) for k, r in enumerate(rows) if k % 4 != fold], familiar)
        held = [r for k, r in enumerate(rows) if k % 4 == fold]
        lex = Lexicon(familiar)
        t = tokens([r[0] for r in held], lex)
        x, owner, words = stretches(t, np.array(lex.band), len(CUTOFFS))
        share = np.zeros((len(held), 5))
        np.add.at(share, (owner, f.level(x) - 1), words)
        for r, k in zip(held, share.argmax(axis=1) + 1):
            right += k == r[1]
            near += abs(k - r[1]) <= 1
            n5 += r[1] == 5
            right5 += k == r[1] == 5
    assert right / len(rows) > 0.9 and near / len(rows) > 0.97 and right5 / n5 > 0.9


def test_formula_is_published(data):
    docs, samples = data
    lines = formula_table(docs, samples).collect()
    assert len(lines) == 4 * len(term_names()) == 4 * 20
    familiar, f = fitted(docs, samples)
    lex = Lexicon(familiar)
    t = tokens(["The cow sat on the mat. The cow ran."], lex)
    x, _, words = stretches(t, np.array(lex.band), len(CUTOFFS))
    outside = [sum(familiar.get(w, 0) <= k for w in "the cow sat on the mat the cow ran".split()) / 9 for k in range(len(CUTOFFS))]
    s = math.log1p(4.5)
    assert words.tolist() == [9] and x[0] == pytest.approx([*outside, s, *[u * s for u in outside], 1.0])
    above = [sum(r["coefficient"] * v for r, v in zip((r for r in lines if r["above_level"] == k), x[0])) > 0 for k in range(1, 5)]
    assert f.level(x)[0] == 1 + sum(above) == 1


def test_document_frequencies_equal_brute_force(spark):
    docs = spark.createDataFrame([("The river and the dam.",), ("The river is low.",), ("El río y la presa de los peces.",), (None,), ("",), ("a <b>river</b>\n1.0 2.0 3.0 4.0 5.0 dam 0\n",)], "text string").withColumn("word", F.lit("x"))
    got = {r["word"]: r["n"] for r in document_frequencies(docs).collect()}
    assert (got["river"], got["the"], got["dam"], got["low"]) == (2, 2, 1, 1) and "presa" not in got and got[""] == 2


def test_levels_of_odd_texts(data, spark):
    docs, samples = data
    extra = [(-1, None), (-2, ""), (-3, "12 34 ,,, !!"), (-4, "Se contaron 5,997 barreras en la cuenca, casi todas pequeñas, y los vecinos lo notaron."), (-5, "The cow sat on the mat. " * 40_000), (-6, "The cow sat on the mat."), (-6, "The cow sat on the mat.")]
    odd = spark.createDataFrame(extra, "doc_id long, text string")
    out = reading_levels(docs.select("doc_id", "text").unionByName(odd).withColumn("level", F.lit("x")).withColumn("english", F.lit("x")), samples.unionByName(spark.createDataFrame([(None, None, 3), (1, "", 2), (2, "words", None), (3, "words", 9)], samples.schema)))
    got = {r["doc_id"]: r for r in out.where("doc_id < 0").collect()}
    for k in (-1, -2, -3, -4):
        assert got[k]["level"] is None and not got[k]["english"]
    assert got[-5]["level"] == got[-6]["level"] == 1 and got[-5]["n_words"] == 240_000
    assert out.count() == docs.count() + len(extra)
    assert out.where("doc_id = -6").count() == 2


def test_empty_corpus(data, spark):
    docs, samples = data
    assert reading_levels(docs.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        reading_levels(docs, samples.limit(0)).count()


def test_levels_do_not_depend_on_partitions(data):
    docs, samples = data
    one = sorted(map(tuple, reading_levels(docs.repartition(1), samples).select("doc_id", "level").collect()), key=repr)
    assert one == sorted(map(tuple, reading_levels(docs.repartition(5), samples).select("doc_id", "level").collect()), key=repr)
