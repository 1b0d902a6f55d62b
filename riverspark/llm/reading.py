"""Reading level of each document: familiar-word formula.

High-frequency lists are derived from the corpus' own document frequencies: words in at least 1, 2, 3, 5, 8, 11, 14, 20 and
30 % of the English documents. With u the share of a text's words outside a list, and s = ln(1 + average sentence length), a text is
above level k if

    c0 + c1 s + sum over the lists of (a + b s) u  >  0

One list alone can't do it where the words of easy texts are rarer in the corpus than technical ones. The coefficients
(20 for each of the four thresholds) are fitted on labelled samples and published by formula_table. A text is judged in
stretches of about STRETCH words, whole sentences; the document's level is that of most of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverspark.llm.text import clean, pieces
from riverspark.session import cut

#: Cut-offs of the nested lists: share of the English documents that hold the word. The lowest bounds the list's size.
CUTOFFS = (0.01, 0.02, 0.03, 0.05, 0.08, 0.11, 0.14, 0.2, 0.3)
#: The list whose outside share is reported as unfamiliar.
MAIN = 6
STRETCH, LEVELS = 24, 5
#: Labelled samples that are fitted at most, and words the familiar lists may have at most.
MAX_SAMPLES, MAX_WORDS = 20_000, 1_000_000

#: Frequent function words.
ENGLISH = "the of and to in is that it was for on are with as at be this by from or had not but which were have an they one all you their its has there been if more when will would who so no we can about up out into than them only other some could these two may then do any my now such like our over even most after also did many before must through where much your way well down should because each just those people how too little good very make still own see work long get here both between being under never same another know while last might us since against however upon near neither nor although whereas unless".split()
FOREIGN = {
    "es": "el los las del un una y que en se por con para al lo como más su es sus le ha pero muy este ya sin sobre también fue hasta hay desde todo nos durante todos uno les ni contra otros ese eso ante ellos esto antes algunos unos otro la de".split(),
    "pt": "o os as do da dos das um uma e que em se por com para ao na no nas nos mais como mas foi são não também muito já até pelo pela seu sua ou quando há entre depois sem mesmo aos seus quem isso num numa essa esse isto de a".split(),
    "fr": "le les des du un une et que en se par avec pour au aux la il elle on ne pas dans sur est ce qui plus ont son sa ses ces sont mais ou où cette sans leur leurs entre après même aussi très puis jusque dont nous vous ils d'un d'une de".split(),
}
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.!?]+(?=[\s\"')\]\0]|$)|\n\s*\n|\n[ \t]*(?:[-*•]|\d{1,3}[.)])[ \t]|\0")
#: Lines of numbers (annotations) and of keywords are no text.
DEBRIS = re.compile(r"(?m)^[ \t]*(?:(?:-?\d+(?:\.\d+)?[ \t]+){4,}[^\n\0]*|(?:key ?words?|tags)[ \t]*:[^\n\0]*)$", re.IGNORECASE)


class Lexicon(dict):
    """Numbers of tokens: words from 2 on, 1 for a sentence's end, 0 for a text's end; with a language mark per word."""

    LIMIT = 1_000_000

    def __init__(self, familiar: dict[str, int] | None = None) -> None:
        super().__init__()
        self.familiar = familiar or {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: list[str] = ["\0", "."]
        self.band: list[int] = [-1, -1]
        self.english: list[int] = [0, 0]
        self.foreign: list[tuple[int, ...]] = [(0,) * len(FOREIGN)] * 2
        self.marked: list[bool] = [False, False]

    def __missing__(self, token: str) -> int:
        if token == "\0":
            n = 0
        elif not token[0].isalpha():
            n = 1
        else:
            n = len(self.words)
            self.words.append(token)
            self.band.append(self.familiar.get(token, 0))
            self.english.append(token in _ENGLISH)
            self.foreign.append(tuple(token in f for f in _FOREIGN))
            self.marked.append(token in _ENGLISH or any(self.foreign[-1]))
        self[token] = n
        return n


_ENGLISH, _FOREIGN = frozenset(ENGLISH), [frozenset(w) for w in FOREIGN.values()]


@dataclass
class Tokens:
    """Words of a piece: number, text and sentence of each; and per text, whether it is English and its words."""

    ids: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray
    english: np.ndarray
    words: np.ndarray


def tokens(texts: list[str | None], lex: Lexicon) -> Tokens:
    if len(lex.words) > lex.LIMIT:
        lex.reset()
    s = DEBRIS.sub("\n", clean(texts)).lower().replace("’", "'")
    found = TOKEN.findall(s)
    ids = np.fromiter(map(lex.__getitem__, found), np.int64, len(found))
    doc, sentence = np.cumsum(ids == 0) - (ids == 0), np.cumsum(ids < 2)
    word = ids > 1
    ids, doc, sentence = ids[word], doc[word], sentence[word]
    n = len(texts)
    words = np.bincount(doc, minlength=n)
    marked = np.array(lex.marked, bool)[ids]
    few, at = ids[marked], doc[marked]
    en = np.bincount(at, np.array(lex.english, float)[few], n)
    most = np.max([np.bincount(at, f, n) for f in np.array(lex.foreign, float)[few].T.reshape(len(FOREIGN), -1)], axis=0)
    # technical texts have few function words: what has no foreign majority, and some English word, is English
    return Tokens(ids, doc, sentence, (en > most) & (words > 0), words)


def stretches(t: Tokens, bands: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of the formula, text, words) of the stretches."""
    if not len(t.ids):
        return np.zeros((0, 2 * count + 2)), np.zeros(0, np.int64), np.zeros(0)
    first = np.flatnonzero(np.r_[True, t.sentence[1:] != t.sentence[:-1]])
    length = np.diff(np.r_[first, len(t.ids)])
    doc = t.doc[first]
    new = np.r_[True, doc[1:] != doc[:-1]]
    start = first - first[new][np.cumsum(new) - 1]
    # a sentence belongs to the stretch in which its middle lies; a text's short rest joins the stretch before
    number = np.minimum((start + length / 2) // STRETCH, np.maximum((t.words[doc] - STRETCH / 2) // STRETCH, 0))
    which = np.cumsum(new | np.r_[True, number[1:] != number[:-1]]) - 1
    n = which[-1] + 1
    words = np.bincount(which, length, n)
    row = np.repeat(which, length)
    cells = np.bincount(row * (count + 1) + bands[t.ids], minlength=n * (count + 1)).reshape(n, count + 1)
    outside = np.cumsum(cells, axis=1)[:, :count] / words[:, None]
    length = np.log1p(words / np.bincount(which, minlength=n))[:, None]
    x = np.c_[outside, length, outside * length, np.ones(n)]
    owner = np.zeros(n, np.int64)
    owner[which] = doc
    return x, owner, words


def term_names(count: int = len(CUTOFFS)) -> list[str]:
    """Names of the formula's terms, in the order of stretches."""
    lists = [f"outside_{100 * c:g}%" for c in CUTOFFS[:count]]
    return [*lists, "sentence", *[f"{n}*sentence" for n in lists], "1"]


@dataclass
class Formula:
    """A row of coefficients for each threshold between levels."""

    coefficients: np.ndarray

    def level(self, x: np.ndarray) -> np.ndarray:
        return 1 + (x @ self.coefficients.T > 0).sum(axis=1)


def fit(x: np.ndarray, y: np.ndarray, words: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> Formula:
    """Logistic regression of "above level k" on the terms, for each k, by Newton's method from 0: the same result for the same rows."""
    weight = words / words.mean()
    lines = []
    for k in range(1, LEVELS):
        c = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(c)), x.T @ (weight * (p - (y > k))) + ridge * c)
            c -= step
            if np.abs(step).max() < 1e-9:
                break
        lines.append(c)
    return Formula(np.array(lines))


def fit_samples(samples: list[tuple[str | None, int | None]], familiar: dict[str, int]) -> Formula:
    """The formula from (text, level) samples; samples without text or with a level outside 1 to 5 are left out."""
    rows = [(t, int(k)) for t, k in samples if t and k is not None and 1 <= int(k) <= LEVELS]
    if not rows:
        raise ValueError("no labelled sample with text")
    lex = Lexicon(familiar)
    t = tokens([r[0] for r in rows], lex)
    x, owner, words = stretches(t, np.array(lex.band), len(CUTOFFS))
    return fit(x, np.array([r[1] for r in rows])[owner], words)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): in how many English documents a word occurs; word '' has the number of English documents. All documents count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = Lexicon()
        for b in batches:
            texts = list(b["text"])
            for i, j in pieces(texts):
                t = tokens(texts[i:j], lex)
                mine = t.english[t.doc]
                pairs = np.sort(t.doc[mine] * (1 << 32) + t.ids[mine])
                pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
                n = np.bincount(pairs & ((1 << 32) - 1), minlength=1)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"word": [lex.words[k] for k in at] + [""], "n": np.r_[n[at], t.english.sum()]})

    parts = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def familiar_words(frequencies: DataFrame, cutoffs: tuple[float, ...] = CUTOFFS, limit: int = MAX_WORDS) -> dict[str, int]:
    """word -> number of cut-offs it reaches, for the words that reach the lowest.

    Bounded: a word of the list is in at least cutoffs[0] of the documents, so the list has at most (mean number of
    distinct words of a document) / cutoffs[0] words at any size of the corpus. More than limit is an error.
    """
    total = frequencies.where("word = ''").agg(F.sum("n").alias("n")).scalar()
    listed = frequencies.where(F.col("word") != "").where(F.col("n") >= total * F.lit(cutoffs[0])).withColumn("all", total).limit(limit + 1).collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} familiar words")
    return {r["word"]: int(np.searchsorted(cutoffs, r["n"] / r["all"] + 1e-12, "right")) for r in listed}


def fitted(docs: DataFrame, samples: DataFrame, text: str = "text", max_samples: int = MAX_SAMPLES) -> tuple[dict[str, int], Formula]:
    """The familiar words and the formula of a corpus; at most max_samples of the samples are fitted, chosen by hash."""
    familiar = familiar_words(cut(document_frequencies(docs, text), "frequencies"))
    chosen = samples.select("sample_text", "read_level").orderBy(F.xxhash64("sample_text"), "read_level").limit(max_samples).collect()
    return familiar, fit_samples([tuple(r) for r in chosen], familiar)


def formula_table(docs: DataFrame, samples: DataFrame, text: str = "text", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """(above_level, term, coefficient): a stretch is above a level if the sum of coefficients times terms is above 0."""
    _, f = fitted(docs, samples, text, max_samples)
    lines = [(k + 1, n, float(c)) for k, line in enumerate(f.coefficients) for n, c in zip(term_names(), line)]
    return docs.sparkSession.createDataFrame(lines, "above_level int, term string, coefficient double")


def reading_levels(docs: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """One row per row of docs: doc_id, english, n_words, level, share_1 to share_5, unfamiliar, sentence_words.

    share_k: share of the words in stretches of level k; level: the level with the largest share (equal: the lower).
    unfamiliar: share of words in less than 14 % of the documents. Texts that are null, empty, without words or not
    English (told by function words, whatever any column says) have a null level and shares 0. Repeated documents are
    rows of their own. samples (sample_text, read_level): at most max_samples of them are fitted, chosen by hash.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fitted(docs, samples, text, max_samples))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, f = sent.value
        lex = Lexicon(known)
        for b in batches:
            texts, ids = list(b["text"]), b["doc_id"].to_numpy()
            for i, j in pieces(texts):
                t = tokens(texts[i:j], lex)
                band = np.array(lex.band)
                x, owner, words = stretches(t, band, len(CUTOFFS))
                n = j - i
                share = np.zeros((n, LEVELS))
                if len(x):
                    np.add.at(share, (owner, f.level(x) - 1), words)
                total = np.maximum(t.words, 1)
                share = share / total[:, None] * t.english[:, None]
                rare = np.bincount(t.doc, band[t.ids] <= MAIN, n) / total
                sentences = np.bincount(t.doc[np.flatnonzero(np.r_[True, np.diff(t.sentence) != 0])] if len(t.ids) else t.doc, minlength=n)
                level = pd.array(share.argmax(axis=1) + 1, dtype="Int64")
                level[~t.english] = pd.NA
                out = {"doc_id": ids[i:j], "english": t.english, "n_words": t.words, "level": level}
                out |= {f"share_{k + 1}": share[:, k] for k in range(LEVELS)}
                yield pd.DataFrame(out | {"unfamiliar": rare, "sentence_words": t.words / np.maximum(sentences, 1)})

    schema = "doc_id long, english boolean, n_words long, level int, " + ", ".join(f"share_{k + 1} double" for k in range(LEVELS)) + ", unfamiliar double, sentence_words double"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(judge, schema).withColumnRenamed("doc_id", doc_id)
