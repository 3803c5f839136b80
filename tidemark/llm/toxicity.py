"""Toxicity by a factorization machine over hashed terms.

Terms are words and the five-letter runs in them, hashed. A bounded sample of
labelled rows chooses the terms (those that lean to one label, and the most
common ones) and fits a weight and a factor vector for each, so that a pair of
terms can say what neither says alone. Scoring looks up each distinct word of a
text once.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import name, slim, training_fold
from tidemark.llm.words import in_groups
from tidemark.session import ship_package

#: Labelled rows fitted on, and the longest text among them.
SAMPLE_ROWS, SAMPLE_CHARS = 8_000, 65_536
#: Hash space of terms; terms kept because they lean, or because they are common.
SPACE, LEANING, COMMON = 1 << 22, 4_000, 300
FACTORS, GRAM = 8, 5
WORD = re.compile(r"[^\W\d_]+")


def hashed(term: str) -> int:
    return zlib.crc32(term.encode()) % SPACE


def word_terms(word: str) -> list[int]:
    """The word, and every run of ``GRAM`` letters in it."""
    return [hashed(word)] + [hashed("~" + word[i:i + GRAM]) for i in range(len(word) - GRAM + 1)]


class Terms:
    """Distinct terms of texts; what words hold is remembered, up to a bound."""

    def __init__(self, chosen: dict[int, int] | None = None):
        self.chosen, self.known = chosen, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            terms = word_terms(word)
            found = tuple(terms) if self.chosen is None else tuple({self.chosen[t] for t in terms if t in self.chosen})
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found
        return found

    def of(self, text: str) -> list[int]:
        return list({t for word in set(WORD.findall(text.lower())) for t in self.of_word(word)})


class Machine:
    """w0 + sum of weights + sum over pairs of terms of the product of their factors."""

    def __init__(self, chosen: dict[int, int], value: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.chosen, self.value, self.w0, self.w, self.v = chosen, value, w0, w, v
        self.terms = Terms(chosen)

    def __getstate__(self):
        return self.chosen, self.value, self.w0, self.w, self.v

    def __setstate__(self, state):
        self.__init__(*state)

    def margins(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Margins, and for the gradient: row of each entry, term of each entry, factor sums of each row."""
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.array([t for r in rows for t in r], np.int64)
        x = self.value[term]
        vx = self.v[term] * x[:, None]
        sums = np.zeros((len(rows), self.v.shape[1]))
        squares, linear = np.zeros(len(rows)), np.bincount(of, weights=self.w[term] * x, minlength=len(rows))
        for f in range(self.v.shape[1]):
            sums[:, f] = np.bincount(of, weights=vx[:, f], minlength=len(rows))
            squares += np.bincount(of, weights=vx[:, f] ** 2, minlength=len(rows))
        return self.w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares), of, term, sums

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins([self.terms.of(t) for t in texts])[0], -30, 30)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.5, decay: float = 1e-5, seed: int = 3) -> Machine:
    """Choose terms and fit the machine by AdaGrad on the logistic loss."""
    every = Terms()
    rows = [every.of(t) for t in texts]
    bad, good = Counter(), Counter()
    for r, y in zip(rows, labels):
        (bad if y else good).update(r)
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    lean = {}
    for t in bad.keys() | good.keys():
        a, b = bad[t], good[t]
        if a + b >= 4:
            share = (a + b) / (n0 + n1)
            z = abs(a / n1 - b / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
            if z > 5:
                lean[t] = z
    common = Counter({t: bad[t] + good[t] for t in bad.keys() | good.keys()}).most_common(COMMON)
    picked = sorted({*sorted(lean, key=lambda t: (-lean[t], t))[:LEANING], *(t for t, _ in common)})
    chosen = {t: i for i, t in enumerate(picked)}
    frequency = np.array([bad[t] + good[t] for t in picked], float)
    value = np.log((n0 + n1 + 1) / np.maximum(1.0, frequency)) / np.log(n0 + n1 + 1) if len(picked) else np.zeros(0)
    rng = np.random.default_rng(seed)
    m = Machine(chosen, value, float(np.log(n1 / n0)), np.zeros(len(picked)), rng.normal(0, 0.02, (len(picked), FACTORS)))
    rows = [[chosen[t] for t in r if t in chosen] for r in rows]
    gw, gv, g0 = np.full(len(picked), 1e-2), np.full((len(picked), FACTORS), 1e-2), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            margin, of, term, sums = m.margins([rows[i] for i in some])
            miss = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[some]) / len(some)
            x = m.value[term]
            step_w = np.bincount(term, weights=miss[of] * x, minlength=len(picked)) + decay * m.w
            inner = (miss[of] * x)[:, None] * (sums[of] - m.v[term] * x[:, None])
            step_v = np.stack([np.bincount(term, weights=inner[:, f], minlength=len(picked)) for f in range(FACTORS)], axis=1) + decay * m.v
            g0 += miss.sum() ** 2
            gw += step_w**2
            gv += step_v**2
            m.w0 -= rate * miss.sum() / np.sqrt(g0)
            m.w -= rate * step_w / np.sqrt(gw)
            m.v -= rate * step_v / np.sqrt(gv)
    return m


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> Machine | None:
    """A machine from at most ``rows`` labelled rows of the training fold, drawn by a hash of the id; null without any.

    The drawn labels (two numbers a row) are the one broadcast side."""
    usable = labels.where(training_fold(name(id_col)) & name(label_col).isNotNull()).select(name(id_col).alias("id"), (name(label_col) == 1).cast("int").alias("label"))
    n = usable.count()
    if not n:
        return None
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, 1.2 * rows / n) * (1 << 30)))
    drawn = drawn.groupBy("id").agg(F.max("label").alias("label")).limit(rows)
    texts = docs.select(name(id_col).alias("doc_id"), name(text_col).alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    found = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label").limit(rows).collect()
    if not found:
        return None
    found.sort()
    return fit([r["text"] for r in found], np.array([r["label"] for r in found]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns only from labelled rows whose crc32 of the id (as text) is no multiple
    of five; a score depends on the text alone. A null or empty text has the
    score of no terms; without a label to learn from all scores are 0. An id
    labelled more than once counts as toxic if one label says so. Rows with a
    null id are held out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    machine = learn(docs, labels, id_col, text_col, label_col, rows)
    texts = slim(docs, id_col, text_col).select("doc_id", (~training_fold(F.col("doc_id"))).alias("held_out"), "text")
    if machine is None:
        return texts.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in in_groups(batches, "text"):
            found = shared.value.scores(some)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
