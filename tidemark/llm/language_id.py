"""Language ID by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes holds counts; an
unseen byte escapes to the shorter context with the probability (distinct bytes)
/ (count + distinct bytes). Counts are frozen after learning, so every code
length is known beforehand and a text's exact code length under each language
is a sum of table entries. The shortest code wins.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import name, packed, restored, schema, small_batches, training_fold
from tidemark.llm.words import in_groups
from tidemark.session import ship_package

ORDER = 3
#: About so many labelled rows of each language are learned from, and none longer than this.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 65_536
#: Contexts of the full order that the trees hold: the most frequent ones.
FULL_CONTEXTS = 12_000
#: Bytes scored at a time.
STEP = 400_000


class Model:
    """Code lengths (natural log units) of every symbol in every context for every language."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        text = {lang: np.frombuffer(b"".join(samples[lang]), np.uint8) for lang in self.langs}
        used = np.unique(np.concatenate([*text.values(), np.zeros(0, np.uint8)]))
        # symbol 0 is what no sample holds, and what stands before a text
        self.symbol = np.zeros(256, np.int64)
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.size = size = len(used) + 1
        seen = {lang: [self.contexts(np.frombuffer(t, np.uint8)) for t in samples[lang]] for lang in self.langs}
        n = len(self.langs)
        lower = np.full((1, size, n), 1.0 / size)
        nodes, tables, self.node = 0, [], None
        place = np.zeros(1, np.int64)  # of each context of the order before: its row in ``lower``
        rows_before = np.zeros(1, np.int64)
        for order in range(ORDER + 1):
            span = size**order
            pairs = {lang: np.unique(np.concatenate([(ctx % span) * size + sym for ctx, sym in seen[lang]] or [np.zeros(0, np.int64)]), return_counts=True) for lang in self.langs}
            total: dict[int, int] | np.ndarray
            keys = np.concatenate([p[0] // size for p in pairs.values()] + [np.zeros(0, np.int64)])
            weight = np.concatenate([p[1] for p in pairs.values()] + [np.zeros(0, np.int64)])
            kept, back = np.unique(keys, return_inverse=True)
            if order == ORDER and len(kept) > FULL_CONTEXTS:
                total = np.bincount(back, weights=weight)
                kept = np.sort(kept[np.argsort(-total, kind="stable")[:FULL_CONTEXTS]])
            table = lower[rows_before[kept % max(1, span // size)]] if order else lower.copy()
            if not order:
                kept = np.zeros(1, np.int64)
            for k, lang in enumerate(self.langs):
                pair, count = pairs[lang]
                row = np.searchsorted(kept, pair // size)
                row[row == len(kept)] = 0
                ok = kept[row] == pair // size
                row, sym, count = row[ok], (pair % size)[ok], count[ok]
                whole = np.bincount(row, weights=count, minlength=len(kept))
                distinct = np.bincount(row, minlength=len(kept))
                with_escape = np.where(whole > 0, distinct / np.maximum(1, whole + distinct), 1.0)
                table[:, :, k] *= with_escape[:, None]
                table[row, sym, k] = count / (whole + distinct)[row]
            tables.append(table)
            where = np.full(span, -1, np.int64)
            where[kept] = nodes + np.arange(len(kept))
            # a context that the tree lacks is served by its longest suffix
            if order:
                shorter = np.tile(place, size)
                where = np.where(where < 0, shorter, where)
            place, rows_before, lower = where, np.zeros(span, np.int64), table
            rows_before[kept] = np.arange(len(kept))
            nodes += len(kept)
        self.node = place.astype(np.int32)
        self.cost = -np.log(np.concatenate(tables)).reshape(nodes * size, n).astype(np.float32)

    def contexts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the preceding bytes, and symbol, at every place of a text."""
        symbols = self.symbol[data]
        ctx = np.zeros(len(symbols), np.int64)
        for back in range(ORDER, 0, -1):
            ctx *= self.size
            ctx[back:] += symbols[:len(symbols) - back] if back <= len(symbols) else 0
        return ctx, symbols

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per language."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        ctx, symbols = self.contexts(data)
        for s in range(ORDER):  # the first bytes of a text have no bytes of the text before it
            at = (starts + s)[sizes > s]
            ctx[at] %= self.size**s
        out = np.zeros((len(texts), len(self.langs)))
        use = np.flatnonzero(sizes)
        for a in range(0, len(data), STEP):
            b = min(len(data), a + STEP)
            costs = self.cost[self.node[ctx[a:b]].astype(np.int64) * self.size + symbols[a:b]]
            first = np.searchsorted(starts[use], a, side="right") - 1
            last = np.searchsorted(starts[use], b, side="left")
            cuts = np.maximum(starts[use][first:last] - a, 0)
            out[use[first:last]] += np.add.reduceat(costs, cuts, axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The language of the shortest code (ties: the first by name) and its probability, all languages being equally likely before."""
        lengths = self.code_lengths(texts)
        lengths -= lengths.min(axis=1, keepdims=True)
        best = lengths.argmin(axis=1)
        return [self.langs[i] for i in best], 1.0 / np.exp(-lengths).sum(axis=1)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """Trees from about ``rows`` rows of each language, drawn by hash from the training fold; null without any."""
    text, lang = name(text_col), name(lang_col)
    usable = docs.where(training_fold(name(id_col)) & lang.isNotNull() & text.isNotNull() & F.length(text).between(1, SAMPLE_CHARS))
    usable = usable.select(lang.cast("string").alias("lang"), text.alias("text"), F.pmod(F.xxhash64(name(id_col), text), F.lit(1 << 30)).alias("draw"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    chance = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, rows / n) * (1 << 30)))])
    drawn = usable.where(F.col("draw") < chance[F.col("lang")]).limit(2 * rows * len(counts))
    samples: dict[str, list[bytes]] = {}
    for row in sorted(drawn.select("lang", "text").collect()):
        samples.setdefault(row["lang"], []).append(row["text"].encode())
    return Model(samples) if samples else None


def identified(docs: DataFrame, model: Model | None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row: ``row`` (as it was), ``text`` (null: empty), ``lang_pred``, ``score``."""
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(docs)
    rows = packed(docs, id_col, text_col).select("row", "text", F.col("text").rlike(r"\p{L}").alias("letters"))
    if model is None:
        return rows.select("row", "text", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_groups(batches, "text", 1_000_000):
            langs, scores = shared.value.predict([t.encode() for t in texts])
            letters = part.column("letters").to_pylist()
            langs = [lang if ok else "und" for lang, ok in zip(langs, letters)]
            scores = np.where(letters, scores, 0.0)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), pa.array(langs), pa.array(scores)], ["row", "text", "lang_pred", "score"])

    return rows.mapInArrow(run, schema(rows, ["row", "text"], "lang_pred string, score double"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32 of the id (as text) is no multiple of five, and
    from their text and non-null language only. ``und`` with score 0 where the
    text is null or has no letter, or where there was nothing to learn from.
    Rows with a null id are held out. An empty table gives an empty result.
    """
    model = learn(docs, id_col, text_col, lang_col, rows)
    found = identified(docs.select(name(id_col).alias("doc_id"), name(text_col).alias("text")), model)
    doc_id = F.col("row.columns.doc_id")
    return found.select(doc_id.alias("doc_id"), (~training_fold(doc_id)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is found with a probability of at least ``least``; ``und`` goes."""
    found = identified(docs, learn(docs, id_col, text_col, lang_col), text_col, id_col)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*restored(docs.columns, text_col, F.col("text")))
