"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from two tokens on either side: four
embedding tables are added up, one for each place, and a two-step softmax names
the token's class and the token within it. Corpus word counts give the
vocabulary and the first biases. Every token of all documents is a target of the
network once, each task trains on its own part of the documents, and the tasks'
weights are averaged between rounds. A
document's score is the sum of the conditional log-probabilities of its tokens.

Words beyond the most frequent ones share buckets in the network. Within its
bucket a word has the share of its corpus count, out of a table of all words of
the corpus: tasks hold the head of the table, a join in Spark brings the rest.

Texts are cut into words twice, to count them and to write the ids of their
tokens; training and scoring read the ids alone.
"""
from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, slim
from tidemark.llm.tokens import Tokens, counted
from tidemark.llm.words import in_groups
from tidemark.session import cut_lineage, ship_package

#: A token is one of the WORDS most frequent words, or one of the RARE buckets of all others.
SIDE = 32
VOCABULARY, RARE = SIDE * SIDE, 256
WORDS = VOCABULARY - RARE
#: The most frequent words, held by every task; the counts of all others are joined.
HEAD = 1 << 16
HIDDEN = 16
#: Places of the context, relative to the token.
PLACES = (-2, -1, 1, 2)
PAD = VOCABULARY
#: Every token is trained on in one of the rounds, by its place in its text modulo ROUNDS.
ROUNDS, BATCH, RATE = 2, 2048, 0.08
#: Weights travel in pieces of this many numbers, each added up in DEAL tasks.
PIECE, DEAL = 4096, 8
#: Bytes of text, or of ids, that are worked on at once.
GROUP = 2_000_000
#: Rows of a matrix product that the linear algebra library does in one thread: a task has one core.
ROWS = 256
#: Counts fall into this many steps for each factor of e when the head of the words is sought.
STEPS = 20

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in BLANKS]] = 1
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def words_of(text: str) -> list[bytes]:
    """Words between blanks, A-Z lower-cased."""
    return text.encode().lower().split()


def tokens_of(texts: list[str]) -> Tokens:
    """``words_of`` for a group of texts."""
    return Tokens([t.encode() for t in texts], _KIND, _LOWER)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over the whole corpus, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in in_groups(batches, "text", GROUP):
            t = tokens_of(texts)
            n = np.bincount(t.code, minlength=len(t.words))
            yield pa.RecordBatch.from_arrays([t.words.cast(pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

    found = rows.select("text").mapInArrow(run, "word binary, n long")
    return cut_lineage(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


def bucket(word: bytes) -> int:
    return WORDS + zlib.crc32(word) % RARE


class Vocabulary:
    """Tokens of words, and for words in a bucket their share of it.

    ``words`` are the head of the corpus's words, most frequent first, with their
    counts; ``rare`` are the counts of the buckets. Words that the corpus does
    not hold have, together, the share of one more occurrence in their bucket."""

    def __init__(self, words: list[bytes], times: list[int], rare: np.ndarray):
        self.words = pa.array(words, pa.large_binary())
        self.token = np.array([i if i < WORDS else bucket(w) for i, w in enumerate(words)], np.int64)
        self.log_rare = np.log(rare + 1.0)
        self.log_share = np.zeros(len(words))
        self.log_share[WORDS:] = np.log(np.array(times[WORDS:], float)) - self.log_rare[self.token[WORDS:] - WORDS]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return self.looked_up(words)[0]

    def looked_up(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids; log of each word's share of its token (0 for a word of its own, unset beyond the head); which words lie beyond the head."""
        place = pc.index_in(pa.array(words, pa.large_binary()) if isinstance(words, list) else words, self.words).fill_null(-1).to_numpy().astype(np.int64)
        beyond = np.flatnonzero(place < 0)
        found, share = np.zeros(len(words), np.int64), np.zeros(len(words))
        known = place >= 0
        found[known], share[known] = self.token[place[known]], self.log_share[place[known]]
        found[beyond] = [bucket(words[i]) for i in beyond.tolist()] if isinstance(words, list) else [bucket(w) for w in words.take(pa.array(beyond)).to_pylist()]
        return found, share, beyond

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``laid_out`` for the ids of texts."""
        return laid_out([self.ids(words_of(t)) for t in texts])


def laid_out(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with two pads around each; the places that hold tokens; the text of each."""
    sizes = np.array([len(x) for x in each], np.int64)
    ids = np.full(int(sizes.sum()) + 2 * len(each) + 2, PAD, np.int64)
    of = np.repeat(np.arange(len(each)), sizes)
    at = np.arange(len(of)) + 2 * (of + 1)
    if len(of):
        ids[at] = np.concatenate(each)
    return ids, at, of


def shapes() -> list[tuple[int, ...]]:
    return [(len(PLACES), VOCABULARY + 1, HIDDEN), (HIDDEN, SIDE), (SIDE,), (SIDE, HIDDEN), (HIDDEN, SIDE), (SIDE, SIDE)]


def unflatten(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes():
        n = int(np.prod(shape))
        out.append(flat[at:at + n].reshape(shape).copy())
        at += n
    return out


def first_weights(counts: np.ndarray, seed: int = 5) -> np.ndarray:
    """Small random weights; biases from the corpus frequencies of the tokens."""
    rng = np.random.default_rng(seed)
    share = (counts + 1.0).reshape(SIDE, SIDE)
    tables, w1, _, c, w2, _ = (rng.normal(0, 0.1, s) for s in shapes())
    tables[:, PAD] = 0
    b1 = np.log(share.sum(axis=1) / share.sum())
    b2 = np.log(share / share.sum(axis=1, keepdims=True))
    return np.concatenate([x.ravel() for x in (tables, w1, b1, c, w2, b2)]).astype(np.float32)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` by ROWS rows at a time."""
    n = len(a) // ROWS * ROWS
    whole = (a[:n].reshape(n // ROWS, ROWS, a.shape[1]) @ b).reshape(n, b.shape[1])
    return whole if n == len(a) else np.concatenate([whole, a[n:] @ b])


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` by ROWS rows at a time."""
    n = len(a) // ROWS * ROWS
    whole = (a[:n].reshape(n // ROWS, ROWS, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(n // ROWS, ROWS, b.shape[1])).sum(axis=0)
    return whole if n == len(a) else whole + a[n:].T @ b[n:]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    x /= x.sum(axis=1, keepdims=True)
    return x


def chosen(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at one place."""
    x = x - x.max(axis=1, keepdims=True)
    return x[np.arange(len(x)), at] - np.log(np.exp(x).sum(axis=1))


class Network:
    def __init__(self, flat: np.ndarray):
        self.tables, self.w1, self.b1, self.c, self.w2, self.b2 = unflatten(flat)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.tables, self.w1, self.b1, self.c, self.w2, self.b2)])

    def forward(self, ids: np.ndarray, at: np.ndarray):
        """Rows of the embedding tables (one table behind the other), hidden layers, classes, members, and the inputs of both softmaxes."""
        around = np.stack([ids[at + p] + k * (VOCABULARY + 1) for k, p in enumerate(PLACES)])
        rows = self.tables.reshape(-1, HIDDEN)
        h = np.tanh(sum(rows[i] for i in around))
        group, member = ids[at] // SIDE, ids[at] % SIDE
        g = np.tanh(h + self.c[group])
        return around, h, g, group, member, times(h, self.w1) + self.b1, times(g, self.w2) + self.b2[group]

    def log_probability(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(at), BATCH):
            _, _, _, group, member, first, second = self.forward(ids, at[i:i + BATCH])
            out.append(chosen(first, group) + chosen(second, member))
        return np.concatenate(out)

    def step(self, ids: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One step of gradient ascent on the mean log-probability of the tokens at ``at``."""
        around, h, g, group, member, first, second = self.forward(ids, at)
        rows, scale = np.arange(len(at)), np.float32(rate * len(at) ** -0.5)
        d1, d2 = -softmax(first), -softmax(second)
        d1[rows, group] += 1
        d2[rows, member] += 1
        dg = times(d2, self.w2.T) * (1 - g * g)
        dh = (times(d1, self.w1.T) + dg) * (1 - h * h)
        self.w1 += scale * crossed(h, d1) * np.float32(0.05)
        self.w2 += scale * crossed(g, d2) * np.float32(0.05)
        self.b1 += scale * d1.sum(axis=0) * np.float32(0.02)
        one = np.zeros((len(at), SIDE), np.float32)
        one[rows, group] = 1
        damped = scale * one / np.sqrt(np.maximum(one.sum(axis=0), 1))
        self.b2 += crossed(damped, d2)
        self.c += crossed(damped, dg)
        added(self.tables.reshape(-1, HIDDEN), around, dh, scale)


def added(table: np.ndarray, rows: np.ndarray, values: np.ndarray, scale: np.float32) -> None:
    """Add ``values`` to the rows that each line of ``rows`` names, damped where a row is named often."""
    flat = rows.ravel()
    sizes = np.bincount(flat, minlength=len(table))
    weight = np.float32(scale) / np.sqrt(np.maximum(sizes, 1)).astype(np.float32)
    for j in range(table.shape[1]):
        table[:, j] += weight * np.bincount(flat, np.tile(values[:, j], len(rows)), len(table)).astype(np.float32)


def head_of(counts: DataFrame) -> DataFrame:
    """The HEAD most frequent words, ties by bytes, as a written table.

    Steps of the logarithm of the counts, a thousand at most, tell below which
    count no such word lies, so only little more than the head is sorted."""
    step = F.floor(F.log(F.col("n").cast("double")) * STEPS).cast("int")
    left, least = HEAD, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most 44 * STEPS rows
        left, least = left - r["count"], r["step"]
        if left <= 0:
            break
    return cut_lineage(counts.where(step >= least).orderBy(F.desc("n"), "word").limit(HEAD), "head")


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The most frequent words (ties by bytes) and the corpus count of every token."""
    head = sorted(((bytes(r["word"]), r["n"]) for r in head_of(counts).collect()), key=lambda x: (-x[1], x[0]))  # HEAD rows
    top = head[:WORDS]
    out = np.zeros(VOCABULARY)
    out[:len(top)] = [n for _, n in top]
    for r in counts.groupBy(F.pmod(F.crc32("word"), F.lit(RARE)).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # RARE rows
        out[WORDS + r["bucket"]] = r["n"]
    for word, n in top:
        out[bucket(word)] -= n
    return Vocabulary([w for w, _ in head], [n for _, n in head], out[WORDS:]), out


def encoded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """One written row per row of (doc_id, text): n_tokens, ``ids`` of its tokens (unsigned, 16 bits), ``share``
    (sum of the log shares of its words of the head), ``rest`` and ``times`` (its words beyond the head, with their numbers)."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in in_groups(batches, "text", GROUP):
            t = tokens_of(texts)
            token, log_share, beyond = shared.value.looked_up(t.words)
            n = np.bincount(t.doc, minlength=len(texts))
            share = np.bincount(t.doc, log_share[t.code], len(texts)).astype(float)  # whole numbers if there is no token
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(2 * ends), pa.py_buffer(token[t.code].astype("<u2"))])
            far = np.zeros(len(token), bool)
            far[beyond] = True
            doc, code = t.doc[far[t.code]], t.code[far[t.code]]
            first, times = counted(doc, code)
            cuts = pa.array(np.searchsorted(doc[first], np.arange(len(texts) + 1)), pa.int32())
            rest = t.words.take(pa.array(code[first])).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), ids.cast(pa.binary()), pa.array(share), pa.ListArray.from_arrays(cuts, rest), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int64()))],
                ["doc_id", "n_tokens", "ids", "share", "rest", "times"])

    rows = rows.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut_lineage(rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, share double, rest array<binary>, times array<long>"), "token-ids")


def targets(at: np.ndarray, of: np.ndarray, shift: int, rounds: int) -> np.ndarray:
    """The places of round ``shift``: tokens whose place in their own text is ``shift`` modulo ``rounds``, however texts are grouped."""
    first = np.searchsorted(of, of)
    return at[(np.arange(len(of)) - first) % rounds == shift]


def read(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``laid_out`` for ids as ``encoded`` writes them."""
    return laid_out([np.frombuffer(x, "<u2") for x in ids])


def trained(rows: DataFrame, flat: np.ndarray, shift: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one round over ``encoded`` rows: the mean of the tasks' weights, by tokens trained on.

    Which texts a task holds, and so the weights, follow from the partitions of
    the input; the mean is rounded to 32 bits."""
    shared = rows.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen = Network(shared.value), 0
        for _, ids in in_groups(batches, "ids", GROUP):
            ids, at, of = read(ids)
            at = targets(at, of, shift, rounds)
            at = at[np.random.default_rng(len(at)).permutation(len(at))]
            for i in range(0, len(at), BATCH):
                net.step(ids, at[i:i + BATCH], RATE)
            seen += len(at)
        if seen:
            end = net.flat()
            pieces = [end[i:i + PIECE].astype(float) * seen for i in range(0, len(end), PIECE)]
            deal = TaskContext.get().partitionId() % DEAL
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([deal] * len(pieces), pa.int32()), pa.array(pieces, pa.list_(pa.float64())), pa.array([seen] * len(pieces), pa.int64())], ["piece", "deal", "weights", "seen"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            for piece, weights, n in zip(batch["piece"].to_pylist(), batch["weights"], batch["seen"].to_pylist()):
                total[piece] = total.get(piece, 0) + weights.values.to_numpy()
                seen[piece] = seen.get(piece, 0) + n
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())], ["piece", "weights", "seen"])

    made = rows.select("ids").mapInArrow(run, "piece int, deal int, weights array<double>, seen long")
    sums = made.repartition("piece", "deal").mapInArrow(add_up, "piece int, weights array<double>, seen long")
    out, weight = np.zeros(len(flat)), np.zeros(len(flat))
    for r in sums.collect():  # at most DEAL times as many numbers as the network has weights
        place = slice(r["piece"] * PIECE, r["piece"] * PIECE + len(r["weights"]))
        out[place] += r["weights"]
        weight[place] += r["seen"]
    return (out / weight).astype(np.float32) if weight.all() else flat


def words_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word_counts`` of a table of documents."""
    ship_package(docs.sparkSession)
    return word_counts(slim(docs, id_col, text_col))


def fitted(rows: DataFrame, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Weights from all ``encoded`` rows."""
    flat = first_weights(counts)
    for r in range(rounds):
        flat = trained(rows, flat, r, rounds)
    return flat


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, words: DataFrame | None = None) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and weights from all of ``docs``; ``words`` is their ``words_table``, if it is there already.

    Null and empty texts teach nothing, null ids and repeated rows are rows like
    any other, words of equal counts are taken by their bytes. An empty table
    leaves the first weights as they are."""
    ship_package(docs.sparkSession)
    rows = slim(docs, id_col, text_col)
    vocabulary, counts = vocabulary_of(word_counts(rows) if words is None else words)
    return vocabulary, fitted(encoded(rows, vocabulary), counts, rounds)


def learn_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``score`` of the documents under the model learned from them, with all texts encoded once."""
    ship_package(docs.sparkSession)
    rows = slim(docs, id_col, text_col)
    words = word_counts(rows)
    vocabulary, counts = vocabulary_of(words)
    ids = encoded(rows, vocabulary)
    return scored(ids, (vocabulary, fitted(ids, counts, rounds)), words)


def score(docs: DataFrame, model: tuple[Vocabulary, np.ndarray], id_col: str = "doc_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """One row per row: doc_id, n_tokens, log_likelihood (sum over tokens, natural log), mean_log_likelihood.

    ``words`` is the ``words_table`` that the model was learned from; with it the
    scores are those of the words themselves. Without it they are those of the
    network's tokens, where all words of a bucket are one. A null or empty text
    has no tokens and 0 in both scores; rows with a null id and repeated rows
    are scored each. An empty table gives an empty result."""
    ship_package(docs.sparkSession)
    return scored(encoded(slim(docs, id_col, text_col), model[0]), model, words)


def scored(rows: DataFrame, model: tuple[Vocabulary, np.ndarray], words: DataFrame | None) -> DataFrame:
    """``score`` for ``encoded`` rows."""
    shared, whole = rows.sparkSession.sparkContext.broadcast(model[1]), words is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for part, texts in in_groups(batches, "ids", GROUP):
            ids, at, of = read(texts)
            total = np.bincount(of, net.log_probability(ids, at), len(texts)).astype(float)
            if whole:
                total += part.column("share").to_numpy()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_tokens"), pa.array(total), *([part.column("row")] if whole else [])], ["doc_id", "n_tokens", "total", *["row"] * whole])

    kind = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    if not whole:
        made = rows.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, total double")
    else:
        made = numbered.select("doc_id", "n_tokens", "ids", "share", "row").mapInArrow(run, f"doc_id {kind}, n_tokens long, total double, row long")
        made = made.join(rest_of(numbered, words, model[0].log_rare), "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return made.select("doc_id", "n_tokens", F.col("total").alias("log_likelihood"), (F.col("total") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_likelihood"))


def rest_of(rows: DataFrame, words: DataFrame, log_rare: np.ndarray) -> DataFrame:
    """(row, more): log of the count of each word beyond the head (1 for all unseen words together) less that of its bucket, times its occurrences."""
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    of_bucket = F.array(*[F.lit(float(x)) for x in log_rare])[F.pmod(F.crc32("word"), F.lit(RARE)).cast("int")]
    return rest.join(words, "word", "left").groupBy("row").agg(F.sum(F.col("times") * (F.log(F.coalesce("n", F.lit(1)).cast("double")) - of_bucket)).alias("more"))
