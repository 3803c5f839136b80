"""Phrase collocations from range-partitioned suffix trees.

Every word of a piece starts a suffix, cut after five words: the paths of a
depth-truncated suffix tree. The tree is never built whole. Its sorted paths are
cut into ranges of near equal size, however many of them one prefix starts: each
task sorts its range (Spark spills where it must) and walks it with only the open
path in memory. A node's count is the total of the leaves below it. Only the nodes
on the first and the last path of a range can go on in its neighbours, so a task
gives at most ten counts that are parts, and these are added up.

Exact pruning keeps the tree small: a phrase is never more frequent than any
of its words or pairs of neighbours, so suffixes end before the first pair that
is too rare. Words, then pairs, are counted and the frequent ones marked in Bloom
filters of fixed size; what a filter lets through by mistake is counted in the
tree and then dropped for its count.
"""
from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import name, salted_join, written
from tidemark.llm.substring_dedup import Spans
from tidemark.llm.tokens import Tokens, batch_rows, bloom_bits, bloom_block, counted, gathered_blocks, in_bloom, mixed, text_groups
from tidemark.session import ship_package

BREAKS = b".,;:!?\n\x0b\x0c\r"
BETWEEN = re.compile("[.,;:!?\n\x0b\x0c\r]")
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: Between the words of a phrase: below every other character, so that a sorted subtree is one run.
SEP = "\x00"
#: 64-bit blocks of the filters of frequent words and pairs (8 MB each), whatever their number.
FILTER_BLOCKS = 1 << 20
#: Occurrences of a word beyond which the words behind it are counted in several tasks; at most MOST_SPLIT words are that frequent.
WORD_SHARE, MOST_SPLIT = 1_000_000, 1 << 16
#: Suffixes that a task should hold, and the most tasks.
TASK_SUFFIXES, MOST_TASKS = 1_000_000, 1 << 16
#: Parts of phrases with more than this share of all words are broadcast: fewer than so many of each length.
HOT_PARTS = 1024
#: Fewer suffixes are not worth a task of their own.
LEAST_BUDGET = 1_000


def kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[list(b" \t")] = 1
    kind[list(BREAKS)] = 2
    return kind


def escaped(words: pa.Array) -> pa.Array:
    """Words without the separator: the two lowest characters are written as two."""
    data = [w.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") for w in words.to_pylist()]
    return pa.array(data, pa.large_binary())


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, np.ndarray, list]]:
    """(tokens, language code of each token, languages) of groups of texts; words are escaped."""
    kind = kinds()
    for texts, batch, rows in text_groups(batches, "text", BETWEEN):
        found = Tokens(texts, kind, LOWER)
        if not len(found.code):
            continue
        if (found.data < 2).any():
            found.words = escaped(found.words)
        langs = batch.column("lang").take(pa.array(rows)).dictionary_encode()
        yield found, langs.indices.to_numpy()[found.doc].astype(np.int64), langs.dictionary


def text_of(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_string()).cast(pa.string())


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, f) of single words, and the empty phrase for all of them."""
    for found, lang, langs in groups(batches):
        at, n = counted(lang, found.code)
        total = np.bincount(lang, minlength=len(langs))
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([langs.take(pa.array(lang[at])), langs]), pa.concat_arrays([text_of(found.words.take(pa.array(found.code[at]))), pa.array([""] * len(langs))]),
            pa.array(np.concatenate([n, total]))], ["lang", "phrase", "f"])


def word_hash(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the bytes of words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[edges[0]:edges[-1]]
    return Spans(data).hash(edges[:-1] - edges[0], edges[1:] - edges[0])


def mark_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = word_hash(batch.column("phrase"))
        yield pa.RecordBatch.from_arrays([pa.array(bloom_block(h, FILTER_BLOCKS)), pa.array(bloom_bits(h).view(np.int64))], ["block", "bits"])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


def neighbours(found: Tokens, ok: np.ndarray) -> np.ndarray:
    """Places whose word and the next one of the same piece are both frequent."""
    return np.flatnonzero(ok[:-1] & ok[1:] & (found.piece[1:] == found.piece[:-1]))


def pair_blocks(words_sent, split_sent):
    """Rows (lang, word, part, nexts, counts): for a word of a group of texts the frequent words behind it, and how often.

    Words behind a very frequent word are dealt to ``part``s by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, split = words_sent.value, split_sent.value
        for found, lang, langs in groups(batches):
            h = word_hash(found.words)
            at = neighbours(found, in_bloom(frequent, h)[found.code])
            if not len(at):
                continue
            wide = len(found.words)
            one, n = counted(lang[at] * wide + found.code[at], found.code[at + 1])
            at = at[one]
            head, tail = lang[at] * wide + found.code[at], found.code[at + 1]
            kinds_, of = np.unique(head, return_inverse=True)
            names, spoken = text_of(found.words.take(pa.array(kinds_ % wide))), langs.take(pa.array(kinds_ // wide))
            parts = np.array([split.get(k, 1) for k in zip(spoken.to_pylist(), names.to_pylist())], np.uint64)[of]
            part = (h[tail] % parts).astype(np.int64)
            order = np.lexsort((part, of))
            of, part, tail, n = of[order], part[order], tail[order], n[order]
            heads = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
            edges = pa.array(np.append(heads, len(of)), pa.int32())
            nexts = pc.binary_join(pa.ListArray.from_arrays(edges, text_of(found.words.take(pa.array(tail)))), SEP)
            yield pa.RecordBatch.from_arrays([
                spoken.take(pa.array(of[heads])), names.take(pa.array(of[heads])), pa.array(part[heads]), nexts,
                pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))], ["lang", "word", "part", "nexts", "counts"])

    return run


def mark_pairs(least: int):
    """Rows (block, bits) of the pairs with enough occurrences, from sorted :func:`pair_blocks`; holds a batch and the last word's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def marks(words: pa.Array, nexts: pa.Array) -> pa.RecordBatch:
            h = pair_hash(word_hash(words), word_hash(nexts))
            return pa.RecordBatch.from_arrays([pa.array(bloom_block(h, FILTER_BLOCKS)), pa.array(bloom_bits(h).view(np.int64))], ["block", "bits"])

        for batch in batches:
            if not batch.num_rows:
                continue
            spoken, word, part = (batch.column(c) for c in ("lang", "word", "part"))
            code = [c.dictionary_encode().indices.to_numpy() for c in (spoken, word)] + [part.to_numpy()]
            key = np.cumsum(np.concatenate([[0], np.logical_or.reduce([c[1:] != c[:-1] for c in code])]))
            lists = pc.split_pattern(batch.column("nexts"), SEP)
            of, nexts, n = key[pc.list_parent_indices(lists).to_numpy()], lists.flatten(), batch.column("counts").flatten().to_numpy().astype(np.int64)
            words = word.take(pa.array(np.flatnonzero(np.diff(key, prepend=-1))))
            first, last = (tuple(c[i].as_py() for c in (spoken, word, part)) for i in (0, batch.num_rows - 1))
            if held and held[0] == first:
                of, n = np.concatenate([np.zeros(len(held[2]), np.int64), of]), np.concatenate([held[2], n])
                nexts = pa.concat_arrays([held[1], nexts])
            elif held:
                use = pa.array(held[2] >= least)
                yield marks(pa.array([held[0][1]] * int((held[2] >= least).sum()), pa.string()), held[1].filter(use))
            encoded = nexts.dictionary_encode()
            at, total = counted(of, encoded.indices.to_numpy(), weight=n)
            mine = of[at] == key[-1]
            held = (last, nexts.take(pa.array(at[mine])), total[mine])
            use = ~mine & (total >= least)
            yield marks(words.take(pa.array(of[at[use]])), nexts.take(pa.array(at[use])))
        if held:
            use = held[2] >= least
            yield marks(pa.array([held[0][1]] * int(use.sum()), pa.string()), held[1].filter(pa.array(use)))

    return run


def suffixes(words_sent, pairs_sent, depth: int):
    """Rows (lang, suffix, n): distinct suffixes of frequent pairs in a group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, paired = words_sent.value, pairs_sent.value
        for found, lang, langs in groups(batches):
            h = word_hash(found.words)
            n = len(found.code)
            near = neighbours(found, in_bloom(frequent, h)[found.code])
            near = near[in_bloom(paired, pair_hash(h[found.code[near]], h[found.code[near + 1]]))]
            if not len(near):
                continue
            goes_on = np.zeros(n, bool)
            goes_on[near] = True
            run_of = np.cumsum(np.concatenate([[True], ~goes_on[:-1]]))
            path = np.zeros((depth, len(near)), np.int64)  # 0: no word
            path[0] = found.code[near] + 1
            for d in range(1, depth):
                there = np.minimum(near + d, n - 1)
                path[d] = np.where((near + d < n) & (run_of[there] == run_of[near]), found.code[there] + 1, 0)
            lang = lang[near]
            wide = len(found.words) + 1
            keys = [lang * wide + path[0], *(path[d] * wide + (path[d + 1] if d + 1 < depth else 0) for d in range(1, depth, 2))]
            at, many = counted(*keys)
            path = path[:, at]
            words = found.words.cast(pa.large_string())
            text = words.take(pa.array(path[0] - 1))
            for d in range(1, depth):
                more = words.take(pa.array(path[d] - 1, mask=path[d] == 0))
                text = pc.binary_join_element_wise(text, more, pa.scalar(SEP, pa.large_string()), null_handling="skip")
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(lang[at])), text.cast(pa.string()), pa.array(many)], ["lang", "suffix", "n"])

    return run


def prefix(column: str, words: Column | int) -> Column:
    """The first words of a phrase (negative: the last)."""
    return F.call_function("substring_index", F.col(column), F.lit(SEP), F.lit(words))


class OpenPath:
    """Walks sorted suffixes and yields the nodes it has left; holds the open path only.

    Nodes on the first path of the walk, and those that are open at its end, may be parts and come whatever their count.
    """

    def __init__(self, depth: int, least: int):
        self.depth, self.least = depth, least
        self.path: list = []  # (words up to here, count, whether it is on the first path) of the open nodes, shallowest first
        self.key: tuple = ()

    def walk(self, lang: pa.Array, suffix: pa.Array, own: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = len(n)
        split = pc.split_pattern(suffix, SEP)
        size = pc.list_value_length(split).to_numpy()
        code = split.values.dictionary_encode().indices.to_numpy() if len(split.values) else np.zeros(0, np.int32)
        first = split.offsets.to_numpy()[:-1] - split.offsets.to_numpy()[0]
        same = np.zeros(rows, bool)
        spoken = lang.dictionary_encode().indices.to_numpy()
        same[1:] = spoken[1:] == spoken[:-1]
        first_walk = not self.key
        opened = self.key and self.key[0] == lang[0].as_py()
        kept: tuple = ([], [], [])
        words0 = split[0].as_py() if rows else []
        path, tail = [], split[rows - 1].as_py()
        for d in range(self.depth):
            has = size > d
            at = np.where(has, code[np.minimum(first + d, len(code) - 1)], -1)
            same = same & has
            same[1:] &= at[1:] == at[:-1]
            heads = np.flatnonzero(has & ~same)
            opened = opened and len(self.key) > d + 1 and len(words0) > d and self.key[d + 1] == words0[d]
            # rows without a word here belong to no node: they lie between runs
            starts = np.flatnonzero(~same)
            total = np.add.reduceat(n, starts)
            total, begin = total[has[starts]], starts[has[starts]]
            assert len(begin) == len(heads)
            carried = self.path[d] if d < len(self.path) else None
            edge = (begin == 0) & first_walk
            if carried and opened:
                total[0] += carried[1]
                edge[0] = carried[2]
            elif carried:
                self.leave(kept, d, *carried)
            if len(total) and has[rows - 1] and len(tail) > d:
                path.append(((lang[rows - 1].as_py(), SEP.join(tail[:d + 1]), int(own[rows - 1])), int(total[-1]), bool(edge[-1])))
                total, begin, edge = total[:-1], begin[:-1], edge[:-1]
            use = ((total >= self.least) | edge) & (own[begin] <= d + 1) & (d > 0)
            if use.any():
                at_rows = begin[use]
                kept[0].extend(lang.take(pa.array(at_rows)).to_pylist())
                kept[1].extend(SEP.join(x[:d + 1]) for x in split.take(pa.array(at_rows)).to_pylist())
                kept[2].extend(total[use].tolist())
        self.path, self.key = path, (lang[rows - 1].as_py(), *tail)
        return self.nodes(kept)

    def leave(self, kept: tuple, d: int, node: tuple, total: int, edge: bool) -> None:
        if d > 0 and (edge or total >= self.least) and node[2] <= d + 1:
            for column, value in zip(kept, (node[0], node[1], total)):
                column.append(value)

    def nodes(self, kept: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kept[0], pa.string()), pa.array(kept[1], pa.string()), pa.array(kept[2], pa.int64())], ["lang", "phrase", "f"])

    def close(self) -> pa.RecordBatch:
        kept: tuple = ([], [], [])
        for d, (node, total, _) in enumerate(self.path):
            self.leave(kept, d, node, total, True)
        return self.nodes(kept)


def subtrees(depth: int, least: int):
    """Rows (lang, phrase, f): nodes of two words or more of the subtrees of sorted (lang, suffix, n); those at the ends may be parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = OpenPath(depth, least)
        for batch in batches:
            if batch.num_rows:
                yield path.walk(batch.column("lang"), batch.column("suffix"), np.ones(batch.num_rows, np.int64), batch.column("n").to_numpy())
        yield path.close()

    return run


def filled(marks: DataFrame) -> np.ndarray:
    """The filter of (block, bits) rows."""
    filter_ = np.zeros(FILTER_BLOCKS, np.uint64)
    block, bits = gathered_blocks(marks)
    filter_[block] = bits
    return filter_


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = 5, least: int = 100) -> DataFrame:
    """(lang, phrase, f): all phrases of one to ``depth`` words with at least ``least`` occurrences, and the empty phrase with all words.

    Words are joined by ``SEP`` and escaped (:func:`plain` undoes both). A written table.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.coalesce(name(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(name(text_col), F.lit("")).alias("text"))
    with batch_rows(spark, 1000):
        single = texts.mapInArrow(count_words, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        single = written(single.where((F.col("f") >= least) | (F.col("phrase") == "")), "words")
    words = filled(single.where("phrase != ''").select("phrase").mapInArrow(mark_words, "block long, bits long"))
    words_sent = spark.sparkContext.broadcast(words)
    total = single.where("phrase = ''").agg(F.sum("f")).first()[0] or 0
    share = max(WORD_SHARE, total // MOST_SPLIT)
    split = single.where((F.col("phrase") != "") & (F.col("f") > share)).collect()  # at most MOST_SPLIT words
    split_sent = spark.sparkContext.broadcast({(r["lang"], r["phrase"]): -(-r["f"] // share) for r in split})
    with batch_rows(spark, 1000):
        blocks = texts.mapInArrow(pair_blocks(words_sent, split_sent), "lang string, word string, part long, nexts string, counts array<int>")
        blocks = blocks.repartition("lang", "word", "part").sortWithinPartitions("lang", "word", "part")
        marks = written(blocks.mapInArrow(mark_pairs(least), "block long, bits long"), "pairs")  # its shuffle files go before the suffixes come
        pairs_sent = spark.sparkContext.broadcast(filled(marks))
        table = written(texts.mapInArrow(suffixes(words_sent, pairs_sent, depth), "lang string, suffix string, n long"), "suffixes")
    rows = table.count()
    tasks = max(-(-rows // TASK_SUFFIXES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST_BUDGET))
    dealt = table.repartitionByRange(max(1, min(MOST_TASKS, tasks)), "lang", "suffix").sortWithinPartitions("lang", "suffix")
    with batch_rows(spark, 10_000):
        nodes = written(dealt.mapInArrow(subtrees(depth, least), "lang string, phrase string, f long"), "nodes")
    nodes = nodes.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    out = single.unionByName(nodes)
    for sent in (words_sent, split_sent, pairs_sent):
        sent.unpersist()
    return out


def with_part_counts(cuts: DataFrame, parts: DataFrame, whole: int, column: str, count: str) -> DataFrame:
    """``cuts`` with the count of the part in ``column``.

    A part occurs at least ``a`` times for each phrase that it begins (or ends), so
    only frequent parts can be hot keys. Of one length fewer than HOT_PARTS parts have
    more than a HOT_PARTS-th of all words: these are broadcast. Their cuts go through
    the join of the others under keys of their own, which match nothing.
    """
    often = F.broadcast(parts.where(F.col("f") * HOT_PARTS > whole).select("lang", F.col("phrase").alias(column), F.col("f").alias(count)))
    cuts = cuts.join(often, ["lang", column], "left")
    own = F.concat_ws(SEP, F.lit(""), "phrase", "k")  # no phrase begins with the separator
    cuts = cuts.withColumn("__part", F.when(F.col(count).isNull(), F.col(column)).otherwise(own))
    rest = parts.where(F.col("f") * HOT_PARTS <= whole).select("lang", F.col("phrase").alias("__part"), F.col("f").alias("__f"))
    cuts = cuts.join(rest, ["lang", "__part"], "left")
    return cuts.withColumn(count, F.coalesce(count, "__f")).drop("__part", "__f")


def plain(phrase: Column) -> Column:
    """A phrase with its words joined by one space, as they were."""
    joined = F.translate(phrase, SEP, " ")
    return F.when(F.contains(joined, F.lit("\x01")), F.replace(F.replace(joined, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))).otherwise(joined)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", depth: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """Per language its ``top`` phrases of 2 to ``depth`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?]``, line feed,
    vertical tab, form feed and carriage return, and those into words at blanks
    and tabs. ``a`` is the phrase's count within pieces, at least ``least``; of
    its cuts in two the one with the smallest floor(1000 a n / (l r)) counts
    (ties: the earliest), with the counts l and r of its parts and n of all
    words. A phrase inside a longer one that is as frequent goes. Order: score
    and a falling, phrase rising by its UTF-8 bytes. A null language is ``und``,
    null and empty texts have no words, repeated rows count as often as they
    occur, an empty table gives an empty result. Other columns are not read.
    """
    counts = phrase_counts(docs, text_col, lang_col, depth, least)
    sizes = counts.withColumn("d", F.length("phrase") - F.length(F.translate("phrase", SEP, "")) + 1)
    known = written(sizes, "phrases")
    totals = known.where("phrase = ''").select("lang", F.col("f").alias("n"))
    phrases = known.where("phrase != ''")
    longer = phrases.where("d >= 3")
    inner = longer.select("lang", F.explode(F.array(prefix("phrase", F.col("d") - 1), prefix("phrase", 1 - F.col("d")))).alias("phrase"), "f")
    inner = inner.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    alone = phrases.where("d >= 2").join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (F.col("around") < F.col("f")))
    cuts = alone.select("lang", "phrase", F.col("f").alias("a"), "d", F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": prefix("phrase", F.col("k")), "rest": prefix("phrase", F.col("k") - F.col("d"))})
    parts = phrases.where(F.col("d") < depth)
    by = F.struct("phrase", "k")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    cuts = with_part_counts(cuts, parts, whole, "head", "l")
    cuts = with_part_counts(cuts, parts, whole, "rest", "r")
    cuts = salted_join(cuts, totals, ["lang"], by)
    score = F.expr("(cast(1000 as decimal(4,0)) * (cast(a as decimal(19,0)) * cast(n as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    ranked = best.select("lang", plain(F.col("phrase")).alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within slices of a language, so that no task sorts a whole one
    some = ranked.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top)
    final = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return final.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
