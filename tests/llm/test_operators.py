"""The training-text operators against brute force on small, awkward tables."""
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tidemark.llm import bpe, exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, packing, queries, simhash, substring_dedup, toxicity
from tidemark.llm.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `key` string, `rid` int, `d.x` int"
LONG = " ".join(f"word{i % 97}x{i % 13}" for i in range(4000))
LINE = "  This Line is shared by MANY documents, all of them.\t"
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    None, "", " \n\t ", "one", "one two", "One  TWO", "a\n\n\nb", LONG, LONG, LONG + " end", LINE, LINE + "\nother", f"x\n{LINE.lower()}\ny", LINE + "\n" + LINE, LINE,
    LINE.upper(), f"start here {PASSAGE} stop", f"{PASSAGE}", f"begin {PASSAGE}\n{LINE}", "é è ü 漢字 🙂 don't  stop\r\n", "a" * 3000, "te " * 500, "!!! ??? 123", "one", "\x1c \x85 　x<|endoftext|>",
]


def rows_of(texts=TEXTS):
    out = [(i, t, "en" if i % 2 else None, "s", None, 1, "k", 2, 3) for i, t in enumerate(texts)]
    return out + [out[3], (None, "one", "en", None, 1, None, None, None, None), (4, "another text of the same id", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def low(i):
    return -1 if i is None else i


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def test_lines(docs):
    rows = [(r[0], (r[1] or "").split("\n")) for r in rows_of()]
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, lines in rows:
        for line in lines:
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(low(i))
    want = []
    for i, lines in rows:
        keep = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != low(i))]
        want.append((low(i), "\n".join(keep), len(lines), len(lines) - len(keep)))
    got = [(low(r["doc_id"]), r["kept"], r["n_lines"], r["n_dropped"]) for r in line_dedup.judged(docs).select("row.columns.doc_id", "kept", "n_lines", "n_dropped").collect()]
    assert sorted(got) == sorted(want) and sum(w[3] for w in want) > 4
    kept = line_dedup.drop_common_lines(docs)
    assert kept.columns == docs.columns and kept.count() == len(want) and kept.where("text is null").count() == 1


@pytest.mark.parametrize("hot", [8192, 0])
def test_passages(docs, hot, monkeypatch):
    if not hot:
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0)
    words = [(low(r[0]), (r[1] or "").encode().split()) for r in rows_of()]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    want = []
    for i, w in words:
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k:k + 13])] < i for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = [(low(r[0]), r[1], r[2], r[3]) for r in substring_dedup.judged(docs, slots_hot=hot).select("row.columns.doc_id", "n_words", "n_removed", "kept").collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 100


def test_one_repeated_word_fills_many_short_strings(spark, monkeypatch):
    texts = ["word " * 30_000, "word " * 30_000 + "end", "other " + "word " * 20, "word " * 12]
    packed = substring_dedup.Packed([" ".join(t.split()).encode() for t in texts], 13)
    assert packed.size.max() <= substring_dedup.STRING_WINDOWS
    assert [packed.size[packed.doc == i].sum() for i in range(4)] == [29_988, 29_989, 9, 0]
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1000)
    for hot in (4_000_000, 1000):  # gathered by minimiser, and as a hot slot by its bytes
        monkeypatch.setattr(substring_dedup, "HOT_BYTES", hot)
        monkeypatch.setattr(substring_dedup, "HOT_SHARE", 0)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        found = {r[0]: r[1:] for r in substring_dedup.judged(df).select("row.columns.doc_id", "n_words", "n_removed", "kept").collect()}
        assert found == {0: (30_000, 0, texts[0].strip()), 1: (30_001, 30_000, "end"), 2: (21, 20, "other"), 3: (12, 0, texts[3].strip())}


def test_buckets_end_between_minimisers(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 50)
    mini = [1, 1, 1, 2, 2, 3, 3, 3, 3, 9]
    rows = pa.table({"mini": mini, "string": pa.array([b"x" * 10] * len(mini))})
    for size in (1, 3, 100):
        found = [t["mini"].to_pylist() for t in substring_dedup.buckets(iter(rows.to_batches(max_chunksize=size)))]
        assert sum(found, []) == mini and all(not set(a) & set(b) for i, a in enumerate(found) for b in found[i + 1:])


def test_colliding_windows_are_told_apart():
    strings = b"a b\na c\na b"
    start, end = np.array([0, 4, 8]), np.array([3, 7, 11])
    found = substring_dedup.first_documents(strings, start, end, np.zeros(3, np.uint64), np.array([5, 1, 7]))
    assert found.tolist() == [5, 1, 5]


def brute_fingerprint(text):
    w = lowered(text or "").encode().split()
    shingles = [b" ".join(w[k:k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = rows_of()
    prints = [brute_fingerprint(r[1]) for r in rows]
    labels = list(range(len(rows)))
    for _ in rows:
        labels = [min(labels[j] for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(rows))]
    best = {}
    for lab, r in zip(labels, rows):
        if r[0] is not None:
            best[lab] = min(best.get(lab, 1 << 60), r[0])
    want = sorted((low(r[0]), f"{p:016x}", low(best.get(lab))) for r, p, lab in zip(rows, prints, labels))
    got = sorted((low(r[0]), r[1], low(r[2])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(labels))


@pytest.mark.parametrize("tile", [8192, 30])
def test_links_in_large_buckets(spark, tile):
    rng = np.random.default_rng(1)
    centre, values = int(rng.integers(1 << 62)), set()
    for _ in range(400):
        x = centre
        for bit in rng.integers(0, 64, rng.integers(0, 8)):
            x ^= 1 << int(bit)
        values.add(x)
    values = np.array(sorted(values), np.uint64)
    want = simhash.joined(np.arange(len(values)), *np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = dict(simhash.stars(simhash.links(frame, 3, tile)).collect())
    got = [roots.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(got, want.tolist()))) == len(set(got)) == len(set(want.tolist()))


@pytest.mark.parametrize("edges", [[], [(5, 1), (5, 1), (1, 6)], [(i, i + 1) for i in range(-20, 20)], [(4, 2), (4, 3), (9, 8), (8, 7), (3, 3), (30, 31)]])
def test_stars_end_at_the_smallest_node(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = simhash.stars(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted((n, r) for n, r in root.items() if n != r)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact(docs, bits):
    groups = {}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows_of()]
    for r, t in zip(rows_of(), norm):
        groups.setdefault(t, []).append(r[0])
    want = []
    for r, t in zip(rows_of(), norm):
        ids = [i for i in groups[t] if i is not None]
        want.append((low(r[0]), low(min(ids, default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, bits=bits).collect()
    assert sorted((low(r[0]), low(r[1]), r[2], r[4]) for r in got) == sorted(want)
    assert sum(r["kept"] for r in got) == len(groups)


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.Vocabulary(path).rank
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((low(r[0]), np.array(plain.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows_of())
    got = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path).collect()
    assert sorted((low(r[0]), bytes(r[1]), bytes(r[2])) for r in got) == want


def test_prefix_table_appends_and_edits():
    v = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    table = bpe.PrefixTable(v, b"")
    for part in (b" inter", b"national", b"ization", b"s of things"):
        table.append(part)
        assert table.ids() == v.merged(bytes(table.data))
    table.replace(3, 9, b"XYZ")
    assert table.data == b" inXYZional" + b"izations of things" and table.ids() == v.merged(bytes(table.data))


def test_fingerprints(docs, spark):
    got = {(low(r["doc_id"]), r["edited_sha256"]): r for r in fingerprints.edit_trial(docs.where("doc_id is null or doc_id not in (3, 4)")).collect()}
    rows = sorted((r[0], r[1] or "") for r in rows_of() if r[0] not in (None, 3, 4))
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).where("doc_id not in (3, 4)").collect()}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(text) and r["fingerprint"] == prints[i]
        assert (r["near_edited"] == 1.0) >= (edited == text) and (r["near_next"] == 1.0) >= (after == text)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (edited == text)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(got) == len(rows) + 1 and prints[7] == prints[8] and prints[7] != prints[9]


def test_languages(docs, spark):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language_id.identify(known).join(known.select("doc_id", "lang"), "doc_id").where("held_out and length(lang) = 2").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    odd = {low(r[0]): r for r in language_id.identify(docs).collect()}
    assert {odd[i]["lang_pred"] for i in (0, 1, 2, 22)} == {"und"} and odd[-1]["held_out"] and len(odd) == len(TEXTS) + 1
    held = {int(r[0]) for r in got[["doc_id"]].itertuples(index=False)}
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    kept = language_id.keep_identified(known)
    assert kept.columns == known.columns and kept.count() > 0.95 * known.count()


def test_code_lengths_are_those_of_the_tree():
    model = language_id.Model({"x": [b"abracadabra", b"abba"], "y": [b"zzz"]})
    counts = {}
    for t in (b"abracadabra", b"abba"):
        s = [0, 0, 0] + [int(v) for v in model.symbol[list(t)]]
        for i in range(3, len(s)):
            for k in range(4):
                counts.setdefault(tuple(s[i - k:i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - k:i])][s[i]] += 1

    def p(context, symbol):
        below = p(context[1:], symbol) if context else 1 / model.size
        seen = counts.get(context)
        if not seen:
            return below
        n, q = sum(seen.values()), len(seen)
        return seen[symbol] / (n + q) if symbol in seen else q / (n + q) * below

    for text in (b"abracadabra", b"zab", b"?"):
        s = [0, 0, 0] + [int(v) for v in model.symbol[list(text)]]
        want = -sum(np.log(p(tuple(s[i - 3:i]), s[i])) for i in range(3, len(s)))
        assert model.code_lengths([b"q", text])[1, 0] == pytest.approx(want, rel=1e-4)


def test_packing(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(docs, path, pattern=public_tokenizers.PATTERN).toPandas()
    slow = packing.tokenizer(path, None)([t or "" for t in TEXTS])
    for i, ids in enumerate(slow):
        if i not in (3, 4):
            pieces = got[got["doc_id"] == i].sort_values("piece")
            assert b"".join(pieces["ids"]) == ids + (2).to_bytes(4, "little")
            assert pieces["start"].tolist() == [0, *np.cumsum(pieces["length"])[:-1]] and (pieces["length"].iloc[1:] == 1024).all()
            assert [zlib.crc32(x) for x in pieces["ids"]] == pieces["ids_crc32"].tolist()
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 1024) + 1


def test_added_tokens_are_those_of_the_unmodified_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext |>", "plain", "", "é<|endoftext|>\u4e2d"]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert packing.tokenizer(path, public_tokenizers.PATTERN)(texts) == want == packing.tokenizer(path, None)(texts)
    assert (50256).to_bytes(4, "little") in want[0]


def test_layout_uses_every_piece_once():
    bins = np.random.default_rng(2).integers(0, 400, 1025)
    bins[0] = 0
    used = np.zeros(1025, np.int64)
    for lengths, times in packing.layout(bins, 1024):
        assert sum(lengths) <= 1024
        for v in lengths:
            used[v] += times
    assert (used == bins).all()
    total = int((bins * np.arange(1025)).sum())
    assert sum(t for _, t in packing.layout(bins, 1024)) <= 1.01 * -(-total // 1024) + 1


def test_toxicity(docs, spark):
    texts = [(i, f"{'you idiot ' if i % 4 == 0 else ''}some words {i} {LONG[i:i + 200]}") for i in range(400)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in texts] + [(5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(frame, labels).where("held_out").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got) and len(got) > 40
    odd = toxicity.score(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0


def test_pairs_say_what_terms_alone_do_not():
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for _ in range(800):
        a, b = rng.integers(0, 2, 2)
        texts.append(f"{'insults' if a else 'praises'} {'groupname' if b else 'nobodys'}")
        labels.append(int(a != b))
    m = toxicity.fit(texts, np.array(labels), epochs=60)
    assert ((m.scores(texts) >= 0.5) == np.array(labels, bool)).mean() > 0.95


def test_lm(docs, empty, spark):
    known = spark.read.parquet(f"{FOLDER}/documents.parquet")
    vocabulary, flat = lm_scoring.learn(known)
    got = lm_scoring.score(known, (vocabulary, flat)).toPandas()
    text = known.where(f"doc_id = {int(got['doc_id'][0])}").first()["text"]
    ids = vocabulary.ids(lm_scoring.words_of(text))
    assert got["n_tokens"][0] == len(text.split())
    net, one = lm_scoring.Network(flat), 0.0
    around = np.concatenate([[lm_scoring.PAD] * 2, ids, [lm_scoring.PAD] * 2])
    for i in range(2, len(ids) + 2):
        h = np.tanh(sum(net.tables[k][around[i + p]] for k, p in enumerate(lm_scoring.PLACES)))
        c, m = divmod(int(around[i]), lm_scoring.SIDE)
        first, second = h @ net.w1 + net.b1, np.tanh(h + net.c[c]) @ net.w2 + net.b2[c]
        one += first[c] - np.log(np.exp(first).sum()) + second[m] - np.log(np.exp(second).sum())
    assert got["log_likelihood"][0] == pytest.approx(one, rel=1e-3)
    _, counts = lm_scoring.vocabulary_of(lm_scoring.word_counts(known.select("text")))
    start = lm_scoring.score(known, (vocabulary, lm_scoring.first_weights(counts))).toPandas()
    assert got["log_likelihood"].sum() > start["log_likelihood"].sum()
    odd = {low(r["doc_id"]): r for r in lm_scoring.score(docs, (vocabulary, flat)).collect()}
    assert odd[0]["n_tokens"] == 0 == odd[0]["log_likelihood"] and odd[7]["n_tokens"] == 4000


def test_lm_trains_on_every_token(spark):
    """Words of the second class stand only at places 2 and 3 modulo 4."""
    text = " ".join(f"w{i // 4 * 2 + i % 2 + (32 if i % 4 > 1 else 0):03d}" for i in range(64))
    vocabulary, flat = lm_scoring.learn(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    start = lm_scoring.first_weights(lm_scoring.vocabulary_of(lm_scoring.word_counts(spark.createDataFrame([(text,)], "text string")))[1])
    changed = (lm_scoring.Network(flat).b2 != lm_scoring.Network(start).b2).any(axis=1)
    assert changed.tolist() == [True, True] + [False] * (lm_scoring.SIDE - 2)
    _, at, of = vocabulary.batch(["a b c d e", "", "f", "g h i j k l m", "n o"])
    for rounds in (1, 2, 4):
        assert sorted(np.concatenate([lm_scoring.targets(at, of, r, rounds) for r in range(rounds)]).tolist()) == at.tolist()


def test_one_step_of_the_network():
    """Against a loop over tokens and places."""
    rng = np.random.default_rng(3)
    ids, at, _ = lm_scoring.laid_out([rng.integers(0, lm_scoring.VOCABULARY, 40) % 70, rng.integers(0, 9, 7)])
    flat = lm_scoring.first_weights(np.ones(lm_scoring.VOCABULARY))
    net, old, dh = lm_scoring.Network(flat), lm_scoring.Network(flat), np.zeros((len(at), lm_scoring.HIDDEN))
    more_b2, more_tables = np.zeros_like(old.b2, float), np.zeros_like(old.tables, float)
    groups = ids[at] // lm_scoring.SIDE
    scale = 0.5 / np.sqrt(len(at))
    for i, place in enumerate(at):
        h = np.tanh(sum(old.tables[k][ids[place + p]] for k, p in enumerate(lm_scoring.PLACES)))
        c, m = divmod(int(ids[place]), lm_scoring.SIDE)
        g = np.tanh(h + old.c[c])
        e1, e2 = np.exp(h @ old.w1 + old.b1), np.exp(g @ old.w2 + old.b2[c])
        d1, d2 = -e1 / e1.sum(), -e2 / e2.sum()
        d1[c] += 1
        d2[m] += 1
        dh[i] = (d1 @ old.w1.T + (d2 @ old.w2.T) * (1 - g * g)) * (1 - h * h)
        more_b2[c] += scale * d2 / np.sqrt((groups == c).sum())
    for k, p in enumerate(lm_scoring.PLACES):
        for i, place in enumerate(at):
            more_tables[k][ids[place + p]] += scale * dh[i] / np.sqrt((ids[at + p] == ids[place + p]).sum())
    net.step(ids, at, 0.5)
    assert np.allclose(net.b2, old.b2 + more_b2, atol=1e-5) and np.allclose(net.tables, old.tables + more_tables, atol=1e-5)


def test_lm_encodes_rows_as_words_of_does(spark):
    """Blanks of all kinds, capitals, odd characters, null ids and texts, repeated rows, a text longer than a group."""
    texts = ["A b\tB\n\x0bc\x0c\rÄ ä", None, "", " \n ", "b b \u4e2d\x00 x", "long word " * 300_000, "b b \u4e2d\x00 x"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = {bytes(r["word"]): r["n"] for r in lm_scoring.words_table(docs).collect()}
    want = Counter(w for t in texts for w in lm_scoring.words_of(t or ""))
    assert counts == want
    head = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
    vocabulary = lm_scoring.Vocabulary([w for w, _ in head], [n for _, n in head], np.ones(lm_scoring.RARE))
    got = lm_scoring.encoded(lm_scoring.slim(docs, "doc_id", "text"), vocabulary).collect()
    assert len(got) == len(texts)
    for r in got:
        words = lm_scoring.words_of(texts[r["doc_id"] or 0] or "")
        assert np.frombuffer(r["ids"], "<u2").tolist() == vocabulary.ids(words).tolist() and r["n_tokens"] == len(words)
        assert {bytes(w): n for w, n in zip(r["rest"], r["times"])} == Counter(w for w in words if w not in dict(head))


@pytest.mark.parametrize("head", [1, 3, 5, 40])
def test_lm_head_of_words(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rows = [(f"w{i}".encode(), n) for i, n in enumerate([1, 1, 1, 7, 7, 900, 5, 1, 10**12, 8, 7])]
    got = lm_scoring.head_of(spark.createDataFrame(rows, "word binary, n long")).collect()
    assert sorted((-r["n"], bytes(r["word"])) for r in got) == sorted((-n, w) for w, n in rows)[:head]


@pytest.mark.parametrize("head", [lm_scoring.HEAD, lm_scoring.WORDS])
def test_lm_scores_words_within_buckets(spark, monkeypatch, head):
    """Two real words and a made-up one of one bucket differ by the log of their counts; shares of a bucket add up to one."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rare = [w for w in (f"rare{i}" for i in range(20_000)) if lm_scoring.bucket(w.encode()) == lm_scoring.WORDS][:3]
    text = " ".join([f"top{i} " * 9 for i in range(lm_scoring.WORDS)] + [rare[0]] * 5 + [rare[1]] * 2)
    known = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    words = lm_scoring.words_table(known)
    model = lm_scoring.learn(known, words=words)
    asked = spark.createDataFrame([(i, f"top1 top2 {w} top3") for i, w in enumerate(rare)] + [(None, f"{rare[0]} {rare[0]}"), (9, None), (9, None)], "doc_id long, text string")
    net = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.score(asked, model).collect()}
    got = lm_scoring.score(asked, model, words=words).collect()
    full = {r["doc_id"]: r["log_likelihood"] for r in got}
    assert len(got) == 6 and full[9] == 0
    assert [full[i] - net[i] for i in range(3)] == pytest.approx(np.log([5 / 8, 2 / 8, 1 / 8]).tolist())
    assert full[None] - net[None] == pytest.approx(2 * np.log(5 / 8))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, FOLDER).toPandas()[con.sql(ORACLES[name]).columns]
    assert sorted(map(str, want.itertuples(index=False, name=None))) == sorted(map(str, got.itertuples(index=False, name=None)))


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    frames = [
        line_dedup.drop_common_lines(empty), substring_dedup.drop_repeated_passages(empty), simhash.near_duplicates(empty), exact_dedup.exact_dedup(empty), lm_scoring.score(empty, lm_scoring.learn(empty)),
        bpe.encode(empty, path, public_tokenizers.PATTERN), fingerprints.edit_trial(empty), language_id.identify(empty), packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")), toxicity.score(empty, labels),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)


def test_pipeline(spark):
    out = QUERIES["pipeline"](spark, FOLDER).select("doc_id", "length", "sequence_id", "offset").toPandas()
    assert 0.8 * 190 < out["doc_id"].nunique() <= 200 and out.groupby("sequence_id")["length"].sum().max() <= 1024
