"""Sharding, spelling variants and collocations against brute force on small, awkward tables."""
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import collocations, corpus_queries, sharding, variants  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES
from tidemark.llm.tokens import Tokens, in_bloom, mixed, text_groups

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `shard_` int, `at` int, `curve` int, `range` string, `d.x` int, `word` string, `n` long, `id` long"
PROSE = "The quick-minded analysts reconsidered Überraschung. the quick-minded analysts reconsidered; the analysts,\tthe analysts \x0b the quick-minded"
TEXTS = [
    None, "", " \n\t ", "one", "a" * 3000, PROSE, PROSE, PROSE + " more", "reconsidered reconsidred recconsidered reconsidered", "straße × Ààÿabcde Āabcdefg",
    "x\x00y \x01\x02 x\x00y \x01\x02 x\x01y x\x00y \x01\x02", "\x1c\x85 te te te te. te te!te te", "漢字 🙂 漢字 🙂", "\n".join(["common words here", "common words there"] * 40), "Abcdefgh" * 20000, "Abcdefgh" * 20000,
]


def rows_of(texts=TEXTS):
    out = [(i, t, ["en", None, "de"][i % 3], "s" if i % 4 else None, None, 1, 2, 3, "r", 5, "w", 7, 8) for i, t in enumerate(texts)]
    blank = (None,) * 8
    return out + [out[3], out[5], (None, "one two", "und", None, 1, *blank), (4, "another text of the same id", None, None, None, *blank)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_steps_to_a_neighbour(spark, axes, bits):
    grid = spark.range(1 << bits * axes).select(*[F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)).alias(f"x{i}") for i in range(axes)])
    names = [f"x{i}" for i in range(axes)]
    found = [(r["place"], tuple(r[c] for c in names)) for r in sharding.hilbert(grid, names, bits, "place").collect()]
    found.sort()
    assert [p for p, _ in found] == list(range(1 << bits * axes))
    assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for (_, x), (_, y) in zip(found, found[1:]))
    for b in range(1, bits):  # every aligned part of the curve is a cube
        side = 1 << b
        for i in range(0, len(found), side**axes):
            block = [p for _, p in found[i:i + side**axes]]
            assert len({tuple(v // side for v in p) for p in block}) == 1


@pytest.mark.parametrize("law", ["bytes", "rows"])
@pytest.mark.parametrize("shards", [3, 8])
def test_shards(docs, law, shards):
    rows = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["grown_shard"], r["law"]) for r in sharding.shard(docs, law=law, shards=shards).collect()]
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows_of())
    assert Counter(r[:3] for r in rows) == want
    assert all(r[5] is None and r[6] == law for r in rows)
    held = defaultdict(list)
    for r in rows:
        held[r[3]].append(r)
    assert set(held) <= set(range(shards))
    for s in held.values():
        assert sorted(r[4] for r in s) == list(range(len(s)))
    if law == "rows":
        assert max(map(len, held.values())) - min(map(len, held.values())) <= 1
    else:  # cut where the running total passes a shard's share
        total, before = sum(r[1] for r in rows), 0
        for r in sorted(rows, key=lambda r: (r[3], r[4])):
            assert r[3] == before * shards // total
            before += r[1]


def test_shards_are_pruned_by_any_dimension(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    path = str(tmp_path / "out")
    manifest = sharding.write_shards(docs, path)
    back = spark.read.parquet(f"{path}/shards").drop("shard")
    assert Counter(map(str, back.select(docs.columns).collect())) == Counter(map(str, docs.collect()))
    assert manifest.agg(F.sum("n_rows")).first()[0] == docs.count()
    for i, (low, high) in {0: ("de", "de"), 3: (0, 20)}.items():
        column = ["lang", "source", None, "doc_id"][i]
        some = sharding.read_shards(spark, path, {i: (low, high)})
        inside = F.col(column).between(low, high)
        assert some.where(inside).count() == docs.where(inside).count()
        assert some.select("shard").distinct().count() < 8
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), path + "2")
    with pytest.raises(ValueError):
        sharding.shard(docs, law="key")


def test_equal_cells_are_cut_like_any_other(spark):
    rows = spark.range(4000).select("id", F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("doc_id"))
    found = sharding.shard(rows.drop("id"), law="rows").groupBy("shard").count().collect()
    assert {r[1] for r in found} == {500}


def test_bloom_filters_forget_nothing():
    rng = np.random.default_rng(3)
    h = mixed(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64))
    from tidemark.llm.tokens import bloom_bits, bloom_block
    filter_ = np.zeros(50_000 // 4, np.uint64)
    np.bitwise_or.at(filter_, bloom_block(h, len(filter_)), bloom_bits(h))
    assert in_bloom(filter_, h).all()
    assert in_bloom(filter_, mixed(rng.integers(0, 1 << 64, 50_000, dtype=np.uint64))).mean() < 0.02


def spelled(rows, every=31):
    words = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            words[variants.planted(run, h) if h % every == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def wanted_variants(words):
    out, forms = {}, {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        best = others[0] if others and -others[0][0] >= 10 * n else None
        forms[w] = best and best[1]
        out[w] = [best and best[1], None, n, len(others), best and -best[0]]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


LETTERS = [
    "abcdefgh " * 300, "abcdefg " * 25 + "abcdefghh " * 20 + "abcdefgx abcdefgx " + "bbcdefgh bbcdefgh " + "bbcdefg bbcdefg", "ABCDEFGH abcdefgx zbcdefgx zbcdefgx",
    "ààààààà àààààààà " * 3 + "àààáààà " * 40, "qwertyuiop " * 5 + "qwertyuio " * 60 + "qwertyui " * 700, "aaaaaaaaab " * 2 + "baaaaaaaaa " * 2,
]


@pytest.mark.parametrize("most_blocks", [variants.FILTER_BLOCKS, variants.LEAST_BLOCKS // 4])
def test_variants(spark, docs, empty, most_blocks):
    rows = rows_of(TEXTS + LETTERS)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = wanted_variants(spelled(rows))
    assert want["qwertyuiop"][:2] == ("qwertyuio", "qwertyui")
    assert found_variants(variants.variants(df, most_blocks=most_blocks)) == want
    assert variants.variants(empty).count() == 0


def test_variants_of_many_small_words(spark):
    rng = np.random.default_rng(5)
    text = [" ".join("".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(3000)) for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {}
    words = Counter()
    for i, t in rows:
        for w in t.split():
            h = zlib.crc32(f"{i}:{w}".encode())
            words[variants.planted(w, h) if h % 31 == 0 else w] += 1
    words = {w: n for w, n in words.items() if len(w) >= 4 and n >= 2}
    want = wanted_variants(words)
    assert found_variants(variants.variants(df, least_letters=4)) == want


def test_hash_ranges_cover_a_large_length(spark):
    served = variants.rounds({7: 10_000_000, 8: 5, 70: 3}, 1 << 20)
    parts = [r.shards[7][2:] for r in served if 7 in r.shards]
    assert parts == [(p, len(parts)) for p in range(len(parts))] and len(parts) > 1
    assert all(r.blocks <= 1 << 20 for r in served) and {c for r in served for c in r.shards} == {7, 8, 70}
    for length in (7, 63, 64, 65, 127, 128, 70_000):
        assert spark.range(1).select(variants.length_class(F.lit(length))).first()[0] == variants.class_of(length)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def wanted_collocations(rows, least, top=2000, depth=5):
    counts, total = defaultdict(Counter), Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(r[1] or "")):
            words = re.findall("[^\x20\x09]+", piece)
            lang = "und" if r[2] is None else r[2]
            total[lang] += len(words)
            for d in range(1, depth + 1):
                counts[lang].update(tuple(words[i:i + d]) for i in range(len(words) - d + 1))
    out = []
    for lang, f in counts.items():
        n, found = total[lang], []
        frequent = [p for p in f if 2 <= len(p) and f[p] >= least]
        for p in frequent:
            if any(len(q) > len(p) and f[q] >= f[p] and any(q[i:i + len(p)] == p for i in range(len(q))) for q in frequent):
                continue
            score, k = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def found_collocations(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least", [1, 2, 5])
def test_collocations(docs, empty, least):
    rows = [r for r in rows_of() if r[1] is None or len(r[1]) < 5000]
    short = docs.where(F.col("text").isNull() | (F.length("text") < 5000))
    assert found_collocations(collocations.collocations(short, least=least)) == wanted_collocations(rows, least)
    assert collocations.collocations(empty, least=least).count() == 0


def test_collocations_with_extended_prefixes_and_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(9)
    vocabulary = ["the", "of"] * 12 + [f"w{i}" for i in range(30)]
    texts = [". ".join(" ".join(rng.choice(vocabulary, 12)) + " the of the of the of the" for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en" if i % 5 else None) for i, t in enumerate(texts)]
    monkeypatch.setattr(collocations, "LEAST_BUDGET", 20)
    monkeypatch.setattr(collocations, "TASK_SUFFIXES", 500)
    monkeypatch.setattr(collocations, "WORD_SHARE", 40)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    want = wanted_collocations(rows, 10, top=50)
    assert found_collocations(collocations.collocations(df, least=10, top=50)) == want
    one = df.coalesce(1)
    assert found_collocations(collocations.collocations(one, least=10, top=50)) == want


def test_the_open_path_goes_on_over_batches():
    rows = sorted(("en" if i % 3 else "de", "\x00".join("abc"[(i >> 2 * k) % 3] for k in range(1 + i % 5))) for i in range(2000))
    merged = sorted(Counter(rows).items())
    want = Counter()
    for (lang, s), n in merged:
        words = s.split("\x00")
        for d in range(2, len(words) + 1):
            want[lang, "\x00".join(words[:d])] += n
    for step in (1, 2, 7, 10_000):
        path, got = collocations.OpenPath(5, 1), []
        for i in range(0, len(merged), step):
            some = merged[i:i + step]
            got.append(path.walk(pa.array([k[0] for k, _ in some]), pa.array([k[1] for k, _ in some]), np.ones(len(some), np.int64), np.array([n for _, n in some])))
        got.append(path.close())
        found = [tuple(r.values()) for b in got for r in b.to_pylist()]
        assert len(found) == len(set(f[:2] for f in found)) and {f[:2]: f[2] for f in found} == dict(want)


def test_ranges_cut_anywhere_add_up():
    """A prefix too large for a task goes on in the next range; its parts add up though each is rare."""
    rng = np.random.default_rng(4)
    rows = Counter(("en" if rng.random() < 0.6 else "de", "\x00".join(rng.choice(list("aaab"), 1 + rng.integers(5)))) for _ in range(3000))
    merged = sorted(rows.items())
    want = Counter()
    for (lang, s), n in merged:
        words = s.split("\x00")
        for d in range(2, len(words) + 1):
            want[lang, "\x00".join(words[:d])] += n
    for size in (1, 3, 10, 10_000):
        got, given = Counter(), []
        for i in range(0, len(merged), size):
            some = merged[i:i + size]
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some]), pa.array([k[1] for k, _ in some]), pa.array([n for _, n in some])], ["lang", "suffix", "n"])
            parts = [r for b in collocations.subtrees(5, 40)(iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
            assert len(parts) == len({(r["lang"], r["phrase"]) for r in parts}) and sum(r["f"] < 40 for r in parts) <= 8
            given += parts
        for r in given:
            got[r["lang"], r["phrase"]] += r["f"]
        assert {k: f for k, f in got.items() if f >= 40} == {k: f for k, f in want.items() if f >= 40}


def test_long_texts_are_cut_only_between_words():
    text = "ab cd. ef gh! " * 50
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "x" * 500, ""])], ["text"])
    for characters in (10, 64, 10_000):
        parts, rows = [], []
        for some, _, at in text_groups(iter([batch]), "text", collocations.BETWEEN, characters):
            parts += some
            rows += at.tolist()
        assert [b"".join(p for p, r in zip(parts, rows) if r == i).decode() for i in range(4)] == [text, "", "x" * 500, ""]
        assert all(p[-1:] in b".!" or r != 0 or p == parts[rows.index(1) - 1] for p, r in zip(parts, rows))


def test_tokens():
    found = Tokens([b"A b  a", b"", b"b. c", b""], collocations.kinds(), collocations.LOWER)
    words = found.words.to_pylist()
    assert [words[c] for c in found.code] == [b"a", b"b", b"a", b"b", b"c"]
    assert found.doc.tolist() == [0, 0, 0, 2, 2]
    assert found.piece[0] == found.piece[2] != found.piece[3] != found.piece[4]


@pytest.mark.parametrize("name", ["op11_sharding", "op12_spelling_variants", "op13_phrase_collocations"])
def test_queries_agree_with_their_sql(spark, name):
    import oracle
    assert oracle.compare(name, QUERIES[name], ORACLES[name], spark, FOLDER, oracle.duck(FOLDER)).startswith("OK")
