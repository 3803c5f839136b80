"""Order-dependent news steps against a plain double loop."""
import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import news as nw

START = datetime(2026, 1, 1)
WORDS = "alpha beta gamma delta guidance revenue margin outlook record".split()


def fixture(seed=5, events=3, per=40):
    rng, rows = random.Random(seed), []
    for e in range(events):
        base = [" ".join(rng.choices(WORDS, k=8)) for _ in range(6)]
        for i in range(per):
            title = rng.choice(base)
            if rng.random() < 0.5:
                title = title + " " + rng.choice(WORDS)
            rows.append((e, "E%d" % e, START + timedelta(days=9), e * 1000 + i, START + timedelta(days=8, minutes=17 * i), title, "sum",
                         "https://x/%d?a" % rng.randrange(30), "src%d" % rng.randrange(2), rng.choice([None, "id%d" % rng.randrange(25)]),
                         ["E%d" % e], 0.7, False))
    return rows


SCHEMA = ("event_id int, entity string, cutoff timestamp, article_id int, published_at timestamp, headline string, summary string, url string, "
          "source string, source_id string, entities array<string>, vendor_relevance double, material boolean")


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def keep_ranking(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[5], r[3])):
        url, sid = r[7].split("?")[0], (r[8], r[9])
        if any(k[7].split("?")[0] == url for k in kept) or (r[9] and any((k[8], k[9]) == sid for k in kept)):
            continue
        if any(abs((r[4] - k[4]).total_seconds()) <= 8 * 3600 and ratio(r[5], k[5]) >= 0.90 for k in kept[-40:]):
            continue
        kept.append(r)
    return kept


def keep_family(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[4], r[3])):
        if any(k[7].split("?")[0] == r[7].split("?")[0] for k in kept):
            continue
        if any(k[8] == r[8] and abs((r[4] - k[4]).total_seconds()) <= 3600 and ratio(r[5], k[5]) >= 0.92 for k in kept[-25:]):
            continue
        kept.append(r)
    return kept


@pytest.fixture(scope="module")
def rows():
    return fixture()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_event(rows, rule):
    return {r[3] for e in {x[0] for x in rows} for r in rule([x for x in rows if x[0] == e])}


def test_ranking_dedup(df, rows):
    got = {r["article_id"] for r in nw.dedup_ranking(df, "event_id", "cutoff", "entity").collect()}
    assert got == by_event(rows, keep_ranking) and len(got) < len(rows)


def test_family_dedup(df, rows):
    got = {r["article_id"] for r in nw.dedup_family(df, ["event_id"], "cutoff", "entity").collect()}
    assert got == by_event(rows, keep_family) and len(got) < len(rows)


def test_rank_and_novelty(df, rows):
    ready = nw.with_article_features(df)
    got = {r["article_id"]: r for r in nw.rank_news(ready, "event_id", "cutoff", "entity", F.array("entity"), 100).collect()}
    for e in {r[0] for r in rows}:
        seen = []
        for r in sorted(keep_ranking([x for x in rows if x[0] == e]), key=lambda r: r[4], reverse=True):
            worst = max([ratio(r[5], s) for s in seen], default=0.0)
            assert got[r[3]]["novelty"] == pytest.approx(max(0.0, min(1.0, 1 - 0.75 * worst)))
            seen.append(r[5])
    places = sorted((r["event_id"], r["place"], -r["priority_score"]) for r in got.values())
    assert places == sorted(places, key=lambda p: (p[0], p[2]))


def test_same_address_with_other_query_is_one_article(spark):
    a = (1, "A", START + timedelta(days=1), 1, START, "One title here", "", "https://x/a?1", "s", None, ["A"], None, False)
    b = (1, "A", START + timedelta(days=1), 2, START + timedelta(hours=20), "Something else entirely", "", "https://x/a?2", "s", None, ["A"], None, False)
    assert nw.dedup_ranking(spark.createDataFrame([a, b], SCHEMA), "event_id", "cutoff", "entity").count() == 1


def test_events_that_see_the_same_articles_share_one_scan(spark):
    from tidemark.operators import joins as jn

    rng = random.Random(8)
    articles = [(a, START + timedelta(hours=rng.randrange(200)), rng.choice("AB")) for a in range(25)]
    articles = [(a, at, at + timedelta(hours=a % 3), e) for a, at, e in articles]
    events = [(i, START + timedelta(minutes=rng.randrange(24 * 60 * 18)), rng.choice("AB")) for i in range(400)]
    events += [(i, at + timedelta(hours=rng.randrange(30)), e) for i, at, e in events[:5]] + [(None, *events[7][1:]), (500, START + timedelta(days=8), None)]
    # on the very edge of a window
    events += [(600 + i, articles[i][1] + timedelta(days=7), articles[i][3]) for i in range(5)] + [(700 + i, articles[i][2], articles[i][3]) for i in range(5)]
    queries = spark.createDataFrame(events, "event_id long, cutoff timestamp, entity string")
    records = spark.createDataFrame(articles, "article_id long, published_at timestamp, available_at timestamp, entity string")
    hits = lambda q: jn.interval_join(q, records, "entity", "cutoff", "published_at", "available_at", 7).groupBy("event_id").agg(F.sort_array(F.collect_list("article_id")).alias("seen"))
    asked, owners = jn.shared_windows(queries, records, "entity", "event_id", "cutoff", "published_at", "available_at", 7)
    rows = lambda df: {(r["event_id"], tuple(r["seen"])) for r in df.collect()}
    assert rows(jn.of_owner(owners, hits(asked), "event_id")) == rows(hits(queries))
    assert asked.count() <= 2 * len(articles) + 11


def test_news_context_ranks_once_for_events_that_follow_the_same(spark, df, monkeypatch):
    from tidemark.plans import assembly

    sizes, rank = [], nw.rank_news
    monkeypatch.setattr(nw, "rank_news", lambda hits, *a, **k: (sizes.append(hits.count()), rank(hits, *a, **k))[1])
    followed = spark.createDataFrame([(e, START + timedelta(days=9), "E0", r) for e in range(5) for r in assembly.RELATIONS], "event_id long, cutoff timestamp, entity string, relation string")
    news = df.where("event_id = 0").withColumns({"available_at": F.col("published_at"), "sentiment": F.lit(0.5)}).drop("event_id", "cutoff", "entity")
    block, signals, leaks = assembly.news_context(followed, news)
    assert sizes == [40]
    rows = {tuple(r)[1:] for r in block.collect()}
    assert len(rows) == 1 and block.count() == 5
    counts = {(r["company_articles"], r["peer_articles"], r["sector_articles"]) for r in signals.collect()}
    assert len(counts) == 1 and len(set(counts.pop())) == 1
    assert {r["leakage_violations"] for r in leaks.collect()} == {0}


def test_news_context_carries_no_text_to_the_events(spark, df, monkeypatch):
    from tidemark.operators import reasoning as rs
    from tidemark.plans import assembly

    seen, rank = [], nw.rank_news
    monkeypatch.setattr(nw, "rank_news", lambda hits, *a, **k: (seen.append(hits.columns), rank(hits, *a, **k))[1])
    followed = spark.createDataFrame([(1, START + timedelta(days=9), "E0", "company")], "event_id long, cutoff timestamp, entity string, relation string")
    text = F.concat(F.lit("strong growth and a lawsuit "), F.repeat(F.lit("weak "), F.col("article_id") % 2))
    news = df.where("event_id = 0").withColumns({"available_at": F.col("published_at"), "sentiment": (F.col("article_id") % 5 - 2) / 4, "summary": text}).drop("event_id", "cutoff", "entity")
    _, signals, _ = assembly.news_context(followed, news)
    assert seen and "summary" not in seen[0]
    kept = rank(nw.with_article_features(news.withColumns({"scan_key": F.lit("x"), "cutoff": F.lit(START + timedelta(days=9)), "entity": F.lit("E0")})),
                "scan_key", "cutoff", "entity", F.array("entity"), 10)
    scored = kept.withColumns(rs.article_scores(*map(F.col, ("headline", "summary", "sentiment", "source_quality", "relevance", "materiality"))))
    told = rs.news_signal(scored, ["scan_key"]).first()
    got = signals.first()
    assert got["company_signal"] == pytest.approx(told["news_signal"]) and told["news_signal"] != 0
    assert got["company_articles"] == told["n_articles"] and got["company_confidence"] == pytest.approx(told["confidence_sum"])


def test_matched_letters_are_those_of_difflib():
    import random
    from difflib import SequenceMatcher

    from tidemark.functions import python_text as pt

    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a", "b"), ("ab", "ba"), ("a" * 50, "a" * 70), ("x" * 3000, "x" * 199)]
    for letters in ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyz 0123456789é"):
        for _ in range(300):
            text = lambda most: "".join(rng.choices(letters, k=rng.randrange(most)))
            a, b = text(250), text(230)
            pairs += [(a, b), (a, a), (a, b[:40] + a[:60] + b[40:])]
    pairs += [(a + a[:200], b + b[20:] + a[:90]) for a, b in pairs[-600:]] + [("ab" * 2000, "ba" * 2000), ("q" + "ab" * 300, "ab" * 280 + "qz")]
    for a, b in pairs:
        want = SequenceMatcher(None, a, b)
        assert pt.title_ratio.__wrapped__(a, b) == want.ratio()
        size = sum(m.size for m in want.get_matching_blocks())
        assert pt.matched_by_places(a, b) == size
        if len(b) < pt.AUTOJUNK and a and b:
            assert pt.matched(a, b) == size


def test_articles_of_one_scan_stay_together(spark):
    """Articles that an event sees through several entities are compared with each other, in one move of the rows."""
    from datetime import datetime, timedelta

    at = datetime(2024, 3, 9)
    rows = [(e, f"E{i % 40}", at, i, at - timedelta(minutes=i), f"same words in {e}", None, f"http://a/{e}/{i}", "s", None) for e in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id int, entity string, cutoff timestamp, article_id int, published_at timestamp, headline string, summary string, url string, source string, source_id string")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    was = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("64", "false")):
        spark.conf.set(n, v)
    try:
        kept = nw.dedup_ranking(df, "event_id", "cutoff", "entity")
        assert sorted((r["event_id"], r["article_id"]) for r in kept.collect()) == [(e, 39) for e in range(6)]
        ready = df.withColumns({"entities": F.array("entity"), "vendor_relevance": F.lit(0.5), "materiality": F.lit(0.5), "source_quality": F.lit(0.5)})
        plan = nw.scored_news(ready, "event_id", "cutoff", "entity", F.array("entity"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        for n, v in zip(names, was):
            spark.conf.set(n, v)
