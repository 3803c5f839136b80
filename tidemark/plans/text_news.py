"""Registered queries: statements, results, news and claims
(B12-B13, C07, D08-D10, D26, E11-E14, H01-H21, H24-H27, H29, H31, J01, K16)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import python_text as pt
from tidemark.functions import text as tx
from tidemark.operators import families as fam
from tidemark.operators import joins as jn
from tidemark.operators import news as nw
from tidemark.operators import reasoning as rs
from tidemark.plans.catalog import query, r6
from tidemark.session import ship_package, table

# A lexicon of words that do occur in the corpus; same shape as the financial one.
START, END = r"(^|[^A-Za-zÀ-ÿ])", r"([^A-Za-zÀ-ÿ]|$)"
FORWARD = START + "([Tt]hat|[Ww]ith|[Dd]ans|[Nn]icht|[Pp]ara)" + END
EARNINGS = START + "([Tt]he|[Uu]ne|[Dd]er|[Ll]os)" + END
QUANT = (START + "([Aa]nd|[Ee]t|[Uu]nd|[Yy])" + END, "[0-9]+ *%")
RAISED = "[Tt]he[^.!?]{0,45}[^A-Za-z](and|was)[^A-Za-z]"
LOWERED = "[Dd]e[^.!?]{0,45}[^A-Za-z](la|ou)[^A-Za-z]"
KEPT = "[Dd]er[^.!?]{0,45}[^A-Za-z](und|die)[^A-Za-z]"
CORPUS = tx.Lexicon(FORWARD, EARNINGS, QUANT, RAISED, LOWERED, KEPT)
UP, DOWN = ("the", "and", "la", "los"), ("de", "ein", "was")
TONE_UP, TONE_DOWN, TONE_NOT = (r"\bthe\b", r"\bla\b"), (r"\bde\b", r"\bof\b"), r"\b(?:and|et)\b"
TOPICS = (("first", ("ther", "ment")), ("second", ("keit", "ción")), ("third", ("the", "que")))


def facts(spark, d) -> DataFrame:
    """Documents as disclosures: every line of the whole text is one fact."""
    return table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("facts"), "text")


def fact_rows(spark, d) -> DataFrame:
    return facts(spark, d).select("doc_id", F.posexplode("facts").alias("pos", "fact")).withColumn("pos", F.col("pos").cast("bigint"))


FACT_SQL = """fact AS (SELECT doc_id, CAST(generate_subscripts(f, 1) - 1 AS BIGINT) AS pos, unnest(f) AS fact
  FROM (SELECT doc_id, string_split(text, chr(10)) AS f FROM documents))"""
Q_SQL = " OR ".join(f"regexp_matches(fact, '{p}')" for p in QUANT)
FLAG_SQL = FACT_SQL + f""", fl AS (SELECT doc_id, pos, fact, regexp_matches(fact, '{FORWARD}') AS forward,
  regexp_matches(fact, '{EARNINGS}') AS earnings, {Q_SQL} AS quantitative FROM fact)"""


@query("h01_forward_looking", f"WITH {FLAG_SQL} SELECT doc_id, pos, forward FROM fl")
def h01(spark, d):
    return fact_rows(spark, d).select("doc_id", "pos", tx.statement_flags(F.col("fact"), CORPUS)["forward"].alias("forward"))


@query("h02_earnings_related", f"WITH {FLAG_SQL} SELECT doc_id, pos, earnings FROM fl")
def h02(spark, d):
    return fact_rows(spark, d).select("doc_id", "pos", tx.statement_flags(F.col("fact"), CORPUS)["earnings"].alias("earnings"))


@query("h03_quantitative", f"WITH {FLAG_SQL} SELECT doc_id, pos, quantitative FROM fl")
def h03(spark, d):
    return fact_rows(spark, d).select("doc_id", "pos", tx.statement_flags(F.col("fact"), CORPUS)["quantitative"].alias("quantitative"))


@query("h04_statement_category", f"""WITH {FLAG_SQL} SELECT doc_id, pos, CASE WHEN forward THEN
  (CASE WHEN quantitative THEN 'quantitative' ELSE 'nonquantitative' END) || (CASE WHEN earnings THEN '_earnings' ELSE '_non_earnings' END) END AS category FROM fl""")
def h04(spark, d):
    return fact_rows(spark, d).select(
        "doc_id", "pos", tx.statement_category(*tx.statement_flags(F.col("fact"), CORPUS).values()).alias("category"))


@query("h05_directional_score")
def h05(spark, d):
    """Needs match offsets; tested against brute force on fixtures."""
    ship_package(spark)
    score = pt.direction_score(TONE_UP, TONE_DOWN, TONE_NOT)
    return facts(spark, d).select("doc_id", F.posexplode(score(F.col("facts"))).alias("pos", "tone")).groupBy("doc_id").agg(
        F.count(F.when(F.col("tone") > 0, 1)).alias("positive"), F.count(F.when(F.col("tone") < 0, 1)).alias("negative"))


@query("h06_guidance_language", f"""SELECT doc_id, CAST(CAST(regexp_matches(j, '{RAISED}') AS INT) AS DOUBLE) AS guidance_raised,
  CAST(CAST(regexp_matches(j, '{LOWERED}') AS INT) AS DOUBLE) AS guidance_lowered, CAST(CAST(regexp_matches(j, '{KEPT}') AS INT) AS DOUBLE) AS guidance_maintained,
  CASE WHEN regexp_matches(j, '{RAISED}') AND NOT regexp_matches(j, '{LOWERED}') THEN 1.0 WHEN regexp_matches(j, '{LOWERED}') AND NOT regexp_matches(j, '{RAISED}') THEN -1.0 ELSE 0.0 END::DOUBLE AS direction
FROM (SELECT doc_id, replace(text, chr(10), ' ') AS j FROM documents)""")
def h06(spark, d):
    flags = tx.guidance_flags(F.concat_ws(" ", "facts"), CORPUS)
    return facts(spark, d).withColumns(flags).select(
        "doc_id", *flags, tx.guidance_direction(F.col("guidance_raised"), F.col("guidance_lowered")).alias("direction"))


def _occ(word):
    return f"((length(low) - length(replace(low, '{word}', ''))) // {len(word)})"


@query("h07_substring_count", f"SELECT doc_id, CAST({_occ('the')} AS BIGINT) AS hits FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def h07(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.occurrences(F.lower("text"), "the").alias("hits"))


@query("d10_lexicon_features", f"""WITH b AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_facts, CAST(length(text) AS BIGINT) AS text_length,
  lower(replace(text, chr(10), ' ')) AS low FROM documents), c AS (SELECT *, CAST({' + '.join(map(_occ, UP))} AS BIGINT) AS positive_hits, CAST({' + '.join(map(_occ, DOWN))} AS BIGINT) AS negative_hits FROM b)
SELECT doc_id, n_facts, text_length, positive_hits, negative_hits, positive_hits - negative_hits AS net_sentiment, contains(low, 'tion') AS has_guidance_mention FROM c""")
def d10(spark, d):
    return facts(spark, d).select("doc_id", *[c.alias(n) for n, c in fam.lexicon_block(F.col("facts"), UP, DOWN, "tion").items()])


NO_TONE = [n for n in fv.FLS_FEATURES if n not in (
    "positive_forward_count", "negative_forward_count", "signed_forward_tone", "signed_fls_intensity",
    "signed_quant_earnings_intensity", "signed_other_fls_intensity")]
D09_PARTS = {
    "fls": "n", "earnings_fls": "e", "non_earnings_fls": "n - e", "quantitative_fls": "q", "non_quantitative_fls": "n - q",
    "quant_earnings_fls": "qe", "other_fls": "n - qe"}
D09_COLS = ", ".join([f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {k}_count, round(({x}) / t, 6) + 0.0 AS {k}_ratio" for k, x in D09_PARTS.items()] + [
    "round((q - qe) / t, 6) + 0.0 AS quant_non_earnings_ratio", "round((e - qe) / t, 6) + 0.0 AS nonquant_earnings_ratio",
    "round((n - qe) / (qe + 1.0), 6) + 0.0 AS other_to_quant_earnings_ratio", "gr AS guidance_raised", "gl AS guidance_lowered", "gm AS guidance_maintained",
    "gd AS guidance_direction", "round(n / t * gd, 6) + 0.0 AS guidance_fls_interaction", "round(qe / t * gd, 6) + 0.0 AS guidance_quant_earnings_interaction",
    "round((n - qe - qe) / t, 6) + 0.0 AS other_minus_quant_earnings"])


@query("d09_forward_looking_aggregates", f"""WITH {FLAG_SQL}, a AS (SELECT doc_id, CAST(count(*) AS DOUBLE) AS t, count(*) FILTER (WHERE forward) AS n,
  count(*) FILTER (WHERE forward AND earnings) AS e, count(*) FILTER (WHERE forward AND quantitative) AS q, count(*) FILTER (WHERE forward AND earnings AND quantitative) AS qe FROM fl GROUP BY doc_id),
g AS (SELECT doc_id, CAST(CAST(regexp_matches(j, '{RAISED}') AS INT) AS DOUBLE) AS gr, CAST(CAST(regexp_matches(j, '{LOWERED}') AS INT) AS DOUBLE) AS gl,
  CAST(CAST(regexp_matches(j, '{KEPT}') AS INT) AS DOUBLE) AS gm FROM (SELECT doc_id, replace(text, chr(10), ' ') AS j FROM documents)),
h AS (SELECT *, CASE WHEN gr > 0 AND gl = 0 THEN 1.0 WHEN gl > 0 AND gr = 0 THEN -1.0 ELSE 0.0 END::DOUBLE AS gd FROM a JOIN g USING (doc_id))
SELECT doc_id, {D09_COLS} FROM h""")
def d09(spark, d):
    return fam.with_fls(facts(spark, d), "facts", CORPUS, tones=False).select("doc_id", *NO_TONE)


@query("d09_tone_aggregates")
def d09_tone(spark, d):
    """The tone columns, whose score needs match offsets (see h05)."""
    ship_package(spark)
    scored = fam.with_fls(facts(spark, d), "facts", CORPUS, pt.direction_score(TONE_UP, TONE_DOWN, TONE_NOT))
    return scored.select("doc_id", *[n for n in fv.FLS_FEATURES if n not in NO_TONE])


# --------------------------------------------------------------------------
# claims derived from orders, so that the expected parse is plain arithmetic
# --------------------------------------------------------------------------
def claims(spark, d) -> DataFrame:
    """One disclosure claim per order, from eight templates and its key."""
    k = F.col("o_orderkey")
    a, b = (k % 97 + 1), (k % 89 + 1)
    num = lambda x: x.cast("string")
    c = F.concat
    L = F.lit
    text = (
        F.when(k % 8 == 0, c(L("EPS of $"), num(a), L(".25 vs. consensus $"), num(b), L(".50")))
        .when(k % 8 == 1, c(L("Revenue beat  consensus by "), num(a), L("%.")))
        .when(k % 8 == 2, c(L("Revenue missed analyst estimates by "), num(a), L(".5% in the period")))
        .when(k % 8 == 3, L("EPS was in line with consensus."))
        .when(k % 8 == 4, c(L("We raised our full-year outlook to "), num(a), L(" million units and expect growth.")))
        .when(k % 8 == 5, L("The company lowered its guidance amid headwinds we expect to persist."))
        .when(k % 8 == 6, c(L("Net sales of $"), num(a), L(" million versus expectations of $"), num(b), L(" million")))
        .otherwise(c(L("Revenue grew "), num(a), L("% year over year in 2024"))))
    return table(spark, d, "orders").select(k.alias("event_id"), F.col("o_custkey").alias("ticker"), text.alias("claim"))


CLAIM_SQL = """c AS (SELECT o_orderkey AS event_id, CAST(o_orderkey % 97 + 1 AS DOUBLE) AS a, CAST(o_orderkey % 89 + 1 AS DOUBLE) AS b, o_orderkey % 8 AS t FROM orders)"""


@query("h08_amount_tokens", f"""WITH {CLAIM_SQL} SELECT event_id, n, round(total, 6) + 0.0 AS total FROM (SELECT event_id,
  CAST(CASE t WHEN 0 THEN 2 WHEN 3 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 2 ELSE 1 END AS BIGINT) AS n,
  CASE t WHEN 0 THEN a + 0.25 + b + 0.5 WHEN 1 THEN a WHEN 2 THEN a + 0.5 WHEN 4 THEN a * 1000000 WHEN 6 THEN (a + b) * 1000000 WHEN 7 THEN a ELSE 0 END AS total FROM c)""")
def h08(spark, d):
    return claims(spark, d).withColumn("x", tx.amounts(F.col("claim"))).select(
        "event_id", F.size("x").cast("bigint").alias("n"), fam.array_sum(F.col("x")).alias("total"))


@query("h09_exact_pair", f"""WITH {CLAIM_SQL} SELECT event_id, round(CASE t WHEN 0 THEN a + 0.25 WHEN 6 THEN a * 1000000 END, 6) + 0.0 AS reported,
  round(CASE t WHEN 0 THEN b + 0.5 WHEN 6 THEN b * 1000000 END, 6) + 0.0 AS consensus FROM c""")
def h09(spark, d):
    return claims(spark, d).select("event_id", tx.exact_pair(tx.squeeze(F.col("claim"))).alias("p")).select("event_id", "p.reported", "p.consensus")


@query("h10_relative_pair", f"""WITH {CLAIM_SQL} SELECT event_id, round(CASE t WHEN 1 THEN 1 + a / 100 WHEN 2 THEN 1 - (a + 0.5) / 100 WHEN 3 THEN 1 END, 6) + 0.0 AS reported,
  CASE WHEN t IN (1, 2, 3) THEN 1.0 END::DOUBLE AS consensus FROM c""")
def h10(spark, d):
    return claims(spark, d).select("event_id", tx.relative_pair(tx.squeeze(F.col("claim"))).alias("p")).select("event_id", "p.reported", "p.consensus")


@query("h11_disclosure_results", """WITH c AS (SELECT o_custkey AS ticker, o_orderkey AS event_id, CAST(o_orderkey % 97 + 1 AS DOUBLE) AS a, CAST(o_orderkey % 89 + 1 AS DOUBLE) AS b, o_orderkey % 8 AS t FROM orders),
p AS (SELECT ticker, event_id, CASE t WHEN 0 THEN a + 0.25 WHEN 3 THEN 1 END AS re, CASE t WHEN 0 THEN b + 0.5 WHEN 3 THEN 1 END AS ce,
  CASE t WHEN 1 THEN 1 + a / 100 WHEN 2 THEN 1 - (a + 0.5) / 100 WHEN 6 THEN a * 1000000 END AS rr, CASE t WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 6 THEN b * 1000000 END AS cr,
  CASE t WHEN 4 THEN 'raised' WHEN 5 THEN 'lowered' END AS g FROM c)
SELECT ticker, round(arg_min(re, event_id) FILTER (WHERE re IS NOT NULL), 6) + 0.0 AS reported_eps, round(arg_min(ce, event_id) FILTER (WHERE re IS NOT NULL), 6) + 0.0 AS consensus_eps,
  round(arg_min(rr, event_id) FILTER (WHERE rr IS NOT NULL), 6) + 0.0 AS reported_revenue, round(arg_min(cr, event_id) FILTER (WHERE rr IS NOT NULL), 6) + 0.0 AS consensus_revenue,
  arg_min(g, event_id) FILTER (WHERE g IS NOT NULL) AS direction FROM p GROUP BY ticker""")
def h11(spark, d):
    """First matching claim per ticker and field; reduced map-side, so a ticker
    with any number of claims never sits in one task."""
    line = tx.squeeze(F.col("claim"))
    parsed = claims(spark, d).select("ticker", "event_id", tx.metric_pair(line, fv.EPS_LABEL).alias("e"),
                                     tx.metric_pair(line, fv.REVENUE_LABEL).alias("r"), tx.result_guidance(line).alias("g"))

    def first(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_id")))

    agg = parsed.groupBy("ticker").agg(first("e").alias("e"), first("r").alias("r"), first("g").alias("direction"))
    return agg.select("ticker", F.col("e.reported").alias("reported_eps"), F.col("e.consensus").alias("consensus_eps"),
                      F.col("r.reported").alias("reported_revenue"), F.col("r.consensus").alias("consensus_revenue"), "direction")


def claim_parts(spark, d) -> DataFrame:
    """Claims with their flags, tone and parsed results."""
    ship_package(spark)
    c = claims(spark, d).withColumn("line", tx.squeeze(F.col("claim")))
    c = c.withColumns({**tx.statement_flags(F.col("line")), **tx.line_labels(F.col("line"))})
    # pair and flags are columns of their own, so that none is worked out once per use
    c = c.withColumns({"pair": tx.labelled_pair(F.col("line"), F.col("on_eps"), F.col("on_revenue")), "guided": tx.result_guidance(F.col("line"))})
    tone = pt.line_direction()(F.when(F.col("forward"), F.col("line")))
    return c.withColumn("tone", tone).withColumn("parsed", tx.line_results(F.col("pair"), F.col("on_eps"), F.col("on_revenue"), F.col("guided")))


CONF_SQL = "CASE t WHEN 0 THEN 0.98 WHEN 1 THEN 0.98 WHEN 2 THEN 0.98 WHEN 3 THEN 0.25 WHEN 4 THEN 0.92 WHEN 5 THEN 0.92 WHEN 6 THEN 0.98 ELSE 0.25 END::DOUBLE"


def claim_confidence(parts: DataFrame):
    p = F.col("parsed")
    result = p["reported_eps"].isNotNull() | p["reported_revenue"].isNotNull()
    return tx.claim_confidence(F.col("line"), result, p["direction"].isNotNull(), F.col("forward"), F.col("tone"), F.col("quantitative"))


@query("h25_claim_confidence", f"WITH {CLAIM_SQL} SELECT event_id, {CONF_SQL} AS confidence FROM c")
def h25(spark, d):
    parts = claim_parts(spark, d)
    return parts.select("event_id", claim_confidence(parts).alias("confidence"))


DIR_SQL = """CASE t WHEN 0 THEN CAST(sign(a + 0.25 - b - 0.5) AS INT) WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 0 WHEN 4 THEN 1 WHEN 5 THEN -1 WHEN 6 THEN CAST(sign(a - b) AS INT) ELSE 0 END"""


def claim_direction():
    p = F.col("parsed")
    return tx.claim_direction(p["direction"], p["reported_eps"] - p["consensus_eps"],
                              p["reported_revenue"] - p["consensus_revenue"], F.col("tone"))


@query("h26_claim_direction", f"WITH {CLAIM_SQL} SELECT event_id, CAST({DIR_SQL} AS INTEGER) AS direction FROM c")
def h26(spark, d):
    return claim_parts(spark, d).select("event_id", claim_direction().cast("int").alias("direction"))


def claim_relevance(weights: dict[str, float]):
    """Share of model weight a claim can move, blended with feature coverage."""
    p = F.col("parsed")
    total = sum(abs(w) for w in weights.values()) or 1.0
    revenue = [n for n in fv.REVENUE_FEATURES[3:] if n != "revenue_surprise_zscore_company"]
    cross = fv.REVENUE_FEATURES[9:]

    def used(names):
        return [n for n in weights if n in names]

    groups = [(F.col("forward"), used(fv.FLS_FEATURES)), (p["reported_revenue"].isNotNull(), used(revenue)),
              (p["reported_eps"].isNotNull(), used(cross))]
    # the EPS group is inside the revenue group: count it only when revenue is absent
    active = [(groups[0][0], groups[0][1]), (groups[1][0], groups[1][1]), (groups[2][0] & ~groups[1][0], groups[2][1])]

    def summed(value):
        return sum([F.when(t, F.lit(float(value(ns)))).otherwise(0.0) for t, ns in active], F.lit(0.0))

    weight, count = summed(lambda ns: sum(abs(weights[n]) for n in ns)), summed(len)
    score = 0.65 * F.least(F.lit(1.0), weight / (0.25 * total)) + 0.35 * F.least(F.lit(1.0), count / len(weights) / 0.5)
    return F.when(count == 0, 0.05).otherwise(F.least(F.lit(1.0), score))


WEIGHTS = {n: (-1) ** i * (i + 1) / 1000.0 for i, n in enumerate(fv.FLS_FEATURES + fv.REVENUE_FEATURES[3:])}


def _weight_sql():
    total = sum(map(abs, WEIGHTS.values()))
    rev = [n for n in fv.REVENUE_FEATURES[3:] if n != "revenue_surprise_zscore_company"]

    def score(*groups):
        names = {n for g in groups for n in g}
        w, k = sum(abs(WEIGHTS[n]) for n in names), len(names)
        return 0.05 if not k else min(1.0, 0.65 * min(1.0, w / (0.25 * total)) + 0.35 * min(1.0, k / len(WEIGHTS) / 0.5))

    fls, cross = fv.FLS_FEATURES, fv.REVENUE_FEATURES[9:]
    by = {0: score(cross), 1: score(rev), 2: score(rev), 3: score(cross), 4: score(fls), 5: score(fls), 6: score(rev), 7: 0.05}
    return "CASE t " + " ".join(f"WHEN {t} THEN {round(s, 9)}" for t, s in by.items()) + " END"


@query("h27_claim_relevance", f"WITH {CLAIM_SQL} SELECT event_id, round(CAST({_weight_sql()} AS DOUBLE), 6) + 0.0 AS relevance FROM c")
def h27(spark, d):
    return claim_parts(spark, d).select("event_id", claim_relevance(WEIGHTS).alias("relevance"))


@query("k16_claim_diagnostics", f"""WITH {CLAIM_SQL} SELECT event_id, {CONF_SQL} AS confidence, CAST({DIR_SQL} AS INTEGER) AS direction, round(CAST({_weight_sql()} AS DOUBLE), 6) + 0.0 AS relevance,
  t IN (4, 5) AS forward_looking, CASE WHEN t = 4 THEN 'quantitative_non_earnings' WHEN t = 5 THEN 'nonquantitative_non_earnings' END AS category FROM c""")
def k16(spark, d):
    parts = claim_parts(spark, d)
    return parts.select(
        "event_id", claim_confidence(parts).alias("confidence"), claim_direction().cast("int").alias("direction"),
        claim_relevance(WEIGHTS).alias("relevance"), F.col("forward").alias("forward_looking"),
        tx.statement_category(F.col("forward"), F.col("earnings"), F.col("quantitative")).alias("category"))


@query("k17_claim_support", f"""WITH {CLAIM_SQL}, x AS (SELECT o_custkey AS ticker, {CONF_SQL} AS confidence, CAST({_weight_sql()} AS DOUBLE) AS relevance, t, CAST({DIR_SQL} AS INTEGER) AS direction FROM c JOIN orders ON o_orderkey = event_id)
SELECT ticker, count(*) AS claims, round(avg(confidence), 6) + 0.0 AS mean_claim_confidence, round(avg(relevance), 6) + 0.0 AS mean_claim_relevance,
  count(*) FILTER (WHERE t IN (4, 5)) AS forward_claims, count(*) FILTER (WHERE direction > 0) AS claims_up, count(*) FILTER (WHERE direction < 0) AS claims_down FROM x GROUP BY ticker""")
def k17_claims(spark, d):
    """What the claims of a disclosure say for its score: the claim half of the diagnostic summary, a ticker's orders being one disclosure."""
    parts = claim_parts(spark, d)
    told = parts.select("ticker", claim_confidence(parts).alias("confidence"), claim_relevance(WEIGHTS).alias("relevance"), "forward", claim_direction().alias("direction"))
    n = lambda test: F.count(F.when(test, 1))
    return told.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("claims"), F.avg("confidence").alias("mean_claim_confidence"), F.avg("relevance").alias("mean_claim_relevance"),
        n(F.col("forward")).alias("forward_claims"), n(F.col("direction") > 0).alias("claims_up"), n(F.col("direction") < 0).alias("claims_down"))


@query("h29_feature_family", "SELECT family, CAST(n AS BIGINT) AS n, k FROM (VALUES ('forward_looking', 30, (SELECT count(*) FROM events WHERE event_id % 46 < 30)), "
       "('revenue_results', 10, (SELECT count(*) FROM events WHERE event_id % 46 BETWEEN 30 AND 39)), ('other', 6, (SELECT count(*) FROM events WHERE event_id % 46 >= 40))) v(family, n, k)")
def h29(spark, d):
    """Families of the features that the events are assigned round-robin."""
    names = list(fv.FLS_FEATURES + fv.REVENUE_FEATURES[3:] + fv.PRICE_FEATURES[:6])
    picked = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    e = table(spark, d, "events").select(picked.alias("feature"))
    return e.groupBy(tx.feature_family(F.col("feature")).alias("family")).agg(
        F.countDistinct("feature").alias("n"), F.count(F.lit(1)).alias("k"))


# --------------------------------------------------------------------------
# text columns of news
# --------------------------------------------------------------------------
@query("b12_canonical_url", """SELECT page_id, lower(rtrim(split_part(url, '?', 1), '/')) AS canonical,
  trim(regexp_replace(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS title FROM pages""")
def b12(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("canonical"),
                                           tx.normalized_title(title).alias("title"))


@query("h12_topic", "SELECT doc_id, CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})' for t in ts)} THEN '{n}'" for n, ts in TOPICS) + " ELSE 'other' END AS topic FROM documents")
def h12(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.topic(F.col("text"), TOPICS).alias("topic"))


WORDS_UP, WORDS_DOWN = ("the", "and", "that"), ("of", "was", "are", "with")


def _present(words):
    return " + ".join(f"CAST(regexp_matches(low, '(^|[^\\pL\\pN_]){w}([^\\pL\\pN_]|$)') AS INT)" for w in words)


@query("h13_lexical_direction", f"""WITH b AS (SELECT doc_id, lower(text) AS low FROM documents), c AS (SELECT doc_id, {_present(WORDS_UP)} AS p, {_present(WORDS_DOWN)} AS n FROM b)
SELECT doc_id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / CAST(p + n AS DOUBLE) END, 6) + 0.0 AS direction FROM c""")
def h13(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.lexical_direction(F.col("text"), WORDS_UP, WORDS_DOWN).alias("direction"))


MATERIAL = ("ther", "ment", "keit", "worthless", "ción", "tion")


@query("h14_materiality", f"""SELECT doc_id, round(greatest(0, least(1, 0.30 + 0.16 * ({' + '.join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in MATERIAL)}
  + CASE WHEN quality = 1 THEN 2 ELSE 0 END))), 6) + 0.0 AS materiality FROM documents LEFT JOIN labels USING (doc_id)""")
def h14(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return doc.select("doc_id", tx.materiality(F.col("text"), F.col("quality") == 1, MATERIAL).alias("materiality"))


SRC_HIGH, SRC_MID, SRC_ISS = ("src1 ", "src7"), ("src2", "src3"), ("src9", "/fr/")


@query("h15_source_quality", """SELECT doc_id, CASE WHEN contains(s, 'src1 ') OR contains(s, 'src7') THEN 0.95 WHEN contains(s, 'src2') OR contains(s, 'src3') THEN 0.85
  WHEN contains(s, 'src9') OR contains(s, '/fr/') THEN 0.90 ELSE 0.60 END::DOUBLE AS quality FROM (SELECT doc_id, lower(source) || ' ' || coalesce(lower(url), '') AS s FROM documents LEFT JOIN pages ON page_id = doc_id)""")
def h15(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), "doc_id", "left")
    return doc.select("doc_id", tx.source_quality(F.col("source"), F.col("url"), SRC_HIGH, SRC_MID, SRC_ISS).alias("quality"))


@query("h18_source_id", "SELECT doc_id, substr(sha256(coalesce(url, '') || '|' || lang || '|' || text), 1, 24) AS source_id FROM documents LEFT JOIN pages ON page_id = doc_id")
def h18(spark, d):
    doc = table(spark, d, "documents").join(table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"), "doc_id", "left")
    return doc.select("doc_id", tx.source_id(F.col("url"), F.col("lang"), F.col("text")).alias("source_id"))


def provider_log(spark, d) -> DataFrame:
    """Provider messages derived from the event log."""
    k = F.col("event_id")
    secret = F.concat(F.lit("GET /v1?apikey="), F.col("user_id"), F.lit("&symbol=X"), F.col("event_type"))
    text = (F.when(k % 6 == 0, F.concat(secret, F.lit(" premium endpoint, invalid symbol")))
            .when(k % 6 == 1, F.concat(F.lit("Bearer abc."), k.cast("string"), F.lit(" symbol may be delisted")))
            .when(k % 6 == 2, F.concat(F.lit("upstream said "), F.repeat(F.lit("x"), (k % 500).cast("int"))))
            .when(k % 6 == 3, F.lit("   ")).when(k % 6 == 4, F.lit(None)).otherwise(F.lit("Subscription required")))
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500, 503, 403, 408))), (k % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", text.alias("message"), status.alias("status"))


LOG_SQL = """lg AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'GET /v1?apikey=' || user_id || '&symbol=X' || event_type || ' premium endpoint, invalid symbol'
  WHEN 1 THEN 'Bearer abc.' || event_id || ' symbol may be delisted' WHEN 2 THEN 'upstream said ' || repeat('x', CAST(event_id % 500 AS INT))
  WHEN 3 THEN '   ' WHEN 4 THEN NULL ELSE 'Subscription required' END AS message, [200, 404, 429, 500, 503, 403, 408][event_id % 7 + 1] AS status FROM events)"""


@query("h19_redaction", f"""WITH {LOG_SQL}, r AS (SELECT event_id, trim(regexp_replace(regexp_replace(message, '(?i)(apikey|api_key|token|key)=([^&\\s]+)', '\\1=<redacted>', 'g'),
  '(?i)(Bearer)\\s+([A-Za-z0-9._\\-]+)', '\\1=<redacted>', 'g')) AS m FROM lg)
SELECT event_id, nullif(CASE WHEN length(m) > 300 THEN substr(m, 1, 300) || '...' ELSE m END, '') AS stored FROM r""")
def h19(spark, d):
    return provider_log(spark, d).select("event_id", tx.redact(F.col("message")).alias("stored"))


@query("h20_message_class", f"""WITH {LOG_SQL} SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'entitlement' WHEN 5 THEN 'entitlement' WHEN 1 THEN 'unsupported_symbol' END AS kind,
  CASE WHEN status = 429 THEN 'rate_limit' WHEN status IN (408, 425, 500, 502, 503, 504) THEN 'transient' ELSE 'permanent' END AS status_kind FROM lg""")
def h20(spark, d):
    return provider_log(spark, d).select("event_id", tx.classify_message(F.col("message")).alias("kind"),
                                         tx.classify_status(F.col("status")).alias("status_kind"))


SECTORS = ("Technology", "Health Care", "US Financial Services", "Energy & Power", "Utilities")


@query("h21_sector_topic", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'technology' WHEN 1 THEN 'life_sciences' WHEN 2 THEN 'finance' WHEN 3 THEN 'energy_transportation' END AS topic FROM customer""")
def h21(spark, d):
    name = F.element_at(F.array(*map(F.lit, SECTORS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", tx.sector_topic(name).alias("topic"))


@query("h31_safe_key", """SELECT event_id, coalesce(nullif(regexp_replace(k, '[^A-Za-z0-9_-]', '', 'g'), ''), 'unknown') AS safe
FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '/::/' ELSE props || event_type || '/' || user_id || '..' END AS k FROM events)""")
def h31(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, "/::/").otherwise(
        F.concat("props", "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("..")))
    return table(spark, d, "events").select("event_id", tx.safe_key(raw).alias("safe"))


# --------------------------------------------------------------------------
# news joined to events
# --------------------------------------------------------------------------
def articles(spark, d) -> DataFrame:
    """Documents as news: the headline is the first line, the summary the text."""
    doc = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k * 2580)
    return doc.select(
        k.alias("article_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"), F.col("text").alias("summary"),
        at.alias("published_at"), (at + F.make_dt_interval(hours=(k % 3).cast("int"))).alias("available_at"), "source",
        F.array_distinct(F.array(F.upper("source"), F.concat(F.lit("SRC"), (k % 20).cast("string")))).alias("entities"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/a/"), F.floor(k / 2).cast("string"), F.lit("/?x="), k.cast("string")).alias("url"),
        F.when(k % 5 == 0, F.concat(F.lit("id"), F.floor(k / 10).cast("string"))).alias("source_id"),
        F.when(k % 4 != 0, (k % 21 - 10) / 10.0).alias("sentiment"), (F.col("quality") == 1).alias("material"),
        F.when(k % 3 != 0, (k % 10) / 10.0).alias("vendor_relevance"),
    )


def followed(spark, d) -> DataFrame:
    """Focal events with the entity they follow."""
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("cutoff"), F.concat(F.lit("SRC"), (F.col("user_id") % 20).cast("string")).alias("entity"))


NEWS_SQL = """art AS (SELECT doc_id AS article_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id * 2580 AS BIGINT)) AS published_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id * 2580 + (doc_id % 3) * 3600 AS BIGINT)) AS available_at, source,
  CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 21 - 10) / CAST(10 AS DOUBLE) END AS sentiment, coalesce(quality = 1, false) AS material,
  list_distinct([upper(source), 'SRC' || (doc_id % 20)]) AS entities, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 10) / CAST(10 AS DOUBLE) END AS vendor_relevance
  FROM documents LEFT JOIN labels USING (doc_id)),
ent AS (SELECT *, unnest(entities) AS entity FROM art), fol AS (SELECT event_id, ts AS cutoff, 'SRC' || (user_id % 20) AS entity FROM events),
hit AS (SELECT f.event_id, f.cutoff, e.* EXCLUDE (entity) FROM fol f JOIN ent e ON e.entity = f.entity AND e.published_at BETWEEN f.cutoff - INTERVAL 7 DAY AND f.cutoff AND e.available_at <= f.cutoff)"""


def shared_events(spark, d) -> tuple[DataFrame, DataFrame]:
    """The events to scan, one for all that see the same articles, and the event scanned in place of each."""
    seen = articles(spark, d).select("published_at", "available_at", F.explode("entities").alias("entity"))
    return jn.shared_windows(followed(spark, d), seen, "entity", "event_id", "cutoff", "published_at", "available_at", 7)


def news_hits(spark, d, *columns: str, art: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Articles in each event's seven-day window that name its entity."""
    art = articles(spark, d) if art is None else art
    if columns:
        art = art.select("article_id", "published_at", "available_at", "entities", *columns)
    tagged = art.withColumn("entity", F.explode("entities"))
    return jn.interval_join(followed(spark, d) if events is None else events, tagged, "entity", "cutoff", "published_at", "available_at", 7)


@query("c07_news_interval_join", f"WITH {NEWS_SQL} SELECT event_id, article_id FROM hit")
def c07(spark, d):
    return news_hits(spark, d).select("event_id", "article_id")


@query("b10_eligible_news_window", f"WITH {NEWS_SQL} SELECT event_id, count(*) AS n, min(article_id) AS first_article FROM hit GROUP BY event_id")
def b10(spark, d):
    return news_hits(spark, d).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("article_id").alias("first_article"))


@query("b13_entity_intersection", f"WITH {NEWS_SQL} SELECT article_id, len(list_intersect(entities, ['SRC1', 'SRC4', 'SRC7'])) > 0 AS overlaps FROM art")
def b13(spark, d):
    wanted = F.array(*map(F.lit, ("SRC1", "SRC4", "SRC7")))
    return articles(spark, d).select("article_id", F.arrays_overlap("entities", wanted).alias("overlaps"))


@query("h16_relevance", f"""WITH {NEWS_SQL}, x AS (SELECT article_id, vendor_relevance AS v, len(list_intersect(entities, ['SRC1', 'SRC4', 'SRC7'])) AS h FROM art),
b AS (SELECT *, coalesce(v, CASE WHEN h > 0 THEN 0.85 ELSE 0.10 END) AS base FROM x)
SELECT article_id, round(CASE WHEN h > 0 THEN greatest(base, least(1.0, 0.75 + 0.08 * h)) ELSE base END, 6) + 0.0 AS relevance FROM b""")
def h16(spark, d):
    wanted = F.array(*map(F.lit, ("src1", "SRC4", "src7")))
    return articles(spark, d).select("article_id", tx.relevance(F.col("entities"), wanted, F.col("vendor_relevance")).alias("relevance"))


D08_SQL = ", ".join(f"""CAST(count(*) FILTER (WHERE age <= 24 AND rel = '{r}') AS DOUBLE) AS {r}_news_count_24h, CAST(count(*) FILTER (WHERE rel = '{r}') AS DOUBLE) AS {r}_news_count_7d,
  round(coalesce(sum(greatest(sentiment, 0)) FILTER (WHERE rel = '{r}'), 0) / greatest(count(sentiment) FILTER (WHERE rel = '{r}'), 1), 6) + 0.0 AS {r}_positive_news_score,
  round(coalesce(sum(greatest(-sentiment, 0)) FILTER (WHERE rel = '{r}'), 0) / greatest(count(sentiment) FILTER (WHERE rel = '{r}'), 1), 6) + 0.0 AS {r}_negative_news_score,
  CASE WHEN bool_or(material AND rel = '{r}') THEN 1.0 ELSE 0.0 END::DOUBLE AS {r}_material_news_flag, CASE WHEN bool_or(rel = '{r}') THEN 1.0 ELSE 0.0 END::DOUBLE AS has_{r}_news"""
                    for r in ("company", "peer"))


@query("d08_news_block", f"""WITH {NEWS_SQL}, h AS (SELECT *, CASE WHEN upper(source) = (SELECT any_value('SRC' || (user_id % 20)) FROM events e WHERE e.event_id = hit.event_id) THEN 'company' ELSE 'peer' END AS rel,
  (epoch_us(cutoff) - epoch_us(published_at)) / CAST(3600000000 AS DOUBLE) AS age FROM hit) SELECT event_id, {D08_SQL} FROM h GROUP BY event_id""")
def d08(spark, d):
    hits = news_hits(spark, d, "source", "sentiment", "material").withColumn(
        "relation", F.when(F.upper("source") == F.col("entity"), "company").otherwise("peer"))
    events = hits.select("event_id").distinct()
    return nw.news_block(hits, events, "event_id", "cutoff", "relation", ["company", "peer"])


@query("e11_family_dedup")
def e11(spark, d):
    """Order-dependent; tested against brute force on fixtures."""
    asked, owners = shared_events(spark, d)
    hits = news_hits(spark, d, "headline", "url", "source", events=asked)
    kept = nw.dedup_family(hits, ["event_id"], "cutoff", "entity")
    found = kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"), F.max("article_id").alias("newest"))
    return jn.of_owner(owners, found, "event_id").select("event_id", "kept", "newest")


@query("e12_ranking_dedup")
def e12(spark, d):
    """Order-dependent; tested against brute force on fixtures."""
    asked, owners = shared_events(spark, d)
    hits = news_hits(spark, d, "headline", "url", "source", "source_id", events=asked)
    kept = nw.dedup_ranking(hits, "event_id", "cutoff", "entity")
    found = kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("kept"), F.max("article_id").alias("newest"))
    return jn.of_owner(owners, found, "event_id").select("event_id", "kept", "newest")


def ranked_news(spark, d, top_n: int = 10) -> DataFrame:
    art = nw.with_article_features(articles(spark, d), MATERIAL)
    asked, owners = shared_events(spark, d)
    hits = news_hits(spark, d, "headline", "url", "source", "source_id", "vendor_relevance", "materiality", "source_quality", art=art, events=asked)
    return nw.rank_shared(hits, owners, "event_id", "cutoff", "entity", F.array("entity"), top_n, True)


@query("e13_news_ranking")
def e13(spark, d):
    """Ranking with title novelty; tested against brute force on fixtures."""
    return ranked_news(spark, d).select("event_id", F.col("place").cast("bigint").alias("place"), "article_id", "priority_score")


@query("e14_novelty")
def e14(spark, d):
    """Novelty of the ranked articles; tested against brute force on fixtures."""
    return ranked_news(spark, d).groupBy("event_id").agg(F.avg("novelty").alias("mean_novelty"), F.min("novelty").alias("min_novelty"))


@query("h24_title_similarity")
def h24(spark, d):
    """Similarity of each article title to the one published just before it."""
    ship_package(spark)
    a = articles(spark, d).select("article_id", tx.normalized_title(F.col("headline")).alias("title"))
    b = a.select((F.col("article_id") + 1).alias("article_id"), F.col("title").alias("earlier"))
    return a.join(b, "article_id").select("article_id", pt.similarity(F.col("title"), F.col("earlier")).alias("ratio"))


J_SQL = NEWS_SQL + f""", low AS (SELECT doc_id AS article_id, lower(split_part(text, chr(10), 1) || '. ' || text) AS low FROM documents),
w AS (SELECT article_id, low, {_present(WORDS_UP)} AS p, {_present(WORDS_DOWN)} AS n FROM low),
l AS (SELECT article_id, low, CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / CAST(p + n AS DOUBLE) END AS lex FROM w),
s AS (SELECT article_id, low, lex, greatest(-1, least(1, 0.65 * coalesce(sentiment, lex) + 0.35 * lex)) AS mood, coalesce(vendor_relevance, 0.1) AS rel, (article_id % 7) / CAST(10 AS DOUBLE) AS mat FROM l JOIN art USING (article_id)),
sc AS (SELECT article_id, low, mood AS sentiment_score, greatest(-1, least(1, 0.75 * mood + 0.25 * lex)) AS expected_direction, rel, mat,
  greatest(0.2, least(0.95, 0.35 + 0.30 * 0.6 + 0.20 * rel + 0.15 * mat)) AS confidence FROM s)"""
TOPIC_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{t}{chr(39)})' for t in ts)} THEN '{n}'" for n, ts in TOPICS) + " ELSE 'other' END"


def scored_articles(spark, d) -> DataFrame:
    a = articles(spark, d).withColumns({"relevance": F.coalesce("vendor_relevance", F.lit(0.1)), "materiality": (F.col("article_id") % 7) / 10.0})
    return a.withColumns(rs.article_scores(F.col("headline"), F.col("summary"), F.col("sentiment"), F.lit(0.6), F.col("relevance"),
                                           F.col("materiality"), WORDS_UP, WORDS_DOWN, TOPICS))


@query("j01_article_scores", f"WITH {J_SQL} SELECT article_id, {TOPIC_SQL} AS topic, {r6('sentiment_score', 'expected_direction', 'confidence')} FROM sc")
def j01(spark, d):
    return scored_articles(spark, d).select("article_id", "topic", "sentiment_score", "expected_direction", "confidence")


@query("d26_weighted_news_signal", f"""WITH {J_SQL}, x AS (SELECT h.event_id, expected_direction AS e, confidence AS c, greatest(0.05, mat * rel * confidence) AS w FROM hit h JOIN sc USING (article_id))
SELECT event_id, round(greatest(-1, least(1, sum(e * w) / sum(w))), 6) + 0.0 AS news_signal, count(*) AS n_articles, round(sum(c), 6) + 0.0 AS confidence_sum FROM x GROUP BY event_id""")
def d26(spark, d):
    hits = news_hits(spark, d, "source").select("event_id", "article_id")
    s = scored_articles(spark, d).select("article_id", "expected_direction", "materiality", "relevance", "confidence")
    return rs.news_signal(hits.join(s, "article_id"), ["event_id"])
