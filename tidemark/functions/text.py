"""Text-to-feature expressions.  Word lists are parameters: the defaults are the
fixed financial lexicon, and any other lexicon can be supplied."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions.fixed_values import unicode_ci


@dataclass(frozen=True)
class Lexicon:
    """Patterns (Java dialect) that drive statement classification."""

    forward: str = unicode_ci(fv.FORWARD_LOOKING)
    earnings: str = unicode_ci(fv.EARNINGS_RELATED)
    quantitative: tuple[str, ...] = (
        unicode_ci(fv.CURRENCY), unicode_ci(fv.PERCENT), unicode_ci(fv.SCALE), unicode_ci(fv.FINANCIAL_NUMBER),
    )
    raised: str = unicode_ci(fv.GUIDANCE_RAISED)
    lowered: str = unicode_ci(fv.GUIDANCE_LOWERED)
    maintained: str = unicode_ci(fv.GUIDANCE_MAINTAINED)


FINANCIAL = Lexicon()


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    """True when any of the patterns is found."""
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def any_contains(text: Column, tokens: Sequence[str]) -> Column:
    """True when any of the plain substrings occurs."""
    return reduce(lambda a, b: a | b, [text.contains(t) for t in tokens])


def count_contains(text: Column, tokens: Sequence[str]) -> Column:
    """How many of the plain substrings occur at least once."""
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in tokens])


def occurrences(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a plain substring."""
    shrunk = F.length(F.replace(text, F.lit(token), F.lit("")))
    return ((F.length(text) - shrunk) / len(token)).cast("bigint")


def total_occurrences(text: Column, tokens: Sequence[str]) -> Column:
    """Summed occurrences over a word list (overlapping entries both count)."""
    return reduce(lambda a, b: a + b, [occurrences(text, t) for t in tokens])


def squeeze(text: Column) -> Column:
    """Trim and collapse whitespace runs to one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


# --------------------------------------------------------------------------
# statements
# --------------------------------------------------------------------------
def statement_flags(text: Column, lexicon: Lexicon = FINANCIAL) -> dict[str, Column]:
    """Forward-looking, earnings-related and quantitative flags of one text."""
    text = F.coalesce(text, F.lit(""))
    return {
        "forward": text.rlike(lexicon.forward),
        "earnings": text.rlike(lexicon.earnings),
        "quantitative": any_match(text, lexicon.quantitative),
    }


def statement_category(forward: Column, earnings: Column, quantitative: Column) -> Column:
    """Cell of the earnings x quantitative table, NULL when not forward-looking."""
    name = F.concat(
        F.when(quantitative, F.lit("quantitative")).otherwise(F.lit("nonquantitative")),
        F.when(earnings, F.lit("_earnings")).otherwise(F.lit("_non_earnings")),
    )
    return F.when(forward, name)


def guidance_flags(joined: Column, lexicon: Lexicon = FINANCIAL) -> dict[str, Column]:
    """Raised / lowered / maintained language in the joined disclosure."""
    return {
        "guidance_raised": joined.rlike(lexicon.raised).cast("double"),
        "guidance_lowered": joined.rlike(lexicon.lowered).cast("double"),
        "guidance_maintained": joined.rlike(lexicon.maintained).cast("double"),
    }


def guidance_direction(raised: Column, lowered: Column) -> Column:
    """+1 only raised, -1 only lowered, 0 when neither or conflicting."""
    return F.when((raised > 0) & (lowered == 0), 1.0).when((lowered > 0) & (raised == 0), -1.0).otherwise(0.0)


# --------------------------------------------------------------------------
# amounts and results
# --------------------------------------------------------------------------
def amounts(text: Column) -> Column:
    """Array of scaled amounts; bare years are not amounts."""
    # the text is scanned once; the parts of what is found are read off the short match
    part = lambda x, p: F.regexp_extract(x, p, 0)
    tokens = F.transform(F.regexp_extract_all(text, F.lit("(?U)" + fv.AMOUNT), 0), lambda x: F.struct(
        part(x, fv.AMOUNT_CURRENCY).alias("currency"),
        F.replace(part(x, "(?U)" + fv.AMOUNT_NUMBER), F.lit(","), F.lit("")).try_cast("double").alias("number"),
        part(x, fv.AMOUNT_SCALE).alias("scale")))
    scales = F.create_map(*[F.lit(x) for pair in fv.AMOUNT_SCALES.items() for x in pair])

    def number(t: Column) -> Column:
        return t["number"]

    def wanted(t: Column) -> Column:
        bare = (t["currency"] == "") & (t["scale"] == "")
        size = F.abs(number(t))
        year = (size == F.floor(size)) & size.between(*fv.YEAR_LIKE)
        return number(t).isNotNull() & ~(bare & year)

    return F.transform(
        F.filter(tokens, wanted),
        lambda t: number(t) * F.coalesce(F.try_element_at(scales, F.lower(t["scale"])), F.lit(1.0)),
    )


def _pair(reported: Column, consensus: Column) -> Column:
    return F.struct(reported.cast("double").alias("reported"), consensus.cast("double").alias("consensus"))


def exact_pair(line: Column) -> Column:
    """Stated actual and consensus values of one line, else NULL."""
    sides = F.split(line, unicode_ci(fv.VERSUS), 2)

    def ends(first: Column, second: Column, size: Column) -> Column:
        return F.when(size, _pair(first, second))

    # the amount lists are built once each: an absent list gives NULL ends, and without a second side there is none
    left, right = F.try_element_at(amounts(sides[0]), F.lit(-1)), F.try_element_at(amounts(F.get(sides, F.lit(1))), F.lit(1))
    split = F.transform(F.array(F.when(line.rlike(unicode_ci(fv.VERSUS)), _pair(left, right))), lambda p: F.when(
        p["reported"].isNotNull() & p["consensus"].isNotNull(), p))[0]
    whole = F.transform(F.array(amounts(line)), lambda xs: ends(
        F.try_element_at(xs, F.lit(1)), F.try_element_at(xs, F.lit(-1)), F.size(xs) >= 2))[0]
    return F.when(line.rlike(unicode_ci(fv.CONSENSUS)), F.coalesce(split, whole))


def relative_pair(line: Column) -> Column:
    """A surprise given only as a percentage, as a pair around 1.0."""
    after, before = unicode_ci(fv.PERCENT_AFTER_CONSENSUS), unicode_ci(fv.PERCENT_BEFORE_CONSENSUS)
    use_after = line.rlike(after)
    word = F.when(use_after, F.regexp_extract(line, after, 1)).otherwise(F.regexp_extract(line, before, 1))
    pct = F.when(use_after, F.regexp_extract(line, after, 2)).otherwise(F.regexp_extract(line, before, 2))
    sign = F.when(word.rlike(unicode_ci(fv.MISS_WORDS)), -1.0).otherwise(1.0)
    stated = _pair(F.lit(1.0) + sign * (pct.try_cast("double") / 100.0), F.lit(1.0))
    pair = F.when(line.rlike(unicode_ci(fv.INLINE_RESULT)), _pair(F.lit(1.0), F.lit(1.0))).when(word != "", stated)
    return F.when(line.rlike(unicode_ci(fv.CONSENSUS)), pair)


def metric_pair(line: Column, label: str) -> Column:
    """Pair for a labelled metric: stated values first, percentage second."""
    return F.when(line.rlike(unicode_ci(label)), F.coalesce(exact_pair(line), relative_pair(line)))


def result_guidance(line: Column) -> Column:
    """Guidance direction stated in one line (raised wins over lowered)."""
    return (
        F.when(line.rlike(unicode_ci(fv.RESULT_GUIDANCE_RAISED)), "raised")
        .when(line.rlike(unicode_ci(fv.RESULT_GUIDANCE_LOWERED)), "lowered")
        .when(line.rlike(unicode_ci(fv.RESULT_GUIDANCE_REAFFIRMED)), "reaffirmed")
    )


def first_present(items: Column, extract) -> Column:
    """First non-NULL ``extract(line)`` over an array of lines, in order."""
    return F.try_element_at(F.filter(F.transform(items, extract), lambda x: x.isNotNull()), F.lit(1))


def disclosure_results(facts: Column) -> Column:
    """Struct of the EPS pair, revenue pair and guidance direction that a list
    of facts states; per field the first matching fact wins."""
    lines = F.filter(F.transform(facts, squeeze), lambda x: x.isNotNull() & (x != ""))
    eps = first_present(lines, lambda x: metric_pair(x, fv.EPS_LABEL))
    revenue = first_present(lines, lambda x: metric_pair(x, fv.REVENUE_LABEL))
    return F.struct(
        eps["reported"].alias("reported_eps"), eps["consensus"].alias("consensus_eps"),
        revenue["reported"].alias("reported_revenue"), revenue["consensus"].alias("consensus_revenue"),
        first_present(lines, result_guidance).alias("direction"),
    )


def line_labels(line: Column) -> dict[str, Column]:
    """Whether a line names earnings per share, revenue."""
    return {"on_eps": line.rlike(unicode_ci(fv.EPS_LABEL)), "on_revenue": line.rlike(unicode_ci(fv.REVENUE_LABEL))}


def labelled_pair(line: Column, on_eps: Column, on_revenue: Column) -> Column:
    """The pair of :func:`metric_pair` for a line with either label."""
    return F.when(on_eps | on_revenue, F.coalesce(exact_pair(line), relative_pair(line)))


def line_results(pair: Column, on_eps: Column, on_revenue: Column, direction: Column) -> Column:
    """The struct of :func:`disclosure_results` for a single line, from its parts."""
    named = {"eps": on_eps, "revenue": on_revenue}
    return F.struct(*[F.when(on, pair[side]).alias(f"{side}_{name}") for name, on in named.items() for side in ("reported", "consensus")],
                    direction.alias("direction"))


# --------------------------------------------------------------------------
# news text
# --------------------------------------------------------------------------
def canonical_url(url: Column) -> Column:
    """Address without query string and trailing slashes, lower case."""
    return F.coalesce(F.lower(F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", "")), F.lit(""))


def normalized_title(title: Column) -> Column:
    """Lower case letters and digits, other characters become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]+", " "), " +", " "))


def plain_title(title: Column) -> Column:
    """Lower case with whitespace collapsed."""
    return squeeze(F.lower(title))


def topic(text: Column, topics=fv.NEWS_TOPICS) -> Column:
    """First topic in list order with a term in the text, else ``other``."""
    low = F.lower(text)
    out = F.lit("other")
    for name, terms in reversed(topics):
        out = F.when(any_contains(low, terms), F.lit(name)).otherwise(out)
    return out


def lexical_direction(text: Column, positive=fv.NEWS_POSITIVE, negative=fv.NEWS_NEGATIVE) -> Column:
    """(positive - negative) / (positive + negative) over whole-word presence."""
    low = F.lower(text)

    def present(words):
        return reduce(lambda a, b: a + b, [low.rlike(rf"(?U)\b{w}\b").cast("int") for w in words])

    p, n = present(positive), present(negative)
    return F.when(p + n == 0, 0.0).otherwise((p - n) / F.greatest(p + n, F.lit(1)))


def materiality(text: Column, flagged: Column, terms=fv.MATERIAL_TERMS) -> Column:
    """Clipped count of material terms; a vendor flag adds two hits."""
    hits = count_contains(F.lower(text), terms) + F.when(F.coalesce(flagged, F.lit(False)), 2).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.30) + F.lit(0.16) * hits))


def source_quality(source: Column, url: Column, high=fv.SOURCES_HIGH, medium=fv.SOURCES_MEDIUM,
                   issuer=fv.SOURCES_ISSUER) -> Column:
    """Quality tier of a news source from its name and address."""
    seen = F.concat_ws(" ", F.lower(source), F.coalesce(F.lower(url), F.lit("")))
    return (
        F.when(any_contains(seen, high), fv.QUALITY_HIGH)
        .when(any_contains(seen, medium), fv.QUALITY_MEDIUM)
        .when(any_contains(seen, issuer), fv.QUALITY_ISSUER)
        .otherwise(fv.QUALITY_OTHER)
    )


def relevance(entities: Column, targets: Column, vendor: Column, broad: bool = False) -> Column:
    """Vendor relevance or a default, lifted by matched target entities."""
    def upper(xs):
        return F.transform(xs, F.upper)

    hits = F.size(F.array_intersect(upper(entities), upper(targets)))
    start = F.lit(0.60) if broad else F.when(hits > 0, 0.85).otherwise(0.10)
    base = F.coalesce(vendor, start)
    lifted = F.when(hits > 0, F.greatest(base, F.least(F.lit(1.0), F.lit(0.75) + F.lit(0.08) * hits))).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), lifted))


def sector_topic(sector: Column, mapping=fv.SECTOR_TOPICS) -> Column:
    """Vendor topic of a sector: exact name first, then first contained name."""
    key = F.lower(F.trim(F.coalesce(sector, F.lit(""))))
    out = F.lit(None).cast("string")
    for name, mapped in reversed(mapping):
        out = F.when(key.contains(name), F.lit(mapped)).otherwise(out)
    for name, mapped in mapping:
        out = F.when(key == name, F.lit(mapped)).otherwise(out)
    return out


def source_id(url: Column, published: Column, title: Column) -> Column:
    """Stable 24-digit id of an article."""
    blank = F.lit("")
    joined = F.concat_ws("|", F.coalesce(url, blank), F.coalesce(published, blank), F.coalesce(title, blank))
    return F.substring(F.sha2(joined, 256), 1, 24)


# --------------------------------------------------------------------------
# provider messages and keys
# --------------------------------------------------------------------------
def redact(message: Column) -> Column:
    """Mask credentials and bound the stored length; blank becomes NULL."""
    out = message
    for pattern in fv.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1=<redacted>")
    out = F.trim(out)
    cut = fv.PROVIDER_MESSAGE_CHARS
    out = F.when(F.length(out) > cut, F.concat(F.substring(out, 1, cut), F.lit("..."))).otherwise(out)
    return F.nullif(out, F.lit(""))


def classify_message(message: Column) -> Column:
    """Permanent provider problems: entitlement before unsupported symbol."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(any_contains(low, fv.ENTITLEMENT_TOKENS), "entitlement").when(
        any_contains(low, fv.UNSUPPORTED_TOKENS), "unsupported_symbol")


def classify_status(status: Column) -> Column:
    """HTTP status class: rate limit, transient or permanent."""
    return F.when(status.isin(*fv.RATE_LIMIT_STATUS), "rate_limit").when(
        status.isin(*fv.TRANSIENT_STATUS), "transient").otherwise("permanent")


def safe_key(value: Column, extra: str = "-_", fallback: str = "unknown") -> Column:
    """Letters, digits and the extra characters only; never empty."""
    kept = F.regexp_replace(value, rf"[^\p{{L}}\p{{N}}{extra.replace('-', chr(92) + '-')}]", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(fallback))


# --------------------------------------------------------------------------
# claims
# --------------------------------------------------------------------------
def claim_confidence(text: Column, matched_result: Column, matched_guidance: Column, forward: Column,
                     direction: Column, quantitative: Column) -> Column:
    """Rule strength of how explicitly a claim maps to the feature schema."""
    expectation = text.rlike(unicode_ci(fv.CLAIM_EXPECTATION))
    comparison = text.rlike(unicode_ci(fv.CLAIM_COMPARISON))
    numbers = F.regexp_count(text, F.lit(unicode_ci(fv.CLAIM_NUMBER)))
    return (
        F.when(matched_result & expectation & comparison & (numbers >= 1), 0.98)
        .when(matched_result & expectation & (numbers >= 2), 0.95)
        .when(matched_guidance, 0.92)
        .when(forward & (direction != 0) & quantitative, 0.86)
        .when(forward & (direction != 0), 0.78)
        .when(forward, 0.68)
        .when(comparison & (numbers >= 1), 0.55)
        .otherwise(0.25)
    )


def claim_direction(guidance: Column, eps_delta: Column, revenue_delta: Column, tone: Column) -> Column:
    """-1/0/1 by guidance, then agreeing results, then tone."""
    known = F.array_compact(F.array(eps_delta, revenue_delta))
    return (
        F.when(guidance == "raised", 1)
        .when(guidance == "lowered", -1)
        .when(guidance == "reaffirmed", 0)
        .when((F.size(known) > 0) & (F.array_min(known) > 0), 1)
        .when((F.size(known) > 0) & (F.array_max(known) < 0), -1)
        .otherwise(F.signum(tone).cast("int"))
    )


def feature_family(name: Column) -> Column:
    """Family label of a model feature."""
    revenue_flags = [n for n in fv.REVENUE_FEATURES if n.startswith(("is_", "has_", "eps_"))]
    return (
        F.when(name.isin(*fv.FLS_FEATURES), "forward_looking")
        .when(name.startswith("revenue_") | name.isin(*revenue_flags), "revenue_results")
        .otherwise("other")
    )
