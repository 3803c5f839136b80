"""Per-event feature families: results, guidance, history, peers, disclosure."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.functions.pit import clip, middle, ratio
from tidemark.operators.joins import POINT_AFTER, POINT_FIRST, QUERY, timeline
from tidemark.operators.ranks import top_in_group
from tidemark.operators.scan import Running, running
from tidemark.session import ship_package


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


# --------------------------------------------------------------------------
# array statistics (arrays are bounded by the history limit)
# --------------------------------------------------------------------------
def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def array_mean(xs: Column) -> Column:
    """Mean of an array, 0 when empty."""
    return F.when(F.size(xs) > 0, array_sum(xs) / F.size(xs)).otherwise(0.0)


def array_std(xs: Column) -> Column:
    """Population deviation of an array, 0 below two elements."""
    mean = array_mean(xs)
    spread = F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(xs) >= 2, F.sqrt(spread / F.size(xs))).otherwise(0.0)


def array_median(xs: Column) -> Column:
    ordered = F.sort_array(xs)
    n = F.size(xs)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2).otherwise(0.0)


def present(history: Column, value) -> Column:
    """Non-NULL values of a per-record expression."""
    return F.filter(F.transform(history, value), lambda x: x.isNotNull())


def eps_surprise(r: Column) -> Column:
    return ratio(r["reported_eps"], r["consensus_eps"], fv.EPS_FLOOR)


def revenue_surprise(r: Column) -> Column:
    return ratio(r["reported_revenue"], r["consensus_revenue"], fv.REVENUE_FLOOR)


def zscore(value: Column, sample: Column) -> Column:
    sd = array_std(sample)
    return F.when((F.size(sample) >= 2) & (sd > fv.NEGLIGIBLE), (value - array_mean(sample)) / sd).otherwise(0.0)


def midrank_share(value: Column, sample: Column) -> Column:
    """(below + half the equal) / n against a sample; 0.5 without one."""
    below = F.size(F.filter(sample, lambda x: x < value))
    equal = F.size(F.filter(sample, lambda x: x == value))
    return F.when(F.size(sample) > 0, (below + equal * 0.5) / F.size(sample)).otherwise(0.5)


# --------------------------------------------------------------------------
# results
# --------------------------------------------------------------------------
def prepare_history(df: DataFrame, history: str = "history") -> DataFrame:
    """Surprise and reaction arrays as columns of their own, so that the many
    features built on them do not evaluate the records again."""
    h = F.col(history)
    return df.withColumns({
        "__eps": present(h, eps_surprise), "__revenue": present(h, revenue_surprise),
        "__reactions": present(h, lambda r: r["abnormal_return"]),
    })


def eps_block(history: Column | None, sample: Column | None = None, against: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """EPS surprise features of the current result against visible history.
    ``against`` gives its z-score and mid-rank share where they are known already."""
    reported, consensus = F.col("reported_eps"), F.col("consensus_eps")
    known = reported.isNotNull() & consensus.isNotNull()
    delta, pct = reported - consensus, ratio(reported, consensus, fv.EPS_FLOOR)
    if against is None:
        sample = present(history, eps_surprise) if sample is None else sample
        against = zscore(pct, sample), midrank_share(pct, sample)

    def when_known(c: Column) -> Column:
        return F.when(known, c).otherwise(0.0)

    return {
        "reported_eps": when_known(reported), "consensus_eps": when_known(consensus),
        "eps_surprise_absolute": when_known(delta), "eps_surprise_percent": when_known(pct),
        "eps_surprise_signed": when_known(F.abs(pct) * F.signum(delta)), "eps_surprise_abs": when_known(F.abs(pct)),
        "eps_surprise_zscore_company": when_known(against[0]),
        "eps_surprise_percentile_company": when_known(against[1]),
        "is_eps_beat": flag(known & (delta > 0)), "is_eps_miss": flag(known & (delta < 0)),
        "is_large_eps_beat": flag(known & (pct >= fv.LARGE_SURPRISE)),
        "is_large_eps_miss": flag(known & (pct <= -fv.LARGE_SURPRISE)),
        "has_eps_surprise": flag(known),
    }


def revenue_block(history: Column | None, sample: Column | None = None, against: tuple[Column, Column] | None = None) -> dict[str, Column]:
    """Revenue surprise features and the four EPS x revenue combinations; ``against`` as in :func:`eps_block`."""
    reported, consensus = F.col("reported_revenue"), F.col("consensus_revenue")
    known = reported.isNotNull() & consensus.isNotNull()
    delta, pct = reported - consensus, ratio(reported, consensus, fv.REVENUE_FLOOR)
    eps = F.col("reported_eps") - F.col("consensus_eps")
    if against is None:
        sample = present(history, revenue_surprise) if sample is None else sample
        against = zscore(pct, sample), midrank_share(pct, sample)

    def when_known(c: Column) -> Column:
        return F.when(known, c).otherwise(0.0)

    return {
        "reported_revenue": when_known(reported), "consensus_revenue": when_known(consensus),
        "revenue_surprise_absolute": when_known(delta), "revenue_surprise_percent": when_known(pct),
        "revenue_surprise_zscore_company": when_known(against[0]),
        "revenue_surprise_percentile_company": when_known(against[1]),
        "is_revenue_beat": flag(known & (delta > 0)), "is_revenue_miss": flag(known & (delta < 0)),
        "has_revenue_surprise": flag(known),
        "eps_beat_and_revenue_beat": flag(known & (eps > 0) & (delta > 0)),
        "eps_beat_revenue_miss": flag(known & (eps > 0) & (delta < 0)),
        "eps_miss_revenue_beat": flag(known & (eps < 0) & (delta > 0)),
        "eps_miss_and_revenue_miss": flag(known & (eps < 0) & (delta < 0)),
    }


def guidance_block() -> dict[str, Column]:
    """Guidance features from nullable columns of one record per event."""
    c = F.col
    rev_mid, eps_mid = middle(c("revenue_low"), c("revenue_high")), middle(c("eps_low"), c("eps_high"))
    rev_vs = ratio(rev_mid, c("revenue_consensus"), fv.GUIDANCE_FLOOR)
    eps_vs = ratio(eps_mid, c("eps_consensus"), fv.GUIDANCE_FLOOR)
    known = F.array_compact(F.array(rev_vs, eps_vs))
    combined, compared = array_mean(known), F.size(known) > 0
    word = F.lower(F.trim(F.coalesce(c("direction"), F.lit(""))))

    def zero(x: Column) -> Column:
        return F.coalesce(x, F.lit(0.0))

    return {
        "revenue_guidance_low": zero(c("revenue_low")), "revenue_guidance_high": zero(c("revenue_high")),
        "revenue_guidance_mid": zero(rev_mid), "eps_guidance_low": zero(c("eps_low")),
        "eps_guidance_high": zero(c("eps_high")), "eps_guidance_mid": zero(eps_mid),
        "ebitda_guidance": zero(c("ebitda")), "margin_guidance": zero(c("margin")),
        "revenue_guidance_vs_consensus": zero(rev_vs), "eps_guidance_vs_consensus": zero(eps_vs),
        "guidance_surprise_percent": combined,
        "guidance_above_consensus": flag(compared & (combined > fv.INLINE_TOLERANCE)),
        "guidance_below_consensus": flag(compared & (combined < -fv.INLINE_TOLERANCE)),
        "guidance_inline": flag(compared & (F.abs(combined) <= fv.INLINE_TOLERANCE)),
        "numeric_guidance_raised": flag(word == "raised"),
        "numeric_guidance_lowered": flag(word.isin("lowered", "cut")),
        "guidance_reaffirmed": flag(word.isin("reaffirmed", "maintained")),
        "has_numeric_guidance": flag(F.coalesce(rev_mid, eps_mid, c("ebitda"), c("margin")).isNotNull()),
        "has_guidance_consensus": flag(compared),
    }


def interaction_block() -> dict[str, Column]:
    """Five result x guidance flags over the already built columns."""
    c = F.col
    raised = (c("numeric_guidance_raised") > 0) | (F.coalesce(c("guidance_raised"), F.lit(0.0)) > 0)
    lowered = (c("numeric_guidance_lowered") > 0) | (F.coalesce(c("guidance_lowered"), F.lit(0.0)) > 0)
    return {
        "eps_beat_but_guidance_cut": flag((c("is_eps_beat") > 0) & lowered),
        "eps_miss_but_guidance_raised": flag((c("is_eps_miss") > 0) & raised),
        "revenue_beat_and_guidance_above": flag((c("is_revenue_beat") > 0) & (c("guidance_above_consensus") > 0)),
        "double_beat_and_raise": flag((c("eps_beat_and_revenue_beat") > 0) & raised),
        "double_miss_and_cut": flag((c("eps_miss_and_revenue_miss") > 0) & lowered),
    }


# --------------------------------------------------------------------------
# company history
# --------------------------------------------------------------------------
REACTION_GROUPS = {
    "eps_beat": ("mean_reaction_after_eps_beat", lambda e, v: e > 0),
    "eps_miss": ("mean_reaction_after_eps_miss", lambda e, v: e < 0),
    "revenue_beat": ("mean_reaction_after_revenue_beat", lambda e, v: v > 0),
    "revenue_miss": ("mean_reaction_after_revenue_miss", lambda e, v: v < 0),
    "double_beat": ("mean_reaction_after_double_beat", lambda e, v: (e > 0) & (v > 0)),
    "double_miss": ("mean_reaction_after_double_miss", lambda e, v: (e < 0) & (v < 0)),
}


def similar_reactions(history: Column, distance, k: int = fv.SIMILAR_EVENTS) -> Column:
    """Reactions of the ``k`` nearest past records; equal distances keep the
    older record first (the array is oldest first)."""
    scored = F.transform(history, lambda r, i: F.struct(
        distance(r).alias("distance"), i.alias("position"), r["abnormal_return"].alias("reaction")))
    usable = F.filter(scored, lambda s: s["distance"].isNotNull() & s["reaction"].isNotNull())
    return F.transform(F.slice(F.array_sort(usable), 1, k), lambda s: s["reaction"])


def history_block(history: Column, eps_now: Column, revenue_now: Column, priors: dict[str, Column] | None = None,
                  strength: float = fv.SHRINKAGE_STRENGTH, k: int = fv.SIMILAR_EVENTS, prepared: bool = False) -> dict[str, Column]:
    """Company-history features from the bounded array of visible records.
    ``prepared`` means the arrays of :func:`prepare_history` are present.

    ``eps_now`` / ``revenue_now`` are the current surprises, NULL when unknown.
    ``priors`` maps a reaction group to a prior mean it is shrunk towards.
    """
    priors = priors or {}
    if prepared:
        reactions, eps, revenue = F.col("__reactions"), F.col("__eps"), F.col("__revenue")
    else:
        reactions = present(history, lambda r: r["abnormal_return"])
        eps, revenue = present(history, eps_surprise), present(history, revenue_surprise)
    n = F.size(reactions)

    def rate(test) -> Column:
        return F.when(n > 0, F.size(F.filter(reactions, test)) / n).otherwise(0.0)

    def conditional(group: str) -> Column:
        _, test = REACTION_GROUPS[group]
        zero = F.lit(0.0)
        hits = F.filter(history, lambda r: r["abnormal_return"].isNotNull() & test(
            F.coalesce(eps_surprise(r), zero), F.coalesce(revenue_surprise(r), zero)))
        values = F.transform(hits, lambda r: r["abnormal_return"])
        if group not in priors or strength <= 0:
            return array_mean(values)
        prior = priors[group]
        return F.when(F.size(values) > 0, (array_sum(values) + strength * prior) / (F.size(values) + strength)).otherwise(prior)

    def square(x: Column) -> Column:
        return x * x

    by_eps = similar_reactions(history, lambda r: F.abs(eps_surprise(r) - eps_now), k)
    by_revenue = similar_reactions(history, lambda r: F.abs(revenue_surprise(r) - revenue_now), k)
    by_both = similar_reactions(
        history, lambda r: F.sqrt(square(eps_surprise(r) - eps_now) + square(revenue_surprise(r) - revenue_now)), k)
    return {
        "prior_earnings_count": F.size(history).cast("double"),
        "mean_prior_earnings_abnormal_return": array_mean(reactions),
        "median_prior_earnings_abnormal_return": array_median(reactions),
        "std_prior_earnings_abnormal_return": array_std(reactions),
        "positive_prior_earnings_rate": rate(lambda x: x > 0),
        "negative_prior_earnings_rate": rate(lambda x: x < 0),
        "mean_prior_eps_surprise": array_mean(eps), "std_prior_eps_surprise": array_std(eps),
        "mean_prior_revenue_surprise": array_mean(revenue), "std_prior_revenue_surprise": array_std(revenue),
        **{name: conditional(group) for group, (name, _) in REACTION_GROUPS.items()},
        "similar_eps_surprise_mean_reaction": array_mean(by_eps),
        "similar_revenue_surprise_mean_reaction": array_mean(by_revenue),
        "similar_earnings_event_mean_reaction": array_mean(by_both),
        "similar_event_count": F.when(F.size(by_both) > 0, F.size(by_both)).otherwise(
            F.greatest(F.size(by_eps), F.size(by_revenue))).cast("double"),
        "has_company_earnings_history": flag(F.size(history) > 0),
    }


def prior_reactions(events: DataFrame, key: str, event_id: str, at: str, outcome: str, eligible: Column,
                    lag_days: int = fv.REACTION_LAG_DAYS) -> DataFrame:
    """Archive history without a length limit: for each event, the count, mean,
    deviation and sign rates of all earlier same-key outcomes that were known
    ``lag_days`` after their event.  Running sums only, so any history length
    and any key size is fine."""
    points = events.where(eligible & F.col(outcome).isNotNull()).select(
        key, at, F.col(outcome).alias("__y"))
    both = timeline(points, events, [key], F.col(at) + F.expr(f"INTERVAL {lag_days} DAYS"), F.col(at), ["__y"],
                    F.lit(POINT_FIRST if lag_days > 0 else POINT_AFTER))
    y = F.col("__point.__y")
    done = running(both, [key], ["__t", "__tag"], [
        Running("sum", F.when(y.isNotNull(), 1).cast("bigint"), "__n"),
        Running("sum", y, "__s"), Running("sum", y * y, "__ss"),
        Running("sum", F.when(y > 0, 1).cast("bigint"), "__pos"), Running("sum", F.when(y < 0, 1).cast("bigint"), "__neg"),
    ]).where(F.col("__tag") == QUERY)
    n = F.coalesce(F.col("__n"), F.lit(0))
    mean = F.col("__s") / n

    def when_any(c: Column) -> Column:
        return F.when(n > 0, F.coalesce(c, F.lit(0.0))).otherwise(0.0)

    return done.select(
        key, "__query.*", n.alias("prior_count"), when_any(mean).alias("prior_mean"),
        F.when(n >= 2, F.sqrt(F.greatest(F.lit(0.0), F.col("__ss") / n - mean * mean))).otherwise(0.0).alias("prior_std"),
        when_any(F.col("__pos") / n).alias("positive_rate"), when_any(F.col("__neg") / n).alias("negative_rate"))


# --------------------------------------------------------------------------
# peers
# --------------------------------------------------------------------------
def select_peers(edges: DataFrame, event_id: str, limit: int = 10) -> DataFrame:
    """Best ``limit`` peers of each event by score, then name."""
    return top_in_group(edges, [event_id], [F.col("score").desc(), F.col("peer_key")], limit, "peer_place")


def peer_block(events: DataFrame, peers: DataFrame, event_id: str, market_1d: Column, results: dict[str, Column] | None = None) -> DataFrame:
    """Peer means and dispersions from one row per (event, peer) that already
    carries ``return_1d/5d/20d``; short histories count as zero, not missing.
    ``results`` adds aggregates over the same rows (:func:`peer_result_means`), zero for events without peers."""
    results = results or {}
    agg = peers.groupBy(event_id).agg(
        *[c.alias(n) for n, c in results.items()],
        *[F.avg(f"return_{k}").alias(f"peer_mean_return_{k}") for k in ("1d", "5d", "20d")],
        F.stddev_pop("return_1d").alias("peer_dispersion_1d"), F.stddev_pop("return_5d").alias("peer_dispersion_5d"))
    joined = events.join(agg, event_id, "left")
    names = [f"peer_mean_return_{k}" for k in ("1d", "5d", "20d")] + ["peer_dispersion_1d", "peer_dispersion_5d", *results]
    has = F.col("peer_mean_return_1d").isNotNull()
    return joined.withColumn("has_peer_data", flag(has)).withColumns(
        {n: F.coalesce(F.col(n), F.lit(0.0)) for n in names}).withColumn(
        "peer_abnormal_return_1d", F.col("peer_mean_return_1d") - market_1d)


def peer_earnings_block(records: Column) -> dict[str, Column]:
    """Aggregates over the flattened array of recent peer results."""
    return {
        "recent_peer_earnings_count": F.size(records).cast("double"),
        "recent_peer_eps_surprise_mean": array_mean(present(records, eps_surprise)),
        "recent_peer_revenue_surprise_mean": array_mean(present(records, revenue_surprise)),
        "recent_peer_guidance_signal_mean": F.lit(0.0),
        "recent_peer_post_earnings_abnormal_return_mean": array_mean(present(records, lambda r: r["abnormal_return"])),
    }


#: Values of one result that are averaged over the recent results of all peers.
PEER_RESULTS = ("eps_surprise", "revenue_surprise", "abnormal_return")


def peer_result_values() -> dict[str, Column]:
    """The averaged values that are not columns of a result yet."""
    row = F.struct(*[F.col(c) for c in ("reported_eps", "consensus_eps", "reported_revenue", "consensus_revenue")])
    return {"eps_surprise": eps_surprise(row), "revenue_surprise": revenue_surprise(row)}


def peer_result_means() -> dict[str, Column]:
    """What :func:`peer_earnings_block` says, from the counts (``n_``) and sums (``s_``) of each peer's recent results."""
    mean = lambda n: F.when(F.sum(f"n_{n}") > 0, F.sum(f"s_{n}") / F.sum(f"n_{n}"))
    return {
        "recent_peer_earnings_count": F.sum("records").cast("double"),
        "recent_peer_eps_surprise_mean": mean("eps_surprise"), "recent_peer_revenue_surprise_mean": mean("revenue_surprise"),
        "recent_peer_guidance_signal_mean": F.max(F.lit(0.0)),
        "recent_peer_post_earnings_abnormal_return_mean": mean("abnormal_return"),
    }


# --------------------------------------------------------------------------
# disclosure text
# --------------------------------------------------------------------------
def with_fls(df: DataFrame, facts: str, lexicon: tx.Lexicon = tx.FINANCIAL, scorer=None, tones: bool = True) -> DataFrame:
    """Add the 30 forward-looking features of one disclosure (array of facts).

    Everything happens inside the row that already holds the disclosure: no
    explode, no shuffle.  Each fact is classified once, into a column of its own
    (a shared higher-order expression would be evaluated per output column), and
    only forward-looking facts visit Python for their direction.
    """
    from tidemark.functions.python_text import direction_score

    kept = F.filter(F.col(facts), lambda x: x.isNotNull())
    flags = F.transform(kept, lambda x: F.struct(*[c.alias(n) for n, c in tx.statement_flags(x, lexicon).items()], x.alias("text")))
    guide = tx.guidance_flags(F.concat_ws(" ", F.col(facts)), lexicon)
    df = df.withColumns({"__forward": F.filter(flags, lambda s: s["forward"]), "__facts": F.size(kept), **guide})
    if tones:
        ship_package(df.sparkSession)
        scorer = scorer or direction_score()
        df = df.withColumn("__tones", scorer(F.transform("__forward", lambda s: s["text"])))
    else:
        df = df.withColumn("__tones", F.array().cast("array<int>"))
    forward = F.col("__forward")

    def count(test) -> Column:
        return F.size(F.filter(forward, test)).cast("double")

    df = df.withColumns({
        "__total": F.greatest(F.col("__facts"), F.lit(1)), "__n": F.size(forward).cast("double"),
        "__earnings": count(lambda s: s["earnings"]), "__quant": count(lambda s: s["quantitative"]),
        "__both": count(lambda s: s["earnings"] & s["quantitative"]),
        "positive_forward_count": F.size(F.filter("__tones", lambda t: t > 0)).cast("double"),
        "negative_forward_count": F.size(F.filter("__tones", lambda t: t < 0)).cast("double"),
    })
    n, total, both = F.col("__n"), F.col("__total"), F.col("__both")
    earnings, quant, other = F.col("__earnings"), F.col("__quant"), n - both
    counted = {
        "fls": n, "earnings_fls": earnings, "non_earnings_fls": n - earnings, "quantitative_fls": quant,
        "non_quantitative_fls": n - quant, "quant_earnings_fls": both, "other_fls": other,
    }
    tone = clip((F.col("positive_forward_count") - F.col("negative_forward_count")) / F.greatest(n, F.lit(1.0)))
    direction = tx.guidance_direction(F.col("guidance_raised"), F.col("guidance_lowered"))
    out = {f"{k}_count": c for k, c in counted.items()} | {f"{k}_ratio": c / total for k, c in counted.items()}
    out |= {
        "quant_non_earnings_ratio": (quant - both) / total, "nonquant_earnings_ratio": (earnings - both) / total,
        "other_to_quant_earnings_ratio": other / (both + 1.0), "signed_forward_tone": tone, "guidance_direction": direction,
        "signed_fls_intensity": n / total * tone, "signed_quant_earnings_intensity": both / total * tone,
        "signed_other_fls_intensity": other / total * tone,
        "guidance_fls_interaction": n / total * direction,
        "guidance_quant_earnings_interaction": both / total * direction,
        "other_minus_quant_earnings": (other - both) / total,
    }
    return df.withColumns(out).drop("__forward", "__facts", "__tones", "__total", "__n", "__earnings", "__quant", "__both")


def lexicon_block(facts: Column, positive=fv.LEXICON_POSITIVE, negative=fv.LEXICON_NEGATIVE,
                  guidance: str = fv.LEXICON_GUIDANCE) -> dict[str, Column]:
    """The transparent text counters of one disclosure."""
    joined = F.concat_ws(" ", facts)
    low = F.lower(joined)
    up, down = tx.total_occurrences(low, positive), tx.total_occurrences(low, negative)
    return {
        "n_facts": F.size(facts).cast("bigint"), "text_length": F.length(joined).cast("bigint"),
        "positive_hits": up, "negative_hits": down, "net_sentiment": up - down,
        "has_guidance_mention": low.contains(guidance),
    }


def heuristic(net: Column) -> Column:
    """0.5 shifted by the net word count, clamped."""
    return clip(F.lit(0.5) + F.lit(fv.HEURISTIC_STEP) * net, fv.HEURISTIC_LOW, fv.HEURISTIC_HIGH)


def availability_row(names: Sequence[str] = tuple(fv.AVAILABILITY_FLAGS)) -> list[Column]:
    """Family availability columns from the ``has_*`` flags."""
    return [F.col(fv.AVAILABILITY_FLAGS[n]).alias(n) for n in names]
