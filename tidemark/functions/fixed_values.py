"""Word lists, patterns, feature names and constants.

Everything in this module is a *fixed value*: it has to equal the published
behaviour for results to agree, so it is written out plainly and nothing is
computed here except tuples of names.  Patterns use the Java dialect; pass them
through :func:`unicode_ci` before handing them to ``rlike`` so that ``\\b`` and
case folding work on Unicode text.
"""
from __future__ import annotations


def unicode_ci(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of ``pattern`` for Spark (Java)."""
    return "(?iU)" + pattern


# --------------------------------------------------------------------------
# Statement classification
# --------------------------------------------------------------------------
FORWARD_LOOKING = (
    r"\b(?:anticipat(?:e|es|ed|ing)|expect(?:s|ed|ing)?|forecast(?:s|ed|ing)?|"
    r"hop(?:e|es|ed|ing)|intend(?:s|ed|ing)?|plan(?:s|ned|ning)?|"
    r"project(?:s|ed|ing)?|seek(?:s|ing)?|sought|believ(?:e|es|ed|ing)|"
    r"goals?|objectives?|may|might|can|could|should|will)\b"
)
EARNINGS_RELATED = r"\b(?:earnings|eps|income|loss(?:es)?|profit(?:s)?)\b"
CURRENCY = (
    r"(?:[$€£¥]\s*[-+]?\d[\d,]*(?:\.\d+)?|"
    r"\b(?:usd|dollars?|euros?|yen|gbp)\s*[-+]?\d[\d,]*(?:\.\d+)?)"
)
PERCENT = r"(?:[-+]?\d+(?:\.\d+)?\s*%|[-+]?\d+(?:\.\d+)?\s*percent\b)"
SCALE = r"\b[-+]?\d[\d,]*(?:\.\d+)?\s*(?:thousand|million|billion|trillion|mn|mm|bn|[mbt])\b"
FINANCIAL_NUMBER = (
    r"\b(?:revenue|sales|margin|margins|eps|earnings|income|profit|loss|cash flow|"
    r"capex|capital expenditures?|ebitda|ebit|free cash flow|fcf|bookings|arr|"
    r"gross margin|operating margin)\b[^.!?]{0,35}\b[-+]?\d+(?:\.\d+)?\b"
)

# --------------------------------------------------------------------------
# Directional words and negations
# --------------------------------------------------------------------------
DIRECTION_POSITIVE = (
    r"\brais(?:e|ed|es|ing)\b", r"\bincreas(?:e|ed|es|ing)\b",
    r"\baccelerat(?:e|ed|es|ing)\b", r"\bstrong(?:er)?\b",
    r"\bimprov(?:e|ed|es|ing|ement)\b", r"\bexpand(?:s|ed|ing|ion)?\b",
    r"\bgrowth\b", r"\boutperform(?:s|ed|ing)?\b", r"\brecord\b",
    r"\bhigher\b", r"\bconfiden(?:ce|t)\b", r"\bdemand strength\b",
)
DIRECTION_NEGATIVE = (
    r"\blower(?:ed|ing)?\b", r"\bdecreas(?:e|ed|es|ing)\b", r"\bdeclin(?:e|ed|es|ing)\b",
    r"\bweaker\b", r"\bslow(?:er|ed|ing)?\b", r"\bpressure(?:s|d)?\b",
    r"\bcompression\b", r"\bheadwinds?\b", r"\brisks?\b", r"\buncertain(?:ty)?\b",
    r"\bsoftness\b", r"\bdeteriorat(?:e|ed|es|ing|ion)\b", r"\bcut(?:s|ting)?\b",
    r"\breduc(?:e|ed|es|ing|tion)\b", r"\bdemand weakness\b",
)
NEGATION = r"\b(?:not|no|never|without|isn't|wasn't|won't|wouldn't|doesn't|didn't)\b"
NEGATION_PREFIX_CHARS = 28
NEGATION_LOOKBACK_WORDS = 3

# --------------------------------------------------------------------------
# Guidance language on the joined disclosure
# --------------------------------------------------------------------------
GUIDANCE_WORDS = r"(?:guidance|outlook|forecast|expectations?)"
GUIDANCE_RAISED = (
    rf"(?:{GUIDANCE_WORDS})[^.!?]{{0,45}}\b(?:rais(?:e|ed|ing)|increas(?:e|ed|ing)|higher|above)\b|"
    rf"\b(?:rais(?:e|ed|ing)|increas(?:e|ed|ing))\b[^.!?]{{0,45}}{GUIDANCE_WORDS}"
)
GUIDANCE_LOWERED = (
    rf"(?:{GUIDANCE_WORDS})[^.!?]{{0,45}}\b(?:lower(?:ed|ing)?|cut|reduc(?:e|ed|ing)|decreas(?:e|ed|ing)|below)\b|"
    rf"\b(?:lower(?:ed|ing)?|cut|reduc(?:e|ed|ing))\b[^.!?]{{0,45}}{GUIDANCE_WORDS}"
)
GUIDANCE_MAINTAINED = (
    rf"(?:{GUIDANCE_WORDS})[^.!?]{{0,45}}\b(?:maintain(?:ed|s|ing)?|reaffirm(?:ed|s|ing)?|unchanged|repeat(?:ed|s|ing)?)\b|"
    rf"\b(?:maintain(?:ed|s|ing)?|reaffirm(?:ed|s|ing)?|unchanged)\b[^.!?]{{0,45}}{GUIDANCE_WORDS}"
)

# --------------------------------------------------------------------------
# Transparent text counters
# --------------------------------------------------------------------------
LEXICON_POSITIVE = (
    "raised", "raise", "record", "beat", "above", "exceeded", "strong", "accelerat",
    "expand", "outperform", "upgrade", "buyback", "authorization", "reaccelerat",
)
LEXICON_NEGATIVE = (
    "missed", "miss", "below", "cut", "lowered", "decline", "weak", "delay",
    "shortfall", "downgrade", "compress", "warn",
)
LEXICON_GUIDANCE = "guidance"
HEURISTIC_STEP, HEURISTIC_LOW, HEURISTIC_HIGH = 0.08, 0.10, 0.90
FORBIDDEN_TEXT_FEATURES = ("car1", "earnings_surprise", "surprise", "predicted_percentile", "y")

# --------------------------------------------------------------------------
# Realised results in disclosure lines
# --------------------------------------------------------------------------
RESULTS_PARSER_VERSION = "disclosure_results_v1"
EPS_LABEL = r"\b(?:eps|earnings\s+per\s+share|diluted\s+earnings\s+per\s+share)\b"
REVENUE_LABEL = r"\b(?:revenue|revenues|sales|net\s+sales)\b"
CONSENSUS = r"\b(?:consensus|estimate|estimates|estimated|expected|expectations)\b"
INLINE_RESULT = (
    r"\b(?:in[ -]?line\s+with|matched|matches|matching)\s+(?:the\s+)?"
    r"(?:consensus|estimate|estimates|expectations)\b"
)
BEAT_WORDS = r"(?:beat|beats|beating|above|exceeded|exceeds|topped|tops)"
MISS_WORDS = r"(?:miss|missed|misses|missing|below|fell\s+short\s+of)"
PERCENT_AFTER_CONSENSUS = (
    rf"({BEAT_WORDS}|{MISS_WORDS}).*?(?:consensus|estimate|estimates|expectations).*?\bby\s+(\d+(?:\.\d+)?)\s*%"
)
PERCENT_BEFORE_CONSENSUS = (
    rf"({BEAT_WORDS}|{MISS_WORDS}).*?\bby\s+(\d+(?:\.\d+)?)\s*%.*?(?:consensus|estimate|estimates|expectations)"
)
# case-sensitive on purpose: only the listed single letters are scales
AMOUNT = r"([$€£])?\s*(-?\d[\d,]*(?:\.\d+)?)\s*(trillion|billion|million|thousand|[TtBbMmKk])?\b"
#: The parts of a match of AMOUNT, which holds nothing but them and blanks.
AMOUNT_CURRENCY, AMOUNT_NUMBER, AMOUNT_SCALE = r"^[$€£]", r"-?\d[\d,]*(?:\.\d+)?", r"[A-Za-z]+$"
AMOUNT_SCALES = {
    "k": 1e3, "thousand": 1e3, "m": 1e6, "million": 1e6,
    "b": 1e9, "billion": 1e9, "t": 1e12, "trillion": 1e12,
}
YEAR_LIKE = (1900.0, 2100.0)
VERSUS = r"\b(?:vs\.?|versus|compared\s+(?:with|to))\b"
RESULT_GUIDANCE_RAISED = (
    r"\b(?:raise[sd]?|raising|increase[sd]?|boost(?:ed|s)?|upped)\b.*?\b(?:guidance|outlook|forecast)\b|"
    r"\b(?:guidance|outlook|forecast)\b.*?\b(?:raise[sd]?|raising|increase[sd]?|boost(?:ed|s)?|upped)\b"
)
RESULT_GUIDANCE_LOWERED = (
    r"\b(?:lower(?:ed|s)?|cut|cuts|cutting|reduce[sd]?|slash(?:ed|es)?)\b.*?\b(?:guidance|outlook|forecast)\b|"
    r"\b(?:guidance|outlook|forecast)\b.*?\b(?:lower(?:ed|s)?|cut|cuts|cutting|reduce[sd]?|slash(?:ed|es)?)\b"
)
RESULT_GUIDANCE_REAFFIRMED = (
    r"\b(?:reaffirm(?:ed|s)?|maintain(?:ed|s)?|reiterate[sd]?)\b.*?\b(?:guidance|outlook|forecast)\b|"
    r"\b(?:guidance|outlook|forecast)\b.*?\b(?:reaffirm(?:ed|s)?|maintain(?:ed|s)?|reiterate[sd]?)\b"
)

# --------------------------------------------------------------------------
# Claim diagnostics
# --------------------------------------------------------------------------
CLAIM_EXPECTATION = r"\b(?:consensus|estimate|estimates|expected|expectations|guidance|outlook|forecast|plan)\b"
CLAIM_COMPARISON = (
    r"\b(?:beat|beats|beating|miss|missed|misses|above|below|exceeded|fell short|in[- ]?line|matched|versus|vs\.?)\b"
)
CLAIM_NUMBER = r"(?:[$€£]\s*)?-?\d[\d,]*(?:\.\d+)?\s*(?:%|percent|bps|basis points|[KMBT]|million|billion|trillion)?"

# --------------------------------------------------------------------------
# News topics, directions, materiality, sources
# --------------------------------------------------------------------------
NEWS_TOPICS = (
    ("guidance", ("guidance", "outlook", "forecast")),
    ("demand", ("demand", "orders", "bookings")),
    ("pricing", ("pricing", "price increase", "price cut")),
    ("supply_constraint", ("supply", "shortage", "constraint")),
    ("customer_win", ("customer win", "contract win", "selected by", "awarded")),
    ("customer_loss", ("customer loss", "lost customer", "termination")),
    ("product_launch", ("launch", "new product", "release")),
    ("regulatory", ("regulator", "regulatory", "ftc", "doj", "sec ")),
    ("FDA", ("fda", "clinical", "drug approval")),
    ("litigation", ("lawsuit", "litigation", "court", "ruling")),
    ("M&A", ("acquisition", "acquire", "merger", "takeover")),
    ("capital_raise", ("offering", "capital raise", "secondary", "convertible")),
    ("layoffs", ("layoff", "workforce reduction", "job cuts")),
    ("management_change", ("ceo", "cfo", "chief executive", "management change")),
    ("margin_pressure", ("margin pressure", "compression", "cost pressure")),
    ("credit_quality", ("credit quality", "delinquency", "default", "charge-off")),
    ("commodity_exposure", ("commodity", "oil price", "gas price", "copper", "gold")),
    ("industry_demand", ("industry demand", "sector demand", "market demand")),
    ("analyst_action", ("upgrade", "downgrade", "price target", "analyst")),
)
NEWS_POSITIVE = ("beat", "raise", "raised", "approval", "win", "growth", "strong", "record", "upgrade", "expansion")
NEWS_NEGATIVE = (
    "miss", "cut", "lowered", "weak", "decline", "lawsuit", "layoff", "downgrade",
    "shortage", "recall", "investigation",
)
MATERIAL_TERMS = (
    "guidance", "forecast", "outlook", "earnings", "revenue", "margin", "layoff", "layoffs",
    "fda", "approval", "regulatory", "lawsuit", "litigation", "acquisition", "merger", "m&a",
    "offering", "capital raise", "customer", "contract", "supply", "shortage", "pricing",
    "ceo", "cfo", "management", "demand", "credit", "default", "recall",
)
VENDOR_MATERIAL_WORDS = (
    "guidance", "outlook", "earnings", "revenue", "margin", "fda", "approval",
    "lawsuit", "acquisition", "merger", "offering", "layoff", "contract", "customer",
    "supply", "pricing", "ceo", "cfo", "demand", "credit", "recall",
)
SOURCES_HIGH = ("reuters", "associated press", "ap news", "sec", "business wire", "globe newswire")
SOURCES_MEDIUM = (
    "bloomberg", "wsj", "wall street journal", "financial times", "cnbc", "marketwatch", "barron's",
)
SOURCES_ISSUER = ("investor", "ir.", "sec.gov")
QUALITY_HIGH, QUALITY_MEDIUM, QUALITY_ISSUER, QUALITY_OTHER = 0.95, 0.85, 0.90, 0.60
SECTOR_TOPICS = (
    ("technology", "technology"),
    ("information technology", "technology"),
    ("health care", "life_sciences"),
    ("healthcare", "life_sciences"),
    ("biotechnology", "life_sciences"),
    ("financials", "finance"),
    ("financial services", "finance"),
    ("industrials", "manufacturing"),
    ("manufacturing", "manufacturing"),
    ("energy", "energy_transportation"),
    ("transportation", "energy_transportation"),
    ("real estate", "real_estate"),
    ("consumer discretionary", "retail_wholesale"),
    ("consumer staples", "retail_wholesale"),
    ("retail", "retail_wholesale"),
)

# --------------------------------------------------------------------------
# Provider messages
# --------------------------------------------------------------------------
SECRET_PATTERNS = (
    r"(?i)(apikey|api_key|token|key)=([^&\s]+)",
    r"(?i)(Bearer)\s+([A-Za-z0-9._\-]+)",
)
PROVIDER_MESSAGE_CHARS = 300
UNSUPPORTED_TOKENS = (
    "not found", "not available", "no data", "invalid symbol", "unsupported", "does not exist",
    "may not be supported", "not supported", "no historical data", "symbol is required",
    "delisted", "unavailable for this symbol",
)
ENTITLEMENT_TOKENS = (
    "not authorized", "unauthorized", "upgrade your plan", "subscription", "premium",
    "your plan", "grow plan", "pro plan", "access denied", "forbidden",
)
TRANSIENT_STATUS = (408, 425, 429, 500, 502, 503, 504)
RATE_LIMIT_STATUS = (429,)

# --------------------------------------------------------------------------
# Numeric floors, windows and gates
# --------------------------------------------------------------------------
EPS_FLOOR, REVENUE_FLOOR, GUIDANCE_FLOOR = 0.05, 1.0, 1e-6
LARGE_SURPRISE, INLINE_TOLERANCE = 0.10, 0.0025
NEGLIGIBLE = 1e-12
REACTION_LAG_DAYS = 2
SHRINKAGE_STRENGTH, SIMILAR_EVENTS = 5.0, 5
RETURN_WINDOWS = (
    (1, "return_1d_pre_event"), (5, "return_5d"), (20, "return_20d"), (60, "return_60d"),
    (120, "return_120d"), (252, "return_252d"), (756, "return_3y"), (1260, "return_5y"),
)
FIVE_YEAR_SESSIONS = 1261
TRADING_DAYS = 252.0
NEWS_WINDOW_DAYS = 7
FAMILY_DEDUP = {"lookback": 25, "seconds": 3600, "ratio": 0.92}
RANKING_DEDUP = {"lookback": 40, "seconds": 8 * 3600, "ratio": 0.90}
PRICE_LOOKBACK_DAYS = 5 * 366 + 45
MIN_USABLE_SESSIONS = 30
CALIBRATION_BOUNDS, CALIBRATION_KNOTS = (0.01, 0.99), 4000
SCORE_BOUNDS = (0.05, 0.95)
AFFINE_CALIBRATION = {"center_raw": 0.5, "center_target": 0.5, "scale": 3.42554, "low": 0.05, "high": 0.95}
NEAR_HALF_TIGHT, NEAR_HALF_WIDE = (0.48, 0.52), (0.45, 0.55)
RIDGE_ALPHAS = (1.0, 10.0, 30.0, 100.0, 300.0, 1000.0)
ELASTIC_ALPHAS, ELASTIC_L1_RATIOS = (0.0005, 0.001, 0.005), (0.1, 0.5)
FULL_RIDGE_ALPHAS = (0.1, 1.0, 10.0, 100.0, 300.0)
FULL_ELASTIC_ALPHAS, FULL_ELASTIC_L1_RATIOS = (0.0005, 0.001, 0.005, 0.01), (0.1, 0.5, 0.9)
COVERAGE_MINIMA = {"eps": 0.30, "company_news": 0.20, "reasoning": 0.20, "price": 0.50}
ROLE_QUARTERS = {
    "train": "2025Q4", "validation": "2026Q1", "legacy": "2026Q2", "honest_holdout": "2026Q3",
}
SIGN_CONSTRAINTS = {
    "eps_surprise_percent": 1,
    "eps_surprise_signed": 1,
    "eps_surprise_zscore_company": 1,
    "eps_surprise_percentile_company": 1,
    "is_eps_beat": 1,
    "is_eps_miss": -1,
    "is_large_eps_beat": 1,
    "is_large_eps_miss": -1,
    "revenue_surprise_percent": 1,
    "revenue_surprise_zscore_company": 1,
    "revenue_surprise_percentile_company": 1,
    "is_revenue_beat": 1,
    "is_revenue_miss": -1,
    "eps_beat_and_revenue_beat": 1,
    "eps_miss_and_revenue_miss": -1,
    "reasoning_earnings_quality": 1,
    "reasoning_revenue_quality": 1,
    "reasoning_expectations_gap": 1,
    "reasoning_overall_event_signal": 1,
}
REALISED_SCENARIOS = (
    ("negative", ("Revenue missed consensus by 8%.", "EPS missed consensus by 12%.")),
    ("neutral", ("Revenue was in line with consensus.", "EPS matched consensus.")),
    ("positive", ("Revenue beat consensus by 8%.", "EPS beat consensus by 12%.")),
)
PRODUCTION_SCENARIOS = (
    ("negative", (
        "We expect earnings to decline 25% next year.",
        "We lowered full-year guidance and expect revenue to decrease 20%.",
    )),
    ("neutral", ("Quarterly results were in line with expectations.",)),
    ("positive", (
        "We expect earnings to increase 25% next year.",
        "We raised full-year guidance and expect revenue growth of 20%.",
    )),
)
REASONING_EVIDENCE = (
    "has_eps_surprise", "has_revenue_surprise", "has_numeric_guidance",
    "has_company_earnings_history", "has_5y_price_history", "has_peer_data",
    "has_company_news", "has_peer_news", "has_sector_news",
)

# --------------------------------------------------------------------------
# The frozen 173-column feature row, family by family
# --------------------------------------------------------------------------
FLS_FEATURES = (
    "fls_count", "fls_ratio",
    "earnings_fls_count", "earnings_fls_ratio",
    "non_earnings_fls_count", "non_earnings_fls_ratio",
    "quantitative_fls_count", "quantitative_fls_ratio",
    "non_quantitative_fls_count", "non_quantitative_fls_ratio",
    "quant_earnings_fls_count", "quant_earnings_fls_ratio",
    "other_fls_count", "other_fls_ratio",
    "quant_non_earnings_ratio", "nonquant_earnings_ratio",
    "other_to_quant_earnings_ratio",
    "positive_forward_count", "negative_forward_count", "signed_forward_tone",
    "guidance_raised", "guidance_lowered", "guidance_maintained", "guidance_direction",
    "signed_fls_intensity", "signed_quant_earnings_intensity", "signed_other_fls_intensity",
    "guidance_fls_interaction", "guidance_quant_earnings_interaction",
    "other_minus_quant_earnings",
)
EPS_FEATURES = (
    "reported_eps", "consensus_eps", "eps_surprise_absolute", "eps_surprise_percent",
    "eps_surprise_signed", "eps_surprise_abs", "eps_surprise_zscore_company",
    "eps_surprise_percentile_company", "is_eps_beat", "is_eps_miss",
    "is_large_eps_beat", "is_large_eps_miss", "has_eps_surprise",
)
REVENUE_FEATURES = (
    "reported_revenue", "consensus_revenue", "revenue_surprise_absolute",
    "revenue_surprise_percent", "revenue_surprise_zscore_company",
    "revenue_surprise_percentile_company", "is_revenue_beat", "is_revenue_miss",
    "has_revenue_surprise", "eps_beat_and_revenue_beat", "eps_beat_revenue_miss",
    "eps_miss_revenue_beat", "eps_miss_and_revenue_miss",
)
GUIDANCE_FEATURES = (
    "revenue_guidance_low", "revenue_guidance_high", "revenue_guidance_mid",
    "eps_guidance_low", "eps_guidance_high", "eps_guidance_mid", "ebitda_guidance",
    "margin_guidance", "revenue_guidance_vs_consensus", "eps_guidance_vs_consensus",
    "guidance_surprise_percent", "guidance_above_consensus", "guidance_below_consensus",
    "guidance_inline", "numeric_guidance_raised", "numeric_guidance_lowered",
    "guidance_reaffirmed", "has_numeric_guidance", "has_guidance_consensus",
)
INTERACTION_FEATURES = (
    "eps_beat_but_guidance_cut", "eps_miss_but_guidance_raised",
    "revenue_beat_and_guidance_above", "double_beat_and_raise", "double_miss_and_cut",
)
HISTORY_FEATURES = (
    "prior_earnings_count",
    "mean_prior_earnings_abnormal_return", "median_prior_earnings_abnormal_return",
    "std_prior_earnings_abnormal_return",
    "positive_prior_earnings_rate", "negative_prior_earnings_rate",
    "mean_prior_eps_surprise", "std_prior_eps_surprise",
    "mean_prior_revenue_surprise", "std_prior_revenue_surprise",
    "mean_reaction_after_eps_beat", "mean_reaction_after_eps_miss",
    "mean_reaction_after_revenue_beat", "mean_reaction_after_revenue_miss",
    "mean_reaction_after_double_beat", "mean_reaction_after_double_miss",
    "similar_eps_surprise_mean_reaction", "similar_revenue_surprise_mean_reaction",
    "similar_earnings_event_mean_reaction", "similar_event_count",
    "has_company_earnings_history",
)
PRICE_FEATURES = (
    "return_1d_pre_event", "return_5d", "return_20d", "return_60d", "return_120d",
    "return_252d", "return_3y", "return_5y", "realized_volatility_20d",
    "realized_volatility_60d", "realized_volatility_252d", "max_drawdown_60d",
    "max_drawdown_252d", "distance_from_20d_high", "distance_from_52w_high",
    "distance_from_20d_low", "distance_from_52w_low", "volume_zscore", "has_5y_price_history",
)
MARKET_FEATURES = (
    "market_return_1d", "market_return_5d", "sector_return_1d", "sector_return_5d",
    "sector_return_20d", "sector_volatility_20d", "stock_minus_market_5d",
    "stock_minus_market_20d", "stock_minus_market_60d", "stock_minus_sector_20d",
    "stock_minus_sector_60d",
)
PEER_FEATURES = (
    "peer_mean_return_1d", "peer_mean_return_5d", "peer_mean_return_20d",
    "peer_abnormal_return_1d", "peer_dispersion_1d", "peer_dispersion_5d",
    "recent_peer_earnings_count", "recent_peer_eps_surprise_mean",
    "recent_peer_revenue_surprise_mean", "recent_peer_guidance_signal_mean",
    "recent_peer_post_earnings_abnormal_return_mean", "has_peer_data",
)
NEWS_FEATURES = (
    "company_news_count_24h", "company_news_count_7d", "peer_news_count_24h",
    "sector_news_count_24h", "company_positive_news_score", "company_negative_news_score",
    "peer_positive_news_score", "peer_negative_news_score", "sector_positive_news_score",
    "sector_negative_news_score", "company_material_news_flag", "peer_material_news_flag",
    "sector_material_news_flag", "has_company_news", "has_peer_news", "has_sector_news",
)
REASONING_FEATURES = (
    "reasoning_earnings_quality", "reasoning_revenue_quality", "reasoning_guidance_quality",
    "reasoning_expectations_gap", "reasoning_priced_in_score", "reasoning_company_news_signal",
    "reasoning_peer_signal", "reasoning_sector_signal", "reasoning_historical_analogy_signal",
    "reasoning_contradiction_score", "reasoning_overall_event_signal", "reasoning_materiality",
    "reasoning_confidence", "has_reasoning",
)
FEATURES = (
    FLS_FEATURES + EPS_FEATURES + REVENUE_FEATURES + GUIDANCE_FEATURES + INTERACTION_FEATURES
    + HISTORY_FEATURES + PRICE_FEATURES + MARKET_FEATURES + PEER_FEATURES + NEWS_FEATURES
    + REASONING_FEATURES
)
FORBIDDEN_FEATURES = (
    "car1", "current_event_car1", "post_event_return", "future_price", "future_news",
    "leaderboard_outcome", "realized_percentile", "predicted_percentile", "y",
)
AVAILABILITY_FLAGS = {
    "eps": "has_eps_surprise",
    "revenue": "has_revenue_surprise",
    "guidance": "has_numeric_guidance",
    "guidance_consensus": "has_guidance_consensus",
    "price_5y": "has_5y_price_history",
    "company_history": "has_company_earnings_history",
    "peers": "has_peer_data",
    "company_news": "has_company_news",
    "peer_news": "has_peer_news",
    "sector_news": "has_sector_news",
    "reasoning": "has_reasoning",
}
