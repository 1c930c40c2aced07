"""Parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# The categories of the lexicon.
CATEGORIES = ("negative", "positive", "uncertainty", "litigious", "strong_modal", "weak_modal", "constraining")

# English stop words left out of token lists; a parameter of every function that tokenises.
STOP_WORDS = tuple(
    (
        "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for "
        "from further had has have having he her here hers herself him himself his how i if in into is it its itself just may me might more most must my myself no nor not now of off on once "
        "only or other our ours ourselves out over own same shall she should so some such than that the their theirs them themselves then there these they this those through to too under "
        "until up upon us very was we were what when where which while who whom why will with would you your yours yourself yourselves"
    ).split()
)


@dataclass(frozen=True)
class EngineConfig:
    """The defaults; pass another instance to change them."""

    forms: tuple[str, ...] = ("10-K", "10-Q")
    start_date: str = "2015-01-01"
    end_date: str = "2024-12-31"
    benchmark: str = "SPY"
    return_windows: tuple[int, ...] = (1, 5, 21, 63)
    vol_window: int = 63
    trading_days: int = 252
    nw_lags: int = 5
    quantiles: int = 3
    section_min_chars: int = 200
    panel_min_chars: int = 50
    sentence_cap_chars: int = 1_500_000
    sentence_max_words: int = 400
    sentence_min_words: int = 3
    model_batch: int = 32
    stop_words: tuple[str, ...] = field(default=STOP_WORDS)


DEFAULT = EngineConfig()

# Columns whose change from filing to filing is taken.
DELTA_COLUMNS = (
    "lm_1a_negative_pct", "lm_1a_positive_pct", "lm_1a_uncertainty_pct", "lm_1a_net_sentiment", "lm_mda_negative_pct", "lm_mda_net_sentiment",
    "fb_1a_finbert_net_sentiment", "fb_mda_finbert_net_sentiment", "stat_1a_word_count", "stat_1a_fog_index",
)
