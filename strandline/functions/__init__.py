"""Column expressions with one rule for what is missing: NULL, never NaN or infinity."""

from .safe import (  # noqa: F401
    clip, complete_max, correlation, filled, finite, full, log_positive, neutral_ratio, rank_pct, rolling, safe_div, sign_or_zero, skip_max, skip_min, std_pop, tie_rank, year_of,
)
