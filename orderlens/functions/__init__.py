from orderlens.functions.classify import (
    MARGIN_LABELS, SIZE_LABELS, margin_category, product_size_class,
)
from orderlens.functions.scalar import (
    WEEKDAYS, exact_avg, exact_part, exact_sum, money_total, residue, float32, growth_pct, hour_of, month_key,
    round_half_up, text_to_timestamp, weekday_name, year_of,
)

__all__ = [
    "MARGIN_LABELS", "SIZE_LABELS", "WEEKDAYS", "exact_avg", "exact_part", "exact_sum", "float32", "growth_pct", "money_total", "residue",
    "hour_of", "margin_category", "month_key", "product_size_class", "round_half_up",
    "text_to_timestamp", "weekday_name", "year_of",
]
