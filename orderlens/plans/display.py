"""Display names: the column headers the original analyses print.

The library's own names are lower snake case; ``with_display_names``
renames a result to the headers the original outputs carry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Original column headers per analysis (only those that differ).
DISPLAY_NAMES: dict[str, dict[str, str]] = {
    "hour_weekday_matrix": {"hour": "Hour"},
    "payment_summary": {"payment_type": "Payment_type", "total_payment_value": "Total Payment Value",
                        "avg_installments": "Avg Installments"},
    "orders_per_state": {"order_count": "Order Count"},
    "customer_behaviour": {"customer_id": "Customer_id", "order_count": "Order_Count",
                           "average_order_value": "Average_Order_Value"},
    "value_by_product_size": {"product_size_category": "Product_Size_Category",
                              "average_order_value": "Average_Order_Value"},
    "seller_monthly_growth": {"seller_id": "Seller_id", "year_month": "YearMonth"},
}


def with_display_names(df: DataFrame, analysis: str) -> DataFrame:
    """Rename ``df``'s columns to the original headers of ``analysis`` (others unchanged)."""
    names = DISPLAY_NAMES.get(analysis, {})
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
