"""The cleaning phase over the eight marketplace tables, as one function."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderlens.operators import cleaning

# The city spelling unified in the geolocation table, and the
# payment type whose installments are set to 0.
CITY_FIXES = {"são paulo": "sao paulo"}
UNDEFINED_PAYMENT_TYPE = "not_defined"


def prepare_tables(tables: dict[str, DataFrame], trim: bool = False,
                   undefined: str = UNDEFINED_PAYMENT_TYPE,
                   city_fixes: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Clean the tables the analyses read; tables not named here pass through.

    - sellers: whitespace runs collapsed to one blank (trimmed too if ``trim``)
    - geolocation: exact city replacements (trimmed first if ``trim``)
    - orders: rows with any missing value dropped
    - products: category name replaced by its translation (null if none)
    - payments: installments 0 for the undefined type

    ``trim`` defaults to False: the original trims were computed and thrown
    away, so its outputs are untrimmed.
    """
    out = dict(tables)
    if "sellers" in out:
        sellers = cleaning.trim_columns(out["sellers"]) if trim else out["sellers"]
        out["sellers"] = cleaning.collapse_whitespace(sellers)
    if "geolocation" in out:
        geo = cleaning.trim_columns(out["geolocation"]) if trim else out["geolocation"]
        out["geolocation"] = cleaning.replace_values(geo, city_fixes if city_fixes is not None else CITY_FIXES)
    if "orders" in out:
        out["orders"] = cleaning.drop_nulls(out["orders"])
    if "products" in out and "category_translation" in out:
        out["products"] = cleaning.lookup_translate(out["products"], out["category_translation"],
                                                    "product_category_name", "product_category_name_english")
    if "payments" in out:
        out["payments"] = cleaning.zero_undefined_installments(out["payments"], undefined=undefined)
    return out
