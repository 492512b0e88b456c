"""Dimension frames the reports decorate their aggregates with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyshop.schema import RetailTables


def catalog(t: RetailTables) -> DataFrame:
    """Products with the names of their brand and category."""
    return t.products.join(t.brands, "brand_id").join(t.categories, "category_id")


def product_category(t: RetailTables) -> DataFrame:
    return t.products.join(t.categories, "category_id").select("product_id", "category_name")


def product_brand(t: RetailTables) -> DataFrame:
    return t.products.join(t.brands, "brand_id").select("product_id", "brand_name")


def staff_with_store(t: RetailTables) -> DataFrame:
    """Staff with the name of their home store."""
    return t.staffs.join(t.stores.select("store_id", "store_name"), "store_id")
