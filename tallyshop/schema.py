"""The nine-table retail model: column types, keys and references.

Types are declared, never inferred: a literal ``NULL`` in a CSV integer column
or a leading zero in a zip code would otherwise change a column's type.
Money is ``decimal(12,2)`` and discounts ``decimal(5,3)`` so that sums do not
depend on the order in which partitions are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INT, LONG, TEXT, DATE = T.IntegerType(), T.LongType(), T.StringType(), T.DateType()
MONEY, FRACTION = T.DecimalType(12, 2), T.DecimalType(5, 3)

_ADDRESS = {
    name: TEXT for name in ("phone", "email", "street", "city", "state", "zip_code")
}


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "brands": _struct(brand_id=INT, brand_name=TEXT),
    "categories": _struct(category_id=INT, category_name=TEXT),
    "stores": _struct(store_id=INT, store_name=TEXT, **_ADDRESS),
    "customers": _struct(customer_id=LONG, first_name=TEXT, last_name=TEXT, **_ADDRESS),
    "staffs": _struct(
        staff_id=LONG,
        first_name=TEXT,
        last_name=TEXT,
        email=TEXT,
        phone=TEXT,
        active=INT,
        store_id=INT,
        manager_id=LONG,
    ),
    "products": _struct(
        product_id=LONG,
        product_name=TEXT,
        brand_id=INT,
        category_id=INT,
        model_year=INT,
        list_price=MONEY,
    ),
    "stocks": _struct(store_id=INT, product_id=LONG, quantity=INT),
    "orders": _struct(
        order_id=LONG,
        customer_id=LONG,
        order_status=INT,
        order_date=DATE,
        required_date=DATE,
        shipped_date=DATE,
        store_id=INT,
        staff_id=LONG,
    ),
    "order_items": _struct(
        order_id=LONG,
        item_id=INT,
        product_id=LONG,
        quantity=INT,
        list_price=MONEY,
        discount=FRACTION,
    ),
}

#: The tables that grow with the business; all others are dimensions of these.
FACTS = ("orders", "order_items")

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "brands": ("brand_id",),
    "categories": ("category_id",),
    "stores": ("store_id",),
    "customers": ("customer_id",),
    "staffs": ("staff_id",),
    "products": ("product_id",),
    "stocks": ("store_id", "product_id"),
    "orders": ("order_id",),
    "order_items": ("order_id", "item_id"),
}

REQUIRED: dict[str, tuple[str, ...]] = {
    "brands": ("brand_name",),
    "categories": ("category_name",),
    "stores": ("store_name",),
    "customers": ("first_name", "last_name"),
    "staffs": ("first_name", "last_name"),
    "products": ("product_name",),
}


@dataclass(frozen=True)
class Reference:
    """``child.column`` must exist as ``parent.key``; a null passes."""

    child: str
    column: str
    parent: str
    key: str


REFERENCES: tuple[Reference, ...] = (
    Reference("staffs", "store_id", "stores", "store_id"),
    Reference("staffs", "manager_id", "staffs", "staff_id"),
    Reference("products", "brand_id", "brands", "brand_id"),
    Reference("products", "category_id", "categories", "category_id"),
    Reference("stocks", "store_id", "stores", "store_id"),
    Reference("stocks", "product_id", "products", "product_id"),
    Reference("orders", "customer_id", "customers", "customer_id"),
    Reference("orders", "store_id", "stores", "store_id"),
    Reference("orders", "staff_id", "staffs", "staff_id"),
    Reference("order_items", "order_id", "orders", "order_id"),
    Reference("order_items", "product_id", "products", "product_id"),
)


class RetailTables:
    """The nine tables, each opened the first time a report asks for it.

    Opening a table lists its files, which is slow for large folders, so a
    report pays only for the tables it reads.
    """

    def __init__(self, spark: SparkSession, openers: Mapping[str, Callable[[], DataFrame]]):
        missing = set(SCHEMAS) - set(openers)
        if missing:
            raise ValueError(f"no source given for {sorted(missing)}")
        self.spark = spark
        self.item_totals: DataFrame | None = None
        self._openers = dict(openers)
        self._open: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> RetailTables:
        return cls(spark, {name: (lambda df=df: df) for name, df in frames.items()})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = self._openers[name]()
        return self._open[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self[name]
        raise AttributeError(name)

    def replace(self, **frames: DataFrame) -> RetailTables:
        """The same tables with some of them swapped. Saved totals are dropped
        with the lines they were taken from."""
        openers = {n: (lambda n=n: self[n]) for n in SCHEMAS}
        openers.update({n: (lambda df=df: df) for n, df in frames.items()})
        tables = RetailTables(self.spark, openers)
        if "order_items" not in frames:
            tables.item_totals = self.item_totals
        return tables

    def with_item_totals(self, totals: DataFrame) -> RetailTables:
        """The same tables with the line totals per order already worked out."""
        tables = self.replace()
        tables.item_totals = totals
        return tables
