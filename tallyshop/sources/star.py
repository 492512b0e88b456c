"""The retail model over a TPC-H-like star of Parquet files.

The mapping is row-local, apart from lookups in dimensions (nations, regions, and the
suppliers that act as sales staff).
Columns the star does not have are derived from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyshop.operators.lookup import fits_broadcast, lookup
from tallyshop.schema import FACTS, SCHEMAS, RetailTables
from tallyshop.session import tuned


def _as(name: str, df: DataFrame, **columns: str) -> DataFrame:
    """The columns of table ``name`` in order and type, from SQL expressions
    over ``df``; those not given are null."""
    return df.selectExpr(
        *(
            f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in SCHEMAS[name]
        )
    )


def load_retail(spark: SparkSession, sf_dir: str) -> RetailTables:
    """The nine tables over the star in ``sf_dir``. Files are opened on first use."""

    schemas: dict[str, StructType] = {}

    def raw(name: str) -> DataFrame:
        # Reading a Parquet footer is a job of its own; do it once per file and call.
        path = f"{sf_dir}/{name}.parquet"
        if name not in schemas:
            schemas[name] = spark.read.parquet(path).schema
        return spark.read.schema(schemas[name]).parquet(path)

    def geography() -> DataFrame:
        regions = raw("region").selectExpr("r_regionkey AS n_regionkey", "r_name")
        return lookup(raw("nation"), regions, "n_regionkey")

    def kinds() -> DataFrame:
        # The few texts of product types, numbered in their order.
        number = F.row_number().over(Window.orderBy("p_type"))
        return raw("part").select("p_type").distinct().withColumn("kind", number)

    brand_id = "substring(p_brand, 7)"

    def brands() -> DataFrame:
        names = raw("part").select("p_brand").distinct()
        return _as("brands", names, brand_id=brand_id, brand_name="p_brand")

    def categories() -> DataFrame:
        return _as("categories", kinds(), category_id="kind", category_name="p_type")

    def stores() -> DataFrame:
        return _as(
            "stores",
            geography(),
            store_id="n_nationkey",
            store_name="n_name",
            city="n_name",
            state="r_name",
        )

    def customers() -> DataFrame:
        places = geography().selectExpr("n_nationkey AS c_nationkey", "n_name", "r_name")
        return _as(
            "customers",
            lookup(raw("customer"), places, "c_nationkey"),
            customer_id="c_custkey",
            first_name="'Customer'",
            last_name="substring(c_name, 10)",
            city="n_name",
            state="r_name",
        )

    def staffs() -> DataFrame:
        return _as(
            "staffs",
            raw("supplier"),
            staff_id="s_suppkey",
            first_name="'Supplier'",
            last_name="substring(s_name, 10)",
            active="s_acctbal >= 0",
            store_id="s_nationkey",
            manager_id="CASE WHEN s_suppkey <> 0 THEN (s_suppkey - 1) div 4 END",
        )

    def products() -> DataFrame:
        return _as(
            "products",
            lookup(raw("part"), kinds(), "p_type", "left"),
            product_id="p_partkey",
            product_name="p_name",
            brand_id=brand_id,
            category_id="kind",
            model_year="2016 + p_size % 4",
            list_price="CAST(p_retailprice AS DECIMAL(12,2)) * p_size * 0.1",
        )

    def stocks() -> DataFrame:
        # Each product is held by the stores in one of five residue classes.
        part = raw("part").where("p_partkey % 40 <> 0")
        part = part.selectExpr("p_partkey", "(5 - p_partkey % 5) % 5 AS residue")
        nation = raw("nation").selectExpr(
            "n_nationkey", "CAST(n_nationkey % 5 AS BIGINT) AS residue"
        )
        return _as(
            "stocks",
            lookup(part, nation, "residue"),
            store_id="n_nationkey",
            product_id="p_partkey",
            quantity="(p_partkey * 7 + n_nationkey * 13) % 31",
        )

    def orders() -> DataFrame:
        # Orders are dealt to all suppliers by key; an order keeps its row even if no
        # supplier has the key it is dealt to. One row per key, said by an aggregate, lets
        # Catalyst leave the join out where neither store nor seller is wanted.
        seller = F.col("s_suppkey").alias("seller")
        sellers = raw("supplier").groupBy(seller).agg(F.max("s_nationkey").alias("s_nationkey"))
        number = raw("supplier").selectExpr("max(s_suppkey) + 1 AS n")
        if fits_broadcast(sellers):
            sellers = F.broadcast(sellers)
        placed = raw("orders").selectExpr(
            "o_orderkey",
            "o_custkey",
            "o_orderpriority",
            "CASE WHEN o_orderkey % 20 = 0 THEN 3 WHEN o_orderstatus = 'P' THEN 1 "
            "WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'F' THEN 4 END AS status",
            "to_date(o_orderdate) AS day",
        ).withColumn("seller", F.col("o_orderkey") % number.scalar())
        return _as(
            "orders",
            placed.join(sellers, "seller", "left"),
            order_id="o_orderkey",
            customer_id="o_custkey",
            order_status="status",
            order_date="day",
            required_date="date_add(day, CAST(substring(o_orderpriority, 1, 1) AS INT))",
            shipped_date="CASE WHEN status = 4 THEN date_add(day, CAST(o_orderkey % 7 AS INT)) END",
            store_id="s_nationkey",
            staff_id="seller",
        )

    def order_items() -> DataFrame:
        # Prices and discounts are two-decimal doubles: go through whole hundredths.
        quantity = "nullif(CAST(l_quantity AS BIGINT), 0)"
        cents = f"floor(l_extendedprice * 100 + 0.5) div {quantity} div 10"
        return _as(
            "order_items",
            raw("lineitem"),
            order_id="l_orderkey",
            item_id="l_linenumber",
            product_id="l_partkey",
            quantity="1 + CAST(l_quantity AS INT) % 3",
            list_price=f"CAST({cents} AS DECIMAL(14,0)) * 0.01",
            discount="CAST(floor(l_discount * 100 + 0.5) AS DECIMAL(3,0)) * 0.025",
        )

    openers = {
        "brands": brands,
        "categories": categories,
        "stores": stores,
        "customers": customers,
        "staffs": staffs,
        "products": products,
        "stocks": stocks,
        "orders": orders,
        "order_items": order_items,
    }
    return RetailTables(spark, tuned(openers, FACTS))
