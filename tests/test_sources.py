"""Readers and writers."""

import pytest
from pyspark.sql import functions as F

from tallyshop import (
    read_by_year,
    read_table,
    read_tables,
    save_bucketed,
    write_by_year,
    write_tables,
)
from tallyshop.operators import save_item_totals
from tallyshop.plans import REPORTS, run
from tallyshop.schema import SCHEMAS, RetailTables


def write(path, *lines):
    path.write_bytes("\r\n".join(lines).encode() + b"\r\n")
    return str(path)


def test_csv_null_literal_and_crlf(spark, tmp_path):
    path = write(
        tmp_path / "staffs.csv",
        "staff_id,first_name,last_name,email,phone,active,store_id,manager_id",
        "1,Ann,Lee,a@x,(555) 123-0000,1,1,NULL",
        "2,Bob,Ray,b@x,NULL,1,2,1",
    )
    rows = read_table(spark, path, "staffs").orderBy("staff_id").collect()
    assert rows[0].manager_id is None and rows[1].manager_id == 1
    assert rows[0].phone == "(555) 123-0000" and rows[1].phone is None


def test_csv_quotes_and_commas(spark, tmp_path):
    path = write(
        tmp_path / "products.csv",
        "product_id,product_name,brand_id,category_id,model_year,list_price",
        '1,"Girl\'s 20"" Bike - 2018",1,2,2018,349.99',
        '2,"Tandem, red",1,2,2018,1000',
    )
    df = read_table(spark, path, "products").orderBy("product_id")
    assert [r.product_name for r in df.collect()] == ["Girl's 20\" Bike - 2018", "Tandem, red"]
    assert df.schema == SCHEMAS["products"]


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = write(
        tmp_path / "stores.csv",
        "store_id,store_name,phone,email,street,city,state,zip_code",
        "1,North,NULL,NULL,1 Road,Springfield,MA,01234",
    )
    assert read_table(spark, path, "stores").collect()[0].zip_code == "01234"


def test_csv_that_does_not_fit_fails(spark, tmp_path):
    path = write(tmp_path / "brands.csv", "brand_id,brand_name", "x,Alto")
    with pytest.raises(Exception, match="Malformed records"):
        read_table(spark, path, "brands").collect()


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        read_table(spark, "x", "brands", "xml")


def test_tables_need_all_nine(spark, golden):
    with pytest.raises(ValueError):
        RetailTables.of(spark, brands=golden.brands)
    with pytest.raises(AttributeError):
        golden.nothing


def test_write_again_replaces(spark, golden, tmp_path):
    root = str(tmp_path)
    write_tables(golden, root)
    write_tables(golden, root)
    back = read_tables(spark, root)
    for name in SCHEMAS:
        assert back[name].schema == SCHEMAS[name]
        assert back[name].count() == golden[name].count()


def test_csv_folder(spark, golden, tmp_path):
    for name in SCHEMAS:
        golden[name].write.csv(f"{tmp_path}/{name}.csv", header=True, nullValue="NULL", escape='"')
    back = read_tables(spark, str(tmp_path), "csv")
    assert run("clv_tiers", back).collect() == run("clv_tiers", golden).collect()


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bucketed_orders_join_without_an_exchange(spark, golden, tmp_path):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    saved = save_bucketed(golden, "shop", 4, str(tmp_path))
    try:
        spark.conf.set(key, "-1")
        plan = exchanges(REPORTS["monthly_revenue"](saved))
        assert "hashpartitioning(order_id" not in plan
        assert "SortMergeJoin" in plan
        for name in ("monthly_revenue", "revenue_by_category", "discount_tiers"):
            assert REPORTS[name](saved).collect() == REPORTS[name](golden).collect()
    finally:
        spark.conf.set(key, before)
        spark.sql("DROP DATABASE shop CASCADE")


def test_an_order_too_large_for_a_bucket_is_refused(spark, skewed_dir):
    hot = read_tables(spark, skewed_dir)
    with pytest.raises(ValueError, match="one order has"):
        save_bucketed(hot, "default", 64)


def test_saved_item_totals_replace_the_lines(spark, golden, tmp_path):
    saved = save_item_totals(golden, f"{tmp_path}/totals")
    plan = exchanges(REPORTS["clv_top"](saved))
    assert "order_items" not in plan
    for name in ("clv_top", "store_comparison", "segment_revenue", "yearly_growth"):
        assert sorted(REPORTS[name](saved).collect()) == sorted(REPORTS[name](golden).collect())
    # New lines make the saved totals stale.
    fewer = saved.replace(order_items=golden.order_items.where(F.col("order_id") < 5))
    assert fewer.item_totals is None


def test_a_write_that_fails_leaves_the_old_table(spark, golden, tmp_path):
    write_tables(golden, str(tmp_path), ["orders", "brands"])
    before = sorted(p.name for p in tmp_path.iterdir())
    # all rows but one can be written
    checked = F.when(F.col("order_id") == 9, F.raise_error(F.lit("no such order")).cast("bigint"))
    broken = golden.orders.repartition(3).withColumn("order_id", F.coalesce(checked, "order_id"))
    with pytest.raises(Exception, match="no such order"):
        write_tables(golden.replace(orders=broken), str(tmp_path), ["orders"])
    assert read_tables(spark, str(tmp_path)).orders.exceptAll(golden.orders).isEmpty()
    assert read_tables(spark, str(tmp_path)).orders.count() == golden.orders.count()
    assert sorted(p.name for p in tmp_path.iterdir()) == before


def test_a_table_may_be_replaced_by_what_is_read_from_it(spark, golden, tmp_path):
    write_tables(golden, str(tmp_path), ["brands"])
    stored = read_table(spark, f"{tmp_path}/brands", "brands", "parquet")
    write_tables(golden.replace(brands=stored.where("brand_id > 1")), str(tmp_path), ["brands"])
    left = read_table(spark, f"{tmp_path}/brands", "brands", "parquet")
    assert sorted(r.brand_id for r in left.collect()) == [2, 3]
    write_tables(golden, str(tmp_path), ["brands"], mode="append")
    assert read_table(spark, f"{tmp_path}/brands", "brands", "parquet").count() == 5


def test_one_year_reads_one_folder(spark, random_dir, tmp_path):
    t, root = read_tables(spark, random_dir), str(tmp_path)
    write_by_year(t, root)
    whole = read_by_year(spark, root)
    for name in SCHEMAS:
        assert whole[name].schema == t[name].schema
        assert whole[name].exceptAll(t[name]).isEmpty() and whole[name].count() == t[name].count()
    # files of other years cannot even be read
    for table in ("orders", "order_items"):
        for folder in (tmp_path / table).iterdir():
            if folder.name.startswith("order_year=") and folder.name != "order_year=2016":
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"not parquet")
    year = read_by_year(spark, root, 2016, 2016)
    expected = REPORTS["yearly_growth"](t).where("order_year = 2016").drop("yoy_growth_pct")
    found = REPORTS["yearly_growth"](year)
    assert found.drop("yoy_growth_pct").collect() == expected.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(order_year#") >= 2 and "PartitionFilters: [isnotnull(order_year" in plan
    with pytest.raises(Exception):
        read_by_year(spark, root, 2017, 2017).orders.collect()


def test_a_hot_year_is_written_by_several_tasks(spark, golden, tmp_path):
    rows = spark.range(200_000).selectExpr(
        "id AS order_id", "id AS customer_id", "1 AS order_status", "DATE '2017-01-01' AS order_date",
        "DATE '2017-01-02' AS required_date", "CAST(NULL AS DATE) AS shipped_date", "1 AS store_id", "id AS staff_id",
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "200KB")
    try:
        write_by_year(golden.replace(orders=rows), str(tmp_path))
    finally:
        spark.conf.set(key, before)
    assert len(list((tmp_path / "orders" / "order_year=2017").glob("*.parquet"))) > 1


def test_the_session_is_prepared_when_facts_are_first_opened(spark, golden_dir, monkeypatch):
    from tallyshop import session

    seen = []
    monkeypatch.setattr(session, "tune", lambda spark, df: seen.append(df.columns[0]))
    t = read_tables(spark, golden_dir)
    assert t.brands.count() and seen == []
    assert t.order_items.count() and t.order_items.count() and seen == ["order_id"]
