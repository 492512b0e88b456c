"""Operators against their plain definitions."""

import math
import random
from collections import Counter
from decimal import Decimal
from functools import partial

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyshop import functions as fn
from tallyshop import operators as ops
from tallyshop.session import ensure_checkpoint_dir, parse_bytes, tune


@pytest.fixture
def unmerged(spark):
    """Keep the small shuffle partitions, as if they were large."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, before)


def one(df):
    return df.collect()[0][0]


@pytest.mark.parametrize("n_rows", [0, 1, 2, 3, 4, 5, 7, 101, 1003])
def test_ntile_global_is_ntile(spark, unmerged, n_rows):
    rng = random.Random(n_rows)
    df = spark.createDataFrame(
        [(i, rng.randint(0, 5)) for i in range(n_rows)], "id bigint, v int"
    )
    order = [F.col("v").desc(), F.col("id").asc()]
    ours = ops.ntile_global(df, 4, order, "b")
    plain = df.withColumn("b", F.ntile(4).over(Window.orderBy(*order)))
    assert {tuple(r) for r in ours.collect()} == {tuple(r) for r in plain.collect()}
    sizes = [r[1] for r in ours.groupBy("b").count().collect()]
    assert not sizes or max(sizes) - min(sizes) <= 1


def test_global_row_number_spans_partitions(spark, unmerged):
    df = spark.range(5000).withColumn("k", F.hash("id"))
    order = [F.col("k").asc(), F.col("id").asc()]
    ours = ops.global_row_number(df, order, "rn")
    plain = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    assert ours.exceptAll(plain).isEmpty() and ours.count() == 5000


def test_global_row_number_of_equal_keys(spark, unmerged):
    # All rows share the first key; the tie-breaker orders them.
    df = spark.range(20000).withColumn("k", F.lit(1))
    ours = ops.global_row_number(df, [F.col("k").asc(), F.col("id").asc()])
    assert ours.where(F.col("rn") != F.col("id") + 1).isEmpty()


@pytest.mark.parametrize("seed", range(4))
def test_group_median_is_the_row_number_median(spark, unmerged, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["a", "b", "c", None]), rng.choice([None, *range(8)]))
        for _ in range(rng.randint(1, 60))
    ]
    df = spark.createDataFrame(rows, "g string, v int")
    group = Window.partitionBy("g")
    plain = (
        df.withColumn("n", F.count("*").over(group))
        .withColumn("rn", F.row_number().over(group.orderBy(F.col("v").asc_nulls_first())))
        .where("rn IN ((n + 1) div 2, (n + 2) div 2)")
        .groupBy("g")
        .agg(F.avg("v").alias("median"))
    )
    ours = ops.group_median(df, ["g"], "v")
    assert {tuple(r) for r in ours.collect()} == {tuple(r) for r in plain.collect()}


def test_group_median_without_nulls_is_the_builtin(spark, unmerged):
    df = spark.range(999).select((F.col("id") % 7).alias("g"), F.hash("id").alias("v"))
    ours = ops.group_median(df, ["g"], "v")
    builtin = df.groupBy("g").agg(F.median("v").alias("median"))
    assert ours.exceptAll(builtin).isEmpty()


def test_rounding_is_half_up_on_the_decimal_text(spark):
    values = [(1.005, 1.01), (2.675, 2.68), (-1.005, -1.01), (0.0, 0.0)]
    df = spark.createDataFrame(values, "x double, want double")
    assert df.where(fn.rounded("x") != F.col("want")).isEmpty()


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (None, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(fn.ratio("a", "b")).collect()] == [None, None, None]


def test_tiers(spark):
    df = spark.createDataFrame(
        [(Decimal(v) if v else None,) for v in ("-1", "0", "0.05", "0.051", "0.10", "9", None)],
        "x decimal(5,3)",
    )
    names = ("zero", "low", "high", "rest")
    bounds = (Decimal("0.05"), Decimal("0.10"))
    assert [r[0] for r in df.select(fn.tier_le("x", bounds, names)).collect()] == [
        "rest", "zero", "low", "high", "high", "rest", "rest",
    ]
    assert [r[0] for r in df.select(fn.tier_lt("x", bounds, names[:3])).collect()] == [
        "zero", "zero", "low", "low", "high", "high", "high",
    ]
    with pytest.raises(ValueError):
        fn.tier_lt("x", bounds, names)
    with pytest.raises(ValueError):
        fn.tier_le("x", bounds, names[:3])


def test_tier_counts_cover_all_rows(golden):
    from tallyshop.plans import REPORTS

    tiers = REPORTS["price_tiers"](golden)
    assert one(tiers.agg(F.sum("num_products"))) == golden.products.count()


def test_periods(spark):
    df = spark.sql("SELECT DATE '2017-09-05' AS d")
    got = df.select(
        *(fn.period("d", k) for k in ("month", "year", "quarter", "month_of_year", "month_name"))
    )
    assert tuple(got.collect()[0]) == ("2017-09", 2017, 3, 9, "September")
    with pytest.raises(ValueError):
        fn.period("d", "week")


def test_label(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "c int")
    got = df.select(fn.label("c", {1: "one"}, "other")).collect()
    assert [r[0] for r in got] == ["one", "other", "other"]


def test_count_if_and_rate(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (2,)], "c int")
    row = df.agg(fn.count_if(F.col("c") == 2), fn.rate_pct(F.col("c") == 2)).collect()[0]
    assert tuple(row) == (2, 50.0)
    assert one(df.where("c = 9").agg(fn.count_if(F.col("c") == 2))) == 0


def test_pct_of_total_both_ways(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n int")
    own = ops.pct_of_total(df, "n", "pct")
    given = ops.pct_of_total(df, "n", "pct", total_df=spark.sql("SELECT 8 AS total"))
    assert sorted(r.pct for r in own.collect()) == [25.0, 75.0]
    assert sorted(r.pct for r in given.collect()) == [12.5, 37.5]


def test_shares_add_up(spark, random_dir):
    from tallyshop import read_tables
    from tallyshop.plans import REPORTS

    t = read_tables(spark, random_dir)
    total = one(REPORTS["status_breakdown"](t).agg(F.sum("pct_of_all_orders")))
    assert total == pytest.approx(100, abs=0.05)


def test_growth_after_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 10)], "y int, v int")
    got = ops.growth_pct(df, "y", "v").orderBy("y").collect()
    assert [r.growth_pct for r in got] == [None, None, 100.0]


def test_running_total_ends_at_the_total(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 4)], "g string, y int, v int")
    whole = ops.running_total(df.groupBy("y").agg(F.sum("v").alias("v")), "y", "v")
    assert [r.running_total for r in whole.orderBy("y").collect()] == [6, 9]
    parts = ops.running_total(df, "y", "v", partition="g")
    assert [r.running_total for r in parts.orderBy("g", "y").collect()] == [2, 5, 4]


def test_rank_has_gaps(spark):
    rows = [("a", 3, 1), ("a", 3, 2), ("a", 1, 3), ("b", 9, 4)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = ops.rank_within(df, ["g"], "v", ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in got] == [1, 1, 3, 1]


@pytest.mark.parametrize("seed", range(3))
def test_rank_within_is_rank(spark, unmerged, seed):
    # Groups and runs of equal values reach over several partitions; some keys are null.
    rng = random.Random(seed)
    rows = [
        (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([0, 0, 0, 1, 2, None]), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    ours = ops.rank_within(df, ["g"], "v", ["id"], "r")
    plain = df.withColumn(
        "r", F.rank().over(Window.partitionBy("g").orderBy(F.col("v").desc())).cast("bigint")
    )
    assert ours.exceptAll(plain).isEmpty() and ours.count() == 400


@pytest.mark.parametrize("values", [1, 2, 9, 5000])
def test_groups_and_ties_over_many_partitions(spark, unmerged, values):
    # Three groups over 24 range partitions: runs of one group, and of one value, fill several.
    rng = random.Random(values)
    rows = [(rng.choice("aaaaab") if i % 50 else None, rng.randrange(values), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        ours = ops.rank_within(df, ["g"], "v", ["id"], "r").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append(v)
    ordered = {g: sorted(vs, reverse=True) for g, vs in groups.items()}
    assert len(ours) == 3000
    assert all(r.r == ordered[r.g].index(r.v) + 1 for r in ours)


def test_top_n_breaks_ties(spark):
    df = spark.createDataFrame([(i, i // 3) for i in range(9)], "id int, v int")
    got = ops.top_n(df, [F.col("v").desc()], 4, ["id"]).collect()
    assert [r.id for r in got] == [6, 7, 8, 3]


def test_unmatched_and_matched_make_the_parent(golden):
    p, i = golden.products, golden.order_items
    unsold = ops.unmatched(p, i, "product_id").count()
    sold = p.join(i, "product_id", "left_semi").count()
    assert unsold + sold == p.count()
    assert unsold == 4


def test_count_lookup_gives_zero(golden):
    got = ops.count_lookup(
        golden.stores, golden.staffs, "store_id", F.col("active") == 1, "n"
    ).select("store_id", "n")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 4), (2, 1), (3, 0)]


def test_status_pivot_counts_unknown_codes_in_the_total(golden):
    row = ops.status_pivot(golden.orders, []).collect()[0]
    known = row.pending + row.processing + row.rejected + row.completed
    assert (known, row.total_orders) == (17, 19)
    pivoted = (
        golden.orders.groupBy().pivot("order_status", [1, 2, 3, 4]).count().fillna(0).collect()[0]
    )
    assert tuple(pivoted) == (row.pending, row.processing, row.rejected, row.completed)


def test_violations_are_reported(spark, golden):
    twice = golden.orders.unionByName(golden.orders.where("order_id = 3"))
    assert [tuple(r) for r in ops.pk_violations(twice, ["order_id"]).collect()] == [(3, 2)]
    nameless = golden.brands.withColumn("brand_name", F.lit(None).cast("string"))
    assert ops.null_violations(nameless, ["brand_id", "brand_name"]).collect()[1].violations == 3
    stray = golden.orders.withColumn("store_id", F.lit(99))
    assert ops.fk_violations(stray, "store_id", golden.stores, "store_id").count() == 19
    broken = ops.validate(golden.replace(orders=stray.unionByName(stray.limit(1))))
    found = {(r[0], r[1]): r[2] for r in broken.where("violations > 0").collect()}
    assert found == {
        ("orders", "primary key (order_id)"): 1,
        ("orders", "foreign key (store_id)"): 20,
    }


def test_a_null_reference_passes(golden):
    customers = golden.customers
    assert ops.fk_violations(golden.orders, "customer_id", customers, "customer_id").isEmpty()


def test_golden_tables_are_valid(golden):
    assert ops.validate(golden).where("violations > 0").isEmpty()


def test_driver_lines_have_duplicate_keys(spark, star_dir):
    from tallyshop import load_retail

    checks = ops.validate(load_retail(spark, star_dir)).where("violations > 0").collect()
    assert [(r[0], r[1]) for r in checks] == [("order_items", "primary key (order_id, item_id)")]


def test_parse_bytes():
    assert [parse_bytes(s) for s in ("10485760b", "64MB", "1g", "-1")] == [
        10485760,
        64 << 20,
        1 << 30,
        -1,
    ]


def test_dimensions_beyond_the_limit_are_not_broadcast(spark, golden):
    assert ops.fits_broadcast(golden.products)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "100")
        assert not ops.fits_broadcast(golden.products)
        spark.conf.set(key, "-1")
        assert not ops.fits_broadcast(golden.products)
    finally:
        spark.conf.set(key, before)


def test_tune_sizes_shuffles_from_the_input(spark, golden, monkeypatch):
    from tallyshop import session

    keys = (
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.files.maxPartitionBytes",
    )
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        tune(spark, golden.orders)
        assert {k: spark.conf.get(k, None) for k in keys} == before
        monkeypatch.setattr(session, "input_bytes", lambda df: 100 * 10**12)
        tune(spark, golden.orders)
        assert int(spark.conf.get(keys[0])) == session.SHUFFLE_PARTITIONS
        assert int(spark.conf.get(keys[1])) == 500_000_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def task_settings(spark):
    keys = (
        "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst",
    )
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield keys
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tune_bounds_what_a_task_reads(spark, golden, task_settings, monkeypatch):
    from tallyshop import session

    read, skewed, initial = task_settings[:3]
    monkeypatch.setattr(session, "input_bytes", lambda df: 4 * 10**9)
    tune(spark, golden.order_items)
    assert parse_bytes(spark.conf.get(read)) == 16 << 20
    assert parse_bytes(spark.conf.get(skewed)) == 64 << 20
    # 16 MB of input each, so that 64 MB are not left to a task that cannot be split
    assert int(spark.conf.get(initial)) == math.ceil(4 * 10**9 / (16 << 20))
    spark.conf.set(read, "8MB")
    spark.conf.set(skewed, "32MB")
    tune(spark, golden.order_items)
    assert (spark.conf.get(read), spark.conf.get(skewed)) == ("8MB", "32MB")


@pytest.mark.parametrize("name", ["revenue_by_brand", "revenue_by_category"])
def test_lines_of_ten_times_the_orders_make_no_larger_task(spark, task_settings, tmp_path, monkeypatch, name):
    """Distinct orders per group: the rows that one task sorts and hashes do not grow with the table."""
    from tallyshop import read_tables, session
    from tallyshop.operators import valid_lines
    from tallyshop.plans import REPORTS, sales
    from tests.fixtures import _save, random_tables

    read, _, initial, least, parallel = task_settings
    monkeypatch.setattr(session, "tune", partial(tune, max_task_bytes=8 << 10))
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    unchanged = spark.conf.get(broadcast)
    for k, v in ((initial, "64"), (least, "1KB"), (parallel, "false"), (broadcast, "-1")):
        spark.conf.set(k, v)
    try:
        largest = []
        for n in (600, 6000):
            t = read_tables(spark, _save(str(tmp_path / str(n)), random_tables(5, n_orders=n)))
            names = sales.product_brand(t) if name == "revenue_by_brand" else sales.product_category(t)
            lines = valid_lines(t, t.order_items.join(names, "product_id"))
            counts = lines.groupBy(F.spark_partition_id()).count().select("count").collect()
            largest.append(max(r[0] for r in counts))
            got = REPORTS[name](t).select(name.split("_by_")[1] + "_name", "num_orders").collect()
            key = got[0].__fields__[0]
            pairs = Counter(r[0] for r in lines.select(key, "order_id").distinct().collect())
            assert {r[0]: r[1] for r in got} == pairs
        assert largest[1] <= 2 * largest[0]
    finally:
        spark.conf.set(broadcast, unchanged)


@pytest.mark.parametrize("configured", ["/shared/checkpoints", None])
def test_checkpoint_folder_comes_from_the_session(configured):
    class Context:
        master = "spark://cluster"
        chosen = None

        @classmethod
        def getCheckpointDir(cls):
            return cls.chosen

        @classmethod
        def setCheckpointDir(cls, path):
            cls.chosen = path

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return "/shared/warehouse" if key == "spark.sql.warehouse.dir" else configured

    # Without a setting, the warehouse is the folder that all executors share.
    expected = configured or "/shared/warehouse/_checkpoints"
    assert ensure_checkpoint_dir(Session) == expected == Context.chosen


def test_a_local_session_has_a_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark)


@pytest.mark.parametrize("seed", range(6))
def test_group_median_over_wide_values(spark, seed):
    # Both signs, powers of two and their neighbours, fractions, equal values, nulls and weights.
    import statistics

    rng = random.Random(seed)
    pool = [s * (2.0**e + d) for e in range(0, 40, 3) for d in (-0.01, 0, 0.01) for s in (1, -1)]
    pool += [0.0, 0.25, -0.25, None]
    rows = [
        (rng.choice(["a", "b", None]), rng.choice(pool if seed % 2 else pool[:9]), rng.randint(1, 4))
        for _ in range(rng.randint(3, 90))
    ]
    df = spark.createDataFrame(rows, "g string, v double, n int")
    expected = {}
    for g in {r[0] for r in rows}:
        values = sorted(
            (v for k, v, n in rows if k == g for _ in range(n)), key=lambda v: (v is not None, v or 0)
        )
        middle = [v for v in (values[(len(values) - 1) // 2], values[len(values) // 2]) if v is not None]
        expected[g] = statistics.fmean(middle) if middle else None
    found = {r.g: r.m for r in ops.group_median(df, ["g"], "v", "m", weight="n").collect()}
    assert found == expected


def test_ranges_never_fall(spark):
    from tallyshop.operators.stats import _value_range

    values = sorted({s * (2.0**e + d / 64) for e in range(-2, 50) for d in range(-3, 4) for s in (1, -1)})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranges = [r[1] for r in sorted(df.select("v", _value_range(F.col("v"))).collect())]
    assert ranges == sorted(ranges) and min(ranges) > -1e6


@pytest.mark.parametrize("spread", [1, 40_000, 10**12])
def test_distinct_ids_are_countdistinct(spark, spread):
    rng = random.Random(spread)
    edges = [0, -1, 1, 32767, 32768, 32769, -32768, 2**62, None]
    rows = [(rng.choice(["a", "b", None]), rng.choice([*edges, rng.randrange(100) * spread])) for _ in range(2000)]
    df = spark.createDataFrame(rows + [("none", None)], "g string, id bigint").repartition(5)
    ours = ops.count_distinct_ids(df, ["g"], "id", "n")
    plain = df.groupBy("g").agg(F.countDistinct("id").alias("n"))
    assert {tuple(r) for r in ours.collect()} == {tuple(r) for r in plain.collect()}
    assert ops.count_distinct_ids(df.limit(0), ["g"], "id").isEmpty()
