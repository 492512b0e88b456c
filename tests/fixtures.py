"""Small invented tables: one written by hand around the edges of the reports,
one drawn at random with nulls, unknown references and optional hot keys."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.types import DateType, DecimalType, IntegerType, LongType

from tallyshop.schema import SCHEMAS


def _arrow_type(kind):
    match kind:
        case IntegerType():
            return pa.int32()
        case LongType():
            return pa.int64()
        case DateType():
            return pa.date32()
        case DecimalType():
            return pa.decimal128(kind.precision, kind.scale)
    return pa.string()


def _save(root: str, tables: dict[str, list[tuple]]) -> str:
    for name, rows in tables.items():
        fields = SCHEMAS[name].fields
        width = len(rows[0]) if rows else 0
        columns = {}
        for i, f in enumerate(fields):
            values = [row[i] if i < width else None for row in rows]
            if isinstance(f.dataType, DecimalType):
                exp = Decimal(1).scaleb(-f.dataType.scale)
                values = [None if v is None else Decimal(str(v)).quantize(exp) for v in values]
            columns[f.name] = pa.array(values, _arrow_type(f.dataType))
        os.makedirs(f"{root}/{name}")
        pq.write_table(pa.table(columns), f"{root}/{name}/part-0.parquet")
    return root


def _d(text: str | None) -> date | None:
    return None if text is None else date.fromisoformat(text)


def _order(order_id, customer, status, placed, required, shipped, staff, store=1):
    return (order_id, customer, status, _d(placed), _d(required), _d(shipped), store, staff)


def golden_tables() -> dict[str, list[tuple]]:
    def person(i, city, state):
        return (i, f"First{i}", f"Last{i}", None, None, None, city, state, "01234")

    def staff(i, active, store, manager):
        return (i, f"Staff{i}", f"Name{i}", None, None, active, store, manager)

    def store(i, name, state):
        return (i, name, None, None, None, f"{name} City", state, None)

    return {
        "brands": [(1, "Alto"), (2, "Birk"), (3, "Cedar")],
        # Two categories share a name; one has no products.
        "categories": [(1, "Road"), (2, "Town"), (3, "Cargo"), (4, "Road")],
        # 2 has staff but no orders, 3 has neither.
        "stores": [store(1, "North", "NY"), store(2, "South", "CA"), store(3, "West", "TX")],
        "customers": [
            person(i, "Albany" if i % 2 else "Buffalo", "NY") for i in range(1, 8)
        ]
        + [person(8, "Fresno", "CA"), person(9, None, None)],
        "staffs": [
            staff(1, 1, 1, None),
            staff(2, 1, 2, 1),  # managed from another store
            staff(3, 0, 1, 1),
            staff(4, 1, 1, 2),  # no orders
            staff(5, 1, 1, 2),  # 5 and 6 sell the same amount
            staff(6, 1, 1, 1),
        ],
        "products": [
            (1, "P1", 1, 1, 2016, "499.99"),
            (2, "P2", 1, 1, 2017, "500"),
            (3, "P3", 1, 1, 2018, "999.99"),
            (4, "P4", 1, 1, 2019, "1000"),
            (5, "P5", 1, 2, 2016, "2000"),
            (6, "P6", 1, 2, 2016, "3000"),
            (7, "P7", 1, 2, 2016, None),
            (8, "P8", 2, 4, 2017, "1.00"),  # 8 and 9 average 1.005
            (9, "P9", 2, 4, 2017, "1.01"),
            (10, "P10", None, None, None, "3000.01"),
        ],
        "stocks": [(1, 1, 5), (2, 1, 7), (1, 2, 0), (1, 8, 30)],
        "orders": [
            _order(1, 2, 4, "2016-01-05", "2016-01-08", "2016-01-05", 1),
            _order(2, 3, 4, "2016-04-10", "2016-04-12", "2016-04-11", 1),
            _order(3, 3, 1, "2016-07-01", "2016-07-03", None, 3),
            _order(4, 4, 4, "2016-10-02", "2016-10-04", "2016-10-04", 5),
            _order(5, 4, 2, "2017-01-03", "2017-01-05", None, 5),
            _order(6, 4, 4, "2017-02-01", "2017-02-02", "2017-02-04", 6),
            _order(7, 5, 4, "2017-03-01", "2017-03-10", "2017-03-05", 1),
            _order(8, 5, 4, "2017-03-02", "2017-03-03", "2017-03-01", 1),
            _order(9, 5, 1, "2017-05-05", "2017-05-06", None, 1),
            _order(10, 5, 4, "2017-05-05", "2017-05-06", None, 1),
            _order(11, 6, 4, "2016-02-01", "2016-02-02", "2016-02-01", 1),
            _order(12, 6, 1, "2016-02-02", "2016-02-03", None, 1),
            _order(13, 6, 2, "2016-02-03", "2016-02-04", None, 1),
            _order(14, 6, 4, "2016-02-04", "2016-02-05", None, 1),
            _order(15, 6, 1, "2016-02-05", "2016-02-06", None, 1),  # no lines
            _order(16, 7, 3, "2016-06-01", "2016-06-02", None, 1),  # rejected
            _order(17, None, 4, "2016-08-01", "2016-08-02", "2016-08-11", 3),
            _order(18, 8, 9, "2016-09-01", "2016-09-02", None, 3),
            _order(19, 8, None, "2016-09-01", "2016-09-02", None, 3),
        ],
        "order_items": [
            (1, 1, 1, 1, "500", "0"),
            (2, 1, 1, 1, "700", "0"),
            (3, 1, 2, 1, "800", "0"),
            (4, 1, 3, 1, "750", "0"),
            (5, 1, 3, 1, "750", "0"),
            (6, 1, 1, 2, "750", "0"),
            (7, 1, 4, 1, "3000", "0"),
            (8, 1, 4, 1, "1000", "0"),
            (9, 1, 5, 2, "500", "0"),
            (10, 1, 2, 1, "1000", "0"),
            (11, 1, 1, 1, "100", "0"),
            (12, 1, 2, 1, "100", "0"),
            (13, 1, 3, 1, "100", "0"),
            (14, 1, 4, 1, "199.99", "0"),
            (16, 1, 5, 4, "1000", "0"),
            (17, 1, 6, 1, "100", "0"),
            (17, 2, 6, 1, "100", "0.05"),
            (17, 3, 6, 1, "100", "0.051"),
            (17, 4, 6, 1, "100", "0.10"),
            (17, 5, 6, 1, "100", "0.15"),
            (17, 6, 6, 1, "100", "0.20"),
            (17, 7, 6, 1, "100", "0.201"),
            (18, 1, 2, 1, "10", "0"),
            (19, 1, 2, 1, "10", "0"),
        ],
    }


def random_tables(seed: int, hot: bool = False, n_orders: int = 600) -> dict[str, list[tuple]]:
    """Tables whose keys hold but whose references and values often do not.

    With ``hot``, one order, product, customer, store and category each hold a
    third or more of their rows.
    """
    rng = random.Random(seed)

    def key(n, extra=1):
        """A key from 1 to ``n``, sometimes unknown or null, sometimes the hot one."""
        if hot and rng.random() < 0.4:
            return 1
        roll = rng.random()
        if roll < 0.05:
            return None
        return n + extra if roll < 0.1 else rng.randint(1, n)

    def maybe(value, p=0.05):
        return None if rng.random() < p else value

    def cents(top):
        return Decimal(rng.randint(0, top)) / 100

    def order(i):
        placed = maybe(date(2015, 1, 1) + timedelta(days=rng.randint(0, 1200)))
        base = placed or date(2016, 1, 1)
        return (
            i,
            key(80),
            maybe(rng.choice([1, 2, 3, 4, 4, 4, 7])),
            placed,
            maybe(base + timedelta(days=rng.randint(0, 4))),
            maybe(base + timedelta(days=rng.randint(-1, 7)), 0.3),
            key(6),
            key(20),
        )

    names = ["Ash", "Beech", "Ash", "Cedar", "Dogwood"]  # two share a name
    n_items = n_orders * 4
    return {
        "brands": [(i, f"Brand{i % 7}") for i in range(1, 9)],
        "categories": [(i, names[i - 1]) for i in range(1, 6)],
        "stores": [
            (i, f"Store{i % 5}", None, None, None, f"C{i}", maybe(f"S{i % 3}"), None)
            for i in range(1, 7)
        ],
        "customers": [
            (i, f"F{i}", f"L{i}", None, None, None, maybe(f"C{i % 9}"), maybe(f"S{i % 4}"), None)
            for i in range(1, 81)
        ],
        "staffs": [
            (i, f"F{i}", f"L{i}", None, None, maybe(rng.randint(0, 1)), key(6), key(20))
            for i in range(1, 21)
        ],
        "products": [
            (i, f"P{i % 30}", key(8), key(5), maybe(rng.randint(2016, 2019)), maybe(cents(400000)))
            for i in range(1, 61)
        ],
        "stocks": [
            (s, p, maybe(rng.randint(0, 30)))
            for s in range(1, 8)
            for p in range(1, 62)
            if rng.random() < 0.5
        ],
        "orders": [order(i) for i in range(1, n_orders + 1)],
        "order_items": [
            (
                key(n_orders),
                i,
                key(60),
                maybe(rng.randint(1, 5)),
                maybe(cents(400000)),
                maybe(Decimal(rng.randint(0, 250)) / 1000 if rng.random() < 0.8 else Decimal(0)),
            )
            for i in range(1, n_items + 1)
        ],
    }


def save_empty(root: str) -> str:
    return _save(root, {name: [] for name in SCHEMAS})


def save_golden(root: str) -> str:
    return _save(root, golden_tables())


def save_random(root: str, seed: int, hot: bool = False) -> str:
    return _save(root, random_tables(seed, hot))
