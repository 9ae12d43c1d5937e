from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketwise.schema import HOUSEHOLDS, PRODUCTS, TRANSACTIONS  # noqa: E402
from basketwise.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make transactions from (household, basket, date, product, spend, units, region)."""

    def make(rows):
        full = []
        for hshd, basket, day, product, spend, units, region in rows:
            day = date.fromisoformat(day) if day else None
            amount = None if spend is None else Decimal(str(spend))
            full.append((basket, hshd, day, product, amount, units, region, 1, day.year if day else None))
        return spark.createDataFrame(full, TRANSACTIONS)

    return make


@pytest.fixture
def products(spark):
    def make(rows):
        return spark.createDataFrame([(n, d, c, "PRIVATE", "N") for n, d, c in rows], PRODUCTS)

    return make


@pytest.fixture
def households(spark):
    def make(rows):
        return spark.createDataFrame(
            [(n, flag, age, "Married", "50-74K", "Renter", "Single", 2, 0) for n, flag, age in rows], HOUSEHOLDS
        )

    return make


def as_dicts(df):
    return [row.asDict() for row in df.collect()]
