from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cellgrove.config import EngineConfig
from cellgrove.operators import clean, features
from cellgrove.sources import transactions

NAMES = ["InvoiceNo", "StockCode", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
TYPES = "InvoiceNo string, StockCode string, Quantity double, InvoiceDate string, UnitPrice double, CustomerID string, Country string"


def tx(spark, *rows):
    base = ("1", "AA1", 2.0, "2024-01-01 10:00:00", 3.0, "c1", "X")
    return spark.createDataFrame([base[: len(base) - len(r)] + r if isinstance(r, tuple) else tuple({**dict(zip(NAMES, base)), **r}.values()) for r in rows], TYPES)


def test_nan_null_and_small_prices_go(spark):
    prices = [float("nan"), None, 0.0, -1.0, 2.5]
    assert [r.UnitPrice for r in clean.clean(tx(spark, *({"UnitPrice": p} for p in prices))).collect()] == [2.5]


def test_bad_dates_go_without_error(spark):
    got = clean.clean(tx(spark, {"InvoiceDate": "bad"}, {"InvoiceDate": None}, {"InvoiceDate": "2024-05-01"})).collect()
    assert [r.InvoiceDate for r in got] == [datetime(2024, 5, 1)]


def test_missing_invoice_stays_and_customers_are_needed(spark):
    got = clean.clean(tx(spark, {"InvoiceNo": None}, {"CustomerID": None}, {"CustomerID": ""}, {"InvoiceNo": "C9"})).collect()
    assert [r.InvoiceNo for r in got] == ["nan"]


def test_cancellations_are_split_before_any_filter(spark):
    rows = tx(spark, {"InvoiceNo": "C1", "Quantity": -5.0, "Country": "Y"}, {"InvoiceNo": "C1", "Quantity": -5.0, "Country": "Y"}, {})
    assert clean.cancellations(rows).count() == 2
    assert clean.clean(rows, "X").count() == 1


def test_funnel_counts_each_step(spark):
    rows = tx(spark, {}, {}, {"CustomerID": ""}, {"Quantity": 0.0}, {"UnitPrice": None}, {"InvoiceDate": "x"}, {"InvoiceNo": "C2"}, {"Country": "Y"})
    got = {r.step: r.n_rows for r in clean.funnel(rows, "X").collect()}
    assert got == {"loaded": 8, "purchases": 7, "with_customer": 6, "positive_quantity": 5, "positive_price": 4, "distinct": 3, "with_date": 2, "country": 1}
    empty = {r.step: r.n_rows for r in clean.funnel(rows.where("false")).collect()}
    assert set(empty.values()) == {0}


def test_recency_is_in_periods_of_24_hours(spark):
    rows = clean.clean(tx(spark, {"InvoiceDate": "2024-01-01 23:00:00"}))
    got = features.profiles(rows, clean.cancellations(tx(spark)), at=datetime(2024, 1, 2, 1)).first()
    assert got.recency == 0.0
    assert features.profiles(rows, clean.cancellations(tx(spark))).first().recency == 1.0


def test_weekend_is_saturday_and_sunday(spark):
    days = tx(spark, *({"CustomerID": f"d{d}", "InvoiceDate": f"2024-01-0{d}"} for d in range(1, 8)))  # the 1st is a Monday
    got = {r.CustomerID: r.weekend_ratio for r in features.profiles(clean.clean(days), clean.cancellations(days)).collect()}
    assert {k for k, v in got.items() if v == 1.0} == {"d6", "d7"}


def test_profile_by_hand(spark):
    rows = tx(
        spark,
        {"InvoiceNo": "1", "StockCode": "AA1", "Quantity": 2.0, "UnitPrice": 3.0, "InvoiceDate": "2024-01-01"},
        {"InvoiceNo": "1", "StockCode": "AA2", "Quantity": 1.0, "UnitPrice": 4.0, "InvoiceDate": "2024-01-01"},
        {"InvoiceNo": "2", "StockCode": "BB1", "Quantity": 1.0, "UnitPrice": 8.0, "InvoiceDate": "2024-01-06"},
        {"InvoiceNo": "C7", "Country": "elsewhere"},
        {"InvoiceNo": "C8", "CustomerID": "only cancelled"},
    )
    got = features.profiles(clean.clean(rows), clean.cancellations(rows)).collect()
    assert len(got) == 1
    p = got[0].asDict()
    assert p == {"CustomerID": "c1", "recency": 1.0, "frequency": 2.0, "monetary": 18.0, "avg_basket": 9.0, "product_diversity": 3.0, "return_rate": 1 / 3, "weekend_ratio": 1 / 3, "repeat_category_rate": 2 / 3}


def test_repeat_buyers_and_top_category(spark):
    rows = spark.createDataFrame([Row(CustomerID="a", frequency=1.0), Row(CustomerID="b", frequency=2.0)])
    assert [r.CustomerID for r in features.repeat_buyers(rows).collect()] == ["b"]
    tie = features.top_category(clean.clean(tx(spark, {"StockCode": "ZZ1"}, {"StockCode": "AA1"}))).first()
    assert (tie.category, tie.n) == ("AA", 1)


def test_sheets_are_united_by_name(spark):
    one = spark.createDataFrame([("1", "c")], "Invoice string, `Customer ID` string")
    two = spark.createDataFrame([("d", 2.0)], "CustomerID string, Price double")
    got = transactions.union_sheets(one, two)
    assert got.columns == ["InvoiceNo", "CustomerID", "UnitPrice"] and got.count() == 2


def test_csv_in_latin_1(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("Price,Invoice,Customer ID,Country,Quantity\n2.5,7,c1,Côte,x\n".encode("latin-1"))
    got = transactions.read_transactions(spark, str(path)).first()
    assert (got.UnitPrice, got.InvoiceNo, got.Country, got.Quantity) == (2.5, "7", "Côte", None)
    with pytest.raises(ValueError):
        transactions.read_transactions(spark, "book.xlsx")
    with pytest.raises(FileNotFoundError):
        transactions.resolve(None, str(tmp_path / "nothing"))


def test_settings_are_checked():
    for bad in ({"xi": 1}, {"tau": 0.0}, {"tau": 1.0}, {"winsor_on": "test"}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)


def test_dirt_is_made_by_one_scan(spark, small):
    plan = transactions.with_dirt(transactions.from_star_schema(spark, small))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert plan.count("BatchScan") + plan.count("FileScan") == 4
    assert F is not None
