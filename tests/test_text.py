import pytest
from pyspark.sql import functions as F

from hearthline.functions import parse as P
from hearthline.functions import text as X
from hearthline.sources.files import newest, pick_register_files
from hearthline.sources.registers import register_problem, register_sales


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, expected", [("High St", "HIGH STREET"), ("high st.", "HIGH STREET"), ("Île  Rd", "ILE ROAD"), ("St John's Ave", "STREET JOHN SOUTH AVENUE"), ("", "")])
def test_street(spark, raw, expected):
    assert one(spark, X.norm_street(F.col("s")), s=raw) == expected


@pytest.mark.parametrize("raw, expected", [("Flat 2", "2"), ("APARTMENT 2", "2"), ("Flat Unit 2b", "2B"), ("FLATIRON", "FLATIRON"), ("2", "2")])
def test_subunit(spark, raw, expected):
    assert one(spark, X.norm_subunit(F.col("s")), s=raw) == expected


@pytest.mark.parametrize("pc, parts", [("MK92AB", ("MK", "MK9", "MK9 2")), ("SW1A1AA", ("SW", "SW1A", "SW1A 1")), ("75001", ("", "", "")), ("AB", ("", "", "")), ("ABCDEF", ("", "", ""))])
def test_postcode_parts(spark, pc, parts):
    got = spark.range(1).select(*[c.alias(n) for n, c in X.postcode_parts(F.lit(pc)).items()]).first()
    assert tuple(got) == parts


def test_spellings_of_one_flat_share_a_key(spark):
    rows = spark.createDataFrame([("MK9 2AB", "12", "Flat 2", "High St"), ("mk92ab", "12", "APARTMENT 2", "HIGH STREET"), ("MK9-2AB", " 12 ", "2", "high st."), ("MK9 2AB", "12", "", "High St")],
                                 "pc string, paon string, saon string, street string")
    keys = [r.k for r in rows.select(X.property_key(F.col("pc"), F.col("paon"), F.col("saon"), F.col("street"), F.lit("Town")).alias("k")).collect()]
    assert len(set(keys[:3])) == 1 and keys[3] != keys[0] and len(keys[0]) == 24


@pytest.mark.parametrize("raw, value", [("12.5", 12.5), (" 7 ", 7.0), ("nan", None), ("NaN", None), ("1e3", 1000.0), ("12d", None), ("", None), ("Infinity", None)])
def test_number(spark, raw, value):
    assert one(spark, P.number(F.col("s")), s=raw) == value


@pytest.mark.parametrize("raw, day", [("01/02/2020", "2020-02-01"), ("2020-02-01", "2020-02-01"), ("31/02/2020", None), ("x", None)])
def test_dates(spark, raw, day):
    assert one(spark, P.date_multi(F.col("s")).cast("string"), s=raw) == day


def register_row(**changes):
    base = dict(record_id="{A}", price="250000", date="2021-03-04 00:00", postcode="MK9 2AB", type="D", new_build="N", duration="F", paon="12", saon="", street="HIGH ST",
                locality="", town="MILTON", district="MK", county="BUCKS", category="A", status="A")
    return {**base, **changes}


def test_register_rules(spark):
    bad = [register_row(status="D"), register_row(price="99"), register_row(price="abc"), register_row(price="NaN"), register_row(date="04/03/2021"), register_row(price="-5000")]
    good = [register_row(), register_row(status="C"), register_row(type="O", category="B"), register_row(category="")]
    from hearthline.constants import REGISTER_COLUMNS
    rows = spark.createDataFrame([tuple(r[c] for c in REGISTER_COLUMNS) for r in bad + good], ", ".join(f"{c} string" for c in REGISTER_COLUMNS))
    assert rows.where(register_problem().isNotNull()).count() == len(bad)
    out = register_sales(rows).collect()
    assert sorted(r.market_value_basis for r in out) == ["ADDITIONAL", "STANDARD", "STANDARD", "UNKNOWN"]
    assert sorted(r.is_residential for r in out) == [False, True, True, True]
    assert {r.address_line for r in out} == {"12 High Street"}


def test_file_choice():
    assert pick_register_files(["/a/pp-2020.csv.gz", "/a/pp-2020.csv", "/a/pp-2021.csv.gz"]) == ["/a/pp-2020.csv", "/a/pp-2021.csv.gz"]
    assert pick_register_files(["/a/pp-2020.csv", "/a/pp-2021.csv"], [2021]) == ["/a/pp-2021.csv"]
    assert newest(["f-2023-01.csv", "f-2023-12.csv"]) == "f-2023-12.csv"
