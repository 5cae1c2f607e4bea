"""Date normalisation against hand-made cases and against Python's own zone rules."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.timestamps import days_from_civil, normalize_document_dates
from gleanery.plans.dates import QUERIES

DOCS = T.StructType([T.StructField("proc_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("published_date", T.StringType()), T.StructField("modified_date", T.StringType()), T.StructField("zone_id", T.StringType())])
ZONES = "domain string, zone_id string, locale_code string"

CASES = [
    ("2020-01-03T19:09:59Z", "us", "2020-01-03T19:09:59.000Z"),
    ("2020-01-04t20:53:05.999999999z", "us", "2020-01-04T20:53:05.999Z"),
    ("  2020-01-04 20:53  ", "us", "2020-01-05T01:53:00.000Z"),
    ("2021-11-07 01:30:00", "us", "2021-11-07T05:30:00.000Z"),  # occurs twice: the earlier one
    ("2021-03-14 02:30:00", "us", "2021-03-14T07:30:00.000Z"),  # skipped: forward by the gap
    ("2024-02-29", "de", "2024-02-28T23:00:00.000Z"),
    ("2023-02-29", "de", None),
    ("0000-00-00 00:00:00", "de", None),
    ("31.06.2022", "de", None),
    ("2024-13-05T10:00:00Z", "de", None),
    ("2024-01-05T24:10:00Z", "de", None),
    ("03/04/2021 10:00", "us", "2021-03-04T15:00:00.000Z"),
    ("03/04/2021 10:00", "de", "2021-04-03T08:00:00.000Z"),
    ("13/04/2021", "us", None),
    ("1/2/2021, 12:05 a.m.", "us", "2021-01-02T05:05:00.000Z"),
    ("1/2/2021, 12:05 PM", "us", "2021-01-02T17:05:00.000Z"),
    ("1/2/2021, 13:05 PM", "us", None),
    ("April 3, 2024 at 10:09 p.m.", "us", "2024-04-04T02:09:00.000Z"),
    ("24 de diciembre de 2020, 04:19", "de", "2020-12-24T03:19:00.000Z"),
    ("1 июня 2021 г., 01:59", "de", "2021-05-31T23:59:00.000Z"),
    ("12 décembre 2022 à 19h36", "de", "2022-12-12T18:36:00.000Z"),
    ("28. Februar 2023, 12:35 Uhr", "de", "2023-02-28T11:35:00.000Z"),
    ("12 agosto 2022 ore 02:01", "de", "2022-08-12T00:01:00.000Z"),
    ("Sun, 06 Nov 1994 08:49:37 GMT", "de", "1994-11-06T08:49:37.000Z"),
    ("Fri, 1 Mar 2024 16:41:49 +0100", "us", "2024-03-01T15:41:49.000Z"),
    ("2020-01-17 02:56:18 +12:45", "us", "2020-01-16T14:11:18.000Z"),
    ("2020-01-18 01:57:07 EST", "de", "2020-01-18T06:57:07.000Z"),
    ("2020-01-18 01:57:07 EST", "au", "2020-01-17T15:57:07.000Z"),
    ("2020-01-18 01:57:07 QQQ", "de", None),
    ("2020-01-03T10:22:22+11:00[Australia/Sydney]", "us", "2020-01-02T23:22:22.000Z"),
    ("2020-01-03T10:22:22[Europe/Paris]", "us", "2020-01-03T09:22:22.000Z"),
    ("2020-01-03T10:22:22[Mars/Base]", "us", None),
    ("20200112T175622Z", "us", "2020-01-12T17:56:22.000Z"),
    ("20200111173042", "us", "2020-01-11T22:30:42.000Z"),
    ("20200202", "us", "2020-02-02T05:00:00.000Z"),
    ("1578111248.73", "us", "2020-01-04T04:14:08.730Z"),
    ("1579293874258", "us", "2020-01-17T20:44:34.258Z"),
    ("2 days ago", "us", None),
    ("Invalid Date", "us", None),
    ("", "us", None),
    (None, "us", None),
    ("2020-01-01 10:00:00", "nowhere", None),
    ("2020-01-01T10:00:00Z", "nowhere", "2020-01-01T10:00:00.000Z"),
    ("x" * 20000 + "2020-01-01", "us", None),
]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("us.example", "America/New_York", "en_US"), ("www.DE.example", "Europe/Berlin", "de_DE"), ("au.example", "Australia/Sydney", "en_AU"), ("bad.example", "No/Zone", None)], ZONES)


def test_cases(spark, zones):
    rows = [(i, f"https://www.{site}.example/x", value, None, "clash") for i, (value, site, _) in enumerate(CASES)]
    found = normalize_document_dates(spark.createDataFrame(rows + rows[:5], DOCS), zones).collect()
    got = {r.proc_id: r.utc_ts for r in found}
    assert len(found) == len(got)
    assert {i: got.get(i) for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}
    assert {r.field for r in found} == {"published_date"}


def test_empty_and_nulls(spark, zones):
    assert normalize_document_dates(spark.createDataFrame([], DOCS), zones).count() == 0
    rows = [(None, None, "2020-01-01T00:00:00Z", None, None), (1, "", None, "2020-01-01", None), (2, "http://bad.example/", "2020-01-01", "2020-01-01T05:00Z", None)]
    got = {(r.proc_id, r.field): r.utc_ts for r in normalize_document_dates(spark.createDataFrame(rows, DOCS), zones).collect()}
    assert got == {(None, "published_date"): "2020-01-01T00:00:00.000Z", (2, "modified_date"): "2020-01-01T05:00:00.000Z"}
    assert normalize_document_dates(spark.createDataFrame(rows, DOCS), zones.limit(0)).count() == 2


def test_day_arithmetic(spark):
    days = spark.range(-800, 20000, 137).select(F.expr("date_add(date'1970-01-01', cast(id as int))").alias("day"), "id")
    assert days.where(days_from_civil(F.year("day").cast("long"), F.month("day").cast("long"), F.day("day").cast("long")) != F.col("id")).count() == 0


def test_plain_local_times_agree_with_python(spark, small):
    got = {(r.proc_id, r.field): r.utc_ts for r in QUERIES["p6_found"](spark, small).collect()}
    docs = {r.proc_id: r for r in spark.read.parquet(f"{small}/processed_docs.parquet").collect()}
    zones = {r.domain: r.zone_id for r in spark.read.parquet(f"{small}/site_zones.parquet").collect()}
    seen = 0
    for r in docs.values():
        site = r.url.split("://")[1].split("/")[0].lower().removeprefix("www.")
        for field in ("published_date", "modified_date"):
            try:
                local = dt.datetime.strptime(r[field] or "", "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zones[site]))
            except ValueError:
                continue
            seen += 1
            assert got[r.proc_id, field] == local.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    assert seen
