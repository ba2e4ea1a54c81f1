from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.operators import instants as I


def read(spark, rows, **how):
    df = spark.createDataFrame([(i, t, z, "k") for i, (t, z) in enumerate(rows)], "i int, t string, z string, _p string")
    return [r["utc_us"] for r in I.with_instant(df, "t", "z", **how).orderBy("i").collect()]


def us(*a, tz="UTC"):
    return round(datetime(*a, tzinfo=ZoneInfo(tz)).timestamp() * 1_000_000)


CASES = [
    ("2025-09-01T00:05:05.311Z", None, us(2025, 9, 1, 0, 5, 5, 311000)), ("2025-09-01 16:55:52", "Europe/Berlin", us(2025, 9, 1, 14, 55, 52)), ("2025-10-26 02:30:00", "Europe/Berlin", None), ("2026-03-29 02:30:00", "Europe/Berlin", None),
    ("1756846095478", None, 1756846095478000), ("1756889092.397870", "x", 1756889092397870), ("1.756716976703E18", None, 1756716976703000), (" 1757899895507018555 ", None, 1757899895507018), ("1757244425", None, 1757244425000000),
    ("Fri, 03 Apr 2026 05:37:40 GMT", None, us(2026, 4, 3, 5, 37, 40)), ("03.02.2026 13:19:49", "Asia/Tokyo", us(2026, 2, 3, 4, 19, 49)), ("12/31/2025 1:00 PM", "Asia/Tokyo", us(2025, 12, 31, 4)), ("Apr 24, 2026 12:28:35 AM", "America/Bogota", us(2026, 4, 24, 5, 28, 35)),
    ("2025-09-03T02:03:08,209+1000", None, us(2025, 9, 2, 16, 3, 8, 209000)), ("20250904T041315Z", None, us(2025, 9, 4, 4, 13, 15)), ("2026-03-08 01:07:01 EST", "Asia/Tokyo", us(2026, 3, 8, 6, 7, 1)), ("2025-09-01T11:02:01.137695999Z", None, us(2025, 9, 1, 11, 2, 1, 137695)),
    ("2026-02-30T00:00:00Z", None, None), ("2026-02-29T00:00:00Z", None, None), ("0000-00-00T00:00:00Z", None, None), ("NaN", None, None), ("0", "Etc/UTC", None), ("-1", None, None), ("2026-01-01 00:00:00", "Mars/Olympus", None), ("2026-01-01 00:00:00", None, None),
    (None, None, None), ("", "Etc/UTC", None), ("2026-01-01 25:00:00Z", None, None), ("2026-01-01 00:00:00 XYZ", "Etc/UTC", None), ("9" * 5000, None, None), ("1e99", None, None), ("2024-01-01T00:00:00Z", None, None),
]


def test_cases(spark):
    assert read(spark, [(t, z) for t, z, _ in CASES]) == [x for *_, x in CASES]


def test_ordering_settles_repeated_and_skipped(spark):
    assert read(spark, [("2025-10-26 02:30:00", "Europe/Berlin"), ("2026-03-29 02:30:00", "Europe/Berlin")], settle=True) == [us(2025, 10, 26, 0, 30), us(2026, 3, 29, 1, 30)]


ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "Australia/Lord_Howe", "America/Bogota", "Etc/UTC", "Pacific/Chatham"]


def brute(wall, zone):
    """All instants whose wall time in the zone is wall."""
    out = {u for m in range(-16 * 60, 16 * 60, 15) if (u := wall.replace(tzinfo=timezone.utc) + timedelta(minutes=m)).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == wall}
    return round(out.pop().timestamp() * 1_000_000) if len(out) == 1 else None


@pytest.fixture(scope="module")
def batch():
    return []


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(2025, 8, 3), datetime(2026, 9, 28)) | st.sampled_from([datetime(2025, 10, 5, 2, 15), datetime(2026, 4, 5, 1, 45), datetime(2025, 11, 2, 1, 30), datetime(2026, 3, 8, 2, 30), datetime(2026, 4, 5, 2, 50)]), st.sampled_from(ZONES))
def test_gather(batch, wall, zone):
    batch.append((wall.replace(microsecond=0), zone))


def test_walls_against_brute_force(spark, batch):
    assert read(spark, [(w.isoformat(sep=" "), z) for w, z in batch]) == [brute(w, z) for w, z in batch]


def test_empty_table(spark):
    assert read(spark, []) == []


def test_test_tables_against_the_times_beside_them(spark):
    """A span's end is right even where its start is written oddly: it starts at most some seconds before."""
    from pyspark.sql import functions as F

    from spanloom.plans.core_problems import p4_found

    d = "/root/testdata/sf0.01"
    x = spark.read.parquet(f"{d}/braintrust.parquet").selectExpr("explode(resource_spans) r").selectExpr("explode(r.scopeSpans) s").selectExpr("explode(s.spans) x").selectExpr("x.spanId row_key", "cast(x.endTimeUnixNano as bigint) div 1000 e")
    lag = p4_found(spark, d).where("src = 'braintrust'").join(x, "row_key").select(((F.col("e") - F.col("utc_us")) / 1e6).alias("lag"))
    r = lag.agg(F.count("lag").alias("n"), F.min("lag").alias("a"), F.max("lag").alias("b")).first()
    assert r.n > 0.9 * x.where("e is not null").count() and 0 <= r.a and r.b < 60  # some spans have no end
