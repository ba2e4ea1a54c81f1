"""Times in mixed formats, precisions and zones to one UTC instant in microseconds.

All formats are compiled into one regex alternation with named groups. One regexp_replace turns a
text into its components, calendar ranges are checked, and the instant is put together by integer
day arithmetic (days from civil date), all inside code generation.

* Zone: an offset, Z/GMT/UTC or an unambiguous abbreviation in the text; else the zone given beside
  it. A wall time is tried against every offset its zone uses between lo and hi: it names an instant
  only if exactly one offset fits, so skipped and repeated wall times give null.
* Numbers count from 1970 in seconds, milli-, micro- or nanoseconds, whichever falls between lo and hi.
* Day and month that could be swapped: the day comes first; if only month-first is a date, that.
* Finer digits than microseconds are cut off. Times outside [lo, hi) are no times.
* null, blank, unknown words, impossible dates, unknown zones and wall times without zone give null.

The zones come from the public tz database as one small table (a row per zone), bounded by the number
of zones whatever the data.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime, timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LO, HI = datetime(2025, 8, 1, tzinfo=UTC), datetime(2026, 10, 1, tzinfo=UTC)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Zone abbreviations that stand for one offset, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_CLOCK = r"(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9})\d*)?)?(?:\s*(?<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?<z>[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5}))?"
# The formats, each with the named groups y mo d h mi s f ap z, or n for a number.
FORMATS = (
    r"(?<y>\d{4})[-/.](?<mo>\d{1,2})[-/.](?<d>\d{1,2})[Tt ]\s*" + _CLOCK + _ZONE,
    r"(?<y>\d{4})(?<mo>\d{2})(?<d>\d{2})[Tt](?<h>\d{2})(?<mi>\d{2})(?<s>\d{2})(?:[.,](?<f>\d{1,9})\d*)?" + _ZONE,
    r"(?<p>\d{1,2})[./-](?<q>\d{1,2})[./-](?<y>\d{4}),?[Tt ]\s*" + _CLOCK + _ZONE,
    r"(?:[A-Za-z]{3,9},?\s+)?(?<d>\d{1,2})[ -](?<mn>[A-Za-z]{3})[a-z]*\.?[ -](?<y>\d{4}),?\s+" + _CLOCK + _ZONE,
    r"(?:[A-Za-z]{3,9},\s+)?(?<mn>[A-Za-z]{3})[a-z]*\.?\s+(?<d>\d{1,2}),?\s+(?<y>\d{4}),?\s+" + _CLOCK + _ZONE,
    r"(?<n>[+-]?\d{1,20}(?:\.\d{0,12})?(?:[eE][+]?\d{1,2})?)",
)
PARTS = ("y", "mo", "mn", "d", "p", "q", "h", "mi", "s", "f", "ap", "z", "n")


def compiled() -> tuple[str, str]:
    """The alternation with numbered named groups, and the replacement that puts each part in its place."""
    import re

    alternatives, groups = [], {p: [] for p in PARTS}
    for i, f in enumerate(FORMATS):
        for p in re.findall(r"\(\?<(\w+)>", f):
            groups[p].append(f"{p}{i}")
        alternatives.append(re.sub(r"\(\?<(\w+)>", rf"(?<\g<1>{i}>", f))
    # what the format lacks stays empty, so the parts of the one that matched stand alone
    fill = "|".join("".join(f"${{{g}}}" for g in groups[p]) for p in PARTS)
    return r"^\s*(?:" + "|".join(alternatives) + r")\s*$", "\u0001|" + fill


@lru_cache(maxsize=4)
def _zone_rows(lo: datetime, hi: datetime) -> list[tuple]:
    rows, week = [], timedelta(days=7)
    for name in sorted(zoneinfo.available_timezones()):
        z, spans, t = zoneinfo.ZoneInfo(name), [], lo - timedelta(days=2)
        end = hi + timedelta(days=2)
        while t < end:
            off, nxt = t.astimezone(z).utcoffset(), t
            while nxt < end and (step := min(nxt + week, end)).astimezone(z).utcoffset() == off:
                nxt = step
            if nxt < end:  # it changes before the next step: halve to the second
                a, b = nxt, min(nxt + week, end)
                while b - a > timedelta(seconds=1):
                    m = a + timedelta(seconds=int((b - a).total_seconds()) // 2)
                    a, b = (m, b) if m.astimezone(z).utcoffset() == off else (a, m)
                nxt = b
            us = [int((x - EPOCH).total_seconds()) * 1_000_000 for x in (t, nxt)]
            spans.append((us[0], us[1], int(off.total_seconds()) * 1_000_000))
            t = nxt
        rows.append((name, spans))
    return rows


def zone_table(spark: SparkSession, lo: datetime = LO, hi: datetime = HI) -> DataFrame:
    """(zone, spans): for every zone its offsets between lo and hi as (from_us, to_us, offset_us)."""
    return spark.createDataFrame(_zone_rows(lo, hi), "zone string, spans array<struct<from_us bigint, to_us bigint, offset_us bigint>>")


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * F.when(m > 2, m - 3).otherwise(m + 9) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("bigint")


def with_instant(df: DataFrame, text: str, zone: str | None, out: str = "utc_us", lo: datetime = LO, hi: datetime = HI, settle: bool = False) -> DataFrame:
    """df with the instant named by column text, read with column zone where the text names none.

    settle: for putting rows in order only. A repeated wall time is then its first instant, a skipped one
    is read with the offset before the gap; otherwise both stay null.
    """
    lo_us, hi_us = (int((x - EPOCH).total_seconds()) * 1_000_000 for x in (lo, hi))
    pattern, fill = compiled()
    i = lambda name: F.expr(f"try_cast(nullif(__tp.{name}, '') as int)")
    split = F.split(F.regexp_replace(F.col(text), pattern, fill), r"\|", -1)
    parts = F.struct(*[F.get(F.col("__ts"), F.lit(k + 1)).alias(p) for k, p in enumerate(PARTS)])
    keep = df.columns
    x = df.withColumn("__ts", F.when(F.col(text).isNotNull(), split)).withColumn("__ts", F.when(F.get("__ts", F.lit(0)) == "\u0001", F.col("__ts"))).withColumn("__tp", parts)

    p, q = i("p"), i("q")
    month_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.col("__tp.mn"))).cast("int")
    swapped = (q > 12) & (p <= 12)
    x = x.withColumns({
        "__ty": i("y"),
        "__tmo": F.coalesce(i("mo"), F.nullif(month_name, F.lit(0)), F.when(swapped, p).otherwise(q)),
        "__td": F.coalesce(i("d"), F.when(swapped, q).otherwise(p)),
        "__tap": F.lower("__tp.ap"),
        "__th": i("h"), "__tmi": i("mi"), "__tsec": F.coalesce(i("s"), F.lit(0)),
        "__tus": F.coalesce(F.expr("try_cast(substr(rpad(nullif(__tp.f, ''), 9, '0'), 1, 6) as bigint)"), F.lit(0)),
    })
    leap = ((F.col("__ty") % 4 == 0) & (F.col("__ty") % 100 != 0)) | (F.col("__ty") % 400 == 0)
    month_len = F.when(F.col("__tmo") == 2, F.when(leap, 29).otherwise(28)).when(F.col("__tmo").isin(4, 6, 9, 11), 30).otherwise(31)
    noon = F.col("__tap") != ""
    hour = F.when(noon, F.col("__th") % 12 + F.when(F.col("__tap") == "p", 12).otherwise(0)).otherwise(F.col("__th"))
    valid = F.col("__tmo").between(1, 12) & F.col("__td").between(1, month_len) & F.when(noon, F.col("__th").between(1, 12)).otherwise(F.col("__th").between(0, 23)) & F.col("__tmi").between(0, 59) & F.col("__tsec").between(0, 59)
    wall = F.when(valid, ((_days(F.col("__ty"), F.col("__tmo"), F.col("__td")) * 24 + hour) * 60 + F.col("__tmi")) * 60_000_000 + F.col("__tsec").cast("bigint") * 1_000_000 + F.col("__tus"))

    z = F.upper("__tp.z")
    digits = F.regexp_replace("__tp.z", "[^0-9]", "")
    oh, om = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).try_cast("int"), F.lit(0))
    signed = F.col("__tp.z").rlike("^[+-]")
    off_min = F.when(signed, F.when((oh <= 18) & (om <= 59), (oh * 60 + om) * F.when(F.col("__tp.z").startswith("-"), -1).otherwise(1))).otherwise(
        F.try_element_at(F.create_map(*[v for k, m in ABBREVIATIONS.items() for v in (F.lit(k), F.lit(m))]), z)
    )
    # a number in the only unit that puts it between lo and hi
    num = F.expr("try_cast(nullif(__tp.n, '') as decimal(38,12))")
    number = F.lit(None).cast("bigint")
    for per in (1_000_000, 1_000, 1, 1 / 1000):
        low, high = (F.lit(str(round(x / per)) if per < 1 else f"{x / per:.6f}").cast("decimal(38,12)") for x in (lo_us, hi_us))
        exact = num.cast("decimal(30,9)")  # only evaluated between the bounds, where it can't overflow
        value = exact * F.lit(int(per)).cast("decimal(7,0)") if per >= 1 else exact / F.lit(1000).cast("decimal(4,0)")
        number = F.when((num >= low) & (num < high), F.floor(value).cast("bigint")).otherwise(number)

    x = x.withColumns({"__twall": wall, "__toff": off_min, "__tnum": number})
    if zone:
        zones = F.broadcast(zone_table(df.sparkSession, lo, hi).withColumnsRenamed({"zone": "__tzone", "spans": "__tspans"}))
        x = x.join(zones, F.trim(F.col(zone)) == F.col("__tzone"), "left")
        fits = F.filter("__tspans", lambda s: (F.col("__twall") - s["offset_us"] >= s["from_us"]) & (F.col("__twall") - s["offset_us"] < s["to_us"]))
        x = x.withColumn("__tfits", F.when((F.col("__tp.z") == "") & F.col("__twall").isNotNull(), fits))
        local = F.when(F.size("__tfits") == 1, F.col("__twall") - F.get("__tfits", F.lit(0))["offset_us"])
        if settle:
            near = F.filter("__tspans", lambda s: F.col("__twall") - s["offset_us"] >= s["from_us"])  # the last of these ends before the gap
            local = F.when(F.size("__tfits") > 0, F.array_min(F.transform("__tfits", lambda s: F.col("__twall") - s["offset_us"]))).when(
                (F.size("__tfits") == 0) & (F.size(near) > 0), F.col("__twall") - F.element_at(near, -1)["offset_us"]
            )
    else:
        local = F.lit(None).cast("bigint")
    us = F.coalesce(F.col("__tnum"), F.when(F.col("__tp.z") != "", F.col("__twall") - F.col("__toff").cast("bigint") * 60_000_000).otherwise(local))
    return x.withColumn(out, us).select(*keep, F.when((F.col(out) >= lo_us) & (F.col(out) < hi_us), F.col(out)).alias(out))
