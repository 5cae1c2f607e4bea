"""Mixed timestamp formats to one UTC instant.

Every accepted format is one branch of a single anchored regular expression with named groups. One regexp_replace
call extracts the components (the groups of the branches that didn't match are empty), and the instant is put together
by integer day arithmetic, so the whole operator stays inside generated JVM code: no UDF, no chain of parse attempts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.sites import site_of

# Month names of the languages en de fr es it pt nl ru, January first.
MONTH_NAMES = [
    "january february march april may june july august september october november december",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "januari februari maart april mei juni juli augustus september oktober november december",
    "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
]
# Further spellings that no rule below gives.
MONTH_EXTRAS = {"jänner": 1, "setiembre": 9, "mrt": 3, "янв": 1, "май": 5, "июнь": 6, "июль": 7, "январь": 1, "февраль": 2, "март": 3, "апрель": 4, "август": 8, "сентябрь": 9, "октябрь": 10, "ноябрь": 11, "декабрь": 12}

# Abbreviated zones, minutes east of UTC.
ZONE_MINUTES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "met": 60, "mest": 120,
    "eet": 120, "eest": 180, "msk": 180, "msd": 240, "ist": 330, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630,
    "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "brst": -120, "art": -180, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
# Abbreviations that mean another offset in some zones, as (abbreviation, zone prefix, minutes).
ZONE_MEANINGS = [
    ("est", "Australia/", 600), ("edt", "Australia/", 660), ("ist", "Europe/Dublin", 60), ("ist", "Asia/Jerusalem", 120), ("cst", "Asia/", 480),
    ("cst", "America/Havana", -300), ("cdt", "America/Havana", -240), ("bst", "Asia/Dhaka", 360), ("cst", "Australia/", 570), ("ast", "Asia/", 180),
]

#: Language and country of sites whose dates put the month first.
MONTH_FIRST = ("en_us",)
_SEP = "\u0001"
_PARTS = ("y", "m", "w", "d", "a", "b", "h", "i", "s", "f", "p", "z", "r", "e", "g")


def _months() -> dict[str, int]:
    """Full names, and by rule their first three and four letters where these mean one month only."""
    full: dict[str, int] = {}
    short: dict[str, set[int]] = {}
    for names in MONTH_NAMES:
        for number, name in enumerate(names.split(), 1):
            full[name] = number
            for n in (3, 4):
                short.setdefault(name[:n], set()).add(number)
    return {k: v.pop() for k, v in short.items() if len(v) == 1} | MONTH_EXTRAS | {"sept": 9} | full


def pattern() -> str:
    """The alternation. Group names are a part's letter and the number of its branch."""

    def clock(n: str) -> str:
        zone = rf"(?<z{n}>[+-]\d{{2}}:?\d{{2}}|[+-]\d{{2}}|(?:(?:UTC|GMT)?[+-]\d{{1,2}}(?::?\d{{2}})?)|[A-Za-z]{{1,5}})"
        return (
            rf"(?<h{n}>\d{{1,2}})[:h](?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d{{1,9}}))?)?"
            rf"(?:\s*(?<p{n}>[AaPp]\.?[Mm]\.?)(?![A-Za-z]))?(?:\s*Uhr)?(?:\s*{zone})?(?:\s*\[(?<r{n}>[A-Za-z0-9_+\-/]+)\])?"
        )

    gap = r"(?:\s*,)?\s+(?:(?:à|às|as|a\s+las|om|ore|alle|at|um|в)\s+)?"
    branches = [
        rf"(?<y1>\d{{4}})-(?<m1>\d{{1,2}})-(?<d1>\d{{1,2}})(?:(?:[Tt]|\s+){clock('1')})?",
        rf"(?<y2>\d{{4}})(?<c2>[/.])(?<m2>\d{{1,2}})\k<c2>(?<d2>\d{{1,2}})(?:(?:[Tt]|{gap}){clock('2')})?",
        r"(?<y3>\d{4})(?<m3>\d{2})(?<d3>\d{2})(?:[Tt]?(?<h3>\d{2})(?<i3>\d{2})(?:(?<s3>\d{2})(?:[.,](?<f3>\d{1,9}))?)?\s*(?<z3>Z|z|[+-]\d{2}:?\d{2})?)?",
        r"(?<e4>-?\d{9,10})(?:\.(?<f4>\d{1,9}))?",
        r"(?<g5>\d{12,13})",
        rf"(?:\p{{L}}{{2,12}}\.?,?\s+)?(?<d6>\d{{1,2}})(?:\.|st|nd|rd|th|º|°)?\s+(?:de\s+)?(?<w6>\p{{L}}{{3,12}})\.?,?\s+(?:de\s+)?(?<y6>\d{{4}})(?:\s+г\.?)?(?:{gap}{clock('6')})?",
        rf"(?:\p{{L}}{{2,12}}\.?,?\s+)?(?<w7>\p{{L}}{{3,12}})\.?\s+(?<d7>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?<y7>\d{{4}})(?:{gap}{clock('7')})?",
        rf"(?<a8>\d{{1,2}})(?<c8>[/.-])(?<b8>\d{{1,2}})\k<c8>(?<y8>\d{{4}})(?:{gap}{clock('8')})?",
        r"(?<d9>\d{1,2})-(?<w9>\p{L}{3,12})-(?<y9>\d{4})(?:\s+(?<h9>\d{1,2}):(?<i9>\d{2})(?::(?<s9>\d{2}))?(?:\s*(?<z9>[+-]\d{2}:?\d{2}|[A-Za-z]{1,5}))?)?",
        r"\p{L}{3}\s+(?<w10>\p{L}{3})\s+(?<d10>\d{1,2})\s+(?<h10>\d{2}):(?<i10>\d{2}):(?<s10>\d{2})\s+(?:(?<z10>[A-Za-z]{1,5})\s+)?(?<y10>\d{4})",
    ]
    return r"(?s)^[\s\p{Z}﻿]*(?:" + "|".join(f"(?:{b})" for b in branches) + r")[\s\p{Z}]*$"


def _replacement(regex: str) -> str:
    import re

    names = re.findall(r"\(\?<([a-z])(\d+)>", regex)
    return _SEP + _SEP.join("".join(f"${{{p}{n}}}" for q, n in names if q == p) for p in _PARTS)


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date, in integers only (years 0 to 9999)."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(shifted / 400)
    yoe = shifted - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return era * 146097 + doe - 719468


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when((m == 2) & leap, 29).when(m == 2, 28).otherwise(31)


def known_zones(spark) -> list[str]:
    """Names that the executors' time-zone rules know: a bounded list, so that unknown names give null instead of an error."""
    return sorted(str(x) for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())


def with_utc_instant(df: DataFrame, text: str, zone: str, locale: str, out: str = "utc_instant") -> DataFrame:
    """Add `out`, the UTC timestamp that the string column `text` names, or null where it names no existing day or moment.

    zone: column with the IANA zone of values without their own; null or unknown: such values give null.
    locale: column such as en_US; of a/b/yyyy dates it decides which is the month (month first for en_US only, else day first; null: day first).
    A local time that occurs twice means its earlier moment, a skipped one moves forward by the gap; a day alone means local midnight;
    missing seconds are 0; digits beyond milliseconds are cut. Null, empty and blank values give null. No column of df is lost or
    overwritten (working columns carry a reserved prefix); rows are neither dropped nor repeated.
    """
    regex, w = pattern(), "__ts_"
    df = df.withColumn(w + "p", F.split(F.regexp_replace(F.col(text), regex, _replacement(regex)), _SEP))
    get = {p: F.nullif(F.get(F.col(w + "p"), F.lit(i + 1)), F.lit("")) for i, p in enumerate(_PARTS)}
    df = df.withColumn(w + "t", F.struct(*[get[p].alias(p) for p in _PARTS]))
    t = {p: F.col(w + "t")[p] for p in _PARTS}
    num = lambda p: t[p].cast("long")
    months = F.create_map(*[F.lit(x) for kv in _months().items() for x in kv])
    month_first = F.lower(F.replace(F.col(locale), F.lit("-"), F.lit("_"))).isin(*MONTH_FIRST)
    zone_text = F.lower(F.regexp_replace(F.regexp_replace(t["z"], "^(?i:UTC|GMT)(?=[+-])", ""), ":", ""))
    bare = F.regexp_replace(zone_text, "^[+-]", "")
    region = F.coalesce(t["r"], F.trim(F.col(zone)))
    df = df.withColumn(
        w + "c",
        F.struct(
            num("y").alias("y"),
            F.coalesce(num("m"), months[F.lower(t["w"])], F.when(month_first, num("a")).otherwise(num("b"))).alias("m"),
            F.coalesce(num("d"), F.when(month_first, num("b")).otherwise(num("a"))).alias("d"),
            num("h").alias("h"),
            F.coalesce(num("i"), F.lit(0)).alias("i"),
            F.coalesce(num("s"), F.lit(0)).alias("s"),
            F.coalesce(F.rpad(F.substring(t["f"], 1, 3), 3, "0").cast("long"), F.lit(0)).alias("f"),
            F.lower(F.substring(t["p"], 1, 1)).alias("p"),
            zone_text.alias("z"),
            F.lpad(F.when(F.length(bare) <= 2, F.concat(bare, F.lit("00"))).otherwise(bare), 4, "0").alias("o"),
            F.when(region.isin(*known_zones(df.sparkSession)), region).alias("r"),
            num("e").alias("e"),
            num("g").alias("g"),
        ),
    )
    c = {k: F.col(w + "c")[k] for k in "y m d h i s f p z o r e g".split()}
    clock_ok = F.when(c["p"].isNotNull(), c["h"].between(1, 12)).otherwise(F.coalesce(c["h"], F.lit(0)) <= 23) & (c["i"] <= 59) & (c["s"] <= 59)
    hour = F.when(c["p"] == "p", c["h"] % 12 + 12).when(c["p"] == "a", c["h"] % 12).otherwise(F.coalesce(c["h"], F.lit(0)))
    hh, mm = F.substring(c["o"], 1, 2).cast("long"), F.substring(c["o"], 3, 2).cast("long")
    numeric = F.when(c["z"].rlike(r"^[+-]\d{1,4}$") & (hh <= 18) & (mm <= 59), F.when(c["z"].startswith("-"), -1).otherwise(1) * (hh * 60 + mm))
    named = F.create_map(*[F.lit(x) for kv in ZONE_MINUTES.items() for x in kv])[c["z"]]
    special = reduce(lambda acc, x: acc.when((c["z"] == x[0]) & F.col(zone).startswith(x[1]), x[2]), ZONE_MEANINGS, F.when(F.lit(False), F.lit(0)))
    df = df.withColumn(
        w + "k",
        F.struct(
            (clock_ok & (c["y"] >= 1) & c["m"].between(1, 12) & (c["d"] >= 1) & (c["d"] <= _days_in_month(c["y"], c["m"]))).alias("ok"),
            ((((days_from_civil(c["y"], c["m"], c["d"]) * 24 + hour) * 60 + c["i"]) * 60 + c["s"]) * 1000 + c["f"]).alias("ms"),
            F.coalesce(numeric, special, named).alias("offset"),
        ),
    )
    k = {x: F.col(w + "k")[x] for x in ("ok", "ms", "offset")}
    epoch = F.coalesce(c["g"], c["e"] * 1000 + F.when(c["e"] < 0, -c["f"]).otherwise(c["f"]))
    moment = (
        F.when(epoch.isNotNull(), F.timestamp_millis(epoch))
        .when(k["ok"] & c["z"].isNotNull(), F.timestamp_millis(k["ms"] - k["offset"] * 60000))
        .when(k["ok"] & c["r"].isNotNull(), F.to_utc_timestamp(F.timestamp_millis(k["ms"]), c["r"]))
    )
    return df.withColumn(out, moment).drop(*[w + x for x in "ptck"])


def iso_millis(ts: Column) -> Column:
    """`yyyy-MM-ddTHH:mm:ss.SSSZ`. The session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normalize_document_dates(docs: DataFrame, zones: DataFrame) -> DataFrame:
    """One row (proc_id, field, utc_ts) for each published_date and modified_date of docs that names an existing day or moment.

    zones (domain, zone_id, locale_code) is joined by the site of url; whether it is broadcast is Spark's choice by its measured size.
    Exact repeats of a row give one row. Of several zones rows for a domain the smallest zone_id and its locale count. Rows with null
    proc_id keep a null. Empty inputs give an empty result; other columns of either table are ignored.
    """
    z = zones.select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("__site"), "zone_id", "locale_code")
    z = z.groupBy("__site").agg(F.min(F.struct("zone_id", "locale_code")).alias("__z")).select("__site", "__z.*")
    values = docs.select("proc_id", site_of(F.col("url")).alias("__site"), F.expr("stack(2, 'published_date', published_date, 'modified_date', modified_date) as (field, __value)")).where(F.col("__value").rlike(r"\d"))
    dated = with_utc_instant(values.join(z, "__site", "left"), "__value", "zone_id", "locale_code", "__ts")
    # The test for null stands behind an aggregate: pushed below the working columns it would repeat all their expressions in one method.
    once = dated.groupBy("proc_id", "field", "__value", "__site").agg(F.max("__ts").alias("__ts")).where(F.col("__ts").isNotNull())
    return once.select("proc_id", "field", iso_millis(F.col("__ts")).alias("utc_ts")).distinct()
