"""Scalar expressions: columns in, a column out, all inside code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
EARTH_KM = 6371.0


# -- codes and classes


def classify_event_code(code: Column) -> Column:
    return (
        F.when(code == 4624, "Logon").when(code == 4672, "Privileged Logon").when(code == 4800, "Lock").when(code == 4801, "Unlock").otherwise("Error")
    )


def classify_browsing(category: Column) -> Column:
    """First match wins; anything else, null too, is neutral."""
    return (
        F.when(category.rlike("Suspicious|Phishing|Malicious|Proxy Avoidance|Spam|Compromised Sites"), "Browsing Hacking Sites")
        .when(category.like("%Job Search%"), "Browsing Job Search Sites")
        .otherwise("Browsing Neutral Sites")
    )


def file_kind(name: Column) -> Column:
    """document, executable or other by suffix; null is other."""
    return F.when(name.rlike(r"(?i)\.docx?$"), "document").when(name.rlike(r"(?i)\.(dll|mui|exe|tmp)$"), "executable").otherwise("other")


def allowed_file(name: Column, suffixes: Sequence[str]) -> Column:
    return F.coalesce(name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*suffixes), F.lit(False))


def short_host(host: Column) -> Column:
    return F.upper(F.regexp_extract(host, r"^([^.]*)", 1))


def hash_id(value: Column) -> Column:
    return F.md5(value.cast("string"))


# -- text


def first_line(text: Column) -> Column:
    return F.trim(F.split(text, "\n")[0])


def zip_concat(a: Column, b: Column, sep: str = " - ") -> Column:
    return F.zip_with(a, b, lambda x, y: F.concat_ws(sep, x, y))


def second_or_first(values: Column) -> Column:
    """The second element of a list, else its first, else an empty string."""
    return F.coalesce(F.try_element_at(values, F.lit(2)), F.try_element_at(values, F.lit(1)), F.lit(""))


def drop_first_token(line: Column) -> Column:
    tokens = F.split(F.trim(line), r"\s+")
    return F.array_join(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), "\t")


def clean_response(text: Column, prompt: Column, tags: Sequence[str] = ("customer:", "agent:", "action:")) -> Column:
    """Without the prompt it begins with, and without speaker tags at its end."""
    rest = F.when(text.startswith(prompt), F.substr(text, F.length(prompt) + 1)).otherwise(text)
    return F.trim(F.regexp_replace(rest, rf"(\s*({'|'.join(tags)}))+\s*$", ""))


# -- time


def parse_ts(text: Column, fmt: str = "MM/dd/yy HH:mm:ss") -> Column:
    """Null where the text is no such time."""
    return F.try_to_timestamp(text, F.lit(fmt))


def make_ts(date: Column, time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm:ss"))


def clock(ts: Column) -> Column:
    """HH:mm:ss; strings of this form compare as times do."""
    return F.date_format(ts, "HH:mm:ss")


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hhmmss(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60)


def off_hour(ts: Column, start: str = "08:00:00", end: str = "19:00:00") -> Column:
    return ~clock(ts).between(start, end)


def duration_s(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def weekday_flags(day: Column) -> list[Column]:
    return [F.coalesce((day == d).cast("int"), F.lit(0)).alias(d.lower()) for d in DAYS]


def hour_flags(ts: Column) -> list[Column]:
    return [F.coalesce((F.hour(ts) == h).cast("int"), F.lit(0)).alias(f"h{h:02d}") for h in range(24)]


def hour_partition(ts: Column, tz: str = "America/New_York") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "MMddyy_HH")


# -- ladders


# The case of (working day, working hour, known computer).
CASES = {
    (True, False, False): "Case 1",
    (False, True, False): "Case 2",
    (True, True, False): "Case 3",
    (False, False, True): "Case 4",
    (True, False, True): "Case 5",
    (False, True, True): "Case 6",
    (False, False, False): "Case 7",
}
# Alerts, the severity each stands for, and the classes of messages.
HIGH, MIDDLE, LOW, NORMAL = "HIGH : Call 911", "MIDDLE : Notify Doctor", "LOW : Ping User", "Normal Activity - No alerts"
ALERT_SEVERITY = {HIGH: "emergency", MIDDLE: "high", LOW: "medium"}
ALERT_CLASS = {"critical": "HIGH|Call 911", "high": "MIDDLE|Notify Doctor", "moderate": "LOW|Ping User"}


def anomaly_case(day: Column, hour: Column, freq: Column) -> Column:
    """The case of a row outside its profile; a working day and hour on a known computer is Normal."""
    known = freq != 0
    case = F.lit("Normal")
    for (d, h, k), name in CASES.items():
        case = F.when((day == F.lit(d)) & (hour == F.lit(h)) & (known == F.lit(k)), name).otherwise(case)
    return case


def guardian_alert(hours: Column, deviation: Column) -> Column:
    """Deviation counts for the highest alert only; an unknown one (null) does not reach it."""
    return F.when((deviation > 0.8) & (hours >= 12), HIGH).when(hours >= 6, MIDDLE).when(hours >= 3, LOW).otherwise(NORMAL)


def alert_class(alert: Column) -> Column:
    """critical, high, moderate, or low for all else."""
    return reduce(lambda c, x: c.when(alert.rlike(x[1]), x[0]), ALERT_CLASS.items(), F).otherwise("low")


def clinical_severity(hours: Column, deviation: Column) -> Column:
    return (
        F.when((deviation > 0.8) & (hours > 72), "CRITICAL")
        .when((deviation > 0.6) | (hours > 48), "HIGH")
        .when((deviation > 0.4) | (hours > 24), "MODERATE")
        .otherwise("LOW")
    )


def churn_tier(p: Column) -> Column:
    return F.when(p > 0.7, "high").when(p > 0.4, "medium").otherwise("low")


# -- numbers


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def nan_to_num(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def argmax(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def reconstruction_error(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def rescale(values: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    return F.transform(values, lambda x: (x / 255.0 - mean) / std)


def entropy_of(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))


# -- places


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def manhattan_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return (F.abs(lat2 - lat1) + F.abs(lon2 - lon1) * F.cos(F.radians(lat1))) * 111.0


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.atan2(y, x)


def first_box(lon: Column, lat: Column, boxes: Sequence[tuple[str, float, float, float, float]], default: str = "Unknown") -> Column:
    """Name of the first box (name, lon0, lon1, lat0, lat1) that holds the point."""
    cases = reduce(lambda c, b: c.when(lon.between(b[1], b[2]) & lat.between(b[3], b[4]), b[0]), boxes, F)
    return cases.otherwise(default)
