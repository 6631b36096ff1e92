"""Access logs: sessions, activity counters, user profiles, scoring.

Events have event_id, ts, account, host, activity, details.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

UNLOCKS, LOCKS = ("Logon", "Privileged Logon", "Unlock"), ("Lock",)
KEY = ["account", "host"]
SESSION = [*KEY, "unlock_time", "lock_time"]


# -- sessions


def _neighbours(events: DataFrame, unlocks: Sequence[str], locks: Sequence[str]) -> DataFrame:
    """Each unlock's next lock and each lock's last unlock, strictly, in one window pass."""
    rows = events.where("ts is not null and account is not null and host is not null").select(
        *KEY, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("activity").isin(*unlocks).alias("opens"), F.col("activity").isin(*locks).alias("closes")
    )
    by = Window.partitionBy(*KEY).orderBy("us")
    return (
        rows.where("opens or closes")
        .withColumn("next_lock", F.min(F.when(F.col("closes"), F.col("ts"))).over(by.rangeBetween(1, Window.unboundedFollowing)))
        .withColumn("last_unlock", F.max(F.when(F.col("opens"), F.col("ts"))).over(by.rangeBetween(Window.unboundedPreceding, -1)))
    )


def match_sessions(events: DataFrame, unlocks: Sequence[str] = UNLOCKS, locks: Sequence[str] = LOCKS) -> DataFrame:
    """Sessions from each unlock to the next lock of the account and host;
    of several unlocks before one lock the earliest counts."""
    pairs = _neighbours(events, unlocks, locks).where("opens and next_lock is not null")
    found = pairs.groupBy(*KEY, F.col("next_lock").alias("lock_time")).agg(F.min("ts").alias("unlock_time"))
    return found.select(
        *SESSION,
        (F.unix_timestamp("lock_time") - F.unix_timestamp("unlock_time")).alias("duration_ts"),
        F.date_format("unlock_time", "EEEE").alias("day_unlock"),
        F.date_format("lock_time", "EEEE").alias("day_lock"),
    )


def unmatched_unlocks(events: DataFrame, unlocks: Sequence[str] = UNLOCKS, locks: Sequence[str] = LOCKS) -> DataFrame:
    rows = _neighbours(events, unlocks, locks).where("opens and next_lock is null")
    return rows.select(*KEY, F.col("ts").alias("unlock_time"), F.date_format("ts", "EEEE").alias("day_unlock"))


def unmatched_locks(events: DataFrame, unlocks: Sequence[str] = UNLOCKS, locks: Sequence[str] = LOCKS) -> DataFrame:
    rows = _neighbours(events, unlocks, locks).where("closes and last_unlock is null")
    return rows.select(*KEY, F.col("ts").alias("lock_time"), F.date_format("ts", "EEEE").alias("day_lock"))


def events_in_sessions(events: DataFrame, sessions: DataFrame, closed: str = "both") -> DataFrame:
    """Events within [unlock, lock] (``both``) or [unlock, lock) (``left``) of
    a session of their account and host. Joined on the day too, so a busy pair
    of keys is not compared over all its days."""
    days = sessions.withColumn("day", F.explode(F.sequence(F.to_date("unlock_time"), F.to_date("lock_time"))))
    e = events.withColumn("day", F.to_date("ts"))
    upper = F.col("ts") <= F.col("lock_time") if closed == "both" else F.col("ts") < F.col("lock_time")
    return e.join(days, [*KEY, "day"]).where((F.col("ts") >= F.col("unlock_time")) & upper).drop("day")


def dedup_logons(events: DataFrame, activities: Sequence[str] = UNLOCKS, unit: str = "second") -> DataFrame:
    """The first of the logon-class rows that share time, account and host;
    other rows, and rows without an activity, stay."""
    first = Window.partitionBy(F.date_trunc(unit, "ts"), *KEY, F.col("activity").isin(*activities)).orderBy("ts", "event_id")
    masked = F.coalesce(F.col("activity").isin(*activities), F.lit(False))
    return events.withColumn("_n", F.row_number().over(first)).where(~masked | (F.col("_n") == 1)).drop("_n")


def primary_host(events: DataFrame) -> DataFrame:
    """Each account's commonest host; ties to the first by name."""
    counts = events.where("account is not null").groupBy(*KEY).count()
    best = F.min(F.struct((-F.col("count")).alias("n"), "host")).alias("one")
    return counts.groupBy("account").agg(best).select("account", F.col("one.host").alias("primary_host"))


def working_range(sessions: DataFrame) -> DataFrame:
    """Mean first unlock and mean last lock of an account's days."""
    first = sessions.groupBy("account", F.to_date("unlock_time").alias("d")).agg(F.min(X.seconds_of_day(F.col("unlock_time"))).alias("a"))
    last = sessions.groupBy("account", F.to_date("lock_time").alias("d")).agg(F.max(X.seconds_of_day(F.col("lock_time"))).alias("b"))
    return (
        first.groupBy("account").agg(F.avg("a").alias("a")).join(last.groupBy("account").agg(F.avg("b").alias("b")), "account")
        .select("account", X.hhmmss(F.col("a")).alias("work_start"), X.hhmmss(F.col("b")).alias("work_end"))
    )


def fixed_range(sessions: DataFrame, start: str = "08:00:00", end: str = "19:00:00") -> DataFrame:
    return sessions.withColumn("work_start", F.lit(start)).withColumn("work_end", F.lit(end))


WEB = {"neutral": "Browsing Neutral Sites", "job": "Browsing Job Search Sites", "hacking": "Browsing Hacking Sites"}


def web_counters(joined: DataFrame, start: str = "08:00:00", end: str = "19:00:00") -> DataFrame:
    off = X.off_hour(F.col("ts"), start, end)
    return joined.groupBy(*SESSION).agg(
        *(F.count_if((F.col("activity") == label) & (off if part == "off" else ~off)).alias(f"{name}_{part}") for name, label in WEB.items() for part in ("normal", "off"))
    )


def activity_counters(joined: DataFrame, primary: DataFrame, start: str = "08:00:00", end: str = "19:00:00", default_logon: bool = False) -> DataFrame:
    """Sixteen counters of a session: logon (of any kind, unlocks too), device,
    document and executable events, on the account's own or another host, in
    or out of hours. With ``default_logon`` a session without a logon counts
    that of :func:`inject_default_logon`, in the same pass."""
    off = X.off_hour(F.col("ts"), start, end)
    own = F.col("host").eqNullSafe(F.col("primary_host"))
    kinds = {
        "logon": F.col("activity").isin(*UNLOCKS),
        "device": F.col("activity") == "PeFileWritten",
        "document": X.file_kind(F.col("details")) == "document",
        "executable": X.file_kind(F.col("details")) == "executable",
    }
    counters = [
        F.count_if(F.coalesce(is_kind, F.lit(False)) & (own if pc == "own" else ~own) & (off if part == "off" else ~off)).alias(f"{kind}_{pc}_{part}")
        for kind, is_kind in kinds.items()
        for pc in ("own", "other")
        for part in ("normal", "off")
    ]
    ranked = joined.join(primary, "account", "left")
    if not default_logon:
        return ranked.groupBy(*SESSION).agg(*counters)
    out = ranked.groupBy(*SESSION, "primary_host").agg(*counters, F.count_if(kinds["logon"]).alias("_logons"))  # one primary host an account
    begun = X.off_hour(F.col("unlock_time"), start, end)
    one = lambda pc, part: (F.col("_logons") == 0) & (own if pc == "own" else ~own) & (begun if part == "off" else ~begun)
    names = [(f"logon_{pc}_{part}", one(pc, part)) for pc in ("own", "other") for part in ("normal", "off")]
    return out.withColumns({n: F.col(n) + F.when(c, 1).otherwise(0) for n, c in names}).drop("primary_host", "_logons")


def inject_default_logon(joined: DataFrame) -> DataFrame:
    """Sessions that have events but no logon of any kind get one at their unlock time."""
    none = joined.groupBy(*SESSION).agg(F.max(F.col("activity").isin(*UNLOCKS).cast("int")).alias("has")).where("has = 0 or has is null")
    default = none.select(*SESSION, F.col("unlock_time").alias("ts"), F.lit("Logon").alias("activity"), F.lit(None).cast("string").alias("details"))
    return joined.select(*SESSION, "ts", "activity", "details").unionByName(default)


def attach_counts(sessions: DataFrame, counts: DataFrame, missing: int = 0) -> DataFrame:
    names = [c for c in counts.columns if c not in SESSION]
    return sessions.join(counts, SESSION, "left").fillna(missing, names)


def add_attributes(df: DataFrame, attributes: DataFrame, names: Sequence[str] = ("title", "department", "company")) -> DataFrame:
    one = attributes.groupBy("account").agg(*(F.min(c).alias(c) for c in names))
    return df.join(one, "account", "left")


# -- identities and membership


def hash_identities(df: DataFrame, users: DataFrame, hosts: DataFrame) -> DataFrame:
    """Hashes from lookup tables (account, account_hash) and (host, host_hash)."""
    return df.join(users, "account", "left").join(hosts, "host", "left")


def monitored(df: DataFrame, users: DataFrame, key: str = "account") -> DataFrame:
    return df.join(users.select(key), key, "left_semi")


def split_by_model(df: DataFrame, good: DataFrame, key: str = "account") -> DataFrame:
    """One pass: ``has_model`` says whether the row's user has a good model."""
    return df.join(good.select(key).distinct().withColumn("_g", F.lit(True)), key, "left").withColumn("has_model", F.coalesce("_g", F.lit(False))).drop("_g")


def new_keys(df: DataFrame, known: DataFrame, key: str = "account") -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def duplicate_keys(**named: DataFrame) -> DataFrame:
    """Keys (column ``key``) that occur more than once over the tables: count and tables."""
    both = None
    for name, df in named.items():
        part = df.select("key", F.lit(name).alias("source"))
        both = part if both is None else both.unionByName(part)
    found = both.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return found.where("n > 1")


# -- profiles


def day_profile(df: DataFrame) -> DataFrame:
    """Share of each weekday in an account's rows, all seven days."""
    day = F.date_format("ts", "EEEE")
    return df.where("account is not null").groupBy("account").agg(*(F.avg((day == d).cast("double")).alias(d.lower()) for d in X.DAYS))


def weekday_class(profile: DataFrame) -> DataFrame:
    """normal or abnormal: abnormal up to the second smallest share, or none at all."""
    shares = F.array(*(F.col(d.lower()) for d in X.DAYS))
    low = F.array_sort(shares)[1]
    return profile.select("account", *(F.when((F.col(d.lower()) <= low) | (F.col(d.lower()) == 0), "abnormal").otherwise("normal").alias(d.lower()) for d in X.DAYS))


def long_profile(profile: DataFrame) -> DataFrame:
    """account, day, share."""
    return profile.unpivot("account", [d.lower() for d in X.DAYS], "day", "share")


def top_working_days(profile: DataFrame, n: int = 5) -> DataFrame:
    by = Window.partitionBy("account").orderBy(F.desc("share"), "day")
    return long_profile(profile).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def host_profile(df: DataFrame, only_normal: bool = False) -> DataFrame:
    """Share of each host in an account's rows."""
    rows = df.where("target = 0") if only_normal else df
    counts = rows.where("account is not null").groupBy(*KEY).count()
    return counts.select(*KEY, (F.col("count") / F.sum("count").over(Window.partitionBy("account"))).alias("freq"))


def hour_profile(df: DataFrame) -> DataFrame:
    """Mean first and last hour of an account on each weekday, cut to whole
    hours; weekdays without rows have 0 and 23."""
    rows = df.where("account is not null and ts is not null")
    daily = rows.groupBy("account", F.to_date("ts").alias("d")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = daily.groupBy("account", F.date_format("d", "EEEE").alias("day")).agg(
        F.floor(F.avg(F.hour("a"))).cast("int").alias("a"), F.floor(F.avg(F.hour("b"))).cast("int").alias("b")
    )
    week = rows.select("account").distinct().withColumn("day", F.explode(F.array(*map(F.lit, X.DAYS))))
    return week.join(hours, ["account", "day"], "left").select("account", "day", F.coalesce("a", F.lit(0)).alias("start_hour"), F.coalesce("b", F.lit(23)).alias("end_hour"))


def unlock_ratio(df: DataFrame, unlocks: Sequence[str] = UNLOCKS, locks: Sequence[str] = LOCKS) -> DataFrame:
    u, n = F.count_if(F.col("activity").isin(*unlocks)), F.count_if(F.col("activity").isin(*unlocks, *locks))
    return df.where("account is not null").groupBy("account").agg(X.ratio(u, n).alias("unlock_ratio"))


def eligible_users(df: DataFrame, min_days: int = 6, min_rows: int = 100) -> DataFrame:
    """Rows of accounts that span more than ``min_days`` days with more than ``min_rows`` rows."""
    ok = df.groupBy("account").agg(F.datediff(F.max("ts"), F.min("ts")).alias("days"), F.count("*").alias("n")).where((F.col("days") > min_days) & (F.col("n") > min_rows))
    return df.join(ok.select("account"), "account", "left_semi")


def working_day(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``working_day`` from :func:`weekday_class`."""
    long = classes.unpivot("account", [d.lower() for d in X.DAYS], "day", "cls")
    day = F.lower(F.date_format("ts", "EEEE"))
    return df.withColumn("day", day).join(long, ["account", "day"], "left").withColumn("working_day", F.coalesce(F.col("cls") == "normal", F.lit(False))).drop("cls")


def working_hour(df: DataFrame, hours: DataFrame, mode: str = "train") -> DataFrame:
    """Adds ``working_hour``: the hour lies in the weekday's range. The range
    0-23 means no profile: not working in mode train, working in mode model."""
    h = F.hour("ts")
    within = h.between(F.col("start_hour"), F.col("end_hour"))
    if mode == "train":
        within = within & ~((F.col("start_hour") == 0) & (F.col("end_hour") == 23))
    joined = df.withColumn("day", F.date_format("ts", "EEEE")).join(hours, ["account", "day"], "left")
    return joined.withColumn("working_hour", F.coalesce(within, F.lit(False))).drop("start_hour", "end_hour")


def apply_profile(df: DataFrame, freq: DataFrame, days: DataFrame, hours: DataFrame) -> DataFrame:
    """Stored shares, days and hours on new rows; unseen hosts have 0."""
    out = working_hour(working_day(df, days).drop("day"), hours, "model").drop("day")
    return out.join(freq, KEY, "left").withColumn("freq", F.coalesce("freq", F.lit(0.0)))


def merge_predictions(rows: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(predictions, list(keys), "left").withColumn("case", F.coalesce("case", F.lit("Normal")))


def passing_models(models: DataFrame, scores: DataFrame, least: float = 0.85) -> DataFrame:
    return models.join(scores.where((F.col("precision") >= least) & (F.col("recall") >= least) & (F.col("f1") >= least)), "account")


def assign_scenario(df: DataFrame, order: Sequence[Column], n: int = 7) -> DataFrame:
    """Scenario 1..n by a row's place among its account's rows; the i-th part
    ends at the half-even rounding of rows * i / n."""
    by = Window.partitionBy("account")
    place = F.row_number().over(by.orderBy(*order)) - 1
    rows = df.withColumn("_i", place).withColumn("_n", F.count("*").over(by))
    scenario = F.lit(n)
    for i in range(n - 1, 0, -1):
        scenario = F.when(F.col("_i") < F.bround(F.col("_n") / n * i), i).otherwise(scenario)
    return rows.withColumn("scenario", scenario).drop("_i", "_n")


def sequences(df: DataFrame, columns: Sequence[str], order: Sequence[str], lookback: int = 3) -> DataFrame:
    """The last ``lookback`` rows of an account up to each row, oldest first."""
    by = Window.partitionBy("account").orderBy(*order).rowsBetween(-(lookback - 1), 0)
    out = df.withColumn("sequence", F.collect_list(F.array(*(F.col(c).cast("double") for c in columns))).over(by))
    return out.where(F.size("sequence") == lookback)


def min_max_by_key(train: DataFrame, test: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``test`` scaled to the range of each key in ``train``; a range of one value, or no range, gives 0."""
    bounds = train.groupBy(key).agg(*(F.min(c).alias(f"_lo_{c}") for c in columns), *(F.max(c).alias(f"_hi_{c}") for c in columns))
    out = test.join(bounds, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(X.ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)))
    return out.drop(*(f"_{p}_{c}" for p in ("lo", "hi") for c in columns))


def score_per_user(df: DataFrame, models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear models (account, weights, bias): positive rows, prediction first."""
    x = F.array(*(F.col(c).cast("double") for c in columns))
    dot = F.aggregate(F.zip_with(x, F.col("weights"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = df.join(models, "account").withColumn("prediction", (dot + F.col("bias") > 0).cast("int"))
    return scored.where("prediction = 1").select("prediction", *df.columns)


def with_label(df: DataFrame, name: str, value: int) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def merge_counts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partial counters of one key added up."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in parts.columns if c not in keys))
