"""Queries over access logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import logs as L
from .fixtures import ACC, ATTR, DAYC, DAYP, DAYS7, HOSTP, HOURP, JOINED, JOINED_LEFT, LONGP, NEAR, PRIM, SESS, USERS, Registry, access_events, attributes, load, r6, text, users, with_

add = Registry()
_S = ("unlock_time", "lock_time")
_FMT = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {1}"
_SK = "account, host, " + ", ".join(_FMT.format(c, c) for c in _S)


def _texts(df):
    return df.withColumns({c: text(c) for c in df.columns if c in (*_S, "ts")})


def _sessions(spark, d):
    return L.match_sessions(access_events(spark, d))


def _joined(spark, d, closed="both"):
    e = access_events(spark, d)
    return L.events_in_sessions(e, L.match_sessions(e), closed)


@add(with_(ACC) + "SELECT activity, account, count(*) AS n, min(k) AS least FROM acc GROUP BY 1, 2")
def p1_classified_activity(spark, d):
    return access_events(spark, d).groupBy("activity", "account").agg(F.count("*").alias("n"), F.min("k").alias("least"))


@add("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Logon' WHEN 1 THEN 'Privileged Logon' WHEN 2 THEN 'Lock' WHEN 3 THEN 'Unlock' ELSE 'Error' END AS activity FROM events")
def p1_event_codes(spark, d):
    code = F.try_element_at(F.array(*map(F.lit, (4624, 4672, 4800, 4801, 1))), (F.col("event_id") % 6 + 1).cast("int"))
    return load(spark, d, "events").select("event_id", X.classify_event_code(code).alias("activity"))


_CAT = "CASE o_orderkey % 4 WHEN 0 THEN 'Phishing and Job Search' WHEN 1 THEN 'Job Search Boards' WHEN 2 THEN 'News' END"


@add(f"SELECT o_orderkey, CASE WHEN regexp_matches({_CAT}, 'Suspicious|Phishing|Malicious|Proxy Avoidance|Spam|Compromised Sites') THEN 'Browsing Hacking Sites' WHEN {_CAT} LIKE '%Job Search%' THEN 'Browsing Job Search Sites' ELSE 'Browsing Neutral Sites' END AS class FROM orders")
def p2_browsing_class(spark, d):
    k = F.col("o_orderkey") % 4
    cat = F.when(k == 0, "Phishing and Job Search").when(k == 1, "Job Search Boards").when(k == 2, "News")
    return load(spark, d, "orders").select("o_orderkey", X.classify_browsing(cat).alias("class"))


@add(with_(ACC) + "SELECT event_id, activity FROM acc WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-29 00:00:00' AND activity IN ('Lock','Unlock')")
def p3_recent(spark, d):
    e = access_events(spark, d)
    as_of = F.lit("2024-01-29 00:00:00").cast("timestamp")
    return e.where((F.col("ts") >= as_of - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") <= as_of) & F.col("activity").isin("Lock", "Unlock")).select("event_id", "activity")


@add(with_(ACC) + "SELECT event_id, coalesce(activity IN ('Logon','Privileged Logon','Unlock'), false) AS is_logon FROM acc")
def p4_split_by_activity(spark, d):
    return access_events(spark, d).select("event_id", F.coalesce(F.col("activity").isin(*L.UNLOCKS), F.lit(False)).alias("is_logon"))


@add(with_(ACC) + "SELECT event_id, CASE WHEN activity = 'Unlock' THEN 1 ELSE 0 END AS unlocks, CASE WHEN activity = 'Lock' THEN 1 ELSE 0 END AS locks, 0 AS target FROM acc")
def p5_lock_flags(spark, d):
    return access_events(spark, d).select(
        "event_id", F.coalesce((F.col("activity") == "Unlock").cast("int"), F.lit(0)).alias("unlocks"), F.coalesce((F.col("activity") == "Lock").cast("int"), F.lit(0)).alias("locks"), F.lit(0).alias("target")
    )


@add(with_(ACC) + "SELECT event_id, NOT (strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '19:00:00') AS off FROM acc")
def p9_off_hours(spark, d):
    return access_events(spark, d).select("event_id", X.off_hour(F.col("ts")).alias("off"))


@add(with_(ACC, NEAR, SESS) + f"SELECT {_SK}, CAST(epoch(lock_time) - epoch(unlock_time) AS BIGINT) AS duration_ts, dayname(unlock_time) AS day_unlock, dayname(lock_time) AS day_lock FROM sess")
def j1_match_sessions(spark, d):
    return _texts(_sessions(spark, d))


@add(with_(ACC, NEAR) + "SELECT account, host, " + _FMT.format("ts", "lock_time") + ", dayname(ts) AS day_lock FROM near WHERE NOT opens AND last_unlock IS NULL")
def j2_unmatched_locks(spark, d):
    return _texts(L.unmatched_locks(access_events(spark, d)))


@add(with_(ACC, NEAR) + "SELECT account, host, " + _FMT.format("ts", "unlock_time") + ", dayname(ts) AS day_unlock FROM near WHERE opens AND next_lock IS NULL")
def j3_unmatched_unlocks(spark, d):
    return _texts(L.unmatched_unlocks(access_events(spark, d)))


@add(with_(ACC, NEAR, SESS, JOINED) + f"SELECT event_id, activity, {_SK} FROM joined")
def j4_events_in_sessions_closed(spark, d):
    return _texts(_joined(spark, d).select("event_id", "activity", *L.SESSION))


@add(with_(ACC, NEAR, SESS, JOINED_LEFT) + f"SELECT event_id, activity, {_SK} FROM joined_left")
def j5_events_in_sessions_half_open(spark, d):
    return _texts(_joined(spark, d, "left").select("event_id", "activity", *L.SESSION))


_OFF = "NOT (strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '19:00:00')"
_WEB = ", ".join(f"count(*) FILTER (WHERE activity = '{label}' AND {'' if part == 'off' else 'NOT '}({_OFF})) AS {n}_{part}" for n, label in L.WEB.items() for part in ("normal", "off"))
_WEBC = f"webc AS (SELECT account, host, unlock_time, lock_time, {_WEB} FROM joined GROUP BY ALL)"
_WEBN = [f"{n}_{p}" for n in L.WEB for p in ("normal", "off")]


@add(with_(ACC, NEAR, SESS, JOINED, _WEBC) + f"SELECT {_SK}, {', '.join(_WEBN)} FROM webc")
def a2_web_counters(spark, d):
    return _texts(L.web_counters(_joined(spark, d)))


@add(with_(ACC, NEAR, SESS, JOINED, _WEBC) + "SELECT s.account, s.host, " + ", ".join(_FMT.format("s." + c, c) for c in _S) + ", " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _WEBN) + " FROM sess s LEFT JOIN webc w ON s.account = w.account AND s.host = w.host AND s.unlock_time = w.unlock_time AND s.lock_time = w.lock_time")
def j6_attach_counts(spark, d):
    s = _sessions(spark, d)
    return _texts(L.attach_counts(s.select(*L.SESSION), L.web_counters(L.events_in_sessions(access_events(spark, d), s))))


_KIND = {"logon": "activity IN ('Logon','Privileged Logon','Unlock')", "device": "activity = 'PeFileWritten'", "document": "coalesce(regexp_matches(lower(details), '\\.docx?$'), false)", "executable": "coalesce(regexp_matches(lower(details), '\\.(dll|mui|exe|tmp)$'), false)"}
_ACT = ", ".join(
    f"count(*) FILTER (WHERE ({c}) AND {'NOT ' if pc == 'other' else ''}(host IS NOT DISTINCT FROM primary_host) AND {'' if part == 'off' else 'NOT '}({_OFF})) AS {k}_{pc}_{part}"
    for k, c in _KIND.items() for pc in ("own", "other") for part in ("normal", "off")
)
_ACTN = [f"{k}_{pc}_{part}" for k in _KIND for pc in ("own", "other") for part in ("normal", "off")]
_ACTC = f"actc AS (SELECT account, host, unlock_time, lock_time, {_ACT} FROM (SELECT j.*, p.primary_host FROM injected j LEFT JOIN prim p ON j.account = p.account) GROUP BY account, host, unlock_time, lock_time)"


def _injected(table):
    """``table`` of events in sessions, and a logon for each session without one."""
    return f"injected AS (SELECT account, host, unlock_time, lock_time, ts, activity, details FROM {table} UNION ALL SELECT account, host, unlock_time, lock_time, unlock_time, 'Logon', NULL FROM {table} GROUP BY account, host, unlock_time, lock_time HAVING count(*) FILTER (WHERE activity IN ('Logon','Privileged Logon','Unlock')) = 0)"


@add(with_(ACC, NEAR, SESS, JOINED_LEFT, _injected("joined_left"), PRIM, _ACTC) + f"SELECT {_SK}, {', '.join(_ACTN)} FROM actc")
def a3_activity_counters(spark, d):
    return _texts(L.activity_counters(_joined(spark, d, "left"), L.primary_host(access_events(spark, d)), default_logon=True))


@add(with_(ACC, NEAR, SESS, JOINED, JOINED_LEFT, _injected("joined_left"), PRIM, _WEBC, _ACTC) + "SELECT w.account, w.host, " + ", ".join(_FMT.format("w." + c, c) for c in _S) + ", hour(w.unlock_time) AS logon_hour, isodow(w.unlock_time) - 1 AS weekday, " + ", ".join(_WEBN) + ", " + ", ".join(f"coalesce({c}, -1) AS {c}" for c in _ACTN) + " FROM webc w LEFT JOIN actc a ON w.account = a.account AND w.host = a.host AND w.unlock_time = a.unlock_time AND w.lock_time = a.lock_time")
def j8_combine_features(spark, d):
    """The session feature table; joins events to sessions once for each closure."""
    e = access_events(spark, d)
    s = L.match_sessions(e)
    web = L.web_counters(L.events_in_sessions(e, s))
    act = L.activity_counters(L.events_in_sessions(e, s, "left"), L.primary_host(e), default_logon=True)
    out = L.attach_counts(web, act, -1).withColumn("logon_hour", F.hour("unlock_time")).withColumn("weekday", F.weekday("unlock_time"))
    return _texts(out)


_REST = "rest AS (SELECT * FROM joined_left WHERE activity IS DISTINCT FROM 'Unlock')"


@add(with_(ACC, NEAR, SESS, JOINED_LEFT, _REST, _injected("rest")) + f"SELECT {_SK}, {_FMT.format('ts', 'ts')}, activity, details FROM injected")
def j7_inject_default_logon(spark, d):
    """Events other than unlocks, so that sessions begun by an unlock have no logon of their own."""
    rest = _joined(spark, d, "left").where("activity is null or activity <> 'Unlock'")
    return _texts(L.inject_default_logon(rest))


@add(with_(ACC, NEAR, SESS, ATTR) + f"SELECT {_SK.replace('account,', 's.account,')}, title, department, company FROM sess s LEFT JOIN (SELECT account, min(title) AS title, min(department) AS department, min(company) AS company FROM attr GROUP BY account) a ON s.account = a.account")
def j9_add_attributes(spark, d):
    return _texts(L.add_attributes(_sessions(spark, d).select(*L.SESSION), attributes(spark, d)))


@add(with_(ACC, PRIM) + "SELECT a.event_id, p.primary_host, a.host IS NOT DISTINCT FROM p.primary_host AS own_pc FROM acc a LEFT JOIN prim p ON a.account = p.account")
def a1_primary_host(spark, d):
    e = access_events(spark, d)
    return e.join(L.primary_host(e), "account", "left").select("event_id", "primary_host", F.col("host").eqNullSafe(F.col("primary_host")).alias("own_pc"))


_SEC = "hour({0}) * 3600 + minute({0}) * 60 + second({0})"
_HMS = "printf('%02d:%02d:%02d', CAST(floor({0}) AS BIGINT) // 3600, CAST(floor({0}) AS BIGINT) % 3600 // 60, CAST(floor({0}) AS BIGINT) % 60)"


@add(with_(ACC, NEAR, SESS) + f"SELECT a.account, {_HMS.format('a.s')} AS work_start, {_HMS.format('b.s')} AS work_end FROM (SELECT account, avg(s) AS s FROM (SELECT account, CAST(unlock_time AS DATE) AS d, min({_SEC.format('unlock_time')}) AS s FROM sess GROUP BY 1, 2) GROUP BY account) a JOIN (SELECT account, avg(s) AS s FROM (SELECT account, CAST(lock_time AS DATE) AS d, max({_SEC.format('lock_time')}) AS s FROM sess GROUP BY 1, 2) GROUP BY account) b ON a.account = b.account")
def a4_working_range(spark, d):
    return L.working_range(_sessions(spark, d))


@add(with_(ACC, NEAR, SESS) + f"SELECT {_SK}, '08:00:00' AS work_start, '19:00:00' AS work_end FROM sess")
def a5_fixed_range(spark, d):
    return _texts(L.fixed_range(_sessions(spark, d).select(*L.SESSION)))


@add(with_(ACC) + "SELECT event_id, activity FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('hour', ts), account, host, activity IN ('Logon','Privileged Logon','Unlock') ORDER BY ts, event_id) AS n FROM acc) WHERE n = 1 OR NOT coalesce(activity IN ('Logon','Privileged Logon','Unlock'), false)")
def w1_dedup_logons(spark, d):
    return L.dedup_logons(access_events(spark, d), unit="hour").select("event_id", "activity")


@add("SELECT key, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM (SELECT 'k' || (s_nationkey % 5) AS key, 'hosts' AS source FROM supplier UNION ALL SELECT s_name, 'hosts' FROM supplier UNION ALL SELECT 'k' || c_nationkey, 'users' FROM customer) GROUP BY key HAVING count(*) > 1")
def a7_duplicate_keys(spark, d):
    s, c = load(spark, d, "supplier"), load(spark, d, "customer")
    k = lambda x: F.concat(F.lit("k"), x.cast("string")).alias("key")
    return L.duplicate_keys(hosts=s.select(k(F.col("s_nationkey") % 5)).union(s.select("s_name")), users=c.select(k(F.col("c_nationkey"))))


@add(with_(ACC) + "SELECT event_id, md5(a.account) AS account_hash, CASE WHEN known THEN md5(a.host) END AS host_hash FROM acc a LEFT JOIN (SELECT DISTINCT host, CAST(substr(host, 3) AS BIGINT) % 3 <> 0 AS known FROM acc) h ON a.host = h.host")
def j10_hash_identities(spark, d):
    e = access_events(spark, d)
    u = e.select("account").distinct().withColumn("account_hash", X.hash_id(F.col("account")))
    h = e.select("host").distinct().where(F.substring("host", 3, 20).cast("long") % 3 != 0).withColumn("host_hash", X.hash_id(F.col("host")))
    return L.hash_identities(e, u, h).select("event_id", "account_hash", "host_hash")


@add(with_(ACC, USERS) + "SELECT event_id, account FROM acc WHERE account IN (SELECT account FROM users WHERE status = 'G')")
def j11_monitored(spark, d):
    return L.monitored(access_events(spark, d), users(spark, d).where("status = 'G'")).select("event_id", "account")


@add(with_(ACC, USERS) + "SELECT event_id, account IN (SELECT account FROM users WHERE status = 'G') AS has_model FROM acc")
def j12_split_by_model(spark, d):
    return L.split_by_model(access_events(spark, d), users(spark, d).where("status = 'G'")).select("event_id", "has_model")


@add(with_(ACC, USERS) + "SELECT DISTINCT account FROM acc WHERE account NOT IN (SELECT account FROM users WHERE known)")
def j13_new_users(spark, d):
    return L.new_keys(access_events(spark, d), users(spark, d).where("known"))


@add(with_(ACC, DAYP) + "SELECT account, " + ", ".join(f"round({x.lower()}, 6) AS {x.lower()}" for x in DAYS7) + " FROM dayp")
def a8_day_profile(spark, d):
    p = L.day_profile(access_events(spark, d))
    return p.select("account", *(r6(c).alias(c) for c in p.columns[1:]))


@add(with_(ACC, HOSTP) + "SELECT account, host, round(freq, 6) AS freq FROM hostp")
def a9_host_profile(spark, d):
    return L.host_profile(access_events(spark, d)).withColumn("freq", r6("freq"))


@add(with_(ACC, HOURP) + "SELECT account, day, start_hour, end_hour FROM hourp")
def a10_hour_profile(spark, d):
    return L.hour_profile(access_events(spark, d))


@add(with_(ACC) + "SELECT account, round(count(*) FILTER (WHERE activity IN ('Logon','Privileged Logon','Unlock')) * 1.0 / nullif(count(*) FILTER (WHERE activity IN ('Logon','Privileged Logon','Unlock','Lock')), 0), 6) AS unlock_ratio FROM acc GROUP BY account")
def a11_unlock_ratio(spark, d):
    return L.unlock_ratio(access_events(spark, d)).withColumn("unlock_ratio", r6("unlock_ratio"))


@add(with_(ACC) + "SELECT event_id, account FROM acc WHERE account IN (SELECT account FROM acc GROUP BY account HAVING datediff('day', min(ts), max(ts)) > 6 AND count(*) > 60)")
def a12_eligible_users(spark, d):
    return L.eligible_users(access_events(spark, d), 6, 60).select("event_id", "account")


@add(with_(ACC, DAYP, LONGP, DAYC) + "SELECT account, " + ", ".join(f"max(CASE WHEN day = '{x.lower()}' THEN cls END) AS {x.lower()}" for x in DAYS7) + " FROM dayc GROUP BY account")
def w4_weekday_class(spark, d):
    return L.weekday_class(L.day_profile(access_events(spark, d)))


@add(with_(ACC, DAYP, LONGP) + "SELECT account, day, round(share, 6) AS share, rank FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY share DESC, day) AS rank FROM longp) WHERE rank <= 5")
def w5_top_working_days(spark, d):
    return L.top_working_days(L.day_profile(access_events(spark, d))).withColumn("share", r6("share"))


@add(with_(ACC, DAYP, LONGP, DAYC) + "SELECT event_id, cls = 'normal' AS working_day FROM acc a JOIN dayc c ON a.account = c.account AND lower(dayname(ts)) = c.day")
def f8_working_day(spark, d):
    e = access_events(spark, d)
    return L.working_day(e, L.weekday_class(L.day_profile(e))).select("event_id", "working_day")


_WH = "hour(ts) BETWEEN start_hour AND end_hour"


@add(with_(ACC, HOURP) + f"SELECT event_id, {_WH} AND NOT (start_hour = 0 AND end_hour = 23) AS train, {_WH} AS model FROM acc a JOIN hourp h ON a.account = h.account AND dayname(ts) = h.day")
def f7_working_hour(spark, d):
    e = access_events(spark, d)
    h = L.hour_profile(e)
    both = L.working_hour(e, h).drop("day").withColumnRenamed("working_hour", "train")
    return L.working_hour(both, h, "model").select("event_id", "train", F.col("working_hour").alias("model"))


_PROFILED = f"profiled AS (SELECT a.event_id, a.account, a.host, a.ts, cls = 'normal' AS working_day, {_WH} AS working_hour, coalesce(f.freq, 0) AS freq FROM acc a JOIN dayc c ON a.account = c.account AND lower(dayname(ts)) = c.day JOIN hourp h ON a.account = h.account AND dayname(ts) = h.day LEFT JOIN (SELECT * FROM hostp WHERE freq > 0.3) f ON a.account = f.account AND a.host = f.host)"


def _profiled(spark, d):
    e = access_events(spark, d)
    return L.apply_profile(e, L.host_profile(e).where("freq > 0.3"), L.weekday_class(L.day_profile(e)), L.hour_profile(e))


@add(with_(ACC, DAYP, LONGP, DAYC, HOURP, HOSTP, _PROFILED) + "SELECT event_id, working_day, working_hour, round(freq, 6) AS freq FROM profiled")
def j14_apply_profile(spark, d):
    return _profiled(spark, d).select("event_id", "working_day", "working_hour", r6("freq").alias("freq"))


_CASES = [
    ("working_day AND NOT working_hour AND freq = 0", "Case 1"), ("NOT working_day AND working_hour AND freq = 0", "Case 2"), ("working_day AND working_hour AND freq = 0", "Case 3"),
    ("NOT working_day AND NOT working_hour AND freq <> 0", "Case 4"), ("working_day AND NOT working_hour AND freq <> 0", "Case 5"), ("NOT working_day AND working_hour AND freq <> 0", "Case 6"),
    ("NOT working_day AND NOT working_hour AND freq = 0", "Case 7"),
]
_CASE = "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in _CASES) + " ELSE 'Normal' END"


@add(with_(ACC, DAYP, LONGP, DAYC, HOURP, HOSTP, _PROFILED) + f"SELECT event_id, {_CASE} AS \"case\" FROM profiled")
def f9_anomaly_case(spark, d):
    return _profiled(spark, d).select("event_id", X.anomaly_case(F.col("working_day"), F.col("working_hour"), F.col("freq")).alias("case"))


@add(with_(ACC, DAYP, LONGP, DAYC, HOURP, HOSTP, _PROFILED, f"c AS (SELECT account, ts, {_CASE} AS \"case\" FROM profiled)") + "SELECT a.event_id, coalesce(c.\"case\", 'Normal') AS \"case\" FROM acc a LEFT JOIN (SELECT * FROM c WHERE \"case\" <> 'Normal') c ON a.account = c.account AND a.ts = c.ts")
def j15_merge_predictions(spark, d):
    p = _profiled(spark, d).select("account", "ts", X.anomaly_case(F.col("working_day"), F.col("working_hour"), F.col("freq")).alias("case")).where("case <> 'Normal'")
    return L.merge_predictions(access_events(spark, d), p, ["account", "ts"]).select("event_id", "case")


_MS = "ms AS (SELECT 'u' || c_custkey AS account, 0.8 + (c_custkey % 17) / 80.0 AS precision, 0.8 + (c_custkey % 13) / 60.0 AS recall, 0.8 + (c_custkey % 11) / 50.0 AS f1 FROM customer)"


@add(with_(USERS, _MS) + "SELECT u.account, status, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM users u JOIN ms ON u.account = ms.account WHERE precision >= 0.85 AND recall >= 0.85 AND f1 >= 0.85")
def j16_passing_models(spark, d):
    k = F.col("c_custkey")
    s = load(spark, d, "customer").select(F.concat(F.lit("u"), k.cast("string")).alias("account"), *((0.8 + (k % a) / float(b)).alias(n) for n, a, b in (("precision", 17, 80), ("recall", 13, 60), ("f1", 11, 50))))
    return L.passing_models(users(spark, d).select("account", "status"), s).select("account", "status", *(r6(c).alias(c) for c in ("precision", "recall", "f1")))


_N7 = " ".join(f"WHEN i < round_even(n / 7.0 * {i}, 0) THEN {i}" for i in range(1, 7))


@add(with_(ACC) + f"SELECT event_id, CASE {_N7} ELSE 7 END AS scenario FROM (SELECT event_id, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY account) AS n FROM acc)")
def w13_assign_scenario(spark, d):
    return L.assign_scenario(access_events(spark, d), [F.col("ts"), F.col("event_id")]).select("event_id", "scenario")


@add(with_(ACC) + "SELECT event_id, round(v1, 6) AS oldest, round(v3, 6) AS newest FROM (SELECT event_id, lag(value, 2) OVER w AS v1, value AS v3, row_number() OVER w AS n FROM acc WINDOW w AS (PARTITION BY account ORDER BY ts, event_id)) WHERE n >= 3")
def w6_sequences(spark, d):
    s = L.sequences(access_events(spark, d), ["value", "k"], ["ts", "event_id"])
    return s.select("event_id", r6(F.col("sequence")[0][0]).alias("oldest"), r6(F.element_at("sequence", -1)[0]).alias("newest"))


@add(with_(ACC) + "SELECT event_id, k AS last_k FROM (SELECT event_id, k, row_number() OVER (PARTITION BY account ORDER BY ts, event_id) AS n FROM acc) WHERE n >= 3")
def w7_last_step(spark, d):
    s = L.sequences(access_events(spark, d), ["value", "k"], ["ts", "event_id"])
    return s.select("event_id", F.element_at("sequence", -1)[1].cast("int").alias("last_k"))


@add(with_(ACC) + "SELECT event_id, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) AS value FROM acc a LEFT JOIN (SELECT account, min(value) AS lo, max(value) AS hi FROM acc WHERE event_id % 5 <> 0 GROUP BY account) b ON a.account = b.account WHERE event_id % 5 = 0")
def m5_min_max_by_key(spark, d):
    e = access_events(spark, d).select("event_id", "account", "value")
    return L.min_max_by_key(e.where("event_id % 5 <> 0"), e.where("event_id % 5 = 0"), "account", ["value"]).select("event_id", r6("value").alias("value"))


@add(with_(ACC) + "SELECT event_id, account, 1 AS prediction FROM acc WHERE value * 0.01 + k * (CAST(substr(account, 2) AS BIGINT) % 5 - 2) * 0.02 - 0.5 > 0")
def m11_score_per_user(spark, d):
    """k counts in fiftieths, so a weight of 0.02 a unit is a whole number: its
    product is the double nearest to the exact one, as in the SQL, also on a tie."""
    e = access_events(spark, d).withColumn("fiftieths", F.col("k") / 50)
    m = e.select("account").distinct().select("account", F.array(F.lit(0.01), (F.substring("account", 2, 20).cast("long") % 5 - 2).cast("double")).alias("weights"), F.lit(-0.5).alias("bias"))
    return L.score_per_user(e, m, ["value", "fiftieths"]).select("event_id", "account", "prediction")


@add(with_(ACC) + "SELECT event_id, 0 AS target FROM acc")
def p6_with_label(spark, d):
    return L.with_label(access_events(spark, d), "target", 0).select("event_id", "target")


@add(with_(ACC, NEAR, SESS) + "SELECT account, host, " + _FMT.format("lock_time", "lock_time") + ", count(*) AS n FROM sess GROUP BY account, host, lock_time")
def w2_one_session_a_lock(spark, d):
    return _sessions(spark, d).groupBy("account", "host", text("lock_time").alias("lock_time")).agg(F.count("*").alias("n"))


@add(with_(ACC, NEAR, SESS) + "SELECT dayname(unlock_time) AS day_unlock, dayname(lock_time) AS day_lock, count(*) AS n, CAST(sum(epoch(lock_time) - epoch(unlock_time)) AS BIGINT) AS seconds FROM sess GROUP BY 1, 2")
def w3_session_durations(spark, d):
    return _sessions(spark, d).groupBy("day_unlock", "day_lock").agg(F.count("*").alias("n"), F.sum("duration_ts").alias("seconds"))


@add(with_(ACC) + "SELECT account, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM acc GROUP BY account")
def a6_merge_partial_counts(spark, d):
    """Counts of chunks of the log, added up: what partial aggregation does by itself."""
    chunks = access_events(spark, d).groupBy("account", F.floor(F.col("event_id") / 1000).alias("chunk")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))
    return L.merge_counts(chunks.drop("chunk"), ["account"])
