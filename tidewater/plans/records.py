"""Queries over records, wearables and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import records as R
from .fixtures import AS_OF, RECS, TURNS, WEAR, Registry, load, r6, records, text, turns, wearables, with_

add = Registry()


@add(with_(RECS) + "SELECT doc_id, type, source FROM recs WHERE workspace_id = 2 AND source = 'en' AND list_contains(tags, 'src2')")
def p15_find(spark, d):
    return R.find(records(spark, d), 2, tag="src2", source="en").select("doc_id", "type", "source")


@add(with_(RECS) + "SELECT doc_id FROM recs WHERE confidence = 1")
def p16_active(spark, d):
    return R.active(records(spark, d).withColumn("ok", F.col("confidence") == 1), "ok").select("doc_id")


@add(with_(RECS) + "SELECT doc_id, type FROM recs WHERE (contains(lower(text), 'than') OR contains(lower(source), 'than')) AND type = 'src3'")
def p17_search(spark, d):
    return R.search(records(spark, d), "Than", ["text", "source"], "src3").select("doc_id", "type")


_CUR = R.encode_cursor("2024-01-01 03:20:00", 601)
_PAGE = "SELECT *, row_number() OVER (ORDER BY created_at DESC, doc_id DESC) AS n, count(*) OVER () AS total FROM recs WHERE workspace_id = 1 AND (created_at < TIMESTAMP '2024-01-01 03:20:00' OR (created_at = TIMESTAMP '2024-01-01 03:20:00' AND doc_id < 601))"


@add(with_(RECS) + f"SELECT doc_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, total > 20 AS has_next, to_base64(CAST('{{\"created_at\":\"' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '\",\"id\":' || doc_id || '}}' AS BLOB)) AS cursor FROM ({_PAGE}) WHERE n <= 20")
def t4_page(spark, d):
    return R.page(records(spark, d), 1, 20, _CUR).select("doc_id", text("created_at").alias("created_at"), "has_next", "cursor")


@add(with_(WEAR) + "SELECT user_id, strftime(date, '%Y-%m-%d') AS date, steps, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rank FROM wear) WHERE rank <= 3")
def t5_latest_n(spark, d):
    return R.latest_n(wearables(spark, d), "user_id", [F.desc("date")], 3).select("user_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "steps", "rank")


_DEV = f"dev AS (SELECT *, (avg_steps - latest_steps) / nullif(avg_steps, 0) AS deviation FROM (SELECT user_id, max(date) AS last_date, avg(steps) AS avg_steps, arg_max(steps, date) AS latest_steps, (epoch(TIMESTAMP '{AS_OF}') - epoch(CAST(max(date) AS TIMESTAMP))) / 3600.0 AS hours FROM wear GROUP BY user_id))"
_ALERT = "alerts AS (SELECT *, CASE WHEN deviation > 0.8 AND hours >= 12 THEN 'HIGH : Call 911' WHEN hours >= 6 THEN 'MIDDLE : Notify Doctor' WHEN hours >= 3 THEN 'LOW : Ping User' ELSE 'Normal Activity - No alerts' END AS alert, CASE WHEN deviation > 0.8 AND hours > 72 THEN 'CRITICAL' WHEN deviation > 0.6 OR hours > 48 THEN 'HIGH' WHEN deviation > 0.4 OR hours > 24 THEN 'MODERATE' ELSE 'LOW' END AS severity FROM dev)"


def _alerts(spark, d):
    return R.guardian_alerts(wearables(spark, d), AS_OF)


@add(with_(WEAR, _DEV) + "SELECT user_id, strftime(last_date, '%Y-%m-%d') AS last_date, round(hours, 6) AS hours, round(avg_steps, 6) AS avg_steps, latest_steps, round(deviation, 6) AS deviation FROM dev")
def a15_activity_deviation(spark, d):
    o = R.activity_deviation(wearables(spark, d), AS_OF)
    return o.select("user_id", F.date_format("last_date", "yyyy-MM-dd").alias("last_date"), r6("hours").alias("hours"), r6("avg_steps").alias("avg_steps"), "latest_steps", r6("deviation").alias("deviation"))


@add(with_(WEAR, _DEV, _ALERT) + "SELECT user_id, alert FROM alerts")
def f31_guardian_alert(spark, d):
    return _alerts(spark, d).select("user_id", "alert")


@add(with_(WEAR, _DEV, _ALERT) + "SELECT user_id, severity FROM alerts")
def f32_clinical_severity(spark, d):
    return _alerts(spark, d).select("user_id", "severity")


@add(with_(WEAR, _DEV, _ALERT) + "SELECT user_id, alert FROM alerts WHERE alert LIKE '%Call 911' OR alert LIKE '%Notify Doctor'")
def p14_alerts_by_severity(spark, d):
    a = _alerts(spark, d)
    return R.alerts_by_severity(a).union(R.alerts_by_severity(a, "high")).select("user_id", "alert")


@add(with_(WEAR, _DEV, _ALERT) + "SELECT count(*) FILTER (WHERE alert LIKE 'HIGH%') AS critical, count(*) FILTER (WHERE alert LIKE 'MIDDLE%') AS high, count(*) FILTER (WHERE alert LIKE 'LOW%') AS moderate, count(*) FILTER (WHERE alert NOT LIKE 'Normal%') AS active, count(*) AS total FROM alerts")
def a16_alert_summary(spark, d):
    return R.alert_summary(_alerts(spark, d))


_LV = "CASE WHEN alert = 'HIGH : Call 911' THEN '{}' ELSE '{}' END AS {}"
_IV = ", ".join((_LV.format("emergency", "high", "severity"), _LV.format("emergency_call", "doctor_notification", "type"), _LV.format("emergency", "doctor", "recipient"), _LV.format("phone", "email", "contact")))


@add(with_(WEAR, _DEV, _ALERT) + f"SELECT user_id, {_IV}, 'Automated intervention for ' || alert AS description, '2024-01-31 04:00:00' AS follow_up_at, true AS follow_up_required FROM alerts WHERE alert IN ('HIGH : Call 911', 'MIDDLE : Notify Doctor')")
def f33_interventions(spark, d):
    return R.interventions(_alerts(spark, d), AS_OF).withColumn("follow_up_at", text("follow_up_at"))


@add(with_(WEAR, _DEV, _ALERT) + "SELECT user_id, alert FROM (SELECT *, row_number() OVER (PARTITION BY split_part(alert, ' ', 1) ORDER BY user_id) AS n FROM alerts WHERE alert NOT LIKE 'Normal%') WHERE alert NOT LIKE 'LOW%' OR n <= 5")
def t6_cap_per_class(spark, d):
    a = _alerts(spark, d).withColumn("cls", X.alert_class(F.col("alert")))
    return R.cap_per_class(a, "cls", {"critical": None, "high": None, "moderate": 5}, [F.col("user_id")]).select("user_id", "alert")


def _people(spark, d):
    return load(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("patient"), F.concat(F.lit("Nurse "), F.col("c_nationkey").cast("string")).alias("caregiver"))


_PEOPLE = "people AS (SELECT c_custkey AS user_id, c_name AS patient, 'Nurse ' || c_nationkey AS caregiver FROM customer WHERE c_custkey % 3 <> 0)"


@add(with_(WEAR, _DEV, _ALERT, _PEOPLE) + "SELECT a.user_id, coalesce(patient, 'Patient ' || a.user_id) AS patient, coalesce(caregiver, 'Family Member') AS caregiver, 'family member' AS relationship FROM alerts a LEFT JOIN people p ON a.user_id = p.user_id")
def j24_add_caregiver(spark, d):
    return R.add_caregiver(_alerts(spark, d), _people(spark, d)).select("user_id", "patient", "caregiver", "relationship")


_NAMED = "named AS (SELECT a.user_id, alert, coalesce(patient, 'Patient ' || a.user_id) AS p, coalesce(caregiver, 'Family Member') AS c, CAST(trunc(hours) AS BIGINT) AS h, CAST(trunc(coalesce(deviation, 0) * 100) AS BIGINT) AS d FROM alerts a LEFT JOIN people p ON a.user_id = p.user_id)"
_MESSAGE = {
    "greeting": (
        "'Dear ' || c || ', we need your immediate attention regarding ' || p || chr(46)", "'Hello ' || c || ', we''re concerned about ' || p || ' and wanted to alert you.'",
        "'Hi ' || c || ', we wanted to update you about ' || p || chr(39) || 's activity patterns.'", "'Hello ' || c || ', here''s a routine update about ' || p || '.'",
    ),
    "summary": (
        "p || ' hasn''t shown any activity for ' || h || ' hours, and their overall activity has dropped by ' || d || '%. This is a critical situation that requires immediate action.'",
        "p || ' has been inactive for ' || h || ' hours and their activity level has decreased by ' || d || '%. This needs your attention today.'",
        "'We''ve noticed ' || p || ' has been less active recently - ' || h || ' hours of inactivity and a ' || d || '% decrease in movement. This might indicate they need some extra support.'",
        "p || ' has shown some minor changes in activity - about ' || d || '% less movement than usual. This is likely normal variation but worth monitoring.'",
    ),
    "first_action": (
        "'Call ' || p || ' right now - if no answer, go to their location immediately'", "'Call ' || p || ' to check on their wellbeing'",
        "'Give ' || p || ' a friendly call to see how they''re feeling'", "'Check in with ' || p || ' during your next regular call'",
    ),
    "actions": ("5", "5", "4", "3"), "contacts": ("'911;555-0100;555-0199;555-0150'", "'911;555-0100;555-0199;555-0150'", "'555-0100;555-0199;555-0150'", "'555-0100;555-0199;555-0150'"),
    "resources": ("4", "4", "3", "3"),
}
_MESSAGES = ", ".join(f"CASE WHEN alert LIKE 'HIGH%' THEN {a} WHEN alert LIKE 'MIDDLE%' THEN {b} WHEN alert LIKE 'LOW%' THEN {c} ELSE {e} END AS {n}" for n, (a, b, c, e) in _MESSAGE.items())


@add(with_(WEAR, _DEV, _ALERT, _PEOPLE, _NAMED) + f"SELECT user_id, {_MESSAGES} FROM named")
def f35_render_message(spark, d):
    m = R.render_message(R.add_caregiver(_alerts(spark, d), _people(spark, d)))
    return m.select("user_id", "message.greeting", "message.summary", F.col("message.actions")[0].alias("first_action"), F.size("message.actions").alias("actions"), F.array_join("message.contacts.number", ";").alias("contacts"), F.size("message.resources").alias("resources"))


_CHURN = "churn AS (SELECT user_id, (user_id * 37 % 100) / 100.0 AS p FROM (SELECT DISTINCT user_id FROM events))"


def _churn(spark, d):
    return load(spark, d, "events").select("user_id").distinct().withColumn("p", (F.col("user_id") * 37 % 100) / 100.0)


@add(with_(_CHURN) + "SELECT user_id, CASE WHEN p > 0.7 THEN 'high' WHEN p > 0.4 THEN 'medium' ELSE 'low' END AS tier, round(greatest(p, 1 - p), 6) AS confidence, CASE WHEN p > 0.7 THEN 'Immediate engagement required;Personal trainer consultation;Offer incentive program' WHEN p > 0.4 THEN 'Send motivational messages;Suggest group activities;Review fitness goals' ELSE 'Continue monitoring;Send weekly tips' END AS recommendations, 'steps_mean;heart_rate_mean;steps_std' AS contributing_factors FROM churn")
def f34_churn_tier(spark, d):
    o = R.churn_report(_churn(spark, d), "p", {"steps_std": 0.2, "steps_mean": 0.5, "class_attended_sum": 0.05, "heart_rate_mean": 0.25})
    return o.select("user_id", "tier", r6("confidence").alias("confidence"), *(F.array_join(c, ";").alias(c) for c in ("recommendations", "contributing_factors")))


@add(with_(_CHURN) + "SELECT count(*) FILTER (WHERE p > 0.7) AS high, count(*) FILTER (WHERE p > 0.3 AND p <= 0.7) AS medium, count(*) FILTER (WHERE p <= 0.3) AS low FROM churn")
def a40_risk_counts(spark, d):
    return R.risk_counts(_churn(spark, d), "p")


_PERIOD = f"recent AS (SELECT * FROM alerts WHERE CAST(last_date AS TIMESTAMP) BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AND TIMESTAMP '{AS_OF}')"


@add(with_(WEAR, _DEV, _ALERT, _CHURN, _PERIOD) + f"SELECT strftime(TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(TIMESTAMP '{AS_OF}', '%Y-%m-%d %H:%M:%S') AS period_end, (SELECT count(DISTINCT user_id) FROM wear) AS users, (SELECT count(*) FROM recent) AS alerts, (SELECT count(*) FROM recent WHERE severity = 'LOW') AS low, (SELECT count(*) FROM churn WHERE p > 0.4) AS at_risk, (SELECT count(*) FROM alerts WHERE alert LIKE 'HIGH%' OR alert LIKE 'MIDDLE%') AS interventions")
def a17_analytics_report(spark, d):
    a = _alerts(spark, d)
    r = R.analytics_report(wearables(spark, d), a, R.churn_report(_churn(spark, d), "p"), R.interventions(a, AS_OF), AS_OF, 2, "last_date")
    return r.select(text("period_start").alias("period_start"), text("period_end").alias("period_end"), "users", "alerts", F.coalesce(F.try_element_at("by_severity", F.lit("LOW")), F.lit(0)).alias("low"), "at_risk", "interventions")


@add(with_(WEAR) + "SELECT user_id, round(avg(steps), 5) AS steps_mean, round(stddev_samp(steps), 5) AS steps_std, min(steps) AS steps_min, max(steps) AS steps_max, round(avg(heart_rate), 5) AS heart_rate_mean, max(heart_rate) AS heart_rate_max, CAST(sum(class_attended) AS BIGINT) AS class_attended_sum, max(churned) AS churned_max FROM wear GROUP BY user_id")
def a13_user_features(spark, d):
    o = R.user_features(wearables(spark, d))
    return o.withColumns({c: F.round(c, 5) for c in ("steps_mean", "steps_std", "heart_rate_mean")})


@add(with_(WEAR) + "SELECT user_id, strftime(date, '%Y-%m-%d') AS date, CAST(floor(avg(steps)) AS INT) AS steps, CAST(floor(avg(heart_rate)) AS INT) AS heart_rate, max(class_attended) AS class_attended FROM wear GROUP BY user_id, date")
def a14_daily_metrics(spark, d):
    return R.daily_metrics(wearables(spark, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@add(with_(RECS) + "SELECT workspace_id, type, count(*) AS n, round(avg(confidence), 6) AS confidence FROM recs GROUP BY ROLLUP (workspace_id, type) HAVING workspace_id IS NOT NULL")
def a18_research_analytics(spark, d):
    return R.research_analytics(records(spark, d)).withColumn("confidence", r6("confidence"))


@add(with_(RECS, WEAR, _DEV, _ALERT) + "SELECT 'records' AS kind, count(*) AS n, count(*) FILTER (WHERE confidence = 1) AS n_active FROM recs UNION ALL SELECT 'alerts', count(*), count(*) FILTER (WHERE alert NOT LIKE 'Normal%') FROM alerts UNION ALL SELECT 'metrics', count(*), 0 FROM wear")
def a19_status_counts(spark, d):
    return R.status_counts(
        records=records(spark, d).withColumn("is_active", F.col("confidence") == 1), alerts=_alerts(spark, d).withColumn("is_active", ~F.col("alert").startswith("Normal")), metrics=wearables(spark, d)
    )


# -- updates

_T = "t AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS v FROM customer)"


def _t(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))


@add(with_(_T) + "SELECT id, nation, v FROM t WHERE id % 4 <> 0 UNION ALL SELECT id, nation, v + 1 FROM t WHERE id % 4 = 0 UNION ALL SELECT id + 1000000, nation, v FROM t WHERE id % 10 = 0")
def u4_upsert(spark, d):
    t = _t(spark, d)
    new = t.where("id % 4 = 0").withColumn("v", F.col("v") + 1).union(t.where("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000))
    return R.upsert(t, new, ["id"])


@add(with_(_T) + "SELECT id, nation, CASE WHEN id % 4 = 0 THEN -1.0 ELSE v END AS v FROM t")
def u5_apply_updates(spark, d):
    t = _t(spark, d)
    return R.apply_updates(t, t.where("id % 4 = 0").select("id", F.lit(-1.0).alias("v")), ["id"], ["v"])


@add("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY")
def u6_retain(spark, d):
    return R.retain(load(spark, d, "events"), "ts", "2024-01-30 00:00:00", 2).select("event_id")


@add(with_(_T) + "SELECT t.id, CASE WHEN n.notes IS NULL THEN 'first' ELSE 'first|' || n.notes END AS history FROM t LEFT JOIN (SELECT user_id AS id, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type, '|' ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S'), event_type) AS notes FROM events GROUP BY user_id) n ON t.id = n.id")
def u7_append_history(spark, d):
    t = _t(spark, d).select("id", F.array(F.lit("first")).alias("history"))
    e = load(spark, d, "events").select(F.col("user_id").alias("id"), text("ts").alias("at"), F.col("event_type").alias("note"))
    return R.append_history(t, e, "id", "history").select("id", F.array_join("history", "|").alias("history"))


@add(with_(_T) + "SELECT id, nation FROM t WHERE NOT (id % 3 = 0 AND nation = 7)")
def u8_delete_keys(spark, d):
    t = _t(spark, d).select("id", "nation")
    return R.delete_keys(t, t.where("id % 3 = 0 and nation = 7"))


# -- dialogues


@add(with_(TURNS) + "SELECT conv_id, string_agg(role || ': ' || text, chr(9) ORDER BY turn) AS line FROM turns WHERE role <> 'action' GROUP BY conv_id")
def f36_conversation_lines(spark, d):
    return R.conversation_lines(turns(spark, d))


_BLOCKS = "blocks AS (SELECT conv_id, CAST(block AS BIGINT) AS block, min(role2) AS role, string_agg(text, ' ' ORDER BY turn) AS text, min(turn) AS first_turn FROM (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS block FROM (SELECT *, CASE WHEN lag(role2) OVER (PARTITION BY conv_id ORDER BY turn) = role2 THEN 0 ELSE 1 END AS new FROM turns)) GROUP BY conv_id, block)"


@add(with_(TURNS, _BLOCKS) + "SELECT * FROM blocks")
def w8_merge_turns(spark, d):
    return R.merge_turns(turns(spark, d), "role2")


@add(with_(TURNS) + "SELECT t.conv_id, t.turn, string_agg(e.role2 || ': ' || e.text, ' ' ORDER BY e.turn) AS context, t.text AS response FROM turns t JOIN turns e ON t.conv_id = e.conv_id AND e.turn < t.turn WHERE t.role2 = 'agent' GROUP BY t.conv_id, t.turn, t.text HAVING count(*) FILTER (WHERE e.role2 = 'customer') > 0")
def w9_context_pairs(spark, d):
    return R.context_pairs(turns(spark, d), "role2")


@add(with_(TURNS, _BLOCKS) + "SELECT b.conv_id, b.block, string_agg(e.role || ': ' || e.text, ' ' ORDER BY e.block) AS context, b.text AS response FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY block) AS nth, max(block) OVER (PARTITION BY conv_id) AS last FROM blocks) b JOIN blocks e ON b.conv_id = e.conv_id AND e.block < b.block WHERE b.role = 'agent' AND nth >= 2 AND b.block < last GROUP BY b.conv_id, b.block, b.text")
def w10_merged_context_pairs(spark, d):
    return R.merged_context_pairs(turns(spark, d), "role2")


@add(with_(TURNS) + "SELECT conv_id, turn, text || ' agent: ' AS prompt, text AS cleaned FROM turns")
def f38_prompt_and_cleaning(spark, d):
    p = R.make_prompt(turns(spark, d).select("conv_id", "turn", F.trim("text").alias("text"), F.col("text").alias("context")))
    said = p.withColumn("raw", F.concat("prompt", "text", F.lit(" customer: agent:")))
    return said.select("conv_id", "turn", "prompt", X.clean_response(F.col("raw"), F.col("prompt")).alias("cleaned"))


@add(with_(TURNS) + "SELECT conv_id, turn, array_to_string(string_split_regex(trim(text), '\\s+')[2:], chr(9)) AS line FROM turns")
def f37_drop_first_token(spark, d):
    return turns(spark, d).select("conv_id", "turn", X.drop_first_token(F.col("text")).alias("line"))


@add(with_(TURNS) + "SELECT count(*) AS n, round(avg(length(text)), 6) AS mean, max(length(text)) AS most FROM turns WHERE role = 'agent'")
def a32_response_length(spark, d):
    o = R.response_length(turns(spark, d).where("role = 'agent'").withColumnRenamed("text", "response"))
    return o.withColumn("mean", r6("mean"))


@add("SELECT d.source AS model, d.lang AS variant, round(avg(greatest((d.doc_id % 100) / 50.0 - 0.4, 0)), 6) AS mean_f1, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def a33_model_comparison(spark, d):
    s = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select(F.col("source").alias("model"), F.col("lang").alias("variant"), ((F.col("doc_id") % 100) / 50.0 - 0.4).alias("f1"))
    return R.model_comparison(s).withColumn("mean_f1", r6("mean_f1"))


@add("WITH tok AS (SELECT doc_id, doc_id // 100 AS batch, unnest(string_split_regex(trim(text), '\\s+')) AS token, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) AS p FROM documents), pos AS (SELECT batch, token, row_number() OVER (PARTITION BY batch ORDER BY doc_id, p) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS total FROM tok) SELECT batch, pos // 128 AS block, md5(string_agg(token, ' ' ORDER BY pos)) AS digest, count(*) AS n FROM pos WHERE total < 128 OR pos // 128 < total // 128 GROUP BY 1, 2")
def w14_pack_tokens(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.split(F.trim("text"), r"\s+").alias("tokens"))
    o = R.pack_tokens(t, "doc_id", "tokens", F.floor(F.col("doc_id") / 100))
    return o.select("batch", "block", F.md5(F.array_join("tokens", " ")).alias("digest"), F.size("tokens").cast("long").alias("n"))


@add(with_(TURNS) + "SELECT conv_id, turn, text || ' agent: ' AS prompt FROM turns")
def f39_make_prompt(spark, d):
    return R.make_prompt(turns(spark, d).select("conv_id", "turn", F.col("text").alias("context"))).select("conv_id", "turn", "prompt")
