"""Records, wearables and dialogues: filters, paging, upserts, alerts, turns."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

# -- record collections


def find(df: DataFrame, workspace: int, tag: str | None = None, **filters: str) -> DataFrame:
    out = df.where(F.col("workspace_id") == workspace)
    for name, value in filters.items():
        out = out.where(F.col(name) == value)
    return out.where(F.array_contains("tags", tag)) if tag is not None else out


def search(df: DataFrame, term: str, columns: Sequence[str], kind: str | None = None) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    out = df.where(hit)
    return out.where(F.col("type") == kind) if kind is not None else out


def active(df: DataFrame, flag: str, want: bool = True) -> DataFrame:
    """Rows whose flag is ``want``; a missing flag is false."""
    return df.where(F.coalesce(F.col(flag), F.lit(False)) == want)


def encode_cursor(created_at: str, id_: int) -> str:
    return base64.b64encode(json.dumps({"created_at": created_at, "id": id_}).encode()).decode()


def page(df: DataFrame, workspace: int, size: int, cursor: str | None = None, id_: str = "doc_id", ties: bool = True) -> DataFrame:
    """The next ``size`` rows, newest first, with ``has_next`` and the cursor
    after each row. Rows of one time are told apart by id; ``ties=False``
    compares the time only, so equal times at a page's edge are skipped."""
    rows = df.where(F.col("workspace_id") == workspace)
    if cursor is not None:
        at = json.loads(base64.b64decode(cursor))
        ts = F.lit(at["created_at"]).cast("timestamp")
        after = F.col("created_at") < ts
        rows = rows.where(after | ((F.col("created_at") == ts) & (F.col(id_) < at["id"])) if ties else after)
    first = rows.orderBy(F.desc("created_at"), F.desc(id_)).limit(size + 1)
    place = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc(id_)))  # of one page
    numbered = first.withColumn("_n", place).withColumn("has_next", F.max("_n").over(Window.partitionBy()) > size)
    mark = F.base64(F.to_json(F.struct(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), F.col(id_).alias("id"))).cast("binary"))
    return numbered.where(F.col("_n") <= size).withColumn("cursor", mark).drop("_n")


def latest_n(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def cap_per_class(df: DataFrame, column: str, caps: Mapping[str, int | None], order: Sequence[Column]) -> DataFrame:
    """The first rows of each class up to its cap; None is all of them."""
    rows = df.where(F.col(column).isin(*caps))
    cap = F.create_map(*(F.lit(x) for k, v in caps.items() for x in (k, 2**62 if v is None else v)))
    n = F.row_number().over(Window.partitionBy(column).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap[F.col(column)]).drop("_n")


def research_analytics(df: DataFrame) -> DataFrame:
    """Count and mean confidence by workspace and type, and by workspace (type null)."""
    return df.rollup("workspace_id", "type").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")).where("workspace_id is not null")


def status_counts(**kinds: DataFrame) -> DataFrame:
    out = None
    for kind, df in kinds.items():
        part = df.select(F.lit(kind).alias("kind"), F.coalesce(F.col("is_active"), F.lit(False)).alias("a") if "is_active" in df.columns else F.lit(False).alias("a"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("a").alias("n_active"))


# -- updates


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` that no update replaces, and the updates."""
    return target.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def replace_partition(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    return upsert(target, updates, [key])


def apply_updates(df: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    new = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = df.join(new, list(keys), "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in df.columns))


def retain(df: DataFrame, ts: str, as_of: str, weeks: int = 2) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {7 * weeks} DAYS"))


def append_history(df: DataFrame, entries: DataFrame, key: str, column: str) -> DataFrame:
    """Entries (key, at, note) added in order of time to an array column."""
    new = entries.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "note"))).alias("_new"))
    notes = F.transform(F.coalesce("_new", F.array()), lambda x: F.concat_ws(" ", x["at"], x["note"]))
    return df.join(new, key, "left").withColumn(column, F.concat(F.coalesce(column, F.array()), notes)).drop("_new")


def delete_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti")


# -- wearables


def user_features(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.avg("steps").alias("steps_mean"), F.stddev_samp("steps").alias("steps_std"), F.min("steps").alias("steps_min"), F.max("steps").alias("steps_max"),
        F.avg("heart_rate").alias("heart_rate_mean"), F.max("heart_rate").alias("heart_rate_max"), F.sum("class_attended").alias("class_attended_sum"), F.max("churned").alias("churned_max"),
    )


def daily_metrics(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id", "date").agg(F.floor(F.avg("steps")).cast("int").alias("steps"), F.floor(F.avg("heart_rate")).cast("int").alias("heart_rate"), F.max("class_attended").alias("class_attended"))


def activity_deviation(df: DataFrame, as_of: str) -> DataFrame:
    found = df.groupBy("user_id").agg(F.max("date").alias("last_date"), F.avg("steps").alias("avg_steps"), F.max_by("steps", "date").alias("latest_steps"))
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_date").cast("timestamp"))) / 3600
    return found.withColumn("hours", hours).withColumn("deviation", F.try_divide(F.col("avg_steps") - F.col("latest_steps"), F.col("avg_steps")))


def guardian_alerts(df: DataFrame, as_of: str) -> DataFrame:
    return activity_deviation(df, as_of).withColumn("alert", X.guardian_alert(F.col("hours"), F.col("deviation"))).withColumn("severity", X.clinical_severity(F.col("hours"), F.col("deviation")))


def alerts_by_severity(alerts: DataFrame, cls: str = "critical") -> DataFrame:
    return alerts.where(F.coalesce(X.alert_class(F.col("alert")) == cls, F.lit(False)))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """critical, high and moderate alerts, those of the three together (active), and all rows."""
    n = [F.count_if(F.col("alert").rlike(pattern)).alias(cls) for cls, pattern in X.ALERT_CLASS.items()]
    return alerts.agg(*n, F.count("*").alias("total")).select(*X.ALERT_CLASS, sum((F.col(c) for c in X.ALERT_CLASS), F.lit(0)).cast("long").alias("active"), "total")


def interventions(alerts: DataFrame, as_of: str) -> DataFrame:
    """What follows from each alert of severity high or emergency; lower ones have none."""
    severity = F.create_map(*(F.lit(x) for pair in X.ALERT_SEVERITY.items() for x in pair))[F.col("alert")]
    urgent = F.col("severity") == "emergency"
    # Type, recipient and contact of an emergency and of a high alert
    pick = lambda emergency, high: F.when(urgent, emergency).otherwise(high)
    rows = alerts.withColumn("severity", severity).where(F.col("severity").isin("high", "emergency"))
    return rows.select(
        "user_id", "severity", pick("emergency_call", "doctor_notification").alias("type"), pick("emergency", "doctor").alias("recipient"), pick("phone", "email").alias("contact"),
        F.concat(F.lit("Automated intervention for "), "alert").alias("description"), (F.lit(as_of).cast("timestamp") + F.expr("INTERVAL 24 HOURS")).alias("follow_up_at"), F.lit(True).alias("follow_up_required"),
    )


# What is recommended for each tier of churn risk.
RECOMMENDATIONS = {
    "high": ("Immediate engagement required", "Personal trainer consultation", "Offer incentive program"),
    "medium": ("Send motivational messages", "Suggest group activities", "Review fitness goals"),
    "low": ("Continue monitoring", "Send weekly tips"),
}


def churn_report(df: DataFrame, p: str, importance: Mapping[str, float] | None = None) -> DataFrame:
    """tier, confidence and recommendations; with a model's feature importances
    also its three largest as contributing_factors."""
    tier = X.churn_tier(F.col(p))
    advice = F.create_map(*(x for t, texts in RECOMMENDATIONS.items() for x in (F.lit(t), F.array(*map(F.lit, texts)))))[tier]
    out = df.withColumn("tier", tier).withColumn("confidence", F.greatest(F.col(p), 1 - F.col(p))).withColumn("recommendations", advice)
    if importance is None:
        return out
    first = sorted(importance, key=lambda c: -importance[c])[:3]
    return out.withColumn("contributing_factors", F.array(*map(F.lit, first)))


def risk_counts(df: DataFrame, p: str) -> DataFrame:
    return df.agg(F.count_if(F.col(p) > 0.7).alias("high"), F.count_if((F.col(p) > 0.3) & (F.col(p) <= 0.7)).alias("medium"), F.count_if(F.col(p) <= 0.3).alias("low"))


def add_caregiver(alerts: DataFrame, people: DataFrame, default: tuple[str, str] = ("Family Member", "family member")) -> DataFrame:
    """Adds patient, caregiver and relationship from ``people``; a user who is
    not there gets ``default``, as does one without a caregiver."""
    relation = F.col("relationship") if "relationship" in people.columns else F.lit(None).cast("string")
    known = people.select("user_id", "patient", "caregiver", relation.alias("relationship"))
    found = alerts.join(known, "user_id", "left").withColumn("patient", F.coalesce("patient", F.concat(F.lit("Patient "), F.col("user_id").cast("string"))))
    return found.withColumns({"caregiver": F.coalesce("caregiver", F.lit(default[0])), "relationship": F.coalesce("relationship", F.lit(default[1]))})


# Texts of a message for each class of alert. {c} is the caregiver, {p} the patient, {h} the hours
# without activity and {d} the percentage by which activity has dropped.
MESSAGES = {
    "critical": {
        "greeting": "Dear {c}, we need your immediate attention regarding {p}.",
        "summary": "{p} hasn't shown any activity for {h} hours, and their overall activity has dropped by {d}%. This is a critical situation that requires immediate action.",
        "actions": (
            "Call {p} right now - if no answer, go to their location immediately",
            "Check if they have fallen or need emergency medical attention",
            "Call 911 if you cannot reach them or if they appear to be in distress",
            "Contact their primary care physician to alert them of the situation",
            "Stay with them until their condition stabilizes",
        ),
        "reassurance": "Your quick action can make all the difference. We're here to support you through this.",
        "next_steps": "After ensuring their immediate safety, schedule an urgent medical evaluation within 24 hours.",
    },
    "high": {
        "greeting": "Hello {c}, we're concerned about {p} and wanted to alert you.",
        "summary": "{p} has been inactive for {h} hours and their activity level has decreased by {d}%. This needs your attention today.",
        "actions": (
            "Call {p} to check on their wellbeing",
            "If they don't answer, visit them within the next 2 hours",
            "Ask about any pain, discomfort, or changes in their routine",
            "Review their medications to ensure they're taking them properly",
            "Consider arranging a telehealth appointment today",
        ),
        "reassurance": "Early intervention often prevents more serious issues. You're doing great by staying involved.",
        "next_steps": "Schedule a check-up with their doctor this week and consider increasing daily check-ins.",
    },
    "moderate": {
        "greeting": "Hi {c}, we wanted to update you about {p}'s activity patterns.",
        "summary": "We've noticed {p} has been less active recently - {h} hours of inactivity and a {d}% decrease in movement. This might indicate they need some extra support.",
        "actions": (
            "Give {p} a friendly call to see how they're feeling",
            "Ask if they need help with groceries, medications, or appointments",
            "Encourage them to take a short walk or do light exercises",
            "Check if they're eating and sleeping well",
        ),
        "reassurance": "These changes might be temporary, but your attention helps ensure their wellbeing.",
        "next_steps": "Monitor their activity over the next few days and schedule a routine check-up if the pattern continues.",
    },
    "low": {
        "greeting": "Hello {c}, here's a routine update about {p}.",
        "summary": "{p} has shown some minor changes in activity - about {d}% less movement than usual. This is likely normal variation but worth monitoring.",
        "actions": (
            "Check in with {p} during your next regular call",
            "Encourage them to maintain their daily routines",
            "Remind them about any upcoming appointments",
        ),
        "reassurance": "Small fluctuations in activity are normal. Your regular check-ins help maintain their health.",
        "next_steps": "Continue your regular communication schedule and note any concerns for their next doctor visit.",
    },
}
# Numbers to call, and pages to read; the first of each for critical and high alerts only.
CONTACTS = (("Emergency Services", "911"), ("Primary Care Physician", "555-0100"), ("24/7 Nurse Hotline", "555-0199"), ("Support", "555-0150"))
RESOURCES = ("/resources/urgent-response-guide", "/resources/activity-monitoring-guide", "/resources/emergency-checklist", "/community/caregiver-support")


def render_message(alerts: DataFrame) -> DataFrame:
    """A message for each alert as a nested struct, by the alert's class; an unknown deviation counts as 0 %."""
    cls = X.alert_class(F.col("alert"))
    fields = {"c": F.col("caregiver"), "p": F.col("patient"), "h": F.col("hours").cast("int").cast("string"), "d": (F.coalesce("deviation", F.lit(0.0)) * 100).cast("int").cast("string")}

    def filled(text: str) -> Column:
        parts = re.split(r"\{(\w)\}", text)
        return F.concat(*(fields[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x))

    def by_class(make) -> Column:
        cases = F
        for name, texts in MESSAGES.items():
            cases = cases.when(cls == name, make(texts))
        return cases

    urgent = cls.isin("critical", "high")
    contacts = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(x).alias("number")) for n, x in CONTACTS))
    rest = lambda a: F.when(urgent, a).otherwise(F.slice(a, 2, F.size(a)))
    message = F.struct(
        by_class(lambda t: filled(t["greeting"])).alias("greeting"),
        by_class(lambda t: filled(t["summary"])).alias("summary"),
        by_class(lambda t: F.array(*map(filled, t["actions"]))).alias("actions"),
        by_class(lambda t: F.lit(t["reassurance"])).alias("reassurance"),
        by_class(lambda t: F.lit(t["next_steps"])).alias("next_steps"),
        rest(contacts).alias("contacts"),
        rest(F.array(*map(F.lit, RESOURCES))).alias("resources"),
    )
    return alerts.withColumn("message", message)


def analytics_report(users: DataFrame, alerts: DataFrame, predictions: DataFrame, actions: DataFrame, as_of: str, days: int = 7, at: str = "timestamp") -> DataFrame:
    """One row: the period of ``days`` up to ``as_of``, users, the alerts whose
    time ``at`` lies in it (both ends count) by severity, users at risk,
    interventions. Alerts without a time lie outside, those without a severity
    count as unknown; risk and interventions are those of all time."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.expr(f"INTERVAL {int(days)} DAY")
    inside = alerts.where(F.col(at).cast("timestamp").between(start, end)).groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).count()
    severity = inside.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "count")))).alias("by_severity"), F.coalesce(F.sum("count"), F.lit(0)).alias("alerts"))
    u = users.agg(F.count_distinct("user_id").alias("users"))
    r = predictions.where("tier in ('high', 'medium')").agg(F.count_distinct("user_id").alias("at_risk"))
    i = actions.agg(F.count("*").alias("interventions"))
    return u.crossJoin(severity).crossJoin(r).crossJoin(i).withColumns({"period_start": start, "period_end": end})  # one row each


# -- dialogues


def conversation_lines(turns: DataFrame, keep_actions: bool = False, sep: str = "\t", one_line: bool = False) -> DataFrame:
    """One line a conversation: its turns as "role: text", in order; with
    ``one_line`` each line end inside a turn becomes a space."""
    rows = turns if keep_actions else turns.where("role <> 'action'")
    text = F.translate("text", "\n\r", "  ") if one_line else F.col("text")
    line = F.struct("turn", F.concat_ws(": ", "role", text).alias("line"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), sep).alias("line"))


def merge_turns(turns: DataFrame, role: str = "role") -> DataFrame:
    """Runs of turns by one speaker as blocks: conv_id, block (from 1), role, text, first_turn."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    new = F.coalesce((F.lag(role).over(by) != F.col(role)).cast("int"), F.lit(1))
    rows = turns.withColumn("_new", new).withColumn("block", F.sum("_new").over(by))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("conv_id", "block").agg(F.first(role).alias("role"), joined.alias("text"), F.min("turn").alias("first_turn"))


def _with_context(rows: DataFrame, order: str, role: str, max_turns: int | None) -> DataFrame:
    by = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding if max_turns is None else -max_turns, -1)
    said = F.concat_ws(": ", role, "text")
    return rows.withColumn("context", F.array_join(F.collect_list(said).over(by), " ")).withColumn("_seen", F.coalesce(F.max((F.col(role) == "customer").cast("int")).over(by), F.lit(0)))


def context_pairs(turns: DataFrame, role: str = "role", max_turns: int | None = None) -> DataFrame:
    """Each agent turn that follows a customer turn, with all turns before it
    (the last ``max_turns`` of them)."""
    rows = _with_context(turns, "turn", role, max_turns)
    return rows.where((F.col(role) == "agent") & (F.col("_seen") == 1)).select("conv_id", "turn", "context", F.col("text").alias("response"))


def merged_context_pairs(turns: DataFrame, role: str = "role", include_last: bool = False) -> DataFrame:
    """Pairs of blocks: an agent's first block and the conversation's last give none."""
    blocks = _with_context(merge_turns(turns, role), "block", "role", None)
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("block"))
    last = F.max("block").over(Window.partitionBy("conv_id"))
    rows = blocks.withColumn("_nth", nth).withColumn("_last", last).where((F.col("role") == "agent") & (F.col("_nth") >= 2))
    rows = rows if include_last else rows.where(F.col("block") < F.col("_last"))
    return rows.select("conv_id", "block", "context", F.col("text").alias("response"))


def make_prompt(df: DataFrame, suffix: str = " agent: ") -> DataFrame:
    return df.withColumn("prompt", F.concat("context", F.lit(suffix)))


def response_length(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(F.length("response")).alias("mean"), F.max(F.length("response")).alias("most"))


def pack_tokens(df: DataFrame, key: str, tokens: str, batch: Column, block: int = 128) -> DataFrame:
    """Token lists joined within batches and cut into blocks; a batch's rest is
    dropped, or kept if it is all the batch has: batch, block, tokens."""
    rows = df.select(key, batch.alias("batch"), F.col(tokens).alias("_t"))
    ahead = F.coalesce(F.sum(F.size("_t")).over(Window.partitionBy("batch").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.size("_t")).over(Window.partitionBy("batch"))
    each = rows.withColumn("_a", ahead).withColumn("_total", total).withColumn("_z", F.col("_a") + F.size("_t")).where("_z > _a")
    # a row a list and block, not a row a token
    each = each.withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_z") - 1) / block))))
    whole = each.where((F.col("_total") < block) | (F.col("block") < F.floor(F.col("_total") / block)))
    first, end = F.greatest(F.col("block") * block, "_a"), F.least((F.col("block") + 1) * block, "_z")
    pieces = whole.select("batch", "block", first.alias("at"), F.slice("_t", (first - F.col("_a") + 1).cast("int"), (end - first).cast("int")).alias("piece"))
    return pieces.groupBy("batch", "block").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("tokens"))


def model_comparison(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "variant").agg(F.avg(F.greatest(F.col("f1"), F.lit(0.0))).alias("mean_f1"), F.count("*").alias("n"))
