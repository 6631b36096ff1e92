"""Inputs of the queries, derived from the given tables by fixed expressions;
the same derivations as SQL, for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and SQL by the same names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(settled(spark), sf_dir)

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.sql[f.__name__] = sql
            return run

        return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def access_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    t = F.col("event_type")
    activity = (
        F.when(t == "signup", "Logon")
        .when(t == "view", "Lock")
        .when(t == "click", F.when(F.col("k") < 10, "Browsing Hacking Sites").when(F.col("k") < 30, "Browsing Job Search Sites").otherwise("Browsing Neutral Sites"))
        .when(t == "error", "PeFileWritten")
        .when(t == "purchase", F.when(F.col("k") % 2 == 0, "Unlock").otherwise("Privileged Logon"))
    )
    m = F.col("event_id") % 6
    suffix = F.when(m == 0, ".doc").when(m == 1, ".DOCX").when(m == 2, ".exe").when(m == 3, ".dll").when(m == 4, ".txt")
    return e.select(
        "event_id",
        F.date_trunc("second", "ts").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("account"),
        F.concat(F.lit("PC"), (F.col("user_id") * 2 + F.when(F.col("k") % 4 == 0, 1).otherwise(0)).cast("string")).alias("host"),
        activity.alias("activity"),
        F.concat(F.lit("f"), F.col("event_id").cast("string"), suffix).alias("details"),
        "k",
        "value",
    )


ACC = """acc AS (SELECT event_id, date_trunc('second', ts) AS ts, 'u' || user_id AS account,
 'PC' || (user_id * 2 + CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END) AS host,
 CASE event_type WHEN 'signup' THEN 'Logon' WHEN 'view' THEN 'Lock'
  WHEN 'click' THEN CASE WHEN k < 10 THEN 'Browsing Hacking Sites' WHEN k < 30 THEN 'Browsing Job Search Sites' ELSE 'Browsing Neutral Sites' END
  WHEN 'error' THEN 'PeFileWritten' WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'Unlock' ELSE 'Privileged Logon' END END AS activity,
 'f' || event_id || CASE event_id % 6 WHEN 0 THEN '.doc' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.exe' WHEN 3 THEN '.dll' WHEN 4 THEN '.txt' ELSE NULL END AS details, k, value
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events))"""

UNL = "activity IN ('Logon','Privileged Logon','Unlock')"
NEAR = f"""near AS (SELECT account, host, ts, {UNL} AS opens,
 min(CASE WHEN activity = 'Lock' THEN ts END) OVER (PARTITION BY account, host ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_lock,
 max(CASE WHEN {UNL} THEN ts END) OVER (PARTITION BY account, host ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_unlock
 FROM acc WHERE {UNL} OR activity = 'Lock')"""
SESS = """sess AS (SELECT account, host, min(ts) AS unlock_time, next_lock AS lock_time FROM near WHERE opens AND next_lock IS NOT NULL GROUP BY account, host, next_lock)"""
PRIM = """prim AS (SELECT account, host AS primary_host FROM (SELECT account, host, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, host) AS n FROM acc GROUP BY account, host) WHERE n = 1)"""
JOINED = """joined AS (SELECT s.*, a.event_id, a.ts, a.activity, a.details FROM acc a JOIN sess s ON a.account = s.account AND a.host = s.host AND a.ts >= s.unlock_time AND a.ts <= s.lock_time)"""
JOINED_LEFT = JOINED.replace("joined AS", "joined_left AS").replace("a.ts <= s.lock_time", "a.ts < s.lock_time")
DAYS7 = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
DAYP = "dayp AS (SELECT account, " + ", ".join(f"avg(CASE WHEN dayname(ts) = '{d}' THEN 1.0 ELSE 0.0 END) AS {d.lower()}" for d in DAYS7) + " FROM acc GROUP BY account)"
LONGP = "longp AS (" + " UNION ALL ".join(f"SELECT account, '{d.lower()}' AS day, {d.lower()} AS share FROM dayp" for d in DAYS7) + ")"
DAYC = "dayc AS (SELECT l.account, l.day, CASE WHEN l.share <= s.low OR l.share = 0 THEN 'abnormal' ELSE 'normal' END AS cls FROM longp l JOIN (SELECT account, list_sort(list(share))[2] AS low FROM longp GROUP BY account) s USING (account))"
HOURP = """hourp AS (SELECT w.account, w.day, coalesce(h.a, 0) AS start_hour, coalesce(h.b, 23) AS end_hour FROM (SELECT DISTINCT account, unnest(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']) AS day FROM acc) w
 LEFT JOIN (SELECT account, dayname(d) AS day, CAST(floor(avg(hour(a))) AS INT) AS a, CAST(floor(avg(hour(b))) AS INT) AS b FROM (SELECT account, CAST(ts AS DATE) AS d, min(ts) AS a, max(ts) AS b FROM acc GROUP BY ALL) GROUP BY account, dayname(d)) h ON w.account = h.account AND w.day = h.day)"""
HOSTP = "hostp AS (SELECT account, host, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY account) AS freq FROM acc GROUP BY account, host)"


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = c.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("account"), F.col("c_mktsegment").alias("title"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("department"), F.col("r_name").alias("company"))


ATTR = "attr AS (SELECT 'u' || c_custkey AS account, c_mktsegment AS title, 'd' || c_nationkey AS department, r_name AS company FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), k.cast("string")).alias("account"), F.when(k % 3 == 0, "G").when(k % 7 == 0, "U").otherwise("B").alias("status"), (k % 5 != 0).alias("known")
    )


USERS = "users AS (SELECT 'u' || c_custkey AS account, CASE WHEN c_custkey % 3 = 0 THEN 'G' WHEN c_custkey % 7 = 0 THEN 'U' ELSE 'B' END AS status, c_custkey % 5 <> 0 AS known FROM customer)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "customer").when(F.col("role") == "assistant", "agent").otherwise("action")
    return c.select("conv_id", "turn", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "agent").otherwise(role).alias("role2"), role.alias("role"), "text")


TURNS = """turns AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent' ELSE 'action' END AS role,
 CASE WHEN (conv_id + turn) % 5 = 0 THEN 'agent' WHEN role = 'user' THEN 'customer' WHEN role = 'assistant' THEN 'agent' ELSE 'action' END AS role2, text FROM conversations)"""


def _point(key: Column, a: int, b: int) -> tuple[Column, Column]:
    return (F.lit(-74.02) + (key * a % 2000) / 10000.0), (F.lit(40.70) + (key * b % 2000) / 10000.0)


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _point(F.col("c_custkey"), 7919, 6007)
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), lon.alias("lon"), lat.alias("lat"), (0.95 + (F.col("c_acctbal") % 100) / 1000.0).alias("target"))


POINTS = "points AS (SELECT c_custkey AS point_id, -74.02 + (c_custkey * 7919 % 2000) / 10000.0 AS lon, 40.70 + (c_custkey * 6007 % 2000) / 10000.0 AS lat, 0.95 + (c_acctbal % 100) / 1000.0 AS target FROM customer)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _point(F.col("p_partkey"), 104729, 7907)
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("site_id"), lon.alias("site_lon"), lat.alias("site_lat"), (F.col("p_retailprice") / 1e9).alias("area"), F.when(F.col("p_size") % 10 != 0, F.col("p_size").cast("double")).alias("height")
    )


SITES = "sites AS (SELECT p_partkey AS site_id, -74.02 + (p_partkey * 104729 % 2000) / 10000.0 AS site_lon, 40.70 + (p_partkey * 7907 % 2000) / 10000.0 AS site_lat, p_retailprice / 1e9 AS area, CASE WHEN p_size % 10 <> 0 THEN CAST(p_size AS DOUBLE) END AS height FROM part)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .groupBy((F.col("l_partkey") % 200).cast("int").alias("row"), (F.col("l_orderkey") % 200).cast("int").alias("col"))
        .agg(
            F.avg("l_quantity").alias("value"),
            F.avg("l_quantity").alias("blue"),
            F.avg(F.col("l_extendedprice") / 1e4).alias("green"),
            F.avg(F.col("l_discount") * 10).alias("red"),
            F.avg(F.col("l_tax") * 10).alias("nir"),
            F.avg((F.col("l_suppkey") % 7).cast("double")).alias("swir1"),
            F.avg(F.col("l_linenumber").cast("double")).alias("swir2"),
        )
    )


PIXELS = "pixels AS (SELECT CAST(l_partkey % 200 AS INT) AS row, CAST(l_orderkey % 200 AS INT) AS col, avg(l_quantity) AS value, avg(l_quantity) AS blue, avg(l_extendedprice / 1e4) AS green, avg(l_discount * 10) AS red, avg(l_tax * 10) AS nir, avg(CAST(l_suppkey % 7 AS DOUBLE)) AS swir1, avg(CAST(l_linenumber AS DOUBLE)) AS swir2 FROM lineitem GROUP BY 1, 2)"
#: Corner and pixel size of the raster.
AFFINE = (-74.02, 40.90, 0.001)


def wearables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    late = F.when(F.col("user_id") % 4 == 3, 1).otherwise(-F.col("user_id") % 4).cast("int")  # users fall silent on different days
    return e.groupBy("user_id", F.date_add(F.to_date("ts"), late).alias("date")).agg(
        F.floor(F.round(F.sum("value") * 20, 3)).cast("int").alias("steps"),
        (F.lit(60) + F.floor(F.avg("k")).cast("int")).alias("heart_rate"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("class_attended"),
    ).withColumn("churned", (F.col("user_id") % 5 == 0).cast("int"))


WEAR = """wear AS (SELECT user_id, CAST(ts AS DATE) + CAST(CASE WHEN user_id % 4 = 3 THEN 1 ELSE -(user_id % 4) END AS INT) AS date, CAST(floor(round(sum(value) * 20, 3)) AS INT) AS steps, 60 + CAST(floor(avg(k)) AS INT) AS heart_rate,
 max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS class_attended, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS churned
 FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events) GROUP BY user_id, CAST(ts AS DATE))"""
AS_OF = "2024-01-30 04:00:00"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    minutes = F.floor(F.col("doc_id") / 3)
    return d.select(
        "doc_id", (F.col("doc_id") % 5).cast("int").alias("workspace_id"), F.col("source").alias("type"), F.col("lang").alias("source"), F.array("lang", "source").alias("tags"),
        F.col("quality").cast("double").alias("confidence"), F.timestamp_micros(F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp")) + minutes * 60_000_000).alias("created_at"), "text",
    )


RECS = "recs AS (SELECT d.doc_id, CAST(d.doc_id % 5 AS INT) AS workspace_id, d.source AS type, d.lang AS source, [d.lang, d.source] AS tags, CAST(l.quality AS DOUBLE) AS confidence, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id // 3) AS created_at, d.text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x1..x4 and y."""
    e = load(spark, sf_dir, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(4)]
    return e.select("vec_id", "label", *(c.alias(f"x{i + 1}") for i, c in enumerate(x)), (x[0] * 2 + x[1]).alias("y"))


FEAT = "feat AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2, CAST(embedding[3] AS DOUBLE) AS x3, CAST(embedding[4] AS DOUBLE) AS x4, CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", ((F.col("n_chars") % 97) / 97.0 * 0.08).alias("score"), F.col("toxic").alias("label"))


SCORES = "scores AS (SELECT d.doc_id, d.lang, (d.n_chars % 97) / 97.0 * 0.08 AS score, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def prediction_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = geo_points(spark, sf_dir)
    key = ["point_id", "lon", "lat"]
    return p.select(*key, F.col("target").alias("a")), p.select(*key, (F.col("target") + ((F.col("point_id") % 21) - 10) / 1000.0).alias("b"))


PRED = "pred AS (SELECT point_id, lon, lat, target AS a, target + ((point_id % 21) - 10) / 1000.0 AS b FROM points)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
