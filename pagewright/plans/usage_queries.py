"""Queries on options, the usage ledger and task states.

Events stand for usage rows: the user is the key, the event type the service,
the value the size. Customers stand for keys and nations for organisations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.unions import union
from ..operators import usage as U
from ..sources import ledger
from ..sources.files import table
from ..streaming import tasks
from . import steps as S


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in U.STATUSES]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("usage_id"), F.col("event_type").alias("service"), F.col("user_id").alias("api_key_id"), status.alias("status"), "ts",
        F.floor("value").alias("source_size"), F.floor(F.col("value") * 2).alias("target_size"), (F.col("event_id") % 7).alias("engine_id"), F.col("props").alias("extra"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("organisation_id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 10 == 0).alias("revoked"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2024-01-15").cast("timestamp")).alias("expiry_date"),
    )


def organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 0).alias("active"))


def engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" "), F.col("event_type"), F.lit(" ,segmentation,, render_txt,"), F.when(F.col("event_id") % 2 == 0, "join_page").otherwise(" JOIN_LINES "))
    return table(spark, sf_dir, "events").select("event_id", T.parse_options(text).alias("options"))


def option_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = options(spark, sf_dir)
    steps = F.filter("options", lambda x: x != S.RENDER)
    return found.select("event_id", F.array_join("options", ",").alias("options"), F.array_contains("options", S.RENDER).alias("render_txt"), F.array_join(steps, ",").alias("steps"))


def option_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = S.check_options(F.col("options"))
    found = options(spark, sf_dir).select(F.array_join(wrong, ",").alias("invalid"), (F.size(wrong) == 0).alias("valid"))
    return found.groupBy("invalid", "valid").agg(F.count("*").alias("n"))


def usage_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.usage_by_key(usage(spark, sf_dir), keys(spark, sf_dir), organisations(spark, sf_dir))


def usage_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir).withColumn("month", F.date_format("ts", "yyyy-MM"))
    return U.usage_by_key(rows, keys(spark, sf_dir), organisations(spark, sf_dir), ["organisation", "service", "month"])


def usable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp")
    return U.usable_keys(keys(spark, sf_dir), organisations(spark, sf_dir), now).select("id", "name", "organisation")


def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.latest_status(usage(spark, sf_dir), ["api_key_id", "service"])


def latest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.latest(usage(spark, sf_dir), ["api_key_id"], ["ts", "usage_id"]).select("api_key_id", "usage_id", "service", "status")


def unknown_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, unknown = U.resolve_engine(usage(spark, sf_dir), engines(spark, sf_dir))
    rows = union(known.select("engine_id", "engine"), unknown.select("engine_id", F.lit(None).cast("string").alias("engine")))
    return rows.groupBy("engine_id", "engine").agg(F.count("*").alias("n"))


def first_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.default_engine(engines(spark, sf_dir))


def drifted_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that no customer names, as options that a service does not offer."""
    local = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    online = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").filter("s_acctbal > 5000"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi")
    return U.drifted_options(local, online.select(F.col("n_name").alias("name"))).select("n_nationkey", "name")


def find_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select(F.initcap("n_name").alias("name"))
    found = U.find_by_name(rows, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_regionkey"))
    return found.select("name", "catalogue_name", "n_regionkey")


def usage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = U.search(usage(spark, sf_dir), "RCH", "service")
    return found.select("usage_id", "service", "ts", U.extra_field(F.col("extra"), "k").alias("k"))


def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests opened and closed as ledger rows; what holds is the last row of each."""
    opened = ledger.open_usage(usage(spark, sf_dir).drop("status", "target_size"))
    results = usage(spark, sf_dir).filter(U.is_ready(F.col("status"))).select(
        "usage_id", (F.col("status") == "SUCCESS").alias("ok"), (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("ts"), "target_size"
    )
    both = union(opened, ledger.close_usage(opened, results))
    last = U.latest(both, ["usage_id"], ["ts"])
    return last.select("usage_id", "service", "status", "source_size", "target_size")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 500).alias("task_id"), F.upper("event_type").alias("status"), "ts", F.when(F.col("event_type") == "error", F.col("props")).alias("error")
    )
    return tasks.task_status(events)


def extra_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free JSON column written from a prompt, where there is one, and read again."""
    prompt = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('say "'), F.col("event_type"), F.lit('"'))).when(F.col("event_id") % 3 == 1, "")
    rows = table(spark, sf_dir, "events").select("event_id", U.extra_json(prompt=prompt).alias("extra"))
    return rows.select("event_id", "extra", U.extra_field(F.col("extra"), "prompt").alias("prompt"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        option_parse, option_invalid, usage_by_key, usage_by_month, usable_keys, latest_status, latest_usage, unknown_engine, first_engine, drifted_options,
        find_by_name, usage_search, extra_json, ledger_states, task_states,
    )
}

SQL_USAGE = """u AS (SELECT event_id AS usage_id, event_type AS service, user_id AS api_key_id, ['PENDING', 'IN_PROGRESS', 'SUCCESS', 'FAILED'][event_id % 4 + 1] AS status, ts,
  floor(value)::BIGINT AS source_size, floor(value * 2)::BIGINT AS target_size, event_id % 7 AS engine_id, props AS extra FROM events)"""
SQL_SUMS = "count(*) AS n_requests, sum(source_size)::BIGINT AS source_size, sum(target_size)::BIGINT AS target_size, count(*) FILTER (WHERE status = 'FAILED') AS n_failed"
SQL_OPTIONS = """o AS (SELECT event_id, list_filter(list_transform(string_split(' ' || event_type || ' ,segmentation,, render_txt,' ||
  CASE WHEN event_id % 2 = 0 THEN 'join_page' ELSE ' JOIN_LINES ' END, ','), lambda x: upper(trim(x))), lambda x: x <> '') AS o FROM events)"""

ORACLE_SQL = {
    "extra_json": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"prompt":"say \\"' || event_type || '\\""}' END AS extra, CASE WHEN event_id % 3 = 0 THEN 'say "' || event_type || '"' END AS prompt FROM events
""",
    "option_parse": f"WITH {SQL_OPTIONS} SELECT event_id, array_to_string(o, ',') AS options, list_contains(o, 'RENDER_TXT') AS render_txt, array_to_string(list_filter(o, lambda x: x <> 'RENDER_TXT'), ',') AS steps FROM o",
    "option_invalid": f"""
WITH {SQL_OPTIONS},
w AS (SELECT list_filter(o, lambda x: x NOT IN ('DEHYPHENATION', 'JOIN_LINES', 'SENTENCE_SEGMENTATION', 'SEGMENTATION', 'JOIN_PAGE', 'RENDER_TXT')) AS w FROM o)
SELECT array_to_string(w, ',') AS invalid, len(w) = 0 AS valid, count(*) AS n FROM w GROUP BY ALL
""",
    "usage_by_key": f"WITH {SQL_USAGE} SELECT n_name AS organisation, c_name AS key_name, service, {SQL_SUMS} FROM u JOIN customer ON api_key_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "usage_by_month": f"WITH {SQL_USAGE} SELECT n_name AS organisation, service, strftime(ts, '%Y-%m') AS month, {SQL_SUMS} FROM u JOIN customer ON api_key_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "usable_keys": """
SELECT c_custkey AS id, c_name AS name, n_name AS organisation FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_regionkey <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 3 <> 0
""",
    "latest_status": f"""
WITH {SQL_USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY api_key_id, service ORDER BY ts DESC, usage_id DESC) AS r FROM u)
SELECT api_key_id, service, status, ts, status IN ('SUCCESS', 'FAILED') AS ready FROM r WHERE r = 1
""",
    "latest_usage": f"""
WITH {SQL_USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY api_key_id ORDER BY ts DESC, usage_id DESC) AS r FROM u)
SELECT api_key_id, usage_id, service, status FROM r WHERE r = 1
""",
    "unknown_engine": f"WITH {SQL_USAGE} SELECT engine_id, r_name AS engine, count(*) AS n FROM u LEFT JOIN region ON engine_id = r_regionkey GROUP BY ALL",
    "first_engine": "SELECT r_regionkey AS id, r_name AS name FROM region ORDER BY r_regionkey LIMIT 1",
    "drifted_options": "SELECT n_nationkey, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "find_by_name": "SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name, n_name AS catalogue_name, n_regionkey FROM nation",
    "usage_search": f"WITH {SQL_USAGE} SELECT usage_id, service, ts, json_extract_string(extra, '$.k') AS k FROM u WHERE service ILIKE '%rch%'",
    "ledger_states": f"""
WITH {SQL_USAGE}
SELECT usage_id, service, CASE WHEN status IN ('SUCCESS', 'FAILED') THEN status ELSE 'IN_PROGRESS' END AS status, source_size,
       CASE WHEN status IN ('SUCCESS', 'FAILED') THEN target_size END AS target_size FROM u
""",
    "task_states": """
WITH e AS (SELECT event_id % 500 AS task_id, upper(event_type) AS status, ts, CASE WHEN event_type = 'error' THEN props END AS error FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, status DESC) AS r FROM e)
SELECT task_id, status, ts, error FROM r WHERE r = 1
""",
}
