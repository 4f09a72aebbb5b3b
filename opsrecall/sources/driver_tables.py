"""Telemetry derived from the `events` table, plus the other mapped inputs.

The rules are those of FIXTURES.md section 2. Counting renames before an event
and finding the last signal before it are prefix computations per service; they
run inside (service, hour) groups and are offset by hourly totals, so no task
sees a whole service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from opsrecall.sources.events import with_clock

HOUR_US = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id",
        F.expr("user_id % 12").alias("s"),
        F.expr("event_type = 'view' AND event_id % 97 = 0").alias("is_rename"),
        F.expr("CASE WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN event_id END").alias("signal_id"),
    ).withColumn("hour", F.floor(F.unix_micros("ts") / HOUR_US))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _base(spark, sf_dir)
    inside = Window.partitionBy("s", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    hours = base.groupBy("s", "hour").agg(
        F.count_if("is_rename").alias("n"), F.max("signal_id").alias("m"))
    earlier = Window.partitionBy("s").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carry = hours.select(
        "s", "hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("gen0"),
        F.max("m").over(earlier).alias("sig0"))
    rows = (
        base
        .withColumn("gen_in", F.coalesce(F.sum(F.col("is_rename").cast("int")).over(inside), F.lit(0)))
        .withColumn("sig_in", F.max("signal_id").over(inside))
        .join(carry, ["s", "hour"])
        .withColumn("gen", F.col("gen0") + F.col("gen_in"))
        .withColumn("last_signal", F.coalesce("sig_in", "sig0"))
    )
    rows = rows.selectExpr(
        "*",
        "CONCAT('s', LPAD(CAST(s AS STRING), 2, '0')) AS stem",
        "CONCAT('s', LPAD(CAST((s + 1) % 12 AS STRING), 2, '0'), '-svc') AS next1",
        "CONCAT('s', LPAD(CAST((s + 2) % 12 AS STRING), 2, '0'), '-svc') AS next2",
        """CASE event_type WHEN 'signup' THEN 'deploy' WHEN 'error' THEN 'log' WHEN 'click' THEN 'metric'
             WHEN 'view' THEN CASE WHEN event_id % 97 = 0 OR event_id % 41 = 0 THEN 'topology' ELSE 'trace' END
             WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'incident_signal' WHEN 1 THEN 'remediation'
                                  ELSE 'metric' END END AS kind""",
    ).withColumn("live", F.expr(
        "CONCAT(stem, CASE WHEN gen = 0 THEN '' ELSE CONCAT('r', CAST(gen AS STRING)) END, '-svc')"))
    mapped = rows.where("NOT (kind = 'remediation' AND last_signal IS NULL)").selectExpr(
        "event_id", "ts", "kind",
        """CASE WHEN kind IN ('trace', 'topology') OR (kind = 'incident_signal' AND event_id % 8 = 0) THEN NULL
             ELSE live END AS service""",
        "CASE WHEN kind = 'deploy' THEN CONCAT('v', CAST(event_id % 9 + 1 AS STRING)) END AS version",
        "CAST(NULL AS STRING) AS actor",
        "CASE WHEN kind = 'log' THEN CASE WHEN event_id % 3 <> 0 THEN 'error' ELSE 'info' END END AS level",
        """CASE WHEN kind = 'log' THEN CONCAT('timeout calling ', next1, ' req_id=', CAST(event_id AS STRING))
             END AS msg""",
        """CASE WHEN kind IN ('log', 'trace') THEN CONCAT('tr-', CAST((event_id - event_id % 16) AS STRING))
             END AS trace_id""",
        """CASE WHEN kind = 'metric' THEN CASE event_id % 5 WHEN 0 THEN 'latency_p99_ms' WHEN 1 THEN 'error_rate'
             WHEN 2 THEN 'cpu_percent' WHEN 3 THEN 'memory_percent' ELSE 'qps' END END AS name""",
        """CASE WHEN kind = 'metric' THEN CASE event_id % 5 WHEN 0 THEN value * 100 WHEN 1 THEN value / 1000
             WHEN 2 THEN value WHEN 3 THEN value ELSE value * 10 END END AS value""",
        """CASE WHEN kind = 'trace' THEN
             CASE WHEN event_id % 3 = 0 THEN ARRAY(
                 NAMED_STRUCT('svc', live, 'dur_ms', value * 50), NAMED_STRUCT('svc', next1, 'dur_ms', value * 40),
                 NAMED_STRUCT('svc', next2, 'dur_ms', value * 30))
               ELSE ARRAY(
                 NAMED_STRUCT('svc', live, 'dur_ms', value * 50), NAMED_STRUCT('svc', next1, 'dur_ms', value * 40))
             END END AS spans""",
        """CASE WHEN kind = 'topology' THEN CASE WHEN is_rename THEN 'rename' WHEN event_id % 2 = 0 THEN 'dep_add'
             ELSE 'dep_remove' END END AS change""",
        "CASE WHEN kind = 'topology' THEN live END AS from_",
        """CASE WHEN kind = 'topology' THEN CASE WHEN is_rename
             THEN CONCAT(stem, 'r', CAST(gen + 1 AS STRING), '-svc') ELSE next1 END END AS to""",
        """CASE kind WHEN 'incident_signal' THEN CONCAT('INC-', CAST(event_id AS STRING))
             WHEN 'remediation' THEN CONCAT('INC-', CAST(last_signal AS STRING)) END AS incident_id""",
        """CASE WHEN kind = 'incident_signal' THEN CONCAT('alert:', live, '/', CASE event_id % 3
             WHEN 0 THEN 'latency_p99_ms>3000' WHEN 1 THEN 'error-rate>5%' ELSE 'cpu_saturation' END) END AS trigger""",
        """CASE WHEN kind = 'remediation' THEN CASE s % 5 WHEN 0 THEN 'rollback' WHEN 1 THEN 'restart'
             WHEN 2 THEN 'scale_up' WHEN 3 THEN 'config_change' ELSE 'failover' END END AS action""",
        "CASE WHEN kind = 'remediation' THEN live END AS target",
        "CASE WHEN kind = 'remediation' THEN CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'resolved' END END AS outcome",
        "CASE WHEN kind = 'incident_signal' THEN CAST(s % 8 AS BIGINT) END AS family",
    )
    return with_clock(mapped)


def replica_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell changes of three peers on the customers: (tbl, key, col, value, version, peer, deleted)."""
    c = table(spark, sf_dir, "customer")

    def cells(cond: str, peer: str, version: int, col: str, value: str, deleted: str = "false") -> DataFrame:
        return c.where(cond).selectExpr(
            "'users' AS tbl", "CAST(c_custkey AS STRING) AS key", f"'{col}' AS col", f"{value} AS value",
            f"CAST({version} AS BIGINT) AS version", f"'{peer}' AS peer", f"{deleted} AS deleted")

    return (
        cells("true", "A", 1, "name", "c_name")
        .unionByName(cells("true", "A", 1, "email", "CONCAT('u', CAST(c_custkey % 97 AS STRING), '@x')"))
        .unionByName(cells("c_custkey % 3 = 0", "A", 2, "segment", "c_mktsegment"))
        .unionByName(cells("c_custkey % 4 = 0", "B", 2, "balance", "CAST(CAST(FLOOR(c_acctbal * 100) AS BIGINT) AS STRING)"))
        .unionByName(cells("c_custkey % 6 = 0", "B", 3, "segment", "UPPER(CONCAT(c_mktsegment, '-b'))"))
        .unionByName(cells("c_custkey % 10 = 0", "C", 4, "", "CAST(NULL AS STRING)", "true"))
    )


def replica_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS id", "CAST(o_custkey AS STRING) AS user_id", "o_orderstatus AS status",
        "CAST(FLOOR(o_totalprice * 100) AS BIGINT) AS total_cents")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(patterns, queries): the first vector of each label, and all others."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    patterns = e.join(first, ["label", "vec_id"]).select(
        F.col("label").cast("bigint").alias("idx"), F.col("embedding").cast("array<double>").alias("x"))
    queries = e.join(first, ["label", "vec_id"], "left_anti").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"),
        F.col("label").cast("bigint").alias("truth"))
    return patterns, queries


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, us, msg): document text split into lines, in order. Ids are unique while
    documents have fewer than 2**24 lines and ids below 2**39."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "msg"))
    order = F.col("doc_id") * (1 << 24) + F.col("line")
    return d.select(order.alias("line_id"), order.alias("us"), "msg")
