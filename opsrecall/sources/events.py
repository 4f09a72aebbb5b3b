"""Reading, normalising, numbering, storing and fetching events."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.types import StructType

from opsrecall.functions import scalars as S
from opsrecall.schema import EVENT_COLUMNS, RAW_EVENT
from opsrecall.session import cut


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank lines vanish, unreadable ones land in `_corrupt_record`."""
    return spark.read.schema(RAW_EVENT).json(path)


def normalise(raw: DataFrame) -> DataFrame:
    """Raw wire rows to the event columns of ``EVENT_COLUMNS``."""
    have = set(raw.columns)

    def pick(name: str, kind: str = "string") -> Column:
        return F.col(f"`{name}`") if name in have else F.lit(None).cast(kind)

    ts = F.col("ts") if dict(raw.dtypes)["ts"] != "string" else S.parse_ts(F.col("ts"))
    rename_src = F.coalesce(*[S.blank_to_null(pick(c)) for c in ("from_", "from", "service")])
    out = raw.select(
        pick("event_id", "bigint").alias("event_id"),
        ts.cast("timestamp").alias("ts"),
        *[pick(c).alias(c) for c in ("kind", "service", "version", "actor", "level", "msg", "trace_id", "name")],
        pick("value", "double").cast("double").alias("value"),
        pick("spans", "array<struct<svc:string,dur_ms:double>>").alias("spans"),
        pick("change").alias("change"),
        F.when(pick("kind") == "topology", rename_src).alias("from_"),
        *[pick(c).alias(c) for c in ("to", "incident_id", "trigger", "action", "target", "outcome")],
        pick("family", "bigint").cast("bigint").alias("family"),
    )
    return with_clock(out)


def with_clock(events: DataFrame) -> DataFrame:
    """Add `us` and `sec` and put the columns in their declared order."""
    us = F.unix_micros("ts")
    return (
        events.withColumn("us", us)
        .withColumn("sec", F.floor(us / 1_000_000).cast("bigint"))
        .select(*EVENT_COLUMNS)
    )


def with_event_ids(events: DataFrame, order: list[str], start: int = 0, into: str = "row_id") -> DataFrame:
    """Number rows from ``start`` in the given order, nulls first.

    Rows are dealt by ranges of all columns of ``order``, which Spark samples, so a busy
    second is split as well as a busy hour; a part's first number is the size of the parts
    before it. ``order`` must tell rows apart, else equal rows share their numbers in any way.
    """
    laid = events.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = cut(laid.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    first = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_first"))
    numbered = laid.join(F.broadcast(first), part == F.col("_part"))
    return numbered.withColumn(into, F.col("_first") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_part", "_first")


class EventLog:
    """Events appended batch by batch, their numbers continuing from batch to batch.

    A batch writes its rows and then a marker with the number after its last; rows without a
    marker are not read. A batch that has its marker is not written again, one that was
    stopped before is written anew, from the same number. Batches come one at a time, and
    ids grow.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[str]):
        self.spark, self.path, self.order = spark, path, order

    def _marks(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("next bigint, batch bigint").parquet(f"{self.path}/marks")
        except AnalysisException:
            return None

    def append(self, events: DataFrame, batch: int) -> None:
        marks = self._marks()
        if marks is not None and not marks.where(F.col("batch") >= batch).isEmpty():
            return
        start = 0 if marks is None else marks.agg(F.max("next")).first()[0] or 0
        numbered = with_event_ids(events, self.order, start)
        numbered.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        n = self.spark.read.parquet(f"{self.path}/rows/batch={batch}").count()
        self.spark.range(1).select(F.lit(start + n).cast("bigint").alias("next")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={batch}")

    def read(self) -> DataFrame:
        marks = self._marks()
        rows = self.spark.read.parquet(f"{self.path}/rows")
        return rows.join(F.broadcast(marks.select("batch")), "batch", "left_semi").drop("batch")  # a row for each batch


def write_events(events: DataFrame, path: str, mode: str = "append", partition_by: tuple[str, ...] = ("event_date", "kind")) -> None:
    """Land events as parquet so that a reader skips what it does not need: a folder for each day and
    kind, rows sorted by service and time, Bloom filters on the ids of events, traces and incidents.

    An empty kind becomes null. Tasks write the folders of the rows they have.
    """
    dated = events.withColumn("event_date", F.to_date("ts")) if "event_date" in partition_by else events
    writer = dated.sortWithinPartitions(*partition_by, "service", "us").write.mode(mode).partitionBy(*partition_by)
    for c in ("event_id", "trace_id", "incident_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def read_events(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    """Landed events with the columns of ``columns`` in their order."""
    return spark.read.schema(columns).parquet(path).select(*columns.fieldNames())


def replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def fetch(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Events whose id is listed in ``ids(event_id)``."""
    return events.join(ids.select("event_id"), "event_id", "left_semi")


def of_kind(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("kind") == kind)


def of_incidents(events: DataFrame) -> DataFrame:
    """(incident_id, seq, event_id, kind): signal first, then what followed."""
    w = Window.partitionBy("incident_id").orderBy("event_id")
    return (
        events.where(F.col("incident_id").isNotNull() & (F.col("incident_id") != ""))
        .select("incident_id", F.row_number().over(w).alias("seq"), "event_id", "kind")
    )


def by_trace(events: DataFrame) -> DataFrame:
    """Per trace id: how many logs and traces carry it."""
    return (
        events.where(F.col("trace_id").isNotNull() & (F.col("trace_id") != ""))
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(F.col("kind") == "log").alias("n_logs"),
            F.count_if(F.col("kind") == "trace").alias("n_traces"),
            F.min("event_id").alias("first_event_id"),
            F.max("event_id").alias("last_event_id"),
        )
    )


def service_mentions(events: DataFrame) -> DataFrame:
    """(event_id, us, sec, kind, name): every service an event belongs to,
    which for a trace are the services of its spans."""
    names = F.array_compact(F.array_union(
        F.array(S.event_service()),
        F.coalesce(
            F.when(F.col("kind") == "trace", F.transform("spans", lambda s: S.blank_to_null(s["svc"]))),
            F.array().cast("array<string>"),
        ),
    ))
    return events.select("event_id", "us", "sec", "kind", F.explode(names).alias("name"))


def search_incidents(incidents: DataFrame, text: str) -> DataFrame:
    """Case-insensitive match on incident id or service."""
    needle = F.lower(F.lit(text))
    return incidents.where(
        F.lower("incident_id").contains(needle) | F.lower(F.coalesce("service", F.lit(""))).contains(needle))
