"""Declared schemas. Events are read with an explicit schema, never an inferred one."""

from pyspark.sql import types as T

SPAN = T.StructType([
    T.StructField("svc", T.StringType()),
    T.StructField("dur_ms", T.DoubleType()),
])

# What arrives on the wire: `ts` is still text, and a rename source may be
# spelled `from`, `from_` or `service`.
RAW_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("actor", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("change", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("from_", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("incident_id", T.StringType()),
    T.StructField("trigger", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("family", T.LongType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])

# Columns of a normalised event, in order. `us` is epoch microseconds and
# `sec` whole epoch seconds; both are null when the timestamp was unreadable.
EVENT_COLUMNS = [
    "event_id", "ts", "us", "sec", "kind", "service", "version", "actor",
    "level", "msg", "trace_id", "name", "value", "spans", "change", "from_",
    "to", "incident_id", "trigger", "action", "target", "outcome", "family",
]
