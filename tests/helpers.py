"""Small event logs typed in by hand."""

import json
from datetime import datetime, timedelta

from opsrecall.sources import events as SRC


def at(start: str, seconds: int) -> str:
    return (datetime.fromisoformat(start) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def sequence(start: str, *steps: tuple) -> list[dict]:
    """Events at seconds after ``start``: (seconds, kind, fields)."""
    return [{"ts": at(start, s), "kind": kind, **fields} for s, kind, fields in steps]


# An index is moved to a new name while a search page depends on it; its next release breaks the
# page, which raises an alert much later. A cache takes no part.
MOVED_INDEX = sequence(
    "2029-06-11T21:40:00",
    (0, "trace", {"trace_id": "q-1", "spans": [{"svc": "search-page", "dur_ms": 80}, {"svc": "word-index", "dur_ms": 35}, {"svc": "geo-cache", "dur_ms": 5}]}),
    (95, "topology", {"change": "rename", "from": "word-index", "to": "term-index"}),
    (400, "deploy", {"service": "term-index", "version": "r88"}),
    (412, "metric", {"service": "geo-cache", "name": "cpu_percent", "value": 64}),
    (447, "log", {"service": "search-page", "level": "error", "msg": "term-index gave up after three tries"}),
    (470, "metric", {"service": "term-index", "name": "latency_p99_ms", "value": 5200}),
    (1190, "incident_signal", {"incident_id": "SRCH-7", "trigger": "alert:search-page/empty-results"}),
    (4000, "remediation", {"incident_id": "SRCH-7", "action": "rollback", "target": "term-index", "outcome": "resolved"}),
)


def bad_release(start: str, incident: str, index: str, slow: int, alert: int, fixed: int | None) -> list[dict]:
    """A release of ``index``, slow answers, failing searches, an alert and perhaps a rollback."""
    steps = [
        (0, "deploy", {"service": index, "version": f"for-{incident}"}),
        (slow, "metric", {"service": index, "name": "latency_p99_ms", "value": 2100 + slow}),
        (slow + 9, "log", {"service": "search-page", "level": "error", "msg": f"{index} gave up after three tries"}),
        (alert, "incident_signal", {"incident_id": incident, "trigger": "alert:search-page/empty-results", "family": 4}),
    ]
    if fixed is not None:
        steps.append((fixed, "remediation", {"incident_id": incident, "action": "rollback", "target": index, "outcome": "resolved"}))
    return sequence(start, *steps)


# Three bad releases under the old name, one more under the new name, still open.
RELEASES = [
    *bad_release("2029-02-03T04:00:00", "SRCH-1", "word-index", 22, 100, 1500),
    *bad_release("2029-03-09T13:20:00", "SRCH-2", "word-index", 27, 118, 900),
    *bad_release("2029-04-21T08:45:00", "SRCH-5", "word-index", 19, 95, 2400),
    {"ts": "2029-05-02T06:00:00Z", "kind": "topology", "change": "rename", "from": "word-index", "to": "term-index"},
    *bad_release("2029-06-30T17:10:00", "SRCH-9", "term-index", 25, 110, None),
]


def rename(ts: str, src: str, dst: str) -> dict:
    return {"ts": ts, "kind": "topology", "change": "rename", "from_": src, "to": dst}


def load(spark, tmp_path, rows):
    """Rows through the JSONL source, with a blank line in the middle."""
    lines = [json.dumps({"event_id": i, **r}) for i, r in enumerate(rows)]
    f = tmp_path / "events.jsonl"
    f.write_text("\n".join([*lines[:1], "", *lines[1:]]) + "\n")
    return SRC.normalise(SRC.read_jsonl(spark, str(f)))
