"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score.

Only built-in column functions. A text is cut at the matches of a pattern once, and the
lengths of what lies between and of the matches add up to the places of the spans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, written so that they never backtrack over a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"

# How far before a span its context reaches, in code points, and the score a span needs.
CONTEXT = 40
NEEDED = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its checksum: moved, spelled in digits, the remainder is 1."""
    bare = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))

    def step(a: Column, ch: Column) -> Column:
        value = F.ascii(ch)
        return F.when(value >= 65, (a * 100 + value - 55) % 97).otherwise((a * 10 + value - 48) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step) == 1


def _ip_parts(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the test its matches must pass, its score before
    context, and words that raise the score when they stand before a span."""

    name: str
    pattern: str
    holds: object
    score: float = NEEDED
    words: str = ""


def _between(c: Column, low: int, high: int) -> Column:
    n = F.length(_digits(c))
    return (n >= low) & (n <= high)


BASE = (
    Kind("email", EMAIL, lambda m: F.lit(True)),
    Kind("ip", IP, _ip_parts),
    Kind("card", CARD, lambda m: _between(m, 14, 19) & luhn(_digits(m))),
    Kind("phone", PHONE, lambda m: _between(m, 10, 15)),
)
MORE = (
    Kind("iban", IBAN, mod97),
    Kind("national_id", NATIONAL, lambda m: ~m.rlike("^(000|666|9)"), 0.2, "ssn|social security|national id|tax id"),
    Kind("local_phone", LOCAL_PHONE, lambda m: F.lit(True), 0.2, "phone|call|tel|mobile|fax|whatsapp"),
)
KINDS = BASE + MORE


def _kind_spans(text: Column, kind: Kind, order: int) -> Column:
    """Array of (start, kind order, end, kind) of the matches of a kind that count."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    placed = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + p["gap"] + F.length(p["hit"])).alias("at"),
            F.concat(a["out"], F.array(F.struct(
                (a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))).alias("out")),
        lambda a: a["out"])

    def counts(s: Column) -> Column:
        score = F.lit(kind.score)
        if kind.words:
            begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
            near = F.lower(F.substr(text, begin + 1, s["start"] - begin))
            score = score + F.when(near.rlike(rf"(?<![a-z])(?:{kind.words})(?![a-z])"), 0.5).otherwise(0.0)
        return kind.holds(s["hit"]) & (score >= NEEDED)

    spans = F.transform(
        F.filter(placed, counts),
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind.name).alias("kind")))
    none = F.expr("cast(array() as array<struct<start:int,order:int,end:int,kind:string>>)")
    return F.when(text.rlike(kind.pattern), spans).otherwise(none)


def with_spans(docs: DataFrame, text_column: str = "text", kinds: tuple[Kind, ...] = KINDS, into: str = "pii_spans") -> DataFrame:
    """``docs`` with the spans of every text, by start and kind, in code points, ends exclusive.

    Matches are leftmost and do not overlap within a kind; spans of two kinds may. Null
    and empty texts have none. All columns and rows of ``docs`` stay; ``into`` must be
    a name of its own.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = [_kind_spans(text, k, i) for i, k in enumerate(kinds)]
    return docs.withColumn(into, F.array_sort(reduce(lambda a, b: F.concat(a, b), found)))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(order: int):
    return lambda s: s["order"] == order


def digest(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of the base kinds, a hash of their spans, and all spans, of every row."""
    spans = with_spans(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")))
    base = F.filter("pii_spans", lambda s: s["order"] < len(BASE))
    counts = [F.size(F.filter("pii_spans", _of_kind(i))).cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return spans.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, as in ``<email>``.

    Spans that overlap are replaced together, under the name of the first. Null texts
    stay null; other columns are untouched.
    """
    spans, text = F.col("__pii_spans"), F.col(text_column)
    merged = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["end"] <= a["at"], a)
        .when(s["start"] < a["at"], F.struct(a["done"].alias("done"), s["end"].alias("at")))
        .otherwise(F.struct(F.concat(a["done"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("done"), s["end"].alias("at"))),
        lambda a: F.concat(a["done"], F.substr(text, a["at"] + 1)))
    return (
        with_spans(docs, text_column, into="__pii_spans")
        .withColumn(text_column, F.when(F.size(spans) > 0, merged).otherwise(text)).drop("__pii_spans")
    )
