"""Log templates: exact masked shapes first, then shapes that agree on enough tokens.

Shapes with the same number of tokens and the same first tokens form a group. What a group
agrees on is a summary that can be merged in any order: a token for a place where all have
it, else the wildcard. A shape belongs to the largest group of its own that agrees on half
of the places, so its template depends on the set of shapes alone, not on their order, on
how they are partitioned or on how many there are.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from opsrecall.functions import scalars as S
from opsrecall.session import cut

WILDCARD = "<*>"
THRESHOLD = 0.5


def mask(tokens):
    """Tokens with a digit become the wildcard."""
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def shapes(logs: DataFrame, masked: bool = True, chars: int | None = S.LOG_CHARS) -> DataFrame:
    """``logs(us, msg)`` grouped by shape: (shape, n_tokens, freq, first_seen,
    last_seen). Counted map-side. Without masking a shape is the plain token list.
    Messages count with their first ``chars`` characters, or as a whole."""
    tokens = S.log_tokens(F.col("msg"), chars)
    return (
        logs.select("us", (mask(tokens) if masked else tokens).alias("t")).where(F.size("t") > 0)
        .select("us", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("shape"))
        .groupBy("shape", "n_tokens")
        .agg(F.count(F.lit(1)).alias("freq"), F.min("us").alias("first_seen"), F.max("us").alias("last_seen"))
    )


def shape_of(msg, masked: bool = True, chars: int | None = S.LOG_CHARS):
    """Shape of a message; null when it has no tokens."""
    t = S.log_tokens(msg, chars)
    t = mask(t) if masked else t
    return F.when(F.size(t) > 0, F.array_join(t, " "))


def cluster(shape_rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(shape, n_tokens, freq, first_seen, last_seen, pattern).

    Groups are tried from the widest: equal token count, then also equal first token, first
    two, first four and so on up to the share that must agree, where a group agrees by
    itself. Every round summarises the shapes that are left by (token count, prefix, place),
    combined before they are shuffled, and keeps the groups that agree on ``threshold`` of
    their places. Rounds grow with the logarithm of the longest shape: nine for the 256 tokens
    that 512 characters hold at most.
    """
    # Groups and shapes go by hashes and tokens are compared by theirs, so that texts are neither repeated
    # for every place nor sorted to be summarised.
    left = shape_rows.select(digest(F.col("shape")).alias("key"), F.xxhash64("shape").alias("number"), "shape", "n_tokens")
    enough = F.ceil(F.col("n_tokens") * threshold)
    group = ["n_tokens", "prefix"]
    found = None
    for depth in (2 ** (i - 1) if i else 0 for i in count()):
        prefix = F.array_join(F.slice(F.split("shape", " "), 1, F.least(F.lit(depth), enough).cast("int")), " ")
        grouped = left.withColumn("prefix", digest(prefix))
        sizes = grouped.groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.min("number").alias("head"))
        # At first a group is a number of tokens, at most as many as the longest shape has.
        few = F.broadcast if depth == 0 else (lambda df: df)
        met = cut(grouped.join(few(sizes), group))
        # A shape that is alone agrees with itself on every place.
        alone = met.where("members = 1").select("key", F.lit(None).cast("string").alias("pattern"))
        several = met.where("members > 1")
        places = several.select(*group, F.posexplode(F.split("shape", " ")).alias("place", "token")).select(*group, "place", F.xxhash64("token").alias("h"))
        agreed = places.groupBy(*group, "place").agg((F.min("h") == F.max("h")).alias("same"))
        per = agreed.groupBy(*group).agg(F.count_if("same").alias("n_same"), F.array_sort(F.collect_list(F.struct("place", "same"))).alias("t"))
        head = several.where("number = head").select(*group, F.split("shape", " ").alias("own"))
        said = F.zip_with("own", "t", lambda token, x: F.when(x["same"], token).otherwise(F.lit(WILDCARD)))
        settled = cut(per.where(F.col("n_same") >= enough).join(head, group).select(*group, F.array_join(said, " ").alias("pattern")))
        done = cut(alone.unionByName(several.select("key", *group).join(settled, group).select("key", "pattern")))
        found = done if found is None else found.unionByName(done)
        left = cut(several.select("key", "number", "shape", *group).join(few(settled.select(*group)), group, "left_anti").select("key", "number", "shape", "n_tokens"))
        if left.isEmpty():
            break
    known = shape_rows.withColumn("key", digest(F.col("shape")))
    return known.join(found, "key").withColumn("pattern", F.coalesce("pattern", "shape")).select(
        "shape", "n_tokens", "freq", "first_seen", "last_seen", "pattern")


def digest(text):
    """A text's MD5 in 16 bytes."""
    return F.unhex(F.md5(text))


def merged(shape_rows: DataFrame) -> DataFrame:
    """Shape rows of several parts of a log as those of the whole: counts add up, times widen."""
    return shape_rows.groupBy("shape", "n_tokens").agg(
        F.sum("freq").alias("freq"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def catalogue(clustered: DataFrame) -> DataFrame:
    """(template_id, pattern, n_tokens, frequency, first_seen, last_seen).

    The id is derived from the pattern, so it needs no global numbering."""
    return (
        clustered.groupBy("pattern", "n_tokens")
        .agg(F.sum("freq").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        .withColumn("template_id", template_id(F.col("pattern")))
    )


def template_id(pattern):
    return F.substring(F.md5(pattern), 1, 12)


def top_templates(templates: DataFrame, limit: int = 50) -> DataFrame:
    return templates.orderBy(F.desc("frequency"), "pattern").limit(limit)


def parameters(pattern, tokens):
    """Tokens standing where the pattern has a wildcard."""
    held = F.zip_with(F.split(pattern, " "), tokens, lambda p, t: F.when(p == WILDCARD, t))
    return F.filter(held, lambda t: t.isNotNull())


def compression(templates: DataFrame) -> DataFrame:
    return templates.agg(
        F.count(F.lit(1)).alias("templates"), F.coalesce(F.sum("frequency"), F.lit(0)).alias("observations"),
    ).withColumn("ratio", F.round(F.col("observations") / F.greatest("templates", F.lit(1)), 4))


def assign(logs: DataFrame, clustered: DataFrame, masked: bool = True, chars: int | None = S.LOG_CHARS) -> DataFrame:
    """Add `template_id` and `pattern` to ``logs(event_id, msg, ...)``; ``masked`` and ``chars`` are those of the shapes."""
    look = clustered.select(digest(F.col("shape")).alias("_shape"), "pattern")
    return (
        logs.withColumn("_shape", digest(shape_of(F.col("msg"), masked, chars))).join(look, "_shape", "left")
        .withColumn("template_id", template_id(F.col("pattern"))).drop("_shape")
    )
