"""Document fingerprints: Merkle trees over paragraphs and sections.

A text is cut into paragraphs (sentences and lines, long ones at words chosen by their
hash) and paragraphs into sections that end where a paragraph's hash says so, so an edit
moves only the borders next to it. Equal roots mean equal texts; sections and then
paragraphs that differ locate what was edited.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.llm.common import partitions

PARAGRAPH = re.compile(r"[^\n.]*[\n.]+|[^\n.]+")
WORDS = re.compile(r"\S*\s+|\S+")
# Paragraphs longer than this are cut, at about every 16th word; about every 8th ends a section.
LONG = 400
DIGEST = 16
SHOWN = 8


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def paragraphs(text: str) -> Iterator[str]:
    for m in PARAGRAPH.finditer(text):
        p = m.group()
        if len(p) <= LONG:
            yield p
            continue
        start = 0
        for w in WORDS.finditer(p):
            if w.end() - start >= LONG or zlib.crc32(w.group().encode("utf-8", "surrogatepass")) % 16 == 0:
                yield p[start:w.end()]
                start = w.end()
        if start < len(p):
            yield p[start:]


@dataclass
class Tree:
    """Hashes of the paragraphs by section, of the sections, and of all."""

    sections: list[tuple[str, list[str]]]
    root: str

    @classmethod
    def of(cls, text: str) -> Tree:
        sections, leaves, above = [], [], hashlib.blake2b(digest_size=DIGEST)
        for p in paragraphs(text):
            leaves.append(_hash(p.encode("utf-8", "surrogatepass")))
            if leaves[-1][0] % 8 == 0:
                sections.append(leaves)
                leaves = []
        if leaves:
            sections.append(leaves)
        out = []
        for s in sections:
            h = _hash(b"".join(s))
            above.update(h)
            out.append((h.hex()[:SHOWN], [x.hex()[:SHOWN] for x in s]))
        return cls(out, above.hexdigest())

    def written(self) -> str:
        """root, then for every section its hash and, after a colon, those of its paragraphs."""
        return "/".join([self.root, *(f"{h}:{''.join(leaves)}" for h, leaves in self.sections)])

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        root, *sections = fingerprint.split("/")
        pairs = (s.split(":") for s in sections)
        return cls([(h, [x[i:i + SHOWN] for i in range(0, len(x), SHOWN)]) for h, x in pairs], root)

    def differing(self, other: Tree) -> tuple[list[str], list[str]]:
        """Paragraphs of self and of other that the other lacks, repeats counted; equal sections are not opened."""
        if self.root == other.root:
            return [], []
        shared = Counter(h for h, _ in self.sections) & Counter(h for h, _ in other.sections)

        def rest(tree: Tree) -> Counter:
            left, out = Counter(shared), Counter()
            for h, leaves in tree.sections:
                if left[h]:
                    left[h] -= 1
                else:
                    out.update(leaves)
            return out

        a, b = rest(self), rest(other)
        return list((a - b).elements()), list((b - a).elements())

    def likeness(self, other: Tree) -> float:
        """Shared paragraphs of all, from 0 to 1; two empty texts are alike."""
        n = sum(len(x) for _, x in self.sections) + sum(len(x) for _, x in other.sections)
        a, b = self.differing(other)
        return 1.0 if not n else 1.0 - (len(a) + len(b)) / n


def likeness(a: str, b: str) -> float:
    return Tree.read(a).likeness(Tree.read(b))


def with_next(docs: DataFrame, schema: str, step, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows of ``step(id, text, next text)`` for every row, by descending id; the last is followed by the first.

    Ids are dealt to partitions by quantiles, so only texts are shuffled, once; the first
    row of a partition is sent to the one before as well. Ties are ordered by text, null
    ids come last, null texts are empty. The driver sees one id for each partition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    n = partitions(spark)
    quantiles = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
    splits = [float("-inf"), *sorted({float(q) for q in quantiles or [0]}), float("inf")]
    last = len(splits)

    def dealt(df: DataFrame) -> DataFrame:
        bucket = Bucketizer(splits=splits, inputCol="x", outputCol="bucket").transform(df.withColumn("x", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
        part = F.when(F.col("id").isNull(), F.lit(last)).otherwise(last - 1 - F.col("bucket"))
        return bucket.withColumn("part", part.cast("int")).drop("x", "bucket")

    heads = sorted((r.part, r.id) for r in dealt(rows.select("id")).groupBy("part").agg(F.max("id").alias("id")).collect())
    ahead = [(heads[(i + 1) % len(heads)][1], part) for i, (part, _) in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(ahead, "head long, to int"))  # a row for each partition
    one, two = F.struct(F.col("part"), F.lit(0).alias("ahead")), F.struct(F.col("to").alias("part"), F.lit(1).alias("ahead"))
    sent = dealt(rows).join(to, F.col("id").eqNullSafe(F.col("head")), "left")
    sent = sent.select("id", "text", F.explode(F.when(F.col("to").isNull(), F.array(one)).otherwise(F.array(one, two))).alias("s"))
    laid = sent.select("id", "text", "s.part", "s.ahead").repartition(n, "part").sortWithinPartitions("part", "ahead", F.col("id").desc_nulls_last(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[2] == row[2]:
                    out.append(step(held[0], held[1], row[1]))
                held = None if row[3] else row
            cols = list(zip(*out, strict=True))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    arrow = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")])
    return laid.mapInArrow(run, schema)


def fingerprints(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; null is empty, all rows and columns stay."""
    @F.pandas_udf("string")
    def written(texts):
        return texts.map(lambda t: Tree.of(t or "").written())

    return docs.withColumn("fingerprint", written(F.coalesce(F.col(text_column), F.lit(""))))


def edited_likeness(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every text against an edited copy and against the next text, by fingerprints.

    The edit replaces the last third by the first code points of the next text, ids
    descending. Repeated rows follow each other; a single row is its own next; an empty
    table gives no rows; other columns are not read.
    """
    trees: dict[str, Tree] = {}

    def tree(text: str) -> Tree:
        if text not in trees:
            while len(trees) > 1:
                trees.pop(next(iter(trees)))
            trees[text] = Tree.of(text)
        return trees[text]

    def step(doc, text, following):
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        changed = Tree.of(edited)
        after = tree(following)
        own = tree(text) if text != following else after
        return (doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.written(), changed.written(), own.likeness(changed), own.likeness(after))

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, schema, step, id_column, text_column)
