"""Merging change logs of replicas: cells, deletes, references, uniqueness, proofs.

A change row is (tbl, key, col, value, version, peer, deleted). The larger
(version, peer) wins, cell by cell; a delete removes the row unless a later
change writes to it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opsrecall.session import cut


def last_writer_rows(log: DataFrame) -> DataFrame:
    """Row-level merge, the weak baseline: the newest (version, peer) snapshot of a row
    replaces the whole row, so the columns it does not carry are lost."""
    snap = log.where("NOT deleted").groupBy("tbl", "key", "version", "peer").agg(
        F.map_from_entries(F.collect_set(F.struct("col", "value"))).alias("cells"))
    return snap.groupBy("tbl", "key").agg(F.max_by("cells", F.struct("version", "peer")).alias("cells"))


def merge_cells(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(tbl, key, col, value, version, peer): the newest value of every live cell, for every holder named by ``by``."""
    newest = F.max_by(F.struct("value", "version", "peer"), F.struct("version", "peer")).alias("w")
    cells = log.where("NOT deleted").groupBy(*by, "tbl", "key", "col").agg(newest)
    gone = tombstones(log, by)
    live = cells.join(gone, [*by, "tbl", "key"], "left").where("gone_at IS NULL OR struct(w.version, w.peer) > gone_at")
    return live.select(*by, "tbl", "key", "col", "w.value", "w.version", "w.peer")


def tombstones(log: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(tbl, key, gone_at): the newest delete of a row."""
    return log.where("deleted").groupBy(*by, "tbl", "key").agg(F.max(F.struct("version", "peer")).alias("gone_at"))


def live_keys(log: DataFrame) -> DataFrame:
    """Keys without a delete that is newer than every write to them."""
    newest = log.where("NOT deleted").groupBy("tbl", "key").agg(F.max(F.struct("version", "peer")).alias("at"))
    dead = newest.join(tombstones(log), ["tbl", "key"]).where("gone_at >= at").select("tbl", "key")
    return newest.select("tbl", "key").join(dead, ["tbl", "key"], "left_anti")


def as_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    """One row per key with the given columns."""
    return cells.groupBy("tbl", "key").pivot("col", columns).agg(F.first("value"))


def orphans(children: DataFrame, parents: DataFrame, ref: str = "user_id", key: str = "key") -> DataFrame:
    """Children whose parent is gone."""
    return children.join(parents.select(F.col(key).alias(ref)), ref, "left_anti")


def apply_policy(children: DataFrame, parents: DataFrame, policy: str, ref: str = "user_id", key: str = "key") -> DataFrame:
    """Children after `cascade` (dropped), `tombstone` (kept) or `orphan` (reference cleared)."""
    if policy == "cascade":
        return children.join(parents.select(F.col(key).alias(ref)), ref, "left_semi")
    if policy == "tombstone":
        return children
    if policy == "orphan":
        known = parents.select(F.col(key).alias("_k"), F.lit(True).alias("_known"))
        return children.join(known, F.col(ref) == F.col("_k"), "left").withColumn(ref, F.when(F.col("_known"), F.col(ref))).drop("_k", "_known")
    raise ValueError(f"unknown policy {policy!r}")


def policy_holds(children: DataFrame, parents: DataFrame, policy: str, watched: Column, ref: str = "user_id", key: str = "key") -> DataFrame:
    """(policy, ok): whether the watched children look as the policy says."""
    known = parents.select(F.col(key).alias("_k"), F.lit(True).alias("_known"))
    seen = children.where(watched).join(known, F.col(ref) == F.col("_k"), "left")
    ok = {"cascade": F.count(F.lit(1)) == 0,
          "tombstone": (F.count(F.lit(1)) > 0) & (F.count("_known") == 0),
          "orphan": (F.count(F.lit(1)) > 0) & (F.count(F.when(F.col(ref) != "__orphan__", 1)) == 0)}[policy]
    return seen.agg(ok.alias("ok")).withColumn("policy", F.lit(policy))


def duplicates(cells: DataFrame, col: str = "email") -> DataFrame:
    """(value, n): live values held by more than one key."""
    return cells.where((F.col("col") == col) & F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_winners(cells: DataFrame, col: str = "email") -> DataFrame:
    """(value, key): the oldest holder keeps the value, ties by peer and key. An
    aggregate, so that a value held by very many keys is reduced map-side."""
    return cells.where((F.col("col") == col) & F.col("value").isNotNull()).groupBy("value").agg(
        F.min(F.struct("version", "peer", "key")).alias("w")).select("value", F.col("w.key").alias("key"))


def repair_unique(cells: DataFrame, col: str = "email") -> DataFrame:
    """Cells where losers of a uniqueness conflict have the value cleared."""
    win = unique_winners(cells, col).select("key", F.lit(col).alias("col"), F.lit(True).alias("_won"))
    return cells.join(win, ["key", "col"], "left").withColumn(
        "value", F.when((F.col("col") != col) | F.col("_won"), F.col("value"))).drop("_won")


def _number(c: Column, start: int) -> Column:
    """Fifteen hex digits of a hash as an exact number that sums without overflow."""
    return F.conv(F.substring(c, start, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hash of a state (per ``by`` if given), independent of row order.

    Every cell is hashed and the hashes are summed, which combines map-side and
    gathers nothing, however many rows one state has.
    """
    by = by or []
    cell = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in ("tbl", "key", "col", "value")]), 256)
    sums = cells.select(*by, cell.alias("h")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_number(F.col("h"), 1)).alias("s1"), F.sum(_number(F.col("h"), 16)).alias("s2"))
    return sums.select(*by, F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "s1", "s2")])).alias("fingerprint"))


def converged(prints: DataFrame) -> DataFrame:
    """(n_states, converged) over one fingerprint per peer."""
    return prints.agg(F.countDistinct("fingerprint").alias("n_states")).withColumn("converged", F.col("n_states") == 1)


def version_vectors(held: DataFrame) -> DataFrame:
    """(holder, origin, seen): up to which version a holder has the changes of every peer."""
    return held.groupBy("holder", F.col("peer").alias("origin")).agg(F.max("version").alias("seen"))


def deltas(held: DataFrame, links: DataFrame) -> DataFrame:
    """Changes that holders lack and get over ``links(src, dst)``, under their new holder.

    ``held(holder, ...)`` are the changes every holder has; of each peer it has all up to a
    version, so a vector of versions says what is missing and only that is sent.
    """
    seen = version_vectors(held).toDF("dst", "peer", "seen")
    offered = held.join(F.broadcast(links.withColumnRenamed("src", "holder")), "holder")  # a row for each link
    missing = offered.join(F.broadcast(seen), ["dst", "peer"], "left").where("version > coalesce(seen, -1)")  # peers by peers
    return missing.select(F.col("dst").alias("holder"), *[c for c in held.columns if c != "holder"]).distinct()


def exchange(held: DataFrame, links: DataFrame) -> DataFrame:
    """What everybody holds once nobody lacks anything over its links. A round sends every missing
    change one link further, so rounds are at most as many as links in a row."""
    held = cut(held)
    while True:
        sent = cut(deltas(held, links))
        if sent.isEmpty():
            return held
        held = cut(held.unionByName(sent))


def shuffled(log: DataFrame, seed: int) -> DataFrame:
    """The same log in another order."""
    return log.orderBy(F.xxhash64(F.lit(seed), "tbl", "key", "col", "version", "peer"))


def order_invariance(log: DataFrame, seeds: list[int]) -> DataFrame:
    """(run, fingerprint): the merge of permuted logs and of a log applied twice."""
    runs = [("given", log), ("twice", log.unionByName(log)), *[(f"seed{s}", shuffled(log, s)) for s in seeds]]
    out = None
    for name, variant in runs:
        one = fingerprint(merge_cells(variant)).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("run", "fingerprint")
