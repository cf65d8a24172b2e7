"""Manifests as hash tries: one digest per package, and a comparison with a pinned trie that reads only what differs.

The rows of a package are leaves named by the hex digits of their digests. How many digits a leaf is named by follows from the row count, so a
leaf holds about ``LEAF_ROWS`` distinct rows at any size, and copies of a row are a count. A node's digest covers its children's, at most sixteen.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.operators.keyed import attach
from pairwright.session import Rounds, cut_lineage

LEAF_ROWS = 64


def entries(rows: DataFrame, package: Sequence[str], row_digest: Column) -> DataFrame:
    """``(package..., digest, n)``: the distinct rows of each package and how often they occur; null digests are no rows."""
    named = rows.select(*package, row_digest.alias("digest")).where("digest is not null")
    return named.groupBy(*package, "digest").agg(F.count(F.lit(1)).alias("n"))


def trie_depth(held: DataFrame, package: Sequence[str], leaf_rows: int = LEAF_ROWS) -> int:
    """Digits that name a leaf, from the rows of the largest package."""
    sizes = held.groupBy(*package).agg(F.count(F.lit(1)).alias("_rows"))
    largest = sizes.agg(F.max("_rows")).first()[0] or 0
    return max(0, ceil(log(max(largest, 1) / leaf_rows, 16)))


def trie(held: DataFrame, package: Sequence[str], depth: int) -> DataFrame:
    """``(package..., level, prefix, digest, n)``: every node from the roots (level 0, prefix empty) down to the leaves of ``entries``.

    Two tables with the same rows have the same trie, whatever the order and partitioning; null package keys are keys like others.
    """
    package = list(package)
    leaf = F.concat_ws(":", "digest", F.col("n").cast("string"))
    level = held.groupBy(*package, F.substring("digest", 1, depth).alias("prefix")).agg(
        sha256_hex(F.array_join(F.array_sort(F.collect_list(leaf)), "\n")).alias("digest"), F.sum("n").alias("n")
    )
    return _upwards(cut_lineage(level), package, depth)


def _upwards(level: DataFrame, package: list[str], depth: int) -> DataFrame:
    """Leaves ``(package..., prefix, digest, n)`` and every node above them."""
    out = level.select(*package, F.lit(depth).alias("level"), "prefix", "digest", "n")
    for digits in range(depth - 1, -1, -1):
        child = F.concat_ws(":", "prefix", "digest")
        level = level.groupBy(*package, F.substring("prefix", 1, digits).alias("prefix")).agg(
            sha256_hex(F.array_join(F.array_sort(F.collect_list(child)), "\n")).alias("digest"), F.sum("n").alias("n")
        )
        out = out.unionByName(level.select(*package, F.lit(digits).alias("level"), "prefix", "digest", "n"))
    return cut_lineage(out)


def differing_leaves(now: DataFrame, pin: DataFrame, package: Sequence[str]) -> DataFrame:
    """``(package..., prefix)`` of the leaves that two tries of one depth do not share, found by descent.

    Each level looks only at the children of nodes that differ, so equal packages and subtrees cost nothing below their root.
    """
    package = list(package)
    depth = max(now.agg(F.max("level")).first()[0] or 0, pin.agg(F.max("level")).first()[0] or 0)
    sides = now.withColumn("_side", F.lit("now")).unionByName(pin.withColumn("_side", F.lit("pin")))
    wrong = None
    for level in range(depth + 1):
        nodes = sides.where(F.col("level") == level)
        if wrong is not None:
            above = wrong.select(*package, F.col("prefix").alias("_above"))
            nodes = attach(nodes.withColumn("_above", F.substring("prefix", 1, level - 1)), above, [*package, "_above"], how="left_semi", spread=["prefix"])
        pairs = nodes.groupBy(*package, "prefix").agg(
            F.max(F.when(F.col("_side") == "now", F.col("digest"))).alias("_now"), F.max(F.when(F.col("_side") == "pin", F.col("digest"))).alias("_pin")
        )
        wrong = cut_lineage(pairs.where(~F.col("_now").eqNullSafe(F.col("_pin"))).select(*package, "prefix"))
        if wrong.isEmpty():
            break
    return wrong


def paired_entries(rows: DataFrame, pinned: DataFrame, package: Sequence[str], row_digest: Column) -> DataFrame:
    """``(package..., digest, n_now, n_pin)``: the distinct rows of both tables, counted together; digests are bytes, half as long as their hex digits."""
    package = list(package)

    def side(frame: DataFrame, now: int) -> DataFrame:
        named = frame.select(*package, row_digest.alias("digest")).where("digest is not null")
        digest = F.coalesce(F.unhex("digest"), F.raise_error(F.lit("row digests are hex digits")).cast("binary"))
        return named.select(*package, digest.alias("digest"), F.lit(now).cast("long").alias("n_now"), F.lit(1 - now).cast("long").alias("n_pin"))

    both = side(rows, 1).unionByName(side(pinned, 0))
    return both.groupBy(*package, "digest").agg(F.sum("n_now").alias("n_now"), F.sum("n_pin").alias("n_pin"))


def paired_tries(held: DataFrame, package: Sequence[str], depth: int) -> tuple[DataFrame, DataFrame]:
    """The tries of both sides of ``paired_entries``, node for node those of ``trie``; the rows are dealt to their leaves once for both."""
    package = list(package)
    names = ("n_now", "n_pin")
    prefix = F.lower(F.substring(F.hex("digest"), 1, depth))
    leaves = held.groupBy(*package, prefix.alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("digest", *names))).alias("_rows"), *[F.sum(n).alias(n) for n in names])

    def digest(n: str) -> Column:
        mine = F.transform(F.filter("_rows", lambda row: row[n] > 0), lambda row: F.concat_ws(":", F.lower(F.hex(row["digest"])), row[n].cast("string")))
        return sha256_hex(F.array_join(mine, "\n"))

    level = cut_lineage(leaves.select(*package, "prefix", *[F.when(F.col(n) > 0, F.struct(digest(n).alias("digest"), F.col(n).alias("n"))).alias(n) for n in names]))
    out = []
    for name in names:
        nodes = level.where(F.col(name).isNotNull()).select(*package, "prefix", f"{name}.digest", f"{name}.n")
        out.append(_upwards(nodes, package, depth))
    return out[0], out[1]


def changed_rows(held: DataFrame, leaves: DataFrame, package: Sequence[str], depth: int) -> DataFrame:
    """``(package..., digest, n_now, n_pin)`` of the rows of ``paired_entries`` that the sides hold differently, in the differing ``leaves``."""
    package = list(package)
    named = held.where("n_now <> n_pin").withColumn("digest", F.lower(F.hex("digest"))).withColumn("prefix", F.substring("digest", 1, depth))
    return attach(named, leaves, [*package, "prefix"], how="left_semi", spread=["digest"]).select(*package, "digest", "n_now", "n_pin")


def pinned_differences(rows: DataFrame, pinned: DataFrame, package: Sequence[str], row_digest: Column, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``(package..., digest, n_now, n_pin)``: the rows by which each package differs from its pin; nothing for packages that agree.

    ``row_digest`` is lower-case hex, two digits a byte.
    """
    rounds = Rounds(rows.sparkSession)
    held = rounds.keep(paired_entries(rows, pinned, package, row_digest), forget=False)
    depth = max(trie_depth(held.where(f"{n} > 0"), package, leaf_rows) for n in ("n_now", "n_pin"))
    leaves = differing_leaves(*paired_tries(held, package, depth), package)
    return rounds.close(changed_rows(held, leaves, package, depth))
