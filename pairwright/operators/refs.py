"""Artifact references: exploding manifests, deduplication, budgets and ordered digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.operators.keyed import attach, tally_sides


def explode_references(
    manifests: DataFrame, keys: Sequence[str], single: Mapping[str, Column], repeated: Mapping[str, Column]
) -> DataFrame:
    """Nested manifests to ``(keys..., slot, ordinal, ref fields)``; null references are dropped.

    ``single`` slots hold one reference struct, ``repeated`` slots an array of them. One explode,
    no shuffle.
    """

    def entry(slot: str, ordinal: Column, ref: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), ordinal.cast("long").alias("ordinal"), ref.alias("ref"))

    def entries_of(slot: str, refs: Column) -> Column:
        return F.transform(refs, lambda ref, i: entry(slot, i, ref))

    parts = [F.array(*[entry(slot, F.lit(0), ref) for slot, ref in single.items()])]
    parts += [entries_of(slot, refs) for slot, refs in repeated.items()]
    entries = F.explode(F.concat(*parts)).alias("e")
    return (
        manifests.select(*keys, entries)
        .where("e.ref is not null")
        .select(*keys, "e.slot", "e.ordinal", "e.ref.*")
    )


def first_metadata(refs: DataFrame, scope: Sequence[str], ordinal: str) -> DataFrame:
    """First-seen metadata per digest in a scope: the metadata that wins."""
    meta = F.struct("byte_length", "media_type", "format_version")
    return refs.groupBy(*scope, "sha256").agg(F.min_by(meta, F.col(ordinal)).alias("first"))


def metadata_conflicts(refs: DataFrame, scope: Sequence[str], ordinal: str) -> DataFrame:
    """References whose metadata differs from the first-seen metadata of the same digest."""
    first = first_metadata(refs, scope, ordinal)
    joined = attach(refs, first, [*scope, "sha256"], spread=[ordinal])
    same = F.col("first") == F.struct("byte_length", "media_type", "format_version")
    return joined.where(~same).drop("first")


def unique_bytes(refs: DataFrame, scope: Sequence[str], ordinal: str) -> DataFrame:
    """Bytes per scope with every digest counted once at its first-seen length."""
    first = first_metadata(refs, scope, ordinal)
    return first.groupBy(*scope).agg(
        F.count(F.lit(1)).alias("n_digests"), F.sum("first.byte_length").alias("unique_bytes")
    )


def duplicate_keys(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Keys that occur more than once, with their first owner."""
    return (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(order).alias("first_owner"))
        .where("n_rows > 1")
    )


def shared_digests(left: DataFrame, right: DataFrame, digest: str = "sha256") -> DataFrame:
    """Digests present in two stores that must stay apart."""
    return tally_sides([digest], left=left, right=right).where("n_left > 0 and n_right > 0")


def ranked_digests(refs: DataFrame, digest: str, owner: Column) -> DataFrame:
    """Total order of a release: distinct digests with their zero-based rank.

    Digests are uniform, so their first 16 bits cut the order into even blocks; only one count per
    block meets in a single task.
    """
    unique = refs.groupBy(digest).agg(F.min(owner).alias("first_owner"))
    blocks = unique.withColumn("_block", F.substring(F.col(digest), 1, 4))
    sizes = blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy(digest)
    ranked = blocks.withColumn("_pos", F.row_number().over(inside)).join(bases, "_block")
    return ranked.select(digest, "first_owner", (F.col("_base") + F.col("_pos") - 1).cast("long").alias("rank"))


def manifest_digests(rows: DataFrame, package: Sequence[str], row_digest: Column, chunk_hex: int = 4) -> DataFrame:
    """One order-independent digest per package over its rows.

    Rows are sorted by digest inside chunks named by the digest's leading hex digits, chunks are
    digested, and the package digest covers its sorted chunk digests: no list ever holds a whole
    package.
    """
    leaves = rows.select(*package, row_digest.alias("_d")).withColumn("_chunk", F.substring("_d", 1, chunk_hex))
    chunks = leaves.groupBy(*package, "_chunk").agg(
        sha256_hex(F.array_join(F.array_sort(F.collect_list("_d")), "\n")).alias("_cd"),
        F.count(F.lit(1)).alias("_n"),
    )
    return chunks.groupBy(*package).agg(
        sha256_hex(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_cd"))), lambda c: c["_cd"]), "\n"
            )
        ).alias("manifest_sha256"),
        F.sum("_n").alias("n_rows"),
    )


def table_digest(rows: DataFrame, row_text: Column) -> DataFrame:
    """Row-order invariant digest of a table: row count, sum and exclusive or of two 60-bit halves of the rows' hashes."""
    digest = F.md5(row_text)
    front = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    back = F.conv(F.substring(digest, 16, 15), 16, 10).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(front.cast("decimal(38,0)")).cast("string").alias("digest_sum"),
        F.bit_xor(back).alias("digest_xor"),
    )


def same_tables(runs: Mapping[str, DataFrame], row_text: Column) -> DataFrame:
    """``(run, n_rows, equal)``: each run's table digest against the first run's."""
    parts = [table_digest(rows, row_text).withColumn("run", F.lit(name)) for name, rows in runs.items()]
    first = parts[0].select(F.struct("n_rows", "digest_sum", "digest_xor").alias("d")).scalar()
    every = reduce(DataFrame.unionByName, parts)
    return every.select("run", "n_rows", F.struct("n_rows", "digest_sum", "digest_xor").eqNullSafe(first).alias("equal"))
