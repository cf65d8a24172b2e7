"""Binding checks between two records of one identity, and the exact-membership family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.operators.keyed import attach, merge_sides, over_groups, tally_sides
from pairwright.operators.rules import violations


def membership(keys: Sequence[str], expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Two-way membership: keys on one side only, and keys repeated on the actual side."""
    counts = tally_sides(keys, expected=expected, actual=actual)
    return violations(
        counts,
        keys,
        {
            "membership.missing": F.col("n_actual") == 0,
            "membership.unexpected": F.col("n_expected") == 0,
            "membership.duplicate": F.col("n_actual") > 1,
        },
    )


def set_difference(keys: Sequence[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Set comparison with the side each key belongs to."""
    counts = tally_sides(keys, left=left, right=right)
    side = F.when(F.col("n_right") == 0, "left_only").when(F.col("n_left") == 0, "right_only").otherwise("both")
    return counts.select(*keys, side.alias("side"))


def dangling(rows: DataFrame, keys: Sequence[str], targets: DataFrame, spread: Sequence[str]) -> DataFrame:
    """Rows whose key names no target row."""
    return attach(rows, targets.select(*keys).distinct(), keys, how="left_anti", spread=spread)


def field_differences(
    keys: Sequence[str], left: DataFrame, right: DataFrame, fields: Sequence[str]
) -> DataFrame:
    """Long form ``(keys..., field, left_value, right_value)`` of null-safe field differences.

    Keys are unique on both sides.
    """
    pairs = left.select(*keys, *[F.col(f).alias(f"l_{i}") for i, f in enumerate(fields)]).join(
        right.select(*keys, *[F.col(f).alias(f"r_{i}") for i, f in enumerate(fields)]), list(keys)
    )
    entries = [
        F.when(
            ~F.col(f"l_{i}").eqNullSafe(F.col(f"r_{i}")),
            F.struct(
                F.lit(field).alias("field"),
                F.col(f"l_{i}").cast("string").alias("left_value"),
                F.col(f"r_{i}").cast("string").alias("right_value"),
            ),
        )
        for i, field in enumerate(fields)
    ]
    return pairs.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(*keys, "d.*")


def facet_equality(keys: Sequence[str], before: DataFrame, after: DataFrame, facets: Sequence[str]) -> DataFrame:
    """One boolean per facet for every key present in both snapshots."""
    old = before.select(*keys, *[F.col(f).alias(f"_{f}") for f in facets])
    return old.join(after, list(keys)).select(
        *keys, *[F.col(f"_{f}").eqNullSafe(F.col(f)).alias(f"{f}_equal") for f in facets]
    )


def first_mismatch(
    keys: Sequence[str], left: DataFrame, right: DataFrame, fields: Sequence[str], order: str
) -> DataFrame:
    """Only the first differing row in key order, as a reader that stops early reports it.

    A row that one side lacks differs too: its field is empty and the value of the side that has it is ``present``. Equal sides
    give no row.
    """
    both = merge_sides(keys, fields, left, right)
    absent = F.lit(None).cast("string")
    row = F.when(F.col("l").isNull() | F.col("r").isNull(), F.struct(
        F.lit("").alias("field"),
        F.when(F.col("l").isNotNull(), F.lit("present")).alias("left_value"),
        F.when(F.col("r").isNotNull(), F.lit("present")).alias("right_value"),
    ))
    cells = [
        F.when(
            F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col(f"l.{field}").eqNullSafe(F.col(f"r.{field}")),
            F.struct(
                F.lit(field).alias("field"),
                F.coalesce(F.col(f"l.{field}").cast("string"), absent).alias("left_value"),
                F.coalesce(F.col(f"r.{field}").cast("string"), absent).alias("right_value"),
            ),
        )
        for field in fields
    ]
    differing = both.select(*keys, F.explode(F.array_compact(F.array(row, *cells))).alias("d")).select(*keys, "d.*")
    ranked = F.struct(order, "field")
    found = differing.agg(F.min_by(F.struct(*keys, "field", "left_value", "right_value"), ranked).alias("m"))
    return found.where("m is not null").select("m.*")


def pair_binding(
    visible: DataFrame,
    sealed: DataFrame,
    keys: Sequence[str],
    bound: Mapping[str, tuple[Column, Column]],
    sealed_only: Mapping[str, Column] | None = None,
    artifacts: tuple[DataFrame, DataFrame, str] | None = None,
) -> DataFrame:
    """``(keys..., code)``: do the visible and the sealed record of one key belong together?

    Each record is compared by the ``bound`` pairs of columns (code: visible, sealed), which must be equal, null with null. A record without
    its other half breaks ``pair.evidence_id`` and nothing else; of repeated records the largest is compared. ``sealed_only`` are
    conditions that break a code on the sealed side alone. ``artifacts`` are the references of both sides, ``(keys..., digest)``, and
    the name of the digest: one that both sides hold breaks ``pair.cas_overlap``.
    """
    keys = list(keys)
    sealed_only = dict(sealed_only or {})
    names = [f"_{k}" for k in range(len(bound))]
    broken = [f"_broken_{k}" for k in range(len(sealed_only))]
    fine = F.lit(False)
    left = visible.select(*keys, *[a.cast("string").alias(n) for n, (a, _) in zip(names, bound.values(), strict=True)], *[fine.alias(n) for n in broken])
    right = sealed.select(
        *keys, *[b.cast("string").alias(n) for n, (_, b) in zip(names, bound.values(), strict=True)],
        *[F.coalesce(rule, fine).alias(n) for n, rule in zip(broken, sealed_only.values(), strict=True)],
    )
    both = merge_sides(keys, [*names, *broken], left, right)
    paired = F.col("l").isNotNull() & F.col("r").isNotNull()
    rules = {"pair.evidence_id": ~paired}
    rules |= {code: paired & ~F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for code, n in zip(bound, names, strict=True)}
    rules |= {code: paired & F.col(f"r.{n}") for code, n in zip(sealed_only, broken, strict=True)}
    found = violations(both, keys, rules)
    if artifacts is None:
        return found
    ours, theirs, digest = artifacts
    held = tally_sides([*keys, digest], visible=ours.where(F.col(digest).isNotNull()), sealed=theirs.where(F.col(digest).isNotNull()))
    overlap = held.where("n_visible > 0 and n_sealed > 0").select(*keys).distinct()
    return found.unionByName(overlap.withColumn("code", F.lit("pair.cas_overlap")))


def replay_differences(derived: DataFrame, stored: DataFrame, keys: Sequence[str], body: Column) -> DataFrame:
    """Recompute and compare: canonical digests of a derived and a stored report per key."""
    left = derived.select(*keys, sha256_hex(body).alias("digest"))
    right = stored.select(*keys, sha256_hex(body).alias("digest"))
    both = merge_sides(keys, ["digest"], left, right)
    return violations(
        both,
        keys,
        {
            "replay.missing": F.col("r").isNull(),
            "replay.unexpected": F.col("l").isNull(),
            "replay.digest": F.col("l") != F.col("r"),
        },
    )


def ordinal_conformance(
    keys: Sequence[str], expected: DataFrame, actual: DataFrame, values: Sequence[str]
) -> DataFrame:
    """Catalogue or vector conformance: same positions, same values, nothing missing, extra or repeated."""
    both = merge_sides(keys, values, expected, actual)
    return violations(
        both,
        keys,
        {
            "conformance.missing": F.col("r").isNull(),
            "conformance.unexpected": F.col("l").isNull(),
            "conformance.value": F.col("l") != F.col("r"),
            "conformance.duplicate": (F.col("n_l") > 1) | (F.col("n_r") > 1),
        },
    )


def checkpoint_alignment(
    checkpoints: DataFrame, record: str, role: str, ordinal: str, identity: str, baseline: str, candidate: str
) -> DataFrame:
    """Two ordered checkpoint lists of one record: same count, same identity at each ordinal.

    A slot that one role lacks has no identity there and is reported. ``(record, ordinal, code)``; the count violation uses ordinal -1. One aggregation per shape, no
    join: both roles of an ordinal meet in the same group.
    """

    def held(name: str) -> Column:
        return F.max(F.when(F.col(role) == name, F.col(identity)))

    slots = checkpoints.groupBy(record, ordinal).agg(held(baseline).alias("_b"), held(candidate).alias("_c"))
    identities = violations(slots, [record, ordinal], {"checkpoint.identity": ~F.col("_b").eqNullSafe(F.col("_c"))})
    counts = checkpoints.groupBy(record).agg(
        F.count_if(F.col(role) == baseline).alias("_b"), F.count_if(F.col(role) == candidate).alias("_c")
    )
    uneven = violations(
        counts.withColumn(ordinal, F.lit(-1).cast("long")),
        [record, ordinal],
        {"checkpoint.count": F.col("_b") != F.col("_c")},
    )
    return identities.unionByName(uneven)


def link_cardinality(
    snapshots: DataFrame, nodes: DataFrame, key: str, is_target: Column, is_linked: Column, has_role: Column
) -> DataFrame:
    """Exactly one target node per snapshot, exactly one linked node, and that node has the role."""
    marks = nodes.select(
        key,
        is_target.cast("long").alias("_t"),
        (is_target & is_linked).cast("long").alias("_k"),
        (is_target & is_linked & ~has_role).cast("long").alias("_w"),
    )
    zero = F.lit(0).cast("long")
    every = snapshots.select(key, zero.alias("_t"), zero.alias("_k"), zero.alias("_w"))
    counts = every.unionByName(marks).groupBy(key).agg(F.sum("_t").alias("_t"), F.sum("_k").alias("_k"), F.sum("_w").alias("_w"))
    return violations(
        counts,
        [key],
        {"link.target_count": F.col("_t") != 1, "link.linked_count": F.col("_k") != 1, "link.role": F.col("_w") > 0},
    )


def reused_keys(
    rows: DataFrame, key: str, slot: str, order: str, allowed: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Rows whose key was first used under another slot, minus the allowed (first, later) aliases.

    Attributes each reuse to the first owner, so a group of n rows gives n - 1 rows and not pairs.
    """
    owned = over_groups(rows, [key], spread=[order], first_slot=F.min_by(slot, order))
    reused = owned.where(F.col(slot) != F.col("first_slot"))
    for first, later in allowed:
        reused = reused.where(~((F.col("first_slot") == first) & (F.col(slot) == later)))
    return reused
