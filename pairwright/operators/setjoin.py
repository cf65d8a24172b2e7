"""Pairs of sets at or over a similarity threshold, from a prefix index.

Sets are rows ``(space, owner, token...)``. Equal sets collapse to their smallest owner first. Tokens are ordered rare ones first; two sets at or over
the threshold share a token among the first n - ceil(t n) + 1 of each, so only those rows are indexed. Sizes and the positions of the shared token
bound what two sets can still have in common; what passes is verified exactly. Boilerplate stands at the end of every set's order, outside
the index, so sets that share only boilerplate never meet, and no pair is made that is only to be thrown away for its
size. Tokens of a single owner are counted but never joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window, large_keys, null_safe_join, over_groups
from pairwright.session import Rounds

PPM = 1_000_000
PART_ROWS = 1 << 16
LONG_SHARE = 1 << 52


def similar_sets(rows: DataFrame, space: str, owner: str, token: Sequence[str], threshold: Column) -> DataFrame:
    """``(space, left, right, n_left, n_right, n_both, jaccard_ppm)`` of the pairs whose Jaccard similarity is at least ``threshold`` ppm.

    ``rows`` are distinct; ``token`` columns are longs, the first well mixed; ``threshold`` may depend on ``space`` and is over 0. ``left`` is the smaller owner. Of equal
    sets the smallest owner stands for all: each further one is paired with it alone. Null spaces and owners are values like
    others; sets without rows do not exist.
    """
    token = list(token)
    rounds = Rounds(rows.sparkSession)
    rows = rounds.keep(rows.select(space, owner, *token))
    mixed = F.xxhash64(*token)
    sets = rows.groupBy(space, owner).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), *token)).alias("_y")
    )
    classes = rounds.keep(over_groups(sets, [space, "n", "_x", "_y"], spread=[owner], _first=F.min(owner)), forget=False)
    alike = classes.where(~F.col(owner).eqNullSafe(F.col("_first")))
    copies = alike.select(space, F.col("_first").alias("left"), F.col(owner).alias("right"), F.col("n").alias("n_left"), F.col("n").alias("n_right"), F.col("n").alias("n_both"))

    # tokens of one owner leave first: they are most rows, and only their number matters
    common = rounds.keep(rows.groupBy(space, *token).agg(F.count(F.lit(1)).alias("_df")).where("_df > 1"), forget=False)
    total = rows.count()
    mine = attach(rows, common, [space, *token], spread=[owner], hot=large_keys(common, [space, *token], "_df", total))
    firsts = classes.where(F.col(owner).eqNullSafe(F.col("_first"))).select(space, owner, "n")
    mine = attach(mine, firsts, [space, owner], spread=token, hot=large_keys(classes, [space, owner], "n", total))
    held = rounds.keep(mine.withColumn("_rarity", F.floor(F.log2("_df")).cast("int")).drop("_df"), forget=False)

    # they come first in every order; the others follow by rarity
    counted = over_groups(held, [space, owner], spread=token, _m=F.count(F.lit(1)))
    part = F.when(F.col("_m") > PART_ROWS, F.expr(f"{token[0]} div {LONG_SHARE}")).otherwise(0)
    placed = blocked_window(counted, [space, owner], ["_rarity", *token], F.struct("_rarity", part.alias("_part")), position="_p")
    at = F.col("n") - F.col("_m") + F.col("_p")
    least = F.ceil(F.col("n") * threshold / PPM)
    index = rounds.keep(placed.select(space, *token, owner, "n", at.alias("_at")).where(F.col("_at") <= F.col("n") - least), forget=False)

    on = [space, *token]
    left = index.select(*on, F.col(owner).alias("left"), F.col("n").alias("n_left"), F.col("_at").alias("_l"))
    right = index.select(*on, F.col(owner).alias("right"), F.col("n").alias("n_right"), F.col("_at").alias("_r"))
    # what the two can share: this token and what follows it in the shorter rest, if it is the first they share
    rest = F.least(F.col("n_left") - F.col("_l"), F.col("n_right") - F.col("_r"))
    needed = F.ceil((F.col("n_left") + F.col("n_right")) * threshold / (PPM + threshold))
    sized = F.least("n_left", "n_right") * PPM >= F.greatest("n_left", "n_right") * threshold
    met = null_safe_join(left, right, on).where("left < right").where(sized)
    first = met.groupBy(space, "left", "right", "n_left", "n_right").agg(F.max(rest).alias("_rest"))
    pairs = rounds.keep(first.where(F.col("_rest") >= needed).drop("_rest"), forget=False)

    lefts = null_safe_join(pairs, held.select(space, F.col(owner).alias("left"), *token), [space, "left"])
    both = null_safe_join(lefts, held.select(space, F.col(owner).alias("right"), *token), [space, "right", *token], "left_semi")
    shared = both.groupBy(space, "left", "right", "n_left", "n_right").agg(F.count(F.lit(1)).alias("n_both"))
    union = F.col("n_left") + F.col("n_right") - F.col("n_both")
    found = shared.where(F.col("n_both") * PPM >= union * threshold).unionByName(copies)
    return rounds.close(found.withColumn("jaccard_ppm", F.expr(f"n_both * {PPM} div (n_left + n_right - n_both)")))
