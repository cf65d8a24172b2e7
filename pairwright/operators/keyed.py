"""Joins, group values and ordered windows that hold up when one key owns a third of the rows.

Three shapes cover the whole library:

* ``attach``         an equi-join to a one-row-per-key side, hot keys salted;
* ``over_groups``    a group value on every row: aggregate first (map-side combine), then attach;
* ``blocked_window`` positions, running sums and previous values: a group is cut into blocks along
  its order, windows run inside a block, and one small row per block carries the total forward.

``tally_sides`` replaces full outer joins: both sides are counted per key in one aggregation,
so duplicated keys never multiply.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 1 / 256
SKETCH_KEYS = 512
SKETCH_WIDTH = 8192
SPLITS_PER_PARTITION = 2

_SALT = "_salt"
_BLOCK = "_block"
_SIDE = "_side_"


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(key) for key in keys])


def _hot_hashes(rows: DataFrame, keys: Sequence[str]) -> Column:
    """Hashes of the keys holding more than HOT_SHARE of the rows, as one scalar array.

    A frequent-items sketch is merged per task, so no shuffle of the keys is needed. The array
    has at most 1 / HOT_SHARE entries whatever the input size, and a hash collision only salts
    one more key.
    """
    sketch = (
        "transform(filter(approx_top_k(_h, {keys}, {width}), x -> x.count > {share} * count(1)), x -> x.item)"
    ).format(keys=SKETCH_KEYS, width=SKETCH_WIDTH, share=HOT_SHARE)
    hashes = rows.select(_key_hash(keys).alias("_h"))
    return hashes.agg(F.coalesce(F.expr(sketch), F.array().cast("array<bigint>")).alias("_hot")).scalar()


def _counted_hot_hashes(groups: DataFrame, keys: Sequence[str], size: str) -> Column:
    """The same from exact group sizes: no more than 1 / HOT_SHARE groups pass the filter."""
    total = groups.agg(F.sum(size)).scalar()
    large = groups.where(F.col(size) > HOT_SHARE * total)
    return large.agg(F.coalesce(F.collect_list(_key_hash(keys)), F.array().cast("array<bigint>"))).scalar()


def large_keys(groups: DataFrame, keys: Sequence[str], size: str, total: int) -> Column:
    """``hot`` for ``attach`` from known group sizes and the number of rows: no more than 1 / HOT_SHARE keys pass."""
    large = groups.where(F.col(size) > HOT_SHARE * total)
    return large.agg(F.coalesce(F.collect_list(_key_hash(keys)), F.array().cast("array<bigint>"))).scalar()


def _aligned(frame: DataFrame, types: Mapping) -> DataFrame:
    differing = {key: F.col(key).cast(kind) for key, kind in types.items() if frame.schema[key].dataType != kind}
    return frame.withColumns(differing) if differing else frame


def null_safe_join(rows: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` in which null equals null; the keys come from ``rows``."""
    renamed = side.withColumnsRenamed({key: f"{_SIDE}{key}" for key in keys})
    on = [F.col(key).eqNullSafe(F.col(f"{_SIDE}{key}")) for key in keys]
    joined = rows.join(renamed, on, how)
    return joined.select(*keys, *[c for c in joined.columns if c not in keys and not c.startswith(_SIDE)])


def salts(frame: DataFrame) -> int:
    """Into how many parts a hot key is split: twice the shuffle partitions, so that even a third of all rows spreads over every task."""
    return SPLITS_PER_PARTITION * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def attach(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    hot_from: DataFrame | None = None,
    hot: Column | None = None,
) -> DataFrame:
    """Join ``rows`` to ``side``, which has at most one row per key; a null key meets a null key.

    Rows of a hot key are spread over ``salts`` values hashed from ``spread``; only the hot rows of
    ``side`` are repeated, so the repeated part is bounded by salts / HOT_SHARE rows. The hot keys are
    ``hot`` when given, else sketched from ``hot_from``: a cheaper table with the same key columns, for rows
    that are costly to make twice.
    """
    keys = list(keys)
    types = {key: rows.schema[key].dataType for key in keys}
    # equal keys must hash alike on every side, so differing integer widths are aligned first
    side = _aligned(side, types)
    if hot is None:
        hot = _hot_hashes(rows if hot_from is None else _aligned(hot_from, types), keys)
    is_hot = F.array_contains(hot, _key_hash(keys))
    parts = salts(rows)
    spread_by = [F.col(name) for name in (spread or [c for c in rows.columns if c not in keys])]
    salt = F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(parts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    salted = rows.withColumn(_SALT, salt)
    repeated = side.withColumn(_SALT, F.explode(copies))
    return null_safe_join(salted, repeated, [*keys, _SALT], how).drop(_SALT)


def over_groups(
    rows: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str] | None = None,
    how: str = "inner",
    **values: Column,
) -> DataFrame:
    """Add aggregate ``values`` of each key group, null keys included, to every row of the group.

    The aggregate counts its groups, so hot keys are known without reading the rows again.
    """
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *[value.alias(name) for name, value in values.items()])
    hot = _counted_hot_hashes(groups, keys, "_size")
    return attach(rows, groups.drop("_size"), keys, how=how, spread=spread, hot=hot)


def blocked_window(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    *,
    position: str | None = None,
    running: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    highest: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Ordered window values without holding a whole key group in one task.

    ``block`` must not decrease along ``order`` inside a group. ``position`` is zero-based,
    ``running`` sums include the current row, ``previous`` is the value one row earlier, ``highest`` the largest
    value of all earlier rows (null when there is none). Null keys and null blocks are values like any other. ``block`` None means one block per group, for groups bounded by a closed vocabulary.
    """
    running = dict(running or {})
    previous = dict(previous or {})
    highest = dict(highest or {})
    keys = list(keys)
    if block is None:
        return _whole_window(rows, keys, order, position, running, previous, highest)
    cut = [*keys, _BLOCK]
    rows = rows.withColumn(_BLOCK, block)
    inside = Window.partitionBy(*cut).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    totals = [F.count(F.lit(1)).alias("_n")]
    totals += [F.sum(value).alias(f"_sum_{name}") for name, value in running.items()]
    totals += [F.max(value).alias(f"_max_{name}") for name, value in highest.items()]
    if previous:
        last = F.struct(*[value.alias(name) for name, value in previous.items()])
        totals.append(F.max_by(last, F.struct(*order)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK)
    before_sum = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum("_n").over(before_sum), F.lit(0)).alias("_base")]
    carried += [F.coalesce(F.sum(f"_sum_{n}").over(before_sum), F.lit(0)).alias(f"_base_{n}") for n in running]
    carried += [F.max(f"_max_{n}").over(before_sum).alias(f"_top_{n}") for n in highest]
    if previous:
        carried.append(F.lag("_last").over(before).alias("_prior"))
    carry = rows.groupBy(*cut).agg(*totals).select(*cut, *carried)

    local = {}
    if position:
        local["_pos"] = F.row_number().over(inside)
    for name, value in running.items():
        local[f"_run_{name}"] = F.sum(value).over(upto)
    for name, value in highest.items():
        local[f"_high_{name}"] = F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    for name, value in previous.items():
        local[f"_lag_{name}"] = F.lag(F.struct(value.alias("v"))).over(inside)
    joined = null_safe_join(rows.withColumns(local), carry, cut)

    out = {}
    if position:
        out[position] = (F.col("_base") + F.col("_pos") - 1).cast("long")
    for name in running:
        out[name] = (F.col(f"_base_{name}") + F.col(f"_run_{name}")).cast("long")
    for name in highest:
        out[name] = F.greatest(f"_high_{name}", f"_top_{name}")
    for name in previous:
        within = F.col(f"_lag_{name}")
        out[name] = F.when(within.isNotNull(), within["v"]).otherwise(F.col("_prior")[name])
    kept = [c for c in rows.columns if c != _BLOCK and c not in out]
    return joined.select(*kept, *[value.alias(name) for name, value in out.items()])


def _whole_window(rows, keys, order, position, running, previous, highest) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {} if position is None else {position: (F.row_number().over(window) - 1).cast("long")}
    out.update({name: F.sum(value).over(upto).cast("long") for name, value in running.items()})
    out.update({name: F.lag(value).over(window) for name, value in previous.items()})
    out.update({name: F.max(value).over(window.rowsBetween(Window.unboundedPreceding, -1)) for name, value in highest.items()})
    return rows.withColumns(out)


def tally_sides(keys: Sequence[str], **sides: DataFrame) -> DataFrame:
    """Rows per key on each side, as ``n_<side>``: the shuffle-once form of a full outer join."""
    names = list(sides)
    marked = [
        frame.select(*keys, *[F.lit(1 if name == other else 0).cast("long").alias(f"n_{other}") for other in names])
        for name, frame in sides.items()
    ]
    merged = marked[0]
    for frame in marked[1:]:
        merged = merged.unionByName(frame)
    return merged.groupBy(*keys).agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in names])


def merge_sides(keys: Sequence[str], values: Sequence[str], left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per key with structs ``l`` and ``r`` (null when absent) and how many rows each side has.

    Of repeated keys the largest row is shown; ``n_l`` and ``n_r`` tell that there are more.
    """

    def side(frame: DataFrame, mine: str, other: str) -> DataFrame:
        body = F.struct(*values)
        return frame.select(*keys, body.alias(mine)).withColumn(other, F.lit(None).cast(_struct_type(frame, values)))

    both = side(left, "l", "r").unionByName(side(right, "r", "l"))
    sides = [F.max("l").alias("l"), F.max("r").alias("r"), F.count("l").alias("n_l"), F.count("r").alias("n_r")]
    return both.groupBy(*keys).agg(*sides)


def _struct_type(frame: DataFrame, values: Sequence[str]):
    return frame.select(F.struct(*values).alias("s")).schema["s"].dataType
