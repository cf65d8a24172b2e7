"""Dictionary-encoded parallel arrays: string table + equal-length index arrays + sparse index columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.binding import let


def encode(values: Column) -> Column:
    """``{strings, indexes}`` of an array of strings: string table and zero-based index array."""

    def indexed(strings: Column) -> Column:
        positions = F.map_from_arrays(strings, F.sequence(F.lit(0), F.size(strings) - 1))
        indexes = let(positions, lambda lookup: F.transform(values, lambda v: F.element_at(lookup, v)))
        return F.struct(strings.alias("strings"), indexes.alias("indexes"))

    return let(F.array_distinct(values), indexed)


def decode(
    documents: DataFrame, keys: Sequence[str], strings: str, columns: Sequence[str], sparse: Sequence[str] = ()
) -> DataFrame:
    """``(keys..., ordinal, <column> decoded..., <sparse> flag...)``: one row per array position.

    Index -1 decodes to null; a sparse column lists the positions where its flag holds.
    """
    def rows_of(table: Column) -> Column:
        def row(index: Column, at: Column) -> Column:
            values = [
                F.when(index[c] >= 0, F.try_element_at(table, index[c] + 1)).alias(c) for c in columns
            ]
            flags = [F.array_contains(F.col(s), at).alias(s) for s in sparse]
            return F.struct(at.cast("long").alias("ordinal"), *values, *flags)

        return F.transform(F.arrays_zip(*columns), row)

    # decoded before the explode, so the string table is not copied to every row
    decoded = documents.select(*keys, F.explode(let(F.col(strings), rows_of)).alias("_row"))
    return decoded.select(*keys, "_row.*")
