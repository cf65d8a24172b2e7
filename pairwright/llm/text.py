"""Small helpers on texts and columns, used inside tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def utf8(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, which spares the tasks a decoding."""
    return F.col(column).cast("binary").alias(column)


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; bytes.split() cuts at exactly those six characters."""
    return text.split() if text else []


def fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def fold_of(value: int | None, folds: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % folds


SLICE = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_HELD: list[dict] = []
_LAST: list[str] = [""]


def tidy(kind: str) -> None:
    """At the start of a task: give back what earlier tasks of this worker left behind.

    Workers are used again by other operators, so caches kept for another ``kind`` are dropped, and freed memory
    goes back to the system instead of staying with an idle worker.
    """
    if _LAST[0] != kind:
        for held in _HELD:
            held.clear()
        _LAST[0] = kind
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def settle(kind: str) -> None:
    """``tidy`` for work on groups, of which a task has many: only when the worker comes from another kind of work."""
    if _LAST[0] != kind:
        tidy(kind)


def keep(held: dict) -> dict:
    """Register a worker-wide cache that ``tidy`` may clear."""
    _HELD.append(held)
    return held


class BoundedCache(dict):
    """A dict that starts over when it holds ``limit`` entries, so a worker's memory is bounded."""

    def __init__(self, limit: int) -> None:
        super().__init__()
        self.limit = limit

    def room(self, more: int = 1) -> None:
        if len(self) + more > self.limit:
            self.clear()


def map_rows(
    frame: DataFrame, columns: Sequence[str | Column], schema: StructType | str, work: Callable[[Iterator[dict]], Iterator[dict]]
) -> DataFrame:
    """``mapInArrow`` over the named columns, with batches given and taken as dicts of Python lists.

    Texts are long, so batches of the session are set to ``SLICE`` rows unless they are smaller already.
    """
    spark = frame.sparkSession
    spark.conf.set(BATCH_SETTING, str(min(SLICE, int(spark.conf.get(BATCH_SETTING)))))
    kind = work.__qualname__
    empty = frame.sparkSession.createDataFrame([], schema)
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in empty.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(kind)
        # slices keep few long texts in Python at a time
        slices = (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))
        for out in work(part.to_pydict() for part in slices):
            yield pa.RecordBatch.from_pydict(out, schema=target)

    return frame.select(*columns).mapInArrow(run, empty.schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
