"""Removal of byte strings that occur more than once, by column-wise construction over many segments.

A string of ``LENGTH`` bytes that also starts anywhere else is a repeat, and every byte inside a repeat is removed.

A Burrows-Wheeler transform over whole documents takes one round per byte of the longest document, each rewriting all that
is there. So documents are first cut into segments in which repeats line up, and the columns are built over these:

1. Anchors. Every ``LENGTH``-byte window is given to one of its ``SEED``-byte seeds, the one of lowest hash (the last of
   equals). The choice depends on the window's bytes alone, so equal windows have the same seed at the same place. A seed
   with its windows is a segment, at most 2 LENGTH - SEED bytes. Seeds are counted over all documents as packed
   arrays of hashes; segments whose seed occurs once hold no repeat and go no further.
2. Whole segments that occur twice (equal 128-bit hashes) repeat in full. Of each such segment one copy
   stays, to be compared with the segments that differ.
3. Columns. All remaining segments of a task are aligned at their seeds and grow by one symbol per segment and round. Each round
   updates the order of the segments by their reversed prefixes (the collection's positional transform: a stable sort by the
   new symbol) and the common suffix with the neighbour before (the largest divergence over the neighbours between). A
   window is a repeat where that common part with either neighbour covers it.
4. The repeats of a text become byte intervals and are cut out.

Equal texts are handled once; a text of at least LENGTH bytes that two rows hold is removed whole. Null and empty texts
keep nothing. Ids play no part, so null and repeated ids are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairwright.llm.registry import query
from pairwright.llm.text import SLICE, map_rows, settle, tidy
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

LENGTH = 200
SEED = 50
TASK_SEEDS = 150_000
BUCKET_SEEDS = 100_000
SEGMENTS = 10_000
CHUNK = 1 << 21

_RNG = np.random.default_rng(20)
_SYMBOLS = [_RNG.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1) for _ in range(2)]
_BASES = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)]


class RollingHash:
    """Hashes of any window of some bytes: prefix sums of a polynomial modulo 2^64, mixed.

    Windows are shorter than the 2,048 bytes from which two strings with equal sums can be written down.
    """

    def __init__(self, data: np.ndarray, which: int) -> None:
        base = _BASES[which]
        powers = np.cumprod(np.full(len(data), base, "u8"))
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(_SYMBOLS[which][data] * powers, out=self.sums[1:])
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.shift = np.cumprod(np.r_[np.uint64(1), np.full(len(data), inverse, "u8")])

    def windows(self, start, end) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.shift[start]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return out


def segments_of(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> dict[str, np.ndarray]:
    """Seeds of one text: ``pos``, first and last window start ``lo`` and ``hi``, seed hash and two segment hashes."""
    parts = []
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        parts.append(_segments(data[at : at + CHUNK + length - 1], at, length, seed))
    names = ("pos", "lo", "hi", "seed", "first", "second")
    return {name: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, "i8" if i < 3 else "u8") for i, name in enumerate(names)}


def _segments(data: np.ndarray, base: int, length: int, seed: int):
    hashes = RollingHash(data, 0)
    seeds = np.arange(len(data) - seed + 1)
    values = hashes.windows(seeds, seeds + seed)
    wide = length - seed + 1
    count = len(data) - length + 1
    low = np.uint64((1 << 22) - 1)
    keys = np.full(-(-len(values) // wide) * wide, ~np.uint64(0), "u8")
    keys[: len(values)] = (values & ~low) | (low - seeds.astype("u8"))  # of equal hashes the last is lowest
    rows = keys.reshape(-1, wide)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:count], before[wide - 1 : wide - 1 + count])
    place = (low - (least & low)).astype("i8")
    lo = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    hi = np.r_[lo[1:], count] - 1
    pos = place[lo]
    other = RollingHash(data, 1)
    # the segment hash also tells where the seed lies in it
    shape = ((pos - lo) * 65536 + (hi - lo)).astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F)
    first = hashes.windows(lo, hi + length) ^ shape
    return pos + base, lo + base, hi + base, values[pos], first, other.windows(lo, hi + length) ^ shape


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")


def seed_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of seeds. A seed is the lowest hash around, so most hashes are low: they are mixed first."""
    return _bucket(hashes * np.uint64(0xC2B2AE3D27D4EB4F), buckets)


def repeated_seeds(texts: DataFrame) -> DataFrame:
    """``key, rows``: per text the segments to look at, as packed ``PLACE`` rows.

    Kind 1: the whole segment repeats. Kind 2: it does too, and it stands for its like in the comparison. Kind 0: to be compared.
    """
    spark = texts.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    # there are about three seeds to every four seed lengths
    buckets = int(max(width, total // (SEED * BUCKET_SEEDS) + 1))
    row = np.dtype([("seed", "u8"), ("first", "u8"), ("second", "u8"), ("key", "S16"), ("pos", "i8"), ("lo", "i4"), ("hi", "i4")])

    def scan(batches: Iterator[dict]) -> Iterator[dict]:
        parts, held, seen = [], 0, set()
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                if len(text or b"") < LENGTH or key in seen:
                    continue
                seen.add(key)
                found = segments_of(np.frombuffer(text, "u1"))
                out = np.zeros(len(found["pos"]), row)
                for name in ("seed", "first", "second", "pos"):
                    out[name] = found[name]
                out["lo"], out["hi"], out["key"] = found["pos"] - found["lo"], found["hi"] - found["lo"], key
                parts.append(out)
                held += len(out)
            if held > TASK_SEEDS:
                yield send(parts)
                parts, held, seen = [], 0, set()
        if parts:
            yield send(parts)

    def send(parts: list[np.ndarray]) -> dict:
        rows = np.concatenate(parts)
        place = seed_bucket(rows["seed"], buckets)
        rows = rows[np.argsort(place, kind="stable")]
        cuts = np.searchsorted(np.sort(place), np.arange(buckets + 1))
        used = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        return {"bucket": used, "rows": [rows[cuts[b] : cuts[b + 1]].tobytes() for b in used]}

    def meet(table: pa.Table) -> pa.Table:
        settle("repeated_seeds")
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), row)
        rows = rows[np.lexsort((rows["pos"], rows["key"], rows["second"], rows["first"], rows["seed"]))]
        alike = np.r_[False, (rows["seed"][1:] == rows["seed"][:-1]) & (rows["first"][1:] == rows["first"][:-1]) & (rows["second"][1:] == rows["second"][:-1])]
        again = np.r_[False, (rows["key"][1:] == rows["key"][:-1]) & (rows["pos"][1:] == rows["pos"][:-1])] & alike
        rows, lead = rows[~again], ~alike[~again]
        starts = np.r_[True, rows["seed"][1:] != rows["seed"][:-1]]
        seed, kind = np.cumsum(starts) - 1, np.cumsum(lead) - 1
        per_seed, per_kind, kinds_of_seed = np.bincount(seed), np.bincount(kind), np.bincount(seed[lead])
        whole = per_kind[kind] > 1
        verdict = np.where(whole, np.where(lead & (kinds_of_seed[seed] > 1), 2, 1), 0)
        shared = per_seed[seed] > 1
        out = np.empty(shared.sum(), PLACE)
        for name in ("key", "pos", "lo", "hi"):
            out[name] = rows[name][shared]
        out["kind"] = verdict[shared]
        return _dealt(out, buckets)

    sent = map_rows(texts, ["key", "text"], "bucket int, rows binary", scan)
    return _by_key(sent.groupBy("bucket").applyInArrow(meet, "part int, rows binary"), PLACE)


#: A segment to look at: its text, seed position, first and last window start around it, and kind.
PLACE = np.dtype([("key", "S16"), ("pos", "i8"), ("lo", "i4"), ("hi", "i4"), ("kind", "i4")])
#: Window starts, from first to last, that repeat.
SPAN = np.dtype([("key", "S16"), ("first", "i8"), ("last", "i8")])


def _dealt(rows: np.ndarray, parts: int) -> pa.Table:
    """Rows packed by a range of their keys."""
    part = _bucket(np.ascontiguousarray(rows["key"]).view("u8").reshape(-1, 2)[:, 0], parts) if len(rows) else np.zeros(0, "i8")
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(rows) else part
    ends = np.r_[at[1:], len(rows)] if len(rows) else at
    packed = [rows[lo:hi].tobytes() for lo, hi in zip(at, ends, strict=True)]
    return pa.table({"part": pa.array(part[at], pa.int32()), "rows": pa.array(packed, pa.binary())})


def _by_key(dealt: DataFrame, kind: np.dtype) -> DataFrame:
    """``key, rows``: one row per key with its packed rows."""

    def run(table: pa.Table) -> pa.Table:
        settle("by_key")
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), kind)
        words = np.ascontiguousarray(rows["key"]).view("u8").reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0]))
        rows, words = rows[order], words[order]
        at = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(axis=1)])
        keys = np.ascontiguousarray(words[at]).tobytes()
        offsets = (np.r_[at, len(rows)] * kind.itemsize).astype("i4")
        wide = (np.arange(len(at) + 1) * 16).astype("i4")
        arrays = [
            pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(body)])
            for cuts, body in ((wide, keys), (offsets, rows.tobytes()))
        ]
        return pa.table(arrays, names=["key", "rows"])

    return dealt.groupBy("part").applyInArrow(run, "key binary, rows binary")


def aligned(flat: np.ndarray, sizes: np.ndarray, shifts: np.ndarray, order: np.ndarray, wide: int) -> np.ndarray:
    """Segments, one after the other in ``flat``, as rows in the given order, each moved right by its shift; -1 where there is none.

    ``SLICE`` rows at a time: the numbers that place a byte take many times the room of the byte.
    """
    out = np.full((len(sizes), wide), -1, "i2")
    starts = np.cumsum(sizes) - sizes
    for at in range(0, len(order), SLICE):
        some = order[at : at + SLICE]
        inside = np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        rows = np.repeat(np.arange(at, at + len(some)), sizes[some])
        out[rows, np.repeat(shifts[some], sizes[some]) + inside] = flat[np.repeat(starts[some], sizes[some]) + inside]
    return out


def column_repeats(segments: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Segments as rows of symbols aligned in columns (-1: none), rows of a group adjacent: which windows of ``length`` columns
    ending at each column occur in another row of the group."""
    count, columns = segments.shape
    out = np.zeros((count, columns), bool)
    order = np.arange(count)
    fresh = np.r_[True, groups[1:] != groups[:-1]]
    diverge = np.zeros(count, "i4")  # first column of the part that a row shares with the row before it
    diverge[fresh] = columns + 1
    of = groups.astype("i8") << 10
    for column in range(columns):
        symbols = segments[order, column].astype("i8")
        keys = of[order] | (symbols + 1)
        step = np.argsort(keys, kind="stable")
        sorted_keys = keys[step]
        match = np.r_[False, sorted_keys[1:] == sorted_keys[:-1]] & (symbols[step] >= 0)
        new = np.full(count, column + 1, "i4")
        near = np.flatnonzero(match)
        if len(near):
            to, start = step[near], step[near - 1] + 1
            single = start == to
            new[near[single]] = diverge[to[single]]
            if not single.all():
                far = ~single
                bounds = np.column_stack([start[far], to[far] + 1]).ravel()
                padded = np.r_[diverge, 0]
                new[near[far]] = np.maximum.reduceat(padded, bounds)[::2]
        order, diverge = order[step], new
        if column >= length - 1:
            shared = (diverge <= column - length + 1) & match
            out[order, column] = shared | np.r_[shared[1:], False]
    return out


def repeats(texts: DataFrame, looked_at: DataFrame) -> DataFrame:
    """``key, spans``: the repeats of segments that do not repeat as a whole, packed per text."""
    spark = texts.sparkSession
    sizes = looked_at.agg(F.sum(F.octet_length("places") / PLACE.itemsize)).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), sizes // SEGMENTS + 1))
    left = LENGTH - SEED
    wide = left + LENGTH
    body = np.dtype([("seed", "u8"), ("key", "S16"), ("pos", "i8"), ("lo", "i4"), ("hi", "i4")])

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            held: dict[int, tuple[list[bytes], list[bytes]]] = {}
            for key, text, places in zip(batch["key"], batch["text"], batch["places"], strict=True):
                place = np.frombuffer(places, PLACE)
                place = place[place["kind"] != 1]
                if not len(place):
                    continue
                rows = np.zeros(len(place), body)
                rows["pos"], rows["lo"], rows["hi"], rows["key"] = place["pos"], place["lo"], place["hi"], key
                data = np.frombuffer(text, "u1")
                rows["seed"] = _seed_hashes(data[place["pos"][:, None] + np.arange(SEED)])
                starts = place["pos"] - place["lo"]
                for bucket, row, start, end in zip(_bucket(rows["seed"], buckets).tolist(), rows, starts.tolist(), (starts + place["hi"] + LENGTH).tolist(), strict=True):
                    mine = held.setdefault(bucket, ([], []))
                    mine[0].append(row.tobytes())
                    mine[1].append(text[start:end])
            yield {"bucket": list(held), "rows": [b"".join(r) for r, _ in held.values()], "bytes": [b"".join(t) for _, t in held.values()]}

    def compare(table: pa.Table) -> pa.Table:
        settle("compare_segments")
        rows = np.frombuffer(b"".join(table["rows"].to_pylist()), body)
        flat = np.frombuffer(b"".join(table["bytes"].to_pylist()), "u1")
        sizes = rows["hi"].astype("i8") + LENGTH
        order = np.argsort(rows["seed"], kind="stable")
        matrix = aligned(flat, sizes, left - rows["lo"].astype("i8"), order, wide)
        rows = rows[order]
        groups = np.cumsum(np.r_[False, rows["seed"][1:] != rows["seed"][:-1]])
        found = column_repeats(matrix, groups, LENGTH)
        # window starts of a row: its repeats as runs of columns
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype("i1"), axis=1)
        row, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        base = rows["pos"][row] - left - LENGTH + 1
        out = np.empty(len(row), SPAN)
        out["key"], out["first"], out["last"] = rows["key"][row], base + first, base + last
        return _dealt(out, buckets)

    joined = texts.select("key", "text").join(looked_at, "key")
    sent = map_rows(joined, ["key", "text", "places"], "bucket int, rows binary, bytes binary", cut)
    met = sent.groupBy("bucket").applyInArrow(compare, "part int, rows binary")
    return _by_key(met, SPAN).withColumnRenamed("rows", "spans")


def _seed_hashes(seeds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(seeds), "u8")
    for column in range(seeds.shape[1]):
        out = out * _BASES[0] + _SYMBOLS[0][seeds[:, column]]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


def removed_spans(first: list[int], last: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte intervals covered by windows that start from ``first`` to ``last``."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(zip(first, last, strict=True)):
        if spans and lo <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], hi + length)
        else:
            spans.append((lo, hi + length))
    return spans


def dedup_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``key, n_removed, n_spans, kept``: one row per distinct text; ``key`` is the md5 of its bytes."""
    rows = documents.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("key"), F.col(text).cast("binary").alias("text")).where("text is not null")
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    looked_at = cut_lineage(repeated_seeds(sized).withColumnRenamed("rows", "places"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    joined = texts.join(looked_at, "key", "left").join(repeats(texts, looked_at), "key", "left")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {"key": batch["key"], "n_removed": [], "n_spans": [], "kept": []}
            for data, n, places, spans in zip(batch["text"], batch["n"], batch["places"], batch["spans"], strict=True):
                if n > 1 and len(data) >= LENGTH:
                    cuts = [(0, len(data))]
                else:
                    place, span = np.frombuffer(places or b"", PLACE), np.frombuffer(spans or b"", SPAN)
                    place = place[place["kind"] > 0]
                    start = place["pos"] - place["lo"]
                    cuts = removed_spans(np.r_[start, span["first"]].tolist(), np.r_[start + place["hi"], span["last"]].tolist())
                ends = [0, *[hi for _, hi in cuts]]
                starts = [*[lo for lo, _ in cuts], len(data)]
                out["n_removed"].append(sum(hi - lo for lo, hi in cuts))
                out["n_spans"].append(len(cuts))
                out["kept"].append(b"".join([data[a:b] for a, b in zip(ends, starts, strict=True)]))
            yield out

    return map_rows(joined, ["key", "text", "n", "places", "spans"], "key binary, n_removed long, n_spans long, kept binary", run)


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents with all repeats cut out of ``text``; ``n_chars``, where there, follows the text.

    A character that a cut leaves incomplete goes with it. Null texts stay null.
    """
    found = dedup_texts(documents).select(F.col("key").alias("__key"), F.col("kept").alias("__kept"))
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    keyed = documents.withColumn("__key", key).drop("text")
    joined = attach(keyed, found, ["__key"], how="left", spread=["doc_id"], hot_from=documents.select(key.alias("__key")))
    texts = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy("without_repeats")
        for batch in batches:
            kept = [value if value is None else value.decode("utf-8", "ignore") for value in batch.column("__kept").to_pylist()]
            at = batch.schema.get_field_index("__kept")
            yield batch.set_column(at, "__text", pa.array(kept, pa.string()))

    kept = joined.drop("__key")
    schema = StructType([StructField("__text", StringType()) if field.name == "__kept" else field for field in kept.schema])
    whole = kept.mapInArrow(run, schema)
    return whole.select(*[texts[c].alias(c) if c in texts else F.col(c) for c in documents.columns])


EMPTY = hashlib.sha256(b"").hexdigest()


def dedup_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    found = dedup_texts(documents).select("key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    rows = documents.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("n_bytes"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    joined = attach(rows, cut_lineage(found), ["key"], how="left", spread=["doc_id"])
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", F.lit(EMPTY)).alias("kept_sha256"),
    )


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_documents(table(spark, folder, "documents"))
