"""Prefix trie of conversations in double arrays, one per range of prefixes.

Every conversation c is rebuilt: the first h turns of conversation c - c % 100, then c's own turns after its first h, h = crc32(c) % 6. A node
is a distinct sequence of first turns; rebuilt conversations that start with it are its members.

Turns travel as 16-byte digests of (role, text), so texts are read once and never shuffled. Equal rebuilt conversations are one sequence
with a count, aggregated on the map side. Sequences are dealt by range over their digests, which is the order of prefixes: a shard is a
run of neighbouring prefixes, however hot a prefix is. A shard numbers its turns densely, packs its trie into BASE and CHECK arrays and
walks each sequence through them; counts gather at the nodes' slots. Only nodes on the path to a shard's first or last sequence can lie in
two shards. Their partial rows are summed over all shards, and every boundary between two shards corrects what both have counted
(shared nodes, shared children, a leaf that goes on in the next shard). The members that end at a node are hashed in order by
streaming packed pieces of the sorted ids, so a group of copies of any size needs one buffer.

Turns are ordered by turn number, null first, then by the digest of role and text, so ties and repeated rows (each a turn) have one
order. Null role or text is empty. Rows without conv_id belong to no conversation. A conversation whose turns all fall away is a member of the
root alone. An empty table has no root and gives no rows. Texts may be of any length; one conversation's digests must fit into a task.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

GROUP = 100
LONGEST_HEAD = 6
DIGEST = 16
SHARD_TURNS = 500_000
PIECE_IDS = 1_024
TRIES = 64

NOTHING = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved")
NODE = "key binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends string, parent_conv_id long, open boolean, above boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the ordered turns of each conversation as (digest, code points)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)), 1, DIGEST)
    turn = F.struct(F.col("turn"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, key, path, chars``: the digests of the rebuilt conversation in one binary, and their digest as its key."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = turns.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, LONGEST_HEAD).alias("head"))
    own = turns.select("conv_id", "turns", base.alias("base"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(LONGEST_HEAD)).cast("int").alias("h"))
    # a base has at most GROUP conversations (twice that around zero), so its key is never hot
    joined = own.join(heads, "base", "left")
    kept = F.concat(
        F.coalesce(F.filter("head", lambda t, at: at < F.col("h")), F.array().cast(turns.schema["turns"].dataType)),
        F.filter("turns", lambda t, at: at >= F.col("h")),
    )
    rows = joined.select("conv_id", kept.alias("kept"))
    # hex keeps every byte in a string that array_join can make in one pass
    path = F.unhex(F.array_join(F.transform("kept", lambda t: F.hex(t["digest"])), ""))
    rows = rows.select("conv_id", path.alias("path"), F.transform("kept", lambda t: t["chars"]).alias("chars"))
    return rows.select("conv_id", F.substring(F.unhex(F.sha2("path", 256)), 1, DIGEST).alias("key"), "path", "chars")


def ends_of(members: DataFrame) -> DataFrame:
    """``key, ends, n, first``: SHA-256 of the sorted, comma-joined ids of each key, their number and the smallest."""
    ids = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys, values = [], batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            for at, key in enumerate(keys):
                if not out or out[-1][0] != key or len(out[-1][1]) == PIECE_IDS:
                    out.append((key, []))
                out[-1][1].append(values[at])
            rows = [(key, mine[0], len(mine), ",".join(map(str, mine))) for key, mine in out]
            yield pa.RecordBatch.from_pylist([dict(zip(("key", "first", "n", "piece"), row, strict=True)) for row in rows], schema=pieces_schema)

    pieces_schema = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("piece", pa.string())])
    pieces = ids.mapInArrow(pack, "key binary, first long, n long, piece string")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, n, state = None, 0, 0, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    if key is not None:
                        out.append((key, state.hexdigest(), n, first))
                    key, first, n, state = row["key"], row["first"], 0, hashlib.sha256()
                state.update((b"," if n else b"") + row["piece"].encode())
                n += row["n"]
            yield _rows(out, ends_schema)
        yield _rows([] if key is None else [(key, state.hexdigest(), n, first)], ends_schema)

    ends_schema = pa.schema([("key", pa.binary()), ("ends", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
    dealt = pieces.repartition("key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(chain, "key binary, ends string, n long, first long")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(c), field.type) for c, field in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


class DoubleArray:
    """A trie in two arrays: the child of slot s over turn id c is BASE[s] + c if CHECK there is s. The root is slot 0.

    Nodes with several children are placed first, where all of them fit within ``TRIES`` places from the first free one, else behind
    the end; then single children fill the holes from the left.
    """

    def __init__(self, children: list[list[int]], nodes: list[list[int]]) -> None:
        """``children[n]`` are the turn ids below node n and ``nodes[n]`` the nodes they lead to; node 0 is the root."""
        self.base, self.check = [0], [-1]
        self.slot = [0] * len(children)
        self._low = 1
        wide = sorted((n for n in range(len(children)) if len(children[n]) > 1), key=lambda n: -len(children[n]))
        starts = {n: self._fit(sorted(children[n])) for n in wide}
        # parents come before children in preorder, so slots of single children can follow their parents'
        for n, (ids, below) in enumerate(zip(children, nodes, strict=True)):
            if not ids:
                continue
            start = starts[n] if n in starts else self._hole() - ids[0]
            self.base[self.slot[n]] = start
            for c, child in zip(ids, below, strict=True):
                self._grow(start + c)
                self.check[start + c] = self.slot[n]
                self.slot[child] = start + c

    def _grow(self, slot: int) -> None:
        more = slot + 1 - len(self.check)
        if more > 0:
            self.base += [0] * more
            self.check += [-1] * more

    def _hole(self) -> int:
        while self._low < len(self.check) and self.check[self._low] != -1:
            self._low += 1
        self._grow(self._low)
        return self._low

    def _fit(self, ids: list[int]) -> int:
        low, size = self._hole(), len(self.check)

        def fits(start: int) -> bool:
            return all(start + c >= size or self.check[start + c] == -1 for c in ids)

        free = next((at for at in range(low, min(low + TRIES, size)) if fits(at - ids[0])), size)
        start = free - ids[0]
        self._grow(start + ids[-1])
        for c in ids:
            # taken, until the owner's slot is known
            self.check[start + c] = -2
        return start

    def child(self, slot: int, turn: int) -> int:
        """The slot below ``slot`` over ``turn``, or -1."""
        at = self.base[slot] + turn
        return at if 0 < at < len(self.check) and self.check[at] == slot else -1


class Shard:
    """The trie of one run of sorted distinct sequences."""

    def __init__(self, rows: list[dict]) -> None:
        rows.sort(key=lambda row: row["path"])
        self.paths = [self._cut(row["path"]) for row in rows]
        self.rows = rows
        turns: dict[bytes, int] = {}
        for path in self.paths:
            for digest in path:
                turns.setdefault(digest, len(turns))
        self.turns = turns
        self.parent, self.depth, self.chars, self.key = [-1], [0], [0], [hashlib.sha256()]
        children: list[list[int]] = [[]]
        nodes: list[list[int]] = [[]]
        stack, last = [0], []
        for row, path in zip(rows, self.paths, strict=True):
            shared = common(last, path)
            del stack[shared + 1 :]
            for at in range(shared, len(path)):
                n = len(self.parent)
                state = self.key[stack[-1]].copy()
                state.update(path[at])
                self.parent.append(stack[-1])
                self.depth.append(at + 1)
                self.chars.append(row["chars"][at])
                self.key.append(state)
                children[stack[-1]].append(turns[path[at]])
                nodes[stack[-1]].append(n)
                children.append([])
                nodes.append([])
                stack.append(n)
            last = path
        self.children = children
        self.array = DoubleArray(children, nodes)

    @staticmethod
    def _cut(path: bytes) -> list[bytes]:
        return [path[at : at + DIGEST] for at in range(0, len(path), DIGEST)]

    def node_rows(self) -> list[tuple]:
        """One row per node, in the order of ``NODE``; counts gather at the slots each sequence walks through."""
        array, size = self.array, len(self.array.check)
        members, least, ends = [0] * size, [None] * size, {}
        for row, path in zip(self.rows, self.paths, strict=True):
            slot = 0
            for turn in [None, *[self.turns[digest] for digest in path]]:
                slot = slot if turn is None else array.child(slot, turn)
                members[slot] += row["n"]
                least[slot] = row["first"] if least[slot] is None else min(least[slot], row["first"])
            ends[slot] = row["ends"]
        count = len(self.parent)
        leaves, saved = [0] * count, [0] * count
        for n in range(count - 1, -1, -1):
            slot = array.slot[n]
            leaves[n] += not self.children[n]
            saved[n] += (members[slot] - 1) * self.chars[n]
            if n:
                leaves[self.parent[n]] += leaves[n]
                saved[self.parent[n]] += saved[n]
        rim = {0}
        for path in (self.paths[0], self.paths[-1]):
            slot = 0
            for digest in path:
                slot = array.child(slot, self.turns[digest])
                rim.add(slot)
        keys = [state.digest()[:DIGEST] for state in self.key]
        out = []
        for n in range(count):
            slot, up = array.slot[n], self.parent[n]
            out.append(
                (
                    keys[n], keys[up] if n else None, self.depth[n], least[slot], members[slot], len(self.children[n]), leaves[n], saved[n],
                    ends.get(slot), least[array.slot[up]] if n else None, slot in rim, n > 0 and array.slot[up] in rim,
                )
            )
        return out


def common(left: list, right: list) -> int:
    """Length of the common start."""
    n = min(len(left), len(right))
    return next((at for at in range(n) if left[at] != right[at]), n)


_NODE_SCHEMA = pa.schema(
    [("key", pa.binary()), ("parent", pa.binary())]
    + [(name, pa.int64()) for name in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved")]
    + [("ends", pa.string()), ("parent_conv_id", pa.int64()), ("open", pa.bool_()), ("above", pa.bool_())]
)


def shard_nodes(sequences: DataFrame) -> DataFrame:
    """All nodes of every partition of sorted ``sequences``, those that other shards may share marked ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if rows:
            found = Shard(rows).node_rows()
            for at in range(0, len(found), 10_000):
                yield _rows(found[at : at + 10_000], _NODE_SCHEMA)

    return sequences.select("path", "chars", "n", "first", "ends").mapInArrow(run, NODE)


def boundary_corrections(sequences: DataFrame) -> DataFrame:
    """What neighbouring shards have both counted, as negative counts per shared node."""
    ends_schema = pa.schema([("shard", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("chars", pa.list_(pa.int32()))])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, chars = None, None, []
        for batch in batches:
            for path, mine in zip(batch.column("path").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                low = path if low is None else min(low, path)
                if high is None or path >= high:
                    high, chars = path, mine
        if low is not None:
            yield _rows([(TaskContext.get().partitionId(), low, high, chars)], ends_schema)

    shards = cut_lineage(sequences.select("path", "chars").mapInArrow(ends, "shard long, low binary, high binary, chars array<int>"))
    # the numbers of the shards that hold rows: as many as tasks, not as documents
    held = sorted(row["shard"] for row in shards.select("shard").collect())
    spark = sequences.sparkSession
    following = spark.createDataFrame(list(zip(held, held[1:], strict=False)), "shard long, next long")
    nexts = shards.select(F.col("shard").alias("next"), F.col("low").alias("after"))
    pairs = shards.select("shard", "high", "chars").join(following, "shard").join(nexts, "next")
    schema = pa.schema([("key", pa.binary())] + [(name, pa.int64()) for name in COUNTS[1:]])

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = Shard._cut(row["high"]), Shard._cut(row["after"])
                shared = common(left, right)
                state, keys = hashlib.sha256(), []
                for at in range(shared + 1):
                    if at:
                        state.update(left[at - 1])
                    keys.append(state.copy().digest()[:DIGEST])
                # the path's node counts (members - 1) twice, once a shard, so its text is owed once more
                owed = [0, *row["chars"][:shared]]
                owed = np.cumsum(owed[::-1])[::-1].tolist()
                goes_on = shared == len(left)
                yield _rows([(keys[at], -int(at < shared), -int(goes_on), owed[at]) for at in range(shared + 1)], schema)

    return pairs.select("high", "after", "chars").mapInArrow(correct, "key binary, n_children long, n_leaves long, saved long")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    members = cut_lineage(rebuilt(turns_of(conversations)))
    distinct = members.groupBy("key").agg(F.first("path").alias("path"), F.first("chars").alias("chars"))
    sequences = distinct.join(ends_of(members), "key").drop("key")
    turns = distinct.agg(F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-turns // shard_turns))
    sequences = cut_lineage(sequences.repartitionByRange(shards, "path"))
    nodes = cut_lineage(shard_nodes(sequences))
    partial = nodes.where("open").select("key", "parent", "depth", "conv_id", *COUNTS, "ends")
    corrections = boundary_corrections(sequences).select(
        "key", F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("n_convs"), *COUNTS[1:], F.lit(None).cast("string").alias("ends"),
    )
    sums = [F.sum(name).alias(name) for name in COUNTS]
    whole = partial.unionByName(corrections).groupBy("key").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends")
    )
    upper = cut_lineage(whole)
    parents = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["depth", "conv_id", *COUNTS, "ends", "parent_conv_id"]
    inner = nodes.where("not open and not above").select(*columns)
    below = nodes.where("not open and above").select("parent", "depth", "conv_id", *COUNTS, "ends").unionByName(upper.drop("key"))
    rows = inner.unionByName(attach(below, parents, ["parent"], how="left", spread=["depth", "conv_id"]).select(*columns))
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


OP13_SQL = """
with turns as (
  select conv_id, length(coalesce(text, '')) as chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] as digest,
    row_number() over (partition by conv_id order by turn nulls first,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32]) as p
  from conversations where conv_id is not null
), convs as (
  select conv_id, xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint,
    list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, s: xor(x >> 1, (x & 1) * 3988292384)))) % 6 as h
  from (select distinct conv_id from turns)
), rebuilt as (
  select c.conv_id, p, digest, chars from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and p <= h
  union all select c.conv_id, p, digest, chars from convs c join turns t on t.conv_id = c.conv_id and p > h
), steps as (
  select conv_id, row_number() over w as depth, sha256(string_agg(digest, '') over w) as key, chars from rebuilt window w as (partition by conv_id order by p)
  union all select conv_id, 0, sha256(''), 0 from convs
), linked as (
  select *, lag(key) over (partition by conv_id order by depth) as parent, max(depth) over (partition by conv_id) as last from steps
), nodes as (
  select key, any_value(parent) as parent, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = last), '')) as ends_sha256
  from linked group by key
), counted as (
  select n.*, (select count(*) from nodes c where c.parent = n.key) as n_children from nodes n
), pairs as (
  select distinct a.key as above, b.key as below from linked a join linked b on a.conv_id = b.conv_id and a.depth <= b.depth
), sums as (
  select above as key, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * chars) as saved_tokens
  from pairs join counted on below = counted.key group by above
)
select c.conv_id, c.depth::bigint as depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, c.ends_sha256
from counted c join sums s using (key) left join nodes p on p.key = c.parent
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))
