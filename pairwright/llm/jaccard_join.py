"""Exact n-gram Jaccard join by signature trees; links become components.

1. Documents with equal shingle sets are one node from here on.
2. Hubs. Shingles get one global order: by how often a bounded sample of documents holds them, then by hash, so that
   common passages come last. Of a set of n, the first n - ceil(.75 n) + ceil(n / 8) shingles are its prefix. Two sets that
   link share at least ceil(n / 8) prefix shingles of the smaller set, so nodes that share fewer with any others drop out. The hub of a
   prefix shingle is the smallest node that holds it: two sets that link share as many shingles of common hubs. Hubs get one
   global order too, those with few nodes first, and a node goes to its first hubs until the shingles left are fewer than a link needs; two
   sets that link meet in the first hub of what they share. Shingles travel as packed arrays.
3. Inside a hub, sets are compared by a dual traversal of signature trees: a node of the tree holds the OR of its sets' token bitmaps, the
   range of their sizes and the most tokens that one bitmap loses to collisions. A pair of tree nodes is pruned when the
   bits they share and the lost tokens are too few for the smallest sets under them, when their size ranges exclude a
   link, or when all their sets are connected already. Pairs of sets that remain are intersected exactly.
4. A hub with more tokens than ``BLOCK`` (a set counts ``SET_WEIGHT`` more, so that blocks of short sets stay small) is dealt into blocks
   that all hold one leader. What a block connects to the leader is one component already; only the rest goes to other blocks, and only to
   those whose bitmap holds three quarters of a set's tokens. No set of candidates is capped.

Empty and null texts have no shingles, link with nothing and are their own component. A row with a null id takes part in no
link and has a null component. Rows with one id and different texts share the id and are each given the component of
their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from pairwright.llm.components import components
from pairwright.llm.registry import query
from pairwright.llm.shingles import Shingler, node_of, set_digest
from pairwright.llm.text import map_rows, utf8
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

SAMPLE = 4_000
SAMPLE_DF = 3
TASK_TOKENS = 600_000
BUCKET_TOKENS = 600_000
FILTER_BITS = 1 << 23
BLOCK = 1_000_000
SET_WEIGHT = 500
BITS = 2048
BLOCK_BITS = 1 << 22
PAIRS = 50_000


def document_sets(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, digest, node`` of every row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler()
        for batch in batches:
            sizes, digests = [], []
            for text in batch["text"]:
                found = shingler.sets(text)
                sizes.append(len(found))
                digests.append(set_digest(found))
            yield {"doc_id": batch["doc_id"], "n_shingles": sizes, "digest": digests, "node": [node_of(d) for d in digests]}

    return map_rows(documents, ["doc_id", utf8()], "doc_id long, n_shingles long, digest binary, node long", run)


def sampled_frequencies(documents: DataFrame, nodes: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that at least ``SAMPLE_DF`` of ``size`` sampled sets hold. They only shape the order, which any choice leaves exact."""
    chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("doc_id")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, parts = Shingler(), []
        for batch in batches:
            parts += [shingler.sets(text) for text in batch["text"]]
        if parts:
            tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield {"token": tokens.view("i8").tolist(), "n": counts.tolist()}

    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    counted = map_rows(texts, [utf8()], "token long, n long", run).groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") >= SAMPLE_DF).toPandas()
    rows = rows.assign(token=rows["token"].to_numpy("i8").view("u8")).sort_values("token")
    return rows["token"].to_numpy(), rows["n"].to_numpy("i8")


def prefix(shingles: np.ndarray, common: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The shingles that a linking set must meet ceil(n / 8) times."""
    n = len(shingles)
    size = n - -(-3 * n // 4) + -(-n // 8)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, frequency[at], 0)
        shingles = shingles[np.argsort(rank, kind="stable")]
    return shingles[:size]


def _pairs(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (token, node) pairs in this order."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])]
    return tokens[fresh], nodes[fresh]


def _edges(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct pairs in this order: nodes, the hubs of shingles that several nodes hold, and how many shingles those are."""
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    sizes = np.diff(np.r_[starts, len(tokens)])
    hubs, many = np.repeat(nodes[starts], sizes), np.repeat(sizes > 1, sizes)
    u, v = nodes[many], hubs[many]
    if not len(u):
        return u, v, u
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    return u[at], v[at], np.diff(np.r_[at, len(u)])


def token_bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of prefix shingles. Prefixes hold the lowest hashes of their sets, so these are mixed first."""
    mixed = tokens * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")


def needed(n: np.ndarray) -> np.ndarray:
    """How many prefix shingles a set of ``n`` shares with any set that links to it: ceil(ceil(.75 n) / 8)."""
    return np.maximum(1, -(-(-(-3 * n // 4)) // 8))


def _packed(place: np.ndarray, places: int, *columns: np.ndarray) -> tuple[list, ...]:
    """The filled places, and of each column the bytes that go to each of them."""
    order = np.argsort(place, kind="stable")
    cuts = np.searchsorted(place[order], np.arange(places + 1))
    filled = np.flatnonzero(np.diff(cuts)).tolist()
    return filled, *[[c[cuts[at] : cuts[at + 1]].tobytes() for at in filled] for c in (column[order] for column in columns)]


def _whole(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def hub_edges(documents: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``u, v, shared``: the hubs v of node u's prefix shingles, and how many of these shingles belong to each.

    Only nodes that share as many as a link needs come out. Each bucket of shingles counts a part of what a node shares, and parts travel as
    packed arrays to the bucket of their node. In a larger table ever more texts have a few shingles in common; they make no rows.
    """
    common, frequency = sampled_frequencies(documents, nodes)
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    width = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = int(max(width, total // 2 // BUCKET_TOKENS + 1))
    owners = max(width, buckets // 4)

    def local(batches: Iterator[dict]) -> Iterator[dict]:
        shingler, parts, held = Shingler(), [], 0
        for batch in batches:
            for text in batch["text"]:
                found = shingler.sets(text)
                if len(found):
                    node = node_of(set_digest(found))
                    first = prefix(found, common, frequency)
                    parts.append((first, np.full(len(first), node, "i8")))
                    held += len(first)
                if held > TASK_TOKENS:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    def pack(parts) -> dict:
        tokens, nodes = _pairs(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return dict(zip(["bucket", "tokens", "nodes"], _packed(token_bucket(tokens, buckets), buckets, tokens, nodes), strict=True))

    def meet(table: pa.Table) -> pa.Table:
        u, v, shared = _edges(*_pairs(_whole(table, "tokens", "u8"), _whole(table, "nodes", "i8")))
        columns = _packed(np.mod(u, owners), owners, u, v, shared.astype("i4"))
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32()] + [pa.binary()] * 3, strict=True)], names=["owner", "u", "v", "shared"])

    def add_up(parts: pa.Table, known: pa.Table) -> pa.Table:
        u, v, shared = _whole(parts, "u", "i8"), _whole(parts, "v", "i8"), _whole(parts, "shared", "i4").astype("i8")
        if len(u):
            order = np.lexsort((v, u))
            u, v, shared = u[order], v[order], shared[order]
            at = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
            u, v, shared = u[at], v[at], np.add.reduceat(shared, at)
            at = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
            met = np.repeat(np.add.reduceat(shared, at), np.diff(np.r_[at, len(u)]))
            node, n = known["node"].to_numpy(), known["n"].to_numpy()
            order = np.argsort(node)
            alive = met >= needed(n[order][np.searchsorted(node[order], u)])
            u, v, shared = u[alive], v[alive], shared[alive]
        return pa.table([u, v, shared], names=["u", "v", "shared"])

    sent = map_rows(documents.where("doc_id is not null"), [utf8()], "bucket int, tokens binary, nodes binary", local)
    met = sent.groupBy("bucket").applyInArrow(meet, "owner int, u binary, v binary, shared binary")
    known = nodes.select(F.pmod("node", F.lit(owners)).cast("int").alias("owner"), "node", "n")
    return met.groupBy("owner").cogroup(known.groupBy("owner")).applyInArrow(add_up, "u long, v long, shared long")


def hub_members(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """``hub, node, doc_id, n``: every node in its first hubs, those with few nodes first, up to the last that a link may need.

    What a node leaves out holds fewer shingles than any link of the node shares. A hub that one node alone has left joins nothing, so its
    shingles do not count.
    """
    need = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * 3 / 4) / 8))
    mine = Window.partitionBy("u")
    sizes = edges.groupBy("v").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    upto = F.sum("shared").over(mine.orderBy("size", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = edges.join(sizes, "v").join(classes.select(F.col("node").alias("u"), "doc_id", "n"), "u")
    met = met.withColumn("met", F.sum("shared").over(mine)).withColumn("upto", upto)
    kept = met.where(F.col("met") - F.col("upto") + F.col("shared") >= need)
    return kept.select(F.col("v").alias("hub"), F.col("u").alias("node"), "doc_id", "n")


class SignatureTree:
    """Binary tree over sets in a given order: OR of bitmaps, sizes and collisions per tree node."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = len(sets)
        bits = np.zeros((self.size, BITS // 8), "u1")
        for row, tokens in zip(bits, sets, strict=True):
            flags = np.zeros(BITS, bool)
            flags[(tokens % np.uint64(BITS)).astype("i8")] = True
            row[:] = np.packbits(flags)
        sizes = np.array([len(s) for s in sets], "i8")
        lost = sizes - np.bitwise_count(bits.view("u8")).sum(axis=1)
        self.levels = [(bits.view("u8"), sizes, sizes, lost)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, lost = self.levels[-1]
            at = np.arange(0, len(low), 2)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of tree nodes may have linking sets below them."""
        bits, low, high, lost = self.levels[level]
        out = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
        for at in range(0, len(a), PAIRS):
            some = np.flatnonzero(out[at : at + PAIRS]) + at
            x, y = a[some], b[some]
            shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype="i8") + np.minimum(lost[x], lost[y])
            out[some] = 7 * shared >= 3 * (low[x] + low[y])
        return out


def link_sets(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray | None = None) -> np.ndarray:
    """Labels after joining all sets that link. With ``sides``, only pairs of two different sides are compared."""
    order = np.lexsort((np.arange(len(sets)), [int(s[0]) if len(s) else 0 for s in sets]))
    sets = [sets[i] for i in order]
    parent = {int(label): int(label) for label in labels}
    mine = labels[order].tolist()

    def root(label: int) -> int:
        while parent[label] != label:
            parent[label] = label = parent[parent[label]]
        return label

    def compare(x: int, y: int) -> None:
        a, b = root(mine[x]), root(mine[y])
        if a != b and linked(sets[x], sets[y]):
            parent[max(a, b)] = min(a, b)

    side = np.zeros(len(sets), "i8") if sides is None else sides[order]
    # neighbours in this order are often copies; what they join need not be compared again
    for x in range(1, len(sets)):
        if sides is None or side[x] != side[x - 1]:
            compare(x - 1, x)
    tree = SignatureTree(sets)
    top = len(tree.levels) - 1
    a = b = np.zeros(1, "i8")
    for level in range(top, -1, -1):
        now = np.array([root(label) for label in mine])
        at = np.arange(0, len(sets), 1 << level)
        low, high = np.minimum.reduceat(now, at), np.maximum.reduceat(now, at)
        first, last = np.minimum.reduceat(side, at), np.maximum.reduceat(side, at)
        joined = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        inside = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]) if sides is not None else np.zeros(len(a), bool)
        open_ = ~joined & ~inside
        open_[open_] = (a[open_] == b[open_]) | tree.may_link(level, a[open_], b[open_])
        a, b = a[open_], b[open_]
        if level:
            count = len(tree.levels[level - 1][1])
            a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            fine = (a < count) & (b < count) & (a <= b)
            a, b = a[fine], b[fine]
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if x != y:
            compare(x, y)
    out = np.empty(len(sets), "i8")
    out[order] = [root(label) for label in mine]
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 x intersection >= 75 x union."""
    if 4 * len(a) < 3 * len(b) or 4 * len(b) < 3 * len(a):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = int((b[at] == a).sum())
    return 100 * shared >= 75 * (len(a) + len(b) - shared)


def _filter_words(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits over the hashes of ``doc_id``, for leaving most other rows out of a shuffle.

    Its size is fixed, so with very many ids it lets more rows through and changes nothing else.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select((place / 32).cast("int").alias("word"), F.expr("1L").alias("one"), (place % 32).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 32, "u4")
    out[[row["word"] for row in rows]] = [row["bits"] for row in rows]
    return out


def _with_tokens(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (one row per node, with its ``doc_id``) with the packed shingle set."""
    bits = _filter_words(members.select("doc_id"))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        shingler = Shingler()
        for batch in batches:
            place = np.array(batch["place"], "i8")
            wanted = np.flatnonzero(bits[place >> 5] >> (place & 31).astype("u4") & 1)
            found = [shingler.sets(batch["text"][i]) for i in wanted]
            # a row with the id of a node and another text is not that node, and the join drops it
            yield {
                "doc_id": [batch["doc_id"][i] for i in wanted],
                "node": [node_of(set_digest(s)) for s in found],
                "tokens": [s.tobytes() for s in found],
            }

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("place")
    rows = map_rows(documents.where("doc_id is not null"), ["doc_id", utf8(), place], "doc_id long, node long, tokens binary", run)
    kept = [c for c in members.columns if c != "doc_id"]
    return rows.join(members, ["doc_id", "node"]).dropDuplicates(["doc_id", "node"]).select(*kept, "tokens")


def link_hubs(documents: DataFrame, members: DataFrame) -> DataFrame:
    """``u, v``: star edges inside the components of the sets that meet in the hubs of ``members``."""
    weight = F.sum(F.col("n") + SET_WEIGHT)
    hubs = members.groupBy("hub").agg(F.count(F.lit(1)).alias("size"), F.ceil(weight / BLOCK).cast("int").alias("blocks"), F.min("node").alias("lead"))
    placed = members.join(hubs.where("size > 1").drop("size"), "hub").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = cut_lineage(placed)
    # the leader is in every block of its hub
    every = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("blk"))
    wanted = placed.withColumn("others", every).groupBy("doc_id", "node").agg(F.collect_list(F.struct("hub", "lead", "blocks", "others")).alias("places"))
    held = _with_tokens(documents, wanted).withColumn("place", F.explode("places")).select("node", "tokens", "place.*")
    sets = held.withColumn("blk", F.explode("others")).drop("others")

    def inside(table: pa.Table) -> pa.Table:
        out = []
        for part in _parts(table, ["hub", "blk"]):
            nodes = part["node"].to_numpy()
            labels = link_sets([np.frombuffer(t, "u8") for t in part["tokens"].to_pylist()], np.arange(len(nodes)))
            lead, blocks = part["lead"][0].as_py(), part["blocks"][0].as_py()
            smallest = _smallest(nodes, labels)
            settled = np.isin(labels, labels[nodes == lead]) if blocks > 1 else np.ones(len(nodes), bool)
            out.append((nodes, smallest, np.full(len(nodes), part["hub"][0].as_py()), settled))
        return pa.table([np.concatenate(column) for column in zip(*out, strict=True)], names=["u", "v", "hub", "settled"])

    near = cut_lineage(_dealt(sets, placed, ["hub", "blk"]).applyInArrow(inside, "u long, v long, hub long, settled boolean").where("u <> v or not settled"))
    edges = near.where("u <> v").select("u", "v")
    loose = near.where("not settled").select("hub", F.col("u").alias("node"), F.col("v").alias("label"))
    if loose.isEmpty():
        return edges
    # written first: a task that joins components too would hold a second Python worker
    return edges.unionByName(cut_lineage(_link_blocks(documents, placed, loose)))


def _link_blocks(documents: DataFrame, placed: DataFrame, loose: DataFrame) -> DataFrame:
    """``u, v``: star edges between blocks of a hub, from sets that their own block leaves ``loose`` (hub, node, label) of its leader."""
    open_ = placed.join(loose.select("hub").distinct(), "hub", "left_semi").join(loose, ["hub", "node"], "left")
    open_ = open_.withColumn("loose", F.col("label").isNotNull()).withColumn("label", F.coalesce("label", "lead"))
    wanted = open_.groupBy("doc_id", "node").agg(F.collect_list(F.struct("hub", "blk", "label", "loose")).alias("places"))
    held = cut_lineage(_with_tokens(documents, wanted).withColumn("place", F.explode("places")).select("node", "tokens", "place.*"))
    sets = held.withColumn("other", F.col("blk")).unionByName(_reaching(held))

    def between(table: pa.Table) -> pa.Table:
        out = []
        for part in _parts(table, ["hub", "other"]):
            nodes = part["node"].to_numpy()
            sides = (part["blk"].to_numpy() != part["other"].to_numpy()).astype("i8")
            if sides.any():
                start = np.unique(part["label"].to_numpy(), return_inverse=True)[1]
                labels = link_sets([np.frombuffer(t, "u8") for t in part["tokens"].to_pylist()], start, sides)
                out.append((nodes, _smallest(nodes, labels)))
        columns = [np.concatenate(column) for column in zip(*out, strict=True)] if out else [np.zeros(0, "i8")] * 2
        return pa.table(columns, names=["u", "v"])

    return _dealt(sets, placed, ["hub", "other"]).applyInArrow(between, "u long, v long").where("u <> v")


def _smallest(nodes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The smallest node with the label of each node."""
    _, at = np.unique(labels, return_inverse=True)
    low = np.full(at.max() + 1, np.iinfo("i8").max)
    np.minimum.at(low, at, nodes)
    return low[at]


def _dealt(sets: DataFrame, placed: DataFrame, key: list[str]):
    """``sets`` grouped into buckets of whole keys; most keys are far too small for a group of their own."""
    total = placed.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_TOKENS + 1)
    return sets.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets))).groupBy("bucket")


def _parts(table: pa.Table, key: list[str]) -> Iterator[pa.Table]:
    table = table.sort_by([(name, "ascending") for name in key])
    first, second = (table[name].to_numpy() for name in key)
    starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    for lo, hi in zip(starts, np.r_[starts[1:], len(first)], strict=True):
        yield table.slice(lo, hi - lo)


def _reaching(held: DataFrame) -> DataFrame:
    """Loose sets, once for each other block of their hub (``other``) that may hold a partner.

    The blocks are the top of the signature trees: a block's OR of token bitmaps must hold three quarters of a set's tokens. Only
    bitmaps travel to every block of their hub.
    """
    key = ["hub", "blk"]

    def bitmap(table: pa.Table) -> pa.Table:
        bits = np.zeros(BLOCK_BITS, bool)
        for tokens in table["tokens"].to_pylist():
            bits[(np.frombuffer(tokens, "u8") % np.uint64(BLOCK_BITS)).astype("i8")] = True
        return pa.table({"hub": table["hub"][:1], "other": table["blk"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    maps = cut_lineage(held.groupBy(*key).applyInArrow(bitmap, "hub long, other int, bits binary"))
    loose = held.where("loose")
    to_block = loose.select("hub", "blk").distinct().join(maps, "hub").where("blk <> other")
    to_block = to_block.select(F.col("hub").alias("_h"), F.col("blk").alias("_b"), "other", "bits")

    def send(sets: pa.Table, near: pa.Table) -> pa.Table:
        out = [sets.slice(0, 0).append_column("other", pa.array([], pa.int32()))]
        places = [(np.frombuffer(tokens, "u8") % np.uint64(BLOCK_BITS)).astype("i8") for tokens in sets["tokens"].to_pylist()]
        for other, packed in zip(near["other"].to_pylist(), near["bits"].to_pylist(), strict=True):
            bits = np.unpackbits(np.frombuffer(packed, "u1"))
            part = sets.filter(pa.array([4 * int(bits[p].sum()) >= 3 * len(p) for p in places], pa.bool_()))
            out.append(part.append_column("other", pa.array([other] * part.num_rows, pa.int32())))
        return pa.concat_tables(out)

    schema = StructType([*held.schema, StructField("other", IntegerType())])
    return loose.groupBy(*key).cogroup(to_block.groupBy("_h", "_b")).applyInArrow(send, schema)


def join_components(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    sets = cut_lineage(document_sets(documents))
    usable = sets.where("doc_id is not null and n_shingles > 0")
    classes = cut_lineage(usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("node").alias("node"), F.first("n_shingles").alias("n")))
    edges = cut_lineage(hub_edges(documents, sets, classes))
    true_groups = components(link_hubs(documents, hub_members(edges, classes)))
    named = classes.select("digest", "node", "doc_id").join(true_groups, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = cut_lineage(attach(named, smallest, ["component"], spread=["node"]).select("digest", "component_id"))
    joined = attach(sets, final, ["digest"], how="left", spread=["doc_id"])
    mine = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", mine.cast("long").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with the smallest id of their component, with all their columns.

    Rows without an id stay. Rows that share an id stay or go together, but of equal texts with one id one row stays.
    """
    found = join_components(documents)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = documents.where("doc_id is not null").join(kept, "doc_id", "left_semi").withColumn("__text", F.md5(F.col("text").cast("binary")))
    return named.dropDuplicates(["doc_id", "__text"]).select(*documents.columns).unionByName(documents.where("doc_id is null"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return join_components(table(spark, folder, "documents"))
