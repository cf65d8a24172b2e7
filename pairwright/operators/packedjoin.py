"""Pairs of similar documents, one row a document, from a prefix index that travels packed.

The sets of ``setjoin`` are rows; here a document's set is one array and only hashes, prefixes and the sets of candidates are ever shuffled.
Equal sets are one node, named by its digest. Tokens are ordered by how often a bounded sample of documents holds them, then by
hash; any order is exact, and this one puts boilerplate last. Of a set of n the first n - ceil(t n) + 1 tokens are its prefix, and two
sets at or over t share one of these. Prefixes travel as packed arrays; tokens of one node leave, the others meet in a join.
Sizes, the number of shared prefix tokens and the places of the last ones bound what two sets can still share; what passes is intersected
exactly. For that, pairs are dealt over a square of cells by both their nodes, and a text travels once to each cell where it has a
pair: at most twice the side of the square, however many pairs it is in.

Tokens are 64-bit hashes: sets are only ever compared two at a time, so the size of the corpus does not make a false meeting likelier.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import null_safe_join, over_groups
from pairwright.session import Rounds

PPM = 1_000_000
SAMPLE = 8_192
SAMPLE_DF = 3
PACK_TOKENS = 400_000
PACK_SETS = 1 << 16
BUCKET_TOKENS = 600_000
FILTER_BITS = 1 << 23
CELL_TOKENS = 4_000_000
# later places count as this one, which makes what two sets may share larger and never smaller
LAST_PLACE = (1 << 16) - 1


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct values of every list, ascending; null lists are empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False).view("u8"), column.offsets.to_numpy()
    for at, valid in enumerate(column.is_valid().to_pylist()):
        yield np.unique(values[offsets[at] : offsets[at + 1]]) if valid else np.zeros(0, "u8")


def _packed(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: of sorted or small values whole planes compress away."""
    return values.view("u1").reshape(-1, values.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(data, "u1").reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def measured(documents: DataFrame, tokens: Column) -> DataFrame:
    """``owner, label, n, digest, node`` of the documents with a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_arrays(batch.column("_t")))
            digests = [_digest(t) for t in found]
            columns = [batch.column("owner"), batch.column("label"), pa.array([len(t) for t in found], pa.int64()), pa.array(digests, pa.binary()), pa.array(map(_node, digests), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["owner", "label", "n", "digest", "node"])

    kind = {c: documents.schema[c].dataType.simpleString() for c in ("owner", "label")}
    schema = f"owner {kind['owner']}, label {kind['label']}, n long, digest binary, node long"
    return documents.select("owner", "label", tokens.alias("_t")).mapInArrow(run, schema).where("n > 0")


def sampled_order(documents: DataFrame, tokens: Column) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several of ``SAMPLE`` documents hold, ascending, and how many do. They shape the order alone, and any order is exact."""
    chosen = documents.select("owner").orderBy(F.xxhash64("owner"), "owner").limit(SAMPLE)
    texts = documents.join(F.broadcast(chosen), "owner", "left_semi")
    counted = texts.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.where(F.col("n") >= SAMPLE_DF).toPandas()
    token, n = rows["token"].to_numpy("i8").view("u8"), rows["n"].to_numpy("i8")
    order = np.argsort(token)
    return token[order], n[order]


def prefix_index(documents: DataFrame, tokens: Column, total: int, threshold: int) -> DataFrame:
    """``token, node, n, at``: the prefix tokens that several nodes may share, and their place in the order of their set."""
    common, counts = sampled_order(documents, tokens)
    buckets = int(max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 2 // BUCKET_TOKENS + 1))
    names = ["bucket", "tokens", "sets", "places", "nodes", "sizes"]

    def seen(found: np.ndarray) -> np.ndarray:
        if not len(common):
            return np.zeros(len(found), "i8")
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        return np.where(common[at] == found, counts[at], 0)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, packs = {}, 0, 0
        for batch in batches:
            for found in _arrays(batch.column("_t")):
                n = len(found)
                node = _node(_digest(found)) if n else None
                if n and node not in parts:
                    size = n - -(-n * threshold // PPM) + 1
                    parts[node] = (found[np.argsort(seen(found), kind="stable")[:size]], n)
                    held += size
                if held > PACK_TOKENS or len(parts) == PACK_SETS:
                    yield pack(parts, packs)
                    parts, held, packs = {}, 0, packs + 1
        if parts:
            yield pack(parts, packs)

    def pack(parts: dict, number: int) -> pa.RecordBatch:
        firsts = [first for first, _ in parts.values()]
        found = np.concatenate(firsts)
        sets = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts]).astype("u2")
        places = np.concatenate([np.minimum(np.arange(len(f)), LAST_PLACE).astype("u2") for f in firsts])
        nodes, sizes = np.array(list(parts), "i8"), np.array([n for _, n in parts.values()], "u4")
        # common tokens need no partner in their bucket, so their packs spread
        place = ((found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")
        place = np.where(seen(found) > 0, (place + number * 7_919 + int(nodes[0] % buckets)) % buckets, place)
        order = np.lexsort((found, place))
        found, sets, places, place = found[order], sets[order], places[order], place[order]
        cuts = np.searchsorted(place, np.arange(buckets + 1))
        rows = []
        for bucket in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[bucket], cuts[bucket + 1])
            used, mine = np.unique(sets[part], return_inverse=True)
            rows.append((int(bucket), *map(_packed, (found[part], mine.astype("u2"), places[part], nodes[used], sizes[used]))))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    def meet(table: pa.Table) -> pa.Table:
        def whole(name: str, kind: str) -> list[np.ndarray]:
            return [_unpacked(b, kind) for b in table[name].to_pylist()]

        found, places, held = whole("tokens", "u8"), whole("places", "u2"), whole("sets", "u2")
        nodes = np.concatenate([nodes[s] for nodes, s in zip(whole("nodes", "i8"), held, strict=True)])
        sizes = np.concatenate([sizes[s] for sizes, s in zip(whole("sizes", "u4"), held, strict=True)])
        found, places = np.concatenate(found), np.concatenate(places)
        order = np.lexsort((nodes, found))
        found, nodes, sizes, places = found[order], nodes[order], sizes[order], places[order]
        starts = np.r_[True, found[1:] != found[:-1]]
        fresh = starts | np.r_[True, nodes[1:] != nodes[:-1]]
        # copies of a set in other tasks repeat its node
        found, nodes, sizes, places = found[fresh], nodes[fresh], sizes[fresh], places[fresh]
        first = np.flatnonzero(starts[fresh])
        met = np.repeat(np.diff(np.r_[first, len(found)]) > 1, np.diff(np.r_[first, len(found)])) | (seen(found) > 0)
        columns = [found[met].view("i8"), nodes[met], sizes[met].astype("i8"), places[met].astype("i8")]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["token", "node", "n", "at"])

    packed = documents.select(tokens.alias("_t")).mapInArrow(local, "bucket int, tokens binary, sets binary, places binary, nodes binary, sizes binary")
    return packed.groupBy("bucket").applyInArrow(meet, "token long, node long, n long, at long")


def candidates(index: DataFrame, threshold: int) -> DataFrame:
    """``a, b, n_a, n_b``: pairs of nodes that may be at or over the threshold, by sizes and by the number and last places of the prefix tokens they share.

    Of the two prefixes, take the one whose last token comes first in the order: up to it every shared token is in both prefixes and counted, so what
    else they share stands behind this prefix, and behind the last shared place of the other set. Which one it is is not known; the
    larger bound holds. Copies of a set in other tasks may repeat a common token, which makes the count larger and never smaller.
    """
    left = index.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("_a"))
    right = index.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("at").alias("_b"))
    sized = F.least("n_a", "n_b") * PPM >= F.greatest("n_a", "n_b") * threshold
    met = left.join(right, "token").where("a < b").where(sized)
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * threshold / (PPM + threshold))
    found = met.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("_both"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    behind = {side: F.expr(f"(n_{side} * {threshold} + {PPM - 1}) div {PPM} - 1") for side in "ab"}
    after = {side: F.col(f"n_{side}") - F.col(f"_{side}") - 1 for side in "ab"}
    rest = F.greatest(F.least(behind["a"], after["b"]), F.least(behind["b"], after["a"]))
    return found.where(F.col("_both") + rest >= needed).select("a", "b", "n_a", "n_b")


def _of_owners(documents: DataFrame, owners: DataFrame) -> DataFrame:
    """``documents`` of ``owners`` and few others: a bitmap of fixed size over the hashes of the owners keeps texts out of a shuffle."""
    place = F.pmod(F.xxhash64("owner"), F.lit(FILTER_BITS))
    words = owners.select(F.floor(place / 32).alias("word"), F.expr("1L").alias("one"), (place % 32).cast("int").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, "u4")
    bits[rows["word"].to_numpy("i8")] = rows["bits"].to_numpy("i8").astype("u4")
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_place").to_numpy()
            kept = batch.filter(pa.array((bits[at >> 5] >> (at & 31).astype("u4") & 1).astype(bool)))
            yield kept.select(columns)

    return documents.withColumn("_place", place).mapInArrow(run, documents.schema)


def verified_pairs(pairs: DataFrame, owners: DataFrame, documents: DataFrame, text: str, shingled: Callable[[Column], Column], threshold: int, rounds: Rounds) -> DataFrame:
    """``a, b, n_a, n_b, n_both`` of the pairs at or over the threshold; ``owners`` are ``(node, owner)``."""
    size = pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0
    side = max(1, math.ceil(math.sqrt(size / CELL_TOKENS)))
    row, column = (F.pmod(F.xxhash64(node), F.lit(side)) for node in "ab")
    placed = pairs.withColumn("cell", row * side + column)
    nodes = placed.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = rounds.keep(nodes.join(owners, "node"), forget=False)
    texts = _of_owners(documents.select("owner", text), members).join(members, "owner")
    parts = min(side * side, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # texts travel, not sets: they compress
    sets = texts.select("cell", "node", text).repartition(parts, "cell").select("cell", "node", shingled(F.col(text)).alias("_t"))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = dict(zip(held["node"].to_pylist(), _arrays(held["_t"].combine_chunks()), strict=True))
        n_a, n_b = asked["n_a"].to_numpy(), asked["n_b"].to_numpy()
        meet = zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True)
        both = np.fromiter((len(np.intersect1d(found[a], found[b], assume_unique=True)) for a, b in meet), "i8", len(asked))
        kept = pa.array(both * PPM >= (n_a + n_b - both) * threshold)
        return asked.drop_columns(["cell"]).append_column("n_both", pa.array(both)).filter(kept)

    return placed.repartition(parts, "cell").groupBy("cell").cogroup(sets.groupBy("cell")).applyInArrow(run, "a long, b long, n_a long, n_b long, n_both long")


def similar_documents(documents: DataFrame, text: str, shingled: Callable[[Column], Column], general: int, labelled: int, everything: str) -> DataFrame:
    """``(label, left, right, n_left, n_right, n_both, jaccard_ppm)`` of the pairs at or over ``general`` ppm, under the label ``everything``, and of those of one
    label at or over ``labelled`` ppm.

    ``documents`` are ``(owner, label, text)`` with one row an owner; ``shingled`` makes an array of longs of a text, repeats allowed. ``left`` is the smaller owner. Of
    equal sets the smallest owner of the label stands for all: each further one is paired with it alone. Null labels are a label
    like others, documents without an owner or a token belong to no pair.
    """
    documents = documents.where("owner is not null").select("owner", "label", text)
    tokens = shingled(F.col(text))
    rounds = Rounds(documents.sparkSession)
    held = rounds.keep(measured(documents, tokens), forget=False)
    total = held.agg(F.sum("n")).first()[0] or 0
    threshold = min(general, labelled)

    # a document counts under its label and under the general one
    named = held.select(F.explode(F.array(F.lit(everything), F.col("label").cast("string"))).alias("label"), "owner", "n", "digest", "node").distinct()
    classes = rounds.keep(over_groups(named, ["label", "digest"], spread=["owner"], _first=F.min("owner")), forget=False)
    copies = classes.where(F.col("owner") != F.col("_first")).select("label", F.col("_first").alias("left"), F.col("owner").alias("right"), F.col("n").alias("n_left"), F.col("n").alias("n_right"), F.col("n").alias("n_both"))
    firsts = classes.where(F.col("owner") == F.col("_first")).select("label", "node", "owner")

    index = rounds.keep(prefix_index(documents, tokens, total, threshold), forget=False)
    pairs = rounds.keep(candidates(index, threshold))
    owners = firsts.where(F.col("label") == everything).select("node", "owner")
    verified = rounds.keep(verified_pairs(pairs, owners, documents, text, shingled, threshold, rounds), forget=False)

    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    limit = F.when(F.col("label").eqNullSafe(everything), general).otherwise(labelled)
    one = verified.join(firsts.select("label", F.col("node").alias("a"), F.col("owner").alias("_p")), "a")
    both = null_safe_join(one, firsts.select("label", F.col("node").alias("b"), F.col("owner").alias("_q")), ["label", "b"])
    forward = F.col("_p") < F.col("_q")
    found = both.where(F.col("n_both") * PPM >= union * limit).select(
        "label", F.least("_p", "_q").alias("left"), F.greatest("_p", "_q").alias("right"), F.when(forward, F.col("n_a")).otherwise(F.col("n_b")).alias("n_left"),
        F.when(forward, F.col("n_b")).otherwise(F.col("n_a")).alias("n_right"), "n_both",
    )
    out = found.unionByName(copies)
    return rounds.close(out.withColumn("jaccard_ppm", F.expr(f"n_both * {PPM} div (n_left + n_right - n_both)")))
