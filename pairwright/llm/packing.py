"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

1. Documents become pieces of at most ``capacity`` tokens and are range-sorted by length over the cluster. What the
   matching needs of them is the number of pieces of each length in each partition: at most one row per length
   and one more per partition boundary.
2. Matching goes in supersteps on runs: a run is a length with consecutive ranks, or a gap with consecutive
   sequence numbers. From the longest length down, a sweep finds the successor of the length among the gaps (the
   smallest gap that is large enough) and matches the whole run at once; the n-th piece of the run takes the n-th sequence
   of the gap run, so no two pieces claim one gap. Gaps are updated and the sweep repeats until the length is placed;
   with no gap left, new sequences are opened. There are never more live runs than lengths and gaps, so the state is
   bounded by ``capacity`` and not by the documents.
3. The runs go back to the partitions, where each piece reads its place from its rank.

Null and empty texts hold the end id alone. Rows with repeated or null ids are packed like any other row.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.llm.text import BoundedCache, keep, map_rows, utf8, words_of
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 400_000
CACHE_PARTS = 400_000
TOGETHER = 5_000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_LOADED: dict[str, WordCodec] = keep({})


class WordCodec:
    """Token ids of whole texts, with the ids of white-space-separated words kept in a bounded cache.

    The tokenizer drops white space and its normalizer never joins characters across it, so the ids of a text are the
    ids of its words one after the other. A word of letters with punctuation behind it is two such parts; parts are kept
    in lower case in a second cache, and missing parts of letters go to the tokenizer in one text, whose ids fall apart
    after every token that ends a part.
    """

    def __init__(self, config: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        suffix = json.loads(config)["model"].get("end_of_word_suffix") or ""
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.words = BoundedCache(CACHE_WORDS)
        self.parts = BoundedCache(CACHE_PARTS)

    def ids(self, text: bytes | None) -> bytes:
        """Ids of a text in UTF-8, as little-endian unsigned 32-bit numbers."""
        words = words_of(text)
        found = list(map(self.words.get, words))
        if None not in found:
            return b"".join(found)
        missing = {word: self._cut(word) for word, ids in zip(words, found, strict=True) if ids is None}
        self.parts.room(2 * len(missing))
        self._learn([part for parts in missing.values() for part in parts if part not in self.parts])
        self.words.room(len(missing))
        for word, parts in missing.items():
            self.words[word] = b"".join([self.parts[part] for part in parts])
        return b"".join([self.words[word] if ids is None else ids for word, ids in zip(words, found, strict=True)])

    def _cut(self, word: bytes) -> tuple[bytes, ...]:
        core = word.rstrip(PUNCTUATION)
        if core == word:
            return (word.lower(),) if word.isalpha() else (word,)
        if core[-1:].isalpha() and b"<|" not in word:
            return (core.lower() if core.isalpha() else core, word[len(core) :])
        return (word,)

    def _learn(self, parts: list[bytes]) -> None:
        parts = list(dict.fromkeys(parts))
        plain = [part for part in parts if part.decode("utf-8", "replace").isalpha()]
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            text = b" ".join(some).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) != len(some):
                self._one_by_one(some)
                continue
            raw, before = ids.tobytes(), 0
            for part, cut in zip(some, cuts.tolist(), strict=True):
                self.parts[part] = raw[before:cut]
                before = cut
        self._one_by_one([part for part in parts if part not in self.parts])

    def _one_by_one(self, parts: list[bytes]) -> None:
        texts = [part.decode("utf-8", "replace") for part in parts]
        for at in range(0, len(parts), TOGETHER):
            encodings = self.tokenizer.encode_batch_fast(texts[at : at + TOGETHER], add_special_tokens=False)
            for part, encoding in zip(parts[at : at + TOGETHER], encodings, strict=True):
                self.parts[part] = np.array(encoding.ids, "<u4").tobytes()


def _codec(config: str) -> WordCodec:
    key = hashlib.sha256(config.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordCodec(config)
    return _LOADED[key]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents with their end id, cut where longer than ``capacity``."""
    with open(tokenizer_path, encoding="utf-8") as file:
        config = json.dumps(json.load(file))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(config)
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = codec.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            yield out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_rows(documents, ["doc_id", utf8()], schema, run)


def match_runs(lengths: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit supersteps on counts per length: ``(length, first rank, pieces, first sequence, offset)``."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the gaps that some sequence has, ascending

    def add(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, count))

    runs, opened = [], 0
    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                more = -(-left // (capacity // length))
                add(capacity, opened, more)
                opened += more
                continue
            gap = sizes[at]
            first, count = gaps[gap].pop()
            matched = min(left, count)
            runs.append((length, rank, matched, first, capacity - gap))
            if not gaps[gap] and matched == count:
                del gaps[gap], sizes[at]
            elif matched < count:
                gaps[gap].append((first + matched, count - matched))
            add(gap - length, first, matched)
            rank, left = rank + matched, left - matched
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``capacity``.

    An empty table stays empty.
    """
    spark = pieces.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(name) for name in ("length", "doc_id", "piece", "ids_crc32")]
    # range bounds are sampled, which would tokenise twice
    ranged = cut_lineage(pieces).repartitionByRange(width, *order).sortWithinPartitions("length")
    ranged = cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))
    # one row per length, and one more for each partition in which a length goes on
    counted = ranged.groupBy("length", "_part").count().collect()
    base: dict[tuple[int, int], int] = {}
    totals: dict[int, int] = {}
    for length, part, count in sorted((row[0], row[1], row[2]) for row in counted):
        base[part, length] = totals.get(length, 0)
        totals[length] = base[part, length] + count
    runs = np.array(sorted(match_runs(totals, capacity)), "i8").reshape(-1, 5)
    keys = runs[:, 0] << 48 | runs[:, 1]

    def place(batches):
        import pyarrow as pa

        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            length = batch.column("length").to_numpy()
            part = batch.column("_part").to_numpy()
            rank = np.empty(len(length), "i8")
            cuts = np.flatnonzero(np.r_[True, (length[1:] != length[:-1]) | (part[1:] != part[:-1])])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(length)], strict=True):
                key = int(part[lo]), int(length[lo])
                first = seen.get(key, base[key])
                rank[lo:hi] = first + np.arange(hi - lo)
                seen[key] = first + hi - lo
            run = runs[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            rest = pa.Table.from_batches([batch]).drop_columns(["_part"])
            rest = rest.append_column("sequence_id", pa.array(run[:, 3] + rank - run[:, 1]))
            yield from rest.append_column("offset", pa.array(run[:, 4])).to_batches()

    schema = ranged.drop("_part").schema.add("sequence_id", "long").add("offset", "long")
    return ranged.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(documents, tokenizer_path, capacity), capacity)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
