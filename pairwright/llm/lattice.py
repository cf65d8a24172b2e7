"""Marginal probability of texts under a unigram model over subword lattices.

The vocabulary is that of a given tokenizer model, which also orders its pieces. Its scores give first weights; the weights are
then re-estimated once from the training documents (one expectation step over all segmentations of all training words).
A word is the mark and its characters; its probability is the sum over all its segmentations, by forward
recursion in log space. A text's words are independent, and one end closes it, so a document's score is a sum over its words.

Counting and scoring of words is done once per distinct word of the corpus. Words holding more than ``FREQUENT`` of the training
tokens (at most 1 / FREQUENT words) go to the tasks as a table and never travel. Every other word of a block of documents
travels once with the documents that hold it, meets its count and its probability in a join, and goes back as sums per
document, added up before they travel.

A null text is empty and scores its end alone. Documents with null ids are learnt from. Repeated rows are counted and scored
as often as they occur. With no training documents all counts are 0.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.llm.text import fold, keep, map_rows, utf8
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

MARK = "▁"
SMOOTHING = 0.5
FREQUENT = 1e-5
BLOCK_WORDS = 4_000_000
FOLDS, HELD_OUT = 5, 1

_LATTICES: dict[str, Lattice] = keep({})


class Lattice:
    """Pieces of a vocabulary with log probabilities; ``forward`` and ``expect`` work on one word."""

    def __init__(self, pieces: list[str], byte_ids: dict[int, int], logs: np.ndarray) -> None:
        self.byte_ids, self.logs = byte_ids, logs.tolist()
        self.automaton = ahocorasick.Automaton()
        self.known = set()
        for i, piece in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), i))
                if len(piece) == 1:
                    self.known.add(piece)
        self.automaton.make_automaton()

    def arcs(self, word: bytes) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
        """Length, and ``(end, start, ids)`` by ascending end; characters that are no piece pass as bytes."""
        text = MARK + word.decode("utf-8", "replace")
        out = [(end + 1, end + 1 - size, (i,)) for end, (size, i) in self.automaton.iter(text)]
        strange = [at for at, char in enumerate(text) if char not in self.known]
        if strange:
            out += [(at + 1, at, tuple(self.byte_ids[b] for b in text[at].encode("utf-8", "replace"))) for at in strange]
            out.sort(key=lambda arc: arc[0])
        return len(text), out

    def forward(self, word: bytes) -> float:
        """Natural log of the word's probability."""
        size, arcs = self.arcs(word)
        return self._alpha(size, arcs)[size]

    def _alpha(self, size: int, arcs) -> list[float]:
        logs, exp, log = self.logs, math.exp, math.log
        alpha = [-math.inf] * (size + 1)
        alpha[0] = 0.0
        at, top, total = 0, -math.inf, 0.0
        for end, start, ids in arcs:
            if end != at:
                if total:
                    alpha[at] = top + log(total)
                at, top, total = end, -math.inf, 0.0
            x = alpha[start] + (logs[ids[0]] if len(ids) == 1 else sum([logs[i] for i in ids]))
            if x == -math.inf:
                continue
            if x <= top:
                total += exp(x - top)
            else:
                total = total * exp(top - x) + 1.0 if total else 1.0
                top = x
        if total:
            alpha[at] = top + log(total)
        return alpha

    def expect(self, word: bytes, count: float, into: np.ndarray) -> None:
        """Add ``count`` times the expected uses of each piece in the word."""
        size, arcs = self.arcs(word)
        alpha = self._alpha(size, arcs)
        logs, exp = self.logs, math.exp
        beta = [0.0] * (size + 1)  # probability of the rest, relative to the word's
        beta[size] = 1.0
        whole = alpha[size]
        # posterior of an arc = alpha[start] * p * beta[end] / whole, with beta carried as posterior mass per alpha
        for end, start, ids in reversed(arcs):
            if beta[end]:
                x = alpha[start] + sum([logs[i] for i in ids]) - alpha[end]
                mass = exp(x) * beta[end]
                beta[start] += mass
                for i in ids:
                    into[i] += count * mass
        assert whole > -math.inf


def read_vocabulary(model: bytes) -> tuple[list[str], dict[int, int], np.ndarray]:
    """Pieces (empty for control and byte pieces), ids of byte pieces, and first log weights from the model's scores.

    Scores that are ranks (0, -1, -2, ...) are read as such: the weight falls with the inverse of the rank.
    """
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = reader.get_piece_size()
    byte_ids = {int(reader.id_to_piece(i)[3:5], 16): i for i in range(size) if reader.is_byte(i)}
    special = [reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i) for i in range(size)]
    pieces = ["" if special[i] else reader.id_to_piece(i) for i in range(size)]
    scores = np.array([reader.get_score(i) for i in range(size)])
    weights = 1.0 / (10.0 + np.clip(-scores, 0, size))
    return pieces, byte_ids, np.log(weights / weights.sum())


def _lattice(model: bytes, logs: np.ndarray) -> Lattice:
    key = hashlib.sha256(model + logs.tobytes()).hexdigest()
    if key not in _LATTICES:
        _LATTICES.clear()
        pieces, byte_ids, _ = read_vocabulary(model)
        _LATTICES[key] = Lattice(pieces, byte_ids, logs)
    return _LATTICES[key]


def word_counts(documents: DataFrame) -> DataFrame:
    """``word, n``: occurrences in training documents, 0 for words that only others hold."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        train, other = Counter(), set()
        for batch in batches:
            for text, held in zip(batch["text"], batch["held_out"], strict=True):
                if text:
                    words = text.lower().split()
                    other.update(words) if held else train.update(words)
            if len(train) + len(other) > BLOCK_WORDS // 4:
                yield from flush(train, other)
                train, other = Counter(), set()
        yield from flush(train, other)

    def flush(train: Counter, other: set) -> Iterator[dict]:
        rest = [word for word in other if word not in train]
        yield {"word": list(train) + rest, "n": list(train.values()) + [0] * len(rest)}

    columns = [utf8(), (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")]
    return map_rows(documents, columns, "word binary, n long", run).groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(counts: DataFrame, model: bytes, n_documents: int) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of the end, from one expectation step over the training words."""
    _, _, first = read_vocabulary(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lattice, uses = _lattice(model, first), np.zeros(len(first))
        for batch in batches:
            for word, n in zip(batch["word"], batch["n"], strict=True):
                lattice.expect(word, n, uses)
        used = np.flatnonzero(uses)
        yield {"piece": used.tolist(), "uses": uses[used].tolist()}

    found = map_rows(counts.where("n > 0"), ["word", "n"], "piece int, uses double", run)
    uses = np.full(len(first), SMOOTHING)
    for piece, total in found.groupBy("piece").agg(F.sum("uses")).collect():  # as many rows as pieces
        uses[piece] += total
    total = uses.sum() + n_documents + SMOOTHING
    return np.log(uses / total), math.log((n_documents + SMOOTHING) / total)


def word_scores(counts: DataFrame, model: bytes, logs: np.ndarray) -> DataFrame:
    """``word, n, score``: log10 of each word's marginal probability."""
    tenth = 1 / math.log(10)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lattice = _lattice(model, logs)
        for batch in batches:
            yield batch | {"score": [lattice.forward(word) * tenth for word in batch["word"]]}

    return map_rows(counts, ["word", "n"], "word binary, n long, score double", run)


def score_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """Base and lattice scores of every document."""
    with open(model_path, "rb") as file:
        model = file.read()
    spark = documents.sparkSession
    counts = cut_lineage(word_counts(documents))
    n_train = documents.where(fold("doc_id", FOLDS) != HELD_OUT).count()
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, distinct = known[0] + n_train, known[1] + (n_train > 0)
    logs, end = fit_pieces(counts, model, n_train)
    scored = cut_lineage(word_scores(counts, model, logs))
    spread = tokens + 0.5 * (distinct + 1)

    def base(n):
        return F.log10((F.col(n) + 0.5) / F.lit(spread))

    rated = scored.select("word", (F.col("n") > 0).cast("int").alias("known"), base("n").alias("base"), "score")
    # no more than 1 / FREQUENT words can hold that share of the tokens
    frequent = {
        bytes(row["word"]): (row["known"], row["base"], row["score"])
        for row in rated.join(counts.where(F.col("n") > max(1.0, FREQUENT * tokens)).select("word"), "word", "left_semi").collect()
    }
    shared = spark.sparkContext.broadcast(frequent)
    end_base = math.log10((n_train + 0.5) / spread)
    ends = np.array([(int(n_train > 0), end_base, end / math.log(10))], _SUMS)[0]
    return _per_document(documents, rated, shared, ends).withColumn("train_tokens", F.lit(tokens).cast("long"))


_SUMS = np.dtype([("known", "f8"), ("base", "f8"), ("score", "f8")])
_DOCUMENT = np.dtype([("doc_id", "i8"), ("has_id", "?"), ("held_out", "?"), ("words", "i8"), *_SUMS.descr])
_PLACED = np.dtype([("place", "u4"), *_SUMS.descr])
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _per_document(documents: DataFrame, rated: DataFrame, shared, ends: np.void) -> DataFrame:
    """Documents stay in the blocks they were read in; what a task adds up for a block travels back as one packed row."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, block = shared.value, None
        for batch in batches:
            for row, doc_id, held, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                block = block or _Block(row)
                block.add(doc_id, held, text, frequent)
                if block.held > BLOCK_WORDS:
                    yield from block.flush()
                    block = None
        if block:
            yield from block.flush()

    columns = [
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), utf8(),
    ]
    posted = documents.select(*columns).mapInArrow(postings, "word binary, block long, posts binary")
    met = posted.join(rated, "word", "left").select("word", "block", "posts", "known", "base", "score")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            known = batch.column("known").is_valid()
            own = batch.filter(pa.compute.invert(known))
            if own.num_rows:
                yield _packed(own.column("block"), pa.array([True] * own.num_rows), own.column("posts"))
            rest = batch.filter(known)
            if rest.num_rows:
                posts = rest.column("posts").to_pylist()
                each = np.array([len(post) // 8 for post in posts])
                flat = np.frombuffer(b"".join(posts), "<u4").reshape(-1, 2)
                block = np.repeat(rest.column("block").to_numpy(), each)
                values = [np.repeat(rest.column(c).to_numpy().astype("f8"), each) * flat[:, 1] for c in _SUMS.names]
                parts.append(_sums(block, flat[:, 0], *values))
                held += len(parts[-1][0])
            if held > BLOCK_WORDS:
                parts = [_sums(*map(np.concatenate, zip(*parts, strict=True)))]
                held = 0
        if parts:
            yield from _by_block(*_sums(*map(np.concatenate, zip(*parts, strict=True))))

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.frombuffer(b"".join(pdf["posts"][pdf["own"]]), _DOCUMENT)
        rest = np.frombuffer(b"".join(pdf["posts"][~pdf["own"]]), _PLACED)
        total = {c: own[c] + np.bincount(rest["place"], rest[c], len(own)) + ends[c] for c in _SUMS.names}
        ids = pd.Series(own["doc_id"], dtype="Int64").where(pd.Series(own["has_id"]))
        return pd.DataFrame(
            {
                "doc_id": ids, "held_out": own["held_out"], "n_tokens": own["words"] + 1,
                "n_known": np.rint(total["known"]).astype("i8"), "base_score": total["base"], "score": total["score"],
            }
        )

    return met.mapInArrow(add_up, "block long, own boolean, posts binary").groupBy("block").applyInPandas(close, _RESULT)


def _sums(block: np.ndarray, place: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((place, block))
    block, place = block[order], place[order]
    at = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (place[1:] != place[:-1])])
    return block[at], place[at], *[np.add.reduceat(value[order], at) for value in values]


def _by_block(block: np.ndarray, place: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = np.empty(len(place), _PLACED)
    for name, value in zip(_PLACED.names, (place, *values), strict=True):
        rows[name] = value
    at = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for lo, hi in zip(at, np.r_[at[1:], len(block)], strict=True):
        yield _packed(pa.array(block[lo : lo + 1]), pa.array([False]), pa.array([rows[lo:hi].tobytes()], pa.binary()))


def _packed(block, own, posts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([block, own, posts], names=["block", "own", "posts"])


class _Block:
    """Documents of one task: their sums over frequent words, and every other word with the documents that hold it."""

    def __init__(self, row: int) -> None:
        self.row = row
        self.documents: list[tuple] = []
        self.ids: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, held: bool, text: bytes | None, frequent: dict) -> None:
        words = text.lower().split() if text else []
        found = list(map(frequent.get, words))
        sums = [sum(column) for column in zip(*[f for f in found if f is not None], strict=True)] or [0, 0.0, 0.0]
        self.documents.append((doc_id or 0, doc_id is not None, held, len(words), *sums))
        ids = self.ids
        self.words.append(np.array([ids.setdefault(w, len(ids)) for w, f in zip(words, found, strict=True) if f is None], "i8"))
        self.held += len(self.words[-1]) + 1

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = ["word", "block", "posts"]
        # a key with a space is no word, and its own for every block
        own = [pa.array([b" %d" % self.row], pa.binary()), pa.array([self.row]), pa.array([np.array(self.documents, _DOCUMENT).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(own, names=names)
        words = np.concatenate(self.words)
        place = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])
        pairs, counts = np.unique(words << 32 | place, return_counts=True)
        posts = np.column_stack([pairs & 0xFFFFFFFF, counts]).astype("<u4").tobytes()
        cuts = np.searchsorted(pairs >> 32, np.arange(len(self.ids) + 1)) * 8
        texts = list(self.ids)
        for at in range(0, len(texts), 10_000):
            upto = min(at + 10_000, len(texts))
            offsets = (cuts[at : upto + 1] - cuts[at]).astype("i4")
            buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(posts[cuts[at] : cuts[upto]])]
            body = pa.BinaryArray.from_buffers(pa.binary(), upto - at, buffers)
            blocks = pa.array(np.full(upto - at, self.row, "i8"))
            yield pa.RecordBatch.from_arrays([pa.array(texts[at:upto], pa.binary()), blocks, body], names=names)


@query("op4_lattice_scores")
def op4_lattice_scores(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
