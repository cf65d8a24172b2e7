"""SentencePiece byte-pair encoding and decoding, exact, by backtracking.

A text is read as the library reads it with an identity normalizer: a space in front, spaces as the piece mark.
No piece of the model holds a mark after another character, so the text falls apart into units of marks
followed by other characters, and each distinct unit is encoded once per worker and cache.

Encoding a unit: an Aho-Corasick automaton lists the pieces that start at every position. From the left the longest
piece is taken whose end has not failed and which is compatible with the piece before it: re-merging the two pieces'
text by the model's merge order must give exactly these two. With no such piece the position is marked in a bitfield of
failed positions and the last piece is taken back. Characters that no piece holds become the bytes of their UTF-8 form.

Nulls and empty texts encode to the end id alone and decode to the empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pairwright.llm.registry import query
from pairwright.llm.text import BoundedCache, keep, map_rows
from pairwright.sources.tables import table

MARK = "▁"
CACHE_UNITS = 300_000
CACHE_PAIRS = 500_000
CACHE_CHARS = 16

_LOADED: dict[str, PieceCodec] = keep({})


class PieceCodec:
    """Pieces, scores and byte ids of one model; encodes and decodes one text at a time."""

    def __init__(self, pieces: Sequence[str], scores: Sequence[float], byte_ids: dict[int, int], end_id: int) -> None:
        self.pieces = list(pieces)
        self.ids = {piece: i for i, piece in enumerate(pieces) if piece}
        self.scores = list(scores)
        self.sizes = [len(piece) for piece in self.pieces]
        self.byte_ids = byte_ids
        self.bytes_by_id = {i: value for value, i in byte_ids.items()}
        self.end_id = end_id
        self.known = {char for piece in self.ids for char in piece}
        self.single = {piece for piece in self.ids if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        whole = {piece: i for piece, i in self.ids.items() if self._merge(piece) == [i]}
        for piece, i in whole.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        # the next shorter piece that starts alike, or -1
        self.shorter = [-1] * len(self.pieces)
        for piece, i in whole.items():
            self.shorter[i] = next((whole[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in whole), -1)
        self.texts = [str(i) for i in range(max(len(self.pieces), end_id + 1))]
        self.plain = [bytes([self.bytes_by_id[i]]) if i in self.bytes_by_id else piece.encode() for i, piece in enumerate(self.pieces)]
        if any(MARK in piece.lstrip(MARK) for piece in self.ids):
            raise ValueError("a piece holds the mark inside; units would not be independent")
        cut = "".join(c for c in "\n\t\r" if c not in self.known)
        self.units = re.compile(f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + (f"|[{cut}]" if cut else ""))
        self.pairs = BoundedCache(CACHE_PAIRS)
        self.cache = BoundedCache(CACHE_UNITS)

    @classmethod
    def load(cls, model: bytes) -> PieceCodec:
        """Read the vocabulary of a model file; only normal pieces take part in merges."""
        import sentencepiece

        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = reader.get_piece_size()
        byte_ids, pieces = {}, []
        for i in range(size):
            if reader.is_byte(i):
                byte_ids[int(reader.id_to_piece(i)[3:5], 16)] = i
            special = reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i)
            pieces.append("" if special else reader.id_to_piece(i))
        return cls(pieces, [reader.get_score(i) for i in range(size)], byte_ids, reader.eos_id())

    def _merge(self, text: str) -> list[int]:
        """Merge a short text from its characters: the best-scored adjacent pair first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best):
                    best, at = self.scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids.get(part, -1) for part in parts]

    def _compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self._merge(self.pieces[left] + self.pieces[right]) == [left, right]
            self.pairs.room()
            self.pairs[left, right] = known
        return known

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces' characters."""
        size, sizes, shorter, pairs = len(text), self.sizes, self.shorter, self.pairs
        longest = [-1] * (size + 1)
        for end, i in self.automaton.iter(text):
            # matches come by their ends, so the last one from a start is its longest
            longest[end + 1 - sizes[i]] = i
        failed = bytearray(size + 1)
        out: list[int] = []
        at, i = 0, longest[0]
        while at < size:
            before = out[-1] if out else -1
            while i >= 0:
                stop = at + sizes[i]
                if not failed[stop] and (before < 0 or (pairs[before, i] if (before, i) in pairs else self._compatible(before, i))):
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, i = stop, longest[stop]
            else:
                if not out:
                    raise ValueError("the model cannot encode this text")
                failed[at] = 1
                i = out.pop()
                at, i = at - sizes[i], shorter[i]
        return out

    def _unit_ids(self, unit: str) -> list[int]:
        if self.single.issuperset(unit):
            return self._backtrack(unit)
        out, run = [], []
        for char in unit:
            if char in self.ids:
                run.append(char)
                continue
            if run:
                out += self._backtrack("".join(run))
                run = []
            out += [self.byte_ids[value] for value in char.encode("utf-8", "surrogatepass")]
        return out + self._backtrack("".join(run)) if run else out

    def _parts(self, units: list[str]) -> list[tuple[str, int, bytes]]:
        """Per unit: ids as decimal text, their number, and the bytes they decode to."""
        found = list(map(self.cache.get, units))
        if None not in found:
            return found
        missing = {unit for unit, part in zip(units, found, strict=True) if part is None}
        self.cache.room(len(missing))
        # long units seldom come again, so only short ones are kept
        once = {}
        for unit in missing:
            ids = self._unit_ids(unit)
            part = (" ".join(map(self.texts.__getitem__, ids)), len(ids), self._bytes(ids))
            (self.cache if len(unit) <= CACHE_CHARS else once)[unit] = part
        return [part or once.get(unit) or self.cache[unit] for unit, part in zip(units, found, strict=True)]

    def _bytes(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.plain.__getitem__, ids)).replace(MARK.encode(), b" ")

    def _split(self, text: str) -> list[str]:
        return self.units.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self._split(text or "") for i in self._unit_ids(unit)] + [self.end_id]

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids, without the space in front; control ids give nothing."""
        found = self._bytes(ids).decode("utf-8", "replace")
        return found[1:] if found.startswith(" ") else found

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with the end id, sha256 of the ids as text, sha256 of the decoded text."""
        parts = self._parts(self._split(text or ""))
        texts, sizes, plain = zip(*parts, strict=True) if parts else ((), (), ())
        ids = " ".join([*texts, str(self.end_id)])
        digests = [hashlib.sha256(value).hexdigest() for value in (ids.encode(), b"".join(plain)[1:])]
        return sum(sizes) + 1, *digests


def _codec(model: bytes) -> PieceCodec:
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = PieceCodec.load(model)
    return _LOADED[key]


def encode_documents(frame: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``piece_ids`` (with the end id) and ``decoded`` to every row."""
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches):
        import pyarrow as pa

        codec = _codec(model)
        for batch in batches:
            ids = [codec.encode(value) for value in batch.column(text).to_pylist()]
            table = pa.Table.from_batches([batch])
            table = table.append_column("piece_ids", pa.array(ids, pa.list_(pa.int32())))
            yield from table.append_column("decoded", pa.array([codec.decode(i) for i in ids], pa.string())).to_batches()

    schema = StructType([*frame.schema, StructField("piece_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return frame.mapInArrow(run, schema)


def encoding_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per document with the digests of its ids and of the text decoded from them."""
    with open(model_path, "rb") as file:
        model = file.read()

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        codec = _codec(model)
        for batch in batches:
            found = [codec.digest(text) for text in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": [row[0] for row in found],
                "ids_sha256": [row[1] for row in found],
                "decoded_sha256": [row[2] for row in found],
            }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_rows(documents, ["doc_id", "text"], schema, run)


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
