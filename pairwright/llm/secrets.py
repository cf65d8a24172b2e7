"""Secret scans: candidates by shape, false positives removed by a random forest.

A candidate is a run of 12 or more letters, digits and ``+ / _ -`` with a digit in it. Its features are its length, its mix of
character classes and the changes between them, how many of its letter pairs and how much of its length the dictionary
knows, the path of its document, and the words around it (credential words, assignment, quotes, placeholders).
The dictionary is the ``DICTIONARY`` most frequent words of all documents.

The forest is fitted on a bounded sample of ``FINDINGS`` labelled findings (the lowest hashes). Where no labelled findings are given, they
are made from the training fold of the documents: values assigned to a credential word or with an issuer's prefix are
secrets, all other candidates are not. Candidates scored at least ``THRESHOLD`` are secrets. With findings of one class only
every candidate gets that class.

Offsets and lengths count UTF-8 bytes. Null and empty texts have no findings, null paths are empty paths, rows with null ids are scanned like
others, and equal rows give equal findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.llm.text import fold, map_rows, tidy, utf8
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

FINDINGS = 20_000
DICTIONARY = 4_096
THRESHOLD = 0.5
TREES, DEPTH, SEED = 24, 8, 7
FOLDS, HELD_OUT = 4, 2
NEIGHBOURHOOD = 48
REDACTED = b"[secret]"

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_\-]{12,}")
CREDENTIAL = re.compile(rb"(?i)(?:token|passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|auth|credential)\w*\W{0,4}$")
ASSIGNED = re.compile(rb"[=:]\s*[\"']?$")
PLACEHOLDER = re.compile(rb"(?i)example|sample|dummy|placeholder|test|changeme")
ISSUED = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}$|sk_(?:live|test)_[A-Za-z0-9]{16,}$|xox[abprs]-")
WORD = re.compile(rb"[A-Za-z]+")
HEX = re.compile(rb"[0-9a-fA-F]+$")
_CLASS = bytes(1 if 48 <= c < 58 else 2 if 65 <= c < 91 else 3 if 97 <= c < 123 else 4 for c in range(256))
FEATURES = (
    "length", "digits", "capitals", "small", "changes", "distinct", "entropy", "hex", "numeric", "known_pairs", "coverage", "path_depth",
    "path_bucket", "path_test", "credential", "assigned", "quoted", "placeholder", "word_before", "word_after", "issuer",
)


class Reader:
    """Findings of one text, with a dictionary of lower-case words."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = set(words)
        self.longest = max(map(len, words), default=0)
        self.pairs = {word[i : i + 2] for word in words for i in range(len(word) - 1)}

    def coverage(self, value: bytes) -> float:
        low, covered, at = value.lower(), 0, 0
        while at < len(low):
            step = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            covered += step
            at += step or 1
        return covered / len(low)

    def features(self, text: bytes, start: int, end: int, path: bytes) -> list[float]:
        value = text[start:end]
        before, after = text[max(0, start - NEIGHBOURHOOD) : start], text[end : end + NEIGHBOURHOOD]
        kinds = value.translate(_CLASS)
        size = len(value)
        counts = Counter(value).values()
        letters = [m[0].lower() for m in WORD.finditer(value)]
        pairs = [word[i : i + 2] for word in letters for i in range(len(word) - 1)]
        last, first = WORD.findall(before)[-1:], WORD.findall(after)[:1]
        return [
            float(size),
            kinds.count(1) / size,
            kinds.count(2) / size,
            kinds.count(3) / size,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / size,
            len(counts) / size,
            -sum(n / size * math.log2(n / size) for n in counts),
            float(bool(HEX.match(value))),
            float(value.isdigit()),
            sum(pair in self.pairs for pair in pairs) / len(pairs) if pairs else 0.0,
            self.coverage(value),
            float(path.count(b"/")),
            float(int.from_bytes(hashlib.blake2b(path, digest_size=2).digest(), "little") % 16),
            float(bool(PLACEHOLDER.search(path))),
            float(bool(CREDENTIAL.search(before))),
            float(bool(ASSIGNED.search(before))),
            float(before[-1:] in (b'"', b"'") and after[:1] == before[-1:]),
            float(bool(PLACEHOLDER.search(before + b" " + after))),
            float(bool(last) and last[0].lower() in self.words),
            float(bool(first) and first[0].lower() in self.words),
            float(bool(ISSUED.match(value))),
        ]


def dictionary(documents: DataFrame, size: int = DICTIONARY) -> list[bytes]:
    """The most frequent words of three or more ASCII letters over all documents, ties in byte order."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["text"]:
                if text:
                    seen.update(text.lower().split())
            plain = [(word, n) for word, n in seen.items() if len(word) > 2 and word.isalpha()]
            yield {"word": [word for word, _ in plain], "n": [n for _, n in plain]}

    counted = map_rows(documents, [utf8()], "word binary, n long", run).groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(row["word"]) for row in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def candidates(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, key, start, length, value_sha256, features`` of every candidate; ``key`` is the md5 of the text."""
    words = dictionary(documents)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        reader = Reader(words)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("doc_id", "key", "start", "length", "value_sha256", "features")}
            for doc_id, text, where in zip(batch["doc_id"], batch["text"], batch["path"], strict=True):
                key = None
                for found in CANDIDATE.finditer(text or b""):
                    if found[0].isalpha() or not any(map(found[0].__contains__, b"0123456789")):
                        continue
                    key = key or hashlib.md5(text).digest()
                    start, end = found.span()
                    row = (doc_id, key, start, end - start, hashlib.sha256(found[0]).hexdigest(), reader.features(text, start, end, where or b""))
                    for name, value in zip(out, row, strict=True):
                        out[name].append(value)
            yield out

    columns = ["doc_id", utf8(), F.col(path).cast("string").cast("binary").alias("path")]
    return map_rows(documents, columns, "doc_id long, key binary, start long, length long, value_sha256 string, features array<double>", run)


def labelled_findings(found: DataFrame) -> DataFrame:
    """Candidates of the training fold with ``label``, by the rule in the module's text."""
    credential, assigned, issuer = (F.col("features")[FEATURES.index(name)] for name in ("credential", "assigned", "issuer"))
    secret = (issuer > 0) | ((credential > 0) & (assigned > 0))
    return found.where(fold("doc_id", FOLDS) != HELD_OUT).withColumn("label", secret.cast("double"))


def scan(documents: DataFrame, path: str, labelled: DataFrame | None = None) -> DataFrame:
    """Candidates with ``score`` and ``is_secret``. ``labelled`` holds ``features`` (as in ``FEATURES``) and ``label`` (0 or 1)."""
    found = cut_lineage(candidates(documents, path))
    labelled = labelled_findings(found) if labelled is None else labelled
    mixed = F.xxhash64("features", "label")
    sample = cut_lineage(labelled.select(array_to_vector("features").alias("x"), "label", mixed.alias("_h")).orderBy("_h").limit(FINDINGS).coalesce(1).sortWithinPartitions("_h"))
    classes = [row[0] for row in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        score = F.lit(float(classes[0]) if classes else 0.0)
        scored = found.withColumn("score", score)
    else:
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
        model = forest.fit(sample)
        scored = model.transform(found.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "key", "start", "length", "value_sha256", "score", (F.col("score") >= THRESHOLD).alias("is_secret"))


def redact(documents: DataFrame, path: str) -> DataFrame:
    """The documents with every secret in ``text`` replaced by a mark; ``n_chars``, where there, follows the text."""
    found = scan(documents, path).where("is_secret")
    spans = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("__spans"))
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    keyed = documents.withColumn("__key", key)
    met = attach(keyed, cut_lineage(spans.withColumnRenamed("key", "__key")), ["__key"], how="left", spread=["__key", "doc_id"], hot_from=documents.select(key.alias("__key")))

    def run(batches):
        import pyarrow as pa

        tidy("redact")
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("__spans").to_pylist()):
                if spans:
                    data = texts[i].encode()
                    for span in reversed(spans):
                        data = data[: span["start"]] + REDACTED + data[span["start"] + span["length"] :]
                    texts[i] = data.decode("utf-8", "replace")
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).select(documents_columns)

    documents_columns = documents.columns
    out = met.select(*documents_columns, "__spans").mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents_columns else out


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Findings in documents; a document's path is its source."""
    return scan(table(spark, folder, "documents"), "source").drop("key")
