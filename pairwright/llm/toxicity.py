"""Toxicity by nearest labelled examples under exact cosine of weighted TF-IDF.

Fitting, on a bounded sample of ``EXAMPLES`` labelled training documents (the lowest id hashes):
* terms are all lower-cased words of the examples without surrounding punctuation; a term at least ``LIFT`` times as frequent on one
  side weighs up to 1 + ``TELLING`` times its TF-IDF, rising with its chi-square up to ``CHI_SQUARE``;
* document frequencies of these terms come from all documents;
* an inverted index over the examples holds their unit vectors, cut into blocks of like examples; for every frequent term the largest
  weight in each block is kept.

Scoring: postings of the other terms are added up, which gives every block its best sum so far; with the maxima of the frequent terms that
bounds its cosines. Blocks are read by falling bound until none left can reach the k-th cosine, so the neighbours are exact. A document that is an example itself is left out of its own vote. Words that no example
holds have no part in a text's length. Votes are weighted by distance (1 / (1 - cosine + ``NEAR``)) and shrunk towards
the share of toxic examples. A monotone calibration, fitted on leave-one-out votes of the
examples, makes the votes probabilities. A document's neighbours are its evidence.

Null and empty texts have no terms and get the prior. Without labelled training rows every score is 0. Documents with null ids
belong to the training side and never match a label. Rows labelled more than once are toxic if any label says so; null labels are none.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.llm.text import BoundedCache, fold, map_rows, tidy, utf8
from pairwright.sources.tables import table

EXAMPLES = 8192
CHI_SQUARE = 50.0
LIFT = 3.0
TELLING = 8.0
NEIGHBOURS = 15
PART = 4096
BLOCK = 256
LONG = 64
LONG_TERMS = 512
SEEDS = 16
FIRST_BLOCKS = 2
QUERIES = 64
SLACK = 1e-4
RESULTS = 20_000
NEAR = 0.05
PRIOR_WEIGHT = 1.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def term_counts(text: bytes | None) -> Counter:
    """Occurrences of each term; every distinct word is stripped once."""
    out: Counter = Counter()
    if text:
        for word, n in Counter(text.lower().split()).items():
            out[word.strip(PUNCTUATION)] += n
        out.pop(b"", None)
    return out


class ExampleIndex:
    """Block-max inverted index over unit-length example vectors.

    Examples are put in an order in which alike ones are neighbours (by the nearest of ``SEEDS`` of them) and cut into blocks. Terms
    that more than a ``LONG``-th of the examples hold (the ``LONG_TERMS`` most frequent at most) have a full row of weights in every block and
    their largest weight there; the postings of the others lie side by side. A vector is its term numbers, rising, and their weights; a
    dict of them is taken too.
    """

    def __init__(self, vectors: list, labels: list[int], idf: np.ndarray) -> None:
        self.labels = np.array(labels, "f8")
        self.idf = idf
        self.prior = (sum(labels) + 0.5 * (len(labels) > 0)) / (len(labels) + 1)
        self.levels: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
        pairs = [_arrays(v) for v in vectors]
        self.terms = np.concatenate([np.zeros(0, "i4"), *[t for t, _ in pairs]]).astype("i4")
        self.weights = np.concatenate([np.zeros(0), *[w for _, w in pairs]])
        self.ends = np.cumsum([0, *[len(t) for t, _ in pairs]])
        owners = np.repeat(np.arange(len(pairs), dtype="i4"), np.diff(self.ends))
        self.order = self._neighbours_together(pairs, self.terms, self.weights, owners)
        at = np.empty(len(pairs), "i4")
        at[self.order] = np.arange(len(pairs))
        self.blocks = max(1, -(-len(pairs) // BLOCK))
        counts = np.bincount(self.terms, minlength=len(idf))
        frequent = np.argsort(-counts, kind="stable")[:LONG_TERMS]
        frequent = np.sort(frequent[counts[frequent] > len(pairs) / LONG])
        self.row = np.full(len(idf), -1, "i4")
        self.row[frequent] = np.arange(len(frequent))
        short = np.flatnonzero(self.row[self.terms] < 0)
        short = short[np.argsort(self.terms[short], kind="stable")]
        self.places, self.short = at[owners[short]], self.weights[short].astype("f4")
        self.starts = np.searchsorted(self.terms[short], np.arange(len(idf) + 1)).astype("i4")
        self._long_terms()

    def _long_terms(self) -> None:
        at = np.empty(len(self.order), "i4")
        at[self.order] = np.arange(len(self.order))
        long = np.flatnonzero(self.row[self.terms] >= 0)
        rows, places = self.row[self.terms[long]], np.repeat(at, np.diff(self.ends))[long]
        self.slabs = np.zeros((self.blocks, int(self.row.max(initial=-1)) + 1, BLOCK), "f4")
        self.slabs[places // BLOCK, rows, places % BLOCK] = self.weights[long]
        self.maxima = np.ascontiguousarray(self.slabs.max(axis=2).T)

    def __getstate__(self) -> dict:
        """Full rows are large and quickly made again, so they do not travel."""
        return {name: value for name, value in self.__dict__.items() if name not in ("slabs", "maxima")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._long_terms()

    @staticmethod
    def _neighbours_together(pairs: list, terms: np.ndarray, weights: np.ndarray, owners: np.ndarray) -> np.ndarray:
        nearest, group = np.zeros(len(pairs)), np.zeros(len(pairs), "i4")
        vector = np.zeros(int(terms.max(initial=-1)) + 1)
        for k, seed in enumerate(range(0, len(pairs), max(1, len(pairs) // SEEDS))):
            vector[pairs[seed][0]] = pairs[seed][1]
            found = np.bincount(owners, weights * vector[terms], len(pairs))
            vector[pairs[seed][0]] = 0
            group[found > nearest] = k
            nearest = np.maximum(nearest, found)
        return np.lexsort((-nearest, group))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.idf[terms]
        terms, weights = terms[weights > 0], weights[weights > 0]
        return terms, weights / math.sqrt((weights * weights).sum() or 1.0)

    def nearest(self, vector, k: int = NEIGHBOURS, but: int = -1) -> list[tuple[float, int]]:
        """The k examples of highest positive cosine, ties to the smaller place; ``but`` is left out."""
        return self.nearest_of([vector], [but], k)[0]

    def nearest_of(self, vectors: list, buts: list[int], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """``nearest`` of every vector. ``QUERIES`` of them go through the blocks together."""
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(vectors), QUERIES):
            out += self._nearest([_arrays(v) for v in vectors[at : at + QUERIES]], buts[at : at + QUERIES], k)
        return out

    def _nearest(self, vectors: list, buts: list[int], k: int) -> list[list[tuple[float, int]]]:
        """The short lists are added up first. What a block holds of that at most and the maxima of its long terms bound every cosine in
        it: blocks are read by falling bound, first some, then all that can still reach the k-th cosine. These sums are rounded to four
        bytes; whatever comes within ``SLACK`` of the k-th is computed in full.
        """
        count, width = len(vectors), self.blocks * BLOCK
        terms = np.concatenate([t for t, _ in vectors])
        weights = np.concatenate([w for _, w in vectors])
        asks = np.repeat(np.arange(count), [len(t) for t, _ in vectors])
        rows = self.row[terms]
        long = rows >= 0
        asked = np.zeros((count, self.slabs.shape[1]), "f4")
        asked[asks[long], rows[long]] = weights[long]
        here, sizes = _ranges(self.starts[terms], self.starts[terms + 1])
        cells = np.repeat(asks * width, sizes) + self.places[here]
        sums = np.bincount(cells, self.short[here] * np.repeat(weights, sizes), count * width).astype("f4").reshape(count, width)
        at = np.empty(len(self.order), "i8")
        at[self.order] = np.arange(len(self.order))
        left = np.array(buts)
        mine = np.flatnonzero(left >= 0)
        sums[mine, at[left[mine]]] = -np.inf
        bounds = sums.reshape(count, self.blocks, BLOCK).max(axis=2) + asked @ self.maxima
        first = np.zeros((count, self.blocks), bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST_BLOCKS], True, axis=1)
        self._read(sums, asked, first)
        self._read(sums, asked, ~first & (bounds > 0) & (bounds >= self._least(sums, k)[:, None] - SLACK))
        out = []
        whole = np.zeros(len(self.idf))
        for (terms, weights), scores, least in zip(vectors, sums, self._least(sums, k), strict=True):
            found = self.order[np.flatnonzero(scores > max(0.0, least - SLACK))]
            if not len(found):
                out.append([])
                continue
            whole[terms] = weights
            here, sizes = _ranges(self.ends[found], self.ends[found + 1])
            exact = np.add.reduceat(self.weights[here] * whole[self.terms[here]], np.cumsum(sizes) - sizes)
            whole[terms] = 0
            best = np.lexsort((found, -exact))[:k]
            out.append([(min(1.0, s), place) for s, place in zip(exact[best].tolist(), found[best].tolist(), strict=True)])
        return out

    def _read(self, sums: np.ndarray, asked: np.ndarray, chosen: np.ndarray) -> None:
        for block in np.flatnonzero(chosen.any(axis=0)):
            rows = np.flatnonzero(chosen[:, block])
            sums[rows, block * BLOCK : (block + 1) * BLOCK] += asked[rows] @ self.slabs[block]

    @staticmethod
    def _least(sums: np.ndarray, k: int) -> np.ndarray:
        """A bound below the k-th cosine of every vector."""
        if sums.shape[1] < k:
            return np.zeros(len(sums))
        return np.maximum(0.0, np.partition(sums, sums.shape[1] - k, axis=1)[:, -k])

    def vote(self, near: list[tuple[float, int]]) -> float:
        weight, toxic = PRIOR_WEIGHT, PRIOR_WEIGHT * self.prior
        for cosine, place in near:
            w = 1 / (1 - cosine + NEAR)
            weight, toxic = weight + w, toxic + w * self.labels[place]
        return toxic / weight

    def calibrate(self, vectors: list) -> None:
        """Pool adjacent violators over leave-one-out votes."""
        votes = np.array([self.vote(near) for near in self.nearest_of(vectors, list(range(len(vectors))))])
        groups: list[list[float]] = []  # highest vote, sum of labels, examples
        for at in np.argsort(votes, kind="stable"):
            if groups and groups[-1][0] == votes[at]:
                groups[-1][1] += self.labels[at]
                groups[-1][2] += 1
            else:
                groups.append([votes[at], self.labels[at], 1])
            while len(groups) > 1 and groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2]:
                high, total, n = groups.pop()
                groups[-1] = [high, groups[-1][1] + total, groups[-1][2] + n]
        means = [(g[1] + 0.02) / (g[2] + 0.2) for g in groups]
        self.levels = np.array([g[0] for g in groups]), np.array(means)

    def score(self, vote: float) -> float:
        tops, means = self.levels
        if not len(tops):
            return 0.0
        return float(np.interp(vote, tops, means))


def fit_index(documents: DataFrame, labels: DataFrame) -> tuple[pa.Array, ExampleIndex, list[int]]:
    """Terms by number, index and example ids; what comes to the driver is bounded by the words of EXAMPLES texts.

    The driver keeps terms packed; each task makes its own dict of them.
    """
    fitted = _fit_index(documents, labels)
    tidy("fit_index")  # what the fit took goes back before the index is pickled
    return fitted


def _numbers(terms: pa.Array) -> dict[bytes, int]:
    return {term: i for i, term in enumerate(terms.to_pylist())}


def _fit_index(documents: DataFrame, labels: DataFrame) -> tuple[pa.Array, ExampleIndex, list[int]]:
    labelled = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = labelled.where(fold("doc_id", FOLDS) != HELD_OUT)
    chosen = training.join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    wanted = {row[0]: int(row[1] > 0) for row in chosen.collect()}
    spark = documents.sparkSession
    picked = spark.createDataFrame(list(wanted.items()), "doc_id long, toxic int")
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    totals = [sum(1 - y for y in wanted.values()), sum(wanted.values())]

    def tally(batches: Iterator[dict]) -> Iterator[dict]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                seen[label].update(term_counts(text).keys())
        terms = list(seen[0] | seen[1])
        yield {"term": terms, "clean": [seen[0][t] for t in terms], "dirty": [seen[1][t] for t in terms]}

    tallied = map_rows(texts, [utf8(), "toxic"], "term binary, clean long, dirty long", tally)
    # chi-square of the 2 x 2 table, and how many times more frequent the term is on one side
    a, b, n0, n1 = F.sum("dirty"), F.sum("clean"), float(totals[0]), float(totals[1])
    n = n0 + n1
    chi = n * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n - a - b) * n0 * n1 + 1e-9)
    lift = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
    telling = F.when((lift > LIFT) | (lift < 1 / LIFT), F.least(F.lit(1.0), chi / CHI_SQUARE)).otherwise(0.0)
    found = tallied.groupBy("term").agg((1 + TELLING * telling).alias("weight")).orderBy("term").toArrow()
    terms = pa.concat_arrays(found["term"].chunks) if len(found) else pa.array([], pa.binary())
    idf = _inverse_frequencies(documents, terms) * found["weight"].to_numpy()

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        numbers = _numbers(terms)
        for batch in batches:
            known = [_known(text, numbers) for text in batch["text"]]
            yield {"doc_id": batch["doc_id"], "terms": [t.tobytes() for t, _ in known], "counts": [n.tobytes() for _, n in known]}

    rows = map_rows(texts, ["doc_id", utf8()], "doc_id long, terms binary, counts binary", count).orderBy("doc_id").toArrow()
    index = ExampleIndex([], [], idf)
    packed = zip(rows["terms"].to_pylist(), rows["counts"].to_pylist(), strict=True)
    vectors = [index.vector(np.frombuffer(numbers, "i4"), np.frombuffer(counts, "i4")) for numbers, counts in packed]
    ids = rows["doc_id"].to_pylist()
    del found, rows
    index = ExampleIndex(vectors, [wanted[i] for i in ids], idf)
    index.calibrate(vectors)
    return terms, index, ids


def _ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and the length of each range."""
    sizes = stops - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes), sizes


def _arrays(vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        terms = sorted(vector)
        return np.array(terms, "i4"), np.array([vector[t] for t in terms], "f8")
    return vector


def _known(text: bytes | None, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known terms of a text, rising, and their counts."""
    words = Counter(text.lower().split()) if text else {}
    found = np.array([numbers.get(word.strip(PUNCTUATION), -1) for word in words], "i4")
    counts = np.fromiter(words.values(), "i4", len(words))
    order = np.argsort(found, kind="stable")[np.count_nonzero(found < 0) :]
    found = found[order]
    at = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else order
    return found[at], (np.add.reduceat(counts[order], at) if len(at) else counts[order]).astype("i4")


def _inverse_frequencies(documents: DataFrame, terms: pa.Array) -> np.ndarray:
    """ln((1 + documents) / (1 + documents with the term)) over all documents; counts travel packed, ``PART`` terms a row."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        seen, numbers = np.zeros(len(terms) + 1, "i8"), _numbers(terms)
        for batch in batches:
            for text in batch["text"]:
                seen[-1] += 1
                if text:
                    found = {numbers.get(word.strip(PUNCTUATION), -2) for word in set(text.lower().split())} - {-2}
                    seen[np.fromiter(found, "i8", len(found))] += 1
        parts = [at for at in range(0, len(seen), PART) if seen[at : at + PART].any()]
        yield {"part": parts, "counts": [seen[at : at + PART].tobytes() for at in parts]}

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(counts, "i8") for counts in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sent = map_rows(documents, [utf8()], "part int, counts binary", run)
    found = np.zeros(len(terms) + 1, "i8")
    for part, counts in sent.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        found[part : part + PART] = np.frombuffer(counts, "i8")
    return np.log((1 + found[-1]) / (1 + found[:-1]))


class Scorer:
    """Score and neighbours of texts, those of a batch together; texts seen lately are not searched again."""

    def __init__(self, terms: pa.Array, index: ExampleIndex, ids: list[int]) -> None:
        self.index, self.ids = index, ids
        self.own = {doc_id: place for place, doc_id in enumerate(ids)}
        self.cache, self.numbers = BoundedCache(RESULTS), _numbers(terms)

    def __call__(self, doc_ids: list[int | None], texts: list[bytes | None]) -> list[tuple[float, list[int]]]:
        keys = [(hashlib.md5(text or b"").digest(), self.own.get(doc_id, -1)) for doc_id, text in zip(doc_ids, texts, strict=True)]
        new = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.cache}
        found = {key: self.cache[key] for key in keys if key not in new}
        vectors = [self.index.vector(*_known(text, self.numbers)) for text in new.values()]
        for key, near in zip(new, self.index.nearest_of(vectors, [own for _, own in new]), strict=True):
            found[key] = self.index.score(self.index.vote(near)), [self.ids[place] for _, place in near]
            self.cache.room()
            self.cache[key] = found[key]
        return [found[key] for key in keys]


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the evidence, for every row."""
    terms, index, ids = fit_index(documents, labels)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        scorer = Scorer(terms, index, ids)
        for batch in batches:
            found = scorer(batch["doc_id"], batch["text"])
            scores = [score for score, _ in found]
            predicted = [int(s >= THRESHOLD) for s in scores]
            yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": predicted, "evidence": [e for _, e in found]}

    columns = ["doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), utf8()]
    return map_rows(documents, columns, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>", run)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    terms, index, ids = fit_index(documents, labels)

    def run(batches):
        tidy("without_toxic")
        scorer = Scorer(terms, index, ids)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            kept = [score < THRESHOLD for score, _ in scorer(batch.column("doc_id").to_pylist(), texts)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))
