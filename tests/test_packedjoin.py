"""The packed prefix join against brute force, with copies over labels, and what it shuffles."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import packedjoin, similarity


def brute(sets, general, labelled):
    out = set()
    for label in {"all", *(label for label, _ in sets.values())}:
        first = {}
        for owner in sorted(sets):
            if sets[owner][1] and label in ("all", sets[owner][0]):
                first.setdefault(sets[owner][1], []).append(owner)
        out |= {(label, owners[0], other, len(s), len(s), len(s)) for s, owners in first.items() for other in owners[1:]}
        for (s, (a, *_)), (t, (b, *_)) in itertools.combinations(sorted(first.items(), key=lambda item: item[1]), 2):
            if len(s & t) * packedjoin.PPM >= (general if label == "all" else labelled) * len(s | t):
                out.add((label, a, b, len(s), len(t), len(s & t)))
    return out


@pytest.mark.parametrize(("general", "labelled"), [(550_000, 700_000), (300_000, 200_000), (1_000_000, 1_000_000)])
def test_equals_brute_force(spark, monkeypatch, general, labelled):
    monkeypatch.setattr(packedjoin, "PACK_TOKENS", 200)
    monkeypatch.setattr(packedjoin, "BUCKET_TOKENS", 100)
    draw = random.Random(general)
    sets = {}
    for owner in range(200):
        base = sets[draw.randrange(owner)][1] if owner and draw.random() < 0.6 else set(draw.sample(range(400), draw.randrange(1, 40)))
        tokens = {t for t in base if draw.random() < 0.95} | set(draw.sample(range(400), draw.randrange(0, 3)))
        sets[owner] = (draw.choice(["x", "y", None]), frozenset(tokens))
    sets |= {500 + k: ("x" if k % 3 else "y", frozenset({7, 8, 9})) for k in range(30)} | {900: ("x", frozenset())}
    rows = [(owner, label, [*s, *s]) for owner, (label, s) in sets.items()] + [(None, "x", [7, 8, 9]), (901, "x", None)]
    frame = spark.createDataFrame(rows, "owner long, label string, ids array<long>").repartition(5)
    found = packedjoin.similar_documents(frame, "ids", lambda ids: F.transform(ids, lambda i: F.xxhash64(i)), general, labelled, "all")
    got = [tuple(r) for r in found.select("label", "left", "right", "n_left", "n_right", "n_both").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sets, general, labelled)


def test_no_shingle_is_a_shuffled_row(spark, monkeypatch):
    """Documents that share nothing write less than a row for each of their shingles: none of their tokens leaves the packs."""
    made = []
    keep = packedjoin.Rounds.keep

    def counted(rounds, frame, forget=True):
        frame = keep(rounds, frame, forget)
        made.append(frame.count())
        return frame

    monkeypatch.setattr(packedjoin.Rounds, "keep", counted)
    monkeypatch.setattr("pairwright.operators.setjoin.Rounds.keep", counted)
    docs = [(d, "en", " ".join(f"w{d}x{i}" for i in range(100))) for d in range(50)] + [(60, "en", " ".join(f"w7x{i}" for i in range(99)))]
    frame = spark.createDataFrame(docs, "app long, lang string, text string")
    found = similarity.shingle_similarity(frame, "app", "lang", "text")
    assert sorted(map(tuple, found.collect())) == [("all", 7, 60, 96, 95, 95, 989583), ("en", 7, 60, 96, 95, 95, 989583)]
    assert max(made) <= 2 * len(docs)


def test_label_of_everything(spark):
    docs = [(1, "all", "a b c d e f"), (2, "en", "a b c d e f"), (3, None, "a b c d e f")]
    frame = spark.createDataFrame(docs, "app long, lang string, text string")
    found = similarity.shingle_similarity(frame, "app", "lang", "text")
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("all", 1, 2), ("all", 1, 3)]


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    """A passage outside the sample stands in prefixes like any text; sets that have little else in common are no candidates for it."""
    monkeypatch.setattr(packedjoin, "SAMPLE", 1)
    passage = [f"p{i}" for i in range(20)]
    docs = [(d, "en", " ".join([f"w{d}x{i}" for i in range(100)] + passage)) for d in range(60)]
    docs += [(60, "en", " ".join([f"w7x{i}" for i in range(2, 100)] + passage)), (61, "en", docs[9][2] + " more")]
    frame = spark.createDataFrame(docs, "owner long, label string, text string").repartition(3)
    tokens = similarity.shingle_hashes(F.col("text"))
    index = packedjoin.prefix_index(frame, tokens, 60 * 116, 550_000)
    assert packedjoin.candidates(index, 550_000).count() == 2
    found = packedjoin.similar_documents(frame, "text", similarity.shingle_hashes, 550_000, 700_000, "all")
    assert sorted(tuple(r)[:3] for r in found.collect()) == [("all", 7, 60), ("all", 9, 61), ("en", 7, 60), ("en", 9, 61)]


@pytest.mark.parametrize("tokens", [4_000_000, 20_000])
def test_a_text_does_not_travel_with_each_of_its_pairs(spark, monkeypatch, tokens):
    monkeypatch.setattr(packedjoin, "CELL_TOKENS", tokens, raising=False)
    draw = random.Random(3)
    base = [f"{draw.getrandbits(64):x}" for _ in range(200)]
    docs = [(d, "en", " ".join([*(f"{draw.getrandbits(64):x}" for _ in range(30)), *base])) for d in range(100)]
    frame = spark.createDataFrame(docs, "app long, lang string, text string").repartition(4)
    size = sum(len(text) for _, _, text in docs)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    setting = "spark.sql.autoBroadcastJoinThreshold"
    threshold, before = spark.conf.get(setting), written()
    spark.conf.set(setting, "-1")
    try:
        assert similarity.shingle_similarity(frame, "app", "lang", "text").count() == 2 * 100 * 99 // 2
    finally:
        spark.conf.set(setting, threshold)
    assert written() - before < 8 * size
