"""Operators on documents against plain Python, on edge rows and on the given tables."""

from __future__ import annotations

import math
import os
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import components, fold, repeats, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairwright.llm import jaccard_join, lattice, packing, quality, secrets, sentencepiece_bpe, suffix_dedup, toxicity
from pairwright.llm.text import keep
from pairwright.sources.tables import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, block string, word string"
BASE = "one two three four five six seven eight nine ten eleven twelve"
EDGE = [
    (0, None), (1, ""), (2, " \n\t "), (3, BASE), (4, BASE.upper()), (5, BASE + " x"), (6, "x" * 1000), (7, "ab" * 300), (8, "é" * 150 + " ▁ \x00 𝄞"),
    (9, "Word " * 3000), (10, "a b c"), (11, "A b C"), (12, "<s> <|endoftext|> don't"), (13, BASE + " " + BASE),
]


def frame(spark, rows, **other):
    """Rows with the other columns of documents and columns whose names clash with the operators' own."""
    lang, source = other.get("lang"), other.get("source")
    full = [(i, t, lang, source, None if t is None else len(t), "k", "r", "b", "w") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def given(spark):
    found = table(spark, FOLDER, "documents")
    return found, [(row["doc_id"], row["text"]) for row in found.collect()]


def bag(found):
    return sorted(map(tuple, found.collect()), key=str)


# --- repeats -------------------------------------------------------------------------------------------------------


def test_repeats_of_edge_rows(spark):
    draw = random.Random(3)
    parts = ["".join(draw.choice("ab é") for _ in range(400)) for _ in range(4)]
    rows = [
        *EDGE, (20, parts[0]), (21, parts[0]), (22, "q" + parts[1] + "z"), (23, "rrr" + parts[1][20:]), (24, parts[2][:199]), (25, parts[2][:199] + "!"),
        (26, parts[3] + parts[3]), (27, "x" * 199), (28, "y" * 200), (29, "x" * 205 + "y"), (30, parts[1][:250] + parts[2][:260]), (None, parts[2]), (20, parts[0]),
    ]
    found = suffix_dedup.dedup_documents(frame(spark, rows))
    assert bag(found) == sorted(repeats(rows), key=str)


def test_repeats_of_the_given_table(spark):
    documents, rows = given(spark)
    assert bag(suffix_dedup.dedup_documents(documents)) == sorted(repeats(rows), key=str)


def test_cut_texts_keep_their_columns(spark):
    rows = [(1, "left " + "é" * 150 + "a" * 100), (2, "é" * 150 + "a" * 100 + " right"), (3, None), (4, "clean")]
    documents = frame(spark, rows)
    found = suffix_dedup.without_repeats(documents)
    assert found.columns == documents.columns
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: "left ", 2: " right", 3: None, 4: "clean"}


def test_no_rows(spark):
    documents, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert suffix_dedup.dedup_documents(documents).isEmpty()
    assert jaccard_join.join_components(documents).isEmpty()
    assert packing.pack_documents(documents, path).isEmpty()
    assert sentencepiece_bpe.encoding_digests(documents, model).isEmpty()
    assert lattice.score_documents(documents, model).isEmpty()
    assert toxicity.score_documents(documents, labels).isEmpty()
    assert quality.judge(documents, labels).isEmpty()
    assert secrets.scan(documents, "source").isEmpty()


# --- Jaccard join --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1_000_000, 3_000])
def test_components_of_the_given_table(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    documents, rows = given(spark)
    assert set(map(tuple, jaccard_join.join_components(documents).collect())) == components(rows)


def test_components_of_edge_rows(spark):
    found = jaccard_join.join_components(frame(spark, [*EDGE, (None, BASE), (3, BASE)]))
    expected = {(i, n, c) for i, n, c in components(EDGE)} | {(None, 8, None)}
    assert set(map(tuple, found.collect())) == expected
    assert found.count() == len(EDGE) + 2


def test_quoted_near_copies_in_other_tasks(spark, monkeypatch):
    # as in a sample that holds none of these texts
    monkeypatch.setattr(jaccard_join, "SAMPLE_DF", 1_000)
    draw, rows = random.Random(5), []
    for i in range(150):
        short, near, long = 3 * i, 3 * i + 1, 3 * i + 2
        text = [f"q{i}x{j}" for j in range(44)]
        filler = [f"f{draw.randrange(10**9)}" for _ in range(400)]
        rows += [(short, " ".join(text)), (near, " ".join([*text[:-1], "end"])), (long, " ".join([*filler, *text]))]
    # each quoting text lies beside one of its two near copies
    placed = [(rows[k], (k // 3 if k % 3 == 2 else k // 3 + k % 3 + k // 6) % 2) for k in range(len(rows))]
    documents = frame(spark, [row for row, _ in placed]).join(spark.createDataFrame([(row[0], part) for row, part in placed], "doc_id long, part int"), "doc_id")
    documents = documents.repartitionByRange(2, "part").drop("part")
    assert set(map(tuple, jaccard_join.join_components(documents).collect())) == components(rows)


@pytest.mark.parametrize("block", [1_000_000, 2_000])
def test_components_of_chains_and_a_large_family(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    draw = random.Random(8)
    base = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    rows = [(1000 + i, " ".join(base[:-1] + [f"tail{i}"])) for i in range(120)]
    chain = list(base)
    for i in range(40):
        chain = chain[1:] + [f"c{i}"]
        rows.append((2000 + i, " ".join(chain)))
    rows += [(i, " ".join(f"u{draw.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    draw.shuffle(rows)
    found = jaccard_join.join_components(frame(spark, rows))
    assert set(map(tuple, found.collect())) == components(rows)


def test_linking_equals_all_pairs():
    draw = random.Random(2)
    pool = [draw.getrandbits(64) for _ in range(400)]
    sets = []
    for _ in range(60):
        core = draw.sample(pool, draw.randrange(1, 60))
        sets += [np.unique(np.array(core[: len(core) - draw.randrange(len(core))] + [draw.getrandbits(64)], "u8")) for _ in range(3)]
    expected = np.arange(len(sets))
    for a in range(len(sets)):
        for b in range(a):
            if jaccard_join.linked(sets[a], sets[b]):
                expected[expected == max(expected[a], expected[b])] = min(expected[a], expected[b])
    assert jaccard_join.link_sets(sets, np.arange(len(sets))).tolist() == expected.tolist()


def test_a_passage_of_many_documents_makes_no_large_group(spark, monkeypatch):
    # as in a sample that holds none of these texts: a passage joins all documents, a chapter the ten of a group, which link in pairs
    monkeypatch.setattr(jaccard_join, "SAMPLE_DF", 1_000)
    draw, rows = random.Random(4), []
    some = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    passage = some(30)
    for group in range(40):
        chapter = some(80)
        for pair in range(5):
            text = [*passage, *chapter, *some(120)]
            rows += [(100 * group + 2 * pair, " ".join(text)), (100 * group + 2 * pair + 1, " ".join([*text[:-4], *some(4)]))]
    documents = frame(spark, rows)
    sets = jaccard_join.document_sets(documents)
    nodes = sets.select("doc_id", "node", F.col("n_shingles").alias("n"))
    members = jaccard_join.hub_members(jaccard_join.hub_edges(documents, sets, nodes), nodes)
    sizes = [row["count"] for row in members.groupBy("hub").count().collect()]
    assert max(sizes) < 40 and sum(sizes) < 3 * len(rows)
    assert set(map(tuple, jaccard_join.join_components(documents).collect())) == components(rows)


@pytest.mark.parametrize("tokens", [600_000, 500])
def test_a_few_shingles_in_common_make_no_rows(spark, monkeypatch, tokens):
    # every text has one phrase in common with another, which is too little for a link; ten pairs link; 500 makes many buckets
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", tokens)
    draw, rows = random.Random(9), []
    some = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    for pair in range(100):
        phrase, text = some(5), some(120)
        rows += [(2 * pair, " ".join([*text, *phrase])), (2 * pair + 1, " ".join([*some(120), *phrase]))]
        if pair < 10:
            rows.append((1000 + pair, " ".join([*text, "end"])))
    documents = frame(spark, rows)
    sets = jaccard_join.document_sets(documents)
    nodes = sets.select("doc_id", "node", F.col("n_shingles").alias("n"))
    edges = jaccard_join.hub_edges(documents, sets, nodes)
    linking = {row["node"] for row in nodes.collect() if row["doc_id"] >= 1000 or row["doc_id"] < 20 and row["doc_id"] % 2 == 0}
    assert {row["u"] for row in edges.collect()} == linking
    assert set(map(tuple, jaccard_join.join_components(documents).collect())) == components(rows)


def test_blocks_of_a_family_send_only_what_their_leader_leaves(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 12_000)
    draw = random.Random(6)
    base = [f"w{draw.randrange(10**9)}" for _ in range(80)]
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(200)]
    held, reaching = [], jaccard_join._reaching
    monkeypatch.setattr(jaccard_join, "_reaching", lambda sets: held.append(sets) or reaching(sets))
    assert set(map(tuple, jaccard_join.join_components(frame(spark, rows)).collect())) == components(rows)
    assert not held  # all are one component with the leader of their block
    # half of them quote too little of it to link with the rest
    rows += [(1000 + i, " ".join([*base[:55], *[f"other{j}" for j in range(20)], f"end{i}"])) for i in range(60)]
    assert set(map(tuple, jaccard_join.join_components(frame(spark, rows)).collect())) == components(rows)


def test_links_are_written_before_components_are_joined(spark, monkeypatch):
    # a task that finds links and joins components holds two Python workers, which an executor of the pipeline has no room for
    monkeypatch.setattr(jaccard_join, "BLOCK", 12_000)
    base, seen, joined = [f"w{i}" for i in range(80)], [], jaccard_join.components
    rows = [(i, " ".join([*base, f"tail{i}"])) for i in range(60)]
    rows += [(1000 + i, " ".join([*base[:55], *[f"other{j}" for j in range(20)], f"end{i}"])) for i in range(60)]
    monkeypatch.setattr(jaccard_join, "components", lambda edges: seen.append(edges) or joined(edges))
    jaccard_join.join_components(frame(spark, rows))
    plans = [edges._jdf.queryExecution().toString() for edges in seen]
    assert plans and not any("InArrow" in plan or "InPandas" in plan for plan in plans)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, BASE), (3, BASE.upper()), (8, "other words here"), (None, BASE), (8, "other words here")]
    found = jaccard_join.one_of_each(frame(spark, rows))
    assert bag(found.select("doc_id", "text")) == sorted([(3, BASE.upper()), (8, "other words here"), (None, BASE)], key=str)


# --- tokenizers ----------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    own, library = sentencepiece_bpe.PieceCodec.load(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    draw = random.Random(1)
    texts = [t or "" for _, t in EDGE] + [t for _, t in given(spark)[1]]
    texts += ["".join(draw.choice(" abethnio\n\t▁é世界𝄞0<>x  ") for _ in range(draw.randrange(80))) for _ in range(2000)]
    texts += ["  ", " " * 40, "a" * 3000, "the" * 800, "<0x0A><s>\x00"]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)


def test_piece_digests_of_edge_rows(spark):
    import hashlib

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = []
    for doc_id, text in [*EDGE, (None, "x")]:
        ids = library.encode(text or "", add_eos=True)
        digests = [hashlib.sha256(v.encode()).hexdigest() for v in (" ".join(map(str, ids)), library.decode(ids))]
        expected.append((doc_id, len(ids), *digests))
    documents = frame(spark, [*EDGE, (None, "x")])
    assert bag(sentencepiece_bpe.encoding_digests(documents, path)) == sorted(expected, key=str)
    round_trip = sentencepiece_bpe.encode_documents(documents.where("doc_id in (3, 9)"), path).select("text", "decoded").collect()
    assert all(row["text"] == row["decoded"] for row in round_trip)


def best_fit(lengths, capacity):
    """Best-fit decreasing, one piece at a time."""
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps[gaps.index(min(fits))] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_packing_the_given_table(spark):
    import zlib

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [*given(spark)[1], *[(None if i == 0 else 10_000 + i, t) for i, t in EDGE]]
    expected = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected.append((doc_id, piece, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack_documents(frame(spark, rows), path).collect()
    assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(expected, key=str)
    at: dict[int, int] = {}
    for row in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == at.get(row["sequence_id"], 0)
        at[row["sequence_id"]] = row["offset"] + row["length"]
    assert max(at.values()) <= 2048
    assert len(at) <= best_fit([e[3] for e in expected], 2048)


def test_runs_pack_as_well_as_single_pieces():
    draw = random.Random(4)
    for _ in range(50):
        lengths = [draw.randrange(1, 101) for _ in range(draw.randrange(1, 300))]
        runs = packing.match_runs(Counter(lengths), 100)
        assert sum(r[2] for r in runs) == len(lengths)
        assert len({r[3] + i for r in runs for i in range(r[2])}) == best_fit(lengths, 100)


# --- scores --------------------------------------------------------------------------------------------------------


def test_lattice_scores_by_hand(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as file:
        pieces, byte_ids, first = lattice.read_vocabulary(file.read())
    ids = {piece: i for i, piece in enumerate(pieces) if piece}
    rows = [*given(spark)[1][:40], *[(None if i == 0 else 10_000 + i, t) for i, t in EDGE], (10_003, BASE)]
    training = [(i, t) for i, t in rows if fold(i, 5) != 1]
    counts = Counter(w.lower() for _, t in training for w in words(t))
    tokens, distinct = sum(counts.values()) + len(training), len(counts) + 1

    def paths(word, logs):
        text = "▁" + word.decode()
        total = [1.0] + [0.0] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 16), end):
                if text[start:end] in ids:
                    total[end] += total[start] * math.exp(logs[ids[text[start:end]]])
                elif end - start == 1:
                    total[end] += total[start] * math.exp(sum(logs[byte_ids[b]] for b in text[start].encode()))
        return math.log10(total[-1])

    model, uses = lattice.Lattice(pieces, byte_ids, first), np.full(len(first), 0.5)
    for word, n in counts.items():
        model.expect(word, n, uses)
    total = uses.sum() + len(training) + 0.5
    logs, end = np.log(uses / total), math.log10((len(training) + 0.5) / total)
    short = {w for _, t in rows for w in words(t) if len(w) < 60}
    word_score = {w.lower(): paths(w.lower(), logs) for w in short}
    found = lattice.score_documents(frame(spark, rows), path).collect()
    assert len(found) == len(rows)
    by_id = {row["doc_id"]: row for row in found}
    for doc_id, text in rows:
        row, mine = by_id[doc_id], [w.lower() for w in words(text)]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (fold(doc_id, 5) == 1, len(mine) + 1, tokens)
        assert row["n_known"] == sum(counts[w] > 0 for w in mine) + 1
        base = sum(math.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1))) for c in [*[counts[w] for w in mine], len(training)])
        assert row["base_score"] == pytest.approx(base)
        if all(w in word_score for w in mine):
            assert row["score"] == pytest.approx(sum(word_score[w] for w in mine) + end)


def test_expected_uses_equal_the_gradient():
    pieces = ["", "▁", "a", "b", "ab", "▁a", "ba"]
    logs = np.log(np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.2, 0.1]))
    uses = np.zeros(7)
    lattice.Lattice(pieces, {}, logs).expect(b"abab", 2.0, uses)
    for i in range(1, 7):
        up, down = logs.copy(), logs.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (lattice.Lattice(pieces, {}, up).forward(b"abab") - lattice.Lattice(pieces, {}, down).forward(b"abab")) / 2e-5
        assert uses[i] == pytest.approx(2 * slope, abs=1e-6)


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else FOLDER
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = toxicity.score_documents(documents, labels).join(labels, "doc_id").where("held_out")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    caught, missed = counts.get((1, 1), 0), counts.get((1, 0), 0)
    assert caught / (caught + missed) > 0.75
    assert counts.get((0, 1), 0) / (counts.get((0, 0), 0) + counts.get((0, 1), 0)) < 0.02
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()


def test_toxicity_of_edge_rows_ignores_other_columns(spark):
    labels = table(spark, FOLDER, "labels")
    documents = table(spark, FOLDER, "documents").withColumns({"key": F.lit("k"), "term": F.lit("t")})
    edge = frame(spark, [(100_000 + i, t) for i, t in EDGE] + [(None, "idiot")])
    both = documents.unionByName(edge, allowMissingColumns=True)
    found = toxicity.score_documents(both, labels)
    assert found.count() == both.count()
    assert found.where("score is null or score < 0 or score > 1").isEmpty()
    kept = toxicity.without_toxic(both, labels)
    assert kept.columns == both.columns
    assert kept.count() == found.where("predicted = 0").count()


def test_toxicity_finds_neighbours_without_telling_terms(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + " and") for i in range(60)]
    documents = frame(spark, [*rows, *[(100 + i, text + " other") for i, text in rows]])
    labels = spark.createDataFrame([(i, i % 6 // 5) for i, _ in rows], "doc_id long, toxic int")
    found = {r["doc_id"]: r["evidence"] for r in toxicity.score_documents(documents, labels).collect()}
    training = [i for i, _ in rows if fold(i, toxicity.FOLDS) != toxicity.HELD_OUT]
    assert training and all(found[100 + i][0] == i for i in training)


def test_exact_neighbours_equal_a_full_scan():
    draw = random.Random(6)
    vectors, labels = [], []
    for _ in range(500):
        weights = {draw.randrange(40): draw.random() for _ in range(draw.randrange(6))}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        vectors.append({t: w / norm for t, w in weights.items()})
        labels.append(draw.randrange(2))
    index = toxicity.ExampleIndex(vectors, labels, np.ones(40))
    for vector in vectors[:100]:
        if vector:
            scores = [sum(w * other.get(t, 0.0) for t, w in vector.items()) for other in vectors]
            best = sorted(((-s, i) for i, s in enumerate(scores) if s > 0), key=lambda x: (round(x[0], 12), x[1]))[:15]
            found = index.nearest(vector)
            assert [round(s, 9) for s, _ in found] == [round(-s, 9) for s, _ in best]


def test_quality_bounds_are_exact():
    for n, k, p in ((50, 3, 0.1), (200, 0, 0.01), (10, 10, 0.5), (1000, 25, 0.03)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_quality_rejects_few_good_documents_and_many_bad_ones(spark):
    good = [(i, " ".join(f"word{i}x{j}" for j in range(30)), "en") for i in range(2000)]
    bad = [(5000 + i, " ".join(f"junk{i}x{j}###" for j in range(30)), "en") for i in range(200)]
    other = [(9000, " ".join(f"junk{j}###" for j in range(30)), None)]
    documents = spark.createDataFrame([*good, *bad, *other], "doc_id long, text string, lang string")
    labels = documents.select("doc_id", (F.col("doc_id") < 5000).cast("int").alias("quality"))
    found = {r["doc_id"]: r["kept"] for r in quality.judge(documents, labels).collect()}
    assert all(found[i] for i, _, _ in good)
    assert not any(found[i] for i, _, _ in bad)
    assert found[9000]  # a stratum without labels has no cutoff


def test_quality_counts_of_edge_rows(spark):
    labels = spark.createDataFrame([(3, None, 0)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.judge(frame(spark, [*EDGE, (None, BASE)]), labels).collect()}
    assert len(found) == len(EDGE) + 1
    assert found[0]["base_failed"] and found[0]["n_words"] == 0 and not found[0]["kept"]
    assert (found[9]["n_words"], found[9]["n_repeat_words"], found[9]["base_failed"]) == (3000, 3000, True)
    assert (found[13]["n_repeat_words"], found[3]["kept"]) == (24, True)


# --- secrets -------------------------------------------------------------------------------------------------------


def test_secrets_are_found_and_redacted(spark):
    draw = random.Random(5)
    def value(n):
        return "".join(draw.choice("0123456789abcdef") for _ in range(n))

    rows = []
    for i in range(400):
        kind = i % 4
        text = [f'here token = "{value(40)}" and more', f"some password={value(18)} here", f"a number 46{draw.randrange(10**14):014d} here", f"build v{value(30)} of it"][kind]
        rows.append((i, "plain words around it. " * 3 + text))
    documents = frame(spark, rows, source="src/a")
    found = secrets.scan(documents, "source")
    verdicts = {(r["doc_id"] % 4, r["is_secret"]) for r in found.collect()}
    assert verdicts == {(0, True), (1, True), (2, False), (3, False)}
    safe = secrets.redact(documents, "source")
    assert safe.columns == documents.columns
    by_id = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert all(("[secret]" in by_id[i]) == (i % 4 < 2) for i, _ in rows)
    assert all(by_id[i] == t for i, t in rows if i % 4 > 1)


def test_secrets_of_edge_rows(spark):
    rows = [*EDGE, (None, "password=abcdef1234567890")]
    assert secrets.redact(frame(spark, rows), "source").count() == len(rows)
    given_labels = spark.createDataFrame([([1.0] * len(secrets.FEATURES), 0.0)], "features array<double>, label double")
    only_clean = secrets.scan(frame(spark, rows), "source", given_labels)
    assert only_clean.where("is_secret").isEmpty() and not only_clean.isEmpty()


def test_toxicity_search_of_a_batch_reads_few_blocks_and_loses_no_neighbour():
    draw = random.Random(16)
    vectors, labels = [], []
    for i in range(4_000):
        topic = 100 + 30 * (i % 12)
        terms = {*draw.sample(range(20), 8), *draw.sample(range(topic, topic + 30), 10)}
        weights = {t: (0.1 if t < 20 else 1.0) * (0.5 + draw.random()) for t in terms}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append({t: w / norm for t, w in weights.items()})
        labels.append(draw.randrange(2))
    index = toxicity.ExampleIndex(vectors, labels, np.ones(500))
    read, step = [], index._read
    index._read = lambda sums, asked, chosen: (read.append(int(chosen.sum())), step(sums, asked, chosen))
    asked = [*range(0, 4_000, 40)]
    found = index.nearest_of([vectors[i] for i in asked], asked)
    assert sum(read) < len(asked) * index.blocks / 2
    whole = np.zeros((4_000, 500))
    for row, vector in zip(whole, vectors, strict=True):
        row[list(vector)] = list(vector.values())
    for i, near in zip(asked, found, strict=True):
        scores = whole @ whole[i]
        scores[i] = -1
        best = sorted(((-s, j) for j, s in enumerate(scores.tolist()) if s > 0), key=lambda x: (round(x[0], 12), x[1]))[:15]
        assert [j for _, j in near] == [j for _, j in best]
    assert index.nearest({499: 1.0}) == [] and index.nearest({}) == []


def test_segments_are_aligned_in_little_memory():
    draw = np.random.default_rng(9)
    sizes = draw.integers(200, 351, 20_000)
    shifts, order = 350 - sizes, draw.permutation(20_000)
    flat = draw.integers(0, 256, sizes.sum()).astype("u1")
    tracemalloc.start()
    matrix = suffix_dedup.aligned(flat, sizes, shifts, order, 350)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * matrix.nbytes
    starts = np.cumsum(sizes) - sizes
    for row, segment in list(enumerate(order))[::97]:
        assert (matrix[row, : shifts[segment]] == -1).all()
        assert (matrix[row, shifts[segment] :] == flat[starts[segment] : starts[segment] + sizes[segment]]).all()


def test_seeds_are_dealt_evenly():
    found = suffix_dedup.segments_of(np.random.default_rng(3).integers(0, 256, 300_000).astype("u1"))
    counts = np.bincount(suffix_dedup.seed_bucket(found["seed"], 20), minlength=20)
    assert counts.max() < 2 * counts.mean()
    assert np.bincount(suffix_dedup._bucket(found["seed"], 20), minlength=20).max() > 10 * counts.mean()


def test_prefix_shingles_are_dealt_evenly():
    none = np.zeros(0, "u8")
    sets = [np.unique(np.random.default_rng(i).integers(0, 1 << 64, 400, "u8")) for i in range(60)]
    tokens = np.concatenate([jaccard_join.prefix(s, none, none) for s in sets])
    counts = np.bincount(jaccard_join.token_bucket(tokens, 20), minlength=20)
    assert counts.min() > 0.8 * counts.mean() and counts.max() < 1.2 * counts.mean()

def test_pipeline_gives_back_what_a_stage_held(spark, monkeypatch):
    import corpus_pipeline

    held = keep({})

    def stage(spark, docs, folder):
        held["fit"] = 1
        return docs.limit(3)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage)])
    assert corpus_pipeline.run(spark, FOLDER).count() == 3
    assert not held
