"""Neighbours, archives, components and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import uuid

import duckdb
import numpy as np
import pytest

from pairwright.llm import components, neighbours, warc
from pairwright.llm.catalogue import QUERIES, TWINS
from pairwright.sources.tables import table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def exact(rows, k=10):
    usable = [(i, np.array(v, "f8")) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, vector in usable:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - vector) ** 2).sum())), i) for i, v in usable if i != q and len(v) == len(vector))
            out[q] = near[:k]
    return out


@pytest.mark.parametrize("cell", [20_000, 100])
def test_neighbours_of_the_given_table(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    vectors = table(spark, FOLDER, "embeddings")
    expected = exact([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    found: dict = {}
    for row in neighbours.nearest_neighbours(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append((row["score"], row["vec_id"], row["rank"]))
    assert found.keys() == expected.keys()
    hits = total = 0
    for q, near in expected.items():
        assert [r for _, _, r in found[q]] == list(range(1, 11))
        assert [(s, i) for s, i, _ in found[q]] == sorted((s, i) for s, i, _ in found[q])
        hits += len({i for _, i in near} & {i for _, i, _ in found[q]})
        total += len(near)
    assert hits / total >= 0.9


def test_neighbours_of_edge_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [1.0, 2.0]), (5, [1.0, 2.0]), (7, [0.0, 0.0]), (8, None), (9, [1.0, None]), (10, [1.0, float("nan")]),
            (11, [float("inf"), 1.0]), (None, [1.0, 2.0]), (3, [4.0, 6.0]), (200, [1.0, 2.0, 3.0]), (12, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, ids int, vector string")
    found = sorted(map(tuple, neighbours.nearest_neighbours(frame).collect()))
    assert found == [(0, 1, 5, 0.0), (0, 2, 100, 0.0), (0, 3, 3, 5.0), (100, 1, 0, 0.0), (100, 2, 5, 0.0), (100, 3, 3, 5.0)]
    assert neighbours.nearest_neighbours(frame.where("false")).isEmpty()


def test_chi_square_quantiles():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 2) == pytest.approx(1.3863, abs=1e-3)


def pages_of(spark, rows):
    return spark.createDataFrame([(*row, "f", 1) for row in rows], "page_id long, url string, html string, file string, pos int")


HOSTILE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n" * 3


@pytest.mark.parametrize(("compression", "split"), [("none", "2k"), ("none", "128m"), ("gzip", "128m")])
def test_archives_round_trip(spark, compression, split):
    from pairwright.session import shared_folder

    draw = random.Random(9)
    rows = [(i, f"http://h/{i}\n", "".join(draw.choice("ab\r\n é") for _ in range(draw.randrange(400)))) for i in range(150)]
    rows += [(200, None, HOSTILE), (201, "u", HOSTILE), (202, "u", None), (203, "u", ""), (None, "u", "z" * 120), (204, "u", "short"), (205, "u", "short")]
    rows += [(300 + i, "u", "copy " * 30) for i in range(60)]
    folder = f"{shared_folder(spark)}/warc-test-{compression}-{split}-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_roles(pages_of(spark, rows).repartition(2)), folder, compression)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = warc.read_archives(spark, folder).where("kind = 'response'").select("record", "payload", "digest").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    first: dict = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) < 100 or page is None or data not in first:
            first.setdefault(data, page)
    expected = sorted(
        (f"<urn:page:{'' if p is None else p}>", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest())
        for p, _, h in rows
        if len((h or "").encode()) < 100 or p is None or first[(h or "").encode()] == p
    )
    assert sorted(map(tuple, found)) == expected


def test_archive_query_rows(spark):
    rows = [(1, "u", "a" * 100), (2, "u", "a" * 100), (3, "u", "a" * 99), (4, "u", "a" * 99), (5, None, None), (6, "u", HOSTILE)]
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_pages(pages_of(spark, rows)).collect()}
    assert found == {1: ("response", None, 100), 2: ("revisit", 1, 100), 3: ("response", None, 99), 4: ("response", None, 99), 5: ("response", None, 0), 6: ("response", None, len(HOSTILE))}
    assert warc.archive_pages(pages_of(spark, rows).where("false")).isEmpty()


def test_components_of_random_graphs(spark):
    draw = random.Random(1)
    for size, count in ((50, 20), (300, 280), (400, 390)):
        edges = [(draw.randrange(size), draw.randrange(size)) for _ in range(count)] + [(i, i + 1) for i in range(1000, 1200)]
        parent = list(range(1300))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        touched = {x for a, b in edges if a != b for x in (a, b)}
        found = components.components(spark.createDataFrame(edges, "u long, v long").repartition(5))
        assert sorted(map(tuple, found.collect())) == sorted((x, root(x)) for x in touched)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_queries_equal_their_twins(spark, name):
    connection = duckdb.connect()
    for view in ("documents", "pages", "labels", "embeddings"):
        connection.execute(f"create view {view} as select * from '{FOLDER}/{view}.parquet'")
    found = QUERIES[name](spark, FOLDER)
    result = connection.execute(TWINS[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(found.columns)
    expected = sorted([tuple(row) for row in result.fetchall()], key=str)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == expected


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline

    documents = table(spark, FOLDER, "documents")
    docs, counts = documents, [documents.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).checkpoint()
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[0]
    assert docs.where("text rlike 'AKIA[A-Z0-9]{16}'").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == counts[-1]
    whole = corpus_pipeline.run(spark, FOLDER)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(*columns).collect())) == sorted(map(tuple, packed.select(*columns).collect()))
