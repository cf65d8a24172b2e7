"""The filter audit against a plain Python version."""

from __future__ import annotations

from itertools import permutations

from pairwright.llm.filter_audit import interactions


def fails(rows):
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            key = text or ""
            first[key] = min(doc_id, first.get(key, doc_id))
    for doc_id, text, part in rows:
        text = text or ""
        w = text.encode().split()
        found = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and doc_id > first[text],
        }
        yield doc_id, part or "", {name for name, bad in found.items() if bad}


def audit(rows, labels):
    good = {d for d, quality, _ in labels if quality == 1 and d is not None}
    toxic = {d for d, _, bad in labels if bad == 1 and d is not None}
    documents = list(fails(rows))
    out, totals = {}, {}
    for part in {p for _, p, _ in documents}:
        mine = [(d, f) for d, p, f in documents if p == part]
        for order in map("".join, permutations("ABCDE")):
            alive = list(mine)
            for step, f in enumerate(order, 1):
                gone = [(d, bad) for d, bad in alive if f in bad]
                early = sum(f in bad for _, bad in mine) - len(gone)
                alive = [(d, bad) for d, bad in alive if f not in bad]
                only = sum(bad == {f} for _, bad in mine)
                lost = sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)
                out[part, order, step] = (len(alive), len(gone), early, only, *lost)
                totals[part, f] = totals.get((part, f), 0) + len(gone)
    return {(*key, *counts, totals[key[0], key[1][key[2] - 1]]) for key, counts in out.items()}


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_against_plain_python(spark):
    long = " ".join(f"word{n}" for n in range(300))
    texts = [long, long, long + " #", None, "", "AB c", "same " * 400, "same " * 400 + "SHOUT" * 99, "w\x0bx\ty " * 70_000, "  é" * 250]
    rows = [(n, texts[n * 7 % len(texts)], ("a", "b", None, "")[n % 4]) for n in range(60)]
    rows += [(None, long, "a"), (None, None, "b"), (3, texts[1], "a"), (3, texts[1], "a")]
    labels = [(n, n % 5 % 2, n % 3 == 0) for n in range(0, 60, 2)] + [(4, 1, False), (None, 1, True), (6, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id long, text string, source string, digest string, mask int")
    marks = spark.createDataFrame([(*row, "y") for row in labels], "doc_id long, quality int, toxic int, part string")
    found = {tuple(row) for row in interactions(docs, marks).select(*COLUMNS).collect()}
    assert found == audit(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(docs, marks).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    assert interactions(one, marks).count() == 600
