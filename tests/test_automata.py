"""Grammars as automata against regular expressions, in one block and over many."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pairwright.operators import automata as a
from pairwright.operators import sequence
from pairwright.operators.keyed import blocked_window

GRAMMARS = {
    "pairs": a.some(a.sequence(a.letters("a"), a.either(a.letters("b"), a.sequence(a.letters("c"), a.letters("c"))))),
    "tail": a.sequence(a.maybe(a.letters("a")), a.some(a.letters("bc")), a.letters("a")),
    "empty": a.maybe(a.letters("a")),
    "never": a.sequence(a.letters("a"), a.letters("")),
}
PATTERNS = {"pairs": "(a(b|cc))+", "tail": "a?[bc]+a", "empty": "a?", "never": "(?!)"}
AUTOMATON = a.compiled(GRAMMARS, "abc")


@pytest.mark.parametrize("block", [3, 1024])
def test_runs_equal_regular_expressions(spark, block):
    draw = random.Random(block)
    texts = ["", "a", "ab", "abacc", "bca", "abz"] + ["".join(draw.choices("abc", k=draw.randrange(1, 40))) for _ in range(60)]
    texts += ["ab" * 300 + "acc", "ab" * 300 + "ac", "b" * 900 + "a"]
    rows = [(None if k == 1 else k, at, mark) for k, text in enumerate(texts) for at, mark in enumerate(text)]
    frame = spark.createDataFrame(rows, "k long, at long, letter string").repartition(7).withColumn("n", F.lit("clash"))
    placed = blocked_window(frame, ["k"], ["at"], F.expr("at div 5"), position="p")
    found = a.runs(placed, ["k"], "p", "letter", AUTOMATON, block)
    marks = [a.accepts(AUTOMATON, F.lit(name), F.col("ends")).alias(name) for name in GRAMMARS]
    got = {row["k"]: (row["n"], *[row[name] for name in GRAMMARS]) for row in found.select("k", "n", *marks).collect()}
    expected = {None if k == 1 else k: (len(t), *[bool(re.fullmatch(PATTERNS[n], t)) for n in GRAMMARS]) for k, t in enumerate(texts) if t}
    assert got == expected


def closed(setup, entry, actions):
    """The recipe rule in plain Python."""

    def segment(marks, expectation, fill):
        if expectation == "none" or not marks:
            return False
        if expectation == "checked":
            return marks == "s"
        if fill and marks == "x":
            return expectation == "value"
        return all(mark in "sk" for mark in marks)

    if len(actions) < 3 or actions[0] != "f" or actions.count("f") != 1 or actions[-1] != "c" or actions.count("c") != 1 or actions[-2] != "t":
        return False
    middle = actions[1:-2]
    if entry is None:
        return "t" not in middle and segment(middle, setup, True)
    if middle.count("t") != 1:
        return False
    first, second = middle.split("t")
    return segment(first, entry, True) and segment(second, setup, False)


def test_recipes(spark):
    draw = random.Random(8)
    cases = {}
    for k in range(400):
        setup, entry = draw.choice(a.EXPECTATIONS), draw.choice([None, *a.EXPECTATIONS])
        middle = draw.choice(["s", "x", "y", "kk", "sk"]) + ("" if entry is None else "t" + draw.choice(["s", "k", "x", "ks"]))
        actions = "f" + middle + "tc"
        if draw.random() < 0.3:
            at = draw.randrange(len(actions))
            actions = actions[:at] + draw.choice(["", "f", "t", "c", "?"]) + actions[at + 1 :]
        cases[k] = (setup, entry, actions)
    cases[400] = ("value", None, "")
    rows = [(k, at, mark if mark != "?" else None) for k, (_, _, actions) in cases.items() for at, mark in enumerate(actions)]
    workflows = spark.createDataFrame([(k, s if e is None else f"{s}/{e}") for k, (s, e, _) in cases.items()], "k long, grammar string")
    frame = spark.createDataFrame(rows, "k long, p long, letter string")
    found = a.recipe_issues(frame, workflows, ["k"], "p", "letter", "grammar")
    assert {(r["k"], r["n_actions"]) for r in found.collect()} == {(k, len(t)) for k, (s, e, t) in cases.items() if not closed(s, e, t)}
    assert sum(closed(*case) for case in cases.values()) > 40
    assert a.recipe_issues(frame.limit(0), workflows.limit(0), ["k"], "p", "letter", "grammar").isEmpty()


def test_pilot_schedule(spark):
    good = [(0, "initial_state", -1), (1, "pre_primary_action", 3), (2, "post_primary_action", 4)]
    cases = {
        "good": good,
        "renamed": [good[0], (1, "before", 3), good[2]],
        "moved": [good[0], good[1], (2, "post_primary_action", 5)],
        "more": [*good, (3, "initial_state", -1)],
        "twice": [good[0], good[0], good[1], good[2]],
        "short": good[:2],
        "none": [],
    }
    rows = [(plan, *row) for plan, listed in cases.items() for row in listed]
    schedule = spark.createDataFrame(rows, "plan string, ordinal long, key string, after long")
    actions = spark.createDataFrame([(plan, 5) for plan in cases], "plan string, n_actions long")
    found = sequence.pilot_schedule_issues(schedule, actions, "plan", "ordinal", "key", "after")
    assert {(r["plan"], r["n_checkpoints"]) for r in found.collect()} == {(plan, len(listed)) for plan, listed in cases.items() if plan != "good"}


def test_runs_reads_costly_rows_once(spark):
    """With a cheaper table to count, positions and letters are made once: no job runs over them before the result is asked for."""
    reads = spark.sparkContext.accumulator(0)
    letters = F.udf(lambda k: reads.add(1) or "a")
    placed = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("p")).withColumn("letter", letters("p"))
    made = a.runs(placed.where("letter = 'a'"), ["k"], "p", "letter", AUTOMATON, 4, counted=spark.range(40).select(F.lit(1).alias("k")))
    assert reads.value == 0
    assert [tuple(r)[:2] for r in made.collect()] == [(1, 40)]
