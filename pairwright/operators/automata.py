"""Declared grammars run over ordered rows as finite automata.

A grammar is built from letters with ``letters``, ``sequence``, ``either``, ``some`` and ``maybe``. ``compiled`` turns it into one transition table by
derivatives. What a run of rows does to the automaton is a map from state to state, and maps compose associatively: rows are folded
inside blocks of a fixed width, block maps are composed level by level, and a sequence of any length, or one that holds a third
of the table, never meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1_024

NOTHING, EMPTY = ("nothing",), ("empty",)


def letters(marks: str) -> tuple:
    """Any one of these letters."""
    return ("letters", frozenset(marks)) if marks else NOTHING


def sequence(*parts: tuple) -> tuple:
    out = EMPTY
    for part in reversed(parts):
        if NOTHING in (part, out):
            return NOTHING
        out = part if out == EMPTY else out if part == EMPTY else ("then", part, out)
    return out


def either(*parts: tuple) -> tuple:
    choices = set()
    for part in parts:
        choices |= part[1] if part[0] == "either" else {part} - {NOTHING}
    return NOTHING if not choices else next(iter(choices)) if len(choices) == 1 else ("either", frozenset(choices))


def some(part: tuple) -> tuple:
    """Once or more."""
    return part if part in (NOTHING, EMPTY) else ("some", part)


def maybe(part: tuple) -> tuple:
    return either(part, EMPTY)


def _ends(grammar: tuple) -> bool:
    """May the grammar match no letter at all?"""
    kind = grammar[0]
    if kind == "then":
        return _ends(grammar[1]) and _ends(grammar[2])
    if kind == "either":
        return any(map(_ends, grammar[1]))
    return kind == "empty" or (kind == "some" and _ends(grammar[1]))


def _after(grammar: tuple, letter: str) -> tuple:
    """What may follow once ``letter`` was read."""
    kind = grammar[0]
    if kind == "letters":
        return EMPTY if letter in grammar[1] else NOTHING
    if kind == "then":
        first = sequence(_after(grammar[1], letter), grammar[2])
        return either(first, _after(grammar[2], letter)) if _ends(grammar[1]) else first
    if kind == "either":
        return either(*(_after(part, letter) for part in grammar[1]))
    if kind == "some":
        return sequence(_after(grammar[1], letter), maybe(grammar))
    return NOTHING


@dataclass(frozen=True)
class Automaton:
    """States are numbered from 0; ``moves[state * (len(alphabet) + 1) + letter]`` is the next one. The last letter is any other letter."""

    alphabet: str
    moves: tuple[int, ...]
    starts: dict[str, int]
    accepting: tuple[int, ...]

    @property
    def states(self) -> int:
        return len(self.moves) // (len(self.alphabet) + 1)

    def code(self, letter: Column) -> Column:
        """Number of a letter column; null and unknown letters are the other letter."""
        found = F.try_element_at(F.create_map(*[F.lit(x) for k, mark in enumerate(self.alphabet) for x in (mark, k)]), letter)
        return F.coalesce(found, F.lit(len(self.alphabet)))


def compiled(grammars: dict[str, tuple], alphabet: str) -> Automaton:
    """One automaton for several named grammars, each with its own start state."""
    numbers: dict[tuple, int] = {}
    queue = []

    def number(grammar: tuple) -> int:
        if grammar not in numbers:
            numbers[grammar] = len(numbers)
            queue.append(grammar)
        return numbers[grammar]

    starts = {name: number(grammar) for name, grammar in grammars.items()}
    dead = number(NOTHING)
    moves = []
    for grammar in queue:  # grows while it is read
        moves += [number(_after(grammar, letter)) for letter in alphabet] + [dead]
    return Automaton(alphabet, tuple(moves), starts, tuple(k for grammar, k in numbers.items() if _ends(grammar)))


def runs(rows: DataFrame, keys: Sequence[str], position: str, letter: str, automaton: Automaton, block: int = BLOCK, counted: DataFrame | None = None) -> DataFrame:
    """``(keys..., n, ends)``: rows per sequence and, for each state the automaton may start in, the state it ends in.

    ``position`` counts the rows of a sequence from 0 without gaps or repeats, as ``blocked_window`` does, so a block holds at most ``block`` rows.
    Null keys are keys like others. ``counted`` is a cheaper table with as many rows for every key, if positions and letters are costly to make twice.
    """
    keys = list(keys)
    width = len(automaton.alphabet) + 1
    table = F.array(*[F.lit(state) for state in automaton.moves])
    every = F.array(*[F.lit(state) for state in range(automaton.states)])
    coded = F.struct(F.col(position).alias("at"), automaton.code(F.col(letter)).alias("code"))
    cut = rows.select(*keys, F.floor(F.col(position) / block).alias("_block"), coded.alias("_row"))
    blocks = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_row")).alias("_rows"))

    def read(state: Column, row: Column) -> Column:
        return table[state * width + row["code"]]

    maps = blocks.select(*keys, "_block", "n", F.transform(every, lambda s: F.aggregate("_rows", s, read)).alias("ends"))
    if counted is None:
        last = rows.agg(F.max(position)).first()[0]
    else:
        last = counted.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_last")).agg(F.max("_last")).first()[0]
    levels, blocks_left = 0, (last or 0) // block
    while blocks_left:
        levels, blocks_left = levels + 1, blocks_left // block
    for _ in range(levels):
        part = F.struct(F.col("_block").alias("at"), "ends")
        joined = maps.groupBy(*keys, F.floor(F.col("_block") / block).alias("_upper")).agg(
            F.sum("n").alias("n"), F.array_sort(F.collect_list(part)).alias("_maps")
        )
        ends = F.transform(every, lambda s: F.aggregate("_maps", s, lambda state, m: m["ends"][state]))
        maps = joined.select(*keys, F.col("_upper").alias("_block"), "n", ends.alias("ends"))
    return maps.select(*keys, "n", "ends")


def accepts(automaton: Automaton, grammar: Column, ends: Column) -> Column:
    """Does the named grammar accept the run? False for names that are null or unknown."""
    start = F.try_element_at(F.create_map(*[F.lit(x) for pair in automaton.starts.items() for x in pair]), grammar)
    accepting = [F.lit(state) for state in automaton.accepting]
    return F.coalesce(F.array_contains(F.array(*accepting), F.try_element_at(ends, start + 1)), F.lit(False))


# Letters of an action recipe. f focus, x fill with the expected text, y any other fill, s Space, k another key, t Tab, c click.
RECIPE_LETTERS = "fxysktc"
# Kinds of expectation on a control: checked, a value, another attribute, none.
EXPECTATIONS = ("checked", "value", "other", "none")


def control_segment(expectation: str, fill: bool) -> tuple:
    """What may be done to one control: a checkbox takes one Space; a value one fill with the expected text or keys; others keys alone."""
    if expectation == "none":
        return NOTHING
    if expectation == "checked":
        return letters("s")
    keys = some(letters("sk"))
    return either(keys, letters("x")) if fill and expectation == "value" else keys


def recipe_grammars() -> dict[str, tuple]:
    """Closed action recipes, named ``setup`` or ``setup/entry`` by the expectations on the controls.

    Focus, then the setup control alone (when it is the focused one) or the focused control, Tab and the setup control; then Tab and one click.
    """
    out = {}
    for setup in EXPECTATIONS:
        segments = {setup: control_segment(setup, True)}
        for entry in EXPECTATIONS:
            segments[f"{setup}/{entry}"] = sequence(control_segment(entry, True), letters("t"), control_segment(setup, False))
        for name, segment in segments.items():
            out[name] = sequence(letters("f"), segment, letters("t"), letters("c"))
    return out


RECIPES = compiled(recipe_grammars(), RECIPE_LETTERS)


def recipe_issues(rows: DataFrame, workflows: DataFrame, keys: Sequence[str], position: str, letter: str, grammar: str, counted: DataFrame | None = None) -> DataFrame:
    """``(keys..., n_actions, code)`` of the workflows whose actions are not the closed recipe that their expectations name.

    ``workflows`` has one row per workflow; those without any action are violations too. ``letter`` tells what an action is, once its
    text is compared with the expectation bound to it. ``counted`` is as in ``runs``.
    """
    keys = list(keys)
    found = runs(rows, keys, position, letter, RECIPES, counted=counted)
    # one row a workflow on either side
    nothing = F.array(*[F.lit(state) for state in range(RECIPES.states)])
    renamed = found.withColumnsRenamed({key: f"_run_{key}" for key in keys})
    on = [F.col(key).eqNullSafe(F.col(f"_run_{key}")) for key in keys]
    joined = workflows.select(*keys, grammar).join(renamed, on, "left")
    closed = accepts(RECIPES, F.col(grammar), F.coalesce("ends", nothing))
    rows = joined.where(~closed)
    return rows.select(*keys, F.coalesce("n", F.lit(0)).alias("n_actions"), F.lit("recipe.action_recipe").alias("code"))
