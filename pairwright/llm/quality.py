"""Quality rules whose cutoffs are certified on labelled documents.

Signals are counts per mille (symbols, capitals and exclamation marks per character or word, repeated lines, words in
repeated windows). For every stratum, signal and cutoff of a fixed grid, the labelled good documents of the stratum give
n trials with k false rejections. A cutoff is certified when the exact binomial (Clopper-Pearson) upper bound on the false
rejection rate is at most ``RISK / signals``, at level ``DELTA`` divided by the number of tests (strata x signals x
cutoffs, Bonferroni). The lowest certified cutoff of each signal is used, so with probability 1 - DELTA the method
rejects at most RISK of the good documents in every stratum. A stratum without enough labels gets no cutoff.

Null and empty texts have no words and fail the base rule. Null strata form one stratum. Documents labelled more than once
are good only if every label says so. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.llm.text import map_rows, utf8, words_of
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

RISK = 0.05
DELTA = 0.05
WINDOW = 5
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700)
SIGNALS = ("s_symbols", "s_caps", "s_bangs", "s_dup_lines", "s_repeats")

_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_bangs")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice, first occurrences included."""
    grams = list(zip(*[words[i:] for i in range(window)], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    covered, end = 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + window - max(end, at)
            end = at + window
    return covered


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The counts named in ``_COUNTS`` for one text."""
    text = text or b""
    words = words_of(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, _CAPITALS)),
        text.count(b"!"),
    )


def document_counts(documents: DataFrame, stratum: str) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            rows = [text_counts(text) for text in batch["text"]]
            counts = dict(zip(_COUNTS, map(list, zip(*rows, strict=True)), strict=True)) if rows else {c: [] for c in _COUNTS}
            yield {"doc_id": batch["doc_id"], "stratum": batch["stratum"]} | counts

    schema = "doc_id long, stratum string, " + ", ".join(f"{name} long" for name in _COUNTS)
    columns = ["doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), utf8()]
    counted = map_rows(documents, columns, schema, run)

    def share(part: str, whole: str):
        return F.coalesce(F.expr(f"1000 * {part} div nullif({whole}, 0)"), F.lit(0)).cast("long")

    failed = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"
    return counted.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(failed).alias("base_failed"), share("n_symbols", "word_chars").alias("s_symbols"),
        share("n_caps", "word_chars").alias("s_caps"), share("n_bangs", "n_words").alias("s_bangs"),
        share("n_dup_lines", "n_lines").alias("s_dup_lines"), share("n_repeat_words", "n_words").alias("s_repeats"),
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), the regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def certified_cutoffs(counts: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum`` and one column per signal: its lowest certified cutoff, or null."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    trials = counts.where("not base_failed").join(good, "doc_id", "left_semi")
    rejections = [F.count_if(F.col(s) > c).alias(f"{s}@{c}") for s in SIGNALS for c in CUTOFFS]
    tallies = trials.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *rejections)
    tests = F.count(F.lit(1)).over(_all()) * len(SIGNALS) * len(CUTOFFS)

    def certify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                passed = {"stratum": row["stratum"], "n_trials": row["n"]}
                for s in SIGNALS:
                    fine = (c for c in CUTOFFS if binomial_tail(row[f"{s}@{c}"], row["n"], risk / len(SIGNALS)) <= delta / row["tests"])
                    passed[f"c_{s}"] = next(fine, None)
                out.append(passed)
            yield pd.DataFrame(out, columns=["stratum", "n_trials", *[f"c_{s}" for s in SIGNALS]])

    schema = "stratum string, n_trials long, " + ", ".join(f"c_{s} double" for s in SIGNALS)
    return tallies.withColumn("tests", tests).mapInPandas(certify, schema)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def judge(documents: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``."""
    counts = cut_lineage(document_counts(documents, stratum))
    cutoffs = cut_lineage(certified_cutoffs(counts, labels))
    joined = attach(counts, cutoffs, ["stratum"], how="left", spread=["doc_id", "n_words", "word_chars"])
    rejected = F.lit(False)
    for s in SIGNALS:
        rejected = rejected | F.coalesce(F.col(s) > F.col(f"c_{s}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _share(part: str, whole: str) -> str:
    return f"coalesce(1000 * {part} // nullif({whole}, 0), 0)"


_TESTS = len(SIGNALS) * len(CUTOFFS)
OP1_SQL = f"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents
), split as (
  select r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs
), tokens as (
  select r, unnest(w) as t, generate_subscripts(w, 1) as p from split
), grams as (
  select r, p, t || ' ' || lead(t, 1) over o || ' ' || lead(t, 2) over o || ' ' || lead(t, 3) over o || ' ' || lead(t, 4) over o as g
  from tokens window o as (partition by r order by p)
), twice as (
  select r, p from (select r, p, count(*) over (partition by r, g) as n from grams where g is not null) where n > 1
), repeats as (
  select r, count(distinct q) as n from (select r, unnest(range(p, p + 5)) as q from twice) group by r
), lines as (
  select r, count(*) as n_lines, count(*) - count(distinct l) as n_dup
  from (select r, unnest(string_split(text, chr(10))) as l from docs)
  where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r
), counts as (
  select d.doc_id, d.stratum, cast(len(w) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(n_dup, 0) as n_dup_lines, coalesce(p.n, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_caps, length(regexp_replace(text, '[^!]', '', 'g')) as n_bangs
  from docs d join split using (r) left join repeats p using (r) left join lines using (r)
), signals as (
  select doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    {_share("n_symbols", "word_chars")} as s_symbols, {_share("n_caps", "word_chars")} as s_caps,
    {_share("n_bangs", "n_words")} as s_bangs, {_share("n_dup_lines", "n_lines")} as s_dup_lines,
    {_share("n_repeat_words", "n_words")} as s_repeats
  from counts
), good as (
  select s.* from signals s semi join (select doc_id from labels group by doc_id having min(quality) = 1) g
  on s.doc_id = g.doc_id where not base_failed
), strata as (
  select stratum, count(*) as n, count(*) over () * {_TESTS} as tests from good group by stratum
), tests as (
  select stratum, signal, cutoff, count(*) filter (where value > cutoff) as k from
  (unpivot (select stratum, {", ".join(SIGNALS)} from good) on {", ".join(SIGNALS)} into name signal value value),
  (select unnest([{", ".join(map(str, CUTOFFS))}]) as cutoff) group by all
), certified as (
  select stratum, signal, min(cutoff) as cutoff from tests join strata using (stratum)
  where k < n and list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({RISK / len(SIGNALS)}) + (n - i) * ln(1 - {RISK / len(SIGNALS)})))) <= {DELTA} / tests
  group by stratum, signal
), cutoffs as (
  select stratum, {", ".join(f"max(cutoff) filter (where signal = '{s}') as c_{s}" for s in SIGNALS)} from certified group by stratum
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(f"coalesce({s} > c_{s}, false)" for s in SIGNALS)}) as kept
from signals left join cutoffs using (stratum)
"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
