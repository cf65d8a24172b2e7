"""What each of five filters removes, alone and after the others, in all 120 orders.

A document's failures are one bit mask. Documents are counted per part and mask first (map-side combine), so at most 32 cells a part
remain whatever the input. Each cell then folds across the array of orders, a constant that travels with the plan: ``transform`` runs
over the orders, ``aggregate`` over the five filters of one order, and the cell's counts weigh the 120 x 5 structs that come out. Cells of a
part are merged by elementwise sums of these arrays. Everything is built-in functions.

Filters: A under 200 words; B under half of the words distinct; C over 2% of the code points in A-Z; D holds one of ``#$%&*|``; E equals
the text of a smaller id. Texts are compared by SHA-256; texts shared by a third of the table are spread over salts.

Null texts are empty: they fail A, and E as other empty texts do. Rows without an id are no repeats and make none. A null part is the empty
string. Repeated rows count as often as they occur; equal ids with one text do not repeat each other. A document is good (toxic)
if any of its labels says so. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.binding import let
from pairwright.llm.registry import query
from pairwright.operators.keyed import attach, over_groups
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
SPACE = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the filters that a text alone decides: A to D."""
    words = F.filter(F.split(text, SPACE), lambda word: word != "")
    few = let(
        words,
        lambda w: F.when(F.size(w) < 200, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0),
    )
    loud = F.when(100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text), 4).otherwise(0)
    return few + loud + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def failures(documents: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, mask``: bit k of the mask says that filter k fails."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_failures(text).alias("mask"),
    )
    known = over_groups(cut_lineage(rows), ["digest"], spread=["doc_id"], first=F.min("doc_id"))
    repeat = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return known.select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones per part and mask."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marks.agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    rows = attach(cut_lineage(failed), marked, ["doc_id"], how="left", spread=["part", "mask"])
    sums = [F.sum(F.coalesce(F.col(name), F.lit(0)).cast("long")).alias(name) for name in ("good", "toxic")]
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *sums)


def _step(mask: Column, n: Column, good: Column, toxic: Column, alive: Column, at: Column) -> Column:
    """Weighted counts of one cell at filter ``at``, ``alive`` telling whether the cell got as far."""
    bit = F.call_function("shiftleft", F.lit(1), at)
    fails = mask.bitwiseAND(bit) != 0
    here = alive & fails

    def when(condition: Column, weight: Column) -> Column:
        return F.when(condition, weight).otherwise(F.lit(0).cast("long"))

    values = [when(alive & ~fails, n), when(here, n), when(fails & ~alive, n), when(mask == bit, n), when(here, good), when(here, toxic)]
    return F.struct(at.alias("at"), *[value.alias(name) for value, name in zip(values, COUNTS, strict=True)])


def folded(orders: Column) -> Column:
    """The array of weighted structs of one cell: all orders, and in each all steps."""
    mask, n, good, toxic = (F.col(name) for name in ("mask", "n", "good", "toxic"))
    kind = "array<struct<at:int," + ",".join(f"{name}:bigint" for name in COUNTS) + ">>"

    def fold(order: Column) -> Column:
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))

        def step(so_far: Column, at: Column) -> Column:
            passes = mask.bitwiseAND(F.call_function("shiftleft", F.lit(1), at)) == 0
            steps = F.concat(so_far["steps"], F.array(_step(mask, n, good, toxic, so_far["alive"], at)).cast(kind))
            return F.struct((so_far["alive"] & passes).alias("alive"), steps.alias("steps"))

        return F.aggregate(order, start, step, lambda done: done["steps"])

    return F.flatten(F.transform(orders, fold))


def _summed(left: Column, right: Column) -> Column:
    total = [(left[name] + right[name]).alias(name) for name in COUNTS]
    return F.struct(left["at"].alias("at"), *total)


def interactions(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order and step with the counts of the step and the filter's share over all orders."""
    orders = F.array(*[F.array(*[F.lit(at) for at in order]) for order in ORDERS])
    weighted = cells(failures(documents, part), labels).select("part", folded(orders).alias("steps"))
    # at most 32 cells a part, one per mask
    lists = weighted.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    rest = F.slice("cells", 2, 2 ** len(FILTERS))
    merged = lists.select("part", F.aggregate(rest, F.col("cells")[0], lambda a, b: F.zip_with(a, b, _summed)).alias("steps"))
    zero = F.lit(0).cast("long")
    shares = F.transform(
        F.array(*[F.lit(at) for at in range(len(FILTERS))]),
        lambda at: F.aggregate("steps", zero, lambda sum_, s: sum_ + F.when(s["at"] == at, s["removed"]).otherwise(zero)),
    )
    rows = merged.select("part", shares.alias("shares"), F.posexplode("steps").alias("_p", "_s"))
    names = F.array(*[F.lit("".join(FILTERS[at] for at in order)) for order in ORDERS])
    return rows.select(
        "part",
        names[F.expr(f"int(_p div {len(FILTERS)})")].alias("filter_order"),
        (F.col("_p") % len(FILTERS) + 1).cast("int").alias("step"),
        *[F.col(f"_s.{name}").alias(name) for name in COUNTS],
        F.col("shares")[F.col("_s.at")].alias("shapley"),
    )


OP11_SQL = r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), marks as (
  select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id
), measured as (
  select doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by text) as first from docs
), failed as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    if(len(w) < 200, 1, 0) + if(100 * list_unique(w) < 50 * len(w), 2, 0)
    + if(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), 4, 0)
    + if(regexp_matches(text, '[#$%&*|]'), 8, 0) + if(coalesce(doc_id > first, false), 16, 0) as mask
  from measured left join marks using (doc_id)
), cells as (
  select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by all
), letters as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f
), orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order
  from letters a join letters b on a.f <> b.f join letters c on c.f not in (a.f, b.f)
    join letters d on d.f not in (a.f, b.f, c.f) join letters e on e.f not in (a.f, b.f, c.f, d.f)
), steps as (
  select filter_order, step, 1 << (ascii(filter_order[step]) - 65) as bit,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::int as earlier
  from orders, (select unnest(range(1, 6)) as step)
), counted as (
  select part, filter_order, step::int as step, bit,
    coalesce(sum(n) filter (where mask & (earlier | bit) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (where mask & earlier = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(n) filter (where mask & earlier <> 0 and mask & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (where mask & earlier = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (where mask & earlier = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
  from cells, steps group by all
)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from counted
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))
