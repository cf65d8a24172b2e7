"""Metric queries over labels joined to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.experiments import eligibility_gates
from pairwright.catalogue.registry import TWINS, query
from pairwright.catalogue.splits import SCHEDULE_SQL, block_sql
from pairwright.operators import scoring, splits, stacking
from pairwright.plans.factorial import dimension
from pairwright.sources.tables import table

MODELS = ("fused", "pixel", "structured")


def model_scores(quality, n_chars, doc_id):
    """Deterministic scores in millionths: two experts and a fused score that knows a little more."""
    pixel = (n_chars * 7919 + doc_id * 31) % 1000001
    structured = (n_chars * 104729 + doc_id * 17) % 1000001
    fused = F.floor((pixel + structured + (1 - quality) * 700000) / 3)
    return {"fused": fused, "pixel": pixel, "structured": structured}


SCORED_SQL = f"""d as (select l.doc_id, quality, toxic, source, lang, {block_sql("source")} as block, quality = 0 as y,
      (n_chars * 7919 + l.doc_id * 31) % 1000001 as pixel, (n_chars * 104729 + l.doc_id * 17) % 1000001 as structured from labels l join documents d on l.doc_id = d.doc_id),
   s as (select *, floor((pixel + structured + (1 - quality) * 700000) / 3)::bigint as fused from d where toxic = 0)"""


def labelled(spark, sf):
    """Labels with their document: both sides have one row per document id."""
    documents = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = table(spark, sf, "labels").join(documents, "doc_id")
    scores = model_scores(F.col("quality"), F.col("n_chars"), F.col("doc_id"))
    return joined.withColumns({name: value.cast("long") for name, value in scores.items()})


def valid_rows(spark, sf):
    return labelled(spark, sf).where("toxic = 0")


def fused_counts(spark, sf, *keys):
    return scoring.histogram(valid_rows(spark, sf), keys, "fused", F.col("quality") == 0)


def curve_sql(score: str, keys: str = "") -> str:
    """Counts per distinct score with cumulative positives and rows."""
    lead = f"{keys}, " if keys else ""
    part = f"partition by {keys} " if keys else ""
    return (
        f"select {lead}score, pos, n, sum(pos) over ({part}order by score desc) as tp, sum(n) over ({part}order by score desc) as taken "
        f"from (select {lead}{score} as score, count_if(y) as pos, count(*) as n from s group by all)"
    )


@query(
    "average_precision",
    f"""with {SCORED_SQL}, c as ({curve_sql("fused")})
        select sum(n)::bigint as n_rows, sum(pos)::bigint as n_positive, round(sum(pos * tp / taken) / sum(pos), 9) as average_precision from c""",
)
def average_precision(spark, sf):
    metrics = scoring.ranking_metrics(fused_counts(spark, sf), [])
    return metrics.select("n_rows", "n_positive", F.round("average_precision", 9).alias("average_precision"))


@query(
    "auroc",
    f"""with {SCORED_SQL}, p as (select a.fused as fa, b.fused as fb from s a, s b where a.y and not b.y)
        select round((count_if(fa > fb) + 0.5 * count_if(fa = fb))::double / count(*), 9) as auroc from p""",
)
def auroc(spark, sf):
    return scoring.ranking_metrics(fused_counts(spark, sf), []).select(F.round("auroc", 9).alias("auroc"))


@query(
    "recall_at_fpr",
    f"""with {SCORED_SQL}, r as (select fold_id, role, fused, y from s join {SCHEDULE_SQL.replace(") s(", ") k(")} on s.block = k.block where role <> 'train'),
          t as (select distinct fold_id, fused as threshold from r where role = 'validation'),
          f as (select t.fold_id, threshold, count_if(not y and fused >= threshold) <= 0.05 * count_if(not y) as fits from t join r on t.fold_id = r.fold_id and role = 'validation' group by 1, 2),
          b as (select fold_id, min(threshold) as threshold from f where fits group by 1)
        select r.fold_id, b.threshold, count_if(y and fused >= b.threshold)::double / nullif(count_if(y), 0) as test_recall,
               count_if(not y and fused >= b.threshold)::double / nullif(count_if(not y), 0) as test_fpr
        from r left join b on r.fold_id = b.fold_id where role = 'test' group by 1, 2""",
)
def recall_at_fpr(spark, sf):
    rows = valid_rows(spark, sf).withColumn("block", splits.block_of(F.col("source")))
    counts = scoring.histogram(rows, ["block"], "fused", F.col("quality") == 0)
    return scoring.recall_at_fpr(counts, "block")


@query(
    "brier",
    f"with {SCORED_SQL} select count(*) as n_rows, round(avg(pow(fused / 1000000 - y::int, 2)), 9) as brier from s",
)
def brier(spark, sf):
    return scoring.brier(fused_counts(spark, sf), []).select("n_rows", F.round("brier", 9).alias("brier"))


@query(
    "ece",
    f"""with {SCORED_SQL}, b as (select least(fused // 100000, 9) as bin, count(*) as n, avg(fused / 1000000) as p, avg(y::int) as r from s group by 1)
        select sum(n)::bigint as n_rows, round(sum(n * abs(p - r)) / sum(n), 9) as ece from b""",
)
def ece(spark, sf):
    counts = fused_counts(spark, sf)
    return scoring.expected_calibration_error(counts, []).select("n_rows", F.round("ece", 9).alias("ece"))


@query(
    "class_recall",
    f"""with {SCORED_SQL} select round(count_if(y and fused >= 500000)::double / count_if(y), 9) as regression_recall,
           round(count_if(not y and fused < 500000)::double / count_if(not y), 9) as non_regression_recall, (select count_if(toxic = 1)::bigint from d) as n_invalid from s""",
)
def class_recall(spark, sf):
    recalls = scoring.class_recall(fused_counts(spark, sf), [])
    invalid = labelled(spark, sf).agg(F.count_if(F.col("toxic") == 1).alias("n")).scalar()
    return recalls.select(
        F.round("regression_recall", 9).alias("regression_recall"),
        F.round("non_regression_recall", 9).alias("non_regression_recall"),
        invalid.alias("n_invalid"),
    )


@query(
    "metrics_by_group",
    f"""with {SCORED_SQL}, g as (select unnest([{{'l': 'all', 'v': 'all'}}, {{'l': 'application', 'v': source}}, {{'l': 'family', 'v': lang}}], recursive := true), fused, y from s),
          h as (select l, v, fused as score, count_if(y) as pos, count(*) as n from g group by all),
          c as (select *, sum(pos) over w as tp, sum(n) over w as taken from h window w as (partition by l, v order by score desc))
        select l as level, v as value, sum(n)::bigint as n_rows, sum(pos)::bigint as n_positive,
               case when sum(pos) > 0 and sum(pos) < sum(n) then round(sum(pos * tp / taken) / sum(pos), 9) end as average_precision,
               case when sum(pos) > 0 and sum(pos) < sum(n) then round(sum((n - pos) * (2 * (tp - pos) + pos)) / (2 * sum(pos) * (sum(n) - sum(pos))), 9) end as auroc,
               round(sum(pos * pow(1 - score / 1000000, 2) + (n - pos) * pow(score / 1000000, 2)) / sum(n), 9) as brier
        from c group by 1, 2""",
)
def metrics_by_group(spark, sf):
    counts = fused_counts(spark, sf, "source", "lang")
    level = F.array(
        F.struct(F.lit("all").alias("level"), F.lit("all").alias("value")),
        F.struct(F.lit("application").alias("level"), F.col("source").alias("value")),
        F.struct(F.lit("family").alias("level"), F.col("lang").alias("value")),
    )
    leveled = counts.select("score", "pos", "n", F.explode(level).alias("g")).select("g.*", "score", "pos", "n")
    keys = ["level", "value"]
    summed = scoring.merged(leveled, keys)
    metrics = scoring.ranking_metrics(summed, keys).join(scoring.brier(summed, keys).drop("n_rows"), keys)
    return metrics.select(
        *keys,
        "n_rows",
        "n_positive",
        *[F.round(name, 9).alias(name) for name in ("average_precision", "auroc", "brier")],
    )




def resampled(spark, sf):
    clusters = dimension(valid_rows(spark, sf), "source").withColumnRenamed("_at", "cluster")
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])
    rows = valid_rows(spark, sf).select("source", "quality", F.explode(entries).alias("m"))
    counts = scoring.histogram(
        rows.select("source", "quality", "m.*"), ["source", "model"], "score", F.col("quality") == 0
    )
    numbered = counts.join(clusters, "source").drop("source")
    return scoring.bootstrap_precision(numbered, MODELS)


BOOTSTRAP_SQL = f"""{SCORED_SQL}, k as (select source, row_number() over (order by source) - 1 as cluster, count(*) over () as k from (select distinct source from s)),
   w as (select b.b as resample, ('0x' || substr(md5('20260715:' || b.b || ':' || j.j), 1, 8))::bigint % (select max(k) from k) as cluster, count(*) as weight
         from range({scoring.RESAMPLES}) b(b), range((select max(k) from k)) j(j) group by 1, 2),
   h as (select cluster, model, score, count_if(y) as pos, count(*) as n from (unpivot (select source, y, pixel, structured, fused from s) on pixel, structured, fused into name model value score) u
         join k on u.source = k.source group by all),
   r as (select resample, model, score, sum(pos * weight) as pos, sum(n * weight) as n from h join w on h.cluster = w.cluster group by all),
   c as (select *, sum(pos) over z as tp, sum(n) over z as taken from r window z as (partition by resample, model order by score desc)),
   a as (select resample, model, case when sum(pos) > 0 and sum(pos) < sum(n) then sum(pos * tp / taken) / sum(pos) end as ap from c group by 1, 2),
   x as (select f.resample, o.model, round_even((f.ap - o.ap) * 1000000, 0)::bigint as diff from a f join a o on f.resample = o.resample and f.model = 'fused' and o.model <> 'fused'),
   q as (select *, row_number() over (partition by model order by diff) as rn from x),
   i as (select 'fused-' || model as comparison, count(*) as n_resamples, count_if(diff is null)::bigint as n_undefined,
          case when count_if(diff is null) = 0 then max(diff) filter (where rn = ceil({scoring.RESAMPLES} * 25 / 1000)) end as lower_ppm,
          case when count_if(diff is null) = 0 then max(diff) filter (where rn = ceil({scoring.RESAMPLES} * 975 / 1000)) end as upper_ppm from q group by 1)"""


@query("cluster_bootstrap", f"with {BOOTSTRAP_SQL} select * from i")
def cluster_bootstrap(spark, sf):
    return scoring.bootstrap_intervals(resampled(spark, sf), "fused", MODELS[1:])


@query(
    "claim_gate",
    f"""with {BOOTSTRAP_SQL}, gt as ({TWINS["eligibility_gates"]})
        select bool_and(coalesce(lower_ppm > 0, false)) as bounds_positive, bool_and(n_undefined = 0) as all_defined, (select bool_and(passed) from gt) as gates_passed,
               bool_and(coalesce(lower_ppm > 0, false)) and bool_and(n_undefined = 0) and (select bool_and(passed) from gt) as claim from i""",
)
def claim_gate(spark, sf):
    return scoring.claim_gate(cluster_bootstrap(spark, sf), eligibility_gates(spark, sf))


def stacked_predictions(spark, sf):
    rows = (
        labelled(spark, sf)
        .join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
        .select(
            "doc_id",
            "source",
            "toxic",
            splits.block_of(F.col("source")).alias("block"),
            (F.col("quality") == 0).cast("double").alias("label"),
            F.log1p("n_chars").alias("size"),
            F.log1p(F.size(F.split("text", "\n"))).alias("lines"),
            F.log1p(F.size(F.split("text", " "))).alias("words"),
        )
    )
    experts = [["size", "lines"], ["words", "lines"]]
    return stacking.outer_predictions(rows, "block", F.col("toxic") == 0, "doc_id", "source", "label", experts)


@query("crossfit_stacker")
def crossfit_stacker(spark, sf):
    return stacked_predictions(spark, sf).withColumn("probability", F.round("probability", 6))


@query(
    "stacker_coverage",
    f"""with d as (select l.doc_id, {block_sql("source")} as block from labels l join documents d on l.doc_id = d.doc_id)
       select doc_id, fold_id, role, 1::bigint as n_predictions from d join {SCHEDULE_SQL.replace(") s(", ") k(")} on d.block = k.block where role <> 'train'""",
)
def stacker_coverage(spark, sf):
    """Every validation and test row is predicted once per outer fold, and no training row is."""
    return stacked_predictions(spark, sf).groupBy("doc_id", "fold_id", "role").agg(F.count("probability").alias("n_predictions"))


@query(
    "temporal_views",
    """with t as (select conv_id, turn, length(text)::bigint as n from conversations)
       select conv_id, 'initial_only' as view, 1::bigint as n_checkpoints, arg_min(n, turn) as n_chars from t group by 1
       union all select conv_id, 'post_primary_action_only', 1, arg_max(n, turn) from t group by 1
       union all select conv_id, 'all_checkpoints', count(*), sum(n)::bigint from t group by 1""",
)
def temporal_views(spark, sf):
    return scoring.temporal_views(
        table(spark, sf, "conversations"), "conv_id", "turn", {"n_chars": F.length("text").cast("long")}
    )


@query(
    "score_parity",
    """with a as (select doc_id, n_chars / (n_chars + 1000) as p from documents), b as (select doc_id, p::float::double as p from a where doc_id in (select doc_id from labels))
       select count(b.doc_id) as n_compared, count(*) - count(b.doc_id) as n_unmatched, max(abs(a.p - b.p)) as max_difference, count(*) = count(b.doc_id) and max(abs(a.p - b.p)) <= 1e-6 as passed
       from a left join b on a.doc_id = b.doc_id""",
)
def score_parity(spark, sf):
    native = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000)).alias("p"))
    labels = table(spark, sf, "labels").select("doc_id")
    exported = native.join(labels, "doc_id").select("doc_id", F.col("p").cast("float").cast("double").alias("p"))
    return scoring.score_parity(native, exported, ["doc_id"], "p")
