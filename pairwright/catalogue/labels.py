"""Label, oracle, precondition and localization queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.functions.canonical import canonical_json
from pairwright.functions.scalars import epoch_micros
from pairwright.operators import labels as L
from pairwright.operators.rules import violations
from pairwright.sources.tables import table

STEP_SQL = "'step-' || (doc_id % 8)"


def step():
    return F.concat(F.lit("step-"), (F.col("doc_id") % 8).cast("string"))


@query(
    "label_decision",
    f"""select doc_id, toxic = 0 as sample_valid, case when toxic = 1 then 'baseline_failed' end as invalid_reason,
               case when toxic = 0 then quality = 0 end as task_regression,
               case when toxic = 0 then case when quality = 0 then 4 else 0 end end as severity_ordinal,
               case when toxic = 0 and quality = 0 then {STEP_SQL} end as first_failed_step_id,
               toxic = 0 and quality = 0 as requires_localization from labels""",
)
def label_decision(spark, sf):
    decided = L.label_decision(F.col("toxic") == 0, F.col("quality") == 1, step())
    return table(spark, sf, "labels").select("doc_id", *[value.alias(name) for name, value in decided.items()])


LABEL_SQL = f"""
with d as (select l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, toxic = 0 as b, quality = 1 as c from labels l join documents d on l.doc_id = d.doc_id),
     o as (select *, case when not b then {STEP_SQL} end as bs, case when not c and source <> 'src3' then {STEP_SQL} end as cs,
            case when lang = 'fr' and quality = 1 then false else b end as valid,
            case when not b and source <> 'src5' then 'baseline_failed' when source = 'src6' then 'timeout' end as reason,
            case when b or source = 'src7' then not c end as regression,
            case when b and not c then case when source = 'src8' then 0 else 4 end when b then 0 end as severity,
            case when b and not c then case when lang = 'de' then 'step-x' else {STEP_SQL} end when source = 'src9' then 'step-0' end as failed,
            case when b and not c and lang <> 'es' then 'loc' end as place,
            n_chars % 3 = 0 as same from d)
select doc_id, code from o, (values ('record.success_has_failed_step'), ('record.failure_missing_step'), ('record.invalid_without_reason'), ('record.invalid_has_labels'),
   ('record.baseline_failure_reason'), ('record.spurious_baseline_failure_reason'), ('record.valid_has_reason'), ('record.valid_failed_baseline'), ('record.derived_regression'),
   ('record.regression_severity'), ('record.derived_failed_step'), ('record.regression_localization'), ('record.non_regression_labels'), ('record.outcome_artifact_contradiction')) k(code)
where case code when 'record.success_has_failed_step' then (b and bs is not null) or (c and cs is not null)
   when 'record.failure_missing_step' then (not b and bs is null) or (not c and cs is null)
   when 'record.invalid_without_reason' then not valid and reason is null
   when 'record.invalid_has_labels' then not valid and (regression is not null or severity is not null or failed is not null or place is not null)
   when 'record.baseline_failure_reason' then not valid and not b and reason is distinct from 'baseline_failed'
   when 'record.spurious_baseline_failure_reason' then not valid and b and reason is not distinct from 'baseline_failed'
   when 'record.valid_has_reason' then valid and reason is not null
   when 'record.valid_failed_baseline' then valid and not b
   when 'record.derived_regression' then valid and regression is distinct from (not c)
   when 'record.regression_severity' then valid and not c and (severity is null or severity < 1)
   when 'record.derived_failed_step' then valid and not c and (failed is null or failed is distinct from cs)
   when 'record.regression_localization' then valid and not c and place is null
   when 'record.non_regression_labels' then valid and c and (severity is distinct from 0 or failed is not null or place is not null)
   else same and (b <> c or bs is distinct from cs) end
"""


@query("label_audit", LABEL_SQL)
def label_audit(spark, sf):
    rows = table(spark, sf, "labels").join(
        table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    )
    base_ok, cand_ok = F.col("toxic") == 0, F.col("quality") == 1
    source, lang = F.col("source"), F.col("lang")
    regressed = base_ok & ~cand_ok
    same = F.col("n_chars") % 3 == 0

    def outcome(role, ok, failed):
        digest = F.when(same, F.lit("shared")).otherwise(F.lit(role))
        return F.struct(
            ok.alias("task_success"),
            failed.alias("first_unsatisfied_step_id"),
            F.lit(0).alias("recovery_actions"),
            F.lit(0).cast("long").alias("virtual_elapsed_ms"),
            *[digest.alias(name) for name in ("final_state_oracle", "accessibility_oracle", "raw_trace")],
        )

    stored = F.struct(
        F.when((lang == "fr") & cand_ok, F.lit(False)).otherwise(base_ok).alias("sample_valid"),
        F.when(~base_ok & (source != "src5"), "baseline_failed").when(source == "src6", "timeout").alias("invalid_reason"),
        F.when(base_ok | (source == "src7"), ~cand_ok).alias("task_regression"),
        F.when(regressed, F.when(source == "src8", 0).otherwise(4)).when(base_ok, 0).alias("severity_ordinal"),
        F.when(regressed, F.when(lang == "de", "step-x").otherwise(step()))
        .when(source == "src9", "step-0")
        .alias("first_failed_step_id"),
        F.when(regressed & (lang != "es"), "loc").alias("localization"),
    )
    records = rows.select(
        "doc_id",
        outcome("baseline", base_ok, F.when(~base_ok, step())).alias("baseline"),
        outcome("candidate", cand_ok, F.when(~cand_ok & (source != "src3"), step())).alias("candidate"),
        stored.alias("labels"),
    )
    return violations(
        records, ["doc_id"], L.label_rules(F.col("baseline"), F.col("candidate"), F.col("labels"))
    )


@query(
    "precondition_report",
    """with c as (select c_custkey, c_acctbal, c_mktsegment, c_nationkey, round_even(c_acctbal * 100, 0)::bigint as cents from customer),
            k as (select c_custkey, code, case code when 'account.in_range' then cents between -50000 and 900000 when 'account.solvent' then c_acctbal >= 0
                    when 'nation.known' then c_nationkey between 0 and 22 else c_mktsegment <> 'MACHINERY' end as passed,
                    sha256(case code when 'account.in_range' then '{"cents":' || cents || '}' when 'account.solvent' then case when c_acctbal >= 0 then 'true' else 'false' end
                    when 'nation.known' then c_nationkey::varchar else '"' || c_mktsegment || '"' end) as observed_sha256
                  from c, (values ('account.in_range'), ('account.solvent'), ('nation.known'), ('segment.served')) v(code))
       select c_custkey, bool_and(passed) over (partition by c_custkey) as applicable, code, passed, observed_sha256 from k""",
)
def precondition_report(spark, sf):
    cents = F.rint(F.col("c_acctbal") * 100).cast("long")
    solvent = F.col("c_acctbal") >= 0
    checks = {
        "segment.served": (
            F.col("c_mktsegment") != "MACHINERY",
            F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('"')),
        ),
        "nation.known": (F.col("c_nationkey").between(0, 22), F.col("c_nationkey").cast("string")),
        "account.solvent": (solvent, solvent.cast("string")),
        "account.in_range": (cents.between(-50000, 900000), canonical_json({"cents": cents})),
    }
    return L.precondition_report(table(spark, sf, "customer"), ["c_custkey"], checks)


@query(
    "terminal_oracle",
    """with e as (select user_id, (epoch_us(ts) // 86400000000)::bigint as day, event_type, value from events),
            c as (select user_id, day, bool_or(event_type = 'error') as t, count_if(event_type = 'click' and value > 30) as p,
                         count_if(event_type = 'purchase') as k from e group by 1, 2),
            l as (select * from c qualify day = max(day) over (partition by user_id))
       select user_id, day, case when t then 'review' else 'confirmed' end as observed_state, not t as final_passed, p::bigint as primary_action_count,
              k::bigint as confirmation_count, p = 0 and k = 1 as accessibility_passed from l""",
)
def terminal_oracle(spark, sf):
    nodes = table(spark, sf, "events").select(
        "user_id", F.floor(epoch_micros("ts") / 86_400_000_000).cast("long").alias("day"), "event_type", "value"
    )
    kind = F.col("event_type")
    return L.terminal_oracles(
        nodes, ["user_id"], "day", kind == "error", (kind == "click") & (F.col("value") > 30), kind == "purchase"
    )


@query(
    "localization_match",
    """with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, round_even(l_quantity * 1000, 0)::bigint as w,
                  round_even(l_extendedprice, 0)::bigint as h, round_even(l_discount * 1000, 0)::bigint as e from lineitem)
       select l_orderkey, l_linenumber, l_partkey, code from b, (values ('localization.nodes'), ('localization.regions')) c(code)
       where (code = 'localization.nodes' and l_returnflag = 'R' and l_linestatus = 'F') or
             (code = 'localization.regions' and l_returnflag = 'A' and (case when e > 50 then e else w end) <> w)""",
)
def localization_match(spark, sf):
    lines = table(spark, sf, "lineitem")
    milli = F.rint(F.col("l_quantity") * 1000).cast("long")
    height = F.rint("l_extendedprice").cast("long")
    effect = F.rint(F.col("l_discount") * 1000).cast("long")

    def rect(width):
        return F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), width.alias("width"), height.alias("height"))

    touched = L.changed_region(F.when(effect > 50, rect(effect)), rect(milli))
    node = F.concat(F.lit("node-"), F.col("l_suppkey").cast("string"))
    instance = F.col("l_orderkey").cast("string")
    surface = F.struct(
        instance.alias("instance_id"), F.array(node).alias("affected_node_ids"), F.array(touched).alias("regions")
    )
    strayed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    stored_region = F.when(F.col("l_returnflag") == "A", rect(milli)).otherwise(touched)
    stored = F.struct(
        instance.alias("instance_id"),
        F.array(F.when(strayed, F.concat(node, F.lit("b"))).otherwise(node)).alias("affected_node_ids"),
        F.array(stored_region).alias("regions"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = lines.select(*keys, surface.alias("surface"), stored.alias("stored"))
    return violations(rows, keys, L.localization_rules(F.col("stored"), F.col("surface")))
