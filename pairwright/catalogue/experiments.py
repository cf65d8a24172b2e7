"""Plan, matrix, pairing and policy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.catalogue.splits import SCHEDULE_SQL, block_sql
from pairwright.functions.canonical import canonical_json, sha256_hex
from pairwright.operators import splits
from pairwright.operators.keyed import attach
from pairwright.plans import factorial, gates, policy
from pairwright.sources.codecs import whitespace_codec
from pairwright.sources.tables import table

RELATIONS_SQL = "(values ('F'), ('O')) r(relation)"


def supplier_plan(spark, sf):
    """Suppliers as workflows, brands as operators, line status as the relation variant."""
    lines = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("relation"))
    return factorial.factorial_plan(
        spark,
        {
            "s_suppkey": factorial.dimension(table(spark, sf, "supplier"), "s_suppkey", F.expr("s_suppkey div 65536")),
            "p_brand": factorial.dimension(table(spark, sf, "part"), "p_brand"),
            "relation": factorial.dimension(lines, "relation"),
        },
    )


@query(
    "factorial_plan",
    f"""select row_number() over (order by s_suppkey, p_brand, relation) - 1 as cell, s_suppkey, p_brand, relation
        from supplier, (select distinct p_brand from part), {RELATIONS_SQL}""",
)
def factorial_plan(spark, sf):
    return supplier_plan(spark, sf)


@query(
    "matrix_audit",
    f"""with p as (select s_suppkey, p_brand, relation from supplier, (select distinct p_brand from part), {RELATIONS_SQL}),
             a as (select l_suppkey as s_suppkey, p_brand, l_linestatus as relation, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2, 3)
        select p.s_suppkey, p.p_brand, p.relation, coalesce(n, 0) as n_actual, case when n is null then 'cell.missing' else 'cell.repeated' end as code
        from p left join a on p.s_suppkey = a.s_suppkey and p.p_brand = a.p_brand and p.relation = a.relation where n is null or n > 1""",
)
def matrix_audit(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linestatus")
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    actual = attach(lines, brands, ["l_partkey"], spread=["l_orderkey"]).select(
        F.col("l_suppkey").alias("s_suppkey"), "p_brand", F.col("l_linestatus").alias("relation")
    )
    return factorial.matrix_audit(supplier_plan(spark, sf), actual, ["s_suppkey", "p_brand", "relation"])


@query(
    "matrix_order",
    f"""with p as (select s_suppkey, p_brand, relation, row_number() over (order by s_suppkey, p_brand, relation) - 1 as cell
                   from supplier, (select distinct p_brand from part), {RELATIONS_SQL}),
             a as (select *, case when s_suppkey % 17 = 3 and relation = 'O' then cell * 10 + 55 when s_suppkey % 19 = 5 and p_brand = 'Brand#1' then cell * 10 - 333 else cell * 10 end as place from p),
             w as (select *, max(cell) over (order by place, cell rows between unbounded preceding and 1 preceding) as before from a)
        select s_suppkey, p_brand, relation, place, 'cell.order' as code from w where before > cell""",
)
def matrix_order(spark, sf):
    plan = supplier_plan(spark, sf)
    late = (F.col("s_suppkey") % 17 == 3) & (F.col("relation") == "O")
    early = (F.col("s_suppkey") % 19 == 5) & (F.col("p_brand") == "Brand#1")
    place = F.col("cell") * 10 + F.when(late, 55).when(early, -333).otherwise(0)
    actual = plan.select("s_suppkey", "p_brand", "relation", place.alias("place"))
    return factorial.order_audit(plan, actual, ["s_suppkey", "p_brand", "relation"], "place", 4096)


@query(
    "coverage_once",
    """with p as (select doc_id, unnest(['fused', 'pixel']) as model from labels),
            q as (select doc_id, 'fused' as model from documents where n_chars > 200 union all select doc_id, 'fused' from documents where lang = 'de'
                  union all select doc_id, 'pixel' from documents where doc_id % 11 <> 5)
       select coalesce(p.doc_id, q.doc_id) as doc_id, coalesce(p.model, q.model) as model, coalesce(n, 0) as n_predictions,
              case when p.doc_id is null then 'coverage.unplanned' when n is null then 'coverage.missing' else 'coverage.repeated' end as code
       from p full join (select doc_id, model, count(*) as n from q group by 1, 2) q on p.doc_id = q.doc_id and p.model = q.model where p.doc_id is null or n is null or n > 1""",
)
def coverage_once(spark, sf):
    documents = table(spark, sf, "documents")
    fused, pixel = F.lit("fused").alias("model"), F.lit("pixel").alias("model")
    predictions = documents.where("n_chars > 200").select("doc_id", fused)
    again = documents.where("lang = 'de'").select("doc_id", fused)
    other = documents.where("doc_id % 11 <> 5").select("doc_id", pixel)
    planned = table(spark, sf, "labels").select("doc_id", F.explode(F.array(F.lit("fused"), F.lit("pixel"))).alias("model"))
    return factorial.coverage_once(planned, predictions.unionByName(again).unionByName(other), ["doc_id", "model"])


@query(
    "functional_dependency",
    "select l_partkey, count(distinct l_suppkey) as n_values from lineitem group by 1 having count(distinct l_suppkey) > 1",
)
def functional_dependency(spark, sf):
    return factorial.dependency_breaks(table(spark, sf, "lineitem"), ["l_partkey"], "l_suppkey")


@query(
    "matched_pairs",
    """with g as (select l_orderkey, l_linenumber, count(*) as n, count(distinct (l_returnflag, l_linestatus)) as b from lineitem group by 1, 2)
       select l_orderkey, l_linenumber, n as n_members, 'pair.cardinality' as code from g where n <> 2
       union all select l_orderkey, l_linenumber, n, 'pair.common_body' from g where b > 1""",
)
def matched_pairs(spark, sf):
    body = canonical_json({"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")})
    return factorial.matched_pairs(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], body)


@query(
    "replicate_determinism",
    r"""with d as (select sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'), ' ')) as content, sha256(text) as raw from documents)
       select content, count(*) as n_replicates, count(distinct raw) = 1 as identical, count(*) = 2 as complete from d group by 1""",
)
def replicate_determinism(spark, sf):
    rows = table(spark, sf, "documents").select(
        sha256_hex(whitespace_codec(F.lower("text"))).alias("content"), sha256_hex(F.col("text")).alias("raw")
    )
    return factorial.replicate_determinism(rows, ["content"], "raw", 2)


@query(
    "vector_policy",
    """with v as (select user_id, event_type, max(value) as top from events group by 1, 2),
            r as (select user_id, user_id % 2 = 0 as control, case when top > 120 then 'fail' else 'pass' end as state,
                         case when event_type = 'purchase' or (event_type = 'signup' and top > 150) then 'designated' when event_type = 'error' then 'correlated' else 'preserved' end as role from v)
       select user_id, code from (
         select user_id, 'policy.designated' as code from r group by 1 having count_if(role = 'designated') <> 1
         union all select user_id, 'policy.preserved' from r group by 1 having count_if(role = 'preserved' and state <> 'pass') > 0
         union all select user_id, 'policy.correlated' from r group by 1 having count_if(role = 'correlated' and state <> 'fail') > 0
         union all select user_id, 'policy.control' from r group by 1 having count_if(control and (role = 'correlated' or state <> 'pass')) > 0)""",
)
def vector_policy(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))
    kind, top = F.col("event_type"), F.col("top")
    role = (
        F.when((kind == "purchase") | ((kind == "signup") & (top > 150)), policy.DESIGNATED)
        .when(kind == "error", policy.CORRELATED)
        .otherwise(policy.PRESERVED)
    )
    rows = seen.select("user_id", role.alias("role"), F.when(top > 120, "fail").otherwise("pass").alias("state"))
    return policy.vector_issues(rows, ["user_id"], "role", "state", F.col("user_id") % 2 == 0)


@query(
    "eligibility_gates",
    f"""with c as (select source, {block_sql("source")} as block, count_if(toxic = 0 and quality = 0)::bigint as p, count_if(toxic = 0 and quality = 1)::bigint as n
                   from labels l join documents d on l.doc_id = d.doc_id group by 1, 2),
             g as (select role as gate, fold_id as scope, count(*) as n_groups, sum(p)::bigint as n_positive, sum(n)::bigint as n_negative from c join {SCHEDULE_SQL} on c.block = s.block group by 1, 2
                   union all select 'pooled_test', 'all', count(*), sum(p)::bigint, sum(n)::bigint from c
                   union all select 'application', source, 1, p, n from c)
        select gate, scope, m.metric, case m.metric when 'n_groups' then n_groups when 'n_positive' then n_positive else n_negative end as value, m.minimum::bigint as minimum,
               case m.metric when 'n_groups' then n_groups when 'n_positive' then n_positive else n_negative end >= m.minimum as passed
        from g join (values {", ".join(f"('{g}', '{m}', {v})" for g, ms in gates.GATES.items() for m, v in ms.items())}) m(g, metric, minimum) on g.gate = m.g""",
)
def eligibility_gates(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    rows = rows.withColumn("block", splits.block_of(F.col("source")))
    return gates.eligibility_gates(rows, "source", "block", F.col("quality") == 0, F.col("toxic") == 0)
