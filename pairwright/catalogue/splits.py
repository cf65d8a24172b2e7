"""Split leakage, ownership, uniformity and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.identities import grouping_columns
from pairwright.catalogue.registry import query
from pairwright.functions.canonical import sha256_hex
from pairwright.operators import bindings, refs, splits
from pairwright.operators.rules import violations
from pairwright.sources.tables import table


def bucket_sql(key: str, n: int) -> str:
    return f"('0x' || substr(md5({key}::varchar), 1, 8))::bigint % {n}"


def partition_sql(key: str) -> str:
    draw = bucket_sql(key, 100)
    return f"case when {draw} < 10 then 'test' when {draw} < 20 then 'validation' else 'train' end"


@query(
    "split_leakage",
    f"""with d as (select doc_id, {partition_sql("doc_id")} as partition, case when doc_id % 7 <> 3 then lang end as lang, source, sha256(text) as text_digest from documents),
             g as (select doc_id, partition, 'lang' as group_key, lang as group_value from d
                   union all select doc_id, partition, 'source', source from d union all select doc_id, partition, 'text_digest', text_digest from d),
             o as (select *, first_value(partition) over (partition by group_key, group_value order by doc_id) as owner from g)
        select * from o where partition <> owner""",
)
def split_leakage(spark, sf):
    items = table(spark, sf, "documents").withColumn("partition", splits.hashed_partition(F.col("doc_id")))
    # a missing language is a group too
    lang = F.when(F.col("doc_id") % 7 != 3, F.col("lang"))
    groups = {"lang": lang, "source": F.col("source"), "text_digest": sha256_hex(F.col("text"))}
    return splits.leaking_items(
        splits.unpivot_groups(items, "doc_id", groups), ["group_key", "group_value"], "doc_id"
    )


@query(
    "observation_overlap",
    f"""with l as (select l_partkey, l_orderkey, l_linenumber, {partition_sql("l_orderkey")} as partition from lineitem),
             o as (select l_partkey, first_value(partition) over (partition by l_partkey order by l_orderkey) as owner, l_orderkey, l_linenumber, partition from l)
        select * from o where partition <> owner""",
)
def observation_overlap(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", splits.hashed_partition(F.col("l_orderkey")).alias("partition")
    )
    return splits.leaking_items(rows, ["l_partkey"], "l_orderkey")


@query(
    "uniformity",
    """with k as (select o_orderkey, case when o_custkey % 10 <> 3 then o_custkey end as o_custkey, o_orderstatus from orders),
            o as (select *, first_value(o_orderstatus) over (partition by o_custkey order by o_orderkey) as first_value from k)
       select * from o where o_orderstatus <> first_value""",
)
def uniformity(spark, sf):
    customer = F.when(F.col("o_custkey") % 10 != 3, F.col("o_custkey")).alias("o_custkey")
    rows = table(spark, sf, "orders").select("o_orderkey", customer, "o_orderstatus")
    return splits.not_uniform(rows, ["o_custkey"], "o_orderstatus", "o_orderkey")


SCHEDULE_SQL = "(values " + ", ".join(
    f"('{fold}', '{role}', '{block}')"
    for fold, train, validation, test in splits.ROLE_SCHEDULE
    for role, blocks in zip(splits.PARTITIONS, (train, validation, test))
    for block in blocks
) + ") s(fold_id, role, block)"


def block_sql(column: str) -> str:
    return f"'block_' || ({bucket_sql(column, 4)})"


@query(
    "fold_roles",
    f"""select doc_id, s.block, fold_id, role from (select doc_id, {block_sql("source")} as block from documents) d
        join {SCHEDULE_SQL} on d.block = s.block""",
)
def fold_roles(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", splits.block_of(F.col("source")).alias("block"))
    return splits.fold_roles(items).select("doc_id", "block", "fold_id", "role")


@query(
    "fold_balance",
    f"""select fold_id, role, lang, count(*) as n_items from (select lang, {block_sql("source")} as block from documents) d
        join {SCHEDULE_SQL} on d.block = s.block group by rollup (fold_id, role, lang)""",
)
def fold_balance(spark, sf):
    items = table(spark, sf, "documents").select("lang", splits.block_of(F.col("source")).alias("block"))
    return splits.fold_balance(items, "block", "lang")


BUNDLE_SQL = f"""
with d as (select doc_id, {partition_sql("doc_id")} as partition, lang, source, sha256(text) as t from documents),
     m as (select d.*, '{{"lang":"' || lang || '","sha256":"' || t || '","source":"' || source || '"}}' as nb from d),
     g as (select doc_id, partition, 'source_state_group_id' as gk, t as gv from m
           union all select doc_id, partition, 'source_task_group_id', lang || t from m
           union all select doc_id, partition, 'near_duplicate_group_id', nb from m
           union all select doc_id, partition, 'asset_component_id', t from m
           union all select doc_id, partition, 'application_group_id', source from m),
     o as (select *, first_value(partition) over (partition by gk, gv order by doc_id) as owner from g),
     lines as (select doc_id, partition, sha256(unnest(string_split(text, chr(10)))) as h from (select doc_id, {partition_sql("doc_id")} as partition, text from documents)),
     lo as (select doc_id, partition, h, first_value(partition) over (partition by h order by doc_id) as owner from lines)
select doc_id::varchar as subject, 'split_bundle.group_overlap:' || gk as code from o where partition <> owner
union all select coalesce(x.doc_id, l.doc_id)::varchar, case when x.doc_id is null then 'membership.unexpected' else 'membership.missing' end
  from d x full join labels l on x.doc_id = l.doc_id where x.doc_id is null or l.doc_id is null
union all select doc_id::varchar, 'dataset.duplicate_pair' from d group by 1 having count(*) > 1
union all select doc_id::varchar, 'dataset.label_policy' from (select doc_id, lang, first_value(lang) over (partition by source order by doc_id) as f from d) where lang <> f
union all select distinct doc_id::varchar, 'dataset.artifact_partition_overlap' from lo where partition <> owner
union all select distinct h, 'dataset.cas_overlap' from lines where h in (select sha256(unnest(string_split(text, chr(10)))) from benchmark)
"""


@query("dataset_bundle", BUNDLE_SQL)
def dataset_bundle(spark, sf):
    """One violations table for a whole split: membership, uniqueness, uniformity, leakage, overlap."""
    documents = table(spark, sf, "documents").withColumn("partition", splits.hashed_partition(F.col("doc_id")))
    bound = documents.withColumn("sha256", sha256_hex(F.col("text")))
    keyed = bound.select("doc_id", "partition", *grouping_columns())
    names = splits.disjoint_groups("application_holdout")

    def subject(frame, code):
        return frame.select(F.col("doc_id").cast("string").alias("subject"), code.alias("code"))

    overlap = splits.leaking_items(
        splits.unpivot_groups(keyed, "doc_id", {n: F.col(n) for n in names}), ["group_key", "group_value"], "doc_id"
    )
    membership = bindings.membership(["doc_id"], documents, table(spark, sf, "labels"))
    repeated = refs.duplicate_keys(documents, ["doc_id"], F.col("doc_id"))
    mixed = splits.not_uniform(documents.select("doc_id", "source", "lang"), ["source"], "lang", "doc_id")
    lines = documents.select("doc_id", "partition", F.explode(F.split("text", "\n")).alias("line")).select(
        "doc_id", "partition", sha256_hex(F.col("line")).alias("sha256")
    )
    observed = splits.leaking_items(lines, ["sha256"], "doc_id").select("doc_id").distinct()
    sealed = table(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    shared = refs.shared_digests(lines, sealed.select(sha256_hex(F.col("line")).alias("sha256")))
    return (
        subject(overlap, F.concat(F.lit("split_bundle.group_overlap:"), F.col("group_key")))
        .unionByName(subject(membership, F.col("code")))
        .unionByName(subject(repeated, F.lit("dataset.duplicate_pair")))
        .unionByName(subject(mixed, F.lit("dataset.label_policy")))
        .unionByName(subject(observed, F.lit("dataset.artifact_partition_overlap")))
        .unionByName(shared.select(F.col("sha256").alias("subject"), F.lit("dataset.cas_overlap").alias("code")))
    )
