"""Canonical JSON, digests and content-derived identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.functions import canonical as C
from pairwright.functions.jsontext import json_defect
from pairwright.operators.bindings import replay_differences
from pairwright.operators.refs import same_tables, table_digest
from pairwright.operators.rules import IDENTIFIER_PATTERN, mismatched, violations
from pairwright.sources.tables import table

ORDER_DOMAIN = "pairwright:order:v1"


def cents(value: Column) -> Column:
    return F.rint(value * 100).cast("long")


def order_fields(total: Column | None = None) -> dict[str, Column]:
    return {
        "o_orderkey": F.col("o_orderkey"),
        "o_custkey": F.col("o_custkey"),
        "o_orderstatus": F.col("o_orderstatus"),
        "o_orderpriority": F.col("o_orderpriority"),
        "total_cents": cents(F.col("o_totalprice")) if total is None else total,
    }


def order_id(total: Column | None = None) -> Column:
    return C.domain_id("idor1_", ORDER_DOMAIN, C.canonical_json(order_fields(total)))


TOTAL_SQL = "round_even(o_totalprice * 100, 0)::bigint"


def order_body_sql(total: str = TOTAL_SQL, alias: str = "") -> str:
    return (
        f"""'{{"o_custkey":' || {alias}o_custkey || ',"o_orderkey":' || {alias}o_orderkey || ',"o_orderpriority":"' || """
        f"""{alias}o_orderpriority || '","o_orderstatus":"' || {alias}o_orderstatus || '","total_cents":' || {total} || '}}'"""
    )


def order_id_sql(total: str = TOTAL_SQL) -> str:
    return f"'idor1_' || sha256('{ORDER_DOMAIN}' || chr(0) || {order_body_sql(total)})"


# stored identities of urgent, finished orders were computed before the total changed
def stale() -> Column:
    return (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")


STALE_SQL = "o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"


@query(
    "canonical_json",
    f"select o_orderkey, {order_body_sql()} as body, strlen({order_body_sql()}) as body_bytes from orders",
)
def canonical_json(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", C.canonical_json(order_fields()).alias("body"))
    return orders.withColumn("body_bytes", C.byte_length(F.col("body")))


@query(
    "src_json_props",
    """select event_id, json_extract(props, '$.k')::bigint as k,
              '{"k":' || json_extract(props, '$.k')::bigint || '}' as canonical_text,
              props = '{"k":' || json_extract(props, '$.k')::bigint || '}' as canonical
       from events""",
)
def src_json_props(spark, sf):
    parsed = table(spark, sf, "events").select("event_id", "props", F.from_json("props", "k long").alias("o"))
    text = C.canonical_json({"k": F.col("o.k")})
    return parsed.select(
        "event_id", F.col("o.k").alias("k"), text.alias("canonical_text"), (text == F.col("props")).alias("canonical")
    )


@query(
    "noncanonical_props",
    """select event_id, event_type, 'json.noncanonical' as code from events
       where (case when event_type = 'click' then replace(props, ' ', '') else props end)
             <> '{"k":' || json_extract(props, '$.k')::bigint || '}'""",
)
def noncanonical_props(spark, sf):
    text = F.when(F.col("event_type") == "click", F.replace("props", F.lit(" "), F.lit(""))).otherwise(F.col("props"))
    broken = ~C.is_canonical(text, "k long", lambda o: {"k": o["k"]})
    return violations(table(spark, sf, "events"), ["event_id", "event_type"], {"json.noncanonical": broken})


@query(
    "json_defects",
    """select event_id, case event_type when 'click' then null
                when 'error' then 'json.duplicate_key' when 'purchase' then 'json.non_integer_number'
                when 'signup' then 'json.syntax' else 'json.noncanonical' end as code
       from events""",
)
def json_defects(spark, sf):
    tight = F.replace("props", F.lit(" "), F.lit(""))
    text = (
        F.when(F.col("event_type") == "click", tight)
        .when(F.col("event_type") == "error", F.replace(tight, F.lit("}"), F.lit(',"k":0}')))
        .when(F.col("event_type") == "purchase", F.replace(tight, F.lit("}"), F.lit(".5}")))
        .when(F.col("event_type") == "signup", F.replace(tight, F.lit("}"), F.lit("")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", json_defect(text).alias("code"))


@query("content_digest", "select doc_id, sha256(text) as sha256, strlen(text) as byte_length from documents")
def content_digest(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", C.sha256_hex(text).alias("sha256"), C.byte_length(text).alias("byte_length")
    )


@query("domain_identity", f"select o_orderkey, {order_id_sql()} as order_id from orders")
def domain_identity(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", order_id().alias("order_id"))


@query(
    "identity_audit",
    f"""select o_orderkey, stored_id, {order_id_sql()} as derived_id
        from (select *, case when {STALE_SQL} then {order_id_sql(TOTAL_SQL + " + 1")} else {order_id_sql()} end
              as stored_id from orders)
        where stored_id <> {order_id_sql()}""",
)
def identity_audit(spark, sf):
    total = cents(F.col("o_totalprice"))
    stored = F.when(stale(), order_id(total + 1)).otherwise(order_id())
    both = table(spark, sf, "orders").select("o_orderkey", stored.alias("stored_id"), order_id().alias("derived_id"))
    return both.where("stored_id <> derived_id")


@query(
    "id_pattern",
    rf"""with ids as (
          select o_orderkey, case o_orderstatus when 'P' then upper({order_id_sql()})
                 when 'O' then left({order_id_sql()}, 50) else {order_id_sql()} end as id from orders)
        select o_orderkey, 'schema.pattern' as code from ids
        where not regexp_matches(id, '^id[a-z][a-z]1_[0-9a-f]{{64}}$')""",
)
def id_pattern(spark, sf):
    made = order_id()
    spelled = (
        F.when(F.col("o_orderstatus") == "P", F.upper(made))
        .when(F.col("o_orderstatus") == "O", F.substring(made, 1, 50))
        .otherwise(made)
    )
    rows = table(spark, sf, "orders").select("o_orderkey", spelled.alias("id"))
    return violations(rows, ["o_orderkey"], {"schema.pattern": mismatched(F.col("id"), IDENTIFIER_PATTERN)})


@query(
    "grouping_keys",
    """with d as (select doc_id, lang, source, sha256(text) as t from documents)
       select doc_id,
         'idag1_' || sha256('pairwright:application-group:v1' || chr(0) || '{"source":"' || source || '"}') as application_group_id,
         'idsg1_' || sha256('pairwright:source-state-group:v1' || chr(0) || '{"sha256":"' || t || '"}') as source_state_group_id,
         'idtg1_' || sha256('pairwright:source-task-group:v1' || chr(0) || '{"lang":"' || lang || '","sha256":"' || t || '"}') as source_task_group_id,
         'idng1_' || sha256('pairwright:near-duplicate-group:v1' || chr(0) || '{"lang":"' || lang || '","sha256":"' || t || '","source":"' || source || '"}') as near_duplicate_group_id,
         'idac1_' || sha256('pairwright:asset-component:v1' || chr(0) || '{"sha256":"' || t || '"}') as asset_component_id,
         'idmg1_' || sha256('pairwright:mutation-family-group:v1' || chr(0) || '{"lang":"' || lang || '"}') as mutation_family_group_id
       from d""",
)
def grouping_keys(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", C.sha256_hex(F.col("text")).alias("sha256"))
    return rows.select("doc_id", *grouping_columns())


def grouping_columns() -> list[Column]:
    """The six grouping identities, each over its own subset of the binding."""
    # Which binding fields make up each grouping identity.
    parts = (
        ("application_group_id", "idag1_", "application-group", ("source",)),
        ("source_state_group_id", "idsg1_", "source-state-group", ("sha256",)),
        ("source_task_group_id", "idtg1_", "source-task-group", ("lang", "sha256")),
        ("near_duplicate_group_id", "idng1_", "near-duplicate-group", ("lang", "sha256", "source")),
        ("asset_component_id", "idac1_", "asset-component", ("sha256",)),
        ("mutation_family_group_id", "idmg1_", "mutation-family-group", ("lang",)),
    )
    return [
        C.domain_id(prefix, f"pairwright:{domain}:v1", C.canonical_json({f: F.col(f) for f in fields})).alias(name)
        for name, prefix, domain, fields in parts
    ]


@query(
    "replay_compare",
    """with derived as (select l_orderkey, count(*) as n_lines, sum(round_even(l_extendedprice * 100, 0)::bigint)::bigint as total_cents
                        from lineitem group by 1),
            stored as (select l_orderkey, count(*) as n_lines, sum(round_even(l_extendedprice * 100, 0)::bigint)::bigint as total_cents
                        from lineitem where not (l_returnflag = 'R' and l_linenumber = 7) group by 1)
       select coalesce(d.l_orderkey, s.l_orderkey) as l_orderkey,
              case when s.l_orderkey is null then 'replay.missing' when d.l_orderkey is null then 'replay.unexpected'
                   else 'replay.digest' end as code
       from derived d full join stored s on d.l_orderkey = s.l_orderkey
       where d.n_lines is distinct from s.n_lines or d.total_cents is distinct from s.total_cents""",
)
def replay_compare(spark, sf):
    lines = table(spark, sf, "lineitem")

    def report(rows):
        return rows.groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("n_lines"), F.sum(cents(F.col("l_extendedprice"))).alias("total_cents")
        )

    stored = report(lines.where("not (l_returnflag = 'R' and l_linenumber = 7)"))
    fields = {"n_lines": F.col("n_lines"), "total_cents": F.col("total_cents")}
    return replay_differences(report(lines), stored, ["l_orderkey"], C.canonical_json(fields))


@query(
    "table_digest",
    f"""select count(*) as n_rows, sum(('0x' || substr(md5({order_body_sql()}), 1, 15))::bigint)::varchar as digest_sum,
              bit_xor(('0x' || substr(md5({order_body_sql()}), 16, 15))::bigint) as digest_xor
        from orders""",
)
def digest_of_table(spark, sf):
    return table_digest(table(spark, sf, "orders"), C.canonical_json(order_fields()))


@query(
    "run_invariance",
    """select 'first' as run, count(*) as n_rows, true as equal from orders union all select 'reordered', count(*), true from orders
       union all select 'perturbed', count(*), count(*) = 0 from orders union all select 'shortened', count(*) filter (where o_orderkey % 7 <> 0), count_if(o_orderkey % 7 = 0) = 0 from orders""",
)
def run_invariance(spark, sf):
    """A second run over reordered rows with sealed columns added must give the same table; altered or missing rows must not."""
    orders = table(spark, sf, "orders")
    runs = {
        "first": orders,
        "reordered": orders.repartition(3, "o_orderkey").sortWithinPartitions(F.desc("o_custkey")).withColumn("sealed", F.lit("x")),
        "perturbed": orders.withColumn("o_custkey", F.col("o_custkey") + 1),
        "shortened": orders.where("o_orderkey % 7 <> 0"),
    }
    return same_tables(runs, C.canonical_json(order_fields()))
