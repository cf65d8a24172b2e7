"""Two-record binding, alignment, diff and conformance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.identities import (
    stale,
    STALE_SQL,
    TOTAL_SQL,
    cents,
    order_body_sql,
    order_fields,
)
from pairwright.catalogue.registry import query
from pairwright.functions.canonical import byte_length, canonical_json, domain_id, sha256_hex
from pairwright.operators import bindings
from pairwright.operators.keyed import blocked_window
from pairwright.operators.rules import violations
from pairwright.sources.tables import table

GROUP_DOMAIN = "pairwright:customer-group:v1"


@query(
    "pair_binding",
    f"""with v as (select o_orderkey, o_custkey, o_orderpriority as p, sha256({order_body_sql()}) as d from orders where o_orderkey % 41 <> 7),
             s as (select o_orderkey, sha256({order_body_sql("case when " + STALE_SQL + " then " + TOTAL_SQL + " + 1 else " + TOTAL_SQL + " end")}) as d, o_orderkey % 37 = 5 as moved,
                     case when o_orderpriority = '5-LOW' then o_custkey + 1 else o_custkey end as c, case when o_orderkey % 31 = 3 then 'x' else o_orderpriority end as p
                   from orders where o_orderkey % 43 <> 9),
             j as (select v.o_orderkey, v.d <> s.d as manifest, v.o_custkey <> s.c as grp, v.p <> s.p as state, moved from v join s on v.o_orderkey = s.o_orderkey),
             a as (select distinct l_orderkey from lineitem where l_partkey % 53 = 8 and l_linestatus = 'F')
        select coalesce(v.o_orderkey, s.o_orderkey) as o_orderkey, 'pair.evidence_id' as code from v full join s on v.o_orderkey = s.o_orderkey where v.d is null or s.d is null
        union all select o_orderkey, 'pair.manifest_digest' from j where manifest
        union all select o_orderkey, 'pair.source_state_group' from j where grp
        union all select o_orderkey, 'pair.source_state_identity' from j where state
        union all select o_orderkey, 'pair.mutation_family_group' from j where moved
        union all select l_orderkey, 'pair.cas_overlap' from a""",
)
def pair_binding(spark, sf):
    orders = table(spark, sf, "orders")

    def identity(field, value):
        return domain_id("idsg1_", GROUP_DOMAIN, canonical_json({field: value}))

    total, key = cents(F.col("o_totalprice")), F.col("o_orderkey")
    visible = orders.where("o_orderkey % 41 <> 7").select(
        "o_orderkey", sha256_hex(canonical_json(order_fields())).alias("manifest"), "o_custkey", identity("state", F.col("o_orderpriority")).alias("state")
    )
    customer = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    sealed = orders.where("o_orderkey % 43 <> 9").select(
        "o_orderkey",
        sha256_hex(canonical_json(order_fields(F.when(stale(), total + 1).otherwise(total)))).alias("bound_manifest"),
        identity("o_custkey", customer).alias("source_group"),
        F.when(key % 31 == 3, "x").otherwise(F.col("o_orderpriority")).alias("source"),
        F.col("o_orderstatus").alias("family"),
        identity("family", F.when(key % 37 == 5, "other").otherwise(F.col("o_orderstatus"))).alias("family_group"),
    )
    bound = {
        "pair.manifest_digest": (F.col("manifest"), F.col("bound_manifest")),
        "pair.source_state_identity": (F.col("state"), identity("state", F.col("source"))),
        "pair.source_state_group": (identity("o_custkey", F.col("o_custkey")), F.col("source_group")),
    }
    own = {"pair.mutation_family_group": F.col("family_group") != identity("family", F.col("family"))}
    lines = table(spark, sf, "lineitem")
    salt = F.when((F.col("l_partkey") % 53 == 8) & (F.col("l_linestatus") == "F"), "").otherwise("sealed")

    def refs(*parts):
        body = F.concat_ws(":", *parts, *[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
        return lines.select(F.col("l_orderkey").alias("o_orderkey"), sha256_hex(body).alias("digest"))

    return bindings.pair_binding(visible, sealed, ["o_orderkey"], bound, own, (refs(F.lit("")), refs(salt), "digest"))


@query(
    "checkpoint_align",
    """with p as (select conv_id, role, row_number() over (partition by conv_id, role order by turn) - 1 as ordinal,
                  'idck1_' || sha256('pairwright:checkpoint:v1' || chr(0) || '{"conv_id":' || conv_id || ',"step":' || (turn // 2) || '}') as id
                  from conversations where role in ('user', 'assistant')),
            u as (select * from p where role = 'user'), a as (select * from p where role = 'assistant')
       select coalesce(u.conv_id, a.conv_id) as conv_id, coalesce(u.ordinal, a.ordinal) as ordinal, 'checkpoint.identity' as code
       from u full join a on u.conv_id = a.conv_id and u.ordinal = a.ordinal where u.id is distinct from a.id
       union all select conv_id, -1, 'checkpoint.count' from p group by 1 having count_if(role = 'user') <> count_if(role = 'assistant')""",
)
def checkpoint_align(spark, sf):
    turns = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    step = F.expr("turn div 2")
    identity = domain_id(
        "idck1_", "pairwright:checkpoint:v1", canonical_json({"conv_id": F.col("conv_id"), "step": step})
    )
    placed = blocked_window(
        turns.select("conv_id", "role", "turn", identity.alias("checkpoint_id")),
        ["conv_id", "role"],
        ["turn"],
        F.expr("turn div 4096"),
        position="ordinal",
    )
    return bindings.checkpoint_alignment(placed, "conv_id", "role", "ordinal", "checkpoint_id", "user", "assistant")


ALTERED_SQL = f"""select o_orderkey, o_custkey, case when {STALE_SQL} then {TOTAL_SQL} + 1 else {TOTAL_SQL} end as total_cents,
    case when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then null else o_orderstatus end as o_orderstatus, o_orderpriority from orders"""


def order_versions(spark, sf):
    """Orders and a copy with a changed total or a lost status."""
    orders = table(spark, sf, "orders")
    total = cents(F.col("o_totalprice"))
    left = orders.select("o_orderkey", "o_custkey", total.alias("total_cents"), "o_orderstatus", "o_orderpriority")
    status = F.when(
        ~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O")), F.col("o_orderstatus")
    )
    right = orders.select(
        "o_orderkey",
        "o_custkey",
        F.when(stale(), total + 1).otherwise(total).alias("total_cents"),
        status.alias("o_orderstatus"),
        "o_orderpriority",
    )
    return left, right


ORDER_FIELDS = ["o_custkey", "total_cents", "o_orderstatus", "o_orderpriority"]


@query(
    "field_binding",
    f"""with l as (select o_orderkey, {TOTAL_SQL} as t, o_orderstatus as s from orders), r as ({ALTERED_SQL})
        select l.o_orderkey, 'total_cents' as field, t::varchar as left_value, total_cents::varchar as right_value
        from l join r on l.o_orderkey = r.o_orderkey where t is distinct from total_cents
        union all select l.o_orderkey, 'o_orderstatus', s, o_orderstatus from l join r on l.o_orderkey = r.o_orderkey where s is distinct from o_orderstatus""",
)
def field_binding(spark, sf):
    left, right = order_versions(spark, sf)
    return bindings.field_differences(["o_orderkey"], left, right, ORDER_FIELDS)


@query(
    "first_mismatch",
    f"""with l as (select o_orderkey, {TOTAL_SQL} as t, o_orderstatus as s from orders), r as ({ALTERED_SQL}), z as (select max(o_orderkey) as z from orders),
             d as (select l.o_orderkey, 'total_cents' as field, t::varchar as left_value, total_cents::varchar as right_value
                   from l join r on l.o_orderkey = r.o_orderkey where t is distinct from total_cents
                   union all select l.o_orderkey, 'o_orderstatus', s, o_orderstatus from l join r on l.o_orderkey = r.o_orderkey where s is distinct from o_orderstatus),
             k as (select * from d where o_orderkey % 5 <> 1 union all select o_orderkey, '', 'present', null from l where o_orderkey % 5 = 1)
        select k.* from k, z where o_orderkey * 10 > z * 9 order by o_orderkey, field limit 1""",
)
def first_mismatch(spark, sf):
    left, right = order_versions(spark, sf)
    # both sides agree up to the last tenth of the keys
    late = F.col("o_orderkey") * 10 > left.agg(F.max("o_orderkey")).scalar() * 9
    right = left.where(~late).unionByName(right.where(late & (F.col("o_orderkey") % 5 != 1)))
    return bindings.first_mismatch(["o_orderkey"], left, right, ORDER_FIELDS, "o_orderkey")


@query(
    "unique_link",
    """with n as (select o_orderkey as k, coalesce(count_if(l_returnflag = 'R'), 0) as t, coalesce(count_if(l_returnflag = 'R' and l_linestatus = 'F'), 0) as l,
                  coalesce(count_if(l_returnflag = 'R' and l_linestatus = 'F' and l_discount <= 0.05), 0) as w
                  from orders left join lineitem on o_orderkey = l_orderkey group by 1)
       select k as snapshot, 'link.target_count' as code from n where t <> 1
       union all select k, 'link.linked_count' from n where l <> 1
       union all select k, 'link.role' from n where w > 0""",
)
def unique_link(spark, sf):
    snapshots = table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot"))
    nodes = table(spark, sf, "lineitem").withColumn("snapshot", F.col("l_orderkey"))
    return bindings.link_cardinality(
        snapshots,
        nodes,
        "snapshot",
        F.col("l_returnflag") == "R",
        F.col("l_linestatus") == "F",
        F.col("l_discount") > 0.05,
    )


@query(
    "snapshot_diff",
    """select p_partkey, true as p_name_equal, p_brand not in ('Brand#3', 'Brand#7') as p_brand_equal, p_type <> 'PROMO' as p_type_equal,
              p_size >= 10 as p_size_equal, true as p_retailprice_equal from part""",
)
def snapshot_diff(spark, sf):
    before = table(spark, sf, "part")
    after = before.select(
        "p_partkey",
        "p_name",
        F.when(F.col("p_brand").isin("Brand#3", "Brand#7"), "Brand#0").otherwise(F.col("p_brand")).alias("p_brand"),
        F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("p_type"),
        F.when(F.col("p_size") < 10, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"),
        "p_retailprice",
    )
    facets = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    return bindings.facet_equality(["p_partkey"], before, after, facets)


@query(
    "key_reuse",
    """with d as (select doc_id, source, sha256(text) as sha256 from documents),
            o as (select *, first_value(source) over (partition by sha256 order by doc_id) as first_slot from d)
       select doc_id, source, first_slot from o where source <> first_slot and not (first_slot = 'src1' and source = 'src2')""",
)
def key_reuse(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", sha256_hex(F.col("text")).alias("sha256"))
    reused = bindings.reused_keys(rows, "sha256", "source", "doc_id", allowed=[("src1", "src2")])
    return reused.select("doc_id", "source", "first_slot")


# Expected state per event type, in catalogue order.
EXPECTED_STATES = (("click", "pass"), ("error", "fail"), ("purchase", "pass"), ("signup", "pass"), ("view", "fail"))


@query(
    "policy_vector",
    """with e as (select user_id, ordinal, predicate, state from (select distinct user_id from events),
                  (values (0, 'click', 'pass'), (1, 'error', 'fail'), (2, 'purchase', 'pass'), (3, 'signup', 'pass'), (4, 'view', 'fail')) v(ordinal, predicate, state)),
            seen as (select user_id, event_type as predicate, case when max(value) > 120 then 'fail' else 'pass' end as state from events group by 1, 2),
            o as (select user_id, row_number() over (partition by user_id order by predicate) - 1 as ordinal, predicate, state from seen)
       select coalesce(e.user_id, o.user_id) as user_id, coalesce(e.ordinal, o.ordinal)::bigint as ordinal,
              case when o.user_id is null then 'conformance.missing' when e.user_id is null then 'conformance.unexpected' else 'conformance.value' end as code
       from e full join o on e.user_id = o.user_id and e.ordinal = o.ordinal
       where o.user_id is null or e.user_id is null or e.predicate <> o.predicate or e.state <> o.state""",
)
def policy_vector(spark, sf):
    events = table(spark, sf, "events")
    vector = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ordinal"), F.lit(name).alias("predicate"), F.lit(state).alias("state")
            )
            for i, (name, state) in enumerate(EXPECTED_STATES)
        ]
    )
    expected = events.select("user_id").distinct().select("user_id", F.explode(vector).alias("e"))
    state = F.when(F.max("value") > 120, "fail").otherwise("pass")
    seen = events.groupBy("user_id", F.col("event_type").alias("predicate")).agg(state.alias("state"))
    observed = blocked_window(seen, ["user_id"], ["predicate"], None, position="ordinal")
    return bindings.ordinal_conformance(
        ["user_id", "ordinal"], expected.select("user_id", "e.*"), observed, ["predicate", "state"]
    )


@query(
    "catalog_conformance",
    """with e as (select p_partkey, p_name, p_brand, p_type from part),
            a as (select p_partkey, p_name, case when p_type = 'SMALL' then 'Brand#0' else p_brand end as p_brand, p_type from part where p_type <> 'PROMO'
                  union all select -1 - p_partkey, p_name, p_brand, p_type from part where p_size = 50),
            r as (select p_partkey from part where p_size = 49 and p_type not in ('PROMO', 'SMALL'))
       select coalesce(e.p_partkey, a.p_partkey) as p_partkey, case when a.p_partkey is null then 'conformance.missing'
              when e.p_partkey is null then 'conformance.unexpected' else 'conformance.value' end as code
       from e full join a on e.p_partkey = a.p_partkey where a.p_partkey is null or e.p_partkey is null or e.p_brand <> a.p_brand
       union all select p_partkey, 'conformance.duplicate' from r""",
)
def catalog_conformance(spark, sf):
    values = ["p_name", "p_brand", "p_type"]
    expected = table(spark, sf, "part").select("p_partkey", *values)
    renamed = F.when(F.col("p_type") == "SMALL", "Brand#0").otherwise(F.col("p_brand")).alias("p_brand")
    kept = expected.where("p_type <> 'PROMO'").select("p_partkey", "p_name", renamed, "p_type")
    extra = table(spark, sf, "part").where("p_size = 50").select((-1 - F.col("p_partkey")).alias("p_partkey"), *values)
    # an upper-case copy sorts below its original, so only the count shows that the row is there twice
    repeated = expected.where("p_size = 49 and p_type not in ('PROMO', 'SMALL')").withColumn("p_name", F.upper("p_name"))
    return bindings.ordinal_conformance(["p_partkey"], expected, kept.unionByName(extra).unionByName(repeated), values)


@query(
    "resource_binding",
    """with m as (select page_id, sha256(html) as s, strlen(html) as n from pages),
            a as (select page_id, sha256(h) as s, strlen(h) as n from (select page_id, case when url like 'http://%' then html || ' ' else html end as h from pages where url not like '%#top'))
       select m.page_id, code from m left join a on m.page_id = a.page_id,
              (values ('resource.missing'), ('resource.sha256'), ('resource.byte_length')) c(code)
       where (code = 'resource.missing' and a.page_id is null) or (code = 'resource.sha256' and m.s <> a.s) or (code = 'resource.byte_length' and m.n <> a.n)""",
)
def resource_binding(spark, sf):
    pages = table(spark, sf, "pages")
    declared = pages.select(
        "page_id", sha256_hex(F.col("html")).alias("sha256"), byte_length(F.col("html")).alias("byte_length")
    )
    stored = F.when(F.col("url").startswith("http://"), F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    scanned = pages.where("not endswith(url, '#top')").select(
        "page_id", sha256_hex(stored).alias("found_sha256"), byte_length(stored).alias("found_bytes")
    )
    joined = declared.join(scanned, "page_id", "left")
    return violations(
        joined,
        ["page_id"],
        {
            "resource.missing": F.col("found_sha256").isNull(),
            "resource.sha256": F.col("sha256") != F.col("found_sha256"),
            "resource.byte_length": F.col("byte_length") != F.col("found_bytes"),
        },
    )
