"""Tree queries over world > region > nation > customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.operators import trees
from pairwright.operators.keyed import blocked_window
from pairwright.session import cut_lineage
from pairwright.sources.tables import table


def place_nodes(spark, sf):
    """Node table with a text id, the parent id and the sibling ordinal."""

    def level(name, prefix, key, parent_prefix, parent):
        ordinal = F.col(key).cast("long")
        return table(spark, sf, name).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node"),
            F.concat(F.lit(parent_prefix), F.col(parent).cast("string")).alias("parent"),
            ordinal.alias("ordinal"),
        )

    regions = level("region", "r", "r_regionkey", "r", "r_regionkey").withColumn("parent", F.lit("w"))
    nations = level("nation", "n", "n_nationkey", "r", "n_regionkey")
    customers = level("customer", "c", "c_custkey", "n", "c_nationkey")
    root = spark.range(1).select(F.lit("w").alias("node"), F.lit(None).cast("string").alias("parent"), "id")
    return root.withColumnRenamed("id", "ordinal").unionByName(regions).unionByName(nations).unionByName(customers)


NODES_SQL = """nodes as (select 'w' as node, null::varchar as parent, 0::bigint as ordinal, '' as path, 0 as depth
   union all select 'r' || r_regionkey, 'w', r_regionkey, lpad(r_regionkey::varchar, 12, '0'), 1 from region
   union all select 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, lpad(n_regionkey::varchar, 12, '0') || lpad(n_nationkey::varchar, 12, '0'), 2 from nation
   union all select 'c' || c_custkey, 'n' || c_nationkey, c_custkey, lpad(n_regionkey::varchar, 12, '0') || lpad(n_nationkey::varchar, 12, '0') || lpad(c_custkey::varchar, 12, '0'), 3
      from customer join nation on c_nationkey = n_nationkey)"""

PREORDER_SQL = NODES_SQL + """, pre as (select node, parent, ordinal, depth, row_number() over (order by path) - 1 as index from nodes)"""


@query(
    "tree_preorder",
    f"""with {PREORDER_SQL} select p.node, p.parent, p.index, q.index as parent_index, p.depth::bigint as depth
        from pre p left join pre q on p.parent = q.node""",
)
def tree_preorder(spark, sf):
    return trees.preorder(place_nodes(spark, sf))


@query(
    "tree_audit",
    """with recursive raw as (
         select 'w' as node, null::varchar as parent union all select 'r' || r_regionkey, 'w' from region
         union all select 'n' || n_nationkey, case when n_nationkey = 7 then 'r9' else 'r' || n_regionkey end from nation
         union all select 'c' || c_custkey, case when c_mktsegment = 'HOUSEHOLD' and c_acctbal < -500 then 'n99' when c_mktsegment = 'BUILDING' and c_acctbal > 9500 then 'c' || c_custkey
                   when c_mktsegment = 'FURNITURE' and c_acctbal > 9500 then null else 'n' || c_nationkey end from customer
         union all select 'c' || c_custkey, 'n0' from customer where c_mktsegment = 'MACHINERY' and c_acctbal > 9000
         union all select 'p' || p_partkey, case when (p_partkey - 1) % 200 > 0 then 'p' || (p_partkey - 1) when (p_partkey - 1) // 200 % 2 = 0 then 'w' else 'p' || (p_partkey + 199) end from part),
       f as (select node, count(*) as n, min(parent) as parent, max(parent) as other from raw group by 1),
       up(node, above, d) as (select node, parent, 1 from f where parent is not null
            union all select up.node, f.parent, d + 1 from up join f on up.above = f.node where f.parent is not null and d < 420),
       last as (select node, arg_max(above, d) as top, max(d) as d from up group by 1),
       t as (select l.*, top not in (select node from f) as lost, d >= 420 as loops from last l)
     select node, 'tree.duplicate_id' as code from f where n > 1
     union all select node, 'tree.two_parents' from f where parent <> other
     union all select node, 'tree.dangling_parent' from t where lost and d = 1
     union all select node, 'tree.disconnected' from t where lost and d > 1
     union all select node, 'tree.cycle' from t where loops
     union all select node, 'tree.depth' from t where d > 64 and not loops
     union all select null, 'tree.root_count' from raw having count_if(parent is null) <> 1""",
)
def tree_audit(spark, sf):
    nodes = place_nodes(spark, sf).select("node", "parent")
    facts = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "c_mktsegment", "c_acctbal"
    )
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    joined = nodes.join(facts, "node", "left")
    moved = (
        F.when((segment == "HOUSEHOLD") & (balance < -500), "n99")
        .when((segment == "BUILDING") & (balance > 9500), F.col("node"))
        .when((segment == "FURNITURE") & (balance > 9500), F.lit(None))
        .when(F.col("node") == "n7", "r9")
        .otherwise(F.col("parent"))
    )
    again = facts.where((segment == "MACHINERY") & (balance > 9000)).select("node", F.lit("n0").alias("parent"))
    # parts make chains and circles of two hundred nodes
    key = F.col("p_partkey")
    before = F.concat(F.lit("p"), (key - 1).cast("string"))
    closing = F.when(F.expr("(p_partkey - 1) div 200 % 2 = 0"), F.lit("w")).otherwise(F.concat(F.lit("p"), (key + 199).cast("string")))
    deep = table(spark, sf, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("node"), F.when((key - 1) % 200 > 0, before).otherwise(closing).alias("parent")
    )
    return trees.tree_issues(joined.select("node", moved.alias("parent")).unionByName(again).unionByName(deep))


IGNORED_SQL = "(node like 'n%' and ordinal % 3 = 0)"


def ignored_nations():
    return F.col("node").startswith("n") & (F.col("ordinal") % 3 == 0)


@query(
    "tree_splice",
    f"""with {PREORDER_SQL}, up as (select p.*, case when exists (select 1 from pre q where q.node = p.parent and {IGNORED_SQL.replace("node", "q.node").replace("ordinal", "q.ordinal")})
                 then (select q.parent from pre q where q.node = p.parent) else p.parent end as lifted from pre p where not {IGNORED_SQL})
       select node, lifted as parent, case when lifted is null then 0 else row_number() over (partition by lifted order by index) - 1 end as ordinal from up""",
)
def tree_splice(spark, sf):
    return trees.splice(place_nodes(spark, sf), ignored_nations())


@query(
    "subtree_exclude",
    f"""with {NODES_SQL} select node from nodes where not (node in ('r1', 'r3') or coalesce(parent, '') in ('r1', 'r3')
        or coalesce(parent, '') in (select 'n' || n_nationkey from nation where n_regionkey in (1, 3)))""",
)
def subtree_exclude(spark, sf):
    nodes = place_nodes(spark, sf)
    return trees.exclude_subtrees(nodes, nodes.where(F.col("node").isin("r1", "r3")))


@query(
    "nearest_ancestor",
    f"""with {NODES_SQL} select n.node, case when p.node like 'n%' and p.ordinal % 3 = 0 then p.parent else n.parent end as nearest,
           case when p.node like 'n%' and p.ordinal % 3 = 0 then 2 else 1 end::bigint as distance
        from nodes n join nodes p on n.parent = p.node""",
)
def nearest_ancestor(spark, sf):
    nodes = place_nodes(spark, sf)
    return trees.nearest_retained(nodes, ~ignored_nations())


@query(
    "preorder_audit",
    f"""with {PREORDER_SQL}, b as (select p.index, q.index as parent_index, row_number() over (partition by p.parent order by p.index) - 1 as child_ordinal, c_mktsegment as s, c_acctbal as a
               from pre p left join pre q on p.parent = q.node left join customer on p.node = 'c' || c_custkey),
             f as (select index, case when s = 'HOUSEHOLD' and a > 9500 then 1 when s = 'MACHINERY' and a > 9800 then index + 1 else parent_index end as parent_index,
                   case when index = 0 then 0 when s = 'BUILDING' and a > 9500 then child_ordinal + 1 else child_ordinal end as child_ordinal from b),
             e as (select index, row_number() over (partition by parent_index order by index) - 1 as expected from f where parent_index < index),
             w as (select index, case when parent_index < index then parent_index end as back from f),
             recursive_line as (select f.index, f.parent_index, f.child_ordinal, g.index as i1, g.back as i2, h.back as i3, k.back as i4 from f
                left join w g on g.index = f.index - 1 left join w h on h.index = g.back left join w k on k.index = h.back)
        select index, 'tree.parent_order' as code from f where parent_index >= index and parent_index <= (select max(index) from f)
        union all select index, 'tree.dangling_parent' from f where index > 0 and parent_index not between 0 and (select max(index) from f)
        union all select index, 'tree.preorder' from recursive_line where index > 0 and parent_index < index and parent_index is distinct from i1
            and parent_index is distinct from i2 and parent_index is distinct from i3 and parent_index is distinct from i4
        union all select f.index, 'tree.child_order' from f join e on f.index = e.index where f.index > 0 and child_ordinal <> expected""",
)
def preorder_audit(spark, sf):
    nodes = place_nodes(spark, sf)
    facts = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "c_mktsegment", "c_acctbal"
    )
    children = nodes.where("parent is not null")
    block = F.floor(F.col("ordinal") / trees.SIBLING_BLOCK)
    numbered = blocked_window(children, ["parent"], ["ordinal"], block, position="child_ordinal")
    rows = (
        trees.preorder(nodes)
        .join(numbered.select("node", "child_ordinal"), "node", "left")
        .fillna(0, "child_ordinal")
        .join(facts, "node", "left")
    )
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    parent = (
        F.when((segment == "HOUSEHOLD") & (balance > 9500), 1)
        .when((segment == "MACHINERY") & (balance > 9800), F.col("index") + 1)
        .otherwise(F.col("parent_index"))
    )
    ordinal = F.when((segment == "BUILDING") & (balance > 9500), F.col("child_ordinal") + 1).otherwise(
        F.col("child_ordinal")
    )
    stored = rows.select("index", parent.cast("long").alias("parent_index"), ordinal.alias("child_ordinal"))
    return trees.preorder_issues(cut_lineage(stored))


@query(
    "tree_edit",
    """with b as (select n_regionkey as region, n_nationkey || '/' || c_custkey as path, c_mktsegment as label from customer join nation on c_nationkey = n_nationkey),
            a as (select n_regionkey as region, n_nationkey || '/' || c_custkey as path, case when c_acctbal < 0 then 'DEBTOR' else c_mktsegment end as label
                  from customer join nation on case when c_mktsegment = 'BUILDING' then (c_nationkey + 1) % 25 else c_nationkey end = n_nationkey where c_acctbal <= 9500),
            m as (select coalesce(b.region, a.region) as region, b.label as bl, a.label as al from b full join a on b.region = a.region and b.path = a.path)
       select region, count_if(bl is null)::bigint as inserts, count_if(al is null)::bigint as deletes, count_if(bl <> al)::bigint as relabels,
              (count_if(bl is null) + count_if(al is null) + count_if(bl <> al))::bigint as cost from m group by 1""",
)
def tree_edit(spark, sf):
    nations = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").alias("region"))

    def variant(customers, nation, label):
        path = F.concat(nation.cast("string"), F.lit("/"), F.col("c_custkey").cast("string"))
        rows = customers.select(nation.alias("n_nationkey"), path.alias("path"), label.alias("label"))
        return rows.join(nations, "n_nationkey").select("region", "path", "label")

    customers = table(spark, sf, "customer")
    home = F.col("c_nationkey")
    moved = F.when(F.col("c_mktsegment") == "BUILDING", (home + 1) % 25).otherwise(home)
    label = F.when(F.col("c_acctbal") < 0, "DEBTOR").otherwise(F.col("c_mktsegment"))
    baseline = variant(customers, home, F.col("c_mktsegment"))
    candidate = variant(customers.where("c_acctbal <= 9500"), moved, label)
    return trees.edit_costs(baseline, candidate, "region", "path", "label")


@query(
    "role_alias",
    """select event_id, case event_type when 'click' then 'button' when 'view' then 'document' when 'signup' then 'form' when 'purchase' then 'text' end as role,
              case when event_type = 'error' then 'accessibility.role' end as code from events""",
)
def role_alias(spark, sf):
    kind = F.col("event_type")
    raw = F.when(kind == "click", "button").when(kind == "view", "WebArea").when(kind == "signup", "form")
    raw = raw.when(kind == "purchase", "StaticText").otherwise(kind)
    role = trees.role_alias(raw)
    return table(spark, sf, "events").select(
        "event_id", role.alias("role"), F.when(role.isNull(), "accessibility.role").alias("code")
    )


@query(
    "state_set",
    """with p as (select l_orderkey, unnest([case when l_returnflag = 'R' then 'required' end,
                 case when l_linestatus = 'O' then 'expanded' else 'collapsed' end, case when l_discount > 0.05 then 'checked' when l_discount = 0.05 then 'checked:mixed' end,
                 case when l_tax > 0.07 then 'invalid' end]) as s from lineitem)
       select l_orderkey, coalesce(string_agg(distinct s, ',' order by s), '') as states from p group by 1""",
)
def state_set(spark, sf):
    def prop(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def flag(condition):
        return condition.cast("string")

    checked = F.when(F.col("l_discount") > 0.05, "true").when(F.col("l_discount") == 0.05, "mixed").otherwise("false")
    entries = F.array(
        prop("required", flag(F.col("l_returnflag") == "R")),
        prop("expanded", flag(F.col("l_linestatus") == "O")),
        prop("checked", checked),
        prop("invalid", F.when(F.col("l_tax") > 0.07, "spelling").otherwise("false")),
        prop("level", F.col("l_linenumber").cast("string")),
    )
    lines = table(spark, sf, "lineitem")
    properties = lines.select("l_orderkey", F.explode(entries).alias("p"))
    sets = trees.state_sets(properties.select("l_orderkey", "p.*"), ["l_orderkey"], "name", "value")
    return sets.select("l_orderkey", F.array_join("states", ",").alias("states"))


@query(
    "child_list_audit",
    f"""with recursive {NODES_SQL}, c as (select 'c' || c_custkey as id, c_mktsegment as s, c_acctbal as a from customer),
         told as (select node, case when s = 'HOUSEHOLD' and a < -900 then 'n99' when s = 'FURNITURE' and a < -900 then 'n0' when s = 'AUTOMOBILE' and a < 0 then null
                         when node in ('n3', 'n4') then case node when 'n3' then 'c3' else 'c4' end else parent end as parent, node like 'n%' and ordinal % 3 = 0 as ignored
                  from nodes left join c on node = id),
         lists as (select case when node in ('n3', 'n4') then case node when 'n3' then 'c3' else 'c4' end else parent end as node, node as child from nodes left join c on node = id
                   where parent is not null and not (coalesce(s, '') = 'BUILDING' and a > 9800)
              union all select 'n1', id from c where s = 'MACHINERY' and a > 9700 union all select parent, node from nodes join c on node = id where s = 'MACHINERY' and a < -950
              union all select 'n' || s_nationkey, 's' || s_suppkey from supplier),
         listed as (select child, count(*) as n, min(node) as lister from lists group by 1),
         known as (select t.*, coalesce(n, 0) as n, lister from told t left join listed on child = node),
         line(node, above, d) as (select node, lister, 1 from known where lister is not null
              union all select l.node, k.lister, d + 1 from line l join known k on l.above = k.node where k.lister is not null and d < 70),
         last as (select node, max(d) as d from line group by 1),
         circle as (select distinct node from line where node = above)
       select l.node, l.child, 'accessibility.dangling_child' as code from (select distinct node, child from lists) l where l.child not in (select node from told)
       union all select distinct l.node, l.child, 'accessibility.duplicate_child' from lists l join listed q on l.child = q.child where q.n > 1
       union all select null, node, 'accessibility.dangling_parent' from told where parent not in (select node from told)
       union all select lister, node, 'accessibility.parent_mismatch' from known where parent in (select node from told) and n <= 1 and lister is distinct from parent
       union all select null, node, 'accessibility.cycle' from circle
       union all select null, node, 'accessibility.disconnected' from last where d >= 70 and node not in (select node from circle)
       union all select null, node, 'accessibility.root' from known where n = 0 and ignored
       union all select null, null, 'accessibility.root_count' from known having count_if(n = 0) <> 1""",
)
def child_list_audit(spark, sf):
    facts = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), "c_mktsegment", "c_acctbal")
    segment, balance = F.coalesce("c_mktsegment", F.lit("")), F.col("c_acctbal")
    nodes = place_nodes(spark, sf).join(facts, "node", "left")
    # two nations are told and listed below customers of other nations, which may close circles
    below = F.when(F.col("node") == "n3", "c3").when(F.col("node") == "n4", "c4")
    told = (
        F.when((segment == "HOUSEHOLD") & (balance < -900), "n99")
        .when((segment == "FURNITURE") & (balance < -900), "n0")
        .when((segment == "AUTOMOBILE") & (balance < 0), F.lit(None))
        .otherwise(F.coalesce(below, "parent"))
    )
    unlisted = F.coalesce((segment == "BUILDING") & (balance > 9800), F.lit(False))
    lister = F.coalesce(below, "parent")
    lists = nodes.where(F.col("parent").isNotNull() & ~unlisted).select(lister.alias("node"), F.col("node").alias("child"))
    again = nodes.where((segment == "MACHINERY") & (balance > 9700)).select(F.lit("n1").alias("node"), F.col("node").alias("child"))
    twice = nodes.where((segment == "MACHINERY") & (balance < -950)).select(F.col("parent").alias("node"), F.col("node").alias("child"))
    unknown = table(spark, sf, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("node"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("child")
    )
    every = lists.unionByName(again).unionByName(twice).unionByName(unknown)
    return trees.child_list_issues(nodes.select("node", told.alias("parent"), ignored_nations().alias("ignored")), every, ignored="ignored")


@query(
    "state_values",
    """with p as (select l_orderkey, l_linenumber, unnest([{'n': 'checked', 'v': case l_returnflag when 'R' then 'mixed' when 'A' then 'true' else 'maybe' end},
                  {'n': 'expanded', 'v': case when l_quantity > 40 then '7' when l_quantity > 20 then 'true' else 'false' end},
                  {'n': case when l_suppkey % 9 = 0 then '' when l_suppkey % 9 = 1 then repeat('n', 65) else 'level' end, 'v': 'any'},
                  {'n': case when l_partkey % 7 = 0 then 'checked' when l_partkey % 7 = 1 then null else 'editable' end, 'v': case when l_tax > 0.04 then 'plaintext' when l_tax > 0.02 then 'none' end},
                  {'n': 'invalid', 'v': case l_linestatus when 'F' then 'grammar' else 'perhaps' end}]) as p from lineitem),
            g as (select l_orderkey, l_linenumber, p.n as name, count(*) as c, bool_or(case when p.n = 'checked' then p.v is null or p.v not in ('true', 'false', 'mixed') when p.n = 'expanded' then p.v not in ('true', 'false')
                    when p.n = 'editable' then p.v is null or p.v not in ('true', 'plaintext', 'richtext', 'false', 'none') when p.n = 'invalid' then p.v not in ('true', 'grammar', 'spelling', 'false') else false end) as bad from p group by all)
       select l_orderkey, l_linenumber, name, 'accessibility.property_name' as code from g where name is null or length(name) not between 1 and 64
       union all select l_orderkey, l_linenumber, name, 'accessibility.duplicate_property' from g where c > 1
       union all select l_orderkey, l_linenumber, name, 'accessibility.state_value' from g where bad""",
)
def state_values(spark, sf):
    def prop(name, value):
        return F.struct(name.alias("name"), value.alias("value"))

    supplier, part, tax, quantity = F.col("l_suppkey") % 9, F.col("l_partkey") % 7, F.col("l_tax"), F.col("l_quantity")
    entries = F.array(
        prop(F.lit("checked"), F.when(F.col("l_returnflag") == "R", "mixed").when(F.col("l_returnflag") == "A", "true").otherwise("maybe")),
        prop(F.lit("expanded"), F.when(quantity > 40, "7").when(quantity > 20, "true").otherwise("false")),
        prop(F.when(supplier == 0, "").when(supplier == 1, "n" * 65).otherwise("level"), F.lit("any")),
        prop(F.when(part == 0, "checked").when(part != 1, "editable"), F.when(tax > 0.04, "plaintext").when(tax > 0.02, "none")),
        prop(F.lit("invalid"), F.when(F.col("l_linestatus") == "F", "grammar").otherwise("perhaps")),
    )
    properties = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(entries).alias("p")).select("l_orderkey", "l_linenumber", "p.*")
    return trees.state_issues(properties, ["l_orderkey", "l_linenumber"], "name", "value")
