"""Queries over ordered traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright.catalogue.registry import query
from pairwright.functions.scalars import epoch_micros
from pairwright.operators import automata, sequence
from pairwright.operators.keyed import attach, blocked_window, over_groups
from pairwright.sources.tables import table


@query(
    "sorted_check",
    """with e as (select event_id, user_id, epoch_us(ts) as micros, round_even(value * 100, 0)::bigint as cents from events),
            l as (select *, lag(micros) over w as pm, lag(cents) over w as pc from e window w as (partition by user_id order by event_id))
       select event_id, user_id, 'order.ts' as code from l where pm >= micros
       union all select event_id, user_id, 'order.value' from l where pc >= cents""",
)
def sorted_check(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        epoch_micros("ts").alias("micros"),
        F.rint(F.col("value") * 100).cast("long").alias("cents"),
    )
    return sequence.not_strictly_sorted(
        rows,
        ["user_id"],
        "event_id",
        {"order.ts": "micros", "order.value": "cents"},
        F.expr("event_id div 65536"),
    )


@query(
    "ordinal_contiguity",
    """with r as (select 'conversation' as kind, conv_id as key, turn as ordinal from conversations
                  union all select 'order', l_orderkey, l_linenumber - 1 from lineitem),
            p as (select *, row_number() over (partition by kind, key order by ordinal) - 1 as pos from r)
       select kind, key, ordinal, count(*) as n_misplaced from p where pos <> ordinal group by 1, 2, 3""",
)
def ordinal_contiguity(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.lit("conversation").alias("kind"), F.col("conv_id").alias("key"), F.col("turn").alias("ordinal")
    )
    lines = table(spark, sf, "lineitem").select(
        F.lit("order").alias("kind"),
        F.col("l_orderkey").alias("key"),
        (F.col("l_linenumber") - 1).cast("long").alias("ordinal"),
    )
    return sequence.misplaced_ordinals(turns.unionByName(lines), ["kind", "key"], "ordinal")


@query(
    "schedule_audit",
    """with a as (select conv_id, count(*) as n from conversations group by 1),
            s as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as ordinal,
                         case when turn < 2 then -1 else turn + length(text) % 3 - 1 end as after_action from conversations where role = 'assistant'),
            l as (select s.*, n, lag(after_action) over w as p, min(ordinal) over (partition by s.conv_id) as f, max(ordinal) over (partition by s.conv_id) as z
                  from s join a on s.conv_id = a.conv_id window w as (partition by s.conv_id order by ordinal))
       select conv_id, ordinal, code from l, (values ('schedule.out_of_range'), ('schedule.order'), ('schedule.initial'), ('schedule.final')) c(code)
       where (code = 'schedule.out_of_range' and after_action >= n) or (code = 'schedule.order' and after_action <= p)
          or (code = 'schedule.initial' and ordinal = f and after_action <> -1) or (code = 'schedule.final' and ordinal = z and after_action <> n - 1)""",
)
def schedule_audit(spark, sf):
    turns = table(spark, sf, "conversations")
    actions = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_actions"))
    after = F.when(F.col("turn") < 2, -1).otherwise(F.col("turn") + F.length("text") % 3 - 1)
    checkpoints = turns.where("role = 'assistant'").select("conv_id", "turn", after.cast("long").alias("after_action"))
    schedule = blocked_window(checkpoints, ["conv_id"], ["turn"], F.expr("turn div 4096"), position="ordinal")
    return sequence.schedule_issues(
        schedule.select("conv_id", "ordinal", "after_action"), actions, "conv_id", "ordinal", "after_action"
    )


@query(
    "trace_status",
    """with v as (select event_id, ts, event_type, case when user_id % 9 <> 4 then user_id end as user_id from events),
            f as (select user_id, min({'t': ts, 'e': event_id}) filter (where event_type = 'error') as f from v group by 1)
       select event_id, e.user_id, case when f is null or {'t': ts, 'e': event_id} < f then 'satisfied'
              when {'t': ts, 'e': event_id} = f then 'unsatisfied' else 'not_reached' end as status
       from v e join f on e.user_id is not distinct from f.user_id""",
)
def trace_status(spark, sf):
    user = F.when(F.col("user_id") % 9 != 4, F.col("user_id")).alias("user_id")
    events = table(spark, sf, "events").select(user, "ts", "event_id", "event_type")
    traced = sequence.step_statuses(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return traced.select("event_id", "user_id", "status")


@query(
    "trace_audit",
    """with e as (select user_id, event_id, case event_type when 'error' then 'unsatisfied' when 'signup' then 'not_reached' else 'satisfied' end as s from events),
            f as (select user_id, min(event_id) filter (where s = 'unsatisfied') as f from e group by 1),
            j as (select e.*, f from e join f on e.user_id = f.user_id)
       select user_id, event_id, code from j, (values ('trace.multiple_failures'), ('trace.post_failure_status'), ('trace.early_not_reached')) c(code)
       where (code = 'trace.multiple_failures' and event_id > f and s = 'unsatisfied') or (code = 'trace.post_failure_status' and event_id > f and s <> 'not_reached')
          or (code = 'trace.early_not_reached' and (f is null or event_id < f) and s = 'not_reached')""",
)
def trace_audit(spark, sf):
    return sequence.trace_issues(stored_statuses(spark, sf), "user_id", ["event_id"], "status")


@query(
    "trace_outcome",
    """select user_id, count_if(event_type = 'error') = 0 as task_success,
              arg_min(event_id, event_id) filter (where event_type = 'error') as first_unsatisfied_step from events group by 1""",
)
def trace_outcome(spark, sf):
    return sequence.trace_outcomes(stored_statuses(spark, sf), "user_id", ["event_id"], "status", "event_id")


def stored_statuses(spark, sf):
    status = (
        F.when(F.col("event_type") == "error", "unsatisfied")
        .when(F.col("event_type") == "signup", "not_reached")
        .otherwise("satisfied")
    )
    return table(spark, sf, "events").select("user_id", "event_id", status.alias("status"))


@query(
    "dense_rank",
    "select p_partkey, p_brand, dense_rank() over (partition by p_brand order by case when p_size % 6 <> 1 then p_size end nulls first) - 1 as dense_rank from part",
)
def dense_rank(spark, sf):
    size = F.when(F.col("p_size") % 6 != 1, F.col("p_size")).alias("p_size")
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", size)
    ranked = sequence.dense_ranks(parts, ["p_brand"], "p_size", F.expr("p_size div 1024"), ["p_partkey"])
    return ranked.select("p_partkey", "p_brand", "dense_rank")


@query(
    "sibling_ordinal",
    "select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) - 1 as ordinal from customer",
)
def sibling_ordinal(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return sequence.sibling_ordinals(rows, "c_nationkey", "c_custkey", F.expr("c_custkey div 65536"))


@query(
    "sequence_pattern",
    """with e as (select user_id, (epoch_us(ts) // 86400000000)::bigint as day, event_id,
                 case event_type when 'signup' then 'f' when 'error' then 'x' when 'view' then 'k' when 'click' then 't' else 'c' end as letter from events),
            s as (select user_id, day, string_agg(letter, '' order by event_id) as s from e group by 1, 2)
       select user_id, day, length(s) as n_actions, regexp_matches(s, '^f[^f]*$') as focus_first, regexp_matches(s, '^[^c]*c$') as click_last,
              case when position('t' in s) = 0 then false else length(s) - position('t' in reverse(s)) = length(s) - 2 end as tab_before_click,
              regexp_matches(s, '^f(x|k+)(tk+)?tc$') as closed
       from s""",
)
def sequence_pattern(spark, sf):
    letter = (
        F.when(F.col("event_type") == "signup", "f")
        .when(F.col("event_type") == "error", "x")
        .when(F.col("event_type") == "view", "k")
        .when(F.col("event_type") == "click", "t")
        .otherwise("c")
    )
    day = F.floor(epoch_micros("ts") / 86_400_000_000).cast("long").alias("day")
    coded = table(spark, sf, "events").select("user_id", day, "event_id", letter.alias("letter"))
    placed = blocked_window(
        coded, ["user_id", "day"], ["event_id"], F.expr("event_id div 65536"), position="ordinal"
    )
    return sequence.recipe_conformance(placed, ["user_id", "day"], "ordinal", "letter").drop("segments_closed")


@query(
    "late_activity",
    """with f as (select user_id, min({'t': ts, 'e': event_id}) as f from events where event_type = 'purchase' group by 1)
       select event_id, e.user_id, event_type from events e join f on e.user_id = f.user_id where {'t': ts, 'e': event_id} > f""",
)
def late_activity(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    late = sequence.late_activity(
        events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", ["event_id"]
    )
    return late.select("event_id", "user_id", "event_type")


RECIPE_SQL = """lines as (select l_orderkey, l_partkey, l_suppkey, l_returnflag, row_number() over w - 1 as p, count(*) over (partition by l_orderkey) as n
         from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
       kinds as (select o_orderkey, case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as wanted,
         (['checked', 'value', 'other', 'none'])[o_custkey % 7 % 4 + 1] as setup, case when o_orderkey % 2 = 1 then (['value', 'checked', 'other', 'none'])[o_custkey % 5 % 4 + 1] end as entry from orders),
       acts as (select l_orderkey, p, case when p = 0 then if(l_suppkey % 13 = 0, 'k', 'f') when p = n - 1 then if(l_suppkey % 17 = 0, 't', 'c') when p = n - 2 then if(l_partkey % 19 = 0, 's', 't')
         when l_partkey % 8 < 3 then 's' when l_partkey % 8 = 3 then 't' when l_partkey % 8 < 6 then 'k' when l_returnflag = wanted then 'x' else 'y' end as letter
         from lines join kinds on l_orderkey = o_orderkey)"""


def recipe_actions(spark, sf):
    """Lines of an order as the actions of a workflow: positions, letters bound to what the order expects."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, sf, "lineitem").select("l_orderkey", *order, "l_returnflag")
    placed = blocked_window(lines, ["l_orderkey"], order, F.expr("l_linenumber div 65536"), position="p")
    status, customer = F.col("o_orderstatus"), F.col("o_custkey")
    setup = F.array(*map(F.lit, ("checked", "value", "other", "none")))[(customer % 7 % 4).cast("int")]
    entry = F.array(*map(F.lit, ("value", "checked", "other", "none")))[(customer % 5 % 4).cast("int")]
    grammar = F.when(F.col("o_orderkey") % 2 == 1, F.concat_ws("/", setup, entry)).otherwise(setup)
    wanted = F.when(status == "F", "A").when(status == "O", "N").otherwise("R")
    workflows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), grammar.alias("grammar"), wanted.alias("wanted"))
    # sizes come from the raw lines and meet the orders first, so that the placed lines are joined once
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    bound = sizes.join(workflows.select("l_orderkey", "wanted"), "l_orderkey")
    rows = attach(placed, bound, ["l_orderkey"], spread=["p"], hot_from=lines.select("l_orderkey"))
    part, supplier, p, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("p"), F.col("n")
    letter = (
        F.when(p == 0, F.when(supplier % 13 == 0, "k").otherwise("f"))
        .when(p == n - 1, F.when(supplier % 17 == 0, "t").otherwise("c"))
        .when(p == n - 2, F.when(part % 19 == 0, "s").otherwise("t"))
        .when(part % 8 < 3, "s")
        .when(part % 8 == 3, "t")
        .when(part % 8 < 6, "k")
        .when(F.col("l_returnflag") == F.col("wanted"), "x")
        .otherwise("y")
    )
    return rows.select("l_orderkey", "p", "n", letter.alias("letter")), workflows


@query(
    "recipe_automaton",
    f"""with {RECIPE_SQL}, s as (select o_orderkey, setup, entry, coalesce(string_agg(letter, '' order by p), '') as s from kinds left join acts on l_orderkey = o_orderkey group by all),
         g as (select *, case coalesce(entry, setup) when 'checked' then 's' when 'value' then '([sk]+|x)' when 'other' then '[sk]+' else '!' end
               || case when entry is null then '' else 't' || case setup when 'checked' then 's' when 'none' then '!' else '[sk]+' end end as middle from s)
       select o_orderkey as l_orderkey, length(s) as n_actions, 'recipe.action_recipe' as code from g where not regexp_full_match(s, 'f' || middle || 'tc')""",
)
def recipe_automaton(spark, sf):
    rows, workflows = recipe_actions(spark, sf)
    return automata.recipe_issues(rows, workflows, ["l_orderkey"], "p", "letter", "grammar", counted=table(spark, sf, "lineitem"))


@query(
    "pilot_schedule",
    """with a as (select l_orderkey, count(*) as n from lineitem group by 1),
            s as (select l_orderkey, unnest([{'o': 0, 'k': 'initial_state', 'a': -1}, {'o': 1, 'k': if(l_orderkey % 11 = 0, 'post_primary_action', 'pre_primary_action'), 'a': n - 2},
                    {'o': 2, 'k': 'post_primary_action', 'a': if(l_orderkey % 7 = 0, n, n - 1)}, {'o': 3, 'k': 'initial_state', 'a': n}]) as c, n from a),
            t as (select l_orderkey, c.o as o, c.k as k, c.a as a, n from s where (c.o < 3 or l_orderkey % 13 = 0) and not (l_orderkey % 5 = 0 and c.o = 1) and l_orderkey % 17 > 0)
       select a.l_orderkey, count(o) as n_checkpoints, 'schedule.pilot' as code from a left join t using (l_orderkey) group by a.l_orderkey
       having not coalesce(count(o) = 3 and count_if((o = 0 and k = 'initial_state' and a = -1) or (o = 1 and k = 'pre_primary_action' and a = t.n - 2) or (o = 2 and k = 'post_primary_action' and a = t.n - 1)) = 3, false)""",
)
def pilot_schedule(spark, sf):
    key = F.col("l_orderkey")
    actions = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_actions"))
    n = F.col("n_actions")

    def checkpoint(ordinal, name, after):
        return F.struct(F.lit(ordinal).alias("ordinal"), name.alias("key"), after.cast("long").alias("after"))

    made = F.array(
        checkpoint(0, F.lit("initial_state"), F.lit(-1)),
        checkpoint(1, F.when(key % 11 == 0, "post_primary_action").otherwise("pre_primary_action"), n - 2),
        checkpoint(2, F.lit("post_primary_action"), F.when(key % 7 == 0, n).otherwise(n - 1)),
        checkpoint(3, F.lit("initial_state"), n),
    )
    rows = actions.select("l_orderkey", F.explode(made).alias("c")).select("l_orderkey", "c.*")
    told = rows.where("(ordinal < 3 or l_orderkey % 13 = 0) and not (l_orderkey % 5 = 0 and ordinal = 1) and l_orderkey % 17 > 0")
    return sequence.pilot_schedule_issues(told, actions, "l_orderkey", "ordinal", "key", "after")


@query(
    "trace_replay",
    """with p as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as o from events),
            w as (select p.*, case when event_id % 61 = 5 then event_id + 1 else event_id end as a from p where event_id % 59 <> 3),
            e as (select user_id, min(o) filter (where event_type = 'error') as f from p join events using (event_id, user_id) group by 1),
            n as (select user_id, f, case when user_id % 10 = 4 then (select event_id from p where p.user_id = e.user_id and o = 0) when user_id % 10 <> 6 then (select event_id from p where p.user_id = e.user_id and o = f) end as failed,
                    case when user_id % 10 = 3 then f is not null else f is null end as success from e where user_id % 10 <> 8),
            s as (select p.user_id, o, event_id, case when f is null or o < f then 'satisfied' when o = f then 'unsatisfied' when event_id % 67 = 9 then 'satisfied' else 'not_reached' end as status
                  from p join e using (user_id) where event_id % 71 <> 2),
            d as (select user_id, arg_min(event_id, o) filter (where status = 'unsatisfied') as first from s group by 1),
            x as (select n.*, coalesce((select min(o) from w where w.user_id = n.user_id and w.a = n.failed), -1) as fa from n),
            b as (select coalesce(w.user_id, s.user_id) as user_id, coalesce(w.o, s.o) as o, a, s.event_id, status from w full join s on w.user_id = s.user_id and w.o = s.o)
       select b.user_id, o as ordinal, 'trace.actions' as code from b join x on b.user_id = x.user_id
       where a is distinct from event_id or status is distinct from case when success or o < fa then 'satisfied' when o = fa then 'unsatisfied' else 'not_reached' end
       union all select user_id, o, 'trace.outcome' from b where user_id not in (select user_id from n)
       union all select n.user_id, null, 'trace.derived_success' from n join d on n.user_id = d.user_id where success <> (first is null)
       union all select n.user_id, null, 'trace.derived_failed_step' from n join d on n.user_id = d.user_id where failed is distinct from first""",
)
def trace_replay(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    placed = blocked_window(events, ["user_id"], ["event_id"], F.expr("event_id div 65536"), position="ordinal")
    event, user = F.col("event_id"), F.col("user_id")
    changed = F.when(event % 61 == 5, event + 1).otherwise(event)
    plan = placed.where(event % 59 != 3).select("user_id", "ordinal", changed.alias("action"))
    marked = over_groups(placed, ["user_id"], spread=["event_id"], fail=F.min(F.when(F.col("event_type") == "error", F.col("ordinal"))))
    at, fail = F.col("ordinal"), F.col("fail")
    status = (
        F.when(fail.isNull() | (at < fail), "satisfied").when(at == fail, "unsatisfied").when(event % 67 == 9, "satisfied").otherwise("not_reached")
    )
    steps = marked.where(event % 71 != 2).select("user_id", "ordinal", event.alias("action"), status.alias("status"))
    truth = marked.groupBy("user_id").agg(
        F.max("fail").alias("fail"), F.min_by("event_id", "ordinal").alias("opening"), F.max(F.when(at == fail, event)).alias("failing")
    )
    failed = F.when(user % 10 == 4, F.col("opening")).when(user % 10 != 6, F.col("failing"))
    success = F.when(user % 10 == 3, fail.isNotNull()).otherwise(fail.isNull())
    outcomes = truth.where(user % 10 != 8).select("user_id", success.alias("task_success"), failed.alias("failed_step"))
    return sequence.trace_replay(plan, steps, outcomes, "user_id", "ordinal", "action", "status", "task_success", "failed_step")
