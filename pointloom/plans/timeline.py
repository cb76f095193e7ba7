"""Queries along time over the events table, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import temporal as T
from .relational import EV, events, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_VIEWS = f"(select user_id, us, max(event_id) as view_id from {EV} where event_type = 'view' group by user_id, us)"
_BUYS = f"(select * from {EV} where event_type = 'purchase')"


def _views_buys(spark, d):
    e = events(spark, d)
    return e.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("view_id")), e.filter("event_type = 'purchase'")


@query(f"""select b.event_id, b.user_id, b.us, case when b.us - v.us <= {72 * HOUR} then v.view_id end as view_id
  from {_BUYS} b asof left join {_VIEWS} v on b.user_id = v.user_id and b.us >= v.us""")
def asof_backward_tolerance(spark, d):
    views, buys = _views_buys(spark, d)
    hit = T.asof(buys, views, ["user_id"], "us", ["view_id"], order="view_id", tolerance=72 * HOUR)
    return hit.select("event_id", "user_id", "us", F.col("r_view_id").alias("view_id"))


@query(f"""select b.event_id, v.view_id, v.us as view_us from {_BUYS} b asof left join {_VIEWS} v on b.user_id = v.user_id and b.us >= v.us""")
def asof_in_buckets(spark, d):
    views, buys = _views_buys(spark, d)
    hit = T.asof(buys, views, ["user_id"], "us", ["view_id"], order="view_id", bucket=24 * HOUR)
    return hit.select("event_id", F.col("r_view_id").alias("view_id"), F.col("r_us").alias("view_us"))


@query(f"""with f as (select user_id, us, min(event_id) as view_id from {EV} where event_type = 'view' group by user_id, us),
n as (select b.event_id, b.us, v.view_id as bid, v.us as bus from {_BUYS} b asof left join {_VIEWS} v on b.user_id = v.user_id and b.us >= v.us),
m as (select b.event_id, v.view_id as fid, v.us as fus from {_BUYS} b asof left join f v on b.user_id = v.user_id and b.us <= v.us)
select event_id, case when bus is not null and (fus is null or us - bus <= fus - us) then case when us - bus <= {48 * HOUR} then bid end
  else case when fus - us <= {48 * HOUR} then fid end end as view_id from n join m using (event_id)""")
def nearest_time(spark, d):
    views, buys = _views_buys(spark, d)
    return T.nearest(buys, views, ["user_id"], "us", ["view_id"], order="view_id", tolerance=48 * HOUR).select("event_id", F.col("r_view_id").alias("view_id"))


@query(f"""select event_id, lead(us) over (partition by user_id order by us, event_id) as next_us,
  lead(event_type) over (partition by user_id order by us, event_id) as next_type from {EV}""")
def next_event_after(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, d).select("event_id", F.lead("us").over(w).alias("next_us"), F.lead("event_type").over(w).alias("next_type"))


@query(f"""with e as {EV} select a.event_id, not exists (select 1 from e b where b.user_id = a.user_id and b.us between a.us - {250 * HOUR} and a.us - {3 * HOUR} and b.v >= 5000) as quiet from e a""")
def quiet_before(spark, d):
    return T.quiet_before(events(spark, d), ["user_id"], "us", F.col("v") >= 5000, 250 * HOUR, 3 * HOUR).select("event_id", "quiet")


_ISLANDS = f"""(select *, sum(b) over (partition by user_id order by us, event_id rows between unbounded preceding and current row)::BIGINT as island
  from (select *, coalesce((us - lag(us) over (partition by user_id order by us, event_id) > {6 * HOUR})::INT, 0) as b from {EV}))"""


@query(f"""select user_id, island, min(us) as start_us, max(us) as end_us, count(*) as n from {_ISLANDS} group by user_id, island""")
def islands(spark, d):
    t = T.islands(events(spark, d), ["user_id"], "us", 6 * HOUR, ["event_id"])
    return t.groupBy("user_id", "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


@query(f"""with s as (select user_id, median(us - p) as step from (select user_id, us, lag(us) over (partition by user_id order by us) as p from (select distinct user_id, us from {EV})) group by user_id),
r as (select user_id, island, min(us) as a, max(us) as b from (select *, sum(k) over (partition by user_id order by us rows between unbounded preceding and current row) as island from
  (select *, coalesce((us - lag(us) over (partition by user_id order by us) > {200 * HOUR})::INT, 0) as k from (select distinct user_id, us from {EV}))) group by user_id, island)
select user_id, island::BIGINT as island, a - step / 2 as start, b + step / 2 as end, b - a + step as dur from r join s using (user_id) where b - a >= {2 * HOUR}""")
def segments(spark, d):
    return T.segments(events(spark, d).select("user_id", "us").distinct(), ["user_id"], "us", 200 * HOUR, 2 * HOUR)


@query(f"""with i as (select user_id, island, min(us) as a, max(us) as b from {_ISLANDS} where event_type <> 'purchase' group by user_id, island)
select p.event_id, i.island from {_BUYS} p left join i on p.user_id = i.user_id and p.us between i.a and i.b""")
def point_in_interval(spark, d):
    e = T.islands(events(spark, d), ["user_id"], "us", 6 * HOUR, ["event_id"])
    spans = e.filter("event_type <> 'purchase'").groupBy("user_id", "island").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return T.in_interval(events(spark, d).filter("event_type = 'purchase'"), spans, ["user_id"], "us", "a", "b", ["island"]).select("event_id", "island")


@query(f"""with e as {EV} select s.event_id, exists (select 1 from e p where p.event_type = 'purchase' and p.user_id = s.user_id and s.us between p.us - {30 * HOUR} and p.us + {80 * HOUR}) as y
  from e s where s.event_type = 'view'""")
def interval_label(spark, d):
    views, buys = _views_buys(spark, d)
    spans = buys.select("user_id", (F.col("us") - 30 * HOUR).alias("a"), (F.col("us") + 80 * HOUR).alias("b"))
    return T.covered(views, spans, ["user_id"], "us", "a", "b").select(F.col("view_id").alias("event_id"), "y")


@query("""select l_orderkey, l_linenumber, l_partkey - lag(l_partkey) over w as diff, lead(l_partkey) over w - l_partkey as ahead, lag(l_returnflag) over w as before
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)""")
def lag_lead_diff(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    p = F.col("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (p - F.lag(p).over(w)).alias("diff"), (F.lead(p).over(w) - p).alias("ahead"), F.lag("l_returnflag").over(w).alias("before"))


@query(f"""select event_id, avg(v) over w7 as mean7, round(stddev_samp(v) over w13 * 1000)::BIGINT as sd13 from {EV}
  window w7 as (partition by user_id order by us, event_id rows between 3 preceding and 3 following), w13 as (partition by user_id order by us, event_id rows between 6 preceding and 6 following)""")
def rolling_mean_std(spark, d):
    by, order = ["user_id"], ["us", "event_id"]
    return events(spark, d).select("event_id", F.avg("v").over(T.centred(by, order, 7)).alias("mean7"), F.round(F.stddev_samp("v").over(T.centred(by, order, 13)) * 1000).cast("long").alias("sd13"))


@query(f"""select event_id, median(v) over (partition by user_id order by us, event_id rows between 1 preceding and 1 following) as median3,
  median(v) over (partition by user_id order by us, event_id rows between 3 preceding and 3 following) as median7 from {EV}""")
def rolling_median3(spark, d):
    by, order = ["user_id"], ["us", "event_id"]
    return events(spark, d).select("event_id", T.median3("v", by, order).cast("double").alias("median3"), T.running_median("v", by, order, 7).alias("median7"))


@query(f"""with e as {EV}, s as (select * from e where event_type = 'view'), p as (select * from e where event_type <> 'view')
select s.event_id, (select count(*) from p where p.user_id = s.user_id and p.us >= s.us - {25 * HOUR} and p.us < s.us + {25 * HOUR}) as near,
  least((s.us - (select max(us) from p where p.user_id = s.user_id and p.us < s.us)), {300 * HOUR}) as since,
  least(((select min(us) from p where p.user_id = s.user_id and p.us >= s.us) - s.us), {300 * HOUR}) as until from s""")
def event_density(spark, d):
    e = events(spark, d)
    s, p = e.filter("event_type = 'view'"), e.filter("event_type <> 'view'").select("user_id", "us")
    out = T.density(s, p, ["user_id"], "us", 25 * HOUR, "near")
    out = T.asof(out, p, ["user_id"], "us", [], strict=True, prefix="b_")
    out = T.asof(out, p, ["user_id"], "us", [], forward=True, prefix="f_")
    cap = F.lit(300 * HOUR)
    gap = lambda x: F.when(x.isNotNull(), F.least(x, cap)).otherwise(cap)
    return out.select("event_id", "near", gap(F.col("us") - F.col("b_us")).alias("since"), gap(F.col("f_us") - F.col("us")).alias("until"))


@query("""with s as (select l_orderkey, sqrt((l_partkey % 100 - lag(l_partkey % 100) over w) ** 2 + (l_suppkey % 50 - lag(l_suppkey % 50) over w) ** 2) as step
  from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey))
select l_orderkey, sum(case when step < 60 then floor(step * 1000)::BIGINT else 0 end)::BIGINT as milli from s group by l_orderkey""")
def path_length(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 50
    step = F.sqrt(F.pow(x - F.lag(x).over(w), F.lit(2)) + F.pow(y - F.lag(y).over(w), F.lit(2)))
    t = table(spark, d, "lineitem").select("l_orderkey", step.alias("step"))
    return t.groupBy("l_orderkey").agg(F.sum(F.when(F.col("step") < 60, F.floor(F.col("step") * 1000)).otherwise(0)).cast("long").alias("milli"))


@query(f"""with v as (select user_id, us, max_by(v, event_id) as x from {EV} where event_type = 'view' group by user_id, us),
f as (select user_id, us, min_by(v, event_id) as x from {EV} where event_type = 'view' group by user_id, us),
b as (select p.event_id, p.us, v.us as t0, v.x as x0 from {_BUYS} p asof left join v on p.user_id = v.user_id and p.us >= v.us),
a as (select p.event_id, f.us as t1, f.x as x1 from {_BUYS} p asof left join f on p.user_id = f.user_id and p.us <= f.us)
select event_id, case when least(abs(us - t0), abs(t1 - us)) <= {200 * HOUR} then case when t0 is null then x1::DOUBLE when t1 is null then x0::DOUBLE
  when t1 > t0 then x0 + (x1 - x0) * ((us - t0)::DOUBLE / (t1 - t0)) else x0::DOUBLE end end as at_v from b join a using (event_id)""")
def lerp_at_time(spark, d):
    e = events(spark, d)
    views, buys = e.filter("event_type = 'view'").select("user_id", "us", "v", "event_id"), e.filter("event_type = 'purchase'")
    return T.lerp(buys, views, ["user_id"], "us", ["v"], order="event_id", tolerance=200 * HOUR).select("event_id", F.col("at_v").cast("double").alias("at_v"))


@query("""select conv_id, bool_and(role = case when (rn - 1) % 2 = 0 then first else case first when 'user' then 'assistant' else 'user' end end) as alternates, count(*) as turns
  from (select *, row_number() over (partition by conv_id order by turn) as rn, first_value(role) over (partition by conv_id order by turn) as first from conversations) group by conv_id""")
def alternation_check(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").select("conv_id", "role", F.row_number().over(w).alias("rn"), F.first("role").over(w).alias("first"))
    other = F.when(F.col("first") == "user", "assistant").otherwise("user")
    return t.groupBy("conv_id").agg(F.bool_and(F.col("role") == F.when(F.col("rn") % 2 == 1, F.col("first")).otherwise(other)).alias("alternates"), F.count(F.lit(1)).alias("turns"))
