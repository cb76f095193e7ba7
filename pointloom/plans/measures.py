"""Queries of metrics and of the report's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import metrics as M
from .relational import EV, events, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_SHOTS = "(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 - 1 as depth, l_discount * 100 - 5 as x, l_returnflag, case o_orderstatus when 'F' then 1 when 'O' then 0 end as won, o_orderdate, o_custkey from lineitem join orders on l_orderkey = o_orderkey)"


def shots(spark, d):
    """lineitem as contacts, orders as points: depth behind the baseline, x to the side, who won."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("won"), "o_orderdate", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10 - 1).alias("depth"), (F.col("l_discount") * 100 - 5).alias("x"), "l_returnflag")
    return li.join(o, "l_orderkey")


@query(f"""select case when depth < 0 then 'inside' when depth < 1 then '0-1 m' when depth < 2 then '1-2 m' when depth < 3 then '2-3 m' when depth < 4 then '3-4 m' else '4+ m' end as band,
  count(*) as n, avg(won) as won from {_SHOTS} where won is not null group by band""")
def win_by_band(spark, d):
    return A.win_by_band(shots(spark, d), A.depth_band(F.col("depth")), F.col("won"))


@query("""select l_returnflag, median(l_quantity) as med, quantile_cont(l_quantity, 0.9) as p90, round(stddev_samp(l_quantity) * 1000000)::BIGINT as sd_u, min(l_quantity) as lo, max(l_quantity) as hi from lineitem group by l_returnflag""")
def median_p90_by_group(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.median(q).alias("med"), F.percentile(q, F.lit(0.9)).alias("p90"), F.round(F.stddev_samp(q) * 1000000).cast("long").alias("sd_u"), F.min(q).alias("lo"), F.max(q).alias("hi"))


@query("""with g as (select o_custkey, count(*) as n, sum(l_linenumber) as s from lineitem join orders on l_orderkey = o_orderkey group by o_custkey)
select c_mktsegment, sum(s * n)::DOUBLE / sum(n)::DOUBLE as pooled, sum(n)::BIGINT as n, sum(s)::DOUBLE / sum(n)::DOUBLE as ratio from g join customer on o_custkey = c_custkey group by c_mktsegment""")
def weighted_pool(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    g = table(spark, d, "lineitem").join(o, "l_orderkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return g.join(c, "o_custkey").groupBy("c_mktsegment").agg(M.weighted_mean(F.col("s"), F.col("n")).alias("pooled"), F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("ratio"))


@query(f"""with c as (select user_id, event_type, count(*) as n from {EV} group by all)
select e.user_id, count(distinct event_type) as kinds, min_by(event_type, (us, event_id)) as first, max_by(event_type, (us, event_id)) as last,
  (select event_type from c where c.user_id = e.user_id order by n desc, event_type limit 1) as mode, array_to_string(list_sort(list(distinct event_type)), ',') as all_kinds from {EV} e group by e.user_id""")
def mode_nunique_firstlast(spark, d):
    at = F.struct("us", "event_id")
    return events(spark, d).groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.min_by("event_type", at).alias("first"), F.max_by("event_type", at).alias("last"), F.mode("event_type", True).alias("mode"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("all_kinds"))


_JUDGED = "(select d.doc_id, lang, source, n_chars, quality, toxic, least(n_chars, 4000) as capped from documents d join labels l on d.doc_id = l.doc_id)"


def judged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").withColumn("capped", F.least("n_chars", F.lit(4000)))


@query(f"""select lang, count(*) filter (where quality = 0) as "0", count(*) filter (where quality = 1) as "1" from {_JUDGED} group by lang""")
def confusion_pivot(spark, d):
    return M.confusion(judged(spark, d), "lang", "quality", [0, 1])


@query("""with r as (select l_quantity as a, l_extendedprice as b from lineitem),
x as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from r)
select round(corr(ra, rb) * 1000000000)::BIGINT as spearman_n, count(*) as n from x""")
def spearman(spark, d):
    out = M.spearman(table(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")
    return out.select(F.round(F.col("spearman") * 1000000000).cast("long").alias("spearman_n"), "n")


@query(f"""select (select count(*) from orders) as matches, (select count(*) from orders where o_orderstatus = 'F') as charted, (select count(*) from lineitem where l_linenumber > 1) as rally_shots,
  (select count(*) from lineitem where l_linenumber = 1) as serves, (select min(year(o_orderdate)) from orders) as first_year, (select max(year(o_orderdate)) from orders) as last_year,
  (select count(*) from customer where c_custkey not in (select o_custkey from orders)) as unprocessed""")
def kpi_row(spark, d):
    o, li, c = (table(spark, d, n) for n in ("orders", "lineitem", "customer"))
    a = o.agg(F.count(F.lit(1)).alias("matches"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("charted"), F.min(F.year("o_orderdate")).cast("long").alias("first_year"), F.max(F.year("o_orderdate")).cast("long").alias("last_year"))
    b = li.agg(F.count(F.when(F.col("l_linenumber") > 1, 1)).alias("rally_shots"), F.count(F.when(F.col("l_linenumber") == 1, 1)).alias("serves"))
    left = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("unprocessed"))
    return a.crossJoin(b).crossJoin(left)


@query(f"""with r as (select lang, n_chars, quality, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as rk from {_JUDGED})
select lang, (2 * sum(rk) filter (where quality = 1) - count(*) filter (where quality = 1) * (count(*) filter (where quality = 1) + 1))::DOUBLE
  / nullif(2 * count(*) filter (where quality = 1) * count(*) filter (where quality = 0), 0)::DOUBLE as auc, count(*) filter (where quality = 1) as n_pos, count(*) filter (where quality = 0) as n_neg from r group by lang""")
def auc_ranksum(spark, d):
    return M.auc(judged(spark, d), ["lang"], "n_chars", F.col("quality") == 1)


@query(f"""with p as (select lang, capped / 4000.0::DOUBLE as p, quality = 1 as y from {_JUDGED}),
b as (select lang, greatest(p, 1 - p) as c, ((p >= 0.5) = y)::INT as r, least(floor((greatest(p, 1 - p) - 0.5) * 20), 9) as bin from p),
g as (select lang, bin, count(*) as n, abs(avg(c) - avg(r)) as gap from b group by lang, bin)
select lang, round(sum(gap * n) / sum(n) * 1000000000)::BIGINT as ece_n, sum(n)::BIGINT as n from g group by lang""")
def calibration_ece(spark, d):
    out = M.calibration(judged(spark, d), ["lang"], F.col("capped") / F.lit(4000.0), F.col("quality") == 1)
    return out.select("lang", F.round(F.col("ece") * 1000000000).cast("long").alias("ece_n"), "n")


@query(f"""with x as (select quality::VARCHAR as truth, case when n_chars > 1200 then '1' else '0' end as hat from {_JUDGED}),
c as (select truth as class, count(*) as support, count(*) filter (where truth = hat) as hits, (select count(*) from x y where y.hat = x.truth) as called from x group by truth)
select class, support, coalesce(hits::DOUBLE / nullif(called, 0), 0) as precision, hits::DOUBLE / support as recall, (2 * hits)::DOUBLE / (support + called) as f1 from c""")
def macro_f1_classes(spark, d):
    rows = judged(spark, d).select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 1200, "1").otherwise("0").alias("hat"))
    return M.class_scores(rows, "truth", "hat")


@query(f"""with x as (select quality::VARCHAR as truth, case when n_chars > 1200 then '1' else '0' end as hat from {_JUDGED}),
c as (select truth as class, count(*) as support, count(*) filter (where truth = hat) as hits, (select count(*) from x y where y.hat = x.truth) as called from x group by truth)
select round(sum(hits)::DOUBLE / sum(support) * 1000000)::BIGINT as accuracy_u, round(avg((2 * hits)::DOUBLE / (support + called)) * 1000000)::BIGINT as macro_f1_u, sum(support)::BIGINT as n from c""")
def macro_f1(spark, d):
    rows = judged(spark, d).select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 1200, "1").otherwise("0").alias("hat"))
    out = M.macro_f1(rows, "truth", "hat")
    return out.select(F.round(F.col("accuracy") * 1000000).cast("long").alias("accuracy_u"), F.round(F.col("macro_f1") * 1000000).cast("long").alias("macro_f1_u"), "n")


@query("""select l_returnflag, count(*) as n, avg((l_linenumber = l_suppkey % 8)::INT) as exact, avg((abs(l_linenumber - l_suppkey % 8) <= 1)::INT) as within1,
  avg(l_linenumber - l_suppkey % 8) as bias, avg(abs(l_linenumber - l_suppkey % 8)) as mae from lineitem group by l_returnflag""")
def exact_within1(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", (F.col("l_suppkey") % 8).alias("truth"))
    return M.rally_agreement(rows, ["l_returnflag"], "l_linenumber", "truth")


@query(f"""with x as (select lang, n_chars / 2000.0 > 0.5 as hat, quality = 1 as y from {_JUDGED})
select lang, avg((hat = y)::INT) as accuracy, count(*) filter (where hat and y)::DOUBLE / greatest(count(*) filter (where hat), 1) as precision,
  count(*) filter (where hat and y)::DOUBLE / greatest(count(*) filter (where y), 1) as recall, avg(hat::INT) as share_called, avg(y::INT) as share_true from x group by lang""")
def binary_score(spark, d):
    return M.binary_score(judged(spark, d), ["lang"], F.col("n_chars") / F.lit(2000.0), F.col("quality") == 1)


@query(f"""with a as (select o_orderkey as k, o_custkey % 3 = 0 as r from orders), b as (select l_orderkey as k, bool_or(l_returnflag = 'R') as r from lineitem group by 1)
select count(*) as n, avg(a.r::INT) as share_a, avg(b.r::INT) as share_b, count(*) filter (where a.r and not b.r) as only_a, count(*) filter (where not a.r and b.r) as only_b from a join b using (k)""")
def paired_comparison(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 3 == 0).alias("right"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("right"))
    return M.paired(a, b, ["k"], "right")


@query("""select split_part(event_type, '_', 1) as label, count(*) as requests, sum(round(value * 100)::BIGINT)::BIGINT as tokens, sum(round(value * 100)::BIGINT) / 1000000.0::DOUBLE as usd from events group by 1""")
def cost_rollup(spark, d):
    ledger = events(spark, d).select(F.concat_ws(":", F.split("event_type", "_")[0], F.col("event_id").cast("string")).alias("label"), F.col("v").alias("input_tokens"), F.lit(None).cast("double").alias("usd"))
    return M.cost(ledger, 1.0).withColumn("usd", F.col("tokens") / F.lit(1000000.0))


@query("""select 'rows' as metric, count(*)::DOUBLE as value, 1000.0::DOUBLE as target, count(*) >= 1000 as met from lineitem
  union all select 'nations', count(*)::DOUBLE, 30.0, count(*) >= 30 from nation""")
def targets_met(spark, d):
    measured = table(spark, d, "lineitem").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rows").alias("metric"), "value")
    measured = measured.unionByName(table(spark, d, "nation").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("nations").alias("metric"), "value"))
    targets = spark.sql("select * from values ('rows', 1000.0D, true), ('nations', 30.0D, true) as t(metric, target, at_least)")
    return M.against_targets(measured, targets)


@query(f"""with s as (select a as audio, b as bias, a * 3 + b as setting from range(3) x(a), range(3) y(b)),
r as (select setting, audio, bias, avg((v % 10 >= audio + bias * 2)::INT) * avg((v % 7 <> bias)::INT) as objective from {EV}, s group by all)
select setting, audio, bias, objective from r order by objective desc, setting limit 1""")
def grid_search_best(spark, d):
    from ..operators import sequence as S

    settings = S.params_frame(spark, S.grid(audio=[0, 1, 2], bias=[0, 1, 2]))
    v = F.col("v")
    rows = events(spark, d).crossJoin(F.broadcast(settings))
    scores = rows.groupBy("setting", "audio", "bias").agg((M.share(v % 10 >= F.col("audio") + F.col("bias") * 2) * M.share(v % 7 != F.col("bias"))).alias("objective"))
    return S.best_setting(scores)


@query("""with c as (select l_returnflag, 19 - least(floor((l_quantity - 0) / 2.5), 19) as row, least(floor((l_discount * 100 - 0) / 2.5), 3) as col from lineitem where l_quantity between 0 and 50 and l_discount * 100 between 0 and 10)
select l_returnflag, row::INT as row, col::INT as col, count(*) as n from c group by all""")
def histogram2d(spark, d):
    t = table(spark, d, "lineitem")
    return A.histogram2d(t, ["l_returnflag"], F.col("l_discount") * 100, F.col("l_quantity"), (0.0, 10.0), (0.0, 50.0), 2.5)


@query("""with c as (select l_returnflag, (19 - least(floor(l_quantity / 2.5), 19))::INT as row, least(floor(l_discount * 100 / 2.5), 3)::INT as col, count(*) as n from lineitem
  where l_quantity between 0 and 50 and l_discount * 100 between 0 and 10 group by all),
e as (select *, n / sum(n) over (partition by l_returnflag)::DOUBLE as density from c)
select l_returnflag, row, col, n, density / max(density) over () as scaled, max(density) over (partition by l_returnflag) * 100 / 6.25 as peak from e""")
def shared_scale_panels(spark, d):
    return A.shared_scale(histogram2d(spark, d), ["l_returnflag"], 2.5)


@query(f"""with z as (select case when depth < -5.485 then '1 inside service line' when depth < 0 then '2 inside baseline' when depth < 1 then '3 0-1 m' when depth < 2 then '4 1-2 m' when depth < 3 then '5 2-3 m' else '6 3+ m' end as band,
  x from {_SHOTS})
select band, count(*) as n, count(*) filter (where x < -1.37)::DOUBLE / (select count(*) from z) as "left", count(*) filter (where x between -1.37 and 1.37)::DOUBLE / (select count(*) from z) as middle,
  count(*) filter (where x > 1.37)::DOUBLE / (select count(*) from z) as "right" from z group by band""")
def zone_table(spark, d):
    return A.zone_table(shots(spark, d), F.col("x"), F.col("depth"))


@query(f"""with c as (select -6.75 + floor((x + 6.75) / 1.5) * 1.5::DOUBLE as x, -4.5 + floor((depth + 4.5) / 1.5) * 1.5::DOUBLE as depth, won from {_SHOTS}
  where x >= -6.75 and x < 6.75 and depth >= -4.5 and depth < 7.5 and won is not null)
select x::DOUBLE as x, depth::DOUBLE as depth, count(*) as n, avg(won) as won from c group by 1, 2 having count(*) >= 40""")
def win_map(spark, d):
    return A.win_map(shots(spark, d), F.col("x"), F.col("depth"), F.col("won"))


@query(f"""with m as (select l_suppkey, count(*) filter (where l_linenumber % 2 = 1) as n_first, count(*) filter (where l_linenumber % 2 = 0) as n_second,
  median(depth) filter (where l_linenumber % 2 = 1) as first, median(depth) filter (where l_linenumber % 2 = 0) as second from {_SHOTS} group by l_suppkey)
select l_suppkey, n_first, n_second, first, second, first - second as step from m where n_first >= 30 and n_second >= 12""")
def dumbbell(spark, d):
    rows = shots(spark, d).withColumn("attempt", F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(2))
    return A.dumbbell(rows, "l_suppkey", "attempt", "depth")


@query(f"""with w as (select o_custkey, list_sort(list(distinct l_suppkey % 3)) as p from {_SHOTS} group by o_custkey having count(distinct l_suppkey % 3) = 2)
select o_custkey, p[1] as player, p[2] as opponent from w union all select o_custkey, p[2], p[1] from w""")
def opponents(spark, d):
    rows = shots(spark, d).select("o_custkey", (F.col("l_suppkey") % 3).alias("player"))
    return A.opponents(rows, "o_custkey", "player")


@query("""with n as (select l_orderkey, count(*) as k from lineitem group by 1), r as (select 'machine' as source, k from n union all select 'charted', o_custkey % 20 from orders),
c as (select source, least(k, 15)::INT as length, count(*) as n from r group by all), s as (select source, unnest(range(16))::INT as length from (select distinct source from c)),
f as (select source, length, coalesce(n, 0) as n from s left join c using (source, length))
select source, length, n, n / sum(n) over (partition by source)::DOUBLE as share from f""")
def length_distribution(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k")).select(F.lit("machine").alias("source"), "k")
    b = table(spark, d, "orders").select(F.lit("charted").alias("source"), (F.col("o_custkey") % 20).alias("k"))
    return A.length_distribution(a.unionByName(b), "source", "k")


_BINS = f"""(with b as (select case when l_linenumber >= 4 then 'rally' else 'return' end as kind, floor((x + 5) / 1.0)::INT as bin, won from {_SHOTS} where x >= -5 and x < 5 and won is not null),
g as (select kind, bin, count(*) as n, avg(won) as share from b group by all), s as (select kind, unnest(range(10))::INT as bin from (select distinct kind from g))
select kind, bin, -5 + (bin + 0.5::DOUBLE) * 1.0::DOUBLE as centre, coalesce(n, 0) as n, case when n >= 25 then share end as share from s left join g using (kind, bin))"""


def _bins(spark, d):
    return A.share_by_bin(shots(spark, d), F.col("x"), F.col("won") == 1, -5.0, 5.0, 1.0, 25, F.when(F.col("l_linenumber") >= 4, "rally").otherwise("return"))


@query(f"select kind, bin, centre, n, share from {_BINS}")
def share_by_bin(spark, d):
    return _bins(spark, d)


@query(f"""with a as (select *, lead(centre) over w as c, lead(share) over w as s from {_BINS} window w as (partition by kind order by bin)),
h as (select kind, bin, centre + (0.5::DOUBLE - share) * (c - centre) / (s - share) as "at" from a where (share - 0.5::DOUBLE) * (s - 0.5::DOUBLE) <= 0 and share <> s)
select kind, min_by("at", bin) as "at" from h group by kind""")
def half_crossing(spark, d):
    return A.crossing(_bins(spark, d))


@query(f"""select user_id, count(*) as n, count(*) / 4.0::DOUBLE / 3600 as hours, median(v) as median_depth, avg((v < 2000)::INT) as net_share, round(stddev_samp(v) * 1000)::BIGINT as lateral_sd from {EV} group by user_id""")
def per_match_summary(spark, d):
    out = A.match_summary(events(spark, d), "user_id", "v", "v", F.col("v") < 2000)
    return out.withColumn("lateral_sd", F.round(F.col("lateral_sd") * 1000).cast("long"))


@query(f"""select l_suppkey, count(*) as shots, median(depth) as depth, avg((depth < 0)::INT) as inside, avg((l_linenumber = 2)::INT) as forehand,
  (select l_returnflag from lineitem l where l.l_suppkey = s.l_suppkey group by l_returnflag order by count(*) desc, l_returnflag limit 1) as hand from {_SHOTS} s group by l_suppkey having count(*) >= 150""")
def fingerprints(spark, d):
    return A.fingerprints(shots(spark, d), "l_suppkey", "depth", F.col("l_linenumber") == 2, "l_returnflag")


@query(f"""select l_linenumber, count(*) as n, median(depth) as depth, median(x) as x from {_SHOTS} where l_linenumber in (1, 2) group by 1""")
def serve_setup(spark, d):
    return A.serve_setup(shots(spark, d), "l_linenumber", ["depth", "x"])


@query(f"""select l_orderkey, l_linenumber, 'near' as "end", l_discount * 100 as x, l_quantity - 30 as y from lineitem where l_tax > 0.05 and l_quantity - 30 < 0
  union all select l_orderkey, l_linenumber, 'far', -(l_tax * 100), -(l_quantity - 20) from lineitem where l_tax > 0.05 and -(l_quantity - 20) < 0""")
def occupancy_unpivot(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") * 10).alias("p"), (F.col("l_discount") * 100).alias("nx"), (F.col("l_quantity") - 30).alias("ny"), (F.col("l_tax") * 100).alias("fx"), (F.col("l_quantity") - 20).alias("fy"))
    from ..operators.analytics import occupancy

    return occupancy(t.filter("p / 10 > 0.05D or p > 0.5D").withColumn("p", F.when(F.col("fx") / 100 > 0.05, 1.0).otherwise(0.0)), ["l_orderkey", "l_linenumber"], "p", {"near": ("nx", "ny"), "far": ("fx", "fy")})


@query("""with n as (select l_orderkey, count(*) as k from lineitem group by 1)
select c_mktsegment, case when k <= 4 then '1-4' when k <= 8 then '5-8' else '9+' end as bucket, count(*) as n, avg((o_orderstatus = 'F')::INT) as won from n join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all""")
def server_win_by_length(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = n.join(table(spark, d, "orders"), "o_orderkey").join(c, "o_custkey")
    return rows.groupBy("c_mktsegment", A.length_bucket(F.col("k")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), M.share(F.col("o_orderstatus") == "F").alias("won"))


@query(f"""with p as (select user_id, event_id as pid, us as a, lead(us) over (partition by user_id order by us, event_id) - 1 as b from {EV} where event_type = 'purchase'),
s as (select e.user_id, p.pid, e.us, e.event_id, e.v % 100 as x, e.v % 37 as y from {EV} e join p on e.user_id = p.user_id and e.us between p.a and p.b),
g as (select user_id, pid from s group by all having count(*) >= 3),
st as (select user_id, pid, abs(x - lag(x) over w) as dx from s join g using (user_id, pid) window w as (partition by user_id, pid order by us, event_id))
select user_id, pid, coalesce(sum(case when dx < 60 then dx end), 0)::DOUBLE as distance from st group by all""")
def distance_run(spark, d):
    from pyspark.sql import Window

    e = events(spark, d)
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    points = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("pid"), F.col("us").alias("a"), "event_id", "us")
    points = points.withColumn("b", F.lead("us").over(w) - 1).filter("b >= a").select("user_id", "pid", "a", "b")
    order = F.col("us") * 1  # times are unique to the microsecond within a user
    samples = e.select("user_id", order.alias("us"), F.lit(0).alias("seg"), (F.col("v") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"))
    return A.distance_run(points, samples, ["user_id"], "a", "b", "us", "x", "y", longest=60.0)
