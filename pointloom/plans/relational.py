"""Queries of the relational core over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import geometry as G
from ..operators import relational as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """event_id, user_id, event_type, us (microseconds) and v (hundredths of the value)."""
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("event_id", "user_id", "event_type", us.alias("us"), F.round(F.col("value") * 100).cast("long").alias("v"))


EV = "(select event_id, user_id, event_type, epoch_us(ts) as us, round(value * 100)::BIGINT as v from events)"


@query("""select event_id, user_id, event_type, try_cast(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') as integer) as k,
  coalesce(value, 0) as value from events""")
def scan_typed_events(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce("value", F.lit(0.0)).alias("value"))


@query(f"""select user_id, event_type, event_id, us from (select *, row_number() over (partition by user_id, event_type
  order by us desc, event_id desc) as n from {EV}) where n = 1""")
def latest_per_key(spark, d):
    return R.latest_per_key(events(spark, d), ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id", "us")


@query("""select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey % 10 <> 0
  union all select o_orderkey, o_custkey, 'X' from orders where o_orderkey % 10 = 0""")
def upsert_by_key(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return R.upsert(old, old.filter("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X")), ["o_orderkey"])


@query("""select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""")
def unseen_work(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.unseen(table(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("""select l_orderkey as point, l_linenumber::BIGINT as shot, l_returnflag as outcome, o_orderstatus as charted_status, o_custkey as charted_player,
  'machine' as source from lineitem left join orders on l_orderkey = o_orderkey""")
def export_provenance(spark, d):
    truth = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("player"))
    names = {"l_orderkey": "point", "l_linenumber": "shot", "l_returnflag": "outcome"}
    return R.export(table(spark, d, "lineitem"), names, ["l_linenumber"], "machine", truth, ["l_orderkey"]).drop("charted_l_orderkey")


@query("""select l_orderkey, l_linenumber, l_quantity from lineitem join part on l_partkey = p_partkey
  where l_quantity between 10 and 20 and l_returnflag in ('A', 'R') and p_size not in (1, 2, 3) and contains(p_name, 'a') and l_shipdate >= timestamp '1995-01-01'""")
def filter_between_isin(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 20) & F.col("l_returnflag").isin("A", "R") & (F.col("l_shipdate") >= F.expr("timestamp_ntz'1995-01-01'")))
    part = table(spark, d, "part").filter(~F.col("p_size").isin(1, 2, 3) & F.col("p_name").contains("a")).select("p_partkey")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""select l_orderkey, l_linenumber from lineitem where l_discount * 5 between 0.04 and 0.55 and l_quantity / 40 between 0.5 and 1.05
  and l_quantity / 40 - l_discount * 5 >= 0.25 and l_tax * 10 between 0.1 and 0.9 and l_tax * 12 between 0.05 and 0.95 and l_quantity / 50 >= 0.3""")
def live_view_predicate(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").filter(G.live_view(disc * 5, q / 40, tax * 10, tax * 12, q / 50)).select("l_orderkey", "l_linenumber")


_LETTER = "substr('fbrsvzopuylmhijktq', ((l_partkey % 18) + 1)::INT, 1)"


def letter():
    return F.expr("substr('fbrsvzopuylmhijktq', cast(l_partkey % 18 as int) + 1, 1)")


@query(f"""with x as (select l_orderkey, l_linenumber, {_LETTER} as letter, l_returnflag from lineitem)
select l_orderkey, l_linenumber, case when contains('frvoulhj', letter) then 'F' when contains('bszpymik', letter) then 'B' else 'U' end as side,
  case when letter in ('f', 'b') then 'groundstroke' when letter in ('r', 's') then 'slice' when letter in ('v', 'z') then 'volley'
    when letter in ('h', 'i') then 'half_volley' when letter in ('j', 'k') then 'swinging_volley' when letter in ('o', 'p') then 'overhead'
    when letter in ('u', 'y') then 'drop' when letter in ('l', 'm') then 'lob' when letter = 't' then 'trick' else 'unknown' end as family,
  case when l_returnflag = 'R' then 'R' else 'U' end as hand from x""")
def map_codes(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", letter().alias("letter"), "l_returnflag")
    return t.select("l_orderkey", "l_linenumber", C.stroke_side(F.col("letter")).alias("side"), C.stroke_family(F.col("letter")).alias("family"), C.hand(F.col("l_returnflag")).alias("hand"))


@query(f"""select event_id, case when v is null then null else least(greatest(v / 100.0::DOUBLE, 10.0), 50.0) end as clipped,
  floor(ln(least(greatest(v / 10000.0::DOUBLE, 0.01), 0.99) / (1 - least(greatest(v / 10000.0::DOUBLE, 0.01), 0.99))) * 1000000)::BIGINT as logit_u,
  floor(0.5 * ln(greatest(v / 100.0::DOUBLE, 1.0) / 20.0) * 1000000)::BIGINT as loud_u from {EV}""")
def clip_and_null(spark, d):
    v = F.col("v")
    micro = lambda x: F.floor(x * 1000000).cast("long")
    return events(spark, d).select("event_id", C.clip(v / F.lit(100.0), 10, 50).alias("clipped"), micro(C.logit(v / F.lit(10000.0))).alias("logit_u"), micro(C.loudness(v / F.lit(100.0), 0.5, 20.0)).alias("loud_u"))


@query("""select a.l_orderkey, a.l_linenumber, b.l_partkey as next_part from lineitem a left join lineitem b
  on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber""")
def join_left_two_keys(spark, d):
    t = table(spark, d, "lineitem")
    nxt = t.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next_part"))
    return t.select("l_orderkey", "l_linenumber").join(nxt, ["l_orderkey", "l_linenumber"], "left")


@query("""select c_custkey, coalesce(n_name, 'U') as n_name, coalesce(n_regionkey, -1) as n_regionkey from customer left join
  (select * from nation where n_nationkey % 2 = 0) on c_nationkey = n_nationkey""")
def lookup_default(spark, d):
    nation = table(spark, d, "nation").filter("n_nationkey % 2 = 0").withColumnRenamed("n_nationkey", "c_nationkey")
    return R.look_up(table(spark, d, "customer").select("c_custkey", "c_nationkey"), nation, ["c_nationkey"], {"n_name": "U", "n_regionkey": -1}).drop("c_nationkey")


@query("""select doc_id, lang, coalesce(quality::BIGINT, n_chars) as n_chars from documents left join labels using (doc_id)""")
def overwrite_matched(spark, d):
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("n_chars"))
    return R.overwrite(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), new, ["doc_id"], ["n_chars"])


_NAMES = "select p_partkey, p_size, p_retailprice, string_split(p_name, ' ') as t1, string_split(lower(p_type), ' ') as t2, list_sort([string_split(p_name, ' ')[-1], string_split(lower(p_type), ' ')[-1]]) as key from part"


@query(f"""with n as ({_NAMES}), b as (select p_partkey as partner, p_size, p_retailprice, t1 as r1, t2 as r2, key from n),
keyed as (select n.p_partkey, partner, 1 as phase, b.p_retailprice from n join b on n.p_size = b.p_size and n.key = b.key and partner <> n.p_partkey),
loose as (select n.p_partkey, partner, 2, b.p_retailprice from n join b on n.p_size = b.p_size and partner <> n.p_partkey where n.p_partkey not in (select p_partkey from keyed)
  and (list_has_any(list_filter(t1, lambda t: length(t) >= 3), list_filter(r1, lambda t: length(t) >= 3)) and list_has_any(t2, r2)
    or list_has_any(list_filter(t1, lambda t: length(t) >= 3), r2) and list_has_any(t2, list_filter(r1, lambda t: length(t) >= 3))))
select p_partkey, partner, phase from (select *, row_number() over (partition by p_partkey order by p_retailprice desc, partner) as k from (select * from keyed union all select * from loose)) where k = 1""")
def linkage_two_phase_whole(spark, d):
    """Every part against all other parts."""
    t = table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_type", "p_retailprice")
    right = t.select(F.col("p_partkey").alias("partner"), "p_size", F.col("p_name").alias("one"), F.col("p_type").alias("two"), "p_retailprice")
    return R.link_two_phase(t, right, ["p_size"], ("p_name", "p_type"), ("one", "two"), "p_partkey", "partner", [-F.col("p_retailprice")], within=True)


@query("""with t as (select p_partkey, p_brand, p_size % 5 as s, p_name, string_split(p_name, ' ')[1] as needle from part),
h as (select a.p_partkey, b.p_partkey as partner, count(*) over (partition by a.p_partkey) as n from t a join t b on a.p_brand = b.p_brand and a.s = b.s and a.p_partkey <> b.p_partkey
  where length(a.needle) > 0 and contains(b.p_name, a.needle))
select p_partkey, partner from h where n = 1""")
def linkage_unique_whole(spark, d):
    """Every part against all other parts."""
    t = table(spark, d, "part").withColumn("s", F.col("p_size") % 5)
    return R.link_unique_within(t, ["p_brand", "s"], F.split("p_name", " ")[0], F.col("p_name"), "p_partkey", "partner")


@query("""with u as (select conv_id, text as ask, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'user'),
a as (select conv_id, text as reply, row_number() over (partition by conv_id order by turn) as rn from conversations where role = 'assistant')
select conv_id, rn::INT as rn, length(ask) as asked, length(reply) as replied from u join a using (conv_id, rn)""")
def positional_pairs(spark, d):
    t = table(spark, d, "conversations")
    u, a = (t.filter(F.col("role") == r).select("conv_id", "turn", F.col("text").alias(n)) for r, n in (("user", "ask"), ("assistant", "reply")))
    out = R.pair_by_position(u, a, ["conv_id"], ["turn"], ["turn"])
    return out.select("conv_id", "rn", F.length("ask").cast("long").alias("asked"), F.length("reply").cast("long").alias("replied"))


@query("""select o_custkey, o_orderkey as best_order from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey desc) as n from orders) where n = 1""")
def topk_and_rank_pick(spark, d):
    return R.best_of_group(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderkey"), F.struct("o_totalprice", "o_orderkey"), "best_order")


@query("""select o_orderkey, o_orderpriority, o_totalprice from orders order by list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), o_totalprice desc nulls last, o_orderkey limit 100""")
def sort_by_category(spark, d):
    order = F.array_position(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(F.when(order > 0, order).asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(100)


@query("""with x as (select n_nationkey as k from nation union all select c_nationkey from customer union all select s_nationkey from supplier)
select distinct k from x where k not in (select r_regionkey from region)""")
def union_dedupe_setdiff(spark, d):
    k = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    both = k("nation", "n_nationkey").unionByName(k("customer", "c_nationkey")).unionByName(k("supplier", "s_nationkey"))
    return both.distinct().join(k("region", "r_regionkey"), "k", "left_anti")


_FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z]+', ' ', 'g'))"


@query(f"select doc_id, {_FOLD.format('text')} as folded from documents")
def fold_names(spark, d):
    return table(spark, d, "documents").select("doc_id", C.fold_name(F.col("text")).alias("folded"))


@query("""with s as (select l_orderkey, l_linenumber, '4' || 'f' || (l_linenumber % 4) || (case when l_returnflag = 'R' then '*' when l_returnflag = 'A' then 'n@' else 'x?' end) as s from lineitem),
x as (select l_orderkey, l_linenumber, unnest(string_split(s, '')) as c, generate_subscripts(string_split(s, ''), 1) - 1 as pos from s)
select l_orderkey, l_linenumber, pos::INT as pos, c as char, case when c in ('4', '5', '6') then 'serve_dir' when c in ('1', '2', '3') then 'shot_dir' when c = '0' then 'zero'
  when c = 'f' then 'shot' when c in ('*', '@') then 'outcome' when c in ('n', 'x') then 'err' else 'junk' end as kind from x""")
def lex_chars(spark, d):
    s = F.concat(F.lit("4f"), (F.col("l_linenumber") % 4).cast("string"), F.when(F.col("l_returnflag") == "R", "*").when(F.col("l_returnflag") == "A", "n@").otherwise("x?"))
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(C.lex(s)).alias("x"))
    return x.select("l_orderkey", "l_linenumber", "x.pos", "x.char", "x.kind")


@query("""select vec_id, 'e' || (list_position(embedding[1:8], list_max(embedding[1:8])) - 1) as best from embeddings""")
def argmax_label(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].alias(f"e{i}") for i in range(8)])
    return t.select("vec_id", C.argmax_label([f"e{i}" for i in range(8)]).alias("best"))


@query("""with x as (select vec_id, embedding::DOUBLE[] as e, (vec_id % 7)::DOUBLE as x, (vec_id % 5)::DOUBLE as y from embeddings)
select vec_id, (e[1] * x + e[2] * y + e[3]) / (e[7] * x + e[8] * y + e[9]) as px, (e[4] * x + e[5] * y + e[6]) / (e[7] * x + e[8] * y + e[9]) as py
from x where e[7] * x + e[8] * y + e[9] <> 0""")
def projective_points(spark, d):
    x, y = (F.col("vec_id") % 7).cast("double"), (F.col("vec_id") % 5).cast("double")
    t = table(spark, d, "embeddings").select("vec_id", G.project(F.col("embedding"), x, y).alias("p")).filter("p is not null")
    return t.select("vec_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


@query("""with b as (select l_orderkey, l_linenumber, l_quantity as x1, l_discount * 100 as y1, l_quantity + 10 as x2, l_discount * 100 + 5 as y2, l_quantity + l_tax * 50 as a1, l_quantity + l_tax * 50 + 8 as a2 from lineitem),
o as (select *, greatest(least(x2, a2) - greatest(x1, a1), 0.0) as w, greatest(least(y2, 9.0) - greatest(y1, 1.0), 0.0) as h from b)
select l_orderkey, l_linenumber, w * h / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (9.0 - 1.0) - w * h) as iou from o""")
def box_iou(spark, d):
    q, y = F.col("l_quantity"), F.col("l_discount") * 100
    a = q + F.col("l_tax") * 50
    iou = G.box_iou(q, y, q + 10, y + 5, a, F.lit(1.0), a + 8, F.lit(9.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", iou.alias("iou"))


@query("""with rows as (select l_orderkey, l_linenumber, l_partkey, l_returnflag, (l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey as line from lineitem
  union all select l_orderkey, l_linenumber, l_partkey, 'S', (l_orderkey * 100 + 50 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey from lineitem where l_orderkey % 3 = 0),
n as (select *, row_number() over (partition by l_orderkey, l_linenumber order by line) - 1 as copy from rows),
s as (select l_orderkey, copy, sum((l_returnflag = 'S')::INT) as spec, sum(length(l_returnflag)) as chars from n group by all),
b as (select l_orderkey, copy from (select *, row_number() over (partition by l_orderkey order by spec, chars desc, copy) as k from s) where k = 1),
kept as (select distinct l_orderkey, l_linenumber, l_partkey, l_returnflag from n join b using (l_orderkey, copy))
select k.l_orderkey, k.l_linenumber, k.l_partkey, k.l_returnflag, (select count(*) from rows r where r.l_orderkey = k.l_orderkey) - count(*) over (partition by k.l_orderkey) as dropped from kept k""")
def whole_copy_dedupe(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.expr("(l_orderkey * 100 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey").alias("line"))
    again = t.filter("l_orderkey % 3 = 0").withColumn("l_returnflag", F.lit("S")).withColumn("line", F.col("line") + 50_000_000_000)
    kept, gone = R.whole_copies(t.unionByName(again), "l_orderkey", "l_linenumber", "line", (F.col("l_returnflag") == "S").cast("int"), F.length("l_returnflag"))
    return kept.drop("line").join(gone, "l_orderkey")


@query("""select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then 'charted'
  when exists (select 1 from orders where o_custkey = c_custkey) then 'tracked' else 'none' end as tier from customer""")
def tier_by_presence(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return R.tiers(table(spark, d, "customer").select("c_custkey"), "c_custkey", charted=o.filter("o_orderstatus = 'F'"), tracked=o)


@query("""select l_orderkey, l_linenumber, 'near' as side, l_quantity as x from lineitem where l_tax > 0.03 and l_quantity > 25
  union all select l_orderkey, l_linenumber, 'far', l_discount * 100 from lineitem where l_tax > 0.03 and l_quantity > 25""")
def wide_to_long(spark, d):
    t = table(spark, d, "lineitem").filter("l_tax > 0.03D and l_quantity > 25").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("near"), (F.col("l_discount") * 100).alias("far"))
    return t.unpivot(["l_orderkey", "l_linenumber"], ["near", "far"], "side", "x")


@query(f"""select user_id as match, event_id as shot, 'machine' as source, (v > 5000) as won from {EV} where event_type = 'purchase'
  union all select o_custkey, o_orderkey, 'charted', case o_orderstatus when 'F' then true when 'O' then false end from orders""")
def shared_shot_union(spark, d):
    a = events(spark, d).filter("event_type = 'purchase'").select(F.col("user_id").alias("match"), F.col("event_id").alias("shot"), F.lit("machine").alias("source"), (F.col("v") > 5000).alias("won"))
    won = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("match"), F.col("o_orderkey").alias("shot"), F.lit("charted").alias("source"), won.alias("won"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""select o_orderkey, case when year(o_orderdate) between 2001 and 2005 then '2001-05' when year(o_orderdate) between 2006 and 2010 then '2006-10' end as era,
  sha256(o_orderkey::VARCHAR || chr(31) || o_orderstatus) as key from orders""")
def era_and_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.era(F.year("o_orderdate")).alias("era"), C.content_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("key"))


@query("""select l_orderkey, l_linenumber, case when l_linenumber > 5 then (l_linenumber % 4) || '-' || l_suppkey % 7 when l_linenumber % 4 = 3 and l_suppkey % 7 >= 3 then
    case when l_suppkey % 7 = 3 then '40-40' else '40-AD' end
  else ['0', '15', '30', '40'][(l_linenumber % 4) + 1] || '-' || ['0', '15', '30', '40'][least(l_suppkey % 7, 3) + 1] end as pts from lineitem""")
def score_text(spark, d):
    a, b = (F.col("l_linenumber") % 4).cast("int"), (F.col("l_suppkey") % 7).cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.format_pts(a, b, F.col("l_linenumber") > 5).alias("pts"))
