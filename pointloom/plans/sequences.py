"""Queries of the notation, the scoring, the decoders, the streams and the models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import session
from ..operators import models as ML
from ..operators import notation as N
from ..operators import points as P
from ..operators import scoring as S
from ..operators import sequence as Q
from ..operators.temporal import islands
from ..streaming import jobs as J
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


# an attempt for each order: a serve digit from its first line, a shot for each further line, an outcome from its status
_ATTEMPTS = """(with s as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as k from lineitem),
x as (select l_orderkey, string_agg(case when k = 1 then ['4', '5', '6', '0'][(l_partkey % 4 + 1)::INT] else substr('fbrsvzopuylmhijktq', (l_partkey % 18 + 1)::INT, 1) || (l_partkey % 4)::VARCHAR end, '' order by k) as body, count(*) as n from s group by 1)
select o_orderkey, o_custkey, body || case when n = 1 then case o_orderstatus when 'F' then '*' when 'O' then 'n' else '#' end else case o_orderstatus when 'F' then '*' when 'O' then 'd@' else 'w' end end as attempt, n from x join orders on l_orderkey = o_orderkey)"""


def attempts(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    s = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("k"))
    digit = F.get(F.array(*[F.lit(c) for c in "4560"]), (F.col("l_partkey") % 4).cast("int"))
    shot = F.concat(F.expr("substr('fbrsvzopuylmhijktq', cast(l_partkey % 18 as int) + 1, 1)"), (F.col("l_partkey") % 4).cast("string"))
    part = F.struct("k", F.when(F.col("k") == 1, digit).otherwise(shot).alias("s"))
    x = s.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    end = lambda f, u, e: F.when(F.col("o_orderstatus") == "F", f).when(F.col("o_orderstatus") == "O", u).otherwise(e)
    n = F.size("parts")
    tail = F.when(n == 1, end("*", "n", "#")).otherwise(end("*", "d@", "w"))
    return x.join(o, "o_orderkey").select("o_orderkey", "o_custkey", F.concat(F.concat_ws("", F.col("parts.s")), tail).alias("attempt"), n.cast("long").alias("n"))


def _points(spark, d):
    t = attempts(spark, d).withColumn("1st", F.col("attempt")).withColumn("2nd", F.when(F.col("attempt").rlike("n$"), "4f1*").otherwise(""))
    return N.parse_points(t)


@query(f"""select o_orderkey, case when regexp_matches(attempt, '^[4560]n$') then 'fault' when regexp_matches(attempt, '^[4560][*#]$') then 'ace' else 'rally' end as kind,
  len(regexp_extract_all(attempt, '[fbrsvzopuylmhijktq][0-9]')) as n_shots from {_ATTEMPTS}""")
def canonical_kinds(spark, d):
    t = attempts(spark, d)
    return t.select("o_orderkey", N.canonical_kind(F.col("attempt")).alias("kind"), F.size(N.canonical_shots(F.col("attempt"))).cast("long").alias("n_shots"))


@query(f"""with a as (select * from {_ATTEMPTS}), p as (select *, case when regexp_matches(attempt, '^[4560]n$') then '4f1*' end as second from a)
select o_orderkey, true as ok, case when second is not null then 2 when n = 1 then 1 else n end::INT as n_contacts,
  case when second is not null then 'winner' when n = 1 then case right(attempt, 1) when '*' then 'ace' else 'service_winner' end
    when right(attempt, 1) = '*' then 'winner' when right(attempt, 1) = '@' then 'unforced_error' else 'other' end as outcome,
  case when second is not null then 'returner' when right(attempt, 1) in ('*', '#') then case when n % 2 = 1 then 'server' else 'returner' end
    else case when n % 2 = 1 then 'returner' else 'server' end end as winner_role,
  case when second is not null then 2 else 1 end::INT as in_serve_index from p""")
def parse_attempt(spark, d):
    return N.with_summary(_points(spark, d)).select("o_orderkey", F.col("point.ok").alias("ok"), "n_contacts", "outcome", "winner_role", "in_serve_index")


@query(f"""with a as (select * from {_ATTEMPTS}), p as (select *, regexp_matches(attempt, '^[4560]n$') as fault, (o_orderkey % 2 + 1)::INT as svr from a),
r as (select o_orderkey, svr, unnest(range(1, case when fault then 3 else n + 1 end)) as shot_no, fault from p)
select o_orderkey, 0::INT as shot_no, svr as hitter, 'serve' as kind from p where fault
union all select o_orderkey, shot_no::INT, case when shot_no % 2 = 1 then svr else 3 - svr end, case when shot_no = 1 then 'serve' else 'rally' end from r""")
def explode_contacts(spark, d):
    pts = _points(spark, d).withColumn("Svr", (F.col("o_orderkey") % 2 + 1).cast("int"))
    return N.contacts(pts, ["o_orderkey"]).select("o_orderkey", "shot_no", "hitter", "kind")


@query(f"""select o_orderkey, attempt as first, case when regexp_matches(attempt, '^[4560]n$') then '4f1*' else '' end as second, true as same from {_ATTEMPTS}""")
def serialize_roundtrip(spark, d):
    p = _points(spark, d).withColumn("back", N.serialize(F.col("point")))
    return p.select("o_orderkey", "back.first", "back.second", ((F.col("back.first") == F.col("1st")) & (F.col("back.second") == F.col("2nd"))).alias("same"))


def _winners(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d).select("user_id", F.row_number().over(w).alias("pt"), F.when(F.col("v") % 2 == 0, 1).otherwise(2).alias("winner"))
    return e.select("*", F.lit(1).alias("first_server"), F.lit(3).alias("best_of"), F.lit("seven").alias("regular_rule"), F.lit("seven").alias("final_rule"))


_SCORE_SQL = f"""with recursive w as (select user_id, row_number() over (partition by user_id order by us, event_id) as pt, case when v % 2 = 0 then 1 else 2 end as winner from {EV}),
s as (
  select user_id, 1::BIGINT as pt, 0 as s1, 0 as s2, 0 as g1, 0 as g2, 0 as p1, 0 as p2, 1 as srv, 1 as game from (select distinct user_id from w)
  union all
  select user_id, pt + 1, case when st and k = 1 then s1 + 1 else s1 end, case when st and k = 2 then s2 + 1 else s2 end,
    case when st then 0 when gm and k = 1 then g1 + 1 else g1 end, case when st then 0 when gm and k = 2 then g2 + 1 else g2 end,
    case when gm then 0 else q1 end, case when gm then 0 else q2 end, case when gm then 3 - srv else srv end, game + gm::INT
  from (select *, gm and (tb or (greatest(h1, h2) >= 6 and abs(h1 - h2) >= 2 and (k = 1) = (h1 > h2))) as st from (
    select s.*, w.winner as k, p1 + (w.winner = 1)::INT as q1, p2 + (w.winner = 2)::INT as q2, g1 + (w.winner = 1)::INT as h1, g2 + (w.winner = 2)::INT as h2, g1 = 6 and g2 = 6 as tb,
      case when w.winner = 1 then p1 + 1 else p2 + 1 end >= (case when g1 = 6 and g2 = 6 then 7 else 4 end)
      and (case when w.winner = 1 then p1 + 1 - p2 else p2 + 1 - p1 end) >= 2 as gm
    from s join w on s.user_id = w.user_id and s.pt = w.pt where greatest(s1, s2) < 2 and s.pt < (select max(pt) from w x where x.user_id = s.user_id))))
"""


@query(_SCORE_SQL + "select user_id, pt::INT as pt, s1 as sets_p1, s2 as sets_p2, g1 as games_p1, g2 as games_p2, p1 as points_p1, p2 as points_p2, game as game_no_in_match from s where greatest(s1, s2) < 2")
def score_replay(spark, d):
    out = S.replay(_winners(spark, d), "user_id", "pt", "winner").filter("not after_match_end")
    return out.select("user_id", "pt", "sets_p1", "sets_p2", "games_p1", "games_p2", "points_p1", "points_p2", "game_no_in_match")


@query(_SCORE_SQL + "select user_id, pt::INT as pt, case when pt > 1 then true end as step_ok from s where greatest(s1, s2) < 2")
def step_check(spark, d):
    w = _winners(spark, d)
    scores = S.replay(w, "user_id", "pt", "winner").filter("not after_match_end").join(w, ["user_id", "pt"])
    return S.check_steps(scores, "user_id", "pt", "winner").select("user_id", "pt", "step_ok")


@query()
def score_validation(spark, d):
    w = _winners(spark, d)
    replayed = S.replay(w, "user_id", "pt", "winner")
    recorded = replayed.withColumn("pts", F.when((F.col("user_id") % 7 == 0) & (F.col("pt") == 9), "30-30").otherwise(F.col("pts")))
    steps = S.check_steps(recorded.join(w, ["user_id", "pt"]), "user_id", "pt", "winner")
    return S.validate(replayed, recorded, "user_id", "pt", steps)


def _streams(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = events(spark, d).withColumn("k", F.row_number().over(w))
    return e.filter("k % 2 = 0"), e.filter("k % 2 = 1")


@query()
def alignment_nw(spark, d):
    a, b = _streams(spark, d)
    return Q.align_streams(a, b, "user_id", "k", "event_type")


@query()
def edit_distance_words(spark, d):
    """Distances of adjacent words over each document's whole text: how many pairs, their sum and the largest."""
    w, n = F.col("w"), F.greatest(F.size("w") - 1, F.lit(0))
    t = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: F.length(x) > 0).alias("w")).filter("w is not null")
    t = t.select("doc_id", F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.levenshtein(a, b)).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v)
    return t.select("doc_id", F.size("x").cast("long").alias("pairs"), total.alias("distance"), F.array_max("x").cast("long").alias("furthest"))


def _detected(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("rally"))
    p = table(spark, d, "orders").join(n, "o_orderkey").withColumn("pid", F.row_number().over(w).cast("long"))
    end = F.when(F.col("o_orderkey") % 2 == 0, "near").otherwise("far")
    return p.select("o_custkey", "pid", "rally", end.alias("server_end"), F.lit("deuce").alias("side"), F.lit(1).alias("n_serves"))


@query()
def alignment_layouts(spark, d):
    turned = F.when(F.col("server_end") == "near", "far").otherwise("near")
    charted = _detected(spark, d).filter("pid % 5 <> 0").select("o_custkey", F.col("pid").alias("pt"), "rally", "side", "n_serves", turned.alias("server_end_a"), F.col("server_end").alias("server_end_b"))
    return Q.align_points(_detected(spark, d), charted, "o_custkey")


def _candidates(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    return events(spark, d).select("user_id", (F.row_number().over(w) * 0.7 + F.col("v") % 10 / 20.0).alias("t"), (F.col("v") % 100 / 25.0 - 2).alias("near"), (F.col("v") % 37 / 10.0 - 2).alias("far"))


@query()
def alternating_dp(spark, d):
    c = _candidates(spark, d)
    serves = c.groupBy("user_id").agg((F.min("t") - 0.9).alias("t_serve")).withColumn("first", F.when(F.col("user_id") % 2 == 0, "near").otherwise("far"))
    return Q.decode_rallies(c, serves, ["user_id"], weight=0.5, missed=-2.0)


@query()
def viterbi_tracks(spark, d):
    e = events(spark, d)
    t = e.select("user_id", F.floor(F.col("us") / 3_600_000_000 / 48).cast("double").alias("t"), "event_id", (F.col("v") % 50 / 10.0).alias("cx"), (F.col("v") % 90 / 10.0).alias("cy"), (F.col("v") % 7 / 7.0).alias("score"))
    return Q.choose_tracks(t, ["user_id"])


@query("""with recursive c as (select user_id, event_id, us, v, row_number() over (partition by user_id order by v desc, us, event_id) as k from """ + EV + """),
p as (select user_id, 1::BIGINT as k, [us] as taken, [event_id] as ids from c where k = 1
  union all select p.user_id, p.k + 1, case when list_min(list_transform(p.taken, lambda t: abs(t - c.us))) >= 432000000000 then list_append(p.taken, c.us) else p.taken end,
    case when list_min(list_transform(p.taken, lambda t: abs(t - c.us))) >= 432000000000 then list_append(p.ids, c.event_id) else p.ids end
  from p join c on p.user_id = c.user_id and c.k = p.k + 1)
select user_id, unnest(arg_max(ids, k)) as event_id from p group by user_id""")
def nms_greedy(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "us", "v")
    return Q.suppress_groups(rows, ["user_id"], "us", "v", "event_id", 432_000_000_000).select("user_id", "event_id")


def _stream(spark, d, name):
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("""select event_type, count(*) as n, sum(round(value * 100)::BIGINT)::BIGINT as cents from events group by event_type""")
def stream_tail(spark, d):
    s = _stream(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    totals = J.running_totals(s, [F.col("event_type")], ["cents"])
    return J.drain(totals, "tail", session.work_folder(spark), "complete")


@query(f"""with i as (select *, sum(b) over (partition by user_id order by us, event_id rows between unbounded preceding and current row) as island from
  (select *, coalesce((us - lag(us) over (partition by user_id order by us, event_id) > 21600000000)::INT, 0) as b from {EV}))
select user_id, count(*) as n, min(us) as start_us, max(us) as end_us from i group by user_id, island""")
def stream_islands(spark, d):
    s = _stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    # a run ends when the pause is longer than six hours, a session when it is that long: a microsecond more makes them one
    out = s.groupBy("user_id", F.session_window("ts", "6 hours 1 microseconds")).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts")).alias("start_us"), F.unix_micros(F.max("ts")).alias("end_us"))
    return J.drain(out.select("user_id", "n", "start_us", "end_us"), "islands", session.work_folder(spark), "complete")


@query(_SCORE_SQL + "select user_id, pt::INT as number, s1 as sets_p1, s2 as sets_p2, g1 as games_p1, g2 as games_p2 from s where greatest(s1, s2) < 2")
def stream_score(spark, d):
    folder = session.work_folder(spark)
    _winners(spark, d).select("user_id", F.col("pt").alias("number"), "winner").repartition(4, "number").write.parquet(f"{folder}/points")
    s = spark.readStream.schema("user_id long, number int, winner int").option("maxFilesPerTrigger", 2).parquet(f"{folder}/points")
    out = J.live_scores(s, "user_id", "number", "winner")
    done = J.drain(out, "score", f"{folder}/checkpoint")
    return done.filter("greatest(sets_p1, sets_p2) < 2").select("user_id", "number", "sets_p1", "sets_p2", "games_p1", "games_p2")


@query()
def gbt_loo(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    text = F.col("text")
    marks = F.length(F.regexp_replace(text, "[^$%&#*|!]", "")) / F.length(text)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.length(text)
    x = rows.select("doc_id", "source", F.col("quality").cast("double").alias("label"), F.col("n_chars").cast("double").alias("chars"), marks.alias("marks"), upper.alias("upper"))
    x = ML.folds(x, "source", most=5, k=3)
    return ML.out_of_fold(x, ML.binary(["chars", "marks", "upper"], rounds=8, depth=3), "label").select("doc_id", "fold", "label", "p")


@query(f"""with s as (select user_id, event_id, us, v, v % 100 < 90 as fits, row_number() over (partition by user_id order by us, event_id) as shot_no from {EV}),
c as (select *, min(case when not fits then shot_no end) over (partition by user_id) as cut from s)
select user_id, event_id, shot_no, count(*) over (partition by user_id) as rally from c where cut is null or shot_no < cut""")
def cut_tails(spark, d):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, d).select(F.col("user_id").alias("match"), F.lit(0).alias("pid"), "event_id", F.row_number().over(w).cast("long").alias("shot_no"), F.when(F.col("v") % 100 < 90, 1.0).otherwise(0.0).alias("p"))
    return P.cut_tails(rows, "p", 0.5).select(F.col("match").alias("user_id"), "event_id", "shot_no", "rally")


@query()
def rally_time_features(spark, d):
    e = events(spark, d)
    t = (F.col("us") / 3_600_000_000.0).alias("t")
    half = F.when(F.col("v") % 2 == 0, "near").otherwise("far").alias("half")
    tracks = e.select(F.col("user_id").alias("match"), F.lit(0).alias("seg"), t, half, (F.col("v") % 50 / 10.0).alias("cx"), (F.col("v") % 90 / 10.0).alias("cy"))
    onsets = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("match"), t, (F.col("v") / 100.0).alias("z"))
    return P.rally_time_features(tracks, onsets, onsets.select("match", F.col("t").alias("t_start"), F.col("t").alias("t_last")))


@query()
def contact_positions(spark, d):
    e = events(spark, d)
    t = (F.col("us") / 3_600_000_000.0).alias("t")
    half = F.when(F.col("v") % 2 == 0, "near").otherwise("far")
    tracks = e.filter("event_type <> 'purchase'").select(F.col("user_id").alias("match"), half.alias("half"), t, (F.col("v") % 50 / 10.0).alias("cx"), (F.col("v") % 90 / 10.0).alias("cy"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    contacts = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("match"), F.lit(1).alias("pid"), F.row_number().over(w).alias("shot_no"), F.lit(None).cast("int").alias("serve_no"), t, half.alias("hitter_end"))
    return P.enrich(contacts, tracks)
