"""The scoring of a match: formats, a replay of point winners, and a check of single steps in columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C


@dataclass(frozen=True)
class SetRule:
    """A tiebreak at ``at`` all (None: never) to ``to`` points with ``margin``; its first server serves ``block`` points before
    both serve two in turn, and ends change every ``change`` points."""

    at: int | None = 6
    to: int = 7
    margin: int = 2
    block: int = 1
    change: int = 6


LONG, SEVEN, TEN, SUDDEN = SetRule(at=None), SetRule(), SetRule(to=10), SetRule(to=5, margin=1, block=2, change=4)
RULES = {"long": LONG, "seven": SEVEN, "ten": TEN, "sudden": SUDDEN}
# From which year which rule held, for other sets and for the last one.
SINCE = {
    ("uso", False): ((0, "long"), (1970, "sudden"), (1975, "seven")),
    ("uso", True): ((0, "long"), (1970, "sudden"), (1975, "seven"), (2022, "ten")),
    ("ao", False): ((0, "long"), (1971, "seven")),
    ("ao", True): ((0, "long"), (2019, "ten")),
}
EVENTS = {"us open": "uso", "uso": "uso", "usopen": "uso", "u.s. open": "uso", "australian open": "ao", "ao": "ao", "australianopen": "ao"}


def event(tournament: Column) -> Column:
    """uso or ao; any other name is an error."""
    name = F.trim(F.translate(F.lower(tournament), "_-", "  "))
    return F.coalesce(C.lookup(name, EVENTS), F.raise_error(F.concat(F.lit("unknown tournament "), F.coalesce(tournament, F.lit("null")))))


def rule_name(tournament: Column, year: Column, last: bool) -> Column:
    """The name in RULES of the sets of an event's year."""
    out = F.lit(None).cast("string")
    ev = event(tournament)
    for (name, final), steps in SINCE.items():
        if final == last:
            for since, rule in steps:
                out = F.when((ev == name) & (year >= since), rule).otherwise(out)
    return out


def slam_best_of(gender: Column, round_: Column) -> Column:
    """Sets of a grand-slam singles match: 5 in the men's main draw, 3 elsewhere. Match lists are wrong about it at times."""
    men = F.substring(F.lower(F.trim(gender)), 1, 1) == "m"
    qualifying = F.upper(F.trim(round_)).isin("Q1", "Q2", "Q3", "Q4")
    return F.when(F.coalesce(men, F.lit(False)) & ~F.coalesce(qualifying, F.lit(False)), 5).otherwise(3)


def recorded_state(sets: tuple[Column, Column], games: tuple[Column, Column], server: Column, pts: Column, best_of: Column, final: Column, regular: Column) -> Column:
    """A recorded row (texts or numbers) as sets, games and points of both players, server and in_tiebreak, to be compared with a
    replay; null if any field is missing or malformed."""
    s1, s2, g1, g2, own = (c.try_cast("int") for c in (*sets, *games, server))
    rule = F.when(s1 + s2 + 1 == best_of, final).otherwise(regular)
    at = C.lookup(rule, {name: str(r.at) for name, r in RULES.items() if r.at is not None}).cast("int")
    tie = F.coalesce((g1 == at) & (g2 == at), F.lit(False))
    told = C.parse_pts(pts, tie)
    mine = lambda p: F.when(own == p, told["a"]).otherwise(told["b"])
    fields = {"sets_p1": s1, "sets_p2": s2, "games_p1": g1, "games_p2": g2, "points_p1": mine(1), "points_p2": mine(2), "server": own, "in_tiebreak": tie}
    whole = F.lit(True)
    for c in (s1, s2, g1, g2, own, told):
        whole = whole & c.isNotNull()
    return F.when(whole, F.struct(*[v.alias(k) for k, v in fields.items()]))


def completeness(replayed: DataFrame, key: str, order: str, winner: str, best_of: str = "best_of", final: str = "final_rule", regular: str = "regular_rule") -> DataFrame:
    """``complete`` for each match: no winner is missing and the match ends with the last row, neither before nor after it.

    ``replayed`` are replay()'s rows with the winner and the match's rules.
    """
    now = [tuple(F.col(f"{c}_p{p}") for p in (1, 2)) for c in ("sets", "games", "points")]
    nxt = successor(F.col(best_of), F.col(final), F.col(regular), *now, F.col("server"), F.col(winner))
    ends = F.greatest(nxt["sets_p1"], nxt["sets_p2"]) > F.floor(F.col(best_of) / 2)
    rows = replayed.select(key, order, winner, "after_match_end", F.coalesce(ends, F.lit(False)).alias("_ends"))
    good = F.max_by("_ends", order) & ~F.bool_or("after_match_end") & F.bool_and(F.col(winner).isNotNull())
    return rows.groupBy(key).agg(good.alias("complete"))


def end_layouts(server: Column, swapped: Column) -> tuple[Column, Column]:
    """Where the server stands if the first player began at the near end (a) or at the far one (b), from the ends' changes."""
    near = (server == 1) == (swapped == 0)
    return F.when(near, "near").otherwise("far"), F.when(near, "far").otherwise("near")


@dataclass(frozen=True)
class State:
    """The score before a point. ``serves`` is the game's server, or a tiebreak's first."""

    serves: int
    sets: tuple[int, int] = (0, 0)
    games: tuple[int, int] = (0, 0)
    points: tuple[int, int] = (0, 0)
    game: int = 1
    swapped: int = 0


class Match:
    """How states follow each other under a match's rules; a state is never changed."""

    def __init__(self, best_of: int = 3, regular: SetRule = SEVEN, final: SetRule = SEVEN):
        if best_of not in (1, 3, 5):
            raise ValueError(f"best of must be 1, 3 or 5, not {best_of}")
        self.best_of, self.regular, self.final = best_of, regular, final

    def rule(self, s: State) -> SetRule:
        return self.final if sum(s.sets) + 1 == self.best_of else self.regular

    def tiebreak(self, s: State) -> bool:
        at = self.rule(s).at
        return at is not None and s.games == (at, at)

    def over(self, s: State) -> bool:
        return max(s.sets) > self.best_of // 2

    def server(self, s: State) -> int:
        played = sum(s.points)
        block = self.rule(s).block
        own = not self.tiebreak(s) or played < block or (played - block) // 2 % 2 == 1
        return s.serves if own else 3 - s.serves

    def after(self, s: State, winner: int) -> State:
        if self.over(s):
            raise ValueError("the match is over")
        if winner not in (1, 2):
            raise ValueError("the winner must be 1 or 2")
        add = lambda pair: (pair[0] + (winner == 1), pair[1] + (winner == 2))
        points, tie, rule = add(s.points), self.tiebreak(s), self.rule(s)
        mine, his = (points if winner == 1 else points[::-1])
        to, margin = (rule.to, rule.margin) if tie else (4, 2)
        if mine < to or mine - his < margin:
            turn = tie and sum(points) % rule.change == 0
            return replace(s, points=points, swapped=s.swapped ^ turn)
        games = add(s.games)
        mine, his = (games if winner == 1 else games[::-1])
        new = replace(s, points=(0, 0), games=games, serves=3 - s.serves, game=s.game + 1, swapped=s.swapped ^ (sum(s.games) % 2 == 0))
        if tie or mine >= 6 and mine - his >= 2:
            return replace(new, sets=add(s.sets), games=(0, 0))
        return new

    def resume(self, sets: tuple[int, int], games: tuple[int, int], points: tuple[int, int], server: int, game: int = 1, swapped: int = 0) -> State:
        """The state of a score in which ``server`` serves the next point."""
        s = State(server, sets, games, points, game, swapped)
        return s if self.server(s) == server else replace(s, serves=3 - server)

    def describe(self, s: State) -> dict:
        server, tie = self.server(s), self.tiebreak(s)
        a, b = s.points if server == 1 else s.points[::-1]
        return {
            "set_no": sum(s.sets) + 1, "game_no_in_set": sum(s.games) + 1, "game_no_in_match": s.game, "point_no_in_game": sum(s.points) + 1,
            "in_tiebreak": tie, "tb_set": self.rule(s).at is not None, "final_set": sum(s.sets) + 1 == self.best_of, "server": server, "returner": 3 - server,
            "side": "ad" if sum(s.points) % 2 else "deuce", "sets_p1": s.sets[0], "sets_p2": s.sets[1], "games_p1": s.games[0], "games_p2": s.games[1],
            "points_p1": s.points[0], "points_p2": s.points[1], "pts": spell_points(a, b, tie), "game_score": f"{s.games[0]}-{s.games[1]}",
            "set_score": f"{s.sets[0]}-{s.sets[1]}", "ends_swapped_before_point": int(s.swapped),
        }


def spell_points(a: int, b: int, tiebreak: bool) -> str:
    if tiebreak:
        return f"{a}-{b}"
    if min(a, b) >= 3:
        return "40-40" if a == b else "AD-40" if a > b else "40-AD"
    return "-".join(("0", "15", "30", "40")[min(x, 3)] for x in (a, b))


def replay_rows(match: Match, first_server: int, winners: Iterator[int | None]) -> Iterator[dict]:
    """The score before each point. After a missing winner or the end, rows repeat the last state and say so."""
    state, stopped = State(first_server), False
    for w in winners:
        stopped = stopped or match.over(state)
        yield match.describe(state) | {"after_match_end": stopped}
        if stopped or w is None or pd.isna(w):
            stopped = True
        else:
            state = match.after(state, int(w))


def replay(points: DataFrame, key: str, order: str, winner: str, first_server: str = "first_server", best_of: str = "best_of", regular: str = "regular_rule", final: str = "final_rule") -> DataFrame:
    """Each point's key and order with the columns of schema.SCORE, one task for each match at a time.

    A match has some hundred points; its rules and first server are those of its first row.
    """
    kinds = points.select(key, order).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        top = pdf.iloc[0]
        match = Match(int(top[best_of]), RULES[top[regular]], RULES[top[final]])
        rows = pd.DataFrame(replay_rows(match, int(top[first_server]), pdf[winner]), index=pdf.index)
        return pd.concat([pdf[[key, order]], rows], axis=1)

    rows = points.select(key, order, winner, first_server, best_of, regular, final)
    return rows.groupBy(key).applyInPandas(fold, f"{fields}, {schema.SCORE}")


def successor(best_of: Column, last_rule: Column, other_rule: Column, sets: tuple[Column, Column], games: tuple[Column, Column], points: tuple[Column, Column], server: Column, winner: Column) -> Column:
    """The score that follows one point, in columns: sets_p1, sets_p2, games_p1, games_p2, points_p1, points_p2, server.

    ``points`` count from 0 (4 to 3 is an advantage); null if the match is over.
    """
    rule = F.when(sets[0] + sets[1] + 1 == best_of, last_rule).otherwise(other_rule)
    of = lambda name: C.lookup(rule, {k: str(getattr(r, name)) for k, r in RULES.items()}).try_cast("int")
    at, to, margin, block = of("at"), of("to"), of("margin"), of("block")
    tie = at.isNotNull() & (games[0] == at) & (games[1] == at)
    add = lambda pair: (pair[0] + (winner == 1).cast("int"), pair[1] + (winner == 2).cast("int"))
    mine = lambda pair: F.when(winner == 1, pair[0]).otherwise(pair[1])
    his = lambda pair: F.when(winner == 1, pair[1]).otherwise(pair[0])
    p, g, s = add(points), add(games), add(sets)
    game = (mine(p) >= F.when(tie, to).otherwise(4)) & (mine(p) - his(p) >= F.when(tie, margin).otherwise(2))
    set_ = game & (tie | ((mine(g) >= 6) & (mine(g) - his(g) >= 2)))
    first = lambda played: (played < block) | (F.floor((played - block) / 2) % 2 == 1)
    before = points[0] + points[1]
    opener = F.when(~tie | first(before), server).otherwise(3 - server)
    nxt = F.when(game, 3 - opener).when(tie & ~first(before + 1), 3 - opener).otherwise(opener)
    # from 40-all on the written score goes back from advantage to 40-all
    deuce = ~tie & ~game & (p[0] >= 4) & (p[1] >= 4) & (p[0] == p[1])
    zero = F.lit(0)
    out = F.struct(
        F.when(set_, s[0]).otherwise(sets[0]).alias("sets_p1"), F.when(set_, s[1]).otherwise(sets[1]).alias("sets_p2"),
        F.when(set_, zero).when(game, g[0]).otherwise(games[0]).alias("games_p1"), F.when(set_, zero).when(game, g[1]).otherwise(games[1]).alias("games_p2"),
        F.when(game, zero).when(deuce, 3).otherwise(p[0]).alias("points_p1"), F.when(game, zero).when(deuce, 3).otherwise(p[1]).alias("points_p2"), nxt.alias("server"),
    )
    return F.when(F.greatest(*sets) <= F.floor(best_of / 2), out)


def check_steps(scores: DataFrame, key: str, order: str, winner: str, best_of: str = "best_of", final: str = "final_rule", regular: str = "regular_rule") -> DataFrame:
    """Whether each recorded score is one point after the one before it; null on a match's first row. No replay is needed."""
    w = Window.partitionBy(key).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("sets_p1", "sets_p2", "games_p1", "games_p2", "points_p1", "points_p2", "server", winner)}
    rows = scores.select("*", *[v.alias("_" + c) for c, v in before.items()], F.row_number().over(w).alias("_n"))
    # scores past 40-all are written as 3 and 4
    both = lambda a, b: F.least(F.col(a), F.col(b))
    low = both("_points_p1", "_points_p2")
    capped = lambda c: F.when(low > 3, F.col(c) - low + 3).otherwise(F.col(c))
    tie = F.col("_games_p1") + F.col("_games_p2") >= 12
    pts = tuple(F.when(tie, F.col(c)).otherwise(capped(c)) for c in ("_points_p1", "_points_p2"))
    nxt = successor(F.col(best_of), F.col(final), F.col(regular), (F.col("_sets_p1"), F.col("_sets_p2")), (F.col("_games_p1"), F.col("_games_p2")), pts, F.col("_server"), F.col("_" + winner))
    rows = rows.withColumn("_next", nxt)
    now_low = both("points_p1", "points_p2")
    now = lambda c: F.when((now_low > 3) & (F.col("games_p1") + F.col("games_p2") < 12), F.col(c) - now_low + 3).otherwise(F.col(c))
    same = F.lit(True)
    for c in ("sets_p1", "sets_p2", "games_p1", "games_p2", "server"):
        same = same & (F.col(f"_next.{c}") == F.col(c))
    for c in ("points_p1", "points_p2"):
        same = same & (F.col(f"_next.{c}") == now(c))
    return rows.select(*scores.columns, F.when(F.col("_n") > 1, F.coalesce(same, F.lit(False))).alias("step_ok"))


CORE = ("server", "sets_p1", "sets_p2", "games_p1", "games_p2", "pts", "game_no_in_match")


def validate(replayed: DataFrame, recorded: DataFrame, key: str, order: str, steps: DataFrame) -> DataFrame:
    """A row for each match: how its recorded scores (under the replay's names) compare with the replay.

    ``steps`` has check_steps()'s result for the recorded rows. Categories, the first that holds: partial_start, clean or
    tbset_flag_only, rows_after_match_end, missing_value, inconsistent, diverged.
    """
    told = recorded.select(key, order, *[F.col(c).alias("_" + c) for c in (*CORE, "tb_set")])
    rows = replayed.join(told, [key, order], "left").join(steps.select(key, order, "step_ok"), [key, order], "left")
    equal = {c: F.coalesce(F.col(c) == F.col("_" + c), F.lit(False)) for c in (*CORE, "tb_set")}
    core = equal[CORE[0]]
    for c in CORE[1:]:
        core = core & equal[c]
    missing = F.lit(False)
    for c in CORE:
        missing = missing | F.col("_" + c).isNull()
    start = (F.col("_sets_p1") == 0) & (F.col("_sets_p2") == 0) & (F.col("_games_p1") == 0) & (F.col("_games_p2") == 0) & (F.col("_pts") == "0-0")
    bad = F.when(~core, F.struct(F.col(order).alias("at"), F.col("after_match_end").alias("after"), missing.alias("missing"), F.coalesce("step_ok", F.lit(True)).alias("step")))
    out = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(F.coalesce(start, F.lit(False)), F.col(order)).alias("starts_at_zero"), F.min(bad).alias("_bad"),
        F.sum((~equal["tb_set"]).cast("int")).alias("mismatch_tb_set"), *[F.sum((~equal[c]).cast("int")).alias(f"mismatch_{c}") for c in CORE],
        F.sum(F.col("after_match_end").cast("int")).alias("rows_after_match_end"), F.sum(F.col("step_ok").cast("int")).alias("step_ok"), F.count("step_ok").alias("step_total"),
    )
    b = F.col("_bad")
    category = (
        F.when(~F.col("starts_at_zero"), "partial_start").when(b.isNull(), F.when(F.col("mismatch_tb_set") > 0, "tbset_flag_only").otherwise("clean"))
        .when(b["after"], "rows_after_match_end").when(b["missing"], "missing_value").when(~b["step"], "inconsistent").otherwise("diverged")
    )
    return out.select("*", category.alias("category"), b["at"].alias("first_bad")).drop("_bad")
