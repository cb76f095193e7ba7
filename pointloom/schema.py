"""Declared schemas of the source files and the column order of the result tables."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Columns of the files, all read as text.
MATCHES = strings("match_id", "Player 1", "Player 2", "Pl 1 hand", "Pl 2 hand", "Date", "Tournament", "Round", "Time", "Court", "Surface", "Umpire", "Best of", "Final TB?", "Charted by")
POINTS = strings("match_id", "Pt", "Set1", "Set2", "Gm1", "Gm2", "Pts", "Gm#", "TbSet", "Svr", "1st", "2nd", "Notes", "PtWinner")
POINT_INTEGERS = ("Pt", "Set1", "Set2", "Gm1", "Gm2", "Gm#", "Svr", "PtWinner")

#: One row a point, as point_table() gives it.
POINT_TABLE = (
    "match_id", "Pt", "server", "returner", "server_name", "returner_name", "Set1", "Set2", "Gm1", "Gm2", "Pts", "Gm#", "TbSet",
    "n_serve_attempts", "in_serve", "in_serve_direction", "is_double_fault", "n_contacts", "outcome", "last_hitter_role", "special",
    "challenge", "winner_role", "PtWinner", "notation_winner_agrees", "parse_ok", "canonical", "parse_errors",
)

SERVE = "struct<lets:int,direction:string,fault:string,outcome:string,volley:boolean,underarm:boolean,cord:boolean>"
SHOT = "struct<letter:string,modifiers:string,direction:string,depth:string,error:string,outcome:string>"
ATTEMPT = f"struct<special:string,serve:{SERVE},shots:array<{SHOT}>,challenge:boolean,canonical:boolean,errors:array<string>,warnings:array<string>>"

#: A score before a point, as replay() gives it.
SCORE = (
    "set_no int, game_no_in_set int, game_no_in_match int, point_no_in_game int, in_tiebreak boolean, tb_set boolean, "
    "final_set boolean, server int, returner int, side string, sets_p1 int, sets_p2 int, games_p1 int, games_p2 int, "
    "points_p1 int, points_p2 int, pts string, game_score string, set_score string, ends_swapped_before_point int, after_match_end boolean"
)
LEDGER = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("key", T.StringType()), T.StructField("input_tokens", T.LongType()), T.StructField("usd", T.DoubleType()), T.StructField("label", T.StringType())])
