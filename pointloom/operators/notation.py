"""The shot notation: parsing, combining, serialising, and one row for each contact.

An attempt string is read by two patterns, one for the serve and one for each shot; each is permissive, and rules on what its
groups hold tell canonical spelling, spellings that are put right, and errors. Spark parses each different string once and
joins the result back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import columns as C

LETTERS = "fbrsvzopuylmhijktq"
# What canonical attempts look like, by kind.
FAULT = r"^c*[4560]?\^?\+?[nwdxge!]{1,2};?@?$"
ACE = r"^c*[4560]\^?\+?;?[*#]$"
_SHOT = r"[fbrsvzopuylmhijktq][-+=;^!]*[0123]?[789]?"
RALLY = rf"^c*[4560]\^?\+?;?(?:{_SHOT})*(?:{_SHOT}[nwdxe!]{{0,2}}[*#@]?)?C?$"

_SERVE = re.compile(r"(?P<lets>c*)(?:(?P<swap>[nwdxeg])(?=[4560]$))?(?P<dir>[4560]?)(?P<mods>[+^;]*)(?P<fault>[nwdxeg!]*)(?P<cord>;?)(?P<out>[*#@]?)")
_STROKE = re.compile(rf"(?P<letter>[{LETTERS}])(?P<pre>[-+=;^!]*)(?P<digits>[0-9]*)(?P<post>[-+=;^]*)(?P<late>[0-9]*)(?P<err>[nwdxe!]*)(?P<out>[*#@]?)(?P<tail>[nwdxe!]*)")


def _serve(s: str) -> tuple[dict | None, int, list[str], list[str]]:
    """(serve, where it ends, errors, spellings put right) of an attempt that isn't a code."""
    m = _SERVE.match(s)
    g, end, wrong, fixed = m.groupdict(), m.end(), [], []
    if g["swap"]:
        return {"lets": len(g["lets"]), "direction": g["dir"], "fault": g["swap"], "outcome": None, "volley": False, "underarm": False, "cord": False}, end, [], ["fault letter written before the serve digit"]
    if not g["dir"] and not g["fault"]:
        why = "a serve has neither direction nor fault" if g["mods"] else f"a serve's direction is missing at {s[len(g['lets']):len(g['lets']) + 1]!r}"
        return None, end, [why], []
    volley, under = "+" in g["mods"], "^" in g["mods"]
    plain = "^" * under + "+" * volley
    fault, cord, out = g["fault"], ";" in g["mods"], g["out"] or None
    if fault:
        if len(fault) > 2:
            return None, end, [f"too many fault letters {fault!r}"], []
        if cord:
            fixed.append("net cord before the fault letter")
        elif g["mods"] != plain:
            fixed.append("serve modifiers in another order")
        cord = cord or bool(g["cord"])
        if out and out != "@":
            out, end = None, end - 1
    else:
        # the cord's place belongs to the modifiers when there is no fault
        if g["mods"] + g["cord"] != plain + ";" * (cord or bool(g["cord"])):
            fixed.append("serve modifiers in another order")
        cord = cord or bool(g["cord"])
        if out == "@":
            return None, end, ["'@' on a serve in play"], fixed
    return {"lets": len(g["lets"]), "direction": g["dir"] or None, "fault": fault or None, "outcome": out, "volley": volley, "underarm": under, "cord": cord}, end, wrong, fixed


def _stroke(m: re.Match) -> tuple[dict | None, str | None, list[str]]:
    """(shot, error, spellings put right) from a match of _STROKE."""
    g, fixed = m.groupdict(), []
    way, deep = [c for c in g["digits"] if c in "0123"], [c for c in g["digits"] if c in "789"]
    first_bad = next((c for k, c in enumerate(g["digits"]) if c in "456" or c in "789" and any(x in "789" for x in g["digits"][:k]) or c in "0123" and any(x in "0123" for x in g["digits"][:k])), None)
    if first_bad:
        return None, f"serve digit {first_bad!r} in a rally shot" if first_bad in "456" else f"two {'depth' if first_bad in '789' else 'direction'} digits in one shot", []
    if way and deep and g["digits"][0] in "789":
        fixed.append("depth written before direction")
    if g["post"]:
        fixed.append("modifier written after the digits")
        if g["late"]:
            return None, "digit after a modifier that followed the direction", []
    if g["tail"]:
        if g["err"]:
            return None, "error letters on both sides of the outcome", []
        fixed.append("outcome written before the error letter")
    error = g["err"] + g["tail"]
    if len(error) > 2:
        return None, f"too many error letters {error!r}", []
    return {"letter": g["letter"], "modifiers": g["pre"] + g["post"], "direction": way[0] if way else None, "depth": deep[0] if deep else None, "error": error or None, "outcome": g["out"] or None}, None, fixed


def parse_attempt(s: str) -> dict:
    """One attempt string as a dictionary of the fields of schema.ATTEMPT."""
    out = {"special": None, "serve": None, "shots": [], "challenge": False, "canonical": True, "errors": [], "warnings": []}
    if not s:
        return out | {"errors": ["the string is empty"]}
    if s in C.SPECIAL_WINNERS:
        return out | {"special": s}
    if s == "V":
        return out | {"serve": {"lets": 0, "direction": None, "fault": "V", "outcome": None, "volley": False, "underarm": False, "cord": False}}
    serve, at, errors, fixed = _serve(s)
    out |= {"serve": serve, "errors": errors}
    done = serve is None
    if not done and (serve["fault"] or serve["outcome"]) and at < len(s):
        errors.append("text after a fault, an ace or an unreturned serve")
        done = True
    while not done and at < len(s):
        if s[at] == "C":
            if at < len(s) - 1:
                errors.append("'C' before the end")
            else:
                out["challenge"] = True
            break
        m = _STROKE.match(s, at)
        if not m:
            errors.append(f"a shot letter is missing at {s[at]!r}")
            break
        shot, wrong, more = _stroke(m)
        if wrong:
            errors.append(wrong)
            break
        fixed += more
        out["shots"].append(shot)
        at = m.end()
    if not errors:
        for k, shot in enumerate(out["shots"][:-1], 1):
            if shot["outcome"] or shot["error"]:
                errors.append(f"shot {k} ends the point but isn't the last")
        if not out["challenge"] and not serve["fault"]:
            last = out["shots"][-1] if out["shots"] else serve
            if last["outcome"] is None:
                out["warnings"].append("the point's end is missing")
    out["warnings"] += fixed
    out["canonical"] = not fixed
    return out


def _parse_column(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"attempt": batch["attempt"], "parsed": [parse_attempt(s) for s in batch["attempt"]]})


def parse_points(points: DataFrame, first: str = "1st", second: str = "2nd") -> DataFrame:
    """``points`` with a column ``point``: serves, shots, special, challenge, ok, canonical, errors, warnings.

    Null strings count as empty. The second string is read only where the first failed or is a fault.
    """
    a, b = C.clean(F.col(first)), C.clean(F.col(second))
    points = points.withColumn("_a", a).withColumn("_b", b)
    strings = points.select(F.explode(F.array("_a", "_b")).alias("attempt")).distinct()
    parsed = strings.mapInPandas(_parse_column, f"attempt string, parsed {schema.ATTEMPT}")
    joined = points.join(parsed.select(F.col("attempt").alias("_a"), F.col("parsed").alias("p")), "_a").join(parsed.select(F.col("attempt").alias("_b"), F.col("parsed").alias("q")), "_b")
    return joined.withColumn("point", combine(F.col("p"), F.col("q"), F.col("_b"))).drop("_a", "_b", "p", "q")


def combine(p: Column, q: Column, second: Column) -> Column:
    """A point from its two parsed attempts."""
    special = p["special"].isNotNull()
    again = ~special & (p["serve"].isNull() | p["serve"]["fault"].isNotNull() | (F.size(p["errors"]) > 0))
    use = again & (second != "")
    taken = use & q["serve"].isNotNull()
    tagged = lambda a, tag: F.transform(a, lambda e: F.concat(F.lit(tag), e))
    none = F.array().cast("array<string>")
    own = (
        F.when(special & (second != ""), F.array(F.lit("point: text after a code for the whole point")))
        .when(use & q["special"].isNotNull(), F.array(F.lit("2nd: a code for the whole point")))
        .when(~special & ~again & (second != ""), F.array(F.lit("point: a second string though the first serve was in play")))
        .when(again & ~use & p["serve"]["fault"].isNotNull(), F.array(F.lit("point: a fault without a second string")))
        .otherwise(none)
    )
    errors = F.concat(tagged(p["errors"], "1st: "), F.when(use, tagged(q["errors"], "2nd: ")).otherwise(none), own)
    warnings = F.concat(tagged(p["warnings"], "1st: "), F.when(use, tagged(q["warnings"], "2nd: ")).otherwise(none))
    serves = F.filter(F.array(F.when(~special, p["serve"]), F.when(taken, q["serve"])), lambda s: s.isNotNull())
    return F.struct(
        serves.alias("serves"), F.when(taken, q["shots"]).otherwise(p["shots"]).alias("shots"), p["special"].alias("special"),
        F.when(taken, q["challenge"]).otherwise(p["challenge"]).alias("challenge"), (F.size(errors) == 0).alias("ok"),
        (p["canonical"] & (~use | q["canonical"])).alias("canonical"), errors.alias("errors"), warnings.alias("warnings"),
    )


def with_summary(points: DataFrame, point: str = "point") -> DataFrame:
    """Adds what follows from a parsed point: in_serve_index, n_contacts, outcome, last_hitter_role, winner_role, double_fault."""
    p = F.col(point)
    known = p["ok"] & p["special"].isNull()
    faults = F.transform(p["serves"], lambda s: s["fault"].isNotNull())
    double = known & (F.size(p["serves"]) == 2) & F.forall(faults, lambda f: f)
    index = F.when(known, F.array_position(faults, False)).cast("int")
    n = F.size(p["shots"])
    last = F.when(n > 0, F.element_at(p["shots"], -1))
    serve = F.get(p["serves"], index - 1)
    outcome = (
        F.when(~known, "other").when(double, "double_fault").when(p["challenge"], "other")
        .when(n == 0, F.when(serve["outcome"] == "*", "ace").when(serve["outcome"] == "#", "service_winner").otherwise("other"))
        .otherwise(C.lookup(last["outcome"], C.OUTCOMES, "other"))
    )
    hitter = F.when(known, F.when(double | (n % 2 == 0), "server").otherwise("returner"))
    other = F.when(F.col("last_hitter_role") == "server", "returner").otherwise("server")
    winner = (
        F.when(p["special"].isNotNull(), C.lookup(p["special"], C.SPECIAL_WINNERS)).when(~p["ok"], F.lit(None))
        .when(F.col("double_fault"), "returner")
        .when(F.col("outcome").isin("ace", "service_winner", "winner") | p["challenge"], F.col("last_hitter_role"))
        .when(F.col("outcome").isin("forced_error", "unforced_error") | last["error"].isNotNull(), other)
    )
    points = points.withColumn("double_fault", F.coalesce(double, F.lit(False))).withColumn("in_serve_index", F.when(F.col("double_fault") | (index == 0), F.lit(None)).otherwise(index))
    points = points.withColumn("n_contacts", F.when(known, F.when(F.col("double_fault"), 0).otherwise(1 + n)))
    return points.withColumn("outcome", outcome).withColumn("last_hitter_role", hitter).withColumn("winner_role", winner)


def point_table(points: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for each point, in the columns of schema.POINT_TABLE: who serves, the recorded score, what the notation says, and
    whether the winner it implies is the recorded one (null where it implies none or nothing is recorded).

    ``points`` as read_points() gives them; ``matches`` as read_matches(). A match that isn't listed has no names.
    """
    rows = with_summary(parse_points(points))
    names = matches.select("match_id", F.col("Player 1").alias("_one"), F.col("Player 2").alias("_two")).dropDuplicates(["match_id"])
    rows = rows.join(names, "match_id", "left")
    p, server = F.col("point"), F.col("Svr")
    other = 3 - server
    name = lambda who: F.when(who == 1, F.col("_one")).when(who == 2, F.col("_two"))
    serve = F.get(p["serves"], F.col("in_serve_index") - 1)
    implied = F.when(F.col("winner_role") == "server", server).when(F.col("winner_role") == "returner", other)
    made = {
        "server": server, "returner": other, "server_name": name(server), "returner_name": name(other), "n_serve_attempts": F.size(p["serves"]),
        "in_serve": F.col("in_serve_index"), "in_serve_direction": C.lookup(serve["direction"], C.SERVE_DIRECTIONS), "is_double_fault": F.col("double_fault"),
        "special": p["special"], "challenge": F.coalesce(p["challenge"], F.lit(False)), "notation_winner_agrees": implied == F.col("PtWinner"),
        "parse_ok": p["ok"], "canonical": p["canonical"], "parse_errors": F.concat_ws("; ", p["errors"]),
    }
    return rows.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in schema.POINT_TABLE])


def _spell_serve(s: Column) -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    flag = lambda c, t: F.when(c, t).otherwise("")
    body = F.concat(F.repeat(F.lit("c"), s["lets"]), part(s["direction"]), flag(s["underarm"], "^"), flag(s["volley"], "+"), part(s["fault"]), flag(s["cord"], ";"), part(s["outcome"]))
    return F.when(s["fault"] == "V", "V").otherwise(body)


def serialize(point: Column) -> Column:
    """(first, second) in canonical spelling; canonical points come back as they were written."""
    shots = F.concat_ws("", F.transform(point["shots"], lambda s: F.concat_ws("", s["letter"], s["modifiers"], s["direction"], s["depth"], s["error"], s["outcome"])))
    rest = F.concat(shots, F.when(point["challenge"], "C").otherwise(""))
    spelt = F.transform(point["serves"], lambda s: F.concat(_spell_serve(s), F.when(s["fault"].isNull(), rest).otherwise("")))
    first = F.when(point["special"].isNotNull(), point["special"]).otherwise(F.coalesce(F.get(spelt, F.lit(0)), F.lit("")))
    return F.struct(first.alias("first"), F.coalesce(F.get(spelt, F.lit(1)), F.lit("")).alias("second"))


def contacts(points: DataFrame, keys: list[str], server: str = "Svr", point: str = "point") -> DataFrame:
    """A row for each contact of the parsed points whose server is known: struck faults (shot_no 0), the serve in play (1),
    rally shots (2 on); players 1 and 2 hit in turn."""
    p = F.col(point)
    hit = "struct<shot_no:int,serve_no:int,letter:string,modifiers:string,direction:string,depth:string,error:string,outcome:string>"
    faults = F.transform(p["serves"], lambda s, i: F.struct(F.lit(0), i + 1, F.lit(None).cast("string"), F.lit(None).cast("string"), s["direction"], F.lit(None).cast("string"), s["fault"], s["outcome"]).cast(hit))
    struck = F.filter(faults, lambda s: s["error"].isNotNull() & (s["error"] != "V"))
    served = F.transform(p["serves"], lambda s, i: F.struct(F.lit(1), i + 1, F.lit(None).cast("string"), F.lit(None).cast("string"), s["direction"], F.lit(None).cast("string"), s["fault"], s["outcome"]).cast(hit))
    in_play = F.filter(served, lambda s: s["error"].isNull())
    rally = F.transform(p["shots"], lambda s, i: F.struct(i + 2, F.lit(None).cast("int"), s["letter"], s["modifiers"], s["direction"], s["depth"], s["error"], s["outcome"]).cast(hit))
    rows = points.filter(p["ok"] & p["special"].isNull() & F.col(server).isin(1, 2)).select(*keys, F.col(server).alias("_server"), F.explode(F.concat(struck, in_play, rally)).alias("h"))
    odd = F.when(F.col("h.shot_no") <= 1, True).otherwise(F.col("h.shot_no") % 2 == 1)
    kind = F.when(F.col("h.shot_no") <= 1, "serve").otherwise("rally")
    family = F.when(F.col("h.letter").isNotNull(), C.stroke_family(F.col("h.letter")))
    side = F.when(F.col("h.letter").isNotNull(), C.stroke_side(F.col("h.letter")))
    return rows.select(*keys, "h.*", kind.alias("kind"), F.when(odd, F.col("_server")).otherwise(3 - F.col("_server")).alias("hitter"), family.alias("family"), side.alias("side"))


def canonical_kind(s: Column) -> Column:
    """fault, ace, rally, code or violation for canonical strings, else null: no parser is needed for these."""
    return F.when(s.isin(*C.SPECIAL_WINNERS), "code").when(s == "V", "violation").when(s.rlike(FAULT), "fault").when(s.rlike(ACE), "ace").when(s.rlike(RALLY), "rally")


def canonical_shots(s: Column) -> Column:
    """The shots of a canonical rally as strings."""
    return F.regexp_extract_all(s, F.lit(rf"({_SHOT}[nwdxe!]{{0,2}}[*#@]?)"), F.lit(1))


@F.udtf(returnType="pos int, char string, kind string")
class Lexemes:
    """A row for each character of a string of the notation: in SQL, ``select ... from t, lateral lexemes(t.s)``."""

    def eval(self, s: str):
        for pos, char in enumerate(s or ""):
            yield pos, char, C.KINDS.get(char, "junk")


def register(spark) -> None:
    """Makes the table function known to the session's SQL."""
    spark.udtf.register("lexemes", Lexemes)
