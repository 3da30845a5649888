"""Routing of questions by term sets, and rules over questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import any_of


def route(text: Column, routes: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first route of which a term is a substring of the lower-cased text."""
    t, out = F.lower(text), None
    for name, terms in routes:
        out = F.when(any_of(t, terms), name) if out is None else out.when(any_of(t, terms), name)
    return out.otherwise(default)


def _any(c: Column, patterns) -> Column:
    """Whether any of the patterns (one, or several) is found in the text."""
    hit = F.lit(False)
    for p in (patterns,) if isinstance(patterns, str) else patterns:
        hit = hit | c.rlike(p)
    return F.coalesce(hit, F.lit(False))


def guard(question: Column, answer: Column, rules: list[dict]) -> Column:
    """The answer with the notes of the rules it breaks, in order, each on a line; empty notes add nothing.

    A rule: when (terms in the question) or when_any (patterns), unless or unless_any; then forbid (patterns of which
    none may be in the answer) with forbid_note, ensure (patterns of which one must) with ensure_note, and require
    (patterns that all must) with require_note."""
    notes = []
    q = F.lower(question)
    for r in rules:
        live = any_of(q, r["when"]) if "when" in r else _any(q, r["when_any"])
        live = live & ~any_of(q, r.get("unless", ())) & ~_any(q, r.get("unless_any", ()))
        if "forbid" in r:
            notes.append(F.when(live & _any(answer, r["forbid"]), F.lit(r["forbid_note"])))
        if "ensure" in r:
            notes.append(F.when(live & ~_any(answer, r["ensure"]), F.lit(r["ensure_note"])))
        if "require" in r:
            whole = F.lit(True)
            for p in r["require"]:
                whole = whole & _any(answer, p)
            notes.append(F.when(live & ~whole, F.lit(r["require_note"])))
    return F.concat_ws("\n", answer, *[F.nullif(n, F.lit("")) for n in notes])


def checked(questions: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Questions that say something, and those that are null or blank."""
    said = F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") != "", F.lit(False))
    return questions.where(said), questions.where(~said)


def gated(questions: DataFrame, mode: str, wanted: str = "gold") -> tuple[DataFrame, DataFrame]:
    """Questions in the wanted mode, whatever its case, and the others."""
    ok = F.coalesce(F.lower(mode) == wanted, F.lit(False))
    return questions.where(ok), questions.where(~ok)


def parsed(raw: Column, schema: str) -> Column:
    """A reply's JSON as a struct of schema and error: null for a JSON object, else up to 2,000 characters of the text."""
    good = F.call_function("try_parse_json", raw).isNotNull() & F.startswith(F.ltrim(raw), F.lit("{"))
    ok = F.coalesce(good, F.lit(False))
    return F.struct(F.when(ok, F.from_json(raw, schema)).alias("value"), F.when(~ok, F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, 2000)).alias("error"))


def whole_number(c: Column) -> Column:
    """The integer a setting spells; null if it does not."""
    return F.trim(c).try_cast("int")


#: What an extraction says: its status, the fields found, those needed, and a question for them.
EXTRACTION = "status string, found map<string,string>, needed_fields array<string>, followup_question string"


def slots(raw: Column, critical: list[str], defaults: dict[str, str], ask: str = "More details are needed.") -> Column:
    """(status, found, missing, question, detail) from an extraction's JSON.

    READY with found fields is OK. MISSING takes needed fields from the defaults (empty ones don't count); if a critical
    one stays open the status is ASK_CLIENT, with the open fields sorted and the question, else OK. All else is ERROR, with
    the raw text, cut, as detail."""
    p = parsed(raw, EXTRACTION)
    v = p["value"]
    given = {k: d for k, d in defaults.items() if d not in (None, "")}
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")
    found, needed = F.coalesce(v["found"], F.create_map().cast("map<string,string>")), F.array_distinct(F.coalesce(v["needed_fields"], F.array().cast("array<string>")))
    filled = F.map_filter(table, lambda k, _: F.array_contains(needed, k))
    open_ = F.array_sort(F.array_except(needed, F.map_keys(table)))
    whole = F.map_concat(F.map_filter(found, lambda k, _: ~F.map_contains_key(filled, k)), filled)
    ready = F.coalesce((v["status"] == "READY") & v["found"].isNotNull(), F.lit(False))
    missing = F.coalesce(v["status"] == "MISSING", F.lit(False))
    asks = missing & F.arrays_overlap(open_, F.array(*map(F.lit, critical)))
    status = F.when(asks, "ASK_CLIENT").when(ready | missing, "OK").otherwise("ERROR")
    return F.struct(
        status.alias("status"), F.when(ready, v["found"]).when(missing, whole).alias("found"), F.when(asks, F.array_join(open_, ",")).otherwise("").alias("missing"),
        F.when(asks, F.coalesce(v["followup_question"], F.lit(ask))).alias("question"), F.when(status == "ERROR", F.substring(F.trim(F.coalesce(raw, F.lit(""))), 1, 2000)).alias("detail"),
    )


def fill_slots(found: Column, needed: list[str], critical: list[str], defaults: dict[str, str]) -> Column:
    """(status, missing) for a map of found fields: OK once defaults leave no critical field open, else ASK_CLIENT
    with the sorted open fields; ERROR for null."""
    have = F.map_keys(F.map_filter(found, lambda _, v: v.isNotNull() & (v != "")))
    open_ = F.array_sort(F.array_except(F.array(*map(F.lit, needed)), have))
    still = F.array_except(open_, F.array(*map(F.lit, defaults)))
    asks = F.size(F.array_intersect(still, F.array(*map(F.lit, critical)))) > 0
    status = F.when(found.isNull(), "ERROR").when(F.size(open_) == 0, "OK").when(asks, "ASK_CLIENT").otherwise("OK")
    return F.struct(status.alias("status"), F.coalesce(F.array_join(F.when(status == "ASK_CLIENT", still), ","), F.lit("")).alias("missing"))
