"""Quality rules: a threshold table compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import let, words


@dataclass(frozen=True)
class Rule:
    """Keep a document if low <= measure <= high (either end may be open) once it has min_words words."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Common function words of the languages the rules are meant for.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec dans de des du elle en est et la le les ou par pas pour que qui se sur un une "
    "auf das dem den der des die ein eine er es ist mit nicht und von zu "
    "al como con del el los las lo no para por su y"
).split()
_STOP_FORMS = [f for w in dict.fromkeys(STOP_WORDS) for f in dict.fromkeys((w, w.capitalize(), w.upper()))]

#: Production thresholds. base_* are the two rules that any text has to meet.
RULES = (
    Rule("base_length", "n_words", low=50),
    Rule("base_repeats", "repeat_ratio", high=0.5),
    Rule("mean_word_length", "mean_word_length", low=2.0, high=20.0),
    Rule("symbols", "symbol_ratio", high=0.3),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.5),
    Rule("shouting", "upper_ratio", high=0.5),
    Rule("bar_cells", "bar_ratio", high=0.2),
)


def measures(text: Column) -> dict[str, Column]:
    """Counts over the whole text of a row that has its words beside it; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
        "lines": line_counts,
        "n_repeat_words": repeat_words(F.col("words")).cast("long"),
        "n_stop": F.size(F.filter("words", lambda w: w.isin(_STOP_FORMS))).cast("long"),
        "n_upper": F.length(F.regexp_replace(t, r"[^A-Z]+", "")).cast("long"),
        "n_bars": F.length(F.regexp_replace(t, r"[^|]+", "")).cast("long"),
    }


def repeat_words(w: Column) -> Column:
    """Words that stand in a 3-word window found twice or more, the first find included.

    Windows are compared by 64-bit hash within one text: sorted with their places, equal neighbours are
    repeats, and the places covered by them are counted once. n log n in the words, for texts of any length."""

    def hashes(v: Column) -> Column:
        at = F.slice(v, 1, F.greatest(F.size(v) - 2, F.lit(0)))
        return F.transform(at, lambda x, i: F.xxhash64(x, F.get(v, i + 1), F.get(v, i + 2)))

    def repeated(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.filter(s, lambda x, k: x == F.get(s, k + 1)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<int>")).otherwise(let(F.array_distinct(twice), lambda d: places(h, d)))

    def places(h: Column, d: Column) -> Column:  # by search in a few values, else by sorting all with their places
        few = F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull())
        near = lambda s: F.filter(s, lambda x, k: (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"]))
        many = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), near)
        return F.when(F.size(d) <= 16, few).otherwise(F.sort_array(F.transform(many, lambda x: x["i"])))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(let(let(w, hashes), repeated), covered)


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "stop_ratio": F.col("n_stop") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "bar_ratio": F.col("n_bars") / n,
    }


def compile_rules(rules=RULES) -> Column:
    """The names of the rules that a row breaks, as one expression over the measures."""
    r = ratios()
    broken = []
    for rule in rules:
        bad = F.lit(False)
        if rule.low is not None:
            bad = bad | (r[rule.measure] < rule.low)
        if rule.high is not None:
            bad = bad | (r[rule.measure] > rule.high)
        broken.append(F.when(bad & (F.col("n_words") >= rule.min_words), F.lit(rule.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules=RULES, text_col: str = "text", key_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, measures, broken rules (array of names), base_failed and kept; one row for each row of docs.

    Null or empty text: all counts 0, base_failed, not kept. Null ids and repeated rows pass through as they
    are; an empty table gives an empty table; other columns are ignored, whatever their names."""
    inner = docs.select(*[F.col(c) for c in key_cols], F.col(text_col).alias("text")).withColumn("words", words(F.col("text")))
    counted = inner.select(*key_cols, *[c.alias(k) for k, c in measures(F.col("text")).items()])
    counted = counted.withColumns({"n_lines": F.col("lines.n").cast("long"), "n_dup_lines": F.col("lines.dup").cast("long")}).drop("lines")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.withColumns({"broken": compile_rules(rules), "base_failed": base})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs, with all their columns, that break no rule."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judged = apply_rules(docs.select(F.col("text"), whole.alias("row")), rules, key_cols=("row",))
    return judged.where("kept").select("row.*")


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    from lexmill.llm.common import table

    out = apply_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in _STOP_FORMS)
ORACLE = rf"""
with t as (select row_number() over () rid, doc_id, coalesce("text", '') s from documents),
w as (select rid, doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') ws,
      list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from t),
g as (select rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g from (select rid, ws, unnest(range(1, len(ws)::bigint - 1)) i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from r) group by 1),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
      length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
      coalesce(c.n, 0)::bigint n_repeat_words, len(ls) n_lines, length(regexp_replace(s, '[^A-Z]+', '', 'g')) n_upper, length(regexp_replace(s, '[^|]+', '', 'g')) n_bars,
      len(list_filter(ws, lambda x: x in ({_STOP}))) n_stop
      from w left join c using (rid)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, greatest(n_words, 1)::double n from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars / n between 2.0 and 20.0 and n_symbols / n <= 0.3 and n_stop / n >= 0.02
  and n_dup_lines / greatest(n_lines, 1)::double <= 0.5 and n_upper / greatest(word_chars, 1)::double <= 0.5 and n_bars / n <= 0.2 kept
from b
"""
