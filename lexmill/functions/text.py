"""Normalisers and tokenisers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÇÑÝ"
FOLDED = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, FOLDED)


def fold_exact(c: Column) -> Column:
    """Compatibility decomposition without marks, for texts beyond Latin-1 (ligatures, superscripts); in Arrow batches."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        bare = lambda t: "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
        return texts.map(bare, na_action="ignore")

    return fold(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """Lower case, letters, digits and _ kept with their accents, single blanks."""
    return collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "))


def normalize_folded(c: Column, fold=fold_accents) -> Column:
    """Accents folded (by fold, or fold_exact), lower case, a-z and 0-9 kept; null is empty."""
    return collapse(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s]", " "))


def normalize_stop(c: Column, stop: tuple[str, ...], fold=fold_accents) -> Column:
    """Lower case, folded, - and _ kept, stop words taken out."""
    kept = collapse(F.regexp_replace(fold(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s_-]", " "))
    return F.array_join(F.filter(F.split(kept, " "), lambda t: ~t.isin(*stop)), " ")


def compact(c: Column) -> Column:
    """Letters and digits only, for names that differ in spacing or marks."""
    return F.regexp_replace(F.translate(F.lower(c), "ø", "o"), r"[^\p{L}\p{N}]+", "")


def normalize_blanks(c: Column) -> Column:
    """Single blanks, trimmed, lower case; all signs stay."""
    return F.lower(collapse(c))


def tokens_of_name(c: Column) -> Column:
    """Lower-cased runs of letters and digits; slashes and all other signs, _ among them at the ends, part them."""
    parts = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(parts, lambda t: t != "")


def split_words(c: Column) -> Column:
    """Plain split of a normalised text: an empty text has one empty word."""
    return F.split(c, " ")


def tokens(c: Column) -> Column:
    """Blank-separated tokens of a normalised text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def counted(toks: Column) -> Column:
    """(token, f) of an array's distinct tokens with their numbers, within the row: no exchange is needed."""
    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return bind(starts, lambda p: F.transform(p, lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).alias("f"))))

    return bind(F.sort_array(toks), runs)


def expand(toks: Column, synonyms: dict[str, list[str]], normalize=None) -> Column:
    """Tokens with, behind them, key and members of each synonym group they belong to; first mention kept.

    A token belongs to a group as it stands, so one that normalising changes (as accents are) has to be given that way; normalize:
    applied to what is added, as to the tokens before. What is empty then is left out."""
    groups: dict[str, list[str]] = {}
    for key, members in synonyms.items():
        for word in (key, *members):
            groups.setdefault(word, []).extend((key, *members))
    said = lambda w: F.lit(w) if normalize is None else normalize(F.lit(w))
    pairs = [x for w, g in groups.items() for x in (F.lit(w), F.array(*map(said, dict.fromkeys(g))))]
    table = F.create_map(*pairs)
    more = F.flatten(F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.concat(toks, more), lambda t: t != ""))


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether the text holds any of the terms as a substring."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(c, F.lit(t))
    return F.coalesce(hit, F.lit(False))


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def clamp(c: Column, limit: int = 1200) -> Column:
    """Texts over the limit are cut, reduced to their first sentence if there is one, and marked."""
    cut = F.substring(c, 1, limit)
    sentence = F.regexp_extract(cut, r"(?s)^(.+?[.!?])(?:\s|\z)", 1)
    kept = F.regexp_replace(F.when(sentence != "", sentence).otherwise(cut), r"(?U)\s+\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(kept, F.lit(" …")))


#: Labels of questions and answers in tagged texts.
QUESTION_LABELS, ANSWER_LABELS = ("D", "DOMANDA"), ("R", "RISPOSTA")


def strip_label(c: Column, labels: tuple[str, ...] = ANSWER_LABELS) -> Column:
    """A label and colon at the beginning go, and blanks around the rest."""
    return trim_all(F.regexp_replace(c, rf"(?i)^\s*(?:{'|'.join(labels)})\s*:\s*", ""))


def strip_labels(c: Column) -> Column:
    """Labels at the beginning of any line go."""
    for labels in (QUESTION_LABELS, ANSWER_LABELS):
        c = F.regexp_replace(c, rf"(?im)^\s*(?:{'|'.join(labels)})\s*:\s*", "")
    return c


def trim_all(c: Column) -> Column:
    """Trimmed of all white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def first_paragraph(c: Column) -> Column:
    return trim_all(F.element_at(F.split(c, "\n\n", 2), 1))
