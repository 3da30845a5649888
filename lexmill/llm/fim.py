"""Fill-in-the-middle: a byte automaton counts what cuts need, a second pass finds them, and marks are set between the parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import ship, table

#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that one pass of the automaton takes at most; longer texts go through it window by window.
WINDOW = 4 << 20

# Classes of bytes: white space, inner bytes of UTF-8, "<", a mark's letter, ">", and whatever begins a code point otherwise.
_SPACE, _INNER, _OPEN, _LETTER, _CLOSE, _OTHER = range(6)
CLASSES = np.full(256, _OTHER, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = _SPACE
CLASSES[0x80:0xC0] = _INNER
CLASSES[[ord("<"), ord(">")]] = _OPEN, _CLOSE
CLASSES[[ord("P"), ord("S"), ord("M")]] = _LETTER
# States: at the beginning, in white space, in a word, after "<", after "<" and a letter.
_BEGIN, _BLANK, _WORD, _AFTER_OPEN, _AFTER_LETTER = range(5)
#: What a transition counts: a code point, a unit's beginning, a mark's end.
POINT, UNIT, MARK = 1, 2, 4


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what is counted), by state and class."""
    step, count = np.full((5, 6), _WORD, np.uint8), np.full((5, 6), POINT, np.uint8)
    step[:, _SPACE], step[:, _OPEN] = _BLANK, _AFTER_OPEN
    step[_AFTER_OPEN, _LETTER] = _AFTER_LETTER
    count[:, _INNER] = 0
    count[_BEGIN] |= UNIT
    count[[_WORD, _AFTER_OPEN, _AFTER_LETTER], _SPACE] |= UNIT
    count[_AFTER_LETTER, _CLOSE] |= MARK
    return step, count


STEP, COUNT = _tables()
#: After two bytes the state no longer tells where it came from, so all places can be stepped at once.
assert all(len({int(STEP[STEP[s, a], b]) for s in range(5)}) == 1 for a in range(6) for b in range(6))


def scan(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the automaton counts at each byte; it begins anew at starts (places within data, rising, the first 0)."""
    out = np.empty(len(data), np.uint8)
    for lo in range(0, len(data), WINDOW):
        hi, back = min(len(data), lo + WINDOW), min(2, lo)
        kind = CLASSES[data[lo - back : hi]]
        before = np.empty(len(kind), np.uint8)  # the state in which each byte is met
        before[0] = _BEGIN
        before[1:] = STEP[_WORD][kind[:-1]]
        before[2:] = STEP.ravel()[before[1:-1] * np.uint8(6) + kind[1:-1]]
        own = starts[np.searchsorted(starts, lo - back) : np.searchsorted(starts, hi)] - lo + back
        before[own] = _BEGIN
        own = own[own + 1 < len(kind)]
        own = own[~np.isin(own + 1, starts - lo + back)] if len(own) else own
        before[own + 1] = STEP[_BEGIN][kind[own]]
        out[lo:hi] = COUNT.ravel()[before * np.uint8(6) + kind][back:]
    return out


def counted(out: np.ndarray, what: int) -> int:
    return int(np.count_nonzero(out & np.uint8(what)))


def place_of_unit(out: np.ndarray, k: int, block: int = 1 << 16) -> int:
    """Where unit k (from 0) of a text begins, or the text's end if it has no such unit."""
    for lo in range(0, len(out), block):
        begins = out[lo : lo + block] & np.uint8(UNIT)
        n = int(np.count_nonzero(begins))
        if k < n:
            return lo + int(np.flatnonzero(begins)[k])
        k -= n
    return len(out)


def _groups(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are a window long together; a longer text stands alone."""
    lo = 0
    for hi in range(1, len(ends)):
        if hi == len(ends) - 1 or ends[hi + 1] - ends[lo] > WINDOW:
            yield lo, hi
            lo = hi


def _transformed(texts: pa.Array, draws: list[np.ndarray], fim_percent: int, spm_percent: int) -> Iterator[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text; texts: large_string without nulls."""
    h1, h2, h3, h4 = draws
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    mark = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for lo, hi in _groups(ends):
        base, piece = int(ends[lo]), data[ends[lo] : ends[hi]]
        at = ends[lo : hi + 1] - base
        out = scan(piece, np.unique(at[:-1][at[:-1] < at[1:]]))
        for i in range(lo, hi):
            a, b = int(at[i - lo]), int(at[i - lo + 1])
            own = out[a:b]
            n = counted(own, UNIT)
            if a == b or h3[i] % 100 >= fim_percent or counted(own, MARK):
                yield n, "plain", None, None, piece[a:b].tobytes()
                continue
            u, v = sorted((int(h1[i] % (n + 1)), int(h2[i] % (n + 1))))
            first = place_of_unit(own, u)
            second = first + place_of_unit(own[first:], v - u)
            prefix, middle, suffix = (piece[a + x : a + y].tobytes() for x, y in ((0, first), (first, second), (second, b - a)))
            spm = h4[i] % 100 < spm_percent
            made = (mark[1], suffix, mark[0], prefix, mark[2], middle) if spm else (mark[0], prefix, mark[1], suffix, mark[2], middle)
            yield n, "spm" if spm else "psm", counted(own[:first], POINT), counted(own[first:second], POINT), b"".join(made)


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row for each row of docs.

    A text is cut into n units: white space and the word behind it, or white space at the end. Two cuts, drawn from the
    digest of seed and id, part it into prefix, middle and suffix, any of which may be empty. output is the text (form
    plain, for empty and null texts, such that hold a mark, and those not drawn), or the parts with their marks, as prefix,
    suffix, middle (psm) or suffix, prefix, middle (spm). Lengths are code points, null for plain texts.

    Rows of one id and text agree, and a null id draws as an empty one. Other columns are not read; a text of any length is
    taken whole, and memory holds a few times its bytes. One pass without exchange; the state of the automaton is fixed by
    the two bytes before, so all bytes of a window are stepped at once through its tables."""
    ship(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    inner = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), digest.alias("h"))
    inner = inner.select("id", "text", *[F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, n = 0, batch.num_rows
            while lo < n:  # a few MB leave at a time, so that long texts don't pile up
                sizes = np.cumsum(pc.binary_length(batch.column("text").slice(lo)).to_numpy(zero_copy_only=False))
                part = batch.slice(lo, max(1, int(np.searchsorted(sizes, WINDOW, "right"))))
                lo += part.num_rows
                draws = [part.column(f"h{k}").to_numpy() for k in range(1, 5)]
                rows = list(_transformed(pc.cast(part.column("text"), pa.large_string()), draws, fim_percent, spm_percent))
                n_, form, p, m, output = zip(*rows, strict=True)
                text = pa.array(output, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n_, pa.int64()), pa.array(form, pa.string()), pa.array(p, pa.int64()), pa.array(m, pa.int64()), text], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text from output and form: the parts between the marks, in their order. Marks cannot arise anywhere else, as
    none is in the text and none ends as it begins."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def op13_fim(spark, sf_dir: str) -> DataFrame:
    out = transform(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || doc_id) h from documents),
u as (select doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w, [('0x' || h[8 * k + 1 : 8 * k + 8])::bigint for k in range(4)] h from d),
f as (select doc_id, t, w, len(w)::bigint n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end form from u),
p as (select doc_id, t, n, form, array_to_string(w[1:a], '') p, array_to_string(w[a + 1:b], '') m, array_to_string(w[b + 1:], '') s from f)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256 from p
"""
