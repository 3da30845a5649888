"""Chat formatting on token level: segments encoded apart, reserved ids spliced in, loss masks by prefix sums."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import ship, table

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's words are cut (a fixed value of the public byte-level vocabulary).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Runs of white space (Unicode's, a fixed value) of this many signs are cut out before the pattern sees them, where it
#: would cut itself: it would run out of stack over some million of them.
SPACES = 100_000
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: It starts at the start of a run alone and gives nothing back, so each run is gone through once.
_SPACES = re.compile(rf"(?<![{_WHITE}])[{_WHITE}]{{{SPACES},}}+")
#: Rows that are held decoded at a time.
CHUNK = 1000
#: The template's own marks, in the order of their reserved ids behind the tokenizer's vocabulary.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
#: Control strings of this and other templates that must not stand in a content.
CONTROLS = (*MARKS, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\([a-z\\])")
_CODE = {c: chr(97 + i) for i, c in enumerate(CONTROLS)}
_BACK = {v: k for k, v in _CODE.items()} | {"\\": "\\"}


def escape(s: str) -> str:
    r"""Backslashes are doubled and control strings become a backslash and a letter; unescape() undoes it.

    No control string holds a backslash, so none is left or arises."""
    return _CONTROL.sub(lambda m: "\\" + _CODE[m[0]], s.replace("\\", "\\\\"))


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m[1]], s)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """The ranks of a vocabulary file; it has no special tokens, so every content is ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("chat", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def encode(tok, s: str) -> np.ndarray:
    """Ids of a content; decode() undoes it for any text.

    The pattern takes all of a run of white space before a word but its last sign as one piece, and a run at the end
    whole: long runs are handed over as such pieces, so ids are those of the undivided text."""
    parts, at = [], 0
    for m in _SPACES.finditer(s) if len(s) >= SPACES else ():
        if m.end() < len(s):
            parts += [s[at : m.start()], s[m.start() : m.end() - 1]]
            at = m.end() - 1
    return np.concatenate([tok.encode_to_numpy(p, disallowed_special=()) for p in [*parts, s[at:]]]).astype(np.int32)


def decode(tok, ids: np.ndarray) -> str:
    return tok.decode_bytes(ids.tolist()).decode("utf-8")


def format_turns(turns: DataFrame, path: str = DEFAULT_TOKENIZER, learn: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn: conv, turn, tie, ids, text_from, text_to, in_loss, n_tokens, chars.

    ids are the tokens of the turn: TURN, the role's, TEXT, the text's, END, where the marks are reserved ids behind
    the vocabulary and content is encoded by itself, so no content can make or swallow a mark. Tokens
    [text_from, text_to), sums of the lengths of the segments before them, are content of the turn, and in_loss says
    whether they count; mask() spells that out. Turns of a conversation are ordered by turn, and turns of one number
    by tie, a hash of role and text. Null role and text count as empty, and a null conversation id is a conversation
    of its own; repeated rows stay. Other columns are not read; no rows give no rows.

    Segments are encoded row by row, without any exchange; place() and render() add places and text."""
    ship(turns.sparkSession)
    fixed = sum(map(len, MARKS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        turn, text, end = (np.array([tok.n_vocab + i], np.int32) for i in range(len(MARKS)))
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                pdf = batch.iloc[at : at + CHUNK]
                roles, texts = [escape(r) for r in pdf["role"]], [escape(t) for t in pdf["text"]]
                a, b = [encode(tok, r) for r in roles], [encode(tok, t) for t in texts]
                segments = np.array([[1 + len(x), 1, len(y), 1] for x, y in zip(a, b, strict=True)]).cumsum(axis=1)
                yield pd.DataFrame({
                    "conv": pdf["conv"], "turn": pdf["turn"], "tie": pdf["tie"],
                    "ids": [np.concatenate([turn, x, text, y, end]) for x, y in zip(a, b, strict=True)],
                    "text_from": segments[:, 1], "text_to": segments[:, 2], "in_loss": pdf["role"].isin(learn), "n_tokens": segments[:, 3],
                    "chars": [fixed + len(r) + len(t) for r, t in zip(roles, texts, strict=True)],
                })

    inner = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    inner = inner.withColumn("tie", F.xxhash64("role", "text"))
    kinds = {f.name: f.dataType.simpleString() for f in inner.schema.fields}
    out = inner.mapInPandas(run, f"conv {kinds['conv']}, turn {kinds['turn']}, tie bigint, ids array<int>, text_from int, text_to int, in_loss boolean, n_tokens long, chars long")
    return out.withColumnRenamed("conv", conv_col)


def place(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Adds place (from 0), start and start_chars: prefix sums over the turns before, the turn's first token and
    character in its conversation."""
    order = Window.partitionBy(conv_col).orderBy("turn", "tie")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return formatted.withColumns({
        "place": F.row_number().over(order) - 1,
        "start": F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"),
        "start_chars": F.coalesce(F.sum("chars").over(before), F.lit(0)).cast("long"),
    })


def loss_mask(n: int, lo: int, hi: int, in_loss: bool) -> np.ndarray:
    """0 or 1 for each of n tokens: the running sum of +1 where counted content begins and -1 behind its end."""
    step = np.zeros(n + 1, np.int8)
    if in_loss:
        step[lo] += 1
        step[hi] -= 1
    return np.cumsum(step[:-1], dtype=np.int8)


def _spell(tok, ids: np.ndarray) -> list[str]:
    """Segments between the marks, decoded, and the marks themselves, in order."""
    out, at = [], 0
    for i in np.nonzero(ids >= tok.n_vocab)[0].tolist():
        out += [decode(tok, ids[at:i]), MARKS[ids[i] - tok.n_vocab]]
        at = i + 1
    return [*out, decode(tok, ids[at:])]


def render(out: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Adds formatted: the text that the ids spell, marks as their strings."""

    @F.pandas_udf("string")
    def spelled(ids: pd.Series) -> pd.Series:
        tok = tokenizer(path)
        return pd.Series(["".join(_spell(tok, x)) for x in ids], dtype=object)

    return out.withColumn("formatted", spelled("ids"))


def mask(out: DataFrame) -> DataFrame:
    """Adds loss_mask: loss_mask() of each turn's tokens."""

    @F.pandas_udf("array<tinyint>")
    def masks(n: pd.Series, lo: pd.Series, hi: pd.Series, in_loss: pd.Series) -> pd.Series:
        return pd.Series([loss_mask(*x) for x in zip(n, lo, hi, in_loss, strict=True)], dtype=object)

    return out.withColumn("loss_mask", masks("n_tokens", "text_from", "text_to", "in_loss"))


def digests(formatted: DataFrame, path: str = DEFAULT_TOKENIZER, conv_col: str = "conv_id") -> DataFrame:
    """Read conversations back from their tokens: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    What is learned are the tokens under the loss mask. Turns stream through in order with two hash states for each
    conversation, never gathered: a hash of texts in order needs one task for a conversation, of whatever length."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        now: list = []

        def done() -> pd.DataFrame:
            conv, n, turns, chars, loss, total = now
            row = {"conv": None if conv is None else conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}
            return pd.DataFrame([row])

        for pdf in batches:
            rows = zip(pdf["conv"], pdf["ids"], pdf["text_from"], pdf["text_to"], pdf["in_loss"], strict=True)
            finished = []
            for conv, ids, lo, hi, in_loss in rows:
                conv = None if pd.isna(conv) else conv
                if not now or now[0] != conv:
                    if now:
                        finished.append(done())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                spelled = _spell(tok, ids)
                _, _, role, _, text, _, _ = spelled
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                if in_loss:
                    learned = unescape(decode(tok, ids[loss_mask(len(ids), lo, hi, in_loss) == 1]))
                    now[3] += len(learned)
                    now[4].update(learned.encode("utf-8", "surrogatepass"))
                now[5] += sum(map(len, spelled))
            if finished:
                yield pd.concat(finished)
        if now:
            yield done()

    dealt = formatted.withColumnRenamed(conv_col, "conv").repartition("conv").sortWithinPartitions("conv", "turn", "tie")
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    out = dealt.select("conv", "ids", "text_from", "text_to", "in_loss").mapInPandas(run, schema)
    return out.withColumnRenamed("conv", conv_col)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    schema = T.StructType([turns.schema[c] for c in turns.columns])
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], schema)
    return digests(format_turns(turns.unionByName(own)))


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') r, coalesce("text", '') s from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(replace(s, chr(92), repeat(chr(92), 2))) + length(r)
      - list_sum(list_transform(['<|turn|>', '<|text|>', '<|end|>', '<|im_start|>', '<|im_end|>', '<|endoftext|>', '<|system|>', '<|user|>', '<|assistant|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
          lambda c: (length(s) - length(replace(s, c, ''))) // length(c) * (length(c) - 2))) + 23 n from t)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || s || chr(10), '' order by turn)) turns_sha256,
  coalesce(sum(length(s)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(s, '' order by turn) filter (r = 'assistant'), '')) loss_sha256, sum(n)::bigint formatted_chars
from e group by 1
"""
