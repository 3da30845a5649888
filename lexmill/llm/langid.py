"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import fold, ship, table

#: Size of the vectors, and letters of an n-gram.
DIM, GRAM = 1024, 3
#: Prototypes are bundled from this many documents of a language at most (a bounded sample of the labelled rows,
#: drawn by hash of the id); languages beyond CLASSES are an error.
TRAIN_PER_LANG, CLASSES = 4_000, 2_000
UNDETERMINED = "und"


class Grams:
    """Vectors of letters (random signs that follow from the code point) and of n-grams bound from them."""

    ROOM = 30_000  # n-gram vectors kept; beyond that they are bound anew

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.kept = np.empty((1024, DIM), np.int8)
        self.fold: dict[int, int] = {}

    def letter(self, cp: int) -> np.ndarray:
        if cp not in self.letters:
            self.letters[cp] = np.random.default_rng([7, cp]).integers(0, 2, DIM, dtype=np.int8) * 2 - 1
        return self.letters[cp]

    def bind(self, key: int) -> np.ndarray:
        """The product of the n-gram's letter vectors, each rotated by its place."""
        v = np.ones(DIM, np.int8)
        for place in range(GRAM):
            v = v * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
        return v

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """One row for each n-gram. Those that are new are bound, and kept while there is room."""
        rows = np.array([self.rows.get(k, -1) for k in keys.tolist()])
        new = np.nonzero(rows < 0)[0]
        if len(self.rows) + len(new) > self.ROOM:
            self.rows.clear()
            if len(keys) > self.ROOM // 4:
                return np.stack([self.bind(k) for k in keys.tolist()])
            return self.vectors(keys)
        for i in new.tolist():
            rows[i] = at = len(self.rows)
            if at >= len(self.kept):
                self.kept = np.concatenate([self.kept, np.empty_like(self.kept)])
            k = int(keys[i])
            self.kept[at] = self.bind(k)
            self.rows[k] = at
        return self.kept[rows]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of letters and of word ends, and how often each occurs; empty without a letter."""
        cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known, back = np.unique(cps, return_inverse=True)
        mapped = np.array([self.folded(c) for c in known.tolist()], np.int64)[back] if len(known) else np.empty(0, np.int64)
        if not mapped.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        s = np.concatenate([[0], mapped, [0]])
        s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # other signs are one gap
        return np.unique(s[:-2] | s[1:-1] << 21 | s[2:] << 42, return_counts=True)

    def folded(self, cp: int) -> int:
        if cp not in self.fold:
            self.fold[cp] = cp if chr(cp).isalpha() else 0
        return self.fold[cp]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The sum of the text's n-gram vectors, frequent ones damped by a square root; None without a letter."""
        keys, n = self.counts(text) if isinstance(text, str) else ((), ())
        if not len(keys):
            return None
        out = np.zeros(DIM, np.float32)
        for lo in range(0, len(keys), 4096):
            out += np.sqrt(n[lo : lo + 4096]).astype(np.float32) @ self.vectors(keys[lo : lo + 4096]).astype(np.float32)
        return out


_grams: Grams | None = None


def grams() -> Grams:
    global _grams
    if _grams is None:
        _grams = Grams()
    return _grams


def prototypes(train: DataFrame, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by language, from (id, text, lang) rows; rows with a null text or lang teach nothing.

    Languages are counted first; of one with more than per_lang rows a share is drawn by hash of the id. Each task
    returns one vector for each language that it met, so what reaches the driver is bounded by CLASSES."""
    ship(train.sparkSession)
    rows = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").count().limit(CLASSES + 1).collect()
    if len(counts) > CLASSES:
        raise ValueError(f"more than {CLASSES} languages")
    if not counts:
        return {}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_lang / r["count"])))])
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).drop("id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, sums = grams(), {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                v = g.bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.astype(float).tolist() for v in sums.values()]})

    parts = drawn.mapInPandas(run, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    by_lang = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("v")).collect()
    out = {r["lang"]: np.array(r["v"], np.float32) for r in sorted(by_lang, key=lambda r: r["lang"])}
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in out.items()}


def identify(docs: DataFrame, protos: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score), one row for each row of docs: the language of the nearest prototype by cosine.

    score is the winner's share of a softmax over the cosines. Ties go to the first name. und and 0 for null texts,
    texts without a letter, and everything if no language was learned. Whole texts count, in the space of one
    vector. Other columns are not read; repeated rows and null ids pass through."""
    spark = docs.sparkSession
    ship(spark)
    names = sorted(protos)
    matrix = spark.sparkContext.broadcast(np.stack([protos[k] for k in names]) if names else np.empty((0, DIM), np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, m = grams(), matrix.value
        for pdf in batches:
            langs, scores = [], []
            for text in pdf["text"]:
                v = g.bundle(text) if names else None
                if v is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cos = m @ (v / max(np.linalg.norm(v), 1e-9))
                p = np.exp(20.0 * (cos - cos.max()).astype(float))
                best = int(cos.argmax())
                langs.append(names[best])
                scores.append(float(min(1.0, p[best] / p.sum())))
            yield pd.DataFrame({"id": pdf["id"], "lang_pred": langs, "score": scores})

    inner = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = inner.schema["id"].dataType.simpleString()
    return inner.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    protos = prototypes(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs, protos)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
