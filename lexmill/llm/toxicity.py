"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, calibrated votes."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, alone, fold, ship, small, table

#: The classifier is fitted on this many labelled rows at most, drawn by hash of id and text from all labelled rows.
TRAIN_ROWS = 4_000
#: Terms are words and their beginnings of these lengths.
PREFIX = (3, 4, 6)
#: A term's weight is its idf times the square of its log odds of a toxic row, as if SHRINK more rows had the term at
#: the odds of all rows. Common terms weigh little by it, but every term of every text counts.
SHRINK = 10.0
#: Neighbours that vote, and examples in a block of the lists.
NEIGHBOURS, BLOCK = 20, 128
#: Terms of so few examples have no blocks: their lists are read at once.
RARE = 4
#: Terms are added up until what the others can add is this part of the k-th score.
SLACK = 0.3
#: Votes of weight PRIOR for the share of toxic rows among the examples.
PRIOR = 1e-3
REJECT = 0.7
#: Rows are taken from a batch by so many, and their texts together up to this many characters.
SLICE = 300
CHUNK_CHARS = 800_000

_random = np.random.default_rng(20240510).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is part of a word: alphanumeric and no decimal digit."""
    return np.array([(c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)])


def multipliers(n: int) -> np.ndarray:
    """Random odd numbers for the places of a word."""
    global _random
    while len(_random) < n:
        more = np.random.default_rng([20240510, len(_random)]).integers(0, 2**63, len(_random), dtype=np.uint64)
        _random = np.concatenate([_random, more * np.uint64(2) + np.uint64(1)])
    return _random


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """The bits of sums well spread, apart by salt."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Terms:
    """The terms of texts, by 64-bit key or, with a sorted vocabulary of keys, by their numbers there; others are left out.

    A word's terms are the lower-cased word and its beginnings, hashed linearly with random multipliers for the places."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys = keys

    def of(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The terms of each whole text, repeated as they occur."""
        part, size = [], 0
        for t in texts:
            t = t.lower() if isinstance(t, str) else ""
            if part and size + len(t) > CHUNK_CHARS:
                yield from self._of(part)
                part, size = [], 0
            part.append(t)
            size += len(t) + 1
        yield from self._of(part)

    def _of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        cps = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters()[cps]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        n = stop - start
        if not len(n):
            yield from (np.empty(0, np.int64 if self.keys is not None else np.uint64) for _ in texts)
            return
        at, _ = _ranges(start, stop)
        first = np.cumsum(n) - n
        sums = (cps[at].astype(np.uint64) + np.uint64(1)) * multipliers(int(n.max()))[np.arange(len(at)) - np.repeat(first, n)]
        words, one, of = np.unique(mixed(np.add.reduceat(sums, first), 0), return_index=True, return_inverse=True)
        table, valid = np.zeros((len(words), 1 + len(PREFIX)), np.uint64), np.ones((len(words), 1 + len(PREFIX)), bool)
        table[:, 0] = words
        for k, size in enumerate(PREFIX, 1):  # of the distinct words alone
            valid[:, k] = n[one] > size
            at = first[one[valid[:, k]]]
            table[valid[:, k], k] = mixed(sum((sums[at + j] for j in range(1, size)), sums[at]), size)
        if self.keys is not None:
            found = np.minimum(np.searchsorted(self.keys, table[valid]), max(len(self.keys) - 1, 0))
            hit = self.keys[found] == table[valid] if len(self.keys) else np.zeros(len(found), bool)
            table = table.astype(np.int64)
            table[valid] = found
            valid[valid] = hit
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = np.searchsorted(start, ends)
        for lo, hi in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            rows = of[lo:hi]
            yield table[rows][valid[rows]]

    def counts(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct terms of each whole text, sorted, and how often each occurs."""
        for ids in self.of(texts):
            ids = np.sort(ids)
            first = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0] if len(ids) else np.empty(0, np.int64)
            yield ids[first], np.diff(np.append(first, len(ids)))


class BlockMaxIndex:
    """Inverted lists of TF-IDF vectors, in blocks of examples; a block's largest weights of a term bound its part.

    Examples are rows, sorted by id; terms are numbers, each of at least one row. rows, cols, counts: the entries of all
    rows, sorted by col and row; weights: those of the terms. An entry weighs (1 + log count) * weight / norm of its row."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray):
        n, v = len(ids), len(weights)
        self.ids, self.labels, self.terms = ids, labels, weights.astype(np.float64)
        parts = [slice(i, i + 500_000) for i in range(0, max(len(counts), 1), 500_000)]  # no copies of all entries
        self.tf = np.concatenate([(1 + np.log(counts[p])).astype(np.float32) for p in parts])
        self.rows = rows.astype(np.uint16 if n < 1 << 16 else np.int32)
        self.starts = np.searchsorted(cols, np.arange(v + 1)).astype(np.int32)
        square = sum(np.bincount(rows[p], (self.tf[p] * self.terms[cols[p]]) ** 2, n) for p in parts)
        self.scale = 1 / np.maximum(np.sqrt(square), 1e-12)
        # the same by row, to finish a few rows
        order = np.argsort(self.rows, kind="stable")
        self.row_cols, self.row_tf = cols[order].astype(np.int32), self.tf[order]
        self.row_starts = np.searchsorted(self.rows[order], np.arange(n + 1)).astype(np.int32)
        # largest entries by block of the terms that are not rare, without the terms' weights, rounded up
        size = np.diff(self.starts)
        self.common = np.nonzero(size > RARE)[0].astype(np.int32)
        self.number = np.full(v, -1, np.int32)  # of the terms that are not rare
        self.number[self.common] = np.arange(len(self.common))
        self.blocks = -(-n // BLOCK)
        peak = np.zeros((len(self.common), self.blocks), np.float32)
        for p in parts:
            of = self.number[cols[p]]
            mine = of >= 0
            at = self.rows[p][mine]
            np.maximum.at(peak, (of[mine], at // BLOCK), (self.tf[p][mine] * self.scale[at]).astype(np.float32))
        self.peak = peak * np.float32(1 + 1e-6)
        self.most = self.peak.max(axis=1) if self.peak.size else np.empty(0, np.float32)

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The weights of a query's unit vector."""
        q = (1 + np.log(counts)) * self.terms[terms]
        return q / max(float(np.sqrt(q @ q)), 1e-12)

    def _add(self, score: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: np.ndarray) -> np.ndarray:
        at, n = _ranges(lo, hi)
        return score + np.bincount(self.rows[at], np.repeat(q, n) * self.tf[at], len(score)) if len(at) else score

    def _floor(self, cosine: np.ndarray, k: int) -> float:
        """At most the k-th best cosine: the k-th best of the blocks' best, or of all where there are few blocks."""
        best = np.maximum.reduceat(cosine, np.arange(0, len(cosine), BLOCK)) if self.blocks >= k else cosine
        return float(np.partition(best, len(best) - k)[len(best) - k]) if len(best) >= k else 0.0

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, without: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k best over 0, exactly; ties (to six digits) go to the smaller id. without: places left out.

        terms, q: numbers and weights of the query's unit vector. Rare and heavy terms are added up first, until what the
        others can add is small against the k-th score. The blocks' largest entries of the others bound what each
        example can still get; the few that could be among the best are finished one by one."""
        n = len(self.ids)
        if not len(terms) or not n:
            return np.empty(0), np.empty(0, np.int64)
        q = q * self.terms[terms]
        lo, hi = self.starts[terms], self.starts[terms + 1]
        at = self.number[terms]
        rare = at < 0
        common = ~rare
        at = at[common]
        lo_, hi_, q_ = lo[common], hi[common], q[common]
        impact = q_ * self.most[at]
        order = np.argsort(-impact)
        rest = np.append(np.cumsum(impact[order][::-1])[::-1], 0.0)
        done = min(16, len(order))
        strong = order[:done]
        score = self._add(np.zeros(n), *(np.concatenate([x[rare], y[strong]]) for x, y in ((lo, lo_), (hi, hi_), (q, q_))))
        while True:
            cosine = score * self.scale
            if without is not None:
                cosine[without] = 0
            floor = self._floor(cosine, k)
            if done == len(order) or rest[done] <= SLACK * floor:
                break
            now = max(done + 16, min(int(np.searchsorted(-rest, -SLACK * floor)), 3 * done + 32))
            strong = order[done:now]
            score = self._add(score, lo_[strong], hi_[strong], q_[strong])
            done = min(now, len(order))
        weak = order[done:]
        if len(weak):
            more = q_[weak].astype(np.float32) @ self.peak[at[weak]]
            near = np.nonzero(cosine + np.repeat(more, BLOCK)[:n] >= max(floor - 1e-5, 1e-9))[0]
            left = self._left()
            left[terms[common][weak]] = q_[weak]
            cuts = list(zip(self.row_starts[near].tolist(), self.row_starts[near + 1].tolist(), strict=True))
            parts = [left[self.row_cols[i:j]] @ self.row_tf[i:j] for i, j in cuts]
            left[terms[common][weak]] = 0
            cosine = cosine[near] + np.array(parts) * self.scale[near]
        else:
            near = np.nonzero(cosine)[0]
            cosine = cosine[near]
        cosine = np.round(cosine, 6)
        if without is not None:
            cosine[(near >= without.start) & (near < without.stop)] = 0
        best = np.argsort(-cosine, kind="stable")[:k]
        best = best[cosine[best] > 0]
        return cosine[best], near[best]

    def _left(self) -> np.ndarray:
        """A vector of zeros over the terms, kept by the task."""
        if "zeros" not in self.__dict__:
            self.zeros = np.zeros(len(self.terms), np.float32)
        return self.zeros


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, end to end, and the ranges' lengths."""
    n = (hi - lo).astype(np.int64)
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n), n


@dataclass
class Model:
    """All that scoring needs, of bounded size: keys of the examples' terms, index with their weights, the examples' share."""

    keys: np.ndarray
    index: BlockMaxIndex
    prior: float

    def vote(self, ids: np.ndarray, n: np.ndarray, without: slice | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of toxic neighbours, each weighing by its distance, and the neighbours (cosine, place)."""
        near, at = self.index.nearest(ids, self.index.unit(ids, n), NEIGHBOURS, without)
        w = near * near
        return float((w @ self.index.labels[at] + PRIOR * self.prior) / (w.sum() + PRIOR)), near, at


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The increasing function nearest to y at x, by pooling: the ends of the pools, to draw lines between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, least and greatest x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, w, _, top = pools.pop()
            q = pools[-1]
            q[0], q[1], q[3] = (q[0] * q[1] + m * w) / (q[1] + w), q[1] + w, top
    return np.array([z for p in pools for z in p[2:]]), np.array([min(max(p[0], 0.0), 1.0) for p in pools for _ in (0, 1)])


def usable(labels: DataFrame) -> DataFrame:
    """(id, label) of all labelled documents; of conflicting labels the toxic one."""
    return labels.where("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").cast("int").alias("label"))


def draw(labelled: DataFrame, rows: int) -> DataFrame:
    """About rows of the labelled rows, by hash of id and text."""
    share = min(1.0, rows / max(labelled.count(), 1))
    return labelled.where(F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 20)) < int(share * (1 << 20)))


def entries(drawn: DataFrame):
    """ids and labels of the examples, sorted by id, and their terms end to end: keys, counts, numbers of terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alone("toxicity")
        for pdf in batches:
            for at in range(0, len(pdf), 100):
                part = pdf.iloc[at : at + 100]
                found = list(Terms().counts(part["text"]))
                yield pd.DataFrame({"id": part["id"], "label": part["label"], "terms": [i.tobytes() for i, _ in found], "counts": [n.astype(np.int32).tobytes() for _, n in found]})

    found = drawn.mapInPandas(run, "id long, label int, terms binary, counts binary").toArrow()
    found = found.take(pc.sort_indices(found["id"]))
    flat = [np.frombuffer(c.buffers()[2] or b"", t) for c, t in ((found["terms"].combine_chunks(), np.uint64), (found["counts"].combine_chunks(), np.int32))]
    sizes = pc.binary_length(found["terms"]).to_numpy().astype(np.int64) // 8
    return found["id"].to_numpy(), found["label"].to_numpy().astype(np.int64), flat[0][: sizes.sum()], flat[1][: sizes.sum()], sizes


def fit(docs: DataFrame, drawn: DataFrame) -> Model:
    """The model without its calibration.

    Log odds of terms come from the drawn examples, document frequencies from all docs: each task counts the terms of
    its texts, and sums are by shuffle. What reaches the driver is bounded by the drawn rows and their terms."""
    spark = docs.sparkSession
    ids, labels, keys, counts, sizes = entries(drawn)
    order = np.argsort(keys, kind="stable")
    rows = np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) < 1 << 16 else np.int32), sizes)[order]
    counts = counts[order]
    keys = keys[order]
    del order
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    cols = (np.cumsum(first, dtype=np.int32) - 1).astype(np.int32)
    keys = keys[first].copy()
    shared = spark.sparkContext.broadcast(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")
        known, n = Terms(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in _slices(batches):
            for ids in known.of(batch.column(0).to_pylist()):
                n[ids] += 1  # once for a term, however often it is in the text
        i = np.nonzero(n)[0]
        for lo in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[lo : lo + 100_000].astype(np.int32)), pa.array(n[i[lo : lo + 100_000]])], ["i", "n"])

    total = docs.select("text").mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(keys))
    df[total["i"].to_numpy()] = total["n"].to_numpy()
    del total
    share = (labels.sum() + 0.5) / (len(ids) + 1)
    have = np.bincount(cols, minlength=len(keys))
    toxic = np.bincount(cols[labels[rows] == 1], minlength=len(keys))
    odds = np.log((toxic / share + SHRINK) / (have + SHRINK))
    weights = (np.log((1 + docs.count()) / (1 + df)) + 1) * odds**2
    shared.unpersist()
    return Model(keys, BlockMaxIndex(ids, labels, weights, rows, cols, counts), float(share))


def calibrate(drawn: DataFrame, model) -> tuple[np.ndarray, np.ndarray]:
    """The calibration from votes of the examples, each without those of its own id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alone("toxicity")
        m = model.value
        for pdf in batches:
            own = [slice(*np.searchsorted(m.index.ids, [i, i + 1]).tolist()) for i in pdf["id"]]
            yield pd.DataFrame({"vote": [m.vote(*c, s)[0] for c, s in zip(Terms(m.keys).counts(pdf["text"]), own, strict=True)], "label": pdf["label"]})

    votes = drawn.mapInPandas(run, "vote double, label double").toPandas().sort_values(["vote", "label"])
    if votes.empty:
        return np.array([0.0, 1.0]), np.array([0.5, 0.5])
    return isotonic(votes["vote"].to_numpy(), votes["label"].to_numpy())


def trained(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """A function of texts that gives scores and neighbours: the fitted and calibrated classifier. Its attribute evidence
    makes a column of the neighbours.

    docs: id, text; labels: id, label. Of an id with several texts each is an example with the id's label."""
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    known = work.write(usable(labels), "known")
    labelled = docs.where("text is not null").join(small(known), "id").select("id", "text", "label", F.xxhash64("text").alias("mark"))
    drawn = work.write(draw(labelled, train_rows).dropDuplicates(["id", "mark"]).repartition(32, "id"), "drawn")
    shared = spark.sparkContext.broadcast(fit(docs, drawn))
    steps = calibrate(drawn, shared)

    def classify(texts) -> tuple[list[float], list[tuple[np.ndarray, np.ndarray]]]:
        m = shared.value
        found = [m.vote(*counts) for counts in Terms(m.keys).counts(texts)]
        return np.interp([v for v, _, _ in found], *steps).tolist(), [(near, at) for _, near, at in found]

    def evidence(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
        index = shared.value.index
        ends = np.cumsum([0, *[len(at) for _, at in found]])
        near, at = (np.concatenate([*x, np.empty(0, t)]) for x, t in zip(zip(*found, strict=True), (float, np.int64), strict=True)) if found else (np.empty(0), np.empty(0, np.int64))
        parts = [pa.array(index.ids[at]), pa.array(near), pa.array(index.labels[at].astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["id", "cosine", "label"]))

    classify.evidence = evidence
    return classify


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that few texts are held as Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, score, predicted, evidence), one row for each row of docs.

    labels (id, label 0 or 1; others and nulls are passed over, of conflicting ones the toxic one holds) name the rows
    to learn from; their texts are in train_docs, by default docs. score is the calibrated share of toxic votes among
    the NEIGHBOURS labelled examples of highest cosine, predicted is 1 from 0.7 on, evidence lists (example id, cosine,
    label). Null, empty and wordless texts have no neighbours and get the score of a vote at the examples' share; without
    labels all get 0.5. Whole texts and all their terms count; a term that no example has weighs nothing. Null ids and
    repeated rows pass through; an empty table gives an empty table; other columns are not read.

    Texts are read twice: to count document frequencies, and to score. The model is bounded by train_rows examples and
    goes to the executors as a broadcast variable."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = docs if train_docs is None else train_docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    classify = trained(source, labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")), train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")
        for batch in _slices(batches):
            scores, found = classify(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), classify.evidence(found)], ["id", "score", "evidence"])

    kind = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:bigint,cosine:double,label:int>>")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic; each row is judged by its own text."""
    ship(docs.sparkSession)
    source = docs if train_docs is None else train_docs
    classify = trained(source.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")))

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("toxicity")
        for batch in _slices(batches):
            scores, _ = classify(batch.column(at).to_pylist())
            yield batch.filter(pa.array([s < REJECT for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1)
    out = score(docs, labels)
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")
