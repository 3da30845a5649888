"""Hard negatives by a Voronoi-partitioned join: largest inner products become nearest neighbours of norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, meet, ship, table
from lexmill.llm.vectors import BLOCK, best_of_rows, packed, ranked, sample, unpacked, usable

#: Rows of a pivot's cell, and pivots, about and at most; anchors of a group at most.
CELL_ROWS, MOST_PIVOTS, GROUP_ANCHORS = 1024, 512, 512
#: Products up to here are exact in doubles.
EXACT = float(1 << 53)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all pairs of integer vectors, exact."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if float(most) ** 2 * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lengths(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return (v * v).sum(axis=1)


def _distance(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors with their further component to pivots that have one."""
    x = np.column_stack([v.astype(np.float64), extra])
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)))


class Voronoi:
    """Rows by their nearest pivot, in the space where each has a further component that makes all of them equally long.

    There the distance of a row s to an anchor q, whose component is 0, is |q|^2 + most - 2 qs squared: the nearest row has
    the largest product. rows: id, label, v (bytes of 64-bit integers), pivot, r (distance to it). Per pivot, counts and
    the least and largest r are kept."""

    def __init__(self, rows: DataFrame, work: Workspace):
        """rows: id, label, v (array<long>), one for each id."""
        self.work, self.spark = work, rows.sparkSession
        ship(self.spark)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        row = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.max(F.size("v")).alias("d")).first()
        self.n, self.most, self.dim = row["n"], row["most"] or 0.0, row["d"] or 1
        k = int(min(MOST_PIVOTS, max(1, self.n // CELL_ROWS)))
        chosen = [r["v"] for r in sample(rows, self.n, 4 * k).select("v").collect()][:k] or [[0] * self.dim]
        v = np.asarray(chosen, np.int64)
        self.pivots = pivots = np.column_stack([v.astype(np.float64), np.sqrt(np.maximum(0.0, self.most - lengths(v)))])
        most = self.most

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v = np.stack(pdf["v"].tolist()).astype(np.int64)
                    d = _distance(v, np.sqrt(np.maximum(0.0, most - lengths(v))), pivots)
                    own = d.argmin(axis=1)
                    yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "v": packed(v), "pivot": own, "r": d[np.arange(len(own)), own]})

        self.rows = work.write(rows.select("id", "label", "v").mapInPandas(assign, "id long, label long, v binary, pivot int, r double"), "rows")
        cells = self.rows.groupBy("pivot").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()  # MOST_PIVOTS at most
        self.count = np.zeros(len(pivots), np.int64)
        self.least, self.largest = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in cells:
            self.count[r["pivot"]], self.least[r["pivot"]], self.largest[r["pivot"]] = r["n"], r["lo"], r["hi"]

    def groups(self, anchors: DataFrame) -> DataFrame:
        """(id, label, v, g): anchors in groups of neighbouring pivots. Pivots of few anchors share a group, those of many
        are several groups."""
        pivots, spark = self.pivots, self.spark

        def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v = unpacked(pdf["v"], np.int64)
                    yield pdf[["id", "label", "v"]].assign(pivot=_distance(v, np.zeros(len(v)), pivots).argmin(axis=1).astype(np.int32))

        own = self.work.write(anchors.select("id", "label", "v").mapInPandas(home, "id long, label long, v binary, pivot int"), "anchors")
        held = np.zeros(len(pivots), np.int64)
        for r in own.groupBy("pivot").agg(F.count("*").alias("n")).collect():
            held[r["pivot"]] = r["n"]
        g, parts, k, full = np.zeros(len(pivots), np.int64), np.ones(len(pivots), np.int64), 0, 0
        for p in _chain(pivots):
            if full and full + held[p] > GROUP_ANCHORS:
                k, full = k + parts_used, 0
            parts[p] = parts_used = max(1, -(-int(held[p]) // GROUP_ANCHORS))
            g[p], full = k, full + int(held[p])
        lookup = spark.createDataFrame([(int(p), int(g[p]), int(parts[p])) for p in range(len(pivots))], "pivot int, first long, parts int")
        out = own.join(F.broadcast(lookup), "pivot")  # a row for each pivot
        return self.work.write(out.select("id", "label", "v", "pivot", (F.col("first") + F.pmod(F.xxhash64("id", F.lit(5)), "parts")).alias("g")), "groups")

    def home_needs(self, grouped: DataFrame) -> DataFrame:
        """(g, pivot, lo, hi): the cells of a group's own pivots."""
        return grouped.select("g", "pivot", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")).distinct()

    def needs(self, grouped: DataFrame) -> DataFrame:
        """(g, pivot, lo, hi): which cells, and which of their rows by distance to the pivot, may serve a group.

        grouped: v, g, least and most: the scores that an anchor still looks for. By the triangle inequality a row of a
        score in between lies in a ring around its pivot; a group takes the hull of its anchors' rings."""
        pivots, most, near, far = self.pivots, self.most, self.least, self.largest

        def rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                v = unpacked(pdf["v"], np.int64)
                d, q = _distance(v, np.zeros(len(v)), pivots), lengths(v) + most
                reach = np.sqrt(np.maximum(0.0, q - 2 * pdf["least"].to_numpy()))[:, None]
                inner = np.sqrt(np.maximum(0.0, q - 2 * pdf["most"].to_numpy()))[:, None]
                slack = 1e-6 * (1 + np.sqrt(q))[:, None]  # above what rounding does to distances
                lo, hi = np.maximum(d - reach, inner - d) - slack, d + reach + slack
                may = (lo <= far) & (hi >= near)
                row, p = np.nonzero(may)
                found = pd.DataFrame({"g": pdf["g"].to_numpy()[row], "pivot": p.astype(np.int32), "lo": lo[row, p], "hi": hi[row, p]})
                yield found.groupby(["g", "pivot"], as_index=False).agg({"lo": "min", "hi": "max"})

        made = grouped.select("v", "g", "least", "most").mapInPandas(rings, "g long, pivot int, lo double, hi double")
        return made.groupBy("g", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def joined(self, grouped: DataFrame, needs: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """(anchor, window, score, id, rank): of each anchor's windows the first k rows of the same label, or of others, with a
        score from lo to hi, among the rows that needs name.

        grouped: id, label, v, g, windows (array of window, lo, hi). Rows go to the groups that need them, in parts of
        about BLOCK rows, and anchors to all parts of their group."""
        needs = self.work.write(needs, f"{name}-needs")
        counts = self.spark.createDataFrame([(int(p), int(n)) for p, n in enumerate(self.count)], "pivot int, n long")
        parts = needs.join(F.broadcast(counts), "pivot").groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
        parts = self.work.write(parts.where("parts > 0").withColumn("n", F.lit(0).cast("long")), f"{name}-parts")
        wanted = meet(needs, parts, "g", "pivot").groupBy("pivot").agg(F.collect_list(F.struct("g", "lo", "hi", "parts")).alias("w"))  # of a pivot, one for each group
        wanted = self.work.write(wanted.join(F.broadcast(counts), "pivot"), f"{name}-wanted")
        sent = meet(self.rows, wanted, "pivot", "id")
        sent = sent.select("id", "label", "v", F.explode(F.filter("w", lambda x: (x["lo"] <= F.col("r")) & (F.col("r") <= x["hi"]))).alias("w"))
        sent = sent.select("id", "label", "v", "w.g", F.pmod(F.xxhash64("id", F.lit(6)), F.col("w.parts")).cast("int").alias("part"))
        asked = meet(grouped.select("id", "label", "v", "g", "windows"), parts, "g", "id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        def local(asked: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(sent):
                sid, scores = sent["id"].to_numpy(), products(unpacked(asked["v"], np.int64), unpacked(sent["v"], np.int64))
                equal = asked["label"].to_numpy()[:, None] == sent["label"].to_numpy()[None, :]
                may = (equal if same else ~equal) & (asked["id"].to_numpy()[:, None] != sid[None, :])
                windows = asked["windows"].tolist()
                for w in range(max(map(len, windows), default=0)):
                    has = np.flatnonzero([len(x) > w for x in windows])
                    name, lo, hi = (np.array([windows[i][w][c] for i in has]) for c in ("window", "lo", "hi"))
                    own = scores[has]
                    fit = may[has] & (own >= lo[:, None]) & (own <= hi[:, None])
                    row, col = best_of_rows(np.where(fit, own.astype(np.float64), -np.inf), k, 0.0 if np.abs(own).max(initial=0) < EXACT else np.inf)
                    row, col = row[fit[row, col]], col[fit[row, col]]
                    top = ranked(row, own[row, col], sid[col], k)
                    row, col = row[top], col[top]
                    out.append(pd.DataFrame({"anchor": asked["id"].to_numpy()[has][row], "window": name[row], "score": own[row, col], "id": sid[col]}))
            return pd.concat(out) if out else pd.DataFrame({"anchor": [], "window": [], "score": [], "id": []})

        met = asked.groupBy("g", "part").cogroup(sent.groupBy("g", "part")).applyInPandas(local, "anchor long, window long, score long, id long")
        best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")
        return self.work.write(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), name)

    def first(self, grouped: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """joined() of all rows that may serve. At home, among the rows of its own pivots, an anchor finds how good its k-th
        row is at least; what cannot be better is not sent to its group."""
        home = self.joined(grouped, self.home_needs(grouped), same, k, f"{name}-home")
        kth = home.where(F.col("rank") == k).select(F.col("anchor").alias("id"), "window", F.col("score").alias("kth"))
        windows = grouped.select("id", F.explode("windows").alias("w")).select("id", "w.*")
        bound = windows.join(kth, ["id", "window"], "left").groupBy("id").agg(
            F.min(F.greatest(F.coalesce("kth", "lo"), "lo")).cast("double").alias("least"), F.max("hi").cast("double").alias("most"))
        return self.joined(grouped, self.needs(grouped.join(bound, "id")), same, k, name)


def _chain(pivots: np.ndarray) -> list[int]:
    """All pivots, each followed by the nearest of those left."""
    left, out = set(range(1, len(pivots))), [0]
    while left:
        rest = np.array(sorted(left))
        d = ((pivots[rest] - pivots[out[-1]]) ** 2).sum(axis=1)
        out.append(int(rest[d.argmin()]))
        left.discard(out[-1])
    return out


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score) of the anchors, whose ids are divisible by every.

    vec_col holds integers; the score of two rows is their inner product, higher first, ties to the smaller id. A positive is one of
    an anchor's first rows of its own label; its negatives are the first rows of other labels whose score s satisfies
    low * p <= 100 s <= high * p, p being the positive's score.

    Rows without id, label, vector or a component take no part, nor those of another length than most, and such whose
    products would not fit a long. Rows of one id count once (of the least label, then vector). Other columns are not read;
    empty tables give no rows. The result is exact: bounds only spare sending rows that cannot serve."""
    work = Workspace(vectors.sparkSession, "negatives")
    rows = usable(vectors.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("long").alias("label")), "id", "v", "label")
    rows = rows.where(F.forall("v", lambda x: F.abs(x) * F.sqrt(F.size("v")) < 2.0**31)).withColumn("v", F.col("v").cast("array<long>"))
    cells = Voronoi(work.write(rows, "usable"), work)
    grouped = cells.groups(cells.rows.where(F.col("id") % every == 0))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-(1 << 62)).alias("lo"), F.lit(1 << 62).alias("hi")))
    found = cells.first(grouped.withColumn("windows", all_of), True, positives, "positives")
    s = F.col("score")
    window = F.struct(F.col("id").alias("window"), F.expr(f"cast(-floor(-(cast(score as decimal(38,0)) * {low}) / 100) as long)").alias("lo"), F.expr(f"cast(floor(cast(score as decimal(38,0)) * {high} / 100) as long)").alias("hi"))
    windows = found.withColumn("w", window).where("w.lo <= w.hi").groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))  # positives at most
    asking = work.write(grouped.join(windows.withColumnRenamed("anchor", "id"), "id"), "asking")
    hard = cells.first(asking, False, negatives, "negatives")
    pairs = found.select("anchor", F.col("id").alias("positive"), s.alias("positive_score"))
    out = hard.select("anchor", F.col("window").alias("positive"), "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    return out.join(pairs, ["anchor", "positive"]).select("anchor", "positive", "rank", "negative", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one first, and components become floor(256 x)."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double")) * 256))
    out = mine(rows.select("vec_id", label.alias("label"), scaled.alias("embedding")))
    return out.select(*[F.col(c).alias(f"{c}_id") for c in ("anchor", "positive")], "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")


ORACLE = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_dot_product(a.v, b.v)::bigint score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int "rank", id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify "rank" <= 3
"""
