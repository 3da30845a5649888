"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, ascii_lower, let, ship, small, spread, table, words
from lexmill.llm.graph import components

#: Registers of a sketch are ROWS x BANDS. A pair at similarity s shares no band with probability
#: (1 - s^4)^28: 1e-9 at 0.85, 4e-7 at 0.8.
ROWS, BANDS = 4, 28
#: A register holds the count of leading zeros of its least hash in 6 bits and the 10 bits that follow.
MANTISSA = 10
#: An estimate may lie this many standard errors under the threshold and still be confirmed: 1e-9 of the pairs at the
#: threshold lie further, as many as share no band.
ERRORS = 6
#: Members of a group of candidates are compared block by block.
BLOCK = 384

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_hashes(text: Column, n: int) -> Column:
    """64-bit hashes of the distinct n-word shingles of a lower-cased (A-Z) text; fewer words: one of all of them."""

    def windows(w: Column) -> Column:
        at = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        full = F.transform(at, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
        short = F.array(F.xxhash64(w))
        return F.when(F.size(w) >= n, full).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(words(ascii_lower(text)), windows))


def registers(h: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: for each register the compressed least of a linear hash."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max)
    for i in range(0, len(h), 2048):
        x = h[i : i + 2048, None] * _MUL
        x += _ADD
        np.minimum(low, x.min(axis=0), out=low)
    return compress(low)


def compress(low: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of 64-bit values, as uint16: HyperMinHash's floating-point cut of a minimum."""
    top = (low >> np.uint64(11)).astype(np.float64)  # 53 bits: exact in a double
    frac, exp = np.frexp(top)  # top = frac * 2^exp, 0.5 <= frac < 1
    zeros = np.minimum(53 - exp, 63).astype(np.uint16)
    mantissa = np.where(top > 0, (frac - 0.5) * 2 ** (MANTISSA + 1), 0).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | mantissa


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m elements agree by accident.

    The minima have densities n e^-nx and m e^-mx; in an octave [2^-l-1, 2^-l) cells are 2^-(l+1+MANTISSA) wide."""
    n, m = np.asarray(n, float)[..., None], np.asarray(m, float)[..., None]
    hi = 2.0 ** -np.arange(0, 48)
    lo, width = hi / 2, hi / 2 / 2**MANTISSA
    return (n * m / (n + m) * width * (np.exp(-(n + m) * lo) - np.exp(-(n + m) * hi))).sum(-1)


def likely(same: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: int) -> np.ndarray:
    """Whether pairs that agree in this many registers can have the threshold's similarity (in per cent): sizes close
    enough, and the estimate, with accidental agreements taken out, within ERRORS of it."""
    c, j = chance(na, nb), threshold / 100
    estimate = (same / len(_MUL) - c) / (1 - c)
    return (estimate >= j - ERRORS * np.sqrt(j * (1 - j) / len(_MUL))) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb))


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ns, digests, sigs = [], [], []
        for arr in pdf["h"]:
            h = np.sort(np.asarray(arr, dtype=np.int64)).view(np.uint64)
            ns.append(len(h))
            digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
            sigs.append(registers(h).tobytes() if len(h) else None)
        yield pd.DataFrame({"id": pdf["id"], "mark": pdf["mark"], "n_shingles": ns, "digest": digests, "sig": sigs})


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n_shingles, digest of the full set, sketch), null digest and sketch for an empty set. mark tells
    the texts of one id apart."""
    h = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), shingle_hashes(F.col(text_col), n).alias("h"))
    return h.mapInPandas(_sketch, "id long, mark long, n_shingles long, digest binary, sig binary")


def _stacked(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), len(_MUL))


def _across(threshold: int):
    """Links between the members of two blocks of a group that join components which are still apart: likely pairs by
    their sketches, best first, and sure ones by their full sets."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").reset_index(drop=True)
        left, right = (np.nonzero((pdf["blk"] == pdf[x]).to_numpy())[0] for x in ("i", "j"))
        sig, n, comp, cls = _stacked(pdf["sig"]), pdf["n"].to_numpy(), pdf["comp"].to_numpy(), pdf["cls"].to_numpy()
        same = np.zeros((len(left), len(right)), np.uint8)
        for k in range(len(_MUL)):
            same += sig[left, k][:, None] == sig[right, k][None, :]
        x, y = np.nonzero((same > 0) & (comp[left][:, None] != comp[right][None, :]))
        same = same[x, y]
        x, y = left[x], right[y]
        ok = likely(same, n[x], n[y], threshold)
        order = np.argsort(-same[ok].astype(int), kind="stable")
        sets: dict[int, np.ndarray] = {}
        parent: dict[int, int] = {}
        out = []

        def root(v: int) -> int:
            while (up := parent.get(v, v)) != v:
                parent[v] = parent.get(up, up)
                v = up
            return v

        def full(v: int) -> frozenset:
            if v not in sets:
                sets[v] = frozenset(np.asarray(pdf.at[v, "h"]).tolist())
            return sets[v]

        for p, q in zip(x[ok][order].tolist(), y[ok][order].tolist(), strict=True):
            rp, rq = root(comp[p]), root(comp[q])
            if rp != rq:
                a, b = full(p), full(q)
                both = len(a & b)
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    parent[rp] = rq
                    out.append((cls[p], cls[q]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of classes that are linked: likely by their sketches, and sure by their full sets."""

    @F.pandas_udf("boolean")
    def may(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series(likely((_stacked(p) == _stacked(q)).sum(axis=1), n.to_numpy(), m.to_numpy(), threshold))

    pairs = work.write(pairs, f"{name}-pairs")
    for own, other in (("a", "b"), ("b", "a")):
        counts = work.write(pairs.groupBy(own).agg(F.count("*").alias("n")), f"{name}-{own}")
        rows = sets.select(F.col("cls").alias(own), F.struct("n", "sig", "h").alias(f"set_{own}")).join(counts, own)
        both = spread(pairs if own == "a" else both, rows, own, other, hot=256)
    p, q = F.col("set_a"), F.col("set_b")
    both = both.where(may(p["sig"], q["sig"], p["n"], q["n"])).withColumn("both", F.size(F.array_intersect(p["h"], q["h"])).cast("long"))
    linked = both.where(100 * F.col("both") >= threshold * (p["n"] + q["n"] - F.col("both")))
    return work.write(linked.select("a", "b"), name)


def _classes(docs: DataFrame, n: int, threshold: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and (digest, component_id, n) of the classes of equal sets, n being their rows."""
    sk = work.write(sketches(docs, n, "id", "text"), "sketches")
    named = sk.where("sig is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("rows"))
    classes = work.write(named.select(F.monotonically_increasing_id().alias("cls"), "digest", "rep.id", "rep.mark", "n", "sig", "rows"), "classes")

    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sig", 1 + 2 * ROWS * b, 2 * ROWS)) for b in range(BANDS)])
    keyed = classes.select("cls", F.explode(bands).alias("bucket"))
    shared = work.write(keyed.groupBy("bucket").agg(F.min("cls").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = work.write(spread(keyed, shared, "bucket", "cls"), "members")
    wanted = work.write(members.select("cls").distinct().join(classes.select("cls", "id", "mark", "n", "sig"), "cls"), "wanted")
    texts = docs.withColumn("mark", F.xxhash64("text")).join(small(wanted.select("id", "mark")), ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    sets = texts.select("id", "mark", shingle_hashes(F.col("text"), n).alias("h")).join(wanted, ["id", "mark"])
    sets = work.write(sets.select("cls", "n", "sig", "h"), "sets")

    # every member with its bucket's head; then, where buckets are not one component by that, all that are apart
    stars = members.where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    links = _confirmed(stars, sets, threshold, work, "stars")
    comps = work.write(components(links, work, "joined"), "comps")
    at = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "head", "bucket", F.coalesce("component", "cls").alias("comp"))
    at = work.write(at, "placed")
    apart = work.write(at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "n"), "apart")
    if not apart.isEmpty():
        open_ = work.write(spread(at, apart, "bucket", "cls").select("cls", "head", "comp").distinct(), "open")
        groups = work.write(components(open_.select(F.col("cls").alias("a"), F.col("head").alias("b")), work, "groups"), "groups")
        sizes = work.write(groups.groupBy("component").agg(F.count("*").alias("n")), "sizes").withColumn("size", F.col("n"))
        sized = spread(groups.withColumnRenamed("node", "cls"), sizes, "component", "cls").join(open_.select("cls", "comp").distinct(), "cls")
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        dealt = sized.withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select(F.col("component").alias("grp"), "cls", "comp", "blk", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
        found = work.write(dealt.join(sets, "cls").groupBy("grp", "i", "j").applyInPandas(_across(threshold), "a long, b long"), "across")
        comps = work.write(components(links.unionByName(found), work, "all"), "all-comps")

    placed = classes.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("digest", "id", "rows", F.coalesce("component", "cls").alias("comp"))
    least = work.write(placed.groupBy("comp").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
    return sk, work.write(spread(placed, least, "comp", "digest").select("digest", "component_id", "comp", F.col("rows").alias("n")), "placed-classes")


def _judged(docs: DataFrame, n: int, threshold: int, work: Workspace) -> DataFrame:
    """(id, mark, n_shingles, component_id, comp) of all rows of docs (id, text); comp numbers the components."""
    ship(docs.sparkSession)
    sk, classes = _classes(docs, n, threshold, work)
    named = sk.where("sig is not null and id is not null").select("id", "mark", "n_shingles", "digest")
    named = spread(named, classes, "digest", "id").select("id", "mark", "n_shingles", "component_id", "comp")
    alone = sk.where("sig is null or id is null").select("id", "mark", "n_shingles", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return named.unionByName(alone)


def near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Rows are linked if their sets of distinct n-word shingles have 100 * intersection >= threshold * union;
    component_id is the least id reachable, and kept marks its rows. Texts of 1 to n - 1 words are one shingle; null,
    empty and wordless texts have none and stand alone. Rows of one id are rows of their own, whatever their texts;
    ids are longs and a null id stands alone. An empty table gives an empty table. Other columns are not read.

    Equal sets fall to a class first (a partial aggregate), so a group of copies is one row from there on. Band keys
    of four registers give buckets. Each member of a bucket is compared with the bucket's head, by its sketch and then
    by its full set: that joins most copies. Buckets that still have several components give groups of candidates, which
    are split into blocks; each pair of blocks compares the sketches of members of different components, and full sets
    of likely pairs until their components are joined. No pairs are emitted but those that join something. Links are missed only where a pair at
    the threshold shares no band or its estimate lies ERRORS standard errors off (some 1e-9 each, 4e-7 at 80 %). Keys of
    many rows (copies, buckets, heads, components) are dealt over several tasks."""
    work = Workspace(docs.sparkSession, "minhash")
    out = _judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, threshold, work).drop("mark", "comp")
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group: one of the least id, and of several texts of it the one of least
    hash. Rows without words or id stand alone and stay."""
    work = Workspace(docs.sparkSession, "minhash-kept")
    rows = work.write(_judged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), n, threshold, work).where("comp is not null"), "rows")
    heads = work.write(rows.groupBy("comp").agg(F.min(F.struct("id", "mark")).alias("head"), F.count("*").alias("n")), "heads")
    rows = spread(rows, heads, "comp", "id").withColumn("stays", F.struct("id", "mark") == F.col("head"))
    gone = work.write(rows.where(~F.col("stays")).select("id", "mark").distinct(), "gone")
    twice = work.write(rows.where("stays").groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "twice")
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    left = marked.join(small(gone), ["id", "mark"], "left_anti")
    if not twice.isEmpty():  # equal rows of a kept id: one of them
        several = small(twice)
        left = left.join(several, ["id", "mark"], "left_anti").unionByName(left.join(several, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]))
    return left.select("row.*")


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, threshold=85)


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select distinct doc_id, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] g from (select doc_id, ws, unnest(range(1, len(ws)::bigint - 1)) i from w where len(ws) >= 3)
  union select doc_id, array_to_string(ws, ' ') from w where len(ws) between 1 and 2),
c as (select doc_id, count(*) n from s group by 1),
k as (select doc_id, n, md5(string_agg(g, chr(10) order by g)) h from s join c using (doc_id) group by 1, 2),
r as (select *, min(doc_id) over (partition by h, n) rep from k),
d as (select s.doc_id, g from s join r using (doc_id) where r.doc_id = r.rep),
i as (select a.doc_id x, b.doc_id y, count(*) m from d a join d b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from i join c p on x = p.doc_id join c q on y = q.doc_id where 100 * m >= 85 * (p.n + q.n - m)),
e as (select x, y from l union select y, x from l),
t(a, b) as (select rep, rep from r group by 1 union select t.a, e.y from t join e on t.b = e.x),
m as (select a, min(b) comp from t group by 1)
select w.doc_id, coalesce(r.n, 0)::bigint n_shingles, coalesce(m.comp, w.doc_id) component_id, w.doc_id = coalesce(m.comp, w.doc_id) kept
from w left join r using (doc_id) left join m on m.a = r.rep
"""
