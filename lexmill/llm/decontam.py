"""Benchmark decontamination: size-partitioned MinHash containment search, exact confirmation; DataFrame code only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, ascii_lower, let, small, table, words
from lexmill.llm.minhash import shingle_hashes


def shingle_texts(text: Column, n: int) -> Column:
    """The distinct n-word shingles of a lower-cased text, spelled out; of fewer words all as one."""

    def windows(w: Column) -> Column:
        at = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        full = F.transform(at, lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, n)]))
        return F.when(F.size(w) >= n, full).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(let(words(ascii_lower(text)), windows))


def size_class(q: Column) -> Column:
    """Items are partitioned by powers of two of their shingles."""
    return F.floor(F.log2(q)).cast("int")


#: Hashes of an item's sketch beyond those that no document can miss all of: a document must hold this many and one.
EXTRA = 3


def sketch(items: DataFrame, n: int, threshold: int) -> DataFrame:
    """(item, mark, part, q, need, least, h): each item's MinHash sketch, the shingles of least hash, sized by its partition.

    A document that holds need = ceil(threshold q / 100) of an item's q shingles misses q - need of them at most. The
    partition of sizes [2^p, 2^(p+1)) takes that number for its largest size and 1 + EXTRA more; of a sketch of k hashes
    such a document holds least = k - (q - need) at least, which is over 0 for all items of the partition."""
    hashes = F.array_sort(F.transform(shingle_hashes(F.col("text"), n), lambda h: F.struct(F.xxhash64(h).alias("m"), h.alias("h"))))
    sets = items.select("item", "mark", hashes.alias("hs")).withColumn("q", F.size("hs").cast("long")).where("q > 0")
    sets = sets.withColumn("part", size_class(F.col("q"))).withColumn("need", F.ceil(F.col("q") * threshold / 100).cast("long"))
    top = (F.pow(F.lit(2), F.col("part") + 1) - 1).cast("long")
    take = (top - F.ceil(top * threshold / 100) + 1 + EXTRA).cast("int")
    sets = sets.withColumn("k", F.least(F.col("q"), take.cast("long")))
    return sets.select("item", "mark", "part", "q", "need", (F.col("k") - F.col("q") + F.col("need")).alias("least"), F.explode(F.slice("hs", F.lit(1), take)["h"]).alias("h"))


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, item, n_item_shingles, n_shared, containment): documents that hold threshold per cent or more of an item's shingles.

    Shingles are distinct runs of n words of the lower-cased (A-Z) text; an item of fewer words is one shingle
    and found only in a text of the same words. Null, empty and wordless texts and items hold nothing. Rows with
    the same id are each compared by their own text and reported once for an item; so are items. Null ids are not
    searched. Empty tables give an empty result. Other columns are not read.

    Items are few and small next to documents; their sketches, counted first, go to all executors, or are joined
    by shuffle if they are many. A document's hashes that are in no sketch are dropped at once. Documents that hold as
    many of an item's sketch as its containment asks for, and are long enough, are candidates; their texts alone are
    read again, and shingles are compared as text."""
    work = Workspace(docs.sparkSession, "decontam")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("doc")).where("id is not null")
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark")).where("item is not null")
    sk = work.write(sketch(items, n, threshold).distinct(), "sketch")
    by_hash = sk.groupBy("h").agg(F.min("need").alias("shortest"))
    hashed = docs.select("id", "doc", shingle_hashes(F.col("text"), n).alias("hs"))
    met = hashed.select("id", "doc", F.size("hs").alias("n"), F.explode("hs").alias("h")).join(small(by_hash), "h").where("n >= shortest").select("id", "doc", "n", "h")
    met = work.write(met.distinct(), "met")
    held = met.join(small(sk.select("h", "item", "mark", "need", "least")), "h").where("n >= need")
    held = held.groupBy("id", "doc", "item", "mark").agg(F.count("*").alias("held"), F.first("least").alias("least")).where("held >= least")
    cands = work.write(held.select("id", "doc", "item", "mark"), "candidates")
    wanted = small(cands.select("id", "doc").distinct())
    texts = docs.join(wanted, ["id", "doc"], "left_semi").select("id", "doc", shingle_texts(F.col("text"), n).alias("shingles"))
    sets = items.select("item", "mark", shingle_texts(F.col("text"), n).alias("own"))
    pairs = texts.join(small(cands), ["id", "doc"]).join(small(sets, 20_000), ["item", "mark"])
    pairs = pairs.withColumns({"n_item_shingles": F.size("own").cast("long"), "n_shared": F.size(F.array_intersect("own", "shingles")).cast("long")})
    hit = pairs.where(100 * F.col("n_shared") >= threshold * F.col("n_item_shingles")).where("n_item_shingles > 0")
    best = hit.groupBy("id", "item").agg(F.max(F.struct(F.round(F.col("n_shared") / F.col("n_item_shingles"), 6).alias("containment"), "n_item_shingles", "n_shared")).alias("b"))
    out = best.select("id", "item", "b.n_item_shingles", "b.n_shared", "b.containment")
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose own text holds no item, whatever their ids."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*names).alias("row"), F.md5(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    hit = contaminated(keyed, texts, n, threshold, "text_key", "item", "text").select("text_key").distinct()
    hit = Workspace(docs.sparkSession, "decontam-hit").write(hit, "hit")
    return keyed.join(small(hit), "text_key", "left_anti").select("row.*")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with w as (
  select 'd' k, doc_id id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
  union all
  select 'i', item_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
s as (
  select distinct k, id, array_to_string(ws[i:i+4], ' ') g from (select k, id, ws, unnest(range(1, len(ws)::bigint - 3)) i from w where len(ws) >= 5)
  union select k, id, array_to_string(ws, ' ') from w where len(ws) between 1 and 4),
q as (select id, count(*) q from s where k = 'i' group by 1),
m as (select d.id doc_id, i.id item_id, count(*) n from s d join s i on d.k = 'd' and i.k = 'i' and d.g = i.g group by 1, 2)
select doc_id, item_id, q n_item_shingles, n n_shared, round(n / q::double, 6) containment from m join q on q.id = item_id where 100 * n >= 80 * q
"""
