"""URL filters: host and path rules, then a blocked Bloom filter before an exact join with listed URLs."""

from __future__ import annotations

import pkgutil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import Workspace, ascii_lower, meet, ship, table

#: (host and path, verdict) of production.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Listed sites of production, as canonical URLs: a host and "/" lists the host and its subdomains.
LISTED = tuple(pkgutil.get_data(__package__, "blocked_sites.csv").decode().split()[1:])
#: Session setting that names a table of listed URLs.
LISTED_TABLE = "lexmill.urls.listed"
#: Bits a key, and bits that each key sets in its block of eight words of 64.
BITS_PER_KEY, PROBES = 16, 4
#: Blocks of the filter at most: 32 MB that every executor gets. A longer list fills them more and lets more URLs
#: through to the exact join, which decides.
MOST_BLOCKS = 1 << 19


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def canonical_keys(host: Column, path: Column) -> Column:
    """Keys under which a URL can be listed: its own host and path, and host/ of its host and all domains above."""
    sites = F.transform(suffixes(host), lambda h: F.concat(h, F.lit("/")))
    own = F.concat(host, F.when(path == "", F.lit("/")).otherwise(path))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(own), sites)))


def canonical(url: Column) -> Column:
    """A listed URL in canonical form: scheme, query and fragment dropped, host lower-cased, / for an empty path."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("x://"), url))
    path = path_of(full)
    return F.concat(host_of(full), F.when(path == "", F.lit("/")).otherwise(path))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _places(key: Column) -> Column:
    """The second hash of a key, of which each nine bits name a bit of its block."""
    return F.xxhash64(key, F.lit(1))


def bloom_filter(listed: DataFrame, blocks: int) -> np.ndarray:
    """The blocked Bloom filter of the column key, as words by block: bits are set by partial aggregates."""
    h = _places(F.col("key"))
    bits = [F.shiftrightunsigned(h, 9 * p).bitwiseAND(F.lit(511)) for p in range(PROBES)]
    mask = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
    found = listed.select(_block(F.col("key"), blocks).alias("block"), F.explode(F.array(*[F.struct(F.shiftright(b, 6).cast("int").alias("w"), mask(b).alias("m")) for b in bits])).alias("b"))
    rows = found.groupBy("block", "b.w").agg(F.bit_or("b.m").alias("m")).toPandas()  # MOST_BLOCKS * 8 rows at most
    out = np.zeros((blocks, 8), np.uint64)
    out[rows["block"].to_numpy(), rows["w"].to_numpy()] = rows["m"].to_numpy(np.int64).view(np.uint64)
    return out


def might_hold(bloom: np.ndarray, block: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the keys: all their bits are set."""
    h, hit = places.view(np.uint64), np.ones(len(block), bool)
    for p in range(PROBES):
        bit = h >> np.uint64(9 * p) & np.uint64(511)
        hit &= bloom[block, (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
    return hit


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, listed), one row for each row of pages.

    rules: rule (host, then path from the first /), verdict. A rule fits its host and all subdomains if the path
    starts with the rule's; the longest wins, ties by text. listed: url. Without a rule, a URL is blocked if it or
    its site is listed. Null URLs and such without :// have empty host and path, no rule and the default verdict.
    Repeated rows stay, other columns are not read, empty tables of any of the three are fine.

    Each place (host and path) is judged once: its few keys are looked up in the filter, a bit set of bounded size that
    every executor holds. Keys whose bits are set go on to a hash join with the listed URLs by text, which removes
    false positives. Rules, listed URLs and verdicts are broadcast only if counted and measured as small; domains, keys and
    places of many rows are otherwise dealt over tasks, and rows without a host take part in no join."""
    ship(pages.sparkSession)
    work = Workspace(pages.sparkSession, "urls")
    parsed = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    sites = work.write(parsed.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")), "sites")

    rules = rules.select(F.col("rule"), F.col("verdict").alias("said"), F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start"))
    under = sites.select("host", "path", F.explode(suffixes(F.col("host"))).alias("suffix"))
    fits = meet(under, work.write(rules, "rules"), "suffix", "path").where("startswith(path, start)")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "said")).alias("r"))

    keys = work.write(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct(), "listed")
    blocks = min(MOST_BLOCKS, keys.count() * BITS_PER_KEY // 512 + 1)
    bloom = pages.sparkSession.sparkContext.broadcast(bloom_filter(keys, blocks))

    @F.pandas_udf("boolean")
    def maybe_listed(block: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series(might_hold(bloom.value, block.to_numpy(), places.to_numpy()))

    probes = sites.select("host", "path", F.explode(canonical_keys(F.col("host"), F.col("path"))).alias("key"))
    maybe = probes.where(maybe_listed(_block(F.col("key"), blocks), _places(F.col("key"))))
    sure = meet(maybe, keys, "key", "path", "left_semi").select("host", "path").distinct().withColumn("listed", F.lit(True))

    judged = work.write(sites.join(best, ["host", "path"], "left").join(sure, ["host", "path"], "left").select(
        "host", "path", "n", F.col("r.rule").alias("rule"), F.col("r.said").alias("said"), F.coalesce("listed", F.lit(False)).alias("listed")), "judged")
    named = parsed.where("host <> ''")
    out = meet(named, judged, ["host", "path"], "id", "inner", 100_000, 16 << 20)
    bare = parsed.where("host = ''").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said"), F.lit(False).alias("listed"))
    out = out.select("id", "host", "path", "rule", "said", "listed").unionByName(bare)
    verdict = F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit(default)))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "listed")


def production_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, verdict string")


def production_list(spark) -> DataFrame:
    return spark.createDataFrame([(u,) for u in LISTED], T.StructType([T.StructField("url", T.StringType())]))


def listed_table(spark) -> DataFrame:
    """url: the Parquet table of any size that lexmill.urls.listed names, or the package's six sites."""
    path = spark.conf.get(LISTED_TABLE, None)
    return spark.read.parquet(path).select("url") if path else production_list(spark)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), production_rules(spark), production_list(spark))


def op6_url_filter_table(spark, sf_dir: str) -> DataFrame:
    """The same with the list read as a table."""
    return judge(table(spark, sf_dir, "pages"), production_rules(spark), listed_table(spark))


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
with p as (select page_id, {_HOST} host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path from pages),
r(rule, said) as (values {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
q as (select rule, said, split_part(rule, '/', 1) h, substr(rule, instr(rule, '/')) s from r),
b as (select host, path, max_by(rule, length(rule)) rule, max_by(said, length(rule)) said from (select distinct host, path from p) p
      join q on (p.host = h or ends_with(p.host, '.' || h)) and starts_with(p.path, s) group by 1, 2),
l(u) as (values {", ".join(f"('{u[:-1]}')" for u in LISTED)}),
x as (select page_id, p.host, p.path, rule, said, exists(select 1 from l where p.host = u or ends_with(p.host, '.' || u)) listed from p left join b on p.host = b.host and p.path = b.path)
select page_id, host, path, rule, coalesce(said, case when listed then 'block' else 'allow' end) verdict, listed from x
"""
