"""URL rules behind a blocked Bloom filter (operator 7), DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, UPPER_AZ, read

#: Blocks of the filter, each of four 64-bit words; a key sets one bit in every word of one block. 32 kB, whatever the list.
BLOCKS, WORDS = 1024, 4
#: The rules of the query (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    tail = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER_AZ, LOWER_AZ), tail


def _block(key: Column) -> Column:
    return F.pmod(key, F.lit(BLOCKS)).cast("int")


def _bits(key: Column, word: int) -> Column:
    # bits 10 and up of the hash choose one bit in each word
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(key, 10 + 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom(keys: DataFrame, key: str) -> DataFrame:
    """One row with ``filter``: BLOCKS arrays of WORDS longs, in which the hashes in ``key`` are entered."""
    full = keys.sparkSession.range(BLOCKS).select(F.col("id").cast("int").alias("block"))
    sets = keys.groupBy(_block(F.col(key)).alias("block")).agg(*[F.bit_or(_bits(F.col(key), w)).alias(f"w{w}") for w in range(WORDS)])
    cells = full.join(sets, "block", "left").select("block", F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)]).alias("cell"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "cell"))), lambda x: x["cell"]).alias("filter"))


def _maybe(filter_: Column, key: Column) -> Column:
    cell = F.element_at(filter_, _block(key) + 1)
    hits = [cell[w].bitwiseAND(_bits(key, w)) != 0 for w in range(WORDS)]
    return hits[0] & hits[1] & hits[2] & hits[3]


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``verdict, host, path``; a rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest rule (host and path, then host) wins; without one ``default`` is the verdict. Candidates of a
    url are its host suffixes with the path cut to each length that a listed path has. The filter drops nearly all of
    them inside the row; what passes is joined on (host, path), which removes the false positives.

    Null urls and urls without ``://`` have empty host and path. Rows that repeat an id and a url come back as often.
    A rule listed with two verdicts counts as ``block``. Without rules every verdict is ``default``.
    """
    listed = rules.groupBy(F.translate("host", UPPER_AZ, LOWER_AZ).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    listed = listed.where("r_host is not null and r_path is not null")
    cut = rules.sparkSession.range(1)
    lengths = listed.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"))
    known = bloom(listed.select(F.xxhash64("r_host", "r_path").alias("key")), "key")
    # one row: a fixed filter and the lengths of paths, of which there are fewer than a url has characters
    one = F.broadcast(cut.crossJoin(lengths).crossJoin(known).drop("id"))
    host, path = host_path(F.col(url_col))
    rows = pages.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("copies")).select("*", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = F.filter("lengths", lambda n: n <= F.length("path"))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(cuts, lambda n: F.struct(h.alias("h"), F.substring("path", 1, n).alias("p")))))
    probed = rows.crossJoin(one).withColumn("hits", F.filter(pairs, lambda x: _maybe(F.col("filter"), F.xxhash64(x["h"], x["p"])))).drop("filter", "lengths")
    seen = probed.select("page_id", "url", "host", "path", "copies", F.explode_outer("hits").alias("hit"))
    on = (F.col("hit.h") == F.col("r_host")) & (F.col("hit.p") == F.col("r_path"))
    found = F.when(
        F.col("r_host").isNotNull(),
        F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.concat("r_host", "r_path").alias("rule"), "r_verdict"),
    )
    best = seen.join(listed, on, "left").groupBy("page_id", "url", "host", "path", "copies").agg(F.max(found).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_one")
    ).drop("_one")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = """
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.k, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.verdict, length(r.host) + length(r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.k)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (k)
"""
