"""URL filters: a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.bloom import filled
from larder.llm.common import bounded_batches, read

#: Lists of up to so many entries are broadcast (a few MB); longer ones are joined by shuffle, in so many salted parts.
BROADCAST_LISTED, SALTS = 1 << 15, 32


def _hashes(keys: Iterable[str]) -> np.ndarray:
    """As Spark's xxhash64 of the text."""
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42) for k in keys], dtype=np.uint64)


def suffixes(host: str, counts: list[int]) -> list[str]:
    """The last labels of a host, for each of the (ascending) label counts that it reaches."""
    out, at, have = [], len(host), 0
    for n in counts:
        while have < n and at >= 0:
            at = host.rfind(".", 0, at)
            have += 1
        if have < n:
            break
        out.append(host[at + 1 :])
    return out


def prefixes(path: str, lengths: list[int]) -> list[str]:
    return [path[:n] for n in lengths if n <= len(path)]


def split_url(url: str) -> tuple[str, str]:
    """(host, path): both empty without ``://``; A-Z of the host lower-cased, nothing else changed."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:stop]


def judge_urls(pages: DataFrame, listed: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``listed``: (host, path, verdict) of canonical URL prefixes. An entry fits its host and all subdomains if the URL's
    path starts with its own; the longest host and path wins, between equal texts block does. URLs that no entry fits
    get ``default`` and a null rule.

    Each host is cut to the label counts that the list has, so a host of any length costs as many lookups as there are
    such counts. A blocked Bloom filter of the listed hosts and entries drops nearly all of these; where a host may be
    listed, its paths are looked up too. Possible hits go to an exact hash join with the list, which removes false
    positives. The filter is filled on the executors and broadcast; it never takes more than 32 MB (longer lists let
    more false hits through to the join, with the same results).

    Null url or url without ``://``: host and path empty, no rule. Rows that repeat an id are each returned; a null id
    is kept. Other columns are ignored. An empty list or table is fine.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    listed = listed.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null")
    # as many values as different label counts and path lengths exist
    counts = sorted(r[0] for r in listed.select(F.size(F.split("host", r"\.", -1))).distinct().collect())
    lengths = sorted(r[0] for r in listed.select(F.length("path")).distinct().collect())
    size = listed.count()
    key = F.concat("host", F.lit("\x00"), "path")
    bloom = spark.sparkContext.broadcast(filled(listed.select(F.explode(F.array(F.xxhash64("host"), F.xxhash64(key)))), 2 * size))

    def expand(stream):
        for batch in stream:
            ids, urls = batch.column(id_col), batch.column(url_col).to_pylist()
            split = [split_url(u or "") for u in urls]
            held = bloom.value.holds
            hosts = [(i, h) for i, (host, _) in enumerate(split) if host for h in suffixes(host, counts)]
            listed_hosts = [x for x, ok in zip(hosts, held(_hashes(h for _, h in hosts)), strict=True) if ok]
            tried = [(i, h + "\x00" + p) for i, h in listed_hosts for p in prefixes(split[i][1], lengths)]
            keys: list[list[str]] = [[] for _ in split]
            for (i, k), ok in zip(tried, held(_hashes(k for _, k in tried)), strict=True):
                if ok:
                    keys[i].append(k)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(keys, pa.list_(pa.string()))],
                [id_col, "host", "path", "keys"],
            )

    judged = pages.select(F.col(id_col).cast("long").alias(id_col), url_col).mapInArrow(expand, f"{id_col} long, host string, path string, keys array<string>")
    possible = judged.withColumn("row", F.monotonically_increasing_id()).select("row", id_col, "host", "path", F.explode_outer("keys").alias("key"))
    possible = possible.withColumn("key", F.coalesce("key", F.concat(F.lit("\x01"), F.col("row").cast("string"))))  # spread, never listed
    entries = listed.groupBy(key.alias("key")).agg(
        F.max(F.struct(F.concat("host", "path").alias("rule"), F.col("verdict"))).alias("entry")
    )
    if size <= BROADCAST_LISTED:
        joined = possible.join(F.broadcast(entries), "key", "left")
    else:  # a listed host may take a third of all rows: its rows go to SALTS tasks
        salted = possible.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
        copies = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, ["key", "salt"], "left")
    order = F.struct(F.length("entry.rule"), F.col("entry.rule"), F.col("entry.verdict"))
    won = joined.groupBy("row").agg(
        *[F.first(c).alias(c) for c in (id_col, "host", "path")], F.max_by("entry", F.when(F.col("entry").isNotNull(), order)).alias("won")
    )
    return won.select(id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


#: The query's rules: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark, sf_dir):
    listed = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), listed)


OP5_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM parts
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
