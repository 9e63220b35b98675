"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds canonical URLs (blocked) and rules ``host, path, verdict`` that
fit a host with all its subdomains where the path starts with the rule's. Every
URL is probed under all keys that could be listed: its canonical form, and each
domain suffix with each prefix of its path that has the length of a rule's path.

The filter is an array of 256-bit blocks, eight 32-bit words of which a key sets
one bit each. It is built by a map-side combined aggregate and goes to every task
as one array of words: its size is at most ``max_filter_mb`` whatever the list
holds, since a fuller filter only passes more false hits, which the exact join
removes. Keys are made and hashed by built-ins, the array is read by an Arrow
function over their hashes. Pages without a possible hit get their verdict in that
projection; only the others are stored, and joined exactly by the keys that the
filter passed. A key that very many pages have is broadcast there, never dealt.

Defined results: a null URL, or one without ``://``, has empty host and path and
fits nothing; the longest rule wins, of equal ones the one with the longer host,
of rules listed twice the blocking one; null and empty list entries are ignored;
an empty list allows everything; repeated pages give repeated rows. Columns of
the pages other than ``page_id, url`` are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import terms
from ..session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = range(8)
_BLOCK_BYTES = 32
_BITS_PER_KEY = 12


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and path without closing slashes; no scheme, query or fragment."""
    bare = F.regexp_replace(host(url), r"^www\.", "")
    return F.concat(bare, F.regexp_replace(path(url), "/+$", ""))


def listed_keys(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``_key, _rule, _host_len, _verdict`` of listed URLs and rules, each key once."""
    exact = urls.select(canonical(F.col("url")).alias("_url")).where(F.col("_url") != "").select(
        F.concat(F.lit("="), "_url").alias("_key"), F.lit(None).cast("string").alias("_rule"), F.lit(0).alias("_host_len"), F.lit("block").alias("_verdict")
    )
    fits = rules.where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.concat("host", "path").alias("_key"), F.concat("host", "path").alias("_rule"), F.length("host").alias("_host_len"), F.col("verdict").alias("_verdict")
    )
    # "block" is the larger of the two words
    return exact.unionByName(fits).groupBy("_key").agg(F.max("_rule").alias("_rule"), F.max("_host_len").alias("_host_len"), F.max("_verdict").alias("_verdict"))


def _hashes(key: Column) -> tuple[Column, Column]:
    """A key's block is that of the first; its bits are five bits of the second for each word."""
    return F.xxhash64(key), F.xxhash64(key, F.lit("bits"))


def build_filter(keys: DataFrame, max_filter_mb: int = 32) -> np.ndarray:
    """The words of all blocks, a row for each block; at most ``max_filter_mb`` (one block at least) come to the driver."""
    wanted = math.ceil(keys.count() * _BITS_PER_KEY / (8 * _BLOCK_BYTES))
    blocks = max(1, min(wanted, max_filter_mb * 1_000_000 // _BLOCK_BYTES))
    first, second = _hashes(F.col("_key"))
    marked = keys.select(F.pmod(first, F.lit(blocks)).alias("_block"), second.alias("_bits"))
    one = F.lit(1)
    bits = [F.call_function("shiftleft", one, F.shiftright("_bits", 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in _WORDS]
    table = marked.groupBy("_block").agg(*[F.bit_or(b).alias(f"_w{i}") for i, b in zip(_WORDS, bits)]).toArrow()
    words = np.zeros((blocks, len(_WORDS)), np.int32)
    words[table.column(0).to_numpy()] = np.stack([table.column(1 + i).to_numpy() for i in _WORDS], 1)
    return words


def possible(keys: Column, words: np.ndarray) -> Column:
    """Those of an array of keys that the filter passes. The array of words travels with the function."""

    @F.arrow_udf("array<int>")
    def passed(firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(firsts).to_numpy(zero_copy_only=False))))
        first, second = (x.flatten().to_numpy(zero_copy_only=False) for x in (firsts, seconds))
        block = words[first % len(words)]
        bits = np.left_shift(np.int32(1), (second[:, None] >> (5 * np.arange(len(_WORDS)))) & 31, dtype=np.int32, casting="unsafe")
        hit = ((block & bits) == bits).all(1)
        place = np.arange(len(hit)) - np.repeat(edges[:-1], np.diff(edges))
        kept = np.concatenate(([0], np.cumsum(hit)))[edges]
        return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(place[hit], pa.int32()))

    # named nondeterministic, so that it runs once a row and is not moved into filters and generators
    at = passed.asNondeterministic()(F.transform(keys, lambda k: _hashes(k)[0]), F.transform(keys, lambda k: _hashes(k)[1]))
    return F.transform(at, lambda i: F.get(keys, i))


def probes(rule_lengths: list[int]) -> Column:
    """All keys under which ``_host, _path, _canonical`` may be listed."""
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in rule_lengths]).cast("array<int>"), lambda n: n <= F.length("_path"))
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.substr(F.col("_path"), F.lit(1), n)))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "_canonical")), both))


def filter_urls(pages: DataFrame, urls: DataFrame, rules: DataFrame, max_filter_mb: int = 32) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page.

    ``rules`` give the verdict where one fits; else a listed URL is blocked and
    any other allowed. The distinct lengths of rule paths come to the driver;
    they are at most as many as the longest path has characters.
    """
    keys = listed_keys(urls, rules)
    lengths = [r[0] for r in rules.where(F.col("path").isNotNull()).select(F.length("path")).distinct().collect()]
    words = build_filter(keys, max_filter_mb)
    rows = pages.select(
        F.monotonically_increasing_id().alias("_row"), F.col("page_id"), host(F.col("url")).alias("_host"),
        path(F.col("url")).alias("_path"), canonical(F.col("url")).alias("_canonical"),
    )
    probed = rows.withColumn("_probes", probes(lengths))
    tested = probed.select("_row", "page_id", "_host", "_path", possible(F.col("_probes"), words).alias("_keys"))
    clear = tested.where(F.size("_keys") == 0).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"),
        F.lit("allow").alias("verdict"), F.lit(False).alias("listed"),
    )
    passed = materialize(tested.where(F.size("_keys") > 0), "url-hits")
    hits = passed.select("_row", "page_id", "_host", "_path", F.explode("_keys").alias("_key"))
    # a rule's key may fit a third of all pages: keys go by their number of hits, the frequent ones by broadcast
    often = keys.join(hits.groupBy("_key").agg(F.count(F.lit(1)).alias("_hits")), "_key")
    listed = terms.attach_by_frequency(hits, often, ["_key"], "_hits")
    found = listed.unionByName(passed.drop("_keys"), allowMissingColumns=True)  # a page may have false hits only
    best = F.max(F.when(F.col("_rule").isNotNull(), F.struct(F.length("_rule").alias("n"), F.col("_host_len").alias("h"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))))
    judged = found.groupBy("_row").agg(
        F.first("page_id").alias("page_id"), F.first("_host").alias("host"), F.first("_path").alias("path"), best.alias("_best"),
        F.coalesce(F.bool_or(F.col("_verdict").isNotNull() & F.col("_rule").isNull()), F.lit(False)).alias("listed"),
    )
    judged = judged.select(
        "page_id", "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed",
    )
    return clear.unionByName(judged)
