"""URL rules and block lists held in a cascade of Bloom filters: exact answers without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.llm.store import ascii_lower, saved

#: Rules as (verdict, host and path); a rule fits its host, all subdomains and all paths that start with its path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hash functions and bits per key of the filters after the first; largest filter in bytes, as it goes to every task.
HASHES, BITS_PER_KEY, MAX_FILTER_BYTES = 3, 6, 64 << 20


@dataclass(frozen=True)
class Level:
    bits: DataFrame      # one row: array of 64-bit words
    words: int
    seed: int

    def might_hold(self, key: Column) -> Column:
        bits, sure = self.bits.scalar(), F.lit(True)
        for at in _places(key, self.words, self.seed):
            word = F.get(bits, F.shiftright(at, 6).cast("int"))
            sure = sure & (F.call_function("shiftrightunsigned", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return sure


def _places(key: Column, words: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * HASHES + k)), F.lit(words * 64)) for k in range(HASHES)]


def _level(keys: DataFrame, n: int, bits_per_key: float, seed: int) -> Level:
    words = max(1, math.ceil(n * bits_per_key / 64))
    if words * 8 > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {words * 8} bytes for {n} keys is above MAX_FILTER_BYTES; split the list")
    places = keys.select(F.explode(F.array(*_places(F.col("key"), words, seed))).alias("at"))
    filled = (places.groupBy(F.shiftright("at", 6).alias("word"))
              .agg(F.bit_or(F.expr("shiftleft(1L, int(pmod(at, 64)))")).alias("bits")))
    every = keys.sparkSession.range(words).join(filled, F.col("id") == F.col("word"), "left")
    bits = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("row"))
    return Level(saved(bits.select(F.col("row.bits").alias("bits"))), words, seed)


class Cascade:
    """Set of listed keys, exact for every key of a universe.

    Level 1 holds the listed keys.  Level 2 holds the keys of the universe that level 1
    lets through by mistake, level 3 the listed keys that level 2 lets through, and so
    on until nothing is let through by mistake.  A key is listed if the first level that
    does not know it is an even one.  The first level is sized so that about as many
    keys pass by mistake as are listed; every level is then of the order of the list,
    whatever the size of the universe.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        """Both have a column ``key``; repeats and nulls do not matter."""
        inside = saved(listed.select("key").where("key IS NOT NULL").distinct())
        outside = universe.select("key").where("key IS NOT NULL")
        n, others = inside.count(), outside.count()
        self.levels: list[Level] = []
        per_key = max(BITS_PER_KEY, 1.44 * math.log2(max(2.0, others / max(n, 1))) + 2)
        held, rest, first = inside, outside, True
        while n:
            level = _level(held, n, per_key, len(self.levels) + 1)
            self.levels.append(level)
            passed = rest.where(level.might_hold(F.col("key")))
            if first:      # keys of the list itself are no mistakes
                passed = passed.distinct().join(inside, "key", "left_anti")
            passed = saved(passed)
            held, rest, n, per_key, first = passed, held, passed.count(), BITS_PER_KEY, False

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed; false for null."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            answer = F.when(~self.levels[number - 1].might_hold(key), F.lit(number % 2 == 0)).otherwise(answer)
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path``; both empty for null and for urls without ``://``."""
    start = F.instr("url", "://")
    rest = F.when(start > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    cut = pages.withColumn("rest of url", F.coalesce(rest, F.lit("")))
    cut = cut.withColumn("host", F.regexp_extract("rest of url", "^[^/?#]*", 0))
    cut = cut.withColumn("path", F.regexp_extract(F.expr("substr(`rest of url`, length(host) + 1)"), "^[^?#]*", 0))
    return cut.withColumn("host", ascii_lower(F.col("host"))).drop("rest of url")


def _shape(rule: str) -> tuple[int, int]:
    host = rule.split("/", 1)[0]
    return len(host), len(rule) - len(host)


def candidates(rules: tuple) -> list[Column]:
    """For each pair of lengths among the rules, longest first: the url's host ending and path start of them.

    Null where the url has no such ending at a label or is too short, so there are as
    many candidates as shapes of rules, however long the url.
    """
    shapes = sorted({_shape(rule) for _, rule in rules}, key=lambda s: (-(s[0] + s[1]), -s[0]))
    out = []
    for h, p in shapes:
        at_label = (F.length("host") == h) | F.expr(f"substr(host, length(host) - {h}, 1) = '.'")
        fits = (F.length("host") >= h) & at_label & (F.length("path") >= p)
        out.append(F.when(fits, F.concat(F.expr(f"substr(host, length(host) - {h} + 1)"), F.expr(f"substr(path, 1, {p})"))))
    return out


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    Longest fitting rule first (of equally long ones that with the longer host).  A page
    that no rule fits is blocked if its host is listed.  Listed are the hosts of which
    block rules catch more than half of the pages.  Rules, blocking rules and listed
    hosts are three cascades whose universes are all candidate keys, all rules and all
    hosts of the table, so every answer is exact.

    Null urls have empty host and path, fit no rule and are judged by the empty host;
    repeated rows are judged alike; columns other than ``page_id`` and ``url`` are ignored.
    """
    spark = pages.sparkSession
    split = with_host_and_path(pages.select("page_id", "url"))
    possible = candidates(rules)
    listed = spark.createDataFrame([(rule, verdict) for verdict, rule in rules], "key string, verdict string")
    universe = split.select(F.explode(F.array(*possible)).alias("key")) if possible else split.select(F.lit(None).cast("string").alias("key"))
    of_rules = Cascade(listed, universe)
    blocking = Cascade(listed.where("verdict = 'block'"), listed)
    rule = F.coalesce(*[F.when(of_rules.holds(c), c) for c in possible]) if possible else F.lit(None).cast("string")
    ruled = saved(split.select("page_id", "host", "path", rule.alias("rule"))
                  .withColumn("blocked", F.when(F.col("rule").isNotNull(), blocking.holds(F.col("rule")))))
    hosts = ruled.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("blocked").alias("caught"))
    bad = Cascade(hosts.where("2 * caught > pages").select(F.col("host").alias("key")), hosts.select(F.col("host").alias("key")))
    block = F.coalesce("blocked", bad.holds(F.col("host")))
    return ruled.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise("allow").alias("verdict"))
