"""Mixing sources to target weights with equal blocks and highest quotients (Sainte-Laguë)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.llm.store import BLANKS, saved

#: Weights of the sources in code point order, repeating; budget of the mix and cap of a source as shares of sizes.
WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 16, 1 << 20, 42
SOURCE = ["no_source", "source_key"]


def n_words(text: Column) -> Column:
    """Number of runs of non-blank characters; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def apportion(shares: DataFrame, groups: list[str], weight: str, seats: Column, order: list[str]) -> DataFrame:
    """``quota``: the group's ``seats`` dealt to its rows by highest quotient weight / (2 j - 1).

    Exact without forming every quotient: with the divisor total / seats the rounded
    quotas miss the seats by at most half a row each, so the true quota of a row lies
    within ``reach`` of its fair share; only the quotients in that reach are ranked.
    Ties go to the row that is first in ``order``.  Rows without weight get none.
    """
    all_rows = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    first = all_rows.orderBy(F.desc("quotient"), *order, "seat")
    fair = (shares.withColumns({"seats": seats, "total_weight": F.sum(weight).over(all_rows),
                                "rows": F.count("*").over(all_rows)})
            .withColumn("fair", F.when(F.col("total_weight") > 0, F.col("seats") * F.col(weight) / F.col("total_weight"))
                        .otherwise(0.0))
            .withColumn("reach", F.when(F.col("seats") > 0, F.ceil(F.col("fair") * F.col("rows") / (2 * F.col("seats"))))
                        .otherwise(0) + 2)
            .withColumn("base", F.greatest(F.floor("fair") - F.col("reach"), F.lit(0)))
            .withColumn("open", F.col("seats") - F.sum("base").over(all_rows)))
    ranked = (fair.withColumn("seat", F.explode(F.sequence(F.col("base") + 1, F.ceil("fair") + F.col("reach"))))
              .withColumn("quotient", F.col(weight) / (2 * F.col("seat") - 1))
              .withColumn("won", (F.col("quotient") > 0) & (F.row_number().over(first) <= F.col("open"))))
    kept = [c for c in shares.columns]
    return (ranked.groupBy(*kept).agg((F.first("base") + F.sum(F.col("won").cast("long"))).alias("quota")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``target`` words of each source: shares of the budget by weight, at most ``cap`` times its size.

    ``sizes`` has one row per source.  Sorted by cap per weight the capped sources come
    first: a source is capped when what is left of the budget after all before it would
    give it more than its cap.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("no_source", "source_key")
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "no_source", "source_key")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    zero = F.lit(0.0)
    sorted_ = (sizes.withColumns({"weight": weight, "limit": F.col("source_size") * float(cap)})
               .withColumn("ratio", F.col("limit") / F.col("weight"))
               .withColumns({"budget": F.sum("source_size").over(everything) * float(budget),
                             "left": F.sum("source_size").over(everything) * float(budget) - F.coalesce(F.sum("limit").over(before), zero),
                             "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)})
               .withColumn("capped", F.col("left") * F.col("weight") >= F.col("limit") * F.col("weight_left")))
    capped = F.col("capped")
    level = ((F.col("budget") - F.coalesce(F.sum(F.when(capped, F.col("limit"))).over(everything), zero))
             / F.sum(F.when(~capped, F.col("weight"))).over(everything))
    return (sorted_.withColumn("target", F.when(capped, F.col("limit")).otherwise(level * F.col("weight")))
            .select(*SOURCE, "source_size", "target"))


def seeded(*parts: Column) -> Column:
    """60 bits of an MD5 digest, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, cap: int = CAP, block_words: int = BLOCK_WORDS,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Words that the mix takes of each document: ``doc_id, source, size, source_size, target, taken``.

    The budget is cut into blocks of ``block_words`` words.  Sources get blocks by
    highest quotients of their targets.  The documents of a source are dealt by digest
    to shards of about ``shard_words`` words, whose quotas come by highest quotients of
    their sizes.  A shard lines its documents up in digest order and takes whole rounds
    of all its blocks, then the rest of its quota as evenly spaced blocks from a seeded
    start, so that a block is taken at most ``cap`` times.

    Null text has size 0; a null source is one more source, after all others; null ids
    and repeated rows are documents like any other; an empty table gives no rows.  Only
    ``doc_id``, ``text`` and ``source`` are read, so further columns cannot clash.
    """
    sized = saved(docs.select("doc_id", n_words(F.col("text")).alias("size"), F.col("source").isNull().alias("no_source"),
                              F.coalesce("source", F.lit("")).alias("source_key")))
    sizes = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, budget, cap)
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    sources = saved(apportion(targets.withColumn("all_seats", F.round(total / block_words).cast("long")), [], "target",
                              F.col("all_seats"), SOURCE)
                    .select(*SOURCE, "source_size", "target", F.col("quota").alias("source_quota"),
                            F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("shards")))
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    dealt = (sized.join(sources, SOURCE)
             .withColumn("shard", F.pmod(seeded(F.lit(f"shard {seed}"), identity), F.col("shards")))
             .withColumn("place", seeded(F.lit(f"place {seed}"), identity)))
    shards = (dealt.groupBy(*SOURCE, "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")))
    quotas = (apportion(shards, SOURCE, "shard_size", F.col("source_quota"), ["shard"])
              .select(*SOURCE, "shard", "quota", F.col("shard_size")))
    inside = Window.partitionBy(*SOURCE, "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (dealt.withColumn("until", F.sum("size").over(inside)).withColumn("since", F.col("until") - F.col("size"))
              .join(quotas, [*SOURCE, "shard"])
              .withColumn("blocks", F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1)))
              .withColumn("seats", F.least(F.col("quota"), F.col("blocks") * cap))
              .withColumn("rounds", F.expr("seats div blocks")).withColumn("rest", F.expr("seats % blocks"))
              .withColumn("start", F.pmod(seeded(F.lit(f"start {seed}"), F.col("source_key"), F.col("shard").cast("string")), F.col("blocks"))))
    return placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + F.expr(_words_before("until", block_words)) - F.expr(_words_before("since", block_words)))
        .cast("long").alias("taken"))


def _words_before(at: str, block: int) -> str:
    """Words of the evenly spaced blocks before a position of the shard."""
    chosen = f"(({at} div {block}) * rest + start) div blocks"
    following = f"(({at} div {block} + 1) * rest + start) div blocks"
    return f"(({chosen} - start div blocks) * {block} + (({following}) - ({chosen})) * ({at} % {block}))"
