"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

1. Targets. Sources share ``SHARE`` times all words by weight; a source stops at ``MOST`` times its own size and the
   excess is shared again among the rest until none is above.
2. Blocks. All targets together make a number of blocks of equal numbers of words. Sources win them one by one, the
   next going to the highest quotient target / (2 * won + 1).
3. Shards. A source's documents are dealt over shards of about ``SHARD_WORDS`` words; its blocks go to its shards the
   same way, by the shards' sizes. So every shard gets a whole number of blocks.
4. Selection. A shard lays its documents end to end in seeded order and cuts them into blocks. A quota of q out of n
   blocks takes every block q // n times and, of the rest, an evenly spaced choice from a seeded start once more. A
   document is taken as far as its words lie in chosen blocks, so twice its size at most.

The number of blocks that win seats near the line is bounded: a party's seats lie within (n * share + 1) / 2 of its
exact quota, n being the number of parties, so all but about four seats for each party are given without ranking.

Nothing is enumerated by block, so blocks can be small: ``BLOCK`` words, or a thousandth of the smallest target.

Defined results: the null source is a source of its own, last in order; null and empty texts have size 0 and are taken
0 times; a source without words has target 0; rows with equal ids are documents of their own; documents of one shard
with equal order keys follow by id, then by size; the empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import WORD
from corvane.plans.runtime import cut_lineage

# Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1_000_000
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


# ---- targets -------------------------------------------------------------------------------------------------

def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, documents, weight, target) of ``sizes`` (source, size).

    The weights repeat over the sources in code point order, null last. One row per source from here on.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = (F.row_number().over(by_name) - 1) % len(weights)
    rows = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
            .withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), at)))
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    goal, limit, rate = share * total, F.col("source_size") * F.lit(float(most)), 0.0
    held = F.lit(False)
    capped = -1
    while True:  # each round caps at least one more source or ends
        one = rows.agg(F.count_if(held).alias("n"), F.sum(F.when(held, limit)).alias("full"),
                       F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        if one.n == capped or not one.free:
            break
        capped, rate = one.n, (goal - (one.full or 0.0)) / one.free
        held = limit <= F.lit(rate) * F.col("weight")
    return rows.withColumn("target", F.least(limit, F.lit(rate) * F.col("weight")))


# ---- apportionment -------------------------------------------------------------------------------------------

def apportion(parties: DataFrame, group: Sequence[str], weight: str, seats: str, order: Sequence[Column],
              out: str) -> DataFrame:
    """``parties`` with the seats each wins of its group's ``seats`` by highest quotients weight / (2 * won + 1).

    Of equal quotients the one first in ``order`` wins. Parties without weight win none.
    """
    everyone = Window.partitionBy(*group)
    share = F.col(weight) / F.col("__sum")
    reach = F.col("__n") * F.col("__share") / 2 + 0.5
    placed = (parties.withColumn("__sum", F.sum(weight).over(everyone)).withColumn("__n", F.count("*").over(everyone))
              .withColumn("__share", F.when(F.col("__sum") > 0, share).otherwise(0.0))
              .withColumn("__quota", F.col("__share") * F.col(seats))
              .withColumn("__sure", F.greatest(F.lit(0), F.floor(F.col("__quota") - reach)).cast("bigint"))
              .withColumn("__last", F.ceil(F.col("__quota") + reach).cast("bigint"))
              .withColumn("__open", F.col(seats) - F.sum("__sure").over(everyone)))
    bids = (placed.withColumn("__won", F.explode(F.sequence("__sure", "__last")))
            .withColumn("__quotient", F.col(weight) / (2 * F.col("__won") + 1)))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("__quotient"), *order))
    wins = (F.col("__quotient") > 0) & (F.col("__rank") <= F.col("__open"))
    return (bids.withColumn("__rank", rank).groupBy(*parties.columns, "__sure")
            .agg(F.count_if(wins).alias("__more"))
            .withColumn(out, F.col("__sure") + F.col("__more")).select(*parties.columns, out))


# ---- selection -----------------------------------------------------------------------------------------------

def taken_before(position: Column, block: Column) -> Column:
    """Words that a shard's chosen blocks hold before ``position``, repeats counted."""
    extra = F.col("quota") - F.col("times") * F.col("blocks")
    done = F.floor(position / block)

    def chosen(i: Column) -> Column:  # of the first i blocks, those taken once more
        return F.floor((i * extra + F.col("start_at")) / F.col("blocks"))

    inside = (position - done * block) * (chosen(done + 1) - chosen(done))
    return F.col("times") * position + block * chosen(done) + inside


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED,
        block_words: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: id, source, size, source_size, target (its source's), shard, taken."""
    sizes = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                                    word_count(F.col(text_col)).alias("size"))
                        .withColumn("turn", F.xxhash64(F.lit(seed), "id", "size")))
    sources = cut_lineage(targets(sizes, weights, share, most))
    facts = sources.agg(F.sum("target").alias("all"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = max(1, min(block_words, int((facts["least"] or 0) // 1000)))
    named = [F.col("source").isNull(), F.col("source").cast("binary")]
    won = apportion(sources.withColumn("all_blocks", F.lit(round((facts["all"] or 0) / block)).cast("bigint"))
                    .withColumn("one", F.lit(1)), ["one"], "target", "all_blocks", named, "source_blocks")
    won = won.select("source", "source_size", "target", "source_blocks",
                     F.ceil(F.col("source_size") / shard_words).cast("bigint").alias("shards"))
    same = sizes["source"].eqNullSafe(won["source"])
    dealt = (sizes.join(won, same).drop(won["source"])
             .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "size"), F.greatest("shards", F.lit(1)))))
    # a null source joins the later steps under its own mark
    dealt = cut_lineage(dealt.withColumn("mark", F.xxhash64(F.col("source").isNull(), "source")))
    shards = dealt.groupBy("mark", "source", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    quotas = apportion(shards, ["mark", "source"], "shard_size", "source_blocks", [F.col("shard")], "quota")
    quotas = (quotas.withColumn("blocks", F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("bigint"))
              .withColumn("quota", F.least(F.col("quota"), most * F.col("blocks")))
              .withColumn("times", F.floor(F.col("quota") / F.col("blocks")))
              .withColumn("start_at", F.pmod(F.xxhash64(F.lit(seed + 2), "mark", "shard"), F.col("blocks")))
              .select("mark", "shard", "blocks", "quota", "times", "start_at"))
    laid = Window.partitionBy("mark", "shard").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    width = F.lit(block).cast("bigint")
    end = F.col("end")
    return (dealt.withColumn("end", F.sum("size").over(laid)).join(quotas, ["mark", "shard"])
            .withColumn("taken", (taken_before(end, width) - taken_before(end - F.col("size"), width)).cast("bigint"))
            .select("id", "source", "size", "source_size", "target", "shard", "taken"))
