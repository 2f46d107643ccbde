"""Distributions, averages over time, top lists, co-authorship."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.numeric import non_negative_long
from corvane.operators.records import exploded_categories, frequency, top_values
from corvane.plans.ranking import first_rows, global_rank
from corvane.plans.runtime import cut_lineage
from corvane.plans.skew import hot_key_join
from corvane.sources.scan import hash_sample

PAIR_BLOCK = 256
TASK_PAIRS = 1 << 19  # pairs that a task makes and counts


def size_distribution(df: DataFrame, size: Column, name: str = "size", cap: int | None = None) -> DataFrame:
    """How many rows have each size, optionally only sizes 0..cap."""
    sized = df.select(size.cast("bigint").alias(name))
    if cap is not None:
        sized = sized.where(F.col(name).between(0, cap))
    return frequency(sized, name)


def size_summary(df: DataFrame, size: Column) -> DataFrame:
    """Mean, median, min and max. The median reads the small table of sizes, weighted by their counts."""
    counts = size_distribution(df, size).where(F.col("size").isNotNull())
    return counts.agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
                      F.percentile("size", 0.5, F.col("n")).alias("median"),
                      F.min("size").alias("min"), F.max("size").alias("max"))


def mean_per_year(df: DataFrame, metric: Column, year: str = "year", name: str = "mean_value") -> DataFrame:
    return (df.where(F.col(year).isNotNull() & metric.isNotNull())
            .groupBy(year).agg(F.avg(metric).alias(name)))


def means_per_year(df: DataFrame, metrics: dict[str, Column], year: str = "year") -> DataFrame:
    """Several means in one pass; a year without any value of a metric has null there."""
    return df.where(F.col(year).isNotNull()).groupBy(year).agg(*[F.avg(m).alias(name) for name, m in metrics.items()])


def top_over_time(df: DataFrame, entity: str, k: int, year: str = "year") -> DataFrame:
    """Yearly counts of the k most frequent entities; an entity is ranked over all rows, dated or not."""
    top = top_values(df, entity, k).select(entity)
    return (df.where(F.col(year).isNotNull()).join(top, entity, "left_semi")
            .groupBy(entity, year).agg(F.count("*").alias("n")))


def coverage(df: DataFrame, column: str, ks: Sequence[int]) -> DataFrame:
    """Share of rows covered by the k most frequent values, for each k."""
    counts = frequency(df, column)
    total = counts.agg(F.sum("n")).scalar()
    curve = cumulative_coverage(counts, column, max(ks), total)
    labels = counts.agg(F.count("*")).scalar()
    reached = curve.where(F.col("k").isin(*[int(k) for k in ks]) | (F.col("k") == labels))
    asked = F.explode(F.array(*[F.lit(int(k)).cast("bigint") for k in ks]))
    # one row per curve point, asked for by every k that lands on it (k beyond the last label lands on the last)
    return (reached.select("k", "covered", "coverage", asked.alias("top_k"))
            .where(F.least(F.col("top_k"), labels) == F.col("k"))
            .select("top_k", "covered", "coverage"))


def cumulative_coverage(counts: DataFrame, column: str, k_max: int, total: Column) -> DataFrame:
    """Rank, count and cumulative share of the k_max most frequent values. The window sees k_max rows only."""
    head = counts.orderBy(F.desc("n"), column).limit(k_max)
    order = Window.orderBy(F.desc("n"), column)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (head.withColumn("k", F.row_number().over(order).cast("bigint"))
            .withColumn("covered", F.sum("n").over(upto))
            .withColumn("coverage", F.col("covered") / total))


def long_tail(df: DataFrame, column: str) -> DataFrame:
    """Rank of every value by frequency: range-sorted over the cluster, not in one window."""
    return global_rank(frequency(df, column), [F.desc("n"), F.col(column)], "rank")


# ---- pairs ---------------------------------------------------------------------------------------------------

def member_pairs(df: DataFrame, group: str, member: str, min_size: int = 2,
                 max_size: int | None = None) -> DataFrame:
    """(a1, a2) with a1 < a2 for every two distinct members that share a group, once per group.

    Members of a large group are hashed into blocks of about PAIR_BLOCK, and each pair of blocks is a join key of
    its own, so the pairs of one huge group are spread over many tasks and no list is built. The number of tasks follows
    from the number of pairs, as it is these that a task holds, not the rows it reads.
    """
    rows = cut_lineage(df.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct())
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_size))
    if max_size is not None:
        sizes = sizes.where(F.col("n") <= max_size)
    sizes = cut_lineage(sizes)
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    tasks = max(1, math.ceil(pairs / TASK_PAIRS))
    blocks = F.ceil(F.col("n") / PAIR_BLOCK)
    blocked = (hot_key_join(rows, sizes, "g", "n", rows.agg(F.count("*")).scalar())
               .withColumn("blocks", blocks)
               .withColumn("b", F.pmod(F.xxhash64("m"), F.col("blocks")))
               .withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
               .select("g", "m", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
               .repartition(tasks, "g", "lo", "hi"))
    left = blocked.select("g", "lo", "hi", F.col("m").alias("a1"), F.col("b").alias("b1"))
    right = blocked.select("g", "lo", "hi", F.col("m").alias("a2"), F.col("b").alias("b2"))
    crossing = (F.col("lo") == F.col("hi")) | (F.col("b1") != F.col("b2"))
    return left.join(right, ["g", "lo", "hi"]).where((F.col("a1") < F.col("a2")) & crossing).select("a1", "a2")


def pair_counts(df: DataFrame, group: str, member: str, **bounds) -> DataFrame:
    return member_pairs(df, group, member, **bounds).groupBy("a1", "a2").agg(F.count("*").alias("n"))


def top_pairs(df: DataFrame, group: str, member: str, k: int = 20, probe: int = 200) -> DataFrame:
    """The k pairs that share the most groups, exactly, without pairing everybody.

    A pair shares at most as many groups as its rarer member has. The k-th best count among the ``probe`` most
    frequent members is therefore a floor: members below it cannot be part of the answer.
    """
    rows = cut_lineage(df.select(F.col(group).alias("g"), F.col(member).alias("m")).distinct())
    counts = rows.groupBy("m").agg(F.count("*").alias("n"))
    often = counts.orderBy(F.desc("n"), "m").limit(probe).select("m")
    best = (pair_counts(rows.join(often, "m", "left_semi"), "g", "m")
            .orderBy(F.desc("n"), "a1", "a2").limit(k).agg(F.min("n").alias("low"), F.count("*").alias("found")))
    floor = best.select(F.when(F.col("found") == k, F.col("low")).otherwise(F.lit(1))).scalar()
    able = counts.where(F.col("n") >= floor).select("m")
    return (pair_counts(rows.join(able, "m", "left_semi"), "g", "m")
            .orderBy(F.desc("n"), "a1", "a2").limit(k))


def sampled_pairs(df: DataFrame, group: str, member: str, fraction: float = 0.25, max_size: int = 50,
                  seed: object = 42) -> DataFrame:
    """Pair counts over a hash sample of the groups that have 2..max_size distinct members."""
    return pair_counts(hash_sample(df, group, fraction, seed), group, member, min_size=2, max_size=max_size)


# ---- cross tables and citation figures -----------------------------------------------------------------------

def top_cross_table(rows_df: DataFrame, cols_df: DataFrame, key: str, row_col: str, col_col: str,
                    n_rows: int, n_cols: int) -> DataFrame:
    """Counts of (row value, column value) sharing a key, over the two top lists, zero cells included."""
    top_r = top_values(rows_df, row_col, n_rows).select(row_col)
    top_c = top_values(cols_df, col_col, n_cols).select(col_col)
    found = (rows_df.join(top_r, row_col, "left_semi")
             .join(cols_df.join(top_c, col_col, "left_semi"), key)
             .groupBy(row_col, col_col).agg(F.count("*").alias("n")))
    return zero_filled(found, top_r, row_col, top_c, col_col, "n")


def zero_filled(found: DataFrame, rows_df: DataFrame, row_col: str, cols_df: DataFrame, col_col: str,
                value: str) -> DataFrame:
    """Every (row, column) of two short lists, 0 where nothing was found. The column list is one array value."""
    names = cols_df.agg(F.collect_list(col_col)).scalar()
    grid = rows_df.select(row_col, F.explode(names).alias(col_col))
    return (grid.join(found, [row_col, col_col], "left")
            .select(row_col, col_col, F.coalesce(value, F.lit(0)).cast("bigint").alias(value)))


def citation_totals(authors: DataFrame, papers: DataFrame, count_col: str, key: str = "id",
                    author: str = "author") -> DataFrame:
    """Sum, mean and distinct papers per author over papers with a citation count."""
    counts = papers.select(key, F.col(count_col).cast("string").try_cast("bigint").alias("cit"))
    return (authors.join(counts.where(F.col("cit").isNotNull()), key)
            .groupBy(author).agg(F.sum("cit").alias("cit_sum"), F.avg("cit").alias("cit_mean"),
                                 F.count_distinct(key).alias("papers")))


def mean_citations_per_category(papers: DataFrame, count_col: str, min_papers: int = 500) -> DataFrame:
    cit = F.col(count_col).cast("string").try_cast("bigint")
    return (exploded_categories(papers.withColumn("cit", cit).where(F.col("cit").isNotNull()), "cit")
            .groupBy("category").agg(F.avg("cit").alias("mean_cit"), F.count("*").alias("papers"))
            .where(F.col("papers") >= min_papers))


def clipped_histogram(df: DataFrame, value: Column, key: str, fraction: float = 0.2, bins: int = 50,
                      quantile: float = 0.995, clip_above: int = 1000, seed: object = 42) -> DataFrame:
    """Histogram of non-negative counts up to a cut-off: the whole part of the ``quantile`` when the sample has
    more than ``clip_above`` rows, else the maximum; never below 1. Equal bins over [0, cut], the last closed.

    Everything after the sample works on the table of distinct values and their counts.
    """
    sample = hash_sample(df.withColumn("__v", non_negative_long(value)), key, fraction, seed)
    counts = sample.where(F.col("__v").isNotNull()).groupBy("__v").agg(F.count("*").alias("n"))
    cut = counts.agg(F.greatest(F.lit(1), F.when(
        F.sum("n") > clip_above, F.floor(F.percentile("__v", quantile, F.col("n")))
    ).otherwise(F.max("__v")))).scalar()
    width = cut / F.lit(float(bins))
    bin_no = F.least(F.floor(F.col("__v") / width), F.lit(bins - 1)).cast("bigint")
    return (counts.where(F.col("__v") <= cut).withColumn("bin", bin_no)
            .groupBy("bin").agg(F.sum("n").alias("n"), F.min(width).alias("__w"))
            .select("bin", (F.col("bin") * F.col("__w")).alias("low"),
                    ((F.col("bin") + 1) * F.col("__w")).alias("high"), "n"))


def length_against_authors(papers: DataFrame, size: Column, sample_rows: int = 200_000,
                           fraction: float = 1.0, seed: object = 42) -> DataFrame:
    """(num_authors, title_len) of a hash sample of at most ``sample_rows`` papers."""
    picked = (papers.select("id", size.alias("num_authors"), F.length("title").alias("title_len"))
              .where(F.col("num_authors").isNotNull() & F.col("title_len").isNotNull()))
    place = tx.hash_order(F.col("id"), seed)
    return first_rows(hash_sample(picked, "id", fraction, seed), [place, F.col("id")], F.substring(place, 1, 6), sample_rows)


def summary_records(papers: DataFrame, authors: DataFrame, num_authors: Column, citations: str | None) -> DataFrame:
    """(key, entity, value) rows of record holders. ``papers`` has id, year, categories; ties go to the smaller
    entity. Without a citation column one row says so."""

    def first(entity: Column, value: Column) -> Column:
        """The record holder as an aggregate: greatest value, then smallest entity."""
        entity, value = entity.cast("string"), value.cast("bigint")
        return F.min(F.when(value.isNotNull(), F.struct((-value).alias("below"), entity.alias("entity"))))

    def holders(df: DataFrame, **records: Column) -> DataFrame:
        """All record holders of a table from one pass over it."""
        row = df.agg(*[c.alias(key) for key, c in records.items()])
        listed = F.array(*[F.struct(F.lit(key).alias("key"), F.col(f"{key}.entity").alias("entity"), (-F.col(f"{key}.below")).alias("value"))
                           for key in records])
        return row.select(F.explode(listed).alias("r")).select("r.*").where(F.col("value").isNotNull())

    n = F.col("n")
    given = citations and F.col(citations).cast("string").try_cast("bigint")
    slim = cut_lineage(papers.select("id", "year", "categories", num_authors.alias("n"), *([given.alias("cited")] if citations else [])))
    own = {"paper_with_most_authors": first(F.col("id"), n),
           "paper_with_most_categories": first(F.col("id"), F.size(tx.category_list(F.col("categories"))))}
    if citations:
        own["most_cited_paper"] = first(F.col("id"), F.col("cited"))
    by_year = frequency(slim.where(F.col("year").isNotNull()), "year")
    by_author = authors.join(slim.groupBy("id").agg(F.sum("cited").alias("cited")), "id", "left") if citations else authors
    per_author = by_author.groupBy("author").agg(F.count("*").alias("n"), *([F.sum("cited").alias("cit_sum")] if citations else []))
    of_authors = {"most_prolific_author": first(F.col("author"), n)}
    if citations:
        of_authors["most_cited_author"] = first(F.col("author"), F.col("cit_sum"))
    parts = [
        slim.agg(F.count("*").alias("value")).select(F.lit("rows_total").alias("key"), F.lit(None).cast("string").alias("entity"), "value"),
        holders(slim, **own),
        holders(by_year, year_with_most_papers=first(F.col("year"), n)),
        holders(frequency(exploded_categories(slim), "category"), most_common_category=first(F.col("category"), n)),
        holders(per_author, **of_authors),
    ]
    if not citations:
        parts.append(papers.sparkSession.createDataFrame(
            [("citations_available", None, 0)], "key STRING, entity STRING, value BIGINT"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
