"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a target of words: its weight's share of all words, at most ``max_epochs`` times what
it has; what it cannot take is shared again by weight.  A source gives its complete epochs (every
document) first.  The rest is a weighted sample without replacement: document d gets the exponential
key ``-ln(u_d) / quality_d`` with u_d uniform from a hash of its id and text, keys ascend within the source,
and documents are taken while the running word count is nearest to the budget.

The running count is not a window over a source, which may hold a third of all rows.  Documents are
range-partitioned by (source, key), so a bucket is what one task of that exchange holds of a source, of even
size whatever the weights.  Word counts per bucket are summed first; they settle every bucket but the
one where the budget runs out, and only that bucket's documents stand in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep_table

WORD = r"[^\x20\x09-\x0D]+"


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from the MD5 of the columns: 48 bits, the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size, n_docs, weight, target) from one row per source (source, source_size, n_docs).

    Filling by weight with caps has a closed form: order sources by cap / weight; those below the
    water level are full, the others share what is left by weight.  Sources are ranked by code point,
    null last, and the weights repeat along that order.  The rows are sources, not documents.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = sizes.withColumn("weight", F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    fill = Window.partitionBy(F.lit(0)).orderBy("cap_ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rest = Window.partitionBy(F.lit(0))
    level = (ranked.withColumn("cap", F.col("source_size") * max_epochs)
             .withColumn("cap_ratio", F.col("cap") / F.col("weight"))
             .withColumns({"caps_below": F.sum("cap").over(fill), "weight_below": F.sum("weight").over(fill),
                           "all_words": F.sum("source_size").over(rest), "all_weight": F.sum("weight").over(rest)})
             # a source is full if the level that fills all sources up to its ratio needs no more than there is
             .withColumn("full", F.col("caps_below") + F.col("cap_ratio") * (F.col("all_weight") - F.col("weight_below"))
                         <= F.col("all_words")))
    used = (level.withColumns({
        "left_words": F.col("all_words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(rest), F.lit(0)),
        "left_weight": F.sum(F.when(~F.col("full"), F.col("weight"))).over(rest)}))
    return used.select("source", "source_size", "n_docs", "weight",
                       F.when(F.col("full"), F.col("cap").cast("double"))
                       .otherwise(F.least(F.col("cap").cast("double"),
                                          F.col("weight") * F.col("left_words") / F.col("left_weight")))
                       .alias("target"))


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3),
                max_epochs: int = 3) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, source, source_size, target, taken, copies, row_key).

    ``docs`` needs ``doc_id``, ``text``, ``source``; ``quality`` may give (doc_id, weight > 0) and counts as 1
    where it has no row, more than one row (the mean counts) or a weight that is null or not positive.
    ``size`` is the number of words (null or empty text: 0), ``copies`` how often the mix takes the document
    and ``taken = copies * size``.  Null is a source of its own.  Copies under other ids are other documents; rows
    equal in doc_id, text and source share ``row_key`` and are taken together or not at all.  Only these
    columns are read; an empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.col("text").cast("string").alias("text"))
    sized = sized.select("doc_id", "source", F.xxhash64("doc_id", "text", "source").alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
                         .cast("long").alias("size"), uniform(F.col("doc_id"), F.md5("text")).alias("u"))
    if quality is not None:
        weight = (quality.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("q_id"))
                  .agg(F.avg("weight").alias("q")))
        sized = sized.join(weight, sized["doc_id"] == weight["q_id"], "left").drop("q_id")
    else:
        sized = sized.withColumn("q", F.lit(1.0))
    sized = keep_table(sized.withColumn("q", F.when(F.col("q") > 0, F.col("q")).otherwise(1.0))
                       .withColumn("key", -F.log("u") / F.col("q")), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = keep_table(
        source_targets(totals, weights, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "sources")
    # every column of the order takes part, so that rows of equal keys are told apart as in the window below
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep_table(sized.repartitionByRange(n, "source", "key", "doc_id", "row_key")
                        .withColumn("bucket", F.spark_partition_id()), "ranges")
    placed = ranged.join(sources.withColumnRenamed("source", "__source"), F.expr("source <=> __source")).drop("__source")
    counted = placed.where("size > 0").groupBy("source", "bucket").agg(
        F.sum("size").alias("in_bucket"), F.first("budget").alias("__budget"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    buckets = keep_table(counted.withColumn("offset", before).select(
        F.col("source").alias("__source"), F.col("bucket").alias("__bucket"), "offset",
        F.when(F.col("offset") + F.col("in_bucket") <= F.col("__budget"), 1)
        .when(F.col("offset") > F.col("__budget"), 0).alias("settled")), "buckets")
    known = placed.join(buckets, F.expr("size > 0 and source <=> __source and bucket = __bucket"), "left")
    upto = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "row_key")
                              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # taken while its middle word is within the budget: the sum ends nearest to it
    edge = (known.where("size > 0 and settled is null")
            .withColumn("extra", (F.col("offset") + upto - F.col("size") / 2 <= F.col("budget")).cast("int")))
    rest = known.where("size = 0 or settled is not null").withColumn("extra", F.coalesce("settled", F.lit(0)))
    return (rest.unionByName(edge)
            .withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.col("extra")).cast("long"))
            .select("doc_id", "size", "source", "source_size", "target",
                    (F.col("copies") * F.col("size")).alias("taken"), "copies", "row_key"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3),
                    max_epochs: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay."""
    taken = (mix_sources(docs, quality, weights, max_epochs).where("copies > 0")
             .groupBy(F.col("row_key").alias("__key")).agg(F.max("copies").alias("__copies")))
    keyed = docs.withColumn("__own", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                                                F.col("source").cast("string")))
    return (keyed.join(taken, keyed["__own"] == taken["__key"])
            .withColumn("__copy", F.explode(F.expr("sequence(1, cast(__copies as int))")))
            .drop("__own", "__key", "__copies", "__copy"))
