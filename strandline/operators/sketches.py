"""Word sketches of blocks as signed sums, by joins.

A word has a slot and a sign, from the stable hash; a block's sketch for a word length is the signed sum of its word
counts by slot, scaled to length one, and its embedding is all its sketches beside each other, scaled again. Rows
are slots that aren't zero: norms, centroids and distances come from sums of products, so no vector is built, unless
the record is short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import kernels as K
from strandline.operators import tiles as T
from strandline.operators import windows
from strandline.sources.shared import saved

KS = (3, 4, 5, 6)
WHOLE = 1 << 20
FIGURES = tuple(f"grammar_{c}" for c in ("embedding_norm", "embedding_entropy", "block_drift_mean", "block_drift_sd", "centroid_distance", "block_count"))


def words(k: int, dim: int, seed: int) -> list[tuple[str, int, int]]:
    """word, slot, sign of all words of k symbols."""
    slot, sign = K.sketch_table(k, dim, seed)
    names = [""]
    for _ in range(k):
        names = [w + b for w in names for b in "ACGT"]
    return list(zip(names, slot.tolist(), sign.astype(int).tolist(), strict=True))


def word_table(spark: SparkSession, dim: int, ks: tuple[int, ...] = KS) -> DataFrame:
    """k, kmer, slot, sign: 4^k rows for each k, whatever the data."""
    rows = [(k, *w) for k in ks for w in words(k, dim, 101 + k)]
    return spark.createDataFrame(rows, "k int, kmer string, slot int, sign int")


def block_sketches(df: DataFrame, dim: int = 512, levels: int = 4, ks: tuple[int, ...] = KS) -> DataFrame:
    """name, block, k, slot, v: the slots of every block's embedding that aren't zero, of sequences of 96 symbols or
    more. A block whose word lengths all give a sketch has length one."""
    blocks = T.grammar_blocks(df.where(F.length("sequence") >= 96).select("name", "sequence"), levels).withColumnRenamed("piece", "sequence")
    each = [T.kmer_counts(blocks, k, keep=("name", "block")).withColumn("k", F.lit(k)) for k in ks]
    table = word_table(df.sparkSession, max(32, dim), ks)
    sums = reduce(DataFrame.unionByName, each).join(F.broadcast(table), ["k", "kmer"]).groupBy("name", "block", "k", "slot").agg(F.sum(F.col("sign") * F.col("cnt")).cast("double").alias("v")).where("v <> 0")
    one = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("name", "block", "k")))
    sums = sums.withColumn("v", F.col("v") / one)
    whole = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("name", "block")))
    return sums.withColumn("v", F.col("v") / whole)


def grammar(df: DataFrame, dim: int = 512, levels: int = 4, ks: tuple[int, ...] = KS) -> DataFrame:
    """The figures of joined_grammar. A record of up to `WHOLE` symbols is a matrix of its blocks' embeddings in its own
    row, so that no slot moves; longer ones go by joins."""
    df = saved(df.select("name", "sequence"))
    short = F.coalesce(F.length("sequence") <= WHOLE, F.lit(True))
    own = windows.per_record(df.where(short), "name string, " + ", ".join(f"{c} double" for c in FIGURES), lambda s: {c: v for c, v in K.grammar(s, dim, levels, ks).items() if c in FIGURES})
    return own.unionByName(joined_grammar(df.where(~short), dim, levels, ks))


def joined_grammar(df: DataFrame, dim: int = 512, levels: int = 4, ks: tuple[int, ...] = KS) -> DataFrame:
    """name and how embeddings move over the blocks: length and entropy of their mean, mean and deviation of the steps
    between blocks that follow each other, mean distance to the mean, number of blocks. NULL below 96 symbols."""
    s = block_sketches(df, dim, levels, ks)
    count = T.grammar_blocks(df.where(F.length("sequence") >= 96).select("name", "sequence"), levels).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    mean = s.groupBy("name", "k", "slot").agg(F.sum("v").alias("t")).join(count, "name").select("name", "k", "slot", "n", (F.col("t") / F.col("n")).alias("m"))
    sq = F.col("m") * F.col("m")
    # -sum p log2 p of p = m^2 / M is log2 M - sum m^2 log2 m^2 / M.
    centre = mean.groupBy("name", "n").agg(F.sum(sq).alias("mm"), F.sum(sq * F.log2(sq)).alias("ml"))
    size = float(len(ks) * max(32, dim))
    own = s.groupBy("name", "block").agg(F.sum(F.col("v") * F.col("v")).alias("vv"))
    to_mean = s.join(mean.select("name", "k", "slot", "m"), ["name", "k", "slot"]).groupBy("name", "block").agg(F.sum(F.col("v") * F.col("m")).alias("vm"))
    far = own.join(to_mean, ["name", "block"]).join(centre.select("name", "mm"), "name").groupBy("name").agg(F.sum(F.sqrt(F.greatest(F.col("vv") + F.col("mm") - 2 * F.col("vm"), F.lit(0.0)))).alias("far"), F.count(F.lit(1)).alias("seen"))
    after = s.select("name", (F.col("block") - 1).alias("block"), "k", "slot", F.col("v").alias("w"))
    dot = s.join(after, ["name", "block", "k", "slot"]).groupBy("name", "block").agg(F.sum(F.col("v") * F.col("w")).alias("d"))
    # A block without a word is at zero, and so has no row here.
    pairs = count.select("name", F.explode(F.sequence(F.lit(0), (F.col("n") - 2).cast("int"))).alias("block"))
    size_of = lambda shift, name: own.select("name", (F.col("block") - shift).alias("block"), F.col("vv").alias(name))
    steps = pairs.join(size_of(0, "p"), ["name", "block"], "left").join(size_of(1, "q"), ["name", "block"], "left").join(dot, ["name", "block"], "left")
    zero = F.lit(0.0)
    step = F.sqrt(F.greatest(F.coalesce("p", zero) + F.coalesce("q", zero) - 2 * F.coalesce("d", zero), zero))
    drift = steps.groupBy("name").agg(F.avg(step).alias("drift"), F.stddev_pop(step).alias("sd"))
    got = count.join(centre.drop("n"), "name", "left").join(far, "name", "left").join(drift, "name", "left")
    away = (F.coalesce("far", zero) + (F.col("n") - F.coalesce("seen", F.lit(0))) * F.sqrt(F.coalesce("mm", zero))) / F.col("n")
    got = got.select(
        "name", F.sqrt(F.coalesce("mm", zero)).alias("grammar_embedding_norm"), ((F.log2("mm") - F.col("ml") / F.col("mm")) / F.log2(F.lit(size))).alias("grammar_embedding_entropy"), F.col("drift").alias("grammar_block_drift_mean"),
        F.col("sd").alias("grammar_block_drift_sd"), away.alias("grammar_centroid_distance"), F.col("n").cast("double").alias("grammar_block_count"),
    )
    return df.select("name").join(got, "name", "left")
