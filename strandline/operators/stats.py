"""Summaries, paired and unpaired tests, false discovery rates, correlations and quality reports."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.symbols import finite, stable_seed
from strandline.sources.shared import checkpointed

IDENTITY = ("organism", "accession", "organism_type", "source", "replicate", "start", "end")


def numeric_columns(df: DataFrame, identity=IDENTITY) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in identity]


def long_form(df: DataFrame, keys: list[str], features: list[str] | None = None) -> DataFrame:
    """keys..., feature, value: finite values only."""
    features = features or [c for c in numeric_columns(df) if c not in keys]
    wide = df.select(*keys, *(finite(F.col(c).cast("double")).alias(c) for c in features))
    return wide.unpivot(keys, features, "feature", "value").where("value IS NOT NULL")


def summary(df: DataFrame, by: str, features: list[str], carry: list[str] = ()) -> DataFrame:
    """One row per `by`: n_windows, and mean, sd (0 for one value) and ci95 of every feature."""
    aggs = [F.count(F.lit(1)).alias("n_windows"), *(F.min(c).alias(c) for c in carry)]
    for c in features:
        v = finite(F.col(c).cast("double"))
        sd = F.coalesce(F.stddev_samp(v), F.when(F.count(v) == 1, 0.0))
        aggs += [F.avg(v).alias(f"{c}_mean"), sd.alias(f"{c}_sd"), (1.96 * sd / F.sqrt(F.nullif(F.count(v), F.lit(0)))).alias(f"{c}_ci95")]
    return df.groupBy(by).agg(*aggs)


def paired(values: DataFrame, keys: list[str], source: str = "source", observed: str = "observed") -> DataFrame:
    """keys..., feature, control, o, c: every observed value beside those of its controls."""
    o = values.where(F.col(source) == observed).select(*keys, "feature", F.col("value").alias("o"))
    c = values.where(F.col(source) != observed).select(*keys, "feature", F.col(source).alias("control"), F.col("value").alias("c"))
    return o.join(c, [*keys, "feature"])


def paired_stats(pairs: DataFrame) -> DataFrame:
    """n_pairs, means, standard deviations and effect sizes by feature and control, of two pairs or more."""
    d = F.col("o") - F.col("c")
    pooled = F.sqrt((F.var_samp("o") + F.var_samp("c")) / 2) + 1e-15
    out = pairs.groupBy("feature", "control").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("c").alias("null_mean"), F.stddev_samp("c").alias("null_sd"), F.avg(d).alias("delta_mean_paired"),
        F.stddev_samp(d).alias("delta_sd_paired"), (F.avg(d) / pooled).alias("cohens_d_pooled"), (F.avg(d) / (F.stddev_samp(d) + 1e-15)).alias("paired_standardized_mean"),
    )
    return out.where("n_pairs >= 2")


def sign_flip_p(deltas: np.ndarray, permutations: int, seed: int) -> float | None:
    deltas = np.asarray(deltas, float)
    deltas = deltas[np.isfinite(deltas)]
    if len(deltas) < 2:
        return None
    mean = abs(deltas.mean())
    if mean == 0:
        return 1.0
    if permutations <= 0:
        return None
    rng = np.random.default_rng(seed)
    two = np.array([-1.0, 1.0])
    hits = sum(abs((deltas * rng.choice(two, size=len(deltas))).mean()) >= mean for _ in range(permutations))
    return (hits + 1) / (permutations + 1)


def permutation_tests(pairs: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """feature, control, paired_permutation_p. A group holds one number per pair of windows and is drawn for
    as a whole, in the generator's order; permutation_sums does for groups of any size."""

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        f, c = pdf.feature.iloc[0], pdf.control.iloc[0]
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"feature": [f], "control": [c], "paired_permutation_p": [sign_flip_p(pdf.d.to_numpy(), permutations, stable_seed(seed, f, c))]})

    keys = [c for c in pairs.columns if c not in ("feature", "control", "o", "c")]
    d = pairs.select("feature", "control", F.concat_ws("|", *(F.col(k).cast("string") for k in keys)).alias("k"), (F.col("o") - F.col("c")).alias("d"))
    return d.groupBy("feature", "control").applyInPandas(test, "feature string, control string, paired_permutation_p double")


def permutation_sums(pairs: DataFrame, permutations: int = 999, seed: int = 42) -> DataFrame:
    """The same test for groups of any size: the sign of a pair in a permutation is a bit of a hash of its
    key, so each task adds up its own flipped deltas and only the sums (one per permutation) move."""
    keys = [c for c in pairs.columns if c not in ("feature", "control", "o", "c")]
    mark = F.xxhash64(F.lit(seed), "feature", "control", *keys)
    d = pairs.select("feature", "control", mark.alias("h"), finite(F.col("o") - F.col("c")).alias("d")).where("d IS NOT NULL")

    def part(batches):
        for pdf in batches:
            for (f, c), own in pdf.groupby(["feature", "control"], sort=False):
                x, flips = own.d.to_numpy(float), np.arange(permutations, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sums = np.zeros(permutations)
                for k in range(0, len(x), 4096):
                    h = own.h.to_numpy(np.int64)[k : k + 4096].view(np.uint64)[:, None] + flips
                    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
                    sums += x[k : k + 4096] @ np.where(h >> np.uint64(63), -1.0, 1.0)
                yield pd.DataFrame({"feature": f, "control": c, "n": len(x), "k": np.arange(-1, permutations), "s": np.append(x.sum(), sums)})

    sums = d.mapInPandas(part, "feature string, control string, n long, k int, s double").groupBy("feature", "control", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    own = F.max(F.when(F.col("k") == -1, F.abs("s"))).over(Window.partitionBy("feature", "control"))
    hits = F.sum(F.when((F.col("k") >= 0) & (F.abs("s") >= F.col("own")), 1).otherwise(0))
    p = F.when(F.max("n") < 2, None).when(F.max("own") == 0, 1.0).otherwise((hits + 1) / (permutations + 1) if permutations > 0 else F.lit(None).cast("double"))
    return sums.withColumn("own", own).groupBy("feature", "control").agg(p.alias("paired_permutation_p"))


def benjamini_hochberg(df: DataFrame, p: str, ties: list[str], q: str = "p_fdr_bh") -> DataFrame:
    """Adjusted p-values over all rows; a missing p counts as a test and gets 1. `df` has a row per test.

    Rows are dealt by ranges of p. A rank is one inside a range plus the rows before the range, and a
    minimum of all that follow is one inside a range and one over the ranges behind: a row per range."""
    order = [F.col(p).asc_nulls_last(), *ties]
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ranges = Window.orderBy("_part")
    size = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    size = size.select("_part", (F.sum("_n").over(ranges) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_m"))
    inner = Window.partitionBy("_part")
    # A minimum of the rows behind, as a running one from the far end: a frame that only begins at a row costs its length each time.
    back = inner.orderBy(F.col(p).desc_nulls_first(), *(F.col(c).desc_nulls_last() for c in ties)).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(inner.orderBy(*order)) + F.col("_before")
    raw = F.coalesce(F.least(F.lit(1.0), F.col(p) * F.col("_m") / rank), F.lit(1.0))
    local = dealt.join(F.broadcast(size), "_part").withColumn("_raw", raw).withColumn("_least", F.min("_raw").over(back))
    local = checkpointed(local)
    behind = local.groupBy("_part").agg(F.min("_raw").alias("_low")).select("_part", F.min("_low").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"))
    out = local.join(F.broadcast(behind), "_part")
    return out.withColumn(q, F.when(F.col(p).isNull(), 1.0).otherwise(F.least("_least", "_behind"))).drop("_part", "_before", "_m", "_raw", "_least", "_behind")


def unpaired_stats(values: DataFrame, source: str = "source", observed: str = "observed") -> DataFrame:
    """Difference of means, Cohen's d and the rough empirical p of each control, three values at least."""
    o = values.where(F.col(source) == observed).groupBy("feature").agg(F.avg("value").alias("om"), F.var_samp("value").alias("ov"), F.count(F.lit(1)).alias("on")).where("on >= 3")
    null = values.where(F.col(source) != observed).withColumnRenamed(source, "control")
    m = null.groupBy("feature", "control").agg(F.avg("value").alias("nm"), F.var_samp("value").alias("nv"), F.count(F.lit(1)).alias("nn")).where("nn >= 3").join(o, "feature")
    far = null.join(m, ["feature", "control"]).groupBy("feature", "control").agg(F.sum(F.when(F.abs(F.col("value") - F.col("nm")) >= F.abs(F.col("om") - F.col("nm")), 1).otherwise(0)).alias("far"))
    return m.join(far, ["feature", "control"]).select(
        "feature", "control", F.col("nm").alias("null_mean"), F.sqrt("nv").alias("null_sd"), (F.col("om") - F.col("nm")).alias("delta"),
        ((F.col("om") - F.col("nm")) / (F.sqrt((F.col("ov") + F.col("nv")) / 2) + 1e-15)).alias("cohens_d"), ((F.col("far") + 1) / (F.col("nn") + 1)).alias("empirical_p_rough"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate over rows where both are present; NULL where one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlations(df: DataFrame, target: str, features: list[str], least: int = 4) -> DataFrame:
    """feature, n, r of every feature with `target`, over complete pairs."""
    v = df.select(F.col(target).cast("double").alias("_t"), *(finite(F.col(c).cast("double")).alias(c) for c in features)).unpivot(["_t"], features, "feature", "value").where("value IS NOT NULL AND _t IS NOT NULL")
    return v.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("value"), F.col("_t")).alias("r")).where(F.col("n") >= least)


def correlation_matrix(df: DataFrame, features: list[str], more_than: int = 3) -> DataFrame:
    """a, b, n, r for all ordered pairs, each over the rows that have both.

    A batch of rows is a matrix, and its sums for all pairs are four products with the mask of present values; only
    these move, one row a pair and task. Values are taken from their column's mean first, so that no digits are
    lost to it."""
    k = len(features)
    x = df.select(*(finite(F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(features)))
    mean = x.agg(*(F.avg(c) for c in x.columns)).first()
    centre = np.array([v or 0.0 for v in mean])

    def work(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - centre
            has = np.isfinite(v)
            v, m = np.where(has, v, 0.0), has.astype(float)
            total += [m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v]
        i, j = np.divmod(np.arange(k * k), k)
        yield pd.DataFrame(dict(zip(("i", "j", "n", "sa", "sb", "saa", "sbb", "sab"), (i, j, *total.reshape(6, -1)), strict=True)))

    def batched(batches):
        import pyarrow as pa

        for out in work(batches):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    sums = x.mapInArrow(batched, "i long, j long, n double, sa double, sb double, saa double, sbb double, sab double").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    n = F.col("n")
    va, vb = n * F.col("saa") - F.col("sa") * F.col("sa"), n * F.col("sbb") - F.col("sb") * F.col("sb")
    # A constant column leaves nothing but rounding.
    flat = (va <= 1e-12 * n * F.col("saa")) | (vb <= 1e-12 * n * F.col("sbb"))
    r = F.when(~flat, (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va) / F.sqrt(vb))
    names = F.array(*map(F.lit, features))
    return sums.where(n > more_than).select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), n.cast("long").alias("n"), r.alias("r"))


def exact_quantiles(df: DataFrame, group: str, value: str, qs: list[float]) -> DataFrame:
    """group, q, value: exact quantiles with linear interpolation, of several groups and shares in one pass.

    Equal values are counted first, so that a frequent one is one row. Distinct values are dealt to ranges of
    (group, value); a range's counts say which ranks lie in it, and only ranks that are asked for are looked up,
    each in its range. A task holds a range, never a group. NULL and NaN take no part."""
    held = df.select(F.col(group).alias("g"), finite(F.col(value).cast("double")).alias("v")).where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    # The range is written beside the rows, since a second deal need not be cut alike.
    dealt = checkpointed(held.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("g", "part").agg(F.sum("c").alias("n"))
    order = Window.partitionBy("g").orderBy("part")
    sizes = checkpointed(sizes.select("g", "part", "n", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total")))
    at = F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("q")
    asked = sizes.groupBy("g").agg(F.max("total").alias("total")).select("g", "total", at).withColumn("place", F.col("q") * (F.col("total") - 1))
    asked = asked.select("g", "q", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank"))
    ranks = asked.join(sizes, "g").where("before <= rank AND rank < before + n").select("g", "part", "q", "place", "rank", "before")
    inner = Window.partitionBy("part", "g").orderBy("v")
    rows = dealt.withColumn("upto", F.sum("c").over(inner))
    found = rows.join(ranks, ["g", "part"]).where((F.col("before") + F.col("upto") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("upto")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    return found.groupBy("g", "q").agg((low + (high - low) * (F.max("place") - F.floor(F.max("place")))).alias("value")).select(F.col("g").alias(group), "q", "value")


def pearson_p(r: float, n: int) -> float | None:
    """Two-sided p of a Pearson r over n pairs, by the regularised incomplete beta function."""
    if n < 3 or r is None:
        return None
    if abs(r) >= 1:
        return 0.0
    return _betainc((n - 2) / 2, 0.5, 1 - r * r)


def with_pearson_p(df: DataFrame) -> DataFrame:
    """Rows of feature, n, r with their two-sided p; one row per feature."""

    def work(batches):
        for pdf in batches:
            yield pdf.assign(p=[pearson_p(None if r is None or r != r else r, int(n)) for r, n in zip(pdf.r, pdf.n, strict=True)])

    return df.mapInPandas(work, T.StructType([*df.schema.fields, T.StructField("p", T.DoubleType())]))


def _betainc(a: float, b: float, x: float) -> float:
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def radar(df: DataFrame, by: str, features: list[str], inverted: list[str]) -> DataFrame:
    """Mean per type of features scaled to 0..1 over all complete rows; some run the other way."""
    full = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in features))
    ends = full.agg(*[e for c in features for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))])
    unit = lambda c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-10)
    return full.crossJoin(F.broadcast(ends)).groupBy(by).agg(*(F.avg(1 - unit(c) if c in inverted else unit(c)).alias(c) for c in features))


def projection_score(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """Mean pairwise cosine of rows' feature vectors, missing values dropped (which shortens a vector).

    Pairs of equal lengths add up: the sum over pairs of x.y is (|sum x|^2 - sum |x|^2) / 2, so no pair is
    formed. Vectors of different lengths meet over their common prefix: prefix sums by length."""
    v = F.filter(F.array(*(finite(F.col(c).cast("double")) for c in features)), lambda x: x.isNotNull())
    rows = df.select(F.col(key).alias("k"), v.alias("v")).where(F.size("v") > 0)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.select(F.size("v").alias("len"), F.posexplode(F.when(size > 0, F.transform("v", lambda x: x / size)).otherwise(F.col("v"))).alias("i", "x"))
    by = unit.groupBy("len", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"), F.count(F.lit(1)).alias("n"))
    a, b = by.select(F.col("len").alias("la"), "i", F.col("s").alias("sa"), "ss", F.col("n").alias("na")), by.select(F.col("len").alias("lb"), "i", F.col("s").alias("sb"), F.col("n").alias("nb"))
    pairs = a.join(b, "i").where("la <= lb")
    dots = F.when(F.col("la") == F.col("lb"), (F.col("sa") * F.col("sb") - F.col("ss")) / 2).otherwise(F.col("sa") * F.col("sb"))
    count = F.when(F.col("la") == F.col("lb"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return pairs.agg((F.sum(dots) / F.nullif(F.sum(F.when(F.col("i") == 0, count).otherwise(0)), F.lit(0.0))).alias("score"))


def quality(df: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """feature, n, nan_rate."""
    cells = [F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.avg(F.when(finite(F.col(c).cast("double")).isNull(), 1.0).otherwise(0.0)).alias("nan_rate")) for c in features]
    return df.agg(F.array(*cells).alias("m")).select(F.inline("m"))


def top_effects(stats: DataFrame, n: int = 20, effect: str = "cohens_d_pooled") -> DataFrame:
    """The features with the largest absolute effect against any control."""
    return stats.groupBy("feature").agg(F.max(F.abs(effect)).alias("max_abs_d")).orderBy(F.desc("max_abs_d"), "feature").limit(n)


def first_wins(value: Column, tie: Column) -> Column:
    """Orders by value, the smallest tie first: for max(...) of argmax with the first place winning."""
    return F.struct(value, -tie)
