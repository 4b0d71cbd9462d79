"""Scores of layouts: guarded correlations and the two levels of residual metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from mosaiq.operators.graph import FEW, gone, kept, looked_up


def guarded_correlation(x: Column, y: Column, least: int = 2) -> Column:
    """Pearson's correlation as one pass of sums; 0 with too few rows or no variance."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("double")
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = sxx - sx * sx / F.greatest(n, F.lit(1.0)), syy - sy * sy / F.greatest(n, F.lit(1.0))
    r = F.try_divide(sxy - sx * sy / F.greatest(n, F.lit(1.0)), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    return F.when((n < least) | (vx <= 1e-12) | (vy <= 1e-12), 0.0).otherwise(r)


def residual_metrics(errors: DataFrame, keys: list[str], err: str) -> DataFrame:
    """Root mean square, median and 95th percentile of pooled errors; one row of nulls and n = 0 without rows and keys."""
    e = F.col(err)
    return errors.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rms"), F.percentile(e, F.lit(0.5)).alias("median"), F.percentile(e, F.lit(0.95)).alias("p95"))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], *, bins: int = 1024, few: int = FEW) -> DataFrame:
    """keys, share, quantile: exact, linear between neighbouring ranks, for groups of any size.

    A rank is looked for by passes: the range that holds it is cut into `bins` of equal
    width, rows are counted by bin (partial sums), and the range shrinks to the least and
    largest value of the bin that has the rank, until these are one. So a pass moves `bins`
    rows a rank at most, and no task holds a group's values. Nulls don't count; groups
    without values have no row; NaN comes last, as Spark sorts it, but is no end of a range
    that can be cut, so values must be finite.
    """
    spark = rows.sparkSession
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    held, held_at = kept(rows.select(F.xxhash64(key).alias("_h"), *keys, F.col(value).cast("double").alias("_v")).where("_v is not null"))
    sizes, _ = kept(held.groupBy("_h", *keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = F.col("share") * (F.col("_n") - 1)
    wanted = sizes.withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares]))).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = wanted.withColumn("_k", F.when(F.col("_side") == 0, F.floor(at)).otherwise(F.ceil(at))).withColumn("_t", F.monotonically_increasing_id())
    state, path = kept(wanted)
    while state.where("_lo < _hi").limit(1).count():
        open_ = state.where("_lo < _hi").select("_h", "_t", "_k", "_lo", "_hi")
        n = open_.count()
        near = held.select("_h", "_v").join(F.broadcast(open_) if n <= few else open_, "_h").where("_v between _lo and _hi")
        # halves first, so that no difference of two finite numbers is infinite
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        counts = near.groupBy("_t", bin_.alias("_b")).agg(F.count("*").alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_m"))
        upto = counts.withColumn("_before", F.sum("_c").over(W.partitionBy("_t").orderBy("_b")) - F.col("_c"))  # `bins` rows a rank
        found = upto.join(F.broadcast(open_.select("_t", "_k")) if n <= few else open_.select("_t", "_k"), "_t").where("_before <= _k and _k < _before + _c")
        found, found_at = kept(found.select("_t", (F.col("_k") - F.col("_before")).alias("_k2"), "_l", "_m"))
        after, after_at = kept(looked_up(state, ["_t"], found, few).withColumns({"_k": F.coalesce("_k2", "_k"), "_lo": F.coalesce("_l", "_lo"), "_hi": F.coalesce("_m", "_hi")}).drop("_k2", "_l", "_m"))
        gone(spark, path)
        gone(spark, found_at)
        state, path = after, after_at
    gone(spark, held_at)
    low, high = (F.max(F.when(F.col("_side") == k, F.col("_lo"))) for k in (0, 1))
    ends = state.groupBy("_h", *keys, "share", "_n").agg(low.alias("_a"), high.alias("_z"))
    part = at - F.floor(at)
    return ends.select(*keys, "share", (F.col("_a") + (F.col("_z") - F.col("_a")) * part).alias("quantile"))


def residual_metrics_of_any_size(errors: DataFrame, keys: list[str], err: str, *, most: int = 1_000_000, few: int = FEW) -> DataFrame:
    """residual_metrics() where groups of over `most` rows get their median and 95th percentile from quantiles(): errors is staged, keys are not null."""
    e = F.col(err)
    base, _ = kept(errors.groupBy(*keys).agg(F.count(e).alias("n"), F.sqrt(F.avg(e * e)).alias("rms")))
    large = base.where(F.col("n") > most).select(*keys)
    if not large.limit(1).count():
        return residual_metrics(errors, keys, err)
    large, _ = kept(large.withColumn("_large", F.lit(True)))
    told = looked_up(errors, keys, large, few)
    small = residual_metrics(told.where("_large is null"), keys, err).select(*keys, "median", "p95")
    q = quantiles(told.where("_large"), keys, err, [0.5, 0.95], few=few)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(c) for s, c in ((0.5, "median"), (0.95, "p95"))])
    return base.join(small.unionByName(wide), keys, "left").select(*keys, "n", "rms", "median", "p95")


def pair_scores(agreement: DataFrame, keys: list[str], ncc: str = "ncc", overlap: str = "overlap") -> DataFrame:
    """n_pairs_scored, mean_overlap_ncc, min_overlap_ncc, mean_overlap_frac: every pair weighs the same."""
    return agreement.groupBy(*keys).agg(F.count("*").alias("n_pairs_scored"), F.avg(ncc).alias("mean_overlap_ncc"), F.min(ncc).alias("min_overlap_ncc"), F.avg(overlap).alias("mean_overlap_frac"))


def pooled_errors(pairs: DataFrame, errors: str, keys: list[str]) -> DataFrame:
    """keys, err: the errors of all pairs (an array a pair) as one pool; null arrays have none."""
    return pairs.select(*keys, F.explode(errors).alias("err"))


def overlap_fraction(pixels: Column, width: Column, height: Column) -> Column:
    """Mask pixels as a share of the frame that they lie in; 0 for an empty frame."""
    return F.coalesce(F.try_divide(pixels.cast("double"), width.cast("double") * height.cast("double")), F.lit(0.0))


def coverage(mask: Column) -> Column:
    """The share of a canvas's pixels that are set, as an aggregate; unset: null, false or 0."""
    return F.avg(F.coalesce((mask > 0).cast("double"), F.lit(0.0)))


def content_box(pixels: DataFrame, keys: list[str], x: Column, y: Column, grey: Column, width: Column, height: Column, pad: int = 0) -> DataFrame:
    """keys, x0, x1, y0, y1: the box of pixels that aren't black, `pad` wider, inside the picture; the whole picture if all are black."""
    lit = grey > 0
    b = pixels.groupBy(*keys).agg(*[f(F.when(lit, c)).alias(n) for n, f, c in (("_x0", F.min, x), ("_x1", F.max, x), ("_y0", F.min, y), ("_y1", F.max, y))], F.max(width).alias("_w"), F.max(height).alias("_h"))
    low = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c) - pad, F.lit(0)))
    high = lambda c, n: F.least(F.col(n), F.coalesce(F.col(c) + 1 + pad, F.col(n)))
    return b.select(*keys, low("_x0").alias("x0"), high("_x1", "_w").alias("x1"), low("_y0").alias("y0"), high("_y1", "_h").alias("y1"))


def local_agreement(pixels: DataFrame, keys: list[str], covered: Column, a: Column, b: Column, share: float = 0.9) -> DataFrame:
    """keys (a window), ncc: correlation in windows of which `share` is covered at least; null in others, 0 without variance."""
    on = F.coalesce(covered.cast("double"), F.lit(0.0))
    return pixels.groupBy(*keys).agg(F.when(F.avg(on) >= share, guarded_correlation(a, b)).alias("ncc"))


def local_summary(windows: DataFrame, keys: list[str], good: float = 0.4) -> DataFrame:
    """Of windows that count (ncc not null): how many, median, p10, p90, and the share above `good`."""
    n = F.col("ncc")
    return windows.groupBy(*keys).agg(F.count(n).alias("windows"), *[F.percentile(n, F.lit(q)).alias(c) for q, c in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))], F.avg((n > good).cast("double")).alias("share_good"))


def area_ratio(width: Column, height: Column, first_width: Column, first_height: Column) -> Column:
    """How many times a picture is as large as one of its inputs, to two places; above 1, something was joined."""
    return F.round(F.try_divide((width * height).cast("double"), (first_width * first_height).cast("double")), 2)
