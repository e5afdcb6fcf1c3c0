"""The tables behind figures; drawing itself is left to the reader's tool."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.functions.codes import padded_area, zero_padded
from panelmill.functions.safe import ratio
from panelmill.operators.joins import null_safe_merge
from panelmill.operators.quantiles import exact_quantiles
from panelmill.operators.scaling import share_of_total
from panelmill.session import reused


def _with_box(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    df = reused(df)
    box = exact_quantiles(df, x, [0.25, 0.5, 0.75], by)
    q = F.col("quantiles")
    reach = 1.5 * (q[2] - q[0])
    box = box.select(
        *by, q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"),
        (q[0] - reach).alias("__low"), (q[2] + reach).alias("__high"),
    )
    return null_safe_merge(df.where(F.col(x).isNotNull()), box, by)


def box_stats(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (furthest values within 1.5 box lengths) and the number of outliers."""
    inside = F.col(x).between(F.col("__low"), F.col("__high"))
    return (
        _with_box(df, x, by)
        .groupBy(*by)
        .agg(
            F.min(F.when(inside, F.col(x))).alias("low"), F.first("q1").alias("q1"),
            F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.max(F.when(inside, F.col(x))).alias("high"),
            F.count(F.when(~inside, F.lit(1))).alias("outliers"), F.count(F.lit(1)).alias("n"),
        )
    )


def box_outliers(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """The rows beyond the whiskers."""
    beyond = ~F.col(x).between(F.col("__low"), F.col("__high"))
    return _with_box(df, x, by).where(beyond).drop("q1", "median", "q3", "__low", "__high")


def density_bandwidth(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    """(by..., n, bandwidth): 0.9 * min(sd, IQR / 1.34) * n^-0.2 per class."""
    q = F.col("quantiles")
    stats = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(x).alias("__sd"))
    stats = null_safe_merge(stats, exact_quantiles(df, x, [0.25, 0.75], by), by)
    iqr = (q[1] - q[0]) / 1.34
    spread = F.when(iqr > 0, F.least("__sd", iqr)).otherwise(F.col("__sd"))
    return stats.select(*by, "n", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


def density(df: DataFrame, x: str, by: Sequence[str], points: int = 512) -> DataFrame:
    """(by..., x, density): Gaussian kernel density on ``points`` grid values over the whole range.

    Each value is shared between its two neighbouring grid points, so rows shrink to at most
    ``points`` masses per class in one aggregation; the kernel is then summed over the masses.
    """
    df = reused(df)
    rows = df.select(*by, F.col(x).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    span = rows.agg(F.min("__v").alias("lo"), F.max("__v").alias("hi")).select(F.struct("lo", "hi")).scalar()
    low, step = F.col("__span.lo"), (F.col("__span.hi") - F.col("__span.lo")) / (points - 1)
    rows = rows.withColumn("__span", span)
    at = ratio(F.col("__v") - low, step)
    left = F.least(F.floor(at), F.lit(points - 2))
    pieces = F.array(F.struct(left.alias("i"), (1 - (at - left)).alias("m")), F.struct((left + 1).alias("i"), (at - left).alias("m")))
    masses = rows.select(*by, F.explode(pieces).alias("p")).groupBy(*by, F.col("p.i").alias("i")).agg(F.sum("p.m").alias("mass"))
    spread = null_safe_merge(masses, density_bandwidth(df, x, by), by)
    on_grid = spread.withColumn("__span", span).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = ratio((F.col("g") - F.col("i")) * step, "bandwidth")
    kernel = F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    height = ratio(F.sum(F.col("mass") * kernel), F.first("n") * F.first("bandwidth"))
    summed = on_grid.groupBy(*by, "g").agg(height.alias("density")).withColumn("__span", span)
    return summed.select(*by, (low + F.col("g") * step).alias("x"), "density")


def map_table(df: DataFrame, value: str, state: str, area: str | None = None, where: Column | None = None) -> DataFrame:
    """(fips, value): two-digit state or five-digit area keys."""
    key = padded_area(state, area) if area else zero_padded(state, 2)
    chosen = df if where is None else df.where(where)
    return chosen.select(key.alias("fips"), F.col(value).alias("value"))


def mean_bars(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(x).alias("height"))


def error_bars(coefficients: DataFrame, width: float = 2.0) -> DataFrame:
    """Estimate series with bars of ``width`` standard errors to both sides."""
    reach = width * F.col("std_error")
    return coefficients.withColumns({"bar_low": F.col("estimate") - reach, "bar_high": F.col("estimate") + reach})


def scatter(df: DataFrame, x: str, y: str, **roles: str) -> DataFrame:
    """(x, y, roles...): roles such as size, colour or facet map to columns."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), *[F.col(c).alias(r) for r, c in roles.items()])


def histogram(df: DataFrame, x: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, n, share): bins start at the overall minimum; shares are of the class total."""
    df = reused(df)
    low = df.agg(F.min(x)).scalar()
    cells = df.where(F.col(x).isNotNull()).groupBy(*by, F.floor((F.col(x) - low) / width).cast("long").alias("bin"))
    return share_of_total(cells.agg(F.count(F.lit(1)).alias("n")), "n", by, "share")


def roc_points(df: DataFrame, score: str, label: str, steps: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cutoff, tpr, fpr) for the cut-offs 0, 1/steps, ..., 1; a row is guessed 1 above the cut-off.

    Rows are counted once by the number of cut-offs below their score; running sums over that small
    table give every cut-off's counts, instead of one pass or one copy of the data per cut-off.
    """
    s = F.col(score).cast("double")
    # First estimate from multiplication, then corrected by exact comparison with the cut-offs.
    near = F.ceil(s * steps)
    near = near + F.when(near / steps < s, 1).otherwise(0) - F.when((near - 1) / steps >= s, 1).otherwise(0)
    below = F.greatest(F.lit(0), F.least(near, F.lit(steps + 1))).cast("long")
    pos, neg = F.count(F.when(F.col(label) == 1, F.lit(1))), F.count(F.when(F.col(label) == 0, F.lit(1)))
    counts = df.where(s.isNotNull()).groupBy(*by, below.alias("k")).agg(pos.alias("p"), neg.alias("q"))
    counts = reused(counts)
    totals = counts.groupBy(*by).agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    # An entry for every cut-off index, so that each group has all steps + 1 of them.
    cut_offs = F.sequence(F.lit(0).cast("long"), F.lit(steps + 1).cast("long"))
    every = totals.select(*by, F.explode(cut_offs).alias("k"), F.lit(0).alias("p"), F.lit(0).alias("q"))
    filled = counts.unionByName(every).groupBy(*by, "k").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    above = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col("k").desc())
    run = filled.withColumns({"p": F.sum("p").over(above), "q": F.sum("q").over(above)})
    if by:
        run = null_safe_merge(run, totals, by)
    else:
        one = totals.select(F.struct("__p", "__q")).scalar()
        run = run.withColumn("__one", one).withColumns({"__p": F.col("__one.__p"), "__q": F.col("__one.__q")})
    return run.where(F.col("k") > 0).select(
        *by, ((F.col("k") - 1) / steps).alias("cutoff"), ratio("p", "__p").alias("tpr"), ratio("q", "__q").alias("fpr")
    )


def auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc): trapezoids under the highest true-positive rate at each false-positive rate."""
    best = points.groupBy(*by, "fpr").agg(F.max("tpr").alias("tpr"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("fpr")
    area = (F.col("fpr") - F.lag("fpr").over(w)) * (F.col("tpr") + F.lag("tpr").over(w)) / 2
    return best.withColumn("__a", area).groupBy(*by).agg(F.sum("__a").alias("auc"))


def half_split(df: DataFrame, key: str, label: str, replicates: int = 1, seed: int = 0) -> DataFrame:
    """Rows repeated per ``replicate`` with ``in_sample`` true for half of each label's rows.

    Membership follows from a hash of key, replicate and seed, so it is the same on every run. The
    cut is the exact rank cut of the hash, found by the quantile operator rather than a sort per label.
    """
    draw = F.conv(F.left(F.md5(F.concat_ws("-", F.col(key), F.col("replicate"), F.lit(seed))), F.lit(13)), 16, 10)
    numbers = F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))
    rows = df.withColumn("replicate", F.explode(numbers))
    rows = rows.withColumn("__draw", draw.cast("double"))
    groups = ["replicate", label]
    # Half of n, halves to even, then the gap between that rank and the next one.
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).withColumn("__half", F.bround(F.col("__n") / 2))
    numbered = _rank_cut(rows, groups, sizes)
    return null_safe_merge(rows, numbered, groups).withColumn("in_sample", F.col("__draw") < F.col("__cut")).drop("__draw", "__cut")


def _rank_cut(rows: DataFrame, groups: list[str], sizes: DataFrame) -> DataFrame:
    """The draw of rank ``__half`` (counted from 0) of each group; draws below it are the sample.

    The middle ranks of a group lie within one of its median, so the median's two neighbours decide.
    """
    middle = exact_quantiles(rows, "__draw", [0.5], groups)
    known = null_safe_merge(middle, sizes, groups)
    split = null_safe_merge(rows, known, groups)
    low = F.col("__draw") < F.col("quantiles")[0]
    counted = split.groupBy(*groups).agg(
        F.count(F.when(low, F.lit(1))).alias("__below"), F.first("__half").alias("__half"),
        F.min(F.when(F.col("__draw") > F.col("quantiles")[0], F.col("__draw"))).alias("__next"),
        F.first(F.col("quantiles")[0]).alias("__mid"),
    )
    # An odd group has the median among its draws: it joins the sample when the rounded half says so.
    cut = F.when(F.col("__half") > F.col("__below"), F.coalesce(F.col("__next"), F.lit(float("inf")))).otherwise(F.col("__mid"))
    return counted.select(*groups, cut.alias("__cut"))
