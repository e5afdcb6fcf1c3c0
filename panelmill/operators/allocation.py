"""Spreading unit measures over areas and summing them over neighbouring areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import ratio, strict
from panelmill.session import reused


def allocate(
    measures: DataFrame,
    unit_areas: DataFrame,
    unit: str,
    value: str,
    areas: Sequence[str],
    detail: Sequence[str] = (),
    keep_unit: bool = False,
) -> DataFrame:
    """Split each unit's measure evenly over its area rows and sum by area.

    Equal to dividing every row of the many-to-many join by the row count of its
    ``(unit, detail)`` group, but both sides are reduced first, so that one large unit neither
    fills a window partition nor multiplies raw rows.
    """
    per_unit = measures.groupBy(unit, *detail).agg(F.sum(value).alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    per_area = reused(unit_areas.groupBy(unit, *areas).agg(F.count(F.lit(1)).alias("__times")))
    fan_out = per_area.groupBy(unit).agg(F.sum("__times").alias("__fan"))
    spread = per_unit.join(fan_out, unit).join(per_area, unit)
    part = ratio(F.col("__sum") * F.col("__times"), F.col("__rows") * F.col("__fan"))
    keys = [*([unit] if keep_unit else []), *areas, *detail]
    return spread.groupBy(*keys).agg(F.sum(part).alias(value))


def neighbour_totals(
    measures: DataFrame,
    edges: DataFrame,
    area: Sequence[str],
    neighbour: Sequence[str],
    kind: str,
    value: str,
    size: str,
    distinct_sizes: bool = True,
    complete: bool = True,
) -> DataFrame:
    """Totals of ``value`` and ``size`` over each area's neighbours, and their ratio.

    ``distinct_sizes`` counts equal sizes of different neighbours once; ``complete`` makes a total
    null when a neighbour has no measure.
    """
    renamed = measures.select(*[F.col(a).alias(n) for a, n in zip(area, neighbour)], kind, value, size)
    joined = edges.join(reused(renamed), list(neighbour), "left")
    total = (lambda c: strict(F.sum, c)) if complete else F.sum
    by_kind = joined.groupBy(*area, kind).agg(total(F.col(value)).alias(f"{value}_adj"))
    one_each = joined.select(*area, *([] if distinct_sizes else neighbour), size).distinct()
    sizes = one_each.groupBy(*area).agg(total(F.col(size)).alias(f"{size}_adj"))
    return by_kind.join(sizes, list(area)).withColumn(f"{value}_per_{size}", ratio(f"{value}_adj", f"{size}_adj"))
