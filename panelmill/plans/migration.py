"""Migration flows, hub classes and the propensity to move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.safe import flag
from panelmill.functions.weighted import wmean, wshare
from panelmill.models.design import design
from panelmill.models.logit import fit_logit
from panelmill.operators.joins import with_role
from panelmill.operators.panel import attach_base, log_change_prev
from panelmill.operators.scaling import above_quantile, share_of_total, zscore
from panelmill.session import reused


def net_migration(
    persons: DataFrame, time: str, dest: str, origin: str, weight: str, score: str, base: int
) -> DataFrame:
    """Per destination and period: inflow, outflow, net flow, size and exposure, with base-period values.

    Persons shrink to (time, destination, origin) flows; both directions are regroupings of that table.
    """
    moved = F.when(F.col(dest) != F.col(origin), F.col(weight)).otherwise(0.0)
    flows = persons.where(F.col(dest).isNotNull() & F.col(origin).isNotNull()).groupBy(time, dest, origin).agg(
        F.sum(moved).alias("moved"), F.sum(weight).alias("num"), wmean(score, weight).alias("score")
    )
    flows = reused(flows)
    out = flows.groupBy(time, F.col(origin).alias("place")).agg(F.sum("moved").alias("outflow"))
    into = flows.groupBy(time, F.col(dest).alias("place")).agg(
        F.sum("moved").alias("inflow"), wmean("score", "num").alias("score"), F.sum("num").alias("num")
    )
    both = into.join(out, [time, "place"]).withColumn("net", F.col("inflow") - F.col("outflow"))
    both = attach_base(both, ["place"], time, base, score_base="score", pop_base="num")
    return log_change_prev(both, ["place"], time, del_net="net")


def hub_classes(persons: DataFrame, area: str, time: str, weight: str, skilled: Column, q: float = 0.5) -> DataFrame:
    """(area, time, frac, hub): areas above the period's quantile of the skilled share are hubs."""
    share = persons.groupBy(area, time).agg(wshare(skilled, weight).alias("frac"))
    marked = above_quantile(share, "frac", q, "hub", [time])
    return marked.withColumn("hub", F.when(F.col("hub"), "Skill Hub").otherwise("Not"))


def hub_flows(
    persons: DataFrame, classes: DataFrame, area: str, time: str, dest: str, origin: str, weight: str,
    extra: Sequence[str] = (), keys: Sequence[str] = ("source", "sink"), share_within: Sequence[str] = (),
    origin_lag: int = -1, where: Column | None = None,
) -> DataFrame:
    """Weight and share of movers by class of the place left and the place reached.

    The origin's class is that of the period ``-origin_lag`` later, since the class table's period
    is moved by ``origin_lag`` before the join; pass 0 for the same period.
    """
    movers = persons.where(F.col(dest) != F.col(origin))
    if where is not None:
        movers = movers.where(where)
    classes = reused(classes)
    # Cells first: the two class joins then run over places and periods, not over persons.
    cells = movers.groupBy(time, dest, origin, *extra).agg(F.sum(weight).alias("weight"))
    sink = with_role(classes, area, dest, sink="hub", **{time: time})
    source = with_role(classes, area, origin, source="hub", **{time: time}).withColumn(time, F.col(time) + origin_lag)
    flows = cells.join(sink, [dest, time]).join(source, [origin, time])
    sums = flows.groupBy(time, *keys, *extra).agg(F.sum("weight").alias("weight"))
    return share_of_total(sums, "weight", [time, *share_within], "frac")


def place_shares(persons: DataFrame, classes: DataFrame, area: str, time: str, weight: str, extra: Sequence[str]) -> DataFrame:
    """Population by class of the place and ``extra``, as shares of the period."""
    cells = persons.groupBy(area, time, *extra).agg(F.sum(weight).alias("weight"))
    sums = cells.join(classes.select(area, time, "hub"), [area, time]).groupBy(time, "hub", *extra)
    return share_of_total(sums.agg(F.sum("weight").alias("weight")), "weight", [time], "frac")


def mover_share(persons: DataFrame, time: str, weight: str, moved: Column) -> DataFrame:
    return persons.groupBy(time).agg(wshare(moved, weight).alias("mig_frac"))


def place_scores(persons: DataFrame, place: str, time: str, score: str, weight: str) -> DataFrame:
    """Weighted exposure per place, standardised within each period."""
    return zscore(persons.groupBy(place, time).agg(wmean(score, weight).alias("exposure")), [time], exposure_z="exposure")


def mover_rows(
    persons: DataFrame, scores: DataFrame, place: str, time: str, dest: str, origin: str, role: str = "prev",
    college: Column | None = None,
) -> DataFrame:
    """Person rows with the mover flag and the standardised exposure of one of their places."""
    key = origin if role == "prev" else dest
    dim = with_role(scores, place, key, **{f"{role}_exposure": "exposure_z", time: time})
    rows = persons.where(F.col(origin).isNotNull()).join(dim, [key, time])
    rows = rows.withColumn("mig", flag(F.col(dest) != F.col(origin)))
    return rows if college is None else rows.withColumn("col", flag(college))


def move_propensity(rows: DataFrame, exposure: str, controls: Sequence[str], cluster: str, factors=None, by: Sequence[str] = ()):
    """Clustered logit of moving on exposure times college, for all rows or for each group."""
    d = design("mig", *controls, f"{exposure}*col", factors=factors)
    return fit_logit(rows, d, by=by, cluster=cluster, patterns=True)


def move_rates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("mig").alias("mig"))

