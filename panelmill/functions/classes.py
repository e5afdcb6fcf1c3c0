"""Standing classifications of survey codes, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.codes import ladder, threshold_ladder
from panelmill.functions.safe import as_col, flag
from panelmill.sources.tables import literal_table

# Fixed values ------------------------------------------------------------------------------------

# Highest industry code of each broad class, in code order; codes above the last one are military.
BROAD_INDUSTRIES = [
    (32, "Agg"),
    (50, "Mining"),
    (60, "Construction"),
    (392, "MANUFACTURING"),
    (472, "Transportation"),
    (572, "Trade_Wholesale"),
    (691, "Trade_Retail"),
    (712, "Finance"),
    (760, "Business"),
    (791, "Services_Personal"),
    (810, "Services_Entertainment"),
    (893, "Services_Professional"),
    (932, "Public_Admin"),
]
LAST_BROAD_INDUSTRY = "Military"
# Industry codes that name no industry.
NO_INDUSTRY = [0, 992, 999]
# First code of each sector and the first code after it.
SECTORS = {"man_con": (60, 400), "transportation": (400, 500), "trade": (500, 700), "public": (900, 940)}
# Occupation code of the unemployed, whose exposure is zero.
UNEMPLOYED = 9920
# School grades and their points.
GRADE_POINTS = [
    ("A or A+", 4.0), ("A-", 3.7), ("B+", 3.3), ("B", 3.0), ("B-", 2.7), ("C+", 2.3), ("C", 2.0), ("C-", 1.7),
    ("D+", 1.3), ("D", 1.0), ("F", 0.0),
]
STEM_MAJORS = ["Mathematics or Statistics", "Engineering", "Biological & Life Sciences", "Physical Science"]
STEM_DEGREE_FIELDS = [24, 25, 36, 37, 50, 51, 57]
STEM_PROGRAMMES = [14, 15, 26, 27, 40, 41]
STEM_MAJOR_CODES = [21, 24, 25, 36, 37, 50, 51]
FAR_FROM_HOME = ["More than 500", "101 to 500", "51 to 100"]
# Origin-state codes that name no state.
NO_ORIGIN_STATE = [0, 91, 99]
# Residence codes of persons who moved between areas.
MOVED_AREA = [4, 5]
# Consumer price index of 2000 over that of 1980.
PRICE_RATIO_2000_1980 = 172 / 82.4

# Classifications ----------------------------------------------------------------------------------


def broad_industry(code: str | Column) -> Column:
    """Broad class of an industry code; null for codes that name no industry."""
    code = as_col(code)
    return F.when(~code.isin(NO_INDUSTRY), threshold_ladder(code, BROAD_INDUSTRIES, LAST_BROAD_INDUSTRY))


def sector_flags(code: str | Column) -> dict[str, Column]:
    """0/1 columns of the sectors used as controls, for ``withColumns``."""
    code = as_col(code)
    return {name: flag((code >= low) & (code < high)) for name, (low, high) in SECTORS.items()}


def schooling(code: str | Column) -> Column:
    """College, some college or none, from the labour-force survey's education code."""
    code = as_col(code)
    return F.when(code.isNotNull(), ladder([(code < 80, "No College"), (code < 110, "Some College")], "College"))


def degree_type(education: str | Column, field: str | Column) -> Column:
    """no_college, no_deg, STEM or not_STEM."""
    education, field = as_col(education), as_col(field)
    return ladder(
        [(education < 7, "no_college"), (field == 0, "no_deg"), (field.isin(STEM_DEGREE_FIELDS), "STEM")], "not_STEM"
    )


def is_stem_major(major: str | Column) -> Column:
    """1.0 for the listed majors, 0.0 for all others and for no answer."""
    return F.coalesce(flag(as_col(major).isin(STEM_MAJORS)), F.lit(0.0))


def programme_type(code: str | Column) -> Column:
    return F.when(as_col(code).isin(STEM_PROGRAMMES), "STEM").otherwise("not_STEM")


def is_far(distance: str | Column) -> Column:
    return F.coalesce(flag(as_col(distance).isin(FAR_FROM_HOME)), F.lit(0.0))


def census_year(period: str | Column) -> Column:
    """Census year a five-year period is compared with."""
    period = as_col(period)
    return ladder([(period.isin(1975, 1980), 1980), (period.isin(1985, 1990), 1990), (period.isin(1995, 2000), 2000)], 2010)


def grade_points(spark: SparkSession, grade: str = "grade", points: str = "points") -> DataFrame:
    return literal_table(spark, GRADE_POINTS, f"{grade} string, {points} double")


def moved_between_states(origin: str | Column, residence: str | Column, none: Sequence[int] = tuple(NO_ORIGIN_STATE)) -> Column:
    """True for persons whose origin is a known state other than the one they live in."""
    origin = as_col(origin)
    return (origin != as_col(residence)) & ~origin.isin(list(none))
