"""Epidemic-style exploration queries.

Plan notes. I-E2..I-E4 are single grouped aggregates (partial + final).
I-E5's running total per location is computed with ``keyed_running``
(plans/prefix.py): the window runs per (location, month) and a per-month
offset is added back, so one location with most of the rows is still spread
over many tasks. RANGE semantics are kept (rows on the same date share the
value), like the SQL default frame of the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.aggs import money_div
from quarry.functions.scalar import pct
from quarry.plans.prefix import keyed_running

RATIO_DIGITS = 6


def _r(c):
    return F.round(c, RATIO_DIGITS)


def _like_ci(col: str, pattern: str):
    """SQL Server default collation: LIKE is case-insensitive."""
    return F.lower(F.col(col)).like(pattern.lower())


def mortality_rate(deaths: DataFrame, location_like: str = "%states%") -> DataFrame:
    """I-E1: (total_deaths / total_cases) * 100 for matching locations with a continent."""
    return (deaths.where(_like_ci("location", location_like) & F.col("continent").isNotNull())
            .select("continent", "location", "date", "total_cases", "total_deaths",
                    _r(pct(F.col("total_deaths").cast("double"), F.col("total_cases"))).alias("mortality_rate"))
            .orderBy("continent", "location"))


def prevalence(deaths: DataFrame, location_like: str = "%states%") -> DataFrame:
    """I-E1: (total_cases / population) * 100 for matching locations with a continent."""
    return (deaths.where(_like_ci("location", location_like) & F.col("continent").isNotNull())
            .select("continent", "location", "date", "total_cases", "population",
                    money_div(F.col("total_cases") * 100, F.col("population").cast("long"), RATIO_DIGITS).alias("prevalence"))
            .orderBy("continent", "location"))


def peak_prevalence(deaths: DataFrame) -> DataFrame:
    """I-E2: highest case count and prevalence per (location, population), ranked (D3)."""
    return (deaths.where(F.col("continent").isNotNull())
            .groupBy("population", "location", "continent")
            .agg(F.max("total_cases").alias("highest_infection_count"),
                 _r(F.max(F.try_divide(F.col("total_cases"), F.col("population").cast("double"))) * 100)
                 .alias("prevalence"))
            .orderBy(F.desc("prevalence")))


def max_deaths_by(deaths: DataFrame, by: str) -> DataFrame:
    """I-E3: ``MAX(total_deaths)`` per location or continent."""
    return (deaths.where(F.col("continent").isNotNull())
            .groupBy(by).agg(F.max(F.col("total_deaths").cast("long")).alias("total_death_count"))
            .orderBy(F.desc("total_death_count")))


def global_numbers(deaths: DataFrame) -> DataFrame:
    """I-E4: total cases, total deaths and death percentage."""
    d = deaths.where(F.col("continent").isNotNull())
    cases = F.sum("new_cases")
    dead = F.sum(F.col("new_deaths").cast("long"))
    return d.agg(cases.alias("total_cases"), dead.cast("long").alias("total_deaths"),
                 _r(pct(dead.cast("double"), cases)).alias("death_percentage"))


def rolling_vaccinations(deaths: DataFrame, vaccinations: DataFrame, continent_required: bool = True) -> DataFrame:
    """I-E5: deaths ⨝ vaccinations on (location, date), running vaccinations per location, % of population.

    ``continent_required=False`` is the temp-table variant that drops the
    continent filter (Q13). The result is what the reference stores as a temp
    table / view (A5, A6): register it with ``createOrReplaceTempView``.
    """
    d = deaths.select("continent", "location", "date", "population")
    if continent_required:
        d = d.where(F.col("continent").isNotNull())
    j = d.join(vaccinations.select("location", "date", "new_vaccinations"), ["location", "date"])
    run = keyed_running(j, ["location"], order=["date"],
                        sums={"rolling_people_vaccinated": F.col("new_vaccinations").cast("long")}, frame="range")
    return run.select(
        "continent", "location", "date", "population", "new_vaccinations", "rolling_people_vaccinated",
        money_div(F.col("rolling_people_vaccinated") * 100, F.col("population").cast("long"), RATIO_DIGITS)
        .alias("percent_vaccinated")).orderBy("location", "date")


def register_view(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``CREATE VIEW name AS ...`` - a session temp view over the lazy plan."""
    df.createOrReplaceTempView(name)
    return spark.table(name)
