"""Registered cleaning (I-DC*) and exploration (I-E*) queries."""

from __future__ import annotations

from quarry.functions.aggs import sql_money_div
from quarry.operators import cleaning, exploration
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources.fixture_sql import with_fixtures

FILLED_SQL = """
filled AS (
  SELECT h.UniqueID, h.ParcelID, coalesce(h.PropertyAddress, p.peer) AS PropertyAddress, h.SaleDate, h.SalePrice,
         h.LegalReference, h.SoldAsVacant, h.OwnerAddress, h.TaxDistrict, CAST(h.SaleDate AS DATE) AS SaleDateConverted
  FROM housing h LEFT JOIN (
    SELECT ParcelID, arg_min(PropertyAddress, UniqueID) AS peer FROM housing
    WHERE PropertyAddress IS NOT NULL GROUP BY ParcelID) p ON h.ParcelID = p.ParcelID)"""

SPLIT_SQL = FILLED_SQL + """,
split AS (
  SELECT *,
    CASE WHEN strpos(PropertyAddress, ',') > 0 THEN split_part(PropertyAddress, ',', 1) ELSE PropertyAddress END AS PropertySplitAddress,
    CASE WHEN strpos(PropertyAddress, ',') > 0 THEN substr(PropertyAddress, strpos(PropertyAddress, ',') + 1) ELSE PropertyAddress END AS PropertySplitCity,
    CASE WHEN len(string_split(replace(OwnerAddress, ',', '.'), '.')) <= 4
         THEN nullif(string_split(replace(OwnerAddress, ',', '.'), '.')[-3], '') END AS OwnerSplitAddress,
    CASE WHEN len(string_split(replace(OwnerAddress, ',', '.'), '.')) <= 4
         THEN nullif(string_split(replace(OwnerAddress, ',', '.'), '.')[-2], '') END AS OwnerSplitCity,
    CASE WHEN len(string_split(replace(OwnerAddress, ',', '.'), '.')) <= 4
         THEN nullif(string_split(replace(OwnerAddress, ',', '.'), '.')[-1], '') END AS OwnerSplitState
  FROM filled)"""


@register("idc1_standardize_date", with_fixtures(
    "SELECT UniqueID, SaleDate, CAST(SaleDate AS DATE) AS SaleDateConverted FROM housing", "housing"))
def idc1_standardize_date(spark, sf):
    return cleaning.standardize_date(fx.housing(spark, sf)).select("UniqueID", "SaleDate", "SaleDateConverted")


@register("idc2_fill_from_peer", with_fixtures(
    "SELECT UniqueID, ParcelID, PropertyAddress FROM filled", "housing", extra=FILLED_SQL))
def idc2_fill_from_peer(spark, sf):
    return cleaning.fill_from_peer(fx.housing(spark, sf), "ParcelID", "PropertyAddress", "UniqueID") \
        .select("UniqueID", "ParcelID", "PropertyAddress")


@register("idc3_split_addresses", with_fixtures("""
SELECT UniqueID, PropertySplitAddress, PropertySplitCity, OwnerSplitAddress, OwnerSplitCity, OwnerSplitState
FROM split""", "housing", extra=SPLIT_SQL))
def idc3_split_addresses(spark, sf):
    h = cleaning.fill_from_peer(fx.housing(spark, sf), "ParcelID", "PropertyAddress", "UniqueID")
    return cleaning.split_addresses(h).select("UniqueID", "PropertySplitAddress", "PropertySplitCity",
                                              "OwnerSplitAddress", "OwnerSplitCity", "OwnerSplitState")


@register("idc4_vacant_frequency", with_fixtures("""
SELECT CASE SoldAsVacant WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE SoldAsVacant END AS SoldAsVacant, count(*) AS n
FROM housing GROUP BY 1 ORDER BY 2""", "housing"))
def idc4_vacant_frequency(spark, sf):
    return cleaning.value_frequency(cleaning.recode_vacant(fx.housing(spark, sf)), "SoldAsVacant")


@register("idc5_clean_sales", with_fixtures("""
SELECT UniqueID, ParcelID, SalePrice, LegalReference, sv AS SoldAsVacant, SaleDateConverted, PropertySplitAddress,
       PropertySplitCity, OwnerSplitAddress, OwnerSplitCity, OwnerSplitState
FROM (
  SELECT *, CASE SoldAsVacant WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' ELSE SoldAsVacant END AS sv,
         row_number() OVER (PARTITION BY ParcelID, PropertyAddress, SalePrice, SaleDate, LegalReference
                            ORDER BY UniqueID) AS row_num
  FROM split) t
WHERE row_num = 1""", "housing", extra=SPLIT_SQL))
def idc5_clean_sales(spark, sf):
    """I-DC1..I-DC6 chained; the result has the unused columns dropped."""
    return cleaning.clean_sales(fx.housing(spark, sf))


def _deaths(spark, sf):
    return fx.covid_deaths(spark, sf)


LOCATION_PATTERN = "%nation_1%"  # fixture locations are NATION_<n>; '%states%' matches none


@register("ie1_mortality_rate", with_fixtures(f"""
SELECT continent, location, date, total_cases, total_deaths,
       round(CAST(total_deaths AS DOUBLE) / nullif(total_cases, 0) * 100, 6) AS mortality_rate
FROM covid_deaths WHERE lower(location) LIKE '{LOCATION_PATTERN}' AND continent IS NOT NULL ORDER BY 1, 2""",
                                             "covid_deaths"))
def ie1_mortality_rate(spark, sf):
    return exploration.mortality_rate(_deaths(spark, sf), LOCATION_PATTERN)


@register("ie1_prevalence", with_fixtures(f"""
SELECT continent, location, date, total_cases, population,
       {sql_money_div('total_cases * 100', 'population', 6)} AS prevalence
FROM covid_deaths WHERE lower(location) LIKE '{LOCATION_PATTERN}' AND continent IS NOT NULL ORDER BY 1, 2""",
                                         "covid_deaths"))
def ie1_prevalence(spark, sf):
    return exploration.prevalence(_deaths(spark, sf), LOCATION_PATTERN)


@register("ie2_peak_prevalence", with_fixtures("""
SELECT population, location, continent, max(total_cases) AS highest_infection_count,
       round(max(total_cases / nullif(CAST(population AS DOUBLE), 0)) * 100, 6) AS prevalence
FROM covid_deaths WHERE continent IS NOT NULL GROUP BY population, location, continent ORDER BY prevalence DESC""",
                                              "covid_deaths"))
def ie2_peak_prevalence(spark, sf):
    return exploration.peak_prevalence(_deaths(spark, sf))


@register("ie3_max_deaths_by_location", with_fixtures("""
SELECT location, max(CAST(total_deaths AS BIGINT)) AS total_death_count FROM covid_deaths
WHERE continent IS NOT NULL GROUP BY location ORDER BY total_death_count DESC""", "covid_deaths"))
def ie3_max_deaths_by_location(spark, sf):
    return exploration.max_deaths_by(_deaths(spark, sf), "location")


@register("ie3_max_deaths_by_continent", with_fixtures("""
SELECT continent, max(CAST(total_deaths AS BIGINT)) AS total_death_count FROM covid_deaths
WHERE continent IS NOT NULL GROUP BY continent ORDER BY total_death_count DESC""", "covid_deaths"))
def ie3_max_deaths_by_continent(spark, sf):
    return exploration.max_deaths_by(_deaths(spark, sf), "continent")


@register("ie4_global_numbers", with_fixtures("""
SELECT sum(new_cases) AS total_cases, CAST(sum(CAST(new_deaths AS BIGINT)) AS BIGINT) AS total_deaths,
       round(CAST(sum(CAST(new_deaths AS BIGINT)) AS DOUBLE) / nullif(sum(new_cases), 0) * 100, 6) AS death_percentage
FROM covid_deaths WHERE continent IS NOT NULL""", "covid_deaths"))
def ie4_global_numbers(spark, sf):
    return exploration.global_numbers(_deaths(spark, sf))


def _rolling_sql(continent_filter: bool) -> str:
    where = "WHERE dea.continent IS NOT NULL" if continent_filter else ""
    return with_fixtures(f"""
SELECT *, {sql_money_div('rolling_people_vaccinated * 100', 'population', 6)} AS percent_vaccinated
FROM (
  SELECT dea.continent, dea.location, dea.date, dea.population, vac.new_vaccinations,
         CAST(sum(CAST(vac.new_vaccinations AS BIGINT)) OVER (PARTITION BY dea.location ORDER BY dea.location, dea.date)
           AS BIGINT) AS rolling_people_vaccinated
  FROM covid_deaths dea JOIN covid_vaccinations vac ON dea.location = vac.location AND dea.date = vac.date
  {where}) t ORDER BY location, date""", "covid_deaths", "covid_vaccinations")


@register("ie5_rolling_vaccinations", _rolling_sql(True))
def ie5_rolling_vaccinations(spark, sf):
    return exploration.rolling_vaccinations(_deaths(spark, sf), fx.covid_vaccinations(spark, sf))


@register("ie5_rolling_vaccinations_all", _rolling_sql(False))
def ie5_rolling_vaccinations_all(spark, sf):
    return exploration.rolling_vaccinations(_deaths(spark, sf), fx.covid_vaccinations(spark, sf),
                                            continent_required=False)
