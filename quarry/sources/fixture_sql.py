"""The fixture adapters of ``fixtures.py`` written as DuckDB SQL for the oracle.

``with_fixtures(body, names)`` prefixes a query with the adapter CTEs it uses
(and the ones those depend on), so every oracle statement runs on the
pre-registered base views alone.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {}
DEPENDS: dict[str, tuple[str, ...]] = {}


def _add(name: str, sql: str, *deps: str) -> None:
    FIXTURE_SQL[name] = sql.strip()
    DEPENDS[name] = deps


_add("dim_customer", """
SELECT c_custkey AS customer_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'sharp' WHEN 'BUILDING' THEN 'regular'
            WHEN 'MACHINERY' THEN 'regular' WHEN 'FURNITURE' THEN 'casual'
            WHEN 'HOUSEHOLD' THEN 'promo_hunter' END AS segment,
       abs(c_acctbal) / 20.0 AS avg_bet_size,
       CAST(1 + c_custkey % 5 AS DOUBLE) AS bets_per_week,
       CAST(0.25 AS DOUBLE) AS pref_moneyline, CAST(0.45 AS DOUBLE) AS pref_spread, CAST(0.25 AS DOUBLE) AS pref_total,
       CAST(0.05 AS DOUBLE) AS pref_parlay,
       CAST(c_custkey % 10 AS DOUBLE) / 10.0 AS promo_sensitivity
FROM customer""")

_add("fact_bet", """
SELECT o_orderkey AS bet_id, o_custkey AS customer_id, o_orderdate AS bet_datetime,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'moneyline' WHEN '2-HIGH' THEN 'spread'
            WHEN '5-LOW' THEN 'spread' WHEN '3-MEDIUM' THEN 'total' WHEN '4-NOT SPECIFIED' THEN 'parlay' END AS bet_type,
       o_totalprice AS stake_amount, CAST(1.9 AS DOUBLE) AS odds_decimal_avg,
       CASE o_orderstatus WHEN 'O' THEN o_totalprice * 1.9 WHEN 'P' THEN o_totalprice ELSE 0.0 END AS gross_payout,
       CASE o_orderstatus WHEN 'F' THEN 'lose' WHEN 'O' THEN 'win' WHEN 'P' THEN 'push' END AS status
FROM orders""")

_add("fact_bet_cost", """
SELECT cost_id, bet_id, promo_cost, payment_fee, tax, promo_cost + payment_fee + tax AS total_cost
FROM (
  SELECT o_orderkey AS cost_id, o_orderkey AS bet_id,
         CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 0.05 ELSE 0.0 END AS promo_cost,
         o_totalprice * 0.012 AS payment_fee,
         greatest(0.0, o_totalprice - CASE o_orderstatus WHEN 'O' THEN o_totalprice * 1.9
                                                         WHEN 'P' THEN o_totalprice ELSE 0.0 END) * 0.03 AS tax
  FROM orders) t""")

_add("fact_bet_leg", """
SELECT l_orderkey * 100 + leg_no AS bet_leg_id, l_orderkey AS bet_id, CAST(leg_no AS INTEGER) AS leg_no,
       l_suppkey AS event_id, market_type,
       CASE WHEN market_type = 'total' THEN CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END
            ELSE CASE WHEN l_linestatus = 'O' THEN 'home' ELSE 'away' END END AS selection,
       CASE market_type WHEN 'spread' THEN CAST(l_partkey % 15 - 7 AS DOUBLE)
                        WHEN 'total' THEN CAST(35 + l_partkey % 20 AS DOUBLE) END AS line_value,
       american_odds,
       CASE WHEN american_odds > 0 THEN 1.0 + CAST(american_odds AS DOUBLE) / 100.0
            ELSE 1.0 + 100.0 / abs(CAST(american_odds AS DOUBLE)) END AS decimal_odds,
       settled_result = 'win' AS is_win, settled_result = 'push' AS is_push, settled_result
FROM (
  SELECT l.*,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS leg_no,
         CASE l_returnflag WHEN 'A' THEN 'moneyline' WHEN 'R' THEN 'spread' ELSE 'total' END AS market_type,
         CAST(CASE WHEN l_quantity > 25 THEN 5 * l_quantity ELSE -(100 + 4 * l_quantity) END AS INTEGER) AS american_odds,
         CASE l_partkey % 3 WHEN 0 THEN 'win' WHEN 1 THEN 'lose' ELSE 'push' END AS settled_result
  FROM lineitem l
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) t""")

_add("dim_event", """
SELECT event_id, season, week, CAST(make_date(season, 9, 1) + 7 * (week - 1) AS DATE) AS game_date,
       home_team_id, away_team_id, home_score, away_score, spread_line, total_line, week >= 19 AS is_playoff
FROM (
  SELECT s_suppkey AS event_id, CAST(2010 + s_suppkey % 10 AS INTEGER) AS season,
         CAST(s_suppkey % 22 + 1 AS INTEGER) AS week,
         CAST(s_nationkey AS VARCHAR) AS home_team_id, CAST((s_nationkey + 7) % 25 AS VARCHAR) AS away_team_id,
         CAST(s_suppkey % 41 AS INTEGER) AS home_score, CAST((7 * s_suppkey) % 38 AS INTEGER) AS away_score,
         CAST(s_suppkey % 15 - 7 AS DOUBLE) AS spread_line, CAST(35 + s_suppkey % 20 AS DOUBLE) AS total_line
  FROM supplier) t""")

_add("raw_teams", """
SELECT n_name AS team_name, 'N' || CAST(n_nationkey AS VARCHAR) AS team_name_short,
       CAST(n_nationkey AS VARCHAR) AS team_id, 'n' || CAST(n_nationkey AS VARCHAR) AS team_id_pfr,
       r_name AS team_conference,
       CASE WHEN n_nationkey % 5 <> 0 THEN r_name || ' ' || CAST(n_nationkey % 5 AS VARCHAR) END AS team_division,
       r_name AS team_conference_pre2002, r_name || ' ' || CAST(n_nationkey % 3 AS VARCHAR) AS team_division_pre2002
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT n_name || ' (old)', 'N' || CAST(n_nationkey AS VARCHAR), CAST(n_nationkey AS VARCHAR),
       'n' || CAST(n_nationkey AS VARCHAR), r_name, CAST(NULL AS VARCHAR), r_name,
       r_name || ' ' || CAST(n_nationkey % 3 AS VARCHAR)
FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey IN (5, 11)
UNION ALL
SELECT c_name, 'C' || CAST(c_custkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR),
       r_name, CAST(NULL AS VARCHAR), r_name, r_name || ' ' || CAST(n_nationkey % 3 AS VARCHAR)
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

_add("raw_scores", """
SELECT CASE WHEN e.event_id % 50 = 0 THEN 'TBD'
            WHEN e.event_id % 2 = 0 THEN strftime(e.game_date, '%Y-%m-%d')
            ELSE strftime(e.game_date, '%-m/%-d/%Y') END AS schedule_date,
       CAST(e.season AS BIGINT) AS schedule_season,
       CASE e.week WHEN 19 THEN 'Wildcard' WHEN 20 THEN 'Division' WHEN 21 THEN 'Championship'
                   WHEN 22 THEN 'Superbowl' ELSE CAST(e.week AS VARCHAR) END AS schedule_week,
       e.is_playoff AS schedule_playoff,
       CASE WHEN e.event_id % 4 = 0 AND e.home_team_id IN ('5', '11') THEN h.n_name || ' (old)' ELSE h.n_name END AS team_home,
       CAST(e.home_score AS BIGINT) AS score_home, CAST(e.away_score AS BIGINT) AS score_away,
       a.n_name AS team_away,
       CASE WHEN e.spread_line < 0 THEN e.home_team_id WHEN e.spread_line > 0 THEN e.away_team_id ELSE 'PICK' END AS team_favorite_id,
       CASE WHEN e.spread_line < 0 THEN e.spread_line WHEN e.spread_line > 0 THEN -e.spread_line ELSE 0.0 END AS spread_favorite,
       CASE WHEN e.event_id % 6 = 0 THEN '' ELSE CAST(e.total_line AS VARCHAR) END AS over_under_line,
       'Stadium ' || e.home_team_id AS stadium,
       e.week = 22 AS stadium_neutral,
       30 + e.event_id % 60 AS weather_temperature, e.event_id % 25 AS weather_wind_mph,
       e.event_id % 100 AS weather_humidity,
       CASE e.event_id % 7 WHEN 0 THEN 'Rain' WHEN 1 THEN 'DOME' WHEN 2 THEN 'Snow | Fog' END AS weather_detail
FROM dim_event e
LEFT JOIN nation h ON CAST(h.n_nationkey AS VARCHAR) = e.home_team_id
LEFT JOIN nation a ON CAST(a.n_nationkey AS VARCHAR) = e.away_team_id""", "dim_event")


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(body: str, *names: str, extra: str = "") -> str:
    """``WITH <adapters>[, extra] <body>``; ``extra`` holds further CTEs (without WITH)."""
    ctes = [f"{n} AS (\n{FIXTURE_SQL[n]}\n)" for n in _closure(names)]
    if extra.strip():
        ctes.append(extra.strip())
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


_add("housing", """
SELECT * FROM (
  SELECT o_orderkey AS UniqueID, CAST(o_custkey AS VARCHAR) AS ParcelID,
         CASE WHEN o_orderkey % 10 <> 0 THEN c_name || ', ' || n_name END AS PropertyAddress,
         o_orderdate AS SaleDate, o_totalprice AS SalePrice, o_orderpriority AS LegalReference,
         CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'Yes' ELSE 'No' END AS SoldAsVacant,
         c_name || ', ' || n_name || ', ' || r_name AS OwnerAddress, r_name AS TaxDistrict
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey) h
UNION ALL
SELECT UniqueID + 1000000000, ParcelID, PropertyAddress, SaleDate, SalePrice, LegalReference, SoldAsVacant,
       OwnerAddress, TaxDistrict
FROM (
  SELECT o_orderkey AS UniqueID, CAST(o_custkey AS VARCHAR) AS ParcelID,
         CASE WHEN o_orderkey % 10 <> 0 THEN c_name || ', ' || n_name END AS PropertyAddress,
         o_orderdate AS SaleDate, o_totalprice AS SalePrice, o_orderpriority AS LegalReference,
         CASE o_orderkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'Yes' ELSE 'No' END AS SoldAsVacant,
         c_name || ', ' || n_name || ', ' || r_name AS OwnerAddress, r_name AS TaxDistrict
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey) d
WHERE UniqueID % 20 = 0""")

_add("nation_geo", """
SELECT n_nationkey, n_name AS location, CASE WHEN n_nationkey <> 0 THEN r_name END AS continent
FROM nation JOIN region ON n_regionkey = r_regionkey""")

_add("covid_deaths", """
SELECT g.continent, g.location, d.date, CAST(p.population AS DECIMAL(18,0)) AS population,
       sum(d.new_cases) OVER (PARTITION BY d.n_nationkey ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_cases,
       d.new_cases,
       CAST(sum(d.deaths) OVER (PARTITION BY d.n_nationkey ORDER BY d.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS VARCHAR) AS total_deaths,
       CAST(d.deaths AS VARCHAR) AS new_deaths
FROM (SELECT c_nationkey AS n_nationkey, o_orderdate AS date, CAST(count(*) AS DOUBLE) AS new_cases,
             count(*) FILTER (WHERE o_orderstatus = 'F') AS deaths
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) d
JOIN nation_geo g ON d.n_nationkey = g.n_nationkey
JOIN (SELECT c_nationkey AS n_nationkey, count(*) * 1000 AS population FROM customer GROUP BY 1) p
  ON d.n_nationkey = p.n_nationkey""", "nation_geo")

_add("covid_vaccinations", """
SELECT g.location, d.date, d.new_vaccinations
FROM (SELECT c_nationkey AS n_nationkey, o_orderdate AS date,
             CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS new_vaccinations
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      GROUP BY 1, 2) d
JOIN nation_geo g ON d.n_nationkey = g.n_nationkey""", "nation_geo")

_add("games", """
SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS schedule_date,
       CAST(year(o_orderdate) AS INTEGER) AS schedule_season,
       CAST(floor((dayofyear(o_orderdate) - 1) / 7) + 1 AS INTEGER) AS schedule_week,
       floor((dayofyear(o_orderdate) - 1) / 7) + 1 > 50 AS schedule_playoff,
       CAST(c_nationkey AS VARCHAR) AS team_home_id,
       CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS VARCHAR) AS team_away_id,
       CAST(floor(o_totalprice) % 45 AS INTEGER) AS score_home,
       CAST(floor(o_totalprice / 7) % 45 AS INTEGER) AS score_away,
       CASE o_orderkey % 3 WHEN 0 THEN CAST(c_nationkey AS VARCHAR)
            WHEN 1 THEN CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS VARCHAR) ELSE 'PICK' END AS team_favorite_id,
       CASE WHEN o_orderkey % 3 = 2 THEN 0.0 ELSE CAST(-(o_orderkey % 14) AS DOUBLE) / 2.0 END AS spread_favorite,
       CAST(35 + o_orderkey % 20 AS DOUBLE) + CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 0.0 END AS over_under_line,
       o_orderkey % 50 = 0 AS stadium_neutral,
       CASE WHEN o_orderkey % 13 <> 0 THEN CAST(20 + o_orderkey % 70 AS INTEGER) END AS weather_temperature,
       CAST(o_orderkey % 25 AS INTEGER) AS weather_wind_mph,
       CASE o_orderkey % 7 WHEN 0 THEN 'Rain' WHEN 1 THEN 'DOME' WHEN 2 THEN 'Snow | Fog' WHEN 3 THEN 'rain showers' END AS weather_detail,
       CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 AS INTEGER) END AS weather_humidity,
       'Stadium ' || CAST(c_nationkey AS VARCHAR) AS stadium,
       CAST(1300 + (c_nationkey * 37) % 400 AS DOUBLE) AS team_home_elo_pre,
       CAST(1300 + (((c_nationkey + 1 + o_orderkey % 24) % 25) * 37) % 400 AS DOUBLE) AS team_away_elo_pre
FROM orders JOIN customer ON o_custkey = c_custkey""")

_add("ab_players", """
SELECT user_id AS userid, CASE WHEN user_id % 2 = 0 THEN 'gate_30' ELSE 'gate_40' END AS version,
       'v' || CAST(user_id % 4 AS VARCHAR) AS variant, install_date, sum_gamerounds, retention_1, retention_7,
       events_first_day
FROM (
  SELECT e.user_id, max(date_diff('day', f.anchor, CAST(e.ts AS DATE)) = 1) AS retention_1,
         max(date_diff('day', f.anchor, CAST(e.ts AS DATE)) = 7) AS retention_7,
         count(*) FILTER (WHERE e.event_type = 'click' AND e.value > 100) AS sum_gamerounds,
         count(*) FILTER (WHERE date_diff('day', f.anchor, CAST(e.ts AS DATE)) = 0) AS events_first_day,
         min(f.anchor) AS install_date
  FROM events e JOIN (SELECT user_id, min(CAST(ts AS DATE)) AS anchor FROM events GROUP BY 1) f
    ON e.user_id = f.user_id
  GROUP BY e.user_id) u""")

_add("run_bets", "SELECT *, CAST(customer_id % 12 AS INTEGER) AS run_id FROM fact_bet", "fact_bet")

_add("asset_prices", """
SELECT p_brand AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
       avg(l_extendedprice / l_quantity) AS price, round(sum(l_extendedprice), 2) AS market_cap
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")

_add("holdings", """
SELECT p_brand AS asset, CAST(1 + CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INTEGER) AS DOUBLE) AS quantity
FROM (SELECT DISTINCT p_brand FROM part) b""")

_add("matches", """
SELECT l_orderkey AS gameId, CASE WHEN (l_quantity > 25) <> (l_partkey % 10 = 0) THEN 2 ELSE 1 END AS winner,
       CAST(l_partkey % 3 AS INTEGER) AS firstBlood, CAST((l_partkey + 1) % 3 AS INTEGER) AS firstTower,
       CAST((l_partkey + 2) % 3 AS INTEGER) AS firstInhibitor, CAST((l_partkey + 3) % 3 AS INTEGER) AS firstBaron,
       CAST((l_partkey + 4) % 3 AS INTEGER) AS firstDragon, CAST((l_partkey + 5) % 3 AS INTEGER) AS firstRiftHerald,
       CAST(floor(l_quantity / 5) AS INTEGER) AS t1_towerKills, CAST(l_linenumber % 4 AS INTEGER) AS t1_inhibitorKills,
       CAST(floor(l_discount * 100) % 3 AS INTEGER) AS t1_baronKills, CAST(l_quantity % 5 AS INTEGER) AS t1_dragonKills,
       CAST(l_partkey % 3 AS INTEGER) AS t1_riftHeraldKills, CAST(floor((51 - l_quantity) / 5) AS INTEGER) AS t2_towerKills,
       CAST((l_partkey + 1) % 4 AS INTEGER) AS t2_inhibitorKills, CAST((l_partkey + 2) % 3 AS INTEGER) AS t2_baronKills,
       CAST((l_quantity + 2) % 5 AS INTEGER) AS t2_dragonKills, CAST((l_partkey + 1) % 2 AS INTEGER) AS t2_riftHeraldKills
FROM lineitem""")

_add("movies", """
SELECT 'Film ' || CAST(l_orderkey AS VARCHAR) AS name, p_brand AS company, p_type AS genre,
       'Day, ' || CAST(year(l_shipdate) AS VARCHAR) || ' x' AS released,
       CASE WHEN l_partkey % 50 <> 0 THEN l_extendedprice END AS budget,
       l_extendedprice * (1 - l_discount) * 3 AS gross, l_quantity AS votes, CAST(p_size AS DOUBLE) AS runtime,
       CASE WHEN l_partkey % 50 <> 0 THEN p_retailprice END AS score
FROM lineitem JOIN part ON l_partkey = p_partkey""")

_add("champion_entries", """
SELECT event_type || '_' || CAST(k % 5 AS VARCHAR) AS key, k - 10 AS id,
       upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || ' ' || CAST(k AS VARCHAR) AS name,
       (event_id % 2) * 1000000000000 + event_id AS priority
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '(-?\\d+)', 1) AS INTEGER) AS k FROM events) e""")

_add("product_pages", """
SELECT page_id, 'https://shop.example.com/p/' || CAST(page_id AS VARCHAR) AS url,
       '<html lang="en"><body>'
       || CASE WHEN page_id % 17 = 0 THEN '' ELSE '<span id="productTitle" class="t">' || chr(10) || '  <b>' || p_name || '</b> </span>' END
       || CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 13 = 0 THEN '<span class="a-price-whole">sold out</span>'
               ELSE '<span class="x a-price-whole"> $' || format('{:,}', cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') || ' </span>' END
       || '</body></html>' AS html
FROM (SELECT p_partkey AS page_id, p_name,
             CAST(round(round(CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice % 40 ELSE p_retailprice * 10 END, 2) * 100) AS BIGINT) AS cents
      FROM part) p""")
