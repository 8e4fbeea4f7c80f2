"""The analysis panels (S12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerfold import presets as P
from ledgerfold.operators import panels as N, windows as W
from ledgerfold.plans.registry import query, r6
from ledgerfold.plans.relational import WOMENS
from ledgerfold.plans.returns import case_sql

OTHER = ["MEDIUM"]  # the part type that plays the catch weights
TIERS = {"ECONOMY": "S", "PROMO": "A", "STANDARD": "B"}

EVENTS = f"""
, ev AS (SELECT * FROM players WHERE contest_id <> {P.SENTINEL_CONTEST}
  QUALIFY row_number() OVER (PARTITION BY date_id, player_id ORDER BY contest_size DESC, contest_id) = 1),
sec AS (SELECT date_id, player_id, CASE row_number() OVER (PARTITION BY date_id ORDER BY salary DESC, player_id) WHEN 1 THEN 'main_event' WHEN 2 THEN 'co_main'
  WHEN 3 THEN 'main_card' WHEN 4 THEN 'main_card' WHEN 5 THEN 'main_card' ELSE 'prelim' END AS card_section FROM ev),
ec AS (SELECT * FROM ev JOIN sec USING (date_id, player_id))
"""
_VALUE = "CASE WHEN salary > 0 THEN actual_points/(salary/1000) END"
_TIER = "CASE weight_class WHEN 'ECONOMY' THEN 'S' WHEN 'PROMO' THEN 'A' WHEN 'STANDARD' THEN 'B' ELSE '?' END AS tier"
_SEX = "CASE WHEN weight_class IN ('ECONOMY', 'SMALL') THEN 'Women' ELSE 'Men' END AS gender"


def _dir(missing):
    return (f"CASE WHEN line_move IS NULL THEN '{missing}' WHEN line_move > 0.02::DOUBLE THEN 'steamed' "
            "WHEN line_move < -0.02::DOUBLE THEN 'drifted' ELSE 'stable' END AS line_move_dir")


MEMBER = ("date_id", "player_id", "contest_id", "contest_size", "salary", "ownership", "actual_points", "close_prob", "open_prob", "line_move")
# the name settles ties of a member listed twice
CLASSED = (*MEMBER, "full_name", "weight_class")


def events(t, columns=CLASSED):
    """Member rows of a date from its largest contest, the sentinel contest left out.

    The whole row is carried through the choice, so it brings only what a panel uses.
    """
    rows = t.players.where(F.col("contest_id") != P.SENTINEL_CONTEST).select(*columns)
    return N.one_per_event(rows, ["date_id", "player_id"])


def carded_events(t, columns=CLASSED):
    """:func:`events` with the section of the card, numbered on the rows themselves: nothing is joined back."""
    e = events(t, columns).where("date_id IS NOT NULL AND player_id IS NOT NULL")
    return W.position_in_group(e, ["date_id"], ["-salary", "player_id"], name="card_position",
                               labels=P.CARD_SECTIONS, default=P.CARD_DEFAULT, label_name="card_section")


_BANDS = f"""{case_sql('salary', P.ENTITY_SALARY)} AS salary_tier, {case_sql('ownership', P.ENTITY_OWN)} AS ownership_band,
       {case_sql('close_prob', P.CLOSE_PROB)} AS close_prob_band, {_dir('no_data')}, round({_VALUE}, 9) AS salary_value, {_VALUE} >= 8 AS is_ceiling"""


@query("S12_construction_panel", EVENTS + f"""
SELECT date_id, player_id, card_section, {_BANDS}, {_VALUE} >= 6 AS is_optimal_range FROM ec WHERE close_prob IS NOT NULL AND actual_points IS NOT NULL""")
def _(t):
    return N.construction(carded_events(t, MEMBER)).select(
        "date_id", "player_id", "card_section", "salary_tier", "ownership_band", "close_prob_band", "line_move_dir",
        r6("salary_value", 9).alias("salary_value"), "is_ceiling", "is_optimal_range")


@query("S12_detailed_panel", EVENTS + f"""
SELECT date_id, player_id, card_section, {_BANDS}, {_VALUE} >= 10 AS is_smash, actual_points < 10 AS is_dud,
       CASE WHEN close_prob > 0.5 THEN 'Favorite' ELSE 'Underdog' END AS fav_dog,
       CASE WHEN weight_class IN ('ECONOMY', 'SMALL') THEN 'Women''s' WHEN weight_class <> 'MEDIUM' THEN 'Men''s' ELSE 'Unknown' END AS gender,
       CASE WHEN weight_class IN ('ECONOMY', 'SMALL') THEN 'W-' || weight_class WHEN weight_class = 'MEDIUM' THEN 'Other' ELSE weight_class END AS weight_group,
       {case_sql('close_prob', P.PROB_TIER)} AS prob_tier
FROM ec WHERE close_prob IS NOT NULL AND actual_points IS NOT NULL""")
def _(t):
    return N.detailed(carded_events(t), womens=WOMENS, other=OTHER).select(
        "date_id", "player_id", "card_section", "salary_tier", "ownership_band", "close_prob_band", "line_move_dir",
        r6("salary_value", 9).alias("salary_value"), "is_ceiling", "is_smash", "is_dud", "fav_dog", "gender", "weight_group", "prob_tier")


@query("S12_archetype_member_panel", f"""
, m AS (SELECT * FROM players WHERE contest_id <> {P.SENTINEL_CONTEST}
  QUALIFY row_number() OVER (PARTITION BY date_id, full_name ORDER BY contest_size DESC, contest_id, player_id) = 1)
SELECT date_id, full_name, contest_id, player_id, CASE WHEN multi_entry_max = 1 THEN 'SE' WHEN multi_entry_max BETWEEN 3 AND 18 THEN 'LIMITED'
       WHEN multi_entry_max = 20 THEN '20-Max' WHEN multi_entry_max = 150 THEN '150-Max' ELSE 'UNLIMITED' END AS archetype,
       round(coalesce({_VALUE}, 0), 9) AS salary_value, coalesce({_VALUE} >= 8, FALSE) AS is_ceiling, coalesce(actual_points = 0, FALSE) AS is_dud, {_TIER}, {_SEX} FROM m""")
def _(t):
    rows = t.players.where(F.col("contest_id") != P.SENTINEL_CONTEST)
    return N.archetype_members(rows, tiers=TIERS, womens=WOMENS).select(
        "date_id", "full_name", "contest_id", "player_id", "archetype", r6("salary_value", 9).alias("salary_value"), "is_ceiling", "is_dud", "tier", "gender")


@query("S12_archetype_price_panel", EVENTS + f"""
SELECT date_id, player_id, card_section, round(coalesce({_VALUE}, 0), 9) AS salary_value, coalesce({_VALUE}, 0) >= 8 AS is_ceiling, actual_points = 0 AS is_dud,
       {_dir('unknown')}, {case_sql('close_prob', P.PROB_BAND)} AS prob_band, {_TIER}, {_SEX} FROM ec WHERE actual_points IS NOT NULL""")
def _(t):
    return N.archetype_prices(carded_events(t), tiers=TIERS, womens=WOMENS).select(
        "date_id", "player_id", "card_section", r6("salary_value", 9).alias("salary_value"), "is_ceiling", "is_dud", "line_move_dir", "prob_band", "tier", "gender")


@query("S12_composition_panel", EVENTS + f"""
, med AS (SELECT date_id, quantile_cont(actual_points, 0.5) AS event_median FROM ec GROUP BY 1)
SELECT date_id, player_id, card_section, {case_sql('close_prob', P.PROB_BAND)} AS prob_band, round({_VALUE}, 9) AS salary_value, {_dir('unknown')},
       CASE WHEN close_prob - open_prob > 0.02::DOUBLE THEN {case_sql('greatest((close_prob - open_prob)*100, 2.0::DOUBLE)', P.STEAMED)} END AS steam_magnitude,
       {_SEX}, coalesce({_VALUE} >= 8, FALSE) AS ceiling_hit, round(event_median, 9) AS event_median,
       coalesce(actual_points = 0 OR actual_points < event_median*0.3::DOUBLE, FALSE) AS is_dud FROM ec JOIN med USING (date_id)""")
def _(t):
    return N.composition_members(carded_events(t), womens=WOMENS).select(
        "date_id", "player_id", "card_section", "prob_band", r6("salary_value", 9).alias("salary_value"), "line_move_dir", "steam_magnitude", "gender",
        "ceiling_hit", r6("event_median", 9).alias("event_median"), "is_dud")
