"""Column functions about contests: ratings, odds, situations, labels, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, round_even

# fixed values: rating rules
MEAN_RATING = 1505.0
K_FACTOR = 6.0
HOME_EDGE = 50.0
SEASON_REVERSION = 0.30
PLAYOFF_WEIGHT = 1.25
DECAY = 0.05

# fixed values: states and types of a game
COMPLETED = ("OFF", "FINAL")
LIVE = ("LIVE", "CRIT")
REGULAR, PLAYOFF = 2, 3

# fixed values: event types
ATTEMPTS = ("shot-on-goal", "missed-shot", "goal")
LIVE_ATTEMPTS = ("shot-on-goal", "missed-shot", "blocked-shot", "goal")
ON_GOAL = ("shot-on-goal", "goal")

# fixed values: points of a settled pick and the prior of an unseen game
POINTS_RIGHT, POINTS_WRONG = 100, 10
NEUTRAL_PRIOR = 0.54


def is_completed(state: Column) -> Column:
    """True only for completed games; an unknown state counts as not completed."""
    return F.coalesce(state.isin(*COMPLETED), F.lit(False))


def win_probability(rating_gap: Column) -> Column:
    return F.lit(1.0) / (F.pow(F.lit(10.0), -rating_gap / 400.0) + 1.0)


def margin_multiplier(goal_diff: Column, winner_gap: Column) -> Column:
    """Bigger wins count more, less so for the side that was rated higher."""
    return (0.6686 * F.ln(F.greatest(F.abs(goal_diff), F.lit(1)).cast("double")) + 0.8048) * (
        F.lit(2.05) / (winner_gap * 0.001 + 2.05)
    )


def fair_odds(p: Column, low: float = 0.02) -> Column:
    """American odds without margin, the probability kept within ``low`` … ``1 - low``."""
    q = clamp(p, low, 1 - low)
    return F.rint(F.when(q >= 0.5, -100 * q / (1 - q)).otherwise(100 * (1 - q) / q)).cast("long")


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def pick_home(p: Column) -> Column:
    return p >= 0.5


def is_right(p: Column, y: Column) -> Column:
    return (p >= 0.5) == (y == 1)


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def series_code(game_id: Column, home: Column, away: Column) -> Column:
    """Characters 7–9 of a ten-digit id, else the two teams in order."""
    text = game_id.cast("string")
    by_pair = F.concat_ws("-", F.array_sort(F.array(home.cast("string"), away.cast("string"))))
    return F.when(F.length(text) >= 10, F.substring(text, 7, 3)).otherwise(by_pair)


def situation(code: Column) -> dict[str, Column]:
    """The four digits of a situation code: away goalie, away, home, home goalie; unreadable means 5 on 5.

    The text is padded to four places; a missing code is 1551.
    """
    text = F.coalesce(F.nullif(code.cast("string"), F.lit("")), F.lit("1551"))
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    digits = [F.substring(padded, i, 1).try_cast("int") for i in (1, 2, 3, 4)]
    readable = digits[0].isNotNull() & digits[1].isNotNull() & digits[2].isNotNull() & digits[3].isNotNull()
    away_goalie, away, home, home_goalie = (
        F.when(readable, d).otherwise(F.lit(fallback)).cast("long") for d, fallback in zip(digits, (1, 5, 5, 1), strict=True)
    )
    return {
        "home_skaters": home,
        "away_skaters": away,
        "home_goalie_on_ice": home_goalie,
        "away_goalie_on_ice": away_goalie,
    }


def manpower(home: Column, away: Column, home_goalie: Column, away_goalie: Column) -> dict[str, Column]:
    return {
        "home_empty_net": (home_goalie == 0).cast("long"),
        "away_empty_net": (away_goalie == 0).cast("long"),
        "manpower_diff_home": home - away,
        "home_power_play": (home > away).cast("long"),
        "away_power_play": (away > home).cast("long"),
        "even_strength": (home == away).cast("long"),
    }


def power_play_side(home: Column, away: Column) -> Column:
    return F.when(home > away, F.lit("home")).when(away > home, F.lit("away"))


def score_per_root_time(score_diff: Column, seconds_left: Column) -> Column:
    return score_diff / F.sqrt(F.when(seconds_left < 0, F.lit(0)).otherwise(seconds_left) + 1.0)


def live_save_pct(saves: Column, goals_against: Column) -> Column:
    return round_even(F.try_divide(saves.cast("double"), (saves + goals_against).cast("double")), 4)


def fraction_part(text: Column, index: int) -> Column:
    """Part ``index`` of a text such as ``1/3``; null when it is no such fraction."""
    parts = F.split(text, "/", 2)
    return F.when(F.contains(text, F.lit("/")), F.get(parts, F.lit(index)).try_cast("bigint"))


def event_label(event_type: Column, team: Column, period: Column, *, live: bool = False) -> Column:
    """What a viewer reads for an event."""
    team = F.coalesce(team.cast("string"), F.lit(""))
    number = period.cast("long").cast("string")
    # fixed values: label endings; the live feed words three of them differently
    own = {
        "goal": " GOAL" if live else " goal",
        "penalty": " penalty",
        "shot-on-goal": " shot on goal",
        "missed-shot": " shot misses",
        "hit": " big hit" if live else " hit",
        "giveaway": " giveaway",
        "takeaway": " takeaway",
    }
    plain = {
        "faceoff": "Faceoff won" if live else "Faceoff",
        "blocked-shot": "Shot blocked",
        "stoppage": "Play stopped",
        "game-end": "Final horn",
    }
    label = F.when(event_type == "period-start", F.concat(F.lit("Period "), number, F.lit(" starts")))
    label = label.when(event_type == "period-end", F.concat(F.lit("End of period "), number))
    for kind, ending in own.items():
        label = label.when(event_type == kind, F.concat(team, F.lit(ending)))
    for kind, text in plain.items():
        label = label.when(event_type == kind, F.lit(text))
    words = F.lower(F.replace(event_type, F.lit("-"), F.lit(" ")))
    return label.otherwise(F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))


def record(wins: Column, losses: Column, overtime: Column) -> Column:
    return F.format_string("%d-%d-%d", wins.cast("long"), losses.cast("long"), overtime.cast("long"))


def streak_code(code: Column, count: Column) -> Column:
    return F.concat(F.coalesce(code, F.lit("")), F.coalesce(count, F.lit(0)).cast("long").cast("string"))


def club_name(full: Column, special: Column | None = None, special_name: str = "Hockey Club") -> Column:
    """The last word of a full name; clubs flagged ``special`` carry a two-word name."""
    last = F.regexp_extract(full, r"(\S+)\s*$", 1)
    return last if special is None else F.when(special, F.lit(special_name)).otherwise(last)


def club_city(full: Column, name: Column) -> Column:
    return F.trim(F.substring(full, F.lit(1), F.greatest(F.length(full) - F.length(name), F.lit(0))))


def form_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x != "")


def default_text(value: Column) -> Column:
    """The ``default`` entry of a localised text map, else its first entry."""
    return F.coalesce(F.nullif(value["default"], F.lit("")), F.get(F.map_values(value), F.lit(0)))


def event_description(desc_key: Column, type_key: Column, event_id: Column) -> Column:
    desc = F.coalesce(F.nullif(desc_key, F.lit("")), type_key, F.lit(""))
    return F.when(event_id.isNotNull(), F.concat(desc, F.lit(" event_id="), event_id.cast("string"))).otherwise(desc)


def first_reason(*fields: Column) -> Column:
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in fields])
