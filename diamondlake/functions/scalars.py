"""Column expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diamondlake import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key, table: dict) -> Column:
    """Constant dictionary lookup; NULL when the key is absent."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, _col(key))


# --- arithmetic ------------------------------------------------------------------------------------

def ratio(num, den) -> Column:
    """Division that yields NULL on a zero or NULL divisor (ANSI mode would raise)."""
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def clip(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(_col(x), F.lit(lo)), F.lit(hi))


def half_even(x, digits: int) -> Column:
    return F.bround(_col(x), digits)


def flag(cond: Column) -> Column:
    """1 where the condition holds, else 0 (a NULL condition counts as 0)."""
    return F.when(cond, 1).otherwise(0)


def fflag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


# --- text ------------------------------------------------------------------------------------------

def canonical_team(code) -> Column:
    trimmed = F.trim(_col(code))
    return F.coalesce(lookup(F.upper(trimmed), K.TEAM_ALIASES), trimmed)


def player_key(name) -> Column:
    """'Last, First' and 'First  Last' both become 'first last'."""
    low = F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))
    parts = F.split(low, ",", 2)
    swapped = F.concat_ws(" ", F.trim(F.try_element_at(parts, F.lit(2))), F.trim(parts[0]))
    joined = F.when(F.contains(low, F.lit(",")), swapped).otherwise(low)
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def digits_to_int(text) -> Column:
    return F.when(_col(text).rlike("^[0-9]+$"), _col(text).try_cast("int"))


def record_label(wins, losses) -> Column:
    return F.concat_ws("-", _col(wins).cast("int"), _col(losses).cast("int"))


def game_id(day, away, home) -> Column:
    return F.concat(
        F.date_format(_col(day), "yyyyMMdd"), F.lit("_"),
        F.coalesce(_col(away), F.lit("?")), F.lit("@"), _col(home))


# --- time ------------------------------------------------------------------------------------------

def default_start(day) -> Column:
    """19:00 UTC on the day, without a zone."""
    return (F.to_date(_col(day)).cast("timestamp_ntz")
            + F.expr("INTERVAL 19 HOURS"))


def utc_naive(ts, zone: str | None = None) -> Column:
    """Zone-less UTC: a `timestamp` is read as an instant, a local time needs its zone."""
    if zone is None:
        return F.convert_timezone(
            None, F.lit("UTC"), _col(ts).cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _col(ts).cast("timestamp_ntz"))


def is_evening(start_utc, zone: str = "America/New_York", hour: int = 19) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(start_utc).cast("timestamp_ntz"))
    return F.coalesce(F.hour(local) >= hour, F.lit(False))


def rest_days_to(day, last_played) -> Column:
    """Days since the last game, never below one; NULL when the team never played."""
    gap = F.datediff(_col(day), _col(last_played))
    return F.when(gap.isNotNull(), F.greatest(gap, F.lit(1)))


# --- pitch log rules -------------------------------------------------------------------------------

def ends_plate_appearance(events="events") -> Column:
    return _col(events).isin(K.PA_END_EVENTS)


def outs_on(events="events") -> Column:
    return F.coalesce(lookup(events, K.OUTS_ON_EVENT), F.lit(0))


def batting_team(half="inning_topbot", home="home_team", away="away_team") -> Column:
    return F.when(_col(half) == "Top", _col(away)).otherwise(_col(home))


def fielding_team(half="inning_topbot", home="home_team", away="away_team") -> Column:
    return F.when(_col(half) == "Top", _col(home)).otherwise(_col(away))


def barrel(speed="launch_speed", angle="launch_angle", low: float = 22, high: float = 36) -> Column:
    """The pitcher side uses a 22-36 degree band, the team side 26-30."""
    return fflag((_col(speed) >= 98) & _col(angle).between(low, high))


def hard_hit(speed="launch_speed") -> Column:
    return fflag(_col(speed) >= 95)


def venue_of(team) -> Column:
    return F.coalesce(lookup(team, K.VENUES), F.lit("Unknown"))


def pitch_category(pitch_type="pitch_type") -> Column:
    out = None
    for family, types in K.PITCH_CATEGORIES.items():
        cond = _col(pitch_type).isin(types)
        out = F.when(cond, family) if out is None else out.when(cond, family)
    return out.otherwise("unknown")


def occupied(*bases) -> Column:
    total = F.lit(0)
    for b in bases:
        total = total + _col(b).isNotNull().cast("int")
    return total


def winner_label(home_score="home_score", away_score="away_score") -> Column:
    """1 home, 0 away, NULL when level or unknown."""
    return (F.when(_col(home_score) > _col(away_score), 1.0)
             .when(_col(away_score) > _col(home_score), 0.0))


def woba_numerator(counts: dict) -> Column:
    """`counts` maps an event name to its count column."""
    total = None
    for event, weight in K.WOBA_WEIGHTS.items():
        term = F.lit(weight) * _col(counts[event])
        total = term if total is None else total + term
    return total


# --- odds ------------------------------------------------------------------------------------------

def american_to_probability(line) -> Column:
    x = _col(line).cast("double")
    return F.when(x < 0, ratio(-x, -x + 100)).otherwise(ratio(F.lit(100.0), x + 100))


def probability_to_american(p) -> Column:
    x = _col(p).cast("double")
    fav = F.rint(ratio(-100 * x, 1 - x))
    dog = F.rint(ratio(100 * (1 - x), x))
    return F.when(x >= 0.5, fav).otherwise(dog).cast("int")


def fair_pair(line_home, line_away) -> tuple[Column, Column]:
    """Two-way vig removal; a missing line counts as the default line."""
    h = american_to_probability(F.coalesce(_col(line_home), F.lit(K.DEFAULT_MONEYLINE)))
    a = american_to_probability(F.coalesce(_col(line_away), F.lit(K.DEFAULT_MONEYLINE)))
    return ratio(h, h + a), ratio(a, h + a)


# --- model output ----------------------------------------------------------------------------------

def pick(prob, home="home_team", away="away_team") -> Column:
    return F.when(_col(prob) >= 0.5, _col(home)).when(_col(prob) < 0.5, _col(away))


def winner(home_win="home_win", home="home_team", away="away_team") -> Column:
    return F.when(_col(home_win) == 1, _col(home)).when(_col(home_win) == 0, _col(away))


def psi_status(psi) -> Column:
    return (F.when(_col(psi) >= K.PSI_ALERT, "ALERT")
             .when(_col(psi) >= K.PSI_WARN, "WARN").otherwise("OK"))


def psi_noise_floor(n_base, n_cur, bins: int = 10) -> Column:
    nb, nc = _col(n_base).cast("double"), _col(n_cur).cast("double")
    return F.when((nb > 0) & (nc > 0), (bins - 1) / 2.0 * (1 / nb + 1 / nc)).otherwise(0.0)


def game_status(home_win, start_utc, now) -> Column:
    """Scheduled before the start, else Final when decided, else Live; `now` is explicit."""
    started = F.when(_col(home_win).isNotNull(), "Final").otherwise("Live")
    return F.when(_col(start_utc) > _col(now), "Scheduled").otherwise(started)
