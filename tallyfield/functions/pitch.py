"""Expressions on pitch coordinates (120 x 80, attacking toward x = 120). Texts run on Spark and DuckDB alike."""

from __future__ import annotations

# Edges belong to the upper cell.
LANE_EDGES = (18, 30, 50, 62)
X_EDGES = (20, 40, 60, 80, 100)
THIRD_EDGES = (40, 80)
LANES = ("wide_left", "halfspace_left", "centre", "halfspace_right", "wide_right")
ZONES = (len(X_EDGES) + 1) * (len(LANE_EDGES) + 1)
SHOT, LOSS = ZONES, ZONES + 1
RESTARTS = ("Corner", "Free Kick", "Throw-in", "Goal Kick", "Kick Off")


NUDGE = 1e-10  # lifts quotients off decimal ties, so that the last digit does not hang on the order of a sum


def steps(value: str, edges: tuple[int, ...]) -> str:
    """How many edges a value has reached; null counts as none."""
    return "(" + " + ".join(f"coalesce(cast({value} >= {e} as int), 0)" for e in edges) + ")"


def lane(y: str) -> str:
    return steps(y, LANE_EDGES)


def zone(x: str, y: str) -> str:
    return f"({steps(x, X_EDGES)} * 5 + {lane(y)})"


def region(x: str, y: str) -> str:
    return f"({steps(x, THIRD_EDGES)} * 5 + {lane(y)})"


def crossing_y(line: int) -> str:
    """Where an action crosses a line, by linear interpolation; null where it does not move along x."""
    return f"(y + (end_y - y) * ({line} - x) / nullif(end_x - x, 0))"


def crossing_lane(line: int) -> str:
    """Lane in which an action crosses a line; an unknown height counts for the last lane."""
    return f"(case when {crossing_y(line)} is null then {len(LANE_EDGES)} else {lane(crossing_y(line))} end)"


def crosses(line: int) -> str:
    return f"(action = 'move' and x < {line} and end_x >= {line})"


def quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


# Events that win the ball, and defensive actions.
REGAINS = ("Ball Recovery", "Interception", "Duel", "Block", "Clearance", "Goal Keeper", "Pressure", "Foul Won", "Dispossessed", "Miscontrol")
DEFENSIVE = "(type in ('Interception', 'Foul Committed') or type = 'Duel' and coalesce(sub_type, '') = 'Tackle')"
GOAL = "(type = 'Shot' and coalesce(outcome, '') = 'Goal' or type = 'Own Goal For')"
TRANSITION_SECONDS = 10
TRANSITION = f"""(coalesce(play_pattern, '') in ('Regular Play', 'From Counter') and (coalesce(pos_first_type, '') in ({quoted(REGAINS)}) or coalesce(play_pattern, '') = 'From Counter')
  and coalesce(pos_seconds <= {TRANSITION_SECONDS}, false))"""
RESTART = f"case when type = 'Pass' and coalesce(sub_type, '') in ({quoted(RESTARTS)}) then sub_type end"

#: Open-play actions of the team in possession; everything else is null. Null fields are guarded first.
KIND = """case when team_id <> possession_team_id then null
  when type = 'Shot' and coalesce(sub_type, '') not in ('Penalty', 'Free Kick') then 'shot'
  when type = 'Pass' and coalesce(sub_type, '') in (""" + quoted(RESTARTS) + """) then null
  when type in ('Pass', 'Carry') and outcome is null and end_x is not null then 'move'
  when type = 'Pass' and outcome is not null then 'turnover'
  when type in ('Dispossessed', 'Miscontrol') then 'turnover'
  when type = 'Dribble' and outcome = 'Incomplete' then 'turnover' end"""

#: As KIND, with restarts and free kicks at goal; only penalties stay out.
ACTION = """case when x is null or not coalesce(team_id = possession_team_id, false) then null
  when type = 'Shot' and coalesce(sub_type, '') <> 'Penalty' then 'shot'
  when type in ('Pass', 'Carry') and (type = 'Carry' or outcome is null) and end_x is not null then 'move'
  when type = 'Pass' and outcome is not null then 'turnover'
  when type in ('Dispossessed', 'Miscontrol') then 'turnover'
  when type = 'Dribble' and outcome = 'Incomplete' then 'turnover' end"""

PHASE = "case when x < 40 then 'build_up' when x < 80 then 'progression' when x is not null then 'final_third' end"
BUCKET = "case when minute < 30 then '0-30' when minute < 60 then '30-60' else '60-90+' end"
# Name of a season as 2015/2016 out of 15/16, 2015-16 or 2015/2016; the second year decides the century of the first.
_A, _B = (rf"regexp_extract(s, '^([0-9]{{2,4}})[/-]([0-9]{{2,4}})$', {k})" for k in (1, 2))
_FIRST = f"case when length({_A}) = 4 then cast({_A} as int) when cast({_A} as int) > 50 then 1900 + cast({_A} as int) else 2000 + cast({_A} as int) end"
SEASON = rf"""case when regexp_like(s, '^([0-9]{{2}}|[0-9]{{4}})[/-]([0-9]{{2}}|[0-9]{{4}})$') then concat(cast({_FIRST} as string), '/', cast({_FIRST} + 1 as string)) else s end"""
