"""Possession values on a 16 x 12 grid, what actions add to them, and the season's 13 claims made of these."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pitch
from .stats import count_if, ledger

NX, NY = 16, 12  # fixed values
GRID = NX * NY
SHOT, LOSS = GRID, GRID + 1
PRIOR_LOSSES = 1.0  # fixed value: pseudo losses of each zone

WON = "x is not null and (type = 'Ball Recovery' or type = 'Interception' and coalesce(outcome, '') not in ('Lost', 'Lost In Play', 'Lost Out'))"

# The claims as sum(num) / sum(den) over a team's matches. Threat is what actions add, where they add.
SEASON_CLAIMS = (
    ("possession", "passes", "passes + opp_passes"), ("buildup_success", "deep_reached", "deep"), ("fast_attacks", "entries_fast", "entries"),
    ("long_balls", "long_passes", "open_passes"), ("wide_entries", "entries_wide", "entries"), ("threat_per_match", "threat", "1"), ("ppda", "opp_passes_low", "def_actions"),
    ("press_height", "press_x", "press_starts"), ("high_regains", "recoveries_high", "recoveries"), ("conceded_per_match", "opp_threat", "1"),
    ("conceded_in_transition", "opp_threat_transition", "opp_threat"), ("conceded_wide", "opp_entries_wide", "opp_entries"), ("conceded_late", "opp_threat_late", "opp_threat"),
)


def grid_zone(x: str, y: str) -> Column:
    cell = lambda v, size, n: F.least(F.greatest(F.floor(F.col(v) / (size / n)), F.lit(0)), F.lit(n - 1))
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), cell(x, 120.0, NX) * NY + cell(y, 80.0, NY)).cast("int")


def solved_grid(c: np.ndarray, xg: np.ndarray) -> np.ndarray:
    """Values of the zones from counts by zone and outcome, and the xg of each zone's shots."""
    p = c / (c.sum(1, keepdims=True) + PRIOR_LOSSES)
    shots = c[:, SHOT]
    quality = np.divide(xg, shots, out=np.zeros(GRID), where=shots > 0)
    return np.linalg.solve(np.eye(GRID) - p[:, :GRID], p[:, SHOT] * quality)


def grid_values(ev: DataFrame) -> DataFrame:
    """zone, value of all 192 zones from open-play actions: V = s g + M V, solved once over counts by zone pair."""
    out = F.when(F.col("kind") == "move", grid_zone("end_x", "end_y")).when(F.col("kind") == "shot", SHOT).otherwise(LOSS)
    a = ev.where("kind is not null").select(grid_zone("x", "y").alias("z0"), out.alias("out"), F.when(F.col("kind") == "shot", F.col("xg")).alias("xg"))
    counts = a.where("z0 is not null and out is not null").groupBy("z0", "out").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("xg"), F.lit(0.0)), 6).alias("xg"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros((GRID, GRID + 2))
        z, o = g["z0"].to_numpy(int), g["out"].to_numpy(int)
        c[z, o] = g["n"].to_numpy(float)
        xg = np.zeros(GRID)
        np.add.at(xg, z, g["xg"].to_numpy(float))
        return pd.DataFrame({"zone": np.arange(GRID), "value": solved_grid(c, xg)})

    return counts.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "zone int, value double")


def action_values(ev: DataFrame) -> DataFrame:
    """Events with action, v_start, v_end and value: what the action added. Null where nothing is valued."""
    table = grid_values(ev).agg(F.sort_array(F.collect_list(F.struct("zone", "value"))).alias("v")).select(F.col("v.value").alias("grid"))
    at = lambda x, y: F.try_element_at("grid", grid_zone(x, y) + 1)
    e = ev.withColumn("action", F.expr(pitch.ACTION)).crossJoin(F.broadcast(table))
    e = e.withColumn("v_start", F.when(F.col("action").isNotNull(), at("x", "y"))).withColumn("v_end", F.when(F.col("action").isNotNull(), at("end_x", "end_y"))).drop("grid")
    gain = F.when(F.col("action") == "move", F.col("v_end") - F.col("v_start")).when(F.col("action") == "shot", F.coalesce("xg", F.lit(0.0)) - F.col("v_start")).when(F.col("action") == "turnover", -F.col("v_start"))
    return e.withColumn("value", gain)


def season_ledger(ev: DataFrame) -> DataFrame:
    """The ledger with threat, threat in transition and late, and recoveries, made and conceded."""
    up = F.greatest(F.col("value"), F.lit(0.0))
    total = lambda c: F.round(F.coalesce(F.sum(F.when(c, up)), F.lit(0.0)), 6)
    acts = action_values(ev).where("action is not null").groupBy("match_id", "team_id").agg(total(F.lit(True)).alias("threat"), total(F.col("transition")).alias("threat_transition"), total(F.col("bucket") == "60-90+").alias("threat_late"))
    won = ev.groupBy("match_id", "team_id").agg(count_if(WON).alias("recoveries"), count_if(f"{WON} and x >= 80").alias("recoveries_high"))
    made = ["threat", "threat_transition", "threat_late"]
    led = ledger(ev).join(acts, ["match_id", "team_id"], "left").join(won, ["match_id", "team_id"], "left").fillna(0.0, made)
    other = acts.select("match_id", F.col("team_id").alias("opp_id"), *(F.col(c).alias(f"opp_{c}") for c in made))
    return led.join(other, ["match_id", "opp_id"], "left").fillna(0.0, [f"opp_{c}" for c in made])
