"""Thresholds and fixed vocabularies of the behaviour operators."""

from __future__ import annotations

from dataclasses import dataclass

# Activity ids are positions in this list; features in the order that tables and rules use.
ACTIVITIES = (
    "walking standing sitting lying_down standing_up sitting_down bending_reaching falling fallen_on_ground eating drinking "
    "cooking_food_prep taking_medication watching_tv reading using_phone cleaning_housework personal_hygiene interacting_with_person other_idle"
).split()
SEDENTARY = ("sitting", "lying_down", "watching_tv", "reading", "other_idle")
TRACKED = (
    "walking_duration_s walking_bouts mean_bout_duration_s room_transitions sit_to_stand_count mean_sit_to_stand_duration_s sitting_duration_s "
    "lying_duration_s longest_inactive_block_s meal_events eating_duration_s drinking_events medication_events tv_duration_s "
    "social_interaction_duration_s housework_duration_s mobility_index sedentary_ratio"
).split()
UNTRACKED = "standing_duration_s cooking_duration_s reading_duration_s phone_events visitor_count fall_events max_post_fall_immobility_s".split()
DRIFT = "walking_duration_s room_transitions sit_to_stand_count mobility_index social_interaction_duration_s".split()
OWN_RULE = "mobility_index meal_events drinking_events medication_events social_interaction_duration_s lying_duration_s longest_inactive_block_s".split()
SEVERITY = {"info": 0, "advisory": 1, "urgent": 2, "emergency": 3}


@dataclass(frozen=True)
class Thresholds:
    """One operating point; every rule and window reads its numbers from here."""

    window_days: int = 14
    least_days: int = 7
    split_weekends: bool = True
    least_hours: float = 8.0
    least_coverage: float = 0.6
    gate_absence: bool = True
    z_limit: float = 3.0
    z_clamp: float = 10.0
    mad_floor: float = 0.05
    sustained_days: int = 3
    routine_days: int = 2
    cusum_slack: float = 0.75
    cusum_limit: float = 5.0
    cusum_decay: float = 0.98
    cusum_warmup: int = 7
    social_drift: bool = True
    inactivity_s: float = 14400.0
    post_fall_s: float = 60.0
    bridge_s: float = 60.0
    meal_gap_s: float = 3600.0
    least_meals: int = 2
    least_drinks: int = 4

    @property
    def weekday_span(self) -> int:
        return self.window_days * 7 // 5

    @property
    def weekend_span(self) -> int:
        return self.window_days * 7 // 2
