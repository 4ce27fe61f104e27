from lacuna.sources.fixture import nation_arms, trial_tables
from lacuna.sources.tables import (
    load_responses,
    load_subjects,
    scenario_grid,
    seed_frame,
    subject_universe,
)

__all__ = [
    "load_responses",
    "nation_arms",
    "load_subjects",
    "scenario_grid",
    "seed_frame",
    "subject_universe",
    "trial_tables",
]
