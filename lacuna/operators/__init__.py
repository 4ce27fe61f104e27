from lacuna.operators.analysis import (
    analysis_set,
    parameter_rows,
    response_lag,
    three_way_table,
)
from lacuna.operators.cells import design_of, model_cells
from lacuna.operators.logit import level_ratios, odds_ratios
from lacuna.operators.mechanisms import (
    Draws,
    mar_draws,
    mark_dropout,
    mark_level,
    mask_from,
    mcar_draws,
)
from lacuna.operators.profile import subject_profile
from lacuna.operators.sampling import draw_cuts, is_drawn, sample_exact
from lacuna.operators.strategies import (
    complete_case,
    completers,
    impute_composite,
    impute_locf,
)

__all__ = [
    "Draws",
    "analysis_set",
    "complete_case",
    "completers",
    "design_of",
    "draw_cuts",
    "impute_composite",
    "impute_locf",
    "is_drawn",
    "level_ratios",
    "mar_draws",
    "mark_dropout",
    "mark_level",
    "mask_from",
    "mcar_draws",
    "model_cells",
    "odds_ratios",
    "parameter_rows",
    "response_lag",
    "sample_exact",
    "subject_profile",
    "three_way_table",
]
