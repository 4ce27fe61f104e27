from lacuna.plans.custom import Flagged, Sampled, own_cells, run_own
from lacuna.plans.frames import (
    forest_frame,
    single_draw_frame,
    truth_frame,
    variance_frame,
)
from lacuna.plans.montecarlo import (
    compare_once,
    complete_odds_ratios,
    mar_cells,
    mar_locf_all_visits,
    mc_summary,
    mcar_cells,
    run_mar,
    run_mcar,
)
from lacuna.plans.rows import mar_rows, mcar_rows

__all__ = [
    "Flagged",
    "Sampled",
    "compare_once",
    "complete_odds_ratios",
    "forest_frame",
    "mar_cells",
    "mar_locf_all_visits",
    "mar_rows",
    "mc_summary",
    "mcar_cells",
    "mcar_rows",
    "own_cells",
    "run_mar",
    "run_mcar",
    "run_own",
    "single_draw_frame",
    "truth_frame",
    "variance_frame",
]
