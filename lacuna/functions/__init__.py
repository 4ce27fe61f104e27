from lacuna.functions.columns import (
    cell_code,
    draw_key,
    pick,
    poor_response,
    sample_size,
    standard_normal_quantile,
)
from lacuna.functions.staging import (
    attach_small,
    kept_tables,
    settle,
    settle_counting,
    tasks_for,
)

__all__ = [
    "attach_small",
    "cell_code",
    "kept_tables",
    "draw_key",
    "pick",
    "poor_response",
    "sample_size",
    "settle",
    "settle_counting",
    "standard_normal_quantile",
    "tasks_for",
]
