"""Missing-data simulation for visit-based trials, as Spark DataFrame jobs."""

from lacuna.study import (
    DEFAULT_DESIGN,
    DEFAULT_STUDY,
    Contrast,
    Design,
    Factor,
    MarRates,
    Study,
)

__all__ = [
    "DEFAULT_DESIGN",
    "DEFAULT_STUDY",
    "Contrast",
    "Design",
    "Factor",
    "MarRates",
    "Study",
]
