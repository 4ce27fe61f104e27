"""Table shapes, model design and the settings of one simulation study."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

RESPONSE_SCHEMA = T.StructType(
    [
        T.StructField("SUBJID", T.LongType(), False),
        T.StructField("PARAMN", T.IntegerType()),
        T.StructField("AVISITN", T.IntegerType()),
        T.StructField("AVISIT", T.StringType()),
        T.StructField("AVAL", T.DoubleType()),
        T.StructField("PCHG", T.DoubleType()),
        T.StructField("PCHGCA1N", T.IntegerType()),
        T.StructField("TRTP", T.StringType()),
        T.StructField("TRTPN", T.IntegerType()),
    ]
)

SUBJECT_SCHEMA = T.StructType(
    [
        T.StructField("SUBJID", T.LongType(), False),
        T.StructField("SEX", T.StringType()),
    ]
)

RESPONSE = "PCHGCA1N"
LAGGED = "LAGPCHGCA1N"

# The names results are reported under.
STRATEGIES = ("completers", "imputed", "locf")


@dataclass(frozen=True)
class Factor:
    """A categorical predictor; the first level present in the data is the base."""

    name: str
    levels: tuple[str, ...]


@dataclass(frozen=True)
class Contrast:
    """The odds ratio of ``level`` against ``reference`` within one factor."""

    name: str
    factor: str
    level: str
    reference: str


@dataclass(frozen=True)
class Design:
    """Main-effects logistic model on factors, with the odds ratios to report."""

    factors: tuple[Factor, ...]
    contrasts: tuple[Contrast, ...]

    @property
    def factor_names(self) -> list[str]:
        return [f.name for f in self.factors]

    @property
    def n_cells(self) -> int:
        size = 1
        for factor in self.factors:
            size *= len(factor.levels)
        return size

    def cell_levels(self, cell: int) -> tuple[str, ...]:
        """Factor levels of one cell of the crossed design, first factor slowest."""
        picked = []
        for factor in reversed(self.factors):
            cell, at = divmod(cell, len(factor.levels))
            picked.append(factor.levels[at])
        return tuple(reversed(picked))

    def terms(self) -> list[tuple[str, str]]:
        """Every (factor, level), in the order of the coefficients after the intercept."""
        return [(f.name, level) for f in self.factors for level in f.levels]

    def position(self, factor: str, level: str) -> int:
        """Zero-based place of a level's coefficient; the intercept is 0."""
        return 1 + self.terms().index((factor, level))


# The four arms, two sexes and four reported odds ratios.
DEFAULT_DESIGN = Design(
    factors=(
        Factor("SEX", ("F", "M")),
        Factor("TRTP", ("ACTIVE", "PLACEBO", "TEST 140MG", "TEST 210MG")),
    ),
    contrasts=(
        Contrast("AvsP", "TRTP", "ACTIVE", "PLACEBO"),
        Contrast("SexM2F", "SEX", "M", "F"),
        Contrast("T140vsP", "TRTP", "TEST 140MG", "PLACEBO"),
        Contrast("T210vsP", "TRTP", "TEST 210MG", "PLACEBO"),
    ),
)


@dataclass(frozen=True)
class MarRates:
    """Dropout rates of one MAR scenario: poor responders, then everybody else."""

    high: float
    low: float
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"MAR {100 * self.high:g}/{100 * self.low:g}%"


def mcar_label(rate: float) -> str:
    return f"MCAR {100 * rate:g}%"


# The scenario menus.
MCAR_RATES = (0.1, 0.2, 0.3)
MAR_SCRIPT = (MarRates(0.3, 0.05, "MAR"),)
MAR_HIGH_RATES = (0.3, 0.25, 0.2)
MAR_LOW_RATES = (0.1, 0.075, 0.05)
MAR_MENU = tuple(MarRates(h, low) for h in MAR_HIGH_RATES for low in MAR_LOW_RATES)
REPLICATES = range(1, 1001)


@dataclass(frozen=True)
class Study:
    """Which rows are analysed and when a response counts as poor."""

    parameter: int = 10
    skipped_visit: int | None = 2
    analysis_visit: int = 6
    dropout_visits: tuple[int, ...] = (4, 5, 6)
    poor_cut: float = 10.0
    poor_below: bool = True
    #: Column that orders several rows of a subject at one visit.
    tie: str | None = None
    design: Design = field(default=DEFAULT_DESIGN)

    def with_visits(self, *visits: int) -> Study:
        return replace(self, dropout_visits=tuple(visits))


DEFAULT_STUDY = Study()
