"""Parameters of a run and their valid ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INF = float("inf")

#: Valid ranges (fixed values).
RANGES = {
    "alpha": (0.01, 10.0),
    "beta": (0.01, 1.0),
    "w_1": (0.0, 1.0),
    "w_2": (0.0, 1.0),
    "w_3": (0.0, 1.0),
    "rcd": (1.0, 10.0),
    "f": (0.01, 1.0),
    "alpha_gw": (0.01, 1.0),
    "x": (0.0, 1.0),
    "fpar_min": (0.0, 1.0),
    "fpar_max": (0.0, 1.0),
    "lai_max": (0.0, 12.0),
    "i_imp": (0.0, 3.0),
    "t_ini": (0.0, 1.0),
    "bfw_ini": (0.0, INF),
    "bfw_lim": (0.0, INF),
    "s_sat_ini": (0.0, INF),
}


@dataclass(frozen=True)
class Parameters:
    """Calibration, constants, initial conditions and the side of a square cell [m]."""

    alpha: float = 4.5
    beta: float = 0.5
    w_1: float = 0.333
    w_2: float = 0.333
    w_3: float = 0.334
    rcd: float = 5.0
    f: float = 0.5
    alpha_gw: float = 0.5
    x: float = 0.5
    fpar_min: float = 0.001
    fpar_max: float = 0.95
    lai_max: float = 12.0
    i_imp: float = 2.5
    t_ini: float = 1.0
    bfw_ini: float = 0.1
    bfw_lim: float = 1.0
    s_sat_ini: float = 1.1
    grid: float = 500.0

    @property
    def area(self) -> float:
        """Of a cell [m2]."""
        return self.grid * self.grid

    def problems(self) -> list[str]:
        values = asdict(self)
        found = [f"{k} is not in [{lo}, {hi}]" for k, (lo, hi) in RANGES.items() if not lo <= values[k] <= hi]
        total = self.w_1 + self.w_2 + self.w_3
        if abs(total - 1) > 1e-9 * max(abs(total), 1):
            found.append("w_1 + w_2 + w_3 is not 1")
        if self.fpar_max < self.fpar_min:
            found.append("fpar_max is less than fpar_min")
        if not self.grid > 0:
            found.append("grid is not positive")
        return found

    def checked(self) -> Parameters:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


@dataclass(frozen=True)
class Outputs:
    """Which variables a run writes."""

    itp: bool = True
    bfw: bool = True
    srn: bool = True
    eta: bool = True
    lfw: bool = True
    rec: bool = True
    smc: bool = True
    rnf: bool = True
    arn: bool = True

    def enabled(self) -> tuple[str, ...]:
        return tuple(k for k, v in asdict(self).items() if v)

    def any(self) -> bool:
        return bool(self.enabled())

    def all(self) -> bool:
        return all(asdict(self).values())


@dataclass(frozen=True)
class ParameterColumns:
    """Parameters that each row has in columns of these names, as after a sweep; what ``fixed`` has is the same for all rows."""

    fixed: Parameters
    columns: tuple[str, ...]

    def __getattr__(self, name: str):
        if name in ("fixed", "columns") or name.startswith("_"):
            raise AttributeError(name)
        return name if name in self.columns else getattr(self.fixed, name)


def valid_parameters(df: DataFrame) -> DataFrame:
    """Adds ``problems`` (array of texts) and ``valid`` to a table of parameter sets.

    The columns of RANGES that the table has are checked; a NULL is a problem.
    """
    rules = [(~F.coalesce(F.col(k).between(lo, hi), F.lit(False)), f"{k} is not in [{lo}, {hi}]") for k, (lo, hi) in RANGES.items() if k in df.columns]
    if {"w_1", "w_2", "w_3"} <= set(df.columns):
        total = F.col("w_1") + F.col("w_2") + F.col("w_3")
        rules.append((~F.coalesce(F.abs(total - 1) <= 1e-9 * F.greatest(F.abs(total), F.lit(1.0)), F.lit(False)), "w_1 + w_2 + w_3 is not 1"))
    if {"fpar_min", "fpar_max"} <= set(df.columns):
        rules.append((F.col("fpar_max") < F.col("fpar_min"), "fpar_max is less than fpar_min"))
    if "grid" in df.columns:
        rules.append((~F.coalesce(F.col("grid") > 0, F.lit(False)), "grid is not positive"))
    problems = F.filter(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]), lambda x: x.isNotNull())
    return df.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)
