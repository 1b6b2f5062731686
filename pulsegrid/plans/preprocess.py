"""Cleaning a table of series: counters, grid, gaps, outliers, scale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.scalar import is_counter_name
from pulsegrid.operators.counters import unwrap_counters
from pulsegrid.operators.gaps import fill_gaps
from pulsegrid.operators.normalize import minmax_normalize, robust_normalize, z_normalize
from pulsegrid.operators.ordering import DEFAULT, Layout
from pulsegrid.operators.outliers import replace_outliers
from pulsegrid.operators.resample import resample_uniform


@dataclass(frozen=True)
class PreprocessConfig:
    unwrap_counters: bool = True
    counter_bits: int = 64
    fill_gaps: bool = True
    gap_method: str = "linear"
    max_gap: float | None = None
    handle_outliers: bool = True
    outlier_method: str = "iqr"
    outlier_replacement: str = "median"
    resample: bool = False
    resample_interval: float | None = None
    normalize: bool = False
    normalize_method: str = "zscore"
    #: Leave values alone for every method but zscore.
    strict_parity: bool = False

    def steps(self) -> list[str]:
        """Steps that apply to every series (counters are decided by name)."""
        on = [("resample", self.resample and bool(self.resample_interval)), ("fill_gaps", self.fill_gaps),
              ("handle_outliers", self.handle_outliers), ("normalize", self.normalize)]
        return [name for name, used in on if used]


def preprocess(rows: DataFrame, config: PreprocessConfig = PreprocessConfig(),
               layout: Layout = DEFAULT) -> DataFrame:
    """Clean every series.  ``raw`` keeps the value read, unless the grid changed."""
    c = config
    out = rows.withColumn("raw", F.col("value"))
    if c.unwrap_counters:
        out = unwrap_counters(out, c.counter_bits, only=is_counter_name(F.col("series_id")), layout=layout)
    if c.resample and c.resample_interval:
        out = resample_uniform(out, c.resample_interval, layout=layout).withColumn("raw", F.col("value"))
    if c.fill_gaps:
        out = fill_gaps(out, c.gap_method, c.max_gap, layout)
    if c.handle_outliers:
        out = replace_outliers(out, c.outlier_method, c.outlier_replacement)
    if c.normalize:
        scale = {"zscore": z_normalize, "minmax": minmax_normalize, "robust": robust_normalize}
        if c.normalize_method not in scale:
            raise ValueError(f"unknown normalisation {c.normalize_method!r}, expected one of {sorted(scale)}")
        if c.normalize_method == "zscore" or not c.strict_parity:
            out = scale[c.normalize_method](out)
    return out.drop("cell", "sub")


def steps_applied(rows: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """``(series_id, steps)``: what :func:`preprocess` does to each series."""
    always = F.array(*[F.lit(s) for s in config.steps()]).cast("array<string>")
    counters = is_counter_name(F.col("series_id")) & F.lit(config.unwrap_counters)
    steps = F.when(counters, F.concat(F.array(F.lit("unwrap_counters")), always)).otherwise(always)
    return rows.select("series_id").distinct().withColumn("steps", steps)
