"""What the test modules share besides fixtures."""

from __future__ import annotations

import numpy as np

from pulsegrid.operators.ordering import Layout

#: Series cut into many small pieces, so every carry and halo is crossed.
TINY = Layout(cell_seconds=300.0, block_rows=16)


def column(df, name="value", by=("series_id", "ts", "seq")):
    """A column in series order, missing as NaN."""
    rows = df.orderBy(*by).select(name).collect()
    return np.array([np.nan if r[0] is None else float(r[0]) for r in rows])
