"""User code over column batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def batch_map(
    df: DataFrame,
    fn: Callable[..., pd.DataFrame],
    schema: StructType | str,
    **bound: object,
) -> DataFrame:
    """Apply ``fn(batch, **bound)`` to Arrow batches of rows; the schema is declared."""
    apply = partial(fn, **bound)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(apply, batches)

    return df.mapInPandas(run, schema)
