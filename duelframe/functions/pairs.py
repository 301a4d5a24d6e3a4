"""Fields of a comparison row.

``summaries.text`` is taken before the index, so that a Parquet scan reads the
``text`` member only. Indexing raises on a choice outside {0, 1}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def post_text() -> Column:
    return F.col("info.post")


def chosen_text(choice: str = "choice") -> Column:
    return F.col("summaries.text")[F.col(choice)]


def rejected_text(choice: str = "choice") -> Column:
    return F.col("summaries.text")[F.lit(1) - F.col(choice)]
