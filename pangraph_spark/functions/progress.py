"""Running counts of what was processed, and when a report or a snapshot is due."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Progress:
    """Counts up; ``report(total)`` is called when the count passes a multiple of ``every``."""

    def __init__(self, every: int, report=lambda total: print(f"processed {total}")):
        self.every, self.report, self.total = every, report, 0

    def add(self, n: int) -> bool:
        """Whether a multiple was reached by ``n`` more; counts that jump over several report once."""
        before, self.total = self.total, self.total + n
        due = self.total // self.every > before // self.every
        if due:
            self.report(self.total)
        return due


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get["rows"]`` is its number of rows, once it has been written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias(name)), seen
