"""Text column functions for solver log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arcweave.functions.util import as_col

# The progress-line shape and the closing lines of a run.
PROGRESS_PATTERN = r"Iteration No\. (\d+) distance=([0-9.eE+-]+)"
FINISHED_PATTERN = r"^\[app\] Solve finished in "
FAILED_PATTERN = r"^\[app\] Solve FAILED"
ABORT_PATTERN = r"^\[app\] Abort requested"


def progress_iteration(line) -> Column:
    """Iteration number of a progress line, else null."""
    return F.regexp_extract(as_col(line), PROGRESS_PATTERN, 1).try_cast("long")


def progress_distance(line) -> Column:
    """Distance of a progress line, else null."""
    line = as_col(line)
    return F.when(line.rlike(PROGRESS_PATTERN),
                  F.regexp_extract(line, PROGRESS_PATTERN, 2).try_cast("double"))


def parse_progress(line) -> Column:
    """``struct(iteration, distance)``; both null when the line is not a progress line."""
    it = progress_iteration(line)
    dist = progress_distance(line)
    ok = it.isNotNull() & dist.isNotNull()
    return F.struct(F.when(ok, it).alias("iteration"), F.when(ok, dist).alias("distance"))
