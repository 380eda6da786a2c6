"""Join helpers."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TASK_PARAMS = 4096  # parameter rows that a task may hold


def attach_rows(df: DataFrame, params: DataFrame, task_params: int = TASK_PARAMS, tasks: int | None = None) -> DataFrame:
    """Every row of ``df`` once per row of a parameter table of any size.

    A parameter table of at most ``task_params`` rows (one count of that many rows at most decides) is sent to all tasks as
    one row that holds it, and ``df`` stays where it is: no shuffle and no copy of its rows. A larger
    one is cut into ``c`` parts of that size and ``df`` into ``r`` parts, so that there are about ``tasks`` (the shuffle
    partitions) pairs of parts; each pair is one key of an equi-join. Rows of ``df`` are copied ``c`` times,
    parameters ``r`` times, the least that lets every task hold its parameters.
    """
    cols = [f"`{c}`" for c in df.columns]
    if params.limit(task_params + 1).count() <= task_params:
        held = params.agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in params.columns])).alias("_params"))
        return df.crossJoin(F.broadcast(held)).select(*cols, F.inline("_params"))  # one row
    tasks = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = ceil(params.count() / task_params)
    r = max(1, ceil(tasks / c))
    p = params.select(F.pmod(F.xxhash64(*[f"`{x}`" for x in params.columns]), F.lit(c)).alias("_c"),
                      F.explode(F.sequence(F.lit(0), F.lit(r - 1))).alias("_r"),
                      *[F.col(f"`{x}`").alias(f"_p_{x}") for x in params.columns])
    rows = df.select(*cols, F.pmod(F.monotonically_increasing_id(), F.lit(r)).cast("int").alias("_r"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c - 1).cast("long"))).alias("_c"))
    return rows.join(p, ["_r", "_c"]).select(*cols, *[F.col(f"`_p_{x}`").alias(x) for x in params.columns])
