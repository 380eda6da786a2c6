"""Registry of named queries with their DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the supplied
tables. Double columns are rounded to 9 significant digits on both sides so a
last-bit difference in summation order does not change the comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.checks.sqlparts import NET_T, stable, with_ctes
from arcweave.functions import at_digits


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple[str, ...] = field(default_factory=tuple)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return stabilise(self.build(spark, sf_dir), self.doubles)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.doubles:
            return self.sql
        repl = ", ".join(f'{stable(q(c))} AS "{c}"' for c in self.doubles)
        return f"SELECT * REPLACE ({repl}) FROM (\n{self.sql}\n) AS oracle_q"


REGISTRY: dict[str, Query] = {}


def q(c: str) -> str:
    return f'"{c}"'


def register(name: str, sql: str | None = None, doubles: tuple[str, ...] | list[str] = (),
             ctes: list | None = None):
    """Decorator: register a query; ``sql`` is the final SELECT, NET-T CTEs are prepended."""
    def deco(fn):
        text = None
        if sql is not None:
            parts = NET_T if ctes is None else ctes
            text = with_ctes(parts, sql) if parts else sql
        REGISTRY[name] = Query(name, fn, text, tuple(doubles))
        return fn
    return deco


def _whole(y) -> "F.Column":
    """Nearest whole double, halves away from zero."""
    near = F.rint(y)
    return near + F.signum(y) * (F.abs(y) - F.abs(near) == 0.5).cast("double")


def stable_col(x) -> "F.Column":
    """Comparison rounding: k = 9 significant digits, half away from zero."""
    return at_digits(F.nanvl(x, F.lit(None).cast("double")), 9, _whole)


def stabilise(df: DataFrame, doubles) -> DataFrame:
    if not doubles:
        return df
    ds = set(doubles)
    return df.select(*[stable_col(F.col(f"`{c}`")).alias(c) if c in ds else F.col(f"`{c}`")
                       for c in df.columns])


@contextmanager
def split_size(spark, n_bytes):
    """Files are read in blocks of ``n_bytes`` inside; scans are planned when they are first used."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


BLOCKS_A_FILE = 4
MOST_OF_A_BLOCK = 128 << 20


@contextmanager
def small_blocks(spark, path, least):
    """The files of ``path`` are read in blocks of about a quarter of a file inside, and of ``least`` bytes at least.

    So every larger file is cut, and the number of tasks follows the number of files, not the bytes. The sizes are those
    of the file listing; no block is larger than 128 MB, Spark's default.
    """
    n_bytes, n_files = spark.read.format("binaryFile").load(path).agg(F.sum("length"), F.count(F.lit(1))).first()
    size = -(-(n_bytes or 0) // (BLOCKS_A_FILE * max(n_files, 1)))
    with split_size(spark, min(max(size, least), MOST_OF_A_BLOCK)):
        yield
