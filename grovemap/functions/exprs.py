"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """a / b, or `empty` where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def log_or_low(x: Column) -> Column:
    """Natural logarithm; minus infinity at 0, where Spark gives null."""
    return F.coalesce(F.ln(x), F.lit(float("-inf")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def scaled(x: Column, low: Column, high: Column, empty: float = 0.5) -> Column:
    """(x - low) / (high - low) within [0, 1]; `empty` where the range is empty."""
    return F.when(F.abs(high - low) < 1e-12, F.lit(empty)).otherwise(clamp((x - low) / F.nullif(high - low, F.lit(0.0))))


def directory(path: Column) -> Column:
    """Text before the last slash; null without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def same_module(a: Column, b: Column) -> Column:
    """Both paths are there and lie in one directory; two bare names do too."""
    return F.coalesce(a.isNotNull() & b.isNotNull() & directory(a).eqNullSafe(directory(b)), F.lit(False))


def package_of(path: Column) -> Column:
    """`pkg.` and the first segment of the path; `pkg.root` without a path or a slash."""
    return F.when(path.isNull() | (F.instr(path, "/") == 0), F.lit("pkg.root")).otherwise(F.concat(F.lit("pkg."), F.split(path, "/")[0]))


def mapped(x: Column, table: dict[str, object], default: object) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.coalesce(F.element_at(pairs, x), F.lit(default))
