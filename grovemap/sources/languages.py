"""Languages by file extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {"javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx", "mts", "cts"], "python": ["py", "pyw", "pyi"], "c": ["c", "h"]}
BY_EXTENSION = {e: name for name, es in EXTENSIONS.items() for e in es}


def language_of(path: Column) -> Column:
    """Language of a path; null for extensions that have no parser."""
    pairs = F.create_map(*[F.lit(x) for kv in BY_EXTENSION.items() for x in kv])
    return F.element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))
