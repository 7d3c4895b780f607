"""Sources that fail, at planning or while they are read: the part is left out, the others go on, and a warning says why.

Only failures of a source count (SOURCES): a column misspelt in our own code stays an error."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

#: Spark's conditions for a source that isn't there, has no schema, or can't be read to its end.
SOURCES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE", "TABLE_OR_VIEW_NOT_FOUND", "MALFORMED_RECORD_IN_PARSING", "MALFORMED_CSV_RECORD")
FAILURES = (PySparkException, Py4JJavaError)


def source_failure(error: Exception) -> str | None:
    """The condition of a source's failure, which may be the cause of another error; None: something else went wrong."""
    if isinstance(error, PySparkException):
        conditions = [error.getCondition()]
        cause = getattr(error, "_origin", None)
    else:
        conditions, cause = [], error.java_exception
    while cause is not None:
        if "Spark" in cause.getClass().getSimpleName() or "Analysis" in cause.getClass().getSimpleName():
            conditions.append(cause.getCondition())
        cause = cause.getCause()
    tops = [c.split(".")[0] for c in conditions if c]
    return next((c for c in tops if c in SOURCES), None)


def _union(parts: list[DataFrame], warnings: list[tuple[str, str]]) -> DataFrame:
    if not parts:
        raise ValueError("no factor could be loaded: " + "; ".join(f"{k}: {v}" for k, v in warnings))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def loaded(parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The union of the parts that can be planned, and (label, condition) of those whose source isn't there. None at all: an error."""
    kept, warnings = [], []
    for label, part in parts.items():
        try:
            rows = part()
            rows.schema  # noqa: B018 - resolves the plan
            kept.append(rows)
        except FAILURES as e:
            if not (why := source_failure(e)):
                raise
            warnings.append((label, why))
    return _union(kept, warnings), warnings


def isolated(spark: SparkSession, parts: dict[str, Callable[[], DataFrame]], folder: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """As `loaded`, for sources that may also fail while they are read: each part is written on its own below `folder`, which executors
    share, and read again, so one that breaks off takes no other with it and nothing is read twice."""
    kept, warnings = [], []
    for k, (label, part) in enumerate(parts.items()):
        path = f"{folder.rstrip('/')}/part-{k}"
        try:
            rows = part()
            rows.write.parquet(path)
            kept.append(spark.read.schema(rows.schema).parquet(path))
        except FAILURES as e:
            if not (why := source_failure(e)):
                raise
            warnings.append((label, why))
    return _union(kept, warnings), warnings
