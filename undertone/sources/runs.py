"""Sources run one by one, so that one that fails, even in a task, leaves an error row and not an empty answer."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from undertone.operators.search import union_sources
from undertone.session import settle

AT_ONCE = 8
MESSAGE_LENGTH = 500
ERRORS = "source STRING, error_class STRING, message STRING"


def _described(error: Exception) -> tuple[str, str]:
    """(class, message) of a failure: the innermost Java exception where there is one."""
    cause = getattr(error, "_cause", None) or error
    while getattr(cause, "_cause", None) is not None:
        cause = cause._cause
    java = getattr(cause, "java_exception", None)
    if java is not None:
        while java.getCause() is not None:
            java = java.getCause()
        return java.getClass().getSimpleName(), str(java.getMessage())[:MESSAGE_LENGTH]
    return type(cause).__name__, str(cause)[:MESSAGE_LENGTH]


def run_sources(spark: SparkSession, readers: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, DataFrame]:
    """(rows, errors): the union of the sources that ran to their end, and one row per source that did not.

    ``readers`` maps a source to what makes its DataFrame. Each source is written as a table of its own, several at the
    same time; what failed in a task has written nothing that is read. ``rows`` is None if all failed. Only errors of
    Spark count as a failed source; a mistake in a reader's own Python code is raised.
    """
    def one(source: str) -> DataFrame | tuple[str, str, str]:
        try:
            return settle(readers[source]())
        except (PySparkException, Py4JJavaError) as error:
            return source, *_described(error)

    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(readers)))) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(one), readers))
    kept = [d for d in done if isinstance(d, DataFrame)]
    failed = [d for d in done if not isinstance(d, DataFrame)]
    return union_sources(kept) if kept else None, spark.createDataFrame(failed, ERRORS)
