"""Registry of runnable jobs over the test tables, each with its SQL oracle.

Every entry is ``(spark, sf_dir) -> DataFrame`` and reads the full test
tables (through the stand-in views of ``sources.standins``). The oracle is an
independent SQL text over the raw tables, for DuckDB; it repeats the stand-in
projection in a CTE, so no code is shared with the Spark side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    job: Job
    oracle: str | None


_REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Job], Job]:
    """Decorator: add a job (and its SQL oracle, if SQL can state it)."""

    def wrap(job: Job) -> Job:
        if name in _REGISTRY:
            raise ValueError(f"duplicate job name {name!r}")
        _REGISTRY[name] = Entry(name, job, oracle)
        return job

    return wrap


def oracle_of(name: str) -> str | None:
    """The SQL of a job that is registered already."""
    return _REGISTRY[name].oracle


def jobs() -> dict[str, Job]:
    from . import standin_jobs, stored_jobs  # noqa: F401  (importing registers the jobs)

    return {name: e.job for name, e in _REGISTRY.items()}


def oracles() -> dict[str, str]:
    from . import standin_jobs, stored_jobs  # noqa: F401

    return {name: e.oracle for name, e in _REGISTRY.items() if e.oracle is not None}
