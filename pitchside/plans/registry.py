"""The catalog of registered queries, name -> ``(spark, sf_dir) -> DataFrame``.

Question, transform and statistic entries derive the star schema from the
driver's tables in ``sf_dir`` (lazily, so Catalyst prunes the projection to the
columns the query uses); ingestion entries render season-file rows from the same
tables and run the loader on them. Every entry returns its DataFrame without
collecting it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import fixture_star
from .browser_stats import BROWSER_STATS
from .ingest_outputs import INGEST_OUTPUTS
from .questions import QUESTIONS
from .transforms import TRANSFORMS

QueryFn = Callable[[SparkSession, str], DataFrame]


def _on_star(job) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return job(fixture_star(spark, sf_dir))
    run.__name__ = job.__name__
    run.__doc__ = job.__doc__
    return run


def registry() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for name, job in {**QUESTIONS, **TRANSFORMS, **BROWSER_STATS}.items():
        out[name] = _on_star(job)
    out.update(INGEST_OUTPUTS)
    return out
