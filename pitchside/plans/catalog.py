"""The question catalog.

Each question has an id, a title, an optional description and either one job
or labelled parts (questions 7 and 8 have parts A and B). ``run_question``
returns the DataFrames of a question's parts; an unknown id is an error, the
reference's "not found". The parts are independent DataFrames, so a caller
may run them concurrently.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..sources.star import Star
from . import questions as q


@dataclass(frozen=True)
class Question:
    id: str
    title: str
    parts: dict = field(default_factory=dict)   # part label ("" for a single query) -> job
    description: str | None = None


CATALOG = (
    Question("1", "Which teams are the most consistent over the seasons?", {"": q.q1_consistency},
             "Points per season: mean, population spread and mean / (1 + spread)."),
    Question("2", "Which teams beat or miss the bookmaker's expectations?", {"": q.q2_expected_points},
             "Actual league points against points implied by margin-free odds."),
    Question("3", "Who turns half-time deficits into results?", {"": q.q3_comebacks}),
    Question("4", "Do more shots on target turn into wins?", {"": q.q4_pressure}),
    Question("5", "How did scoring change from season to season?", {"": q.q5_scoring}),
    Question("6", "Are the favourites' odds getting more accurate?", {"": q.q6_bookmaker}),
    Question("7", "Does aggressive play pay off?", {"A": q.q7a_aggression, "B": q.q7b_aggression_bands}),
    Question("8", "Do strict referees change outcomes?", {"A": q.q8a_referees, "B": q.q8b_referee_bands}),
)


class QuestionNotFound(KeyError):
    pass


def find(question_id: str) -> Question:
    for item in CATALOG:
        if item.id == str(question_id):
            return item
    raise QuestionNotFound(question_id)


def run_question(star: Star, question_id: str) -> dict[str, DataFrame]:
    """Part label -> result DataFrame for one question."""
    return {label: job(star) for label, job in find(question_id).parts.items()}
