"""Rules on texts: headers, intents, conditional questions, source matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions import settings as S

HEADER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
EDGE_SPACE = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def words(text: Column) -> Column:
    trimmed = strip(text)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+")))


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def intent(message: Column) -> Column:
    lowered = F.lower(message)
    result = F.lit(S.OTHER_INTENT)
    for name, needles in reversed(S.INTENT_WORDS.items()):
        result = F.when(contains_any(lowered, needles), name).otherwise(result)
    return result


def is_follow_up(message: Column) -> Column:
    lowered = F.lower(strip(message))
    short = (words(lowered) <= 6) & contains_any(lowered, S.FOLLOW_UP_WORDS)
    return contains_any(lowered, S.FOLLOW_UP_PHRASES) | short


def token_estimate(text: Column, extra: int = 0) -> Column:
    return F.floor(words(text) * F.lit(1.3)) + extra


def scenario_args(question: Column) -> dict[str, Column]:
    """Setpoint raise and early-off hours named in a conditional question, else null."""
    lowered = F.lower(question)
    asked = contains_any(lowered, S.CONDITION_CUES)
    setpoint = F.regexp_extract(lowered, S.SETPOINT_PATTERN, 1)
    early = F.regexp_extract(lowered, S.EARLY_OFF_PATTERN, 1)
    return {
        "setpoint_delta_c": F.when(asked, F.replace(setpoint, F.lit(","), F.lit(".")).try_cast("double")),
        "off_hours": F.when(asked, early.try_cast("int")),
    }


def source_matches(expected: Column, doc_id: Column, source: Column) -> Column:
    """Whether a retrieved passage comes from the expected document."""
    want = F.lower(F.trim(expected))
    stem = F.replace(want, F.lit(".md"), F.lit(""))
    doc, src = F.lower(F.coalesce(doc_id, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    long_words = F.filter(F.split(stem, "_"), lambda w: F.length(w) > 3)
    return (
        doc.contains(want) | doc.contains(stem) | src.contains(want) | src.contains(stem)
        | F.exists(long_words, lambda w: doc.contains(w))
    )
