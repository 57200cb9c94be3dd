"""Expressions over ids and display labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label lengths and the shape of a human-looking accession.
TARGET_LABEL = 12
DRUG_LABEL = 10
COMPOUND_NAME = 30
HUMAN_ID_LENGTH = 6
HUMAN_ID_INITIALS = ("P", "Q", "O")


def display_label(text: Column, length: int, ellipsis: str = "…") -> Column:
    """First ``length`` characters; the ellipsis only marks text that was cut."""
    head = F.substring(text, 1, length)
    return F.when(F.length(text) > length, F.concat(head, F.lit(ellipsis))).otherwise(head)


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def numeric_id(text: Column) -> Column:
    return F.coalesce(trimmed(text).rlike(r"^[0-9]+\z"), F.lit(False))


def human_looking(target: Column) -> Column:
    initial = F.substring(target, 1, 1)
    return (F.length(target) == HUMAN_ID_LENGTH) & initial.isin(*HUMAN_ID_INITIALS)


def non_empty(text: Column) -> Column:
    """Null instead of an empty string."""
    return F.nullif(text, F.lit(""))
