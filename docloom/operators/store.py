"""Keyed tables: insert-or-ignore, upsert, routing and review reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that route a question and words that deny it.
ROUTED = "ระเบียบ|ประกาศ|ข้อบังคับ|กฎหมาย|ราชการ|ทะเบียน|ทุนการศึกษา"
DENIED = "hack|แฮ็ก|ทำร้าย|phishing"


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows whose key is new, the first of each key."""
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(key), key, "left_anti").select(*incoming.columns)


def upsert(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; aggregated on the map side, so repeated keys don't pile up."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def route(question: Column, thai_share: Column, context: Column | None = None, hint: Column | None = None) -> Column:
    """Model A for Thai or official questions, else B; ``thai_share`` is the sum of question's and context's
    shares where there is a context. A hint of "A" or "B" decides."""
    said = question.rlike(ROUTED) if context is None else question.rlike(ROUTED) | F.coalesce(context, F.lit("")).rlike(ROUTED)
    chosen = F.when((thai_share >= 0.55) | said, "A").otherwise("B")
    return chosen if hint is None else F.when(hint.isin("A", "B"), hint).otherwise(chosen)


def denied(question: Column) -> Column:
    return F.lower(question).rlike(DENIED)
