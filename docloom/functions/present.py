"""Presentation columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_size(n: Column) -> Column:
    """Bytes in units of 1024 with one decimal."""
    unit = F.least(F.greatest(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(0)), F.lit(4))
    names = F.array(*[F.lit(x) for x in ("B", "KB", "MB", "GB", "TB")])
    return F.when(n.isNull() | (n <= 0), "0 B").otherwise(F.concat(F.format_string("%.1f", n / F.pow(F.lit(1024.0), unit)), F.lit(" "), F.element_at(names, (unit + 1).cast("int"))))


def type_label(type_: Column) -> Column:
    t = F.lower(type_)
    return F.when(F.contains(t, F.lit("pdf")), "PDF").when(F.contains(t, F.lit("word")) | F.contains(t, F.lit("document")), "DOCX").when(F.contains(t, F.lit("markdown")), "MD").when(F.contains(t, F.lit("text")), "TXT").otherwise("File")


def stars(score: Column) -> Column:
    return F.floor(score * 5 + 0.5).cast("int")


def recency_label(day: Column, as_of: Column) -> Column:
    months = (F.year(as_of) - F.year(day)) * 12 + F.month(as_of) - F.month(day) + (F.dayofmonth(as_of) - F.dayofmonth(day)) / 30
    m = F.greatest(F.lit(0), F.floor(months)).cast("int")
    return F.when(day.isNull(), None).when(m < 6, "Updated recently").when(m < 12, F.concat(F.lit("Updated "), m.cast("string"), F.when(m == 1, " month ago").otherwise(" months ago"))).otherwise("Older content")
