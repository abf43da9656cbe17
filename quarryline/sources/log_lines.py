"""Progress told by a run's log lines (SRC-15), for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the lines of a run look like.
FILE_LINE = r"\b(OK|FAIL)\s+\[(\d{1,9})\s*/\s*(\d{1,9})\]"
START_LINE = r"===\s*run start:\s*(\d{1,9})\s+entries"
STOP_LINE = r"\bINTERRUPTED\b"


def progress_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add done, total, failed, interrupted; lines that say nothing of progress go."""
    text = F.col(column)
    number = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit("")).cast("int")
    file_line = text.rlike(FILE_LINE)
    d = lines.withColumns({
        "done": number(FILE_LINE, 2), "total": F.coalesce(number(FILE_LINE, 3), number(START_LINE, 1)),
        "failed": file_line & (F.regexp_extract(text, FILE_LINE, 1) == "FAIL"), "interrupted": ~file_line & ~text.rlike(START_LINE) & text.rlike(STOP_LINE),
    })
    return d.where("done is not null or total is not null or interrupted")
