"""Checks of requests: a status and a reason for each, and sessions that may be unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a query in characters and of uploads in bytes.
QUERY_CHARS, PDF_BYTES, AUDIO_BYTES, BODY_BYTES = 2000, 20 << 20, 25 << 20, 30 << 20


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def checked(requests: DataFrame) -> DataFrame:
    """requests with status (200, 400, 413) and reason (null where all is well); the first fault counts.

    requests: kind (predict, query, pdf, audio), lat, lon, date, session_id, query (texts), bytes (of the
    upload, null: none). A kind that isn't known is a fault.
    """
    kind, size = F.col("kind"), F.col("bytes")
    number = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).try_cast("double").isNull()
    faults = [
        (size > BODY_BYTES, 413, "body too large"),
        ((kind == "predict") & (number("lat") | number("lon") | F.try_to_date(F.col("date"), "yyyy-M-d").isNull()), 400, "lat, lon and date are required"),
        (kind.isin("query", "pdf") & _blank("session_id"), 400, "session_id is required"),
        ((kind == "query") & _blank("query"), 400, "query is required"),
        ((kind == "query") & (F.length("query") > QUERY_CHARS), 400, "query too long"),
        (kind.isin("pdf", "audio") & size.isNull(), 400, "file is required"),
        ((kind == "pdf") & (size > PDF_BYTES), 413, "pdf too large"),
        ((kind == "audio") & (size > AUDIO_BYTES), 413, "audio too large"),
        (kind.isNull() | ~kind.isin("predict", "query", "pdf", "audio"), 400, "unknown request"),
    ]
    status, reason = F.lit(200), F.lit(None).cast("string")
    for test, code, why in reversed(faults):
        test = F.coalesce(test, F.lit(False))
        status, reason = F.when(test, code).otherwise(status), F.when(test, why).otherwise(reason)
    return requests.withColumn("status", status).withColumn("reason", reason)


def looked_up(requests: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """requests with the columns of their session and `found`; where there is none it is false and they are null."""
    return requests.join(sessions.withColumn("__there", F.lit(True)), key, "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")
