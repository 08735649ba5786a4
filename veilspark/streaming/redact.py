"""Redaction of streams: numbering is per row, so a stream is a stateless projection in append mode."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..functions import detectors
from ..operators.redaction import redact


def redact_stream(df: DataFrame, names: Iterable[str] = detectors.DEFAULT, text_col: str = "text") -> DataFrame:
    """Like `redact`; the plan must hold no stateful operator, so there is no watermark and no late data."""
    if not df.isStreaming:
        raise ValueError("not a stream")
    return redact(df, names, text_col)
