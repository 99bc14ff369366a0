"""JSON in free text and by schema."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MOST_CANDIDATES = 64


def has_keys(text: Column, required: list[str]) -> Column:
    """The required keys that a JSON object lacks, in order; null if the text is no object."""
    keys = F.json_object_keys(text)
    return F.when(keys.isNotNull(), F.array_except(F.array(*[F.lit(k) for k in required]), keys))


def balanced(text: str, required: tuple[str, ...] = ()) -> str | None:
    """The first balanced JSON object in a text that has the required keys, of at most MOST_CANDIDATES tried."""
    decode = json.JSONDecoder().raw_decode
    at = text.find("{")
    for _ in range(MOST_CANDIDATES):
        if at < 0:
            return None
        try:
            value, end = decode(text, at)
            if isinstance(value, dict) and all(k in value for k in required):
                return text[at:end]
        except ValueError:
            pass
        at = text.find("{", at + 1)
    return None


def extracted(text: Column, *required: str) -> Column:
    """balanced() as a column, in batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else balanced(t, required))

    return F.pandas_udf(run, StringType())(text)
