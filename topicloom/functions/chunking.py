"""Sentence-aware chunks of long texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, Row, StringType, StructField, StructType

from topicloom.functions.text import BLOCK_CAP


def pieces(text: str, cap: int = BLOCK_CAP) -> Iterator[str]:
    """Pieces of at most ``cap`` characters, each ending after the last full stop that fits (a hard cut without one),
    without blanks around. Each cut depends on the one before. Only the piece at hand is copied."""
    start, end = 0, len(text)
    while end - start > cap:
        stop = text.rfind(". ", start, start + cap)
        cut = stop + 1 if stop >= 0 else start + cap
        yield text[start:cut].strip()
        if not start:
            while end > cut and text[end - 1].isspace():
                end -= 1
        start = cut
        while start < end and text[start].isspace():
            start += 1
    if start < end or not start:
        yield text[start:end]


@F.pandas_udf(ArrayType(StringType()))
def chunks(texts: pd.Series) -> pd.Series:
    """The pieces of short texts as an array; ``chunk_rows`` is for texts of any length."""
    return texts.map(lambda text: None if text is None else list(pieces(text)))


def chunk_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk, piece): the pieces of every text, numbered from 1. A table function: a piece is a row as soon as it is
    cut, and no array of pieces is ever built. A null text has none; an empty one has an empty piece."""
    kind = StructType([StructField(key, LongType()), StructField("chunk", LongType()), StructField("piece", StringType())])

    @F.udtf(returnType=kind)
    class Pieces:
        def eval(self, row: Row):
            if row[1] is not None:
                for i, piece in enumerate(pieces(row[1])):
                    yield row[0], i + 1, piece

    return Pieces(texts.select(F.col(key).cast("long").alias(key), text).asTable())
