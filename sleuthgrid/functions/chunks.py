"""Texts in chunks that retrieval can hold."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

AFTER_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def chunk(text: str, size: int = 1200, overlap: int = 200) -> list[str]:
    """Paragraphs packed into chunks of at most size characters.

    A paragraph that is too long is packed by sentences, or by words if it is a
    single sentence, and each of its chunks begins with the last overlap
    characters of the one before. A sentence that is too long stays whole.
    """
    if not text.strip():
        return []
    if len(text) <= size:
        return [text]
    done: list[str] = []
    held = ""

    def add(unit: str, glue: str, carry: int) -> None:
        nonlocal held
        if len(held) + len(unit) + len(glue) <= size:
            held = f"{held}{glue}{unit}" if held else unit
            return
        if held:
            done.append(held)
        held = f"{held[-carry:]}{glue}{unit}" if carry and held else unit

    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if len(held) + len(paragraph) + 2 > size and len(paragraph) > size:
            if held:
                done.append(held)
                held = ""
            units = [s for s in map(str.strip, AFTER_SENTENCE.split(paragraph)) if s]
            for unit in units if len(units) > 1 else paragraph.split():
                add(unit, " ", overlap)
        else:
            add(paragraph, "\n\n", 0)
    return [*done, held] if held else done


def chunks(text: Column, size: int = 1200, overlap: int = 200) -> Column:
    """The chunks of a text, an array; what is held between paragraphs makes it a fold that expressions can't say. Null and blank texts have none."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: chunk(t, size, overlap))

    return split(text)
