"""Models over rows: loaded once a task, asked in batches of texts of like length, with smaller batches where memory ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def modelled(rows: DataFrame, columns: tuple[str, ...], load: Callable[[], Callable[[list[tuple[str, ...]]], list]], out: str, kind: str = "double", most: int = 64, too_large: tuple[type[BaseException], ...] = (MemoryError,)) -> DataFrame:
    """``rows`` with ``out``: what a model says of each row's texts.

    ``load`` is called once in each task and gives a function from a list of tuples of texts to as many values. A batch of rows is
    taken in order of length, ``most`` at a time; if the model fails with ``too_large``, half as many are asked
    from then on, and the failed ones again, so every row gets its value once. A single row that is too large fails the task. Null texts are
    empty ones; a column of the name ``out`` is replaced.
    """
    held = [c for c in rows.columns if c != out]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, size = load(), most
        for batch in batches:
            texts = list(zip(*[batch[c].fillna("") for c in columns], strict=True))
            order, values, at = sorted(range(len(texts)), key=lambda i: sum(map(len, texts[i]))), [None] * len(texts), 0
            while at < len(order):
                asked = order[at : at + size]
                try:
                    found = model([texts[i] for i in asked])
                except too_large:
                    if len(asked) == 1:
                        raise
                    size = max(1, len(asked) // 2)
                    continue
                if len(found) != len(asked):
                    raise ValueError(f"the model gave {len(found)} values for {len(asked)} rows")
                for i, v in zip(asked, found, strict=True):
                    values[i] = v
                at += len(asked)
            yield batch.assign(**{out: values})

    schema = ", ".join(f"`{c}` {dict(rows.dtypes)[c]}" for c in held) + f", `{out}` {kind}"
    return rows.select(*held).mapInPandas(run, schema)


def word_share() -> Callable[[list[tuple[str, ...]]], list[float]]:
    """A model of (question, text) pairs: the share of the question's words (runs of ASCII letters) that the text has."""
    import re

    words = re.compile("[a-z]+").findall

    def run(pairs: list[tuple[str, ...]]) -> list[float]:
        out = []
        for question, text in pairs:
            asked = set(words(question.lower()))
            out.append(len(asked & set(words(text.lower()))) / len(asked) if asked else 0.0)
        return out

    return run
