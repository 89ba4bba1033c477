"""A hook for annotators such as language models: any callable over texts, run in Arrow batches (SRC13, STR10, PIP9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Takes texts, returns one reply for each; an exception fails the batch's rows, not the job.
Annotator = Callable[[list[str]], list[str]]


def annotate(df: DataFrame, text: str, make: Callable[[], Annotator], batch: int = 32, retries: int = 2) -> DataFrame:
    """df with reply and error. make builds the annotator once for each task; at most as many batches are under way as
    there are tasks at a time. A batch that fails is tried again, then row by row, so that one bad row harms no other.
    """
    schema = StructType(list(df.schema)).add("reply", StringType()).add("error", StringType())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()

        def tried(texts: list[str], n: int) -> list[tuple[str | None, str | None]]:
            for k in range(n + 1):
                try:
                    return [(r, None) for r in ask(texts)]
                except Exception as e:  # noqa: BLE001  the annotator is foreign code
                    said = f"{type(e).__name__}: {e}"
                    if len(texts) > 1 and k == n:
                        return [x for t in texts for x in tried([t], 0)]
            return [(None, said)] * len(texts)

        for frame in frames:
            out = []
            for k in range(0, len(frame), batch):
                out += tried(frame[text].iloc[k : k + batch].fillna("").tolist(), retries)
            yield frame.assign(reply=[r for r, _ in out], error=[e for _, e in out])

    return df.mapInPandas(run, schema)


def with_fallback(annotated: DataFrame, rule: dict[str, Column], reply: dict[str, Column]) -> DataFrame:
    """Each column from the reply where there is one, else from the rules."""
    return annotated.withColumns({c: F.coalesce(F.when(F.col("error").isNull(), reply[c]), rule[c]) for c in rule})
