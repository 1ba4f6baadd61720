"""Pluggable recognisers and detectors: models run in Arrow batches, one load for each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as t


def run(df: DataFrame, load: Callable[[], Callable], inputs: Sequence[str], result: str, name: str = "result", batch: int = 16) -> DataFrame:
    """Rows with success, message and `name` (of DDL type result): what the model gives for each row's inputs.

    load() makes the model; model(list of input tuples) gives a list. If a batch fails its rows
    are tried one by one, so that a bad row fails alone.
    """
    columns = df.columns

    def one(model, row):
        try:
            return True, "", model([row])[0]
        except Exception as e:  # whatever a model raises belongs to this row alone
            return False, f"{type(e).__name__}: {e}", None

    def judged(model, rows):
        try:
            return [(True, "", r) for r in model(rows)]
        except Exception:
            return [one(model, row) for row in rows]

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = list(zip(*(frame[c] for c in inputs), strict=True))
            got = [x for at in range(0, len(rows), batch) for x in judged(model, rows[at : at + batch])]
            yield frame.assign(success=[g[0] for g in got], message=[g[1] for g in got], **{name: pd.Series([g[2] for g in got], index=frame.index, dtype=object)})[[*columns, "success", "message", name]]

    schema = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "success boolean", "message string", f"`{name}` {result}"]
    return df.mapInPandas(parts, ", ".join(schema))


def read_text(df: DataFrame, engines: Sequence[Callable[[], Callable]], inputs: Sequence[str], least: float = 0.0) -> DataFrame:
    """Rows with text: of several recognisers, in order of preference, the first reading that is not blank and sure enough."""
    rest, readings = df.columns, []
    for k, load in enumerate(engines):
        df = run(df, load, inputs, "struct<text:string,score:double>", f"__r{k}").drop("success", "message")
        readings.append(F.when(F.col(f"__r{k}.score") >= least, F.col(f"__r{k}.text")))
    return df.withColumn("text", t.first_filled(*readings)).select(*rest, "text")
