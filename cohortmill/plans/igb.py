"""Contents of binary potentials made from series, for the query of their reader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def packed(series: DataFrame) -> DataFrame:
    """(job_id, content) of series(job_id, vm array<double>): one node, a frame a value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            head = [f"x:1 y:1 z:1 t:{len(v)} type:float".encode().ljust(1024, b"\0") for v in pdf["vm"]]
            yield pd.DataFrame({"job_id": pdf["job_id"], "content": [h + np.asarray(v, "<f4").tobytes() for h, v in zip(head, pdf["vm"], strict=True)]})

    return series.select("job_id", "vm").mapInPandas(run, "job_id string, content binary")
