"""Progress reports as a stateful stream keyed by worker.

Reports are folded to one summary per worker and run of sequence numbers first, so the
state of a busy worker is advanced by a few summaries per micro-batch and never
by all its reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradframe.operators.updates import EMA

SUMMARY = "worker bigint, seq bigint, cnt bigint, points bigint, loss double, first double, keep double, add double"
OUTPUT = "worker bigint, seq bigint, reports bigint, points bigint, loss double, t_point double, fires bigint"
RUN = 1 << 16  # sequence numbers, and so reports at most, that are folded together
STATE = "reports bigint, points bigint, loss double, t_point double"


def summaries(reports: DataFrame) -> DataFrame:
    """One row per worker and run of ``RUN`` sequence numbers: totals and the composed average step.

    A worker's reports of one run are put in order before they are folded, wherever in the
    micro-batch's files they lie; from one micro-batch to the next, arrival is the order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        count = len(pdf)
        add = EMA * (1 - EMA) ** np.arange(count)[::-1] * pdf["t_point"].to_numpy()
        row = (
            pdf["worker"].iloc[0], pdf["seq"].iloc[-1], count, pdf["n"].sum(), pdf["loss"].sum(),
            pdf["t_point"].iloc[0], (1 - EMA) ** count, add.sum(),
        )
        return pd.DataFrame([row], columns=["worker", "seq", "cnt", "points", "loss", "first", "keep", "add"])

    own = reports.select("worker", "seq", "n", "t_point", "loss", F.floor(F.col("seq") / RUN).alias("_run"))
    return own.groupBy("worker", "_run").applyInPandas(fold, SUMMARY)


def advance(batch: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reports, points, loss, ema = state.get if state.exists else (0, 0, 0.0, None)
        fired = points // batch
        rows = pd.concat(list(parts)).sort_values("seq")
        for r in rows.itertuples():
            # the first report counts as it is: fold it onto itself
            ema = r.keep * (r.first if ema is None else ema) + r.add
            reports, points, loss = reports + r.cnt, points + r.points, loss + r.loss
        state.update((int(reports), int(points), float(loss), float(ema)))
        yield pd.DataFrame(
            [(key[0], int(rows["seq"].max()), reports, points, loss, ema, points // batch - fired)],
            columns=["worker", "seq", "reports", "points", "loss", "t_point", "fires"],
        )

    return run


def report_state(stream: DataFrame, batch: int) -> DataFrame:
    """Running totals and smoothed time per point of every worker.

    One row per worker and micro-batch: its newest ``seq``, number of reports,
    points and loss so far, the moving average of ``t_point``, and how many
    whole batches of points were completed (``fires``).
    """
    return (
        summaries(stream)
        .groupBy("worker")
        .applyInPandasWithState(advance(batch), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    )


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's rows to a Parquet table until the input is worked off."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def current(table: DataFrame) -> DataFrame:
    """Newest row of every worker."""
    rest = [c for c in table.columns if c != "worker"]
    return table.groupBy("worker").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("worker", "r.*")
