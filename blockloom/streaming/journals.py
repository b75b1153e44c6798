"""Streaming twins: journal steps checked as they arrive, and running copy progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockloom.operators.journal import STEPS


def illegal_steps(journal: DataFrame) -> DataFrame:
    """(artifact, sequence, before, state) of steps that the job's last seen state does not allow.

    State is one row a job: its last sequence and state.  Entries of a batch are taken in order of their sequence; an
    entry with a sequence that was passed already counts as illegal.
    """
    legal = set(STEPS)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("sequence")
        last, before = state.get if state.exists else (-1, None)
        out = []
        for sequence, now in zip(rows["sequence"].tolist(), rows["state"].tolist(), strict=True):
            if sequence <= last or before is not None and (before, now) not in legal:
                out.append((key[0], sequence, before, now))
            if sequence > last:
                last, before = sequence, now
        state.update((last, before))
        yield pd.DataFrame(out, columns=["artifact", "sequence", "before", "state"])

    rows = journal.select(F.col("artifact").cast("string"), F.col("sequence").cast("long"), F.col("state").cast("string"))
    return rows.groupBy("artifact").applyInPandasWithState(
        run, "artifact string, sequence long, before string, state string", "sequence long, state string", "append", GroupStateTimeout.NoTimeout
    )


def copied(progress: DataFrame, every: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Bytes and requests of each disk in windows of event time (ts); rows later than the watermark are dropped."""
    return progress.withWatermark("ts", late).groupBy(F.window("ts", every).alias("window"), "disk_id").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("requests"))
