"""Versions of a change log, handed out by keyed state: gapless per user, in total order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.sync import PushError

MOST = 25
"""Records under one version."""


class Versions(StatefulProcessor):
    """Stamps a user's records, ``most`` at a time in order of ``order``, with the user's next versions. The counter is part of the checkpoint: a
    micro-batch that runs again starts from the same number, so none is repeated or left out."""

    def __init__(self, columns: list[str], order: str, most: int) -> None:
        self.columns, self.order, self.most = columns, order, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.counter.get()[0] if self.counter.exists() else 0
        pushed = pd.concat(list(rows)).sort_values(self.order, kind="stable")[self.columns]
        nth = pd.Series(range(len(pushed)), index=pushed.index)
        self.counter.update((last + -(-len(pushed) // self.most),))
        yield pushed.assign(version=last + 1 + nth // self.most)

    def close(self) -> None:
        pass


def versioned(records: DataFrame, user: str = "pk", order: str = "sk", most: int = MOST) -> DataFrame:
    """The stream ``records`` with ``version``: every micro-batch of a user is cut into pushes of at most ``most`` records, each under the user's next
    version. What a user pushes within one micro-batch is one group in one task; the source's limit per trigger bounds it."""
    if "version" in records.columns:
        raise PushError("records have a version already")
    out = StructType([*records.schema.fields, StructField("version", LongType())])
    return records.groupBy(user).transformWithStateInPandas(statefulProcessor=Versions(records.columns, order, most), outputStructType=out, outputMode="Append", timeMode="None")
