"""Streaming operators that keep their own state per signal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plantlog.operators.sampling import finite
from plantlog.streaming.groups import Pages, by_group

_SERIES = ["asset_uuid", "id"]


class _Deadband(StatefulProcessor):
    """Signals with the value each has kept last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = Pages(handle, "last")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # order across the arrow batches of one micro-batch is restored before the walk
        readings = pd.concat(list(rows)).sort_values("offset", kind="stable")
        series = readings["series"].tolist()
        # The setting of the newest reading holds for the batch.
        own = dict(zip(series, readings["band_"].tolist()))
        last, changed, kept = self.last.read(own), {}, []
        for i, (s, v) in enumerate(zip(series, readings["value_num"].tolist())):
            if own[s] <= 0 or s not in last or not abs(v - last[s]) < own[s]:
                kept.append(i)
                last[s] = changed[s] = v
        self.last.write(changed)
        yield readings.iloc[kept][[*_SERIES, "offset", "value_num"]]

    def close(self) -> None:
        pass


def stream_deadband(readings: DataFrame, band: float | str) -> DataFrame:
    """Streaming form of the deadband filter: the state is the last kept value of each signal.

    ``band`` is one number, or the name of a column with each signal's setting; NULL, 0 or less keeps all
    readings of a signal. NaN and infinite values are no samples.
    """
    setting = F.col(band).cast("double") if isinstance(band, str) else F.lit(float(band))
    rows = finite(readings, "value_num").select(*_SERIES, "offset", "value_num", F.coalesce(setting, F.lit(0.0)).alias(
        "band_"), F.to_json(F.array(*_SERIES)).alias("series"))
    return by_group(rows, "series").transformWithStateInPandas(
        _Deadband(), "asset_uuid string, id string, offset bigint, value_num double", "Append", "None")
