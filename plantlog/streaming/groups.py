"""Keyed state for Python processors that are called once per group of keys.

A call of a stateful processor costs milliseconds and every access to the state store a message, so many keys
share a call and the entries of a group lie in pages: a batch reads and writes the pages its keys are in.
"""

from __future__ import annotations

import json
from zlib import crc32

from pyspark.sql import DataFrame, GroupedData, functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

# Groups of keys and pages of a group. Fixed: a key stays in its page over restarts.
GROUPS, PAGES = 512, 16


def by_group(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows grouped for a processor; all rows of a key are in one group."""
    return rows.withColumn("group_", F.pmod(F.xxhash64(*keys), F.lit(GROUPS))).groupBy("group_")


class Pages:
    """A map of keys (text or NULL) to JSON values in the state of the current group."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.state = handle.getMapState(name, "page int", "entries string")

    @staticmethod
    def _page(key: str | None) -> int:
        return crc32((key or "").encode()) % PAGES

    def read(self, keys) -> dict[str | None, object]:
        """All entries of the pages that the keys are in."""
        self.entries: dict[int, dict] = {}
        if not self.state.exists():
            self.entries = {p: {} for p in {self._page(k) for k in keys}}
        else:
            for p in {self._page(k) for k in keys}:
                self.entries[p] = dict(json.loads(self.state.getValue((p,))[0])) if self.state.containsKey((p,)) else {}
        return {k: v for page in self.entries.values() for k, v in page.items()}

    def write(self, changed: dict[str | None, object]) -> None:
        """Stores changed values of keys that were among those read."""
        touched = set()
        for k, v in changed.items():
            p = self._page(k)
            self.entries[p][k] = v
            touched.add(p)
        for p in touched:
            self.state.updateValue((p,), (json.dumps(list(self.entries[p].items())),))
