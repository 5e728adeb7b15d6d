"""Series of brackets from a stream of files: the running key of a folder, and its open run, as state.

Files of a folder follow each other by name, and one of bias zero begins a new run.  A run is closed by the next one of its folder, or when the
watermark of ``modified`` passes its last file by ``QUIET``; its series and singles come out then.  State holds the last name of closed runs and
the files of the open one.  A file whose name is not behind the last closed one is late: it comes out at once, as a single of its own.
Files that come in the order of their names, over any number of batches, give the series of the batch query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalog import ENDINGS

#: Milliseconds without a file after which a run is over; how far ``modified`` may run behind.
QUIET, DELAY = 60_000, "0 seconds"
#: The state store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "folder string, first_path string, path string, late boolean"
_FILE = "path string, bias double, width int, height int"


def runs(files: list[tuple]) -> list[list[tuple]]:
    """Files (path, bias, width, height), sorted by name, cut before each of bias zero; those without a bias stay where they are."""
    out: list[list[tuple]] = []
    for f in sorted(files, key=lambda f: f[0]):
        if not out or (f[1] is not None and abs(f[1]) < 1e-6):
            out.append([])
        out[-1].append(f)
    return out


def series(run: list[tuple]) -> Iterator[tuple[str | None, str]]:
    """(first path of its series or None, path) of each file of a run: a series has two files and two biases of one size."""
    groups: dict[tuple, list[tuple]] = {}
    for f in run:
        groups.setdefault((f[2], f[3]) if f[1] is not None else ("alone", f[0]), []).append(f)
    for key, files in groups.items():
        whole = key[0] != "alone" and len(files) >= 2 and len({f[1] for f in files}) >= 2
        for f in files:
            yield (min(x[0] for x in files) if whole else None), f[0]


class Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "path string")
        self.open = handle.getListState("open", _FILE)

    def _out(self, folder: str, run: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(folder, first, path, False) for first, path in series(run)], columns=["folder", "first_path", "path", "late"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (folder,) = key
        last = self.closed.get()[0] if self.closed.exists() else ""
        files, newest = [tuple(f) for f in self.open.get()], 0
        for batch in rows:
            newest = max(newest, int(batch.modified.max().timestamp() * 1000))
            new = [(p, None if pd.isna(b) else float(b), int(w), int(h)) for p, b, w, h in zip(batch.path, batch.bias, batch.width, batch.height, strict=True)]
            late = [f for f in new if f[0] <= last]
            if late:
                yield pd.DataFrame([(folder, None, f[0], True) for f in late], columns=["folder", "first_path", "path", "late"])
            files += [f for f in new if f[0] > last]
        *over, still = runs(files) or [[]]
        for run in over:
            yield self._out(folder, run)
        if over:
            self.closed.update((max(f[0] for run in over for f in run),))
        if still:
            self.open.put(still)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + QUIET)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        files = [tuple(f) for f in self.open.get()]
        if files:
            yield self._out(key[0], files)
            self.closed.update((max(f[0] for f in files),))
            self.open.clear()

    def close(self) -> None:
        pass


def sessions(files: DataFrame) -> DataFrame:
    """folder, first_path (null for singles), path, late of a stream of files (folder, path, bias, width, height, modified: a time)."""
    spark = files.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    wanted = files.filter(" OR ".join(f"lower(path) LIKE '%{e}'" for e in ENDINGS)).withWatermark("modified", DELAY)
    return wanted.groupBy("folder").transformWithStateInPandas(Sessions(), FOUND, "Append", "EventTime")
