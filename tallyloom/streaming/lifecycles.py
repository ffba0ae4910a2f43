"""Findings across runs as a stream: for each identity what it was in the last run, how often it came, and whether it recurs.

Rows of runs arrive in any number of batches. Each identity has one small state; a timer tells, once the stream's time has
passed its last run, that a later run came without it. What comes out is the same for one batch and for many, as long as rows
of a run that was passed don't follow; such late rows are told as late and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Finalized runs of one severity, and decisions by hand among them, that make a finding recurring.
RUNS, MANUAL = 3, 2

STATE = "run long, at long, rows long, digest string, runs long, manual long, severity string, mixed boolean"
OUT = "identity string, run long, status string, runs long, manual long, recurring boolean"
OUT_ROW = Row("identity", "run", "status", "runs", "manual", "recurring")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """The state of an identity: its last run, when that was, its rows (0: it has been told that the identity left) and digest; finalized runs, decisions by hand, the severity, whether there was another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  names of the interface
        last = self.state.get()
        run, at, n, digest, runs, manual, severity, mixed = last or (None, None, 0, None, 0, 0, None, False)
        seen: dict[int, list] = {}  # rows, digest, finalized rows, decisions by hand among them, their severities and the time of each run of the batch
        for x in rows:
            s = seen.setdefault(x.run, [0, None, 0, 0, set(), x.ms])
            s[0] += 1
            if x.digest is not None and (s[1] is None or x.digest < s[1]):
                s[1] = x.digest
            if x.finalized:
                s[2] += 1
                s[3] += x.manual
                s[4].add(x.severity)
            s[5] = max(s[5], x.ms)
        for now in sorted(seen):
            own, least, final, by_hand, kinds, time = seen[now]
            if run is not None and now <= run:
                yield from [OUT_ROW(key[0], now, "late", runs, manual, False)] * own
                continue
            if run is not None and now > run + 1 and n:
                yield OUT_ROW(key[0], run + 1, "ambiguous" if n > 1 else "resolved", runs, manual, False)
            follows = run is not None and now == run + 1
            status = "ambiguous" if own > 1 or follows and n > 1 else "new" if not follows else "exact" if least == digest else "changed"
            if final:
                runs, manual = runs + 1, manual + by_hand
                kinds |= {severity} if severity is not None else set()
                severity, mixed = min(kinds), mixed or len(kinds) > 1
            run, at, n, digest = now, time, own, least
            yield OUT_ROW(key[0], now, status, runs, manual, runs >= RUNS and manual >= MANUAL and not mixed)
        if run is not None and (last is None or run != last[0]):
            if last is not None and last[2]:  # its timer is still set
                self.handle.deleteTimer(last[1] + 1)
            self.handle.registerTimer(at + 1)
            self.state.update((run, at, n, digest, runs, manual, severity, mixed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        run, at, n, digest, runs, manual, severity, mixed = self.state.get()
        self.state.update((run, at, 0, digest, runs, manual, severity, mixed))
        yield OUT_ROW(key[0], run + 1, "ambiguous" if n > 1 else "resolved", runs, manual, False)

    def close(self) -> None:
        pass


def lifecycles(findings: DataFrame) -> DataFrame:
    """identity, run, status (new, exact, changed, resolved, ambiguous, late), runs, manual and recurring so far, for each run that an identity is in or has just left.

    findings: a stream of identity (text), run (numbers without gaps), at (the run's time, ascending with it), severity,
    digest, finalized, manual. A severity that is null counts as one of its own. Needs the state store of RocksDB.
    """
    d = findings.select("identity", F.col("run").cast("long").alias("run"), "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.coalesce("severity", F.lit("")).alias("severity"), "digest", F.coalesce("finalized", F.lit(False)).alias("finalized"), F.coalesce("manual", F.lit(False)).alias("manual"))
    return d.where("identity is not null and run is not null and at is not null").withWatermark("at", "0 seconds").groupBy("identity").transformWithState(Lifecycle(), OUT, "Append", "EventTime")
