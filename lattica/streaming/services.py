"""States and approvals of generated services as a stateful stream.

Events of a service come in any order, late or repeated; what they amount to doesn't depend on that. An event has a number that is unique within its service; an event seen before changes nothing.
The state of a service is the farthest it has reached, its iterations the number of events that name a known state; an approval is pending from a request until an approval or a resumption of a higher number, and expires if none
comes within a time limit of the request, by the time of the latest event of any service. Events that lie further behind that than ``lateness`` are dropped, all others count. Numbers seen are kept as ranges, so a
service whose events are numbered without gaps needs one range.

The stream gives a row for a service whenever events or the time limit change it; the last row of a service is its result, equal to :func:`fold` over all events. A run that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.openapi import STATES

EVENTS = "service string, seq long, at timestamp, kind string"
RESULT = "service string, state string, iterations long, approval string, changed_at timestamp"
#: Besides STATES: what asks for an approval, and what ends the wait.
REQUEST, ENDS = "request_approval", ("approve", "resume")
#: Seconds after which a pending approval expires.
LIMIT = 24 * 3600
#: Seconds that an event may lie behind the latest one.
LATENESS = 7 * 24 * 3600


def fold(events: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(service, state, iterations, approval) of events (service, seq, at, kind), all at once. The time is that of the latest event of any service."""
    once = events.where("service IS NOT NULL AND seq IS NOT NULL").groupBy("service", "seq").agg(F.min(F.struct("kind", "at")).alias("e")).select("service", "seq", "e.*")
    now = events.agg(F.max("at").alias("now"))  # one row
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("kind"))
    asked, ended = F.when(F.col("kind") == REQUEST, F.col("seq")), F.when(F.col("kind").isin(*ENDS), F.col("seq"))
    per = once.groupBy("service").agg(
        F.max(rank).alias("rank"), F.count_if(rank > 0).alias("iterations"), F.max(asked).alias("asked"), F.max(ended).alias("ended"), F.max_by("at", asked).alias("asked_at")
    )
    late = F.unix_timestamp("now") >= F.unix_timestamp("asked_at") + limit
    approval = F.when(F.col("asked").isNull(), F.when(F.col("ended").isNotNull(), "approved")).when(F.col("ended") > F.col("asked"), "approved").when(late, "expired").otherwise("pending")
    state = F.when(F.col("rank") > 0, F.element_at(F.array(*map(F.lit, STATES)), F.col("rank").cast("int")))
    return per.crossJoin(F.broadcast(now)).select("service", state.alias("state"), "iterations", approval.alias("approval"))


def _add(ranges: list[list[int]], n: int) -> bool:
    """Adds a number to sorted ranges; False if it is there."""
    from bisect import bisect_right

    i = bisect_right(ranges, [n, float("inf")]) - 1
    if i >= 0 and ranges[i][1] >= n:
        return False
    joins_left, joins_right = i >= 0 and ranges[i][1] == n - 1, i + 1 < len(ranges) and ranges[i + 1][0] == n + 1
    if joins_left and joins_right:
        ranges[i][1] = ranges.pop(i + 1)[1]
    elif joins_left:
        ranges[i][1] = n
    elif joins_right:
        ranges[i + 1][0] = n
    else:
        ranges.insert(i + 1, [n, n])
    return True


def _step(limit: int, lateness: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, stops, rank, iterations, asked, ended, asked_at, told = state.get if state.exists else ([], [], 0, 0, None, None, None, "")
        ranges = [[a, b] for a, b in zip(starts, stops)]
        last = None
        if not state.hasTimedOut:
            for frame in frames:
                for seq, at, kind in zip(frame["seq"], frame["at"], frame["kind"]):
                    if not _add(ranges, int(seq)):
                        continue
                    last = at if last is None else max(last, at)
                    if kind in STATES:
                        rank, iterations = max(rank, STATES.index(kind) + 1), iterations + 1
                    elif kind == REQUEST and (asked is None or seq > asked):
                        asked, asked_at = int(seq), int(at.timestamp())
                    elif kind in ENDS:
                        ended = int(seq) if ended is None else max(ended, int(seq))
        watermark = state.getCurrentWatermarkMs()
        now = watermark // 1000 + lateness if watermark else 0  # the time of the latest event, before the first batch ends 0
        approval = (None if ended is None else "approved") if asked is None else "approved" if ended is not None and ended > asked else "expired" if now >= asked_at + limit else "pending"
        shown = f"{rank},{iterations},{approval}"
        state.update(([a for a, _ in ranges], [b for _, b in ranges], rank, iterations, asked, ended, asked_at, shown))
        if approval == "pending":
            state.setTimeoutTimestamp(max((asked_at + limit - lateness) * 1000, watermark + 1))
        if shown != told:
            when = last if last is not None else pd.Timestamp(now, unit="s")
            yield pd.DataFrame({"service": [key[0]], "state": [STATES[rank - 1] if rank else None], "iterations": [iterations], "approval": [approval], "changed_at": [when]})

    return run


def states(stream: DataFrame, limit: int = LIMIT, lateness: int = LATENESS) -> DataFrame:
    """A stream of RESULT rows (update mode) from a stream of EVENTS; rows without a service or number don't count."""
    clocked = stream.where("service IS NOT NULL AND seq IS NOT NULL").withWatermark("at", f"{lateness} seconds")
    held = "starts array<long>, stops array<long>, rank int, iterations long, asked long, ended long, asked_at long, told string"
    return clocked.groupBy("service").applyInPandasWithState(_step(limit, lateness), RESULT, held, "update", GroupStateTimeout.EventTimeTimeout)


def latest(results: DataFrame) -> DataFrame:
    """The last row of each service of stored results (with a column batch, the number of the batch that gave it)."""
    last = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("batch")))
    return results.withColumn("_n", last).where("_n = 1").drop("_n", "batch")
