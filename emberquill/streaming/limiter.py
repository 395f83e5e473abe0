"""A sliding-window limiter: denied requests consume nothing, so each client is an ordered fold.

Batch: time is cut into slots as long as the longest window, and a client's requests into sessions
wherever a slot of its own is empty: nothing that happened before such a pause counts after it.
Sessions are hash-partitioned, sorted by Spark's spilling sort and folded as a stream, holding at most
the limit's timestamps; a busy client is split over its sessions.  A limit over all clients couples
them: sessions are then those of all requests together.  Stream: the same fold with state.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

LIMIT, SECONDS = 10, 60


class Slots:
    """The allowed requests of one client within the window."""

    def __init__(self, limit: int, seconds: float, held: list[float] | None = None) -> None:
        self.limit, self.seconds, self.held = limit, seconds, deque(held or ())

    def wait(self, now: float) -> int:
        """Seconds until a request is allowed, 0 if it is now; times at or before now - window have expired."""
        while self.held and self.held[0] <= now - self.seconds:
            self.held.popleft()
        return max(1, math.ceil(self.held[0] + self.seconds - now)) if len(self.held) >= self.limit else 0

    def ask(self, now: float) -> tuple[bool, int, int]:
        """(allowed, remaining, seconds to wait) of a request; a denied one consumes nothing."""
        if wait := self.wait(now):
            return False, 0, wait
        self.held.append(now)
        return True, self.limit - len(self.held), 0


def ask_all(slots: list[Slots], scopes: list[str], now: float, flagged: bool) -> tuple[bool, int, int, str]:
    """(allowed, remaining, seconds to wait, scope): a plain request needs the first limit, a flagged one all, and counts in all it needs."""
    own = list(zip(slots, scopes))[: None if flagged else 1]
    for slot, scope in own:
        if wait := slot.wait(now):
            return False, 0, wait, scope
    for slot, _ in own:
        slot.held.append(now)
    left = min(slot.limit - len(slot.held) for slot, _ in own)
    scope = next(name for slot, name in own if slot.limit - len(slot.held) == left)
    return True, left, 0, scope


def sessions(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Rows with ``session``: a number that changes, within equal keys, wherever a whole slot of ``seconds`` is empty.

    Only distinct slots are put in order, which are bounded by the time covered, not by the rows.
    """
    slotted = rows.withColumn("_slot", F.floor(F.col(at) / seconds).cast("bigint"))
    slots = slotted.select(*keys, "_slot").distinct()
    order = Window.partitionBy(*keys).orderBy("_slot")
    runs = slots.withColumn("session", F.col("_slot") - F.row_number().over(order))
    return slotted.join(runs, [*keys, "_slot"]).drop("_slot")


def decisions(
    rows: DataFrame, *, client: str, time: str, ident: str, limit: int = LIMIT, seconds: int = SECONDS, flag: str | None = None, flag_limit: int = 3, flag_seconds: int = 600, total_limit: int | None = None, total_seconds: int = 600
) -> DataFrame:
    """ident, client, allowed, remaining, retry_after and scope of every request in the order of time, then ident.

    ``flag`` names a boolean column of requests that a second limit of their client holds for as well
    and, with ``total_limit``, a third one over all clients (scopes requests, flagged and total).
    Rows without client or time are left out; a null flag is false.
    """
    total = total_limit is not None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, clients, every = object(), {}, Slots(total_limit or 0, total_seconds)
        for batch in batches:
            out = []
            for who, now, flagged, own in zip(*(batch.column(c).to_pylist() for c in ("client", "at", "flagged", "session"))):
                if (key := own if total else (who, own)) != session:
                    session, clients, every = key, {}, Slots(total_limit or 0, total_seconds)
                if who not in clients:
                    clients[who] = [Slots(limit, seconds), Slots(flag_limit, flag_seconds)]
                out.append(ask_all([*clients[who], every] if total else clients[who], ["requests", "flagged", "total"], now, flagged))
            a, r, w, s = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("ident"), batch.column("client"), pa.array(a, pa.bool_()), pa.array(r, pa.int32()), pa.array(w, pa.int32()), pa.array(s, pa.string())], ["ident", "client", "allowed", "remaining", "retry_after", "scope"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.select(client, ident).schema}
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = rows.where(F.col(client).isNotNull() & F.col(time).isNotNull()).select(F.col(ident).alias("ident"), F.col(client).alias("client"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), flagged.alias("flagged"))
    keys = [] if total else ["client"]
    cut = sessions(rows, keys, "at", max(seconds, flag_seconds if flag else 0, total_seconds if total else 0))
    ordered = cut.repartition(*keys, "session").sortWithinPartitions(*keys, "session", "at", "ident")
    return ordered.mapInArrow(fold, f"ident {kinds[ident]}, client {kinds[client]}, allowed boolean, remaining int, retry_after int, scope string")


def stream_decisions(stream: DataFrame, *, client: str, time: str, limit: int = LIMIT, seconds: int = SECONDS, flag: str | None = None, flag_limit: int = 3, flag_seconds: int = 600, late: str = "1 minute") -> DataFrame:
    """client, at, allowed, remaining, retry_after and scope of a stream of requests; ``flag`` as in ``decisions``.

    A client is forgotten once the watermark (``late`` behind the newest time) has passed its windows.
    """
    longest = max(seconds, flag_seconds if flag else 0)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ((), ())
        slots = [Slots(limit, seconds, list(held[0])), Slots(flag_limit, flag_seconds, list(held[1]))]
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")  # one client's rows of a micro-batch
        done = [ask_all(slots, ["requests", "flagged"], now, bool(f)) for now, f in zip(rows["at"], rows["flagged"])]
        state.update(tuple(list(s.held) for s in slots))
        state.setTimeoutTimestamp(max(int((rows["at"].iloc[-1] + longest) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "at": rows["at"].to_numpy(), **{n: [d[k] for d in done] for k, n in enumerate(("allowed", "remaining", "retry_after", "scope"))}})

    kind = stream.schema[client].dataType.simpleString()
    flagged = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)
    rows = stream.withWatermark(time, late).select(F.col(client).alias("client"), time, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("at"), flagged.alias("flagged"))
    out = f"client {kind}, at double, allowed boolean, remaining int, retry_after int, scope string"
    return rows.groupBy("client").applyInPandasWithState(fold, out, "held array<double>, flagged array<double>", "append", GroupStateTimeout.EventTimeTimeout)
