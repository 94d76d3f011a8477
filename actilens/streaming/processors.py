"""Keyed state for streams: limiter, change detection, inactivity, sequences, federated rounds.

Rows arrive in any order and in any number of micro-batches. Each processor holds them in time cells and takes a cell in
event-time order once the watermark has passed its end, so its result does not depend on how rows were dealt over files;
memory holds one cell of one key. Rows behind the watermark are dropped and counted by Spark's state operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MICROS = 1_000_000
CELL_SECONDS = 3600


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class InOrder(StatefulProcessor):
    """Holds rows (with the time ``us``) until the watermark has passed their cell, then hands the cell on in order.

    ``taken`` gets the rows of one cell sorted by ``ORDER``. With ``CLOCK``, ``closed`` then gets the time up to which this
    key is known to have no more rows.
    """

    ORDER, CLOCK = ("us", "id"), False

    def __init__(self, cell_seconds: int = CELL_SECONDS):
        self.cell = cell_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._parts = handle.getMapState("parts", "cell long", "n int")
        self._rows = handle.getMapState("rows", "cell long, part int", "data binary")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Further state of the processor."""

    def _end(self, cell: int) -> int:
        """The millisecond in which everything in a cell is past."""
        return (cell + 1) * self.cell // 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["us"].notna()]  # a row without a time has no place in the order
            cells = frame["us"].to_numpy(np.int64) // self.cell
            for cell in np.unique(cells).tolist():
                at = (int(cell),)
                n = self._parts.getValue(at)[0] if self._parts.containsKey(at) else 0
                self._rows.updateValue((int(cell), n), (_packed(frame[cells == cell]),))
                self._parts.updateValue(at, (n + 1,))
                if not n:
                    self._handle.registerTimer(self._end(int(cell)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cell = expiredTimerInfo.getExpiryTimeInMs() * 1000 // self.cell - 1
        if self._parts.containsKey((cell,)):
            n = self._parts.getValue((cell,))[0]
            frames = [_unpacked(bytes(self._rows.getValue((cell, part))[0])) for part in range(n)]
            for part in range(n):
                self._rows.removeKey((cell, part))
            self._parts.removeKey((cell,))
            frame = pd.concat(frames, ignore_index=True).sort_values(list(self.ORDER), kind="stable").reset_index(drop=True)
            yield from self.taken(key, frame)
        if self.CLOCK:
            later = [c[0] * self.cell for c in self._parts.keys()]
            yield from self.closed(key, min([timerValues.getCurrentWatermarkInMs() * 1000, *later]))

    def taken(self, key, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def closed(self, key, us: int) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


class RateLimiter(InOrder):
    """Input (keys..., us, id, lim, win); output adds ``allowed``. State: the last admitted times."""

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self._times = handle.getListState("times", T.StructType([T.StructField("us", T.LongType())]))

    def taken(self, key, frame) -> Iterator[pd.DataFrame]:
        admitted = np.array([t[0] for t in self._times.get()] if self._times.exists() else [], np.int64)
        us, limit, span = (frame[c].to_numpy(np.int64) for c in ("us", "lim", "win"))
        allowed, at = np.zeros(len(us), bool), 0
        while at < len(us):
            # While the limit and the window stay as they are, the next row that can pass is found by one search.
            admitted = admitted[np.searchsorted(admitted, us[at] - span[at] * MICROS, "right") :]
            if len(admitted) < limit[at]:
                allowed[at] = True
                admitted = np.append(admitted, us[at])
                at += 1
                continue
            other = np.flatnonzero((limit[at:] != limit[at]) | (span[at:] != span[at]))
            same = at + (int(other[0]) if len(other) else len(us) - at)
            free = admitted[len(admitted) - limit[at]] + span[at] * MICROS
            at += int(np.searchsorted(us[at:same], free, "left"))
        if len(admitted):
            self._times.put([(int(t),) for t in admitted])
        else:
            self._times.clear()
        yield frame.assign(allowed=allowed)


class ChangeDetector(InOrder):
    """Input (key, us, id, value); keeps rows whose value differs from the one before."""

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", T.StructType([T.StructField("value", T.StringType())]))

    def taken(self, key, frame) -> Iterator[pd.DataFrame]:
        before = self._last.get()[0] if self._last.exists() else None
        previous = frame["value"].astype(object).shift(1)
        previous.iloc[0] = before
        self._last.update((frame["value"].iloc[-1],))
        changed = (frame["value"] != previous).to_numpy()
        if changed.any():
            yield frame.assign(previous=previous)[changed]


class Sequence(InOrder):
    """Input (key, us, id, value); output (value, next_value) pairs of consecutive rows."""

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", T.StructType([T.StructField("value", T.StringType())]))

    def taken(self, key, frame) -> Iterator[pd.DataFrame]:
        values = frame["value"].to_list()
        if self._last.exists():
            values.insert(0, self._last.get()[0])
        self._last.update((values[-1],))
        if len(values) > 1:
            yield pd.DataFrame({"value": values[:-1], "next_value": values[1:]})


class InactivityTimer(InOrder):
    """Input (user_name, us); output (user_name, kind, at_us): one warning and one limit per gap.

    Gaps inside the data are seen when the next row is taken, an open gap at the end of the cell in which it falls due,
    when all earlier rows have been taken.
    """

    ORDER, CLOCK = ("us",), True
    STATE = T.StructType(
        [T.StructField("last", T.LongType()), T.StructField("warned", T.BooleanType()), T.StructField("reached", T.BooleanType())]
    )

    def __init__(self, limit_seconds: int = 7200, cell_seconds: int = CELL_SECONDS):
        super().__init__(cell_seconds)
        self.limit = limit_seconds * MICROS
        self.warning = max(limit_seconds - 300, 0) * MICROS

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("activity", self.STATE)

    def _emit(self, key, kind: list[str], at: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"user_name": [key[0]] * len(kind), "kind": kind, "at_us": np.array(at, dtype="int64")})

    def taken(self, key, frame) -> Iterator[pd.DataFrame]:
        us = np.unique(frame["us"].to_numpy(np.int64))
        last, warned, reached = self._state.get() if self._state.exists() else (None, False, False)
        starts = us[:-1] if last is None else np.concatenate([[last], us[:-1]])
        gaps = us[len(us) - len(starts) :] - starts
        kind, at = [], []
        for name, wait, done in (("warning", self.warning, warned), ("limit", self.limit, reached)):
            over = gaps > wait
            if done and last is not None:
                over[0] = False  # the open gap has been told already
            kind += [name] * int(over.sum())
            at += (starts[over] + wait).tolist()
        last = int(us[-1])
        self._state.update((last, False, False))
        for wait in {self.warning, self.limit}:
            self._handle.registerTimer(self._end((last + wait) // self.cell))
        if kind:
            yield self._emit(key, kind, at)

    def closed(self, key, us) -> Iterator[pd.DataFrame]:
        if not self._state.exists():
            return
        last, warned, reached = self._state.get()
        warn, reach = us - last > self.warning and not warned, us - last > self.limit and not reached
        if warn or reach:
            self._state.update((last, warned or warn, reached or reach))
            due = [("warning", last + self.warning)] * warn + [("limit", last + self.limit)] * reach
            yield self._emit(key, [k for k, _ in due], [a for _, a in due])


class FederatedRound(InOrder):
    """Input: submissions and reveals of a round in time order. Output: a verdict per message, and
    the weighted average with the message that completes the round."""

    ROUND = (
        "opened long, timeout long, min_clients int, dimension int, submitted int, revealed int, samples long, "
        "epsilon double, sums array<double>, finalized boolean"
    )
    AGENT = "weight double, revealed boolean"

    ORDER = ("us", "message_id")

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self._round = handle.getValueState("round", self.ROUND)
        self._agents = handle.getMapState("agents", "agent_id string", self.AGENT)

    def taken(self, key, frame) -> Iterator[pd.DataFrame]:
        state = list(self._round.get()) if self._round.exists() else None
        out = []
        for row in frame.itertuples():
            vector = np.asarray(row.vector, dtype=float)
            if row.kind == "update":
                if state is None:
                    timeout = max(30, int(row.timeout_seconds)) * MICROS
                    state = [int(row.us), timeout, max(1, int(row.min_clients)), len(vector), 0, 0, 0, 0.0, [0.0] * len(vector), False]
                verdict = self._submit(state, row, vector)
            else:
                verdict = "unknown_round" if state is None else self._reveal(state, row, vector)
            average = None
            if state is not None and not state[9] and state[4] >= state[2] and state[5] == state[4] > 0 and verdict == "revealed":
                state[9] = True
                weight = sum(w for w, _ in self._agents.values())
                average = [s / weight for s in state[8]]
            out.append((key[0], row.agent_id, row.message_id, row.kind, verdict, average))
        if state is not None:
            self._round.update(tuple(state))
        yield pd.DataFrame(out, columns=["round_id", "agent_id", "message_id", "kind", "verdict", "average"])

    def _submit(self, state, row, vector) -> str:
        agent = (row.agent_id,)
        if state[9]:
            return "round_already_finalized"
        if row.us > state[0] + state[1]:
            return "round_expired"
        if self._agents.containsKey(agent):
            return "duplicate_agent_submission"
        if len(vector) != state[3]:
            return "dimension_mismatch"
        weight = float(max(int(row.num_samples), 1))
        self._agents.updateValue(agent, (weight, False))
        state[4] += 1
        state[6] += int(row.num_samples)
        state[7] += float(row.epsilon)
        state[8] = [s + weight * x for s, x in zip(state[8], vector)]
        return "accepted"

    def _reveal(self, state, row, vector) -> str:
        agent = (row.agent_id,)
        if state[9]:
            return "round_already_finalized"
        if not self._agents.containsKey(agent):
            return "no_submission"
        weight, revealed = self._agents.getValue(agent)
        if revealed:
            return "mask_already_revealed"
        if len(vector) != state[3]:
            return "dimension_mismatch"
        self._agents.updateValue(agent, (weight, True))
        state[5] += 1
        state[8] = [s - weight * x for s, x in zip(state[8], vector)]
        return "revealed"
