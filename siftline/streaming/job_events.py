"""T1 as a stream: keyed state (previous, confirmations, told) over polls of each job."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftline.operators.events import TERMINAL

EVENTS = "event_id string, job string, state string, at timestamp"
STATE = "previous string, confirmations int, told string"


def advance(previous: str | None, confirmations: int, told: list[str], state: str, needed: int) -> tuple[int, bool]:
    """The confirmations after a poll, and whether it tells an event."""
    if state not in TERMINAL:
        return 0, False
    n = confirmations + 1 if previous == state else 1
    return n, n >= needed and state not in told


def stream(polls: DataFrame, needed: int = 2) -> DataFrame:
    """Events from a streaming frame (job string, at timestamp, state string).

    Polls of a job in one micro-batch are put in time order first. State is bounded by the
    number of jobs; each job holds three short fields.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        previous, n, told = held.get if held.exists else (None, 0, "")
        names = told.split(",") if told else []
        rows = pd.concat(list(parts)).sort_values("at", kind="stable")
        out = []
        for at, state in zip(rows["at"], rows["state"]):
            n, tell = advance(previous, n, names, state, needed)
            if tell:
                names.append(state)
                out.append((f"{key[0]}--{state}", key[0], state, at))
            previous = state
        held.update((previous, n, ",".join(names)))
        yield pd.DataFrame(out, columns=["event_id", "job", "state", "at"])

    return polls.groupBy("job").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
