"""Online decoding: smoothed activities some windows behind the stream, a result of its own and not the batch path's Viterbi."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from dayweave.operators.decode import FALLEN, FALLING, IDLE, marginals
from dayweave.streaming.tracking import expire, timed

LAGGED = "track_id long, step long, state int, marginal double, abstained boolean, label int"


class Lagged:
    """The state of one track: the last step, the log-prior of the oldest window held, and the log-posteriors of the windows held."""

    def __init__(self, move: np.ndarray, lag: int, saved: str | None = None):
        s = json.loads(saved) if saved else {}
        self.move, self.lag = move, lag
        self.last, self.steps, self.held = s.get("last"), s.get("steps", []), [np.array(e) for e in s.get("held", [])]
        self.prior = np.array(s["prior"]) if s else self.uniform()

    def uniform(self) -> np.ndarray:
        return np.full(len(self.move), -np.log(len(self.move)))

    def save(self) -> str:
        return json.dumps({"last": self.last, "prior": self.prior.tolist(), "steps": self.steps, "held": [e.tolist() for e in self.held]})

    def oldest(self) -> tuple[int, np.ndarray]:
        """The oldest window with its state probabilities given all that is held; it leaves."""
        found = marginals(np.stack(self.held), self.move, self.prior)[0]
        ahead = np.logaddexp.reduce((self.prior + self.held.pop(0))[:, None] + self.move, axis=0)
        self.prior = ahead - np.logaddexp.reduce(ahead)
        return self.steps.pop(0), found

    def take(self, step: int, emission: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        self.last = step
        self.steps.append(step)
        self.held.append(emission)
        if len(self.held) > self.lag:
            yield self.oldest()

    def flush(self) -> Iterator[tuple[int, np.ndarray]]:
        """What is held, with as much lag as there is; the next window starts anew."""
        while self.held:
            yield self.oldest()
        self.prior = self.uniform()


def lagged_labels(
    rows: DataFrame, transition: np.ndarray, lag: int = 3, most_gap: int = 1, idle_ms: int = 3_600_000,
    least: float = 0.40, idle: int = IDLE, exempt: tuple[int, ...] = (FALLING, FALLEN),
) -> DataFrame:
    """Windows (track_id, step, posterior) with the likeliest state given all windows up to `lag` steps later, its probability, and the
    label (idle where that is below `least`).

    A gap of more than most_gap steps ends a sequence: what is held leaves with the lag there is. So it does, and the state with it, once
    the watermark of event_time, if rows have it, is idle_ms beyond the track's latest row. Windows at or behind the track's last step are
    dropped. State: lag + 1 windows at most.
    """
    move = np.log(np.maximum(transition, 1e-12))
    names = [f.split()[0] for f in LAGGED.split(", ")]

    def shown(track: int, found: list[tuple[int, np.ndarray]]) -> Iterator[pd.DataFrame]:
        if found:
            p = np.stack([m for _, m in found])
            state = p.argmax(1)
            sure = p.max(1)
            quiet = (sure < least) & ~np.isin(state, exempt)
            yield pd.DataFrame(dict(zip(names, (track, [s for s, _ in found], state.astype("int32"), sure, quiet, np.where(quiet, idle, state).astype("int32")))))

    def run(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        track = Lagged(move, lag, state.get[0] if state.exists else None)
        if state.hasTimedOut:  # no rows come with a timeout
            state.remove()
            yield from shown(key[0], list(track.flush()))
            return
        found, pdf = [], pd.concat(list(pdfs))
        for step, posterior in pdf.sort_values("step", kind="stable")[["step", "posterior"]].itertuples(index=False):
            if track.last is not None and step <= track.last:
                continue
            if track.last is not None and step - track.last > most_gap:
                found += track.flush()
            found += track.take(int(step), np.log(np.maximum(np.array(posterior, float), 1e-12)))
        state.update((track.save(),))
        expire(state, pdf, idle_ms)
        yield from shown(key[0], found)

    rows, timeout = timed(rows)
    return rows.groupBy("track_id").applyInPandasWithState(run, LAGGED, "saved string", "append", timeout)
