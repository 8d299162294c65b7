"""Calling a model or service of the user's on batches of rows."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from queue import Empty, SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Batch = Callable[[list], Sequence]


def within(seconds: float | None, call: Batch, values: list) -> Sequence:
    """call(values), given up after so many seconds.

    A call cannot be stopped from outside; one that is given up goes on in a
    thread of its own, which does not keep the process alive.
    """
    if seconds is None:
        return call(values)
    answer: SimpleQueue = SimpleQueue()

    def work() -> None:
        try:
            answer.put((call(values), None))
        except BaseException as e:  # noqa: BLE001  handed to the caller
            answer.put((None, e))

    threading.Thread(target=work, daemon=True).start()
    try:
        got, error = answer.get(timeout=seconds)
    except Empty:
        raise TimeoutError(f"took more than {seconds} s") from None
    if error is not None:
        raise error
    return got


def is_blank(x) -> bool:
    """Whether there is nothing to send: null, white space, no bytes, or a list of only such."""
    if x is None:
        return True
    if isinstance(x, str):
        return not x.strip()
    if isinstance(x, (bytes, bytearray)):
        return not x
    return all(is_blank(y) for y in x)


class Caller:
    """Calls with attempts and a deadline; a batch that fails is halved until the rows that fail stand alone."""

    def __init__(self, call: Batch, attempts: int, seconds: float | None, pause: float):
        self.call, self.attempts, self.seconds, self.pause = call, attempts, seconds, pause

    def checked(self, values: list) -> list:
        """What comes back for a batch, if it comes back whole."""
        got = list(within(self.seconds, self.call, values))
        if len(got) != len(values):
            raise ValueError(f"{len(values)} values sent, {len(got)} came back")
        for v, g in zip(values, got):
            if isinstance(v, list) and len(g) != len(v):
                raise ValueError(f"{len(v)} lines sent, {len(g)} came back")
        return got

    def tried(self, values: list) -> list:
        error: Exception = RuntimeError("not called")
        for n in range(self.attempts):
            try:
                return self.checked(values)
            except Exception as e:  # noqa: BLE001  whatever a user's model raises becomes the row's error
                error = e
                if isinstance(e, TimeoutError) and len(values) > 1:
                    break  # waiting again for all of them would not tell which one hangs
                if n + 1 < self.attempts and self.pause:
                    time.sleep(self.pause)
        raise error

    def results(self, values: list) -> list[tuple[object, str | None]]:
        """(result, error) of each value, in order."""
        try:
            return [(g, None) for g in self.tried(values)]
        except Exception as e:  # noqa: BLE001
            if len(values) == 1:
                return [(None, str(e) or type(e).__name__)]
            half = len(values) // 2
            return self.results(values[:half]) + self.results(values[half:])


def enrich(
    rows: DataFrame,
    call: Batch,
    column: str,
    to: str,
    kind: str = "string",
    on_error: str = "fail_row",
    attempts: int = 2,
    seconds: float | None = None,
    pause: float = 0.0,
    size: int = 256,
    window: int = 1,
) -> DataFrame:
    """Add `to` (what call gives for `column`), `status` and `error` to each row.

    call gets a list of at most `size` values and returns as many results, in
    order. A null or blank text, or a list of only such texts, is passed through
    and never sent. A batch that fails is tried again, up to `attempts` times,
    then halved, so that a bad row takes no others with it and costs a few calls,
    not one for each row beside it. A row that fails gets FAILED and the error's text, and
    no result (on_error "fail_row") or its own value ("pass_through"). A list
    must come back with as many lines as it has, or it fails too. seconds: a
    call that has not returned by then has failed, whatever it is doing; a batch
    of several rows is then halved at once. window: calls of a task that may be
    under way at the same time, so call must bear that; results keep the rows' order.
    """
    if on_error not in ("fail_row", "pass_through"):
        raise ValueError("on_error is fail_row or pass_through")
    if min(attempts, size, window) < 1:
        raise ValueError("at least one attempt, one row and one call")
    kept = [f for f in rows.schema.fields if f.name not in (to, "status", "error")]
    out = T.StructType([*kept, T.StructField(to, T._parse_datatype_string(kind)), T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
    names = [f.name for f in kept]

    def told(caller: Caller, pool: ThreadPoolExecutor, values: list) -> Iterator[tuple[object, str | None]]:
        """What caller gives for the values, batch after batch, `window` of them under way."""
        waiting: deque[Future] = deque()
        for at in range(0, len(values), size):
            if len(waiting) == window:
                yield from waiting.popleft().result()
            waiting.append(pool.submit(caller.results, values[at : at + size]))
        while waiting:
            yield from waiting.popleft().result()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(call, attempts, seconds, pause)
        with ThreadPoolExecutor(window) as pool:
            for frame in frames:
                values = [list(x) if hasattr(x, "tolist") else x for x in frame[column]]
                ask = [i for i, v in enumerate(values) if not is_blank(v)]
                results, status, errors = list(values), ["SUCCESS"] * len(values), [None] * len(values)
                for i, (g, e) in zip(ask, told(caller, pool, [values[i] for i in ask])):
                    if e is None:
                        results[i] = g
                    else:
                        results[i] = values[i] if on_error == "pass_through" else None
                        status[i], errors[i] = "FAILED", e
                made = frame[names].copy()
                made[to], made["status"], made["error"] = pd.Series(results, index=frame.index, dtype=object), status, errors
                yield made

    return rows.mapInPandas(run, out)
