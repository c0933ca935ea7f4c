"""Places where a user's own code is plugged in: a table function over partitioned, ordered rows.

A plug sees the rows of one key in their order and gives rows of its own: a
model that predicts frames by windows, or a resolver that answers requests.
Spark partitions and sorts; a plug holds what it keeps itself, no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


class Plug(Protocol):
    """One instance for each key."""

    def feed(self, row: Row) -> Iterable[tuple]:
        """Rows to give out once ``row`` is known."""

    def finish(self) -> Iterable[tuple]:
        """Rows to give out after the last row."""


def through(rows: DataFrame, plug: Callable[[], Plug], partition: list[str], order: list[str], schema: str) -> DataFrame:
    """What ``plug`` makes of the rows of each key in their order; an empty table gives no rows."""

    @udtf(returnType=schema)
    class Through:
        def __init__(self):
            self.plug = plug()

        def eval(self, row: Row):
            yield from self.plug.feed(row)

        def terminate(self):
            yield from self.plug.finish()

    return Through(rows.asTable().partitionBy(*partition).orderBy(*order))


class Windows:
    """Feeds a predictor fixed windows: ``size`` values every ``step``, of which the middle ``step`` predictions count.

    The first and last value are repeated at the ends, so every value is once in the middle.  ``predict`` takes a
    list of ``size`` values and gives as many predictions.  ``key`` and ``place`` name the columns that are passed on.
    """

    def __init__(self, predict: Callable[[list], list[float]], key: str, place: str, value: str, size: int = 100, step: int = 50):
        self.predict, self.names, self.size, self.step = predict, (key, place, value), size, step
        self.pad = (size - step) // 2
        self.values: list = []  # of the window that is being filled
        self.places: list[tuple] = []  # of those values that have no prediction yet

    def feed(self, row):
        key, place, value = (row[n] for n in self.names)
        if not self.places and not self.values:
            self.values = [value] * self.pad
        self.values.append(value)
        self.places.append((key, place))
        if len(self.values) == self.size:
            yield from self.window()

    def finish(self):
        while self.places:
            self.values += [self.values[-1]] * (self.size - len(self.values))
            yield from self.window()

    def window(self):
        scores = self.predict(self.values)[self.pad : self.pad + self.step]
        done, self.places = self.places[: self.step], self.places[self.step :]
        for (key, place), score in zip(done, scores):  # at the end there are fewer places than scores
            yield key, place, float(score)
        self.values = self.values[self.step :]


class Resolver:
    """Answers each request as it comes; an answer outside its candidates is an error of the plug."""

    def __init__(self, resolve: Callable[[dict], list[int]]):
        self.resolve = resolve

    def feed(self, row):
        request = row.asDict(recursive=True)
        chosen = list(self.resolve(request))
        known = {c["block"] for c in request["candidates"]}
        if foreign := [b for b in chosen if b not in known]:
            raise ValueError(f"request {request['request_id']}: blocks {foreign} are no candidates")
        yield request["movie_key"], request["request_id"], "match" if chosen else "no_match", chosen

    def finish(self):
        return ()
