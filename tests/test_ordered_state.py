"""What the streamed detectors hold at once."""

import random
from types import SimpleNamespace

import pandas as pd

from tidemark.functions import HOUR
from tidemark.streaming import detect


class State(dict):
    """A list, a value or a map of a stateful processor's handle."""

    getMapState = getListState = getValueState = lambda self, name, *schemas: self.setdefault(name, State())  # noqa: N815
    exists = lambda self: "value" in self
    get = lambda self: self.get_value()
    update = put = lambda self, value: self.__setitem__("value", value)
    appendList = lambda self, rows: self.__setitem__("value", [*dict.get(self, "value", []), *rows])  # noqa: E731, N815
    updateValue = dict.__setitem__  # noqa: N815
    getValue = dict.__getitem__  # noqa: N815
    removeKey = dict.__delitem__  # noqa: N815
    registerTimer = lambda self, at: None  # noqa: E731, N815

    def get_value(self):
        return self["value"]


def frame(rows):
    return pd.DataFrame(rows, columns=detect.QUOTE)


def test_waiting_quotes_are_looked_at_hour_by_hour(monkeypatch):
    rng, hours, each = random.Random(5), 30, 40
    rows = [(k * HOUR // each, k, float(rng.randint(0, 1)), 2.0) for k in range(-3 * each, hours * each)]
    whole, end = detect.flagged(frame(rows), None, 4, 1)
    mixed, most, found = rng.sample(rows, len(rows)), [], []
    plain = detect.flagged
    monkeypatch.setattr(detect, "flagged", lambda rows, *a: most.append(len(rows)) or plain(rows, *a))
    monkeypatch.setattr(detect, "HELD", 500, raising=False)
    order = detect.InOrder(4, 1)
    order.init(state := State())
    list(order.handleInputRows(("E",), iter([frame(mixed[k : k + 150]) for k in range(0, len(mixed), 150)]), None))
    for ms in (-90 * 60_000, 12 * 3_600_000 + 777, hours * 3_600_000):  # within hours, and past all
        found += order.handleExpiredTimer(("E",), SimpleNamespace(getCurrentWatermarkInMs=lambda ms=ms: ms), None)
    found = pd.concat(found)
    assert set(found.pop("instrument")) == {"E"} and len(whole) > 500
    assert sorted(map(tuple, found.to_numpy())) == sorted(map(tuple, whole.to_numpy()))
    assert state["last"].get() == end and max(most) <= each


def test_quotes_that_come_again_to_an_hour_are_kept_beside_those_that_wait():
    order = detect.InOrder(2, 30)
    order.init(State())
    seen = []
    for ms, rows in ((10_000, [(5_000_000, 1, 1.0, 1.0), (50_000_000, 4, 1.0, 1.0)]), (30_000, [(20_000_000, 2, 1.0, 1.0), (40_000_000, 3, 1.0, 1.0)]), (60_000, [(45_000_000, 5, 2.0, 1.0)])):
        list(order.handleInputRows(("E",), iter([frame(rows)]), None))
        for out in order.handleExpiredTimer(("E",), SimpleNamespace(getCurrentWatermarkInMs=lambda ms=ms: ms), None):
            seen += out.seq.tolist()
    assert seen == [2, 3]
