"""A key's samples are read and written once a batch, however many there are."""

import pandas as pd

from sedgewren.streaming import keyed


class Counted:
    def __init__(self):
        self.calls, self.value, self.map = 0, None, {}

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def iterator(self):
        self.calls += 1
        return iter(list(self.map.items()))

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.map[key] = value

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.map

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self.map[key]


class Handle:
    def __init__(self):
        self.of = {"base": Counted(), "samples": Counted()}

    getValueState = getMapState = lambda self, name, *schema: self.of[name]  # noqa: N815
    listTimers = lambda self: []  # noqa: N815, E731
    registerTimer = lambda self, at: None  # noqa: N815, E731


def test_calls_do_not_grow_with_samples():
    handle, work = Handle(), keyed.CounterGrowth()
    work.init(handle)
    rows = []
    for batch in range(2):
        frame = pd.DataFrame({"at": [(batch * 100 + i) * keyed.DAY // 50 for i in range(100)], "counter": range(batch * 100, batch * 100 + 100)})
        rows += list(work.handleInputRows((7,), iter([frame]), None))
    assert rows[-1]["counter"].tolist() == [199] and rows[-1]["day_delta"].tolist() == [50]
    assert handle.of["samples"].calls <= 4
