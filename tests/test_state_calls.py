"""How often stream processors call their state: each call is a round trip to Spark, so calls must not grow with votes or columns."""

import pandas as pd
from pyspark.sql import Row

from larkspan.streaming.jobs import JobMachine
from larkspan.streaming.votes import VoteFold


class Store:
    """A value state, or a map state, that counts calls."""

    def __init__(self):
        self.rows, self.calls = {}, 0

    def _of(self, key=None, value=None, what="get"):
        self.calls += 1
        if what == "put":
            self.rows[key] = value
        elif what == "drop":
            self.rows.pop(key, None)
        return self.rows.get(key)

    def exists(self):
        return self._of() is not None

    def get(self):
        return self._of()

    def update(self, value):
        self._of(None, value, "put")

    def clear(self):
        self._of(None, None, "drop")

    def containsKey(self, key):  # noqa: N802
        return self._of(key) is not None

    def getValue(self, key):  # noqa: N802
        return self._of(key)

    def updateValue(self, key, value):  # noqa: N802
        self._of(key, value, "put")

    def removeKey(self, key):  # noqa: N802
        self._of(key, None, "drop")


class Handle:
    def __init__(self):
        self.stores = {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.stores.setdefault(name, Store())

    getValueState = getMapState  # noqa: N815


def test_votes_of_many_users_take_few_calls():
    handle, fold = Handle(), VoteFold()
    fold.init(handle)
    score = lambda rows: list(fold.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["user_id", "vote", "seq"])]), None))[0]["score"][0]
    assert score([(u, 1, u) for u in range(-100, 1000)]) == 1100
    assert handle.stores["votes"].calls <= 3 * 5  # five blocks of 256 users
    assert score([(-100, -1, 1), (5, 0, 2), (6, 1, 3), (6, -1, 4), (2000, 0, 5), (3000, 1, 6)]) == 1100 - 2 - 1 - 2 + 1
    assert score([(3000, 0, 1)]) == 1095 and (3000 >> 8,) not in handle.stores["votes"].rows


def test_a_job_is_one_value():
    handle, machine = Handle(), JobMachine(None, None, ["at", "n"])
    machine.init(handle)
    message = lambda at, kind, n=None: Row(at=at, kind=kind, ok=None, n=n, total=None)
    out = list(machine.handleInputRows((4,), iter([message(3, "done"), message(1, "start"), message(2, "add", 5)]), None))
    assert [(r["job"], r["status"], r["progress"], r["ended_at"]) for r in out] == [(4, "done", 5, 3)]
    assert list(handle.stores) == ["job"] and handle.stores["job"].calls == 2
