"""The ordered stream's operator: calls to the state serve all tasks of a bucket."""

from collections import Counter
from types import SimpleNamespace as Of

from haulage.streaming import ordered


class Handle:
    """State in memory that counts the calls to it."""

    def __init__(self):
        self.calls, self.listed, self.mapped, self.timers = Counter(), [], {}, []

    def _count(self, name, found=None):
        self.calls[name] += 1
        return found

    def getListState(self, name, schema):
        return Of(exists=lambda: self._count("exists", bool(self.listed)), get=lambda: self._count("get", iter(list(self.listed))),
                  appendList=lambda rows: self._count("append", self.listed.extend(rows)), put=lambda rows: self._count("put", self._set(rows)),
                  clear=lambda: self._count("clear", self._set([])))

    def _set(self, rows):
        self.listed = list(rows)

    def getMapState(self, name, key, value):
        return Of(exists=lambda: self._count("exists", bool(self.mapped)), iterator=lambda: self._count("iterator", iter(list(self.mapped.items()))),
                  updateValue=lambda k, v: self._count("update", self.mapped.__setitem__(k, v)), removeKey=lambda k: self._count("remove", self.mapped.pop(k)))

    def registerTimer(self, at):
        self._count("timer", self.timers.append(at))


def woken(judge, passed):
    return list(judge.handleExpiredTimer((0,), Of(getCurrentWatermarkInMs=lambda: passed), None))


def test_a_bucket_of_tasks_is_one_state():
    handle, judge = Handle(), ordered.OrderedJudge("cancel")
    judge.init(handle)
    rows = [Of(task_id=t, kind=kind, at=1000 * at, seq=at) for t in range(500) for kind, at in (("cancel", 20), ("start", 10), ("cancel", 90), ("cancel", 2))]
    late = list(judge.handleInputRows((0,), iter(rows), Of(getCurrentWatermarkInMs=lambda: 5)))
    assert len(late) == 500 and all(r.late and r.seq == 2 for r in late)
    assert handle.calls.total() <= 2 and handle.timers == [10]      # a call for each task would be 500
    out = woken(judge, 50)
    assert Counter((r.seq, r.outcome) for r in out) == {(10, None): 500, (20, "accepted"): 500} and len({r.task_id for r in out}) == 500
    assert handle.calls.total() <= 500 + 10 and handle.timers[-1] == 90 and len(handle.listed) == 500
    assert Counter(r.outcome for r in woken(judge, 95)) == {"rejected": 500} and not handle.listed and len(handle.mapped) == 500


def test_tasks_of_a_bucket_are_forgotten_one_by_one():
    handle, judge = Handle(), ordered.OrderedJudge("cancel", forget_ms=100)
    judge.init(handle)
    give = lambda passed, *rows: list(judge.handleInputRows((0,), (Of(task_id=t, kind=k, at=1000 * at, seq=at) for t, k, at in rows), Of(getCurrentWatermarkInMs=lambda: passed)))
    give(0, (1, "start", 10), (None, "start", 60))
    woken(judge, 70)
    assert set(handle.mapped) == {(1,), (None,)} and {110, 160} <= set(handle.timers)
    woken(judge, 115)
    assert set(handle.mapped) == {(None,)}
    give(115, (1, "cancel", 120), (None, "cancel", 121))
    assert {(r.task_id, r.outcome) for r in woken(judge, 130)} == {(1, "not_found"), (None, "accepted")}
