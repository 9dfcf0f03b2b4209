"""How often the processors ask the state store: each call is a trip to the JVM."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Row

from lodestone.streaming import state


class Store:
    """A handle whose states count the calls."""

    def __init__(self):
        self.calls, self.values, self.timers = Counter(), {}, set()

    def _state(self, name, *_):
        self.values.setdefault(name, None)
        store = self

        class One:
            def __getattr__(self, call):
                store.calls[name] += 1
                held = store.values[name]
                return {
                    "exists": lambda: held is not None, "get": lambda: held if not isinstance(held, list) else iter(held), "update": lambda v: store.values.update({name: v}), "clear": lambda: store.values.update({name: None}),
                    "appendList": lambda v: store.values.update({name: [*(held or []), *v]}), "containsKey": lambda k: k in (held or {}), "getValue": lambda k: held[k], "updateValue": lambda k, v: store.values.update({name: {**(held or {}), k: v}}),
                }[call]

        return One()

    getValueState = getListState = getMapState = _state

    def registerTimer(self, at):
        self.calls["timers"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["timers"] += 1
        self.timers.discard(at)


def page(n, ids, cursor, following):
    return Row(page=n, seq=n, cursor=cursor, comment_ids=ids, has_more=True, next_cursor=following)


def test_pages_ask_the_store_once_for_a_post_whatever_its_comments():
    store = Store()
    pages = state.Pages(3, 10_000)
    pages.init(store)
    first = list(pages.handleInputRows(("p",), iter([page(0, [f"a{k}" for k in range(500)], None, "t1"), page(1, [f"a{k}" for k in range(250, 700)], "t1", "t2")]), None))
    assert [(r.added, r.comments, r.decision) for r in first] == [(500, 500, "next_page_planned"), (200, 700, "next_page_planned")]
    assert sum(store.calls.values()) <= 5
    then = list(pages.handleInputRows(("p",), iter([page(1, ["x"], "t1", "t2"), page(2, ["a1", "a699", "b"], "t2", "t1")]), None))
    assert [(r.added, r.comments, r.decision) for r in then] == [(0, 700, "repeated_request"), (1, 701, "repeated_cursor")]
    assert sum(store.calls.values()) <= 10


def test_leases_ask_the_store_once_for_a_batch_whatever_its_events():
    event = lambda at, kind, worker: Row(at_ms=at, seq=at, kind=kind, worker=worker, lease_id=worker, seconds=10, submission_id=f"s{worker}", digest="d")
    store = Store()
    leases = state.Leases()
    leases.init(store)
    many = [event(k * 1000, ("claim", "release")[k % 2], "w") for k in range(401)]
    found = list(leases.handleInputRows(("b",), iter(many), None))
    assert Counter(r.decision for r in found) == {"claimed": 201, "released": 200}
    assert sum(store.calls.values()) <= 4
    assert store.timers == {410_000}
    found = list(leases.handleInputRows(("b",), iter([event(411_000, "submit", "w"), event(412_000, "claim", "v"), event(413_000, "submit", "v"), event(414_000, "submit", "v")]), None))
    assert [r.decision for r in found] == ["expired", "refused: no lease", "claimed", "committed", "repeated"]
    assert store.timers == set()
    found = list(leases.handleInputRows(("b",), iter([event(500_000, "submit", "v"), event(500_001, "submit", "w"), event(500_002, "claim", "w")]), None))
    assert [r.decision for r in found] == ["repeated", "refused: no lease", "refused: done"]
