from __future__ import annotations

import random
from datetime import datetime, timedelta

from lodestone.streaming import state

EVENTS = "batch_id string, at timestamp, seq long, kind string, worker string, lease_id string, seconds long, submission_id string, digest string"
PAGES = "post_id string, page long, seq long, cursor string, comment_ids array<string>, has_more boolean, next_cursor string"
DAY = datetime(2026, 7, 1, 12)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{name}")


def event(batch, minute, seq, kind, worker, lease, seconds=None, submission=None, digest=None):
    return (batch, DAY + timedelta(minutes=minute), seq, kind, worker, lease, seconds, submission, digest)


def plain_leases(events, end):
    """Decisions by (batch, at, seq, decision), an event at a time; leases whose time is before ``end`` expire."""
    out, held, done = [], {}, {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        b, at, seq, kind, worker, lease, seconds, submission, digest = e
        if b in held and held[b][2] <= at:
            out.append((b, held.pop(b)[2], None, "expired"))
        own = held.get(b, (None, None))[:2] == (lease, worker)
        if kind == "claim":
            word = "refused: done" if done.get(b, {}) else "refused: leased" if b in held else "claimed"
            if word == "claimed":
                held[b] = (lease, worker, at + timedelta(seconds=seconds))
        elif kind == "submit":
            known = done.get(b, {}).get(submission)
            word = ("repeated" if known == (lease, worker, digest) else "refused: another submission") if known else "committed" if own else "refused: no lease"
            if word == "committed":
                done.setdefault(b, {})[submission] = (lease, worker, digest)
                held.pop(b)
        else:
            word = "released" if own else "refused: no lease"
            if own:
                held.pop(b)
        out.append((b, at, seq, word))
    return sorted([*out, *((b, x[2], None, "expired") for b, x in held.items() if x[2] <= end)], key=str)


def test_leases_are_claimed_expire_and_refuse_what_is_late(spark, tmp_path):
    events = [
        event("b1", 0, 1, "claim", "ann", "l1", 600), event("b1", 5, 2, "claim", "bob", "l2", 600), event("b1", 11, 3, "claim", "bob", "l3", 600), event("b1", 12, 4, "submit", "ann", "l1", None, "s1", "x"),
        event("b1", 13, 5, "submit", "bob", "l3", None, "s2", "y"), event("b1", 14, 6, "submit", "bob", "l3", None, "s2", "y"), event("b1", 15, 7, "submit", "bob", "l3", None, "s2", "z"), event("b1", 90, 8, "claim", "cat", "l4", 60),
        event("b2", 1, 9, "claim", "ann", "l5", 300), event("b2", 2, 10, "release", "bob", "l5"), event("b2", 3, 11, "release", "ann", "l5"), event("b2", 4, 12, "claim", "bob", "l6", 120),
        event("b3", 200, 13, "claim", "ann", "l7", 60),
    ]
    put(spark, tmp_path, "a", events[:4] + events[8:12], EVENTS)
    found = state.finished(state.leases(stream(spark, tmp_path, EVENTS)), f"{tmp_path}/out", f"{tmp_path}/c")
    assert found.count() >= 6
    # Another run from the checkpoint: what the first knew still holds.
    put(spark, tmp_path, "b", events[4:8] + events[12:], EVENTS)
    found = state.finished(state.leases(stream(spark, tmp_path, EVENTS)), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    got = sorted(((r.batch_id, r["at"], r.seq, r.decision) for r in found), key=str)
    assert got == plain_leases(events, DAY + timedelta(minutes=200))
    words = {r.seq: r.decision for r in found if r.seq}
    assert words[3] == "claimed" and words[4] == "refused: no lease" and words[5] == "committed" and words[6] == "repeated" and words[7] == "refused: another submission" and words[8] == "refused: done"
    assert ("b2", DAY + timedelta(minutes=6), None, "expired") in got


def test_random_leases_equal_a_plain_model(spark, tmp_path):
    rng, events = random.Random(2), []
    for seq in range(150):
        worker, lease = rng.choice("xyz"), f"l{rng.randrange(12)}"
        kind = rng.choice(["claim", "claim", "submit", "release"])
        events.append(event(f"b{rng.randrange(9)}", seq, seq, kind, worker, lease, 60 * rng.randrange(1, 40), f"s{rng.randrange(6)}", rng.choice("pq")))
    for k in range(3):
        put(spark, tmp_path, f"{k}", events[50 * k : 50 * k + 50], EVENTS)
    found = state.finished(state.leases(stream(spark, tmp_path, EVENTS)), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    assert sorted(((r.batch_id, r["at"], r.seq, r.decision) for r in found), key=str) == plain_leases(events, DAY + timedelta(minutes=149))


def test_pages_carry_on_after_a_restart(spark, tmp_path):
    pages = [
        ("p", 1, 1, None, ["a", "b"], True, "c2"), ("q", 1, 2, None, ["x"], False, None), ("r", 1, 3, None, [], False, None), ("s", 1, 4, None, None, None, None), ("t", 1, 5, None, ["a"], None, None), (None, 1, 6, None, ["z"], True, "c"),
        ("p", 2, 7, "c2", ["b", "c"], True, "c2"), ("u", 1, 8, None, [f"n{k}" for k in range(6)], True, "c2"), ("v", 3, 9, "c3", ["a", None], True, "c4"), ("p", 2, 10, "c2", ["d"], True, "c9"),
    ]
    put(spark, tmp_path, "a", pages[:6], PAGES)
    make = lambda: state.comment_pages(stream(spark, tmp_path, PAGES), max_pages=3, max_comments=5)
    state.finished(make(), f"{tmp_path}/out", f"{tmp_path}/c")
    put(spark, tmp_path, "b", pages[6:], PAGES)
    found = state.finished(make(), f"{tmp_path}/out", f"{tmp_path}/c").collect()
    got = {(r.post_id, r.page, r.added): (r.comments, r.decision, r.next_cursor) for r in found}
    assert got == {
        ("p", 1, 2): (2, "next_page_planned", "c2"), ("p", 2, 1): (3, "repeated_cursor", None), ("p", 2, 0): (3, "repeated_request", None), ("q", 1, 1): (1, "provider_end", None), ("r", 1, 0): (0, "empty_page", None),
        ("s", 1, 0): (0, "empty_or_unrecognized_page", None), ("t", 1, 1): (1, "pagination_unknown", None), ("u", 1, 6): (6, "comment_limit", None), ("v", 3, 1): (1, "page_limit", None),
    }
