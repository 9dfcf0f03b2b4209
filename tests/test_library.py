from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import derivations, library, state

LOG = "evidence_id string, revision_id string, observed_at timestamp, known_at timestamp, published_at timestamp, seq long, historical_import boolean, retracted boolean, status string, run_id string, source string, url string"
DAY = datetime(2026, 7, 1)


def random_log(n=300, seed=1):
    rng = random.Random(seed)
    at = lambda: DAY + timedelta(hours=rng.randint(0, 400))
    return [
        (f"e{rng.randint(0, 25)}", f"r{rng.randint(0, 3)}", at(), at(), rng.choice([None, at()]), k, rng.random() < 0.2, rng.random() < 0.1, rng.choice([None, "ok", "retracted"] if rng.random() < 0.2 else ["ok"]), f"run{k % 5}", rng.choice(["a", "b", None]), None)
        for k in range(n)
    ]


def plain_snapshot(log, cutoff):
    groups = {}
    for r in sorted(log, key=lambda r: (r[3], r[5])):
        if r[2] <= cutoff and r[3] <= cutoff and (r[4] is None or r[4] <= cutoff):
            groups.setdefault(r[0], []).append(r)
    for key, events in groups.items():
        now = ([e for e in events if not e[6]] or events)[-1]
        if now[7] or now[8] == "retracted":
            continue
        own = [e for e in events if e[1] == now[1]]
        yield key, now[1], now[3], min(e[2] for e in events), max(e[2] for e in events), len(events), sorted({e[9] for e in own}), sorted({e[10] for e in own if e[10]})


def test_snapshots_equal_the_plain_form(spark):
    log = random_log()
    frame = spark.createDataFrame(log, LOG)
    for hours in (50, 200, 400):
        cutoff = DAY + timedelta(hours=hours)
        found = library.snapshot(frame, F.lit(cutoff)).select("evidence_id", "revision_id", "recorded_on", "first_observed_at", "last_observed_at", "observations", "run_ids", "source_labels").collect()
        assert sorted(map(tuple, found)) == sorted(plain_snapshot(log, cutoff))


def row(key, revision, known, seq, **more):
    base = {"observed_at": known, "published_at": None, "historical_import": False, "retracted": False, "status": None, "run_id": None, "source": None, "url": None} | more
    return (key, revision, base["observed_at"], known, base["published_at"], seq, base["historical_import"], base["retracted"], base["status"], base["run_id"], base["source"], base["url"])


def current(spark, rows, day, **options):
    found = library.snapshot(spark.createDataFrame(rows, LOG), F.lit(DAY + timedelta(days=day)), **options)
    return {r.evidence_id: r.revision_id for r in found.collect()}


def test_a_late_correction_does_not_rewrite_the_past(spark):
    rows = [row("e", "r1", DAY, 1), row("e", "r2", DAY + timedelta(days=5), 2, observed_at=DAY - timedelta(days=9))]
    assert current(spark, rows, 4) == {"e": "r1"} and current(spark, rows, 5) == {"e": "r2"}


def test_historical_imports_do_not_displace_what_was_seen(spark):
    rows = [row("e", "r1", DAY, 1), row("e", "r0", DAY + timedelta(days=2), 2, historical_import=True), row("f", "r0", DAY, 3, historical_import=True)]
    assert current(spark, rows, 9) == {"e": "r1", "f": "r0"}


def test_retractions_hide_and_can_be_shown(spark):
    rows = [row("e", "r1", DAY, 1), row("e", "r2", DAY + timedelta(days=1), 2, retracted=True)]
    assert current(spark, rows, 0) == {"e": "r1"} and current(spark, rows, 2) == {} and current(spark, rows, 2, include_retracted=True) == {"e": "r2"}


def test_delta(spark):
    rows = [row("a", "r1", DAY, 1), row("b", "r1", DAY, 2), row("c", "r1", DAY, 3), row("b", "r2", DAY + timedelta(days=2), 4), row("c", "r1", DAY + timedelta(days=2), 5), row("d", "r1", DAY + timedelta(days=2), 6)]
    frame = spark.createDataFrame(rows, LOG)
    found = library.delta(library.snapshot(frame, F.lit(DAY)), library.snapshot(frame, F.lit(DAY + timedelta(days=3)))).collect()
    assert sorted((r.evidence_id, r.change) for r in found) == [("b", "revised"), ("c", "reobserved"), ("d", "added")]


def test_replayed_batches_add_nothing(spark):
    batch = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "event_id string, v int")
    log = library.appended(batch.limit(0), batch)
    assert library.appended(log, batch).count() == 2


def test_conflicts_and_future_rows(spark):
    rows = spark.createDataFrame([("e", "r", "h1", DAY), ("e", "r", "h2", DAY), ("f", "r", "h", DAY + timedelta(days=9))], "evidence_id string, revision_id string, content_hash string, t timestamp")
    assert [r.evidence_id for r in library.revision_conflicts(rows).collect()] == ["e"]
    assert [r.evidence_id for r in library.future_events(rows, F.lit(DAY), ["t"]).collect()] == ["f"]


def test_references_resolve_by_precedence(spark):
    records = spark.createDataFrame(
        [("E1", "r1", "object:hn:post:1", "https://h/a", "the quote is here", ["old1"]), ("E2", "r1", "object:hn:post:2", "https://h/a", "other text", []), ("E3", "r1", None, "https://h/c", "x", ["old1"])],
        "evidence_id string, revision_id string, object_key string, url string, original_text string, aliases array<string>",
    )
    refs = spark.createDataFrame(
        [("1", "E1", None, None, None), ("2", None, None, "https://h/a", None), ("3", None, None, "https://h/a", "quote"), ("4", "old1", None, None, None), ("5", "E1", "r9", None, None), ("6", "object:hn:post:2", None, None, None), ("7", None, None, None, None)],
        "ref_id string, evidence_id string, revision_id string, url string, quote string",
    )
    found = {r.ref_id: (r.match_evidence_id, r.problem) for r in library.resolved(refs, records).collect()}
    assert found == {"1": ("E1", None), "2": (None, "ambiguous"), "3": ("E1", None), "4": (None, "ambiguous"), "5": (None, "missing"), "6": ("E2", None), "7": (None, "missing")}


def test_reviews_bind_to_revisions(spark):
    reviews = spark.createDataFrame(
        [("e", "r1", DAY, DAY, 1, "unrelated", None), ("e", "r1", DAY + timedelta(days=1), DAY, 2, "relevant", "alternative"), ("e", "r0", DAY, DAY, 3, "unrelated", None)],
        "evidence_id string, revision_id string, reviewed_at timestamp, known_on timestamp, seq long, status string, evidence_role string",
    )
    evidence = spark.createDataFrame([("e", "r1"), ("e", "r2")], "evidence_id string, revision_id string")
    found = {r.revision_id: (r.semantic_status, r.evidence_role) for r in library.reviewed(evidence, library.latest_reviews(reviews)).collect()}
    assert found == {"r1": ("relevant", "alternative"), "r2": ("not_reviewed", None)}
    early = library.reviewed(evidence, library.latest_reviews(reviews, F.lit(DAY))).collect()
    assert {r.revision_id: r.semantic_status for r in early}["r1"] == "unrelated"


def test_new_parses_supersede_what_they_lack(spark):
    members = "sha string, object_key string, content_hash string"
    old = derivations.derive_sets(spark.createDataFrame([("s1", "a", "h"), ("s1", "b", "h"), ("s2", "b", "h")], members), spark.createDataFrame([("s1", "1.0", "complete"), ("s2", "1.0", "complete")], "sha string, parser_version string, status string"))
    new = derivations.derive_sets(spark.createDataFrame([("s1", "a", "h")], members), spark.createDataFrame([("s1", "1.10", "complete"), ("s3", "1.10", "partial"), ("s4", "2", "complete"), ("s4", "2", "complete")], "sha string, parser_version string, status string"))
    other = derivations.derive_sets(spark.createDataFrame([("s4", "z", "h")], members), spark.createDataFrame([("s4", "2", "complete")], "sha string, parser_version string, status string"))
    latest = derivations.latest_sets(old.where("sha = 's1'").unionByName(new).unionByName(other))
    assert {r.sha: r.status for r in latest.collect()} == {"s1": "complete", "s3": "partial", "s4": "conflict"}
    records = spark.createDataFrame([("1", "a", "h"), ("2", "b", "h"), ("3", "b", "h"), ("4", "c", "h"), ("5", "d", "h"), ("6", "e", "h"), ("7", "b", "h")], "record_id string, object_key string, content_hash string")
    refs = spark.createDataFrame([("1", "s1", "1.0"), ("2", "s1", "1.0"), ("3", "s1", "1.0"), ("3", "s2", "1.0"), ("4", "s3", "1.0"), ("5", "s4", "1.0"), ("7", "s1", "1.10")], "record_id string, sha string, parser_version string")
    found = {r.record_id: r.derivation_status for r in derivations.decided(records, refs, latest).collect()}
    assert found == {"1": "active", "2": "superseded", "3": "active", "4": "needs_review", "5": "needs_review", "6": "active", "7": "needs_review"}


def test_states_and_histories(spark):
    rows = spark.createDataFrame([("k", "r1", True, 1), ("k", "r2", False, 2), ("m", "r1", True, 1), ("m", "r1", False, 2)], "key string, revision_id string, retracted boolean, seq int")
    found = {r.key: (r.current_revision_id, r.status, r.retracted) for r in derivations.current_state(rows, "key", "seq").collect()}
    assert found == {"k": ("r2", "ambiguous", True), "m": ("r1", "current", False)}
    leases = spark.createDataFrame([("b1", DAY, 1, DAY + timedelta(hours=1), False), ("b1", DAY + timedelta(hours=2), 2, DAY + timedelta(hours=3), False), ("b2", DAY, 1, DAY + timedelta(hours=9), True)], "batch_id string, claimed_at timestamp, seq int, expires_at timestamp, committed boolean")
    status = lambda h: {r.batch_id: r.status for r in state.lease_view(leases, F.lit(DAY + timedelta(hours=h))).collect()}
    assert status(2) == {"b1": "leased", "b2": "committed"} and status(3) == {"b1": "available", "b2": "committed"}
    signals = spark.createDataFrame([("SIG-1", True, DAY), ("SIG-2", False, DAY)], "signal_id string, promoted boolean, day timestamp")
    assert sorted((r.record_id, r.kind, r.other_id) for r in state.promotions(signals).collect()) == [("OPP-1", "opened", "SIG-1"), ("SIG-1", "promoted", "OPP-1")]


def test_a_key_of_many_records_makes_no_row_for_each_pair(spark):
    """60,000 references to an alias of 60,000 records: 3.6 billion pairs, which took minutes."""
    none = F.lit(None).cast("string")
    records = spark.range(60_000).select(F.concat(F.lit("e"), "id").alias("evidence_id"), F.concat(F.lit("r"), F.col("id") % 2).alias("revision_id"), none.alias("object_key"), none.alias("url"), F.lit("t").alias("original_text"), F.array(F.lit("a")).alias("aliases"))
    refs = spark.range(60_000).select(F.col("id").alias("ref_id"), F.when(F.col("id") > 1, "a").otherwise("e7").alias("evidence_id"), F.when(F.col("id") == 1, "r0").alias("revision_id"), none.alias("url"), none.alias("quote"))
    started = time.monotonic()
    found = library.resolved(refs, records).groupBy("problem", "match_evidence_id").count().collect()
    assert {(r[0], r[1]): r[2] for r in found} == {(None, "e7"): 1, ("missing", None): 1, ("ambiguous", None): 59_998}
    assert time.monotonic() - started < 60
