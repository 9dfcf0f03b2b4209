"""Streams with state by key: leases of review batches that expire, and comment pages that carry on."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that these streams need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a lease may last, in seconds (fixed values).
SHORTEST, LONGEST = 1, 86_400

LEASED = "batch_id string, at_ms long, seq long, kind string, worker string, lease_id string, decision string"


def _row(schema: str, *values: Any) -> Row:
    """A row that knows its names, which Spark asks for."""
    return Row(**dict(zip((c.split()[0] for c in schema.split(", ")), values, strict=True)))


class Leases(StatefulProcessor):
    """One batch: who holds it, until when, and what has been handed in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "lease_id string, worker string, expires_ms long, done boolean")
        self.submissions = handle.getMapState("submissions", "submission_id string", "lease_id string, worker string, digest string")

    def _stored(self) -> Any:
        return tuple(self.lease.get()) if self.lease.exists() else None

    def _before(self, submission: Any) -> Any:
        """What was handed in under an id; asked of the store once."""
        if submission not in self.known:
            self.known[submission] = tuple(self.submissions.getValue((submission,))) if self.submissions.containsKey((submission,)) else None
        return self.known[submission]

    def _decide(self, batch: str, r: Row) -> Iterator[tuple]:
        held = self.held
        if held and not held[3] and held[2] <= r.at_ms:
            yield (batch, held[2], None, "expiry", held[1], held[0], "expired")
            held = self.held = None
        said = lambda word: (batch, r.at_ms, r.seq, r.kind, r.worker, r.lease_id, word)
        own = held and not held[3] and (held[0], held[1]) == (r.lease_id, r.worker)
        if r.kind == "claim":
            if held and held[3]:
                yield said("refused: done")
            elif held:
                yield said("refused: leased")
            elif not SHORTEST <= (r.seconds or 0) <= LONGEST or not r.worker or not r.lease_id:
                yield said("refused: invalid")
            else:
                self.held = (r.lease_id, r.worker, r.at_ms + 1000 * r.seconds, False)
                yield said("claimed")
        elif r.kind == "submit":
            # Work that is handed in ends the batch for good, so before that there is none to look up.
            before = self._before(r.submission_id) if held and held[3] else None
            if before:
                same = (before[0], before[1], before[2]) == (r.lease_id, r.worker, r.digest)
                yield said("repeated" if same else "refused: another submission")
            elif not own:
                yield said("refused: no lease")
            else:
                self.known[r.submission_id] = (r.lease_id, r.worker, r.digest)
                self.submissions.updateValue((r.submission_id,), self.known[r.submission_id])
                self.held = (held[0], held[1], held[2], True)
                yield said("committed")
        elif r.kind == "release":
            if own:
                self.held = None
            yield said("released" if own else "refused: no lease")
        else:
            yield said("refused: unknown kind")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # The store is read once for a batch's events and told once what they leave, as each call costs a trip to the JVM.
        stored = self.held = self._stored()
        self.known: dict = {}
        for r in sorted(rows, key=lambda r: (r.at_ms, r.seq)):
            for out in self._decide(key[0], r):
                yield _row(LEASED, *out)
        if self.held == stored:
            return
        timer = lambda lease: lease[2] if lease and not lease[3] else None
        old, new = timer(stored), timer(self.held)
        if old is not None and old != new:
            self.handle.deleteTimer(old)
        if new is not None and old != new:
            self.handle.registerTimer(new)
        if self.held:
            self.lease.update(self.held)
        else:
            self.lease.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self._stored()
        if held and not held[3] and held[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.clear()
            yield _row(LEASED, key[0], held[2], None, "expiry", held[1], held[0], "expired")

    def close(self) -> None:
        pass


def leases(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """What becomes of each event of a review queue, and each lease's expiry.

    ``events``: batch_id, at, seq, kind (claim, submit, release), worker, lease_id, seconds,
    submission_id, digest. A batch is one worker's at a time: a claim is refused while another
    lease runs, and for good once work on it was handed in. A lease ends at its time, by a timer
    when the watermark passes it or before the batch's next event, whichever comes first; then the
    batch is free, and what its holder hands in is refused. Handing in the same again under one
    submission_id is ``repeated``, and under another's content refused.

    A batch's state is one lease and its submissions. Events are taken in order of (at, seq) within
    a micro-batch; those older than ``delay`` before the newest of earlier ones are dropped by the
    watermark. Events without a batch or time are dropped. Needs the RocksDB state store.
    """
    rows = events.where("batch_id is not null and at is not null").withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    found = rows.groupBy("batch_id").transformWithState(statefulProcessor=Leases(), outputStructType=LEASED, outputMode="Append", timeMode="EventTime")
    return found.withColumn("at_ms", F.timestamp_millis("at_ms")).withColumnRenamed("at_ms", "at")


PAGED = "post_id string, page long, added long, comments long, decision string, next_cursor string"


class Pages(StatefulProcessor):
    """One post: comments and requests that were seen, and whether reading has ended."""

    def __init__(self, max_pages: int, max_comments: int) -> None:
        self.max_pages, self.max_comments = max_pages, max_comments

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "comments long")
        self.read = handle.getListState("read", "cursor string, ids array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # What was seen is read once for a post's pages, and what they add is appended once: each call costs a trip to the JVM.
        seen, requests, comments, added = 0, set(), set(), []
        if self.count.exists():
            seen = self.count.get()[0]
            for cursor, ids in self.read.get():
                requests.add(cursor)
                comments.update(ids)
        for r in sorted(rows, key=lambda r: (r.page, r.seq)):
            asked = r.cursor or ""
            if asked in requests:
                yield _row(PAGED, key[0], r.page, 0, seen, "repeated_request", None)
                continue
            ids = {x for x in (r.comment_ids or ()) if x is not None}
            new = sorted(ids - comments)
            requests.add(asked)
            comments.update(new)
            added.append((asked, new))
            seen += len(new)
            following = r.next_cursor or ""
            if not ids:
                decision = "empty_page" if r.has_more is False else "empty_or_unrecognized_page"
            elif seen >= self.max_comments:
                decision = "comment_limit"
            elif r.has_more is False:
                decision = "provider_end"
            elif r.page >= self.max_pages:
                decision = "page_limit"
            elif not following:
                decision = "pagination_unknown"
            elif following in requests:
                decision = "repeated_cursor"
            else:
                decision = "next_page_planned"
            yield _row(PAGED, key[0], r.page, len(new), seen, decision, following if decision == "next_page_planned" else None)
        if added:
            self.read.appendList(added)
            self.count.update((seen,))

    def close(self) -> None:
        pass


def comment_pages(pages: DataFrame, max_pages: int = 3, max_comments: int = 100) -> DataFrame:
    """Of each page of a post's comments: how many are new, and whether and where reading carries on.

    ``pages``: post_id, page, seq, cursor (that the page was asked by), comment_ids, has_more,
    next_cursor. Comments and cursors that were seen are a list by post, an entry for each page: a
    micro-batch appends what a post's pages add to it, and reads it once for each post that has new
    pages, whatever the number of their comments. A query that starts again from its checkpoint
    goes on as if it had never stopped. Pages without a post are dropped. Needs the
    RocksDB state store.
    """
    rows = pages.where("post_id is not null")
    return rows.groupBy("post_id").transformWithState(statefulProcessor=Pages(max_pages, max_comments), outputStructType=PAGED, outputMode="Append", timeMode="None")


def finished(frame: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """The rows that a stream gives until its input ends, written to ``path``: all its runs' rows."""
    spark = frame.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(frame.schema).parquet(path)


