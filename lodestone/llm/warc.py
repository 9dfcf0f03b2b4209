"""WARC archives: a writer that deduplicates payloads, and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, new_path, spread
from lodestone.llm.files import create, store

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
#: Bytes of a member that are decoded at once to find its header's end.
HEADER = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1; five bytes make eight digits, which conv spells in base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_type(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with digest, payload_bytes and refers_to (null for a response).

    Of rows with equal payloads of at least ``least`` bytes, that with the largest key is the
    response, and the others refer to it; null keys come last. Rows that repeat the largest
    key are responses each. A hot payload combines before the shuffle, and Spark splits its
    side of the join.
    """
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    sized = spread(pages).withColumn("_digest", base32_sha1(data)).withColumn("_bytes", F.octet_length(data).cast("long"))
    owner = (
        sized.where(F.col("_bytes") >= least)
        .groupBy("_digest").agg(F.max(key).alias("_owner"))
        .withColumnRenamed("_digest", "_of")
    )
    owner = materialise(owner, "owners")  # so that the join below is a plain one, whose hot keys Spark splits
    joined = sized.join(owner, sized._digest == owner._of, "left")
    own = (F.col("_bytes") < least) | F.col(key).eqNullSafe(F.col("_owner"))
    return joined.withColumn("_refers_to", F.when(~own, F.col("_owner"))).withColumn("_revisit", ~own).drop("_of", "_owner")


def record(key: object, uri: str | None, payload: bytes, size: int, digest: str, refers_to: object, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}"]
    if key is not None:
        lines.append(f"WARC-Record-ID: <urn:record:{key}>")
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0, level: int = 3) -> DataFrame:
    """Writes every page as a gzip member of its task's archive; returns (path, size, records).

    Only archives in the returned table count: a lost attempt's file isn't in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                k, u, text, digest, length, refers, revisit = (x.as_py() for x in row)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = (text or "").encode("utf-8", "replace")
                member = squeeze.compress(record(k, u, data, length, digest, refers, revisit)) + squeeze.flush()
                out = out or create(folder, name)
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": [size], "records": [n]})

    text = F.when(~F.col("_revisit"), F.col(payload))
    rows = with_record_type(pages.select(key, uri, payload), key, payload, least)
    rows = rows.select(key, uri, text, "_digest", "_bytes", "_refers_to", "_revisit")
    return materialise(rows.mapInArrow(run, "path string, size long, records long"), "archives")


class _Span:
    """A file read in blocks, by absolute offset."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def _hold(self, offset: int, least: int) -> None:
        if not self.start <= offset or self.start + len(self.data) < min(offset + least, self.size):
            self.data = self.file.read_at(max(BLOCK, least), offset) if offset < self.size else b""
            self.start = offset

    def at(self, offset: int, least: int = 1) -> memoryview:
        """Bytes from ``offset`` on, not copied: at least so many, unless the file ends."""
        self._hold(offset, least)
        return memoryview(self.data)[offset - self.start :]

    def magic(self, offset: int, end: int) -> int:
        """The first place in [offset, end) where gzip magic begins, or ``end``."""
        while offset < end:
            self._hold(offset, len(MAGIC))
            hit = self.data.find(MAGIC, offset - self.start)
            if hit >= 0:
                return min(self.start + hit, end)
            offset = max(offset + 1, self.start + len(self.data) - len(MAGIC) + 1)
        return end


def _is_record(span: _Span, offset: int) -> bool:
    """Whether a gzip member that starts here decodes to the header of a WARC record."""
    unpack, head, end = zlib.decompressobj(31), bytearray(), -1
    data = span.at(offset, HEADER)[:HEADER]
    offset += len(data)
    while end < 0 and data and not unpack.eof:
        seen = len(head)
        try:
            head += unpack.decompress(data, HEADER)
        except zlib.error:
            return False
        if not b"WARC/1.".startswith(head[:7]):
            return False
        end = head.find(b"\r\n\r\n", max(0, seen - 3))
        data = unpack.unconsumed_tail
        if not data and end < 0:
            data = span.at(offset)[:HEADER]
            offset += len(data)
    return end >= 0 and b"\r\nWARC-Type:" in head[: end + 2]


def _parts(span: _Span, offset: int) -> Iterator[tuple[bytes, int]]:
    """The content of the member that starts at ``offset`` by blocks, each with how far was read; the last with the member's end."""
    unpack = zlib.decompressobj(31)
    while not unpack.eof:
        data = span.at(offset)[:HEADER]  # zlib copies what it leaves over
        offset += len(data)
        ended = not data
        while not unpack.eof:
            out = unpack.decompress(data, BLOCK)  # all input may be in, and output still to come
            data = unpack.unconsumed_tail
            if not out and not data:
                break
            yield out, offset - len(data)
        if ended and not unpack.eof:
            raise EOFError("a WARC record isn't whole")
    yield b"", offset - len(unpack.unused_data)


def _member(span: _Span, offset: int) -> tuple[bytes, int]:
    """The content of the member that starts at ``offset``, and where it ends."""
    parts = list(_parts(span, offset))
    return b"".join(x for x, _ in parts), parts[-1][1]


def candidates(file, size: int, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(offset, end) of every member in [start, end) that reads as a record, also of those within another's payload."""
    span, offset = _Span(file, size), start
    while (offset := span.magic(offset, end)) < end:
        if _is_record(span, offset):
            try:
                for _, after in _parts(span, offset):
                    pass
                yield offset, after
            except (EOFError, zlib.error):
                pass  # no whole member: a header within a payload, or a broken archive, which ``entries`` tells
        offset += 1


def members(file, size: int, start: int, end: int, sure: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end), wherever they end.

    ``sure``: a record starts at ``start``, as ``entries`` finds it. Without that, a range that
    is looked at alone takes for its first record what is followed by another or by the end.
    """
    span, offset, sure = _Span(file, size), start, sure or not start
    while offset < end:
        offset = span.magic(offset, end)
        if offset >= end:
            return
        if _is_record(span, offset):
            content, after = _member(span, offset)
            if sure or after == size or bytes(span.at(after, len(MAGIC))[: len(MAGIC)]) == MAGIC:
                yield offset, content
                offset, sure = after, True
            else:
                offset += 1
        else:
            offset += 1


def parsed(content: bytes) -> dict:
    """Header fields and payload of a record."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = block[: int(fields.get("Content-Length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: (\d+)", http)
    name = lambda x: m[1] if (m := re.fullmatch(r"<urn:record:(.*)>", x or "")) else None
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    kind = fields.get("WARC-Type")
    if kind == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != real:
            raise ValueError("a payload doesn't have its digest")
        digest, size = real, len(payload)
    else:
        size = int(length[1]) if length else None
    return {
        "record_id": name(fields.get("WARC-Record-ID")), "record_type": kind, "target_uri": fields.get("WARC-Target-URI"),
        "payload_bytes": size, "payload_digest": digest, "refers_to": name(fields.get("WARC-Refers-To")), "payload": payload,
    }


def entries(spark: SparkSession, archives: DataFrame, split: int = 16 << 20) -> DataFrame:
    """(path, size, start, entry): where the first record that starts in each byte range is, for ranges that have one.

    Every range reports its candidates and their ends. A record is what is reached from the
    archive's beginning, each starting where the one before ends; members in an archived archive
    aren't reached. Within a range candidates are followed in order; from range to range, a join
    of ends to starts is doubled until no range is added, so an archive of n ranges takes log2(n)
    joins of a few numbers a range. Raises where a chain doesn't end at the archive's end.
    """
    spans = archives.where("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = store(r["path"])
                end = min(r["start"] + split, r["size"])
                with system.open_input_file(path) as file:
                    found = dict(candidates(file, r["size"], r["start"], end))
                leaves = {}  # where the chain from a candidate leaves the range
                for offset in sorted(found, reverse=True):
                    leaves[offset] = leaves.get(found[offset], found[offset])
                yield pa.RecordBatch.from_pylist([{**r, "entry": at, "leaves": leaves[at]} for at in sorted(found)], schema)

    s, i = pa.string(), pa.int64()
    schema = pa.schema([("path", s), ("size", i), ("start", i), ("entry", i), ("leaves", i)])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "path string, size long, start long, entry long, leaves long"
    found = materialise(spans.repartition(n, "path", "start").mapInArrow(run, kinds), "candidates")
    archives = archives.where("size > 0").select(F.col("path").alias("p"), F.col("size").alias("end"))
    single = found.where("entry = 0 and leaves = size")
    if archives.join(single, F.col("path") == F.col("p"), "left_anti").isEmpty():  # every archive is one range
        return single.select("path", "size", "start", "entry")
    # What can be the first record of a range: the archive's beginning, and where some chain goes on after leaving its range.
    ends = found.select(F.col("path").alias("p"), F.col("leaves").alias("e")).distinct()
    nodes = found.join(ends, (F.col("path") == F.col("p")) & (F.col("entry") == F.col("e")), "left").where("entry = 0 or e is not null")
    nodes = materialise(nodes.select("path", "size", "start", "entry", "leaves"), "nodes")
    jump = nodes.select(F.col("path").alias("p"), F.col("entry").alias("from"), F.col("leaves").alias("to"))
    reached, known = nodes.where("entry = 0").select("path", "entry"), 0
    while (count := reached.count()) > known:
        known = count
        on = (F.col("path") == F.col("p")) & (F.col("entry") == F.col("from"))
        reached = materialise(reached.union(reached.join(jump, on).select("path", "to")).distinct(), "reached")
        later = jump.select(F.col("p").alias("q"), F.col("from").alias("mid"), F.col("to").alias("far"))
        on = (F.col("p") == F.col("q")) & (F.col("to") == F.col("mid"))
        jump = materialise(jump.join(later, on, "left").select("p", "from", F.coalesce("far", "to").alias("to")), "jumps")
    broken = archives.join(reached, (F.col("path") == F.col("p")) & (F.col("entry") == F.col("end")), "left_anti").take(1)
    if broken:
        raise EOFError(f"{broken[0].p} doesn't consist of whole WARC records")
    return nodes.join(reached, ["path", "entry"]).select("path", "size", "start", "entry")


def read_warc(spark: SparkSession, archives: DataFrame, split: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """The records of ``archives(path, size)``: path, offset and the fields of ``parsed``.

    A task scans byte ranges for gzip magic, takes what decodes to a WARC header for a candidate,
    and owns the records that start in its range, as ``entries`` finds them, so archives of any
    size are read in parallel and the same at every split. An archive that breaks off within a
    record, or a wrong digest, raises.
    """
    spans = entries(spark, archives, split)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, path = store(r["path"])
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for offset, content in members(file, r["size"], r["entry"], min(r["start"] + split, r["size"]), sure=True):
                        found = {"path": r["path"], "offset": offset, **parsed(content)}
                        if not with_payload:
                            del found["payload"]
                        rows.append(found)
                        held += len(content)
                        if held > BLOCK * 8:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    s, i = pa.string(), pa.int64()
    fields = [("path", s), ("offset", i), ("record_id", s), ("record_type", s), ("target_uri", s), ("payload_bytes", i), ("payload_digest", s), ("refers_to", s)]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)
    kinds = "path string, offset long, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spans.repartition(n, "path", "start").mapInArrow(run, kinds + ", payload binary" * with_payload)


def all_read(found: DataFrame, archives: DataFrame) -> DataFrame:
    """``found``, written; raises if an archive has another number of records than its manifest says."""
    found = materialise(found, "records")
    read = found.groupBy(F.col("path").alias("of")).agg(F.count("*").alias("n"))
    wrong = archives.join(read, archives.path == read.of, "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).select("path", "records", "n").take(1)
    if wrong:
        raise ValueError(f"{wrong[0].path} has {wrong[0].records} records, of which {wrong[0].n or 0} were read")
    return found


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back.

    Per page: key, payload_bytes, payload_digest, record_type, refers_to. Null payloads are
    empty; pages with equal payloads as ``with_record_type`` says; no pages give no rows.
    Raises unless as many records are read as were written.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    archives = write_warc(pages, new_path(spark, "warc"), key, uri, payload, least)
    found = all_read(read_warc(spark, archives), archives)
    return found.select(
        F.col("record_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
