from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

from lodestone.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, _of string"


def pages():
    rng = random.Random(7)
    out = [(k, f"https://h/{k}", "".join(rng.choices("abc <>é", k=rng.randint(0, 4000))), "d", "o") for k in range(120)]
    out += [(200 + k, "https://h/x", "the same", "d", "o") for k in range(40)]
    out += [(300, None, None, None, None), (301, "u\r\nWARC-Type: x", "", "d", "o"), (None, "n", "the same", "d", "o"), (None, "n", "alone", "d", "o")]
    return out + [(239, "again", "the same", "d", "o"), (400, "long", "z" * 3_000_000, "d", "o")]


def want(rows, least=0):
    owner = {}
    for k, _, html, *_ in rows:
        if k is not None and len((html or "").encode()) >= least:
            owner[html or ""] = max(owner.get(html or "", k), k)
    for k, _, html, *_ in rows:
        data = (html or "").encode()
        first = owner.get(html or "") if len(data) >= least else k
        same = k == first
        yield k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if same else "revisit", None if same else first


def test_round_trip(spark):
    frame = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    for least in (0, 6, 100):
        found = Counter(map(tuple, warc.round_trip(frame, least=least).collect()))
        assert found == Counter(want(pages(), least))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_split_size_finds_each_record_once():
    rng = random.Random(3)
    contents = [warc.record(k, "u", rng.randbytes(rng.randint(0, 900)), 1, "d", None, False) for k in range(30)]
    contents[7] = warc.record(7, "u", gzip.compress(b"WARC/1.0 not a record") + warc.MAGIC * 5, 1, "d", None, False)
    data = b"".join(gzip.compress(c, rng.choice([0, 6])) for c in contents)
    for split in (1, 7, 100, 1000, len(data)):
        found = []
        for start in range(0, len(data), split):
            with io.BytesIO(data) as raw:
                file = type("F", (), {"read_at": lambda self, n, at, raw=raw: (raw.seek(at), raw.read(n))[1]})()
                found += [c for _, c in warc.members(file, len(data), start, min(start + split, len(data)))]
        assert found == contents


def test_payloads_and_headers_come_back(spark, tmp_path):
    frame = spark.createDataFrame(pages(), SCHEMA)
    archives = warc.write_warc(frame, f"file://{tmp_path}")
    found = warc.read_warc(spark, archives, split=5000, with_payload=True).where("record_type = 'response'").collect()
    texts = {str(k): html for k, _, html, *_ in pages()}
    assert all(bytes(r.payload).decode() == (texts[r.record_id] or "") for r in found if r.record_id)
    assert {r.target_uri for r in found if r.record_id == "301"} <= {"u%0D%0AWARC-Type:%20x"}
