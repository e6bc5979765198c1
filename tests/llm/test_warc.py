"""Archives are read back whole, whatever stands in the payloads and wherever files are split."""

import base64
import hashlib

import pytest

from kurvex.llm import warc

MAGIC = "WARC/1.0\r\n"
INNER = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:kurvex:page:99>\r\nContent-Length: 30\r\n\r\n" + "x" * 30 + "\r\n\r\n"
ROWS = [
    (0, "u", None), (1, None, ""), (2, "a\r\nb", "é" * 50), (3, "q", MAGIC * 30), (4, "r", INNER * 9), (5, "s", "z" + INNER + "y" * 3000 + INNER), (6, "t", "é" * 50),
    (7, "v", INNER[:-4]), (8, "w", "end\r\n" + INNER + MAGIC + "Content-Length: 99999999999\r\n\r\n"),
    *((i, f"u{i}", f"p{i % 10}" * i + (INNER if i % 7 == 0 else "")) for i in range(10, 40)),
]


@pytest.mark.parametrize(("split", "held"), [("128m", 8 << 20), ("1000", 8 << 20), ("700", 100)])
def test_round_trip(spark, tmp_path, monkeypatch, split, held):
    payload = {i: (h or "").encode() for i, _, h in ROWS}
    head = {p: max(i for i, q in payload.items() if q == p) for p in payload.values()}
    want = {(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if head[p] == i else "revisit", None if head[p] == i else head[p]) for i, p in payload.items()}
    monkeypatch.setattr(warc, "HELD_BYTES", held)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        warc.write_archives(spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2), f"file://{tmp_path}/a")
        got = warc.read_archives(spark, f"file://{tmp_path}/a")
        assert {tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()} == want
        assert got.where("payload_digest <> declared").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_archives_of_other_writers(spark, tmp_path):
    """Blocks without an HTTP header are payloads as a whole; revisits need no block; records may come in any order of fields."""

    def record(kind, block, *fields):
        return (MAGIC + "".join(f"{x}\r\n" for x in (*fields, f"WARC-Type: {kind}", f"Content-Length: {len(block)}")) + "\r\n" + block + "\r\n\r\n").encode()

    http = "Content-Type: application/http; msgtype=response"
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(b"".join([
        record("warcinfo", "software: x\r\n", "Content-Type: application/warc-fields"), record("metadata", "a: b\r\n"), record("revisit", "", "WARC-Payload-Digest: sha1:ABC"), record("revisit", "HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", http),
        record("revisit", "HTTP/1.1 304 Not Modified\r\n\r\n", http), record("response", "HTTP/1.1 200 OK\r\n\r\nbody", http), record("response", "no end of header", http), record("resource", "one\r\n\r\ntwo", "content-type: text/plain"), record("request", "GET / HTTP/1.1\r\n\r\n", http.replace("response", "request")),
    ]))
    sha = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    got = warc.read_archives(spark, f"file://{tmp_path}/b").select("record_type", "payload_bytes", "payload_digest", "page_id").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("warcinfo", 13, sha("software: x\r\n"), None), ("metadata", 6, sha("a: b\r\n"), None), ("revisit", None, "ABC", None), ("revisit", 77, None, None), ("revisit", None, None, None),
        ("response", 4, sha("body"), None), ("response", 0, sha(""), None), ("resource", 10, sha("one\r\n\r\ntwo"), None), ("request", 0, sha(""), None),
    ], key=repr)


def test_no_pages(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0
