"""WARC archives: written with payload-digest revisits, read back by boundary-chain verification.

Reading splits the files at every occurrence of the magic line, also inside payloads.  Each task
turns every occurrence into a candidate record with the offset of its successor (from its
Content-Length) and follows those links inside its split, so that per split only chain entries and
exits are left.  Pointer jumping over these from offset 0 of each file keeps the reachable records
and rejects magic inside payloads.  Records that run past their split are re-read by byte range.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_KEYS, small_batches, store, tidy

MAGIC = b"WARC/1.0\r\n"
#: Bytes of one candidate held while its end isn't reached; beyond it the record is re-read by range if it is reachable.
HELD_BYTES = 8 << 20
_PREFIX = "urn:kurvex:page:"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column, with built-in functions only."""
    digest = F.sha1(payload)
    chars = []
    for k in range(8):  # 5 hex digits are 20 bits are 4 letters
        v = F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*chars)


def write_archives(pages: DataFrame, path: str, min_payload: int = 0) -> None:
    """Writes one record per row of ``pages`` (page_id, url, html): uncompressed WARC, one archive per output file.

    Of equal payloads of at least ``min_payload`` bytes the largest page_id is the response and the
    others revisit it.  Null html is an empty payload, a null url is left out; a null page_id is
    written as ``null`` and is smaller than every other.  Rows of one page_id and payload are all responses.
    """
    p = pages.selectExpr("cast(page_id as long) page_id", "regexp_replace(cast(url as string), '[\\r\\n]', '') url", "coalesce(cast(html as string), '') body")
    p = p.withColumn("size", F.octet_length("body").cast("long")).withColumn("digest", base32_sha1(F.col("body").cast("binary")))
    heads = p.where(F.col("size") >= min_payload).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "head")
    heads = store(heads, "heads")
    if heads.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        heads = F.broadcast(heads)
    p = p.join(heads, "digest", "left")
    revisit = F.col("head").isNotNull() & (F.col("size") >= min_payload) & ~F.col("page_id").eqNullSafe(F.col("head"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{_PREFIX}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("head"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    p.select(F.concat(head, http, body, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").text(path)


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def _field(head: bytes, name: str) -> str | None:
    m = re.search(rb"^" + name.encode() + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.I | re.M)
    return m[1].decode("utf-8", "replace") if m else None


def _header(segment: bytes) -> tuple[int, int] | None:
    """(bytes of the header, content length) of what follows the magic, None if it is no record."""
    at = segment.find(b"\r\n\r\n")
    if at < 0 or not (m := _LENGTH.search(segment, 0, at)):
        return None
    return at + 4, int(m[1])


def _page(urn: str | None) -> int | None:
    m = re.search(rf"{_PREFIX}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _record(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, declared digest, record_type, refers_to of a whole record after its magic.

    Only a block of type ``application/http`` starts with an HTTP header, which ends at its first empty line (without one the
    whole block is header); the payload of other blocks is the block.
    """
    at, length = _header(raw)
    head, block = raw[:at], raw[at : at + length]
    kind = _field(head, "WARC-Type")
    cut = 0
    if (_field(head, "Content-Type") or "").lower().startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        cut = len(block) if end < 0 else end + 4
    payload, declared = block[cut:], (_field(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    if kind == "revisit":  # the HTTP header that is kept tells the full payload's length; without one it isn't known
        told = _LENGTH.search(block[:cut])
        size, digest = int(told[1]) if told else None, declared or None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _page(_field(head, "WARC-Record-ID")), size, digest, declared, kind, _page(_field(head, "WARC-Refers-To"))


_RECORD = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("declared", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_OUT = [("file", pa.string()), ("split", pa.int64()), ("kind", pa.string()), ("root", pa.int64()), ("at", pa.int64()), ("next", pa.int64()), *_RECORD]
_SQL = {pa.int64(): "long", pa.string(): "string"}
_SCHEMA = ", ".join(f"{n} {_SQL[t]}" for n, t in _OUT)


class _Split:
    """Candidates, chains and finished records of one split, fed with its segments in order."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.pos, self.first = file, start, 0, start == 0
        self.rows: list[tuple] = []
        self.pending: dict[int, list[int]] = {}  # successor offset -> roots that lead there
        self.open: list[tuple[int, int, int, int]] = []  # (offset, end, root, index of its first segment)
        self.held: list[bytes] = []
        self.held_size = 0

    def row(self, kind: str, root: int, at: int, nxt: int, record: tuple = (None,) * 6) -> None:
        self.rows.append((self.file, self.start, kind, root, at, nxt, *record))

    def feed(self, segment: bytes) -> None:
        if self.first:  # what stands before the file's first magic
            self.first, self.pos = False, self.pos + len(segment)
            return
        at, end_of_segment = self.pos, self.pos + len(MAGIC) + len(segment)
        if found := _header(segment):
            roots = self.pending.pop(at, [])
            root = roots[0] if len(roots) == 1 else at
            for r in roots if len(roots) > 1 else []:
                self.row("chain", r, r, at)
            nxt = at + len(MAGIC) + sum(found) + 4
            self.pending.setdefault(nxt, []).append(root)
            if nxt <= end_of_segment:
                self.row("record", root, at, nxt, _record(segment))
            else:
                self.open.append((at, nxt, root, len(self.held)))
        if self.open:
            self.held.append(segment)
            self.held_size += len(segment)
            left = []
            for x in self.open:
                if x[1] <= end_of_segment:
                    self.row("record", x[2], x[0], x[1], _record(MAGIC.join(self.held[x[3] :])))
                elif self.held_size > HELD_BYTES:
                    self.row("open", x[2], x[0], x[1])
                else:
                    left.append(x)
            self.open = left
            if not left:
                self.held, self.held_size = [], 0
        self.pos = end_of_segment

    def close(self) -> list[tuple]:
        for at, nxt, root, _ in self.open:
            self.row("open", root, at, nxt)
        for nxt, roots in self.pending.items():
            for r in roots:
                self.row("chain", r, r, nxt)
        self.row("split", -1, -1, self.pos)
        return self.rows


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _OUT, strict=True)], [n for n, _ in _OUT])


@tidy
def _scan(batches):
    now: _Split | None = None
    for b in batches:
        for file, start, segment in zip(b.column(0), b.column(1), b.column(2), strict=True):
            key = (file.as_py(), start.as_py())
            if now is None or (now.file, now.start) != key:
                if now and (rows := now.close()):
                    yield _rows(rows)
                now = _Split(*key)
            now.feed(segment.as_py())
        if now and now.rows:
            yield _rows(now.rows)
            now.rows = []
    if now and (rows := now.close()):
        yield _rows(rows)


@tidy
def _offsets(batches):
    """(file, split, offset in the split, bytes with their magic) of every segment."""
    key, pos = None, 0
    for b in batches:
        out = []
        for file, start, segment in zip(b.column(0), b.column(1), b.column(2), strict=True):
            if key != (file.as_py(), start.as_py()):
                key, pos = (file.as_py(), start.as_py()), 0
                first = key[1] == 0
            raw = segment.as_py()
            raw = raw if first else MAGIC + raw
            out.append((*key, pos, raw))
            pos, first = pos + len(raw), False
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["file", "split", "at", "raw"])


def _assembled(pdf: pd.DataFrame) -> pd.DataFrame:
    raw = b"".join(pdf.sort_values("at")["raw"])[len(MAGIC) :]
    return pd.DataFrame([_record(raw)], columns=[n for n, _ in _RECORD])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of the archives under ``path``: page_id, payload_bytes, payload_digest, declared, record_type, refers_to.

    Uncompressed WARC 1.0 with a Content-Length in every record.  Records of other writers are read too: of types other than
    response and revisit as they are, without a page_id where the id is not one of ``write_archives``; a revisit that keeps
    no HTTP header has no payload_bytes, one that declares no digest no payload_digest.  What stands before a
    file's first record, and magic that no chain from the first record reaches, is passed over; an empty folder gives no rows.
    """
    small_batches(spark)
    text = spark.read.option("lineSep", MAGIC.decode()).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    found = store(text.mapInArrow(_scan, _SCHEMA), "candidates")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = store(found.where("kind = 'split'").select("file", "split", F.coalesce(F.sum("next").over(before), F.lit(0)).alias("base")), "splits")
    chains = found.where("kind = 'chain'").join(base, ["file", "split"]).select("file", (F.col("root") + F.col("base")).alias("node"), (F.col("next") + F.col("base")).alias("entry"))
    placed = found.where("kind in ('record', 'open')").join(base, ["file", "split"])
    placed = placed.select("file", (F.col("at") + F.col("base")).alias("entry"), (F.col("root") + F.col("base")).alias("to"))
    pointers = store(chains.join(placed, ["file", "entry"]).select("file", "node", "to", "entry"), "pointers")
    reached = placed.where("entry = 0").select("file", F.col("to").alias("node"), "entry")
    count, size = -1, 0
    while size != count and not pointers.isEmpty():  # each round doubles the reach
        count = size
        reached = store(reached.union(pointers.join(reached.select("file", "node"), ["file", "node"]).select("file", "to", "entry")).distinct(), "reached")
        size = reached.count()
        onward = pointers.toDF("file", "to", "jump", "jump_entry")
        pointers = store(pointers.join(onward, ["file", "to"]).select("file", "node", F.col("jump").alias("to"), F.col("jump_entry").alias("entry")), "pointers")
    live = reached.toDF("file", "node", "entry").join(base, "file").where("node >= base").groupBy("file", "node", "entry").agg(F.max_by("split", "base").alias("split"), F.max("base").alias("base"))
    live = live.select("file", "split", (F.col("node") - F.col("base")).alias("root"), (F.col("entry") - F.col("base")).alias("entry"))
    names = [n for n, _ in _RECORD]
    good = found.join(live, ["file", "split", "root"]).where("at >= entry")
    records = good.where("kind = 'record'").select(*names)
    long = good.where("kind = 'open'").join(base, ["file", "split"]).select("file", (F.col("at") + F.col("base")).alias("lo"), (F.col("next") + F.col("base")).alias("hi"))
    if not long.isEmpty():
        long = store(long, "long")
        parts = text.join(long.select("file").distinct().hint("broadcast") if long.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else long.select("file").distinct(), "file", "left_semi")
        parts = parts.mapInArrow(_offsets, "file string, split long, at long, raw binary").join(base, ["file", "split"]).select("file", "split", (F.col("at") + F.col("base")).alias("at"), "raw")
        # A split has one long record that runs past its end and few that were given up for their size, so a segment meets few.
        ends = base.select("file", "split", "base", F.lead("base").over(Window.partitionBy("file").orderBy("split")).alias("end"))
        spans = long.join(ends, "file").where("lo < coalesce(end, hi) and hi > base").select("file", "split", "lo", "hi")
        parts = parts.join(spans, ["file", "split"]).where("at >= lo and at < hi")
        records = records.union(parts.groupBy("file", "lo").applyInPandas(_assembled, ", ".join(f"{n} {_SQL[t]}" for n, t in _RECORD)))
    return records
