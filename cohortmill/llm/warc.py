"""WARC archives: one gzip member per record, read back sequentially with every digest verified.

An archive is the byte content of a .warc.gz file. Archives are rows of a table (archive, part, content),
so that any store that Spark writes to can hold them; read_files() takes .warc.gz files as well.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.session import stored_bytes, written

#: Up to so many bytes of files the table of payloads that recur is broadcast.
BROADCAST_BYTES = 8 * 1024 * 1024
EOL = b"\r\n"
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _b32(sha1: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(sha1)


def record(name: str, uri: str | None, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to else head + payload
    fields = [(b"WARC-Type", b"revisit" if refers_to else b"response"), (b"WARC-Record-ID", b"<%s>" % name.encode()), (b"WARC-Date", b"1970-01-01T00:00:00Z")]
    if uri is not None:
        fields.append((b"WARC-Target-URI", quote(uri, safe=":/?#[]@!$&'()*+,;=%~-._").encode()))
    if refers_to:
        fields += [(b"WARC-Refers-To", b"<%s>" % refers_to.encode()), (b"WARC-Profile", REVISIT)]
    fields += [(b"WARC-Payload-Digest", _b32(digest)), (b"WARC-Block-Digest", _b32(hashlib.sha1(block).digest())), (b"Content-Type", b"application/http; msgtype=response"), (b"Content-Length", b"%d" % len(block))]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = b"WARC/1.1" + EOL + b"".join(k + b": " + v + EOL for k, v in fields) + EOL
    return packer.compress(text) + packer.compress(block) + packer.compress(EOL + EOL) + packer.flush()


def written_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, archive_bytes: int = 16 << 20) -> DataFrame:
    """(archive string, part int, content binary): the archives' bytes, a record per row of pages.

    Of rows with equal payloads of at least `least` bytes that with the largest id is the response and the
    others revisit it; all others are responses. Equal payloads are found by SHA-1 and length in an
    aggregation that combines before the shuffle, of digests and ids alone. The table of those that recur is written;
    where its files are small, which is looked up, it is broadcast, so that no payload is shuffled, else payloads of at
    least `least` bytes meet it in a join and the smaller ones stay where they are. Null payloads are empty; rows with a null id are
    written under the id `none`, as responses where nothing larger has their payload; repeated rows (same
    id and payload) give a record each, of the same kind; null urls have no target URI.
    """
    body = F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("body"))
    rows = rows.withColumns({"sha": F.sha1(F.col("body").cast("binary")), "size": F.octet_length("body")})
    again = rows.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    again, path = written(again.select("sha", "size", "first"), "payloads")
    if stored_bytes(pages.sparkSession, path) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(again), ["sha", "size"], "left")
    else:
        small = rows.where(F.col("size") < least).withColumn("first", F.lit(None).cast("long"))
        rows = rows.where(F.col("size") >= least).join(again.hint("merge"), ["sha", "size"], "left").unionByName(small)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size, part, name = [], 0, 0, None
        for pdf in batches:
            for i, url, text, sha, first in zip(pdf["id"], pdf["url"], pdf["body"], pdf["sha"], pdf["first"], strict=True):
                own = "none" if pd.isna(i) else str(int(i))
                name = name or f"pages-{own}-{sha[:12]}"
                refers = None if pd.isna(first) or (not pd.isna(i) and int(first) == int(i)) else f"urn:page:{int(first)}"
                out.append(record(f"urn:page:{own}", url, text.encode(), bytes.fromhex(sha), refers))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pd.DataFrame({"archive": [name], "part": [part], "content": [b"".join(out)]})
                    out, size, part = [], 0, part + 1
        if out:
            yield pd.DataFrame({"archive": [name], "part": [part], "content": [b"".join(out)]})

    return rows.select("id", "url", "body", "sha", "first").mapInPandas(run, "archive string, part int, content binary")


class _Stream:
    """Bytes of the gzip members of some chunks, inflated only as far as they are asked for."""

    def __init__(self, chunks: Iterable[bytes], step: int = 1 << 16):
        self.steps = (memoryview(c)[a : a + step] for c in chunks for a in range(0, len(c), step))
        self.waiting, self.ready, self.member = b"", bytearray(), None

    def _more(self) -> bool:
        """Inflate one more step of the member; false at its end."""
        while not self.waiting:
            nxt = next(self.steps, None)
            if nxt is None:
                raise ValueError("a gzip member ends early")
            self.waiting = bytes(nxt)
        self.ready += self.member.decompress(self.waiting, 1 << 18)
        if self.member.eof:
            self.waiting = self.member.unused_data
            return False
        self.waiting = self.member.unconsumed_tail
        return True

    def open(self) -> bool:
        """Begin the next member, if there is one."""
        while not self.waiting:
            nxt = next(self.steps, None)
            if nxt is None:
                return False
            self.waiting = bytes(nxt)
        self.member, self.ready = zlib.decompressobj(31), bytearray()
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.ready.find(mark, start)) < 0:
            start = max(0, len(self.ready) - len(mark))
            if self.member.eof or not self._more() and self.ready.find(mark, start) < 0:
                raise ValueError("a record has no end of its head")
        out = bytes(self.ready[: at + len(mark)])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if self.member.eof or not self._more() and len(self.ready) < n:
                raise ValueError("a record is shorter than its Content-Length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def close(self) -> None:
        while not self.member.eof:
            self._more()
        if bytes(self.ready) != EOL + EOL:
            raise ValueError("a record doesn't end after its Content-Length")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def records(chunks: Iterable[bytes]) -> Iterator[tuple]:
    """The records of one archive in order: framed by Content-Length, block and payload digests verified."""
    stream = _Stream(chunks)
    while stream.open():
        head = stream.until(EOL + EOL)
        if not head.startswith(b"WARC/1."):
            raise ValueError("no WARC record")
        f = _fields(head)
        block = stream.take(int(f["content-length"]))
        stream.close()
        if "warc-block-digest" in f and f["warc-block-digest"].encode() != _b32(hashlib.sha1(block).digest()):
            raise ValueError(f"block digest of {f.get('warc-record-id')} is wrong")
        http, _, payload = block.partition(EOL + EOL) if f.get("content-type", "").startswith("application/http") else (b"", b"", block)
        kind, stated, size = f["warc-type"], f.get("warc-payload-digest"), len(payload)
        if kind == "revisit":
            size, payload = int(_fields(http)["content-length"]), None
        elif stated and stated.encode() != _b32(hashlib.sha1(payload).digest()):
            raise ValueError(f"payload digest of {f.get('warc-record-id')} is wrong")
        hexed = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated else hashlib.sha1(payload or b"").hexdigest()
        strip = lambda x: x.strip("<>") if x else None
        yield strip(f.get("warc-record-id")), kind, f.get("warc-target-uri"), strip(f.get("warc-refers-to")), hexed, size, payload


def _read(contents: DataFrame, payloads: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ.split(", ")]
        for pdf in batches:
            for content in pdf["content"].dropna():
                rows, held = [], 0
                for r in records([content]):
                    rows.append(r if payloads else (*r[:6], None))
                    held += len(r[6] or b"") * payloads + 200
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return contents.select("content").mapInPandas(run, READ)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives(content): id, type, URI, what it refers to, payload digest (hex), size, payload.

    Each content holds whole members, as the writer cuts only between records. A broken member, a length or
    a digest that doesn't hold raises ValueError. payload_bytes is that of the full payload for revisits too. Null and
    empty contents hold no records, an empty table gives an empty one, repeated contents give their records again;
    other columns are not read. A content is inflated in steps; a record of any length takes memory for itself.
    """
    return _read(archives, payloads)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of .warc.gz files under path, a file a row of Spark's binaryFile source; as read_archives()."""
    return _read(spark.read.format("binaryFile").load(path), payloads)
