"""Writing fetched bodies to WARC archives and reading archives back in byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribble.llm.shared import NULL_ID, settle
from cribble.sources.tables import scratch_path

MIN_REVISIT = 0
ARCHIVE_BYTES = 1 << 28
SPLIT_BYTES = 1 << 22
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 18


def record_of(item: int, url: str | None, body: bytes, refers_to: int | None) -> bytes:
    """One record. A revisit has the response's head, with the length of the full body, alone."""
    import base64
    import hashlib

    name = lambda i: f"<urn:item:{'' if i == NULL_ID else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http + body if refers_to is None else http
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {name(item)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writing(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        from uuid import uuid4

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size = None, "", 0

        def entry() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["archive", "n_bytes"])

        for batch in batches:
            items, refers = batch.column("id").to_pylist(), batch.column("refers_to").to_pylist()
            urls, bodies = batch.column("url"), batch.column("body").cast(pa.binary())
            for k, (item, refers_to) in enumerate(zip(items, refers)):
                if out is None:
                    # A repeated task writes files of its own; only the committed list is read.
                    name, size = f"{uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record_of(item, urls[k].as_py(), bodies[k].as_py(), refers_to), 6, mtime=0)
                out.write(member)
                size += len(member)
                if size >= archive_bytes:
                    yield entry()
                    out = None
        if out is not None:
            yield entry()

    return run


def write_archives(items: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every item's body as a WARC record; gives the list ``archive, n_bytes`` of files.

    ``items``: ``id, url, body`` (text; null is empty); other columns are
    ignored. Of items with equal bodies of ``min_revisit`` bytes or more, the one
    with the largest id is stored as a response and the others as revisits that
    refer to it. Rows that share that id are all responses; a null id is the
    smallest. Every record is a gzip member of its own. Archives lie in the
    shared scratch folder; the list is settled, so reading never writes again.
    """
    rows = items.select(F.coalesce(F.col("id").cast("bigint"), F.lit(NULL_ID)).alias("id"), "url",
                        F.coalesce("body", F.lit("")).alias("body"))
    rows = rows.withColumn("print", F.unhex(F.sha2("body", 256)))
    prints = settle(rows.where(F.octet_length("body") >= min_revisit).select("id", "print"), "prints")
    holders = prints.groupBy("print").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Prints and ids only: a print that a third of the items share is split by AQE here,
    # and the bodies are joined by id, which is even.
    revisits = settle(prints.join(holders, "print").where("id <> refers_to").select("id", "print", "refers_to").distinct(), "revisits")
    folder = scratch_path(items.sparkSession, "archives")
    marked = rows.join(revisits, ["id", "print"], "left").select("id", "url", "body", "refers_to")
    listed = settle(marked.mapInArrow(_writing(folder, archive_bytes), "archive string, n_bytes bigint"), "archives_list")
    return listed.select(F.concat(F.lit(folder + "/"), "archive").alias("archive"), "n_bytes")


def members(source, start: int, end: int) -> Iterator[bytes]:
    """Records whose gzip member starts in ``[start, end)``.

    A place with the gzip magic is tried: what it decodes to has to begin as a
    WARC record does, and the whole member has to end with its checksum.
    """
    import zlib

    source.seek(start)
    held, base, at = b"", start, start

    def more() -> bool:
        nonlocal held
        block = source.read(BLOCK)
        held += block
        return bool(block)

    while at < end:
        found = held.find(MAGIC, at - base)
        if found < 0:
            keep = max(at - base, len(held) - 2)
            held, base = held[keep:], base + keep
            at = base
            if not more():
                return
            continue
        held, base = held[found:], base + found
        at = base
        if at >= end:
            return
        machine, parts, fed = zlib.decompressobj(31), [], 0
        good = True
        while good and not machine.eof:
            if fed == len(held) and not more():
                good = False
                break
            try:
                parts.append(machine.decompress(held[fed:]) if fed else machine.decompress(held, 64))
                if machine.unconsumed_tail:
                    # The first bytes decide whether the rest is decoded.
                    good = parts[0].startswith(b"WARC/1.")
                    parts.append(machine.decompress(machine.unconsumed_tail) if good else b"")
            except zlib.error:
                good = False
            fed = len(held)
        if good and b"".join(parts[:2]).startswith(b"WARC/1."):
            used = len(held) - len(machine.unused_data)
            held, base = held[used:], base + used
            at = base
            yield b"".join(parts)
        else:
            at = base + 1


def parsed(record: bytes) -> dict:
    """Fields of a record; digest and length of a response are those of the body that was read."""
    import base64
    import hashlib

    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    item = lambda x: int(x[10:-1]) if x and len(x) > 11 else None  # noqa: E731  <urn:item:N>
    http, _, body = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    if fields["warc-type"] == "response":
        n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    else:
        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest, body = fields["warc-payload-digest"].partition(":")[2], None
    return {"id": item(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": item(fields.get("warc-refers-to")), "payload_bytes": n, "payload_digest": digest, "body": body}


RECORD = "id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _reading(with_body: bool):
    names = [x.split()[0] for x in RECORD.split(", ")] + ["body"] * with_body
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def packed(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for archive, start, end in zip(*(batch.column(x).to_pylist() for x in ("archive", "start", "end"))):
                store, path = fs.FileSystem.from_uri(archive)
                rows, size = [], 0
                with store.open_input_file(path) as source:
                    for record in members(source, start, end):
                        rows.append(parsed(record))
                        size += len(record) if with_body else 256
                        if size > BLOCK * 16:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_body: bool = False) -> DataFrame:
    """Read the records of archives, each file by several tasks.

    ``archives``: ``archive`` (path), ``n_bytes``. A file is cut into ranges of
    ``split_bytes``; a task owns the records that start in its range and reads
    past its end to finish the last one, so each record is read once.

    Returns one row per record: ``id, url, record_type, refers_to,
    payload_bytes, payload_digest`` (base32 SHA-1) and, on request, ``body``
    (null for a revisit). An empty list gives no rows.
    """
    last = F.greatest(F.lit(0), F.col("n_bytes") - 1)
    ranges = archives.select("archive", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(split_bytes).cast("bigint"))).alias("start"))
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.select("archive", "start", (F.col("start") + split_bytes).alias("end")).repartition(parts)
    return ranges.mapInArrow(_reading(with_body), RECORD + (", body binary" if with_body else ""))
