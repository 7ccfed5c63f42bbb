"""WARC archives: writing, and normalising files that were compressed as one whole stream.

`write_archives` writes records into files of one gzip stream each, as some crawlers leave them. Such a file can only
be read from its start. `normalise` inflates each file once, from first to last byte and without holding it, rewrites
every record as a gzip member of its own, and writes a sidecar file with each record's offset. `read_records` then
reads any record alone, by offset.

Tasks write to the shared folder through the file system that its address names, under names that no other attempt
uses; only names that a finished task returned are read, so a lost executor or a repeated task leaves at most a file
that nobody reads.

Null html is an empty payload, a null url or page id leaves its header out. Payloads of any length are written whole.
Of records with equal payloads of at least `least` bytes those with the largest page id are responses (several, if
rows repeat), the others revisit it. A null id counts as smaller than any other; if no id is known, all are
responses. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, fresh_path

LEAST = 1000
ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to long"


def decide(pages: DataFrame, least: int = LEAST, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to for every page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("payload_digest"))
    last = (rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1").drop("_n"))
    revisit = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return (rows.join(last, "payload_digest", "left")
            .select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("_last")).alias("refers_to")))


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Bytes: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[:int(fields["content-length"])]


def _open(address: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(address)


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        out, done, name, n, size, press = None, [], "", 0, 0, None

        def close() -> None:
            out.write(press.flush())
            out.close()
            done.append((f"{folder}/{name}", n))
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")]
            for r in range(batch.num_rows):
                if out is None:
                    name, n, size, press = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(4, zlib.DEFLATED, 31)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                raw = record(*[c[r].as_py() for c in columns])
                out.write(press.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= ROLL_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["archive", "records"])
    return run


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Write the records; (archive, records) for each file."""
    return cut_lineage(decided.select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to").mapInArrow(_write(folder), "archive string, records long"))


def records_of(stream) -> Iterator[bytes]:
    """The records of a gzip file, inflated piece by piece; it may be one stream or many members."""
    inflate, held, need = zlib.decompressobj(31), bytearray(), -1
    while raw := stream.read(READ_BYTES):
        while raw:
            held += inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            at = 0
            while True:
                if need < 0:
                    end = held.find(b"\r\n\r\n", at)
                    if end < 0:
                        break
                    length = next(x for x in bytes(held[at:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    need = end - at + 4 + int(length.split(b":")[1]) + 4
                if len(held) - at < need:
                    break
                yield bytes(held[at:at + need])
                at, need = at + need, -1
            del held[:at]
    if held:
        raise ValueError("the archive ends inside a record")


def _entry(raw: bytes) -> tuple:
    fields, _ = parse(raw)
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (fields["warc-type"], None if page is None else int(page), int(fields["x-payload-bytes"]), fields["warc-payload-digest"].removeprefix("sha1:"),
            None if refers is None else int(refers))


_INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        for batch in batches:
            for address in batch.column(0).to_pylist():
                source, old = _open(address)
                name, offset, rows = f"{os.path.basename(old).split('.')[0]}-{uuid.uuid4().hex[:12]}", 0, []
                with source.open_input_stream(old, compression=None) as stream, files.open_output_stream(f"{path}/{name}.warc.gz", compression=None) as out:
                    for raw in records_of(stream):
                        press = zlib.compressobj(4, zlib.DEFLATED, 31)
                        member = press.compress(raw) + press.flush()
                        out.write(member)
                        rows.append((f"{folder}/{name}.warc.gz", offset, len(member), *_entry(raw)))
                        offset += len(member)
                with files.open_output_stream(f"{path}/{name}.index.jsonl", compression=None) as out:
                    out.write("".join(json.dumps(dict(zip(_INDEX_SCHEMA.names, x))) + "\n" for x in rows).encode())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(_INDEX_SCHEMA)], schema=_INDEX_SCHEMA)
    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive record by record; the offset index of all records, one row each."""
    dealt = archives.select("archive").repartition(max(1, archives.count()))
    return cut_lineage(dealt.mapInArrow(_normalise(folder), INDEX))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, stream = None, None
    for batch in batches:
        out = []
        for address, offset, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if address != at:
                files, path = _open(address)
                at, stream = address, files.open_input_file(path)
            stream.seek(offset)
            fields, payload = parse(zlib.decompress(stream.read(length), 31))
            kind, page, size, digest, refers = _entry(b"WARC\r\n" + "\r\n".join(f"{k}: {v}" for k, v in fields.items()).encode() + b"\r\n\r\n")
            if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"record at {offset} of {address} does not match its digest")
            out.append((page, size, digest, kind, refers, fields.get("warc-target-uri"), payload))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)],
                                         names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_records(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """Read each indexed record alone and check its payload against its digest; records are dealt out by place."""
    places = index.select("archive", "offset", "length")
    if tasks:
        places = places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return places.mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Write the pages' archives, normalise them and read them back: (records, index)."""
    spark = pages.sparkSession
    archives = write_archives(decide(pages, least), fresh_path(spark, "warc-whole"))
    index = normalise(archives, fresh_path(spark, "warc-members"))
    return read_records(index, max(1, archives.count())), index
