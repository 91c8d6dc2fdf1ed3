"""Legacy archive conversion: ARC files (versions 1 and 2) become WARC files.

``write_arc`` makes the legacy archives, ``convert`` turns them into WARC, ``read_warc`` reads these. An ARC record is a
header line of 5 (version 1) or 10 fields (version 2) and a body of the declared length; the version
block at the start of the file says which. The converter synthesises what ARC lacks: record ids, ISO
timestamps, record types, payload and block digests, and revisits.

Equal payloads of at least ``LEAST`` bytes are stored once. An index of the ARC files (path, offset, digest,
page) is taken first; of pages with one digest that with the largest page_id is the response. The index
carries no payload, so a payload that a third of all pages share costs one small row each. Payloads are
never shuffled: each task reads an archive and writes one. Archives roll at ``ROLL`` bytes of content.

Files go to the folder all executors share, through pyarrow's file systems, under names that are new for each
attempt; only the paths that the committed rows name are read, so lost or repeated tasks do no harm.

Defined results: NULL html is an empty payload; a NULL or odd url becomes percent-encoded or ``urn:page:none``;
a NULL page_id gets a record id from its place and is always a response; all rows of the largest page_id with
one payload are responses, so repeated rows give repeated records; an empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored, utf8
from panelwise.session import ensure_checkpoint_dir

LEAST = 1000
ROLL = 16 << 20
DATE = "20010203040506"
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
INDEX = "path string, offset long, page_id long, payload_bytes long, digest string"
RECORD = "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"
PAGE = re.compile(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n")
LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")


def shared_folder(df: DataFrame) -> str:
    """A new folder below the checkpoint folder, as a URI pyarrow takes."""
    at = f"{ensure_checkpoint_dir(df.sparkSession)}/archives-{uuid.uuid4().hex}"
    return re.sub(r"^file:/+", "file:///", at)


def put(folder: str, name: str, data: bytes) -> str:
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def fetch(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        return file.read()


def unzip(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ARC


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 panelwise\n{' '.join(FIELDS[version])}\n".encode()
    fields = ["filedesc://" + name, "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, name: str, offset: int, url: str | None, page_id: int | None, payload: bytes, date: str) -> bytes:
    mark = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    body = b"HTTP/1.1 200 OK\r\n" + mark + b"Content-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:page:none"
    fields = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        fields += ["200", hashlib.md5(payload).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, body) of each record, the version block included."""
    at, version = 0, 1
    while at < len(data):
        line = data.index(b"\n", at)
        values = data[at:line].decode().split(" ")
        if at == 0:
            version = int(data[line + 1:data.index(b" ", line + 1)])
        fields = dict(zip(FIELDS[version], values))
        if len(values) != len(FIELDS[version]):
            raise ValueError(f"header line at {at} has {len(values)} fields")
        stop = line + 1 + int(fields["Archive-length"])
        if data[stop:stop + 1] != b"\n":
            raise ValueError(f"record at {at} does not have its declared length")
        yield at, fields, data[line + 1:stop]
        at = stop + 1


def write_arc(pages: DataFrame, date: str = DATE, roll: int = ROLL) -> DataFrame:
    """(path, records) of the archives written; every other archive of a task is version 2."""
    folder = shared_folder(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, version, name, parts, size, n = [], 1, f"{uuid.uuid4().hex}.arc.gz", [], 0, 0

        def close() -> None:
            if n:
                made.append((put(folder, name, gzip(b"".join([arc_head(version, name, date), *parts]))), n))

        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2))):
                part = arc_record(version, name, size, url, page_id, html or b"", date)
                parts.append(part)
                size, n = size + len(part), n + 1
                if size >= roll:
                    close()
                    version, name, parts, size, n = 3 - version, f"{uuid.uuid4().hex}.arc.gz", [], 0, 0
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64()))], ["path", "records"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(rows.mapInArrow(run, "path string, records long"))


def split_http(body: bytes) -> tuple[bytes, bytes]:
    cut = body.find(b"\r\n\r\n") + 4
    return (body[:cut], body[cut:]) if body.startswith(b"HTTP/") and cut > 3 else (b"", body)


def page_of(head: bytes) -> int | None:
    found = PAGE.search(head)
    return int(found[1]) if found else None


def each_archive(archives: DataFrame) -> DataFrame:
    """``archives`` dealt so that a task has few of them."""
    n = archives.count()
    cores = archives.sparkSession.sparkContext.defaultParallelism
    return archives.repartition(max(1, min(n, 4 * cores), n // 16))


def arc_index(archives: DataFrame) -> DataFrame:
    """INDEX of the records in ``archives``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for offset, fields, body in arc_records(unzip(fetch(path))):
                    if not fields["URL"].startswith("filedesc:"):
                        head, payload = split_http(body)
                        rows.append((path, offset, page_of(head), len(payload), hashlib.sha1(payload).hexdigest()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)],
                                                 ["path", "offset", "page_id", "payload_bytes", "digest"])

    return stored(each_archive(archives.select("path")).mapInArrow(run, INDEX))


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """(path, revisits: array<struct<offset, refers_to>>): a row for each archive that has revisits."""
    groups = index.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"))
    groups = groups.where("low < refers_to").select("digest", "refers_to")
    found = index.join(groups, "digest").where("page_id < refers_to")
    return found.groupBy("path").agg(F.collect_list(F.struct("offset", "refers_to")).alias("revisits"))


# WARC


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, place: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<{uuid.uuid5(uuid.NAMESPACE_URL, place).urn}>"


def warc_record(fields: dict[str, str], body: bytes, refers_to: int | None, place: str) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` makes it a revisit."""
    d = fields["Archive-date"].ljust(14, "0")
    when = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    head, payload = split_http(body)
    page = page_of(head)
    lines = {"WARC-Record-ID": record_id(page, place), "WARC-Date": when}
    if fields["URL"].startswith("filedesc:"):
        kind, block = "warcinfo", b"software: panelwise\r\nformat: WARC File Format 1.1\r\n"
        lines |= {"WARC-Filename": fields["URL"].removeprefix("filedesc://"), "Content-Type": "application/warc-fields"}
    else:
        lines |= {"WARC-Target-URI": fields["URL"], "WARC-IP-Address": fields["IP-address"], "WARC-Payload-Digest": sha1(payload)}
        if refers_to is not None:
            kind, block = "revisit", head
            lines |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                      "WARC-Refers-To": record_id(refers_to, ""), "Content-Type": "application/http;msgtype=response"}
        elif head:
            kind, block = "response", body
            lines["Content-Type"] = "application/http;msgtype=response"
        else:
            kind, block = "resource", body
            lines["Content-Type"] = fields["Content-type"]
    lines |= {"WARC-Block-Digest": sha1(block), "Content-Length": str(len(block))}
    named = "".join(f"{k}: {v}\r\n" for k, v in {"WARC-Type": kind, **lines}.items())
    return f"WARC/1.1\r\n{named}\r\n".encode() + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record; block digests and lengths are verified."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:cut].decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        stop = cut + 4 + int(fields["Content-Length"])
        block = data[cut + 4:stop]
        if not first.startswith("WARC/1.") or data[stop:stop + 4] != b"\r\n\r\n" or sha1(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"broken record at {at}")
        yield fields, block
        at = stop + 4


def convert(archives: DataFrame, least: int = LEAST) -> DataFrame:
    """(path) of the WARC files made from ARC files (path); one each, a gzip member for each record."""
    folder = shared_folder(archives)
    archives = archives.select("path")
    plan = stored(archives.join(revisits(arc_index(archives), least), "path", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for path, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                known = {x["offset"]: x["refers_to"] for x in listed or []}
                parts = [gzip(warc_record(fields, body, known.get(offset), f"{path}:{offset}"))
                         for offset, fields, body in arc_records(unzip(fetch(path)))]
                made.append(put(folder, f"{uuid.uuid4().hex}.warc.gz", b"".join(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    return stored(each_archive(plan).mapInArrow(run, "path string"))


def read_warc(archives: DataFrame) -> DataFrame:
    """RECORD of every response, resource and revisit record in ``archives`` (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in warc_records(unzip(fetch(path))):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    size = int(LENGTH.search(head)[1]) if kind == "revisit" else len(payload)
                    if kind != "revisit" and sha1(payload) != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']}")
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    refers = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
                    rows.append((page_of(head), fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, kind, int(refers) if refers else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = [x.split()[0] for x in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return each_archive(archives.select("path")).mapInArrow(run, RECORD)
