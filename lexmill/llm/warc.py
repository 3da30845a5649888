"""WARC records in ZIP packages: written as stored members with an index, read back by ranges."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import Workspace, ship, small, spread, table

#: Payloads from this size on are written once; later equal ones become revisits.
REVISIT_BYTES = 100
#: A package is closed once its members reach this size.
PACKAGE_BYTES = 64 << 20
#: Records are read in ranges of about this many bytes, and a task reads about this many.
RANGE_BYTES, TASK_BYTES = 4 << 20, 64 << 20
DATA, INDEX, MANIFEST = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2024-01-01T00:00:00Z"
_EOCD, _EOCD64, _LOC64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# --- packages: a small reader of central directories


def directory(read, size: int) -> dict[str, tuple[int, int]]:
    """{member: (offset of its data, size)} of a ZIP package of stored members, ZIP64 included.

    read(offset, length) gives bytes of the package; only its tail, its directory and local headers are read.
    Raises ValueError for what is no such package."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(_EOCD)
    if k < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack("<HII", tail[k + 10 : k + 20])
    if entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        loc = read(tail_at + k - 20, 20)
        if loc[:4] != _LOC64:
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack("<Q", loc[8:16])[0], 56)
        if end64[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack("<QQQ", end64[32:56])
    cd, at, out = read(start, length), 0, {}
    for _ in range(entries):
        if cd[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack("<HH", cd[at + 8 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", cd[at + 20 : at + 34])
        offset = struct.unpack("<I", cd[at + 42 : at + 46])[0]
        name = cd[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = cd[at + 46 + n_name : at + 46 + n_name + n_extra]
        packed, offset = _zip64(extra, plain, packed, offset)
        if method == 0:
            head = read(offset, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"broken local header of {name}")
            out[name] = (offset + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def _zip64(extra: bytes, plain: int, packed: int, offset: int) -> tuple[int, int]:
    """Size and offset, from the ZIP64 field where the entry has no room for them."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack("<HH", extra[at : at + 4])
        if tag == 1:
            wide = list(struct.unpack(f"<{n // 8}Q", extra[at + 4 : at + 4 + n // 8 * 8]))
            if plain == 0xFFFFFFFF:
                wide.pop(0)
            packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
            offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
        at += 4 + n
    return packed, offset


def opened(path: str):
    """(read, size) of a file that pyarrow can open: a local path or a URI."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    f = system.open_input_file(inner)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return read, f.size()


# --- records


def target(page: str, url) -> str:
    """The URI a record is about: the page's url, without line breaks and blanks, or a name made from its id."""
    return quote(url, safe="".join(map(chr, range(33, 127)))) if isinstance(url, str) and url else f"urn:page:{page}"


def record(kind: str, page: str, digest: str, size: int, payload: bytes, refers_to, uri: str) -> bytes:
    """One WARC/1.1 record of an HTTP response, or of a revisit that has its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    return "\r\n".join([*head, f"Content-Length: {len(http) + len(payload)}", "", ""]).encode() + http + payload + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The record that opens an archive and says what it is."""
    block = b"software: lexmill\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def sort_key(uri: str) -> str:
    """The key of a CDXJ line: host labels from the top down, then the rest in lower case; other URIs as they are."""
    scheme, found, rest = uri.partition("://")
    if not found:
        return uri.replace(" ", "%20")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return f"{','.join(reversed(host.lower().split('.')))}){rest[len(host) :].lower() or '/'}"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP part, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# --- jobs


def revisits(pages: DataFrame, work: Workspace, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a lesser id has; (id, digest, size) is all that is shuffled."""
    p = pages.select(F.col(id_col).alias("id"), F.coalesce(html_col, F.lit("")).cast("binary").alias("b"))
    p = p.select("id", F.sha2("b", 256).alias("digest"), F.octet_length("b").alias("n")).where(f"n >= {REVISIT_BYTES} and id is not null").drop("n")
    first = work.write(p.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    return spread(p, first, "digest", "id").where("id <> refers_to").select("id", "digest", "refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url") -> DataFrame:
    """Write one WARC record for each row of pages to ZIP packages in folder; (path, records, bytes) of the packages.

    folder is a path or URI that every executor can write to. Rows are records with the html (null: empty) as payload
    and the url as target (null or none: a name made from the id); of equal payloads of REVISIT_BYTES or more those of
    the least id are responses and others are revisits of it. Rows of one id with several payloads are each judged by
    their own. Each task streams its rows into packages of PACKAGE_BYTES (a warcinfo record, the records, an index of
    CDXJ lines, a manifest), written under a name of its attempt and renamed when closed, so a task that runs again
    leaves no half package. Ids are longs; rows with a null id are responses; repeated rows are each written."""
    spark = pages.sparkSession
    ship(spark)
    work = Workspace(spark, "warc")
    again = small(work.write(revisits(pages, work, id_col, html_col), "revisits"))
    url = F.lit(None).cast("string") if url_col is None or url_col not in pages.columns else F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(again, ["id", "digest"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        made, box = [], None
        for pdf in batches:
            for pid, url, payload, refers, digest in zip(pdf["id"], pdf["url"], pdf["payload"], pdf["refers_to"], pdf["digest"], strict=True):
                if box is None:
                    box = Package(folder, f"part-{task.partitionId():05d}-{len(made):04d}", task.taskAttemptId())
                pid = "" if pd.isna(pid) else str(int(pid))
                kind, refers = ("response", None) if pd.isna(refers) else ("revisit", int(refers))
                uri = target(pid, url)
                box.add(pid, uri, digest, record(kind, pid, digest, len(payload), payload, refers, uri))
                if box.size >= PACKAGE_BYTES:
                    made.append(box.close())
                    box = None
        if box is not None:
            made.append(box.close())
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    return work.write(rows.select("id", "url", "payload", "refers_to", "digest").mapInPandas(run, "path string, records long, bytes long"), "packages")


class Package:
    """A ZIP of stored members, streamed: gzipped records one by one, then their index and a manifest."""

    def __init__(self, folder: str, name: str, attempt: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temp = f"{root}/{name}.wacz", f"{root}/.{name}.{attempt}"
        self.uri = f"{folder}/{name}.wacz"
        self.out = self.fs.open_output_stream(self.temp)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.n, self.lines, self.sum = 0, 0, [], hashlib.sha256()
        self.put(warcinfo(f"{name}.warc.gz"))

    def put(self, raw: bytes) -> int:
        z = gzip.compress(raw, 1, mtime=0)
        self.data.write(z)
        self.sum.update(z)
        self.size += len(z)
        return len(z)

    def add(self, page: str, uri: str, digest: str, raw: bytes) -> None:
        offset, length = self.size, self.put(raw)
        found = {"url": uri, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(length), "offset": str(offset), "filename": DATA.rsplit("/", 1)[1]}
        self.lines.append(f"{sort_key(uri)} {re.sub(r'[^0-9]', '', DATE)} {json.dumps(found)}")
        self.n += 1

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        index = "".join(f"{x}\n" for x in sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        parts = [(DATA, self.sum.hexdigest(), self.size), (INDEX, hashlib.sha256(index).hexdigest(), len(index))]
        resources = [{"name": p.rsplit("/", 1)[1], "path": p, "hash": f"sha256:{h}", "bytes": n} for p, h, n in parts]
        self.zip.writestr(zipfile.ZipInfo(MANIFEST), json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}))
        self.zip.close()
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.uri, self.n, self.size


def cdxj(line: bytes) -> dict:
    """The JSON part of an index line: behind the key and the date."""
    return json.loads(line[line.index(b" {") + 1 :])


def read_packages(packages: DataFrame, block: int | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of the packages.

    packages: path and bytes. Each package is opened in place: its directory and index are read, then records by ranges
    of about block bytes, dealt over as many tasks as the bytes need; nothing is unpacked. url is null where the target
    was made from the id. payload is null for revisits; their size and digest are those of the response.
    Raises ValueError for a response whose payload is not what its digest says, and for broken packages."""
    spark = packages.sparkSession
    ship(spark)
    block = block or RANGE_BYTES

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                read, size = opened(path)
                members = directory(read, size)
                index = sorted((int(e["offset"]), int(e["length"])) for e in map(cdxj, read(*members[INDEX]).splitlines()))
                base, out, now = members[DATA][0], [], None
                for offset, length in index:
                    if now is None or now[2] + length > block or now[1] + now[2] != base + offset:
                        now = [path, base + offset, 0, []]
                        out.append(now)
                    now[2] += length
                    now[3].append(length)
                yield pd.DataFrame(out, columns=["path", "offset", "length", "lengths"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, offset, length, lengths in pdf.itertuples(index=False):
                read, _ = opened(path)
                raw, at, out = read(offset, length), 0, []
                for n in lengths:
                    fields, http, payload = parse(gzip.decompress(raw[at : at + n]))
                    at += n
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: payload of {fields['WARC-Record-ID']} is damaged")
                    page, refers = (x[len("<urn:page:") : -1] if x else None for x in (fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                    uri = fields["WARC-Target-URI"]
                    out.append((int(page) if page else None, None if uri.startswith("urn:page:") else uri, int(http["Content-Length"]), digest, kind, int(refers) if refers else None, payload if kind == "response" else None))
                yield pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    n, total = packages.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = 2 * spark.sparkContext.defaultParallelism
    found = packages.select("path").repartition(max(1, min(n, 100 * least)), "path").mapInPandas(spans, "path string, offset long, length long, lengths array<long>")
    tasks = max(total // TASK_BYTES, min(least, total // block)) + 1
    dealt = found.repartition(int(tasks), "path", "offset")
    return dealt.mapInPandas(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "packages").root
    made = write_packages(table(spark, sf_dir, "pages"), folder)
    return read_packages(made).drop("payload", "url")


ORACLE = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) first from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and page_id <> first then first end refers_to from f
"""
