"""WARC archives: whole-file gzip streams are inflated once and rewritten with a gzip member per record and an index of offsets."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlattice.llm.common import materialize, own_dir, released

#: Bytes read or inflated at a time, and of records (inflated) after which a writer begins another file.
CHUNK, FILE_BYTES = 1 << 20, 256 << 20
#: Smallest payload that a revisit record may stand for.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"

_WRITTEN = "file string, ordinal long, page_id long, payload_bytes long, payload_digest string"
_ARCHIVE = "source string, archive string, sidecar string, records long, bytes long, error string"
_INDEX = "archive string, ordinal long, offset long, length long, record_type string, record_id string, target_uri string, payload_digest string"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system that holds uri (file, hdfs, s3, gs), and its path there. A path without a scheme is a shared mount."""
    return arrow_fs.FileSystem.from_uri(uri)


def _printable(url: str) -> str:
    """A URL for a header line: what isn't visible ASCII is percent-encoded."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode("utf-8"))


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block + b"\r\n\r\n"


def _http(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode("ascii")


def record_id(page_id: int | None, file: str, ordinal: int) -> str:
    """An id of its own for each record, of which page_id can be read."""
    return f"<{_URN}{'' if page_id is None else page_id}:{file.rpartition('/')[2]}:{ordinal}>"


def _page_of(record: str | None) -> int | None:
    found = (record or "").removeprefix(f"<{_URN}").partition(":")[0]
    return int(found) if found.lstrip("-").isdigit() else None


class _Input:
    """The inflated bytes of a gzip file, of one member or of several, read forward in chunks."""

    def __init__(self, raw) -> None:
        self.raw, self.inflater, self.ahead, self.ended = raw, zlib.decompressobj(31), bytearray(), False

    def _more(self) -> bool:
        packed = self.inflater.unconsumed_tail or self.inflater.unused_data
        if self.inflater.eof:
            packed = self.inflater.unused_data or self.raw.read(CHUNK)
            if not packed:
                return False
            self.inflater = zlib.decompressobj(31)
        elif not packed:
            packed = self.raw.read(CHUNK)
            if not packed:
                raise EOFError("the gzip stream ends early")
        self.ahead += self.inflater.decompress(packed, CHUNK)
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """All up to mark and itself; nothing at the end of the stream."""
        seen = 0
        while (at := self.ahead.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ahead)
            if seen > most:
                raise ValueError("a header has no end")
            if not self._more():
                if self.ahead.strip():
                    raise EOFError("the last header has no end")
                return b""
        out = bytes(self.ahead[: at + len(mark)])
        del self.ahead[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces of at most about CHUNK."""
        while n:
            if not self.ahead and not self._more():
                raise EOFError("the last record ends early")
            piece = bytes(self.ahead[:n])
            del self.ahead[:n]
            n -= len(piece)
            if piece:
                yield piece


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


# ---------------------------------------------------------------- monolithic archives


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes each task's rows of (page_id, url, payload binary) as response records of files that are one gzip stream each.

    Returns (file, ordinal, page_id, payload_bytes, payload_digest) of every record. No row is shuffled. Files bear names of their
    attempt: what a lost or repeated task left behind is in no row, and so is never read. A file begins with a warcinfo record, ordinal 0.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, name, size, ordinal, gz = None, "", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)

        def close() -> None:
            if out is not None:
                out.write(gz.flush())
                out.close()

        for batch in batches:
            rows = []
            for page_id, url, payload in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload")), strict=True):
                if out is None or size >= file_bytes:
                    close()
                    name, size, ordinal = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, gz = store.open_output_stream(f"{root}/{name.rpartition('/')[2]}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(gz.compress(_record("warcinfo", [("WARC-Record-ID", f"<urn:info:{name.rpartition('/')[2]}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                ordinal += 1
                digest = hashlib.sha256(payload).hexdigest()
                head = [("WARC-Record-ID", record_id(page_id, name, ordinal)), ("WARC-Date", DATE)]
                head += [("WARC-Target-URI", _printable(url))] if url else []
                head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
                record = _record("response", head, _http(len(payload)) + payload)
                out.write(gz.compress(record))
                size += len(record)
                rows.append((name, ordinal, page_id, len(payload), digest))
            if rows:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "ordinal", "page_id", "payload_bytes", "payload_digest"])
        close()

    return materialize(pages.mapInArrow(write, _WRITTEN), "written")


def revisits(written: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """(file, ordinal, refers_to): every written record, and the id of the record that it revisits, if it does.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id (null last; then file and ordinal) stays.
    Only digests that repeat are joined back; a digest of very many records is a skewed join of short rows, which Spark splits.
    """
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "ordinal")
    first = written.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    twice = written.where(F.col("payload_bytes") >= least).join(first, "payload_digest").where(~((F.col("file") == F.col("first.file")) & (F.col("ordinal") == F.col("first.ordinal"))))
    name = F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), F.lit(":"), F.substring_index("first.file", "/", -1), F.lit(":"), F.col("first.ordinal"), F.lit(">"))
    found = twice.select("file", "ordinal", name.alias("refers_to"))
    rest = written.groupBy("file").agg(F.lit(0).cast("long").alias("ordinal")).withColumn("refers_to", F.lit(None).cast("string"))
    return found.unionByName(rest)


# ---------------------------------------------------------------- normaliser


def _as_revisit(fields: dict[str, str], http: bytes, refers_to: str) -> bytes:
    names = (("WARC-Record-ID", "warc-record-id"), ("WARC-Date", "warc-date"), ("WARC-Target-URI", "warc-target-uri"), ("WARC-Payload-Digest", "warc-payload-digest"), ("Content-Type", "content-type"))
    return _record("revisit", [(k, fields[n]) for k, n in names if n in fields] + [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)], http)


def normalise_file(source: str, folder: str, refers: dict[int, str], level: int = 4) -> dict:
    """Rewrites one archive: a gzip member per record, and a sidecar of JSON lines with each member's offset and length.

    The source is inflated once, forward, whether it is one stream or has members already; of a record only the deflated form is held. Records in
    `refers` (by ordinal) lose their payload and become revisits. A file that breaks off or isn't an archive gets all records before the fault, and the fault's text as `error`.
    """
    store, path = _store(source)
    target, root = _store(folder)
    target.create_dir(root, recursive=True)
    name = f"{source.rpartition('/')[2].removesuffix('.gz').removesuffix('.warc')}-{uuid.uuid4().hex[:8]}.warc.gz"
    ordinal, offset, error = 0, 0, None
    with store.open_input_stream(path, compression=None) as raw, target.open_output_stream(f"{root}/{name}", compression=None) as out, target.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
        stream = _Input(raw)
        try:
            while head := stream.until(b"\r\n\r\n").lstrip(b"\r\n"):
                fields = _fields(head)
                n, gz, parts = int(fields["content-length"]), zlib.compressobj(level, zlib.DEFLATED, 31), []
                kind = fields.get("warc-type", "")
                if ordinal in refers:
                    http = b""
                    for piece in stream.take(n):
                        http += piece if b"\r\n\r\n" not in http else b""
                    http = http[: http.find(b"\r\n\r\n") + 4]
                    kind = "revisit"
                    parts.append(gz.compress(_as_revisit(fields, http, refers[ordinal])))
                else:
                    parts.append(gz.compress(head))
                    parts += (gz.compress(piece) for piece in stream.take(n))
                    parts.append(gz.compress(b"\r\n\r\n"))
                parts.append(gz.flush())
                length = sum(map(len, parts))
                for part in parts:
                    out.write(part)
                stream.until(b"\r\n\r\n")
                entry = {"ordinal": ordinal, "offset": offset, "length": length, "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest")}
                index.write(json.dumps(entry).encode("utf-8") + b"\n")
                ordinal, offset = ordinal + 1, offset + length
        except (EOFError, ValueError, KeyError, zlib.error) as fault:
            error = f"{type(fault).__name__}: {fault}"
    return {"source": source, "archive": f"{folder}/{name}", "sidecar": f"{folder}/{name}.idx", "records": ordinal, "bytes": offset, "error": error}


def normalise(records: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """(source, archive, sidecar, records, bytes, error) of every file of records (file, ordinal, refers_to).

    A file needs one row at least; rows with refers_to name what becomes a revisit. A task holds one file's such rows, which the file's size bounds. New names for each attempt, as in `write_monolithic`.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        said = pdf[pdf["refers_to"].notna()]
        return pd.DataFrame([normalise_file(pdf["file"].iloc[0], folder, dict(zip(said["ordinal"].astype(int), said["refers_to"], strict=True)), level)])

    # The rows are few and the work is not, so tasks are set by the number of files, not by the size of the rows.
    files = records.select("file").distinct().count()
    return materialize(records.repartition(max(1, files), "file").groupBy("file").applyInPandas(one, _ARCHIVE), "archives")


# ---------------------------------------------------------------- reading


def read_index(archives: DataFrame) -> DataFrame:
    """The entries of the sidecars of archives (archive, sidecar), by offset."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, sidecar in zip(pdf["archive"], pdf["sidecar"], strict=True):
                store, path = _store(sidecar)
                with store.open_input_stream(path, compression=None) as raw:
                    entries, rest = [], b""
                    while piece := raw.read(CHUNK):
                        *whole, rest = (rest + piece).split(b"\n")
                        entries = [json.loads(line) for line in whole]
                        if entries:
                            yield pd.DataFrame(entries).assign(archive=archive)[[f.split()[0] for f in _INDEX.split(", ")]]

    return archives.select("archive", "sidecar").mapInPandas(lines, _INDEX)


def _parsed(member: bytes) -> tuple:
    data = zlib.decompress(member, 31)
    at = data.index(b"\r\n\r\n") + 4
    fields = _fields(data[:at])
    block = data[at : at + int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next((int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
    revisit = fields["warc-type"] == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    size = said if revisit else len(payload)
    return _page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page_of(fields.get("warc-refers-to")) if revisit else None, None if revisit else payload


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Response and revisit records, each inflated alone from its offset in an index of (archive, offset, length, record_type, ordinal).

    Size and digest of a response are those of the bytes read; a revisit has them from its headers, and no payload.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        archive, source, rows, held = None, None, [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if name != archive:
                    if source is not None:
                        source.close()
                    archive = name
                    store, path = _store(name)
                    source = store.open_input_file(path)
                source.seek(offset)
                got = _parsed(source.read(length))
                rows.append(got if payloads else (*got[:-1], None))
                held += len(got[-1] or b"") if payloads else 0
                if held > 16 * CHUNK or len(rows) == 10_000:
                    yield made()
                    rows, held = [], 0
        if rows:
            yield made()
        if source is not None:
            source.close()

    wanted = index.where(F.col("record_type").isin("response", "revisit")).select("archive", "offset", "length")
    out = wanted.mapInArrow(read, _READ)
    return out if payloads else out.drop("payload")


def archive_pages(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of (page_id, url, html), written as monolithic streams, normalised, and indexed: the index as a table.

    A null html is an empty payload, a null url has no WARC-Target-URI; rows without a page_id keep a record whose page reads as
    null, and come last among equal payloads. Of repeated rows the first is the response and the others revisit it. Further columns are left out. An empty table gives an empty index.
    """
    folder = own_dir(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    written = write_monolithic(rows, f"{folder}/whole", file_bytes)
    archives = normalise(revisits(written), f"{folder}/members")
    released(f"{folder}/whole")
    return materialize(read_index(archives), "index")


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from its archives."""
    return read_records(archive_pages(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
