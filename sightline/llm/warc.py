"""WARC archives under Zstandard: a dictionary in a leading skippable frame, one frame a record."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from hashlib import sha256
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import filesystem, new_folder, released

#: Fixed values of the formats: the frame that holds the dictionary, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads under this are stored again each time.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, DICTIONARY_SAMPLE = 64 << 10, 8 << 20


def _line(value: object) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record without a body if ``refers_to`` is given."""
    if refers_to is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        block = http + payload
    else:
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": "<urn:page:%s>" % ("" if page_id is None else page_id),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _line(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "WARC-Refers-To": None if refers_to is None else f"<urn:page:{refers_to}>",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _page(value: str) -> int | None:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise ValueError(f"no page id: {value!r}")
    return int(value[10:-1]) if value != "<urn:page:>" else None


def parse_record(raw: bytes) -> dict[str, Any]:
    """A record's fields and payload; ValueError if a header, a length or the digest is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not found or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC record")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise ValueError(f"bad header line {line!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    length = int(fields["content-length"])
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the length is wrong")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    algorithm, _, digest = fields["warc-payload-digest"].partition(":")
    size, kind = int(fields["warc-payload-length"]), fields["warc-type"]
    if kind == "response":
        stated = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if stated != [len(payload)] or size != len(payload):
            raise ValueError("the payload's length is wrong")
        if algorithm != "sha256" or sha256(payload).hexdigest() != digest:
            raise ValueError("the payload's digest is wrong")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
        raise ValueError(f"a record of an unknown kind or an incomplete revisit: {kind}")
    return {
        "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


class ArchiveWriter:
    """Writes one archive; the dictionary is trained on the first records, a bounded number of bytes."""

    def __init__(self, out: BinaryIO, level: int = 3) -> None:
        self.out, self.level = out, level
        self.held: list[bytes] | None = []
        self.size = 0

    def write(self, record: bytes) -> None:
        self.size += len(record)
        if self.held is not None:
            self.held.append(record)
            if self.size >= DICTIONARY_SAMPLE:
                self._start()
        else:
            self.out.write(self.frames.compress(record))

    def _start(self) -> None:
        import zstandard as zstd

        held, self.held = self.held or [], None
        words = None
        if len(held) >= 16:
            try:
                words = zstd.train_dictionary(DICTIONARY_BYTES, [x[: 64 << 10] for x in held])
            except zstd.ZstdError:  # too little to learn from
                words = None
        if words is not None:
            raw = zstd.ZstdCompressor(level=self.level).compress(words.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.frames = zstd.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True, write_content_size=True)
        for x in held:
            self.out.write(self.frames.compress(x))

    def close(self) -> None:
        if self.held is not None:
            self._start()
        self.out.close()


def read_archive(source: BinaryIO, block: int = 1 << 20) -> Iterator[dict[str, Any]]:
    """The records of an archive in order; reads block by block, one frame at a time."""
    import zstandard as zstd

    held, words = source.read(8), None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<I", held[4:])[0]
        raw = source.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary is cut off")
        if raw[:4] == FRAME_MAGIC:
            raw = zstd.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
        words, held = zstd.ZstdCompressionDict(raw), b""
    frames = zstd.ZstdDecompressor(dict_data=words) if words else zstd.ZstdDecompressor()
    while True:
        held = held or source.read(block)
        if not held:
            return
        one, parts = frames.decompressobj(), []
        while True:
            parts.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = source.read(block)
            if not held:
                raise ValueError("the archive ends within a record")
        yield parse_record(b"".join(parts))


def _revisits(keyed: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that repeat an earlier page's payload."""
    first = (
        keyed.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 and refers_to is not null").select("digest", "refers_to")
    )
    again = keyed.select("page_id", "digest").join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Writes a record for every row of ``pages`` and returns the archives' paths.

    Of payloads of at least LEAST_REVISIT bytes that are equal, the page with the smallest
    id holds it (and rows that repeat this id); the others refer to it. A null html is an
    empty payload. Rows without a page_id have a record with an empty id and never are
    referred to. Other columns are ignored; an empty table gives no archive. A task that
    runs again writes other files, and only the paths returned count.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    if folder.startswith(("/", "file:")):
        fs, at = filesystem(folder)
        fs.create_dir(at, recursive=True)
    html = F.coalesce("html", F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), F.sha2(html, 256).alias("digest"))
    revisit = _revisits(keyed.select("page_id", "digest", F.octet_length("payload").alias("size")))
    revisit = revisit.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers_to")
    ready = keyed.join(revisit, keyed.page_id.eqNullSafe(revisit._p) & (keyed.digest == revisit._d), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, paths = None, []
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if writer is None:
                    paths.append(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                    fs, at = filesystem(paths[-1])
                    writer = ArchiveWriter(fs.open_output_stream(at))
                writer.write(make_record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date))
                if writer.size >= archive_bytes:
                    writer.close()
                    writer = None
        if writer:
            writer.close()
        yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string())})

    done = ready.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(released(work), "path string")
    return sorted(x["path"] for x in done.collect())


def read_archives(spark, paths: list[str], with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record,
    validated; with the payload of responses if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        if with_payload:
            kinds["payload"] = pa.binary()

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = filesystem(path)
                with fs.open_input_stream(at) as source:
                    rows = []
                    for record in read_archive(source):
                        rows.append(record)
                        if len(rows) == 200:
                            yield out(rows)
                            rows = []
                    if rows:
                        yield out(rows)

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return listed.mapInArrow(released(work), kind)
