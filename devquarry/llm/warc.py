"""WARC archives compressed by Zstandard with a dictionary: one frame for each record.

An archive begins with a skippable frame that holds its dictionary (plain or itself compressed); each
record is one frame after it. Writer and reader pass archives as a binary column, so any store that Spark
reads will do: a table written by ``write_archives`` or ``.warc.zst`` files through ``binary_files``.

Of pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the smallest id is stored,
the others refer to it. Null html is an empty payload; a null id never is referred to and stays null;
rows that repeat the smallest id are all stored. A very long page is one record of one frame. Only the
id, address and html are read, so further columns can't clash. No pages give no archives.
"""

from __future__ import annotations

import hashlib
import re
import struct
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
LEAST_REVISIT = 100
#: Bytes of records in an archive, of the dictionary, and of the records it is trained on.
ARCHIVE, DICTIONARY, TRAINED_ON = 16 << 20, 16 << 10, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, http_status int, payload_bytes long, payload_digest string, payload binary"


class BadArchive(ValueError):
    """An archive or record that breaks the format."""


# -- frames ------------------------------------------------------------------------------------------------


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its block headers."""
    if data[at : at + 4] != FRAME_MAGIC:
        raise BadArchive(f"no Zstandard frame at byte {at}")
    try:
        head = data[at : at + 18]
        params, pos = zstandard.get_frame_parameters(head), at + zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise BadArchive(f"bad frame header at byte {at}: {e}") from e
    last = False
    while not last:
        if pos + 3 > len(data):
            raise BadArchive("the last frame is cut off")
        head = int.from_bytes(data[pos : pos + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * params.has_checksum
    if pos > len(data):
        raise BadArchive("the last frame is cut off")
    return pos


def split_archive(data: bytes):
    """The records' bytes, one for each frame."""
    at, dictionary = 0, None
    while len(data) - at >= 8 and (magic := struct.unpack_from("<I", data, at)[0]) & 0xFFFFFFF0 == 0x184D2A50:
        size = struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if len(body) != size:
            raise BadArchive("the skippable frame is cut off")
        if magic == DICTIONARY_MAGIC and at == 0:
            raw = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27) if body[:4] == FRAME_MAGIC else body
            dictionary = zstandard.ZstdCompressionDict(raw)
        at += 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield reader.decompressobj().decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at byte {at} can't be decoded: {e}") from e
        at = end


def join_archive(records: list[bytes], level: int = 3) -> bytes:
    """An archive of the records, with a dictionary trained on the first of them where they are enough."""
    sample, held = [], 0
    for r in records:
        if held >= TRAINED_ON:
            break
        sample.append(r[: 1 << 17])
        held += len(sample[-1])
    out, dictionary = [], None
    if len(sample) >= 8 and held >= 8 * DICTIONARY:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY, sample, k=256, d=8, f=18, accel=4)
        except zstandard.ZstdError:
            dictionary = None  # records too much alike to train on
    if dictionary:
        body = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    writer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    return b"".join(out + [writer.compress(r) for r in records])


# -- records -----------------------------------------------------------------------------------------------


def header_lines(raw: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise BadArchive(f"bad header line {line[:80]!r}")
        found[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    return found


def number(text: str | None) -> int:
    if text is None or not re.fullmatch(r"[0-9]{1,18}", text):
        raise BadArchive(f"bad length {text!r}")
    return int(text)


def parse_record(raw: bytes) -> tuple:
    """The columns of RECORD; raises BadArchive where headers or lengths are wrong."""
    head, blank, block = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise BadArchive(f"not a WARC record: {version[:40]!r}")
    h = header_lines(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise BadArchive(f"no {name}")
    size = number(h["content-length"])
    if len(block) != size + 4 or not block.endswith(b"\r\n\r\n"):
        raise BadArchive(f"content-length {size}, but {len(block) - 4} bytes")
    block = block[:size]
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    refers, status, payload, length = h.get("warc-refers-to"), None, block, size
    if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        first, _, rest = http.partition(b"\r\n")
        if not blank or not (m := re.match(rb"HTTP/\d\.\d (\d{3})", first)):
            raise BadArchive("bad HTTP header")
        own = header_lines(rest) if rest else {}
        status, length = int(m[1]), number(own.get("content-length", str(len(payload))))
        if kind == "response" and length != len(payload):
            raise BadArchive(f"HTTP content-length {length}, but {len(payload)} bytes")
    if kind == "revisit":
        if refers is None or digest is None:
            raise BadArchive("a revisit without warc-refers-to or digest")
        payload = None
    elif digest is not None and hashlib.sha256(payload).hexdigest() != digest:
        raise BadArchive(f"{h['warc-record-id']}: the payload has another digest")
    return h["warc-record-id"], kind, h.get("warc-target-uri"), refers, status, length, digest, payload


def format_record(record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(uri, safe=':/?#[]@!$&()*+,;=%~-._')}", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"] if refers_to else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# -- DataFrames --------------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE) -> DataFrame:
    """One row for each archive: archive binary, n_records. ``pages`` has page_id, url and html; other columns are ignored."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html"))
    first = own.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = own.select("page_id", "digest", "size").filter(F.col("size") >= LEAST_REVISIT).join(first, ["digest", "size"]).filter("not (page_id <=> first)")
    again = again.filter("first is not null").select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "first").distinct()
    told = own.join(again, own["page_id"].eqNullSafe(F.col("id")) & (own["digest"] == F.col("d")), "left").select("page_id", "url", "html", "digest", "first")

    def archives(batches):
        records, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page, url, html, digest, ref = row
                name = f"urn:x-page:{'null' if page is None else page}"
                records.append(format_record(f"<{name}>", url or name, html.encode(), digest, None if ref is None else f"<urn:x-page:{ref}>"))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pa.record_batch([pa.array([join_archive(records)], pa.binary()), pa.array([len(records)], pa.int64())], ["archive", "n_records"])
                    records, held = [], 0
        if records:
            yield pa.record_batch([pa.array([join_archive(records)], pa.binary()), pa.array([len(records)], pa.int64())], ["archive", "n_records"])

    return told.mapInArrow(archives, "archive binary, n_records long")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """The ``.warc.zst`` files below ``path`` as an ``archive`` column."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select(F.col("content").alias("archive"))


def read_archives(archives: DataFrame) -> DataFrame:
    """The columns of RECORD for each record; a broken archive ends the job with BadArchive. A revisit has no payload."""

    def records(batches):
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for archive in batch.column("archive"):
                rows, held = [], 0
                for raw in split_archive(archive.as_py() or b""):
                    rows.append(parse_record(raw))
                    held += len(raw)
                    if held >= 4 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return archives.select("archive").mapInArrow(records, RECORD)


def page_number(uri):
    return F.regexp_extract(uri, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), shared_dir(spark), "archives")
    return read_archives(archives).select(
        page_number(F.col("record_id")).alias("page_id"), "payload_bytes",
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"), "record_type", page_number(F.col("refers_to")).alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT page_id, n, sha256(html) AS d, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""
