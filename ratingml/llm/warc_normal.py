"""WARC archives: whole-file gzip streams, rewritten record by record with an offset index.

``write_streams`` writes pages as WARC records, each file one gzip stream, as many
crawlers leave them. ``normalise`` inflates such a stream once, from front to back,
writes every record as a gzip member of its own, and next to the archive a sidecar
index with the offset and length of each member. ``read_back`` opens members by that
index only. Files are rolled over at ``max_file_bytes``, so one task never holds
more than a file's stream, and never more than one record in memory.

Equal payloads of at least ``min_revisit_bytes`` bytes are stored once: the record
with the largest page_id is the response, the others are revisits that refer to it.
The group sizes are found by SHA-1, with sums on the map side, so a payload that a
third of all pages share is spread like any other.

Defined results: a null html is an empty payload. Rows that repeat the largest
page_id of a payload are all responses. A null page_id counts as the smallest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.llm import files
from ratingml.llm.common import fresh_path, stored

MIN_REVISIT_BYTES = 1000
MAX_FILE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_CHUNK = 1 << 20
_URN = "urn:x-page:"
#: Members of one index that a reading task gets at a time.
_SLICE = 4_000

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def decided(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``; ``refers_to`` is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").select(F.col("digest").alias("__digest"), "newest"), "warc-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("__digest")) & (F.octet_length("payload") >= min_revisit_bytes), "left")
    older = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return joined.select("page_id", "url", "payload", "digest", F.when(older, F.col("newest")).alias("refers_to"))


def record_of(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record."""
    kind = "response" if refers_to is None else "revisit"
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(lines).encode() + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <{_URN}{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:]) if name}


def records_in(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the pieces of an inflated stream."""
    held = bytearray()
    need, searched = 0, 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", max(0, searched - 3))
                if end < 0:
                    searched = len(held)
                    break
                need = end + 4 + int(fields_of(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need, searched = 0, 0
    if held:
        raise ValueError("the archive ends inside of a record")


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_URN)
    return int(digits) if digits else None


def _optional(value: object) -> int | None:
    return None if value is None or value != value else int(value)


def write_streams(rows: DataFrame, folder: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write the decided pages, one gzip stream per file; gives ``path, records``."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, out = [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path = files.new_name(folder, "stream", "warc.gz")
                    out, squeeze, size, n = files.create(path), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                record = record_of(_optional(row.page_id), row.url, row.payload, row.digest, _optional(row.refers_to))
                out.write(squeeze.compress(record))
                size, n = size + len(record), n + 1
                if size >= max_file_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            done.append((path, n))
        yield pd.DataFrame(done, columns=["path", "records"])

    # as text, since a column with nulls would turn large ids into floats
    ids = rows.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return stored(ids.mapInPandas(write, "path string, records long"), "warc-streams")


def _inflated(source: BinaryIO) -> Iterator[bytes]:
    inflate = zlib.decompressobj(31)
    while data := source.read(_CHUNK):
        while data:
            yield inflate.decompress(data)
            data = b""
            if inflate.eof:
                # a file may hold several streams
                data, inflate = inflate.unused_data, zlib.decompressobj(31)


def normalise_file(source: BinaryIO, archive: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite one stream; the index has a JSON line per record."""
    offset = n = 0
    for record in records_in(_inflated(source)):
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = squeeze.compress(record) + squeeze.flush()
        archive.write(member)
        fields = fields_of(record[: record.index(b"\r\n\r\n")])
        entry = {"offset": offset, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"]}
        index.write(json.dumps(entry).encode() + b"\n")
        offset, n = offset + len(member), n + 1
    return n


def normalise(streams: DataFrame, folder: str) -> DataFrame:
    """Rewrite every stream file; gives ``archive, index, records``. A file is one row and one task's work."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                archive = files.new_name(folder, "records", "warc.gz")
                index = archive.removesuffix(".warc.gz") + ".idx"
                with files.open_stream(path) as source, files.create(archive) as a, files.create(index) as i:
                    n = normalise_file(source, a, i)
                yield pd.DataFrame([(archive, index, n)], columns=["archive", "index", "records"])

    spread = streams.select("path").repartition(_tasks(streams), "path")
    return stored(spread.mapInPandas(rewrite, "archive string, index string, records long"), "warc-archives")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of one member.

    The length of a revisit's payload is in the HTTP header that it keeps.
    """
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = fields_of(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = len(payload)
    if fields["warc-type"] == "revisit":
        size = int(fields_of(http)["content-length"])
    elif hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not have the digest of its header")
    return _number(fields["warc-record-id"]), size, digest, fields["warc-type"], _number(fields.get("warc-refers-to"))


def read_back(archives: DataFrame) -> DataFrame:
    """A row per record, each read by its place in the sidecar index."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, index, first in zip(batch["archive"], batch["index"], batch["first"]):
                rows = []
                with files.open_file(archive) as source, files.open_stream(index) as lines:
                    # lines before the slice are passed over, not parsed
                    for number, line in enumerate(lines.read().split(b"\n")[int(first) : int(first) + _SLICE]):
                        if line:
                            entry = json.loads(line)
                            source.seek(entry["offset"])
                            rows.append(parsed(source.read(entry["length"])))
                frame = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("records") - 1, F.lit(0)), F.lit(_SLICE).cast("long")))
    slices = archives.select("archive", "index", first.alias("first")).repartition(_tasks(archives), "archive", "first")
    return slices.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Write, normalise and read back; the files stay in the shared folder."""
    folder = fresh_path(pages.sparkSession, "warc")
    streams = write_streams(decided(pages, min_revisit_bytes), folder + "/streams", max_file_bytes)
    return read_back(normalise(streams, folder + "/records"))
