"""WARC archives: an index of records first, then coalesced reads of byte ranges.

Writing: one archive per task in a folder that executors share, each record a gzip member of its own, so
that any can be read by itself. The write returns the index: file, offset, length, URL and digest per record.
Reading: the index's rows are dealt out by file and runs of bytes, sorted by offset, and neighbours less than
GAP bytes apart are fetched in one read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Payloads of fewer bytes are never revisits. Bytes between records that a read passes over rather than start anew, of one read, of a run of records that one task reads, and of a task's runs in the mean.
LEAST_BYTES, GAP, READ, RUN, TASK = 1000, 64 * 1024, 8 << 20, 8 << 20, 16 << 20
INDEX = "page_id string, file string, offset long, length long, url string, digest string, record_type string, refers_to string"
RECORDS = "page_id string, url string, digest string, record_type string, refers_to string, payload binary"
#: Fixed value: the date of every record, since the tables have none; a rerun writes the same bytes.
DATE = "1970-01-01T00:00:00Z"


def record(page_id: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A WARC 1.1 record as a gzip member: a response with its payload, or a revisit without. A URL's line breaks are escaped."""
    url = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + body
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    raw = "WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n"
    return packer.compress(raw.encode("utf-8", "replace") + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[str | None, str, str, str, str | None, bytes]:
    """(page_id, url, digest, record_type, refers_to, payload) of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields.get("X-Page-ID") or None, fields.get("WARC-Target-URI", ""), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields.get("X-Refers-To-Page-ID") or None, block.partition(b"\r\n\r\n")[2]


def _file_system(uri: str):
    """The store of a path that may have a scheme, and the path in it."""
    from pyarrow import fs

    if re.match(r"file:/+", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def with_originals(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is the page that a revisit refers to, else null.

    Of equal payloads of at least `least` bytes the largest page_id is the original, and rows that repeat it
    are too. Only digests that occur more than once are joined back; where they are too many to broadcast, pages are shuffled
    by digest once.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    large: Column = F.octet_length("html") >= least
    again = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("of"), "original")
    rows = rows.join(again, (F.col("digest") == F.col("of")) & large, "left")
    other = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return rows.select("page_id", "url", "html", "digest", F.when(other, F.col("original")).alias("refers_to")).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES) -> DataFrame:
    """Writes a record per row of pages under folder; returns the index as a written table.

    A task writes under a name of its own and the index has only names of tasks that ended, so a task that is
    run again leaves at most a file that nothing refers to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _file_system(folder)
        name, out, at = f"{path}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            rows = []
            for page_id, url, html, digest, refers in zip(*(b[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                member = record(page_id, url, html.encode(), digest, refers)
                if out is None:
                    store.create_dir(path)
                    out = store.open_output_stream(name, compression=None)
                out.write(member)
                rows.append((page_id, name, at, len(member), url, digest, "response" if refers is None else "revisit", refers))
                at += len(member)
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    return shared.written(with_originals(pages, least).mapInPandas(run, INDEX))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index name, in RECORDS columns; a record that is named twice comes once per row.

    Raises if a record's digest or kind isn't the index's.
    """
    dealt = index.select("file", "offset", "length", "digest", "record_type", F.floor(F.col("offset") / RUN).alias("run"))
    size = index.agg(F.sum("length")).first()[0] or 0
    # a number of its own: what a task reads is as large as the records, not as the index that says where they are
    dealt = dealt.repartition(max(1, -(-size // TASK)), "file", "run").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _file_system(folder)
        name, source = None, None
        for b in batches:
            rows, i, size = [], 0, 0
            files, offsets, lengths = b["file"].tolist(), b["offset"].tolist(), b["length"].tolist()
            while i < len(b):
                j, end = i + 1, offsets[i] + lengths[i]
                while j < len(b) and files[j] == files[i] and offsets[j] - end <= GAP and offsets[j] + lengths[j] - offsets[i] <= READ:
                    end = max(end, offsets[j] + lengths[j])
                    j += 1
                if files[i] != name:
                    if source is not None:
                        source.close()
                    name, source = files[i], store.open_input_file(files[i])
                data = source.read_at(end - offsets[i], offsets[i])
                for k in range(i, j):
                    got = parsed(data[offsets[k] - offsets[i] :][: lengths[k]])
                    if got[2] != b["digest"].iat[k] or got[3] != b["record_type"].iat[k]:
                        raise ValueError(f"{name} at {offsets[k]} isn't the record that the index names")
                    rows.append(got)
                    size += len(got[5])
                i = j
                if size > READ or i == len(b):
                    yield pd.DataFrame(rows, columns=[f.split()[0] for f in RECORDS.split(", ")])
                    rows, size = [], 0
        if source is not None:
            source.close()

    return dealt.mapInPandas(run, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from its archive.

    A response's bytes and digest are those of the payload that was read back. A revisit has its original's
    number of bytes and its own digest. A null html is an empty payload; repeated rows have a record each.
    """
    folder = shared.fresh_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder)
    read = read_records(index, folder).select(F.col("page_id").cast("long").alias("page_id"), "digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    read = shared.written(read)
    wanted = read.filter("record_type = 'revisit'").select(F.col("refers_to").alias("original"), "digest").distinct()
    sizes = read.filter("record_type = 'response'").select(F.col("page_id").alias("original"), F.col("sha1").alias("digest"), F.col("bytes").alias("original_bytes")).distinct().join(wanted, ["original", "digest"], "left_semi")
    sizes = sizes.select("digest", "original_bytes").distinct()
    revisit = F.col("record_type") == "revisit"
    rows = read.join(sizes, "digest", "left")
    return rows.select("page_id", F.when(revisit, F.col("original_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("digest")).otherwise(F.col("sha1")).alias("payload_digest"), "record_type", "refers_to")
