"""WARC archives with a Zstandard dictionary.

Each task rolls its records into archives of bounded size. A dictionary is built from records of the
archive and leads the file in a skippable frame (magic number 0x184D2A5D, as .warc.zst files have
it); every record is a frame of its own, so records can be read one by one. The job's manifest lists
the archives; readers open nothing else.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import any_filter, filter_bits, has, saved, shared_folder
from .files import opened, written

_MAGIC = 0x184D2A5D
_DICT_BYTES, _SAMPLE_BYTES = 1 << 16, 1 << 22
#: Bytes of records (before compression) in an archive.
ARCHIVE_BYTES = 1 << 25
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def _line(value: str | None) -> str:
    """A value on one line, as header fields need it."""
    return " ".join((value or "").split())


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    fields = [("WARC-Record-ID", _id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    fields += [("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return record("revisit", fields, b"")
    return record("response", fields, _http(payload or b"") + (payload or b""))


def archive(records: list[bytes]) -> list[bytes]:
    """The parts of an archive: dictionary frame (if one can be built), then a frame for each record."""
    step = max(1, sum(map(len, records)) // _SAMPLE_BYTES)
    samples = records[::step]
    try:
        trained = zstandard.train_dictionary(_DICT_BYTES, samples) if len(samples) > 8 else None
    except zstandard.ZstdError:  # too few or too short records
        trained = None
    parts = []
    if trained is not None:
        data = trained.as_bytes()
        parts = [struct.pack("<II", _MAGIC, len(data)) + data]
    coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    return parts + [coder.compress(r) for r in records]


def records(stream):
    """(type, fields, block) of each record of an archive."""
    head = stream.read(8)
    trained, before = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == _MAGIC:
        trained, before = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    source = io.BufferedReader(_Joined(before, stream))
    with zstandard.ZstdDecompressor(dict_data=trained).stream_reader(source, read_across_frames=True) as plain:
        text = io.BufferedReader(plain)
        while version := text.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {version[:40]!r}")
            fields = {}
            while (line := text.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().partition(":")
                fields[k.strip()] = v.strip()
            block = text.read(int(fields["Content-Length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a record has no end")
            yield fields["WARC-Type"], fields, block


class _Joined(io.RawIOBase):
    """What was read ahead, then the rest of a stream."""

    def __init__(self, before: bytes, rest):
        self.before, self.rest = before, rest

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.before[: len(buffer)] or self.rest.read(len(buffer))
        self.before = self.before[len(data) :]
        buffer[: len(data)] = data
        return len(data)


def _filter(keys: DataFrame, key: Column):
    """A test whether a column of hashes may be among those of keys, by a filter of bounded size that every task gets."""
    bits = filter_bits(keys.count())
    kept = keys.sparkSession.sparkContext.broadcast(any_filter(keys.select(key.alias("h")), bits))

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(has(kept.value, h.to_numpy() & (bits - 1)))

    return test


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages to archives in folder and gives the manifest: path, n_records.

    Of pages with equal payloads (UTF-8, null: empty) of at least least_bytes, that with the smallest
    id is a response and the others are revisits of it; smaller payloads are all responses. Rows that
    repeat the smallest id are responses too; a row without an id is a revisit where another row has
    one. Other columns are not read. An empty table gives no archives.
    """
    data = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    firsts = saved(firsts.select("digest", "first"), "firsts")
    # payloads stay where they are read, but for those of the firsts of several: filters of bounded size tell which rows may
    # be of a digest with several, and of these which may be its first; what they let through is joined exactly
    of_digest, of_row = F.xxhash64("digest"), F.xxhash64("digest", "page_id")
    several, leading = _filter(firsts, of_digest), _filter(firsts.withColumnRenamed("first", "page_id"), of_row)
    may = rows.withColumn("__may", (F.col("size") >= least_bytes) & several(of_digest))
    told = ["page_id", "url", "payload", "digest", "size", "first", "revisit"]
    plain = lambda df: df.withColumns({"first": F.lit(None).cast("long"), "revisit": F.lit(False)}).select(*told)
    moved = may.filter("__may").withColumn("payload", F.when(leading(of_row), F.col("payload"))).join(firsts, "digest", "left")
    moved = moved.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    joined = plain(may.filter(~F.col("__may"))).unionByName(moved.filter("first IS NOT NULL").select(*told))
    # rows that only the filter took for one of several are read again
    stray = saved(may.filter("__may").select("digest").distinct().join(firsts, "digest", "left_anti"), "stray")
    if not stray.isEmpty():
        joined = joined.unionByName(plain(may.filter(F.col("__may") & _filter(stray, of_digest)(of_digest)).join(stray, "digest", "left_semi")))

    def run(batches):
        held, size = [], 0

        def flush():
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            path = written(folder, "pages", ".warc.zst", archive([info, *held]))
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([len(held)], pa.int64())})

        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "digest", "size", "first", "revisit")], strict=True):
                held.append(page_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return saved(joined.select("page_id", "url", "payload", "digest", "size", "first", "revisit").mapInArrow(run, "path string, n_records long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of all records in the archives.

    The digest and size of a response are of the payload that was read, those of a revisit stand in its header.
    """

    def page(uri: str | None) -> int | None:
        value = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)))

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with opened(path) as stream:
                    for kind, fields, block in records(stream):
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = len(payload) if kind == "response" else int(fields["X-Payload-Length"])
                        rows.append(dict(zip(names, (page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, n, digest, kind, page(fields.get("WARC-Refers-To"))), strict=True)))
                        size += len(block)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # an archive is one unit of work
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark, sf_dir: str) -> DataFrame:
    manifest = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{shared_folder(spark)}/warc")
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
