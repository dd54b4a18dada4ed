"""WARC archives: written shard by shard with an index, read back through the index by coalesced byte ranges.

Writing. Each page becomes one record, a gzip member of its own. Of the pages with one payload, that with the
largest page_id (ties: the later in the table's files; null ids last) is a response that holds it; the others are
revisits that name it. Payloads under `least` bytes are always responses. Who is who is settled on digests alone:
partial maxima by digest, then an equi-join that adaptive execution splits where a payload is hot. The pages are
then dealt to shards by position, so no key gathers in a task. A shard task writes its archive through the file
system of the shared folder, under a name of its own attempt, and yields index rows; the index is written as a
table first, and only archives that it names are ever read: what a lost attempt left behind is never seen.

Reading. Index rows are grouped by archive and sorted by offset; ranges less than `gap` bytes apart are read in
one request of at most `most` bytes (a larger record alone); every record is parsed and its digest verified.

A row is known by its place: file and row number where the pages are a plain scan of Parquet files, so that every scan
sees one numbering; other inputs are written once with numbers. The index's rows are counted against the pages.

A null html is the empty payload, and pages of any length are whole records. Repeated rows and ids are records of their
own, with record ids that tell them apart. Null ids are kept. An empty table gives no archives and no rows. Other columns
of the pages are left out. A URL that no header line can hold is written with its bytes escaped, and read as it was.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.llm.common import gone_at_exit, map_batches, shared_dir, written

INDEX = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long, payload_bytes long"
SHARD_BYTES = 256 << 20


#: Says that the target's bytes, its own percent signs among them, are escaped.
ESCAPED = "X-Target-Escaped"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _payload(html: str | None) -> bytes:
    return (html or "").encode("utf-8", "surrogatepass")


Place = tuple[int, int]  # file and row


def _name(page_id: int | None, place: Place) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{place[0] & (1 << 64) - 1:x}-{place[1]}>"


def _page(name: str) -> int | None:
    inner = name.strip("<>").split(":")[2]
    return None if inner == "none" else int(inner)


def record(page_id: int | None, place: Place, url: str | None, payload: bytes, digest: str, response: tuple[int | None, Place] | None) -> bytes:
    """One WARC/1.1 record. A revisit names its response (page id and place) and holds only the HTTP header block, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = url or ""
    plain = url.isascii() and url.isprintable() and " " not in url
    target = url if plain else quote(url.encode("utf-8", "surrogatepass"), safe=":/?#[]@!$&'()*+,;=")
    revisit = response is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name(page_id, place)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if not plain:
        head.append(f"{ESCAPED}: utf-8")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(*response)}"]
    body = http if revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI", "")
    if ESCAPED in fields:
        url = unquote_to_bytes(url).decode("utf-8", "surrogatepass")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def scanned(df: DataFrame) -> bool:
    """Is df a plain scan of Parquet files, so that its rows have one place in them?"""
    if "_metadata" in df.columns:
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if not plan.nodeName().startswith(("LogicalRelation", "Relation")):
        return False
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


def write_archives(pages: DataFrame, least: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the archives of pages (page_id, url, html) and returns their index, a written table."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    gone_at_exit(spark, folder)

    def digests():
        def fn(batch: pa.RecordBatch) -> dict:
            raw = [_payload(x) for x in batch.column(3).to_pylist()]
            return {"file": batch.column(0), "row": batch.column(1), "page_id": batch.column(2), "digest": [digest_of(x) for x in raw], "n": [len(x) for x in raw]}

        return fn

    own = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    if scanned(pages):
        placed = pages.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), *own)
    else:
        placed = written(pages.select(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"), *own), "pages")
    marks = written(map_batches(placed.select("file", "row", "page_id", "html"), "file long, row long, page_id long, digest string, n long", digests), "digests")
    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    # structs order nulls first, so that null ids lose
    best = marks.filter(F.col("n") >= least).groupBy("digest").agg(F.max(F.struct("page_id", "file", "row")).alias("best"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "best")
    other = F.col("best").isNotNull() & ((F.col("best.file") != F.col("file")) | (F.col("best.row") != F.col("row")))
    said = marks.join(best, "digest", "left").select("file", "row", "digest", F.when((F.col("n") >= least) & other, F.col("best")).alias("response"))
    shards = max(1, -(-int(total["b"]) // shard_bytes), min(int(total["n"]), spark.sparkContext.defaultParallelism))
    shard = F.pmod(F.xxhash64("file", "row"), F.lit(shards)).cast("int").alias("shard")
    # both sides are dealt by the shard alone, so the join needs no further exchange and pages move once
    dealt = placed.select(shard, "*").repartition(shards, "shard").join(said.select(shard, "*").repartition(shards, "shard"), ["shard", "file", "row"])
    dealt = dealt.select("shard", "page_id", "file", "row", "url", "html", "digest", F.col("response").isNotNull().alias("revisit"), "response.page_id", "response.file", "response.row").toDF(
        "shard", "page_id", "file", "row", "url", "html", "digest", "revisit", "refers_to", "refers_file", "refers_row"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows, sorted by shard; each shard is an archive."""
        fs, top = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(top, recursive=True)
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])
        shard, out, at, name = None, None, 0, ""
        try:
            for batch in batches:
                rows: list[tuple] = []
                for row in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                    if row[0] != shard:
                        if out is not None:
                            out.close()
                        shard, at, name = row[0], 0, f"{row[0]:06d}-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{top}/{name}", compression=None, buffer_size=1 << 20)
                    _, page_id, file, number, url, html, digest, revisit, refers, *there = row
                    payload = _payload(html)
                    press = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = press.compress(record(page_id, (file, number), url, payload, digest, (refers, tuple(there)) if revisit else None)) + press.flush()
                    out.write(raw)
                    rows.append((name, at, len(raw), page_id, url, digest, "revisit" if revisit else "response", refers, len(payload)))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
        finally:
            if out is not None:
                out.close()

    index = dealt.sortWithinPartitions("shard", F.col("page_id")).mapInArrow(write, INDEX)
    index = written(index, "warc-index")
    if (rows := index.count()) != total["n"]:
        raise RuntimeError(f"{rows} records of {total['n']} pages")
    return index.withColumn("folder", F.lit(folder))


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) coalesced to (start, end, members): reads that skip at most `gap` bytes between two members."""
    start = end = None
    members: list[tuple[int, int]] = []
    for offset, length in rows:
        if members and (offset - end > gap or offset + length - start > most):
            yield start, end, members
            members = []
        if not members:
            start, end = offset, offset
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield start, end, members


PARSED = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(index: DataFrame, payloads: bool = False, gap: int = 64 << 10, most: int = 16 << 20, spread: int | None = None) -> DataFrame:
    """The records that the index rows select: fields as in `parse`; with payloads also html. Each archive is read by one task in order; archives are dealt to `spread` tasks."""
    schema = PARSED + (", html string" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = where = opened = None
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payloads
        try:
            for batch in batches:
                folders, archives, offsets, lengths = (batch.column(i).to_pylist() for i in range(4))
                i = 0
                while i < len(archives):
                    j = i
                    while j < len(archives) and (folders[j], archives[j]) == (folders[i], archives[i]):
                        j += 1
                    if (folders[i], archives[i]) != where:
                        if opened is not None:
                            opened.close()
                        where = (folders[i], archives[i])
                        fs, top = pa.fs.FileSystem.from_uri(folders[i])
                        opened = fs.open_input_file(f"{top}/{archives[i]}")
                    for start, end, members in ranges(list(zip(offsets[i:j], lengths[i:j], strict=True)), gap, most):
                        opened.seek(start)
                        blob = opened.read(end - start)
                        found = []
                        for offset, length in members:
                            got = parse(zlib.decompress(blob[offset - start : offset - start + length], 31))
                            if payloads:
                                got["html"] = None if got["payload"] is None else got["payload"].decode("utf-8", "surrogatepass")
                            found.append(got)
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], k) for n, k in zip(names, kinds, strict=True)], names=names)
                    i = j
        finally:
            if opened is not None:
                opened.close()

    spread = spread or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return index.select("folder", "archive", "offset", "length").repartition(spread, "folder", "archive").sortWithinPartitions("folder", "archive", "offset").mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Per page the fields of its record as read back from the archives."""
    return read_records(write_archives(pages, least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
