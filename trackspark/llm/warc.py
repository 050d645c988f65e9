"""WARC archives: written with an index, read back by coalesced byte ranges.

Every record is a gzip member of its own. A task writes one archive under a name that no other attempt uses and
returns an index row per record (file, offset, length, url, digest); the index is a table, so what a lost or repeated
task left behind is never referred to. Reading sorts the wanted records by place, joins ranges that lie close into one
read, and checks each payload against its digest.

Records with equal payloads of at least ``min_payload`` bytes: the one with the smallest page_id is a response, the
others are revisits that refer to it and carry no payload.

Defined cases: null html is an empty payload; a null url leaves out the target header, control characters in a url are
percent-encoded. Rows of equal page_id and payload are all responses, or all revisits of a smaller id. A null page_id
comes after all others; if a payload has no id at all its rows are responses. An empty table gives no archive and no
rows. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.session import cut_lineage, shared_dir

GAP, READ = 1 << 16, 8 << 20
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORD = "page_id bigint, record_type string, refers_to bigint, url string, digest string, payload binary"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits of ten at a time, then other digits."""
    digest = F.sha1(payload)
    eights = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*eights), _DIGITS, _BASE32)


def with_fate(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to``: what each record will be."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    slim = rows.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), F.octet_length("html").alias("bytes")).distinct()
    slim = cut_lineage(slim)
    firsts = slim.filter(F.col("bytes") >= min_payload).groupBy("d", "bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("held"))
    revisits = slim.join(firsts.filter(F.col("held") > 1), ["d", "bytes"]).filter(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    fate = rows.join(revisits.select("id", "d", "first"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left")
    kind = F.when(F.col("first").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    return fate.select("page_id", "url", "html", "digest", kind.alias("record_type"), F.col("first").alias("refers_to"))


def _clean(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_bytes(page: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers: str | None) -> bytes:
    body = b"" if kind == "revisit" else payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page or ''}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple:
    """``page_id, record_type, refers_to, url, digest, payload`` of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is longer or shorter than it says")
    page = lambda name: (fields.get(name) or "").removeprefix("<urn:page:").removesuffix(">") or None
    payload = None if fields["warc-type"] == "revisit" else rest[:size]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of page {page('warc-record-id')} does not match its digest")
    return page("warc-record-id"), fields["warc-type"], page("warc-refers-to"), fields.get("warc-target-uri"), digest, payload


def _store(folder: str):
    """File system and path of a folder; ``folder`` may be a plain path or a URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                for page, url, html, digest, kind, refers in zip(*[batch[c] for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")]):
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = deflate.compress(record_bytes(page, url, html.encode(), digest, kind, refers)) + deflate.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, page, kind))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(fated: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Writes one archive per task into ``folder`` and returns the index as a table."""
    rows = fated.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "digest", "record_type", F.col("refers_to").cast("string").alias("refers_to"))
    schema = INDEX.replace("page_id bigint", "page_id string")
    return cut_lineage(rows.mapInPandas(_write(folder, level), schema).withColumn("page_id", F.col("page_id").cast("bigint")))


def ranges(rows: list[tuple], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple]]]:
    """Sorted (offset, length, ...) joined into reads: close neighbours share one, up to ``most`` bytes."""
    reads: list[tuple[int, int, list[tuple]]] = []
    for row in rows:
        offset, end = row[0], row[0] + row[1]
        if reads and offset - reads[-1][1] <= gap and end - reads[-1][0] <= most:
            start, stop, held = reads[-1]
            held.append(row)
            reads[-1] = (start, max(stop, end), held)
        else:
            reads.append((offset, end, [row]))
    return reads


def _read(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        source, opened = None, None
        try:
            for batch in batches:
                for name, part in batch.groupby("file", sort=False):
                    if name != opened:
                        if source is not None:
                            source.close()
                        source, opened = store.open_input_file(f"{base}/{name}"), name
                    for start, stop, held in ranges(list(zip(part["offset"], part["length"]))):
                        block = source.read_at(stop - start, start)
                        rows = [parse_record(zlib.decompress(block[o - start : o - start + n], 31)) for o, n in held]
                        yield pd.DataFrame(rows, columns=["page_id", "record_type", "refers_to", "url", "digest", "payload"])
        finally:
            if source is not None:
                source.close()

    return run


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """Records of the index rows in ``selected``; payload is null for revisits."""
    places = selected.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    schema = RECORD.replace("page_id bigint", "page_id string").replace("refers_to bigint", "refers_to string")
    found = places.mapInPandas(_read(folder), schema)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write all pages, read all records back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    What a revisit says of its payload is measured on the response it refers to.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write_archives(with_fate(pages, min_payload), folder)
    back = read_records(index, folder).select(
        "page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    )
    back = cut_lineage(back)
    responses = back.filter(F.col("record_type") == "response")
    targets = responses.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("p")
    ).distinct()
    revisits = back.filter(F.col("record_type") == "revisit").join(targets, ["refers_to", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).union(revisits.select("page_id", F.col("b"), F.col("p"), "record_type", "refers_to")).toDF(*columns)
