"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member per record into archive files of the shared folder.
``build_index`` sorts the captures by reversed-host key, writes them as compressed blocks of
``BLOCK_LINES`` lines, and keeps a sparse directory: the first key of each block, in pages of
``PAGE_BLOCKS`` entries. ``lookup`` finds keys by binary search in the pages' first keys (the only
broadcast, ``MOST_PAGES`` at most), then in a page, then in the block that one range read fetches;
``read_captures`` reads the records by ranges, in file order.

Every task writes files of its own name, and only what a finished task reports is indexed, so lost
executors and repeated tasks leave unreferenced files at worst. Files are reached through
``pyarrow.fs``, which knows local, HDFS and object-store folders.

Records: of equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page id is the response
and the others are revisits of it; all smaller payloads are responses.

Defined cases: a null html is an empty payload. A null url has the key ``-``. Rows without an id are
revisits if an equal payload has one. Rows that repeat the smallest id are all responses. Control
characters in an address are percent-encoded in headers and keys.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.plans.lineage import cut, work_dir
from tokengrove.plans.skew import salted_join
from tokengrove.plans.slices import running

LEAST_REVISIT = 100
BLOCK_LINES, PAGE_BLOCKS = 3000, 256
MOST_PAGES = 1_000_000
#: Gaps below this many bytes are read along, and so many bytes at most at once.
GAP, READ = 64 << 10, 8 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

CAPTURE = "capture string, file string, offset long, length long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def packed(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _header_text(value: str) -> str:
    return "".join(quote(c) if ord(c) < 0x21 or ord(c) == 0x7F else c for c in value)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or with ``refers_to`` a revisit that holds the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_text(url or '-')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[5:5] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, HTTP headers likewise, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    shown = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode("utf-8").split("\r\n")[1:])}
    return {"headers": headers, "http": shown, "payload": payload}


def surt(url: Column) -> Column:
    """Reversed-host key: ``http://www.a.example.com:80/x?y`` is ``com,example,a,www)/x?y``."""
    plain = F.regexp_replace(F.coalesce(url, F.lit("-")), r"[\x00-\x20\x7F]", "%")
    rest = F.regexp_replace(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#:]*)", 1))
    path = F.regexp_replace(rest, r"^[^/?#:]*(:[0-9]*)?", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _shown_id(page_id: Column) -> Column:
    return F.coalesce(page_id.cast("string"), F.lit("-"))


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write the records; returns the captures ``capture, file, offset, length``, as a written table."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    repeated = (
        rows.where(F.octet_length("html") >= LEAST_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    decided = salted_join(rows, repeated, ["digest"], "left", ["page_id", "url"]).select(
        "page_id",
        "url",
        "html",
        "digest",
        F.when(F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)), F.col("first")).alias("refers_to"),
        F.concat(surt(F.col("url")), F.lit("\t"), _shown_id(F.col("page_id"))).alias("capture"),
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                placed = []
                for page_id, url, html, digest, refers_to, capture in zip(
                    batch["page_id"], batch["url"], batch["html"], batch["digest"], batch["refers_to"], batch["capture"]
                ):
                    if out is None:
                        system.create_dir(path, recursive=True)
                        name, offset = f"{uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    page_id = None if pd.isna(page_id) else int(page_id)
                    refers_to = None if pd.isna(refers_to) else int(refers_to)
                    data = packed(record_bytes(page_id, url, html.encode("utf-8", "replace"), digest, refers_to))
                    out.write(data)
                    placed.append((capture, name, offset, len(data)))
                    offset += len(data)
                yield pd.DataFrame(placed, columns=["capture", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return cut(decided.mapInPandas(write, CAPTURE))


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the sorted blocks; returns the directory, ``page, first_key, entries``, one row per page."""
    keyed = captures.select(
        F.concat_ws("\t", "capture", "file", F.col("offset").cast("string"), F.col("length").cast("string")).alias("line")
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        out, name, offset, held = None, "", 0, []
        try:
            for batch in batches:
                held += batch["line"].tolist()
                blocks = []
                while len(held) >= BLOCK_LINES:
                    blocks.append(held[:BLOCK_LINES])
                    held = held[BLOCK_LINES:]
                for lines in blocks:
                    if out is None:
                        system.create_dir(path, recursive=True)
                        name = f"{uuid4().hex}.cdx.gz"
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    data = packed("\n".join(lines).encode())
                    out.write(data)
                    yield pd.DataFrame([(lines[0], name, offset, len(data))], columns=["first_key", "file", "offset", "length"])
                    offset += len(data)
            if held:
                if out is None:
                    system.create_dir(path, recursive=True)
                    name = f"{uuid4().hex}.cdx.gz"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                data = packed("\n".join(held).encode())
                out.write(data)
                yield pd.DataFrame([(held[0], name, offset, len(data))], columns=["first_key", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    blocks = cut(
        keyed.repartitionByRange("line")
        .sortWithinPartitions("line")
        .mapInPandas(write, "first_key string, file string, offset long, length long")
    )
    ranked = running(blocks, [], [F.col("first_key")], {"_rank": F.lit(1)})
    return cut(
        ranked.groupBy(F.floor(F.col("_rank") / F.lit(PAGE_BLOCKS)).cast("long").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("first_key", "file", "offset", "length"))).alias("entries"))
        .select("page", F.col("entries")[0]["first_key"].alias("first_key"), "entries")
    )


def _span(keys: list[str], prefix: str) -> tuple[int, int]:
    """First and last of the sorted runs, each known by its first key, that may hold the prefix."""
    low = max(0, bisect_left(keys, prefix) - 1)
    return low, max(low, bisect_left(keys, prefix[:-1] + "\n") - 1)


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Captures of ``key`` (a reversed-host key, or one with a tab and an id), however many they are.

    Returns ``capture, file, offset, length``.
    """
    tops = directory.select("page", "first_key").limit(MOST_PAGES + 1).toPandas().sort_values("page")
    if len(tops) > MOST_PAGES:
        raise ValueError("the directory has too many pages: raise PAGE_BLOCKS")
    first_keys = keys.sparkSession.sparkContext.broadcast(tops["first_key"].tolist())
    asked = keys.select(F.concat("key", F.lit("\t")).alias("prefix")).distinct()
    if not len(tops):
        return keys.sparkSession.createDataFrame([], CAPTURE)

    @F.pandas_udf("low long, high long")
    def pages_of(prefixes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_span(first_keys.value, p) for p in prefixes], columns=["low", "high"])

    @F.pandas_udf("low long, high long")
    def blocks_of(prefixes: pd.Series, heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_span(list(h), p) for p, h in zip(prefixes, heads)], columns=["low", "high"])

    paged = asked.withColumn("_s", pages_of("prefix")).select(
        "prefix", F.explode(F.sequence("_s.low", "_s.high")).alias("page")
    )
    entered = salted_join(paged, directory.select("page", "entries"), ["page"], "inner", ["prefix"])
    found = (
        entered.withColumn("_s", blocks_of("prefix", F.col("entries.first_key")))
        .select(
            "prefix",
            F.explode(F.slice("entries", (F.col("_s.low") + 1).cast("int"), (F.col("_s.high") - F.col("_s.low") + 1).cast("int"))).alias("b"),
        )
        .select("prefix", F.col("b.file").alias("block_file"), F.col("b.offset").alias("at"), F.col("b.length").alias("size"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        block, lines, name, source = None, [], None, None
        for batch in batches:
            hits = []
            for prefix, file, at, size in zip(batch["prefix"], batch["block_file"], batch["at"], batch["size"]):
                if block != (file, at):
                    if name != file:
                        name, source = file, system.open_input_file(f"{path}/{file}")
                    block = (file, at)
                    lines = zlib.decompress(source.read_at(int(size), int(at)), 31).decode().split("\n")
                for line in lines[bisect_left(lines, prefix) :]:
                    if not line.startswith(prefix):
                        break
                    *capture, where, offset, length = line.split("\t")
                    hits.append(("\t".join(capture), where, int(offset), int(length)))
            yield pd.DataFrame(hits, columns=["capture", "file", "offset", "length"])

    return (
        found.repartition("block_file", "at").sortWithinPartitions("block_file", "at", "prefix").mapInPandas(search, CAPTURE)
    )


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """The records as ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    The digest of a response is taken from the bytes read; that of a revisit is what its record states.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        name, source = None, None
        for batch in batches:
            files = batch["file"].to_numpy()
            offsets, lengths = batch["offset"].to_numpy(np.int64), batch["length"].to_numpy(np.int64)
            start = 0
            while start < len(batch):
                stop = start + 1
                while (
                    stop < len(batch)
                    and files[stop] == files[start]
                    and 0 <= offsets[stop] - (offsets[stop - 1] + lengths[stop - 1]) <= GAP
                    and offsets[stop] + lengths[stop] - offsets[start] <= READ
                ):
                    stop += 1
                if name != files[start]:
                    name, source = files[start], system.open_input_file(f"{path}/{files[start]}")
                base = int(offsets[start])
                data = source.read_at(int(offsets[stop - 1] + lengths[stop - 1]) - base, base)
                rows = []
                for i in range(start, stop):
                    at = int(offsets[i]) - base
                    record = parse_record(zlib.decompress(data[at : at + int(lengths[i])], 31))
                    headers, payload = record["headers"], record["payload"]
                    named = headers["warc-record-id"][len("<urn:page:") : -1]
                    stated = headers["warc-payload-digest"].removeprefix("sha256:")
                    if headers["warc-type"] == "response":
                        digest, refers_to, size = hashlib.sha256(payload).hexdigest(), None, len(payload)
                        if digest != stated:
                            raise ValueError(f"the payload of {named} is damaged")
                    else:
                        digest, size = stated, int(record["http"]["content-length"])
                        refers_to = int(headers["warc-refers-to"][len("<urn:page:") : -1])
                    rows.append(
                        (int(named) if named else None, headers["warc-target-uri"], payload, size, digest, headers["warc-type"], refers_to)
                    )
                yield pd.DataFrame(
                    rows,
                    columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                ).astype({"page_id": "Int64", "refers_to": "Int64"})
                start = stop

    return (
        captures.repartitionByRange("file", "offset")
        .sortWithinPartitions("file", "offset")
        .mapInPandas(
            fetch,
            "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long",
        )
    )


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Archive all pages, index the captures, look every page up and read its record back."""
    base = work_dir(pages.sparkSession, "warc")
    captures = write_archive(pages, f"{base}/archive", id_col, url_col, html_col)
    directory = build_index(captures, f"{base}/index")
    keys = pages.select(
        F.concat(surt(F.col(url_col)), F.lit("\t"), _shown_id(F.col(id_col).cast("long"))).alias("key")
    )
    found = lookup(keys, directory, f"{base}/index")
    return read_captures(found, f"{base}/archive").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE = """
SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha256(p) AS payload_digest,
  CASE WHEN strlen(p) >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(p) >= 100 AND page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, COALESCE(html, '') AS p, min(page_id) OVER (PARTITION BY COALESCE(html, '')) AS first FROM pages)
"""
