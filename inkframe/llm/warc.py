"""WARC archives: write captures as records, read archives back, assemble the records of each capture.

A capture is a request, a response (or a revisit of an earlier response with the same payload) and a metadata
record. Request and metadata name the response or revisit by WARC-Concurrent-To; transaction assembly joins the
records through these ids into one nested row. An archive is a sequence of gzip members, one per record; the query
writes each as a .warc.gz file to the shared folder, and reads the files.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, object_opener, parallelism, slices, table, tidy, uri_of, write_objects

ARCHIVE_BYTES = 4 << 20  # an archive is closed once it is as large as that
SALTS = 64
RECORD = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, rid: str, uri: str, block: bytes, **more: str) -> bytes:
    """One record as a gzip member."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": uri, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def _members(archive: bytes):
    """Uncompressed gzip members, in time and memory by the archive's size: what a member leaves of a piece is read again."""
    view, at = memoryview(archive), 0
    while view[at : at + 2] == b"\x1f\x8b":
        z, data, step = zlib.decompressobj(31), [], 1024
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            data.append(z.decompress(view[at : at + step]))
            at, step = min(at + step, len(view)), step * 2
        at -= len(z.unused_data)
        yield b"".join(data)


def records(archive: bytes):
    """(fields, block) of each record of an archive, gzip or plain."""
    for member in _members(archive) if archive[:2] == b"\x1f\x8b" else [archive]:
        at = 0
        while at < len(member):
            end = member.index(b"\r\n\r\n", at)
            version, *lines = member[at:end].decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(fields["content-length"])
            if end + 4 + size > len(member):
                raise ValueError("the archive ends within a record")
            yield fields, member[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def write_archives(pages: DataFrame, keep: Scratch, min_revisit: int = 0) -> DataFrame:
    """Archives (archive binary), for common.write_objects, of pages (page_id, url, html, anything else).

    Of rows with one payload of at least min_revisit bytes, that with the smallest page_id (null last), and of these
    with the smallest URL (null last), is the response and the rest are revisits of it; smaller payloads are all
    responses. Each row is a capture of its own, with ids of its own, rows that repeat page_id, URL and payload
    included. A null html is an empty payload, a null URL an empty one; an empty table gives no archives.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    src = src.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    # Rows of a payload are dealt over salts, and numbered within them; the least of all rows is number 1 of its salt.
    rank = F.struct(F.col("page_id").isNull().alias("no_page"), "page_id", F.col("url").isNull().alias("no_url"), "url", "salt")
    repeated = src.where(F.octet_length("html") >= min_revisit).groupBy("sha").agg(F.min(rank).alias("first"), F.count("*").alias("c")).where("c > 1")
    repeated = keep.save(repeated.select("sha", "first"), "payloads").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    order = Window.partitionBy("sha", "salt").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last())
    out = src.withColumn("rank", rank).withColumn("n", F.row_number().over(order)).join(repeated, ["sha", "salt"], "left")
    mine = F.concat_ws("-", "sha", F.col("salt").cast("string"), F.col("n").cast("string"))
    later = F.col("first").isNotNull() & ((F.col("rank") != F.col("first")) | (F.col("n") > 1))
    first = F.when(later, F.concat_ws("-", "sha", F.col("first.salt").cast("string"), F.lit("1")))
    out = out.select("page_id", "url", "html", mine.alias("mine"), first.alias("refers"), F.col("first.page_id").alias("of"))

    @tidy
    def run(it):
        own, size = [], 0
        for b in slices(it):
            for page, url, html, mine, refers, of in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "mine", "refers", "of")), strict=True):
                payload, uri = html.encode("utf-8", "replace"), url or ""
                # An id holds the page and the row's number among those of its payload.
                rid = lambda kind, page=page, mine=mine: f"urn:inkframe:{kind}:{'null' if page is None else page}:{mine}"
                kind = "revisit" if refers else "response"
                main, more = rid(kind), {"WARC_Payload_Digest": "sha1:" + digest(payload)}
                if refers:
                    more |= {"WARC_Refers_To": f"<{rid('response', of, refers)}>", "WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                side = {"WARC_Concurrent_To": f"<{main}>"}
                own.append(record("request", rid("request"), uri, b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request", **side))
                own.append(record(kind, main, uri, http + payload, Content_Type="application/http; msgtype=response", **more))
                own.append(record("metadata", rid("metadata"), uri, f"payload-bytes: {len(payload)}\r\n".encode(), Content_Type="application/warc-fields", **side))
                size += sum(map(len, own[-3:]))
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["archive"])
                    own, size = [], 0
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(own)], pa.binary())], ["archive"])

    return out.mapInArrow(run, "archive binary")


def read_archives(archives: DataFrame, payloads: bool = True, uri: str | None = None) -> DataFrame:
    """A row per record: RECORD's columns and, if asked for, the payload (of HTTP records: what follows the HTTP header).

    archives (archive binary), or (path) of files in the folder uri.
    """

    @tidy
    def run(it):
        read = object_opener(uri) if uri else None
        names = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "payload_digest", "payload_bytes", *(["payload"] if payloads else [])]
        for b in it:
            for archive in b.column("path" if uri else "archive"):
                rows = []
                for f, block in records(read(archive.as_py()) if uri else archive.as_py()):
                    if f.get("content-type", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    bare = lambda k: f[k].strip("<>") if k in f else None  # noqa: E731, B023
                    http = f["warc-type"] in ("response", "revisit")
                    if http and f.get("warc-payload-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
                        raise ValueError(f"the payload of {f['warc-record-id']} is damaged")
                    rows.append((bare("warc-record-id"), f["warc-type"], bare("warc-concurrent-to"), bare("warc-refers-to"), f.get("warc-target-uri"), digest(block) if http else None, len(block), *([block] if payloads else [])))
                kinds = [pa.string()] * 6 + [pa.int64()] + [pa.binary()] * payloads
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 1000]], kind) for k, kind in enumerate(kinds)], names)

    return archives.mapInArrow(run, RECORD + ", payload binary" * payloads)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture (capture, main, requests, metadata): records joined through their concurrent-to ids.

    A capture is named by its response or revisit. Request and metadata records whose partner is missing form a
    capture without main. Repeated captures (equal records) stay as many rows.
    """
    body = F.struct(*[F.col(c) for c in rows.columns])
    main = rows.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture"), body.alias("main"))
    side = rows.where("type NOT IN ('response', 'revisit')").select(F.coalesce("concurrent_to", "record_id").alias("capture"), body.alias("r"))
    side = side.dropDuplicates(["capture", "r"]).groupBy("capture").agg(F.collect_list("r").alias("r"))
    pick = lambda kind: F.expr(f"coalesce(filter(r, x -> x.type = '{kind}'), array())")
    return main.join(side, "capture", "full_outer").select("capture", "main", pick("request").alias("requests"), pick("metadata").alias("metadata"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to .warc.gz files, which stay, read back from them and assembled: a row per page.

    Payload sizes and digests are those of the payloads read back. A revisit's refers_to is the page_id of its
    response; null, as the response's page_id then is, where no page of that payload has one.
    """
    keep = Scratch(spark, "warc")
    folder = uri_of(keep.path("files"))
    files = write_objects(write_archives(table(spark, sf_dir, "pages"), keep), "archive", folder, ".warc.gz")
    files = files.select("path").repartition(parallelism(spark))  # rows are small and what they name is large
    rows = keep.save(read_archives(files, payloads=False, uri=folder), "records")
    keep.drop("payloads")
    captures = assemble(rows).where("main IS NOT NULL")
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[3] AS bigint)")
    out = captures.select(
        number("main.record_id").alias("page_id"),
        F.col("main.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        number("main.refers_to").alias("refers_to"),
    )
    out = keep.save(out, "pages")
    keep.drop("records")
    return out
