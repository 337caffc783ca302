"""WARC archives: writing, reading, and the assembly of transactions.

``write_archive`` writes a request, a response (or revisit) and a metadata record for each page, each
a gzip member, linked by WARC-Concurrent-To. ``read_archive`` parses files into one row a
record. ``assemble`` joins the records of a capture through their
concurrent-to identifiers and gives one nested row for each response or revisit.

Of pages with equal payloads of at least ``min_bytes`` the one with the largest id is written as
response, the others as revisits that refer to it. Pages are compared by length and SHA-1.
The pages are read once and never shuffled: each task writes its pages as responses and notes where each
lies; from the notes alone the revisits are found, and files that hold any are copied with
these records replaced, without unpacking the others.

Defined results: a null payload is empty; a null url leaves the target URI out; a null id leaves the
page id out (it sorts below all ids); of repeated rows one is the response;
an empty table writes no file; other columns are not archived. A record may name several others:
a request or metadata record belongs to every response or revisit that it names, that names it, or
that a record which it names (or which names it) belongs to; if there is none, it belongs to no capture.
A file that can't be read to its end gives the records before that place and one row of type
``unreadable``, with the path as its target URI.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import map_arrow
from .common import Scratch, open_uri, quoted, remove_uri, slices

MANIFEST = "path string, n_records long, n_bytes long"
#: Where a page's records lie: ``n`` numbers the pages of a file.
PLACE = "path string, n long, at long, bytes long, id long, url string, digest binary, size long"
#: Files that one task copies or reads, from so many files on.
FILE_TASKS = 20_000
RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, "
    "content_type string, page_id long, payload binary, payload_bytes long, payload_sha1 string"
)
FILE_BYTES = 32 << 20
SPACE = uuid.UUID("6f0c2c8e-35a1-4e43-9f0b-5a3d6f1f2b77")
DATE = "2024-01-01T00:00:00Z"


def record_urn(kind: str, tag: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}-{tag}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + press.flush()


def clean(value: str) -> str:
    """A header value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def tag_of(path: str, n: int) -> str:
    """Names a page by its place in the first file it is written to."""
    return f"{path.rsplit('/', 1)[1]}-{n}"


def page_records(page_id: int | None, url: str | None, body: bytes | None, tag: str, refers_to: str | None = None, sha1: bytes = b"") -> list[bytes]:
    """The three records of a page; a revisit (of the page ``refers_to``) has a digest and no body."""
    main = record_urn("response", tag)
    common = [("WARC-Date", DATE)] + ([("WARC-Target-URI", clean(url))] if url is not None else [])
    digest = "sha1:" + base64.b32encode(sha1).decode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    kind = [("WARC-Type", "response")]
    if refers_to is not None:
        kind = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_urn("response", refers_to))]
    http = ("Content-Type", "application/http")
    answer = record([*kind, ("WARC-Record-ID", main), *common, ("WARC-Payload-Digest", digest), http], head if refers_to is not None else head + body)
    linked = [*common, ("WARC-Concurrent-To", main)]
    ask = record([("WARC-Type", "request"), ("WARC-Record-ID", record_urn("request", tag)), *linked, http], b"GET / HTTP/1.1\r\nUser-Agent: archive\r\n\r\n")
    fields = b"" if page_id is None else f"page-id: {page_id}\r\n".encode()
    note = record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_urn("metadata", tag)), *linked, ("Content-Type", "application/warc-fields")], fields)
    return [ask, answer, note]


def write_pages(rows: DataFrame, folder: str, file_bytes: int) -> DataFrame:
    """Write (id, url, body) as responses; a PLACE row for each page. A file is closed at ``file_bytes``."""
    schema = T._parse_datatype_string(PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, task = to_arrow_schema(schema), TaskContext.get()
        out, path, n, at, part, made = None, "", 0, 0, 0, []

        def entry() -> pa.RecordBatch:
            columns, made[:] = list(zip(*made, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(columns)], names=schema.fieldNames())

        for batch in batches:
            for piece in slices(batch, 256, 4 << 20):
                for page_id, url, body in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if out is None:
                        path, n, at = f"{folder}/pages-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.warc.gz", 0, 0
                        out, part = open_uri(path, "wb"), part + 1
                    sha1 = hashlib.sha1(body).digest()
                    data = b"".join(page_records(page_id, url, body, tag_of(path, n), sha1=sha1))
                    out.write(data)
                    made.append((path, n, at, len(data), page_id, url, sha1, len(body)))
                    n, at = n + 1, at + len(data)
                    if at >= file_bytes:
                        out.close()
                        out = None
                if made and (out is None or len(made) >= 4096):
                    yield entry()
        if out is not None:
            out.close()
        if made:
            yield entry()

    return map_arrow(rows, run, schema)


def replace_pages(files: DataFrame) -> DataFrame:
    """Copy each file (path, pages) with the listed pages as revisits; (old, path, n_bytes)."""
    schema = T._parse_datatype_string("old string, path string, n_bytes long")

    def copied(path: str, pages: list[dict]) -> tuple[str, str, int]:
        from pyspark import TaskContext

        new, written, at = path.replace(".warc.gz", f"-{TaskContext.get().taskAttemptId()}-r.warc.gz"), 0, 0
        with open_uri(path, "rb") as source, open_uri(new, "wb") as out:

            def through(end: int) -> int:
                done = 0
                while done < end - at and (data := source.read(min(1 << 20, end - at - done))):
                    out.write(data)
                    done += len(data)
                return done

            for x in sorted(pages, key=lambda x: x["at"]):
                written += through(x["at"])
                for data in page_records(x["id"], x["url"], None, tag_of(path, x["n"]), tag_of(x["first_path"], x["first_n"]), x["digest"]):
                    out.write(data)
                    written += len(data)
                at = x["at"] + x["bytes"]
                source.seek(at)
            written += through(1 << 62)
        return path, new, written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = copied(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=schema.fieldNames())

    return map_arrow(files, run, schema)


def delete_files(paths: DataFrame) -> int:
    """Delete the files of a one-column table, from the executors; those that are gone already are no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                remove_uri(path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return map_arrow(paths, run, "n long").agg(F.sum("n")).first()[0] or 0


def write_archive(
    df: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 1000,
    scratch: Scratch | None = None,
    folder: str | None = None,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the archives; the manifest, one row a file."""
    scratch = scratch or Scratch(df.sparkSession, "warc")
    rows = df.select(
        F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).cast("string").alias("url"), F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")).cast("binary").alias("body")
    )
    places = scratch.keep(write_pages(rows, folder or scratch.path("files"), file_bytes), "places")
    large = places.where(F.col("size") >= min_bytes)
    groups = large.groupBy("digest", "size").agg(F.max(F.struct("id", "path", "n")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = scratch.keep(groups.select("digest", "size", F.col("first.path").alias("first_path"), F.col("first.n").alias("first_n")), "groups")
    revisits = large.join(groups, ["digest", "size"]).where("path <> first_path or n <> first_n")
    # a file holds a bounded number of pages
    files = revisits.groupBy("path").agg(F.collect_list(F.struct("n", "at", "bytes", "id", "url", "digest", "first_path", "first_n")).alias("pages"))
    files = scratch.keep(files, "revisits")
    copies = scratch.keep(replace_pages(files.repartition(max(1, min(FILE_TASKS, files.count())))), "copies")
    whole = places.groupBy("path").agg((3 * F.count("*")).alias("n_records"), F.sum("bytes").alias("n_bytes"))
    whole = whole.join(copies.select(F.col("old").alias("path"), F.col("path").alias("new"), F.col("n_bytes").alias("new_bytes")), "path", "left")
    manifest = scratch.keep(whole.select(F.coalesce("new", "path").alias("path"), "n_records", F.coalesce("new_bytes", "n_bytes").alias("n_bytes")), "manifest")
    delete_files(copies.select("old"))
    for name in ("places", "groups", "revisits", "copies"):
        scratch.drop(name)
    return manifest


def parse_file(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(values of each lower-cased header, block) of each record."""
    with gzip.GzipFile(fileobj=stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record: {line[:40]!r}")
            headers: dict[str, list[str]] = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode("utf-8").partition(":")
                headers.setdefault(k.strip().lower(), []).append(v.strip())
            size = int(headers.get("content-length", ["0"])[0])
            block = f.read(size)
            if len(block) < size:
                raise EOFError("a record is cut off")
            yield headers, block


def record_row(headers: dict[str, list[str]], block: bytes) -> tuple:
    def get(name: str, missing: str | None = None) -> str | None:
        return headers.get(name, [missing])[0]

    kind = get("warc-type")
    payload, sha1, page_id = None, None, None
    if get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif kind == "metadata":
        fields = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
        page_id = int(fields["page-id"]) if re.fullmatch(r"-?\d{1,18}", fields.get("page-id", "")) else None
    if kind == "revisit":  # the payload is that of the record it refers to
        algorithm, _, value = get("warc-payload-digest", "").partition(":")
        payload, sha1 = None, base64.b32decode(value).hex() if algorithm == "sha1" else None
    elif payload is not None:
        sha1 = hashlib.sha1(payload).hexdigest()
    return (
        get("warc-record-id"), kind, headers.get("warc-concurrent-to"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"),
        get("content-type"), page_id, payload, None if payload is None else len(payload), sha1,
    )


def file_rows(path: str) -> Iterator[tuple]:
    """The records of a file; if it can't be read to its end, a last row says so."""
    try:
        with open_uri(path, "rb") as f:
            for headers, block in parse_file(f):
                yield record_row(headers, block)
    except (EOFError, ValueError, zlib.error, gzip.BadGzipFile):
        yield (None, "unreadable", None, None, path, None, None, None, None, None, None)


def read_archive(manifest: DataFrame) -> DataFrame:
    """One row a record of the manifest's files."""
    schema = T._parse_datatype_string(RECORD)
    files = max(1, min(FILE_TASKS, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows, strict=True))], names=schema.fieldNames())

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in file_rows(path):
                    rows.append(row)
                    size += row[9] or 0
                    if len(rows) >= 512 or size >= 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return map_arrow(manifest.select("path").repartition(files), run, schema)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One nested row for each capture: its response or revisit, requests and metadata.

    Links are read both ways, over one record between at most. Only identifiers are joined; the payload moves once, and not at all if ``payload`` is false.
    """
    shown = [c for c in T._parse_datatype_string(RECORD).fieldNames() if payload or c != "payload"]
    is_main = F.col("type").isin("response", "revisit", "resource")
    mains, sides = records.where(is_main), records.where(F.col("type").isin("request", "metadata"))
    ids = mains.select(F.col("record_id").alias("to"), F.lit(True).alias("is_main"))
    named = sides.select(F.col("record_id").alias("side"), F.explode("concurrent_to").alias("to")).join(ids, "to", "left")
    direct = named.where("is_main").select("side", F.col("to").alias("of"))
    direct = direct.unionByName(mains.select(F.explode("concurrent_to").alias("side"), F.col("record_id").alias("of")))
    # a side that reaches no capture itself, through another side that it names or that names it
    others = named.where("is_main is null").select(F.array(F.struct("side", F.col("to").alias("via")), F.struct(F.col("to").alias("side"), F.col("side").alias("via"))).alias("both"))
    others = others.select(F.explode("both").alias("e")).select("e.side", "e.via").join(direct.select("side").distinct(), "side", "left_anti")
    far = others.join(direct.select(F.col("side").alias("via"), "of"), "via").select("side", "of")
    links = direct.unionByName(far).distinct()
    told = sides.select("record_id", "type", "target_uri", "date", "content_type", "page_id", "payload_bytes").join(links, F.col("record_id") == F.col("side"))
    kept = F.struct("record_id", "target_uri", "date", "content_type", "page_id", "payload_bytes")
    gathered = told.groupBy("of").agg(
        F.sort_array(F.collect_list(F.when(F.col("type") == "request", kept))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", kept))).alias("metadata"),
        F.max("page_id").alias("page_id"),
    )
    main = mains.select(F.col("record_id").alias("of"), F.struct(*shown).alias("main"))
    return main.join(gathered, "of", "left").select(F.col("of").alias("capture_id"), F.col("main").alias("response"), "requests", "metadata", "page_id")
