"""Legacy archive converter: ARC files of either version parsed by their own header lines, rewritten as WARC, read back.

``pack_arc`` writes rows into ARC files (version 1 and 2 in turn), ``parse_arc`` reads the header layout that the file's
version block declares and cuts payloads by their declared lengths, ``convert_arc`` synthesises WARC identifiers,
timestamps, types and digests (and a warcinfo record from the version block), and ``parse_warc`` reads the result back,
checking every digest and length. A record's identifier comes from its file and its place there, so that repeated rows
have different ones. Records with equal payloads of at least ``least`` bytes become revisits of the one with the smallest id.

Files are rows ``(name, data)`` of tables in the shared folder, of about ``FILE_BYTES`` each. Duplicates are found on the
index of ids and digests alone; only each file's own decisions travel to it.

Defined cases: a null payload is empty; a null or odd URL is percent-encoded; of repeated rows with the smallest id all
are responses; a null id comes after every other, and a group of null ids alone is all responses; a file with a broken
header or a wrong length raises ``ValueError``; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.arrow import byte_slices, quoted, texts_of
from seamline.llm.storage import written

FILE_BYTES = 1 << 20
#: The header layouts of the two ARC versions.
LAYOUTS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: The place of the content type in both layouts.
TYPE_AT = 3
STAMP = "20240101000000"
KIND = "text/html"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pack_arc(name: str, version: int, rows: list[tuple[int | None, str | None, bytes]]) -> bytes:
    """An ARC file of ``(id, url, payload)`` rows; the id rides in the URL's fragment."""
    about = f"{version} 0 seamline\n{' '.join(LAYOUTS[version])}\n\n".encode()
    out, at = [], 0

    def add(url: str, kind: str, body: bytes) -> None:
        nonlocal at
        extra = ["200", sha1_base32(body), "-", str(at), name] if version == 2 else []
        block = " ".join([url, "0.0.0.0", STAMP, kind, *extra, str(len(body))]).encode() + b"\n" + body + b"\n"
        out.append(block)
        at += len(block)

    add(f"filedesc://{name}", "text/plain", about)
    for row_id, url, payload in rows:
        add(f"{quote(url or 'unknown:', safe=':/?&=%~+,;@')}#row={'' if row_id is None else row_id}", KIND, payload)
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record after the version block."""
    at, layout = 0, None
    while at < len(data):
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("a header line has no end")
        values = data[at:stop].decode().split(" ")
        size = int(values[-1]) if values[-1].isdigit() else -1
        body = data[stop + 1 : stop + 1 + size] if size >= 0 else b""
        if size < 0 or len(body) < size or data[stop + 1 + size : stop + 2 + size] != b"\n":
            raise ValueError("a declared length is wrong")
        if layout is None:
            lines = body.decode().split("\n")
            version = int(lines[0].split(" ")[0])
            layout = tuple(lines[1].split(" "))
            if not values[0].startswith("filedesc://") or layout != LAYOUTS.get(version):
                raise ValueError("no version block of a known version")
        elif len(values) < len(layout):
            raise ValueError("a header line has the wrong number of fields")
        else:
            # A content type may hold blanks; no other field does.
            after = len(layout) - TYPE_AT - 1
            kind = " ".join(values[TYPE_AT:-after])
            yield dict(zip(layout, [*values[:TYPE_AT], kind, *values[-after:]], strict=True)), body
        at = stop + 2 + size


def _row_of(fields: dict[str, str]) -> tuple[str, int | None]:
    url, _, row = fields["URL"].rpartition("#row=")
    return url, int(row) if row else None


def record_id(name: str, n: int) -> str:
    """The identifier of record ``n`` of an ARC file; -1 is its version block."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#record={n}')}>"


def warc_date(stamp: str) -> str:
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"


def _record(head: list[tuple[str, str]], block: bytes) -> bytes:
    head = [*head, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def convert_arc(name: str, data: bytes, revisits: dict[int, tuple[int, str, int]]) -> bytes:
    """The WARC file of an ARC file; ``revisits`` maps a record's place to the id, file and place of the response it repeats."""
    out = []
    for n, (fields, body) in enumerate(parse_arc(data)):
        date = warc_date(fields["Archive-date"])
        if not n:
            version = f"software: seamline\r\nformat: WARC File Format 1.1\r\nis-part-of: {data[data.find(b'\n') + 1 :].split(b'\n')[0].decode()}\r\n"
            about = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, -1)), ("WARC-Date", date), ("WARC-Filename", warc_name(name)), ("Content-Type", "application/warc-fields")]
            out.append(_record(about, version.encode()))
        url, row = _row_of(fields)
        digest = sha1_base32(body)
        if fields.get("Checksum", digest) != digest:
            raise ValueError("a payload does not match its checksum")
        first = revisits.get(n)
        head = [
            ("WARC-Type", "revisit" if first else "response"),
            ("WARC-Record-ID", record_id(name, n)),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("WARC-IP-Address", fields["IP-address"]),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Seamline-Payload-Length", str(len(body))),
            ("Seamline-Row", "" if row is None else str(row)),
        ]
        if first:
            head += [
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(first[1], first[2])),
                ("Seamline-Refers-To-Row", str(first[0])),
            ]
        else:
            head.append(("Content-Type", fields["Content-type"]))
        out.append(_record(head, b"" if first else body))
    return b"".join(out)


def warc_name(name: str) -> str:
    return name.removesuffix(".arc") + ".warc"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; what does not match its digest or length raises."""
    at = 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n") if stop >= 0 else [""]
        if lines[0] != "WARC/1.1":
            raise ValueError("no record begins here")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        body = data[stop + 4 : stop + 4 + size]
        if len(body) < size or data[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError("a declared length is wrong")
        if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(body)}":
            raise ValueError("a block does not match its digest")
        if fields["WARC-Type"] == "response":
            if fields["WARC-Payload-Digest"] != fields["WARC-Block-Digest"]:
                raise ValueError("a payload does not match its digest")
            if fields["Seamline-Payload-Length"] != str(size):
                raise ValueError("a payload does not have its length")
        yield fields, body
        at = stop + 8 + size


def arc_files(df: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """ARC files ``(name, data)`` of the table's rows."""
    source = df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(url_col)).alias("url"), F.col(quoted(payload_col)).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in byte_slices(batch, "payload", FILE_BYTES):
                name = f"part-{part:06d}-{made:06d}.arc"
                rows = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), [t.encode() for t in texts_of(piece, "payload")], strict=True))
                yield pa.RecordBatch.from_pydict({"name": [name], "data": pa.array([pack_arc(name, 1 + made % 2, rows)], pa.binary())})
                made += 1

    return source.mapInArrow(pack, "name string, data binary")


def arc_index(files: DataFrame) -> DataFrame:
    """``(name, n, id, url, payload_bytes, payload_digest)`` of every record of ARC files."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, n, *reversed(_row_of(f)), len(body), sha1_base32(body)) for n, (f, body) in enumerate(parse_arc(data.as_py()))]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["name", "n", "id", "url", "payload_bytes", "payload_digest"])

    return files.mapInArrow(index, "name string, n int, id long, url string, payload_bytes long, payload_digest string")


def warc_files(arcs: DataFrame, least: int = 0) -> DataFrame:
    """WARC files ``(name, data)`` of ARC files (a table already written)."""
    index = written(arc_index(arcs), "arc-index")
    firsts = (
        index.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "name", "n"))).alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first is not null")
        .select("payload_digest", "payload_bytes", "first")
    )
    # Both sides are read from tables, so that a digest with very many rows can be split.
    revisits = index.select("name", "n", "id", "payload_digest", "payload_bytes").join(written(firsts, "arc-firsts"), ["payload_digest", "payload_bytes"]).where("id is null or id <> first.id")
    per_file = revisits.groupBy("name").agg(F.collect_list(F.struct("n", F.col("first.id").alias("id"), F.col("first.name").alias("file"), F.col("first.n").alias("place"))).alias("revisits"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                known = {r["n"]: (r["id"], r["file"], r["place"]) for r in found.as_py() or []}
                yield pa.RecordBatch.from_pydict({"name": [warc_name(name)], "data": pa.array([convert_arc(name, data.as_py(), known)], pa.binary())})

    return arcs.join(per_file, "name", "left").select("name", "data", "revisits").mapInArrow(convert, "name string, data binary")


def read_warc(files: DataFrame) -> DataFrame:
    """One row for each response and revisit of WARC files; lengths are measured, but for revisits, which have no payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda v: int(v) if v else None
        for batch in batches:
            for data in batch.column("data"):
                records = [(f, len(body)) for f, body in parse_warc(data.as_py()) if f["WARC-Type"] != "warcinfo"]
                heads = [f for f, _ in records]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number(f["Seamline-Row"]) for f in heads], pa.int64()),
                        pa.array([size if f["WARC-Type"] == "response" else int(f["Seamline-Payload-Length"]) for f, size in records], pa.int64()),
                        pa.array([f["WARC-Payload-Digest"].removeprefix("sha1:") for f in heads], pa.string()),
                        pa.array([f["WARC-Type"] for f in heads], pa.string()),
                        pa.array([number(f.get("Seamline-Refers-To-Row")) for f in heads], pa.int64()),
                        pa.array([f["WARC-Record-ID"] for f in heads], pa.string()),
                        pa.array([f["WARC-Date"] for f in heads], pa.string()),
                        pa.array([f["WARC-Target-URI"] for f in heads], pa.string()),
                    ],
                    ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "uri"],
                )

    return files.mapInArrow(read, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, uri string")


def round_trip(df: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """The table written as ARC, converted to WARC, and the WARC records read back. See the module docstring."""
    arcs = written(arc_files(df, id_col, url_col, payload_col), "arc")
    return read_warc(written(warc_files(arcs, least), "warc"))
