"""Operator 13, WARC: archives without repeated payloads, by revisit resolution.

Only headers are shuffled by payload digest: of the records with one digest the smallest id is the
original response, the others become revisits of it.  The few revisits (id, original) are joined back to
the payload rows, and every task writes its archive files: a response record holds the page in an HTTP
response, a revisit record only headers that name the original and the digest.  Reading joins revisits to
their originals by digest and gives every record its payload back, so archives can also be written anew
(``deduplicated``): old revisits are resolved first, then all records are judged afresh under new headers.

Files.  Spark's text writer puts a separator after each row; with CRLF CRLF that is the end of a WARC
record, so a row is a record and the files are plain WARC 1.1 in one gzip stream (``part-*.txt.gz``), in
any store that Spark writes.  The text reader cuts them at the same separator, and a task puts the pieces
together again by each record's Content-Length, one record at a time, so a page may hold the separator.
A file holds at most ``PER_FILE`` records and goes to one task as a whole.

Payloads are the page's text in UTF-8 (null: empty) and equal if their SHA-256 is.  Payloads under
``LEAST_BYTES`` are always responses.  Rows that share the smallest id of a digest are all responses, and
revisits refer to that id.  A null id counts as the largest and is written without number; if all ids of
a digest are null, all are responses.  A null URL is written as no URL; control characters and blanks in
a URL are percent-encoded in the header, so they are read back encoded.  The date is a parameter.  An
empty table gives an archive without records.  Columns other than id, URL and payload are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import written
from shelfwise.session import scratch_path

LEAST_BYTES = 100          # of payloads that revisits can stand for
PER_FILE = 20_000          # records of an archive file
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
ID = "urn:page:"           # a record's URN is this and its id
OUT_BYTES = 4 << 20
RECORDS = "page_id long, url string, record_type string, digest string, refers_to long, date string, payload string"


# ---------------------------------------------------------------- headers

def headers(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, digest, size) of every row: all that is shuffled to find equal payloads."""
    payload = _payload(payload_col)
    return pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def _payload(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def revisits(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(digest, original) of the payloads that more than one id has: ``original`` is the smallest id.  Such a
    digest's other ids are revisits."""
    return heads.where(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("id").alias("original"), F.count(F.lit(1)).alias("n"), F.max("id").alias("last"), F.count("id").alias("known")).where(
        "last > original OR (known > 0 AND known < n)").select("digest", "original")


# ---------------------------------------------------------------- writing

def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def header_safe(url: Column) -> Column:
    """Percent-encodes what cannot stand in a header line: control characters and blanks."""
    out = url
    for code in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def _base32(hex_digest: Column) -> Column:
    """The usual spelling of a digest in WARC headers: base 32 of its bytes, from groups of five bits."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(F.lower(hex_digest), F.lit("0000"))      # 64 digits and padding: 13 groups of 5 digits
    groups = []
    for g in range(13):
        number = F.conv(F.substring(bits, 5 * g + 1, 5), 16, 10).cast("long")
        groups += [F.substring(F.lit(letters), (F.shiftright(number, 15 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(4)]
    return F.concat(*groups)


def _hex(digest: str | None) -> str | None:
    """The hexadecimal digest of a header's ``sha256:`` value in base 32, or None for another kind."""
    kind, _, letters = (digest or "").partition(":")
    if kind.lower() != "sha256" or len(letters) not in (52, 56):
        return None
    return base64.b32decode(letters.rstrip("=").ljust(56, "=")).hex()


def records_of(rows: DataFrame, date: str = DATE) -> DataFrame:
    """Column ``record``: the text of each row's record but for its end.  ``rows`` holds id, url, digest,
    payload and ``original`` (null for responses)."""
    seen = F.col("original").isNotNull()
    urn = F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))
    block = F.when(seen, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.octet_length("payload").cast("string"), F.lit(END), F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(seen, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", header_safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), _base32(F.col("digest")))),
        _line("WARC-Profile", F.when(seen, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(seen, F.concat(F.lit(f"<{ID}"), F.col("original").cast("string"), F.lit(">")))),
        _line("Content-Type", F.when(~seen, F.lit("application/http; msgtype=response"))),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"))
    return rows.withColumn("block", block).select(head.alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write every row as a record below ``path``; equal payloads are written once."""
    first = written(revisits(headers(pages, id_col, payload_col), least_bytes), "originals")
    again = headers(pages, id_col, payload_col).join(first, "digest").where("size >= {} AND (id IS NULL OR id > original)".format(least_bytes))
    again = written(again.select("id", "digest", "original").distinct(), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), _payload(payload_col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # By digest too, as ids may repeat.  The written side's size decides whether payloads move at all.
    same = rows["id"].eqNullSafe(again["id"]) & (rows["digest"] == again["digest"])
    rows = rows.join(again, same, "left").select(rows["id"], "url", "payload", rows["digest"], "original")
    records_of(rows, date).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


# ---------------------------------------------------------------- reading

def split_records(pieces: Iterator[str]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record.  ``pieces`` are a file's text cut at ``END``;
    whole files may follow each other."""
    end = END.encode()
    for piece in pieces:
        head = piece.encode().lstrip(b"\r\n")
        if not head:
            continue                       # after a block that ended in a line end
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not the start of a WARC record: {lines[0][:80]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size, parts, held = int(fields["content-length"]), [], 0
        while held < size or not parts:    # the block's pieces, and the separators it holds
            part = next(pieces, None)
            if part is None:
                raise ValueError(f"the archive ends in a record of {size} bytes after {held}")
            parts.append(part.encode())
            held += len(parts[-1]) + len(end)
        yield fields, end.join([*parts, b""])[:size]


def _record(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    payload = block.partition(END.encode())[2] if kind == "response" and fields.get("content-type", "").startswith("application/http") else block
    number = {k: (fields.get(k) or "").strip("<>").removeprefix(ID) for k in ("warc-record-id", "warc-refers-to")}
    number = {k: int(v) if v.lstrip("-").isdigit() else None for k, v in number.items()}
    return (number["warc-record-id"], fields.get("warc-target-uri"), kind, _hex(fields.get("warc-payload-digest")), number["warc-refers-to"],
            fields.get("warc-date"), None if kind == "revisit" else payload.decode("utf-8", "replace"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``; a revisit's payload is null."""
    pieces = spark.read.option("lineSep", END).text(path)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORDS.split(", ")]
        for fields, block in split_records(p for b in batches for p in b.column(0).to_pylist()):
            out.append(_record(fields, block))
            size += len(block) + 200
            if size > OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return pieces.mapInArrow(parse, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """Revisit resolution, by headers: page_id, url, record_type, refers_to and, of the full payload, its
    bytes and digest.  A revisit takes them from the response it refers to, found by digest; one whose
    original is missing keeps its own digest and has null bytes."""
    heads = written(records.select(
        "page_id", "url", "record_type", "refers_to", F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), "digest").alias("digest"),
        F.octet_length("payload").cast("long").alias("bytes")), "record-headers")
    originals = heads.where("record_type = 'response'").groupBy("digest").agg(F.max("bytes").alias("original_bytes"))
    joined = heads.where("record_type = 'revisit'").join(originals, "digest", "left").withColumn("bytes", F.col("original_bytes"))
    out = heads.where("record_type <> 'revisit'").unionByName(joined.drop("original_bytes"))
    return out.select("page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def with_payloads(records: DataFrame) -> DataFrame:
    """All records with their payloads: a revisit gets that of its original, joined by digest."""
    said = records.withColumn("digest", F.coalesce(F.sha2(F.col("payload").cast("binary"), 256), "digest"))
    wanted = said.where("record_type = 'revisit'").select("digest").distinct()
    originals = said.where("record_type = 'response'").join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("payload").alias("original"))
    again = said.where("record_type = 'revisit'").join(originals, "digest", "left").withColumn("payload", F.col("original")).drop("original")
    return said.where("record_type <> 'revisit'").unionByName(again)


def deduplicated(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write the archives below ``source`` anew below ``target``: revisits resolved, equal payloads of all
    files written once, fresh headers."""
    whole = written(with_payloads(read_archives(spark, source)), "records")
    write_archives(whole, target, payload_col="payload", least_bytes=least_bytes, date=date)


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages' archives below the shared folder, read them back and resolve the revisits."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolved(read_archives(pages.sparkSession, path))
