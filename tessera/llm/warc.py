"""WARC derivatives: metadata and plain-text conversion records that refer to their response records."""

from __future__ import annotations

import gzip
import hashlib
import html
import html.entities
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.shared import fresh_path, remove

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: (pattern, replacement) in order: what turns markup into text. The same list makes the SQL. What a match scans it takes,
#: up to the end where nothing closes it, and no tag reaches beyond the next "<": so the time is linear in any page.
TO_TEXT = (
    (r"(?is)<script\b[^<>]*>.*?(?:</script\s*>|\z)|<style\b[^<>]*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", " "),
    (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|head|body|html)\b[^<>]*>", "\n"), (r"<[^<>]*>", ""),
)
SQUEEZE = ((r"[ \t\r\f]{2,}|[\t\r\f]", " "), (r" ?\n[ \n]*", "\n"))  # a single space stays as it is
TITLE, HREF, LANG = r"(?is)<title\b[^<>]*>([^<]*)", r'(?i)<a\s[^<>]*?href="([^"]*)"', r'(?i)<html\b[^<>]*?\slang="([^"]*)"'
#: The same values in double, single or no quotes; what the records are made with.
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
ANY_HREF, ANY_LANG = r"(?i)<a\s[^<>]*?(?<![\w-])href" + _VALUE, r"(?i)<html\b[^<>]*?\slang" + _VALUE


#: Of ASCII letters and spaces alone, as SQL has them.
_STEPS = [(re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII), put) for pattern, put in TO_TEXT]


def text_of(page: str) -> str:
    """Visible text of a page: one line per block, single spaces.

    References, named and numeric, are resolved once each; a non-breaking space by name becomes a space. Squeezing by
    replacement and by lines says the same as SQUEEZE, in a fraction of the time.
    """
    for pattern, put in _STEPS:
        page = pattern.sub(put, page)
    page = html.unescape(page.replace("&nbsp;", " "))
    for space in "\t\r\f":
        page = page.replace(space, " ")
    while "  " in page:
        page = page.replace("  ", " ")
    return "\n".join(filter(None, (line.strip(" ") for line in page.split("\n"))))


@F.udf(returnType=StringType(), useArrow=True)
def _texts(page: str | None) -> str | None:
    return page and text_of(page)


def _bare(value: Column) -> Column:
    """An attribute's value without its quotes."""
    return F.when(value.rlike("""^["']"""), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def plain_text(body: Column) -> Column:
    """Visible text of a page, see text_of."""
    return _texts(body)


def urn(of: Column) -> Column:
    """<urn:uuid:...> from the MD5 of a string: the same record gets the same id in every run."""
    h = F.md5(of.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of crawled pages: (key, record_id, target_uri, date, http_headers, payload). Nulls count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    body = text(body_col)
    rows = pages.select(F.col(id_col).alias("key"), text(id_col).alias("i"), text(url_col).alias("target_uri"), body.alias("payload"))
    size = F.octet_length("payload").cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    return rows.select("key", urn(F.concat_ws("|", F.lit("response"), "i", "target_uri", F.sha2("payload", 256))).alias("record_id"), "target_uri", F.lit(date).alias("date"), headers.alias("http_headers"), "payload")


def derivatives(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record: (key, record_type, record_id, refers_to, target_uri,
    date, content_type, source_headers, source_digest, block_digest, content_length, block).

    records are rows of responses() or of read_warc() whose record_type is response. The metadata block has the source's
    HTTP headers, title, declared language and links as WARC fields, the conversion block its plain text; both keep the
    response's id (refers_to), address, date and payload digest. Null payloads, addresses and headers count as empty, and
    empty ones give empty fields and an empty text; what is never closed (a script, a comment) reaches to the end, and a
    title to the next tag; repeated responses give repeated records; an empty table gives none; other columns are ignored.
    Rows are handled one by one: no shuffle.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    from_file = "payload" not in records.columns
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.col(c), 256))
    body = text("block" if from_file else "payload")
    rows = records.select("key", text("record_id").alias("source"), text("target_uri").alias("target_uri"), text("date").alias("date"), text("http_headers").alias("source_headers"), body.alias("payload"), *(["payload_digest"] if from_file else []))
    rows = rows.withColumn("source_digest", F.col("payload_digest") if from_file else digest("payload"))
    squeezed = F.regexp_extract("payload", TITLE, 1)
    for pattern, put in ((r"[ \t\r\n\f]+", " "), (r"^ | $", "")):
        squeezed = F.regexp_replace(squeezed, pattern, put)
    links = F.transform(F.regexp_extract_all("payload", F.lit(ANY_HREF), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), _bare(x), F.lit(CRLF)))
    fields = F.concat(
        F.lit("title: "), squeezed, F.lit(f"{CRLF}language: "), _bare(F.regexp_extract("payload", ANY_LANG, 1)), F.lit(CRLF),
        F.regexp_replace("source_headers", r"(?m)^(?=[^\r\n])", "http: "), F.array_join(links, ""),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = rows.select("key", "source", "target_uri", "date", "source_headers", "source_digest", F.explode(made).alias("r"))
    out = out.select("key", "source", "target_uri", "date", "source_headers", "source_digest", "r.record_type", "r.content_type", "r.block")
    return out.select(
        "key", "record_type", urn(F.concat_ws("|", "record_type", "source")).alias("record_id"), F.col("source").alias("refers_to"), "target_uri", "date", "content_type",
        "source_headers", "source_digest", digest("block").alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def report(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The derivative records of a table of pages without their blocks, as read back from files.

    The pages' responses are written as .warc.gz files in the shared folder, those are read and converted, and the
    derivatives written and read in their turn.
    """
    spark = pages.sparkSession
    crawl, made = fresh_path(spark, "crawl"), fresh_path(spark, "derivatives")
    write_warc(responses(pages, id_col), crawl)
    write_warc(derivatives(read_warc(spark, crawl).where("record_type = 'response'")), made)
    remove(spark, crawl)
    kept = F.col("key").cast(pages.schema[id_col].dataType).alias(id_col)
    return read_warc(spark, made, text=False).select(kept, "record_type", "record_id", "refers_to", "target_uri", "content_type", "source_headers", "source_digest", F.col("payload_digest").alias("block_digest"), F.col("payload_bytes").alias("content_length"))


def report_sql() -> str:
    """report over the table pages, for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"

    def chain(x: str, steps: tuple) -> str:
        for pattern, put in steps:
            options = "g" + "".join(o for o in "is" if pattern.startswith("(?") and o in pattern[2 : pattern.index(")")])
            bare = pattern[pattern.index(")") + 1 :] if pattern.startswith(("(?i", "(?s")) else pattern
            x = f"regexp_replace({x}, {q(bare)}, {q(put)}, {q(options)})"
        return x

    # References: what follows each "&" is a number, a name of the standard's table, or begins with one of its old names.
    table = {**html.entities.html5, "nbsp;": " "}
    names = [k for k in table if k.endswith(";")]
    old = sorted((k for k in table if not k.endswith(";")), key=len, reverse=True)
    listed = lambda keys: f"[{', '.join(q(k) for k in keys)}]"
    valued = lambda keys: f"[{', '.join(q(table[k]) for k in keys)}]"
    known, begun = "names[regexp_extract(x, '^[^ <&#;]{1,32};')]", f"list_filter({listed(old)}, lambda n: starts_with(x, n))[1]"
    one = (
        "CASE WHEN regexp_matches(x, '^#[0-9]') THEN chr(CAST(regexp_extract(x, '^#([0-9]{1,7})', 1) AS INT)) || regexp_replace(x, '^#[0-9]+;?', '') "
        "WHEN regexp_matches(x, '^#[xX][0-9a-fA-F]') THEN chr(CAST('0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]{1,6})', 1) AS INT)) || regexp_replace(x, '^#[xX][0-9a-fA-F]+;?', '') "
        f"WHEN {known} IS NOT NULL THEN {known} || regexp_replace(x, '^[^;]*;', '') WHEN {begun} IS NOT NULL THEN old[{begun}] || substr(x, length({begun}) + 1) ELSE '&' || x END"
    )
    split = f"string_split({chain('payload', TO_TEXT)}, '&')"
    body = chain(f"{split}[1] || coalesce(array_to_string(list_transform({split}[2:], lambda x: {one}), ''), '')", SQUEEZE)
    body = f"trim({body}, ' ' || chr(10))"
    title = chain(f"regexp_extract(payload, {q(TITLE)}, 1)", ((r"[ \t\r\n\f]+", " "), (r"^ | $", "")))
    id_of = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    return f"""
WITH table_of AS (SELECT map({listed(names)}, {valued(names)}) AS names, map({listed(old)}, {valued(old)}) AS old),
base AS (
  SELECT page_id, coalesce(CAST(page_id AS VARCHAR), '') AS i, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (
  SELECT page_id, {id_of("'response|' || i || '|' || target_uri || '|' || sha256(payload)")} AS refers_to, target_uri, payload,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(payload) || chr(13) || chr(10) AS source_headers
  FROM base),
d AS (
  SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'title: ' || {title} || chr(13) || chr(10) || 'language: ' || regexp_extract(payload, {q(LANG)}, 1) || chr(13) || chr(10)
    || regexp_replace(source_headers, '(?m)^([^\\r\\n])', 'http: \\1', 'g')
    || coalesce(array_to_string(list_transform(regexp_extract_all(payload, {q(HREF)}, 1), lambda x: 'outlink: ' || x || chr(13) || chr(10)), ''), '') AS block
  FROM r
  UNION ALL
  SELECT r.*, 'conversion', 'text/plain; charset=utf-8', {body} FROM r CROSS JOIN table_of)
SELECT page_id, record_type, {id_of("record_type || '|' || refers_to")} AS record_id, refers_to, target_uri, content_type, source_headers,
  'sha256:' || sha256(payload) AS source_digest, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length
FROM d
"""


FIELDS = ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest")
#: The same in a record's head, in order. The last two are extensions: a key of the caller's, and the source's HTTP head as JSON.
HEAD = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type", "WARC-Source-Payload-Digest", "WARC-Key", "WARC-Source-HTTP-Head")


def record_bytes(values: tuple, block: bytes, payload_at: int = 0) -> bytes:
    """One WARC 1.1 record. values: as HEAD has them; payload_at: where the block's payload begins, after an HTTP head."""
    digest = [("WARC-Payload-Digest", block[payload_at:])] if payload_at else []
    lines = [f"{k}: {v}" for k, v in zip(HEAD, values, strict=True) if v is not None and v != ""]
    lines += [f"{k}: sha256:{hashlib.sha256(b).hexdigest()}" for k, b in (("WARC-Block-Digest", block), *digest)]
    head = CRLF.join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return b"".join([head.encode("utf-8", "surrogatepass"), block, b"\r\n\r\n"])


def write_warc(records: DataFrame, path: str) -> int:
    """Writes response or derivative records as .warc.gz files, a gzip member per record and a file per task; returns how many.

    What stands in path is replaced. A file's name depends on the partition alone and it is moved into place when
    finished, so a task that runs again replaces its own file. path is any address that pyarrow can open, such as one in
    the shared folder. A response's block is its HTTP head, an empty line and its payload.
    """
    system, root = pafs.FileSystem.from_uri(path)
    system.create_dir(root)
    system.delete_dir_contents(root)
    answer = "http_headers" in records.columns
    null = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string") if c in records.columns else null
    fixed = {"record_type": F.lit("response"), "content_type": F.lit("application/http; msgtype=response")} if answer else {}
    head = [fixed.get(c, text(c)).alias(c) for c in FIELDS]
    rows = records.select(*head, text("key").alias("key"), text("http_headers" if answer else "source_headers").alias("http"), F.coalesce(F.col("payload" if answer else "block"), F.lit("")).cast("binary").alias("body"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        system, root = pafs.FileSystem.from_uri(path)
        scratch = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(scratch) as out:
            for batch in batches:
                for *values, http, body in zip(*(batch.column(k).to_pylist() for k in range(len(FIELDS) + 2)), batch.column("body"), strict=True):
                    raw = body.as_py()
                    if answer:
                        before = ((http or "") + CRLF).encode()
                        made = record_bytes((*values, None), before + raw, len(before))
                    else:
                        made = record_bytes((*values, json.dumps(http) if http else None), raw)
                    out.write(gzip.compress(made, 1, mtime=0))
                    n += 1
        system.move(scratch, f"{root}/part-{part:06d}.warc.gz") if n else system.delete_file(scratch)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an uncompressed stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


_HTTP_END = re.compile(rb"\r?\n\r?\n")
_CHARSET = re.compile(r"(?im)^content-type:[^\r\n]*?charset\s*=\s*[\"']?([\w.:-]+)")


def split_http(block: bytes) -> tuple[str | None, bytes]:
    """(head with its line ends, payload) of an HTTP message; without an empty line all is head."""
    if not block.startswith(b"HTTP/"):
        return None, block
    end = _HTTP_END.search(block)
    head, payload = (block[: end.start()] + b"\r\n", block[end.end() :]) if end else (block, b"")
    return head.decode("latin-1"), payload


def decoded(payload: bytes, head: str | None) -> str:
    """A payload as text by its declared charset, UTF-8 if there is none or it is unknown; bytes that do not fit are replaced."""
    found = _CHARSET.search(head or "")
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


READ = "record_type record_id refers_to target_uri date content_type source_digest key source_headers http_headers payload_digest".split()


def read_warc(spark: SparkSession, path: str, text: bool = True) -> DataFrame:
    """One row per record of all .warc.gz files below path, a task per file, streamed: (record_type, record_id, refers_to,
    target_uri, date, content_type, source_digest, key, source_headers, http_headers, payload_digest, payload_bytes, block).

    A response's HTTP head is split from its payload. Digests and sizes are those of the payload's bytes as read; a block
    digest in the record that is sha256 and disagrees ends the job with an error. block is the payload as text, by the
    HTTP head's charset with what does not fit replaced, or null unless text. No files give no rows.
    """
    system, root = pafs.FileSystem.from_uri(path)
    files = [f.path for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.base_name.endswith(".warc.gz")]
    names = spark.createDataFrame([(f,) for f in sorted(files)], "file string").coalesce(1).repartition(max(len(files), 1))
    of = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "content-type", "warc-source-payload-digest", "warc-key")
    kinds = [*[pa.string()] * len(READ), pa.int64(), pa.string()]

    def row(f: dict[str, str], block: bytes, name: str) -> tuple:
        http, payload = split_http(block) if f.get("content-type", "").startswith("application/http") else (None, block)
        digest = f"sha256:{hashlib.sha256(payload).hexdigest()}"
        told = f.get("warc-block-digest", "")
        if told.startswith("sha256:") and told != (digest if payload is block else f"sha256:{hashlib.sha256(block).hexdigest()}"):
            raise ValueError(f"{name}: the block of {f.get('warc-record-id')} does not have its digest")
        source = f.get("warc-source-http-head")
        return (*(f.get(k) for k in of), json.loads(source) if source else None, http, digest, len(payload), decoded(payload, http) if text else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[tuple] = []
                size = 0
                with system.open_input_stream(name, compression="gzip") as raw:
                    for f, block in parse_records(io.BufferedReader(raw, 1 << 20)):
                        held.append(row(f, block, name))
                        size += len(block)
                        if len(held) >= 1000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [*READ, "payload_bytes", "block"])
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [*READ, "payload_bytes", "block"])

    return names.mapInArrow(read, ", ".join(f"{k} string" for k in READ) + ", payload_bytes long, block string")
