"""WARC revisit resolution.

Headers alone are shuffled by payload digest: the earliest response of a digest is its original, written down as one row
a digest; later responses of the digest become revisits, and revisit records are joined to the original they repeat.
Payloads are shuffled once, by digest, after each task has put aside all but one of its payloads of a digest; where they
arrive, the original is written into an archive. Revisits, which have no payload, and records of other types, whose
payload stays where it is read, are written by their own tasks. So a digest that a third of all records have moves as
headers in a join that is split where it is skewed, and as one payload for each task that reads some.

Archives hold one gzip member a record: a warcinfo first, then records with fresh headers; a response's block is an
HTTP head and its payload, a revisit's is empty. Files are written as a stream, a new one begins after ROLL bytes. The
list that the tasks return, written to the shared folder, says which files count, so a lost or repeated task leaves
at most a file that no list names.

Records: record_id, warc_type (response or revisit), target_uri, warc_date, payload_digest, payload (string or binary, NULL
in revisits); other columns, of whatever names, aren't read.

Defined results: a response whose digest is NULL gets the digest of its payload; a NULL payload counts as empty. A
revisit whose digest has no response, or is NULL, stays as it is, without reference (resolved = false). Equal dates are
ordered by record_id, then by target_uri, then by payload. Line ends in headers become blanks. Records without a record_id are kept,
with an id made of their other headers. Repeated rows are repeated records: all but one become revisits of that one. Records of other
types are passed on unresolved. Very long payloads are kept whole, any bytes are. An empty table gives no archives.
"""

from __future__ import annotations

import gzip
import io
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import fresh_path, materialize, table

ROLL = 256 << 20
#: Bytes of archives that one task reads.
READ = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = ["record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", "refers_to_uri", "refers_to_date", "resolved", "header", "payload"]
TYPES = {"resolved": "boolean", "payload": "binary"}
SCHEMA = ", ".join(f"{c} {TYPES.get(c, 'string')}" for c in RECORD)
NO_URI = "urn:unknown"
HTTP = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", "\r\n\r\n")
#: Copies of one record that are made from one row at a time.
COPIES = 1 << 16


def captures(pages: DataFrame) -> DataFrame:
    """Two crawls of the pages: one of responses, and a week later one that found every page unchanged and kept only revisits."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))

    def crawl(kind: str, nth: int, payload) -> DataFrame:
        day = F.date_format(F.timestamp_seconds(F.lit(1704067200 + nth * 604800) + F.coalesce(F.col("page_id"), F.lit(0)) % 604800), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return pages.select(
            F.concat(F.lit(f"<urn:crawl:{nth}:page:"), page, F.lit(">")).alias("record_id"),
            F.lit(kind).alias("warc_type"),
            F.col("url").alias("target_uri"),
            day.alias("warc_date"),
            F.concat(F.lit("sha256:"), F.sha2(html, 256)).alias("payload_digest"),
            payload.alias("payload"),
        )

    return crawl("response", 1, html).unionByName(crawl("revisit", 2, F.lit(None).cast("string")))


def fresh_id(*parts) -> F.Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if i > 1 else []) + [F.substring(h, i, n)]), F.lit(">"))


def one_line(c) -> F.Column:
    return F.regexp_replace(c, "[\\r\\n]+", " ")


def prepared(records: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    response = F.col("warc_type") == "response"
    return records.select(
        F.coalesce(F.col("record_id"), fresh_id("warc_type", "target_uri", "warc_date", "payload_digest")).alias("old_id"),
        F.coalesce(one_line("warc_type"), F.lit("unknown")).alias("warc_type"),
        F.coalesce(one_line("target_uri"), F.lit(NO_URI)).alias("target_uri"),
        F.coalesce(one_line("warc_date"), F.lit("")).alias("warc_date"),
        F.coalesce(one_line("payload_digest"), F.when(response, F.concat(F.lit("sha256:"), F.sha2(body, 256)))).alias("payload_digest"),
        F.when(F.col("warc_type") == "revisit", F.lit(b"")).otherwise(body).alias("payload"),
    )


def new_id(nth, *of) -> F.Column:
    return fresh_id(F.lit("fresh"), *of, nth)


def parts(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Originals with their payload, revisits without one, and records of other types, all with fresh headers."""
    r = prepared(records)
    response = F.col("warc_type") == "response"
    key = ["warc_date", "old_id", "target_uri"]
    none = F.lit(None).cast("string")

    # the only shuffle that holds payloads
    found = r.where(response).groupBy("payload_digest").agg(F.min(F.struct(*key, "payload")).alias("o")).select("payload_digest", "o.*")
    originals = _finished(found.select(new_id(F.lit("0"), *key, "payload_digest").alias("record_id"), F.lit("response").alias("warc_type"), "target_uri", "warc_date", "payload_digest", none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("refers_to_date"), F.lit(True).alias("resolved"), "payload"))

    # headers only from here; a written table, so that a hot digest is split where it meets it
    first = materialize(r.where(response).groupBy("payload_digest").agg(F.min(F.struct(*key)).alias("o")), "originals")
    heads = r.where(response | (F.col("warc_type") == "revisit")).groupBy("warc_type", *key, "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    met = heads.join(first, "payload_digest", "left")
    own = (response & (F.struct(*key) == F.col("o"))).cast("bigint")
    met = met.withColumn("own", F.coalesce(own, F.lit(0).cast("bigint"))).where("n > own")
    met = met.withColumn("b", F.explode(F.expr(f"sequence(0L, (n - own - 1) div {COPIES})")))
    met = met.withColumn("nth", F.explode(F.expr(f"sequence(own + b * {COPIES}, least(n, own + (b + 1) * {COPIES}) - 1)")))
    links = F.col("o").isNotNull()
    revisits = _finished(met.select(
        new_id(F.concat(F.substring("warc_type", 4, 1), F.col("nth").cast("string")), *key, "payload_digest").alias("record_id"),
        F.lit("revisit").alias("warc_type"),
        "target_uri", "warc_date", "payload_digest",
        F.when(links, new_id(F.lit("0"), "o.warc_date", "o.old_id", "o.target_uri", "payload_digest")).alias("refers_to"),
        F.col("o.target_uri").alias("refers_to_uri"), F.col("o.warc_date").alias("refers_to_date"),
        links.alias("resolved"), F.lit(b"").alias("payload"),
    ))

    rest = r.where(~F.col("warc_type").isin("response", "revisit"))
    others = _finished(rest.select(new_id(F.lit("0"), *key, "payload_digest", F.sha2("payload", 256)).alias("record_id"), "warc_type", "target_uri", "warc_date", "payload_digest", none.alias("refers_to"), none.alias("refers_to_uri"), none.alias("refers_to_date"), F.lit(False).alias("resolved"), "payload"))
    return originals, revisits, others


def _finished(df: DataFrame) -> DataFrame:
    return df.withColumn("header", header()).select(*RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """All records with fresh headers; payload is empty in revisits."""
    a, b, c = parts(records)
    return a.union(b).union(c)


def line(name: str, value) -> F.Column:
    """A header line, or nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def header() -> F.Column:
    size = F.octet_length("payload")
    head = F.when(F.col("warc_type") == "response", F.length(F.concat(F.lit(HTTP[0]), size.cast("string"), F.lit(HTTP[1])))).otherwise(0)
    kind = F.when(F.col("warc_type").isin("response", "revisit"), F.lit("application/http; msgtype=response")).otherwise(F.lit("application/octet-stream"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("Content-Type", kind),
        line("Content-Length", (head + size).cast("string")),
    )


def member(head: str, block: bytes) -> bytes:
    """A record as a gzip member of its own."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def archived(records: DataFrame, folder: str, kind: str, roll: int) -> DataFrame:
    """Writes each partition's records into archives of its own: archive, n_records, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task, out, f, n = TaskContext.get().partitionId(), [], None, 0

        def close() -> None:
            nonlocal f, n
            if f:
                size = f.tell()
                f.close()
                out.append((name, n, size))
            f, n = None, 0

        for b in batches:
            for kind_of, head, payload in zip(*(b.column(i).to_pylist() for i in range(3))):
                if f is None:
                    name = f"{kind}-{task:05d}-{len(out):05d}-{uuid.uuid4().hex}.warc.gz"
                    f = fs.open_output_stream(f"{base}/{name}", compression=None)
                    said = f"software: gleaner\r\nformat: WARC File Format 1.1\r\n".encode()
                    f.write(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(said)}\r\n", said))
                if kind_of == "response":
                    payload = f"{HTTP[0]}{len(payload)}{HTTP[1]}".encode() + payload
                f.write(member(head, payload))
                n += 1
                if f.tell() >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    return records.select("warc_type", "header", "payload").mapInArrow(run, "archive string, n_records bigint, n_bytes bigint")


def write_archives(records: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Resolves the records, writes the archives and gives their list: archive, n_records, n_bytes."""
    a, b, c = (archived(x, folder, kind, roll) for x, kind in zip(parts(records), ("responses", "revisits", "others")))
    return materialize(a.union(b).union(c), "archives")


def parse(stream) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record of an archive, one after another."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while first := f.readline():
        if first == b"\r\n":
            continue
        lines = [first]
        while (x := f.readline()) not in (b"\r\n", b""):
            lines.append(x)
        size = next(int(x[15:]) for x in lines if x.lower().startswith(b"content-length:"))
        yield b"".join(lines).decode(), f.read(size)


def read_archives(listed: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives of a folder, in the columns that resolve() gives."""
    total = listed.agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b")).first()
    spark = listed.sparkSession
    tasks = max(1, min(total.n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total.b or 0) // READ)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            kinds = [{"resolved": pa.bool_(), "payload": pa.binary()}.get(n, pa.string()) for n in RECORD]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], RECORD)

        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for head, block in parse(f):
                        x = dict(v.split(": ", 1) for v in head.split("\r\n")[1:] if v)
                        kind, ref = x.get("WARC-Type"), x.get("WARC-Refers-To")
                        if kind == "warcinfo" and x.get("WARC-Filename") == name:
                            continue
                        if kind == "response":
                            block = block[block.index(b"\r\n\r\n") + 4 :]
                        rows.append((x.get("WARC-Record-ID"), kind, x.get("WARC-Target-URI"), x.get("WARC-Date"), x.get("WARC-Payload-Digest"), ref, x.get("WARC-Refers-To-Target-URI"), x.get("WARC-Refers-To-Date"), kind == "response" or ref is not None, head, block))
                        held += len(head) + len(block)
                        if held > 16 << 20 or len(rows) == 2000:
                            yield batch()
                            rows, held = [], 0
        if rows:
            yield batch()

    return listed.select("archive").repartition(tasks).mapInArrow(run, SCHEMA)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the deduplicated archives, as read back from them."""
    folder = fresh_path(spark, "warc")
    listed = write_archives(captures(table(spark, sf_dir, "pages")), folder)
    return read_archives(listed, folder).withColumn("payload", F.col("payload").cast("string"))


def _id_sql(*parts: str) -> str:
    h = f"sha256(concat_ws('|', {', '.join(parts)}))"
    return f"'<urn:uuid:' || {h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32] || '>'"


def _line_sql(name: str, value: str) -> str:
    return f"coalesce('{name}: ' || {value} || chr(13) || chr(10), '')"


def _http_sql(size: str) -> str:
    text = "||".join("'" + x.replace("\r\n", "' || chr(13) || chr(10) || '") + "'" for x in (HTTP[0], "\0", HTTP[1]))
    return f"length({text.replace(chr(39) + chr(0) + chr(39), size)})"


SQL = f"""
WITH p AS (SELECT coalesce(page_id::VARCHAR, 'none') AS page, coalesce(page_id, 0) % 604800 AS s, coalesce(url, '{NO_URI}') AS target_uri, coalesce(html, '') AS html FROM pages),
 r0 AS (SELECT '<urn:crawl:' || c || ':page:' || page || '>' AS old_id, CASE WHEN c = 1 THEN 'response' ELSE 'revisit' END AS old_type, target_uri,
              strftime(make_timestamp((1704067200 + c * 604800 + s) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS warc_date, 'sha256:' || sha256(html) AS payload_digest, html
       FROM p, (VALUES (1), (2)) AS k(c)),
 r AS (SELECT *, row_number() OVER (PARTITION BY old_type, old_id, target_uri, warc_date, payload_digest) - 1 AS nth FROM r0),
 o AS (SELECT * FROM (SELECT payload_digest, warc_date AS od, old_id AS oi, target_uri AS ou, row_number() OVER (PARTITION BY payload_digest ORDER BY warc_date, old_id, target_uri) AS rn FROM r WHERE old_type = 'response') WHERE rn = 1),
 m AS (SELECT r.*, od, oi, ou, old_type = 'response' AND warc_date = od AND old_id = oi AND target_uri = ou AND nth = 0 AS is_first FROM r JOIN o USING (payload_digest)),
 x AS (SELECT CASE WHEN is_first THEN {_id_sql("'fresh'", "warc_date", "old_id", "target_uri", "payload_digest", "'0'")} ELSE {_id_sql("'fresh'", "warc_date", "old_id", "target_uri", "payload_digest", "substr(old_type, 4, 1) || nth")} END AS record_id,
              CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS warc_type, target_uri, warc_date, payload_digest,
              CASE WHEN NOT is_first THEN {_id_sql("'fresh'", "od", "oi", "ou", "payload_digest", "'0'")} END AS refers_to, CASE WHEN NOT is_first THEN ou END AS refers_to_uri, CASE WHEN NOT is_first THEN od END AS refers_to_date,
              true AS resolved, CASE WHEN is_first THEN html ELSE '' END AS payload, CASE WHEN is_first THEN octet_length(encode(html)) ELSE 0 END AS size FROM m)
SELECT record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, refers_to_uri, refers_to_date, resolved,
       'WARC/1.1' || chr(13) || chr(10) || {_line_sql("WARC-Type", "warc_type")} || {_line_sql("WARC-Record-ID", "record_id")} || {_line_sql("WARC-Target-URI", "target_uri")} || {_line_sql("WARC-Date", "warc_date")}
       || {_line_sql("WARC-Payload-Digest", "payload_digest")} || CASE WHEN refers_to IS NOT NULL THEN {_line_sql("WARC-Profile", f"'{PROFILE}'")} ELSE '' END || {_line_sql("WARC-Refers-To", "refers_to")}
       || {_line_sql("WARC-Refers-To-Target-URI", "refers_to_uri")} || {_line_sql("WARC-Refers-To-Date", "refers_to_date")} || {_line_sql("Content-Type", "'application/http; msgtype=response'")}
       || {_line_sql("Content-Length", f"(size + CASE WHEN is_original THEN {_http_sql('size::VARCHAR')} ELSE 0 END)::VARCHAR")} AS header, payload FROM (SELECT *, warc_type = 'response' AS is_original FROM x)
"""
