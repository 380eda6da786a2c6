r"""WARC archives: write captures of pages, read records back, assemble them into captures.

Writing: each page becomes a request, a response (or revisit) and a metadata record; the other
two name the response in WARC-Concurrent-To. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest key is stored, the others become revisit records
without a payload that refer to it. Records are strings, and the text writer with the separator
``\r\n\r\n`` puts them into gzip files, each a valid archive. Rows are stored with a row number
first, so record ids stay the same when tasks are repeated.

Reading: a file is one row of the binary reader; a task reads it as a stream and passes its
records on in small batches. Memory is bounded by a file, so archives are kept to one task's
share of the input.

Assembly: records that are linked by concurrent-to ids, in any direction and over any number of
steps, are one capture. If all links lead to records that have none (what most crawlers write),
the target is the capture; otherwise connected components are computed. One nested row per
capture holds its records by type. Captures of over ``MAX_RECORDS`` records are several rows,
numbered by ``part``, so that no group is collected without a bound.

Defined results: null html is an empty payload; a null url or key is left out of the headers and
read back as null; a null key is never the smallest; of rows with equal key and payload one is
the response; an empty table writes nothing and reads as no rows; a cut-off record is read as far
as it goes with ``truncated`` set; bytes that begin no record are skipped; further columns are
not looked at.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.llm.common import stored
from arcweave.llm.components import components

MIN_REVISIT = 100
MAX_RECORDS = 1000
BATCH_BYTES = 4 << 20
# Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("http_head", T.StringType()),
    T.StructField("http_length", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("file", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("truncated", T.BooleanType()),
])
_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
    ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("http_head", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary()), ("file", pa.string()),
    ("position", pa.int64()), ("truncated", pa.bool_())])


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _head(*fields: tuple[str, Column | str]) -> Column:
    """Header block; a field that is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value))
             for name, value in fields]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit("\r\n\r\n"))


def write_captures(df: DataFrame, path: str, key: str = "page_id", url: str = "url", page: str = "html",
                   date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT) -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``df``."""
    pages = stored(df.select(
        F.col(key).alias("key"),
        F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20]", "%20").alias("url"),
        F.coalesce(F.col(page).cast("string"), F.lit("")).alias("payload")), "pages")
    pages = (pages.withColumn("row", F.monotonically_increasing_id())
             .withColumn("size", F.octet_length("payload"))
             .withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("row").alias("row"))
    groups = stored(pages.filter(F.col("size") >= min_revisit).groupBy("digest")
                    .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                    .select(F.col("digest").alias("gdigest"), "first"), "payload-groups")
    p = pages.join(groups, (F.col("digest") == F.col("gdigest")) & (F.col("size") >= min_revisit), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    row, uri, when = F.col("row").cast("string"), F.col("url"), F.lit(date)
    own = _urn(F.lit("response"), row)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    size = (F.octet_length(http) + F.col("size")).cast("string")
    response = F.concat(_head(
        ("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", size)), http, F.col("payload"))
    again = F.concat(_head(
        ("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Date", when), ("WARC-Target-URI", uri),
        ("WARC-Profile", REVISIT_PROFILE),
        ("WARC-Refers-To", _urn(F.lit("response"), F.col("first.row").cast("string"))),
        ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", F.octet_length(http).cast("string"))), http)
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = F.concat(_head(
        ("WARC-Type", "request"), ("WARC-Record-ID", _urn(F.lit("request"), row)), ("WARC-Date", when),
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own),
        ("Content-Type", "application/http;msgtype=request"),
        ("Content-Length", F.octet_length(ask).cast("string"))), ask)
    facts = F.concat(F.lit(f"{key}: "), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = F.concat(_head(
        ("WARC-Type", "metadata"), ("WARC-Record-ID", _urn(F.lit("metadata"), row)), ("WARC-Date", when),
        ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields"),
        ("Content-Length", F.octet_length(facts).cast("string"))), facts)
    records = p.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _records(name: str, content: bytes) -> Iterator[dict]:
    raw = io.BytesIO(content)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    at = 0
    while True:
        line = f.readline()
        if not line:
            return
        start, at = at, at + len(line)
        if not line.startswith(b"WARC/"):
            continue
        head: dict[str, list[str]] = {}
        while True:
            line = f.readline()
            at += len(line)
            if not line.strip():
                break
            field, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(field.strip().lower(), []).append(value.strip())
        size = head.get("content-length", ["0"])[0]
        size = int(size) if size.isdigit() else 0
        block = f.read(size)
        at += len(block)
        http, body, length = None, block, None
        if head.get("content-type", [""])[0].startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
            for x in http.split("\r\n")[1:]:
                field, _, value = x.partition(":")
                if field.strip().lower() == "content-length" and value.strip().isdigit():
                    length = int(value)
        one = lambda k: head.get(k, [None])[0]
        yield {"record_id": one("warc-record-id"), "type": one("warc-type"), "target_uri": one("warc-target-uri"),
               "date": one("warc-date"), "concurrent_to": head.get("warc-concurrent-to", []),
               "refers_to": one("warc-refers-to"), "payload_digest": one("warc-payload-digest"),
               "http_head": http, "http_length": length, "payload": body, "file": name, "position": start,
               "truncated": len(block) < size}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path`` (gzip, one or many members, or plain)."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for r in _records(name, content.as_py()):
                    rows.append(r)
                    held += len(r["payload"]) + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def capture_keys(records: DataFrame) -> DataFrame:
    """``records`` with the id ``capture`` that the records of a capture share."""
    links = records.select("record_id", F.explode("concurrent_to").alias("to"))
    targets = links.groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    loose = links.join(targets.filter("n > 1").select("record_id"), "record_id", "left_semi").select("to").union(
        links.join(targets.select(F.col("record_id").alias("to")), "to", "left_semi").select("to"))
    if loose.isEmpty():
        return records.withColumn("capture", F.coalesce(F.get("concurrent_to", F.lit(0)), F.col("record_id")))
    label = components(links, "record_id", "to")
    return (records.join(label, records["record_id"] == label["node"], "left")
            .withColumn("capture", F.coalesce("label", "record_id")).drop("node", "label"))


def assemble(records: DataFrame, max_records: int = MAX_RECORDS) -> DataFrame:
    """One nested row per capture: ``capture``, ``part``, and arrays ``responses`` (also revisits), ``requests``,
    ``metadata`` and ``others`` of the records, each in order of their ids."""
    keyed = capture_keys(records)
    fields = [c for c in records.columns if c != "concurrent_to"]
    large = stored(keyed.groupBy(F.col("capture").alias("big")).agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") > max_records), "large-captures")
    parts = F.ceil(F.col("n") / F.lit(max_records))
    keyed = keyed.join(large, keyed["capture"].eqNullSafe(large["big"]), "left").withColumn(
        "part", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id"), parts)).cast("int"))
    one = F.struct(*fields)
    kind = F.col("type")
    pick = lambda cond: F.sort_array(F.collect_list(F.when(cond, one)))
    known = ("response", "revisit", "request", "metadata")
    return keyed.groupBy("capture", "part").agg(
        pick(kind.isin("response", "revisit")).alias("responses"), pick(kind == "request").alias("requests"),
        pick(kind == "metadata").alias("metadata"),
        pick(~F.coalesce(kind.isin(*known), F.lit(False))).alias("others"))


def resolve_revisits(responses: DataFrame) -> DataFrame:
    """Adds ``original`` (the struct of key and payload facts of the record that a revisit refers to)."""
    first = responses.select(F.col("record_id").alias("oid"), F.struct("key", "payload_bytes").alias("original"))
    return responses.join(first, F.col("refers_to") == F.col("oid"), "left").drop("oid")


def page_results(spark: SparkSession, path: str, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to and url of every page capture under ``path``."""
    raw = read_records(spark, path)
    metadata = F.col("type") == "metadata"
    thin = stored(raw.select(
        "record_id", "type", "target_uri", "concurrent_to", "refers_to", "payload_digest", "http_length",
        F.when(~metadata, F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("type") == "response", F.sha2("payload", 256)).alias("payload_sha256"),
        F.when(metadata, F.col("payload").cast("string")).alias("facts")), "records")
    captures = assemble(thin)
    facts = F.get(F.col("metadata"), F.lit(0))["facts"]
    pages = captures.select(
        F.nullif(F.regexp_extract(facts, rf"(?m)^{key}: (\S*)", 1), F.lit("")).cast("long").alias("key"),
        F.explode("responses").alias("r"))
    pages = stored(pages.select(
        "key", "r.record_id", F.col("r.type").alias("record_type"), "r.refers_to", "r.target_uri",
        F.when(F.col("r.type") == "revisit", F.col("r.http_length")).otherwise(F.col("r.payload_bytes"))
        .alias("payload_bytes"),
        F.when(F.col("r.type") == "revisit", F.regexp_replace("r.payload_digest", "^sha256:", ""))
        .otherwise(F.col("r.payload_sha256")).alias("payload_digest")), "captures")
    return resolve_revisits(pages).select(
        F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("original.key")).alias("refers_to"),
        F.col("target_uri").alias("url"))
