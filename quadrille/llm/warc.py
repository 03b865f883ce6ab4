"""WARC archives and a globally ordered capture index.

Writing: every page becomes a WARC/1.1 record. Of pages with equal payloads of some
size one is a response, the others are revisits that refer to it and carry the HTTP
headers only. Records are written with Spark's text writer (a record's last line end
is the writer's line separator), so the archive lies wherever Spark can write.

Files are compressed with gzip.

Reading: archive files are read whole (their size is bounded, see FILES) and parsed
by their Content-Length.

Index: each archive file gives a run of captures, sorted by URL key (host labels
turned round, so that a site's captures are next to each other), time and record.
Runs are dealt by ranges of the sort key; in each range a task merges what the runs
have there with a loser tree. Ranges and merged rows are in order, so that the
capture histories are ordered over the whole table. The place of a capture in that
order is its place in its range, after the sizes of the ranges before.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.llm.common import cut, fresh_path, remove, table, text_or_empty

CRLF = "\r\n"
#: Payloads of fewer bytes are always written out.
LEAST_REVISIT = 1000
#: Payloads of so many bytes or fewer share a file with up to so many records; a file has 64 MiB of
#: payloads at most. Larger payloads have a file each.
FILES = ((1 << 16, 1024), (1 << 21, 32), (None, 1))
HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _with_revisits(pages: DataFrame, least: int, runs: int = 64) -> DataFrame:
    """pages (_page, _url, _html, _date) with _bytes, _digest (SHA-1, hex), _refers: the largest id of equal payloads, null for responses.

    Equal payloads are found by SHA-1, SHA-256 and length. Many equal ones meet by way of
    runs, dealt by id, so that no task has all of them. Rows that repeat an id and a
    payload are the same capture: all are responses or all revisits.
    """
    payload = F.col("_html").cast("binary")
    signed = pages.select("*", F.octet_length(payload).alias("_bytes"), F.sha1(payload).alias("_digest"), F.sha2(payload, 256).alias("_check"), F.pmod(F.xxhash64("_page"), F.lit(runs)).alias("_run"))
    key = ["_bytes", "_digest", "_check"]
    in_runs = cut(signed.where(F.col("_bytes") >= least).groupBy("_run", *key).agg(F.max("_page").alias("_last"), F.count(F.lit(1)).alias("_n")))
    last = in_runs.groupBy(*key).agg(F.max("_last").alias("_last"), F.sum("_n").alias("_n")).where("_n > 1")
    shared = in_runs.drop("_last", "_n").join(last, key).select("_run", *key, "_last")
    joined = signed.join(shared, [*key, "_run"], "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_last")), F.col("_last"))
    return joined.withColumn("_refers", refers).drop("_check", "_run", "_last")


def _record(page: Column, url: Column, date: Column, payload: Column) -> Column:
    """A record up to its last line end but one."""
    revisit = F.col("_refers").isNotNull()
    head = F.concat(F.lit(HEADER), F.col("_bytes").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(revisit, F.lit("")).otherwise(payload)
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("_refers").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(head) + F.octet_length(body)).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), head, body, F.lit(CRLF))


def write_archives(pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date: Column | None = None, least: int = LEAST_REVISIT) -> None:
    """Write a record for each row of pages to archive files under path.

    date is a string column in the form of WARC-Date; without one, records are dated by
    their id, a second each from 1970 on. A null id or URL is written as an empty one, a
    null payload counts as empty. Rows that repeat an id are records of their own; an
    empty table gives an archive without records. Other columns are passed over.
    """
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(0))
    when = date if date is not None else F.date_format(F.timestamp_seconds(F.pmod(number, F.lit(1 << 32))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    named = pages.select(F.col(id_column).alias("_page"), F.col(url_column).cast("string").alias("_url"), text_or_empty(payload_column).alias("_html"), when.alias("_date"))
    size = F.octet_length("_html")
    largest = named.agg(F.max(size)).first()[0] or 0
    below = -1
    for most, records in FILES:
        # Equal payloads are of one size, so revisits refer to records of the same part.
        part = named.where((size > below) & (size <= most)) if most else named.where(size > below)
        rows = _with_revisits(part if below >= 0 or most and largest > most else named, least)
        text = rows.select(_record(F.col("_page"), F.col("_url"), F.col("_date"), F.col("_html")).alias("value"))
        text.write.mode("append" if below >= 0 else "errorifexists").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)
        if not most or largest <= most:
            break
        below = most


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The named fields (in lower case) and the block of each record of an archive file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record does not end at byte {at}")
        at += 4


def url_key(url: str) -> str:
    """The host's labels turned round, then port, path and query, in lower case and without a fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    labels = [x for x in (parts.hostname or "").split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


CAPTURE = "run string, url_key string, date string, record bigint, page bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload_ok boolean"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archive files under path: a sorted run of captures for each file.

    payload_ok tells for a response whether its payload has the length and SHA-1 that
    the record names; it is null for revisits. Files may be compressed or not. Records
    that repeat are rows of their own; an archive without records gives an empty table.
    The rows are a checkpoint: the files aren't needed any more.
    """

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.lstrip("-").isdigit() else None

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows, data = [], content.as_py()
                for n, (fields, block) in enumerate(records_in(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in head.decode().split(CRLF) if x.lower().startswith("content-length:")).partition(":")[2])
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                    good = None if kind == "revisit" else len(payload) == size and hashlib.sha1(payload).hexdigest() == digest
                    url = fields["warc-target-uri"]
                    rows.append((name.as_py(), url_key(url), fields["warc-date"], n, number(fields["warc-record-id"]), url, kind, size, digest, number(fields.get("warc-refers-to")), good))
                rows.sort(key=lambda r: r[1:4])
                kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                names = [field.split()[0] for field in CAPTURE.split(", ")]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # A task's files have spark.sql.files.maxPartitionBytes together, or are one larger file.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return cut(files.mapInArrow(read, CAPTURE))


def merged(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in order, by a loser tree: each inner node holds the run that lost
    there, so that a row costs one comparison a level. Of equal rows that of the earlier run is first."""
    heads = [iter(r) for r in runs]
    size = max(1, 1 << (len(heads) - 1).bit_length()) if heads else 0
    row: list[tuple | None] = [next(h, None) for h in heads] + [None] * (size - len(heads))
    ahead = lambda a, b: row[b] is None or row[a] is not None and (row[a], a) < (row[b], b)
    losers, winners = [0] * size, list(range(size))
    node = size
    while len(winners) > 1:  # the first round: pairs play, losers stay
        node //= 2
        pairs = list(zip(winners[::2], winners[1::2]))
        winners = [a if ahead(a, b) else b for a, b in pairs]
        losers[node : node + len(pairs)] = [b if w == a else a for w, (a, b) in zip(winners, pairs)]
    while winners and row[best := winners[0]] is not None:
        yield row[best]
        row[best] = next(heads[best], None)
        node = (size + best) // 2
        while node:
            if ahead(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2
        winners[0] = best


def history(found: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """captures in the order of url_key, date, run and record, with their place in it.

    Ranges have about range_rows rows; captures of one URL key may be in several, parted
    by time. One count a range comes to the driver. Equal captures stand in the order of
    their files and records; an empty table gives an empty result.
    """
    spark = found.sparkSession
    order = ["url_key", "date", "run", "record"]
    ranges = max(1, -(-found.count() // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(found.repartitionByRange(ranges, *order).sortWithinPartitions("run", "url_key", "date", "record").withColumn("_range", F.spark_partition_id()))
    before, total = {}, 0
    for r in dealt.groupBy("_range").count().orderBy("_range").collect():
        before[r["_range"]], total = total, total + r["count"]
    names = dealt.columns[:-1]
    keys = [names.index(c) for c in order]

    def merge(batches):
        here = pa.Table.from_batches(list(batches), pa_schema) if (batches := list(batches)) else None
        if here is None or not here.num_rows:
            return
        runs: dict[str, list[tuple]] = {}
        columns = [here.column(k).to_pylist() for k in keys]
        for n, key in enumerate(zip(*columns)):
            runs.setdefault(key[2], []).append((*key, n))
        places = pa.array([key[-1] for key in merged(list(runs.values()))], pa.int64())
        first = before[here.column("_range")[0].as_py()]
        ordered = here.take(places).drop_columns(["_range"]).append_column("place", pa.array(range(first, first + len(places)), pa.int64()))
        yield from ordered.to_batches(4096)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(dealt.schema)
    return dealt.mapInArrow(merge, CAPTURE + ", place bigint")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = captures(spark, path)
    remove(spark, path)
    return history(found).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place", "payload_ok")
