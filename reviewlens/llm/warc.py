"""Web archives: written by Spark, read back, and indexed by an external merge.

Pages become WARC records. Of pages with equal payloads one record is the response and
the others revisit it. Reading an archive yields a run of captures sorted by URL key and
time; runs are cut by ranges of the key, and in each range a loser tree merges them, so
the parts of the result are, one after the other, the ordered history of all captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import durable, shared_folder, stored
from reviewlens.sizing import join_dimension

RECORDS_PER_FILE = 2_000
RANGE_ROWS = 50_000
"""Records of an archive at the most, and captures that one task merges on average."""

EPOCH = 1_577_836_800
"""Pages without a time of capture count as taken so many seconds after 1970, plus their id."""

HEX_BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "run string, place int, url_key string, captured string, page_id bigint, url string, "
CAPTURE += "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def payload_digest(payload: Column) -> Column:
    """The SHA-1 of the UTF-8 text as bare upper-case base32: twenty bits are four letters."""
    digest = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digest, 1 + 5 * at, 5), 16, 32), 4, "0") for at in range(8)]
    return F.translate(F.concat(*fours), HEX_BASE32, BASE32)


def captures(pages: DataFrame, captured: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """``pages`` as records: ``page_id``, ``url``, ``payload``, sizes, digest, type, ``refers_to``.

    A null html is an empty payload. Of records with equal payloads of at least
    ``least_bytes`` bytes, that with the largest ``page_id`` is the response; rows that
    share that id are responses all. A null id is smaller than any other. Smaller
    payloads are responses all. Only digests that two records share are looked up, by
    broadcast if they are few, else with a very common one spread over tasks; payloads
    are not gathered by digest.
    """
    if captured is None:
        seconds = EPOCH + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))
        captured = F.timestamp_seconds(seconds)
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        payload_digest(payload).alias("payload_digest"),
        F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    repeated = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
    repeated = repeated.agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    joined = join_dimension(rows, stored(repeated), ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("largest")).alias("refers_to"),
    )


def _record() -> Column:
    """A record as text: headers, a blank line, the block, a line end; the writer adds another."""

    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    def page(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    profile = F.concat(line("WARC-Profile", REVISIT), line("WARC-Refers-To", page(F.col("refers_to"))))
    block_bytes = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", page(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.col("captured")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, profile).otherwise(""),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", block_bytes.cast("string")),
        F.lit("\r\n"),
        http,
        F.when(revisit, "").otherwise(F.col("payload")),
        F.lit("\r\n"),
    )


def write_archives(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """The records as gzipped WARC files in the folder, in any file system that Spark writes to."""
    texts = records.select(_record().alias("value"))
    writer = texts.write.option("lineSep", "\r\n").option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


def url_key(url: str) -> str:
    """The URL in the order that sorts a host with its subdomains: reversed host, then the path."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, one at a time."""
    while first := stream.readline():
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers = _headers(stream)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends inside a record")
        yield headers, block


def _headers(stream) -> dict[str, str]:
    found = {}
    while (line := stream.readline()).strip():
        name, _, value = line.decode("utf-8").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def capture_run(name: str, content: bytes) -> list[tuple]:
    """The captures of one archive, sorted; a response whose payload lost its digest is an error."""
    rows = []
    with gzip.open(io.BytesIO(content)) as stream:
        for headers, block in read_records(stream):
            body = io.BytesIO(block)
            body.readline()
            size = int(_headers(body)["content-length"])
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            if headers["warc-type"] == "response":
                payload = body.read()
                if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"damaged payload in {name}")
            rows.append(
                (
                    url_key(headers["warc-target-uri"]),
                    headers["warc-date"],
                    _page(headers["warc-record-id"]),
                    headers["warc-target-uri"],
                    headers["warc-type"],
                    size,
                    digest,
                    _page(headers.get("warc-refers-to")),
                )
            )
    rows.sort(key=lambda row: (row[0], row[1], row[2] is not None, row[2]))
    return rows


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A sorted run for each archive of the folder: ``run``, ``place`` in it, and the capture."""
    schema = pa.schema(
        [("run", pa.string()), ("place", pa.int32()), ("url_key", pa.string()), ("captured", pa.string())]
        + [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64())]
        + [("payload_digest", pa.string()), ("refers_to", pa.int64())]
    )

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                run = name.as_py()
                rows = [(run, place, *row) for place, row in enumerate(capture_run(run, content.as_py()))]
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parsed, CAPTURE)


class LoserTree:
    """Merges sorted runs: each step replays the one path from the run that last won.

    An inner node holds the run that lost there. Runs that are used up lose to all others.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * max(1, len(runs))
        for run in reversed(range(len(runs))):
            self._replay(run)

    def _beats(self, run: int, other: int) -> bool:
        mine, theirs = self.heads[run], self.heads[other]
        if mine is None or theirs is None:
            return theirs is None and (mine is not None or run < other)
        return (mine, run) < (theirs, other)

    def _replay(self, run: int) -> None:
        """``run`` climbs to the root; whoever wins a match goes on, the other stays.

        While the tree is built a run stays at the first node that no one has reached.
        """
        node = (run + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] == -1:
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                run, self.losers[node] = self.losers[node], run
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            run = self.losers[0]
            head = self.heads[run]
            if head is None:
                return
            yield head
            self.heads[run] = next(self.runs[run], None)
            self._replay(run)


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of URL key, time and page, part after part.

    ``runs`` is read twice, so it should be a stored table. Ranges are cut by the whole
    key, so a URL captured very often is spread over many.
    """
    names = runs.columns
    key = ["url_key", "captured", F.coalesce("page_id", F.lit(-(1 << 63))), "run", "place"]
    ranges = max(1, -(-runs.count() // range_rows))
    # Within a range each run is in its own order; the runs lie one after the other.
    laid = runs.repartitionByRange(ranges, *key).sortWithinPartitions("run", "place")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        if not tables:
            return
        whole = pa.Table.from_batches(tables).combine_chunks()
        runs_of, keys, pages = (whole.column(name).to_pylist() for name in ("run", "url_key", "page_id"))
        times = whole.column("captured").to_pylist()
        starts = [at for at in range(len(runs_of)) if at == 0 or runs_of[at] != runs_of[at - 1]]

        def run(start: int, end: int) -> Iterator[tuple]:
            for at in range(start, end):
                yield keys[at], times[at], pages[at] is not None, pages[at] or 0, at

        tree = LoserTree([run(a, b) for a, b in zip(starts, [*starts[1:], len(runs_of)], strict=True)])
        order = pa.array([head[-1] for head in tree], pa.int64())
        yield from whole.take(order).to_batches(max_chunksize=10_000)

    return laid.mapInArrow(merged, runs.schema).select(*names)


def capture_history(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes the pages as archives, reads these back and merges their index.

    One row per page row, in the order of URL key and time. ``path`` must not exist; by
    default it is a new folder under the shared one. Pages that repeat are recorded as
    often; an empty table gives an empty history.
    """
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures(pages, least_bytes=least_bytes), path)
    return merge_runs(durable(read_runs(spark, path)))
