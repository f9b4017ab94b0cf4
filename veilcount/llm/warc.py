"""WARC archives, revisit records, and a globally ordered capture index.

Every task writes one archive: gzip members, one a record, as rows of a table in the shared folder
(archive, offset, length, member), so that any store that Spark writes to will do. The tasks that
read archives back sort what they read by URL key and timestamp and write it: a run each. Runs are
merged externally: a range partitioner cuts the key space into ranges of a bounded number of
captures, and each task merges the parts of the runs that fall in its range with a loser tree. A
capture's number in the global order is its range's first number and its place there.

A null page body is the empty payload, a null URL the empty key. A null page id is written and read
back as such and never becomes the original of a revisit. Of repeated rows with one id and body,
all are responses. An empty table gives no archives and no rows. Columns not named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilcount.llm._shared import materialize, table, text_of

#: Smaller payloads aren't worth a revisit record.
LEAST_BYTES = 1000
#: Captures that one task merges, about.
RANGE_CAPTURES = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)

ARCHIVES = "archive int, offset long, length int, member binary"
CAPTURES = (
    "archive int, offset long, url_key string, captured string, page_id long, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, so that a site's captures sort together."""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def captured_at(page_id: int | None) -> str:
    """The tables have no times; pages count as captured a second apart, in the order of their ids."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def write_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record. A revisit has the headers of the full payload but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_uri(page_id)}",
        f"WARC-Date: {captured_at(page_id)}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_uri(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(member: bytes) -> dict:
    """The fields of one gzip member; a response's length and digest are those of its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response":
        digest = hashlib.sha1(payload).hexdigest()
        if digest != stated or size != len(payload):
            raise ValueError("a payload doesn't match its record")
    number = lambda uri: int(x) if (x := uri.strip("<>").rpartition(":")[2]) else None
    return {
        "url_key": url_key(fields["warc-target-uri"]),
        "captured": fields["warc-date"],
        "page_id": number(fields["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def write_archives(
    pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", body_col: str = "html"
) -> DataFrame:
    """Archives of all pages; equal payloads are stored once, with the largest page id."""
    own = pages.select(
        F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(body_col).alias("html")
    )
    own = own.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= least_bytes
    repeated = own.where(large).groupBy(F.col("digest").alias("repeated"))
    repeated = repeated.agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that Spark splits a hot digest; small pages have nothing to meet and move nowhere.
    met = own.where(large).join(materialize(repeated, "originals"), F.col("digest") == F.col("repeated"), "left")
    other = F.coalesce(F.col("original") != F.col("page_id"), F.col("original").isNotNull())
    met = met.withColumn("refers_to", F.when(other, F.col("original")))
    small = own.where(~large).withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "url", "html", "digest", "refers_to"]
    dealt = met.select(columns).unionByName(small.select(columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, len(batch), 128):
                out = []
                part = batch.iloc[k : k + 128]
                columns = (part[c].array for c in ("page_id", "url", "html", "digest", "refers_to"))
                for page_id, url, html, digest, original in zip(*columns, strict=True):
                    page_id, original = (None if pd.isna(x) else int(x) for x in (page_id, original))
                    record = write_record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, original)
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = squeeze.compress(record) + squeeze.flush()
                    out.append((archive, at, len(member), member))
                    at += len(member)
                yield pd.DataFrame(out, columns=["archive", "offset", "length", "member"])

    return materialize(dealt.mapInPandas(run, ARCHIVES), "warc", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row for each record, with the number of the run that it lies in: runs are sorted and written."""
    names = [c.split()[0] for c in CAPTURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = zip(batch["archive"].array, batch["offset"].array, batch["member"].array, strict=True)
            found = [{"archive": a, "offset": o} | read_record(bytes(m)) for a, o, m in places]
            yield pd.DataFrame(found, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    read = archives.select("archive", "offset", "member").mapInPandas(run, CAPTURES)
    return materialize(read.withColumn("run", F.spark_partition_id()).sortWithinPartitions("run", *ORDER), "runs")


#: What captures are ordered by: key and time, then what tells any two apart. Nulls come first.
ORDER = ("url_key", "captured", "page_id", "archive", "offset")


def loser_tree_merge(runs: list[Iterable], key: Callable) -> Iterator:
    """Merge sorted runs. Inner nodes keep the loser of their match, so each step replays one path."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    if not k:
        return
    end = (1,)
    heads = [next(s, None) for s in sources]
    keys = [end if h is None else (0, key(h)) for h in heads]
    losers = [-1] * k  # losers[0] holds the winner

    def replay(i: int) -> None:
        node = (i + k) // 2
        while node:
            other = losers[node]
            if other < 0:  # the first to come here waits for the other side
                losers[node] = i
                return
            if (keys[other], other) < (keys[i], i):
                losers[node], i = i, other
            node //= 2
        losers[0] = i

    for i in range(k):
        replay(i)
    while keys[losers[0]] != end:
        i = losers[0]
        yield heads[i]
        heads[i] = next(sources[i], None)
        keys[i] = end if heads[i] is None else (0, key(heads[i]))
        replay(i)


def ordered_captures(captures: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Runs to captures in global order: capture_no counts from 0 by key, time, id and place.

    No two captures are equal in that order, so a site with very many captures, or one page repeated,
    spreads over ranges. A task holds columns of the captures of its range, not their bodies.
    """
    ranges = 1 + captures.count() // range_captures
    ranged = captures.repartitionByRange(ranges, *ORDER).sortWithinPartitions("run", *ORDER)
    names = captures.columns

    def key(row: tuple) -> tuple:
        page_id = row[names.index("page_id")]
        known = (-1, 0) if pd.isna(page_id) else (0, page_id)
        url_key, captured, archive, offset = (row[names.index(c)] for c in ("url_key", "captured", "archive", "offset"))
        return url_key.encode("utf-8", "surrogatepass"), captured, known, archive, offset

    def one_run(parts: list[pd.DataFrame]) -> Iterator[tuple]:
        for part in parts:
            yield from part.itertuples(index=False, name=None)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list[pd.DataFrame]] = {}
        for batch in batches:
            for number, part in batch.groupby("run", sort=False):
                runs.setdefault(number, []).append(part)
        part, out, place = TaskContext.get().partitionId(), [], 0
        for row in loser_tree_merge([one_run(r) for r in runs.values()], key):
            out.append((*row, part, place))
            place += 1
            if len(out) == 10_000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        found = pd.DataFrame(rows, columns=[*names, "order_part", "order_place"])
        return found.astype({"page_id": "Int64", "refers_to": "Int64"})

    merged = materialize(ranged.mapInPandas(merge, f"{CAPTURES}, run int, order_part int, order_place long"), "merged")
    sizes = merged.groupBy("order_part").agg(F.count("*").alias("n"))
    before = Window.orderBy("order_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    bases = sizes.select(F.col("order_part").alias("part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = merged.join(F.broadcast(bases), F.col("order_part") == F.col("part"))
    return numbered.withColumn("capture_no", F.col("base") + F.col("order_place")).drop("part", "base", "run")


def op10_warc(spark, sf_dir):
    captures = ordered_captures(read_archives(write_archives(table(spark, sf_dir, "pages"))))
    return captures.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no"
    )
