"""WARC archives of pages, and their index merged from locally sorted runs.

``write`` makes a response or revisit record of every page.  The text writer
separates records by the two line ends that WARC asks for, so each part file is
an archive, compressed as a whole, and survives retries like any other table.

``read`` parses the archives by Content-Length, checks every payload against
its digest and lists each archive's captures sorted by URL key and time: a
run.  ``merge`` deals the runs over ranges of (key, time, page) and merges the
pieces of all runs that meet in a range with a loser tree, so the result is
ordered as a whole.  A range holds about ``ENTRIES`` captures, and as a range
may end inside one URL, a URL with very many captures is split.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, that with the
largest id is the response, the others revisit it.  Payloads are compared by
length and SHA-256.

Defined cases: null html is an empty payload; a null or empty url becomes
``urn:page:`` and the id; white space and control characters in a url are
percent-encoded; pages that repeat an id and a payload are all responses if that
id is the largest; a page with a null id revisits, or is a response if its group
has no id; an empty table gives an empty index; other columns are ignored.
Where no capture time is given, it is the id in seconds.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_root
from .common import attach, materialise, ship_package

MIN_REVISIT, PER_ARCHIVE, ENTRIES = 1000, 5000, 20_000
END = "\r\n\r\n"
INDEX = "urlkey string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"
FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def records(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """One WARC record (column ``value``, without its final line ends) per row of pages (page_id, url, html)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    seconds = captured if captured is not None else F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(4_000_000_000))
    url = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), html.alias("html"), seconds.cast("long").alias("seconds"),
        F.when(F.length(url) > 0, url).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"),
        F.octet_length(html).alias("bytes"), F.sha1(html.cast("binary")).alias("digest"))
    content = F.when(F.col("bytes") >= MIN_REVISIT, F.concat_ws(":", F.col("bytes").cast("string"), F.sha2("html", 256)))
    rows = rows.withColumn("content", content)
    groups = rows.where("content IS NOT NULL").groupBy("content").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    rows = attach(rows, materialise(groups, "payloads"), "content", "pages")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    rows = rows.withColumn("revisit", revisit)
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds("seconds"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    refers = F.when(F.col("revisit"), F.concat(
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"),
        F.col("response").cast("string"), F.lit(">"))).otherwise("")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name,
        F.lit("\r\nWARC-Date: "), date, F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), refers,
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, captured: Column | None = None, per_archive: int = PER_ARCHIVE) -> None:
    """Archives of up to ``per_archive`` records each."""
    records(pages, captured).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(folder)


def url_key(url: str) -> str:
    """Host labels in reverse order, then path and query: captures of one site sort together."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url.lower()
    rest = rest.partition("#")[0]
    at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:at].lower().rpartition("@")[2], rest[at:] or "/"
    host, _, port = host.partition(":")
    host = host.removeprefix("www.")
    port = "" if port in ("", "80", "443") else ":" + port
    return ",".join(reversed(host.split("."))) + port + ")" + path


def parse(archive: bytes):
    """(offset, headers, HTTP headers, payload) of every record of a compressed archive, one at a time."""
    unpack = zlib.decompressobj(31)
    held, base, place = b"", 0, 0
    end = END.encode()

    def more():
        nonlocal held, place
        while place < len(archive):
            part = unpack.decompress(archive[place:place + (1 << 18)])
            place += 1 << 18
            if part:
                held += part
                return True
        return False

    while True:
        while (stop := held.find(end)) < 0:
            if not more():
                if held.strip():
                    raise ValueError("archive ends inside a record")
                return
        lines = held[:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {base}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        whole = stop + 4 + size + 4
        while len(held) < whole:
            if not more():
                raise ValueError("archive ends inside a record")
        block = held[stop + 4:stop + 4 + size]
        if held[whole - 4:whole] != end:
            raise ValueError(f"record at {base} does not end where it says")
        http, _, payload = block.partition(end)
        yield base, headers, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload
        held, base = held[whole:], base + whole


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def captures(archive: bytes, name: str) -> list[tuple]:
    """Index entries of an archive, sorted: a run."""
    out = []
    for offset, head, http, payload in parse(archive):
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        response = head["WARC-Type"] == "response"
        if response and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])):
            raise ValueError(f"payload at {offset} of {name} does not match its digest")
        refers = _page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
        stamp = "".join(c for c in head["WARC-Date"] if c.isdigit())
        out.append((url_key(head["WARC-Target-URI"]), stamp, _page(head["WARC-Record-ID"]), head["WARC-Type"], int(http["Content-Length"]), digest, refers, name, offset))
    out.sort(key=order)
    return out


def order(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[7], entry[8]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives of a folder, the run of each archive in order."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield _batch(captures(content.as_py(), path.rpartition("/")[2]))

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, INDEX)


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f.split()[1] == "long" else pa.string() for f in INDEX.split(", ")]
    columns = list(zip(*entries)) if entries else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], FIELDS)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < max(len(runs), 1):
            self.size *= 2
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _next(self, i):
        entry = next(self.runs[i], None) if i < len(self.runs) else None
        return None if entry is None else (order(entry), i, entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def __iter__(self):
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            at = self.winner
            self.heads[at] = self._next(at)
            node = (at + self.size) // 2
            while node:
                if self._before(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merge(runs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """All captures in the order of URL key, time, page and place."""
    runs = materialise(runs, "runs")
    ranges = max(1, -(-runs.count() // entries))

    def run(batches):
        pieces: dict[str, list] = {}
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                pieces.setdefault(entry[7], []).append(entry)
        for piece in pieces.values():
            piece.sort(key=order)  # already sorted, if the shuffle kept it so
        out = []
        for entry in LoserTree(list(pieces.values())):
            out.append(entry)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    place = [F.col("urlkey"), F.col("timestamp"), F.coalesce("page_id", F.lit(-1)), F.col("archive"), F.col("offset")]
    return runs.repartitionByRange(ranges, *place).mapInArrow(run, INDEX)


def archived(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder and return their merged index."""
    spark = pages.sparkSession
    folder = f"{scratch_root(spark)}/spotfield/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    write(pages, folder, captured)
    return merge(read(spark, folder))
