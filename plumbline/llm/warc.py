"""Operator 9: WARC files, written by Spark and read in parallel byte ranges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

RANGE = 16 << 20
RANGE_TASKS = 100_000  # tasks at most that read ranges; a task can have several
_MAGIC = b"WARC/1."
_GZIP = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_CHUNK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"


def write(pages: DataFrame, path: str) -> None:
    """Write (page_id, url, html) as response records, one WARC file a partition.

    The text sink writes the bytes of each record and the two line ends after
    it, so Spark's commit protocol covers lost and repeated tasks.  A null
    page has a record without an HTTP response; null ids and addresses have no
    field; line ends in an address are percent-encoded.
    """
    crlf = "\r\n"
    body = F.coalesce(F.col("html"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.octet_length(body).cast("string"), F.lit(crlf * 2), body)
    block = F.when(F.col("html").isNotNull(), http).otherwise(F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    digest = F.md5(F.concat_ws("\x1f", F.col("page_id").cast("string"), F.col("url"), F.col("html")))
    part = lambda a, n: F.substring(digest, a, n)
    urn = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    field = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit(crlf)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: response{crlf}WARC-Date: {_DATE}{crlf}WARC-Record-ID: <urn:uuid:"),
        urn,
        F.lit(f">{crlf}"),
        field("WARC-Target-URI", url),
        field("X-Page-Id", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(crlf * 2),
    )
    pages.select(F.concat(head, block).alias("value")).write.option("lineSep", crlf * 2).text(path)


class _File:
    """Random reads of one file through a window of bytes."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()
        self.at, self.window = 0, b""

    def read(self, start: int, n: int) -> bytes:
        """n bytes from start, fewer at the end of the file."""
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.window)):
            self.at, self.window = start, self.file.read_at(max(n, min(1 << 20, self.size - start)), start)
        return self.window[start - self.at : start - self.at + n]

    def find(self, what: bytes, start: int, end: int) -> Iterator[int]:
        """Places of ``what`` that begin in start to end."""
        while start < end:
            n = min(1 << 22, end - start)
            chunk = bytes(self.file.read_at(min(n + len(what) - 1, self.size - start), start))
            at = chunk.find(what)
            while 0 <= at < n:
                yield start + at
                at = chunk.find(what, at + 1)
            start += n


def fields(head: bytes) -> dict[str, str] | None:
    """Named fields of a record's head, without the line ends after it; None if it isn't one."""
    first, *lines = head.split(b"\r\n")
    if not first.startswith(_MAGIC):
        return None
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        last = name.strip().decode("latin-1").lower()
        found.setdefault(last, value.strip().decode("utf-8", "replace"))
    return found if found.get("content-length", "").isdecimal() else None


def _plain(f: _File, at: int, content: bool) -> tuple[int, dict[str, str], bytes] | None:
    """(place of the next record, fields, block) of the record at ``at``; None if there is none."""
    n = _CHUNK
    while True:
        chunk = f.read(at, n)
        stop = chunk.find(_END)
        if stop >= 0 or len(chunk) < n:
            break
        n *= 4
    if stop < 0 or not (found := fields(chunk[:stop])):
        return None
    body = at + stop + 4
    end = body + int(found["content-length"])
    if end > f.size or f.read(end, 4) != _END[: f.size - end]:
        return None
    return min(end + 4, f.size), found, f.read(body, end - body) if content else b""


def _gzip(f: _File, at: int, content: bool) -> tuple[int, dict[str, str], bytes] | None:
    """The same for a record that is a gzip member by itself."""
    engine, out, place = zlib.decompressobj(31), [], at
    try:
        while not engine.eof:
            chunk = f.read(place, _CHUNK)
            if not chunk:
                return None
            out.append(engine.decompress(chunk))
            place += len(chunk)
            if len(out) == 1 and not _MAGIC.startswith(out[0][: len(_MAGIC)]):
                return None
    except zlib.error:
        return None
    raw = b"".join(out)
    stop = raw.find(_END)
    if stop < 0 or not (found := fields(raw[:stop])):
        return None
    n = int(found["content-length"])
    if len(raw) < stop + 4 + n:
        return None
    return place - len(engine.unused_data), found, raw[stop + 4 : stop + 4 + n] if content else b""


def _record(f: _File, uri: str, at: int, content: bool = False):
    return (_gzip if uri.endswith(".gz") else _plain)(f, at, content)


def candidate_exits(uri: str, start: int, end: int) -> dict[int, int]:
    """For each candidate record that begins in start to end, where its chain leaves the range; -1 if it breaks there.

    A chain leads from a record to its successor.  Inside the range it is
    followed at once, from the last candidate to the first.
    """
    f = _File(uri)
    following = {}
    for at in f.find(_GZIP if uri.endswith(".gz") else _MAGIC, start, end):
        if found := _record(f, uri, at):
            following[at] = found[0]
    exits: dict[int, int] = {}
    for at in sorted(following, reverse=True):
        n = following[at]
        exits[at] = n if n >= end else exits.get(n, -1)
    return exits


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files below path, by Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], system.listFiles(root, True)
    while todo.hasNext():
        s = todo.next()
        if not s.getPath().getName().startswith(("_", ".")) and s.getLen():
            uri = s.getPath().toUri().toString()
            found.append((uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri, s.getLen()))
    return sorted(found)


def reachable(ranges: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, place): where the chain from each file's start enters ranges.

    Tasks emit (candidate, exit) of each range; only candidates that are a
    file's start or another's exit matter.  Pointer jumping then doubles the
    length of the jumps in each round, so a file of n ranges takes log2 n.
    """

    def run(tables):
        for t in tables:
            for file, start, end in zip(t["file"], t["start"], t["end"]):
                exits = candidate_exits(file, int(start), int(end))
                yield pd.DataFrame({"file": file, "place": pd.Series(list(exits), dtype="int64"), "jump": pd.Series(list(exits.values()), dtype="int64")})

    every = scratch.save(ranges.mapInPandas(run, "file string, place long, jump long"), "exits")
    entered = every.where("jump > 0").select("file", F.col("jump").alias("place")).union(every.where("place = 0").select("file", "place")).distinct()
    # candidates compress so well that their files look small enough to broadcast
    jumps = scratch.save(every.join(entered.hint("merge"), ["file", "place"]).where("jump > 0"), "jumps")
    reached = scratch.save(every.where("place = 0").select("file", "place"), "reached")
    count = reached.count()
    while True:
        further = reached.join(jumps, ["file", "place"]).select("file", F.col("jump").alias("place"))
        grown = scratch.save(reached.union(further).distinct(), "reached")
        more = grown.count()
        if more == count:
            return grown
        reached, count = grown, more
        onward = jumps.select("file", F.col("place").alias("jump"), F.col("jump").alias("onward"))
        jumps = scratch.save(jumps.join(onward, ["file", "jump"]).select("file", "place", F.col("onward").alias("jump")), "jumps")


def read(spark: SparkSession, path: str, scratch: Scratch, range_bytes: int = RANGE) -> DataFrame:
    """(file, offset, type, url, page_id, block, payload) of the records of all files below path.

    Files are cut into byte ranges without regard to records.  A record's
    first bytes may as well be inside another's block, so a range alone
    can't tell them apart: the chain from the file's first record, by way of
    lengths, decides.  Files ending in .gz hold one gzip member a record.

    A record counts if it has a version line, named fields, a Content-Length
    that the file has room for, and (uncompressed) two line ends after it.
    Records after a break in the chain are not reached; a file that doesn't
    begin with a record has none, and empty files are passed over.  payload
    is the block without HTTP head for response records, else null; page_id
    and url are null if the field is missing, page_id too if it isn't a number.
    """
    files = _files(spark, path)
    n = sum(-(-size // range_bytes) for _, size in files)
    # the driver knows the files only, their ranges are made by the executors
    every = spark.createDataFrame(files, "file string, size long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long")))
    ranges = every.select("file", start.alias("start"), "size").select("file", "start", F.least(F.col("start") + range_bytes, "size").alias("end"))
    ranges = ranges.repartition(max(1, min(n, RANGE_TASKS)), "file", "start")
    entry = reachable(ranges, scratch).select("file", (F.floor(F.col("place") / range_bytes) * range_bytes).alias("start"), "place").groupBy("file", "start").agg(F.min("place").alias("entry"))
    work = ranges.join(entry, ["file", "start"])

    def run(tables):
        for t in tables:
            for uri, end, at in zip(t["file"], t["end"], t["entry"]):
                f, at, out, held = _File(uri), int(at), [], 0
                while at < end:
                    found = _record(f, uri, at, True)
                    if not found:
                        break
                    n, names, block = found
                    head, gap, rest = block.partition(_END)
                    payload = rest if names.get("warc-type") == "response" and gap and head.startswith(b"HTTP/") else None
                    page = names.get("x-page-id", "")
                    out.append((uri, at, names.get("warc-type"), names.get("warc-target-uri"), int(page) if page.lstrip("-").isdecimal() else None, block, payload))
                    held += len(block)
                    at = n
                    if held > 1 << 23:
                        yield _frame(out)
                        out, held = [], 0
                if out:
                    yield _frame(out)

    return work.mapInPandas(run, "file string, offset long, type string, url string, page_id long, block binary, payload binary")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=["file", "offset", "type", "url", "page_id", "block", "payload"], dtype=object)
    return table.astype({"offset": "int64"}).assign(page_id=table["page_id"].astype("Int64"))


def round_trip(pages: DataFrame, scratch: Scratch, range_bytes: int = RANGE) -> DataFrame:
    """(page_id, url, html) of pages, written as WARC files to the shared folder and read again.

    Nulls in any column come back as nulls; html may hold anything, records
    of its own too.  Repeated rows are records of their own.  Other columns
    are ignored.  No pages, no rows.
    """
    at = f"{scratch.path}/warc"
    write(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), at)
    return read(pages.sparkSession, at, scratch, range_bytes).select("page_id", "url", F.col("payload").cast("string").alias("html"))
