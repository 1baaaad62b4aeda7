"""WARC archives with revisit records, and a two-level capture index over them.

Writing: pages meet the largest page_id of their payload by a join on digest and length, and tasks write archives of one gzip member per record into the shared folder. A file's name holds the task
attempt, so a task that runs again writes another file, and the index names the files of the attempts that counted.

Index: captures are range-partitioned and sorted by reversed-host (SURT) key. Each task packs its captures into
compressed blocks and writes a sparse directory of the blocks beside them; the first keys of these files are the upper
level. A lookup finds its file by binary search over the first keys, its block by binary search in that file's
directory, reads the block's byte range, searches it, and reads the record's byte range from the archive.

Files are opened through pyarrow.fs, so that the folder may be in any store it knows. A null html is an empty payload, a
null url has the empty key; ties of key are told apart by page_id. Repeated rows of a page are records of their own, all
of the same type. A null page_id counts as smaller than all others. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import NO_ID, ROWS, doc_key, materialize, shared_dir, slices

BLOCK_LINES, ARCHIVE_BYTES = 1000, 512 << 20
#: Archive bytes, and look-ups, of a reading task, where there is more than one for every core.
READ_BYTES, LOOKUPS = 128 << 20, 1_000_000
_DATE = "2024-01-01T00:00:00Z"


def store(uri: str):
    """(file system, path) of a URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def surt(url: str | None) -> str:
    """com,example,blog)/path?query: the host reversed, without scheme, user, port, leading www and fragment."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", (url or "").strip()).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host = re.sub(r"^www\d*\.", "", host.rsplit("@", 1)[-1].split(":", 1)[0].lower())
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + ")/" + path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    name = digest(payload)
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, name)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{name}",
        f"X-Page-ID: {page_id}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, name)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; http_length is the payload's length as the HTTP head has it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    return fields | {"payload": payload, "http_length": int(length[1])}


_CAPTURE = "key string, page_id long, archive string, offset long, size long"


def _write_archives(folder: str, most_bytes: int):
    def run(frames):
        fs, root = store(folder)
        task = TaskContext.get()
        stem, made, out, at, name = f"{root}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, None, 0, ""
        try:
            for frame in slices(frames, texts="payload"):
                rows = []
                for r in frame.itertuples(index=False):
                    if out is None or at >= most_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{stem}-{made}.warc.gz", 0
                        made += 1
                        out = fs.open_output_stream(name, compression=None)
                    refers_to = None if pd.isna(r.refers_to) else int(r.refers_to)
                    member = gzip.compress(record(int(r.page_id), r.url, bytes(r.payload), refers_to), 6, mtime=0)
                    out.write(member)
                    rows.append((surt(r.url), r.page_id, name.rsplit("/", 1)[1], at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "size"])
        finally:
            if out is not None:
                out.close()

    return run


def typed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: null for responses."""
    rows = pages.select(
        doc_key("page_id").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"sha1": F.sha1("payload"), "bytes": F.length("payload")})
    last = rows.groupBy("sha1", "bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    # most payloads occur once, and only the others' pages need to look theirs up; what is looked up is written first, so
    # that Spark can split the rows of a frequent payload, by a merge at every size
    last = materialize(last.where("n > 1").drop("n"))
    revisit = (F.col("bytes") >= least_bytes) & (F.col("page_id") != F.col("last"))
    return rows.hint("merge").join(last, ["sha1", "bytes"], "left").select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the captures, as a table of key, page_id, archive, offset and size."""
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    return materialize(typed(pages, least_bytes).mapInPandas(_write_archives(folder, most_bytes), _CAPTURE))


def _write_index(folder: str, lines: int):
    def run(frames):
        fs, root = store(folder)
        task = TaskContext.get()
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        held, blocks, at, first, out = [], [], 0, None, None

        def flush():
            nonlocal at, held, out
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            block = gzip.compress("".join(held).encode(), 6, mtime=0)
            out.write(block)
            blocks.append([*key_of(held[0]), at, len(block)])
            at += len(block)
            held = []

        for frame in frames:
            for r in frame.itertuples(index=False):
                first = first or (r.key, int(r.page_id))
                held.append(f"{r.key} {r.page_id} {r.archive} {r.offset} {r.size}\n")
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as side:
                side.write(json.dumps(blocks).encode())
            yield pd.DataFrame({"key": [first[0]], "page_id": [first[1]], "index": [name]})

    return run


def key_of(line: str) -> tuple[str, int]:
    key, page_id, _ = line.split(" ", 2)
    return key, int(page_id)


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Write blocks and directories; the upper level: first key, its page_id and the file's name, one for each file.

    Python compares the keys by code points, as Spark does, so that the sort holds for the binary searches.
    """
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    ranged = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    made = materialize(ranged.mapInPandas(_write_index(folder, lines), "key string, page_id long, index string"))
    return sorted((r["key"], r["page_id"], r["index"]) for r in made.collect())  # one row a file


class Index:
    """The reader's side of the index; directories are kept once read."""

    def __init__(self, folder: str, top: list[tuple[str, int, str]]):
        self.fs, self.root = store(folder)
        self.first, self.names = [(k, p) for k, p, _ in top], [n for _, _, n in top]
        self.directories: dict[str, tuple] = {}
        self.block = (None, [])

    def _lines(self, file: int, block: int) -> list[str]:
        """A block's lines by a range read; the last one is kept, since lookups come sorted."""
        name = self.names[file]
        starts, places = self._directory(name)
        if self.block[0] != (name, block):
            at, size = places[block]
            with self.fs.open_input_file(f"{self.root}/{name}.cdx.gz") as f:
                self.block = ((name, block), gzip.decompress(f.read_at(size, at)).decode().splitlines())
        return self.block[1]

    def _directory(self, name: str) -> tuple:
        if name not in self.directories:
            if len(self.directories) > 16:
                self.directories.clear()
            with self.fs.open_input_file(f"{self.root}/{name}.dir") as f:
                blocks = json.loads(f.read())
            self.directories[name] = ([(k, p) for k, p, _, _ in blocks], [(a, s) for _, _, a, s in blocks])
        return self.directories[name]

    def find(self, key: str, page_id: int) -> list[tuple[str, int, int]]:
        """(archive, offset, size) of all captures of a key and page; repeated rows may run over block and file ends."""
        wanted, out = (key, page_id), []
        file = bisect_right(self.first, wanted) - 1
        while file >= 0:
            starts, _ = self._directory(self.names[file])
            block = bisect_right(starts, wanted) - 1
            while block >= 0:
                lines = self._lines(file, block)
                high = bisect_right(lines, wanted, key=key_of)
                low = high
                while low and key_of(lines[low - 1]) == wanted:
                    low -= 1
                for line in lines[low:high]:
                    _, _, archive, offset, size = line.split(" ")
                    out.append((archive, int(offset), int(size)))
                if low or not high:
                    return out
                block -= 1
            file -= 1
        return out


_LOOKUP = "archive string, offset long, size long"


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks an amount is dealt to: the tables that name what is read are small, whatever stands behind them."""
    return max(spark.sparkContext.defaultParallelism, -(-amount // each))


def lookup(keys: DataFrame, folder: str, top: list[tuple[str, int, str]], tasks: int) -> DataFrame:
    """The captures of keys(key, page_id), found through the index in so many tasks; keys should be distinct."""
    known = keys.sparkSession.sparkContext.broadcast(top)  # one entry for each index file

    def run(frames):
        index = Index(folder, known.value)
        for frame in slices(frames, 10 * ROWS):
            rows = [c for key, page in zip(frame["key"], frame["page_id"]) for c in index.find(key, int(page))]
            yield pd.DataFrame(rows, columns=["archive", "offset", "size"])

    ranged = keys.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ranged.select("key", "page_id").mapInPandas(run, _LOOKUP)


_RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
    ]
)


def read_records(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records at places(archive, offset, size), by range reads; a response's digest is that of what was read.

    Each of the tasks reads along its range of archives and offsets.
    """

    def run(frames):
        fs, root = store(folder)
        name, file = None, None
        for frame in slices(frames):
            rows = []
            for r in frame.itertuples(index=False):
                if name != r.archive:
                    if file is not None:
                        file.close()
                    name, file = r.archive, fs.open_input_file(f"{root}/{r.archive}")
                found = parse(zlib.decompress(file.read_at(r.size, r.offset), 31))
                own = found["warc-type"] == "response"
                if own and (len(found["payload"]) != found["http_length"] or f"sha1:{digest(found['payload'])}" != found["warc-payload-digest"]):
                    raise ValueError(f"{r.archive} is damaged at {r.offset}")
                refers_to = found.get("x-refers-to-page-id")
                rows.append(
                    (
                        int(found["x-page-id"]),
                        found["http_length"],
                        found["warc-payload-digest"].removeprefix("sha1:"),
                        found["warc-type"],
                        None if refers_to is None else int(refers_to),
                        found["warc-target-uri"],
                    )
                )
            out = pd.DataFrame(rows, columns=_RECORD.names)
            out["refers_to"] = out["refers_to"].astype("Int64")
            yield out
        if file is not None:
            file.close()

    return places.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").mapInPandas(run, _RECORD)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive all pages, index the captures, look every page up and read its record back."""
    spark: SparkSession = pages.sparkSession
    folder = shared_dir(spark)
    captures = write_archives(pages, f"{folder}/archive", least_bytes)
    size = captures.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    top = write_index(captures, f"{folder}/index")
    named = F.pandas_udf(lambda url: url.map(surt), "string")
    keys = pages.select(named("url").alias("key"), doc_key("page_id").alias("page_id")).distinct()
    places = materialize(lookup(keys, f"{folder}/index", top, tasks_for(spark, size["n"], LOOKUPS)))
    records = read_records(places, f"{folder}/archive", tasks_for(spark, size["bytes"], READ_BYTES))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return records.select(real("page_id"), "payload_bytes", "payload_digest", "record_type", real("refers_to"), "url")
