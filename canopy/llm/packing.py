"""Best-fit packing planned over the histogram of lengths.

Documents become token ids plus one closing 0 and are cut into pieces of at most `capacity` tokens. The plan never
looks at documents: best-fit decreasing runs over (length, count), which is at most `capacity` rows, and yields ranges
of slots. A piece then takes the slot of its rank among the pieces of its length, by a join.

Tokenization meets no shuffle. A task numbers its own pieces of each length; counts by (length, task) give every task
the rank it starts from, so no length, however frequent, meets in one task.

Null texts count as empty (one token, the closing 0). An empty table gives no rows. Repeated rows are packed as rows of
their own. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from zlib import crc32

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import materialize, slices

CAPACITY = 2048
_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("task", T.LongType()),
        T.StructField("rank_in_task", T.LongType()),
    ]
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Words(dict):
    """Ids, as little-endian bytes, of a run of text without ASCII blanks.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its runs in order. Runs of
    Latin-1 letters, digits and marks are looked up by parts; others go to the tokenizer whole.
    """

    LETTER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
    MOST = 500_000

    def __init__(self, vocabulary: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.merge = self.tokenizer.model.tokenize
        #: The visible character of each byte: printable Latin-1 stands for itself, the others follow U+0100.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.shown = [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]
        self.parts: dict[str, bytes] = {}
        self.split = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{self.LETTER}]+|[{self.DIGIT}]|[^\t-\r \x85\xa0{self.LETTER}{self.DIGIT}]+"
        ).findall
        self.plain = re.compile("(?s)(?!.*<\\|)[\x00-\xff]*").fullmatch
        #: The shortcut is taken only for a vocabulary that it reproduces on a probe.
        probe = "It's 12 A\xc9t\xe9--x/\xb2 don't&&& \xbd \x01\x7f\xad \xb5m\xdf, na\xefve\xa0x"
        self.short = True
        if b"".join(map(self.__missing__, probe.split(" "))) != self.encode(probe):
            self.short = False
            self.clear()

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            shown = text if text.isascii() and text.isprintable() else "".join(map(self.shown.__getitem__, text.encode()))
            found = self.parts[text] = array("I", [t.id for t in self.merge(shown)]).tobytes()
        return found

    def __missing__(self, run: str) -> bytes:
        if self.short and self.plain(run):
            ids = b"".join(map(self.part, self.split(run.lower())))
        else:
            ids = self.encode(run)
        self[run] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        if len(self) > self.MOST:
            self.clear()
        if len(self.parts) > self.MOST:
            self.parts.clear()
        if not self.short:
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_words: dict[str, _Words] = {}


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, with the task that cut it and its rank among that task's pieces of the same length."""

    def cut(frames):
        if vocabulary not in _words:
            _words[vocabulary] = _Words(vocabulary)
        words = _words[vocabulary]
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for frame in slices(frames, texts="text"):
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                ids = words.of_text(text or "") + b"\0\0\0\0"
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, crc32(part), task, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=_PIECES.names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(cut, _PIECES)


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram: (length, first rank, ranks, first sequence, per sequence, offset) and the number of sequences.

    Sequences with equal room are held as ranges. Best fit puts the next item of a length into the sequence that just
    took one while it still fits, so a range takes room // length items a sequence.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, used = [], 0

    def put(free: int, first: int, n: int) -> None:
        if free > 0 and n > 0:
            if free not in room:
                room[free] = []
                insort(rooms, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                free = rooms[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], rooms[at]
            else:
                free, first, n = capacity, used, -(-left // (capacity // length))
                used += n
            each = free // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            if full:
                slots.append((length, rank, full * each, first, each, capacity - free))
                put(free - each * length, first, full)
            if rest:
                slots.append((length, rank + full * each, rest, first + full, rest, capacity - free))
                put(free - rest * length, first + full, 1)
            put(free, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * each + rest
            left -= full * each + rest
    return slots, used


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document."""
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, vocabulary or default_vocabulary(), capacity))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # at most `capacity` rows, whatever the input
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan_slots(counts, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from_rank"))
    plan = spark.createDataFrame(slots, "slot_length long, lo long, ranks long, first_sequence long, each long, base long")
    ranked = pieces.join(starts, ["length", "task"]).withColumn("rank", F.col("from_rank") + F.col("rank_in_task"))
    inside = F.col("rank") - F.col("lo")
    # a plan has a few ranges for each of at most `capacity` lengths; Spark broadcasts it by its size
    return ranked.join(
        plan,
        (F.col("length") == F.col("slot_length")) & (inside >= 0) & (inside < F.col("ranks")),
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(inside / F.col("each"))).alias("sequence_id"),
        (F.col("base") + inside % F.col("each") * F.col("length")).alias("offset"),
    )
