"""Near-duplicate documents by an LSH forest over MinHash signatures.

A signature is cut into trees. Each tree orders documents by its own label, a run of hashes; documents whose labels share
a long enough prefix stand together there and are neighbours. The prefix starts short and grows only in regions that hold
too many documents, so dense regions are cut finer than sparse ones. A lower bound on similarity gets more and shallower
trees, so that at full depth a link at the bound has a chance of at most MISSED to be in no region: 16 trees of 6 hashes
for 85 percent, 19 of 5 for 80.

Inside a region documents come in the order of their labels. They are compared by sketches, 8 bits of each hash: a link
at the bound shows fewer than `needed` equal ones with a chance of about 1e-9. What remains are candidate clusters,
usually of a few documents. Only they get their texts, once each, and links are confirmed on the full shingle sets.

Only the components of links are asked for, so regions and clusters are searched breadth first: a document that is
reached is compared with those not reached yet. A group of copies costs about one comparison a document and no pair is
ever written. Those that are too large for one task are dealt into chunks; after a first pass the documents outside the
main component are compared with all chunks, block by block and only across components, which finds every link that the
first pass could have missed.

Tables that grow with the corpus are joined by sorting at every size: no broadcast of them would have a bound. Those that
a frequent key could skew are read from files on both sides, so that Spark can split it.

Documents with equal shingle sets are one node from the start. Words are runs of non-blank bytes (space, \\t to \\r)
after lower-casing A-Z; a set holds the distinct five-word shingles, or the whole sequence of a shorter text, by 64-bit
hashes of words and shingles. Null and blank texts have the empty set and are linked with nothing. Every row is a
document of its own, those that repeat a doc_id and those without one too. component_id is the smallest doc_id in a
component, null if it holds none; kept says that the row has that id, and for a component without ids marks one row.
An empty table gives no rows. Other columns are ignored, whatever their names, or carried through by keep_one().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import drop_table, materialize, slices
from canopy.llm.components import connected, grouped
from canopy.llm.words import hashed_words, mixed

WORDS, PERCENT = 5, 80
#: Hashes of a signature, those of a tree at most, and depths before the last.
HASHES, LONGEST, FIRST_DEPTHS = 96, 6, (3, 4)
MISSED = 0.0006
#: A task compares at most so many documents and words; larger groups are dealt into chunks.
REGION_DOCS, REGION_WORDS = 4096, 4_000_000

#: Bytes of words: A-Z in lower case, and what stands between words.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) | np.uint64(1)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)


def depths_for(percent: int) -> tuple[int, ...]:
    """The last one is the deepest at which the trees that the hashes suffice for miss no more than MISSED of the links."""
    fits = [d for d in range(1, LONGEST + 1) if (1 - (percent / 100) ** d) ** (HASHES // d) <= MISSED]
    last = max(fits, default=1)
    return (*(d for d in FIRST_DEPTHS if d < last), last)


def needed(percent: int) -> int:
    """Equal sketch bytes that a link has but for six standard deviations."""
    p = percent / 100
    return max(1, int(HASHES * p - 6 * (HASHES * p * (1 - p)) ** 0.5))


def shingle_sets(texts: list[str | None]) -> list[tuple[int, np.ndarray]]:
    """(words, sorted distinct 64-bit hashes of the shingles) of every text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    first = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    units = _LOWER[np.frombuffer(b"\n".join(raw), np.uint8)]
    starts, _, words = hashed_words(units, _BLANK[units])
    edge = np.searchsorted(starts, first)
    many = max(0, len(words) - WORDS + 1)
    total = np.zeros(many, np.uint64)
    for k in range(WORDS):
        total += words[k : many + k] * _ODD[k]
    total = mixed(total)
    out = []
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
        n = high - low
        if n >= WORDS:
            own = np.unique(total[low : high - WORDS + 1])
        elif n:
            own = mixed((words[low:high] * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) * _ODD[0])
        else:
            own = np.zeros(0, np.uint64)
        out.append((n, own))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _A + _B
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketched(text: pd.Series) -> pd.DataFrame:
    rows = []
    for part in slices([text.to_frame("text")], texts="text"):
        for n, shingles in shingle_sets(part["text"].tolist()):
            if n:
                own = signature(shingles)
                digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
                rows.append((len(shingles), n, digest, own.astype(">u4").tobytes(), own.astype(np.uint8).tobytes()))
            else:
                rows.append((0, 0, None, None, None))
    return pd.DataFrame(rows, columns=["n_shingles", "n_words", "digest", "signature", "sketch"])


class _Sketches:
    """Sketches of a region's documents, compared by the number of equal bytes."""

    def __init__(self, payloads: list[bytes], percent: int):
        self.table, self.needed = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), HASHES), needed(percent)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        return others[(self.table[others] == self.table[one]).sum(axis=1) >= self.needed]


class _Sets:
    """Shingle sets of a cluster's documents, laid out for counting one set's overlap with all others."""

    def __init__(self, payloads: list[str], percent: int):
        sets = [own for _, own in shingle_sets(payloads)]
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        self.edge = np.concatenate(([0], np.cumsum(self.size)))
        distinct, self.shingle = np.unique(np.concatenate(sets), return_inverse=True)
        self.has = np.zeros(len(distinct), bool)

    def linked(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others (positions) have at least `percent` of Jaccard similarity with one."""
        own = self.shingle[self.edge[one] : self.edge[one + 1]]
        self.has[own] = True
        percent = self.percent
        least, most = self.size[one] * percent / 100, self.size[one] * 100 / percent
        others = others[(self.size[others] >= least) & (self.size[others] <= most)]
        if len(others) == len(self.size):
            hits = np.add.reduceat(self.has[self.shingle], self.edge[:-1], dtype=np.int64)
        elif len(others):
            lengths = self.size[others]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            at = np.arange(lengths.sum()) + np.repeat(self.edge[others] - starts, lengths)
            hits = np.add.reduceat(self.has[self.shingle[at]], starts, dtype=np.int64)
        else:
            hits = np.zeros(0, np.int64)
        self.has[own] = False
        return others[100 * hits >= percent * (self.size[one] + self.size[others] - hits)]


def stars_of(ids: list[int], compared) -> list[tuple[int, int]]:
    """(document, smallest document of its component), breadth first in the order in which the documents stand."""
    stars, rest = [], np.arange(len(ids))
    while len(rest) > 1:
        queue, members = [int(rest[0])], [int(rest[0])]
        rest = rest[1:]
        while queue and len(rest):
            found = compared.linked(queue.pop(0), rest)
            rest = np.setdiff1d(rest, found, assume_unique=True)
            queue += found.tolist()
            members += found.tolist()
        root = min(ids[k] for k in members)
        stars += [(ids[k], root) for k in members if ids[k] != root]
    return stars


def _stars(kind, percent):
    def run(frames):
        for group in grouped(frames, ["bucket", "chunk"]):
            if len(group) > 1:
                stars = stars_of(group["node"].tolist(), kind(group["payload"].tolist(), percent))
                yield pd.DataFrame(stars, columns=["a", "b"], dtype="int64")

    return run


def block_links(ids: np.ndarray, asks: np.ndarray, component: np.ndarray, compared) -> list[tuple[int, int]]:
    """Links between the documents that ask and the others, across components only: one for each two that they join."""
    out, others = [], np.flatnonzero(~asks)
    _, root = np.unique(component, return_inverse=True)
    for k in np.flatnonzero(asks):
        apart = others[root[others] != root[k]]
        if not len(apart):
            continue
        found = compared.linked(int(k), apart)
        joined, first = np.unique(root[found], return_index=True)
        out += [(int(ids[k]), int(ids[j])) for j in found[first]]
        root[np.isin(root, joined)] = root[k]
    return out


def _block_links(kind, percent):
    def run(frames):
        for group in grouped(frames, ["bucket", "asked", "chunk"]):
            asks = group["asks"].to_numpy(bool)
            if asks.any() and not asks.all():
                made = kind(group["payload"].tolist(), percent)
                links = block_links(group["node"].to_numpy(np.int64), asks, group["component"].to_numpy(np.int64), made)
                yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _search(members: DataFrame, payloads: DataFrame, kind, percent: int) -> tuple[DataFrame, bool]:
    """Links (a, b) that span the components within every bucket of members(bucket, chunk, chunks, place, node).

    The second value tells whether they are stars around the smallest node of each, as where no bucket has many chunks.
    """
    stars = materialize(
        members.hint("merge").join(payloads, "node")
        .repartition("bucket", "chunk")
        .sortWithinPartitions("bucket", "chunk", "place", "node")
        .select("bucket", "chunk", "node", "payload")
        .mapInPandas(_stars(kind, percent), "a long, b long")
        .distinct()
    )
    large = members.where("chunks > 1")
    if large.isEmpty():
        return stars, True
    component = connected(stars)
    known = large.hint("merge").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = materialize(known.select("bucket", "chunk", "chunks", "node", "component"))
    counts = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("n", F.col("component"))).alias("main"))
    rest = known.join(main, "bucket").where("component <> main").withColumn("asked", F.col("chunk"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    asking = rest.select("bucket", "asked", every, "node", "component", F.lit(True).alias("asks"))
    answering = known.join(rest.select("bucket", "asked").distinct(), "bucket")
    answering = answering.select("bucket", "asked", "chunk", "node", "component", F.lit(False).alias("asks"))
    blocks = asking.unionByName(answering).hint("merge").join(payloads, "node")
    found = (
        blocks.repartition("bucket", "asked", "chunk")
        .sortWithinPartitions("bucket", "asked", "chunk")
        .select("bucket", "asked", "chunk", "node", "component", "asks", "payload")
        .mapInPandas(_block_links(kind, percent), "a long, b long")
    )
    return stars.unionByName(found), False


def _chunks(docs: int, words: int):
    """How many chunks a group of n documents and w words is dealt into."""
    return F.greatest(F.ceil(F.col("n") / docs), F.ceil(F.col("w") / words)).alias("chunks")


def _regions(nodes: DataFrame, depths, most_docs: int, most_words: int) -> DataFrame:
    """bucket, chunk, chunks, place (the label), node: every document's regions; one found by several trees counts once."""
    trees, wide = HASHES // depths[-1], 4 * depths[-1]
    entries = nodes.select("node", "n_words", "signature", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    entries = entries.select("node", "n_words", "tree", F.substring("signature", F.col("tree") * wide + 1, F.lit(wide)).alias("label"))
    key = lambda d: F.xxhash64("tree", F.substring("label", 1, 4 * d))
    placed, pending = None, entries
    for d in depths:
        at = pending.withColumn("bucket", key(d))
        sizes = materialize(
            at.groupBy("bucket")
            .agg(
                F.count("*").alias("n"),
                F.sum("n_words").alias("w"),
                F.min("node").alias("low"),
                F.max("node").alias("high"),
                F.bit_xor(F.xxhash64("node")).alias("same"),
            )
            .where("n > 1")
            .withColumn("chunks", _chunks(most_docs, most_words))
        )
        last = d == depths[-1] or sizes.where("chunks > 1").isEmpty()
        stay = (sizes if last else sizes.where("chunks = 1")).groupBy("n", "low", "high", "same", "chunks").agg(F.min("bucket").alias("bucket"))
        here = at.hint("merge").join(stay.select("bucket", "chunks"), "bucket")
        here = here.select("bucket", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "chunks", F.col("label").alias("place"), "node")
        placed = here if placed is None else placed.unionByName(here)
        if last:
            return placed
        pending = at.hint("merge").join(sizes.where("chunks > 1").select("bucket"), "bucket", "left_semi").drop("bucket")


def _components(docs: DataFrame, row, percent: int, depths, most_docs: int, most_words: int) -> DataFrame:
    """row_no, row, doc_id, n_shingles, component_id, lead (the row_no of the component's first row) for every row."""
    depths = depths or depths_for(percent)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"))
    sketch = F.pandas_udf(_sketched, "n_shingles long, n_words long, digest binary, signature binary, sketch binary")
    table = materialize(rows.withColumn("s", sketch(F.col("row").getField("text").cast("string"))).select("row_no", "doc_id", "row", "s.*"))
    # equal sets have equal signatures, so that any row can speak for its set; ids come before null ids
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("lead")
    nodes = table.where("n_shingles > 0").groupBy("digest").agg(
        lead, F.count("*").alias("rows"), F.max("n_words").alias("n_words"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch")
    )
    nodes = materialize(nodes.withColumn("node", F.col("lead.row_no")))
    regions = materialize(_regions(nodes, depths, most_docs, most_words))
    candidates = connected(_search(regions, nodes.select("node", F.col("sketch").alias("payload")), _Sketches, percent)[0])
    drop_table(regions)
    # every candidate cluster with its smallest node, which the components do not list
    member = candidates.unionByName(candidates.select(F.col("component").alias("node"), "component").distinct())
    member = member.hint("merge").join(nodes.select("node", "n_words"), "node")
    sizes = member.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_words").alias("w"))
    sizes = materialize(sizes.select(F.col("component").alias("bucket"), _chunks(most_docs, most_words)))
    clusters = materialize(
        member.withColumnRenamed("component", "bucket")
        .hint("merge")
        .join(sizes, "bucket")
        .select("bucket", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "chunks", F.col("node").alias("place"), "node")
    )
    texts = table.select(F.col("row_no").alias("node"), F.col("row").getField("text").cast("string").alias("payload"))
    links, stars = _search(clusters, texts, _Sets, percent)
    component = links.select(F.col("a").alias("node"), F.col("b").alias("component")) if stars else connected(links)
    # what rows can't tell by themselves: sets that several rows have or that are linked
    rooted = nodes.select("digest", "node", "lead", "rows").hint("merge").join(component, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # written before it is joined, so that Spark can split the sets of a component that holds very many
    firsts = rooted.hint("merge").join(component.select(F.col("component").alias("root")).distinct(), "root", "left_semi").groupBy("root").agg(F.min("lead").alias("first"))
    firsts = materialize(firsts)
    groups = rooted.hint("merge").join(firsts, "root", "left").where("rows > 1 OR first IS NOT NULL")
    groups = materialize(groups.select("digest", F.coalesce("first", "lead").alias("first")))
    out = table.select("row_no", "row", "doc_id", "n_shingles", "digest").hint("merge").join(groups, "digest", "left")
    return out.select(
        "row_no",
        "row",
        "doc_id",
        "n_shingles",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        F.coalesce("first.row_no", "row_no").alias("lead"),
    )


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, depths=None, region_docs: int = REGION_DOCS, region_words: int = REGION_WORDS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    found = _components(docs, F.struct(F.col("text")), percent, depths, region_docs, region_words)
    kept = F.when(F.col("component_id").isNull(), F.col("row_no") == F.col("lead")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, region_docs: int = REGION_DOCS, region_words: int = REGION_WORDS) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id; of rows repeated as they are, one stays."""
    found = _components(docs, F.struct("*"), percent, None, region_docs, region_words)
    return found.where("row_no = lead").select("row.*")
