"""Near-duplicate embeddings by a pivot-permutation index.

Reference vectors (pivots) are drawn from the data by hash. Each vector is described by its nearest pivots in order. It
is stored in the inverted list of its nearest one and looks itself up in the lists of its nearest `probes_for`; a stored
vector is a candidate if the two share at least `SHARED` of them, counted on bit sets, and a link if their cosine, in
double precision, is at least `cosine`. A vector sees each other one in one list at most, so links can be counted where
they are found: a looked-up vector that would not see its finder is credited at once.

The number of pivots follows the number of vectors, so lists keep their length until MOST_PIVOTS. Among more pivots the
order of the nearest is less stable, so the number of probes grows with their logarithm. A list is dealt into
blocks, and tasks hold one block of lookups and one of stored vectors; a block gives counts and a spanning star of what
is linked, never pairs. Vectors that are equal bit for bit are one, with a multiplicity.

Pivots are fitted on a bounded sample (about 2 * MOST_PIVOTS vectors of each length, chosen by hash) and kept apart, so
that the members of a dense group agree on theirs; every vector is indexed. The pivots of the commonest lengths are
broadcast, MOST_BROADCAST bytes of them at most; vectors of other lengths meet their pivots in the tasks that a shuffle by
length deals them to. Components keep the precision they come in, single or double, and are compared in double precision.

Null, zero and empty vectors, and those with null or non-finite components, link with nothing and are components of their
own; vectors of different lengths never link. Every row counts as a vector, also those that repeat a vec_id: n_links counts
rows, and component_id is the smallest vec_id of a component, where a null vec_id, reported as null, counts as smallest.
An empty table gives no rows. Extra columns, labels among them, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm.common import NO_ID, doc_key, materialize
from canopy.llm.components import connected, grouped

MOST_PIVOTS, LEAST_PIVOTS, VECTORS_A_PIVOT = 4096, 16, 100
PROBES, SHARED = 8, 2
BLOCK = 2048
MOST_BROADCAST = 256 << 20
#: Vectors of one length that meet their pivots in one task, where pivots aren't broadcast.
DEALT = 100_000


def probes_for(pivots: int) -> int:
    """PROBES up to 32 pivots, and two more for each doubling, so that recall doesn't fall with their number."""
    return PROBES + 2 * max(0, math.ceil(math.log2(max(pivots, 1) / 32)))


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepare(kind: str):
    """The vector as bytes; null where it can't be compared."""

    def run(vectors: pd.Series) -> pd.Series:
        raw = []
        for v in vectors:
            x = np.zeros(0) if v is None else np.array([np.nan if c is None else c for c in v], np.float64).astype(kind)
            raw.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        return pd.Series(raw, dtype=object)

    return F.pandas_udf(run, "binary")


def spread(units: np.ndarray, many: int, apart: float = 0.7) -> np.ndarray:
    """The first vectors that are no nearer than `apart` to one before: a dense group gets one pivot, not its share."""
    kept = np.zeros((0, units.shape[1]))
    for u in units:
        if len(kept) == many:
            break
        if not len(kept) or (kept @ u).max() < apart:
            kept = np.vstack([kept, u])
    return kept


def nearest(units: np.ndarray, pivots: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest pivots in order; ties go to the lower number."""
    near = units @ pivots.T
    if len(pivots) > probes:
        some = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
    else:
        some = np.broadcast_to(np.arange(len(pivots)), near.shape).copy()
    some.sort(axis=1)
    order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1).astype(np.int32)


def pivots_of(raw: list[bytes], kind: str, n: int) -> np.ndarray:
    """Pivots for n vectors, from a sample of them."""
    many = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_A_PIVOT)))
    return spread(_unit(raw, kind), many)


def _described(raw: list[bytes], kind: str, pivots: np.ndarray, probes: int | None) -> list[list[int]]:
    return nearest(_unit(raw, kind), pivots, probes or probes_for(len(pivots))).tolist()


def _describe(nodes: DataFrame, kind: str, probes: int | None) -> DataFrame:
    """node, weight, raw, width and pivots, for vectors of every length."""
    spark = nodes.sparkSession
    wide = nodes.withColumn("width", (F.length("raw") / np.dtype(kind).itemsize).cast("int"))
    share = F.pmod(F.xxhash64("raw"), F.lit(1 << 30)) / (1 << 30)
    # a row for each length, written so that Spark knows how small it is
    sizes = materialize(wide.groupBy("width").agg(F.count("*").alias("n")))
    # the sample of a length; the largest share of it that may be needed is twice MOST_PIVOTS and a little more
    sample = wide.join(sizes, "width").where(share * F.col("n") < 2.2 * MOST_PIVOTS).select("width", "n", "raw", share.alias("share"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["share", "raw"])
        n = int(frame["n"].iloc[0])
        most = 2 * int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // VECTORS_A_PIVOT)))
        pivots = pivots_of([bytes(r) for r in frame["raw"].iloc[:most]], kind, n)
        return pd.DataFrame({"width": frame["width"].iloc[:1].to_numpy(), "n": [n], "size": [pivots.nbytes], "table": [pivots.tobytes()]})

    fitted = materialize(sample.groupBy("width").applyInPandas(fit, "width int, n long, size long, table binary"))
    # the commonest lengths, as many as the bound allows and 1,000 at most
    common, held = [], 0
    for r in fitted.select("width", "size").orderBy(F.desc("n"), "width").limit(1000).collect():
        if held + r["size"] <= MOST_BROADCAST:
            common.append(r["width"])
            held += r["size"]
    tables = {r["width"]: np.frombuffer(bytes(r["table"])).reshape(-1, r["width"]) for r in fitted.where(F.col("width").isin(common)).collect()}
    known = spark.sparkContext.broadcast(tables)

    def describe(raw: pd.Series, width: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(raw), dtype=object)
        for w in width.unique():
            rows = np.flatnonzero(width == w)
            for at, near in zip(rows, _described(raw.iloc[rows].tolist(), kind, known.value[int(w)], probes)):
                out.iloc[at] = near
        return out

    columns = ["node", "weight", "raw", "width", "pivots"]
    out = wide.where(F.col("width").isin(common)).withColumn("pivots", F.pandas_udf(describe, "array<int>")("raw", "width")).select(columns)
    others = fitted.where(~F.col("width").isin(common))
    if others.isEmpty():
        return out
    # behind the pivots of their length, dealt to so many tasks that none gets too much
    dealt = others.select("width", "table", F.ceil(F.col("n") / DEALT).alias("deals"))
    member = wide.join(dealt.select("width", "deals"), "width").select(
        "width", F.pmod(F.xxhash64("raw"), "deals").alias("deal"), F.lit(1).alias("turn"), "node", "weight", "raw"
    )
    leading = dealt.select(
        "width",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"),
        F.lit(0).alias("turn"),
        F.lit(0).cast("long").alias("node"),
        F.lit(0).cast("long").alias("weight"),
        F.col("table").alias("raw"),
    )

    def behind(frames):
        pivots = None
        for frame in frames:
            out = []
            for _, own in frame.groupby((frame["turn"] == 0).cumsum(), sort=False):
                if own["turn"].iloc[0] == 0:
                    pivots = np.frombuffer(bytes(own["raw"].iloc[0])).reshape(-1, int(own["width"].iloc[0]))
                    own = own.iloc[1:]
                if len(own):
                    near = _described(own["raw"].tolist(), kind, pivots, probes)
                    out.append(own[["node", "weight", "raw", "width"]].assign(pivots=near))
            if out:
                yield pd.concat(out)

    dealt_out = leading.unionByName(member).repartition("width", "deal").sortWithinPartitions("width", "deal", "turn")
    return out.unionByName(dealt_out.mapInPandas(behind, "node long, weight long, raw binary, width int, pivots array<int>"))


def _lists(sets: np.ndarray, wide: int) -> np.ndarray:
    """Rows of pivot numbers as a 0/1 table over the pivots that occur here."""
    table = np.zeros((len(sets), wide), np.float32)
    np.put_along_axis(table, sets, 1, axis=1)
    return table


def _block(cosine, needed, kind):
    """Counts and stars of a block: lookups (asks) against stored vectors of one list."""

    def run(frames):
        for group in grouped(frames, ["width", "pivot", "ask_block", "block"]):
            asks = group["asks"].to_numpy(bool)
            if not asks.any() or asks.all():
                continue
            look, store = group[asks], group[~asks]
            ids_a, ids_b = look["node"].to_numpy(np.int64), store["node"].to_numpy(np.int64)
            x, y = _unit(look["raw"].tolist(), kind), _unit(store["raw"].tolist(), kind)
            sets_a, sets_b = np.stack(look["pivots"].tolist()), np.stack(store["pivots"].tolist())
            here, into = np.unique(np.concatenate((sets_a.ravel(), sets_b.ravel())), return_inverse=True)
            a = _lists(into[: sets_a.size].reshape(sets_a.shape), len(here))
            b = _lists(into[sets_a.size :].reshape(sets_b.shape), len(here))
            weight_a, weight_b = look["weight"].to_numpy(np.int64), store["weight"].to_numpy(np.int64)
            found_a, found_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            edges = []
            for at in range(0, len(x), 256):
                rows = slice(at, at + 256)
                hit = x[rows] @ y.T >= cosine
                hit &= a[rows] @ b.T >= min(needed, sets_a.shape[1])
                hit &= ids_a[rows, None] != ids_b
                if not hit.any():
                    continue
                found_a[rows] += hit @ weight_b
                # the stored vector does not probe the list where its finder is stored
                blind = ~(sets_b[None, :, :] == sets_a[rows, 0][:, None, None]).any(axis=2)
                found_b += (hit & blind).T @ weight_a[rows]
                for k in np.flatnonzero(hit.any(axis=1)):
                    edges.append((ids_a[at + k], np.flatnonzero(hit[k])))
            pairs, root = [], {}
            for node, others in edges:
                # one edge to each stored vector that has no edge from this block yet, and one at least
                fresh = [j for j in others.tolist() if j not in root]
                for j in fresh or others[:1].tolist():
                    pairs.append((node, ids_b[j]))
                    root[j] = node
                pairs += [(node, root[j]) for j in {root[j]: j for j in others.tolist()}.values() if root[j] != node]
            n = len(pairs)
            counted = np.concatenate((ids_a[found_a > 0], ids_b[found_b > 0]))
            counts = np.concatenate((found_a[found_a > 0], found_b[found_b > 0]))
            yield pd.DataFrame(
                {
                    "node": np.concatenate((counted, np.array([p[0] for p in pairs], np.int64))),
                    "links": np.concatenate((counts, np.zeros(n, np.int64))),
                    "other": pd.array([None] * len(counted) + [int(p[1]) for p in pairs], dtype="Int64"),
                }
            )

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, probes: int | None = None, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(doc_key("vec_id").alias("vec_id"), _prepare(kind)(F.col("embedding").cast("array<double>")).alias("raw"))
    table = materialize(rows)
    # equal vectors are one node, under the smallest of their ids; ids may repeat, so that nodes have numbers of their own
    nodes = table.where("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    described = materialize(_describe(nodes, kind, probes).withColumn("hash", F.abs(F.xxhash64("raw") % 1_000_003)))
    stored = described.withColumn("pivot", F.element_at("pivots", 1))
    looked = described.withColumn("pivot", F.explode("pivots"))
    size = lambda df, name: df.groupBy("width", "pivot").agg(F.ceil(F.count("*") / block).alias(name))
    sizes = materialize(size(stored, "blocks").join(size(looked, "ask_blocks"), ["width", "pivot"]))
    columns = ["width", "pivot", "ask_block", "block", "asks", "node", "weight", "raw", "pivots"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lookups = (
        looked.join(sizes, ["width", "pivot"])
        .withColumn("ask_block", F.col("hash") % F.col("ask_blocks"))
        .withColumn("block", each("blocks"))
        .withColumn("asks", F.lit(True))
    )
    answers = (
        stored.join(sizes, ["width", "pivot"])
        .withColumn("block", F.col("hash") % F.col("blocks"))
        .withColumn("ask_block", each("ask_blocks"))
        .withColumn("asks", F.lit(False))
    )
    keys = ["width", "pivot", "ask_block", "block"]
    found = materialize(
        lookups.select(columns)
        .unionByName(answers.select(columns))
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInPandas(_block(cosine, shared, kind), "node long, links long, other long")
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = nodes.select("node", "low").join(component, "node", "left").withColumn("root", F.coalesce("component", "node"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    groups = nodes.join(rooted.select("node", "root"), "node").join(lows, "root").join(links, "node", "left")
    groups = materialize(groups.select("raw", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    out = table.join(groups, "raw", "left")
    component = F.coalesce("component_id", "vec_id")
    real = lambda c: F.nullif(c, F.lit(NO_ID))
    return out.select(
        real(F.col("vec_id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        real(component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
