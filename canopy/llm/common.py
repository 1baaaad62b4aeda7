"""What the operators share: scratch tables in the cluster's shared folder, row keys, and small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.sources.scratch import clear_scratch, drop_table, materialize, shared_dir  # noqa: F401

#: Stands for a null id in join keys: no real id takes this value.
NO_ID = -(2**63)
#: Rows that a task turns into Python objects at once. Batches have a bound in bytes by Spark's own setting.
ROWS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever characters the name has."""
    return F.col(f"`{column.replace('`', '``')}`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def doc_key(column: str = "doc_id") -> Column:
    """A doc_id as a join key, null ids included."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def slices(frames, rows: int = ROWS, texts: str | None = None, characters: int = 1_000_000):
    """Frames of at most so many rows, so that what a task makes of them stays small.

    With the name of a column of texts, also of no more than so many characters, but for a single longer text.
    """
    for frame in frames:
        size = [0] * len(frame) if texts is None else frame[texts].str.len().fillna(0).tolist()
        low, held = 0, 0
        for k, n in enumerate(size):
            if k > low and (k - low >= rows or held + n > characters):
                yield frame.iloc[low:k]
                low, held = k, 0
            held += n
        if low < len(frame):
            yield frame.iloc[low:]
