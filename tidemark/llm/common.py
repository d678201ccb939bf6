"""What the operators share: scratch tables that every executor can read, and expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import discard, only_kept, saved, shared_dir

__all__ = ["SPACE", "WORD", "discard", "free_names", "large_keys", "one_row_each", "only_kept", "saved", "shared_dir", "slices", "small", "spread", "spread_join", "tidy", "unit"]

#: A group is cut into parts beyond so many rows, and beyond a thousandth of all rows.
LARGE = 100_000

#: White space of the contracts, for Java and RE2 expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a Python worker holds few texts as strings at once."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def tidy() -> None:
    """Give freed memory back to the machine: a worker is kept after its task, idle, while other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A saved table, marked for broadcast only if it was counted to have at most so many rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def unit(*cols: Column) -> Column:
    """A repeatable number in [0, 1) from the values of cols."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(2**53))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as make them differ from all columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def one_row_each(docs: DataFrame, keys: Sequence[Column], kept: DataFrame) -> DataFrame:
    """One row of docs, with its columns, for each row of `kept`: the keys in order, and last how many rows of docs have them.

    Null keys are equal to each other. Of rows that agree in all keys any one stays; only these are grouped. `kept` is a saved table.
    """
    names, count = free_names(docs, *[f"_key{i}" for i in range(len(keys))]), kept.columns[-1]
    marked = docs.withColumns(dict(zip(names, keys, strict=True)))

    def those(of: DataFrame) -> DataFrame:
        of = of.toDF(*[f"_of{n}" for n in names], "_of_count")
        on = [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names]
        return marked.join(of, on, "left_semi")

    out, several = those(kept.filter(F.col(count) == 1)), kept.filter(F.col(count) > 1)
    if not several.isEmpty():
        out = out.unionByName(those(small(several)).dropDuplicates(names))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def large_keys(sizes: DataFrame, key: str, size: str, large: int = LARGE) -> DataFrame | None:
    """key and _parts of the keys with more rows than `large` and than a thousandth of all: into how many parts they go. None if there are none.

    Under a thousand keys can be so large, so they are marked for broadcast.
    """
    total, largest = sizes.agg(F.sum(size), F.max(size)).first()
    most = max(large, (total or 0) // 1000)
    if (largest or 0) <= most:
        return None
    return F.broadcast(saved(sizes.filter(F.col(size) > most).select(key, F.ceil(F.col(size) / most).alias("_parts")).coalesce(1), "large-keys"))


def spread(rows: DataFrame, groups: DataFrame, key: str, by: str, parts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column _part, to be joined by key and _part: rows of a large key are dealt to its parts by a hash of the column `by`, and what the
    groups have of the key goes to each. So no task gets more rows than a part has."""
    if parts is None:
        return tuple(x.withColumn("_part", F.lit(0).cast("long")) for x in (rows, groups))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))
    return rows.join(parts, key, "left").withColumn("_part", part).drop("_parts"), groups.join(parts, key, "left").withColumn("_part", each).drop("_parts")


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, by: str, large: int = LARGE) -> DataFrame:
    """rows with the one row of their group, without its `size`: how many of the rows it has. groups: a saved table."""
    rows, groups = spread(rows, groups.drop(size), key, by, large_keys(groups.select(key, size), key, size, large))
    return rows.join(groups, [key, "_part"]).drop("_part")
