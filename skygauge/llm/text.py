"""What the operators share about texts: words, spaces, row numbers and hashed words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skygauge.session import ship_package, stage

# Words are runs of anything but these six ASCII spaces; bytes.split() cuts at the same ones.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
# Every run of spaces but a lone blank, which needs no change.
UNEVEN_SPACE = rf"[\x09-\x0D][{SPACE_CLASS}]*|\x20[{SPACE_CLASS}]+"

CACHE_WORDS = 400_000
_ROW_BITS = 33


def single_spaced(text: Column) -> Column:
    """Each run of spaces as one blank; null as empty."""
    return F.coalesce(F.regexp_replace(text, UNEVEN_SPACE, " "), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """The words of a text as UTF-8; A-Z in lower case unless told otherwise."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it has become too large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of a 64-bit value over all others (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashed windows of ``width`` words; fewer words make one window; none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(width, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = mixed(total + hashes[k : n - size + 1 + k] + np.uint64(k + 1))
    return np.unique(total)


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()),
}
# Texts handed over at a time, so that results of long texts don't pile up.
TEXTS_AT_ONCE = 500


def with_fields(schema: StructType, fields: dict[str, str]) -> StructType:
    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in fields.items()))
    return StructType([*schema.fields, *added.fields])


def per_text(
    df: DataFrame, start: Callable[[], Callable[[list[str | None]], list[tuple]]], fields: dict[str, str]
) -> DataFrame:
    """The other columns of ``df`` with ``fields`` computed from its column ``text``.

    ``start`` is called once in each task and gives a function from texts to one tuple each. Arrow
    batches pass through; other columns are never touched by Python.
    """
    ship_package(df.sparkSession)
    kept = [c for c in df.columns if c != "text"]
    schema = with_fields(df.select(*kept).schema, fields)
    kinds = [ARROW[k] for k in fields.values()]
    names = [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                rows = compute(part.column("text").to_pylist())
                made = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=names)

    return df.mapInArrow(run, schema)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a 0-based rank column, by range partitions and the row counts before them.

    The sorted rows are staged, so that row numbers cannot change when a task runs again.
    """
    sorted_rows = stage(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("_at", _ROW_BITS)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    # One row for each partition: bounded by the number of partitions.
    other = counts.select(F.col("_part").alias("_before"), F.col("_rows").alias("_n"))
    starts = (
        counts.join(F.broadcast(other), F.col("_before") < F.col("_part"), "left")
        .groupBy("_part")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_start"))
    )
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_part", "_start", "_at")
    )
