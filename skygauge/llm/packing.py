"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most CAPACITY tokens. Full pieces are bins of
their own. All other pieces are dealt at random into shards of about SHARD_ITEMS; a shard is
one packing problem and several islands work on it with different seeds, each a row of a
DataFrame. On an island, a solution is a set of bins. Crossover puts whole well-filled bins of
one parent into a copy of the other, removes the bins there that hold any of the same pieces,
and places the displaced pieces best-fit, largest first. Between epochs each island's best solution
migrates to the next island. A shard ends when it needs no more bins than its tokens demand: it is
best-fit once, and only shards left open go to the islands.

Memory: a task holds the texts of one batch, or one shard; both are bounded, whatever the size or
the skew of the table. Only numbers are shuffled.

Defined results: a null or empty text is its end token alone; a repeated row is packed again;
a null doc_id is packed as any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.text import ARROW, with_fields
from skygauge.session import ship_package, spread, stage

CAPACITY = 2048
END_ID = 0
SHARD_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
# Words that a worker remembers; when there are more, the KEPT_WORDS used last stay.
KNOWN_WORDS, KEPT_WORDS = 500_000, 250_000
# Bytes of texts that are tokenized at a time.
BYTES_AT_ONCE = 8 << 20
MARKS = ".,;:!?"
RAW = "\x01"
# Words encoded in one call, a line end between them.
WORDS_AT_ONCE = 300


# RAW, or space that is not one blank or line end between two other characters (the spaces of str.split).
UNEVEN = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x01\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# A letter and one mark at the end of a key.
MARKED = rf"[A-Za-zÀ-ÖØ-öø-ɏ][{MARKS}]\z"


def regular(text: str) -> bool:
    """All space is one blank or line end between two other characters."""
    return RAW not in text and " ".join(text.split()) == text.replace("\n", " ")


class WordIds:
    """Token ids of texts, word by word.

    The pre-tokenizer never joins what stands on the two sides of a single blank or line end: a
    blank begins the next token, a line end is a token of its own. So a text may be cut there, and
    equal words have equal ids. A key stands for what is encoded: a word for itself after a blank, a
    word after a line end for both, and RAW with any text for that text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.turn = np.zeros(0, np.int64), 0
        self.line_end = self.encode(["\n"])[0]
        self.marks = pa.array(self.encode(list(MARKS)), pa.large_binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", found.ids).tobytes() for found in encoded]

    def encode_words(self, words: list[str], before: str) -> pa.LargeBinaryArray:
        """Ids of words without space in them, ``before`` put before each."""
        blocks = []
        (line_end,) = array("I", self.line_end)
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            text = before + f"\n{before}".join(part)
            ids = np.frombuffer(self.encode([text])[0] + self.line_end, np.uint32)
            if np.count_nonzero(ids == line_end) != len(part):
                raise ValueError("the tokenizer joins line ends with words")
            blocks.append(ids)
        ids = np.concatenate([np.zeros(0, np.uint32), *blocks])
        ends = np.flatnonzero(ids == line_end)
        # Line ends before each end are left out.
        offsets = np.concatenate([[0], ends - np.arange(len(ends))]) * 4
        return _binary(offsets, ids[ids != line_end])

    def encode_keys(self, keys: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeBinaryArray]:
        """The keys in another order, and the ids of what each stands for; words without space are encoded many at a time."""
        odd = pc.or_(pc.starts_with(keys, "\n"), pc.starts_with(keys, RAW))
        after_blank = keys.filter(pc.invert(odd))
        after_line, at_start, others = [], [], []
        for key in keys.filter(odd).to_pylist():
            spaced = len(key) == 1 or any(map(str.isspace, key[1:]))
            (others if spaced else after_line if key[0] == "\n" else at_start).append(key)
        lines = self.encode_words([k[1:] for k in after_line], "").to_pylist()
        ids = [
            self.encode_words(after_blank.to_pylist(), " "),
            self.encode_words([k[1:] for k in at_start], ""),
            pa.array([self.line_end + ids for ids in lines], pa.large_binary()),
            pa.array(self.encode([k[1:] if k[0] == RAW else k for k in others]), pa.large_binary()),
        ]
        return pa.concat_arrays([after_blank, pa.array([*at_start, *after_line, *others], pa.large_string())]), pa.concat_arrays(ids)

    @staticmethod
    def keys(text: str) -> list[str]:
        """What a text with uneven spaces is cut into."""
        words = text.split(" ")
        out = words[:1]
        for word in words[1:]:
            if word and not word[0].isspace() and out[-1] and not out[-1][-1].isspace():
                out.append(" " + word)
            else:
                out[-1] += " " + word
        plain = lambda w: len(w) > 1 and w[0] == " " and "\n" not in w and regular(w[1:])
        return [w[1:] if plain(w) else RAW + w for w in out]

    def of_keys(self, keys: pa.LargeStringArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """Ids of what the distinct keys stand for, and the place of each key's ids among them; remembered."""
        # A letter and one mark after it are never one token: both are looked up alone.
        marked = pc.match_substring_regex(keys, MARKED)
        ending = keys.filter(marked)
        needed = pa.concat_arrays([keys.filter(pc.invert(marked)), pc.utf8_rtrim(ending, MARKS)])
        at = pc.index_in(needed, self.words)
        unknown = at.is_null()
        if unknown.true_count:
            words, ids = self.encode_keys(needed.filter(unknown).unique())
            new = pc.add(pc.index_in(needed.filter(unknown), words), pa.scalar(len(self.words), pa.int32()))
            at = pc.replace_with_mask(at, unknown, new)
            self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.turn += 1
        self.used[at.to_numpy()] = self.turn
        found = self.ids.take(at)
        plain = len(keys) - len(ending)
        mark = pc.index_in(pc.utf8_slice_codeunits(ending, -1), pa.array(list(MARKS), pa.large_string()))
        nothing = pa.scalar(b"", pa.large_binary())
        ended = pc.binary_join_element_wise(found.slice(plain), self.marks.take(mark), nothing)
        if len(self.words) > KNOWN_WORDS:
            kept = np.argsort(-self.used, kind="stable")[:KEPT_WORDS]
            self.words, self.ids, self.used = self.words.take(pa.array(kept)), self.ids.take(pa.array(kept)), self.used[kept]
        place = np.empty(len(keys), np.int64)
        mask = marked.to_numpy(zero_copy_only=False)
        place[~mask], place[mask] = np.arange(plain), np.arange(plain, len(keys))
        return pa.concat_arrays([found.slice(0, plain), ended]), place

    def joined(self, cut: pa.ListArray) -> list[bytes]:
        """Ids of texts that are cut into keys; no key becomes a Python object but those to be encoded."""
        coded = cut.values.dictionary_encode()
        values, place = self.of_keys(coded.dictionary)
        _, ends, data = values.take(pa.array(place[coded.indices.to_numpy()])).buffers()
        at = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist()
        whole = memoryview(data or b"")
        return [bytes(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        column = pa.array(texts, pa.large_string())
        uneven = pc.match_substring_regex(column, UNEVEN)
        even = pc.invert(uneven).to_pylist()
        plain = pc.replace_substring(column.filter(pc.invert(uneven)), "\n", " \n")
        other = [self.keys(t) for t, e in zip(texts, even, strict=True) if not e]
        raw, nothing = pa.scalar(RAW, pa.large_string()), pa.scalar("", pa.large_string())
        cut = pc.split_pattern(pc.binary_join_element_wise(raw, plain, nothing), " ")
        found = self.joined(pa.concat_arrays([cut, pa.array(other, pa.list_(pa.large_string()))]))
        from_plain, from_other = iter(found[: len(plain)]), iter(found[len(plain) :])
        return [next(from_plain if e else from_other) for e in even]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.LargeBinaryArray:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch with about BYTES_AT_ONCE of texts at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES_AT_ONCE, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(start, end - start)


@cache
def word_ids(path: str, special_as_text: bool = False) -> WordIds:
    """One for each worker process: its tasks share the memory of words."""
    return WordIds(path, special_as_text)


def _piece_rows(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a document; only the first piece may be shorter."""
    n = len(ids) // 4
    first = n % capacity or capacity
    ends = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
    for k, (start, end) in enumerate(zip(ends, ends[1:], strict=False)):
        yield k, start, end - start


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, special_as_text: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for), one row per piece.

    Strings of special tokens inside a text are these tokens, as is the library's default, unless ``special_as_text``.
    """
    ship_package(docs.sparkSession)
    fields = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long"}
    if with_ids:
        fields["ids"] = "binary"
    schema = with_fields(docs.select("doc_id").schema, fields)
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer, special_as_text)
        for batch in batches:
            for part in _parts(batch):
                source, rows = [], []
                for k, ids in enumerate(words.of([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    for piece, start, length in _piece_rows(ids, capacity):
                        own = ids[4 * start : 4 * (start + length)]
                        source.append(k)
                        rows.append((piece, start, length, zlib.crc32(own), own)[: len(fields)])
                made = [pa.array(c, ARROW[t]) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(source)), *made], names=["doc_id", *fields]
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Bins:
    """A solution: for each bin its pieces and their sum; free space is indexed for best fit."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self, pieces: list[int]) -> Bins:
        """Places pieces, largest first, into the fullest bin that has room for each."""
        sizes, capacity = self.sizes, self.capacity
        by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        present = 0  # bit f: some bin has f free
        for k, filled in enumerate(self.fill):
            free = capacity - filled
            by_free[free].append(k)
            present |= 1 << free
        for i in sorted(pieces, key=lambda p: -sizes[p]):
            size = sizes[i]
            fitting = present >> size
            if fitting:
                free = size + (fitting & -fitting).bit_length() - 1
                k = by_free[free].pop()
                if not by_free[free]:
                    present &= ~(1 << free)
            else:
                free, k = capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[k].append(i)
            self.fill[k] += size
            left = free - size
            by_free[left].append(k)
            present |= 1 << left
        return self

    def fitness(self) -> float:
        """Mean squared fill: fewer and fuller bins are better."""
        return sum((f / self.capacity) ** 2 for f in self.fill) / max(1, len(self.bins))

    def crossed(self, other: Bins, share: float, rng: np.random.Generator) -> Bins:
        """A child with the well-filled bins of ``other`` and what remains of the own ones."""
        ranked = sorted(range(len(other.bins)), key=lambda k: -other.fill[k])
        taken = [k for k in ranked[: max(1, int(len(ranked) * share))] if rng.random() < 0.8]
        inside = {i for k in taken for i in other.bins[k]}
        child = Bins(self.sizes, self.capacity)
        displaced = []
        child.bins, child.fill = [list(other.bins[k]) for k in taken], [other.fill[k] for k in taken]
        for own, filled in zip(self.bins, self.fill, strict=True):
            if inside.isdisjoint(own):
                child.bins.append(list(own))
                child.fill.append(filled)
            else:
                displaced += [i for i in own if i not in inside]
        return child.best_fit(displaced)

    def mutated(self, rng: np.random.Generator) -> Bins:
        """The emptiest bins and some others are emptied and their pieces placed again."""
        ranked = sorted(range(len(self.bins)), key=lambda k: self.fill[k])
        gone = set(ranked[: max(2, len(ranked) // 20)]) | set(rng.integers(0, len(ranked), 3).tolist())
        child = Bins(self.sizes, self.capacity)
        kept = [k for k in range(len(self.bins)) if k not in gone]
        child.bins, child.fill = [list(self.bins[k]) for k in kept], [self.fill[k] for k in kept]
        return child.best_fit([i for k in sorted(gone) for i in self.bins[k]])

    def numbers(self) -> list[int]:
        """The bin of each piece."""
        out = [0] * len(self.sizes)
        for k, own in enumerate(self.bins):
            for i in own:
                out[i] = k
        return out

    @classmethod
    def of_numbers(cls, sizes: list[int], capacity: int, numbers: list[int]) -> Bins:
        made = cls(sizes, capacity)
        made.bins = [[] for _ in range(max(numbers) + 1)]
        made.fill = [0] * len(made.bins)
        for i, k in enumerate(numbers):
            made.bins[k].append(i)
            made.fill[k] += sizes[i]
        return made


def evolve(sizes: list[int], capacity: int, elites: list[list[int]], seed: int) -> list[int]:
    """The best solution of an island after an epoch, as the bin of each piece.

    Without elites it is the first solution: all pieces best-fit.
    """
    if not elites:
        return Bins(sizes, capacity).best_fit(list(range(len(sizes)))).numbers()
    rng = np.random.default_rng(seed)
    least = -(-sum(sizes) // capacity)
    population = [Bins.of_numbers(sizes, capacity, e) for e in elites]
    best = min(population, key=lambda b: (len(b.bins), -b.fitness()))
    if len(best.bins) <= least:
        return best.numbers()
    while len(population) < POPULATION:
        population.append(population[0].mutated(rng))
    for _ in range(GENERATIONS):
        order = rng.permutation(len(population))
        children = [
            population[a].crossed(population[b], rng.uniform(0.2, 0.6), rng)
            for a, b in zip(order, np.roll(order, 1), strict=True)
        ]
        children.append(min(population, key=lambda b: -b.fitness()).mutated(rng))
        population = sorted(population + children, key=lambda b: (len(b.bins), -b.fitness()))[:POPULATION]
        if len(population[0].bins) <= least:
            break
    return population[0].numbers()


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch on each island; (shard, island, sizes, elites) to (…, best, bins)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                seed = row["shard"] * 1_000 + row["island"] * 10 + epoch
                best = evolve(row["sizes"], capacity, row["elites"] or [], seed)
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array([row["shard"]], pa.int64()),
                        "island": pa.array([row["island"]], pa.int32()),
                        "sizes": pa.array([row["sizes"]], pa.list_(pa.int32())),
                        "best": pa.array([best], pa.list_(pa.int32())),
                        "bins": pa.array([max(best) + 1], pa.int32()),
                    }
                )

    return state.mapInArrow(run, "shard long, island int, sizes array<int>, best array<int>, bins int")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (staged rows with ``length``) with sequence_id and offset."""
    spark = pieces.sparkSession
    ship_package(spark)
    full = pieces.filter(F.col("length") >= capacity)
    rows = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-rows.count() // SHARD_ITEMS))
    # Numbered once: the staged numbers tell repeated rows apart.
    numbered = stage(
        rows.withColumn("item", F.monotonically_increasing_id())
        .withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards))),
        "items",
    )
    # At most about SHARD_ITEMS rows each: items are dealt by a hash of their number.
    problems = stage(
        numbered.groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("item", F.col("length").cast("int").alias("size")))).alias("items"))
        .select("shard", "items.item", "items.size"),
        "shards",
    )
    no_elites = F.array().cast("array<array<int>>").alias("elites")
    # A first solution of each shard; most need no more bins than their tokens demand.
    first = stage(
        _epoch(
            spread(problems.select("shard", F.lit(0).alias("island"), F.col("size").alias("sizes"), no_elites)), capacity, 0
        ),
        "first",
    )
    tokens = F.aggregate("sizes", F.lit(0).cast("long"), lambda total, size: total + size)
    still_open = (F.col("bins") - 1) * F.lit(capacity).cast("long") >= tokens
    solutions = first
    state = first.filter(still_open).select(
        "shard", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), "sizes", F.array("best").alias("elites")
    )
    for epoch in range(1, EPOCHS + 1):
        if state.isEmpty():
            break
        # Not by the key of the join: its few small partitions would be packed into one task.
        evolved = stage(_epoch(spread(state), capacity, epoch), "epoch")
        solutions = solutions.unionByName(evolved)
        guests = evolved.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("guest"))
        state = evolved.filter(still_open).join(guests, ["shard", "island"]).select(
            "shard", "island", "sizes", F.array("best", "guest").alias("elites")
        )
    winner = solutions.groupBy("shard").agg(F.min(F.struct("bins", "island", "best")).alias("w"))
    placed = (
        problems.join(winner, "shard")
        .select("shard", F.explode(F.arrays_zip("item", F.col("w.best").alias("bin"), F.col("size"))).alias("p"))
        .select("shard", "p.item", "p.bin", "p.size")
    )
    # A bin holds at most CAPACITY pieces.

    in_bin = Window.partitionBy("shard", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "item", F.coalesce(F.sum("size").over(in_bin), F.lit(0)).cast("long").alias("offset"),
        (F.col("bin").cast("long") * shards + F.col("shard")).alias("sequence_id"),
    )
    columns = [*pieces.columns, "sequence_id", "offset"]
    # Ids of full pieces are negative: they never meet those of the shards.
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn(
        "offset", F.lit(0).cast("long")
    )
    return numbered.join(placed, "item").select(*columns).unionByName(alone.select(*columns))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the place they are packed at."""
    return pack(stage(token_pieces(docs, tokenizer, capacity, with_ids), "pieces"), capacity)
