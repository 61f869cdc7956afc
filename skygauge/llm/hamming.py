"""MinHash near-dedup through a multi-index Hamming join.

A document's shingles are hashed by SYMBOLS functions; the low b bits of each minimum are one
symbol of its signature. Two documents of similarity s differ in a symbol with probability
at most 1 - s. Signatures are cut into CHUNKS equal chunks. If two signatures differ in fewer than
CHUNKS * (ERRORS + 1) symbols, then by pigeonhole some chunk has at most ERRORS differing
symbols; so each chunk is entered into the index once for every choice of ERRORS symbols left
out, and such a pair meets under at least one key. The guarantee is for all pairs under that
distance. For a similarity of 85 % or more (``AT_85``) it is 31 of 96 symbols: at exactly 0.85, a pair is further
apart with a probability of 6e-6, at 0.9 of 4e-10. For 80 % or more (``AT_80``) it is 39 of 100
symbols: at exactly 0.8, a pair is further apart with a probability of 4e-6.

Texts with the same words are one class with one signature. Under a key, every class is paired
with the one that meets most others (a star, not all pairs); links are confirmed on full shingle
sets and joined to components; only then are other classes compared: those that share a key but no
component, if sizes and signature distance allow a link. So no link between components can be
missing, and members of a large group that are linked with its centre are not paired with each
other. These pairs are never rows: the task that holds the classes of a key forms and judges them, a
pair under its first common key alone, and only links come out. Where very many classes share a key
(copies that were changed more and more), they are compared in blocks, in the same way. Texts go only
to where their class has a pair that signatures allow.

Defined results: no words or null text: no shingles, no link, a component of its own; fewer
words than a shingle: their sequence is the one shingle; a repeated row links with its
copy; component_id is the smallest doc_id of the component (null only if all are null);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.components import components
from skygauge.llm.text import WordHashes, mixed, per_text, shingle_hashes, words_of
from skygauge.session import ship_package, stage

WIDTH = 5
# Shingles hashed at a time, so that a very long text needs no more memory for it.
SLICE = 4096
# Keys under which more classes than this meet are compared in blocks of about BLOCK classes.
DENSE_KEY = 64
BLOCK = 256


@dataclass(frozen=True)
class Scheme:
    """Least similarity of a link in percent, and the layout of signatures that finds such links."""

    percent: int
    chunks: int
    chunk_symbols: int
    # A chunk's symbols fill one long.
    symbol_bits: int
    errors: int = 1

    @property
    def symbols(self) -> int:
        return self.chunks * self.chunk_symbols

    @property
    def most_distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    @property
    def seeds(self) -> np.ndarray:
        return mixed(np.arange(1, 2 * self.symbols + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @property
    def lanes(self) -> np.ndarray:
        return np.arange(self.chunk_symbols, dtype=np.uint64) * np.uint64(self.symbol_bits)

    @property
    def symbol(self) -> np.uint64:
        return np.uint64((1 << self.symbol_bits) - 1)

    def split(self, signatures: np.ndarray) -> np.ndarray:
        """(rows, chunks, chunk_symbols): the symbols of packed signatures."""
        return (signatures.view(np.uint64)[:, :, None] >> self.lanes) & self.symbol


AT_85 = Scheme(85, chunks=16, chunk_symbols=6, symbol_bits=10)
AT_80 = Scheme(80, chunks=20, chunk_symbols=5, symbol_bits=12)

LEAST_PERCENT = AT_85.percent
CHUNKS = AT_85.chunks
CHUNK_SYMBOLS = AT_85.chunk_symbols
ERRORS = AT_85.errors
SYMBOLS = AT_85.symbols
MOST_DISTANCE = AT_85.most_distance
SYMBOL_BITS = AT_85.symbol_bits


def scheme_for(percent: int) -> Scheme:
    """The cheapest scheme whose guarantee is made for ``percent``; links are confirmed at ``percent``."""
    if percent < AT_80.percent:
        raise ValueError(f"no scheme for a similarity under {AT_80.percent} %")
    return replace(AT_85 if percent >= AT_85.percent else AT_80, percent=percent)


def signer(scheme: Scheme = AT_85) -> Callable[[np.ndarray], np.ndarray]:
    """Shingles to signature: low bits of the minimum of each hash function, a long per chunk."""
    seeds, lanes = scheme.seeds, scheme.lanes
    factors, shifts = (seeds[: scheme.symbols] | np.uint64(1))[:, None], seeds[scheme.symbols :][:, None]

    def signature(shingles: np.ndarray) -> np.ndarray:
        least = np.full(scheme.symbols, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), SLICE):
            part = shingles[None, at : at + SLICE]
            np.minimum(least, (part * factors + shifts).min(axis=1), out=least)
        symbols = (mixed(least) & scheme.symbol).reshape(scheme.chunks, scheme.chunk_symbols)
        return np.bitwise_or.reduce(symbols << lanes, axis=1).view(np.int64)

    return signature


def chunk_keys(signatures: np.ndarray, scheme: Scheme = AT_85) -> np.ndarray:
    """(rows, symbols): a key for each chunk and each symbol left out of it, in that order."""
    chunks = scheme.split(signatures)
    place = np.arange(scheme.chunks, dtype=np.uint64)[None, :] * np.uint64(scheme.chunk_symbols)
    keys = np.empty(chunks.shape, np.uint64)
    for out in range(scheme.chunk_symbols):
        key = np.broadcast_to(mixed(place + np.uint64(out + 1)), chunks.shape[:2])
        for k in range(scheme.chunk_symbols):
            if k != out:
                key = mixed(key * np.uint64(31) + chunks[:, :, k])
        keys[:, :, out] = key
    return keys.reshape(len(keys), scheme.symbols).view(np.int64)


def _differing(a: str, b: str, chunk: int, scheme: Scheme) -> Column:
    """Number of symbols of a chunk in which the signatures in columns ``a`` and ``b`` differ."""
    # The highest bit of each lane of a long, and all bits below them.
    lanes, bits = range(scheme.chunk_symbols), scheme.symbol_bits
    high = sum(1 << (bits * k + bits - 1) for k in lanes)
    low = sum(((1 << (bits - 1)) - 1) << (bits * k) for k in lanes)
    x = F.col(a)[chunk].bitwiseXOR(F.col(b)[chunk])
    return F.bit_count((x.bitwiseAND(low) + F.lit(low)).bitwiseOR(x).bitwiseAND(high))


def _may_link(a: str, b: str, n_a: str, n_b: str, scheme: Scheme) -> Column:
    """Whether signature distance and set sizes allow a link."""
    distance = reduce(lambda x, y: x + y, [_differing(a, b, c, scheme) for c in range(scheme.chunks)])
    small, large = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return (100 * small >= scheme.percent * large) & (distance <= scheme.most_distance)


def _start_features(scheme: Scheme):
    hashes, signature = WordHashes(), signer(scheme)

    def features(texts: list[str | None]) -> list[tuple]:
        rows = []
        for text in texts:
            words = words_of(text)
            shingles = shingle_hashes(hashes.of(words), WIDTH)
            same = xxhash.xxh3_128_digest(b" ".join(words))
            rows.append((same, len(shingles), signature(shingles) if len(shingles) else None))
        return rows

    return features


def _keys(batches: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 1000):
            part = batch.iloc[at : at + 1000]
            keys = chunk_keys(np.stack(part["sig"].to_numpy()), scheme)
            yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), scheme.symbols), "key": keys.ravel()})


def _linked(batches: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    """Pairs that the full shingle sets confirm; rows with the same ``a`` stand together."""
    hashes = WordHashes()
    last, mine = None, None
    for batch in batches:
        good = []
        for a, text_a, text_b in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
            if a != last:
                last, mine = a, shingle_hashes(hashes.of(words_of(text_a)), WIDTH)
            theirs = shingle_hashes(hashes.of(words_of(text_b)), WIDTH)
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            good.append(100 * common >= scheme.percent * (len(mine) + len(theirs) - common))
        yield batch.loc[good, ["a", "b"]]


PAIRS = "a long, b long"


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Staged links among the candidate pairs (a, b)."""
    side = lambda df, c, x: df.select(
        F.col("node").alias(c), *[F.col(v).alias(f"{v}_{c}") for v in x]
    )
    near = stage(
        pairs.join(side(nodes, "a", ["n", "sig"]), "a")
        .join(side(nodes, "b", ["n", "sig"]), "b")
        .filter(_may_link("sig_a", "sig_b", "n_a", "n_b", scheme))
        .select("a", "b"),
        "near",
    )
    return stage(
        near.join(side(texts, "b", ["text"]), "b")
        .join(side(texts, "a", ["text"]), "a")
        .mapInPandas(lambda batches: _linked(batches, scheme), PAIRS),
        "links",
    )


def _whole_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches, sorted by key, cut anew so that the rows of a key are in one of them."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held):
            keys = held["key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield held.iloc[:cut]
                held = held.iloc[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _symbols(signatures: np.ndarray, scheme: Scheme) -> np.ndarray:
    return scheme.split(signatures).astype(np.uint16).reshape(len(signatures), scheme.symbols)


def _key_pairs(rows: pd.DataFrame, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of one key and two components whose sizes and signatures allow a link.

    Two classes are paired under the first of their common keys only.
    """
    key, label, n = (rows[c].to_numpy() for c in ("key", "label", "n"))
    signatures = np.stack(rows["sig"].to_numpy())
    symbols, keys = _symbols(signatures, scheme), chunk_keys(signatures, scheme)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # No key has more rows than DENSE_KEY, and the loop ends behind the most frequent one.
    for step in range(1, len(rows)):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        i = i[label[i] != label[i + step]]
        a, b = n[i].astype(np.int64), n[i + step].astype(np.int64)
        i = i[100 * np.minimum(a, b) >= scheme.percent * np.maximum(a, b)]
        i = i[(symbols[i] != symbols[i + step]).sum(axis=1) <= scheme.most_distance]
        first = (keys[i] == keys[i + step]).argmax(axis=1)
        i = i[keys[i, first] == key[i]]
        found.append((i, i + step))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def _paired(batches: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    """Rows (key, node) that have a pair under their key."""
    for rows in _whole_keys(batches):
        yield rows.iloc[np.unique(np.concatenate(_key_pairs(rows, scheme)))]


class _Judge:
    """Confirms pairs of rows on full shingle sets, and merges the components of those linked."""

    def __init__(self, rows: pd.DataFrame, scheme: Scheme, hashes: WordHashes):
        self.nodes, self.texts, self.labels = (rows[c].to_numpy() for c in ("node", "text", "label"))
        self.percent, self.hashes = scheme.percent, hashes
        self.sets: dict[int, np.ndarray] = {}
        self.roots: dict[int, int] = {}
        self.found: list[tuple[int, int]] = []

    def shingles(self, at: int) -> np.ndarray:
        node = self.nodes[at]
        if node not in self.sets:
            self.sets[node] = shingle_hashes(self.hashes.of(words_of(self.texts[at])), WIDTH)
        return self.sets[node]

    def root(self, at: int) -> int:
        label = self.labels[at]
        while (above := self.roots.get(label, label)) != label:
            label = above
        return label

    def judge(self, i: int, j: int) -> None:
        """A link is left out if the links found before it, or the components given, imply it."""
        a, b = self.root(i), self.root(j)
        if a == b:
            return
        mine, theirs = self.shingles(i), self.shingles(j)
        common = len(np.intersect1d(mine, theirs, assume_unique=True))
        if 100 * common >= self.percent * (len(mine) + len(theirs) - common):
            self.roots[max(a, b)] = min(a, b)
            self.found.append((min(self.nodes[i], self.nodes[j]), max(self.nodes[i], self.nodes[j])))

    def links(self) -> pd.DataFrame:
        return pd.DataFrame(self.found, columns=["a", "b"], dtype="int64")


def _key_links(batches: Iterator[pd.DataFrame], scheme: Scheme) -> Iterator[pd.DataFrame]:
    """Links that join components, among the pairs of each key."""
    hashes = WordHashes()
    for rows in _whole_keys(batches):
        judge = _Judge(rows, scheme, hashes)
        for i, j in zip(*_key_pairs(rows, scheme), strict=True):
            judge.judge(i, j)
        yield judge.links()


def _sparse_links(open_: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between components among classes that meet under keys of DENSE_KEY classes at most."""
    by_key = lambda df: df.repartition("key").sortWithinPartitions("key", "node")
    rows = by_key(open_.select("key", "node", "label", "n", "sig"))
    paired = stage(rows.mapInPandas(lambda batches: _paired(batches, scheme), rows.schema), "paired")
    linked = by_key(paired.join(texts, "node")).mapInPandas(lambda batches: _key_links(batches, scheme), PAIRS)
    return stage(linked, "links")


def _block_pairs(rows: pd.DataFrame, scheme: Scheme) -> Iterator[tuple[int, np.ndarray]]:
    """For places i of two blocks (or one): the places behind it, nearest first, that may link with it."""
    n, blocks, label = (rows[c].to_numpy() for c in ("n", "block", "label"))
    n = n.astype(np.int64)
    symbols = _symbols(np.stack(rows["sig"].to_numpy()), scheme)
    one_block = (blocks == blocks[0]).all()
    for i in range(len(rows)):
        j = np.arange(i + 1, len(rows))
        if not one_block:
            j = j[blocks[j] != blocks[i]]
        j = j[label[j] != label[i]]
        j = j[100 * np.minimum(n[j], n[i]) >= scheme.percent * np.maximum(n[j], n[i])]
        distance = (symbols[j] != symbols[i]).sum(axis=1)
        near = distance <= scheme.most_distance
        yield i, j[near][np.argsort(distance[near], kind="stable")]


def _block_paired(rows: pd.DataFrame, scheme: Scheme) -> pd.DataFrame:
    """Rows of two blocks (or one) that may link with another one."""
    at = [np.append(j, i) for i, j in _block_pairs(rows, scheme) if len(j)]
    return rows.iloc[np.unique(np.concatenate(at))] if at else rows.iloc[:0]


def _block_links(rows: pd.DataFrame, scheme: Scheme) -> pd.DataFrame:
    """Links between the classes of two blocks (or within one) that join components."""
    rows = rows.sort_values("node", ignore_index=True)
    judge = _Judge(rows, scheme, WordHashes())
    for i, near in _block_pairs(rows, scheme):
        for j in near:
            judge.judge(i, j)
    return judge.links()


def _dense_links(open_: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """Links between components among classes that meet under dense keys.

    Classes that meet are one cluster. Its largest component needs no comparison with itself: the
    others, in blocks, are compared with all blocks. Two blocks are one group of bounded size;
    signatures are compared in memory, and only links come out.
    """
    spark = open_.sparkSession
    centre = open_.groupBy("key").agg(F.min("node").alias("a"))
    edges = open_.join(stage(centre, "dense"), "key").select("a", F.col("node").alias("b")).distinct()
    members = open_.select("node", "label", "n", "sig").dropDuplicates(["node"])
    placed = stage(
        members.join(components(edges).withColumnRenamed("label", "cluster"), "node"), "clusters"
    )
    per_label = placed.groupBy("cluster", "label").agg(F.count("*").alias("rows"))
    main = per_label.groupBy("cluster").agg(
        F.max(F.struct("rows", "label")).alias("main"), F.sum("rows").alias("all")
    )
    blocks = lambda rows: F.ceil(rows / BLOCK).cast("long")
    sized = stage(
        main.select(
            "cluster", F.col("main.label").alias("main"),
            blocks(F.col("all") - F.col("main.rows")).alias("outer"), blocks(F.col("main.rows")).alias("inner"),
        ),
        "cluster sizes",
    )
    dealt = placed.join(sized, "cluster").withColumn(
        "block",
        F.when(F.col("label") == F.col("main"), F.col("outer") + F.pmod(F.xxhash64("node"), F.col("inner")))
        .otherwise(F.pmod(F.xxhash64("node"), F.col("outer"))),
    )
    last = F.when(F.col("block") < F.col("outer"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    units = (
        dealt.filter("outer > 0")
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .select(
            "cluster", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
            "block", "node", "label", "n", "sig",
        )
    )
    ship_package(spark)
    unit = ["cluster", "low", "high"]
    paired = stage(units.groupBy(unit).applyInPandas(lambda rows: _block_paired(rows, scheme), units.schema), "paired")
    linked = paired.join(texts, "node").groupBy(unit).applyInPandas(lambda rows: _block_links(rows, scheme), PAIRS)
    return stage(linked, "links")


def near_groups(docs: DataFrame, row_id: str | None = None, percent: int = LEAST_PERCENT) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, n_shingles, component_id, kept.

    ``percent`` is the least Jaccard similarity of a link, 80 or more.
    ``row_id`` names a column with distinct longs that are saved with the rows; without it, rows
    are numbered here and staged with their numbers: a later scan may be split in another way.
    """
    scheme = scheme_for(percent)
    ship_package(docs.sparkSession)
    rid = (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("rid")
    numbered = docs.select(rid, "doc_id", "text")
    if row_id is None:
        numbered = stage(numbered, "numbered")
    features = stage(
        per_text(numbered, lambda: _start_features(scheme), {"same": "binary", "n": "int", "sig": "array<long>"}), "features"
    )
    classes = stage(
        features.groupBy("same").agg(F.min("rid").alias("node"), F.max("n").alias("n"), F.max("sig").alias("sig")),
        "classes",
    )
    nodes = classes.filter("n > 0").select("node", "n", "sig")
    keys = nodes.select("node", "sig").mapInPandas(lambda batches: _keys(batches, scheme), "node long, key long")
    shared = stage(
        keys.groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("size"))
        .filter("first < last")
        .select("key", "size"),
        "shared",
    )
    met = stage(keys.join(shared, "key"), "met")
    # Who meets most others is most likely linked with them: the centre of each key's star.
    fame = met.groupBy("node").agg(F.sum("size").alias("fame"))
    famed = stage(met.join(fame, "node"), "famed")
    centres = famed.groupBy("key").agg(F.max(F.struct("fame", "node")).alias("centre"))
    stars = (
        met.join(stage(centres.select("key", F.col("centre.node").alias("centre")), "centres"), "key")
        .filter("node <> centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )
    stars = stage(stars, "stars")
    texts = stage(
        numbered.join(met.select("node").distinct(), F.col("rid") == F.col("node"), "left_semi").select(
            F.col("rid").alias("node"), "text"
        ),
        "texts",
    )
    links = _confirmed(stars, nodes, texts, scheme)
    labels = components(links)
    # Keys under which more than one component meets; a class without links is its own.
    placed = stage(
        met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")),
        "placed",
    )
    mixed_keys = (
        placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low < high").select("key")
    )
    open_ = stage(
        placed.join(mixed_keys, "key", "left_semi").join(shared, "key").join(nodes.select("node", "n", "sig"), "node"), "open"
    )
    sparse = _sparse_links(open_.filter(F.col("size") <= DENSE_KEY), texts, scheme)
    more = sparse.union(_dense_links(open_.filter(F.col("size") > DENSE_KEY), texts, scheme))
    if not more.isEmpty():
        labels = components(links.union(more))
    placed_rows = (
        features.join(classes.select("same", "node"), "same")
        .join(labels, "node", "left")
        .select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "node")).otherwise(F.col("rid")).alias("label"))
    )
    placed_rows = stage(placed_rows, "components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    smallest = stage(placed_rows.groupBy("label").agg(first), "smallest")
    return placed_rows.join(smallest, "label").select(
        "rid", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"),
        (F.col("rid") == F.col("first.rid")).alias("stays"),
    )
