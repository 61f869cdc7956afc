"""Language-model scores: the marginal likelihood of a text over all its segmentations.

The model is a unigram model over the pieces of an existing BPE vocabulary (and single bytes, so that any text can be made). A text is a sequence of pieces and an end; its probability is
the sum over all segmentations, found by a forward recursion in log space. Pieces never
cross a word's beginning, so the recursion runs word by word and the logarithms add up.

A BPE vocabulary scores pieces by merge rank, not by probability, so a piece of rank r starts
with a weight in proportion to 1 / (1 + r); weights are then fitted to the training words by
rounds of expectation and maximisation: each word of the corpus, with its count, is weighed over
all its segmentations. The vocabulary is fixed; only the weights are fitted, from all training
documents. The base model is a word unigram model with add-one smoothing.

Words of a batch that have the same length go through the recursion together, as rows of numbers in place of logarithms; a
word that is long, or whose numbers leave the range of a double, goes through it alone, in log space.

At scale: word counts are aggregates with a partial step, and each distinct word is scored once. The HEAD most frequent words and the
pieces (bounded numbers) are sent to all tasks; all other words of a document are joined with the
counts by word. The join has no hot key, as every frequent word is in the head.

Defined results: a null or empty text is its end alone; a null doc_id is in training; repeated
rows count and are scored each; without training documents all counts are 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property
from math import exp, inf, log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.text import per_text, words_of
from skygauge.session import ship_package, stage

HEAD = 1 << 16
ROUNDS = 2
PSEUDO_COUNT = 0.1
FOLDS, HELD_OUT = 7, 2
WORD_MARK = b" "
# Weight that single bytes have at first, together, in proportion to all pieces.
BYTE_SHARE = 0.01
# Words counted in a task before they are handed on.
COUNTED_AT_ONCE = 1_000_000
# Words of more bytes go through the recursion one by one, as do those of a length that fewer words have.
LONG_WORD, FEW_WORDS = 64, 8
# Bytes of words that go through the recursion together.
BYTES_AT_ONCE = 1 << 15
# Places of pieces in words that are held until they are added up.
USES_AT_ONCE = 1 << 20
# Numbers outside these may have lost digits.
SMALLEST, LARGEST = 1e-280, 1e280
Weights = dict[bytes, float]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def vocabulary(path: str) -> Weights:
    """Log weights of the pieces of a sentencepiece model, from its scores.

    Scores that are ranks (0, -1, -2, ...), as in merge models, weigh a piece by 1 / (1 + rank).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)):
            scores[model.id_to_piece(k).replace("▁", " ").encode()] = model.get_score(k)
    ranks = min(scores.values()) < -1000
    weights = {p: -log(1 - s) if ranks else s for p, s in scores.items() if p}
    total = sum(map(exp, weights.values()))
    for b in range(256):
        weights.setdefault(bytes([b]), log(BYTE_SHARE * total / 256))
    return _normal({p: exp(w) for p, w in weights.items()})


def _normal(counts: dict[bytes, float]) -> Weights:
    total = sum(counts.values())
    return {p: log(c / total) for p, c in counts.items()}


class Lattice:
    """All segmentations of a word under given log weights."""

    def __init__(self, weights: Weights):
        self.weights = weights

    @cached_property
    def pieces(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for piece, weight in self.weights.items():
            made.add_word(piece.decode("latin-1"), (len(piece), weight, piece))
        made.make_automaton()
        return made

    @cached_property
    def beginnings(self) -> list[bytes]:
        """Beginnings of pieces by their number, from 1 on: the empty one, others that go on, whole pieces that don't."""
        inner = {piece[:k] for piece in self.weights for k in range(len(piece))} | {b""}
        return [*sorted(inner), *sorted(self.weights.keys() - inner)]

    @cached_property
    def following(self) -> np.ndarray:
        """At 256 * beginning + byte the beginning that is one byte longer, 0 for none; the last entry stands for all after it."""
        numbers = {b: k for k, b in enumerate(self.beginnings, 1)}
        inner = 1 + max((numbers[b[:-1]] for b in numbers if b), default=0)
        out = np.zeros(256 * inner + 1, np.int32)
        for b, k in numbers.items():
            if b:
                out[256 * numbers[b[:-1]] + b[-1]] = k
        return out

    @cached_property
    def shift(self) -> float:
        """Added to log weights for each byte, so that products of many weights stay in range."""
        return -min(weight / len(piece) for piece, weight in self.weights.items()) / 2

    @cached_property
    def shifted(self) -> np.ndarray:
        """Shifted weight of each beginning, not as a logarithm; 0 for what is no piece."""
        own = [self.weights[b] + self.shift * len(b) if b in self.weights else -inf for b in self.beginnings]
        # What is too large makes words with it go alone.
        with np.errstate(over="ignore"):
            return np.exp([-inf, *own])

    def together(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """Places of words that have one length and their bytes, mark first, a column for each; None for words that go alone."""
        by_length = defaultdict(list)
        for k, word in enumerate(words):
            by_length[len(word)].append(k)
        for length, places in by_length.items():
            if length > LONG_WORD or len(places) < FEW_WORDS:
                yield np.array(places), None
                continue
            n = length + 1
            for at in range(0, len(places), step := max(1, BYTES_AT_ONCE // n)):
                part = places[at : at + step]
                whole = b"".join([WORD_MARK + words[k] for k in part])
                yield np.array(part), np.ascontiguousarray(np.frombuffer(whole, np.uint8).reshape(-1, n).T)

    def spans(self, text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """By length: the beginning (its number) at each start, and its shifted weight."""
        text = text.astype(np.int32)
        at = self.following[256 + text]
        numbers, values = [at], [self.shifted[at]]
        for n in range(1, len(text)):
            at = np.take(self.following, 256 * at[:-1] + text[n:], mode="clip")
            if not at.any():
                break
            numbers.append(at)
            values.append(self.shifted[at])
        return numbers, values

    @staticmethod
    def sums(values: list[np.ndarray]) -> np.ndarray:
        """Shifted weight of all segmentations of each beginning of the words; ``values`` by length and start."""
        n, words = values[0].shape
        out = np.zeros((n + 1, words))
        out[0] = 1
        for end in range(1, n + 1):
            for length, own in enumerate(values[:end], 1):
                out[end] += out[end - length] * own[end - length]
        return out

    @staticmethod
    def in_range(sums: np.ndarray) -> np.ndarray:
        """Words of which no number has lost digits."""
        return (sums.min(0) > SMALLEST) & (sums.max(0) < LARGEST)

    def log10_of(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word, its mark included."""
        out = np.empty(len(words))
        for places, text in self.together(words):
            alone = places
            if text is not None:
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    alpha = self.sums(self.spans(text)[1])
                    out[places] = (np.log(alpha[-1]) - self.shift * len(text)) / log(10)
                alone = places[~self.in_range(alpha)]
            for k in alone.tolist():
                out[k] = self.log10(words[k])
        return out

    def expected_of(self, words: list[bytes], counts: list[float], into: np.ndarray) -> dict[bytes, float]:
        """Adds to ``into``, by the numbers of beginnings, how often each piece is expected in the words; returns what
        words that went alone use."""
        weight, used = np.array(counts, np.float64), {}
        found, uses, held = [], [], 0

        def add():
            nonlocal held
            if held:
                into[:] += np.bincount(np.concatenate(found), np.concatenate(uses), len(into))
            found.clear(), uses.clear()
            held = 0

        for places, text in self.together(words):
            alone = places
            if text is not None:
                numbers, values = self.spans(text)
                with np.errstate(over="ignore", invalid="ignore"):
                    alpha = self.sums(values)
                    # From the word's end on, pieces are known by the distance of their end from it.
                    beta = self.sums([v[::-1] for v in values])[::-1]
                good = self.in_range(alpha) & self.in_range(beta)
                alone = places[~good]
                if len(alone):
                    numbers, values = [v[:, good] for v in numbers], [v[:, good] for v in values]
                    alpha, beta = alpha[:, good], beta[:, good]
                share = weight[places[good]] / alpha[-1]
                for length, (number, value) in enumerate(zip(numbers, values, strict=True), 1):
                    found.append(number.ravel())
                    uses.append((alpha[:-length] * value * beta[length:] * share).ravel())
                    held += len(found[-1])
                if held > USES_AT_ONCE:
                    add()
            for k in alone.tolist():
                self.expected(words[k], counts[k], used)
        add()
        return used

    def arcs(self, word: bytes) -> list[tuple[int, int, float, bytes]]:
        """(start, end, weight, piece) of all pieces in a word, by their ends."""
        found = self.pieces.iter((WORD_MARK + word).decode("latin-1"))
        return [(end + 1 - n, end + 1, weight, piece) for end, (n, weight, piece) in found]

    @staticmethod
    def forward(arcs: list[tuple], length: int) -> list[float]:
        """Log weight of all segmentations of each beginning of a word."""
        alpha = [-inf] * (length + 1)
        alpha[0] = 0.0
        at, terms = 0, [0.0]
        for start, end, weight, _ in arcs:
            if end != at:
                if len(terms) > 1:
                    top = max(terms)
                    alpha[at] = top + log(sum([exp(t - top) for t in terms]))
                else:
                    alpha[at] = terms[0]
                at, terms = end, []
            terms.append(alpha[start] + weight)
        top = max(terms)
        alpha[at] = top + log(sum([exp(t - top) for t in terms]))
        return alpha

    def log10(self, word: bytes) -> float:
        """log10 of the probability of a word, its mark included."""
        return self.forward(self.arcs(word), len(word) + 1)[-1] / log(10)

    def expected(self, word: bytes, count: float, into: dict[bytes, float]) -> None:
        """Adds the expected number of times each piece is used in ``count`` such words."""
        arcs = self.arcs(word)
        n = len(word) + 1
        alpha = self.forward(arcs, n)
        total = alpha[n]
        # From the last arc on, a start's arcs all end at places that are complete.
        beta = [0.0] * (n + 1)
        by_start: list[list[tuple]] = [[] for _ in range(n)]
        for arc in arcs:
            by_start[arc[0]].append(arc)
        for start in range(n - 1, -1, -1):
            own = by_start[start]
            terms = [weight + beta[end] for _, end, weight, _ in own]
            for arc, term in zip(own, terms, strict=True):
                into[arc[3]] = into.get(arc[3], 0.0) + count * exp(alpha[start] + term - total)
            top = max(terms)
            beta[start] = top + log(sum([exp(t - top) for t in terms])) if len(terms) > 1 else top


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, seen) over all documents; n counts those not ``held_out``, seen counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())

        def made():
            words = [*counts[0], *counts[1]]
            n = [*counts[0].values(), *[0] * len(counts[1])]
            seen = [*counts[0].values(), *counts[1].values()]
            arrays = [pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n", "seen"])

        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
                counts[out].update(words_of(text.as_py()))
                if len(counts[0]) + len(counts[1]) > COUNTED_AT_ONCE:
                    yield made()
                    counts[0].clear()
                    counts[1].clear()
        yield made()

    ship_package(docs.sparkSession)
    counted = docs.select("text", "held_out").mapInArrow(run, "word binary, n long, seen long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def word_scores(counts: DataFrame, weights: Weights) -> DataFrame:
    """``counts`` (word, n, seen) with ``log10`` of each word's probability."""
    sent = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            values = pa.array(lattice.log10_of(batch.column("word").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "log10"])

    return counts.mapInArrow(run, "word binary, n long, seen long, log10 double")


def fit(counts: DataFrame, ends: int, path: str, rounds: int = ROUNDS) -> tuple[Weights, float]:
    """Piece weights and the log weight of the end, from word counts."""
    spark = counts.sparkSession
    weights = vocabulary(path)
    end = log(0.1)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(sent.value)
            by_number, uses = np.zeros(len(lattice.beginnings) + 1), Counter()
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_pylist()
                uses.update(lattice.expected_of(words, n, by_number))
            pieces = ((piece, n) for piece, n in zip(lattice.beginnings, by_number[1:].tolist(), strict=True) if n)
            uses.update(dict(pieces))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(uses), pa.binary()), pa.array(list(uses.values()), pa.float64())], names=["piece", "uses"]
            )

        # At most one row for each piece of the vocabulary.
        rows = (
            counts.mapInArrow(run, "piece binary, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        )
        used = {bytes(r["piece"]): r["uses"] for r in rows}
        fitted = {p: used.get(p, 0.0) + PSEUDO_COUNT for p in weights}
        total = sum(fitted.values()) + ends + PSEUDO_COUNT
        weights = {p: log(c / total) for p, c in fitted.items()}
        end = log((ends + PSEUDO_COUNT) / total)
    return weights, end


def score(docs: DataFrame, path: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = stage(word_counts(rows), "words")
    known = counts.filter("n > 0")
    found = known.agg(F.sum("n").alias("n"), F.count("*").alias("words")).first()
    ends = rows.filter(~F.col("held_out")).count()
    all_tokens = (found["n"] or 0) + ends
    distinct = found["words"] + (1 if ends else 0)
    weights, end = fit(known, ends, path)
    words = stage(word_scores(counts, weights), "word scores")
    frequent = words.orderBy(F.desc("seen"), "word").limit(head).collect()
    sent = spark.sparkContext.broadcast(
        {bytes(r["word"]): (r["n"], log10(r["n"] + 1), r["log10"]) for r in frequent}
    )

    def start():
        values = sent.value

        def scores(texts):
            out = []
            for text in texts:
                words = Counter(words_of(text))
                known, base, total, rare = 0, 0.0, 0.0, []
                for word, k in words.items():
                    value = values.get(word)
                    if value is None:
                        rare.append((word, k))
                    else:
                        known += k if value[0] else 0
                        base += k * value[1]
                        total += k * value[2]
                out.append((words.total() + 1, known, base, total + end / log(10), [w for w, _ in rare], [k for _, k in rare]))
            return out

        return scores

    fields = {"tokens": "long", "known": "long", "base": "double", "score": "double", "words": "array<binary>", "ks": "array<int>"}
    scored = stage(
        per_text(rows.withColumn("rid", F.monotonically_increasing_id()), start, fields), "scored"
    )
    rare = scored.select("rid", F.explode(F.arrays_zip("words", "ks")).alias("w")).select(
        "rid", F.col("w.words").alias("word"), F.col("w.ks").alias("k")
    )
    rest = (
        rare.join(words, "word")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more"),
            F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("more_base"),
            F.sum(F.col("k") * F.col("log10")).alias("more_score"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        scored.drop("words", "ks").join(rest, "rid", "left")
        .select(
            "doc_id", "held_out", F.col("tokens").alias("n_tokens"),
            (F.col("known") + zero("more") + (1 if ends else 0)).cast("long").alias("n_known"),
            F.lit(all_tokens).cast("long").alias("train_tokens"),
            (
                F.col("base") + zero("more_base") + log10(ends + 1)
                - F.col("tokens") * log10(all_tokens + distinct + 1)
            ).alias("base_score"),
            (F.col("score") + zero("more_score")).alias("score"),
        )
    )
