"""Token counts of documents without token ids.

A tokenizer cuts a text into pre-tokens and each of these into pieces, so a document has as many tokens
as the pieces of its pre-tokens add up to:

1. Occurrences of each distinct pre-token of the corpus (summed in each task, then by key).
2. The model counts the pieces of each distinct pre-token, once.
3. Per-document pre-token frequencies are joined with these counts and summed.

The join is in two parts, as a frequent pre-token is in nearly every document. The HEAD most frequent ones
at most are sent to all tasks, so their part of the sum never leaves the task that reads the text; all
others, none of which is frequent, are joined by key. Which are frequent follows from a histogram of
the occurrences, so nothing is sorted and the number sent is bounded whatever the corpus.

A pre-token of more than LONG_KEY characters is represented by its digest, so keys are short; its pieces are
counted where it is found. Texts are cut at the six ASCII spaces first, and each distinct word is
pre-tokenized once per worker memory, plain Latin ones by the pattern in the tokenizer's file, others by
the library; ``PreTokens`` checks that the tokenizer's pre-tokens never cross a space. Words of
more than LONG_WORD bytes are cut further where an ASCII letter or digit meets another mark, so that the
library's own working memory stays small.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of the tokenizer's special tokens
inside a text are one token each, as is the library's default; a repeated row is counted again; a null doc_id
is kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.session import ship_package, stage

MAX_TOKENS = 2048
# Most pre-tokens that are sent to all tasks, at most LONG_KEY characters each.
HEAD = 65_536
LONG_KEY = 64
LONG_WORD = 20_000
# Words that a worker keeps the pre-tokens of, and distinct words summed before they are handed on.
KNOWN_WORDS = 300_000
SUMMED_WORDS = 400_000
TEXTS_AT_ONCE = 500

SPACES = " \t\n\v\f\r"
# Space is in no pre-token, so it marks keys that are not the pre-token itself.
SPECIAL, DIGEST = "\n", "\r"
INSIDE_LONG_WORD = re.compile(r"(?<=[0-9A-Za-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[0-9])(?=[0-9A-Za-z])")
# Printable letters and marks of Latin scripts, none of which combines with another.
PLAIN = re.compile("[!-~¡-¬®-ɏ]+")
PROBES = ["a", "Z9", "it's", "'s", "é", "́x", "字", "...", "-", "İ"]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


def plain_pattern(spec: dict) -> tuple[regex.Pattern, bool] | None:
    """What a tokenizer's file says of plain words: the pattern of pre-tokens, and whether they are lower-cased.

    None where it says more than that.
    """
    steps = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    normalizers, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    lower = False
    for step in normalizers:
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"}
        lower |= step["type"] == "Lowercase"
        if not (spaces or step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase")):
            return None
    if [s["type"] for s in pre] != ["Split", "ByteLevel"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]:
        return None
    split = pre[0]
    if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"]:
        return None
    return regex.compile(split["pattern"]["Regex"]), lower


class PreTokens(dict):
    """Keys of the pre-tokens of each word (UTF-8 without ASCII space), remembered."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or set(t.content) & set(SPACES) for t in added):
            raise ValueError("added tokens that depend on what stands around them can't be counted word by word")
        names = sorted((re.escape(t.content) for t in added), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(names)})" if names else r"(?!)")
        self.plain = plain_pattern(json.loads(self.tokenizer.to_str()))
        self.letters = byte_letters()
        if self.plain:
            # Normal forms and letter cases must be those of the library for every plain character.
            plain = [c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)]
            if any(self.cut(c) != self.cut_plain(c) for c in plain):
                self.plain = None
        for a in PROBES:
            for b in PROBES:
                for space in [*SPACES, "\r\n ", "  "]:
                    if self.cut(a + space + b) != self.cut(a) + self.cut(b):
                        raise ValueError("this tokenizer's pre-tokens cross spaces")

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens, as the model gets them."""
        if self.tokenizer.normalizer:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def cut_plain(self, text: str) -> list[str]:
        """The same for a plain word, by the pattern alone."""
        pattern, lower = self.plain
        found = pattern.findall(text.lower() if lower else text)
        if text.isascii():
            return found
        return [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in found]

    def key(self, pre_token: str) -> str:
        if len(pre_token) <= LONG_KEY:
            return pre_token
        return DIGEST + hashlib.sha256(pre_token.encode()).hexdigest()

    def of(self, word: bytes) -> list[str]:
        """Pre-tokens of a word, special tokens marked."""
        text = word.decode("utf-8", "replace")
        if self.plain and PLAIN.fullmatch(text) and not self.special.search(text):
            return self.cut_plain(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(SPECIAL + part)
            else:
                for piece in INSIDE_LONG_WORD.split(part) if len(part) > LONG_WORD else [part]:
                    out += self.cut(piece) if piece else []
        return out

    def __missing__(self, word: bytes) -> tuple[str, ...]:
        keys = tuple(map(self.key, self.of(word)))
        if len(word) <= LONG_KEY:
            self[word] = keys
        return keys

    def forget(self) -> None:
        if len(self) > KNOWN_WORDS:
            self.clear()

    def pieces(self, pre_token: str) -> int:
        """Number of tokens that the model makes of a pre-token."""
        return 1 if pre_token[:1] == SPECIAL else len(self.tokenizer.model.tokenize(pre_token))


@cache
def pre_tokens(path: str) -> PreTokens:
    """One for each worker process: its tasks share the memory of words."""
    return PreTokens(path)


def _occurrences(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = pre_tokens(path)
    words: Counter[bytes] = Counter()

    def summed() -> pa.RecordBatch:
        totals: Counter[str] = Counter()
        long: dict[str, int] = {}
        for word, n in words.items():
            if len(word) > LONG_KEY:
                for pre_token in known.of(word):
                    key = known.key(pre_token)
                    totals[key] += n
                    if key[:1] == DIGEST and key not in long:
                        long[key] = known.pieces(pre_token)
            else:
                for key in known[word]:
                    totals[key] += n
        words.clear()
        known.forget()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64()),
             pa.array([long.get(k) for k in totals], pa.int64())],
            names=["key", "n", "long"],
        )

    for batch in batches:
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words.update((text or b"").split())
            if len(words) > SUMMED_WORDS:
                yield summed()
    yield summed()


def _pieces(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = pre_tokens(path)
    for batch in batches:
        keys, n, long = (batch.column(c) for c in ("key", "n", "long"))
        made = [v if v is not None else known.pieces(k) for k, v in zip(keys.to_pylist(), long.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([keys, n, pa.array(made, pa.int64())], names=["key", "n", "pieces"])


def distinct_pre_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Staged (key, n, pieces): occurrences and number of tokens of each distinct pre-token."""
    ship_package(docs.sparkSession)
    found = docs.select("text").mapInArrow(lambda b: _occurrences(tokenizer, b), "key string, n long, long long")
    totals = found.groupBy("key").agg(F.sum("n").alias("n"), F.max("long").alias("long"))
    return stage(totals.mapInArrow(lambda b: _pieces(tokenizer, b), "key string, n long, pieces long"), "pre-tokens")


def frequent_from(pieces: DataFrame, most: int) -> float:
    """The least number of occurrences that at most ``most`` pre-tokens have.

    From a histogram with eight steps to each doubling: a few hundred rows.
    """
    step = F.floor(8 * F.log2(F.col("n"))).cast("int").alias("step")
    held, least = 0, float("inf")
    for r in sorted(pieces.groupBy(step).agg(F.count("*").alias("rows"), F.min("n").alias("least")).collect(), reverse=True):
        held += r["rows"]
        if held > most:
            break
        least = r["least"]
    return least


def _document_sums(path: str, head: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of the head's pre-tokens in each text, and how often it has each of the others."""
    known = pre_tokens(path)
    tail_type = pa.struct([("key", pa.string()), ("times", pa.int64())])
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            sums, keys, times, ends = [], [], [], array("i", [0])
            for text in part.column("text").cast(pa.binary()).to_pylist():
                total = 0
                for key, n in Counter(chain.from_iterable(map(known.__getitem__, (text or b"").split()))).items():
                    pieces = head.get(key)
                    if pieces is None:
                        keys.append(key)
                        times.append(n)
                    else:
                        total += n * pieces
                sums.append(total)
                ends.append(len(keys))
            known.forget()
            tail = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(times, pa.int64())], fields=list(tail_type))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("row", "doc_id", "n_bytes")), pa.array(sums, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)],
                names=["row", "doc_id", "n_bytes", "frequent", "tail"],
            )


def count_tokens(docs: DataFrame, tokenizer: str, head: int = HEAD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens.

    ``tokenizer`` is the path of a file of the ``tokenizers`` library.
    """
    spark = docs.sparkSession
    pieces = distinct_pre_tokens(docs, tokenizer)
    frequent = F.col("n") >= F.lit(frequent_from(pieces, head))
    # At most ``head`` short keys.
    sent = spark.sparkContext.broadcast({r["key"]: r["pieces"] for r in pieces.filter(frequent).collect()})
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "text",
    )
    id_type = docs.select("doc_id").dtypes[0][1]
    counted = stage(
        rows.mapInArrow(
            lambda b: _document_sums(tokenizer, sent.value, b),
            f"row long, doc_id {id_type}, n_bytes long, frequent long, tail array<struct<key: string, times: long>>",
        ),
        "frequencies",
    )
    others = (
        counted.select("row", F.inline("tail"))
        .join(pieces.filter(~frequent).select("key", "pieces"), "key")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    )
    n_tokens = (F.col("frequent") + F.coalesce("others", F.lit(0))).alias("n_tokens")
    return counted.join(others, "row", "left").select("doc_id", "n_bytes", n_tokens)
