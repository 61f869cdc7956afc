"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps its measurements and one failure bit
per rule. A policy is a version with a mask of rules: a document passes if no bit of the
mask is set, so a new policy or an ablation needs no text. Ablations first count documents by
bit pattern (an aggregate with a partial step and at most 2^rules groups) and then
apply masks to the few patterns.

Defined results: null and empty texts have no words, so all measures are 0 and rule
``few_words`` fails; repeated rows are judged alike; an empty table gives an empty ledger; other
columns are kept by ``apply_policy`` and ignored by the ledger.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.text import per_text, words_of

WINDOW = 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = {c: "long" for c in [*MEASURES, "n_lines", "n_shouted", "n_marked", "unspaced"]}
# Scripts written without blanks between words: Thai, Lao, Tibetan, Burmese, Khmer, Tai, kana, Han, Yi, Javanese and others.
_UNSPACED = (
    "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
)
UNSPACED_LETTER = re.compile(rf"(?![\d_])[{_UNSPACED}]")
OTHER_LETTER = re.compile(rf"[^\W\d_{_UNSPACED}]")


def _rules() -> dict[str, Column]:
    words = F.col("n_words")
    return {
        "few_words": words < 10,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * words,
        "symbols": 100 * F.col("n_symbols") > 10 * words,
        "duplicate_lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
        "long_words": (F.col("unspaced") == 0) & (F.col("word_chars") > 14 * words),
        "short_words": (F.col("unspaced") == 0) & (words >= 50) & (F.col("word_chars") < 2 * words),
        "shouting": (words >= 10) & (100 * F.col("n_shouted") > 60 * words),
        "exclamations": 100 * F.col("n_marked") > 30 * words,
    }


BASE_RULES = ("few_words", "repeated_windows")
POLICIES = {
    "base-1": BASE_RULES,
    "clean-1": (*BASE_RULES, "symbols", "duplicate_lines", "long_words"),
    "clean-2": (
        *BASE_RULES, "symbols", "duplicate_lines", "long_words", "short_words", "shouting", "exclamations",
    ),
}
CURRENT = "clean-2"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of ``width`` words that stand at least twice, the first included.

    Windows are numbered exactly, by their first part's number and the next word's.
    """
    n = len(words)
    if n <= width:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, count=n)
    if len(numbers) == n:
        return 0
    window = ids
    for k in range(1, width):
        pairs = window[:-1] * np.int64(n) + ids[k:]
        window, counts = np.unique(pairs, return_inverse=True, return_counts=True)[1:]
        if len(counts) == len(window):
            return 0
    covered = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[window] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered[:n]) > 0).sum())


def unspaced(text: str) -> bool:
    """Whether most letters are of scripts without blanks between words; word lengths say nothing then."""
    if text.isascii():
        return False
    n = sum(1 for _ in UNSPACED_LETTER.finditer(text))
    return n > 0 and n > sum(1 for _ in OTHER_LETTER.finditer(text))


def measures(text: str | None) -> tuple[int, ...]:
    """The values of MEASURED for a text."""
    text = text or ""
    words = words_of(text, lower=False)
    lines = [line for line in text.split("\n") if line.encode("utf-8", "surrogatepass").strip()]
    joined = b"".join(words).decode("utf-8", "surrogatepass")
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    marked = sum(1 for w in words if w.endswith(b"!!"))
    return (
        len(words), len(joined), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), shouted, marked, int(unspaced(text)),
    )


def _start():
    return lambda texts: [measures(t) for t in texts]


def mask_of(rules: tuple[str, ...]) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in rules)


def failure_bits() -> Column:
    bits = [F.when(failed, F.lit(1 << k)).otherwise(0) for k, failed in enumerate(_rules().values())]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("int")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements and ``failures``, one row per document."""
    return per_text(docs.select("doc_id", "text"), _start, MEASURED).withColumn("failures", failure_bits())


def passes(policy: str | tuple[str, ...] = CURRENT, without: str | None = None) -> Column:
    """Whether a row of the ledger passes a policy, optionally with one rule left out."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("failures").bitwiseAND(mask_of(tuple(r for r in rules if r != without))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """policy, rule, kept, gained: documents kept by each policy, and those it would keep
    beyond them without the rule. ``rule`` is null for the whole policy."""
    patterns = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [(p, r) for p, rules in POLICIES.items() for r in (None, *rules)]
    spark = rows.sparkSession
    table = spark.createDataFrame(
        [(p, r, mask_of(POLICIES[p]), mask_of(tuple(x for x in POLICIES[p] if x != r))) for p, r in cases],
        "policy string, rule string, whole int, mask int",
    )
    passed = lambda mask: F.col("failures").bitwiseAND(F.col(mask)) == 0
    return (
        patterns.join(F.broadcast(table), passed("mask"), "right")
        .groupBy("policy", "rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(~passed("whole"), F.col("n"))), F.lit(0)).alias("gained"),
        )
    )


def apply_policy(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The documents that pass, with their columns as given."""
    inside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    rows = per_text(inside, _start, MEASURED).withColumn("failures", failure_bits())
    return rows.filter(passes(policy)).select("row.*")
