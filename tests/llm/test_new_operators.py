"""Token counts, prefix trie and whitening against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skygauge.llm import token_counts, trie, whitening

COUNTED = public_tokenizers.path("word_bpe_49k.json")
CLASH = "row long, key string, n long, pieces long, n_bytes string, x string, at long, part long, k1 long, block long, depth long"
CLASHING = (1, "k", 2, 3, "b", "x", 4, 5, 6, 7, 8)

# -- token counts -------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", " ", "a", "it's they'll DON'T 's", "<|endoftext|>", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|end",
    "é ́x 가 İ Ị̇ ΑΣ ΣΑΣ", " a b\x85c\x1cd\x00e", "123 4,5.6 x7y８", "字字字。字 ไทย العربية",
    "\U0001f600\U0001f1e9\U0001f1ea ﻿", "a\r\n\tb\v\fc", "word " * 3000, "z" * 500 + " " + "Z" * 500, "é" * 300 + "1" * 300,
    "!" * 200 + "?" * 70, ("abc123+/" * 5000), "x" * 70 + "." + "x" * 70,
]


def library_counts(texts):
    tokenizer = Tokenizer.from_file(COUNTED)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("head", [token_counts.HEAD, 3, 0])
def test_token_counts(spark, head):
    """Everything sent to all tasks, a few pre-tokens, none; repeated rows, null ids, clashing columns."""
    rows = [(k, t, *CLASHING) for k, t in enumerate(ODD_TEXTS)] + [(None, "a b a", *CLASHING), (3, "a", *CLASHING), (3, "a", *CLASHING)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}").repartition(4)
    found = token_counts.count_tokens(docs, COUNTED, head).collect()
    texts = [r[1] for r in rows]
    want = sorted((r[0] is None, r[0] or 0, len((t or "").encode()), n) for r, t, n in zip(rows, texts, library_counts(texts), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == want


def test_token_counts_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, COUNTED).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert found == dict(zip([r.doc_id for r in rows], library_counts([r.text for r in rows]), strict=True))


def test_no_documents_no_counts(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string"), COUNTED).isEmpty()


def test_head_is_bounded(spark):
    pieces = spark.createDataFrame([(str(k), 1 + k % 50, 1) for k in range(1000)], "key string, n long, pieces long")
    for most in (0, 1, 20, 500, 1000, 5000):
        least = token_counts.frequent_from(pieces, most)
        held = sum(1 + k % 50 >= least for k in range(1000))
        assert held <= most and (most < 1000 or held == 1000)


def test_long_words_are_cut_at_pre_tokens():
    known = token_counts.PreTokens(COUNTED)
    text = ("Ab9c+/d'll=4," * 2000) + "<|endoftext|>" + "x" * 30_000
    whole = Tokenizer.from_file(COUNTED).encode(text, add_special_tokens=False)
    assert sum(map(known.pieces, known.of(text.encode()))) == len(whole.ids)


def test_tokenizers_that_join_spaces_are_refused():
    with pytest.raises(ValueError, match="cross spaces"):
        token_counts.PreTokens(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(min_codepoint=0x21, max_codepoint=0x24F, exclude_categories=["Cc", "Cf", "Zs"]), min_size=1, max_size=40))
def test_pattern_of_plain_words_is_the_library(word):
    known = token_counts.pre_tokens(COUNTED)
    assert known.plain and token_counts.PLAIN.fullmatch(word)
    assert known.special.search(word) or known.of(word.encode()) == known.cut(word)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_words_add_up_to_the_text(text):
    known = token_counts.pre_tokens(COUNTED)
    raw = text.encode("utf-8", "replace")
    total = sum(known.pieces(p) for w in raw.split() for p in known.of(w))
    assert total == library_counts([raw.decode()])[0]


# -- prefix trie --------------------------------------------------------------------------


def plain_trie(rows, digest_order=True):
    """Node rows for (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest() if digest_order else ""
            own[conv_id].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(own.get(root, [])[:h] + said[h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1]) if path else 0
            leaves[path[:d]] += path not in children
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children.get(path, 0), leaves[path],
            saved[path], hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def odd_conversations():
    rows = []
    for c in range(0, 260):
        for t in range(c % 7):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {t} of {c % 3} é\U0001f600"))
    # Copies of one conversation, one that is a prefix of it, and a long one.
    for c in range(1000, 1060):
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    rows += [(1060, t, "user", f"same {t}") for t in range(7)]
    rows += [(1100, t, "user", f"long {t % 3}") for t in range(60)] + [(1101, t, "user", f"long {t % 3}") for t in range(60)]
    # Nulls, ties, repeated rows, other ids.
    rows += [(2000, None, None, None), (2000, None, "user", None), (2000, 3, "a", "b"), (2000, 3, "a", "b"), (2000, 3, "ab", "")]
    rows += [(None, 0, "user", "nobody"), (-7, 1, "user", "x"), (-107, 0, "user", "y"), (2**40 + 3, 0, None, "z"), (2**40 + 3, 1, "user", "z")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    """Once with blocks, ranges of ids and parents so small that all are split."""
    if small:
        monkeypatch.setattr(trie, "BLOCK_TURNS", 4)
        monkeypatch.setattr(trie, "IDS_AT_ONCE", 3)
        monkeypatch.setattr(trie, "PARENTS", 10**6)
    rows = odd_conversations()
    turns = spark.createDataFrame([(*r, *CLASHING) for r in rows], f"conv_id long, turn long, role string, text string, {CLASH}")
    found = trie.prefix_trie(turns.repartition(5)).collect()
    assert sorted(map(tuple, found), key=lambda r: (r[0], r[1], r[2] or 0)) == sorted(plain_trie(rows), key=lambda r: (r[0], r[1], r[2] or 0))


def test_long_conversation_over_many_ranges(spark):
    """One conversation with nearly all rows is dealt out, and its positions still run through."""
    rows = [(5, t, "user", f"t{t % 11}") for t in range(3000)] + [(7, 0, "user", "a"), (7, 1, "user", "b")]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = trie._ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = sorted((r.conv_id, r.pos, r.n) for r in placed.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == sorted([(5, k + 1, 3000) for k in range(3000)] + [(7, 1, 2), (7, 2, 2)])


def test_no_conversations_no_nodes(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


# -- whitening ----------------------------------------------------------------------------


def plain_whitening(vectors, components=16):
    """n, exact deviations, whitened columns (up to sign), shares; for clean vectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True))) for row in x]
    centred = (n * fit - s).astype(float) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    whitened = ((n * x - s).astype(float) / n) @ vectors_[:, order] / np.sqrt(values[order])
    return n, deviation, whitened, values[order] / values.sum()


def test_whitening(spark):
    """Copies, null and non-finite entries, null ids, odd lengths, clashing columns."""
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(300, 20)) * np.linspace(3, 0.5, 20)).astype("float32").tolist()
    good += [good[0]] * 100
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [1e30] + good[0][1:], [], [0.0] * 19]
    rows = [(k, v, *CLASHING) for k, v in enumerate(good)] + [(5000 + k, v, *CLASHING) for k, v in enumerate(bad)]
    rows.append((None, good[3], *CLASHING))
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<float>, {CLASH}").repartition(20)
    n, deviation, want, share = plain_whitening([*good, good[3]])
    found = whitening.whiten(table).collect()
    assert len(found) == 16 * 401
    by = defaultdict(dict)
    for r in found:
        by[r.vec_id][r.component] = r
    ids = [*range(len(good)), None]
    got = np.array([[by[i][c].whitened for c in range(1, 17)] for i in ids])
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, rtol=1e-9, atol=1e-9)
    assert [by[i][1].deviation for i in ids] == deviation and {r.n for r in found} == {n} == {300}
    assert np.allclose([by[0][c].explained for c in range(1, 17)], share, rtol=1e-10)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-10


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None]])
def test_no_variance_no_components(spark, vectors):
    table = spark.createDataFrame([(k, v) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = whitening.whiten(table)
    assert found.isEmpty()
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_are_left_out(spark):
    rows = [(k, [float(k % 7), 1.0, float(k % 5), float(k % 7) * 2]) for k in range(70)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r.component for r in found.collect()} == {1, 2}


def test_folding_triangles_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (400, 6)) + 1_000_000
    table = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(13)
    s = x.sum(axis=0).astype(object)
    r = whitening.triangle(table, 400, s)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)


def test_deviations_beyond_whole_machine_numbers():
    x = np.array([[2**40, 0], [-(2**30), 5]])
    n, s = 10**6, np.array([7, 8], dtype=object)
    want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert whitening._deviations(x, n, s) == [v if v < 2**63 else None for v in want]
    assert whitening._deviations(x[1:] // 2**20, n, s)[0] == sum((n * int(a) - b) ** 2 for a, b in zip(x[1] // 2**20, s, strict=True))


bidiagonal = st.integers(1, 12).flatmap(
    lambda n: st.tuples(*[st.lists(st.sampled_from([0.0, 1e-9, 0.1, 1.0, 1.0 + 1e-9, 2.0, 3.0, -1.0, 50.0]), min_size=k, max_size=k) for k in (n, n - 1)])
)


@settings(max_examples=300, deadline=None)
@given(bidiagonal)
def test_solver_on_hard_bidiagonal_matrices(entries):
    """Zeros, equal and close values: values, directions and their orthogonality."""
    d, e = map(np.array, entries)
    b = np.diag(d) + np.diag(e, 1)
    values, directions, total = whitening.principal(b, 16)
    s = np.linalg.svd(b, compute_uv=False) ** 2
    assert np.allclose(whitening.dqds(d, e), s, rtol=1e-12, atol=1e-14 * max(s[0], 1e-300))
    assert total == pytest.approx(s.sum())
    if len(values):
        assert np.abs(b.T @ (b @ directions) - directions * values).max() < 1e-12 * s[0]
        assert np.abs(directions.T @ directions - np.eye(len(values))).max() < 1e-11
