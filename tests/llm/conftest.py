import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, rid string, _n int"


@pytest.fixture(scope="session")
def base_text():
    return " ".join(f"word{k * k % 97}x{k}" for k in range(120))


@pytest.fixture(scope="session")
def hard_rows(base_text):
    """(doc_id, text, source): nulls, empty, long, ties, copies, near copies, odd characters."""
    words = base_text.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    nearer = " ".join(words[:58] + ["altered"] + words[59:])
    rows = [
        (0, base_text, "a"),
        (1, None, "a"),
        (2, "", None),
        (3, " \t\n ", "b"),
        (4, "one", "b"),
        (5, "Two  words", "b"),
        (6, near, "a"),
        (7, nearer, "c"),
        (8, base_text.replace(" ", "  \t"), None),
        (9, base_text.upper(), "c"),
        (10, "same line again here now\n" * 30, "a"),
        (11, "x" * 9000 + " " + "y " * 3000, "b"),
        (12, "é ü 字 字 \U0001f600 \x1c z", "é"),
        (13, "a b c d e", "c"),
        (14, "A B C D E", "c"),
        (15, "one", "a"),
        (16, "x <|endoftext|> y<|endoftext|>\n<|endoftext|> z", "b"),
    ]
    # A group of exact and one of near copies.
    rows += [(100 + k, "copied text of the group with more than five words in it", "a") for k in range(40)]
    many = [f"w{k}" for k in range(200)]
    for k in range(30):
        rows.append((200 + k, " ".join(many[: 5 * k] + [f"new{k}"] + many[5 * k + 1 :]), "hot"))
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The same with columns whose names the operators use inside."""
    data = [(d, t, "en", s, len(t or ""), 1, "k", "r", 2) for d, t, s in hard_rows]
    return spark.createDataFrame(data, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
