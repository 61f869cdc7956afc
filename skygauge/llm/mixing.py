"""Mixing sources to target weights with exact word budgets.

Each document has a hash-random key; a source's documents stand in the order of their keys,
in ranges of keys. Word sums of ranges and their prefix sums find the range in which a source's
budget ends, range by range more finely, and only the last small range is sorted document by
document. Every aggregate has a partial step, no window holds more than 256 ranges of a source or
one small range, and a source with most of all rows costs no more than others. The decision is
one row per source, so texts are never shuffled by it.

A budget over a source's size takes whole epochs first. The document at the cut is taken in part,
so a source's words are its budget exactly (rows that share a key share that part by size, which
may round off one word each).

Defined results: null and empty texts have size 0 and are taken with 0 words; a null source is a
source of its own, last in order; a null doc_id has a key as any other; repeated rows have the same
key and count each; an empty table gives no rows; other columns are kept by ``mix_documents`` and
must not be called ``_key``, ``_size``, ``_full`` or ``_part``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.text import SPACE_CLASS, global_rank, word_count
from skygauge.session import stage

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"
# Hexadecimal digits by which ranges are refined, and the rows of a range that is sorted.
DIGITS = 2
RANGE_ROWS = 1000
KEY_DIGITS = 32


def order_key(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, size, rows, target, budget) from (source, size); sizes are summed here."""
    per_source = stage(
        sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "sources"
    )
    ranked = global_rank(per_source, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = stage(ranked.withColumn("weight", weight).drop("rank"), "weights")
    share = 0.0
    full = F.lit(False)
    before = -1
    top, bottom = 0, 1
    while True:
        found = weighted.agg(
            F.sum("size").alias("all"),
            F.sum(F.when(full, most * F.col("size")).otherwise(0)).alias("kept"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if found["full"] == before or not found["weight"]:
            break
        before = found["full"]
        top, bottom = found["all"] - found["kept"], found["weight"]
        share = top / bottom
        full = most * F.col("size") < F.col("weight") * F.lit(share)
    target = F.when(full, (most * F.col("size")).cast("double")).otherwise(
        F.col("weight") * F.lit(float(top)) / F.lit(float(bottom))
    )
    return weighted.select("source", "size", "rows", target.alias("target")).withColumn(
        "budget", F.floor("target").cast("long")
    )


def source_cuts(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets with whole epochs and the key at which the rest of the budget ends.

    ``sizes`` is a staged (source, key, size). Columns: source, size, rows, target, budget,
    epochs, and at the cut: cut_key, cut_left (words still to take there), cut_size (words there);
    all three null if no rest is left.
    """
    targets = stage(
        source_targets(sizes, weights, most)
        .withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size")),
        "targets",
    )
    same_source = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    open_ = targets.filter("rest > 0").select("source", F.lit("").alias("prefix"), "rest", "rows")
    digits = 0
    while digits < KEY_DIGITS:
        most_rows = open_.agg(F.max("rows")).first()[0]
        if most_rows is None or most_rows <= RANGE_ROWS:
            break
        digits += DIGITS
        cells = (
            _inside(sizes, open_, digits - DIGITS)
            .groupBy("source", "prefix", "rest", F.substring("key", 1, digits).alias("cell"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        )
        ends = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
        open_ = stage(
            cells.withColumn("end", ends)
            .filter((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest")))
            .select(
                "source", F.col("cell").alias("prefix"), (F.col("rest") - F.col("end") + F.col("words")).alias("rest"),
                F.col("n").alias("rows"),
            ),
            "ranges",
        )
    keys = (
        _inside(sizes, open_, digits)
        .groupBy("source", "rest", "key")
        .agg(F.sum("size").alias("words"))
    )
    ends = F.sum("words").over(Window.partitionBy("source").orderBy("key"))
    cuts = (
        keys.withColumn("end", ends)
        .filter((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("words") < F.col("rest")))
        .select(
            "source", F.col("key").alias("cut_key"), F.col("words").alias("cut_size"),
            (F.col("rest") - F.col("end") + F.col("words")).alias("cut_left"),
        )
    )
    joined = targets.alias("t").join(cuts.alias("c"), same_source("t", "c"), "left")
    return stage(joined.select("t.*", "cut_key", "cut_left", "cut_size").drop("rest"), "cuts")


def _inside(sizes: DataFrame, ranges: DataFrame, digits: int) -> DataFrame:
    """The rows of ``sizes`` whose key is in their source's open range."""
    same = F.col("s.source").eqNullSafe(F.col("r.source")) & (
        F.substring("s.key", 1, digits) == F.col("r.prefix")
        if digits
        else F.lit(True)
    )
    return (
        sizes.alias("s").join(ranges.alias("r"), same)
        .filter(F.col("s.size") > 0)
        .select("s.source", "s.key", "s.size", "r.prefix", "r.rest")
    )


def _full_and_part(key: Column, size: Column) -> tuple[Column, Column]:
    """Whole copies, and words of a further part, of a row joined with its source's cut."""
    full = F.col("epochs") + F.coalesce((key < F.col("cut_key")).cast("long"), F.lit(0))
    part = F.when(
        key == F.col("cut_key"), F.floor(F.col("cut_left") * (size / F.col("cut_size")) + 1e-9).cast("long")
    )
    return full, F.coalesce(part, F.lit(0))


def _sizes(docs: DataFrame) -> DataFrame:
    return stage(
        docs.select(
            "doc_id", "source", order_key(F.col("doc_id")).alias("key"), word_count(F.col("text")).alias("size")
        ),
        "sizes",
    )


def mix_words(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    sizes = _sizes(docs)
    cuts = source_cuts(sizes, weights, most).withColumnRenamed("size", "source_size")
    joined = sizes.alias("d").join(cuts.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    full, part = _full_and_part(F.col("key"), F.col("d.size"))
    return joined.select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", (full * F.col("d.size") + part).alias("taken")
    )


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix as documents: a row per whole copy, and the cut document's first words.

    Columns as given; ``n_chars``, if there, is that of the text in the row. Documents without
    words stay once.
    """
    columns = docs.columns
    cuts = source_cuts(_sizes(docs), weights, most).select(
        F.col("source").alias("_source"), "epochs", "cut_key", "cut_left", "cut_size"
    )
    keyed = docs.withColumns(
        {"_key": order_key(F.col("doc_id")), "_size": word_count(F.col("text"))}
    ).join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    full, part = _full_and_part(F.col("_key"), F.col("_size"))
    first_words = F.array_join(
        F.slice(F.regexp_extract_all("text", F.lit(rf"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"), F.lit(0)), F.lit(1), F.col("_part").cast("int")), ""
    )
    none = F.col("_size") == 0
    wanted = keyed.withColumns({"_full": F.when(none, 1).otherwise(full), "_part": F.when(none, 0).otherwise(part)})
    copies = F.concat(
        F.array_repeat(F.lit(False), F.col("_full").cast("int")),
        F.array_repeat(F.lit(True), (F.col("_part") > 0).cast("int")),
    )
    rows = wanted.withColumn("_cut", F.explode(copies)).withColumn(
        "text", F.when(F.col("_cut"), first_words).otherwise(F.col("text"))
    )
    if "n_chars" in columns:
        rows = rows.withColumn(
            "n_chars", F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
        )
    return rows.select(*columns)
