"""Exact dedup by naming: equal pieces get equal integers, then pairs of integers do.

A text is cut into blocks of a fixed number of characters. Sorting the blocks gives each
distinct block an integer name; then the names of adjacent blocks are paired and the pairs are
named in the same way, until each document has one name. Two documents share the last name only
if all their blocks are the same: block contents are compared, never only hashes (a hash
only decides which task compares them).

Texts pass through one shuffle. Frequent blocks are split over several tasks that name their
copies apart; the few names of such a block are then made one.

Defined results: null texts are empty texts; all empty texts are equal; a null doc_id comes
after all others when the row to stay is chosen; a repeated row is a copy like any other and
exactly one row of a group stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygauge.llm.text import single_spaced
from skygauge.session import stage

BLOCK_CHARS = 4096
# A key with more rows than this may be split; the MANY most frequent of them are.
FREQUENT_ROWS = 1000
MANY = 4096


def _named(rows: DataFrame, key: list[str], label: str) -> DataFrame:
    """``rows`` (with rid, pos) with an equal ``name`` where ``key`` is equal; key dropped.

    The result is staged: names are row numbers and must not be computed twice.
    """
    h = F.xxhash64(*key)
    counts = rows.groupBy(h.alias("h")).agg(F.count("*").alias("rows"))
    frequent = (
        counts.filter(F.col("rows") > FREQUENT_ROWS)
        .orderBy(F.desc("rows"), "h")
        .limit(MANY)
        .select("h", F.ceil(F.col("rows") / FREQUENT_ROWS).alias("splits"))
    )
    dealt = (
        rows.withColumn("h", h)
        .join(F.broadcast(frequent), "h", "left")
        .withColumn(
            "split",
            F.when(F.col("splits").isNull(), F.lit(0)).otherwise(
                F.pmod(F.xxhash64("rid", "pos"), F.col("splits"))
            ),
        )
        .repartition("h", "split")
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("name", F.min("row").over(Window.partitionBy("h", "split", *key)))
    )
    first_of_split = F.col("splits").isNotNull() & (F.col("row") == F.col("name"))
    staged = stage(
        dealt.withColumn("shared", F.when(first_of_split, F.struct(*key))).drop(
            "h", "split", "splits", "row", *key
        ),
        label,
    )
    firsts = staged.filter(F.col("shared").isNotNull()).select("shared", "name")
    if firsts.isEmpty():
        return staged.drop("shared")
    one = firsts.groupBy("shared").agg(F.min("name").alias("one"))
    same = firsts.join(one, "shared").select("name", "one")
    return stage(
        staged.drop("shared")
        .join(same, "name", "left")
        .withColumn("name", F.coalesce("one", "name"))
        .drop("one"),
        label,
    )


def name_documents(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """(rid, doc_id, text_sha256, level, name): one identity for each row of ``docs``.

    ``row_id`` names a column with distinct longs; without it, rows are numbered here.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    blocks = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    texts = docs.select(rid.alias("rid"), "doc_id", single_spaced(F.col("text")).alias("norm"))
    cut = texts.select(
        "rid", "doc_id", F.sha2("norm", 256).alias("sha"),
        F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(blocks).alias("blocks"),
    )
    at_start = F.col("pos") == 0
    rows = cut.select(
        "rid", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")
    ).select(
        "rid", "pos", "n", "block",
        F.when(at_start, F.col("doc_id")).alias("doc_id"), F.when(at_start, F.col("sha")).alias("sha"),
    )
    level = 0
    current = _named(rows, ["block"], "names")
    done = []
    while True:
        done.append(
            current.filter("n = 1").select(
                "rid", "doc_id", F.col("sha").alias("text_sha256"), F.lit(level).alias("level"), "name"
            )
        )
        longer = current.filter("n > 1")
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, done)
        even = F.col("pos") % 2 == 0
        pairs = longer.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
            F.ceil(F.max("n") / 2).cast("int").alias("n"),
            F.max("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
        )
        level += 1
        current = _named(stage(pairs, "pairs"), ["left", "right"], "names")


def exact_groups(docs: DataFrame, row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id among equal texts; that row is the kept one.
    """
    named = name_documents(docs, row_id)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    groups = stage(
        named.groupBy("level", "name").agg(first, F.count("*").alias("group_size")), "groups"
    )
    return named.join(groups, ["level", "name"]).select(
        "rid", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256",
    )
