"""Exact duplicates: group by a 128-bit content hash, then compare bytes inside the groups.

Defined results
* A null text counts as empty; empty texts are equal to each other.
* Of equal texts the row with the largest doc_id stays; a null id is smaller than any other.
* Rows that repeat both id and text are one group; exactly one of them stays.
* An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, StructType, VariantType

from tidepanel.llm.common import narrowed, same_key, small_side, without
from tidepanel.session import pinned


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row.

    Texts are only moved for hashes that occur more than once, and copies are
    merged by each task before they are; a group of any size is a few rows then.
    """
    texts = narrowed(docs, id_col, text_col).withColumn("h", hashed(F.col("text")))
    # Narrow rows; repeated rows become a count.
    rows = texts.select("doc_id", "h", F.sha2("text", 256).alias("sha")).groupBy("doc_id", "h", "sha").agg(F.count("*").alias("m"))
    rows = pinned(rows)
    groups = rows.groupBy("h").agg(F.sum("m").alias("n"), F.max("doc_id").alias("keep_id"))
    groups = pinned(groups)

    repeated = small_side(pinned(groups.filter("n > 1").select(F.col("h").alias("__h"))))
    shared = texts.join(repeated, F.col("h") == F.col("__h"), "left_semi")
    variants = shared.groupBy("h", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    colliding = pinned(variants.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("h").alias("__h")))

    plain, apart = groups, None
    if not colliding.isEmpty():
        few = small_side(colliding)
        plain = groups.join(few, F.col("h") == F.col("__h"), "left_anti")
        # Texts that only share the hash are told apart by their bytes.
        clash = texts.join(few, F.col("h") == F.col("__h"), "left_semi")
        apart = clash.groupBy("doc_id", "text").agg(F.count("*").alias("m")).join(
            clash.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n")).withColumnRenamed("text", "__text"),
            F.col("text") == F.col("__text"),
        ).select("doc_id", F.sha2("text", 256).alias("sha"), "m", "n", "keep_id")
    labelled = rows.join(plain.withColumnRenamed("h", "__h"), F.col("h") == F.col("__h")).select("doc_id", "sha", "m", "n", "keep_id")
    if apart is not None:
        labelled = labelled.unionByName(apart)
    return labelled.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("copy")).select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def sortable(schema: StructType) -> list[Column]:
    """The columns as values that can be ordered; maps and what holds them as JSON."""

    def ordered(kind: DataType) -> bool:
        if isinstance(kind, StructType):
            return all(ordered(f.dataType) for f in kind.fields)
        return ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType | CalendarIntervalType)

    columns = [(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields]
    return [c if ordered(kind) else F.to_json(F.struct(c.alias("v"))) for c, kind in columns]


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row per text, all columns kept.

    Of rows that repeat id and text but differ elsewhere, the smallest one (comparing all columns in order, maps by their JSON) stays.
    """
    classes = pinned(exact_classes(docs, id_col, text_col))
    gone = classes.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = [F.col(id_col).cast("bigint"), F.sha2(text, 256)]
    left = without(docs, keys, gone)

    again = pinned(classes.filter("not kept").join(gone, same_key(
        [classes["doc_id"], classes["text_sha256"]], [gone["doc_id"], gone["text_sha256"]]), "left_anti").select("doc_id", "text_sha256").distinct())
    if again.isEmpty():
        return left
    once = small_side(again.toDF("__d0", "__d1"))
    row = F.struct(*[left[f"`{c}`"] for c in left.columns])
    marked = left.select(row.alias("__row"), F.struct(*sortable(left.schema)).alias("__order"), keys[0].alias("__k0"), keys[1].alias("__k1"))
    match = same_key([F.col("__k0"), F.col("__k1")], [F.col("__d0"), F.col("__d1")])
    firsts = marked.join(once, match, "left_semi").groupBy("__k0", "__k1").agg(F.min_by("__row", "__order").alias("__row")).select("__row.*")
    return without(left, keys, again).unionByName(firsts)
