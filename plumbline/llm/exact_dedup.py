"""Exact deduplication: group by a 128-bit content hash, compare bytes inside the groups.

DataFrame operations only. Texts are equal when identical after deleting white
space ``[\\x20\\x09-\\x0D]``. The smallest and largest normalised text of a hash
group are aggregated along with the group; they are the same bytes exactly when
all of the group's texts are. Groups where they differ (hash collisions) are
grouped again by the text itself.

Aggregates combine before the shuffle, so a text that a third of the rows share
costs a row for each input task. The join back to the rows carries no texts and
starts from two plain exchanges, which adaptive execution splits at hot keys.

Cases: null text counts as empty, and all empty texts are one group. A null id
sorts before any id, so it wins a tie in length. Rows that repeat both id and
text each get a row in ``classes`` with the same answer; ``deduplicated``
returns one of them. An empty table gives an empty result. Extra columns of
whatever names are carried only by ``deduplicated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.storage import written

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """``text`` without white space; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Of equal texts the row with the most code points in its original text stays,
    then that with the smallest id. ``hash_of`` is replaced in tests to force collisions.
    """
    norm = normalised(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), norm.alias("norm"), hash_of(norm).alias("h")
    )
    best = F.min(F.struct((-F.col("n")).alias("n"), "id"))
    groups = written(
        base.groupBy("h")
        .agg(F.count("*").alias("size"), best.alias("best"), F.min("norm").alias("lo"), F.max("norm").alias("hi"))
        .select("h", "size", F.col("best.id").alias("keep"), F.col("best.n").alias("keep_n"), (F.col("lo") == F.col("hi")).alias("same")),
        "exact-groups",
    )
    same = groups.filter("same").drop("same")
    rows = base.select("id", "n", "h", F.sha2("norm", 256).alias("sha"))
    found = rows.join(same, "h")
    collided = groups.filter("not same").select("h")
    if not collided.isEmpty():
        inside = base.join(collided, "h", "left_semi")
        by_text = inside.groupBy("norm").agg(F.count("*").alias("size"), best.alias("best"))
        by_text = written(by_text.select("norm", "size", F.col("best.id").alias("keep"), F.col("best.n").alias("keep_n")), "exact-collided")
        found = found.unionByName(inside.join(by_text, "norm").select("h", "id", "n", F.sha2("norm", 256).alias("sha"), "size", "keep", "keep_n"))
    stays = F.col("id").eqNullSafe(F.col("keep")) & (-F.col("n") == F.col("keep_n"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct normalised text, all columns."""
    stay = written(classes(docs, id_col, text_col).filter("kept").select("doc_id", "text_sha256").distinct(), "exact-kept")
    sha = F.sha2(normalised(docs[text_col]), 256)
    out = docs.join(stay, docs[id_col].eqNullSafe(stay["doc_id"]) & (sha == stay["text_sha256"]), "left_semi")
    repeated = stay.groupBy("doc_id").count().filter("count > 1").isEmpty()
    many = docs.groupBy(id_col).count().filter("count > 1").isEmpty()
    return out if repeated and many else out.dropDuplicates([id_col, text_col])
