"""The pN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm import broken_pairs, canonical_text, chunking, formatting_copies, leakage, linked_split, packing, split_overlap
from dialoom.llm.oracle import ORACLE
from dialoom.operators import dialogue
from dialoom.session import spread
from dialoom.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return broken_pairs.flag_defects(dialogue.qa_turns(table(s, d, "conversations")))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    """Every defective pair with its defect."""
    return _flagged(s, d).where(F.col("defect").isNotNull()).select("conv_id", "turn", "defect")


def p1_defect_counts(s: SparkSession, d: str) -> DataFrame:
    """Pairs per defect; sound pairs under "sound"."""
    return _flagged(s, d).groupBy(F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count("*").alias("n"))


def _look_texts(s: SparkSession, d: str) -> DataFrame:
    """(tab, key, text) of both tables that problem 2 names."""
    conv = table(s, d, "conversations").select(F.lit("conversations").alias("tab"), F.col("msg_id").alias("key"), F.col("content").alias("text"))
    items = table(s, d, "dataset").select(F.lit("dataset").alias("tab"), F.col("id").alias("key"), F.col("description").alias("text"))
    return spread(conv).unionByName(spread(items))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs of rows whose texts look the same and are stored differently."""
    return canonical_text.same_look(_look_texts(s, d), "text", "key", ["tab"])


def p2_canonical(s: SparkSession, d: str) -> DataFrame:
    """Every row with its text in the consistent form."""
    return canonical_text.canonical(_look_texts(s, d), "text").select("tab", "key", "canonical")


def p2_classes(s: SparkSession, d: str) -> DataFrame:
    """Every row with its class: the least key of its table whose text looks the same."""
    rows = canonical_text.canonical(_look_texts(s, d), "text").where("canonical is not null").select("tab", "key", *canonical_text.digests("canonical", "_c"))
    least = rows.groupBy("tab", "_c0", "_c1").agg(F.min("key").alias("class"))
    return rows.join(least, ["tab", "_c0", "_c1"]).select("tab", "key", "class")


def _repeated_texts(s: SparkSession, d: str) -> DataFrame:
    """(tab, key, text) of both tables that problem 5 names."""
    conv = table(s, d, "conversations").select(F.lit("conversations").alias("tab"), F.col("msg_id").alias("key"), F.col("content").alias("text"))
    pred = table(s, d, "predictions").select(F.lit("predictions").alias("tab"), F.col("pred_id").alias("key"), F.col("ground_truth").alias("text"))
    return spread(conv).unionByName(pred)


def p5_found(s: SparkSession, d: str) -> DataFrame:
    """Each further copy of a text, with the row that is kept."""
    return formatting_copies.copies(_repeated_texts(s, d), "text", "key", "tab")


def p5_collapsed(s: SparkSession, d: str) -> DataFrame:
    """One row per text, with the number of its copies."""
    return formatting_copies.collapsed(_repeated_texts(s, d), "text", "key", "tab")


def _records(s: SparkSession, d: str, name: str) -> DataFrame:
    value = lambda i: F.get("conversations", F.lit(i)).getField("value")
    return spread(table(s, d, name).select("row_id", "image", "conversations")).select(F.col("row_id").alias("key"), linked_split.picture_number("image").alias("picture"), value(0).alias("question"), value(1).alias("answer"))


def _overlap(s: SparkSession, d: str) -> split_overlap.Overlap:
    return split_overlap.Overlap(_records(s, d, "train"), _records(s, d, "val"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    """All pairs of a training record and an evaluation record that overlap."""
    return _overlap(s, d).pairs().select(F.col("train_key").alias("train_row_id"), F.col("held_out_key").alias("val_row_id"))


def p3_report(s: SparkSession, d: str) -> DataFrame:
    """Overlapping pairs and records per split and source of the evaluation record."""
    return _overlap(s, d).report(table(s, d, "val"), "row_id", ["split", "source"])


def p3_class_pairs(s: SparkSession, d: str) -> DataFrame:
    """Overlapping classes of records; p3_members tells whose they are."""
    return _overlap(s, d).class_pairs()


def p3_members(s: SparkSession, d: str) -> DataFrame:
    """The class of every record of both sides."""
    return _overlap(s, d).members()


def _linked(s: SparkSession, d: str) -> DataFrame:
    """Training records with their item number and picture number."""
    return table(s, d, "train").select("row_id", linked_split.item_number("id").alias("item"), linked_split.picture_number("image").alias("picture"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs of items whose records must share a split."""
    members = linked_split.groups(_linked(s, d), "item", "picture")
    return linked_split.linked_pairs(members, "item").select(F.col("a").alias("item_a"), F.col("b").alias("item_b"))


def p4_groups(s: SparkSession, d: str) -> DataFrame:
    """Every item with its group: the least item number that it hangs together with."""
    return linked_split.groups(_linked(s, d), "item", "picture").withColumnRenamed("component", "group_id")


def p4_split(s: SparkSession, d: str) -> DataFrame:
    """Every training record with its split: 80, 10 and 10 percent of the records."""
    kind = F.regexp_extract("source", "^([a-z]+)-", 1)
    rows = table(s, d, "train").select("row_id", linked_split.item_key("id").alias("item"), linked_split.picture_number("image").alias("picture"), kind.alias("kind"))
    return linked_split.assign(rows, "row_id", "item", "picture", "kind")


def p4_split_sizes(s: SparkSession, d: str) -> DataFrame:
    """Per split: its records, how far they are from its quota, and its groups that another split has, too."""
    records = table(s, d, "train").select("row_id", linked_split.item_number("id").alias("item"))
    groups = p4_groups(s, d)
    rows = records.join(p4_split(s, d), "row_id").join(groups, "item", "left")
    n = rows.groupBy("split").agg(F.count("*").alias("n"))
    torn = rows.where("group_id is not null").groupBy("group_id").agg(F.collect_set("split").alias("splits")).where(F.size("splits") > 1).select(F.explode("splits").alias("split")).groupBy("split").agg(F.count("*").alias("n_torn"))
    quota = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    off = F.abs(F.col("n") - quota * F.col("total")) <= 1
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a handful of rows
    return n.withColumn("total", total).join(torn, "split", "left").select("split", "total", off.alias("meets_quota"), F.coalesce("n_torn", F.lit(0).cast("bigint")).alias("n_torn"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "documents").select("doc_id", "text"))


#: Tokens a container holds.
CAPACITY = 2048


def p6_containers(s: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of an oversized one, with its container."""
    return packing.pack(_documents(s, d), capacity=CAPACITY)


def p6_fill(s: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and how full."""
    return packing.fill(p6_containers(s, d), CAPACITY)


def _coverage(pieces: DataFrame, limit: int) -> DataFrame:
    """Per text: the characters its pieces cover, the gaps between them, and the pieces above the limit."""
    by_key = Window.partitionBy("doc_id").orderBy("piece")
    gap = F.col("start") > F.coalesce(F.lag("end").over(by_key), F.lit(0))
    each = pieces.select("doc_id", "piece", "start", "end", "tokens", gap.alias("gap"))
    return each.groupBy("doc_id").agg(F.max("end").cast("bigint").alias("n_chars"), F.count_if("gap").alias("n_gaps"), F.count_if(F.col("tokens") > limit).alias("n_over"))


def p6_coverage(s: SparkSession, d: str) -> DataFrame:
    """Every text is in containers as a whole, without gaps, in pieces that fit."""
    return _coverage(p6_containers(s, d), CAPACITY)


def p6_overfull(s: SparkSession, d: str) -> DataFrame:
    """How many containers hold more than their capacity, and how many texts that fit are split."""
    packed = p6_containers(s, d)
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > CAPACITY).alias("n_overfull"))
    torn = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).agg(F.count_if((F.col("n") > 1) & (F.col("tokens") < CAPACITY // 2)).alias("n_split_needlessly"))
    return over.join(F.broadcast(torn))  # one row each


def p8_coverage(s: SparkSession, d: str) -> DataFrame:
    """Every text is covered by its pieces, without gaps, each within the limit."""
    return _coverage(p8_pieces(s, d), 512)


def p8_pieces(s: SparkSession, d: str) -> DataFrame:
    """Numbered pieces of every text: at most 512 tokens, 64 of them shared with the piece before."""
    return chunking.pieces(_documents(s, d))


def p8_boundaries(s: SparkSession, d: str) -> DataFrame:
    """Pieces, and their average size, by the boundary they end at."""
    return p8_pieces(s, d).groupBy("boundary").agg(F.count("*").alias("n"), F.avg("tokens").alias("avg_tokens"), F.max("tokens").alias("max_tokens"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    """Every document that contains part of a test item's passage, with the item."""
    return leakage.leaks(_documents(s, d), table(s, d, "benchmark"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_defect_counts": p1_defect_counts,
    "p2_found": p2_found,
    "p2_canonical": p2_canonical,
    "p2_classes": p2_classes,
    "p5_found": p5_found,
    "p5_collapsed": p5_collapsed,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_class_pairs": p3_class_pairs,
    "p3_members": p3_members,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p4_split": p4_split,
    "p4_split_sizes": p4_split_sizes,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p6_coverage": p6_coverage,
    "p6_overfull": p6_overfull,
    "p7_found": p7_found,
    "p8_pieces": p8_pieces,
    "p8_boundaries": p8_boundaries,
    "p8_coverage": p8_coverage,
}

__all__ = ["ORACLE", "QUERIES"]
