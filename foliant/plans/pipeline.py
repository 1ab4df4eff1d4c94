"""The book pipeline in two phases, with a table of cleanup rules between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliant.functions import markup as M, text as X
from foliant.operators import chapters as C


def phase_one(entries: DataFrame) -> DataFrame:
    """Chapters from table-of-contents entries (file, pos, title, path, anchor, html): sliced at anchors, stripped, merged.

    Numbers come from the place among all entries, so an entry without a target leaves a gap.
    """
    from pyspark.sql import Window

    run = Window.partitionBy("file", "path").orderBy("pos")
    cut = M.slice_by_anchor(F.col("html"), F.col("anchor"), F.lead("anchor").over(run))
    rows = entries.where("html IS NOT NULL").withColumn("part", cut)
    chapters = rows.select(F.col("file").alias("book_id"), F.col("pos").cast("long").alias("chapter_id"), (F.col("pos") + 1).alias("chapter_number"), F.col("title").alias("chapter_title"), F.col("href"), M.strip_html(drop_script=True)(F.col("part")).alias("content_text"))
    return C.merge_short(chapters)


def rule_previews(chapters: DataFrame, rules: list[str]) -> DataFrame:
    """(book_id, rule, preview) of every rule that finds something; what a reader is asked to approve."""
    hits = F.array(*(F.struct(F.lit(r).alias("rule"), F.left(F.regexp_extract(F.col("content_text"), "(?isu)" + r, 0), F.lit(300)).alias("preview")) for r in rules))
    found = chapters.select("book_id", "new_number", F.explode(F.filter(hits, lambda h: F.trim(h["preview"]) != "")).alias("h"))
    return found.groupBy("book_id", F.col("h.rule").alias("rule")).agg(F.min(F.struct("new_number", "h.preview"))["preview"].alias("preview"))


def phase_two(chapters: DataFrame, rules: list[str]) -> DataFrame:
    """Approved rules applied, the title put before the body."""
    text = F.col("content_text")
    for r in rules:
        text = F.regexp_replace(text, "(?isu)" + r, "")
    clean = chapters.withColumn("content_text", X.normalize_ws(text))
    return clean.withColumn("content_text", X.prepend_title(F.col("chapter_title"), F.col("content_text")))
