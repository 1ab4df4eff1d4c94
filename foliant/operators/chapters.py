"""Operators over ordered chapter records."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foliant.functions import text as X
from foliant.operators.prefix import numbered, running_sum

#: Ids of one order bucket; reparsed copies of a chapter stand beside each other.
ID_BUCKET = 4096


def place() -> Column:
    """Order bucket of chapters: by number, then by blocks of ids."""
    return F.struct(F.col("chapter_number"), F.floor(F.col("chapter_id") / ID_BUCKET).alias("block"))


ORDER = ["chapter_number", "chapter_id"]


def summarise(df: DataFrame) -> DataFrame:
    """Per book: chapters, words, mean (half up), longest and shortest chapter (the first of equals), first and last title."""
    n = X.word_count(F.col("content_text"))
    rows = df.where("book_id IS NOT NULL").select("book_id", "chapter_id", "chapter_number", "chapter_title", n.alias("n"))
    first = F.struct("chapter_number", "chapter_id", "chapter_title")
    return rows.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"),
        F.sum("n").alias("total_words"),
        F.floor(F.sum("n") / F.count("*") + 0.5).cast("long").alias("mean_words"),
        (-F.max(F.struct("n", -F.col("chapter_number"), (-F.col("chapter_id")).alias("id")))["id"]).alias("longest_id"),
        F.min(F.struct("n", "chapter_number", "chapter_id"))["chapter_id"].alias("shortest_id"),
        F.min(first)["chapter_title"].alias("first_title"),
        F.max(first)["chapter_title"].alias("last_title"),
    )


def renumber(df: DataFrame) -> DataFrame:
    """Chapters with a number, renumbered 1..n in each book."""
    kept = df.where("chapter_number IS NOT NULL AND book_id IS NOT NULL")
    return numbered(kept, ["book_id"], place(), ORDER, "new_number")


def merge_short(df: DataFrame, least: int = 100) -> DataFrame:
    """Short chapters are carried into the next long one, the last ones into the last long one.

    (book_id, new_number, chapter_id, chapter_title, href, content_text) of the long chapters; a book without any has no
    row. A chapter without an href takes the first one carried into it.
    """
    body = X.strip(F.coalesce(F.col("content_text"), F.lit("")))
    rows = df.where("chapter_number IS NOT NULL AND book_id IS NOT NULL").select("book_id", "chapter_id", "chapter_number", "chapter_title", "href", body.alias("body"), (F.length(body) >= least).cast("int").alias("long"))
    slim = running_sum(rows.drop("body", "chapter_title", "href"), ["book_id"], place(), ORDER, F.col("long"), "behind", inclusive=False)
    totals = rows.groupBy("book_id").agg(F.sum("long").alias("n_long")).where("n_long > 0")
    groups = slim.join(totals, "book_id").select("chapter_id", "behind", F.least(F.col("behind"), F.col("n_long") - 1).alias("grp"))
    placed = rows.join(groups, "chapter_id")
    part = F.struct("chapter_number", "chapter_id", "body")
    merged = placed.groupBy("book_id", "grp").agg(
        F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["body"]), lambda b: b != ""), " ").alias("content_text"),
        F.max(F.when(F.col("long") == 1, F.struct("chapter_number", "chapter_id", "chapter_title", "href"))).alias("own"),
        F.min(F.when((F.col("long") == 0) & (F.col("href") != "") & (F.col("behind") == F.col("grp")), F.struct("chapter_number", "chapter_id", "href")))["href"].alias("carried"),
    )
    href = F.coalesce(F.nullif("own.href", F.lit("")), "carried")
    return merged.select("book_id", (F.col("grp") + 1).alias("new_number"), F.col("own.chapter_id").alias("chapter_id"), F.col("own.chapter_title").alias("chapter_title"), href.alias("href"), "content_text")


def upper_median(df: DataFrame) -> DataFrame:
    """Per book the chapter at index n // 2 in order of length, equal lengths in chapter order."""
    rows = df.where("book_id IS NOT NULL").select("book_id", "chapter_id", "chapter_number", F.length(F.coalesce("content_text", F.lit(""))).cast("long").alias("n_chars"))
    by_length = rows.groupBy("book_id", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("book_id").orderBy("n_chars")
    spans = by_length.withColumn("upto", F.sum("c").over(w)).withColumn("total", F.sum("c").over(Window.partitionBy("book_id")))
    hit = spans.where("upto - c <= floor(total / 2) AND floor(total / 2) < upto").select("book_id", "n_chars", (F.floor(F.col("total") / 2) - (F.col("upto") - F.col("c"))).alias("skip"))
    same = rows.join(hit, ["book_id", "n_chars"])
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_number", "chapter_id")) - 1
    return same.withColumn("r", rank).where("r = skip").select("book_id", "chapter_id", "n_chars")


def select_or_all(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is chosen; all rows where none is."""
    hit = df.join(chosen.select(key).distinct(), key, "left_semi")
    none = hit.agg((F.count("*") == 0).alias("none"))
    return hit.unionByName(df.join(F.broadcast(none.where("none").select(F.lit(1).alias("_one"))), F.lit(1) == F.col("_one"), "left_semi"))


def next_anchor(df: DataFrame) -> DataFrame:
    """Each entry's next anchor in the same run of entries of one document: (book_id, chapter_id, path, anchor, next_anchor)."""
    href = X.split_href(F.col("href"))
    rows = df.where("book_id IS NOT NULL").select("book_id", "chapter_number", "chapter_id", href["path"].alias("path"), href["anchor"].alias("anchor"))
    placed = numbered(rows, ["book_id"], place(), ORDER, "pos")
    before = placed.select("book_id", (F.col("pos") + 1).alias("pos"), F.col("path").alias("path_before"))
    changed = placed.join(before, ["book_id", "pos"], "left").withColumn("new_run", F.when(F.col("path_before").eqNullSafe(F.col("path")), 0).otherwise(1))
    runs = running_sum(changed, ["book_id"], F.floor(F.col("pos") / ID_BUCKET), ["pos"], F.col("new_run"), "run")
    later = Window.partitionBy("book_id", "run").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    return runs.select("book_id", "chapter_id", "path", "anchor", F.first("anchor", ignorenulls=True).over(later).alias("next_anchor"))


def checked_rules(rules: DataFrame) -> DataFrame:
    """(rule_no, rule, valid, error): whether each rule is a pattern that can be applied; null isn't one."""
    schema = T.StructType([T.StructField("valid", T.BooleanType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def check(rule: pd.Series) -> pd.DataFrame:
        found = []
        for r in rule:
            try:
                re.compile(r, re.S | re.I)
                found.append((True, None))
            except (re.error, TypeError) as e:
                found.append((False, f"no pattern: {r!r}: {e}"))
        return pd.DataFrame(found, columns=schema.names)

    return rules.select("rule_no", "rule", check("rule").alias("c")).select("rule_no", "rule", "c.valid", "c.error")


def with_rules(df: DataFrame, text_col: str, rules: Sequence[str]) -> DataFrame:
    """``df`` with the rules applied to its text in turn, and ``removed``: what they took, stripped and not blank.

    Of a rule with one group the group's text is noted, of one with several nothing. Invalid rules change nothing.
    """
    text, removed = F.col(text_col), F.array().cast("array<string>")
    for rule in rules:
        try:
            groups = re.compile(rule, re.S | re.I).groups
        except re.error:
            continue
        pattern = "(?isu)" + rule
        if groups < 2:
            hits = F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(groups)), X.strip), lambda m: m != "")
            removed = F.concat(removed, hits)
        text = F.regexp_replace(text, pattern, "")
    return df.withColumn("removed", removed).withColumn(text_col, text)
