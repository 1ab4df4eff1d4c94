"""Other files: JSON documents, JSON lines, WAV headers, checkpoints, first covers; and the sinks."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BOOK = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("creators", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType())]))), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("isbn", T.StringType()),
        T.StructField("chapters", T.ArrayType(T.StructType([T.StructField("chapter_number", T.IntegerType()), T.StructField("chapter_title", T.StringType()), T.StructField("content_text", T.StringType()), T.StructField("chunks", T.ArrayType(T.StringType()))]))),
        T.StructField("cover_image", T.StringType()), T.StructField("cover_image_media_type", T.StringType()), T.StructField("toc_source", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book.json documents; broken ones are skipped."""
    df = spark.read.schema(BOOK).option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return df.where("_corrupt_record IS NULL").drop("_corrupt_record")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of utterances."""
    return spark.read.schema("audio string, text string, ref_audio string").json(path)


def read_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options: str) -> DataFrame:
    """A database table over JDBC; with a whole-number ``key`` and its bounds it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_table(df: DataFrame, url: str, name: str, mode: str = "overwrite", **options: str) -> None:
    """A state (the fold of a log) as a database table."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of the files whose name fits, in the order of their paths, without reading their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length").orderBy("path")


def book_documents(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book_id, json): one document a book: its metadata (any columns of ``books`` beside book_id), chapters in order
    without href, cover, source of contents and warnings; fields that are null or empty are left out."""
    part = F.struct("chapter_number", "chapter_id", "chapter_title", "content_text", "chunks")
    body = chapters.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(part)), lambda c: c.dropFields("chapter_id")).alias("chapters"))
    filled = []
    for f in books.drop("book_id").schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        filled.append(c.alias(f.name))
    return books.join(body, "book_id", "left").select("book_id", F.to_json(F.struct(*filled, F.when(F.size("chapters") > 0, F.col("chapters")).alias("chapters"))).alias("json"))


def write_books(documents: DataFrame, path: str) -> None:
    """The JSON documents as lines, in a folder a book."""
    documents.select("book_id", F.col("json").alias("value")).write.mode("overwrite").partitionBy("book_id").text(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines: manifests, attempt logs, and the states between two steps."""
    df.write.mode("overwrite").json(path)


def cleaned_dump(chapters: DataFrame) -> DataFrame:
    """What a cleaning step leaves for review: number, title, text and what was removed."""
    return chapters.select("chapter_number", F.coalesce("chapter_title", F.lit("")).alias("chapter_title"), F.coalesce("content_text", F.lit("")).alias("chapter_content"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed_text"))


def save_edited(edits: DataFrame, path: str) -> DataFrame:
    """Writes the edits (book_id, json) that are valid JSON and gives the others back."""
    ok = valid_json(F.col("json"))
    write_books(edits.where(ok.isNotNull()), path)
    return edits.where(ok.isNull())


def valid_json(x: Column) -> Column:
    """The text where it is valid JSON, else null."""
    return F.when(F.try_parse_json(x).isNotNull(), x)


@F.pandas_udf(T.DoubleType())
def wav_seconds(content: pd.Series) -> pd.Series:
    """Duration from the header of a WAV file; null where there is none."""

    def one(b):
        if b is None or b[:4] != b"RIFF" or b[8:12] != b"WAVE":
            return None
        at, rate = 12, 0
        while at + 8 <= len(b):
            name, size = b[at : at + 4], struct.unpack("<I", b[at + 4 : at + 8])[0]
            if name == b"fmt ":
                rate = struct.unpack("<I", b[at + 16 : at + 20])[0]
            if name == b"data":
                return size / rate if rate else None
            at += 8 + size + size % 2
        return None

    return content.map(one)


# Cover names in order of preference; image types and their extensions.
COVERS = ("cover.jpg", "cover.jpeg", "cover.png", "cover.webp")
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp"}


def first_cover(files: DataFrame) -> DataFrame:
    """(folder, file): the preferred cover of each folder of (folder, file)."""
    rank = F.array_position(F.array(*map(F.lit, COVERS)), F.col("file"))
    return files.where(rank > 0).groupBy("folder").agg(F.min(F.struct(rank.alias("r"), "file"))["file"].alias("file"))


def cover_code(content: Column) -> Column:
    """An image's bytes as base64 without line breaks."""
    return F.regexp_replace(F.base64(content), "[\\r\\n]", "")


def cover_bytes(image: Column, media_type: Column) -> Column:
    """struct(content, extension) of a base64 image; null content where it can't be decoded."""
    ext = F.coalesce(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))[F.lower(media_type)], F.lit(".img"))
    return F.struct(F.try_to_binary(image, F.lit("base64")).alias("content"), ext.alias("extension"))


def by_number(files: DataFrame, name: str = "file") -> DataFrame:
    """Checkpoint names in the numeric order of their suffix."""
    return files.orderBy(F.substring_index(name, "-", -1).try_cast("int"), name)


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


# The name spaces of a feed.
NAMESPACES = 'xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:atom="http://www.w3.org/2005/Atom"'


def _tag(name: str, x: Column) -> Column:
    """An element, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _escaped(x), F.lit(f"</{name}>")), F.lit(""))


def _empty_tag(name: str, **attrs: Column) -> Column:
    """An element without content; nothing where an attribute is null."""
    parts = [F.concat(F.lit(f' {k}="'), _escaped(v), F.lit('"')) for k, v in attrs.items()]
    return F.coalesce(F.concat(F.lit(f"<{name}"), *parts, F.lit("/>")), F.lit(""))


def feed_items(episodes: DataFrame) -> DataFrame:
    """(channel, pos, xml): an item of each episode (channel, pos, number, title, url, bytes, pub_date, duration, description, author)."""
    c = F.col
    description = F.nullif(F.left(c("description"), F.lit(5000)), F.lit(""))
    xml = F.concat(
        F.lit("<item>"), _tag("title", c("title")), _tag("guid", c("url")), _tag("link", c("url")), _tag("pubDate", c("pub_date")), _tag("description", description), _tag("itunes:summary", description),
        _tag("itunes:episode", c("number").cast("string")), _tag("itunes:episodeType", F.lit("full")), _tag("itunes:author", c("author")),
        _empty_tag("enclosure", url=c("url"), type=F.lit("audio/mpeg"), length=F.coalesce(c("bytes").cast("string"), F.lit("0"))), _tag("itunes:duration", c("duration")), F.lit("</item>"),
    )
    return episodes.select("channel", "pos", xml.alias("xml"))


def feeds(channels: DataFrame, episodes: DataFrame) -> DataFrame:
    """(channel, xml): one RSS document a channel that has episodes, its items in order.

    ``channels``: channel, title, description, language, author, pub_date, build_date, link, image, explicit.
    """
    c = F.col
    items = feed_items(episodes).groupBy("channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "xml"))), lambda i: i["xml"]), "").alias("items"))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Podcast"))
    description = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Podcast adaptation of "), title, F.lit(".")))
    image = F.when(c("image").isNotNull(), F.concat(F.lit("<image>"), _tag("url", c("image")), _tag("title", title), _tag("link", F.coalesce("link", F.lit(""))), F.lit("</image>"), _empty_tag("itunes:image", href=c("image"))))
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" {NAMESPACES}><channel>'), _tag("title", title), _tag("description", description), _tag("language", F.coalesce("language", F.lit("en"))),
        _tag("pubDate", c("pub_date")), _tag("lastBuildDate", c("build_date")), _tag("itunes:author", F.coalesce("author", F.lit("Unknown"))), _tag("itunes:summary", description),
        _tag("itunes:explicit", F.when(c("explicit"), "yes").otherwise("no")), _tag("link", c("link")), _empty_tag("atom:link", href=c("link"), rel=F.lit("self"), type=F.lit("application/rss+xml")), F.coalesce(image, F.lit("")),
    )
    return channels.join(items, "channel").select("channel", F.concat(head, c("items"), F.lit("</channel></rss>")).alias("xml"))


def parsed_feeds(df: DataFrame, xml: str = "xml") -> DataFrame:
    """``df`` with a feed's title, author, language, link, image and the titles and addresses of its items; null for what
    isn't XML."""
    x = F.col(xml)
    own = lambda name: F.nullif(F.xpath_string(x, F.lit(f"/rss/channel/*[name()='{name}']")), F.lit(""))
    items = lambda path: F.xpath(x, F.lit(f"/rss/channel/item/{path}"))
    return df.select(
        "*", own("title").alias("title"), own("itunes:author").alias("author"), own("language").alias("language"), own("link").alias("link"),
        F.nullif(F.xpath_string(x, F.lit("/rss/channel/image/url")), F.lit("")).alias("image"), items("title/text()").alias("item_titles"), items("enclosure/@url").alias("item_urls"),
    )


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed files (one document a file) with what ``parsed_feeds`` finds."""
    return parsed_feeds(spark.read.text(path, wholetext=True, pathGlobFilter="*.xml", recursiveFileLookup=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml"))).drop("xml")
