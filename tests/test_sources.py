"""Readers and writers on small files made here."""

import json
import struct
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from foliant.plans import pipeline
from foliant.sources import epub, files
from foliant.streaming import queue

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<metadata><dc:title>Small Book</dc:title><dc:creator>A. Writer</dc:creator><dc:language>en</dc:language><dc:identifier opf:scheme="ISBN">123</dc:identifier><meta name="cover" content="img"/></metadata>
<manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" media-type="application/xhtml+xml"/>
<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="img" href="pic.png" media-type="image/png"/></manifest>
<spine toc="ncx"><itemref idref="a"/><itemref idref="n" linear="no"/><itemref idref="b"/></spine></package>"""
NCX = """<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="a.xhtml#x"/></navPoint>
<navPoint><navLabel><text>Part</text></navLabel><navPoint><navLabel><text>Two</text></navLabel><content src="a.xhtml#y"/></navPoint></navPoint></navMap></ncx>"""


def make(path):
    long = "<p>" + "Some words here. " * 12 + "</p>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/book.opf", OPF)
        z.writestr("OEBPS/toc.ncx", NCX)
        z.writestr("OEBPS/a.xhtml", f'<html><body><h1 id="x">One</h1>{long}<h1 id="y">Two</h1>{long}</body></html>')
        z.writestr("OEBPS/b.xhtml", f"<html><body>{long}</body></html>")
        z.writestr("OEBPS/n.xhtml", "<html/>")
        z.writestr("OEBPS/pic.png", b"png")


def test_epub(spark, tmp_path):
    make(tmp_path / "small.epub")
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    rows = epub.read_epubs(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert rows[0].error.startswith("BadZipFile") and rows[0].html is None
    got = [(r.title, r.path, r.anchor, r.source) for r in rows[1:]]
    assert got == [("One", "OEBPS/a.xhtml", "x", "opf"), ("Two", "OEBPS/a.xhtml", "y", "opf"), (None, "OEBPS/b.xhtml", None, "opf")]
    assert (rows[1].metadata.title, [c.name for c in rows[1].metadata.creators], rows[1].metadata.isbn, rows[1].cover_href) == ("Small Book", ["A. Writer"], "123", "OEBPS/pic.png")
    covers = epub.read_covers(spark, str(tmp_path)).collect()
    assert [(c.href, c.media_type, bytes(c.content)) for c in covers] == [("OEBPS/pic.png", "image/png", b"png")]
    assert [r.title for r in epub.read_epubs(spark, str(tmp_path), "ncx").where("error IS NULL").orderBy("pos").collect()] == ["One", "Two"]


def test_pipeline(spark, tmp_path):
    make(tmp_path / "small.epub")
    chapters = pipeline.phase_one(epub.read_epubs(spark, str(tmp_path)))
    assert chapters.count() == 3
    previews = pipeline.rule_previews(chapters, [r"some words here\. some", "nothing like it"]).collect()
    assert [p.rule for p in previews] == [r"some words here\. some"]
    done = pipeline.phase_two(chapters, [r"words "]).orderBy("new_number").collect()
    assert done[0].content_text.startswith("One. One. Some here.") and "words" not in done[2].content_text


def test_episodes_and_covers(spark, tmp_path):
    for n in ("001_The_Road.mp3", "02_x.MP3", "notes.txt", "cover.png", "cover.jpeg"):
        (tmp_path / n).write_bytes(b"x")
    got = sorted((r["index"], r.title) for r in epub.list_episodes(spark, str(tmp_path)).collect())
    assert got == [(1, "The Road"), (2, "x")]
    df = spark.createDataFrame([("a", "cover.png"), ("a", "cover.jpeg"), ("b", "x.png")], "folder string, file string")
    assert [tuple(r) for r in files.first_cover(df).collect()] == [("a", "cover.jpeg")]


def test_json_wav_and_feed(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text('{"title": "T", "chapters": [{"chapter_number": 1, "content_text": "x"}]}')
    (tmp_path / "good" / "b.json").write_text('{"title": ')
    assert [r.title for r in files.read_books(spark, str(tmp_path / "good")).collect()] == ["T"]
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", 32000)
    got = spark.createDataFrame([(bytearray(wav),), (bytearray(b"x"),), (None,)], "b binary").select(files.wav_seconds("b").alias("s")).collect()
    assert [r.s for r in got] == [2.0, None, None]
    code = files.cover_code(F.lit(bytearray(b"png bytes")))
    got = spark.range(1).select(files.cover_bytes(code, F.lit("IMAGE/PNG")).alias("a"), files.cover_bytes(F.lit("%%%"), F.lit("image/x")).alias("b")).first()
    assert (bytes(got.a.content), got.a.extension) == (b"png bytes", ".png") and (got.b.content, got.b.extension) == (None, ".img")


def test_feeds(spark, tmp_path):
    channels = spark.createDataFrame([("c", "T", None, "en", "W", "d", "d", None, "i.png", False), ("d", None, "x", None, None, None, None, "l", None, True), ("none", "N", *[None] * 7, False)], "channel string, title string, description string, language string, author string, pub_date string, build_date string, link string, image string, explicit boolean")
    episodes = spark.createDataFrame([("c", 2, 2, "B & C", "u2", 5, "d", "0:10", "t", "a"), ("c", 1, 1, "A", "u1", None, "d", "0:09", None, None), ("d", 1, None, "<x>", "u", 1, None, None, "y" * 6000, None)], "channel string, pos int, number int, title string, url string, bytes long, pub_date string, duration string, description string, author string")
    made = {r.channel: r.xml for r in files.feeds(channels, episodes).collect()}
    assert set(made) == {"c", "d"}
    root = ET.fromstring(made["c"].encode())
    assert [i.findtext("title") for i in root.iter("item")] == ["A", "B & C"] and root.findtext("channel/image/url") == "i.png"
    assert root.find("channel/item/enclosure").attrib == {"url": "u1", "type": "audio/mpeg", "length": "0"}
    assert root.findtext("channel/description") == "Podcast adaptation of T." and len(ET.fromstring(made["d"].encode()).findtext("channel/item/description")) == 5000
    for k, x in made.items():
        (tmp_path / f"{k}.xml").write_text(x)
    got = {r.title: r for r in files.read_feeds(spark, str(tmp_path)).collect()}
    assert got["T"].author == "W" and got["T"].item_titles == ["A", "B & C"] and got["T"].item_urls == ["u1", "u2"] and got["T"].link is None
    assert got["Untitled Podcast"].link == "l" and got["Untitled Podcast"].item_titles == ["<x>"]


def test_database_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, title string")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    files.write_table(df, url, "books", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = files.read_table(spark, url, "books", "id", (0, 20), 3, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 3 and sorted((r[0], r[1]) for r in back.collect()) == sorted(map(tuple, df.collect()))


def test_documents_dumps_and_edits(spark, tmp_path):
    books = spark.createDataFrame([(1, "T", [], ["w"]), (2, "", ["en"], [])], "book_id int, title string, languages array<string>, _warnings array<string>")
    chapters = spark.createDataFrame([(1, 2, 11, "B", "é", "h", None, ["x"]), (1, 1, 10, "A", "a", "h", None, [])], "book_id int, chapter_number int, chapter_id long, chapter_title string, content_text string, href string, chunks array<string>, removed array<string>")
    made = {r.book_id: json.loads(r.json) for r in files.book_documents(books, chapters).collect()}
    assert made[2] == {"languages": ["en"]} and made[1]["title"] == "T" and made[1]["_warnings"] == ["w"]
    assert made[1]["chapters"] == [{"chapter_number": 1, "chapter_title": "A", "content_text": "a"}, {"chapter_number": 2, "chapter_title": "B", "content_text": "é"}]
    edits = spark.createDataFrame([(1, '{"title": "T2"}'), (2, '{"title": ')], "book_id int, json string")
    assert [r.book_id for r in files.save_edited(edits, str(tmp_path / "saved")).collect()] == [2]
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "saved")).collect()] == [{"title": "T2"}]
    files.write_lines(files.cleaned_dump(chapters), str(tmp_path / "dump"))
    assert sorted((r.chapter_number, r.removed_text) for r in spark.read.json(str(tmp_path / "dump")).collect()) == [(1, []), (2, ["x"])]
    assert [r.path.rpartition("/")[2] for r in files.list_files(spark, str(tmp_path / "dump"), "*.json").collect()]
    files.write_lines(spark.createDataFrame([("a", "b", "c")], "audio string, text string, ref_audio string"), str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).first().text == "b"
    names = spark.createDataFrame([("checkpoint-10",), ("checkpoint-9",), ("checkpoint-x",)], "file string")
    assert [r.file for r in files.by_number(names).collect()] == ["checkpoint-x", "checkpoint-9", "checkpoint-10"]


def test_stream_equals_batch(spark, sf, tmp_path):
    log = spark.read.parquet(f"{sf}/player_queue.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = queue.latest_positions(queue.stream_log(spark, str(tmp_path / "log"), log.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("latest").collect())) == sorted(map(str, queue.latest_positions(log).collect()))
