"""EPUB files: one row an entry of the table of contents, parsed on the executors, one book by one task."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PERSON = "struct<name:string,role:string,file_as:string>"
METADATA = f"""struct<title:string,titles:array<string>,creators:array<{PERSON}>,contributors:array<struct<name:string,role:string>>,subjects:array<string>,languages:array<string>,
publishers:array<string>,description:string,rights:string,date:string,identifiers:array<struct<value:string,scheme:string>>,isbn:string>"""
SCHEMA = (
    f"file string, pos int, source string, title string, href string, path string, anchor string, html string, metadata {METADATA}, "
    "cover_href string, cover_media_type string, warnings array<string>, error string"
)
COVER = "file string, href string, media_type string, content binary"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _attr(e: ET.Element, name: str) -> str | None:
    """An attribute by local name in any case."""
    return next((v for k, v in e.attrib.items() if _local(k) == name), None)


def _all(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if _local(e.tag) == name]


def _join(base: str, href: str) -> str:
    path, hash_, anchor = href.partition("#")
    full = posixpath.normpath(posixpath.join(base, unquote(path))) if path else ""
    return full + hash_ + anchor


def _flatten(points: list[ET.Element], base: str) -> Iterator[tuple[str, str]]:
    """Entries in pre-order; one without a target is left out, its children stay."""
    for p in points:
        label = next((t.text for t in _all(p, "text") if t.text), "") or ""
        src = next((_attr(c, "src") for c in p if _local(c.tag) == "content"), None)
        if src:
            yield label.strip(), _join(base, src)
        yield from _flatten([c for c in p if _local(c.tag) == "navpoint"], base)


class Book:
    """One EPUB: its manifest, spine, tables of contents, metadata and images, each read when asked for."""

    def __init__(self, data):
        self.zip = zipfile.ZipFile(data)
        self.names = {n: i.file_size for n, i in ((i.filename, i) for i in self.zip.infolist())}
        root = ET.fromstring(self.zip.read("META-INF/container.xml"))
        opf_path = next(_attr(e, "full-path") for e in _all(root, "rootfile"))
        self.opf, base = ET.fromstring(self.zip.read(opf_path)), posixpath.dirname(opf_path)
        self.items = {_attr(e, "id"): (_join(base, _attr(e, "href") or ""), (_attr(e, "media-type") or "").lower(), _attr(e, "properties") or "") for e in _all(self.opf, "item")}
        self.by_path = {posixpath.normpath(href): href for href, _, _ in self.items.values()}

    def spine(self) -> list[str]:
        refs = [e for e in _all(self.opf, "itemref") if (_attr(e, "linear") or "yes").lower() != "no"]
        return [self.items[_attr(e, "idref")][0] for e in refs if _attr(e, "idref") in self.items]

    def ncx(self) -> list[tuple[str, str]]:
        href = next((h for h, kind, _ in self.items.values() if kind == "application/x-dtbncx+xml" and h in self.names), None)
        maps = _all(ET.fromstring(self.zip.read(href)), "navmap") if href else []
        return list(_flatten([c for c in maps[0] if _local(c.tag) == "navpoint"], posixpath.dirname(href))) if maps else []

    def by_spine(self, entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The entries of each document of the spine, an untitled one for a document without any."""
        of: dict[str, list[tuple[str, str]]] = {}
        for title, href in entries:
            of.setdefault(href.partition("#")[0], []).append((title, href))
        return [x for doc in self.spine() for x in of.get(doc, [("", doc)])]

    def contents(self, preferred: str) -> tuple[str, list[tuple[str, str]], list[str]]:
        """(source, entries, warnings): the preferred table of contents, else the other; a warning for each that is empty."""
        entries, warnings = self.ncx(), []
        for source in ("opf", "ncx") if preferred == "opf" else ("ncx", "opf"):
            found = self.by_spine(entries) if source == "opf" else entries
            if found:
                return source, found, warnings
            warnings.append(f"no entries by {source}")
        return "", [], [*warnings, "no table of contents"]

    def metadata(self) -> dict:
        """The Dublin Core fields that aren't empty, their attributes by local name in any case."""

        def values(name: str, /, **attrs: str) -> list:
            found = [(re.sub(r"\s+", " ", e.text or "").strip(), e) for e in _all(self.opf, name)]
            if not attrs:
                return [v for v, _ in found if v]
            main, *others = attrs
            return [{main: v, **{k: _attr(e, attrs[k]) for k in others}} for v, e in found if v]

        titles, identifiers = values("title"), values("identifier", value="", scheme="scheme")
        first = lambda name: next(iter(values(name)), None)
        fields = {
            "title": next(iter(titles), None), "titles": titles, "creators": values("creator", name="", role="role", file_as="file-as"), "contributors": values("contributor", name="", role="role"),
            "subjects": values("subject"), "languages": values("language"), "publishers": values("publisher"), "description": first("description"), "rights": first("rights"), "date": first("date"),
            "identifiers": identifiers, "isbn": next((i["value"] for i in identifiers if (i["scheme"] or "").lower() == "isbn"), None),
        }
        return {k: v for k, v in fields.items() if v}

    def cover(self) -> tuple[str, str] | None:
        """(href, media type) of the image marked as cover, else one named so, else the first; empty images don't count."""
        marked = next((_attr(e, "content") for e in _all(self.opf, "meta") if _attr(e, "name") == "cover"), None)
        images = [(i, href, kind, props) for i, (href, kind, props) in self.items.items() if kind.startswith("image/") and self.names.get(href)]
        rank = lambda x: 0 if "cover-image" in x[3].lower().split() or x[0] == marked else 1 if "cover" in f"{x[0]} {x[1]}".lower() else 2
        best = min(images, key=rank, default=None)
        return (best[1], best[2]) if best else None

    def text(self, path: str) -> str | None:
        inside = self.by_path.get(posixpath.normpath(path), path)
        return self.zip.read(inside).decode("utf-8", "replace") if inside in self.names else None


def read_book(data, toc: str = "opf") -> list[dict]:
    """Rows of one book. ``toc``: ``opf`` (spine order) or ``ncx``, the other one where it is empty; a book without any
    entry gives one row with its warnings."""
    book = Book(data)
    source, entries, warnings = book.contents(toc)
    href, kind = book.cover() or (None, None)
    shared = {"source": source or None, "metadata": book.metadata(), "cover_href": href, "cover_media_type": kind, "warnings": warnings}
    rows = []
    for pos, (title, target) in enumerate(entries):
        path, _, anchor = target.partition("#")
        rows.append(shared | {"pos": pos, "title": title or None, "href": target, "path": path, "anchor": anchor or None, "html": book.text(path)})
    return rows or [shared]


def _per_file(files: DataFrame, read, ddl: str) -> DataFrame:
    """Rows that ``read`` gives for each (path, content); an unreadable file gives one row with its error, where there is a
    field for it."""
    import json
    schema = files.sparkSession.createDataFrame([], ddl).schema
    text = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, T.AtomicType) else T.StringType()) for f in schema.fields])

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    got = read(content)
                except Exception as e:  # one bad file must not end the scan
                    got = [{"error": f"{type(e).__name__}: {e}"}]
                for r in got:
                    r = {"file": file, **r}
                    out.append([r.get(f.name) if isinstance(f.dataType, T.AtomicType) or r.get(f.name) is None else json.dumps(r[f.name], ensure_ascii=False) for f in schema.fields])
            yield pd.DataFrame(out, columns=schema.names).astype(object)

    rows = files.mapInPandas(run, text)
    return rows.select(*(F.col(f.name) if isinstance(f.dataType, T.AtomicType) else F.from_json(f.name, f.dataType).alias(f.name) for f in schema.fields))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")


def parse_books(files: DataFrame, toc: str = "opf") -> DataFrame:
    """One row an entry of the table of contents, from (path, content). A book is parsed once, by one task."""
    import io

    return _per_file(files, lambda content: read_book(io.BytesIO(content), toc), SCHEMA)


def read_epubs(spark: SparkSession, path: str, toc: str = "opf") -> DataFrame:
    """All books under ``path``; an unreadable file gives one row with its error."""
    return parse_books(_files(spark, path), toc)


def read_covers(spark: SparkSession, path: str) -> DataFrame:
    """(file, href, media_type, content) of each book's cover; books without one, and unreadable files, have no row."""
    import io

    def read(content) -> list[dict]:
        book = Book(io.BytesIO(content))
        best = book.cover()
        return [{"href": best[0], "media_type": best[1], "content": book.zip.read(best[0])}] if best else []

    return _per_file(_files(spark, path), read, COVER).where("href IS NOT NULL")


def list_episodes(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, index, title) of the numbered recordings under ``path``, without reading their bytes."""
    from foliant.functions.text import episode_title

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    e = episode_title(name)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder"), name.alias("file"), e["index"].alias("index"), e["title"].alias("title")).where("index IS NOT NULL")
