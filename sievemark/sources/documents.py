"""Office documents, picture files and article XML: tables, text, pictures, revision marks and metadata, read from binaryFile in the executors."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.functions.entities import TAG, spaced, stripped, untagged

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, length, sha256 and content of the files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def parsed(rows: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """parse over each content; a file that can't be read gives no rows."""
    names = ["path", *(c.strip().split(" ")[0] for c in re.sub(r"<[^>]*>", "", schema).split(","))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b.path, b.content, strict=True):
                try:
                    out += [(path, *r) for r in parse(bytes(content))]
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, struct.error, tarfile.TarError, EOFError, OSError, zlib.error, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return rows.select("path", "content").mapInPandas(run, f"path string, {schema}")


def _xml(content: bytes, part: str) -> ElementTree.Element:
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read(part))


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def header(names: list[str]) -> list[str]:
    """Blank names become col_i, repeated ones get a number."""
    seen: Counter[str] = Counter()
    out = []
    for name in (n.strip() or f"col_{i}" for i, n in enumerate(names)):
        out.append(f"{name}_{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def _docx_cells(content: bytes) -> Iterator[tuple]:
    for k, table in enumerate(_xml(content, "word/document.xml").iter(f"{_W}tbl")):
        rows = [[_text(c).strip() for c in r.iter(f"{_W}tc")] for r in table.iter(f"{_W}tr")]
        if len(rows) < 2:
            continue
        width = max(map(len, rows))
        rows = [r + [""] * (width - len(r)) for r in rows]
        for i, r in enumerate(rows[1:]):
            yield from ((k, i, name, value) for name, value in zip(header(rows[0]), r, strict=True))


def docx_tables(rows: DataFrame) -> DataFrame:
    """path, table, row_id, col, text and val of each cell; a column is numeric if half of its cells are."""
    cells = parsed(rows, _docx_cells, "table int, row_id long, col string, text string")
    number = F.regexp_replace("text", ",", "").try_cast("double")
    share = cells.withColumn("v", number).groupBy("path", "table", "col").agg((F.count("v") >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("numeric"))
    return cells.join(share, ["path", "table", "col"]).withColumn("val", F.when(F.col("numeric"), number)).drop("numeric")


def docx_text(rows: DataFrame) -> DataFrame:
    """path and text: paragraphs that aren't blank, a line each."""
    read = lambda content: [("\n".join(t for p in _xml(content, "word/document.xml").iter(f"{_W}p") if (t := _text(p)).strip()),)]
    return parsed(rows, read, "text string")


def docx_rsids(rows: DataFrame) -> DataFrame:
    """Path, n_unique, n_paragraph, severity: how many editing sessions the document remembers."""

    def read(content: bytes) -> Iterator[tuple]:
        z = zipfile.ZipFile(io.BytesIO(content))
        parts = b"".join(z.read(n) for n in ("word/document.xml", "word/settings.xml") if n in z.namelist())
        found = re.findall(rb'w:rsid(\w*)(?:\s+w:val)?="([0-9A-Fa-f]{8})"', parts)
        yield len({v for _, v in found}), sum(k in (b"P", b"RDefault") for k, _ in found)

    got = parsed(rows, read, "n_unique int, n_paragraph int")
    n = F.col("n_unique")
    return got.withColumn("severity", F.when(n == 0, 2).when((n <= 2) & (F.col("n_paragraph") == 0) | (n <= 4), 1).otherwise(0).cast("int"))


def office_metadata(rows: DataFrame) -> DataFrame:
    """path, creator, last_modified_by, created, modified, title, revision, application, app_version and edit_minutes of docx and xlsx files."""

    def whole(text: str | None) -> int | None:
        return int(text) if (text or "").strip().isdigit() else None

    def read(content: bytes) -> Iterator[tuple]:
        have = set(zipfile.ZipFile(io.BytesIO(content)).namelist())
        of = lambda part: {e.tag.split("}")[-1]: e.text for e in _xml(content, part).iter()} if part in have else {}
        core, app = of("docProps/core.xml"), of("docProps/app.xml")
        if core or app:
            yield core.get("creator"), core.get("lastModifiedBy"), core.get("created"), core.get("modified"), core.get("title"), whole(core.get("revision")), app.get("Application"), app.get("AppVersion"), whole(app.get("TotalTime"))

    got = parsed(rows, read, "creator string, last_modified_by string, created string, modified string, title string, revision int, application string, app_version string, edit_minutes int")
    return got.withColumns({c: F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")) for c in ("created", "modified")})


# How picture files begin, and their kinds.
PICTURES = ((b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff", "jpg"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"II*\x00", "tif"), (b"MM\x00*", "tif"), (b"\x00\x00\x01\x00", "ico"))
# Endings of picture files.
ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff")
#: Least width, height and bytes of a figure; smaller pictures are icons and formulas.
LEAST_SIDE, LEAST_BYTES = 200, 8_000


def kind_of(blob: bytes) -> str | None:
    return next((kind for magic, kind in PICTURES if blob.startswith(magic)), None)


def size_of(blob: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP or JPEG; None where they can't be told."""
    kind = kind_of(blob)
    if kind == "png" and len(blob) >= 24:
        return struct.unpack_from(">II", blob, 16)
    if kind == "gif" and len(blob) >= 10:
        return struct.unpack_from("<HH", blob, 6)
    if kind == "bmp" and len(blob) >= 26:
        w, h = struct.unpack_from("<ii", blob, 18)
        return w, abs(h)
    at = 2
    while kind == "jpg" and at + 9 < len(blob) and blob[at] == 0xFF:
        marker, length = blob[at + 1], struct.unpack_from(">H", blob, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", blob, at + 5)
            return w, h
        at += 2 + length
    return None


def is_figure(blob: bytes) -> bool:
    """Large enough to be a figure; a picture whose size can't be told counts by its bytes."""
    size = size_of(blob)
    return len(blob) >= LEAST_BYTES and (size is None or min(size) >= LEAST_SIDE)


def docx_pictures(rows: DataFrame, figures: bool = True) -> DataFrame:
    """path, name, kind and picture of the media of docx and xlsx files, equal ones of a file once; figures: those that is_figure() takes alone."""

    def read(content: bytes) -> Iterator[tuple]:
        z = zipfile.ZipFile(io.BytesIO(content))
        seen: set[bytes] = set()
        for name in sorted(z.namelist()):
            if re.match(r"(word|xl|ppt)/media/", name) and (kind := kind_of(blob := z.read(name))) and (not figures or is_figure(blob)):
                key = hashlib.sha256(blob).digest()
                if key not in seen:
                    seen.add(key)
                    yield posixpath.basename(name), kind, blob

    return parsed(rows, read, "name string, kind string, picture binary")


def archive_pictures(rows: DataFrame, least: int = 2_000) -> DataFrame:
    """Path, name, kind and picture of a tar.gz archive's picture files of `least` bytes or more; members with a path out of the archive are left out."""

    def read(content: bytes) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
            for m in tar:
                if m.isfile() and m.name.lower().endswith(ENDINGS) and not m.name.startswith("/") and ".." not in m.name.split("/") and m.size >= least:
                    blob = tar.extractfile(m).read()
                    yield posixpath.basename(m.name), kind_of(blob) or "", blob

    return parsed(rows, read, "name string, kind string, picture binary")


# Tags of the image file directories that are read.
EXIF_TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "changed", 0x9003: "original"}


def exif_of(blob: bytes) -> dict[str, str]:
    """Make, model, software and times of a JPEG, TIFF or PNG; empty without any."""
    kind, tiff = kind_of(blob), None
    if kind == "tif":
        tiff = blob
    elif kind == "jpg":
        at = 2
        while at + 4 <= len(blob) and blob[at] == 0xFF and blob[at + 1] not in (0xD9, 0xDA):
            length = struct.unpack_from(">H", blob, at + 2)[0]
            if blob[at + 1] == 0xE1 and blob[at + 4 : at + 10] == b"Exif\0\0":
                tiff = blob[at + 10 : at + 2 + length]
                break
            at += 2 + length
    elif kind == "png":
        at = 8
        while at + 8 <= len(blob):
            length, name = struct.unpack_from(">I4s", blob, at)
            if name == b"eXIf":
                tiff = blob[at + 8 : at + 8 + length]
                break
            at += 12 + length
    out: dict[str, str] = {}
    if not tiff or tiff[:2] not in (b"II", b"MM") or len(tiff) < 8:
        return out
    end = "<" if tiff[:2] == b"II" else ">"
    todo, seen = [struct.unpack_from(end + "I", tiff, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(end + "H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, form, n = struct.unpack_from(end + "HHI", tiff, entry)
            if tag == 0x8769:
                todo.append(struct.unpack_from(end + "I", tiff, entry + 8)[0])
            elif tag in EXIF_TAGS and form == 2:
                start = entry + 8 if n <= 4 else struct.unpack_from(end + "I", tiff, entry + 8)[0]
                out[EXIF_TAGS[tag]] = tiff[start : start + n].split(b"\0")[0].decode("utf-8", "replace").strip()
    return out


def exif(pictures: DataFrame) -> DataFrame:
    """S15 over (path, content): path, make, model, software and shot (the time of the shot, else that of the last change) of each picture that has such marks."""

    def read(content: bytes) -> Iterator[tuple]:
        if got := exif_of(content):
            yield got.get("make"), got.get("model"), got.get("software"), got.get("original"), got.get("changed")

    got = parsed(pictures, read, "make string, model string, software string, original string, changed string")
    time = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyy:MM:dd HH:mm:ss"))
    return got.select("path", "make", "model", "software", F.coalesce(time("original"), time("changed")).alias("shot"))


def _inner(tag: str) -> re.Pattern:
    return re.compile(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")


# Parts of article XML.
_ARTICLE = {tag: _inner(tag) for tag in ("body", "article-title", "abstract", "sec", "(?:article-)?title")}


def article(xml: str | None) -> tuple[str, str, str | None, dict[str, str] | None]:
    """Title, abstract, full text and sections of article XML; each part is looked for once."""
    inner = lambda tag, text: m[1] if (m := _ARTICLE[tag].search(text)) else ""
    if xml is None:
        return "", "", None, None
    body = inner("body", xml) or xml
    found: dict[str, list[str]] = {}
    for m in _ARTICLE["sec"].finditer(body):
        if text := spaced(untagged(m[1])):
            title = spaced(TAG.sub(" ", inner("(?:article-)?title", m[1]))).lower()[:80]
            found.setdefault(title or "untitled", []).append(text)
    return stripped(inner("article-title", xml)), stripped(inner("abstract", xml)), stripped(body), {k: "\n\n".join(v) for k, v in found.items()}


def jats(xml: Column) -> Column:
    """Struct of title, abstract, full_text and sections (map by lower-case title; equal titles are joined by an empty line).

    One Arrow-vectorised function: as an expression, every part would compute xml again.
    """

    @F.pandas_udf("title string, abstract string, full_text string, sections map<string,string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([article(x) for x in s], columns=["title", "abstract", "full_text", "sections"], dtype=object)

    return run(xml)


def subgraph(edges: DataFrame, root: str, hops: int = 2, fan_out: int = 30, most: int = 200) -> DataFrame:
    """Nodes of the citation graph within `hops` of the root: at most fan_out references of a node and `most` nodes, nearest first."""
    from pyspark.sql import Window

    spark = edges.sparkSession
    first = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    capped = edges.withColumn("r", first).where(F.col("r") <= fan_out).drop("r")
    reached = frontier = spark.createDataFrame([(root, 0)], "node string, hop int")
    for hop in range(1, hops + 1):
        step = capped.join(frontier, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.orderBy("hop", "node").limit(most)
