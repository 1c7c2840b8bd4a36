"""Sources, sinks, images and streams on files that the tests write."""

import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from sievemark.functions.text import strip_markup
from sievemark.operators import images as I
from sievemark.sources import documents, sinks, tables
from sievemark.streaming import feeds

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(path):
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in (("a", "a", ""), ("1", "x", "2,5"), ("3", "y")))
    body = f'<w:document {W}><w:body><w:p w:rsidR="00AA11BB"><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:tbl>{rows}</w:tbl></w:body></w:document>'
    core = '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator><d:created>2024-01-02T03:04:05Z</d:created><c:revision>2</c:revision></c:coreProperties>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("docProps/core.xml", core)


def png(path, a):
    raw = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_delimited(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,NA,x\n2,2.5,None\n3,n/a,y\n")
    df = tables.delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "_row_id": "bigint"}
    assert [(r.a, r.b, r.c) for r in df.orderBy("_row_id").collect()] == [(1, None, "x"), (2, 2.5, None), (3, None, "y")]


def test_docx(spark, tmp_path):
    docx(tmp_path / "d.docx")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = documents.files(spark, str(tmp_path), "*.docx")
    cells = documents.docx_tables(rows).collect()
    assert sorted((r.row_id, r.col, r.val) for r in cells if r.col == "a") == [(0, "a", 1.0), (1, "a", 3.0)]
    assert {r.col for r in cells} == {"a", "a_1", "col_2"}
    assert documents.docx_text(rows).first().text.startswith("First\n")
    assert documents.docx_rsids(rows).first().n_unique == 1
    meta = documents.office_metadata(rows).first()
    assert (meta.creator, meta.revision, meta.created.year) == ("Ann", 2, 2024)


def test_jats_and_markup(spark):
    xml = "<article><article-title>A &amp; B</article-title><abstract>We <b>did</b></abstract><body><sec><title>Results</title>p &lt; 10<sup>-3</sup></sec><sec><title>Results</title>more</sec><sec>plain</sec></body></article>"
    r = spark.createDataFrame([(xml,)], "x string").select(documents.jats(F.col("x")).alias("j")).first().j
    assert r.title == "A & B" and r.abstract == "We did" and "p < 10-3" in r.full_text
    assert set(r.sections) == {"results", "untitled"} and "\n\n" in r.sections["results"]


def test_article_is_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def xml(k):
        made.add(1)
        return f"<article><article-title>No {k}</article-title><body><sec><title>Methods</title><p>a</p></sec><sec><title>Results</title>b</sec></body></article>"

    j = spark.range(0, 20, 1, 1).select(documents.jats(xml("id")).alias("j"))
    got = j.select("j.title", "j.abstract", F.col("j.sections")["methods"].alias("m"), F.col("j.sections")["results"].alias("r")).collect()
    assert [tuple(r) for r in got][3] == ("No 3", "", "Methods a", "Results b") and made.value == 20
    assert spark.createDataFrame([(None,)], "x string").select(documents.jats(F.col("x")).alias("j")).first().j == ("", "", None, None)


def test_references_end_with_a_semicolon(spark):
    rows = [("a &amp; b &lt;c&gt; &#233;&#x41;; d&copy;",), ("cut off &amp",), ("&amp x &ltb &#65 &notit; &copyb;",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").coalesce(1).select(strip_markup(F.col("x"))).collect()]
    assert got == ["a & b <c> \u00e9A; d\u00a9", "cut off &amp", "&amp x &ltb &#65 &notit; &copyb;", None]


def test_pictures_pass_in_small_batches(spark):
    made = spark.range(3).selectExpr("cast(id as string) as origin", "64 as height", "64 as width", "1 as nChannels", "cast(repeat(cast(id as string), 4096) as binary) as data")
    for found in (I.hashed(made), I.copy_moves(made), I.patch_splices(made), I.spectra(made), I.decoded(made.withColumnRenamed("data", "picture"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BatchEvalPython") == 1 and "InPandas" not in plan and "Arrow" not in plan
    assert [r.severity for r in I.patch_splices(made).where("severity >= 0").collect()] == [0, 0, 0]


def test_subgraph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e"), ("e", "a")], "src string, dst string")
    assert [(r.node, r.hop) for r in documents.subgraph(edges, "a").collect()] == [("a", 0), ("b", 1), ("e", 1), ("c", 2)]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("d", "A1", 2, "x<y"), ("d", "T4", 4, "z")], "doc_key string, detector_id string, severity int, summary string")
    sinks.json_reports(f, str(tmp_path / "r"))
    report = json.loads(next((tmp_path / "r").glob("*.json")).read_text())
    assert report["overall"] == 4 and [x["detector_id"] for x in report["findings"]] == ["T4", "A1"]
    assert "x&lt;y" in sinks.html_report(f, "d") and "severity" in sinks.json_schema(f)


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    a = (np.kron(rng.integers(0, 200, (16, 16)), np.ones((16, 16)))[..., None] + rng.integers(0, 40, (256, 256, 3))).astype(np.uint8)
    b = a.copy()
    b[160:240, 160:240] = a[0:80, 0:80]
    png(tmp_path / "a.png", a)
    png(tmp_path / "b.png", b)
    pictures = I.images(spark, str(tmp_path))
    got = {r.origin[-5:]: r.votes for r in I.copy_moves(pictures).collect()}
    assert got["b.png"] > got["a.png"]
    assert len({r.phash for r in I.hashed(pictures).collect()}) == 2
    assert I.patch_splices(pictures).count() == 2 and I.spectra(pictures).count() == 2
    c = np.full((320, 320, 3), 50, np.uint8)
    c[:, :] += rng.integers(0, 8, c.shape).astype(np.uint8)
    c[96:192, 96:192] = 220
    assert I.patch_splice(c)[2] >= 2
    assert I.copy_move(np.zeros((10, 10), np.uint8)) == (0, 0)


def test_streams(spark, tmp_path):
    rows = [(1, k, 1_700_000_000 + k - (5 if k == 20 else 0)) for k in range(40)]
    df = spark.createDataFrame(rows, "feed_id long, row_id long, s long").select("feed_id", "row_id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    steps = run(feeds.backward_steps(stream()), "steps")
    assert [(r.row_id, r.behind) for r in steps] == [(20, 4.0)]
    hits = run(feeds.rate_limits(stream().withColumnRenamed("feed_id", "key")), "hits", "update")
    assert max(r.hits for r in hits) == 40
    once = run(feeds.first_uploads(stream().select(F.lit("h").alias("sha256"), "ts")), "once")
    assert len(once) == 1
    day = 86_400
    found = [("r1", "A1", 3, 10), ("r1", "A2", 4, 20), ("r2", "A1", 3, 30), ("r2", "A1", 1, 40), ("r1", "A1", 3, day + 5), ("r9", "A1", 4, 2 * day + 5)]
    findings = spark.createDataFrame(found, "doc_key string, detector_id string, severity int, s long").select("doc_key", "detector_id", "severity", F.timestamp_seconds(F.col("s") + 1_700_006_400).alias("ts"))
    want = [(2, 3, 4), (1, 1, 3), (1, 1, 4)]
    assert [tuple(r)[1:] for r in feeds.daily_digest(findings).orderBy("day").collect()] == want
    for k in range(3):  # a day a batch, so that the watermark closes the days before
        findings.where(F.to_date("ts") == F.date_add(F.to_date(F.timestamp_seconds(F.lit(1_700_006_400))), k)).coalesce(1).write.parquet(str(tmp_path / f"days/{k}"))
    source = spark.readStream.schema(findings.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "days"))
    digests = run(feeds.daily_digest(source), "digests")
    assert sorted(tuple(r)[1:] for r in digests) == sorted(want)[: len(digests)] or {tuple(r)[1:] for r in digests} <= set(want)
    images = spark.createDataFrame([("p1", "A", 7), ("p2", "B", 6), ("p3", "A; C", 0xFFFF << 40)], "paper_id string, authors string, phash long")
    for k in (1, 2):
        images.where(f"paper_id in ('p{k}', 'p{k + 1}')").coalesce(1).write.parquet(str(tmp_path / f"img/{k}"))
        src = spark.readStream.schema(images.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "img"))
        feeds.hash_store(src, str(tmp_path / "store"), str(tmp_path / "ckpt"), str(tmp_path / "found")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "found")).collect()
    assert {(r.paper_id, r.other_id, r.severity) for r in found} == {("p2", "p1", 4)}


def test_baseline_tables(spark):
    from sievemark.operators.reported import welch_pairs
    from sievemark.sources.baseline import baseline_arms, baseline_shares

    rows = [(1, 0, ["Variable", "Treatment (n=40)", "Placebo (n = 42)"]), (1, 1, ["Age", "45.2 ± 12.3", "44.0 (11.1)"]), (1, 2, ["Male", "20 (50%)", "21 (50%)"]), (2, 0, ["x", "y", "z"]), (2, 1, ["a", "1", "2"])]
    cells = spark.createDataFrame([(t, r, c, "Table 1. Baseline" if t == 1 else "") for t, r, c in rows], "table_id long, row int, cells array<string>, page_text string")
    got = baseline_arms(cells)
    assert [(r.variable, [(a.n, a.mean, a.sd) for a in r.arms]) for r in got.collect()] == [("Age", [(40, 45.2, 12.3), (42, 44.0, 11.1)])]
    assert welch_pairs(got.withColumnRenamed("table_id", "trial_id")).count() == 1
    assert [(r.variable, [(a["count"], a.percent) for a in r.arms]) for r in baseline_shares(cells).collect()] == [("Male", [(20, 50.0), (21, 50.0)])]
    bare = spark.createDataFrame([(3, 0, ["", "Arm A", "Arm B"], "Baseline"), (3, 1, ["Age", "45.2 ± 12.3", "44.0 ± 11"], "Baseline")], cells.schema)
    assert baseline_arms(bare).count() == 0 and [[a.n for a in r.arms] for r in baseline_arms(bare, (30, 31)).collect()] == [[30, 31]]


def test_templates(spark):
    from sievemark.operators.templates import TEMPLATES, screen

    assert len(TEMPLATES) == 12
    t = TEMPLATES["pharma"]
    log = spark.range(40).select(F.lit("f").alias("file_id"), F.col("id").alias("row_id"), *[F.lit(10.0).alias(c) for c in t.sources], *[F.lit(5.0).alias(c) for c in t.sinks], F.timestamp_seconds(F.col("id") * 300).alias(t.time_column), F.col("id").alias(t.id_column), F.lit(" ".join(f"w{k}" for k in range(40))).alias(t.narrative_column))
    assert {(r.detector_id, r.severity) for r in screen(log, "pharma").collect()} == {("I1", 3), ("I5", 4)}
    assert {r.detector_id for r in screen(log, "pharma", tolerance_pct=60.0).collect()} == {"I5"}


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>2.5</v></c><c r="B2" s="1"><v>45293.5</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="A4" t="e"><v>#N/A</v></c><c r="AA4"><v>7</v></c></row>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>val</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{first}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c t="str"><v>k</v></c></row><row><c><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>IEEE</d:creator><revision>9</revision></c>')
        z.writestr("docProps/app.xml", "<p><Application>Calc</Application><TotalTime>12</TotalTime></p>")


def test_excel(spark, tmp_path):
    from sievemark.sources.excel import excel_cells

    workbook(tmp_path / "w.xlsx")
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 no")
    rows = documents.files(spark, str(tmp_path), "*.xlsx")
    got = sorted((r.sheet, r.row_id, r.col, r.text, r.val, str(r.at)) for r in excel_cells(rows).collect())
    assert got == [("One", 0, "val", "2.5", 2.5, "None"), ("One", 0, "val_1", "true", None, "None"), ("One", 0, "when", "45293.5", None, "2024-01-02 12:00:00"), ("One", 1, "col_26", "7", 7.0, "None"), ("Two", 0, "k", "1", 1.0, "None")]
    meta = documents.office_metadata(rows).first()
    assert (meta.creator, meta.revision, meta.application, meta.edit_minutes) == ("IEEE", 9, "Calc", 12)


def compound_file(streams):
    """A compound file: short streams in the mini stream, others in sectors of their own."""
    sectors, fat, entries, mini, mini_fat = [], [], [], b"", []

    def put(data):
        start = len(sectors)
        n = max(1, -(-len(data) // 512))
        sectors.extend(data[512 * k : 512 * k + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(start + 1, start + n), 0xFFFFFFFE])
        return start

    for name, data in streams.items():
        if len(data) < 4096:
            start, n = len(mini_fat), max(1, -(-len(data) // 64))
            mini += data.ljust(64 * n, b"\0")
            mini_fat += [*range(start + 1, start + n), 0xFFFFFFFE]
        else:
            start = put(data)
        entries.append((name, 2, start, len(data)))
    entries.insert(0, ("Root Entry", 5, put(mini) if mini else 0xFFFFFFFE, len(mini)))
    table = b"".join(name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + bytes(49) + struct.pack("<IQ", start, size) for name, kind, start, size in entries)
    directory = put(table)
    minis = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else 0xFFFFFFFE
    place = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIII", 1, directory, 0, 4096, minis, 1 if mini_fat else 0)
    head += struct.pack("<II", 0xFFFFFFFE, 0) + struct.pack("<109I", place, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


def test_legacy_word(spark, tmp_path):
    from sievemark.sources import compound

    prose = "The legacy prose of a paper, and more of it. " * 120
    picture = bytes(40) + b"\x89PNG\r\n\x1a\n" + bytes(range(256)) * 20
    (tmp_path / "a.doc").write_bytes(compound_file({"WordDocument": prose.encode("utf-16-le"), "Pictures": picture, "Note": b"short", "Small": b"\x89PNG\r\n\x1a\n"}))
    (tmp_path / "b.doc").write_bytes(compound_file({"WordDocument": b"plain words\0\1\2 of ascii"}))
    (tmp_path / "c.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\xff" * 600)
    (tmp_path / "d.doc").write_bytes(b"no")
    rows = documents.files(spark, str(tmp_path), "*.doc")
    texts = {r.path[-5:]: r.text for r in compound.doc_text(rows).collect()}
    assert texts.get("a.doc") == prose.strip() and texts.get("b.doc") == "plain words of ascii" and "d.doc" not in texts
    assert [(r.name, r.kind, bytes(r.picture)) for r in compound.doc_pictures(rows).collect()] == [("Pictures", "png", picture[40:])]


def tiff(end, make="Nikon", original="2020:01:02 03:04:05"):
    values = [(0x010F, make), (0x0131, "GIMP")]
    pack = lambda f, *x: struct.pack(end + f, *x)
    at = 8 + 2 + 12 * 3 + 4
    entries, tail = b"", b""
    for tag, v in values:
        raw = v.encode() + b"\0"
        entries += pack("HHI", tag, 2, len(raw)) + (pack("I", at + len(tail)) if len(raw) > 4 else raw.ljust(4, b"\0"))
        tail += raw if len(raw) > 4 else b""
    inner = at + len(tail)
    entries += pack("HHII", 0x8769, 4, 1, inner)
    raw = original.encode() + b"\0"
    tail += pack("H", 1) + pack("HHII", 0x9003, 2, len(raw), inner + 18) + pack("I", 0) + raw
    return (b"II*\0" if end == "<" else b"MM\0*") + pack("I", 8) + pack("H", 3) + entries + pack("I", 0) + tail


def test_exif_and_figures(spark, tmp_path):
    import io
    import tarfile

    for name, end in (("a.tif", "<"), ("b.tif", ">")):
        (tmp_path / name).write_bytes(tiff(end))
    marks = tiff(">", "A")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", 8 + len(marks)) + b"Exif\0\0" + marks + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", 30, 40) + bytes(5) + b"\xff\xd9")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xe1\xff\xffExif\0\0II*\0" + b"\xff" * 20)
    got = {r.path[-5:]: (r.make, r.software, str(r.shot)) for r in documents.exif(documents.files(spark, str(tmp_path), "*.{tif,jpg}")).collect()}
    assert got == {"a.tif": ("Nikon", "GIMP", "2020-01-02 03:04:05"), "b.tif": ("Nikon", "GIMP", "2020-01-02 03:04:05"), "c.jpg": ("A", "GIMP", "2020-01-02 03:04:05")}
    assert documents.size_of((tmp_path / "c.jpg").read_bytes()) == (40, 30)
    rng = np.random.default_rng(2)
    png(tmp_path / "big.png", rng.integers(0, 255, (210, 220, 3)).astype(np.uint8))
    png(tmp_path / "icon.png", rng.integers(0, 255, (60, 60, 3)).astype(np.uint8))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        for k, name in enumerate(("big.png", "big.png", "icon.png")):
            z.write(tmp_path / name, f"word/media/{k}{name}")
        z.writestr("word/media/x.emf", b"no picture")
    rows = documents.files(spark, str(tmp_path), "*.docx")
    assert [r.name for r in documents.docx_pictures(rows).collect()] == ["0big.png"] and documents.docx_pictures(rows, figures=False).count() == 2
    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as tar:
        for name, data in (("p/fig.png", (tmp_path / "big.png").read_bytes()), ("../out.png", b"x" * 5000), ("/abs.png", b"x" * 5000), ("p/tiny.gif", b"GIF89a"), ("p/text.txt", b"x" * 5000)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    (tmp_path / "bad.tar.gz").write_bytes(b"\x1f\x8bno")
    assert [(r.name, r.kind) for r in documents.archive_pictures(documents.files(spark, str(tmp_path), "*.tar.gz")).collect()] == [("fig.png", "png")]


def test_decoded_pictures(spark):
    rng = np.random.default_rng(4)
    for channels, colour in ((3, 2), (1, 0), (4, 6)):
        a = rng.integers(0, 255, (13, 9, channels)).astype(np.uint8)
        raw, above = b"", np.zeros((9, channels), int)
        for y, row in enumerate(a.astype(int)):
            left, corner = np.vstack([np.zeros((1, channels), int), row[:-1]]), np.vstack([np.zeros((1, channels), int), above[:-1]])
            p = left + above - corner
            d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
            paeth = np.choose(d.argmin(axis=0), [left, above, corner])
            guess = [0, left, above, (left + above) // 2, paeth][y % 5]
            raw += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            above = row
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        blob = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 13, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        want = a[..., :3][..., ::-1] if channels > 1 else a
        assert (I.decode(blob) == want).all()
    bmp = b"BM" + bytes(8) + struct.pack("<IIiiHHI", 54, 40, 2, 2, 1, 24, 0) + bytes(20) + bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    assert I.decode(bmp).tolist() == [[[7, 8, 9], [10, 11, 12]], [[1, 2, 3], [4, 5, 6]]]
    df = spark.createDataFrame([("a", bmp), ("b", b"no"), ("c", b"\x89PNG\r\n\x1a\nxx")], "origin string, picture binary")
    assert [(r.origin, r.height, r.width, r.nChannels) for r in I.decoded(df).collect()] == [("a", 2, 2, 3)]


def test_scan_of_a_folder(spark, tmp_path):
    import random

    from sievemark import scan
    from sievemark.operators import registry

    rng, folder = random.Random(1), tmp_path / "in"
    folder.mkdir()
    # Fabricated: one column another plus 0.30, whole counts that end in 0 or 5.
    control = [round(rng.uniform(1, 3), 2) for _ in range(70)]
    rows_ = [f"{k},{c:.2f},{c + 0.30:.2f},{rng.randint(50, 99)}%,{rng.randint(100, 999) * 5}" for k, c in enumerate(control)]
    (folder / "fabricated.csv").write_text("Replicate,Control_OD,Treatment_OD,Viability,Cell_Count\n" + "\n".join(rows_))
    # Genuine: noise of its own in every column.
    genuine = [f"{k},{rng.gauss(2.5, 0.3):.3f},{rng.gauss(2.8, 0.3):.3f},{rng.gauss(4500, 800):.0f}" for k in range(70)]
    (folder / "genuine.tsv").write_text("\n".join(["Replicate,Control_OD,Treatment_OD,Cell_Count", *genuine]).replace(",", "\t"))
    (folder / "paper.txt").write_text("word " * 60 + "We show bosom danger by fluffy rationale and head part investigation. t(28) = 2.20, p = .5. Competing interests: none. Data availability: GSE12345.")
    docx(folder / "d.docx")
    out = scan.batch(spark, str(folder), str(tmp_path / "out"), authors=("Bob",))
    got = {r.doc_key.rsplit("/", 1)[1]: r for r in out.collect()}
    assert got["fabricated.csv"].overall == 4 and got["fabricated.csv"].n_critical >= 2
    assert "genuine.tsv" not in got or got["genuine.tsv"].overall < 3
    assert got["paper.txt"].overall == 4 and "CONVERGENCE" in got["paper.txt"].summary
    assert got["d.docx"].n_concern >= 1  # Ann wrote it, not Bob
    found = spark.read.parquet(str(tmp_path / "out/findings"))
    assert found.columns == registry.FINDINGS and found.where("finding_id is null").count() == 0
    text = sinks.terminal_report(out, found, next(r.doc_key for r in out.collect() if r.doc_key.endswith("paper.txt")))
    assert "[CRITICAL] T4: " in text and "innocent" in text
    assert {r.detector_id for r in scan.scan_folder(spark, str(folder), ids=("T4", "B4"), pictures=False).collect()} == {"T4", "B4"}


def test_scan_of_articles(spark):
    from sievemark import scan

    xml = "<article><body><sec><title>Results</title>" + "word " * 60 + "bosom<b> danger</b>, fluffy rationale. t(28) = 2.20, p &lt; .001.</sec></body></article>"
    got = scan.scan_articles(spark.createDataFrame([(7, xml, 2010)], "doc_id long, xml string, paper_year int"), ("T3", "T4", "B4")).collect()
    assert {(r.doc_key, r.detector_id) for r in got} == {("7", "T3"), ("7", "T4"), ("7", "B4")} and {r.summary for r in got if r.detector_id == "T3"} == {"no statement of interests"}


def test_registry_takes_further_detectors(spark):
    from sievemark.operators import registry

    own = registry.Detector("X9", ("numbers",), lambda n: n.select(F.col("k").cast("string").alias("doc_key"), F.lit("odd").alias("summary"), F.lit(0.5).alias("p_value"), F.lit(2).alias("severity")))
    registry.register(own)
    try:
        assert registry.select(have={"numbers"}) == [own] and own.cluster is None
        assert {d.id for d in registry.select(clusters={"compliance"})} == {"T3"}
        assert registry.scan({"numbers": spark.range(3).withColumnRenamed("id", "k")}).count() == 3
    finally:
        del registry.REGISTRY["X9"]


def test_sinks_of_schema_and_audit(spark, tmp_path):
    schema = json.loads(sinks.json_schema(spark.createDataFrame([], "a long, b array<struct<c:string,d:double>>, e map<string,boolean>, f timestamp")))
    assert schema["properties"]["b"]["items"]["properties"]["d"]["type"] == "number" and schema["properties"]["f"]["format"] == "date-time"
    for k in (1, 2):
        sinks.audit_log(spark, str(tmp_path / "log"), f"run{k}", [("begun", {"n": k}), ("ended", {})])
    assert [(r.run_id, r.event) for r in spark.read.json(str(tmp_path / "log")).orderBy("run_id", "position").collect()] == [("run1", "begun"), ("run1", "ended"), ("run2", "begun"), ("run2", "ended")]


def test_landed_works_and_dictionaries(spark):
    from sievemark.operators import evidence as E
    from sievemark.operators import text as T

    work = json.dumps({"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/AB", "title": "t", "publication_year": 2020, "authorships": [{"author": {"id": "https://openalex.org/A1"}}], "referenced_works": ["https://openalex.org/W2"]})
    works = E.works_of(spark.createDataFrame([(work,), ("no json",)], "json string"))
    assert [tuple(r) for r in works.collect()] == [("W1", "10.1/ab", "t", 2020, False, ["A1"], ["W2"])]
    assert E.found_works(works, 2019, 2020, "A1").count() == 1 and E.found_works(works, 2021).count() == 0
    status = E.retraction_status(spark.createDataFrame([(" https://doi.org/10.1/X", '{"update-to":[{"type":"Retraction"},{"type":"correction"}]}'), ("10.1/y", "{}")], "doi string, json string"))
    assert [tuple(r) for r in status.collect()] == [("10.1/x", True, "retraction"), ("10.1/y", False, "")]
    landed = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-05", 2), ("b", "2023-12-01", 3)], "key string, d string, v int").select("key", F.col("d").cast("timestamp").alias("fetched"), "v")
    assert [tuple(r)[::2] for r in E.fresh(landed, "2024-01-06").collect()] == [("a", 2)]
    user = spark.createDataFrame([("gpt", " Delve "), ("gpt", "rich tapestry"), ("x", "y"), ("gpt", " ")], "provider string, phrase string")
    assert {tuple(r) for r in T.beside_builtin(user, {"gpt": ("Delve",)}).collect()} == {("gpt", "Delve", False), ("gpt", "rich tapestry", True)}
    assert T.merged_dictionaries(user, user).count() == 3
    docs = spark.createDataFrame([("rare phrase " * 4 + "of the " * 4,)], "text string")
    assert {r.phrase for r in T.mined_phrases(docs, ("of", "the"), 2, 2).collect()} == {"rare phrase", "phrase rare"}
    assert {r.phrase for r in T.mined_phrases(docs, ("of", "the"), 2, 2, usual={"rare phrase": 200_000.0}).collect()} == {"phrase rare"}


def test_contexts_and_numbers(spark):
    from sievemark.functions.digits import decimal_places, safe_equal
    from sievemark.functions.text import contexts

    r = spark.createDataFrame([("one a1 two\na22 end",)], "t string").select(contexts(F.col("t"), r"a\d+", 3).alias("c")).first()
    assert [tuple(x) for x in r.c] == [(4, "a1", "ne a1 tw"), (11, "a22", "wo\na22 en")]
    df = spark.createDataFrame([(1.25, 1.25 + 1e-10), (3.0, 3.1), (0.0, 1e-13), (float("inf"), float("inf"))], "a double, b double")
    assert [(r.d, r.e) for r in df.select(decimal_places(F.col("a")).alias("d"), safe_equal(F.col("a"), F.col("b")).alias("e")).collect()][:3] == [(2, True), (0, False), (0, True)]
    assert df.select(safe_equal(F.col("a"), F.col("b")).alias("e")).collect()[3].e


def pdf_file(objects, info=None):
    body = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return body + b"trailer << /Root 1 0 R %s >>\nstartxref\n0\n%%%%EOF" % (b"/Info %d 0 R" % info if info else b"")


def test_pdf(spark, tmp_path):
    from sievemark.sources import pdf

    flate = lambda data, more=b"": b"<< /Filter /FlateDecode %s >>\nstream\n%s\nendstream" % (more, zlib.compress(data))
    first = rb"BT /F1 12 Tf 72 700 Td (First \(line\) \251) Tj 0 -14 Td [(Sec) 20 (ond) -300 (line)] TJ ET BI /W 1 ID \x00(x) EI BT (after) ' ET"
    second = b"BT /F2 9 Tf <00010002> Tj T* <0005> Tj ET"
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0004> <0062> <0005> <0006> [<00E900E8> <0041>] endbfrange"
    inner = b"20 0 21 44 << /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>  << /Type /Page /Parent 2 0 R /Contents [6 0 R 7 0 R] /Resources 8 0 R >>"
    start = inner.index(b"<<")
    picture = b"\xff\xd8\xff\xc0\0\x0b\x08" + struct.pack(">HH", 300, 400) + bytes(9000)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [5 0 R 21 0 R] /Count 2 /Resources << /Font << /F1 4 0 R >> >> >>",
        4: b"<< /Type /Font /BaseFont /Helvetica >>", 5: b"<< /Type /Page /Parent 2 0 R /Contents 3 0 R >>", 3: flate(first),
        6: flate(second), 7: b"<< /Length 0 >>\nstream\n\nendstream", 8: b"<< /Font << /F2 20 0 R >> >>", 9: flate(cmap),
        10: flate(inner, b"/Type /ObjStm /N 2 /First %d" % start), 11: b"<< /Author (Ann) /Creator <FEFF00C9> /CreationDate (D:20240102030405Z) >>",
        12: b"<< /Subtype /Image /Filter /DCTDecode >>\nstream\n%s\nendstream" % picture,
    }
    # The second object of the stream begins where its head says.
    at = inner[start:].index(b"<< /Type /Page")
    objects[10] = flate(b"20 0 21 %d ".ljust(0) % at + inner[start:], b"/Type /ObjStm /N 2 /First %d" % len(b"20 0 21 %d " % at))
    (tmp_path / "a.pdf").write_bytes(pdf_file(objects, 11))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken 1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Filter /FlateDecode >> stream\nxx endstream")
    (tmp_path / "c.pdf").write_bytes(b"no")
    rows = documents.files(spark, str(tmp_path), "*.pdf")
    texts = {r.path[-5:]: r.text for r in pdf.pdf_text(rows).collect()}
    assert texts["a.pdf"] == "First (line) ©\nSecond line\nafter\n\nAb\néè" and not texts.get("b.pdf")
    m = {r.path[-5:]: r for r in pdf.pdf_metadata(rows).collect()}["a.pdf"]
    assert (m.author, m.creator, str(m.created)) == ("Ann", "É", "2024-01-02 03:04:05")
    assert [(r.name, len(r.picture)) for r in pdf.pdf_pictures(rows).collect()] == [("object12.jpg", len(picture))]
