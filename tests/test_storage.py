"""Stored tables, file sinks, uploads, streams, marks and numbering against stated results and brute force."""
import io
import json
import random
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sievework.operators import marks, numbering, store
from sievework.sources import files, uploads
from sievework.streaming import asks

SCHEMA = "id string, title string, kept int, ats string"


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def kept(spark, tmp_path):
    out = store.Store(spark, str(tmp_path / "t"), SCHEMA, "id", "ats", 4)
    out.create(spark.createDataFrame([(f"{a}{i}", f"T{i}", i, a) for a in ("x", "y", "z") for i in range(40)], SCHEMA))
    return out


def test_an_upsert_rewrites_only_what_it_touches(spark, kept):
    before = _files(kept.path)
    source = spark.createDataFrame([("x1", None, "x"), ("x_new", "N", "x")], "id string, title string, ats string")
    folders = kept.touched(source)
    assert len(folders) <= 2
    plan = kept.within(folders)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*ats", plan) and re.search(r"PartitionFilters: \[[^\]]*key_bucket", plan)
    kept.upsert(source, ["title"])
    rows = {r.id: (r.title, r.kept, r.ats) for r in kept.read().collect()}
    assert len(rows) == 121 and rows["x1"] == (None, 1, "x") and rows["x_new"] == ("N", None, "x") and rows["y1"] == ("T1", 1, "y")
    after = _files(kept.path)
    stayed = {f for f in before if after.get(f) == before[f]}
    assert len(before) - len(stayed) == len(folders)


def test_a_sweep_behind_its_guard(spark, kept):
    before = _files(kept.path)
    assert not kept.delete(F.col("kept") < 20, F.col("ats") == "x") and _files(kept.path) == before
    answered = spark.createDataFrame([("x", True)], "ats string, answered boolean")
    assert kept.delete(F.col("answered") & (F.col("kept") < 5), F.col("ats") == "x", helper=answered, on="ats")
    assert kept.read().groupBy("ats").count().orderBy("ats").collect() == [("x", 35), ("y", 40), ("z", 40)]
    after = _files(kept.path)
    assert all(after[f] == t for f, t in before.items() if not f.startswith("ats=x"))


def test_whole_folders_go_and_a_truncated_table_stays(spark, kept):
    assert kept.delete(F.col("ats") == "z", F.lit(True), guard=0.5)
    assert {r.ats for r in kept.read().collect()} == {"x", "y"} and not list(Path(kept.path).glob("ats=z/*/*.parquet"))
    kept.truncate()
    assert kept.read().collect() == [] and kept.read().columns == ["id", "title", "kept", "ats"]
    kept.upsert(spark.createDataFrame([("a", "T", "x")], "id string, title string, ats string"), ["title"])
    assert [tuple(r) for r in kept.read().collect()] == [("a", "T", None, "x")]


def test_one_file_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "list.json")
    rows = spark.range(100).select(F.concat(F.lit('s"é'), F.col("id")).alias("s"))
    files.save(rows.orderBy("s"), path)
    expected = sorted(f's"é{i}' for i in range(100))
    assert json.loads(Path(path).read_text()) == expected
    bad = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("s"))
    with pytest.raises(Exception, match="broken"):
        files.save(bad, path)
    with pytest.raises(Exception, match="bytes for one file"):
        files.save(rows, path, limit=100)
    assert json.loads(Path(path).read_text()) == expected
    assert [p.name for p in tmp_path.iterdir()] == ["list.json"]
    files.save(rows.limit(0), path)
    assert Path(path).read_text() == "[]"
    files.save(spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"), path, "map")
    assert json.loads(Path(path).read_text()) == {"a": 1, "b": None}
    files.save(spark.createDataFrame([("a", 1)], "k string, v int"), path)
    assert json.loads(Path(path).read_text()) == [{"k": "a", "v": 1}]


def test_uploads(spark, tmp_path):
    folder = tmp_path / "up"
    texts = {"a.docx": "One\n\ttabbed < & >\n\n\n\nlast ", "b.DOCX": "x\x00y\x0b", "c.docx": "", "d.txt": "no", "e.pdf": "%PDF"}
    rows = spark.createDataFrame([(k, v) for k, v in texts.items() if k.lower().endswith("docx")], "name string, text string")
    assert uploads.write_word_files(rows, f"file://{folder}") == 3
    (folder / "d.txt").write_text("no")
    (folder / "e.pdf").write_text("%PDF")
    (folder / "broken.docx").write_bytes(b"PK not a zip")
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>split</w:t></w:r><w:r><w:t> run</w:t><w:br/><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (folder / "runs.doc").write_bytes(buffer.getvalue())
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.method) for r in uploads.extracted(uploads.read(spark, str(folder))).collect()}
    assert got == {
        # a PDF without pages cannot be read
        "a.docx": ("One\n\n\ttabbed < & >\n\nlast", "word"), "b.DOCX": ("xy", "word"), "c.docx": ("", "word"), "e.pdf": (None, "pdf"), "broken.docx": (None, "word"), "runs.doc": ("split run\ntwo", "word")}
    sizes = spark.createDataFrame([("x.docx", 10 * 2**20), ("x.docx", 10 * 2**20 + 1), ("x.docx.exe", 1), ("doc", 1), ("/a/b.Pdf", 0), (None, 1)], "p string, n long")
    assert [r[0] for r in sizes.select(uploads.taken(F.col("p"), F.col("n"))).collect()] == [True, False, False, False, True, False]


EVENTS = "user_id long, kind string, job_id long, company string, ts timestamp, micros long, seq long"


def _stream(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_asks_once_over_batches_and_replays(spark, tmp_path):
    from datetime import datetime, timezone

    rng = random.Random(8)
    rows, at = [], 1_700_000_000_000_000
    for seq in range(300):
        at += rng.choice([1, 5, 50]) * 60_000_000
        kind = rng.choice(["leave", "leave", "return", "return", "apply"])
        job = rng.randrange(6)
        rows.append((rng.randrange(4), kind, job, rng.choice([None, f"C{job}"]), datetime.fromtimestamp(at / 1e6, timezone.utc), at, seq))
    expected, states = [], {}
    for user, kind, job, company, _, when, _ in rows:  # a plain reading of the rule
        s = states.setdefault(user, {"left": {}, "names": {}, "asked": set(), "applied": set()})
        s["left"] = {j: t for j, t in s["left"].items() if when - t < asks.HOUR}
        s["names"] = {j: n for j, n in s["names"].items() if j in s["left"]}
        if kind == "leave":
            s["left"][job] = when
            if company:
                s["names"][job] = company
        elif kind == "apply":
            s["applied"].add(job)
        else:
            first = next((j for j in s["left"] if j not in s["asked"]), None)
            if first is not None and first not in s["applied"]:
                s["asked"].add(first)
                expected.append((user, first, s["names"].get(first, "this employer"), s["left"][first], when))
    stream = lambda: asks.asked(_stream(spark, tmp_path / "in", [], EVENTS))
    _stream(spark, tmp_path / "in", [rows[:120]], EVENTS)
    asks.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    _stream(spark, tmp_path / "in", [rows[120:200], rows[200:]], EVENTS)
    asks.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    again = asks.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "state"))  # nothing new: nothing twice
    assert sorted(tuple(r) for r in again.collect()) == sorted(expected) and expected


def test_the_cache_stream_equals_its_batch_form(spark, tmp_path):
    from datetime import datetime, timezone

    rng = random.Random(3)
    schema = "key string, kind string, value double, ts timestamp, micros long, seq long"
    rows, at = [], 1_700_000_000_000_000
    for seq in range(200):
        at += rng.randrange(1, 4) * asks.HOUR
        rows.append((rng.choice("abc"), rng.choice(["put", "get", "get", "get"]), float(seq), datetime.fromtimestamp(at / 1e6, timezone.utc), at, seq))
    ttl = 6 * asks.HOUR
    got = asks.run_to_end(asks.looked_up(_stream(spark, tmp_path / "in", [rows[:90], rows[90:]], schema), ttl), str(tmp_path / "out"), str(tmp_path / "state"))
    want = asks.looked_up_batch(spark.createDataFrame(rows, schema), ttl)
    plain = lambda df: sorted((r.key, r.seq, r.micros, r.answer, r.age) for r in df.select("key", "seq", "micros", "answer", "age").collect())
    assert [[None if v != v else v for v in r] for r in plain(got)] == [list(r) for r in plain(want)]
    assert {r.age is None for r in want.collect()} == {True, False}


@pytest.mark.parametrize(("text", "terms", "expected"), [
    ("Spark SQL and sql, spark", ["SQL", "spark", "Spark SQL"], [("Spark SQL", 1), ("sql", 15), ("spark", 20)]), ("aaa", ["a", "aa"], [("aa", 1), ("a", 3)]), ("C++ c++", ["C++"], [("C++", 1)]),
    ("nothing", ["x"], []), ("", ["x"], []), (None, ["x"], None), ("any", [], []), ("SQLSQL x", ["sql"], [("SQL", 1)]),
])
def test_claimed(spark, text, terms, expected):
    row = spark.createDataFrame([(text,)], "t string").select(marks.claimed(F.col("t"), terms).alias("c"), marks.marked(F.col("t"), marks.claimed(F.col("t"), terms), "[", "]").alias("m")).first()
    assert (None if row.c is None else [tuple(x) for x in row.c]) == expected
    if text:
        assert row.m.replace("[", "").replace("]", "") == text and row.m.count("[") == len(expected)


@pytest.mark.parametrize(("html", "expected"), [
    ("<h2 class=x>About&nbsp;us</h2><p>text</p><H4>More <i>yet</i></H4>", ["About us", "More yet"]), ("<p><strong>Your role</strong><br>&nbsp;</p><p><b>Half</b> bold</p>", ["Your role"]),
    ("<div><p><b>In</b> <strong>two</strong></p></div>", ["In two"]), (f"<p><b>{'x' * 121}</b></p><p><b>{'y' * 120}</b></p>", ["y" * 120]), ("<div><b>a</b><ul><li>b</li></ul></div>", []), ("<p></p><p><b></b></p>", []), ("plain", []), ("", []),
])
def test_headings(spark, html, expected):
    assert spark.createDataFrame([(html,)], "h string").select(marks.headings(F.col("h"))).first()[0] == expected


def test_tracking_tags_go(spark):
    df = spark.createDataFrame([("<p>a</p><p> #LI-JCS </p><span class='t'>#LI-Remote</span><p>#LI-x y</p>",)], "h string")
    assert df.select(marks.untracked(F.col("h"))).first()[0] == "<p>a</p><p>#LI-x y</p>"


def test_skills_block_and_roles(spark):
    text = "Jo\nSKILLS\nLanguages: SQL\n  Cloud and more: GCP\n\nEXPERIENCE\nAcme (2019 - 2021)\n- one\n  - two\nlower (2018)\n- three\nBeta (2015)\nno bullets"
    row = spark.createDataFrame([(text,), ("SKILLS\na, b\nEDUCATION\nx",), ("none",)], "t string").select(marks.skills_block(F.col("t")).alias("s"), marks.role_bullets(F.col("t")).alias("r")).collect()
    assert tuple(row[0].s) == ("Languages: SQL\n  Cloud and more: GCP", True, 2) and [tuple(x) for x in row[0].r] == [("Acme (2019 - 2021)", 3), ("Beta (2015)", 0)]
    assert tuple(row[1].s) == ("a, b", False, 0) and tuple(row[2].s) == ("", False, 0) and row[2].r == []


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(6)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = numbering.numbered(rows, [F.asc("v")])
        assert all(r.v == r.row_number for r in out.collect()) and out.count() == 1000
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    some = numbering.spread(spark.createDataFrame([(i, "a" if i % 7 else "b") for i in range(1, 60)] + [(100, "c")], "v int, g string"), [F.asc("v")], "g", most=2)
    assert sorted((r.v, r.g) for r in some.collect()) == [(1, "a"), (7, "b"), (8, "a"), (100, "c")] or sorted((r.v, r.g, r.row_number) for r in some.collect())


def test_rules_as_a_table(spark):
    table = spark.createDataFrame([(1, "^ab", "one"), (2, "b", "two"), (3, "zz", None)], "number int, pattern string, label string")
    got = {r.t: r.l for r in numbering.by_rules(spark.createDataFrame([("abc",), ("cb",), ("x",), ("abc",), (None,)], "t string"), "t", table, "l", "other").collect()}
    assert got == {"abc": "one", "cb": "two", "x": "other", None: "other"}


def test_a_stream_of_upserts_can_be_replayed(spark, tmp_path):
    from sievework.streaming import changes

    schema = "user_id long, part long, event_id long, event_type string"
    table = store.Store(spark, str(tmp_path / "t"), schema, "user_id", "part", 2)
    table.truncate()
    apply = changes.latest_into(table, "user_id", ["event_id"], ["event_id", "event_type"])
    batch = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 7, None), (2, 0, 6, "c")], schema)
    for number in (0, 0, 1):
        apply(batch, number)
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 1, 7, None), (2, 0, 6, "c")]
    src = tmp_path / "in"
    spark.createDataFrame([(2, 0, 9, "z"), (3, 0, 8, "n")], schema).write.parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    for _ in range(2):
        changes.upsert_batches(stream, apply, str(tmp_path / "c")).awaitTermination()
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, 1, 7, None), (2, 0, 9, "z"), (3, 0, 8, "n")]


def _pdf(objects, tail=b"trailer << /Root 1 0 R >>"):
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects.items()) + tail


def _content(content, head=b"", deflate=False):
    import zlib

    data = zlib.compress(content) if deflate else content
    return b"<< /Length %d %s%s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " if deflate else b"", head, data)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_uploads_are_listed_by_tasks(spark, tmp_path, scheme):
    """The driver has no name of a file in any frame's list; folders in folders, odd names and what readers pass over."""
    folder, size = f"{scheme}{tmp_path}/up", len(uploads.word_file("x"))
    names = [*(f"doc {i}.docx" for i in range(300)), "50%25 of it?.docx", "\u00e9#1.docx"]
    assert uploads.write_word_files(spark.createDataFrame([(n, f"text of {n}") for n in names], "name string, text string"), folder) == len(names)
    (deep := tmp_path / "up" / "a b" / "c").mkdir(parents=True)
    for name in ("deep.docx", "_half.docx", ".hidden.docx"):
        (deep / name).write_bytes(uploads.word_file("x"))
    (tmp_path / "up" / "_temporary").mkdir()
    (tmp_path / "up" / "_temporary" / "part.docx").write_bytes(b"")
    (tmp_path / "up" / "empty").mkdir()
    (tmp_path / "up" / "large.docx").write_bytes(bytes(uploads.LARGEST + 1))
    listed = uploads.read(spark, folder)
    assert not [x for x in listed.inputFiles() if "docx" in x]
    sizes = {r.path.removeprefix(f"{folder}/"): r.length for r in listed.select("path", "length").collect()}
    assert len(sizes) == len(names) + 2 and sizes["a b/c/deep.docx"] == size and sizes["large.docx"] == uploads.LARGEST + 1
    got = {r.path.rsplit("/", 1)[1]: r.text for r in uploads.extracted(listed).collect()}
    assert got == {n: f"text of {n}" for n in names} | {"deep.docx": "x"}
    (tmp_path / "none").mkdir()
    assert uploads.extracted(uploads.read(spark, f"{scheme}{tmp_path}/none")).collect() == []


def test_pdf_texts(spark):
    from sievework.sources import pdf

    plain = _pdf({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", 4: b"<< /Type /Page /Contents [5 0 R 7 0 R] >>",
        5: _content(rb"BT /F1 12 Tf 72 700 Td (Jo \(Doe\) \101) Tj 0 -14 Td (caf\351) Tj T* [(Da) 20 (ta) -300 (engineer)] TJ ET", deflate=True), 6: _content(b"BT (Page two) Tj (again) ' ET"), 7: _content(b"BT 1 0 0 1 72 500 Tm <48692E> Tj 1 0 0 1 90 500 Tm ( there) Tj 1 0 0 1 72 480 Tm (below) Tj ET")})
    assert pdf.pdf_text(plain) == ("Jo (Doe) A\ncaf\u00e9\nData engineer\nHi. there\nbelow\n\nPage two\nagain", 2)
    cmap = b"1 beginbfchar <0001> <0041> endbfchar 2 beginbfrange <0002> <0004> <0062> <0010> <0011> [<4E2D> <6587>] endbfrange"
    inner = b"2 0 3 34 " + b"<< /Type /Pages /Kids [4 0 R] >>  ".ljust(34) + b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>"
    mapped = _pdf({
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 4: b"<< /Type /Page /Resources << /Font << /F9 3 0 R >> >> /Contents 5 0 R >>", 5: _content(b"BT /F9 9 Tf <0001000200030004> Tj 0 -1 TD <00100011> Tj ET", deflate=True), 8: _content(cmap, deflate=True),
        9: _content(inner, b"/Type /ObjStm /N 2 /First 9", deflate=True)})
    assert pdf.pdf_text(mapped) == ("Abcd\n\u4e2d\u6587", 1)
    scan = _pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: _content(b"q 1 0 0 1 0 0 cm /Im1 Do Q")})
    assert pdf.pdf_text(scan) == ("", 1)
    rng = random.Random(0)
    broken = [b"", b"%PDF", plain[: len(plain) // 2], scan + b"trailer << /Encrypt 9 0 R >>", b"%PDF" + bytes(rng.randrange(256) for _ in range(3000)), plain.replace(b"Tj", b"T("), plain.replace(b"4 0 R", b"2 0 R")]
    rows = [(f"/{i}.pdf", len(x), x) for i, x in enumerate([plain, scan, *broken])]
    got = {r.path: (r.text, r.pages) for r in uploads.extracted(spark.createDataFrame(rows, "path string, length long, content binary")).collect()}
    assert len(got) == len(rows) and got["/0.pdf"][1] == 2 and got["/1.pdf"] == ("", 1) and got["/2.pdf"] == got["/3.pdf"] == got["/5.pdf"] == (None, None)


def test_intermediate_tables_go_when_told(spark):
    from sievework.operators import staging

    staging.discard(spark)
    place = Path(staging.folder(spark).removeprefix("file://"))
    before = set(place.glob("staged-*"))
    assert staging.written(spark.range(3)).count() == 3 and len(set(place.glob("staged-*")) - before) == 1
    assert staging.discard(spark) == 1 and set(place.glob("staged-*")) == before and staging.discard(spark) == 0
