"""Reading files by ranges, and the committed parts of a context."""

import random

import pytest
from pyspark.sql import functions as F

from quire.sources import files as FS


def _content(rng, size):
    """Text with characters of every width, cut and stray bytes, long lines and empty ones."""
    pieces = [b"plain words ", "é".encode(), "漢字".encode(), "😀".encode(), b"\xff", b"\xf0\x9f\x98", b"\x80\x80\x80\x80\x80", b"\xe2\x82", b"\n", b"\n\n", b"\r\n", b"x" * 150, b"\xed\xa0\x80", b"\x00"]
    out = b""
    while len(out) < size:
        out += rng.choice(pieces)
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 1000])
def test_ranges_together_are_the_whole_text(spark, tmp_path, split):
    rng = random.Random(split)
    contents = {"a.txt": _content(rng, 40 * split + 13), "empty.txt": b"", "ends.txt": b"one\ntwo\n", "one_line.txt": b"y" * (3 * split + 1),
                "newlines.txt": b"\n" * (2 * split), "wide.txt": "😀".encode() * (split + 3)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    scanned = FS.corpus_scan(spark, str(tmp_path))
    parts = FS.text_decode(scanned, str(tmp_path), split)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: (r.rel_path, r.part)):
        texts.setdefault(r.rel_path, []).append(r)
    for name, data in contents.items():
        rows = texts[name]
        assert "".join(r.text for r in rows) == data.decode("utf-8", "replace")
        assert [r.part for r in rows] == list(range(rows[0].parts)) and len(rows) == max(1, -(-len(data) // split))
        assert bytes(rows[0].head) == data[:1024][:max(split + 3, 0)] or len(rows) == 1
    lines = {}
    for r in sorted(FS.text_lines(scanned, str(tmp_path), split).collect(), key=lambda r: r.line_no):
        assert r.line_no == len(lines.setdefault(r.rel_path, [])) + 1
        lines[r.rel_path].append(r.text)
    assert lines == {name: data.decode("utf-8", "replace").split("\n") for name, data in contents.items()}


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    line = b"2024-01-01T00:00:00 INFO request handled in 12 ms by worker 3 \xc3\xa9\n"
    (tmp_path / "big.log").write_bytes(line * 300_000)
    scanned = FS.corpus_scan(spark, str(tmp_path))
    read = FS.text_lines(scanned, str(tmp_path), 1 << 20).withColumn("task", F.spark_partition_id())
    got = read.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("task").alias("tasks"), F.countDistinct("line_no").alias("numbers")).first()
    assert (got.n, got.chars, got.numbers) == (300_001, 300_000 * (len(line.decode()) - 1), 300_001) and got.tasks >= 10


def test_unreadable_files_have_an_error_line(spark, tmp_path):
    scanned = spark.createDataFrame([(str(tmp_path / "gone"), "gone", "gone", "file", 30, None, 1)], FS.SCAN_SCHEMA)
    rows = FS.text_lines(scanned, str(tmp_path), 8).collect()
    assert [(r.line_no, r.size) for r in rows] == [(1, 0)] and rows[0].text.startswith("// Error reading file: ")
    parts = FS.text_decode(scanned, str(tmp_path), 8).collect()
    assert [(r.part, r.parts, r.size) for r in parts] == [(0, 1, 0)] and parts[0].error


def test_names_of_a_context():
    cases = {None: "ai-context.md", "": "ai-context.md", "  ": "ai-context.md", " notes.md ": "notes.md", "../../etc/x.md": "x.md", "/a/b/": "b", ".": "ai-context.md", "a/..": "ai-context.md"}
    assert {k: FS.clean_name(k) for k in cases} == cases


def test_a_context_is_committed_by_its_manifest(spark, tmp_path):
    rows = [(p, i, f"{p} row {i}" + ("\n" if i % 3 else "") + ("\n\nx" if i % 5 == 0 else "")) for p in ("a", "b/c", "ü") for i in range(200)]
    doc = spark.createDataFrame(rows, "project string, seq long, text string").repartition(7)
    want = {p: "".join(t for q, _, t in rows if q == p) for p in ("a", "b/c", "ü")}
    manifest = FS.write_context(doc, str(tmp_path), "../x/out.md", partitions=5).collect()
    assert (tmp_path / "out.md" / "manifest").is_dir() and sum(r.rows for r in manifest) == 600

    def read():
        got = {}
        for r in sorted(FS.read_context(spark, str(tmp_path), "out.md").collect(), key=lambda r: r.part):
            got[r.project] = got.get(r.project, "") + r.text
        return got

    assert read() == want
    lines = {}
    for r in sorted(FS.numbered_lines(FS.read_context(spark, str(tmp_path), "out.md")).collect(), key=lambda r: r.line_no):
        lines.setdefault(r.project, []).append(r.text)
    assert lines == {p: t.split("\n") for p, t in want.items()}
    with pytest.raises(FileExistsError):
        FS.write_context(doc, str(tmp_path), "out.md")
    assert read() == want
    FS.write_context(doc.where("seq < 3"), str(tmp_path), "out.md", overwrite=True)
    assert read() == {p: "".join(t for q, i, t in rows if q == p and i < 3) for p in want}
    part = next(iter(spark.read.schema(FS.MANIFEST).parquet(str(tmp_path / "out.md" / "manifest")).collect()))
    (tmp_path / "out.md" / part.file).write_text("changed")
    with pytest.raises(Exception, match="not what was written"):
        read()
