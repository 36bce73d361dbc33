"""File-system sources and sinks: recursive scan, text decode, header bytes, ordered write.

Folders are listed and files are read in tasks, through the file system that the root's address
names (a plain path, file:, hdfs:, s3:, gs: ...), so names that start with ``.`` or ``_`` are kept
and nothing but the root is known to the driver.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.config import DEFAULT, Config
from quire.operators.corpus import compile_rule, rule_decision
from quire.session import cut_lineage

MAX_DEPTH = 100
HEAD = 65536

SCAN_SCHEMA = "path string, rel_path string, name string, kind string, size long, mtime timestamp, depth int"


def open_folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path inside it."""
    found, path = fs.FileSystem.from_uri(root.rstrip("/") if "://" in root or root.startswith("/") else root.replace("file:", "file://", 1))
    return found, path.rstrip("/")


def _list_folders(root: str):
    def run(it):
        store, base = open_folder(root)
        for pdf in it:
            rows = []
            for rel, depth in zip(pdf["rel_path"], pdf["depth"]):
                try:
                    found = store.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base))
                except OSError:  # a folder that cannot be listed
                    rows.append((f"{base}/{rel}", rel, os.path.basename(rel), "skipped", None, None, depth))
                    continue
                for i in found:
                    kind = {fs.FileType.File: "file", fs.FileType.Directory: "dir"}.get(i.type)
                    if kind:
                        rows.append((i.path, f"{rel}/{i.base_name}" if rel else i.base_name, i.base_name, kind,
                                     i.size if kind == "file" else None, i.mtime, depth + 1))
            yield pd.DataFrame(rows, columns=["path", "rel_path", "name", "kind", "size", "mtime", "depth"])
    return run


def corpus_scan(spark: SparkSession, root: str, rules: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """(path, rel_path, name, kind, size, mtime, depth): a row of kind ``file`` or
    ``dir`` for everything under ``root`` down to 100 levels, and of kind
    ``skipped`` for what the ignore ``rules`` hide (a hidden folder is not
    entered) and for folders that cannot be listed.  The ignore file itself has no
    row.  Folders are listed level by level, each level in parallel."""
    compiled = [c for c in (compile_rule(r) for r in rules or []) if c]
    level = spark.createDataFrame([("", 0)], "rel_path string, depth int")
    out = None
    while True:
        spread = level.repartition(max(1, min(level.count(), spark.sparkContext.defaultParallelism * 4)), "rel_path")
        found = spread.mapInPandas(_list_folders(root), SCAN_SCHEMA).where(F.col("name") != config.ignore_file_name)
        if compiled:
            hidden = F.coalesce(rule_decision(compiled, F.col("rel_path"), F.col("kind") == "dir"), F.lit(False))
            found = found.withColumn("kind", F.when(hidden, "skipped").otherwise(F.col("kind")))
        found = cut_lineage(found)
        out = found if out is None else out.unionByName(found)
        level = found.where((F.col("kind") == "dir") & (F.col("depth") < MAX_DEPTH)).select("rel_path", "depth")
        if level.isEmpty():
            return out


#: Bytes that a task holds of the files it reads before it passes them on.
READ_BYTES = 8 << 20


def _read(root: str, part):
    """Adds what ``part(file, size)`` reads of each file; one that cannot be read gives its error."""
    def run(it):
        store, _ = open_folder(root)
        for pdf in it:
            rows, held = [], 0
            for row in pdf.itertuples(index=False):
                try:
                    with store.open_input_file(row.path) as f:
                        columns, error = part(f, f.size()), None
                except OSError as e:
                    columns, error = part(None, 0), str(e)
                rows.append({**row._asdict(), **columns, "error": error})
                held += sum(map(len, columns.values()))
                if held >= READ_BYTES:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows)
    return run


def _ends(n):
    def part(f, size):
        if not f:
            return {"head": b"", "tail": b""}
        head = f.read_at(min(n, size), 0)
        return {"head": head, "tail": f.read_at(min(n, size), max(0, size - n))}
    return part


def _files(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'file'").select("path", "rel_path", "size").repartition("path")


#: Bytes of a file that one task reads as text.
SPLIT_BYTES = 8 << 20
#: Reading tasks for each core at most.
MOST_READERS = 64
#: Bytes that a reader fetches at once to end its last line.
AHEAD = 1 << 16

SPLIT_SCHEMA = "path string, rel_path string, size long, part int, parts int, begin long, stop long"


def file_splits(scanned: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, rel_path, size, part, parts, begin, stop): the files of a scan cut into byte ranges of ``split_bytes``, dealt over a
    task for each ``split_bytes`` of them, up to ``MOST_READERS`` for each core (a range's row is tiny and its reading is not, so the number is set)."""
    size = F.greatest(F.coalesce("size", F.lit(0)), F.lit(1))
    begins = F.sequence(F.lit(0).cast("long"), size - 1, F.lit(split_bytes).cast("long"))
    splits = (scanned.where("kind = 'file'").select("path", "rel_path", F.coalesce("size", F.lit(0)).alias("size"), F.posexplode(begins).alias("part", "begin"))
              .select("path", "rel_path", "size", "part", F.ceil(F.greatest("size", F.lit(1)) / split_bytes).cast("int").alias("parts"), "begin",
                      F.least("size", F.col("begin") + split_bytes).alias("stop")))
    ranges, total = scanned.where("kind = 'file'").agg(F.sum(F.ceil(size / split_bytes)), F.sum(size)).first()
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    tasks = min(int(ranges or 1), max(cores, -(-int(total or 1) // split_bytes)), MOST_READERS * cores)
    return splits.repartition(max(1, tasks), "path", "part")


def _continued(data: bytes) -> int:
    """How many of the first bytes belong to a character that began before them.  Only up to three can; a fourth byte
    of that kind, or one after another byte, stands alone in the whole text too."""
    n = 0
    while n < 3 and n < len(data) and data[n] & 0xC0 == 0x80:
        n += 1
    return n


def _fetch(f, begin: int, stop: int, size: int) -> bytes:
    return f.read_at(max(0, min(stop, size) - begin), begin) if begin < size else b""


def text_decode(scanned: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, rel_path, size, part, parts, text, head, error) of the files of a scan: UTF-8 with invalid sequences replaced,
    and the first 1 KiB (for the NUL sniff) with the first part.

    A file larger than ``split_bytes`` is several rows, read by several tasks, whose texts follow each other: a character that a
    border cuts belongs to the part in which it begins, so together they are the text of the whole file.  A file that cannot
    be read has one part, size 0 and an error line as its text."""
    def run(it):
        store, _ = open_folder(root)
        for pdf in it:
            for row in pdf.itertuples(index=False):
                text, head, error, size = None, None, None, row.size
                try:
                    with store.open_input_file(row.path) as f:
                        end = f.size() if row.part + 1 == row.parts else row.stop
                        data = _fetch(f, row.begin, end + 3, f.size())
                        skip = _continued(data) if row.part else 0
                        inside = max(0, end - row.begin)
                        text = data[skip:inside + _continued(data[inside:])].decode("utf-8", "replace")
                        head = data[:1024] if row.part == 0 else None
                except OSError as e:
                    if row.part:
                        continue
                    text, head, error, size = f"// Error reading file: {e}", b"", str(e), 0
                yield pd.DataFrame([(row.path, row.rel_path, size, row.part, 1 if error else row.parts, text, head, error)],
                                   columns=["path", "rel_path", "size", "part", "parts", "text", "head", "error"])

    return file_splits(scanned, split_bytes).mapInPandas(run, "path string, rel_path string, size long, part int, parts int, text string, head binary, error string")


def text_lines(scanned: DataFrame, root: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, rel_path, size, line_no, text): every line of the files of a scan, numbered from 1, as splitting the whole text at
    newlines gives them (an empty file has one empty line, text that ends with a newline an empty last one).

    Files are read by ranges.  A first pass counts each range's newlines, so a line's number needs no window over lines; a range then owns
    the lines that begin after its newlines (the first range also the first line) and reads on until its last line ends.
    A file that cannot be read has its error as only line."""
    def opened(count):
        def run(it):
            store, _ = open_folder(root)
            for pdf in it:
                for row in pdf.itertuples(index=False):
                    try:
                        with store.open_input_file(row.path) as f:
                            yield count(row, f, f.size())
                    except OSError as e:
                        yield count(row, None, e)
        return run

    def newlines(row, f, size):
        n = _fetch(f, row.begin, size if row.part + 1 == row.parts else row.stop, size).count(b"\n") if f else 0
        return pd.DataFrame([(row.path, row.part, n)], columns=["path", "part", "n"])

    def lines(row, f, size):
        columns = ["path", "rel_path", "size", "line_no", "text"]
        if f is None:
            return pd.DataFrame([(row.path, row.rel_path, 0, 1, f"// Error reading file: {size}")] if row.part == 0 else [], columns=columns)
        last = row.part + 1 == row.parts
        data = _fetch(f, row.begin, size if last else row.stop, size)
        number = row.before + 1
        if row.part:  # from the first newline on
            at = data.find(b"\n")
            if at < 0:
                return pd.DataFrame([], columns=columns)
            data, number = data[at + 1:], number + 1
        ahead = row.stop
        while not last and ahead < size:
            more = _fetch(f, ahead, ahead + AHEAD, size)
            ahead += len(more)
            at = more.find(b"\n")
            data += more if at < 0 else more[:at]
            if at >= 0:
                break
        texts = data.decode("utf-8", "replace").split("\n")
        return pd.DataFrame({"path": row.path, "rel_path": row.rel_path, "size": row.size, "line_no": range(number, number + len(texts)), "text": texts})

    splits = file_splits(scanned, split_bytes)
    counts = cut_lineage(splits.mapInPandas(opened(newlines), "path string, part int, n long"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("part")) - F.col("n")
    n = splits.rdd.getNumPartitions()
    numbered = splits.join(counts.select("path", "part", before.alias("before")), ["path", "part"]).repartition(n, "path", "part")
    return numbered.mapInPandas(opened(lines), "path string, rel_path string, size long, line_no long, text string")


def lines_digest(line_no, text):
    """A number for each numbered line; the sum over the lines of a text tells whether all lines are the same and in the
    same order, and can be added up in any order."""
    return F.conv(F.substring(F.md5(F.concat(line_no.cast("string"), F.lit(":"), text).cast("binary")), 1, 8), 16, 10).cast("long")


def head_tail(scanned: DataFrame, root: str, n: int = HEAD) -> DataFrame:
    """(path, size, head, tail): only the first and last ``n`` bytes are read."""
    return _files(scanned).mapInPandas(_read(root, _ends(n)), "path string, rel_path string, size long, head binary, tail binary, error string")


def materialise(files: DataFrame, root: str) -> None:
    """Writes ``files(path, content)`` under ``root`` (a shared folder), one file
    per row, from the executors (stand-in corpus for scan tests)."""
    def write(it):
        store, base = open_folder(root)
        for pdf in it:
            for p, c in zip(pdf["path"], pdf["content"]):
                store.create_dir(os.path.dirname(f"{base}/{p}"), recursive=True)
                with store.open_output_stream(f"{base}/{p}") as f:
                    f.write(c if isinstance(c, (bytes, bytearray)) else str(c or "").encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})
    files.select("path", "content").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()


#: Fixed value: the file name of a context unless another is given.
DEFAULT_NAME = "ai-context.md"

MANIFEST = "project string, part int, file string, first_seq string, last_seq string, rows long, bytes long, sha256 string"


def clean_name(name: str | None) -> str:
    """The base name that a context is written under: trimmed, without folders; the default where nothing usable is left."""
    base = os.path.basename(((name or "").strip() or DEFAULT_NAME).rstrip("/"))
    return base if base and base not in (".", "..") else DEFAULT_NAME


def write_context(doc_rows: DataFrame, out_dir: str, name: str | None = None, overwrite: bool = False, partitions: int | None = None) -> DataFrame:
    """Writes each project's document as ordered parts below ``out_dir/<clean name>/`` and returns the manifest
    (project, part, file, first_seq, last_seq, rows, bytes, sha256), whose writing is the commit.

    ``doc_rows(project, seq, text)`` are range-partitioned on (project, seq) and sorted; a task writes one file for each
    project in its range, under a name of its own attempt, and reports it.  Only the files of attempts whose
    report Spark commits are in the manifest, so a retried or speculative task leaves at most a file that no one reads.  An existing context of
    that name is an error unless ``overwrite``; then the new manifest replaces the old one at the end."""
    spark = doc_rows.sparkSession
    store, base = open_folder(out_dir)
    target = f"{base}/{clean_name(name)}"
    if store.get_file_info(f"{target}/manifest").type != fs.FileType.NotFound and not overwrite:
        raise FileExistsError(f"{target} exists; pass overwrite=True to replace it")
    run_id = uuid.uuid4().hex
    columns = [c.split()[0] for c in MANIFEST.split(", ")]

    def write(it):
        out, project, state = open_folder(out_dir)[0], None, None
        part = TaskContext.get().partitionId()

        def closed():
            state["f"].close()
            return pd.DataFrame([(project, part, state["file"], state["first"], state["last"], state["rows"], state["bytes"], state["sha"].hexdigest())], columns=columns)

        for pdf in it:
            for p, seq, text in zip(pdf["project"], pdf["seq"], pdf["text"]):
                if state is None or p != project:
                    if state is not None:
                        yield closed()
                    project, folder = p, f"parts/{run_id}/{hashlib.sha256(p.encode()).hexdigest()[:16]}"
                    out.create_dir(f"{target}/{folder}", recursive=True)
                    file = f"{folder}/{part:06d}-{TaskContext.get().taskAttemptId()}.txt"
                    state = {"f": out.open_output_stream(f"{target}/{file}"), "file": file, "first": seq, "rows": 0, "bytes": 0, "sha": hashlib.sha256()}
                data = text.encode()
                state["f"].write(data)
                state["sha"].update(data)
                state["last"], state["rows"], state["bytes"] = seq, state["rows"] + 1, state["bytes"] + len(data)
        if state is not None:
            yield closed()

    n = partitions or spark.sparkContext.defaultParallelism
    laid = doc_rows.select("project", "seq", "text").repartitionByRange(n, "project", "seq").sortWithinPartitions("project", "seq")
    report = laid.select("project", F.to_json(F.struct("seq")).alias("seq"), "text").mapInPandas(write, MANIFEST)
    place = f"{out_dir.rstrip('/')}/{clean_name(name)}/manifest"
    report.write.mode("overwrite").parquet(place)
    return spark.read.schema(MANIFEST).parquet(place)


def read_context(spark: SparkSession, out_dir: str, name: str | None = None) -> DataFrame:
    """(project, part, text) of a written context: each part as the manifest names it; one whose bytes are not those that
    were written is an error.  The texts of a project in the order of parts are its document."""
    address = f"{out_dir.rstrip('/')}/{clean_name(name)}"
    manifest = spark.read.schema(MANIFEST).parquet(f"{address}/manifest")

    def read(it):
        store, base = open_folder(address)
        for pdf in it:
            for row in pdf.itertuples(index=False):
                with store.open_input_file(f"{base}/{row.file}") as f:
                    data = f.read()
                if hashlib.sha256(data).hexdigest() != row.sha256:
                    raise ValueError(f"{row.file} is not what was written")
                yield pd.DataFrame([(row.project, row.part, data.decode())], columns=["project", "part", "text"])

    return manifest.repartition(spark.sparkContext.defaultParallelism, "file").mapInPandas(read, "project string, part int, text string")


def numbered_lines(parts: DataFrame) -> DataFrame:
    """(project, line_no, text) of the parts of ``read_context``: a line's number follows from the newlines of the parts
    before; only a line that goes on in the next part is put together from its pieces."""
    sizes = parts.select("project", "part", F.regexp_count("text", F.lit("\n")).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("project").orderBy("part")) - F.col("n")
    numbered = parts.join(sizes.select("project", "part", before.alias("before"), "n"), ["project", "part"])
    lines = (numbered.select("project", "part", "before", "n", F.posexplode(F.split("text", "\n", -1)).alias("k", "text"))
             .withColumn("line_no", F.col("before") + F.col("k") + 1).withColumn("border", (F.col("k") == 0) | (F.col("k") == F.col("n"))))
    pieces = F.array_sort(F.collect_list(F.struct("part", "k", "text")))
    joined = lines.where("border").groupBy("project", "line_no").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    return lines.where("NOT border").select("project", "line_no", "text").unionByName(joined)
