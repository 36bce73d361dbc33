"""The whole context: one block for every file that the ignore rules leave, by its route.

``files(project, path, rel_path, size, content)`` are classified once and written by route, so each
kind of block reads its own files only.  Each kind is a job of its own that writes its blocks, as a plan of all
kinds at once does not fit a small driver.  Blocks and tree lines are ordered rows, as in ``render``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.config import DEFAULT, WARNING_EMOJI, Config
from quire.functions.text import explode_lines, format_size, rank_within
from quire.operators import code as CO
from quire.operators import configs as K
from quire.operators import corpus as C
from quire.operators import render as R
from quire.operators import tree as T
from quire.session import written


def kept_files(files: DataFrame, rules: list[str]) -> DataFrame:
    """The files that neither the rules nor one of their folders hides."""
    return C.ignore_filter(files, rules).where(~F.col("ignored")).drop("ignored")


def by_route(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The classified files, written once with a folder for each route."""
    return written(C.classify(files, config), "route")


def _titled(blocks: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Blocks whose header names the key, with the file's relative path instead."""
    b = blocks.select(F.col(key).alias("path"), F.col("text"))
    j = b.join(files.select("path", "rel_path"), "path")
    return j.select("path", F.concat(F.lit("// File: "), F.col("rel_path"), F.expr("substring(text, 10 + length(path), length(text))")).alias("text"))


def file_blocks(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(project, path, block): exactly one block for each file."""
    return routed_blocks(by_route(files, config), config)


def routed_blocks(routed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The blocks of files that ``by_route`` has written."""
    def of(*routes: str) -> DataFrame:
        # dealt by path, so what a renderer groups by file and joins by file needs no other exchange
        return routed.where(F.col("route").isin(*routes)).repartition("path")

    def as_docs(f: DataFrame, key: str = "path") -> DataFrame:
        return f.select(F.col(key).alias("doc_id"), C.basename(F.col("rel_path")).alias("name"), "size", F.coalesce("content", F.lit("")).alias("text"))

    def lines(f: DataFrame) -> DataFrame:
        return explode_lines(f.select("path", F.coalesce("language", F.lit("text")).alias("language"), "content"), "content")

    t, fmt, mime = C.media_type(F.col("path"))
    details = F.filter(F.array(F.when(mime.isNotNull(), F.concat(F.lit("MIME: "), mime))), lambda x: x.isNotNull())
    plain = of("full", "binary").select("path", F.when(F.col("is_binary"), R.binary_block(C.basename(F.col("rel_path")), t, fmt, details)).otherwise(
        R.file_block(F.col("rel_path"), F.col("size"), F.col("language"), F.col("content"), F.col("is_truncated"), config)).alias("text"))
    outs = [plain]
    logs, tables, docs = of("summary:log"), of("summary:csv"), of("summary:doc")
    outs.append(written(_titled(R.render_log_summary(lines(logs), config), logs)))
    outs.append(written(_titled(R.render_csv_summary(lines(tables).select("path", "line_no", "text"), config), tables)))
    outs.append(written(_titled(R.render_doc_summary(as_docs(docs), config), docs, "doc_id")))
    settings = of("summary:config")
    json, others = (settings.where(c) for c in (F.lower("rel_path").endswith(".json"), ~F.lower("rel_path").endswith(".json")))
    outs.append(written(_titled(R.render_json_summary(json.select("path", "content"), config), json)))
    keys = K.order_keys(K.yaml_flat_keys(lines(others).select("path", "line_no", "text"), config))
    outs.append(written(_titled(R.render_yaml_summary(keys, config), others)))
    # the summariser's documents have numbers: a hash of the path stands for it
    pdf, word = (of(r).withColumn("number", F.xxhash64("path")).repartition("number") for r in ("summary:pdf", "summary:word"))
    paged = as_docs(pdf, "number").withColumn("n_pages", (1 + F.floor(F.length("text") / 1500)).cast("int"))
    for render, of_docs, those in ((R.render_pdf_summary, paged, pdf), (R.render_word_summary, as_docs(word, "number"), word)):
        j = render(of_docs, config).join(those.select(F.col("number").alias("doc_id"), "path", "rel_path", F.length(C.basename(F.col("rel_path"))).alias("skip")), "doc_id")
        outs.append(written(j.select("path", F.concat(F.lit("// File: "), "rel_path", F.expr("substring(text, 10 + skip, length(text))")).alias("text"))))
    generic = of("summary:generic", "summary:excel", "summary:pptx")
    is_code = C.is_code_file(F.col("path"))
    outs.append(written(R.render_text_summary(generic.where(~is_code), config)))
    outs.append(written(R.render_code_summary(generic.where(is_code))))
    symbols = of("outline")
    head = F.concat(F.lit("// File: "), F.col("rel_path"), F.lit(f" ({WARNING_EMOJI} Overview — "), format_size(F.col("size")),
                    F.lit(", structure outline)\n// Language: "), F.coalesce("language", F.lit("text")), F.lit("\n\n"))
    outline, summary = written(R.render_outline(lines(symbols), config)), written(R.render_code_summary(symbols))
    choice = CO.outline_choose(
        outline.select("path", F.lit(1).alias("priority"), F.lit("outline").alias("source"), "text")
        .unionByName(summary.select("path", F.lit(2).alias("priority"), F.lit("summary").alias("source"), "text")))
    outs.append(written(choice.join(symbols.select("path", head.alias("head")), "path").select(
        "path", F.when(F.col("source") == "outline", F.concat("head", "text")).otherwise(F.col("text")).alias("text"))))
    made = reduce(DataFrame.unionByName, outs)
    # a file of which a renderer has nothing to tell still gets its header
    every = routed.select("project", "path", F.concat(F.lit("// File: "), F.col("rel_path"), F.lit(" ("), format_size(F.col("size")), F.lit(")\n")).alias("bare"))
    return every.join(made, "path", "left").select("project", "path", F.coalesce("text", "bare").alias("block"))


def whole_context(files: DataFrame, rules: list[str], config: Config = DEFAULT) -> DataFrame:
    """(project, seq, text): the tree and a block of every file that is left, as ordered rows."""
    routed = by_route(kept_files(files, rules), config)
    rank = rank_within(routed.select("project", "rel_path", "path"), "project", [F.col("rel_path")])
    tree = rank_within(T.dir_tree(rank), "project", [F.col("ord_key")], name="ord").select("project", "ord", "line")
    blocks = routed_blocks(routed, config).join(rank.select("path", "rank"), "path")
    return R.assemble(tree, blocks.select("project", "rank", "block"))
