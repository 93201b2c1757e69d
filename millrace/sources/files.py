"""Documents from raw files: listing, routing by extension, TXT, DOCX and PDF readers.

Tasks list the folders (a Python data source) and read the bytes of the files
that are asked for; no path goes through the driver but those of the folders
right below the root. A file that cannot be read becomes a row with its error
and no blocks; it never stops a run.
"""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs as storage
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions import tables, text

# Fixed values.
EXTENSIONS = (".pdf", ".docx", ".txt")
PAGE_CHARS = 1500
HINT_CHARS = 2000

BLOCKS = "array<struct<kind: string, content: string, page: int>>"
RAW = "struct<ok: boolean, error: string, total_pages: int, parts: array<struct<kind: string, content: string, cells: array<array<string>>, page: int>>>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

#: Readers of file bytes: (total pages, [(kind, content or None, cells or None, page)]).
Reader = Callable[[bytes], tuple[int, list[tuple]]]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def _opened(root: str) -> tuple[storage.FileSystem, str, str]:
    """The file system of a folder, the folder in it, and what stands before such paths in source_path."""
    plain = re.sub("^file:/+", "/", root).rstrip("/")
    if "://" not in plain:
        return storage.LocalFileSystem(), os.path.abspath(plain), "file:"
    system, at = storage.FileSystem.from_uri(plain)
    return system, at.rstrip("/"), plain.removesuffix(at.rstrip("/"))


class _ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def _below(self, folder: str, deep: bool) -> list[storage.FileInfo]:
        system, at, _ = _opened(self.root)
        # Names that Spark takes for hidden are passed over.
        shown = lambda path: not any(n.startswith(".") or (n.startswith("_") and "=" not in n) for n in path[len(at) :].split("/"))
        return [i for i in system.get_file_info(storage.FileSelector(folder, recursive=deep)) if shown(i.path)]

    def partitions(self) -> list[InputPartition]:
        at = _opened(self.root)[1]
        folders = sorted(i.path for i in self._below(at, False) if i.type == storage.FileType.Directory)
        return [InputPartition((at, False)), *(InputPartition((f, True)) for f in folders)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        prefix = _opened(self.root)[2]
        for i in self._below(*partition.value):
            if i.type == storage.FileType.File:
                yield prefix + i.path, i.size, i.mtime_ns


class FileListing(DataSource):
    """Files below a folder with length and time of change (nanoseconds): a task for each folder right below it."""

    @classmethod
    def name(cls) -> str:
        return "millrace_files"

    def schema(self) -> str:
        return "source_path string, length long, modified long"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"])


def listing(spark: SparkSession, raw_dir: str) -> DataFrame:
    """source_path, length, modified of every supported file below raw_dir; no file is opened."""
    spark.dataSource.register(FileListing)
    found = spark.read.format(FileListing.name()).load(raw_dir)
    return found.where(extension(F.col("source_path")).isin(*EXTENSIONS))


#: Bytes that a task reads, and that it gives on at a time, about.
TASK, BATCH = 16 << 20, 4 << 20


def _bytes(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _, prefix = _opened(root)
        out, held = [], 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], ["source_path", "content"])

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            try:
                with system.open_input_stream(path.removeprefix(prefix)) as f:
                    data = f.read()
            except OSError:
                data = None
            if out and held + len(data or b"") > BATCH:
                yield given()
                out, held = [], 0
            out.append((path, data))
            held += len(data or b"")
        if out:
            yield given()

    return run


def read(listed: DataFrame, raw_dir: str) -> DataFrame:
    """source_path, content, file_hash of listed files, each read whole in one task.

    What can't be read has null content and an empty hash. Files are dealt out by
    number; there are as many tasks as their bytes ask for, or cores.
    """
    total = listed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, total // TASK + 1)
    rows = listed.select("source_path").repartition(tasks).mapInArrow(_bytes(raw_dir), "source_path string, content binary")
    return rows.select("source_path", "content", F.coalesce(F.sha2("content", 256), F.lit("")).alias("file_hash"))


def put(rows: DataFrame, raw_dir: str) -> None:
    """Writes rows (path below raw_dir, content binary) as files, each whole by one task; null content removes the file.

    A task that runs again writes the same bytes over what it wrote.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at, _ = _opened(raw_dir)
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                full = f"{at}/{path}"
                if data is not None:
                    system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                    with system.open_output_stream(full) as f:
                        f.write(data)
                elif system.get_file_info(full).type == storage.FileType.File:
                    system.delete_file(full)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    rows.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def scan(spark: SparkSession, raw_dir: str) -> DataFrame:
    """source_path, content, file_hash of every supported file below raw_dir, empty files too."""
    return read(listing(spark, raw_dir), raw_dir)


def grouped_paragraphs(paragraphs: Sequence[str], limit: int = PAGE_CHARS) -> list[tuple[str, int]]:
    """Paragraphs joined until they reach the limit, with an approximate page each."""
    groups, run, size, total = [], [], 0, 0
    for p in filter(None, (q.strip() for q in paragraphs)):
        run.append(p)
        size += len(p) + 1
        total += len(p) + 1
        if size >= limit:
            groups.append(("\n".join(run), max(1, total // limit)))
            run, size = [], 0
    if run:
        groups.append(("\n".join(run), max(1, total // limit)))
    return groups


def read_docx(data: bytes) -> tuple[int, list[tuple]]:
    """Grouped paragraphs, then all tables on the last text page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def joined(node) -> str:
        return "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in node.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    texts = [("text", t, None, page) for t, page in grouped_paragraphs([joined(p) for p in body.findall(f"{_W}p")])]
    last = max((x[3] for x in texts), default=1)
    cells = [[["\n".join(joined(p) for p in c.findall(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    return last, texts + [("table", None, c, last) for c in cells]


def read_txt(data: bytes) -> tuple[int, list[tuple]]:
    return 1, [("text", data.decode("utf-8", "replace"), None, 1)]


def outside(chars: DataFrame, boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """The characters that lie fully inside no box of their page.

    chars: doc, page, x0, x1, top, bottom and more; boxes: the same corners. The join
    is on cells of a grid, so a dense page is many keys: a box lies in the cells
    that it touches, a character in that of its first corner, and the corners are
    compared after. Boxes are sorted by size into grids, each four times as wide as
    the one before, so none touches more than 25 cells; there are as many
    joins as grids in use, a handful. Corners are in order (x0 <= x1, top <= bottom);
    a box with other or unknown corners holds nothing.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"))
    sized = boxes.where("x0 <= x1 and top <= bottom").withColumn("_grid", F.greatest(F.lit(0), F.ceil(F.log(size / cell) / F.log(F.lit(4.0)))).cast("int")).na.fill(0, ["_grid"])
    out = chars
    for grid in sorted(r["_grid"] for r in sized.select("_grid").distinct().collect()):
        wide = cell * 4.0**grid

        def at(c: Column, wide=wide) -> Column:
            return F.floor(c / wide)

        own = sized.where(F.col("_grid") == grid).select("doc", "page", "x0", "x1", "top", "bottom", F.explode(F.sequence(at(F.col("x0")), at(F.col("x1")))).alias("_cx"))
        own = own.select("*", F.explode(F.sequence(at(F.col("top")), at(F.col("bottom")))).alias("_cy")).alias("b")
        c = out.alias("c")
        on = [F.col("c.doc") == F.col("b.doc"), F.col("c.page") == F.col("b.page"), at(F.col("c.x0")) == F.col("b._cx"), at(F.col("c.top")) == F.col("b._cy")]
        on += [F.col("c.x0") >= F.col("b.x0"), F.col("c.x1") <= F.col("b.x1"), F.col("c.top") >= F.col("b.top"), F.col("c.bottom") <= F.col("b.bottom")]
        out = c.join(own, reduce(lambda x, y: x & y, on), "left_anti")
    return out


def read_pdf(data: bytes) -> tuple[int, list[tuple]]:
    """Per page the text outside tables, then the tables; needs the optional pdfplumber."""
    import pdfplumber

    parts = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            found = [(t.bbox, t.extract()) for t in page.find_tables()]
            kept = [(box, cells) for box, cells in found if _is_table(cells)]
            free = page.filter(lambda o, kept=kept: o.get("object_type") != "char" or not any(o["x0"] >= b[0] and o["x1"] <= b[2] and o["top"] >= b[1] and o["bottom"] <= b[3] for b, _ in kept))
            parts.append(("text", free.extract_text() or "", None, n))
            parts += [("table", None, cells, n) for _, cells in kept]
        return len(pdf.pages), parts


def _is_table(cells: list[list]) -> bool:
    filled = [[c.strip() for c in r if c and c.strip()] for r in cells]
    sizes = [len(c) for r in filled for c in r]
    return len(cells) >= 2 and max(map(len, cells)) >= 2 and sum(len(r) >= 2 for r in filled) >= 2 and max(sizes) <= 300 and sum(sizes) <= 80 * len(sizes)


READERS: dict[str, Reader] = {".txt": read_txt, ".docx": read_docx, ".pdf": read_pdf}


def _parsed(ext: Column, content: Column, readers: dict[str, Reader]) -> Column:
    @F.pandas_udf(RAW)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for exts, contents in batches:
            rows = []
            for e, c in zip(exts, contents, strict=True):
                try:
                    if e not in readers:
                        raise ValueError(f"no reader for {e!r}")
                    if c is None:
                        raise OSError("the file could not be read")
                    pages, parts = readers[e](c)
                    rows.append((True, None, pages, [{"kind": k, "content": t, "cells": cells, "page": p} for k, t, cells, p in parts]))
                except Exception as error:
                    rows.append((False, f"{type(error).__name__}: {error}"[:500], 0, []))
            yield pd.DataFrame(rows, columns=["ok", "error", "total_pages", "parts"])

    return run(ext, content)


def load(files: DataFrame, latin: bool = True, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Documents of a scan: source_path, filename, file_hash, blocks, total_pages, language_hint, error."""
    ext = extension(F.col("source_path"))
    rows = files.select("source_path", F.element_at(F.split("source_path", "/"), -1).alias("filename"), "file_hash", ext.alias("_e"), _parsed(ext, F.col("content"), readers or READERS).alias("_r"))
    parts = rows.select("source_path", "filename", "file_hash", "_e", "_r.error", "_r.total_pages", F.posexplode_outer("_r.parts").alias("_i", "_p"))
    made = text.normalize(F.when(F.col("_p.kind") == "table", tables.to_markdown(F.col("_p.cells"))).otherwise(F.col("_p.content")), latin)
    parts = parts.withColumn("_n", made).withColumn("_b", F.when(F.col("_n.text") != "", F.struct(F.col("_p.kind").alias("kind"), F.col("_n.text").alias("content"), F.col("_p.page").alias("page"))))
    # One document's blocks gather in one row, as its bytes did.
    docs = parts.groupBy("source_path", "filename", "file_hash", "_e", "error", "total_pages").agg(
        F.sort_array(F.collect_list(F.when(F.col("_b").isNotNull(), F.struct("_i", "_b", F.col("_n.hint").alias("hint"))))).alias("_all")
    )
    docs = docs.withColumn("blocks", F.transform("_all", lambda x: x["_b"]).cast(BLOCKS))
    first = F.substring(F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: b["content"]), "\n"), 1, HINT_CHARS)
    whole = F.when(F.col("_e") == ".txt", F.coalesce(F.get("_all", 0)["hint"], F.lit("mixed"))).otherwise(text.detect_script(first))
    return docs.select("source_path", "filename", "file_hash", "blocks", "total_pages", whole.alias("language_hint"), "error")


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row per block, numbered from 0."""
    return docs.select("source_path", "filename", "file_hash", "language_hint", F.posexplode("blocks").alias("block_idx", "_b")).select("*", "_b.kind", "_b.content", "_b.page").drop("_b")


def relative(path: Column, raw_dir: str) -> Column:
    return F.regexp_replace(path, "^(file:)?/*" + re.escape(re.sub("^file:/+", "", raw_dir).strip("/")) + "/", "")
