"""Report files: which reader a path belongs to, whole texts, and the slot for outside extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ["jpg", "jpeg", "png", "webp", "heic", "tiff", "bmp"]
TEXT_LAYER_CHARS = 50


def route(path: Column, head: Column | None = None) -> Column:
    """pdf, image or text, by extension; the magic bytes count only where there is no extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    magic = F.lit(False) if head is None else F.coalesce(F.substring(head, 1, 5).cast("string") == "%PDF-", F.lit(False))
    return F.when((ext == "pdf") | ((ext == "") & magic), "pdf").when(ext.isin(IMAGES), "image").otherwise("text")


def stdin(spark: SparkSession, stream=None) -> DataFrame:
    """(source, content) of what standard input holds; blank input is an error."""
    import sys

    text = (stream or sys.stdin).read()
    if not text.strip():
        raise ValueError("NoInput: standard input is blank")
    return spark.createDataFrame([("stdin", text)], "source string, content string")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of report files of any kind, a row for each."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", route(F.col("path"), F.col("content")).alias("kind"), "content")


def _with_file(command: list[str], content: bytes, out: str | None = None):
    """What a tool writes for a file: to standard output, or as files whose names start with ``out``, in order of name."""
    import pathlib
    import subprocess
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        source = pathlib.Path(folder, "in")
        source.write_bytes(content)
        try:
            done = subprocess.run([x.format(source=source, folder=folder) for x in command], capture_output=True, timeout=600, check=True)
        except (OSError, subprocess.SubprocessError):
            return None  # no tool, or it failed: there is no result
        if out is None:
            return done.stdout.decode(errors="replace")
        return [p.read_bytes() for p in sorted(pathlib.Path(folder).glob(f"{out}*"))]


PDF_TEXT = ["pdftotext", "-layout", "{source}", "-"]
PDF_IMAGES = ["pdftoppm", "-png", "-r", "150", "{source}", "{folder}/page"]


def pdf_texts(files: DataFrame, command: list[str] = PDF_TEXT) -> DataFrame:
    """(path, content) of pdf files with a text layer. The tool is an outside program; where it fails there is no text layer."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            yield pd.DataFrame({"path": pdf["path"], "content": [_with_file(command, c) for c in pdf["content"]]})

    df = files.filter("kind = 'pdf'").select("path", "content").mapInPandas(batches, "path string, content string")
    return df.filter(has_text_layer(F.col("content")))


def page_images(files: DataFrame, command: list[str] = PDF_IMAGES) -> DataFrame:
    """(path, page, image): pdf pages as an outside program draws them, in order, and image files as their one page."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for path, content in zip(pdf["path"], pdf["content"]):
                drawn = _with_file(command, content, "page") or []
                yield pd.DataFrame({"path": [path] * len(drawn), "page": range(1, len(drawn) + 1), "image": drawn})

    drawn = files.filter("kind = 'pdf'").select("path", "content").mapInPandas(batches, "path string, page int, image binary")
    return drawn.unionByName(files.filter("kind = 'image'").select("path", F.lit(1).alias("page"), F.col("content").alias("image")))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(source, content), a row for each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def named_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, content, error) of the files that a caller names, a row or more for each name, patterns allowed.

    Texts are UTF-8 or an IoError; a name that nothing has is FileNotFound, an empty or blank file NoInput. Where there is an error there is
    no content.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    known, named = [], []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = list(p.getFileSystem(conf).globStatus(p) or [])
        known += [path] * bool(found)
        named += [] if found else [(path, "FileNotFound")]
        named += [(f.getPath().toString(), "NoInput") for f in found if f.isFile() and not f.getLen()]  # which readers skip
    named = spark.createDataFrame(named, "source string, error string").select("source", F.lit(None).cast("string").alias("content"), "error")
    if not known:
        return named
    raw = spark.read.format("binaryFile").load(known).select(F.col("path").alias("source"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    error = F.when(text.isNull(), "IoError").when(F.regexp_replace(text, r"(?U)\s", "") == "", "NoInput")
    return raw.select("source", F.when(error.isNull(), text).alias("content"), error.alias("error")).unionByName(named)


def literal(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("text-input", text)], "source string, content string")


def has_text_layer(text: Column) -> Column:
    """More than 50 characters that aren't white space."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)\s", "")) > TEXT_LAYER_CHARS, F.lit(False))


def _answered(ask: Callable[[str], str], text: str) -> tuple[str | None, str | None]:
    """(answer, error) to a block of text."""
    try:
        if len(text.encode()) < 50:
            raise ValueError("page too short")
        return ask(text), None
    except Exception as e:  # an extractor may fail in any way
        return None, str(e)


def extractor(start: Callable[[], Callable[[str], str]], cut: Callable[[str], list[str]]) -> Callable[..., Column]:
    """As ``extract`` for whole pages: a function of (blocks, text) that gives the lists ``answers`` and ``errors``, one of both for each block.

    Where there are no blocks, ``text`` is cut by ``cut``. An extractor's answers may differ from call to call, so Spark is told not to repeat it.
    """

    @F.pandas_udf("answers array<string>, errors array<string>")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        ask = start()
        for blocks, texts in batches:
            got = [[_answered(ask, t) for t in (cut(text) if page is None else page)] for page, text in zip(blocks, texts)]
            yield pd.DataFrame({"answers": [[a for a, _ in page] for page in got], "errors": [[e for _, e in page] for page in got]})

    return answer.asNondeterministic()


def extract(blocks: DataFrame, start: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(doc_id, page, block, answer, error): an outside extractor's answer to each block of text.

    ``start`` is called once in each task, to load a model, and returns the function for a block. None is
    built in: nothing leaves the machine unless a caller injects it. Blocks under 50 bytes are answered
    with an error, and an exception is a block's error, not the task's.
    """

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = start()
        for pdf in rows:
            got = [_answered(ask, text) for text in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "page": pdf["page"], "block": pdf["block"], "answer": [a for a, _ in got], "error": [e for _, e in got]})

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return blocks.select("doc_id", "page", "block", "text").mapInPandas(batches, f"doc_id {kind}, page int, block int, answer string, error string")
