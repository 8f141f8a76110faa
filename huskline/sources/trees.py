"""Source trees and corpora as tables."""

from __future__ import annotations

import os
import re
import tokenize

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _opened(path: str):
    """The file system of a path or URI, and the path on it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _by_spark(spark: SparkSession, path: str, ending: str, hidden: bool) -> DataFrame:
    """By Spark's own file source, for stores that only Spark opens; it passes over names that begin with a dot or an underscore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.rstrip("/")
    shown = F.col("path").endswith(ending) & (F.lit(True) if hidden else ~F.expr(f"substring(path, {len(root) + 1})").contains("/."))
    return files.where(shown).select(F.col("path").alias("file_path"), "content")


def scan_tree(spark: SparkSession, path: str, ending: str = ".py", hidden: bool = True) -> DataFrame:
    """file_path, content (binary) of every file below `path`, which may be one file; hidden=False leaves out dot-files and what lies in dot-folders.

    Spark's own file sources pass over names that begin with a dot or an underscore, `__init__.py` among them, so they serve
    only where no other reader knows the store.  Folders are listed level by level: those of one level are dealt over all
    tasks, each is listed by one, and their subfolders are the next level.  The driver sees no name but `path`."""
    try:
        store, root = _opened(path)
    except (pa.ArrowException, OSError, ValueError, TypeError):
        return _by_spark(spark, path, ending, hidden)
    info = store.get_file_info(root)
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    top = len(root.rstrip("/"))

    def shown(full: str) -> bool:
        return hidden or not any(p.startswith(".") for p in full.removeprefix(scheme)[top:].split("/"))

    def listed(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                own, place = _opened(name)
                below = [i for i in own.get_file_info(fs.FileSelector(place)) if shown(i.path) and (not i.is_file or i.path.endswith(ending))]
                yield pa.RecordBatch.from_arrays([pa.array([scheme + i.path for i in below], pa.string()), pa.array([not i.is_file for i in below], pa.bool_())], names=["name", "folder"])

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                own, place = _opened(name)
                with own.open_input_stream(place) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f.read()], pa.binary())], names=["file_path", "content"])

    level = spark.createDataFrame([(scheme + info.path, not info.is_file)], "name string, folder boolean")
    files = level.where("not folder") if shown(info.path) and info.path.endswith(ending) else level.limit(0)
    while level.where("folder").limit(1).count():
        below = level.where("folder").select("name").repartition("name").mapInArrow(listed, "name string, folder boolean")
        level = below.persist(StorageLevel.DISK_ONLY)  # names only; listed again where they are lost
        files = files.unionByName(level.where("not folder"))
    return files.select("name").dropDuplicates(["name"]).mapInArrow(read, "file_path string, content binary")


def decode_utf8(files: DataFrame) -> DataFrame:
    """file_path, code; code is null where the bytes are not UTF-8."""
    return files.select("file_path", F.try_validate_utf8(F.col("content").cast("string")).alias("code"))


def decoded(content: bytes | None) -> tuple[str | None, str | None, str | None]:
    """What the first two lines declare, the codec that is used, and the text.

    A declaration or a mark at the start names the codec, UTF-8 stands where there is none; Latin-1 is taken where the name is unknown,
    contradicts the mark, or does not decode the whole file, and it decodes anything.  Line ends stay as they are."""
    if content is None:
        return None, None, None
    lines = iter(content[: content.find(b"\n", content.find(b"\n") + 1) + 1 or len(content)].splitlines(keepends=True))
    declared = None
    for line in content.split(b"\n", 2)[:2]:
        if found := DECLARED.match(line):
            declared = found[1].decode()
            break
        if not BLANK_LINE.match(line):
            break
    try:
        codec = tokenize.detect_encoding(lambda: next(lines, b""))[0]
        return declared, codec, content.decode(codec)
    except (SyntaxError, LookupError, ValueError):
        return declared, "latin-1", content.decode("latin-1")


#: How a source file declares its encoding, and what may stand before it (fixed values).
DECLARED = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-\w.]+)", re.ASCII)
BLANK_LINE = re.compile(rb"^[ \t\f]*(?:[#\r\n]|$)", re.ASCII)


def decode_declared(files: DataFrame) -> DataFrame:
    """file_path, encoding (as declared, null if not), codec (as used), code: every file as text, by the codec that it declares.

    The codec is chosen file by file, in the tasks that hold the files; null content gives null."""

    def run(batches):
        for b in batches:
            told = [decoded(c) for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([t[i] for t in told], pa.string()) for i in range(3))], names=["file_path", "encoding", "codec", "code"])

    return files.select("file_path", "content").mapInArrow(run, "file_path string, encoding string, codec string, code string")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of `code` and `docstring`, with the split that the file's name tells (train, valid or test)."""
    rows = spark.read.schema("code string, docstring string").json(path)
    return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_name"), "(train|valid|test)", 1))


def read_language_lines(spark: SparkSession, path: str, without: str = "py") -> DataFrame:
    """language, line, label of CSV rows (gzip too) whose third column is 1 for code; label is 0 for code, as elsewhere here."""
    rows = spark.read.schema("language string, line string, is_code int").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.where(F.col("language") != without).select("language", "line", (1 - F.col("is_code")).alias("label"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """data, label of CSV rows with a header."""
    return spark.read.schema("data string, label double").option("header", True).option("escape", '"').csv(path).select("data", F.col("label").cast("int").alias("label"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """rank, token, cnt of a vocabulary that write_vocabulary wrote."""
    return spark.read.schema("rank int, token string, cnt long").option("header", True).option("escape", '"').csv(path)


def read_token_list(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """rank (from 0), token of a text file of one token a line; a list longer than `most` is refused, as text files keep no order in Spark."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("rank", "token"))
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"{path} has more than {most} tokens; use a table with a rank column")
    return rows


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select("rank", "token", "cnt").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_by_split(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, one document `{"problems": [..]}` a file."""
    findings.select("document").write.mode("overwrite").text(path)


def write_findings_csv(findings: DataFrame, path: str) -> None:
    findings.select("file_path", "lineno", "content").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
