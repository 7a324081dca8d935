"""Input files as DataFrames: the tasks list folders level by level, and read and decode files."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import file_kind, glob_filter, glob_regex
from ..plans.session import cut

# Size limits in bytes of a file and of a member of an archive.
MOST_BYTES, MOST_MEMBER = 10 * 1024 * 1024, 200 * 1024 * 1024


def folder_excluded(folder: str, exclude: list[str]) -> bool:
    """Whether the globs exclude whatever a folder could hold, at its top and deeper."""
    out = lambda path: any(re.search(glob_regex(g), path) for g in exclude)
    return bool(exclude) and out(f"{folder}/\0") and out(f"{folder}/\0/\0")


def root_path(at: str) -> str:
    """A URI as it is, a path (``file:`` before it or not) without links."""
    at = re.sub("^file:(?://)?(?=/)", "", at)
    return at if "://" in at else os.path.realpath(at)


def entries(root: str, rel: str) -> Iterator[tuple[str, str, bool, int, str, int]]:
    """(relative path, absolute path, is a folder, size, problem, time of change) of what lies in a folder, hidden names
    left out.

    A plain path is one of a machine that all tasks share; its links are kept inside the root. A URI goes through the file
    system that it names. A folder that cannot be listed gives one row for itself.
    """
    within = lambda name: f"{rel}/{name}" if rel else name
    try:
        if "://" in root:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(f"{root.rstrip('/')}/{rel}" if rel else root)
            for info in where.get_file_info(fs.FileSelector(at)):
                if not info.base_name.startswith("."):
                    yield within(info.base_name), f"{root.rstrip('/')}/{within(info.base_name)}", info.type == fs.FileType.Directory, info.size or 0, "", info.mtime_ns or 0
            return
        with os.scandir(os.path.join(root, rel)) as found:
            for e in [e for e in found if not e.name.startswith(".")]:
                full = os.path.join(root, within(e.name))
                if e.is_dir(follow_symlinks=False):
                    yield within(e.name), full, True, 0, "", 0
                elif not e.is_dir():
                    try:
                        inside = os.path.realpath(full).startswith(root.rstrip(os.sep) + os.sep)
                        about = os.stat(full)
                        yield within(e.name), full, False, about.st_size, "" if inside else "symlink_escape", about.st_mtime_ns
                    except OSError:
                        yield within(e.name), full, False, 0, "file_unreadable", 0
    except (OSError, ValueError):  # ValueError: an unknown kind of file system
        yield rel, os.path.join(root, rel), False, 0, "folder_unreadable", 0


def listed(spark: SparkSession, repos: dict[str, str], exclude: list[str] = ()) -> DataFrame:
    """(repo_key, path, abs_path, size, problem) of every file outside hidden and excluded folders.

    Level by level: the folders of a level are rows, the tasks list them, and what is found there is written before the next
    level begins. Only whether a level holds folders comes to the driver.
    """
    globs, lanes = list(exclude), spark.sparkContext.defaultParallelism

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, root, rel in b.itertuples(index=False, name=None):
                for path, full, is_folder, size, problem, _ in entries(root, rel):
                    big = not is_folder and size > MOST_BYTES and not path.lower().endswith(".pbix")
                    if not (is_folder and folder_excluded(path, globs)):
                        out.append((key, root, path, full, is_folder, size, problem or ("file_too_large" if big else "")))
            yield pd.DataFrame(out, columns=["repo_key", "root", "path", "abs_path", "is_folder", "size", "problem"])

    roots = [(key, root_path(at), "") for key, at in sorted(repos.items())]
    level, found = spark.createDataFrame(roots, "repo_key string, root string, rel string"), []
    while not level.isEmpty():
        here = cut(level.repartition(lanes, "root", "rel").mapInPandas(listing, "repo_key string, root string, path string, abs_path string, is_folder boolean, size bigint, problem string"))
        found.append(here.where("not is_folder").select("repo_key", "path", "abs_path", "size", "problem"))
        level = here.where("is_folder").select("repo_key", "root", F.col("path").alias("rel"))
    out = found[0] if found else spark.createDataFrame([], "repo_key string, path string, abs_path string, size bigint, problem string")
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def crawl(spark: SparkSession, repos: dict[str, str], include: list[str] = (), exclude: list[str] = (), folders: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, warnings) of repositories (paths or URIs): files of a known kind that the globs let through, and what was left
    out. ``folders`` keeps, of a repository, only what lies under some of its folders. A report's definition.pbir there stays
    in whatever ``include`` says, unless it is excluded, since it tells which model a report draws from."""
    every = listed(spark, repos, exclude)
    kinds = every.withColumn("kind", file_kind(F.col("path"))).where("kind is not null or problem = 'folder_unreadable'")
    allowed = F.lit(True)
    for key, names in (folders or {}).items():
        under = F.lit(False)
        for name in names:
            under |= F.col("path").startswith(name.strip("/") + "/")
        allowed &= (F.col("repo_key") != key) | under
    definition = F.col("kind").eqNullSafe("pbir_definition")
    not_excluded = ~glob_filter(F.col("path"), list(exclude), []) if exclude else F.lit(True)
    kinds = kinds.where((allowed & (glob_filter(F.col("path"), list(include), list(exclude)) | (definition & not_excluded))) | (F.col("problem") == "folder_unreadable"))
    files = kinds.where("problem = ''").select("repo_key", "path", "abs_path", "kind", "size")
    bad = kinds.where("problem <> ''").select(F.col("path").alias("file"), F.concat(F.lit("left out: "), "problem").alias("message"), F.col("problem").alias("category"))
    return files, bad


def decode_text(raw: bytes) -> str:
    """Text by byte-order mark (32-bit marks before 16-bit ones), else UTF-8 with replacements; line ends become \\n."""
    for mark, codec in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            text = raw.decode(codec, "replace")
            break
    else:
        text = raw.decode("utf-8-sig", "replace")
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    """``decode_text`` of binary columns."""
    return raw.map(lambda b: None if b is None else decode_text(bytes(b)))


def contents(path: str) -> bytes:
    """A file's bytes, from the file system that its path names (a plain path: the one of the machine)."""
    from pyarrow import fs

    where, at = (fs.FileSystem.from_uri(path)) if "://" in path else (fs.LocalFileSystem(), path)
    with where.open_input_stream(at) as f:
        return f.read()


def read_files(files: DataFrame, per_task: int = 64) -> DataFrame:
    """``files`` (…, abs_path) with ``text`` and ``sha``; contents are read in the tasks, about ``per_task`` files in each.

    Tasks open paths by their URI, so the files may lie in any file system that all executors reach. (Spark's own binary
    reader leaves out names that begin with an underscore.)
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [contents(path) for path in b["abs_path"]]
            yield b.assign(text=[decode_text(x) for x in raw], sha=[hashlib.sha256(x).hexdigest() for x in raw])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema) + ", text string, sha string"
    n = max(1, -(-files.count() // per_task))
    return files.repartition(n, "abs_path").mapInPandas(run, schema)


def unreadable(texts: DataFrame) -> DataFrame:
    """Warnings for texts with a NUL character, which only a wrong encoding leaves."""
    return texts.where(F.contains("text", F.lit("\0"))).select(F.col("path").alias("file"), F.lit("not readable as text").alias("message"), F.lit("encoding_unreadable").alias("category"))
