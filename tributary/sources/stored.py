"""Model and report files as a data source of Spark, in batches and as a stream.

``register(spark)``, then ``spark.read.format("estate").option("extract", "tmdl").load(root)`` gives the rows of ``extracted``
for all files under a folder (a path that all executors share, or a URI); ``readStream`` gives those of new and changed files.
A partition is a bin of files, by bytes and by number. A file that cannot be read gives one row with its problem.

Options: ``extract`` (a kind of the registry, or ``events``), ``repo_key``, ``include`` and ``exclude`` (globs, comma-joined),
``bin_bytes`` and ``bin_files``, and for streams ``log``: a folder that outlives the driver. Each listing that differs from the
one before is a generation; what changed is written there before its number is given out as an offset, so a batch that is run
again reads the same files. ``events`` gives (text, seq) as ``streaming.state`` takes them, with a null text for a file that is
gone; other kinds give no rows for it. The reader holds paths and sizes of one listing, as Spark's own file readers do.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.names import glob_regex
from . import files
from .functions import EXTRACTORS

EVENTS = "text string, seq bigint"


class File(NamedTuple):
    """A file of a listing; ``stamp`` is its time of change, and ``seq`` the generation that it came with."""

    path: str
    abs_path: str
    size: int
    stamp: int
    problem: str
    seq: int = 0


class Bin(InputPartition):
    def __init__(self, held: list[File]):
        self.held = held


def listing(root: str, include: list[str], exclude: list[str]) -> list[File]:
    """The files that the globs let through, by path; excluded folders are not entered."""
    at = files.root_path(root)
    hit = lambda globs, path: any(re.search(glob_regex(g), path) for g in globs)
    found, folders = [], [""]
    while folders:
        for path, full, is_folder, size, problem, stamp in files.entries(at, folders.pop()):
            if is_folder:
                if not files.folder_excluded(path, exclude):
                    folders.append(path)
            elif problem == "folder_unreadable" or ((not include or hit(include, path)) and not hit(exclude, path)):
                big = size > files.MOST_BYTES and not path.lower().endswith(".pbix")
                found.append(File(path, full, size, stamp, problem or ("file_too_large" if big else "")))
    return sorted(found)


def bins(held: list[File], most_bytes: int, most_files: int) -> list[Bin]:
    """Files in order, parted where a bin would grow beyond either bound; a larger file is alone."""
    out: list[list[File]] = []
    total = 0
    for f in held:
        if not out or total + f.size > most_bytes or len(out[-1]) >= most_files:
            out.append([])
            total = 0
        out[-1].append(f)
        total += f.size
    return [Bin(b) for b in out]


class _Options:
    def __init__(self, options: dict):
        globs = lambda key: [g.strip() for g in options.get(key, "").split(",") if g.strip()]
        if "path" not in options:
            raise ValueError("give the folder: load(path)")
        self.root, self.kind, self.repo_key = options["path"], options.get("extract", "events"), options.get("repo_key", "")
        if self.kind != "events" and self.kind not in EXTRACTORS:
            raise ValueError(f"extract is one of {['events', *sorted(EXTRACTORS)]}")
        self.include, self.exclude, self.log = globs("include"), globs("exclude"), options.get("log")
        self.most_bytes, self.most_files = int(options.get("bin_bytes", 64 * 2**20)), int(options.get("bin_files", 512))

    def listing(self) -> list[File]:
        return listing(self.root, self.include, self.exclude)

    def bins(self, held: list[File]) -> list[Bin]:
        return bins(held, self.most_bytes, self.most_files)

    def rows(self, held: list[File]) -> Iterator[tuple]:
        """(repo_key, path, problem, …) of each file."""
        width = 2 if self.kind == "events" else len(EXTRACTORS[self.kind][0].split(", "))
        for f in held:
            try:
                made = [] if f.problem else list(self.one(f))
                problem = f.problem
            except Exception as failure:  # one bad file gives one row
                made, problem = [], f"{type(failure).__name__}: {failure}"[:300]
            yield from ((self.repo_key, f.path, "", *r) for r in made)
            if problem:
                yield (self.repo_key, f.path, problem, *[None] * width)

    def one(self, f: File) -> list[tuple]:
        if f.size < 0:  # gone
            return [(None, f.seq)] if self.kind == "events" else []
        raw = files.contents(f.abs_path)
        if self.kind == "events":
            return [(files.decode_text(raw), f.seq)]
        return EXTRACTORS[self.kind][1]({"content": raw} if self.kind == "pbix" else {"text": files.decode_text(raw)})


class _Batch(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Bin]:
        return self.options.bins(self.options.listing()) or [Bin([])]

    def read(self, partition: Bin) -> Iterator[tuple]:
        return self.options.rows(partition.held)


class _Stream(DataSourceStreamReader):
    """Generations of the folder; the log holds what each one changed."""

    def __init__(self, options: _Options):
        if not options.log:
            raise ValueError("a stream needs the option log: a folder that outlives the driver")
        self.options, self.known, self.generation = options, {}, 0

    def initialOffset(self) -> dict:
        return {"generation": 0}

    def latestOffset(self) -> dict:
        while (changed := self.logged(self.generation + 1)) is not None:
            self.take(changed)
        now = {f.path: f for f in self.options.listing()}
        for folder in [f.path for f in now.values() if f.problem == "folder_unreadable"]:
            # what cannot be listed now is not gone
            now = {**{p: f for p, f in self.known.items() if not folder or p.startswith(f"{folder}/")}, **now}
        same = lambda f, g: f is not None and (f.size, f.stamp, f.problem) == (g.size, g.stamp, g.problem)
        seq = self.generation + 1
        changed = [f._replace(seq=seq) for p, f in sorted(now.items()) if not same(self.known.get(p), f)]
        changed += [f._replace(size=-1, problem="", seq=seq) for p, f in sorted(self.known.items()) if p not in now]
        if changed:
            self.write(seq, changed)
            self.take(changed)
        return {"generation": self.generation}

    def take(self, changed: list[File]) -> None:
        for f in changed:
            if f.size < 0:
                self.known.pop(f.path, None)
            else:
                self.known[f.path] = f
        self.generation += 1

    def partitions(self, start: dict, end: dict) -> list[Bin]:
        """The last state of each file that changed between two offsets."""
        last: dict[str, File] = {}
        for n in range(start["generation"] + 1, end["generation"] + 1):
            last.update({f.path: f for f in self.logged(n) or []})
        return self.options.bins(sorted(last.values())) or [Bin([])]

    def read(self, partition: Bin) -> Iterator[tuple]:
        return self.options.rows(partition.held)

    def place(self):
        from pyarrow import fs

        log = files.root_path(self.options.log)
        return fs.FileSystem.from_uri(log) if "://" in log else (fs.LocalFileSystem(), log)

    def logged(self, n: int) -> list[File] | None:
        where, at = self.place()
        if not where.get_file_info(f"{at}/{n}.json").is_file:
            return None
        with where.open_input_stream(f"{at}/{n}.json") as f:
            return [File(*x) for x in json.loads(f.read())]

    def write(self, n: int, changed: list[File]) -> None:
        where, at = self.place()
        where.create_dir(at)
        with where.open_output_stream(f"{at}/.{n}.json") as f:
            f.write(json.dumps(changed).encode())
        where.move(f"{at}/.{n}.json", f"{at}/{n}.json")


class EstateFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "estate"

    def schema(self) -> str:
        kind = _Options(self.options).kind
        return f"repo_key string, path string, problem string, {EVENTS if kind == 'events' else EXTRACTORS[kind][0]}"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(_Options(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Makes the data source known to the session."""
    spark.dataSource.register(EstateFiles)


def problems(rows: DataFrame, category: str) -> DataFrame:
    """Warnings for the files that could not be read."""
    return rows.where("problem <> ''").select(F.col("path").alias("file"), F.col("problem").alias("message"), F.lit(category).alias("category"))
