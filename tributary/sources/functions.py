"""Extractors as table functions of SQL: ``SELECT * FROM extract(TABLE(files), 'tmdl')``.

Each kind of file has one entry in the registry: the columns that it gives, and the function of one file's row. A new kind is
added to the registry and is known to the DataFrame form and to SQL alike.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import models

Extractor = tuple[str, Callable[[dict], list[tuple]]]
_FIELDS = "entity string, property string, kind string, role string"
_fields = lambda row: models.bindings_of(json.loads(row["text"], strict=False))
EXTRACTORS: dict[str, Extractor] = {
    "tmdl": ("kind string, table_name string, name string, value string, properties string", lambda row: models.tmdl_objects(row["text"])),
    "bim": ("kind string, table_name string, name string, value string, properties string", lambda row: models.bim_objects(row["text"])),
    "pbir_visual": (_FIELDS, _fields),
    "pbir_page": (_FIELDS, _fields),
    "pbir_report": (_FIELDS, _fields),
    "report_json_legacy": (f"page string, visual string, {_FIELDS}", lambda row: models.legacy_fields(json.loads(row["text"], strict=False))),
    "pbix": ("what string, name string, property string, kind string, role string, text string", lambda row: models.archive_rows(bytes(row["content"]))),
}


def _names(kind: str) -> list[str]:
    """The columns of a kind; all are strings."""
    return [column.split(" ")[0] for column in EXTRACTORS[kind][0].split(", ")]


def extracted(files: DataFrame, kind: str) -> DataFrame:
    """(repo_key, path, problem, …) of files (repo_key, path, text or content) by the extractor of their kind."""
    schema, read = EXTRACTORS[kind]
    return models._rows(files, schema, read, ["content" if kind == "pbix" else "text"])


class _Extract:
    """One file's rows at a time; a file that cannot be read gives one row with its problem."""

    @staticmethod
    def analyze(files: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("the first argument is a table of files: TABLE(files)")
        if not kind.isConstantExpression or kind.value not in EXTRACTORS:
            raise ValueError(f"the second argument is one of {sorted(EXTRACTORS)}")
        return AnalyzeResult(T.StructType([T.StructField(c, T.StringType()) for c in ("repo_key", "path", "problem", *_names(kind.value))]))

    def eval(self, files, kind: str) -> Iterator[tuple]:
        read, row = EXTRACTORS[kind][1], files.asDict()
        try:
            made = [("", *r) for r in read(row)]
        except Exception as problem:  # one bad file gives one row
            made = [(f"{type(problem).__name__}: {problem}"[:300], *[None] * len(_names(kind)))]
        for r in made:
            yield (row["repo_key"], row["path"], *r)


def register(spark: SparkSession, name: str = "extract") -> None:
    """Makes the extractors known to SQL."""
    spark.udtf.register(name, udtf(_Extract))
