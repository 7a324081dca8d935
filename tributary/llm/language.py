"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of labelled texts; a text goes to the language whose
dictionary makes it smallest. The margin between the two smallest sizes, as a share of the second, gives the score; a
narrow margin rejects the text.

Texts and dictionaries are reduced to their runs of letters (Unicode category L), lower-cased, so that shouting and
ornaments do not count. Short or repetitive texts differ by fractions of a byte that one size cannot show: where the two
smallest sizes are equal, sizes at the highest level, which also finds matches of three bytes, are added, for the text and
for its distinct words one by one. What is equal even then falls to the label that sorts first and is rejected.

Fitting reads a bounded sample: for each label the distinct texts of smallest hash, ``docs_per_language`` for the
dictionary and ``tested_per_language`` to fit the margin, of each text as many bytes as its share of the dictionary, taken
from ``PLACES`` places spread over all of it. Every label is learned: a dictionary has ``bytes_per_language`` bytes, or, with
so many labels that all would exceed ``all_bytes``, an equal share of these, ``LEAST_BYTES`` at least. The tested texts are
classified by the dictionaries, which do not hold them. A text is rejected whose score is at most half of what
``low_share`` of those classified rightly lie under (half, since whole texts mix more than excerpts do). Prediction reads
every whole text and nothing else.

Edge cases: a null text or one without letters is ``und`` with score 0 and rejected. With no labelled text at all every
text is ``und``; with one label every text with letters gets it. Repeated rows give repeated rows. A kept column with a
result's name gives way to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_texts, map_texts, numbered, position, table

#: Places of a sampled text that its share of a dictionary is taken from.
PLACES = 4
LEAST_BYTES = 1024


class _Letters(dict):
    """A table for ``str.translate`` that leaves letters (category L) and makes blanks of all else; it grows as it is used."""

    def __missing__(self, code: int) -> int:
        self[code] = code if chr(code).isalpha() else 32
        return self[code]


_ONLY_LETTERS = _Letters()


def letters(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased."""
    return text.lower().translate(_ONLY_LETTERS).split()


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def excerpt(text: str, size: int) -> bytes:
    """About ``size`` bytes of a text's words, from places spread over the whole of it."""
    raw = " ".join(letters(text)).encode()
    if len(raw) <= size:
        return raw
    part, out = size // PLACES, []
    for k in range(PLACES):
        at = (len(raw) - part) * k // (PLACES - 1)
        out.append(raw[at : at + part].decode("utf-8", "ignore"))
    return " ".join(out).encode()


def sample(labelled: DataFrame, text_col: str, lang_col: str, wanted: int, share: int | None, all_bytes: int) -> list[tuple[str, bytes]]:
    """(label, excerpt) of a bounded sample: the distinct texts of smallest hash for each label, in order of hash.

    Each label's distinct texts are counted first, from hashes. A row goes on only if its hash is under a bound that lets
    about four times the wanted number of distinct texts through, and from then on only its excerpt, so what is sorted
    and collected does not grow with the corpus, however many copies it holds or how long its texts are; the bound follows
    the order of the hashes, so it does not change the sample.
    """
    by_place = numbered(labelled)
    pick = lambda c: by_place[f"__{position(labelled, c)}"]
    rows = by_place.select(pick(lang_col).cast("string").alias("lang"), pick(text_col).cast("string").alias("text"))
    rows = rows.where("lang is not null and text rlike '\\\\p{L}'").withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    size = max(LEAST_BYTES // 4, min(share or all_bytes, all_bytes // (len(counts) * wanted)))
    bound = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(min(2.0, 4 * wanted / r.n)))])
    low = rows.where(F.col("h").cast("double") / 2.0**64 + 0.5 < bound[F.col("lang")])

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            parts = [excerpt(t, size) for t in x.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column("lang"), x.column("h"), pa.array(parts, pa.binary())], ["lang", "h", "part"])

    parts = low.mapInArrow(cut_down, "lang string, h bigint, part binary").dropDuplicates(["lang", "h"])
    top = parts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= wanted)
    return [(r.lang, bytes(r.part)) for r in top.orderBy("lang", "h").select("lang", "part").collect() if r.part]


class Classifier:
    """Compressors with one dictionary each."""

    def __init__(self, content: dict[str, bytes], level: int):
        import zstandard as z

        self.labels = sorted(content)
        dicts = [z.ZstdCompressionDict(content[lang], dict_type=z.DICT_TYPE_RAWCONTENT) for lang in self.labels]

        def sized(d, at: int):
            params = z.ZstdCompressionParameters.from_level(at, source_size=1 << 17, dict_size=1 << 17, write_content_size=False, write_checksum=False, write_dict_id=False)
            return z.ZstdCompressor(dict_data=d, compression_params=params).compress

        self.compress = [sized(d, level) for d in dicts]
        self.closely = [sized(d, 19) for d in dicts]

    def sizes(self, raw: bytes, words: list[bytes]) -> list[int]:
        """Compressed size for each label; where the least is no other's, at one level, else with the closer sizes added."""
        out = [len(c(raw)) for c in self.compress]
        if len(out) > 1 and sorted(out)[0] == sorted(out)[1]:
            alone = [b" " + w + b" " for w in dict.fromkeys(words)]
            out = [s + sum(len(c(w)) for w in [raw, *alone]) for s, c in zip(out, self.closely, strict=True)]
        return out

    def predict(self, text: str | None, narrow: float = 0.0) -> tuple[str, float, bool]:
        words = letters(text) if text and self.labels else []
        if not words:
            return "und", 0.0, True
        if len(self.labels) == 1:
            return self.labels[0], 1.0, False
        raw = " ".join(words).encode()
        label, score = self.nearest(raw)
        return label, score, score <= narrow

    def nearest(self, raw: bytes) -> tuple[str, float]:
        """The label that makes the words smallest, and what it saves against the second one, as a share of that one."""
        sizes = self.sizes(raw, raw.split(b" "))
        first, second = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))[:2]
        return self.labels[first], (sizes[second] - sizes[first]) / max(1, sizes[second])


class Model(NamedTuple):
    content: dict[str, bytes]
    narrow: float


def fitted(rows: list[tuple[str, bytes]], docs_per_language: int, bytes_per_language: int, level: int, low_share: float) -> Model:
    """Dictionaries of each label's first texts, and the margin fitted on the others."""
    by: dict[str, list[bytes]] = {}
    for lang, part in rows:
        by.setdefault(lang, []).append(part)
    used = {lang: min(docs_per_language, max(1, len(parts) * 4 // 5)) for lang, parts in by.items()}
    content = {lang: b"\n".join(parts[: used[lang]])[:bytes_per_language] for lang, parts in by.items()}
    narrow = 0.0
    if len(content) > 1:
        c = Classifier(content, level)
        scores = sorted(score for lang, parts in by.items() for part in parts[used[lang] :] for label, score in [c.nearest(part)] if label == lang)
        narrow = scores[int(len(scores) * low_share)] / 2 if scores else 0.0
    return Model(content, narrow)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 256, tested_per_language: int = 64, bytes_per_language: int = 96_000, all_bytes: int = 64_000_000, level: int = 6, low_share: float = 0.01) -> Model:
    """The model of labelled texts; what comes to the driver is ``all_bytes``, or LEAST_BYTES for each label, at most."""
    rows = sample(labelled, text_col, lang_col, docs_per_language + tested_per_language, bytes_per_language // docs_per_language, all_bytes)
    return fitted(rows, docs_per_language, bytes_per_language, level, low_share)


RESULTS = "lang_pred string, score double, rejected boolean"
_ready: dict[tuple, Classifier] = {}


class Shipped:
    """A model as the tasks see it: broadcast once, compiled once in each worker."""

    def __init__(self, spark, model: Model, level: int):
        self.value, self.level = spark.sparkContext.broadcast(model), level
        self.key = (hashlib.sha1(repr((sorted(model.content.items()), model.narrow)).encode()).hexdigest(), level)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        if self.key not in _ready:
            _ready.clear()
            _ready[self.key] = Classifier(self.value.value.content, self.level)
        return [_ready[self.key].predict(t, self.value.value.narrow) for t in texts]


def identify(df: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None, level: int = 6, **fitting) -> DataFrame:
    """Predicted language, score and rejection of each text of ``df``, learned from ``labelled``."""
    model = Shipped(df.sparkSession, fit(labelled, text_col, lang_col, level=level, **fitting), level)

    def per_batch(column: pa.Array) -> list[pa.Array]:
        rows = model.predict(column.to_pylist())
        return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]

    return map_texts(df, text_col, df.columns if keep is None else keep, RESULTS, per_batch)


def accepted(df: DataFrame, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", level: int = 6, **fitting) -> DataFrame:
    """The rows of ``df`` whose text's language is not rejected; columns as they came."""
    model = Shipped(df.sparkSession, fit(labelled, text_col, lang_col, level=level, **fitting), level)
    return keep_texts(df, text_col, lambda column: pa.array([not rejected for _, _, rejected in model.predict(column.to_pylist())], pa.bool_()))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; rows of remainder 2 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def labelled_part(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(fold() != 2, F.lit(False)) & F.col("lang").isNotNull())


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.withColumn("held_out", F.coalesce(fold() == 2, F.lit(False))), labelled_part(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
