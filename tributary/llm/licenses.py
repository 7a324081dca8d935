"""License scans: ordered signature rules behind a keyword prefilter.

A text is lower-cased, cut into words and joined by single blanks, so a rule is a regex over words. One pass with an
Aho-Corasick automaton finds which keywords occur; only the rules of these are tried. Detections that lie inside another one of
the same or higher priority are suppressed (of equal ones the first label stays); what remains gives the labels. The base
phrases are reported wherever their words stand consecutively, whatever the rules say.

Edge cases: a null or empty text has 0 words, no places, empty labels, score 0. Repeated rows give repeated rows. Columns
not named in ``keep`` do not appear; a kept column with a result's name gives way to it. Texts are scanned whole. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_TRANSLATE, map_texts, table, utf8
from .license_rules import RULES

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: How sure a detection of each priority is.
CONFIDENCE = {95: 1.0, 90: 1.0, 80: 0.95, 75: 0.9, 70: 0.9, 60: 0.85, 50: 0.8, 40: 0.6, 20: 0.4}


def rules() -> list[tuple[str, bytes, int, float, bytes]]:
    """Every rule as (label, keyword, priority, confidence, pattern), ordered by priority, then as written."""
    out = []
    for line in RULES.strip().split("\n"):
        label, priority, key, pattern = line.split(" | ", 3)
        out.append((label, key.encode(), int(priority), CONFIDENCE[int(priority)], pattern.encode()))
    return sorted(out, key=lambda r: -r[2])


Detection = tuple[int, int, int, float, str]


def outermost(found: list[Detection]) -> list[Detection]:
    """Detections that lie inside no other one of the same or higher priority, by start; a sweep for each priority."""
    kept: list[Detection] = []
    for priority in sorted({d[2] for d in found}, reverse=True):
        starts, reach = [k[0] for k in kept], []
        for k in kept:
            reach.append(max(k[1], reach[-1] if reach else 0))
        far, mine = -1, []
        for d in sorted((d for d in found if d[2] == priority), key=lambda d: (d[0], -d[1], d[4])):
            before = bisect_right(starts, d[0])
            if d[1] > far and not (before and reach[before - 1] >= d[1]):
                mine.append(d)
                far = d[1]
        kept = sorted(kept + mine)
    return kept


class Scanner:
    """The compiled rules by keyword, and the automaton of all keywords."""

    def __init__(self) -> None:
        self.rules: dict[bytes, list] = {}
        for label, key, p, c, pattern in rules():
            self.rules.setdefault(key, []).append((label, p, c, re.compile(rb"(?<![^ ])(?:" + pattern + rb")(?![^ ])")))
        self.keywords = ahocorasick.Automaton()
        for key in self.rules:
            self.keywords.add_word(key.decode(), key)
        self.keywords.make_automaton()
        self.base = [(phrase.encode(), label) for phrase, label in BASE.items()]

    def places(self, text: bytes) -> list[tuple[int, str]]:
        """Start byte and label of every base phrase; ``text`` has a blank on either side."""
        out = []
        for phrase, label in self.base:
            at = text.find(b" " + phrase + b" ")
            while at >= 0:
                out.append((at, label))
                at = text.find(b" " + phrase + b" ", at + 1)
        return out

    def detections(self, text: bytes) -> list[Detection]:
        """(start, end, priority, confidence, label) of what the rules find, without what lies inside a better one."""
        keys = {key for _, key in self.keywords.iter(text.decode("latin-1"))}
        found = [(*m.span(), p, c, label) for key in keys for label, p, c, rule in self.rules[key] for m in rule.finditer(text)]
        return outermost(found) if found else found


RESULTS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
_BLANKS = re.compile(rb"  +")
_scanner: list[Scanner] = []


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Licenses of each text: words, base places, labels of base phrases, all labels, best confidence, detections."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        if not _scanner:
            _scanner.append(Scanner())
        s, rows = _scanner[0], []
        data, off = utf8(column)
        raw = data.tobytes()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            text = b" " + _BLANKS.sub(b" ", raw[a:b].translate(WORD_TRANSLATE)).strip(b" ") + b" "
            n = text.count(b" ") - 1 if len(text) > 2 else 0
            places, found = s.places(text), s.detections(text)
            ends = [text.count(b" ", 0, pick(places)[0]) if places else None for pick in (min, max)]
            base = {label for _, label in places}
            rows.append((n, len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | {d[4] for d in found})), max([1.0] * bool(base) + [d[3] for d in found], default=0.0), len(found)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
        return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

    return map_texts(df, text_col, df.columns if keep is None else keep, RESULTS, per_batch)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
