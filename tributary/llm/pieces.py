"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

Three transducers are compiled from a piece file and composed with each input:

* the normaliser: blank -> U+2581, and one U+2581 in front of a non-empty text (as the file's flags say); where the file
  asks for it, runs of blanks become one and those at the ends go;
* the pieces: a trie of states, one arc for each character; a path from the root to a final state writes one id;
* byte fallback: a character that is no piece of its own has an arc that writes its UTF-8 bytes as byte pieces.

An input of n characters gives n + 1 positions; walking the trie from each position gives the arcs of the composed
machine, made only as far as they are reached, and the encoding is its shortest path in a tropical semiring. In a unigram
file the weight of an arc is minus its piece's score, and weights add up.

In a merge-based (BPE) file an arc's weight is the set of merges that build its piece, each as rank and place. Weights
multiply by union and compare by the least merge that only one of them has: the path that has it is the better one. Since
a merge ranks behind the merges that build its parts, the merge algorithm's first step is the least merge of any path, and
so on, and the shortest path is its result. This order is total and kept by union, so one best weight for each position is
enough.

Weights grow along a stretch, and do not rank upwards in a few pieces of equal score (runs of blanks). A stretch of more
than ``LONG`` characters or with such a piece is composed with an acceptor of adjacent pieces first: two pieces may follow each other only if merging their joined text gives exactly these two. A sequence in
which every neighbouring pair is accepted is the merge encoding and no other sequence is, so one path is left.

Paths never leave a stretch between two places that no piece spans (before a U+2581 that follows something else, around
a line break, before a sign that no piece has behind a letter), so each such stretch is solved once and remembered, up to
``memo`` stretches for each worker.

Edge cases: a null or empty text has no pieces and decodes to the empty text. U+2581 in a text decodes to a blank, as in
the piece format itself; ``lossless`` compares with the text so changed. Columns of the input that are not named in
``keep`` do not appear; a kept column with the name of a result gives way to it. Files with a table of characters to
normalise are refused.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches that a worker remembers (about 250 bytes for each).
MEMO = 500_000
#: Stretches of more characters are not remembered.
LONG = 64
_ONE = (1,)
#: Ends a weight, so that of two weights of which one begins the other the longer one is the lesser.
END = float("inf")
TIED: list[int] = [-1]
#: Letters and digits as a part of a character class.
_WORD = "0-9A-Za-z\u00c0-\u024f"


def read_pieces(path: str = MODEL) -> dict:
    """The pieces and flags of a piece file; read on the driver (a file of bounded size), shipped with the tasks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap:
        raise ValueError("files with a table of characters to normalise are not supported")
    return {
        "pieces": [(p.piece, p.score, p.type) for p in m.pieces],
        "bpe": m.trainer_spec.model_type == 2,
        "prefix": m.normalizer_spec.add_dummy_prefix,
        "tidy": m.normalizer_spec.remove_extra_whitespaces,
    }


class Transducer:
    """The compiled transducer of one piece file."""

    def __init__(self, spec: dict, memo: int = MEMO):
        self.bpe, self.prefix, self.memo, self.tidy = spec["bpe"], spec["prefix"], memo, spec.get("tidy", False)
        rows = spec["pieces"]
        # types of the piece format: 1 normal, 4 user-defined, 5 unused, 6 byte
        self.ids = {p: i for i, (p, _, kind) in enumerate(rows) if kind in (1, 4, 5)}
        self.score = {p: s for p, s, kind in rows if kind in (1, 4, 5)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(rows) if kind == 6}
        self.longest = max(map(len, self.ids), default=1)
        self.out = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(BLANK, " ").encode() if kind in (1, 4, 5) else b"" for p, _, kind in rows]
        self.is_byte = np.array([kind == 6 for _, _, kind in rows])
        spans = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids if len(p) > 1))
        # signs that no piece has behind a letter or digit: between the two no arc can lie
        word = re.compile(f"[{_WORD}]")
        behind = {p[k + 1] for p in self.ids for k in range(len(p) - 1) if word.match(p[k])}
        signs = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in behind)
        stop = re.escape(BLANK + alone)
        other, inner = f"[^{stop}{_WORD}]", f"[^{stop}{_WORD}{re.escape(signs)}]"
        self.cut = re.compile(r"(?s).+" if spans else (f"[{re.escape(alone)}]|" if alone else "") + f"{BLANK}*{other}*(?:[{_WORD}]+(?:{inner}{other}*)?)*")
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self._written = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        # the trie: for each state its arcs by character, and the piece that ends there
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[str] = [""]
        for p in self.ids:
            at = 0
            for ch in p:
                to = self.arcs[at].get(ch)
                if to is None:
                    to = self.arcs[at][ch] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append("")
                at = to
            self.final[at] = p
        order = {x: k for k, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[x] << 32 for p, x in self.score.items()}
        #: Arcs that building never gives have no weight; those whose merges do not rank upwards have TIED.
        self.weight = {p: TIED if w and any(b <= a for a, b in zip(w, w[1:], strict=False)) else w for p, w in ((p, self.merges(p)) for p in self.ids)} if self.bpe else {}
        # for each end of a piece, the sizes of the pieces that end with it, the longest first
        self._tails: dict[str, tuple[int, ...]] = {p[-k:]: () for p in self.ids for k in range(1, len(p) + 1)}
        for end in self._tails:
            self._tails[end] = tuple(k for k in range(len(end), 1, -1) if end[-k:] in self.ids) + _ONE
        self._judged = 0
        self._pairs: dict[str, dict[str, bool]] = {"": {}}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by its definition: merge the best-scored neighbours, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merges(self, piece: str) -> list[int] | None:
        """The merges that build a piece, in their order, each as rank and place; None if merging does not give it."""
        parts, starts, out = list(piece), list(range(len(piece))), []
        while len(parts) > 1:
            merge, i = min(((r + starts[i], i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=(0, -1))
            if i < 0:
                return None
            out.append(merge)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del starts[i + 1]
        return out

    def shortest(self, text: str) -> list[str]:
        """The best path through the composed machine, as its arcs' strings: Viterbi over positions."""
        n, arcs, final, weight, score = len(text), self.arcs, self.final, self.weight, self.score
        cost: list = [None] * (n + 1)
        cost[0], back = [END] if self.bpe else 0.0, [""] * (n + 1)
        for j in range(n):
            mine, i, at = cost[j], j, arcs[0].get(text[j])
            if at is None or not final[at]:  # byte fallback
                c = mine if self.bpe else mine - self.unknown
                if cost[j + 1] is None or c < cost[j + 1]:
                    cost[j + 1], back[j + 1] = c, text[j]
            while at is not None:
                i += 1
                piece = final[at]
                if piece:
                    if self.bpe:
                        w = weight[piece]
                        if w is TIED:
                            return self.accepted(text)
                        c = None if w is None else sorted(mine + [m + j for m in w]) if w else mine
                    else:
                        c = mine - score[piece]
                    if c is not None and (cost[i] is None or c < cost[i]):
                        cost[i], back[i] = c, piece
                at = arcs[at].get(text[i]) if i < n else None
        out = []
        while n:
            out.append(back[n])
            n -= len(back[n])
        return out[::-1]

    def follows(self, left: str, right: str) -> bool:
        """Whether the acceptor of adjacent pieces lets ``right`` follow ``left`` ("": stand first)."""
        self._judged += 1
        return self.merged(left + right) == ([left, right] if left else [right])

    def accepted(self, text: str) -> list[str]:
        """The only accepted path of a merge-based file, by position: its last arc to each position is known from the
        arcs that end there and the last arcs of where these start; the longest that may follow is the one."""
        if self._judged > 2 * self.memo:
            self._pairs, self._judged = {"": {}}, 0
        tails, pairs, n = self._tails, self._pairs, len(text)
        last, after = [""] * (n + 1), [pairs[""]] * (n + 1)
        for i in range(1, n + 1):
            k = min(3, i)  # the longest end of text[:i] that ends some piece has about this size
            sizes = tails.get(text[i - k : i])
            if sizes is None:
                while k > 1 and sizes is None:
                    k -= 1
                    sizes = tails.get(text[i - k : i])
                sizes = sizes or _ONE
            else:
                while k < i:
                    longer = tails.get(text[i - k - 1 : i])
                    if longer is None:
                        break
                    sizes, k = longer, k + 1
            for size in sizes:
                j, piece = i - size, text[i - size : i]
                ok = after[j].get(piece)
                if ok is None:
                    ok = after[j][piece] = self.follows(last[j], piece)
                if ok:
                    last[i] = piece
                    then = pairs.get(piece)
                    if then is None:
                        then = pairs[piece] = {}
                    after[i] = then
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def path(self, text: str) -> list[str]:
        """The shortest path through one stretch, as its arcs' strings."""
        return self.shortest(text) if len(text) <= LONG or not self.bpe else self.accepted(text)

    def solve(self, text: str) -> bytes:
        """Ids (32-bit, little-endian) of one stretch."""
        arcs, out = self._written, []
        for piece in self.path(text):
            arc = arcs.get(piece)
            out.append(arc if arc is not None else b"".join(self.bytes[b].to_bytes(4, "little") for b in piece.encode()))
        return b"".join(out)

    def new_stretch(self, stretch: str) -> bytes:
        ids = self._older.get(stretch)
        if ids is None:
            ids = self.solve(stretch)
        if len(stretch) <= LONG:
            if len(self._known) >= self.memo // 2:  # what was used lately stays
                self._older, self._known = self._known, {}
            self._known[stretch] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.tidy:
            text = re.sub("  +", " ", text.strip(" "))
        if not text:
            return b""
        text = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        out = []
        for stretch in self.cut.findall(text):
            ids = self._known.get(stretch)
            out.append(ids if ids is not None else self.new_stretch(stretch))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_compiled: dict[str, Transducer] = {}


def compiled(spec: dict) -> Transducer:
    """One transducer for each worker and piece file; its memo lasts over the worker's batches."""
    if spec["key"] not in _compiled:
        _compiled.clear()
        _compiled[spec["key"]] = Transducer(spec, spec["memo"])
    return _compiled[spec["key"]]


def _spec(path: str, memo: int) -> dict:
    spec = read_pieces(path) | {"memo": memo}
    return spec | {"key": hashlib.sha1(repr(spec).encode()).hexdigest()}


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, memo: int = MEMO) -> DataFrame:
    """``ids array<int>`` of each text."""
    spec = df.sparkSession.sparkContext.broadcast(_spec(model, memo))  # a vocabulary file: a few MB at most

    def per_batch(column: pa.Array) -> list[pa.Array]:
        t = compiled(spec.value)
        ids = [t.encode(x) for x in _texts(column)]
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))]

    return map_texts(df, text_col, df.columns if keep is None else keep, "ids array<int>", per_batch)


def decode(df: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``decoded string`` of each list of ids (null list: empty text); nulls and numbers that are no ids are skipped."""
    spec = df.sparkSession.sparkContext.broadcast(_spec(model, 0))

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        t = compiled(spec.value)
        n = len(t.out)
        return pd.Series(["" if x is None else t.decode(np.array([int(i) for i in x if i == i and i is not None and 0 <= i < n], "<i4").tobytes()) for x in ids], dtype=object)

    names = [c for c in (df.columns if keep is None else keep) if c != "decoded"]
    return df.select(*[df[c] for c in names], decoded(df[ids_col]).alias("decoded"))


ROUND_TRIP = "n_pieces long, n_byte_pieces long, ids_sha256 string, decoded_sha256 string, lossless boolean"


def round_trip(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, memo: int = MEMO) -> DataFrame:
    """Digests of each text's encoding and of its decoding, in one pass.

    ids_sha256 is of the ids as 32-bit little-endian numbers, decoded_sha256 of the UTF-8 text that they decode to, and
    ``lossless`` says that this is the text again (U+2581 counting as a blank).
    """
    spec = df.sparkSession.sparkContext.broadcast(_spec(model, memo))

    def per_batch(column: pa.Array) -> list[pa.Array]:
        t = compiled(spec.value)
        rows = []
        for text in _texts(column):
            ids = t.encode(text)
            decoded = t.decode(ids)
            rows.append((len(ids) // 4, int(t.is_byte[np.frombuffer(ids, "<i4")].sum()), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == text.replace(BLANK, " ")))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return [pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]

    return map_texts(df, text_col, df.columns if keep is None else keep, ROUND_TRIP, per_batch)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
