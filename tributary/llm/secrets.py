"""Secret scans with structural confirmation.

Base spans are found by three patterns. Beyond them, candidates are decoded and parsed before they are reported:

* ``jwt``: three base64url parts whose first decodes to a JSON header with ``alg`` and whose second is a JSON object;
* ``pem``: an armoured private key whose body decodes to a nested DER structure or an OpenSSH key, or whose headers say
  that it is encrypted and whose body is whole cipher blocks;
* ``der``: a bare base64 or hex run that ends in DER whose nested lengths add up to the whole, holding an integer version
  first, as private keys do, or a password-based cipher and its octets (EncryptedPrivateKeyInfo);
* ``ssh``: a bare base64 run that decodes to an OpenSSH private key: the magic, and length-prefixed fields whose number of keys,
  public parts and private part add up. Public keys (``ssh-rsa AAAA...``) and certificates are no secrets.

Base64 may be of the plain or the url-safe alphabet and wrapped into lines of at least 16 characters; a key starts anywhere
in a run and ends where a line's run of letters does. Bare wrapped keys inside a reported ``pem`` are not reported again.

Edge cases: a null or empty text has no spans (the digest is that of the empty string). Overlapping spans of several
kinds are all reported. An empty table gives no rows. Columns not named in ``keep`` do not appear; a kept column with a result's name gives way.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, replace_texts, table

# The base kinds in their order, with the least length that counts (of group 2, of the match, of the match).
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
_ASSIGN_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----((?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n(?:[ \t]+[^\n]*\S[^\n]*\n)*)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
_BASE64 = re.compile(r"(?:MI[A-Za-z0-9+/]|b3B)[A-Za-z0-9+/]{36,}={0,2}")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{16,})*(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)?")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Where DER of a SEQUENCE or the OpenSSH magic may start.
_START = re.compile(r"(?=M[A-P]|b3BlbnNz)")
_SIGN = re.compile("[-_]")
_URL = str.maketrans("-_", "+/")
_MAGIC = b"openssh-key-v1\0"
_HEX_RUN = re.compile(r"[0-9a-fA-F]{64,}")
_HEX_START = re.compile(r"(?=30)")
#: Password-based ciphers: PKCS #5 and PKCS #12.
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
#: Least size in bytes of a key in DER.
LEAST_DER = 29


def unbase64(text: str, url: bool = False) -> bytes:
    """Decoded bytes, empty if the text is no base64."""
    text = "".join(text.split()).rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_items(data: bytes, lo: int, hi: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, begin, end) of the contents of DER values that fill data[lo:hi] exactly, nested ones checked too; else None."""
    out, at = [], lo
    while at < hi:
        if at + 2 > hi:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n >= 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > hi:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + n > hi:
            return None
        out.append((tag, at, at + n))
        if tag & 0x20 and (depth > 8 or der_items(data, at, at + n, depth + 1) is None):
            return None
        at += n
    return out


def is_der_key(data: bytes, lo: int = 0, hi: int | None = None) -> bool:
    """One SEQUENCE that fills data[lo:hi] and starts with a short INTEGER (a version), followed by at least one value; or
    one of a SEQUENCE that names a password-based cipher, and an OCTET STRING.
    """
    hi = len(data) if hi is None else hi
    top = der_items(data, lo, hi) if data[lo : lo + 1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    inner = der_items(data, *top[0][1:])
    if not inner or len(inner) < 2:
        return False
    (tag, begin, end), second = inner[0], inner[1]
    if tag == 2:
        return end - begin == 1
    if tag != 0x30 or len(inner) != 2 or second[0] != 4:
        return False
    cipher = der_items(data, begin, end)
    return bool(cipher) and cipher[0][0] == 6 and data[cipher[0][1] : cipher[0][2]].startswith(_PBE)


def der_size(head: bytes) -> int:
    """The size that the first bytes of a SEQUENCE state, if an INTEGER of one byte or a SEQUENCE follows; else 0."""
    if len(head) < 8 or head[0] != 0x30:
        return 0
    more = head[1] & 0x7F if head[1] >= 0x80 else 0
    if more > 4 or head[1] == 0x80:
        return 0
    inner = head[2 + more : 4 + more]
    if inner != b"\x02\x01" and inner[:1] != b"\x30":
        return 0
    return 2 + more + (int.from_bytes(head[2 : 2 + more], "big") if more else head[1])


def ssh_size(data: bytes, begin: int = 0) -> int:
    """The bytes of an OpenSSH private key at a place of the data; 0 if its fields do not add up.

    Magic; cipher, key derivation and its options; the number of keys; that many public parts, each a field that begins
    with a key type; the private part.
    """
    if not data.startswith(_MAGIC, begin):
        return 0
    at = begin + len(_MAGIC)

    def field() -> int:
        """Where the next field's contents begin, or -1."""
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return -1
        at += 4 + n
        return at - n

    if any(field() < 0 for _ in range(3)):
        return 0
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= (len(data) - begin) // 8:
        return 0
    for _ in range(keys):
        public = field()
        if public < 0 or not data[public + 4 : min(public + 12, at)].startswith((b"ssh-", b"ecdsa-", b"sk-")):
            return 0
    return at - begin if field() >= 0 else 0


class Run:
    """A run of base64 lines as one string, its places in the text, and its bytes, decoded once for each alignment."""

    def __init__(self, text: str, start: int, end: int):
        lines = [m.span() for m in _LINE.finditer(text, start, end)]
        self.begin = [a for a, _ in lines]
        self.flat = "".join([text[a:b] for a, b in lines]).translate(_URL)
        self.first = [0]
        for a, b in lines:
            self.first.append(self.first[-1] + b - a)
        # where a line, or its run of the plain alphabet, ends
        self.stops = set(self.first[1:]) | {f + m.start() - a for (a, b), f in zip(lines, self.first, strict=False) for m in _SIGN.finditer(text, a, b)}
        self.decoded: dict[int, bytes] = {}

    def place(self, k: int) -> int:
        line = bisect.bisect_right(self.first, k, 0, len(self.begin)) - 1
        return self.begin[line] + k - self.first[line]

    def bytes_at(self, k: int) -> tuple[bytes, int]:
        """Bytes of the run from its character k mod 4 on, and where character k's begin in them."""
        shift = k % 4
        if shift not in self.decoded:
            size = len(self.flat) - shift
            self.decoded[shift] = unbase64(self.flat[shift : len(self.flat) - (size % 4 == 1)])
        return self.decoded[shift], (k - shift) // 4 * 3


def bare_keys(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of keys in runs of base64, wrapped or not, of either alphabet."""
    out = []
    for found in _RUN.finditer(text):
        if not _START.search(text, *found.span()) and text.find("\n", *found.span()) < 0:
            continue
        run, after = Run(text, *found.span()), 0
        for m in _START.finditer(run.flat):
            i = m.start()
            if i < after:
                continue
            if run.flat[i] == "M":
                n = der_size(unbase64(run.flat[i : i + 16]))
                chars = (4 * n + 2) // 3
                if n < LEAST_DER or i + chars not in run.stops:
                    continue
                data, lo = run.bytes_at(i)
                if lo + n > len(data) or not is_der_key(data, lo, lo + n):
                    continue
                kind = 5
            else:
                n = ssh_size(*run.bytes_at(i)) if unbase64(run.flat[i : i + 20]).startswith(_MAGIC) else 0
                chars = (4 * n + 2) // 3
                if not n or i + chars not in run.stops:
                    continue
                kind = 6
            last = run.place(i + chars - 1)
            end = last + 1
            while text[end : end + 1] == "=" and end - last <= 2:
                end += 1
            out.append((run.place(i), kind, end))
            after = i + chars
    return out


def hex_keys(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of DER keys at the end of runs of hex digits."""
    out = []
    for run in _HEX_RUN.finditer(text):
        digits, data = run[0], {}
        for m in _HEX_START.finditer(digits):
            n = len(digits) - m.start()
            if n % 2 or n < 64 or 2 * der_size(bytes.fromhex(digits[m.start() : m.start() + 16])) != n:
                continue
            shift = m.start() % 2
            if shift not in data:
                data[shift] = bytes.fromhex(digits[shift : len(digits) - (len(digits) - shift) % 2])
            if is_der_key(data[shift], m.start() // 2):
                out.append((run.start() + m.start(), 5, run.end()))
                break
    return out


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key that fills the data."""
    return len(data) > 0 and ssh_size(data) == len(data)


def is_jwt(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        head, body = (json.loads(unbase64(x, url=True)) for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def is_pem_key(headers: str, body: str) -> bool:
    """A body of a key's structure, or of whole cipher blocks behind headers that say so."""
    data = unbase64(body)
    return is_der_key(data) or is_ssh_key(data) or ("ENCRYPTED" in headers and "DEK-Info:" in headers and len(data) >= LEAST_DER and len(data) % 8 == 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base kinds, leftmost non-overlapping for each."""
    out = []
    low = text.lower()
    if any(k in low for k in _ASSIGN_KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of candidates whose decoded structure is a key's or a signed token's."""
    out = []
    if "eyJ" in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_jwt(m[0])]
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), 4, m.end()) for m in _PEM.finditer(text) if is_pem_key(m[2], m[3])]
    bare: dict[tuple[int, int], int] = {}
    if "MI" in text or "b3B" in text:
        for m in _BASE64.finditer(text):
            data = unbase64(m[0])
            if is_der_key(data):
                bare[m.start(), 5] = m.end()
            elif is_ssh_key(data):
                bare[m.start(), 6] = m.end()
    armoured = [(a, b) for a, kind, b in out if kind == 4]
    for a, kind, b in bare_keys(text):
        if not any(x <= a and b <= y for x, y in armoured):
            bare[a, kind] = max(b, bare.get((a, kind), 0))
    out += [(a, kind, b) for (a, kind), b in bare.items()]
    return out + hex_keys(text)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


RESULTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Secrets of each text: base counts and digest, all spans as kind:start:end in code points, confirmed ones counted."""

    def per_batch(column: pa.Array) -> list[pa.Array]:
        rows = []
        for text in column.to_pylist():
            text = text or ""
            base, more = base_spans(text), confirmed_spans(text)
            rows.append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

    return map_texts(df, text_col, df.columns if keep is None else keep, RESULTS, per_batch)


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping or touching secret spans replaced by ``mark``."""
    out, at = [], 0
    spans = sorted((a, b) for a, _, b in base_spans(text) + confirmed_spans(text))
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with the secrets in ``text_col`` replaced by ``mark``; a null text stays null."""
    return replace_texts(df, text_col, lambda column: pa.array([None if t is None else redacted(t, mark) for t in column.to_pylist()], pa.string()))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
