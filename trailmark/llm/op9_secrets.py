"""Operator 9, secret scans with structural confirmation.

Base findings are pattern matches (assignments, access ids, hex runs). Every base64 and hex run of sufficient length is
decoded, also joined over line wraps, and once more where the result is itself PEM, base64 or hex. A run is
reported only when its structure holds: DER private keys whose nested lengths add up (certificates and public keys are none),
length-prefixed SSH keys with every field in place, PEM blocks around such a body (with or without header lines;
an encrypted body, told by its DEK-Info line, has no structure of its own), and signed tokens
whose header is a JSON object that names an algorithm and whose payload is one too, or is encrypted. An encoded run has the kind of what it holds.

Null or empty texts have no findings; offsets count code points. Ids and other columns pass through; repeated
rows are scanned alike; texts of any length are scanned whole; an empty table gives an empty result. Columns named secrets are replaced.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .rolling import in_slices

#: Kinds in report order; the first three are the base.
KINDS = ("assign", "access", "hex", "der", "ssh", "pem", "jwt")
_SLICE = 2_000_000
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run that is shorter fails whole, so the bound may stand in the pattern
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Fa-f])")
#: Runs over line wraps (real or written as \n): full lines of one alphabet, then a last one.
_BREAK = r"(?:[\x20\t]*(?:\r?\n|\\r\\n|\\n)[\x20\t]*)"
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)+={{0,2}}")
_WRAPPED_HEX = re.compile(rf"(?<![0-9A-Fa-f])[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]+)+(?![0-9A-Fa-f])")
_LINES = re.compile(_BREAK)
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----((?:(?:\s|\\r|\\n)*[A-Za-z][A-Za-z0-9-]*:\x20?[^\r\n\\]*(?:(?:\r?\n|\\r\\n|\\n)[\x20\t]+[^\r\n\\]+)*(?=[\r\n\\]))*)([A-Za-z0-9+/=\s\\]{20,}?)-----END \1-----")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and place of the content of the value whose length bytes start at `at`."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def der_tags(data: bytes, depth: int = 0) -> list[int] | None:
    """Tags of a DER value list whose lengths fill the data exactly, inner ones after their parent; None if broken."""
    tags, at = [], 0
    while at < len(data):
        got = _length(data, at + 1)
        if got is None or got[1] + got[0] > len(data) or depth > 8:
            return None
        size, start = got
        tags.append(data[at])
        if data[at] & 0x20:
            inner = der_tags(data[start : start + size], depth + 1)
            if inner is None:
                return None
            tags += inner
        at = start + size
    return tags


def is_der_key(data: bytes) -> bool:
    """A private key's value list: version 0 and the eight numbers of an RSA key (or the five of a DSA key), an algorithm with the wrapped or
    encrypted key, or a curve's key. Public keys, parameters, other lists of integers, and certificates are none."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    whole = _length(data, 1)
    if whole is None or whole[0] + whole[1] != len(data) or der_tags(data) is None:
        return False
    parts, at = [], whole[1]
    while at < len(data):
        size, start = _length(data, at + 1)
        parts.append((data[at], data[start : start + size]))
        at = start + size
    tags = [t for t, _ in parts]
    if set(tags) == {0x02}:
        return len(tags) in (6, 9) and parts[0][1] == b"\0" and all(len(v) > 1 for _, v in parts[1:2])
    names = lambda k: parts[k][1][:1] == b"\x06"  # noqa: E731  an algorithm starts with its object id
    if tags[:3] == [0x02, 0x30, 0x04] and names(1) or tags == [0x30, 0x04] and names(0):
        return True
    return tags[:2] == [0x02, 0x04] and all(t in (0xA0, 0xA1) for t in tags[2:]) and len(parts[1][1]) >= 16


def _fields(data: bytes) -> list[bytes] | None:
    """Length-prefixed fields that fill the data exactly."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


_SSH_NAME = re.compile(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+")


def _is_ssh_public(data: bytes) -> bool:
    fields = _fields(data)
    return fields is not None and len(fields) >= 2 and _SSH_NAME.fullmatch(fields[0]) is not None


def is_ssh_key(data: bytes) -> bool:
    """The container of private keys: cipher, derivation and its options; how many keys; each public key, and the private block. A public key alone is none."""
    if not data.startswith(b"openssh-key-v1\0"):
        return False
    data, head = data[15:], []
    for _ in range(3):
        n = int.from_bytes(data[:4], "big")
        if len(data) < 4 + n:
            return False
        head.append(data[4 : 4 + n])
        data = data[4 + n :]
    keys, rest = int.from_bytes(data[:4], "big"), _fields(data[4:])
    return bool(head[0] and head[1] and rest) and len(rest) == keys + 1 and all(map(_is_ssh_public, rest[:-1])) and len(rest[-1]) >= 16


def _base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(s: str) -> dict | None:
    data = _base64(s)
    try:
        got = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _is_token(header: str, payload: str) -> bool:
    """A header that names an algorithm, over a JSON object or an encrypted body."""
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and ("enc" in head or _json_object(payload) is not None)


def _is_pem(m: re.Match) -> bool:
    data = _base64(re.sub(r"\\r|\\n|\s", "", m[3]))
    return data is not None and (is_der_key(data) or is_ssh_key(data) or "DEK-Info:" in m[2] and len(data) >= 16)


def _kind(data: bytes | None, again: bool = True) -> int | None:
    """What decoded bytes hold: a place in KINDS, or None; again: look once into PEM, base64 or hex."""
    if data is None or len(data) < 16:
        return None
    if is_der_key(data):
        return 3
    if is_ssh_key(data):
        return 4
    if not again or max(data[:16]) >= 128 or not data.isascii():
        return None
    inner = data.decode("ascii").strip()
    if "-----BEGIN" in inner and any(_is_pem(m) for m in _PEM.finditer(inner)):
        return 5
    inner = _LINES.sub("", inner)
    if _HEX_RUN.fullmatch(inner) and len(inner) % 2 == 0 and (kind := _kind(bytes.fromhex(inner), False)) is not None:
        return kind
    return _kind(_base64(inner), False) if _BASE64.fullmatch(inner) else None


def _wrapped(text: str, pattern: re.Pattern, decode, chars: int, size: int) -> list[tuple[int, int, int]]:
    """Findings in runs over several lines, all but the last equally long; chars characters make size bytes.

    Any line may be the first, since a word of the text may stand above. The first bytes tell which line may be the last: a DER
    value its length, so that long runs without a key are decoded about once.
    """
    out = []
    for m in pattern.finditer(text):
        ends = [x.span() for x in _LINES.finditer(text, m.start(), m.end())]
        starts, stops = [m.start(), *(b for _, b in ends)], [*(a for a, _ in ends), m.end()]
        parts = [text[a:b].rstrip("=") for a, b in zip(starts, stops)]
        i, first, last = 0, 0, 0
        while i < len(parts) - 1:
            if i >= last:
                first = last = i
                while last + 1 < len(parts) and len(parts[last]) == len(parts[i]):
                    last += 1
            width = len(parts[i])
            head = decode(parts[i][:16]) if width >= 16 and last > i else None
            ways: list[int] = []
            if head and head[0] == 0x30 and (whole := _length(head, 1)):
                ways = [j for j in range(last, i, -1) if (width * (j - i) + len(parts[j])) * size // chars == sum(whole)]
            elif head and head.startswith(b"openssh-key"):
                ways = list(range(last, i, -1))
            elif head and i <= first + 1:
                ways = [j for j in (last, last - 1) if j > i]
            found = next(((j, k) for j in ways if (k := _kind(decode("".join(parts[i : j + 1])))) is not None), None)
            if found:
                out.append((starts[i], found[1], stops[found[0]]))
                i = last = found[0]
            i += 1
    return out


def _hex(s: str) -> bytes | None:
    return bytes.fromhex(s) if len(s) % 2 == 0 else None


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; kind is a place in KINDS."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out += [(m.start(), k, m.end()) for m in _BASE64.finditer(text) if (k := _kind(_base64(m[0]))) is not None]
    out += [(m.start(), k, m.end()) for m in _HEX_RUN.finditer(text) if (k := _kind(_hex(m[0]))) is not None]
    out += _wrapped(text, _WRAPPED, _base64, 4, 3) + _wrapped(text, _WRAPPED_HEX, _hex, 2, 1)
    if "-----BEGIN" in text:
        out += [(m.start(), 5, m.end()) for m in _PEM.finditer(text) if _is_pem(m)]
    if "eyJ" in text:
        out += [(m.start(), 6, m.end()) for m in _JWT.finditer(text) if _is_token(m[1], m[2])]
    return sorted(set(out))


_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with out_col appended: findings by start, then kind."""
    bound_batches(docs.sparkSession)
    kept = docs.drop(out_col)

    def run(batches):
        for whole in batches:
            for batch in in_slices(whole, text_col, _SLICE):
                texts = batch.column(text_col).to_pylist()
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t or "")] for t in texts]
                yield pa.record_batch([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(run, kept.withColumn(out_col, F.lit(None).cast(_TYPE)).schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every finding in the text replaced by a mark (overlapping findings by one)."""
    bound_batches(docs.sparkSession)

    def cleaned(text: str) -> str:
        parts, at = [], 0
        for a, _, b in find_secrets(text):
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    def run(batches):
        for whole in batches:
            for batch in in_slices(whole, text_col, _SLICE):
                texts = batch.column(text_col).to_pylist()
                new = pa.array([None if t is None else cleaned(t) for t in texts], pa.string())
                i = batch.schema.get_field_index(text_col)
                yield pa.record_batch([new if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
