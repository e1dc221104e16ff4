"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and long hex runs. Candidates in base64 or hex are decoded, and reported
only if what they hold parses: a signed token's header is JSON with an algorithm, DER nests lengths that fill their
container exactly, an SSH key is a sequence of length-prefixed strings. Line ends may be escaped (JSON, .env), keys may be
wrapped in lines of one width with any indentation, and base64 may have either alphabet.

Null text counts as empty: no span. Spans are in code points, end exclusive; equal spans of different kinds are all kept.
Repeated rows are scanned each, an empty table gives no rows; a column of the input called spans is replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import unlike

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), lambda m: True),
}
#: Parts of a signed token, joined by dots; how its header begins, and how one with white space before or after the brace does.
PARTS = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
HEADER = re.compile(r"(?:e[yw]|I[ACH]|C[QSXgin]|D[QSX])[A-Za-z0-9_-]{10,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([^-]*+(?:-(?!----)[^-]*+)*+)-----END \1-----")
PEM_HEADER = re.compile(r"\s*([A-Za-z][A-Za-z0-9-]*):[^\S\n]*([^\n]*)\n")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s]*")
BLOB = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
URL_BLOB = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_-]{39,}={0,2}")
HEX = re.compile(r"(?:[0-9a-fA-F]{2}){32,}")
_NEXT = r"[ \t]*\\?\r?\n\s*"
#: Two lines or more of base64 or hex, the first of the length that one line needs; the lines; how keys may begin.
WRAPPED = [
    (re.compile(rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{40,}}+(?:{_NEXT}[A-Za-z0-9+/]+)+={{0,2}}"), re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"M[A-P]|AAAA|b3Bl")),
    (re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{40,}}+(?:{_NEXT}[A-Za-z0-9_-]+)+={{0,2}}"), re.compile(r"[A-Za-z0-9_-]+={0,2}"), re.compile(r"M[A-P]|AAAA|b3Bl")),
    (re.compile(rf"(?<![0-9a-fA-F])[0-9a-fA-F]{{64,}}+(?:{_NEXT}[0-9a-fA-F]+)+"), re.compile(r"[0-9a-fA-F]+"), re.compile(r"30|000000|6f70656e", re.I)),
]
#: Escaped line ends and tabs.
ESCAPED = re.compile(r"\\+[nrt]")
#: Texts that match none of these (a linear-time engine) hold no span of any kind.
SCREEN = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|eyJ|(?:e[yw]|I[ACH]|C[QSXgin]|D[QSX])[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.|-----BEGIN |[A-Za-z0-9+/]{40}|[A-Za-z0-9_-]{40}|[0-9a-fA-F]{64}"


def _decoded(text: str) -> bytes:
    body = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(body[: len(body) - (len(body) % 4 == 1)] + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return b""


def _object(part: str) -> dict | None:
    """What a part of a token decodes to, if it is a JSON object."""
    try:
        found = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Spans of signed tokens: the header is a JSON object that names an algorithm, the claims are one too. Each part is decoded twice at most."""
    for m in PARTS.finditer(text):
        parts = m[0].split(".")
        begins = [m.start()]
        for p in parts:
            begins.append(begins[-1] + len(p) + 1)
        k = 0
        while k + 2 < len(parts):
            part = parts[k]
            starts = {0} if HEADER.match(part) else set()
            if (at := part.find("eyJ")) >= 0:
                starts.add(at)
            found = [at for at in sorted(starts) if parts[k + 1] and isinstance((_object(part[at:]) or {}).get("alg"), str)]
            if found and _object(parts[k + 1]) is not None:
                yield begins[k] + found[0], begins[k + 2] + len(parts[k + 2])
                k += 2
            k += 1


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, start and end of the values that fill raw[at:end] exactly; None if they don't."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 128:
            width = n & 127
            if not 1 <= width <= 4 or at + width > end:
                return None
            n = int.from_bytes(raw[at : at + width], "big")
            at += width
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def is_der(raw: bytes) -> bool:
    """One SEQUENCE that fills the bytes and holds two or more values, its own sequences nesting in turn, with an integer, bit or octet string of 8 bytes or more."""
    if len(raw) < 24 or raw[0] != 0x30:
        return False
    todo, large = [(0, len(raw))], False
    top = _elements(raw, 0, len(raw))
    if not top or len(top) != 1 or len(_elements(raw, *top[0][1:]) or []) < 2:
        return False
    while todo:
        inner = _elements(raw, *todo.pop())
        if inner is None:
            return False
        todo += [(a, b) for tag, a, b in inner if tag & 0x20]
        large |= any(tag in (2, 3, 4) and b - a >= 8 for tag, a, b in inner)
    return large


def _names_key(raw: bytes) -> bool:
    """Whether the bytes begin with the length-prefixed name of a key type."""
    n = int.from_bytes(raw[:4], "big")
    return n <= 64 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", raw[4 : 4 + n]) is not None


def is_ssh(raw: bytes) -> bool:
    """An OpenSSH container or length-prefixed strings that fill the bytes, the first a key type."""
    if raw.startswith(b"openssh-key-v1\0"):
        return _own_length(raw) == len(raw)
    at, n_parts = 0, 0
    if not _names_key(raw):
        return False
    while at + 4 <= len(raw):
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
        n_parts += 1
    return at == len(raw) and n_parts >= 2


def is_pem(body: str) -> bool:
    """DER or an SSH key under optional headers, or what such headers say is encrypted: whole blocks of the cipher."""
    headers, at = {}, 0
    while m := PEM_HEADER.match(body, at):
        headers[m[1].lower()] = m[2].strip()
        at = m.end()
    if not PEM_BODY.fullmatch(body, at):
        return False
    raw = _decoded(body[at:])
    if "ENCRYPTED" in headers.get("proc-type", ""):
        vector = re.fullmatch(r"[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{2})+)", headers.get("dek-info", ""))
        return vector is not None and len(raw) >= 16 and len(raw) % (len(vector[1]) // 2) == 0
    return is_der(raw) or is_ssh(raw)


def _own_length(raw: bytes) -> int | None:
    """Bytes that a DER value or an OpenSSH container takes by its own account; None for others."""
    if raw[:1] == b"\x30" and len(raw) > 6:
        width = raw[1] & 127 if raw[1] & 128 else 0
        return 2 + width + (int.from_bytes(raw[2 : 2 + width], "big") if width else raw[1])
    if raw.startswith(b"openssh-key-v1\0"):
        at, left = 15, 3
        while left and at + 4 <= len(raw):  # cipher, key function and its options
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
            left -= 1
        if not left and at + 4 <= len(raw) and (keys := int.from_bytes(raw[at : at + 4], "big")):
            at, left = at + 4, keys + 1  # public keys and the private part
            while left and at + 4 <= len(raw):
                at += 4 + int.from_bytes(raw[at : at + 4], "big")
                left -= 1
            return None if left else at
    return None


def _wrapped(text: str) -> list[tuple[int, int, str]]:
    """Keys in lines of one width, the last one as long at most. Where a key begins, it says itself where it ends, or it ends with the lines of its width or the shorter one after them."""
    out = []
    for block, line, begins in WRAPPED:
        digits = line is WRAPPED[-1][1]
        for m in block.finditer(text):
            spans = [x.span() for x in line.finditer(text, *m.span())]
            sizes = [len(text[a:b].rstrip("=")) for a, b in spans]
            decode = (lambda x: bytes.fromhex(x[: len(x) // 2 * 2])) if digits else _decoded
            run = len(spans)  # where lines of one size end
            for i in range(len(spans) - 1, -1, -1):
                start = spans[i][0]
                if i + 1 < len(spans) and sizes[i + 1] != sizes[i]:
                    run = i + 1
                if not begins.match(text, start):
                    continue
                head = decode(text[start : start + min(sizes[i], 128)])
                der, openssh = head[:1] == b"\x30", head.startswith(b"openssh-key-v1\0")
                if not (der or openssh or _names_key(head)):
                    continue
                last = run + (run < len(spans) and sizes[run] < sizes[i])
                if der:  # it says itself how long it is
                    n = _own_length(head)
                    last = min(last, i - (-(2 * n if digits else -(-4 * n // 3)) // sizes[i])) if n else i
                joined = "".join(text[a:b].rstrip("=") for a, b in spans[i:last])
                n = _own_length(decode(joined)) if der or openssh else None
                for end in range(i + 1, last + 1) if n is not None else range(run, last + 1):
                    size = sizes[i] * (min(end, run) - i) + (sizes[end - 1] if end > run else 0)
                    if n is not None and size != (2 * n if digits else -(-4 * n // 3)):
                        continue
                    raw = decode(joined[:size])
                    if is_der(raw):
                        out.append((start, spans[end - 1][1], "der"))
                    elif is_ssh(raw):
                        out.append((start, spans[end - 1][1], "ssh"))
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind."""
    out = []
    for kind, (pattern, holds) in BASE.items():
        out += [(*m.span(), kind) for m in pattern.finditer(text) if holds(m)]
    plain = ESCAPED.sub(lambda m: " " * (len(m[0]) - 1) + "\n", text)  # of the same length
    out += [(a, b, "jwt") for a, b in tokens(plain)]
    out += [(*m.span(), "pem") for m in PEM.finditer(plain) if is_pem(m[2])]
    out += _wrapped(plain)
    for pattern, decode in ((BLOB, _decoded), (URL_BLOB, _decoded), (HEX, lambda x: bytes.fromhex(x))):
        for m in pattern.finditer(plain):
            raw = decode(m[0])
            if is_der(raw):
                out.append((*m.span(), "der"))
            elif is_ssh(raw):
                out.append((*m.span(), "ssh"))
    return sorted(set(out), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` with spans array<struct<start, end, kind>>, which replaces a column of that name."""
    keep = unlike(keep, "spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("~text")
            hit = pc.match_substring_regex(text, SCREEN).to_pylist()
            spans = [[{"start": a, "end": b, "kind": k} for a, b, k in find(text[i].as_py())] if h else [] for i, h in enumerate(hit)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, kind)], names=[*keep, "spans"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("~text")).mapInArrow(scanned, f"{fields}spans array<struct<start:int,end:int,kind:string>>")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span, overlapping ones merged, replaced by the mark; other columns stay."""
    columns = docs.columns
    place = [c.lower() for c in columns].index("text")

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(place)
            out = text.to_pylist()
            for i, h in enumerate(pc.match_substring_regex(text, SCREEN).to_pylist()):
                if h and (spans := find(out[i])):
                    parts, at = [], 0
                    for a, b, _ in spans:
                        if a >= at:
                            parts += [out[i][at:a], mark]
                        at = max(at, b)
                    out[i] = "".join(parts) + out[i][at:]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == place else batch.column(i) for i in range(len(columns))], names=columns)

    return docs.mapInArrow(redacted, docs.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
