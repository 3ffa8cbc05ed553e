"""Secret scan with structural confirmation.

Base patterns (assign, access, hex) mark candidates by shape. The operator then decodes every long
base64, base64url and hex run and confirms what it is by structure:

* ``jwt``: three base64url parts; the header is a JSON object with an ``alg`` that is a known
  signature name, the claims are a JSON object, and the signature's length is right for ``alg``;
* ``pem``: armour lines whose label names what the body decodes to; an encrypted body of the old
  form has its two headers and is made of whole cipher blocks;
* ``der``: a run that decodes to a private key in DER: nested lengths fill each other exactly and the
  fields are those of PKCS#1, SEC1, DSA, PKCS#8 or encrypted PKCS#8;
* ``openssh``: a run that decodes to an OpenSSH private key, its length-prefixed fields filling it;
* ``jwe``: five base64url parts; the header names a known content encryption, and initialisation vector and tag have its lengths.

What a run decodes to is scanned again where it is text, ``LAYERS`` deep, so a key in base64 or hex is found in another coat of these;
the span is that of the outer run. Armour may stand in quoted lines (``> ``) or in string literals that are put together
line by line, and hex may have colons.

Each text is scanned whole by itself, so the job is one pass over the table without a shuffle. The
time is linear in the text: armour lines are paired in one walk, lines of encoded characters are
joined once, and a key that starts anywhere in them is read by its lengths without decoding the rest.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "openssh", "jwe")
#: Coats of base64 or hex around a secret that are taken off at most; each leaves three quarters or half of a text.
LAYERS = 2

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_long_hex = re.compile(r"[0-9a-f]{24,}")
_jwt = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
_jwe = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]{16,})")
_armour = re.compile(r"-----(BEGIN|END) ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: Line ends and other characters that string literals write with a backslash, once or more often.
_escaped_end = re.compile(r"(?<!\\)\\++(?:[nrt]|(?=\s))")
_escaped_char = re.compile(r"(?<!\\)\\++(?:u00(2[bBfF]|3[dD])|(?=/))")
#: What marks a line as quoted, and what stands between the literals of lines that are put together.
_quoted = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
_literals = re.compile(r"(?:\\+[nr])*[\"'][ \t]*[+.,]?[ \t]*(?:\\[ \t]*)?\r?\n[ \t]*(?:[+.][ \t]*)?[\"']")
#: The two headers of an encrypted body, and the bytes of a block by cipher (fixed values of that format).
_headed = re.compile(r"Proc-Type:\x20*4,\x20*ENCRYPTED\s+DEK-Info:\x20*([A-Z0-9-]+),([0-9A-Fa-f]+)\s+")
BLOCK_BYTES = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
#: What a body under each label decodes to.
LABELS = {"RSA PRIVATE KEY": "pkcs1", "EC PRIVATE KEY": "sec1", "DSA PRIVATE KEY": "dsa", "PRIVATE KEY": "pkcs8", "ENCRYPTED PRIVATE KEY": "pkcs8-encrypted", "OPENSSH PRIVATE KEY": "openssh"}
_run64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_run16 = re.compile(r"[0-9A-Fa-f]{80,}")
_run_colons = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:\s*){39,}[0-9A-Fa-f]{2}(?![0-9A-Fa-f])")
#: Where a key that goes on over line ends may start (a DER sequence, the OpenSSH magic or armour in base64), a line of it, and what may part its lines.
_start = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))"
_start64 = re.compile(_start + r"(?:M[A-P]|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
_start16 = re.compile(_start + r"30[0-9A-Fa-f]{2}")
_line64 = re.compile(r"[A-Za-z0-9+/_-]+")
_line16 = re.compile(r"[0-9A-Fa-f]+")
_line_end = re.compile(r"(?:[ \t]*(?:\r?\n|\\+(?:[nrt]|\r?\n)))+[ \t]*")

#: Signature bytes by algorithm name (fixed values of the signed-token standard); None: set by the key.
SIGNATURE_BYTES = {
    "HS256": 32, "HS384": 48, "HS512": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None,
    "ES256": 64, "ES384": 96, "ES512": 132, "ES256K": 64, "EdDSA": None, "none": 0,
}

#: Bytes of initialisation vector and tag by content encryption (fixed values of the encrypted-token standard).
CONTENT = {"A128CBC-HS256": (16, 16), "A192CBC-HS384": (16, 24), "A256CBC-HS512": (16, 32), "A128GCM": (12, 16), "A192GCM": (12, 16), "A256GCM": (12, 16)}


def decoded64(run: str) -> bytes | None:
    """A base64 or base64url run, padded or not; None if it cannot be one."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def decoded16(run: str) -> bytes | None:
    return bytes.fromhex(run) if len(run) % 2 == 0 else None


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at ``at``; None unless its length is minimal and fits before ``end``."""
    if at + 2 > end:
        return None
    tag, length, start = data[at], data[at + 1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or start + n > end:
            return None
        length = int.from_bytes(data[start : start + n], "big")
        start += n
        if length < 0x80 or length >> (8 * (n - 1)) == 0:
            return None
    return (tag, start, start + length) if start + length <= end else None


def children(data, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``start`` to ``end`` exactly; None if they do not, or are more than the ten that any key has."""
    found = []
    while start < end:
        one = der(data, start, end)
        if one is None or len(found) == 10:
            return None
        found.append(one)
        start = one[2]
    return found


def private_der(data) -> str | None:
    """pkcs1, sec1, dsa, pkcs8 or pkcs8-encrypted if ``data`` is such a key from end to end."""
    if len(data) < 24 or data[0] != 0x30:
        return None
    top = der(data, 0, len(data))
    if top is None or top[2] != len(data):
        return None
    parts = children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return None
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9 and parts[0][2] - parts[0][1] == 1 and tags[9:] in ([], [0x30]) and all(p[2] > p[1] for p in parts):
        return "pkcs1"
    if tags == [2] * 6 and data[parts[0][1] : parts[0][2]] == b"\x00" and all(p[2] > p[1] for p in parts):
        return "dsa"
    if tags[:2] == [2, 4] and data[parts[0][1] : parts[0][2]] == b"\x01" and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1]) and 16 <= parts[1][2] - parts[1][1] <= 72:
        return "sec1"
    if tags[:3] == [2, 0x30, 4] and data[parts[0][1] : parts[0][2]] in (b"\x00", b"\x01") and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        inner = children(data, parts[1][1], parts[1][2])
        return "pkcs8" if inner and inner[0][0] == 6 else None
    if tags == [0x30, 4]:
        inner = children(data, parts[0][1], parts[0][2])
        return "pkcs8-encrypted" if inner and inner[0][0] == 6 and len(inner) == 2 else None
    return None


def private_openssh(data) -> bool:
    """Whether ``data`` is an OpenSSH private key whose fields fill it."""
    size = openssh_fields(data)
    return size is not None and len(data) - size <= 16  # an authentication tag may follow


def openssh_fields(data) -> int | None:
    """Where the fields of the OpenSSH private key that ``data`` begins with end; the format has room for several keys, its files hold one."""
    magic = b"openssh-key-v1\x00"
    if data[: len(magic)] != magic:
        return None
    at = len(magic)
    for turn in range(6):  # cipher, key derivation, its options, number of keys, public key, private part
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if turn == 3:
            if n != 1:
                return None
        elif at + n > len(data) or (turn > 3 and n < 8):
            return None
        else:
            at += n
    return at


class Encoded:
    """The bytes that a run of base64 or hex characters stands for, decoded only where they are read."""

    def __init__(self, chars: str, start: int, end: int, is64: bool):
        self.chars, self.start, self.end, self.is64 = chars, start, end, is64

    def __len__(self) -> int:
        return (self.end - self.start) * 3 // 4 if self.is64 else (self.end - self.start) // 2

    def __getitem__(self, at):
        if isinstance(at, int):
            return self[at : at + 1][0]
        low, high = at.start or 0, min(at.stop, len(self))
        if high <= low:
            return b""
        if not self.is64:
            return bytes.fromhex(self.chars[self.start + 2 * low : self.start + 2 * high])
        body = self.chars[self.start + low // 3 * 4 : min(self.end, self.start + -(-high // 3) * 4)]
        return decoded64(body)[low % 3 : low % 3 + high - low]


def signed_token(head: str, claims: str, signature: str) -> bool:
    raw_head, raw_claims, raw_signature = decoded64(head), decoded64(claims), decoded64(signature) if signature else b""
    if raw_head is None or raw_claims is None or raw_signature is None:
        return False
    try:
        head_json, claims_json = json.loads(raw_head), json.loads(raw_claims)
    except (ValueError, RecursionError):
        return False
    if not isinstance(head_json, dict) or not isinstance(claims_json, dict) or not isinstance(head_json.get("alg"), str) or head_json["alg"] not in SIGNATURE_BYTES:
        return False
    size = SIGNATURE_BYTES[head_json["alg"]]
    return len(raw_signature) == size if size is not None else len(raw_signature) >= 64


def encrypted_token(head: str, key: str, vector: str, text: str, tag: str) -> bool:
    raw = [decoded64(x) if x else b"" for x in (head, key, vector, text, tag)]
    if any(x is None for x in raw):
        return False
    try:
        told = json.loads(raw[0])
    except (ValueError, RecursionError):
        return False
    if not isinstance(told, dict) or not isinstance(told.get("alg"), str) or not isinstance(told.get("enc"), str):
        return False
    return CONTENT.get(told["enc"]) == (len(raw[2]), len(raw[4])) and (bool(raw[1]) or told["alg"] in ("dir", "ECDH-ES"))


def inner_kind(data: bytes, depth: int) -> int | None:
    """The kind of the first secret in what a run decodes to, if that is text."""
    if depth >= LAYERS or not data[:64].isascii() or not data.isascii():
        return None
    found = confirmed_spans(data.decode("ascii"), depth + 1)
    return min(found)[1] if found else None


def extent(data: bytes) -> int | None:
    """Bytes of the DER key that ``data`` begins with, as far as the start tells; None if it is no key's start."""
    if data[:1] == b"0" and len(data) >= 8:
        length, at = data[1], 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4:
                return None
            length, at = int.from_bytes(data[2 : 2 + n], "big"), 2 + n
        return at + length if data[at : at + 1] in (b"\x02", b"0") else None
    return None


class Lines:
    """Lines of encoded characters that follow each other from ``at`` on, joined once for all keys that start in them."""

    def __init__(self, text: str, at: int, line: re.Pattern):
        self.starts, self.ends, self.before, pieces = [], [], [0], []
        self.told = -1  # up to where they have been read as a coat
        while m := line.match(text, at):
            pieces.append(m[0])
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.before.append(self.before[-1] + len(m[0]))
            gap = _line_end.match(text, m.end())
            if not gap:
                break
            at = gap.end()
        self.chars = "".join(pieces)


def joined(text: str, lines: Lines, i: int, is64: bool) -> tuple[int, int] | None:
    """(place of the kind, end) of the key that starts with line ``i`` and may go on in the next ones; its own lengths say where it ends."""
    start, stop = lines.before[i], lines.before[-1]
    head = Encoded(lines.chars, start, min(stop, start + 32), is64)[0:12]
    need = extent(head)
    if need is not None:
        chars = -(-need * 4 // 3) if is64 else need * 2
        at = bisect_left(lines.before, start + chars)
        if at == len(lines.before) or lines.before[at] != start + chars or not private_der(Encoded(lines.chars, start, start + chars, is64)):
            return None
        end, kind = lines.ends[at - 1], 5
    elif is64 and lines.chars.startswith("b3BlbnNzaC1rZXktdjEA", start):
        size = openssh_fields(Encoded(lines.chars, start, stop, True))
        if size is None:
            return None
        at = bisect_left(lines.before, start + -(-size * 4 // 3))
        if at == len(lines.before) or (lines.before[at] - start) * 3 // 4 > size + 16:
            return None
        end, kind = lines.ends[at - 1], 6
    else:
        return None
    if is64:
        while text[end : end + 1] == "=" and end - lines.ends[at - 1] < 2:
            end += 1
    return kind, end


def wrapped(text: str, lines: Lines, i: int, depth: int) -> tuple[int, int] | None:
    """(place of the kind, end) of armour in base64 that starts with line ``i`` and goes on in the next ones; all of them are its coat."""
    start = lines.before[i]
    if depth >= LAYERS or not lines.chars.startswith("LS0tLS1CRUdJTi", start) or lines.told > start:
        return None
    lines.told = len(lines.chars)  # read once, however many starts there are
    data = decoded64(lines.chars[start:])
    kind = inner_kind(data, depth) if data else None
    if kind is None:
        return None
    end = lines.ends[-1]
    while text[end : end + 1] == "=" and end - lines.ends[-1] < 2:
        end += 1
    return kind, end


def armoured(label: str, body: str) -> bool:
    """Whether ``body`` is what armour of ``label`` holds."""
    body = _literals.sub("\n", body) if '"' in body or "'" in body else body
    body = _escaped_end.sub("\n", body) if "\\" in body else body
    body = _quoted.sub("", body) if ">" in body else body
    body = _escaped_char.sub(lambda c: chr(int(c[1], 16)) if c[1] else "", body) if "\\" in body else body
    body, headed = body.strip(), None
    if label in ("RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY") and (headed := _headed.match(body)):
        body = body[headed.end() :]
    data = decoded64("".join(body.split()))
    if not data or label not in LABELS:
        return False
    if headed:  # an encrypted body is not DER
        size = BLOCK_BYTES.get(headed[1])
        return size is not None and len(headed[2]) == 2 * size and len(data) >= 2 * size and len(data) % size == 0
    return private_openssh(data) if label == "OPENSSH PRIVATE KEY" else private_der(data) == LABELS[label]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the three base patterns."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _long_hex.finditer(text)]
    return found


def confirmed_spans(text: str, depth: int = 0) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the spans that only their structure shows to be secrets; ``depth`` coats have been taken off."""
    found = []
    for m in _jwe.finditer(text) if "." in text else ():
        if encrypted_token(*m.groups()):
            found.append((m.start(), 7, m.end()))
    for m in _jwt.finditer(text) if "." in text else ():
        if signed_token(m[1], m[2], m[3]):
            found.append((m.start(), 3, m.end()))
    armour: list[tuple[int, int]] = []
    begin = None
    for m in _armour.finditer(text) if "PRIVATE KEY-----" in text else ():
        if m[1] == "END" and begin is not None and begin[2] == m[2] and armoured(m[2], text[begin.end() : m.start()]):
            armour.append((begin.start(), m.end()))
        begin = m if m[1] == "BEGIN" else None
    found += [(a, 4, b) for a, b in armour]

    def inside(at: int) -> bool:
        k = bisect_right(armour, (at, len(text))) - 1
        return k >= 0 and at < armour[k][1]

    known = set()
    for pattern, decode in ((_run64, decoded64), (_run16, decoded16), (_run_colons, lambda run: bytes.fromhex(run.replace(":", "")))):
        for m in pattern.finditer(text) if pattern is not _run_colons or ":" in text else ():
            data = decode(m[0])
            kind = None if not data or inside(m.start()) else 5 if private_der(data) else 6 if private_openssh(data) else inner_kind(data, depth)
            if kind and not (known and pattern is _run16 and m.start() in known):
                found.append((m.start(), kind, m.end()))
                known.add(m.start())
    for pattern, line, is64 in ((_start64, _line64, True), (_start16, _line16, False)):
        lines, place = None, {}
        for m in pattern.finditer(text):
            at = m.start()
            if at in known or inside(at):
                continue
            if at not in place:
                if not starts_key(text, at, is64):
                    continue
                lines = Lines(text, at, line)
                place = {start: i for i, start in enumerate(lines.starts)}
            if one := joined(text, lines, place[at], is64) or wrapped(text, lines, place[at], depth if is64 else LAYERS):
                found.append((at, *one))
    return found


def starts_key(text: str, at: int, is64: bool) -> bool:
    """Whether the first characters at ``at`` may start a key, so that its lines are worth joining."""
    if is64 and text.startswith(("b3BlbnNzaC1rZXktdjEA", "LS0tLS1CRUdJTi"), at):
        return True
    head = (_line64 if is64 else _line16).match(text, at, at + (16 if is64 else 24))[0]
    head = head[: len(head) // 4 * 4] if is64 else head[: len(head) // 2 * 2]
    return len(head) >= 12 and extent((decoded64 if is64 else decoded16)(head) or b"") is not None


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (unless left out) and its spans (kind, start, end in code points), sorted.

    A null text has no spans, as an empty one. Repeated rows and null ids are scanned like others.
    An empty table gives no rows. Extra columns, whatever their names, are neither read nor returned.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def found(batches):
        for batch in batches:
            spans = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted({*base_spans(text), *confirmed_spans(text)})])
            own = ["doc_id", "text"] if with_text else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(spans, kind)], [*own, "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    text = "text string, " if with_text else ""
    return rows.mapInArrow(found, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {text}spans array<struct<kind string, start long, end long>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the operator's spans written as text; one row per row of ``docs``."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scan(docs, with_text=False).select("doc_id", *map(count, KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of :func:`op1_secret_scan` that its SQL can say too."""
    return op1_secret_scan(spark, sf_dir).drop("spans")


_PATTERNS = {
    "assign": """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}
_MATCHES = " UNION ALL ".join(
    f"SELECT n, {place} AS place, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(regexp_extract_all(text, '{pattern}', {2 if kind == 'assign' else 0})) AS long, "
    f"unnest(string_split_regex(text, '{pattern}')[: len(regexp_extract_all(text, '{pattern}'))]) AS gap, unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM t"
    for place, (kind, pattern) in enumerate(_PATTERNS.items())
)
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_MATCHES}),
s AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY n, kind ORDER BY i) AS BIGINT) AS stop FROM m),
k AS (SELECT n, place, kind, stop - length(hit) AS start, stop FROM s WHERE length(long) >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 24 END),
g AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS w FROM k GROUP BY n)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(w, '')) AS base_sha256 FROM t LEFT JOIN g USING (n)
"""
