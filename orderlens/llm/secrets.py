"""Secret scans with structural confirmation.

Base rules report assignments, access keys and hex runs by pattern.  The
method adds what decodes to a key or a signed token: base64 and hex
candidates are decoded and reported only if the bytes parse as a key
encoding (DER whose nested lengths fill their parents exactly and whose
values are those of PKCS#1, PKCS#8, PKCS#12, SEC1, DSA or a public key, an
OpenSSH private key, an SSH public key of length-prefixed fields), PEM blocks only
if their body does or their header lines say that it is encrypted, and dotted
tokens only if the first part is a JSON header that names an algorithm.
Keys over several lines are read without escaped line ends, quote and comment
marks and string quotes; outside a PEM block they are one span of kind key,
inside it they are told by the block alone.  Public keys count as keys;
signatures, certificates, requests and revocation lists do not.

Defined results: a null or empty text has no spans; spans are in code
points, end exclusive, ordered by start, then by kind as listed in KINDS;
repeated rows each get their own result; no rows give no rows.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "key", "token")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")           # a run begins once, so 20 characters or more is the same as a filter after
HEX = re.compile(r"[0-9a-f]{24,}")
BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----")
LINE_END = r"(?:\\+r\\+n|\\+[nr]|\\+u000[aAdD]|\r\n?|\n)"
HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:")
ENCRYPTED = re.compile(r"Proc-Type:\s*4\s*,\s*ENCRYPTED\b"), re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+(?:\s*,\s*[0-9A-Fa-f]+)?")
STRING_END = re.compile(r"""["'`][\s+.,;&)\\]*$""")
STRING_START = re.compile(r"""^[\s+.&(]*["'`]""")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}")
#: Between two lines of one key: a line end with marks of a quote or comment, or the end and start of a source string.
BETWEEN = rf"""(?:[ \t]*{LINE_END}(?:[ \t>#*;%|]|//(?=[ \t]))*|(?:\\+r)?(?:\\+n)?["'][ \t]*[+.,\\]?[ \t]*\r?\n[ \t]*[+.]?[ \t]*["'])"""
FIRST_LINE = re.compile(rf"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P]|AAAA|b3Bl)[A-Za-z0-9+/_-]++(?={BETWEEN}[A-Za-z0-9+/_-])")
NEXT_LINE = re.compile(rf"{BETWEEN}([A-Za-z0-9+/_-]++)")
LEAST_KEY = 32                      # characters of a key in base64
LEAST_MODULUS, MOST_EXPONENT = 64, 8        # bytes of the two numbers of a public RSA key; a signature's are alike
#: Length-prefixed fields of an SSH public key; those of other types (certificates) go on as far as the lines do.
SSH_FIELDS = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3,
              b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4}
LEAST_CIPHER = 16                   # bytes of an encrypted key
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}+(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{14,}+)\.[A-Za-z0-9_-]++\.([A-Za-z0-9_-]*+))")        # {"alg":""} has 14 characters
OPENSSH = b"openssh-key-v1\0"
SSH_TYPE = re.compile(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-")
PADDING = re.compile("={0,2}")
SPAN = "array<struct<kind:string,start:int,end:int>>"


INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _der_values(data: bytes, start: int, end: int, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill ``data[start:end]`` exactly, containers checked within; None if they do not."""
    values = []
    while start < end:
        if start + 2 > end or depth > 16:
            return None
        tag, length, start = data[start], data[start + 1], start + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or start + size > end:
                return None
            length, start = int.from_bytes(data[start:start + size]), start + size
        if start + length > end or (tag & 0x20 and _der_values(data, start, start + length, depth + 1) is None):
            return None
        values.append((tag, start, start + length))
        start += length
    return values


def _is_der_key(data: bytes) -> bool:
    """Whether the bytes are one DER sequence with the values of a key, private or public."""
    outer = _der_values(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    values = _der_values(data, *outer[0][1:])
    tags = [v[0] for v in values]

    def algorithm(i: int) -> bool:
        return tags[i] == SEQUENCE and [v[0] for v in _der_values(data, *values[i][1:])][:1] == [OID]

    if tags[:2] == [SEQUENCE, BITS] or tags[:2] == [SEQUENCE, OCTETS]:
        return len(tags) == 2 and algorithm(0)              # public key; encrypted PKCS#8
    if len(tags) < 2 or tags[0] != INTEGER:
        return False
    size = [b - a for _, a, b in values]
    if tags == [INTEGER, INTEGER]:                          # public PKCS#1
        return size[0] >= LEAST_MODULUS and size[1] <= MOST_EXPONENT
    version = data[values[0][1]] if size[0] == 1 else -1
    if version in (0, 1) and tags[:9] == [INTEGER] * 9:     # PKCS#1, with further primes in version 1
        return tags[9:] in ([], [SEQUENCE])
    if version == 0 and tags == [INTEGER] * 6:              # DSA
        return True
    if version == 1 and tags[1] == OCTETS:                  # SEC1
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS]:       # PKCS#8
        return algorithm(1) and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:])
    return version == 3 and algorithm(1) and tags[2:] in ([], [SEQUENCE])       # PKCS#12


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly."""
    found, at = [], 0
    while at < len(data):
        end = at + 4 + int.from_bytes(data[at:at + 4])
        if end > len(data) or at + 4 > len(data):
            return None
        found.append(data[at + 4:end])
        at = end
    return found


def _reach(data: bytes) -> int | None:
    """How many bytes the key that ``data`` begins with has, as far as its own lengths tell; None if it begins no key."""
    if data[:1] == b"\x30" and len(data) > 6:
        size = data[1] & 0x7F if data[1] >= 0x80 else 0
        return 2 + size + (int.from_bytes(data[2:2 + size]) if size else data[1]) if size <= 4 else None

    def after(at: int, fields: float) -> int:
        while fields and at + 4 <= len(data):
            at, fields = at + 4 + int.from_bytes(data[at:at + 4]), fields - 1
        return at + 4 if fields else at

    if data.startswith(OPENSSH):                    # cipher, kdf, its options, the number of keys, the public keys, the private ones
        at = after(len(OPENSSH), 3)
        return after(at + 4, int.from_bytes(data[at:at + 4]) + 1) if at + 4 <= len(data) else at + 4
    if SSH_TYPE.match(data[4:]):
        return after(0, SSH_FIELDS.get(data[4:4 + int.from_bytes(data[:4])], float("inf")))
    return None


def is_key(data: bytes) -> bool:
    """Whether the bytes are a key encoding."""
    if data.startswith(OPENSSH):
        return _reach(data) == len(data)
    if data[:1] == b"\x30":
        return _is_der_key(data)
    if data[:3] == b"\0\0\0" and len(data) > 4:
        fields = _fields(data)
        return bool(fields) and len(fields) >= 2 and re.fullmatch(rb"(ssh|ecdsa|sk-ssh|sk-ecdsa)-[a-z0-9@.-]+", fields[0]) is not None
    return False


def _from_base64(text: str) -> bytes:
    plain = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _pem_bodies(inner: str, mark: str) -> Iterator[str]:
    """What the base64 text between BEGIN and END may be; ``mark`` stands before END on its line."""
    inner = inner.replace("\\/", "/")
    for strip in dict.fromkeys((mark.rstrip(), "")):
        body, in_headers, margin = [], True, None
        for line in re.split(LINE_END, inner):
            line = STRING_START.sub("", STRING_END.sub("", line.removeprefix(strip)))
            plain = re.sub(r"^[^A-Za-z0-9+/=]+|[^A-Za-z0-9+/=]+$", "", line)
            indent = len(line) - len(line.lstrip())
            if in_headers and HEADER_LINE.match(plain):
                margin = indent
            elif not plain:
                margin = None
            elif not in_headers or margin is None or indent <= margin:          # else the header line goes on
                in_headers = False
                body.append(plain)
        yield "".join(body)
    for pattern in ENCRYPTED:
        inner = pattern.sub("", inner)
    yield re.sub(LINE_END, "", inner)


def _is_pem(inner: str, mark: str) -> bool:
    bodies = [_from_base64(b) for b in _pem_bodies(inner, mark)]
    return any(is_key(b) for b in bodies) or (any(len(b) >= LEAST_CIPHER for b in bodies) and all(p.search(inner) for p in ENCRYPTED))


def _pem_blocks(text: str) -> list[tuple[int, int]]:
    """The spans from a BEGIN to its END with a key between them."""
    found, begins = [], list(BEGIN.finditer(text))
    for i, m in enumerate(begins):
        end = f"-----END {m[1]}-----"
        at = text.find(end, m.end(), begins[i + 1].start() if i + 1 < len(begins) else len(text))
        if at >= 0:
            inner = text[m.end():at]
            mark = re.split(LINE_END, inner)[-1]
            if re.search("[A-Za-z0-9=]", mark):     # the end of the body
                mark = ""
            if _is_pem(inner[:len(inner) - len(mark)], mark):
                found.append((m.start(), at + len(end)))
    return found


def _wrapped_keys(text: str) -> list[tuple[int, int]]:
    """The spans of base64 keys that go over several lines, followed as far as the keys' own lengths reach."""
    found, at = [], 0
    while m := FIRST_LINE.search(text, at):
        at = m.end()
        chars, data, decoded, wanted = [m[0]], bytearray(), 0, 33
        ends, length = {}, len(m[0])                # the line ends, by the characters before them
        while wanted and (line := NEXT_LINE.match(text, next(reversed(ends.values()), m.end()))):
            chars.append(line[1])
            length += len(line[1])
            ends[length] = line.end()
            if length * 3 // 4 >= wanted:
                whole = "".join(chars)
                data += _from_base64(whole[:len(whole) - len(whole) % 4])
                decoded, chars = decoded + len(whole) - len(whole) % 4, [whole[len(whole) - len(whole) % 4:]]
                reach = _reach(bytes(data)) or 0
                wanted = reach if reach * 4 > length * 3 else 0
        rest = "".join(chars)
        data = bytes(data) + _from_base64(rest[:len(rest) - (len(rest) % 4 == 1)])      # one character more than fours holds no byte
        good = [(n, end) for n, end in ends.items() if n >= LEAST_KEY and is_key(data[:n * 3 // 4])]
        if good:
            end = good[-1][1]
            at = end + len(PADDING.match(text, end)[0])
            found.append((m.start(), at))
    return found


def _escaped_start(text: str, at: int) -> int:
    """1 if the character at ``at`` ends an escape such as \\n, which is not part of what follows."""
    return int(at > 0 and text[at - 1] == "\\" and text[at] in "nrt")


def _is_header(part: str) -> bool:
    try:
        header = json.loads(_from_base64(part))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text."""
    spans = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    blocks = _pem_blocks(text) if "-----BEGIN " in text else []
    spans += [("pem", *s) for s in blocks]
    wrapped = [s for s in _wrapped_keys(text) if not any(a <= s[0] and s[1] <= b for a, b in blocks)]
    spans += [("key", *s) for s in wrapped]
    keys = [(m.start() + skip, m.end()) for m in BASE64.finditer(text) for skip in {0, _escaped_start(text, m.start())}
            if is_key(_from_base64(text[m.start() + skip:m.end()]))]
    spans += [("key", *s) for s in keys if not any(a <= s[0] and s[1] <= b for a, b in wrapped + blocks)]
    spans += [("key", *m.span()) for m in HEX_KEY.finditer(text) if is_key(bytes.fromhex(m[0]))]
    end = 0
    for m in TOKEN.finditer(text):
        skip = _escaped_start(text, m.start())
        if m.start() >= end and (head := next((n for n in (0, skip) if _is_header(m[1][n:])), None)) is not None:
            end = m.end(2)
            spans.append(("token", m.start() + head, end))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def with_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` without the column ``text``, plus ``spans``; a column of this name is replaced."""
    rows = rows.drop(*{"spans"} - {text})
    schema = rows.drop(text).withColumn("spans", F.array().cast(SPAN)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(t.as_py() or "")] for t in batch.column(at)]
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(found, kind)],
                                             [*(batch.schema.names[i] for i in rest), "spans"])

    return rows.mapInArrow(run, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_sha256 and all spans of every document."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
