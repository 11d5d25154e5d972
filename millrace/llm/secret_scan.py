"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions, checksums.

One automaton pass over the ASCII-lowered text finds the keywords of all kinds;
only at those places is the kind's expression matched, anchored there. Runs of
hexadecimal digits have no keyword; they are found by one expression of their own.
Kinds that embed a checksum are accepted only if it holds; tokens without a public checksum
have no kind of their own.

Kinds, in their order among equal starts: the base kinds ``assign``, ``access`` and
``hex``, then ``github`` and ``npm`` (six base-62 digits of CRC-32 over the thirty
before), ``xprv`` (extended private keys, whose base-58 digits end in four bytes of a double
SHA-256), ``age`` and ``nsec`` (private keys in Bech32, whose last six characters are a
checksum) and ``pem`` (private keys from header to footer, whose body must be base 64 of
one DER sequence of exactly that length, of an OpenSSH key, or of whole cipher blocks where it says that
it is encrypted). Spans are code points, end exclusive.

Defined cases: null and empty texts give one row of zeros with the hash of the empty
string; texts of any length are scanned whole; a null doc_id stays null; repeated rows
give repeated rows; an empty table gives no rows; other columns are ignored; a keyword
inside an earlier match of its own kind is skipped, as a left-to-right scan does.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from millrace.llm.base import map_texts

_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    """CRC-32 of an ASCII string as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS62[digit] + out
    return out


# The digits of base 58 and of Bech32, and the latter's generator.
_DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_DIGITS32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def base58_holds(text: str, size: int) -> bool:
    """Whether base-58 digits are ``size`` bytes and the first four of their double SHA-256."""
    value = 0
    for c in text:
        value = 58 * value + _DIGITS58.index(c)
    if value.bit_length() > 8 * (size + 4):
        return False
    raw = value.to_bytes(size + 4, "big")
    return hashlib.sha256(hashlib.sha256(raw[:size]).digest()).digest()[:4] == raw[size:]


def bech32_residue(prefix: str, values: list[int]) -> int:
    """The remainder that is 1 where the checksum of a Bech32 string holds."""
    out = 1
    for value in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *values]:
        top, out = out >> 25, (out & 0x1FFFFFF) << 5 ^ value
        for k, g in enumerate(_GENERATOR):
            out ^= g * (top >> k & 1)
    return out


def bech32_holds(text: str) -> bool:
    """Whether the checksum of a Bech32 string (all upper or all lower case) holds."""
    prefix, _, data = text.lower().rpartition("1")
    return bech32_residue(prefix, [_DIGITS32.index(c) for c in data]) == 1


def pem_holds(body: str) -> bool:
    """Whether the text between header and footer is a private key by its own lengths."""
    lines = body.split("\n")
    data = "".join("".join(line.split()) for line in lines if ":" not in line)
    try:
        raw = base64.b64decode(data, validate=True)
    except ValueError:
        return False
    if any(line.strip().startswith("DEK-Info:") for line in lines):
        return len(raw) > 0 and len(raw) % 8 == 0
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    wide = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return len(raw) == 2 + wide + (int.from_bytes(raw[2 : 2 + wide], "big") if wide else raw[1])


def _crc_token(m: re.Match) -> bool:
    return base62_crc(m[1][:30]) == m[1][30:]


#: kind, keywords in lower case, expression anchored at the keyword, whether a match counts.
KINDS: list[tuple[str, list[str], re.Pattern, Callable[[re.Match], bool]]] = [
    (
        "assign",
        ["password", "passwd", "secret", "token", "apikey", "api_key"],
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        lambda m: len(m[2]) >= 12,
    ),
    ("access", ["akia"], re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 18),
    ("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_token),
    ("npm", ["npm_"], re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_token),
    ("xprv", ["xprv", "tprv"], re.compile(r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), lambda m: base58_holds(m[0], 78)),
    ("age", ["age-secret-key-1"], re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Za-z0-9])"), lambda m: bech32_holds(m[0])),
    ("nsec", ["nsec1"], re.compile(r"nsec1[02-9ac-hj-np-z]{58}(?![A-Za-z0-9])"), lambda m: bech32_holds(m[0])),
    ("pem", ["-----begin "], re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----\s([^-]*(?:-(?!----)[^-]*)*)-----END \1-----"), lambda m: pem_holds(m[2])),
]
HEX = re.compile(r"[0-9a-f]{16,}")
ORDER = ["assign", "access", "hex", "github", "npm", "xprv", "age", "nsec", "pem"]
BASE = ORDER[:3]


def automaton() -> ahocorasick.Automaton:
    """The keywords of all kinds; each yields its length and the places of its kinds in KINDS."""
    out, kinds = ahocorasick.Automaton(), {}
    for at, (_, words, _, _) in enumerate(KINDS):
        for word in words:
            kinds.setdefault(word, []).append(at)
    for word, ats in kinds.items():
        out.add_word(word, (len(word), ats))
    out.make_automaton()
    return out


def spans(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then by ORDER."""
    if not text:
        return []
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    hits: dict[int, list[int]] = {}
    for end, (length, kinds) in keywords.iter(text.translate(_LOWER)):
        for kind in kinds:
            hits.setdefault(kind, []).append(end - length + 1)
    for at, starts in hits.items():
        name, _, pattern, holds = KINDS[at]
        free = 0
        for start in sorted(set(starts)):
            if start >= free and (m := pattern.match(text, start)):
                free = m.end()
                if holds(m):
                    found.append((start, free, name))
    return sorted(found, key=lambda x: (x[0], ORDER.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def digest(doc_id: int | None, text: str | None, keywords: ahocorasick.Automaton) -> tuple:
    """The row of ``scan`` for one text."""
    found = spans(text, keywords)
    base = [x for x in found if x[2] in BASE]
    counts = [sum(x[2] == kind for x in base) for kind in BASE]
    return doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row."""

    def make():
        keywords = automaton()
        return lambda rows: [digest(i, t, keywords) for i, t in rows]

    return map_texts(
        docs, make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """doc_id and text with every span replaced by ``mark`` (overlapping spans by one); a null text stays null."""

    def make():
        keywords = automaton()

        def clean(text: str | None) -> str | None:
            out, free = [], 0
            for start, end, _ in spans(text, keywords):
                if start >= free:
                    out += [text[free:start], mark]
                free = max(free, end)
            return text if text is None else "".join(out) + text[free:]

        return lambda rows: [(i, clean(t)) for i, t in rows]

    return map_texts(docs, make, "doc_id long, text string")
