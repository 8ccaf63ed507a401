"""Secret scanning: keyword prefilter, anchored expressions near hits, checksum validation.

One Aho-Corasick pass over the ASCII-lower-cased text finds the keywords.  Only where a keyword
stands is an expression tried, anchored at that place; numbers that have no keyword of their own (cards,
accounts) are tried at the digits and capitals that stand near a word for them.  Kinds with an embedded
checksum count only if it holds.  ``hex`` alone has no keyword: a run of digits is all there is to see of
it, so it is looked for in the whole text.

Base kinds, leftmost and non-overlapping within each kind, in this order:

``assign``  a key name, ``:`` or ``=``, and a value of at least six characters
``access``  ``AKIA`` and capitals or digits, at least 20 characters
``hex``     a run of lower-case hex digits, at least 24

Kinds added by the method, reported after them: ``ghtoken`` (``ghp_``-style tokens whose last six
characters are the base-62 CRC-32 of the rest), ``npmtoken`` (the same rule), ``card`` (payment card
numbers by their Luhn digit, near a word for cards), ``iban`` (by the remainder of 97, near a word for
accounts), ``jwt`` (whose header decodes to a JSON object with ``alg``) and ``pem`` (private key blocks,
with header lines and with escaped line ends).

Every expression reads a stretch of text at most a few times, so time grows with a text's length.

Defined results: positions are code points, ends exclusive; null texts are empty and an empty text has
no span; repeated rows, and rows with a null id, are scanned each on their own; an empty table gives
none; of one kind spans never overlap, and of spans that start together the kind listed first comes
first; other columns of any name are not looked at.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import frugal

KINDS = ("assign", "access", "hex", "ghtoken", "npmtoken", "card", "iban", "jwt", "pem")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_CARD = re.compile(r"[2-6][0-9](?:[ -]?[0-9]){11,17}(?![0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_JWT_RUN = re.compile(r"eyJ[A-Za-z0-9_-]*")
#: A block reaches to the next five dashes; its body is checked by :func:`_pem_body`.
_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:[^-]|-(?!----))*)-----END \1-----")
_PEM_HEADER = re.compile(r"(?:(?<=\n)|(?<=\\n))[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*(?=\r?\n|\\[nr])")
_PEM_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nrt])*")

#: Keyword (lower case) to the kind whose expression starts there.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "npm_": "npmtoken", "eyj": "jwt", "-----begin ": "pem",
    **{f"gh{c}_": "ghtoken" for c in "pousr"},
    **dict.fromkeys(("card", "visa", "amex", "maestro", "credit", "debit", "payment"), "card"),
    **dict.fromkeys(("iban", "account", "bank"), "iban"),
}
#: Code points before and after a word for cards or accounts in which their numbers may start.
NEAR_BEFORE, NEAR_AFTER = 48, 64
#: A token's header is a small object; nothing longer is one.
MAX_HEADER = 8_192
_DIGITS62 = string.digits + string.ascii_uppercase + string.ascii_lowercase


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """The CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _DIGITS62[digit] + out
    return out


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isascii() and c.isdigit()]
    total = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and total % 10 == 0


def iban(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _jwt_header(part: str) -> bool:
    if len(part) > MAX_HEADER:
        return False
    try:
        header = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _pem_body(body: str) -> bool:
    return bool(_PEM_BODY.fullmatch(_PEM_HEADER.sub("", body)))


#: Kind to its anchored expression and the test that a match must pass.
_RULES = {
    "assign": (_ASSIGN, lambda m: m.end(1) - m.start(1) >= 6),
    "access": (_ACCESS, lambda m: m.end() - m.start() >= 20),
    "ghtoken": (_GITHUB, lambda m: checksum62(m[1][:30]) == m[1][30:]),
    "npmtoken": (_NPM, lambda m: checksum62(m[1][:30]) == m[1][30:]),
    "jwt": (_JWT, lambda m: _jwt_header(m[1])),
    "pem": (_PEM, lambda m: _pem_body(m[2])),
}
#: Kinds whose keywords stand near them: where a match may start (so many code points), its expression and its test.
START = 4
_NEAR = {
    "card": (re.compile(r"(?<![0-9A-Za-z])[2-6][0-9]{3}"), _CARD, luhn),
    "iban": (re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}"), _IBAN, iban),
}


def _stretches(hits: list[tuple[int, int]]) -> list[list[int]]:
    """What lies near the hits ``(start, end)``, ascending, without overlaps."""
    out: list[list[int]] = []
    for start, end in hits:
        a, b = max(0, start - NEAR_BEFORE), end + NEAR_AFTER
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` by start, then kind as listed."""
    spans: list[tuple[str, int, int]] = []
    if not text:
        return spans
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII only: places stay
    free = dict.fromkeys(KINDS, 0)
    near: dict[str, list[tuple[int, int]]] = {kind: [] for kind in _NEAR}
    hits = sorted((end - size + 1, size, kind) for end, (size, kind) in words.iter(low))
    for start, size, kind in hits:
        if kind in near:
            near[kind].append((start, start + size))
            continue
        if start < free[kind]:
            continue
        expression, holds = _RULES[kind]
        if m := expression.match(text, start):
            free[kind] = m.end()
            if holds(m):
                spans.append((kind, start, m.end()))
        elif kind == "jwt" and (run := _JWT_RUN.match(text, start)):
            free[kind] = run.end()  # what fails here fails at every later place of the same run
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, (start, expression, holds) in _NEAR.items():
        for a, b in _stretches(near[kind]):
            for hit in start.finditer(text, a, b + START - 1):
                if hit.start() >= free[kind] and (m := expression.match(text, hit.start())) and holds(m[0]):
                    free[kind] = m.end()
                    spans.append((kind, *m.span()))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every (merged) span replaced by ``[KIND]`` of its first kind."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: counts of the base kinds, their digest, and all spans."""

    def run(batches):
        words = automaton()
        for batch in frugal(batches):
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                spans = scan(text.as_py() or "", words)
                base = [s for s in spans if s[0] in BASE_KINDS]
                kinds = [s[0] for s in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)), strict=True):
                    c.append(v)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; a null text stays null.  ``n_chars``, where there is such a column,
    follows a text that is not null; other columns stay as they are."""

    def run(batches):
        words = automaton()
        for batch in frugal(batches):
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                spans = scan(text, words) if text else []
                texts.append(redact(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out
