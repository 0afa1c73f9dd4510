"""Secret scans: keyword prefilter, anchored expressions near hits, checksum validation.

An Aho-Corasick automaton finds every keyword in one pass over a text; an expression is
tried only where its keyword stands. Runs of hex digits have no keyword: there the
expression itself scans for its 24 digits. Kinds whose tokens carry a checksum or a fixed
structure are kept only if that holds; the base kinds need no checksum and always stay.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt", "private_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++")
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]+")
_KEY = re.compile(r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """The six base-62 digits of a text's CRC-32, as tokens embed it."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _BASE62[digit] + out
    return out


def _checksum_holds(m: re.Match) -> bool:
    body = m[0].split("_", 1)[1]
    return base62_crc(body[:-6]) == body[-6:]


def _jwt_holds(m: re.Match) -> bool:
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in m[0].split(".")[:2]]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and "alg" in parts[0]


def _key_holds(m: re.Match) -> bool:
    """If the body is base64 of a DER sequence or of an OpenSSH key."""
    try:
        body = base64.b64decode("".join(m[2].split()), validate=True)
    except ValueError:
        return False
    return len(body) >= 16 and (body[0] == 0x30 or body.startswith(b"openssh-key-v1"))


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 6


#: Keyword -> kind; expression and validation of each kind.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin ": "private_key"}
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (_ASSIGN, _long_value),
    "access": (_ACCESS, lambda m: len(m[0]) >= 20),
    "github": (_GITHUB, _checksum_holds),
    "npm": (_NPM, _checksum_holds),
    "jwt": (_JWT, _jwt_holds),
    "private_key": (_KEY, _key_holds),
}
_FOLD = {c: c + 32 for c in range(65, 91)}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def fold(text: str) -> str:
    """Lower case that keeps places: of texts where a character's lower case is longer, only A-Z fold."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text in code points, by start, then kind as in ``KINDS``.

    Matches of a kind are leftmost and don't overlap; those that fail its validation go
    afterwards. Null or empty text has none; a text of any length is scanned whole, in time
    that grows with it.
    """
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    upto = dict.fromkeys(RULES, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(fold(text)))
    for start, kind in hits:
        if start < upto[kind]:
            continue
        expression, holds = RULES[kind]
        if m := expression.match(text, start):
            upto[kind] = m.end()
            if holds(m):
                out.append((start, m.end(), kind))
        elif kind == "jwt":  # what follows the run decides, so its later starts fail too
            upto[kind] = _JWT_RUN.match(text, start).end()
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and repeated ids and equal rows give a row each; further columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t) for t in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[2] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(_join(spans).encode()).hexdigest() for spans in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(map(_join, found), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with each secret replaced by ``mark``; of an assignment only its value; overlapping spans as one."""
    spans = []
    for a, b, kind in scan(text):
        if kind == "assign":
            a = _ASSIGN.match(text, a).start(2)
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    for a, b in reversed(spans):
        text = text[:a] + mark + text[b:]
    return text


def redact_documents(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by ``mark`` and ``n_chars``, where there is one, counted anew.

    Only rows that hold a secret change. Null text stays null; all rows and other columns
    stay, whatever their names; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, mark), na_action="ignore")

    rows = docs.select(F.struct(*docs.columns).alias("_doc"), clean("text").alias("_clean"))
    new = {c: F.col(f"_doc.`{c}`").alias(c) for c in docs.columns}
    if "n_chars" in docs.columns:
        counted = F.when(F.col("_clean").eqNullSafe(F.col("_doc.text")), F.col("_doc.n_chars")).otherwise(F.char_length("_clean").cast(docs.schema["n_chars"].dataType))
        new["n_chars"] = counted.alias("n_chars")
    return rows.select(*(new | {"text": F.col("_clean").alias("text")}).values())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in all documents; cases as in ``scan_documents``."""
    return scan_documents(table(spark, sf_dir, "documents"))
