"""Byte-level BPE vocabularies of public tokenizers, read from their files on the executors."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import tiktoken

#: The pre-tokenisation pattern of byte-level tokenizer files that name none (``use_regex``).
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


#: White space as the patterns' ``\s`` has it (Unicode's White_Space; Python's own class has four more).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{SPACE}]{{10000,}}")


def encode_text(enc: tiktoken.Encoding, text: str, special: tuple[str, ...] = ()) -> list[int]:
    """The ids that ``enc`` has for a text; the strings ``special`` are matched as tokens, others are ordinary text.

    The library's expressions fail on white space of about a million characters, so a run of
    10,000 or more is cut by their rule: all of it but its last character is one pre-token,
    and that character begins what follows; at the end of a text (or before a special
    string) the whole run is one.
    """
    if not _LONG_RUN.search(text):
        return enc.encode(text, allowed_special=set(special), disallowed_special=()) if special else enc.encode_ordinary(text)
    out: list[int] = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text) if special else [text]:
        if part in special:
            out.append(enc.encode_single_token(part))
            continue
        at = 0
        while m := _LONG_RUN.search(part, at):
            end = m.end() - (m.end() < len(part))
            out += enc.encode_ordinary(part[at : m.start()])
            out += enc._encode_single_piece(part[m.start() : end])
            at = end
        out += enc.encode_ordinary(part[at:])
    return out


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary file writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def json_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a byte-level tokenizer JSON file, whose added tokens are special tokens.

    ``encode(text, allowed_special="all")`` gives the ids of the tokenizers library, which
    matches added tokens inside texts; ``encode_ordinary`` takes them as ordinary text.
    Ids in such a file ascend in the order of the merges, which is checked; ranks and merges
    then give the same ids.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, alphabet = spec["model"], byte_alphabet()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab = model["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged) or spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel":
        raise ValueError(f"{path} is not a byte-level BPE whose ids follow its merges")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{path} has added tokens that take in their surroundings")
    ranks = {bytes(map(alphabet.__getitem__, token)): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("json", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def rank_encoding(path: str, pattern: str, special: tuple[str, ...] = ()) -> tuple[tiktoken.Encoding, tuple[bytes, ...]]:
    """The encoding of a ranks file, and the bytes of each id. ``special`` strings take the next free ids."""
    ranks = read_ranks(path)
    free = max(ranks.values()) + 1
    named = {s: free + i for i, s in enumerate(special)}
    back = [b""] * (free + len(special))
    for raw, rank in [*ranks.items(), *((s.encode(), i) for s, i in named.items())]:
        back[rank] = raw
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=named), tuple(back)
