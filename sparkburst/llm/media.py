"""Media columns: a baseline JPEG codec in numpy.

``jpeg_from_bytes`` stores bytes losslessly in a grey baseline JPEG: its units are quantised
coefficients, one block of 64 for 64 bytes, entropy-coded with the file's own Huffman
tables. ``decode_files`` parses the markers of baseline files of one or several components,
decodes their (first) scan and gives back the coefficients; the DC terms of the luminance
alone make a thumbnail of an eighth of each side.

A file that names a restart interval can be decoded side by side: markers end each
interval at a whole byte, so numpy takes the next symbol of all intervals, of all files of
a batch, at once. A file without restarts is one interval.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Bytes of files that are decoded side by side.
GROUP_BYTES = 1 << 20


def zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient in the order of a scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


def code_lengths(symbols: list[int], first: list[int], rest: int) -> list[tuple[int, int]]:
    """(symbol, bits): the first symbols with the given bits, the others with ``rest``."""
    return [(s, first[i] if i < len(first) else rest) for i, s in enumerate(symbols)]


def canonical_codes(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits), by ascending bits, as the format counts them."""
    code, bits, out = 0, 0, {}
    for symbol, n in sorted(lengths, key=lambda x: x[1]):
        code <<= n - bits
        bits = n
        out[symbol] = (code, bits)
        code += 1
    return out


@lru_cache(maxsize=1)
def writer_tables() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """DC and AC code lengths of the writer: large values without a run come first, as in stored text."""
    dc = [(s, 4) for s in range(12)]
    runs = [(r << 4) | s for s in range(1, 11) for r in range(16)]
    order = [0x07, 0x06, 0x00, 0x05, *[x for x in (0x08, 0x04, 0x03, 0x02, 0x01, 0xF0, *runs) if x not in (0x07, 0x06, 0x00, 0x05)]]
    ac = code_lengths(list(dict.fromkeys(order)), [1, 2, 4, 4, 5], 11)
    return dc, ac


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _huffman_segment(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    ordered = sorted(lengths, key=lambda x: x[1])
    counts = np.bincount([n for _, n in ordered], minlength=17)[1:17].astype(np.uint8)
    return _segment(0xC4, bytes([kind]) + counts.tobytes() + bytes(s for s, _ in ordered))


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each value's magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def _encode_blocks(coefficients: np.ndarray) -> bytes:
    """The scan of blocks of 64 coefficients in zigzag order, a restart after each block."""
    dc_codes, ac_codes = map(canonical_codes, writer_tables())
    code, bits = np.zeros(512, np.int64), np.zeros(512, np.int64)
    for s, (c, n) in ac_codes.items():
        code[s], bits[s] = c, n
    for s, (c, n) in dc_codes.items():
        code[256 + s], bits[256 + s] = c, n
    blocks = len(coefficients)
    row, column = np.nonzero(coefficients[:, 1:])
    column += 1
    value = coefficients[row, column].astype(np.int64)
    before = np.where(np.concatenate(([True], row[1:] != row[:-1])), 0, np.concatenate(([0], column[:-1]))) if len(row) else column
    run = column - before - 1
    size = _sizes(value)
    fill = run >> 4  # each stands for 16 zeros
    last = np.zeros(blocks, np.int64)
    np.maximum.at(last, row, column)
    ended = np.flatnonzero(last < 63)
    dc = coefficients[:, 0].astype(np.int64)  # each interval predicts from 0
    dc_size = _sizes(dc)
    everything = [  # block, place in it, symbol, value, its bits
        (np.arange(blocks), np.zeros(blocks, np.int64), 256 + dc_size, dc, dc_size),
        (row, column * 8 + 4, ((run & 15) << 4) | size, value, size),
        (ended, np.full(len(ended), 64 * 8), np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64)),
    ]
    for i in (1, 2, 3):
        more = np.flatnonzero(fill >= i)
        if len(more):
            everything.append((row[more], column[more] * 8 + i, np.full(len(more), 0xF0), np.zeros(len(more), np.int64), np.zeros(len(more), np.int64)))
    block, place, symbol, value, size = (np.concatenate(x) for x in zip(*everything))
    order = np.argsort(block * 1024 + place, kind="stable")
    block, symbol, value, size = block[order], symbol[order], value[order], size[order]
    n = bits[symbol] + size
    word = (code[symbol] << size) | np.where(value < 0, value + (1 << size) - 1, value)
    used = np.bincount(block, n, minlength=blocks).astype(np.int64)
    length = (used + 7) // 8
    start = np.concatenate(([0], np.cumsum(length)))
    inside = np.cumsum(n) - n
    at = start[block] * 8 + inside - np.concatenate(([0], np.cumsum(used)))[block]
    # the bits of a block are filled up with ones
    pad = length * 8 - used
    at = np.concatenate((at, start[:-1] * 8 + used))
    word, n = np.concatenate((word, (1 << pad) - 1)), np.concatenate((n, pad))
    raw = np.zeros(start[-1] + 8, np.uint8)
    shifted = (word.astype(np.uint64) << (np.uint64(40) - (at & 7).astype(np.uint64) - n.astype(np.uint64)))
    byte = at >> 3
    for i in range(5):
        np.add.at(raw, byte + i, ((shifted >> np.uint64(32 - 8 * i)) & np.uint64(255)).astype(np.uint8))
    raw = raw[: start[-1]]
    # stuff a zero behind each FF and put the markers in
    full = np.flatnonzero(raw == 0xFF)
    marks = np.repeat(start[1:-1], 2)
    marker = np.empty(2 * (blocks - 1), np.uint8)
    marker[0::2], marker[1::2] = 0xFF, 0xD0 + np.arange(blocks - 1) % 8
    places, values = np.concatenate((full + 1, marks)), np.concatenate((np.zeros(len(full), np.uint8), marker))
    return np.insert(raw, places, values).tobytes()


@lru_cache(maxsize=1)
def _tables_segment() -> bytes:
    dc, ac = writer_tables()
    return _segment(0xDB, b"\0" + b"\1" * 64) + _huffman_segment(0x00, dc) + _huffman_segment(0x10, ac)


def jpeg_from_bytes(payload: bytes) -> bytes:
    """A grey baseline JPEG whose quantised coefficients are the bytes, as signed numbers.

    ``payload`` has a positive multiple of 64 bytes; its size is kept in a comment, as the
    last row of blocks may be filled up.
    """
    blocks = len(payload) // 64
    if not blocks or len(payload) % 64:
        raise ValueError("a positive multiple of 64 bytes is needed")
    wide = int(np.ceil(np.sqrt(blocks)))
    high = -(-blocks // wide)
    if wide > 8191:
        raise ValueError("the format holds 4 GB at most")
    values = np.zeros((wide * high, 64), np.int8)
    values[:blocks] = np.frombuffer(payload, np.int8).reshape(blocks, 64)
    frame = bytes([8]) + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    head = b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % len(payload)) + _tables_segment() + _segment(0xC0, frame) + _segment(0xDD, (1).to_bytes(2, "big"))
    return head + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + _encode_blocks(values) + b"\xff\xd9"


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + bits of its code; 0 where no code fits."""
    counts, symbols = table[:16], table[16:]
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out[code << (16 - bits) : (code + 1) << (16 - bits)] = symbols[k] * 32 + bits
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse_markers(raw: bytes) -> dict:
    """Frame, tables, restart interval, comment and the first scan of a baseline file: its place and its components.

    ValueError if it is no such file. Of a file with a scan for each component only the
    first scan, that of the luminance, is read.
    """
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, out = 2, {"huffman": {}, "quantiser": {}, "interval": 0, "comment": b""}
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("cut off, or no marker where one should be")
        while raw[at + 1] == 0xFF:
            at += 1
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                out["huffman"][body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDB:
            while body:
                n = 129 if body[0] >> 4 else 65
                out["quantiser"][body[0] & 15] = np.frombuffer(body[1:n], ">u2" if n == 129 else np.uint8).astype(np.int64)
                body = body[n:]
        elif marker == 0xC0:
            parts = {body[i]: (body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)}
            out |= {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xDD:
            out["interval"] = int.from_bytes(body, "big")
        elif marker == 0xFE:
            out["comment"] = bytes(body)
        elif marker == 0xDA:
            return out | _scan_layout(out, body) | {"scan": at}


def _scan_layout(head: dict, body: bytes) -> dict:
    """Units of a scan: how many there are in each direction, and tables and component of each block of a unit."""
    if not head.get("parts") or not head["height"] or not head["width"]:
        raise ValueError("no frame of known size before the scan")
    ids = [(body[i], body[i + 1]) for i in range(1, 1 + 2 * body[0], 2)]
    tallest, widest = (max(p[i] for p in head["parts"].values()) for i in (1, 0))
    wide, high, table = head["parts"][ids[0][0]]
    across, down = -(-head["width"] * wide // widest), -(-head["height"] * high // tallest)  # samples of the first component
    if len(ids) == 1:
        wide = high = 1
    units = -(-across // (8 * wide)), -(-down // (8 * high))
    pattern = []
    for i, (part, tables) in enumerate(ids):
        own = head["parts"][part]
        pair = head["huffman"][tables >> 4], head["huffman"][0x10 | (tables & 15)]
        pattern += [(i, pair)] * (own[0] * own[1] if len(ids) > 1 else 1)
    return {"table": table, "units": units, "first": (wide, high), "thumb": (-(-across // 8), -(-down // 8)), "pattern": pattern}


def _intervals(raw: bytes, start: int) -> list[np.ndarray]:
    """The unstuffed bytes of each restart interval of a scan."""
    data = np.frombuffer(raw, np.uint8)[start:]
    full = np.flatnonzero(data[:-1] == 0xFF)
    after = data[full + 1]
    end = full[after == 0xD9]
    stop = int(end[0]) if len(end) else len(data)
    marks = full[(after >= 0xD0) & (after <= 0xD7) & (full < stop)]
    keep = np.ones(stop, bool)
    keep[full[(after == 0) & (full < stop - 1)] + 1] = False
    keep[marks], keep[marks + 1] = False, False
    count = np.concatenate(([0], np.cumsum(keep)))
    clean = data[:stop][keep]
    return clean, np.concatenate(([0], count[marks])), np.concatenate((count[marks], [len(clean)]))


def decode_files(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Headers and coefficients (blocks of 64, zigzag order) of files, all intervals side by side."""
    heads = [parse_markers(f) for f in files]
    stores, starts, units, lanes, base, at = [], [], [], [], [], 0
    for i, (head, raw) in enumerate(zip(heads, files)):
        clean, first, _ = _intervals(raw, head["scan"])
        head["blocks"] = head["units"][0] * head["units"][1] * len(head["pattern"])
        per = head["interval"] * len(head["pattern"]) or head["blocks"]
        if len(first) < -(-head["blocks"] // per):
            raise ValueError("a restart marker is missing")
        first = first[: -(-head["blocks"] // per)]
        stores.append(clean)
        starts.append((first + at) * 8)
        units.append(np.minimum(per, head["blocks"] - np.arange(len(first)) * per))
        base.append(np.arange(len(first)) * per)
        lanes.append(np.full(len(first), i))
        at += len(clean)
    data = np.concatenate([*stores, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(data) - 8, np.uint64)
    for i in range(5):
        words = (words << np.uint64(8)) | data[i : i + len(words)]
    offset = np.concatenate(([0], np.cumsum([h["blocks"] for h in heads])))
    pos, left, lane = np.concatenate(starts), np.concatenate(units), np.concatenate(lanes)
    block = np.concatenate(base) + offset[lane]
    pairs: dict[tuple[bytes, bytes], int] = {}
    tables = np.concatenate([[pairs.setdefault(pair, len(pairs)) << 16 for _, pair in h["pattern"]] for h in heads])
    parts = np.concatenate([[part for part, _ in h["pattern"]] for h in heads])
    repeat = np.array([len(h["pattern"]) for h in heads])
    begin, repeat = (np.cumsum(repeat) - repeat)[lane], repeat[lane]
    phase, which = np.zeros(len(pos), np.int64), tables[begin]
    slot = np.arange(len(pos)) * 4 + parts[begin]  # where a component's last DC is kept
    dc_table, ac_table = (np.concatenate([_lookup(p[i]) for p in pairs]) for i in (0, 1))
    out = np.zeros((int(offset[-1]), 64), np.int16)
    predicted = np.zeros(4 * len(pos), np.int64)
    k = np.zeros(len(pos), np.int64)
    several = bool((repeat > 1).any())
    while len(pos):
        word = words[pos >> 3]
        ahead = ((word >> (np.uint64(24) - (pos & 7).astype(np.uint64))) & np.uint64(0xFFFF)).astype(np.int64)
        is_dc = k == 0
        entry = ac_table[which + ahead]
        if is_dc.any():
            entry = np.where(is_dc, dc_table[which + ahead], entry)
        bits, symbol = (entry & 31).astype(np.int64), (entry >> 5).astype(np.int64)
        if not bits.all():
            raise ValueError("a scan holds a code that its tables lack")
        size, run = symbol & 15, symbol >> 4
        pos = pos + bits
        word = words[pos >> 3]
        extra = ((word >> (np.uint64(40) - (pos & 7).astype(np.uint64) - size.astype(np.uint64))) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        pos = pos + size
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        value = np.where(is_dc, value + predicted[slot], value)
        predicted[slot[is_dc]] = value[is_dc]
        k = np.where(is_dc, 0, k + run)
        if k.max(initial=0) > 63 and ((size > 0) & (k > 63)).any():
            raise ValueError("a block holds too many coefficients")
        write = is_dc | (size > 0)
        out[block[write], k[write]] = value[write]
        ended = ~is_dc & (symbol == 0)
        k = np.where(ended, 64, k + 1)
        done = k >= 64
        if done.any():
            left = left - done
            block = block + done
            k = np.where(done, 0, k)
            if several:  # the next block of a unit may be another component's
                phase = (phase + done) % repeat
                which, slot = tables[begin + phase], slot - slot % 4 + parts[begin + phase]
            stay = left > 0
            if not stay.all():
                pos, left, block, k, which, slot, phase, begin, repeat = (x[stay] for x in (pos, left, block, k, which, slot, phase, begin, repeat))
    return [(h, out[a:b]) for h, a, b in zip(heads, offset[:-1], offset[1:])]


def bytes_from_coefficients(head: dict, coefficients: np.ndarray) -> bytes | None:
    """What ``jpeg_from_bytes`` stored; None of a file that it didn't write."""
    if not head["comment"].startswith(b"bytes="):
        return None
    return coefficients.astype(np.int8).tobytes()[: int(head["comment"].split(b"=")[1])]


def decode_each(files: list[bytes]) -> list[tuple[dict, np.ndarray] | None]:
    """As ``decode_files``, with None for a file that is damaged or no baseline JPEG."""
    try:
        return decode_files(files) if files else []
    except (ValueError, IndexError, KeyError):
        return [None] if len(files) == 1 else [x for f in files for x in decode_each([f])]


def thumbnail(head: dict, coefficients: np.ndarray) -> np.ndarray:
    """Luminance of an eighth of each side from the DC terms alone, 0 to 255."""
    step = int(head["quantiser"][head["table"]][0]) if head["table"] in head["quantiser"] else 1
    (across, down), (wide, high) = head["units"], head["first"]
    dc = coefficients[:, 0].reshape(down, across, -1)[:, :, : wide * high].reshape(down, across, high, wide)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * high, across * wide)[: head["thumb"][1], : head["thumb"][0]]
    return np.clip(np.round(dc.astype(np.float64) * step / 8 + 128), 0, 255).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits as hex digits: of the means of 8 x 9 areas of the thumbnail, if each exceeds the one before.

    Areas of a small thumbnail share its rows or columns.
    """
    rows, columns = np.arange(8) * grey.shape[0] // 8, np.arange(9) * grey.shape[1] // 9
    sums = np.add.reduceat(np.add.reduceat(grey.astype(np.int64), rows, axis=0), columns, axis=1)
    sizes = np.maximum(np.diff([*rows, grey.shape[0]]), 1)[:, None] * np.maximum(np.diff([*columns, grey.shape[1]]), 1)
    sample = sums / sizes
    return np.packbits(sample[:, 1:] > sample[:, :-1]).tobytes().hex()


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: each whole text (null: empty) as a JPEG that holds its bytes.

    Null and repeated ids and equal rows give a row each; further columns are ignored; an
    empty table gives no rows. A text of over 4 GB does not fit the format and is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            media = [jpeg_from_bytes(r + bytes(-len(r) % 64 or (0 if r else 64))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of what stored files hold, read back, and their dimensions with the thumbnail's hash.

    Any baseline file of up to four components has a feature; one that ``store_texts`` did
    not write has no payload (nulls). A damaged file, or one of another kind, has its size
    and digest alone; null media has nulls throughout. Null and repeated ids and equal rows
    give a row each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            files = [f or b"" for f in batch.column("media").to_pylist()]
            out: list[list] = [[] for _ in range(6)]
            first = 0
            while first < len(files):
                last, size = first, 0
                while last < len(files) and (last == first or size + len(files[last]) <= GROUP_BYTES):
                    size += len(files[last])
                    last += 1
                for raw, found in zip(files[first:last], decode_each(files[first:last])):
                    payload, feature = None, None
                    if found:
                        payload, feature = bytes_from_coefficients(*found), f"{found[0]['width']}x{found[0]['height']}:{difference_hash(thumbnail(*found))}"
                    told = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                    for column, x in zip(out, (*told, len(raw) or None, hashlib.sha256(raw).hexdigest() if raw else None, feature)):
                        column.append(x)
                first = last
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds[2:]))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as a JPEG, and what is read back of it; cases as in ``store_texts``."""
    return media_features(store_texts(table(spark, sf_dir, "documents")))
