"""Vector codes, exact search and token alignment against plain versions, on odd inputs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkburst.llm import alignment, codes, search

JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "vec_id long, embedding array<float>, label int, rid string, v string, rank string, x string, _label string"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def vector_rows(n=300, width=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = [[int(i), (centres[i % 5] * 0.2 + rng.normal(size=width) * (0.02 if i % 3 else 0.0)).astype(np.float32).tolist(), int(i % 4) if i % 9 else None] for i in rng.permutation(n)]
    rows[0][1], rows[1][1] = None, [float("nan")] * width
    rows[2][1][3], rows[3][1][0] = None, float("inf")
    rows[4][1] = rows[5][1]
    rows += [[rows[6][0], rows[6][1], 3], [rows[7][0], rows[8][1], None], [None, rows[9][1], 1], [50, [0.0] * width, 2], [100, rows[10][1][: width - 3], 2]]
    return [(*r, "r", "v", "k", "x", "l") for r in rows]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, v, label) for i, v, label, *_ in rows if usable(v)]
    width = -(-max(max((len(v) for _, v, _ in kept), default=0), 1) // parts) * parts
    step = width // parts
    cut = lambda v: [[math.floor(4096 * c) for c in [*v, *[0.0] * (width - len(v))][p * step : (p + 1) * step]] for p in range(parts)]
    whole = [cut(v) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[whole[r][p] for r in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(w[p], books[p])[1] for w in whole]
            for i in range(len(books[p])):
                mine = [w[p] for w, o in zip(whole, own) if o == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[near(w[p], books[p]) for p in range(parts)] for w in whole]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in row) for row in last]
    label = Counter()
    for (_, _, k), e in zip(kept, error):
        label[k] += e
    return Counter((i, "".join(f"{e:02x}" for _, e in row), d, label[k], digest) for (i, _, k), row, d in zip(kept, last, error))


@pytest.mark.parametrize(("n", "width", "entries", "rounds"), [(300, 24, 16, 6), (60, 13, 16, 6), (40, 8, 3, 2), (12, 24, 16, 1)])
def test_codes_are_those_of_plain_rounds(spark, n, width, entries, rounds):
    rows = vector_rows(n, width, n)
    got = codes.coded_table(spark.createDataFrame(rows, SCHEMA).repartition(3), 8, entries, rounds).collect()
    assert Counter(map(tuple, got)) == plain_codes(rows, 8, entries, rounds)


def test_codes_with_many_labels_and_without_rows(spark):
    rows = vector_rows(80)
    assert Counter(map(tuple, codes.coded_table(spark.createDataFrame(rows, SCHEMA), most_labels=1).collect())) == plain_codes(rows, 8, 16, 6)
    empty = codes.coded_table(spark.createDataFrame([(1, None, 2, *"rvkxl")], SCHEMA))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not empty.collect()


def test_bounds_never_decide_ties():
    """Bounds carried over moving entries give the same as comparing all entries; most parts keep theirs unscanned."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(500, 2, 2)) + 40 * rng.integers(0, 4, size=(500, 2, 1))
    books = codes.Codebooks(np.ascontiguousarray(x[:6].transpose(1, 0, 2)))
    own, upper, lower, scans = np.zeros((500, 2), int), np.full((500, 2), np.inf), np.zeros((500, 2)), []
    for _ in range(12):
        own, upper, lower, scanned = codes.assign(x, own, upper, lower, books)
        scans.append(scanned)
        full = ((x[:, :, None, :] - books.now[None]) ** 2).sum(axis=3)
        assert (own == full.argmin(axis=2)).all()
        sums = codes.part_sums(x, own, 6)
        n = sums[:, :, -1:]
        books = codes.Codebooks(np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), books.now), books.now)
    assert scans[0] > 700 and scans[-1] < 500


def plain_search(rows, every, k):
    kept = [(i, v) for i, v, *_ in rows if usable(v)]
    width = max((len(v) for _, v in kept), default=0)
    whole = [[math.floor(256 * c) for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = Counter()
    for a, (i, _) in enumerate(kept):
        if i is None or i % every:
            continue
        found = [(-clip(sum(x * y for x, y in zip(whole[a], whole[b]))), j is None, j or 0) for b, (j, _) in enumerate(kept) if a != b]
        out.update((i, rank, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(found)[:k], 1))
    return out


@pytest.mark.parametrize(("n", "width", "every"), [(400, 24, 5), (90, 7, 1), (4, 16, 1)])
def test_search_is_exact(spark, monkeypatch, n, width, every):
    monkeypatch.setattr(search, "CANDIDATE_BLOCK", 32)
    monkeypatch.setattr(search, "QUERY_BLOCK", 8)
    rows = vector_rows(max(n, 12), width, n)[-n - 4 :]
    got = search.top_products(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % every == 0, 5)
    assert Counter(map(tuple, got.collect())) == plain_search(rows, every, 5)


def test_search_of_huge_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e30, -3e37, 5.5, 2e9, 0.1]) for _ in range(5)], 0, *"rvkxl") for i in range(40)] + [(41, [], 0, *"rvkxl")]
    rows = [(i, np.array(v, np.float32).tolist(), *r) for i, v, *r in rows]
    got = search.top_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 4 == 0, 5)
    assert Counter(map(tuple, got.collect())) == plain_search(rows, 4, 5)
    assert not search.top_products(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 4 == 0, 5).collect()


def test_segment_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(600, 32)) * 30 + rng.normal(size=(600, 1)) * 200)
    stats = np.hstack([search.segment_statistics(x, s) for s in search.LEVELS])
    exact = x @ x.T
    at, before = 0, np.inf
    for s in search.LEVELS:  # each level's bound is at least the product and at most the coarser one's
        part = stats[:, at : at + 2 * s]
        at += 2 * s
        bound = part @ part.T
        assert (bound >= exact - 1e-6 * np.abs(bound)).all() and (bound <= before + 1e-6 * np.abs(bound)).all()
        before = bound
    least = np.sort(exact, axis=1)[:, -5].astype(float)
    row, col = search.survivors(stats, stats, least)
    assert set(zip(*np.nonzero(exact >= least[:, None]))) <= set(zip(row, col)) and len(row) < 0.3 * exact.size


PARTS = ["", " ", "  ", "a", "the", "Straße", "\n", "\t", "中文", "😀", "<s>", "</s>", "<unk>", "<|endoftext|>", "▁", "\x00", "é", "12", "3.5", "'s", "word ", "<0x41>", " ", "ﬁ"]


def alignment_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    words = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(40)]
    texts += [None, "", " ", "   ", "x", texts[160], texts[160], " ".join(rng.choice(words) for _ in range(9000)), "q" * 40_000, "ab  cd" * 9000 + " "]
    return texts


def plain_alignment(rows):
    a_of, b_of = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_of.encode_special_tokens = True
    back = {c: i for c, i in zip(map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), [*range(33, 127), *range(161, 173), *range(174, 256)])}
    back |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in back.values())}
    a_bytes = lambda i: bytes(back[c] for c in a_of.id_to_token(i))

    def b_bytes(i):
        piece = b_of.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_of.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        a, b = [(i, a_bytes(i)) for i in a_of.encode(" " + text, add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b_of.encode(text)]
        raw = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == raw == b"".join(t for _, t in b) else ([], [])

    def spans(ts):
        at, out = 0, []
        for i, t in ts:
            out.append((at, at + len(t), i))
            at += len(t)
        return out

    found = [(doc, *map(spans, tokens(text))) for doc, text in rows]
    links = []
    for _, a, b in found:
        mine, first = [], 0
        for s, e, i in a:
            while first < len(b) and b[first][1] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][0] < e:
                mine.append((i, b[k][2]))
                k += 1
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = Counter()
    for (doc, a, b), mine in zip(found, links):
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, lo = [], 0
        for hi in cuts:
            groups.append(",".join(str(i) for s, e, i in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for s, e, i in b if lo <= s and e <= hi) if len(a) < 3000 else None)
            lo = hi
        if a and groups[0] is None:  # long texts: one pass
            groups = []
            x = y = 0
            for hi in cuts:
                i, j = x, y
                while x < len(a) and a[x][1] <= hi:
                    x += 1
                while y < len(b) and b[y][1] <= hi:
                    y += 1
                groups.append(",".join(str(t[2]) for t in a[i:x]) + "|" + ",".join(str(t[2]) for t in b[j:y]))
        shown = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out[(doc, len(a), len(b), len(cuts), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), shown)] += 1
    return out


def test_alignment_is_that_of_single_tokens(spark):
    rows = [(i if i % 11 else None, t) for i, t in enumerate(alignment_texts())]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, chunk string, pair int").repartition(3)
    want = plain_alignment(rows)
    for size in (200, alignment.CHUNK_CHARS):
        assert Counter(map(tuple, alignment.align_documents(docs, JSON, PIECES, size).collect())) == want
    assert not alignment.align_documents(docs.where("false"), JSON, PIECES).collect()


def test_pieces_of_long_texts_are_the_models(monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_CHARS", 5)
    rng = random.Random(8)
    pieces = alignment.piece_model(PIECES)
    assert pieces.by_word
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "ab", "the", "é", "\n", "<s>", "x y", "中"]) for _ in range(rng.randint(0, 30)))
        assert pieces.encode(text) == pieces.model.encode(text), repr(text)


def test_ends_are_counted_in_spans():
    rng = np.random.default_rng(0)
    a, b = (np.unique(np.append(rng.integers(1, 5000, 900), 5000)) for _ in range(2))
    links, cuts = alignment.common_ends(a, b, 64)
    assert (links == np.union1d(a, b)).all() and (cuts == np.intersect1d(a, b)).all()
