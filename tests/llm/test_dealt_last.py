"""Packing, vector codes and hard negatives against plain Python, with ties, nulls, repeats, other columns and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

NAN, INF = float("nan"), float("inf")


def test_pack_histogram_holds_every_piece_once():
    from courtlake.llm.packing import fill, pack_histogram

    rng = random.Random(11)
    for length in (8, 16, 64, 1024):
        for _ in range(150):
            counts = {rng.randint(1, length - 1): rng.choice((1, 2, 7, 50)) for _ in range(rng.randint(0, 12))}
            patterns = pack_histogram(counts, length)
            assert len(patterns) <= 2 * length and all(n > 0 and sum(p) <= length for n, p in patterns)
            assert sum((Counter({s: n * k for s, k in Counter(p).items()}) for n, p in patterns), Counter()) == Counter(counts)
            room, got = 0, defaultdict(list)
            packs = fill(patterns, length)
            for n, parts in packs:
                assert sum(p[3] for p in parts) <= length
                room = max(room, 0 if n > 1 else length - sum(p[3] for p in parts))
                assert n == 1 or length - sum(p[3] for p in parts) <= 8 * length // 1024
                for s, r, a, t in parts:
                    for k in range(n):
                        got[s, r + k].append((a, t))
            assert len(got) == sum(counts.values())
            for (s, _), cuts in got.items():
                assert [a for a, _ in sorted(cuts)] == [0, *np.cumsum([t for _, t in sorted(cuts)])[:-1]] and sum(t for _, t in cuts) == s


def test_shortest_pack_first_by_single_pieces():
    from courtlake.llm.packing import pack_histogram

    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 9) for _ in range(6)}
        free = []  # plainly: each piece, longest first, to the pack with most room
        for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            at = max(range(len(free)), key=lambda i: free[i], default=None)
            if at is not None and free[at] >= s:
                free[at] -= s
            else:
                free.append(30 - s)
        assert sorted(free) == sorted(30 - sum(p) for n, p in pack_histogram(counts, 30) for _ in range(n))


@pytest.fixture(scope="module")
def byte_tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def test_packed_ids(spark, byte_tokenizer):
    from tokenizers import Tokenizer

    from courtlake.llm.packing import pack_documents, sequences

    rng = random.Random(3)
    bits = ["word", " the", "\n\n", "  ", "é", "日本", "🙂", "<|endoftext|>", "'s", "٣٤", "١", "x" * 40, "\t", " ", "don't", "123456", "\r\n", "﻿", " "]
    texts = [None, "", " ", "a" * 30000, " " * 20000, "<|endoftext|>"] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(250)]
    rows = [(i if i % 50 else None, t, "x", 1) for i, t in enumerate(texts)] + [(7, texts[7], "x", 1)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, part string, rest int").repartition(7)
    library = Tokenizer.from_file(byte_tokenizer)
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t, *_ in rows)
    got = pack_documents(df, byte_tokenizer, length=128, ids=True)
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = got.collect()
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append(r)
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and sum(r["length"] for r in parts) <= 128
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["length"] for r in out) == total and len(by) * 128 - total <= 128 + len(by)
    # documents put together again; equal texts' pieces are interchangeable
    pool, back = defaultdict(Counter), Counter()
    for r in out:
        pool[r["doc_id"], r["doc_tokens"]][r["start"], tuple(r["ids"])] += 1
    for (i, ids), n in want.items():
        for _ in range(n):
            at = 0
            while at < len(ids):
                piece = next(p for p in pool[i, len(ids)] if p[0] == at and p[1] == ids[at : at + len(p[1])] and pool[i, len(ids)][p])
                pool[i, len(ids)][piece] -= 1
                at += len(piece[1])
            back[i, ids] += 1
    assert back == want and not any(n for c in pool.values() for n in c.values())
    assert sequences(got).agg({"tokens": "sum"}).first()[0] == total
    assert pack_documents(df.limit(0), byte_tokenizer).collect() == []


def test_other_tokenizers_pack_too(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from courtlake.llm.packing import pack_documents

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello there, WORLD 12", "", "a <|endoftext|> b"]
    out = pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, ids=True).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def plain_codes(rows, rounds=4):
    d = len(min((r for r in rows if r[0] is not None), key=lambda r: r[0])[1])
    kept = [(i, [math.floor(1024 * c) for c in x] + [0] * (-d % 4), label) for i, x, label in rows if len(x) == d]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[r[1][p * w : p * w + w] for r in kept] for p in range(4)]
    books = [[list(v) for v in part[:256]] for part in parts]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for v in parts[p]:
                members[nearest(p, v)[1]].append(v)
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, errors = [], Counter()
    for n, (i, _, label) in enumerate(kept):
        got = [nearest(p, parts[p][n]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(e for e, _ in got), label))
        errors[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, e, errors[label], digest) for i, code, e, label in out), key=str)


@pytest.mark.parametrize(("n", "d", "grid"), [(700, 8, 3), (40, 6, 50), (300, 12, 1000), (1, 4, 5)])
def test_codes_by_brute_force(spark, n, d, grid, monkeypatch):
    from courtlake.llm import vector_codes

    rng = random.Random(n)
    x = lambda: [rng.randint(-grid, grid) / 64 + 1e-7 for _ in range(d)]
    rows = [(rng.choice((i, i, i, i // 2)), x(), rng.choice((None, 1, 2))) for i in range(n)]
    rows += rows[:1] * (n // 3) + ([(None, rows[0][1], 1)] if n > 1 else [])
    bad = [(5, None, 1), (6, [], 2), (7, [NAN] * d, 1), (8, [INF] * d, None), (9, [None] * d, 1), (10**6, [0.5] * (d + 4), 1)]
    df = spark.createDataFrame([(*r, "c", 0) for r in rows + bad], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    for limit in (200_000, 0):
        monkeypatch.setattr(vector_codes, "small", lambda t, limit=limit: t if not limit else t.hint("broadcast"))
        got, books = vector_codes.compress(df)
        assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows) and books.shape[0] == 4
    assert vector_codes.compress(df.limit(0))[0].collect() == []


def test_orchard_finds_the_nearest_entry():
    from courtlake.llm.vector_codes import Book

    rng = np.random.default_rng(1)
    for n, d, span in ((256, 16, 5), (256, 2, 3), (7, 3, 100), (1, 4, 9), (256, 16, 1 << 25)):
        entries, parts = rng.integers(-span, span + 1, (n, d)), rng.integers(-span, span + 1, (500, d))
        far = ((parts[:, None] - entries[None]) ** 2).sum(2)
        best, dist = Book(entries).nearest(parts)
        assert (best == far.argmin(1)).all() and (dist == far.min(1)).all()


def plain_negatives(rows):
    fine = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * c) for c in x]) for i, x, label in rows if i is not None and label is not None]
    out = []
    for a, (i, label, x) in enumerate(fine):
        if i % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, other) for b, (j, other, y) in enumerate(fine) if b != a)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(i, j, k, m, -s, -t) for k, (t, m, _) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "d", "grid"), [(900, 5, 2), (300, 16, 40), (30, 3, 1)])
def test_negatives_by_brute_force(spark, n, d, grid, monkeypatch):
    from pyspark.sql import functions as F

    from courtlake.llm import negatives

    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "TURN", 3)
    monkeypatch.setattr(negatives, "CELLS", 2)
    rng = random.Random(n)
    rows = [(rng.choice((i, 100 * (i % 9) if i % 20 == 0 else i)), [rng.randint(-grid, 2 * grid) / 64 for _ in range(d)], rng.choice((None, 0, 1, 2, 9))) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 2) for i in range(n // 3)] + rows[:1]
    bad = [(200, None, 1), (201, [], 2), (202, [NAN] * d, 1), (203, [INF] * d, 1), (204, [None] * d, 1), (None, rows[0][1], 1), (10**6, [1.0] * (d + 1), 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], "vec_id long, embedding array<double>, label int, rank int, q int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label)
    want = plain_negatives(rows)
    assert sorted(map(tuple, got.collect())) == want and (n < 100 or len(want) > 50)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_labels_of_text(spark):
    from pyspark.sql import functions as F

    from courtlake.llm.negatives import hard_negatives

    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "a"), (2, [0.5, 0.0], "b"), (3, [0.5, 0.5], "a")], "vec_id long, embedding array<float>, label string")
    assert [r["negative_id"] for r in hard_negatives(df, F.col("vec_id") == 0).collect()] == [2, 2]


def test_tiles_keep_rows():
    from courtlake.llm.negatives import tile

    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 1000, 5000):
        assert sorted(tile(rng.normal(size=(n, 7)))) == list(range(n))
