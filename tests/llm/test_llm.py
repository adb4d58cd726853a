"""Small cases of each operator against plain Python."""

import hashlib
import random
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size long, count long"


def docs_of(spark, texts, **kw):
    return spark.createDataFrame([(i, t, kw.get("lang"), kw.get("source", "s"), 0, 7, 7, 7) for i, t in texts], SCHEMA)


WORDS = " ".join(f"w{i}" for i in range(60))
ODD = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (3, "a b"), (None, "x y"), (4, WORDS), (5, WORDS), (6, WORDS + " z"), (7, "!" * 50_000)]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_sharding(spark):
    from courtlake.llm.sharding import shard_documents

    got = shard_documents(docs_of(spark, ODD), 3).collect()
    assert len(got) == len(ODD)
    text = dict((i, t) for i, t in ODD)
    for r in got:
        assert (r["size"], r["text_crc32"]) == (len((text[r["doc_id"]] or "").encode()) + 8, zlib.crc32((text[r["doc_id"]] or "").encode()))
    for k in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert shard_documents(docs_of(spark, []), 3).count() == 0


def test_mixing(spark):
    from courtlake.llm.mixing import mix_documents, mix_sizes

    df = spark.createDataFrame([(i, "w " * (i % 7), None, None if i % 5 == 0 else f"s{i % 5}", 0) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mix_sizes(df).collect()
    assert len(got) == 400 and all(r["taken"] <= 2 * r["size"] for r in got)
    for target in {(r["source_size"], r["target"]) for r in got}:
        taken = sum(r["taken"] for r in got if (r["source_size"], r["target"]) == target)
        n = len({(r["doc_id"] % 5) for r in got if (r["source_size"], r["target"]) == target})
        assert abs(taken - n * target[1]) <= 7 * n
    assert rows(mix_sizes(df), "doc_id", "taken") == rows(mix_sizes(df), "doc_id", "taken")
    assert sum(len(r.text.split()) for r in mix_documents(df).collect()) == sum(r["taken"] for r in got)
    assert mix_sizes(docs_of(spark, [])).count() == 0 and mix_sizes(docs_of(spark, ODD)).count() == len(ODD)


def test_pii(spark):
    from courtlake.llm.pii import find_pii, pii_digest

    texts = [(0, "mail a.b@x.org, é 10.0.0.1, 4111 1111 1111 1111 or +1 (555) 123-4567"), (1, None), (2, "4111 1111 1111 1112, 1.2.3.256"), (3, "IBAN DE89 3704 0044 0532 0130 00"), (4, "1" * 5000), (5, "call 555 123-4567")]
    got = {r["doc_id"]: r for r in pii_digest(find_pii(docs_of(spark, texts))).collect()}
    t = texts[0][1]
    want = [f"{k}:{t.index(m)}:{t.index(m) + len(m)}" for k, m in (("email", "a.b@x.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"))]
    assert got[0]["spans"] == ",".join(want)
    assert got[1]["spans"] == got[2]["spans"] == got[4]["spans"] == ""
    assert got[3]["spans"] == "iban:5:32" and got[5]["spans"] == "local_phone:5:17"


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from courtlake.llm.scratch import new_path
    from courtlake.llm.tokens import token_counts

    path = str(P.path("word_bpe_49k.json"))
    texts = [*ODD, (8, "It's <|endoftext|> x<|startoftext|>y"), (9, "é é ß  ́a")]
    cache = new_path(spark, "cache")
    lib = Tokenizer.from_file(path)
    want = sorted([(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in texts], key=repr)
    assert rows(token_counts(docs_of(spark, texts), path, cache), "doc_id", "n_bytes", "n_tokens") == want
    n = spark.read.parquet(cache).count()
    assert rows(token_counts(docs_of(spark, texts), path, cache), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == n


def test_warc(spark):
    from courtlake.llm.scratch import new_path
    from courtlake.llm.warc import archive_pages, merge_runs

    big = "<p>WARC/1.1\r\n\r\n\r\n é" * 20
    pages = [(1, "http://www.b.org/x?b=2&a=1", big), (2, "http://a.b.org/", big), (3, None, None), (4, "http://c.org", "s"), (5, "http://c.org", "s"), (None, "http://d.org/ x", "q" * 200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["id"]: r for r in archive_pages(df, new_path(spark, "warc")).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("response", None)}
    assert got[2]["payload_bytes"] == len(big.encode()) and got[1]["urlkey"] == "org,b)/x?a=1&b=2"
    assert archive_pages(df.limit(0), new_path(spark, "warc")).count() == 0
    runs = [[1, 4, 4], [], [2, 4], [0]]
    keys, bounds = [], []
    for r in runs:
        bounds.append((len(keys), len(keys) + len(r)))
        keys += [(x,) for x in r]
    assert [keys[i][0] for i in merge_runs(keys, bounds)] == [0, 1, 2, 4, 4, 4]


def test_vectors(spark):
    from courtlake.llm.embeddings import near_vectors

    a, nan = [1.0, 2.0, 3.0], float("nan")
    data = [(1, a, 1), (2, a, 1), (3, [1.0, 2.0, 3.01], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0] * 3, 1), (8, [nan, 1.0, 1.0], 1), (9, [1.0, None, 1.0], 1), (10, [-3.0, 1.0, 0.0], 1), (11, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in range(4, 12))


def test_jaccard(spark):
    from courtlake.llm.ngram_join import divide_skip, keep_first, near_texts

    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_texts(docs_of(spark, ODD)).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), None: (1, None), 4: (56, 4), 5: (56, 4), 6: (57, 4), 7: (1, 7)}
    kept = keep_first(docs_of(spark, ODD))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["0", "1", "2", "3", "4", "7", "None"] and kept.columns == docs_of(spark, []).columns
    import numpy as np

    lists = [np.array(x) for x in ([1, 2, 3], [2, 3], [3], [2, 3, 5, 7, 9, 11], [1, 2, 3, 4, 5, 6])]
    assert sorted(divide_skip(lists, 4)) == [(2, 4), (3, 5)]
    assert near_texts(docs_of(spark, [])).count() == 0


def test_decontamination(spark):
    from courtlake.llm.decontam import contaminated, decontaminate

    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (4, "")], "item_id long, text string")
    texts = [*ODD[:5], (20, WORDS + " " + item.upper() + " tail"), (21, " ".join(item.split()[:10])), (22, "say two words now")]
    got = {r["doc_id"]: r["items"] for r in contaminated(docs_of(spark, texts), items).collect()}
    assert got == {20: [1], 22: [3]}
    assert decontaminate(docs_of(spark, texts), items).count() == len(texts) - 2
    assert contaminated(docs_of(spark, []), items).count() == 0 and contaminated(docs_of(spark, texts), items.limit(0)).count() == 0


def test_language(spark):
    from courtlake.llm.langid import identify

    en, de = "the cat and the dog with that thing " * 5, "der hund und die katze mit schönen dingen " * 5
    train = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de", "s", 0, 1, 1, 1) for i in range(20)], SCHEMA)
    texts = [(1, "that thing with the dog"), (2, "und die schönen katzen"), (3, None), (4, ""), (5, "123 !!"), (6, "the dog " * 200_000)]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs_of(spark, texts), train).collect()}
    assert got == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert {r["lang_pred"] for r in identify(docs_of(spark, texts), train.limit(0)).collect()} == {"und"}
    assert identify(docs_of(spark, []), train).count() == 0


def plain_repeats(texts):
    """doc_id, n_bytes, n_removed, n_spans and digest of what stays, of texts with distinct ids."""
    first = {}
    raw = {i: (t or "").encode() for i, t in texts}
    for i in sorted(raw):
        for k in range(len(raw[i]) - 49):
            first.setdefault(raw[i][k : k + 50], i)
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        yield i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_suffixes(spark, monkeypatch):
    from courtlake.llm import suffixes

    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rng = random.Random(4)
    parts = ["".join(rng.choice("ab é") for _ in range(n)) for n in (30, 49, 50, 51, 120, 400)]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", "x", "yz" * 20]) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    texts += [(60, None), (61, ""), (62, "a" * 3000), (63, "b" + "a" * 500), (64, texts[0][1]), (65, WORDS), (66, "q" + WORDS)]
    want = sorted(plain_repeats(texts), key=repr)
    assert rows(suffixes.repeats(docs_of(spark, texts)), *cols) == want
    monkeypatch.setattr(suffixes, "FREQUENT", 1)
    assert rows(suffixes.repeats(docs_of(spark, texts)), *cols) == want
    kept = suffixes.repeats(docs_of(spark, texts), keep_bytes=True).collect()
    assert len(kept) == len(texts) and all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)
    got = suffixes.repeats(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and sum(r["n_removed"] for r in got) == len(WORDS) * 2
    assert suffixes.repeats(docs_of(spark, [])).count() == 0
