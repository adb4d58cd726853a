"""Operators against plain Python on seeded inputs, columns with clashing names, and the whole pipeline stage by stage."""

import math
import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "copies long, rate double, cut_key long, cut_rank double, level double, _src string, _size long, _key long, _row long, lang_pred string, score double, shard int, size long, slot long, _part int"


def test_pii_base_spans_by_fuzz(spark, monkeypatch):
    from courtlake.llm import pii

    monkeypatch.setattr(pii, "PART", 3)
    rng = random.Random(8)
    bits = ["a.b@c.org", "@", "x@y", "1.2.3.4", "1.2.3.400", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", " ", "é", "7", "-", "call ", "a@b.c.d"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]

    def luhn(x):
        d = [int(c) for c in x[::-1]]
        return sum(d[0::2] + [sum(divmod(2 * c, 10)) for c in d[1::2]]) % 10 == 0

    only = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 13 <= len(only(m)) <= 19 and luhn(only(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    }
    got = {r["doc_id"]: r["spans"] for r in pii.pii_digest(pii.find_pii(spark.createDataFrame(texts, "doc_id long, text string"))).collect()}
    for i, t in texts:
        want = [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, t) if ok(m[0])]
        assert [x for x in got[i].split(",") if x.split(":")[0] in kinds] == want


def test_many_matches_in_one_text(spark):
    from courtlake.llm.pii import find_pii, pii_digest

    text = " ".join(f"a{i}@x.org" for i in range(20_000))
    row = pii_digest(find_pii(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string"))).collect()
    assert sorted(r["n_email"] for r in row) == [0, 20_000, 20_000]


def test_shards_by_brute_force(spark):
    from courtlake.llm.sharding import shard_documents

    rng = random.Random(2)
    texts = [(rng.randint(0, 200), "x" * rng.choice((0, 1, 5, 50, 3000))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts], SCHEMA)
    size = lambda t: len(t.encode()) + 8
    order = sorted(texts, key=lambda x: (x[0], zlib.crc32(x[1].encode()), size(x[1])))
    total, before, want, slots = sum(size(t) for _, t in texts), 0, [], {}
    for i, t in order:
        k = min(6, (2 * before + size(t)) * 7 // (2 * total))
        want.append((i, size(t), k, slots.setdefault(k, 0)))
        slots[k] += 1
        before += size(t)
    got = shard_documents(df, 7).collect()
    assert sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in got) == sorted(want)
    whole = shard_documents(df, 7, whole=True)
    assert whole.columns[:5] == df.columns and sorted((r["doc_id"], r["text"]) for r in whole.collect()) == sorted(texts)


def test_mixing_levels_and_fill(spark):
    from courtlake.llm.mixing import mix_sizes

    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(math.exp(rng.uniform(0, 7)))), None, f"s{i % 6}", 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mix_sizes(df).collect()
    size = {i: len(t.split()) for i, t, *_ in rows}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    total = sum(size.values())
    assert abs(sum(r["taken"] for r in got) - 1.5 * total) < 0.01 * total
    for k in range(6):
        own = [r for r in got if r["doc_id"] % 6 == k]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.01 * own[0]["target"]


def test_clashing_columns(spark):
    from courtlake.llm.decontam import decontaminate
    from courtlake.llm.langid import identify
    from courtlake.llm.mixing import mix_documents
    from courtlake.llm.ngram_join import keep_first
    from courtlake.llm.pii import find_pii
    from courtlake.llm.sharding import shard_documents

    word = " ".join(f"w{i}" for i in range(30))
    extra = (7, 0.5, 7, 0.5, 0.5, "x", 7, 7, 7, "zz", 0.1, 7, 7, 7, 7)
    df = spark.createDataFrame([(i, t, "en", "s", 0, *extra) for i, t in enumerate((word, word + " z", "the cat", None, ""))], f"{SCHEMA}, {CLASH}")
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(9)))], "item_id long, text string")
    assert mix_documents(df).columns == df.columns and set(mix_documents(df).select("copies", "_row").distinct().collect()) <= {(7, 7)}
    assert decontaminate(df, items).select("_key").distinct().collect() == [(7,)]
    assert keep_first(df).columns == df.columns and keep_first(df).count() == 4
    judged = identify(df, df, keep=df.columns)
    assert sorted(judged.columns) == sorted(df.columns) and {r["lang_pred"] for r in judged.collect()} == {"en", "und"}
    assert find_pii(df).count() == 5 and shard_documents(df, 3, whole=True).select("shard").distinct().collect() == [(7,)]


def test_shared_cache_with_repeated_digests(spark):
    P = pytest.importorskip("public_tokenizers")
    from courtlake.llm.scratch import new_path
    from courtlake.llm.tokens import token_counts

    path, cache = str(P.path("word_bpe_49k.json")), new_path(spark, "cache")
    df = spark.createDataFrame([(i, f"some words {i}", None, None, 0) for i in range(20)], SCHEMA)
    want = sorted(map(tuple, token_counts(df, path, cache).collect()))
    spark.read.parquet(cache).limit(10).write.mode("append").parquet(cache)
    assert sorted(map(tuple, token_counts(df, path, cache).collect())) == want
    assert token_counts(df.limit(0), path, cache).count() == 0


def test_vectors_of_extreme_size(spark):
    from courtlake.llm.embeddings import near_vectors

    rows = [(1, [1e200, 2e200], 1), (2, [1.0, 2.0], 1), (3, [1e-200, 2.001e-200], 1), (4, [2.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()} == {1: 2, 2: 2, 3: 2, 4: 0}
    assert near_vectors(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    english, german = "the cat and the dog saw that thing with a bird near my house".split(), "der hund und die katze mit dem vogel sehen das ding bei uns im haus".split()
    item = " ".join(f"exam{i}" for i in range(20))
    docs = []
    for i in range(120):
        lang, words = ("en", english) if i % 2 else ("de", german)
        docs.append((i, " ".join(rng.choice(words) + str(rng.randint(0, 9)) * (k % 3 == 0) for k in range(60)), lang, f"s{i % 3}", 0))
    docs += [(200, docs[3][1] + " end", "en", "s1", 0), (201, docs[5][1], "en", "s0", 0), (202, "12 34 !!", "en", "s0", 0), (203, None, None, None, 0), (204, docs[7][1] + " " + item.upper(), "en", "s1", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids, frame = [], df
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        ids.append((name, sorted(r["doc_id"] for r in frame.collect())))
        assert name == "shards" or frame.columns == df.columns
    kept = dict(ids)
    assert set(kept["language"]) == set(range(120)) | {200, 201, 204}
    assert set(kept["near_copies"]) == set(range(120)) | {204}
    assert set(kept["benchmark"]) == set(range(120))
    assert 0 < len(set(kept["mixture"])) <= 120 and max(kept["mixture"].count(i) for i in set(kept["mixture"])) <= 2
    assert kept["shards"] == kept["mixture"]
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 8 for r in df.collect()}
    assert all(r["size"] == size[r["doc_id"]] for r in frame.collect())
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
