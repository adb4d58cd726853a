"""Stages and operators keep what they have no reason to drop."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_stage_without_labels(spark):
    import corpus_pipeline

    texts = [(i, f"the cat and dog number {i}", None, "s", 0) for i in range(20)] + [(20, None, "en", "s", 0), (None, "no id here", "en", "s", 0)]
    got = corpus_pipeline.language(spark, spark.createDataFrame(texts, SCHEMA), "")
    assert got.count() == len(texts)
    taught = [(i, t, "en", s, n) for i, t, _, s, n in texts] + [(30, "123 !!", "en", "s", 0)]
    assert corpus_pipeline.language(spark, spark.createDataFrame(taught, SCHEMA), "").count() == len(texts) - 1


def test_large_groups_are_not_gathered():
    import numpy as np
    import pyarrow as pa

    from courtlake.llm.ngram_join import _named

    held = [(-5, 1), (-5, 2), *((7, i) for i in range(200)), (8, 3), (9, 1), (9, 2), *((11, i) for i in range(5))]
    batches = [pa.RecordBatch.from_arrays([pa.array([h for h, _ in held[k : k + 6]], pa.int64()), pa.array([i for _, i in held[k : k + 6]], pa.int64()), pa.array([0] * len(held[k : k + 6]), pa.int32())], ["hash", "id", "pos"]) for k in range(0, len(held), 6)]
    out = list(_named(4)(iter(batches)))
    assert max(b.num_rows for b in out) <= 10
    names, ids = (np.concatenate([b.column(c).to_numpy() for b in out]) for c in ("g", "id"))
    assert sorted(ids[names == 7]) == list(range(200)) and sorted(ids[names == 11]) == list(range(5))
    small = names[(names != 7) & (names != 11)]
    assert len(small) == 4 and len(set(small)) == 1  # -5 and 9 have the same members


def test_repeated_ids_with_different_texts(spark):
    from courtlake.llm.ngram_join import keep_first, near_texts

    word = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    texts = [
        (1, word("a")), (2, word("b")), (2, word("a") + " end"), (3, word("c")), (3, word("d")), (4, word("d")), (5, word("c") + " end"), (5, word("c") + " end"),
        (6, word("e")), (6, word("e") + " end"), (7, None), (7, " "), (None, word("a")), (8, word("f")), (8, word("f")),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(texts)], SCHEMA)
    kept = keep_first(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    one = [r[1] for r in got if r[0] == 6]
    assert one in ([word("e")], [word("e") + " end"])
    assert [r for r in got if r[0] != 6] == sorted([(1, word("a")), (2, word("b")), (3, word("c")), (3, word("d")), (7, ""), (7, " "), (0, word("a")), (8, word("f"))])
    placed = near_texts(df).collect()
    assert len(placed) == len(texts)
    # rows of 3 with c and with d are of two components
    assert len({r["component_id"] for r in placed if r["doc_id"] in (3, 4, 5)}) == 2
    assert {r["component_id"] for r in placed if r["doc_id"] == 2} == {1, 2}


def test_join_against_brute_force(spark):
    import random

    from courtlake.llm.ngram_join import near_texts

    rng = random.Random(9)
    frame = [f"f{i}" for i in range(40)]  # its shingles are common
    texts = []
    for c in range(50):
        base = (frame if c < 30 else []) + [f"c{c}w{i}" for i in range(rng.randint(20, 90))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in near_texts(df).collect()} == dict(enumerate(root))
    assert 50 < len(set(root)) < 300


def test_join_of_a_large_near_group(spark, monkeypatch):
    """400 edits of one text, few of which link with the first: blocks of few rows, so that groups are dealt to many."""
    import random

    import numpy as np

    from courtlake.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 80)
    monkeypatch.setattr(ngram_join, "STAR", 30)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(70)]
    texts = []
    for _ in range(400):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 5))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    sets = [sorted({hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)}) for w in map(str.split, texts)]
    code = {h: k for k, h in enumerate(sorted({h for s in sets for h in s}))}
    has = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        has[i, [code[h] for h in s]] = 1
    both = has @ has.T
    size = has.sum(1)
    link = 9 * both >= 4 * (size[:, None] + size[None, :]) - 1e-3
    root = np.arange(len(sets))
    while True:
        new = np.array([root[row].min() for row in link])
        if (new == root).all():
            break
        root = new
    assert len(set(root)) > 10
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.near_texts(df).collect()} == dict(enumerate(root.tolist()))
