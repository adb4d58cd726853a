"""Operators against plain recomputations: code lengths, containment, targets of the mix, labels, and the whole pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_symbols(text):
    out = []
    for b in text.encode():
        c = chr(b)
        out.append(c.lower() if b < 128 and c.isalpha() else " " if b in (9, 10, 11, 12, 13, 32) else "0" if 48 <= b <= 57 else "." if b < 128 else b)
    return out


def plain_bits(text, taught, order=3, kinds_of_symbols=157):
    """Bits of a text by prediction with escapes to the next shorter context, counts of one language."""
    counts, everywhere = defaultdict(Counter), Counter()
    for lang, t in taught:
        s = [" "] * order + plain_symbols(t)
        for i in range(order, len(s)):
            everywhere[tuple(s[i - order : i])] += 1
            for k in range(order + 1):
                counts[lang, tuple(s[i - k : i])][s[i]] += 1
    langs, bits = sorted({x for x, _ in taught}), {}
    for lang in langs:

        def p(context, symbol):
            shorter = p(context[1:], symbol) if context else 1 / kinds_of_symbols
            own = counts[lang, context]
            n = sum(own.values())
            if not n or (len(context) == order and everywhere[context] < 2):
                return shorter
            return own[symbol] / (n + len(own)) if own[symbol] else len(own) / (n + len(own)) * shorter

        s = [" "] * order + plain_symbols(text)
        bits[lang] = sum(-math.log2(p(tuple(s[i - order : i]), s[i])) for i in range(order, len(s)))
    return bits


def test_code_lengths_by_brute_force(spark):
    from courtlake.llm.langid import SCORE_BYTES, identify

    rng = random.Random(1)
    words = {"en": "the cat and the dog saw a bird".split(), "de": "der hund und die katze größer mit".split(), "fr": "le chat et la maison été où".split()}
    taught = [(lang, " ".join(rng.choice(w) for _ in range(rng.randint(1, 12)))) for lang, w in words.items() for _ in range(12)]
    texts = [" ".join(rng.choice(words[rng.choice([*words])] + ["Zürich", "x9", "日本"]) for _ in range(rng.randint(1, 20))) for _ in range(60)] + ["a", "É", "qqqq", None, "12"]
    train = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(taught)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), train).collect()}
    for i, t in enumerate(texts):
        if t is None or not re.search(r"[^\W\d_]", t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        bits = plain_bits(t, taught)
        best, n = min(bits, key=lambda k: (bits[k], k)), len(t.encode())
        score = 1 / sum(2 ** (-(b - bits[best]) * min(n, SCORE_BYTES) / n) for b in bits.values())
        assert math.isclose(got[i]["score"], score, rel_tol=1e-3)
        if score > 0.51:
            assert got[i]["lang_pred"] == best


def test_noise_is_judged(spark):
    from courtlake.llm.langid import identify

    rng = random.Random(2)
    train = spark.createDataFrame([(i, "the cat and the dog saw a bird near the house " * 3, "en") for i in range(5)], "doc_id long, text string, lang string")
    noise = "".join(chr(rng.randint(0xC0, 0x2FF)) for _ in range(300))
    df = spark.createDataFrame([(1, noise), (2, "the dog and a cat near my house"), (3, "x" + noise), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in identify(df, train, judge=True).collect()} == {1: "und", 2: "en", 3: "und", 4: "und"}
    assert {r["doc_id"]: r["lang_pred"] for r in identify(df, train).collect()} == {1: "en", 2: "en", 3: "en", 4: "und"}


def shingle_set(text, n=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def test_scattered_items_by_brute_force(spark):
    from courtlake.llm.decontam import contaminated, decontaminate

    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 6, 9, 20, 45, 120))))) for i in range(60)] + [(70, None), (71, " ")]
    docs = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 4, 30, 300, 2000)))]
        for _ in range(rng.randint(0, 2)):
            part = (items[rng.randrange(60)][1]).split()
            for k in range(len(part)):
                if rng.random() < 0.02:
                    part[k] = "changed"
            cuts = sorted(rng.sample(range(len(part) + 1), min(len(part), rng.choice((0, 0, 1)))))
            for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):  # a part here, a part there
                at = rng.randint(0, len(words))
                words[at:at] = part[a:b]
        docs.append((i % 140 if i else None, " ".join(words).upper() if i % 2 else " ".join(words)))
    docs.append((999, None))
    df, table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    sets = {i: shingle_set(t) for i, t in items if shingle_set(t)}
    want = []
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        runs = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        found = sorted(j for j, s in sets.items() if len(s & runs[len(next(iter(s)))]) >= 0.8 * len(s))
        if found:
            want.append((i, len(found), found))
    got = [(r["doc_id"], r["n_items"], r["items"]) for r in contaminated(df, table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 60
    assert decontaminate(df, table).count() == len(docs) - len(want)
    assert contaminated(df, table.limit(0)).count() == 0


def test_labels_of_any_type_link_when_equal(spark):
    from courtlake.llm.embeddings import near_vectors

    v = [[1.0, 0.1], [1.0, 0.11], [1.0, 0.12], [1.0, 0.1], [1.0, 0.13]]
    for kind, labels in (("double", [1.2, 1.4, 1.4, 0.0, -0.0]), ("string", ["1", "01", "01", "", ""]), ("date", [None, *(__import__("datetime").date(2024, 1, d) for d in (1, 1, 2, 2))])):
        df = spark.createDataFrame([(i, x, label) for i, (x, label) in enumerate(zip(v, labels, strict=True))], f"vec_id long, embedding array<double>, label {kind}")
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df).collect()} == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def plain_targets(sizes, share=1.5, top=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, fixed, left = {}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        asked = {s: left * weight[s] / total for s in free} if total else {}
        over = [s for s in free if asked[s] > top * sizes[s]]
        if not over:
            return target | asked
        for s in over:
            target[s] = top * sizes[s]
            left -= target[s]
            fixed.add(s)


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_of_the_mix(spark, seed):
    from courtlake.llm.mixing import mix_sizes

    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * int(math.exp(rng.uniform(0, 6)))) if i % 30 else None, None, rng.choice(["Z", "a", "é", "b", "c", None] + ["big"] * 9), 0) for i in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in mix_sizes(df.repartition(3)).collect()}
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    sums = Counter()
    for i, _, _, s, _ in rows:
        sums[s] += size[i]
    want = plain_targets(dict(sums))
    taken = Counter()
    for i, _, _, s, _ in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (size[i], sums[s]) and math.isclose(r["target"], want[s], rel_tol=1e-9) and r["taken"] in (0, size[i], 2 * size[i])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(max(size.values()), 0.02 * want[s]) for s in want)
    assert {r["doc_id"]: r["taken"] for r in mix_sizes(df.repartition(11)).collect()} == {i: r["taken"] for i, r in got.items()}


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    english = "the cat and the dog saw that thing with a bird near my house".split()
    items = [(k, " ".join(f"exam{k}{j}" for j in range(rng.choice((3, 8, 30))))) for k in range(6)]
    docs = []
    for i in range(160):
        words = [rng.choice(english) + str(rng.randint(0, 40)) * (k % 2) for k in range(rng.choice((2, 20, 80)))]
        if i % 9 == 0:
            words += items[i % 6][1].split()
        docs.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "b", None]), 0))
    for i in range(160, 220):
        w = docs[rng.randrange(160)][1].split()
        w[rng.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w), None, "a", 0))
    docs += [(300, None, "en", "a", 0), (301, "12 ... 34", "en", "a", 0), (302, "", None, None, 0), (5, docs[5][1], "en", "b", 0)]
    df = spark.createDataFrame(docs, SCHEMA)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frames, frame = {}, df
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, str(tmp_path)).write.parquet(str(tmp_path / name))
        frames[name] = frame = spark.read.parquet(str(tmp_path / name))
    key = lambda f: sorted((r["doc_id"], r["text"]) for r in f.collect())
    kept = [d for d in docs if d[1] and re.search(r"[a-z]", d[1])]
    assert key(frames["language"]) == sorted((d[0], d[1]) for d in kept)

    sets = [shingle_set(d[1]) for d in kept]
    root = list(range(len(kept)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(kept)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)), key=lambda k: (kept[k][0], k))
                root[y] = x
    first = [d for k, d in enumerate(kept) if find(k) == k]
    assert key(frames["near_copies"]) == sorted((d[0], d[1]) for d in first) and len(first) < len(kept) - 20

    bad = {j: shingle_set(t) for j, t in items}
    holds = lambda t: any(len(s & {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}) >= 0.8 * len(s) for s in bad.values() for n in (len(next(iter(s))),))
    clean = [d for d in first if not holds(d[1].lower().split())]
    assert key(frames["benchmark"]) == sorted((d[0], d[1]) for d in clean) and len(clean) < len(first)

    mixed, size = Counter(key(frames["mixture"])), Counter()
    for d in clean:
        size[d[3]] += len(d[1].split())
    assert set(mixed) <= {(d[0], d[1]) for d in clean} and max(mixed.values()) <= 2
    of = {(d[0], d[1]): d[3] for d in clean}
    words = Counter()
    for k, n in mixed.items():
        words[of[k]] += n * len(k[1].split())
    assert all(abs(words[s] - t) <= 90 for s, t in plain_targets(dict(size)).items())

    rows = sorted(((i, zlib.crc32(t.encode()), len(t.encode()) + 8) for (i, t), n in mixed.items() for _ in range(n)))
    total, before, want, slots = sum(r[2] for r in rows), 0, [], Counter()
    for i, crc, n in rows:
        shard = min(23, (2 * before + n) * 24 // (2 * total))
        want.append((i, n, crc, shard, slots[shard]))
        slots[shard] += 1
        before += n
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in frames["shards"].collect()) == sorted(want)
    assert np.isfinite(total)
