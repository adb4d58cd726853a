"""Removal of byte strings that repeat across documents, by common prefixes of suffixes.

Which strings can repeat is narrowed first: every window of LENGTH bytes has a smallest hash among its grams of GRAM
bytes, and equal windows have the same one, so only runs of windows whose hash occurs in two documents go on. Those
runs are gathered by hash and de-duplicated; runs that share a longer string around the gram stay, and blocks of them get a suffix array, a Burrows-Wheeler transform and a
breadth-first backward extension that finds their common prefixes by increasing value and stops at LENGTH.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import text_bytes
from .scratch import cut, drop, free_shuffles, small
from .shingles import _BACK, _BASE, _power, mix

LENGTH, GRAM = 50, 16
#: Windows of a run at most; bytes whose grams are hashed at once; bytes of a block; distinct runs of a hash that
#: still go into one block (those of a more frequent hash are split by longer strings around its gram).
RUN, CHUNK, BLOCK, FREQUENT = 64, 1 << 17, 1 << 19, 1 << 13


def window_runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, text, start, windows) of runs of windows that share their smallest gram hash; none crosses a text."""
    span, found = length - gram + 1, []
    for s in range(int(at[0]), int(at[-1]) - length + 1, CHUNK):
        b = data[s : min(s + CHUNK + length - 1, int(at[-1]))]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=sums[1:])
        m = mix((sums[gram:] - sums[:-gram]) * _power(_BACK, len(b))[: len(b) - gram + 1])
        step = 1
        while step * 2 <= span:
            m, step = np.minimum(m[:-step], m[step:]), step * 2
        if step < span:
            m = np.minimum(m[: step - span], m[span - step :])
        new = np.ones(len(m), bool)
        new[1:] = m[1:] != m[:-1]
        low, high = np.searchsorted(at, [s, s + len(m)])
        edges = at[low:high]
        new[edges - s] = True
        for k in range(1, length):  # windows that would cross a text's end
            over = edges - s - k
            new[over[over >= 0]] = True
        first = np.nonzero(new)[0]
        size = np.diff(np.append(first, len(m)))
        doc = np.searchsorted(at, first + s, "right") - 1
        fits = first + s + length <= at[doc + 1]
        first, size, doc = first[fits], size[fits], doc[fits]
        # the last window before the end of the chunk may stand in a text that goes on; sizes end at the text's end
        size = np.minimum(size, at[doc + 1] - length + 1 - first - s)
        parts = -(-size // RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, size, doc = np.repeat(first, parts) + RUN * nth, np.repeat(size, parts) - RUN * nth, np.repeat(doc, parts)
        found.append((m[first], doc, first + s - at[doc], np.minimum(size, RUN)))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _shared(base: DataFrame) -> DataFrame:
    """k, h, p of the runs whose hash occurs in two rows; p holds start << 9 | windows << 2.

    Of the rows of a batch that share a hash one goes to the hash's task, as a witness for other batches (2), and the
    others are dealt freely (1), so a hash that is everywhere isn't gathered.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            h, doc, start, size = window_runs(data, at)
            if not len(h):
                continue
            k, p = b.column("k").to_numpy()[doc], start << 9 | size << 2
            order = np.argsort(h, kind="stable")
            edge = np.concatenate([[0], np.nonzero(np.diff(h[order]))[0] + 1])
            many = np.minimum.reduceat(k[order], edge) != np.maximum.reduceat(k[order], edge)
            # rows stay in the order of the texts, in which shuffled bytes pack well
            p[order] |= np.repeat(many, np.diff(np.append(edge, len(h))))
            p[order[edge[many]]] ^= 3
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(p)], ["h", "k", "p"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def of(h: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
            edge = np.concatenate([[0], np.nonzero(h[1:] != h[:-1])[0] + 1])
            hit = (np.minimum.reduceat(k, edge) != np.maximum.reduceat(k, edge)) | (np.maximum.reduceat(p & 3, edge) > 0)
            hit = np.repeat(hit, np.diff(np.append(edge, len(h))))
            return pa.RecordBatch.from_arrays([pa.array(k[hit]), pa.array(h[hit]), pa.array(p[hit])], ["k", "h", "p"])

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(c).to_numpy() for c in ("h", "k", "p")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield of(*(x[:last] for x in now))
            rest = [x[last:] for x in now]
        if rest is not None:
            yield of(*rest)

    rows = base.select("k", "text").mapInArrow(runs, "h long, k long, p long")
    return rows.repartition(F.when(F.expr("p & 3") == 1, F.xxhash64("h", "k")).otherwise(F.col("h"))).sortWithinPartitions("h").mapInArrow(judged, "k long, h long, p long")


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of many ranges, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _contexts(texts: DataFrame) -> DataFrame:
    """k, id, start, windows, h and the bytes of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            runs = b.column("runs")
            of = np.repeat(np.arange(b.num_rows), runs.value_lengths().to_numpy())
            h, p = (runs.flatten().field(i).to_numpy() for i in range(2))
            start, n = p >> 9, p >> 2 & 127
            size = n + LENGTH - 1
            for i in range(0, len(h), 1 << 14):
                c = slice(i, i + (1 << 14))
                flat = data[_ragged(at[of[c]] + start[c], size[c])]
                offsets = np.concatenate([[0], np.cumsum(size[c])]).astype(np.int32)
                ctx = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(of[c])), b.column("id").take(pa.array(of[c])), pa.array(start[c]), pa.array(n[c]), pa.array(h[c]), ctx], ["k", "id", "start", "n", "h", "ctx"])

    return texts.select("k", "id", "text", "runs").mapInArrow(run, "k long, id long, start long, n long, h long, ctx binary")


def suffix_array(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of the suffixes; symbol 0 ends each string, `left` symbols before its end, and earlier ends sort first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.zeros(n, np.uint64)
    for t in range(8):
        word |= np.where(left > t, padded[t : t + n], 0).astype(np.uint64) << np.uint64(56 - 8 * t)
    order, known, most = np.argsort(word, kind="stable"), 8, int(left.max(initial=0)) + 1
    key = word
    while True:
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        if known >= most or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        after = np.zeros(n, np.int64)
        on = np.nonzero(left > known)[0]
        after[on] = rank[on + known]
        key = rank * (n + 1) + after
        order, known = np.argsort(key, kind="stable"), known * 2


def common_prefixes(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix length of each suffix with the one before it, in suffix order; -1 where it is `least` or more.

    Starts from the empty string's interval and extends all intervals of one length by each symbol before them, using
    the transform's last-to-first map. An extended interval goes on only if the entry behind it is still open; then
    that entry is the length so far. Intervals of one length are disjoint, so their sorted starts and sorted ends
    belong together. Each end of a string is a symbol of its own.
    """
    n = len(order)
    before = text[order - 1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    to = place[order - 1]
    by_symbol = np.argsort(before, kind="stable")
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    last, following = np.full(n, -1), np.full(n, n)
    last[by_symbol[1:][same]] = by_symbol[:-1][same]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = 0
    ends = int((text == 0).sum())
    low, high = np.array([0]), np.array([n])
    for length in range(least):
        single = high - low == 1
        one = low[single]
        one = one[before[one] != 0]
        lo, hi = low[~single], high[~single]
        size = hi - lo
        at = _ragged(lo, size)
        some = before[at] != 0
        at, left, right = at[some], np.repeat(lo, size)[some], np.repeat(hi, size)[some]
        starts = np.concatenate([to[one], to[at[last[at] < left]]])
        stops = np.concatenate([to[one], to[at[following[at] >= right]]]) + 1
        if not length:
            starts, stops = np.concatenate([starts, np.arange(ends)]), np.concatenate([stops, np.arange(ends) + 1])
        starts.sort()
        stops.sort()
        open_ = lcp[stops] < 0
        low, high = starts[open_], stops[open_]
        lcp[high] = length
        if not len(low):
            break
    return lcp[:n]


def repeated(strings: pa.Array, ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string the starts of its windows that also stand in a string of a smaller id."""
    a = strings.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    size = np.diff(at)
    ends = np.cumsum(size + 1) - 1
    text = np.zeros(int(size.sum()) + len(a), np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    # UTF-8 has no byte 255, so all symbols can be one higher than their byte
    text[inside] = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]] + np.uint8(1)
    left = np.repeat(ends, size + 1) - np.arange(len(text))
    order = suffix_array(text, left)
    edge = np.nonzero(common_prefixes(text, order, length) >= 0)[0]
    owner = np.repeat(np.arange(len(a)), size + 1)
    least = np.repeat(np.minimum.reduceat(ids[owner[order]], edge), np.diff(np.append(edge, len(order))))
    hit = order[least < ids[owner[order]]]
    hit.sort()
    of = owner[hit]
    return np.split(hit - (ends - size)[of], np.searchsorted(of, np.arange(1, len(a))))


def anchors(h: np.ndarray, strings: pa.Array, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(run, key) of longer strings around the gram of each run's hash, each once for a run.

    A window that two runs share holds the gram at one place in both, and reaches far enough from there to the right,
    to both sides or to the left, so the two share one of the three strings around it.
    """
    a = strings.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    b, at = np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=sums[1:])
    back = _power(_BACK, len(b) + 1)
    owner = np.repeat(np.arange(len(a)), np.diff(at))[: len(b) - gram + 1]
    q = np.nonzero((mix((sums[gram:] - sums[:-gram]) * back[: len(owner)]) == h[owner]) & (np.arange(len(owner)) + gram <= at[owner + 1]))[0]
    rows, keys = [], []
    room = length - gram  # of a window besides its gram
    third = room // 3
    for left, right in ((0, room - third), (third, third), (room - third, 0)):
        low, high, of = q - left, q + gram + right, owner[q]
        some = np.nonzero((low >= at[of]) & (high <= at[of + 1]))[0]
        rows.append(of[some])
        keys.append(mix((sums[high[some]] - sums[low[some]]) * back[low[some]]) ^ h[of[some]])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((rows, keys))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], keys[new]


def may_repeat(h: np.ndarray, strings: pa.Array, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Which runs can share a window with another run: those that share an anchor with one."""
    rows, keys = anchors(h, strings, length, gram)
    same = keys[1:] == keys[:-1]
    keep = np.zeros(len(strings), bool)
    keep[rows[1:][same]] = True
    keep[rows[:-1][same]] = True
    return keep


def _spans(starts: np.ndarray) -> list[int]:
    """start, end, start, end ... of the bytes that the windows at sorted starts cover."""
    if not len(starts):
        return []
    gap = np.nonzero(starts[1:] > starts[:-1] + LENGTH)[0]
    return np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.append(gap, len(starts) - 1)] + LENGTH], 1).ravel().tolist()


def _searched(classes: DataFrame) -> DataFrame:
    """h, d and spans of the runs with windows of a smaller id; whole groups are put into blocks of about BLOCK bytes."""
    import pyarrow.compute  # noqa: F401

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        g = t.column("g").to_numpy()
        alone = np.ones(len(g), bool)
        alone[1:] &= g[1:] != g[:-1]
        alone[:-1] &= g[1:] != g[:-1]
        t = t.filter(pa.array(~alone)).combine_chunks()
        if t.num_rows:
            t = t.filter(pa.array(may_repeat(t.column("h").to_numpy().view(np.uint64), t.column("ctx").combine_chunks())))
        if t.num_rows:
            found = [_spans(x) for x in repeated(t.column("ctx").combine_chunks(), t.column("m").to_numpy())]
            some = pa.array([bool(x) for x in found])
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().filter(some) for c in ("h", "d")), pa.array([x for x in found if x], pa.list_(pa.int32()))], ["h", "d", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.nbytes < BLOCK:
                continue
            g = rest.column("g").to_numpy()
            edge = np.append(np.nonzero(g[1:] != g[:-1])[0] + 1, len(g))[:-1]
            bytes_at = np.cumsum(pa.compute.binary_length(rest.column("ctx")).to_numpy())
            done = 0
            while len(cuts := edge[(edge > done) & (bytes_at[edge - 1] - (bytes_at[done - 1] if done else 0) >= BLOCK)]):
                yield from of(rest.slice(done, cuts[0] - done))
                done = int(cuts[0])
            rest = rest.slice(done)
        if rest is not None and rest.num_rows:
            yield from of(rest)

    return classes.select("g", "h", "d", "m", "ctx").repartition("g").sortWithinPartitions("g").mapInArrow(run, "h long, d long, spans array<int>")


def _by_anchor(classes: DataFrame) -> DataFrame:
    """Runs of frequent hashes, once for each of their anchors, in groups `g` of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, keys = anchors(b.column("h").to_numpy().view(np.uint64), b.column("ctx"))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(b.column(c).take(at) for c in ("h", "d", "m", "ctx"))], ["g", "h", "d", "m", "ctx"])

    return classes.select("h", "d", "m", "ctx").mapInArrow(run, "g long, h long, d long, m long, ctx binary")


def _inner(classes: DataFrame) -> DataFrame:
    """What _searched and _one_by_one find. Groups of a hash that has over FREQUENT runs are split by their anchors."""
    grouped = classes.withColumn("g", F.col("h"))
    often = cut(classes.groupBy("h").count().where(F.col("count") > FREQUENT).select("h"), "suffix-frequent")
    if often.isEmpty():
        return cut(_searched(grouped), "suffix-inner")
    split = cut(_by_anchor(classes.join(small(often), "h", "left_semi")), "suffix-split")
    still = cut(split.groupBy("g").count().where(F.col("count") > FREQUENT).select("g"), "suffix-still")
    found = _searched(grouped.join(small(often), "h", "left_anti").select(*split.columns).unionByName(split.join(small(still), "g", "left_anti")))
    return cut(found.unionByName(_one_by_one(split.join(small(still), "g", "left_semi").dropDuplicates(["h", "d"]))), "suffix-inner")


def _one_by_one(classes: DataFrame) -> DataFrame:
    """The same for runs that share an anchor with over FREQUENT others: their windows are spread over all tasks and compared by minimum."""
    rows = classes.select("h", "d", "m", F.posexplode(F.expr(f"transform(sequence(1, octet_length(ctx) - {LENGTH - 1}), i -> substring(ctx, i, {LENGTH}))")).alias("i", "w"))
    least = rows.groupBy("h", "w").agg(F.min("m").alias("v"))
    hit = rows.join(least, ["h", "w"]).where("v < m").select("h", "d", F.array(F.col("i"), F.col("i") + LENGTH).alias("s"))
    return hit.groupBy("h", "d").agg(F.flatten(F.collect_list("s")).alias("spans"))


def _cleaned(texts: DataFrame) -> DataFrame:
    """k, n_removed, n_spans, kept of each text and its covered spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            spans = b.column("spans").to_pylist()
            removed, runs, kept = [], [], []
            for i, x in enumerate(spans):
                step = np.zeros(int(at[i + 1] - at[i]) + 2, np.int64)
                s = np.array(x, np.int64)
                np.add.at(step, s[0::2] + 1, 1)
                np.add.at(step, s[1::2] + 1, -1)
                gone = np.cumsum(step)[1:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(data[at[i] : at[i + 1]][~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], ["k", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("k", "text", "spans").mapInArrow(run, "k long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row (keep_bytes: also `kept`, the remaining bytes).

    Each byte goes that is covered by a string of LENGTH bytes which also starts in a text of a smaller id. Null texts
    are empty. Rows without an id lose nothing and take nothing from others; rows that repeat an id take nothing from
    each other. A text that a smaller id holds whole goes whole, without a search. Other columns aren't returned.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("k", F.xxhash64("id", "text"))
    facts = cut(rows.select("id", "k", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sig")), "suffix-rows")
    firsts = facts.where("id is not null").groupBy("sig").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    copies = cut(facts.join(firsts, "sig").where("id > first").select("k").distinct(), "suffix-copies")
    base = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH)).join(small(copies), "k", "left_anti")
    runs = cut(_shared(base).repartition("k").groupBy("k").agg(F.collect_list(F.struct("h", "p")).alias("runs")), "suffix-runs")
    free_shuffles(docs.sparkSession)
    contexts = cut(_contexts(base.join(runs, "k")).withColumn("d", F.xxhash64("ctx")), "suffix-contexts")
    drop(runs)
    classes = cut(contexts.groupBy("h", "d", "ctx").agg(F.min("id").alias("m")), "suffix-classes")
    places = cut(contexts.select("k", "id", "start", "n", "h", "d"), "suffix-places")
    drop(contexts)
    inner = _inner(classes)
    least = cut(classes.select("h", "d", "m"), "suffix-least")
    drop(classes)
    # an occurrence that isn't in its class's first document goes whole, the others where the search says so
    judged = places.join(least, ["h", "d"])
    whole = judged.where("id > m").select("k", F.array(F.col("start"), F.col("start") + F.col("n") + LENGTH - 1).alias("s"))
    partly = judged.where("id = m").join(inner, ["h", "d"]).select("k", F.transform("spans", lambda x: x + F.col("start")).alias("s"))
    spans = cut(whole.unionByName(partly).repartition("k").groupBy("k").agg(F.flatten(F.collect_list("s")).alias("spans")), "suffix-spans")
    drop(places, least, inner)
    found = _cleaned(base.join(spans, "k")).dropDuplicates(["k"])
    found = cut(found if keep_bytes else found.drop("kept"), "suffix-cleaned")
    out = facts.join(found, "k", "left").join(copies.withColumn("copy", F.lit(True)), "k", "left")
    gone = F.col("copy").isNotNull() & (F.col("n_bytes") >= LENGTH)
    out = out.select(
        F.col("id").alias(id_col), "k", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sig")))).alias("kept_sha256"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("_found"), gone.alias("_gone")] if keep_bytes else []),
    )
    if not keep_bytes:
        return out.drop("k")
    bodies = rows.select("k", F.encode("text", "utf-8").alias("_all")).dropDuplicates(["k"])
    return out.join(bodies, "k").withColumn("kept", F.when(F.col("_gone"), F.lit(b"")).otherwise(F.coalesce("_found", "_all"))).drop("k", "_found", "_gone", "_all")
