"""Exact Jaccard self-join on word shingles by T-occurrence search.

Two sets with a Jaccard similarity of 4/5 share one of their first n - ceil(4n/5) + 1 hashes in any order that all sets
keep, and differ in a ninth of their summed sizes at most. Here common shingles come last, and the others in hash
order. Sets that share such a hash form a group; DivideSkip searches decide within groups which members share enough.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .components import components
from .grouped import BLOCK, deal_blocks, map_groups
from .memory import pieces, tidy
from .scratch import cut, drop, small
from .shingles import shingle_sets

#: Sets below this size reach 4/5 with equal sets only.
LEAST_SET = 4
#: A list of so many elements is dearer to merge than to probe.
PROBED = 1024
#: Members that a query is searched among at once, and hashes of whole sets in a block.
STAR, BLOCK_HASHES = 256, 1 << 19
#: Shingles in at least so many rows are common; of these the most frequent ones, as many as fit in the second number,
#: go last in the order (the others only make larger groups).
COMMON, MOST_COMMON = 32, 1 << 20
#: Hashes that are counted at once before the shuffle.
COUNTED = 1 << 21


def overlap_needed(a: int, b: np.ndarray) -> np.ndarray:
    """Shared shingles from which 100 * intersection >= 80 * union, that is 9 * intersection >= 4 * (a + b)."""
    return -(-4 * (a + b) // 9)


def often(elements: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """DivideSkip: (elements, occurrences) of the elements that occur in `least` or more of the sorted lists, which lie one after another with these sizes.

    Of the lists longer than PROBED the longest are set aside. An element that occurs often enough occurs in the others
    at least as often as their number falls short of `least`; those are merged by counting all at once, and only such
    elements are looked up in the long ones.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if np.count_nonzero(size) < max(least, 1):
        return none
    ends = np.cumsum(size)
    long = np.nonzero(size > PROBED)[0]
    long = long[np.argsort(-size[long], kind="stable")[: max(least - 1, 0)]]
    probed = [elements[ends[k] - size[k] : ends[k]] for k in long]
    if len(long):
        elements = elements[~np.isin(np.repeat(np.arange(len(size)), size), long)]
    found, times = np.unique(elements, return_counts=True)
    keep = times >= max(least - len(long), 1)
    found, times = found[keep], times[keep]
    for x in probed:
        k = np.minimum(np.searchsorted(x, found), len(x) - 1)
        times += x[k] == found
    keep = times >= least
    return found[keep], times[keep]


def divide_skip(lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """(element, occurrences) of the elements that occur in `least` or more of the sorted lists."""
    if lists:
        yield from zip(*(x.tolist() for x in often(np.concatenate(lists), np.array([len(x) for x in lists]), least)), strict=True)


def shared(query: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many elements of each set (one after another in `flat`) a query holds: the merge of all its lists, for a star's lists are short."""
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    return np.add.reduceat(query[at] == flat, starts, dtype=np.int64)


class Index:
    """Inverted lists of the sets of one block."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], owner[order]

    def lists(self, query: np.ndarray, shortest: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The elements of the lists that hold `shortest` or more, one after another, and the sizes of those lists."""
        low, high = np.searchsorted(self.keys, query, "left"), np.searchsorted(self.keys, query, "right")
        size = high - low
        some = size >= shortest
        low, size = low[some], size[some]
        ends = np.cumsum(size)
        return self.owners[np.repeat(low - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], size


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _pack(cells: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted 32-bit numbers and how often each occurs: differences by byte planes, compressed."""
    planes = [x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T for x in (np.diff(cells, prepend=np.uint32(0)), times)]
    return pa.compress(np.concatenate(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    steps, times = (np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in (planes[:4], planes[4:]))
    return np.cumsum(steps, dtype=np.uint32), times


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Sorted leading bits of the most frequent shingle hashes of all rows, at most MOST_COMMON, and by how many bits a hash is shifted to give them.

    Counts cover all rows. They are combined in each task and shuffled as packed buckets of the hash range; there are
    as many buckets as keep one at a few million numbers. Only which shingles sort last depends on the outcome.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shift = 32 - min(max(8, (size >> 24).bit_length()), 24)

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        cells, times = np.unique(np.concatenate(sets) >> np.uint64(shift), return_counts=True)
        bucket, low = (cells >> np.uint64(32)).astype(np.int64), cells.astype(np.uint32)
        edges = [0, *(np.nonzero(np.diff(bucket))[0] + 1), len(cells)]
        packed = [_pack(low[s:e], times[s:e]) for s, e in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(np.diff(edges)), pa.array(packed, pa.binary())], ["bucket", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for s in shingle_sets(b.column(0)):
                held.append(s)
                n += len(s)
                if n >= COUNTED:
                    yield counted(held)
                    held, n = [], 0
        if n:
            yield counted(held)

    def summed(t: pa.Table) -> tuple | None:
        parts = [_unpack(x, k) for x, k in zip(t.column("packed").to_pylist(), t.column("n").to_pylist(), strict=True)]
        cells, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        edges = np.concatenate([[0], np.nonzero(cells[1:] != cells[:-1])[0] + 1])
        times = np.add.reduceat(times[order].astype(np.int64), edges)
        often = times >= COMMON
        return ((t.column("bucket")[0].as_py() << 32) + cells[edges][often].astype(np.int64), times[often]) if often.any() else None

    buckets = docs.select(text_col).mapInArrow(tidy(run), "bucket long, n long, packed binary")
    times = cut(map_groups(buckets, ["bucket"], summed, "cell long, times long", ["cell", "times"], [pa.int64()] * 2), "join-common")
    room, least = MOST_COMMON, math.inf
    for power, n in sorted(times.groupBy(F.floor(F.log2("times")).alias("p")).count().collect(), reverse=True):
        if n > room:
            break
        room, least = room - n, 2**power
    cells = times.where(F.col("times") >= F.lit(float(least))).select("cell").toArrow().column(0).to_numpy() if least < math.inf else np.zeros(0)
    return np.sort(cells.astype(np.uint64)), shift


def common_last(s: np.ndarray, cells: np.ndarray, shift: int) -> np.ndarray:
    """Sorted hashes as numbers whose order puts common shingles last."""
    if not len(cells):
        return s >> np.uint64(1)
    head = s >> np.uint64(shift)
    common = cells[np.minimum(np.searchsorted(cells, head), len(cells) - 1)] == head
    s = s >> np.uint64(1)
    return np.concatenate([s[~common], s[common] | np.uint64(1 << 63)])


def document_sets(docs: DataFrame, id_col: str, text_col: str, whole: bool, common: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """id, n, sig and hashes (whole: all of them, else the prefix) of each row; no sig without shingles."""
    cells, shift = common or (np.zeros(0, np.uint64), 0)
    cells = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, sig, hashes = [], [], []
            for s in shingle_sets(b.column(1)):
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append((s if whole else common_last(s, cells.value, shift)[: len(s) - (4 * len(s) + 4) // 5 + 1]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(hashes, pa.binary())], ["id", "n", "sig", "hashes"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), "id long, n long, sig binary, hashes binary")


def _postings(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(x, np.int64) for x in b.column("hashes").to_pylist()]
            times = [len(s) for s in sets]
            if sum(times):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(b.column("id").to_numpy(), times)), pa.array(np.concatenate([np.arange(t) for t in times]), pa.int32())], ["hash", "id", "pos"])

    return sets.select("id", "hashes").mapInArrow(tidy(run), "hash long, id long, pos int")


def _named(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names for the groups in batches sorted by hash and id; at most one batch and `block` rows are held."""

    def given(names: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(pos)], ["g", "id", "pos"])

    def of(h: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
        edges = np.concatenate([[0], np.nonzero(h[1:] != h[:-1])[0] + 1, [len(h)]])
        size = np.diff(edges)
        keep = size > 1
        names = h[edges[:-1]].copy()
        for k in np.nonzero(keep & (size <= block))[0]:
            names[k] = int.from_bytes(hashlib.blake2b(ids[edges[k] : edges[k + 1]].tobytes(), digest_size=8).digest(), "little", signed=True)
        rows = np.repeat(keep, size)
        return given(np.repeat(names, size)[rows], ids[rows], pos[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        rest, large = none, None  # large: a hash whose rows go out as they come
        for b in batches:
            if not b.num_rows:
                continue
            h, ids, pos = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(rest, ("hash", "id", "pos"), strict=True))
            if large is not None:
                k = int(np.searchsorted(h, large, "right"))
                if k:
                    yield given(h[:k], ids[:k], pos[:k])
                h, ids, pos = h[k:], ids[k:], pos[k:]
                if not len(h):
                    continue
                large = None
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield of(h[:last], ids[:last], pos[:last])
            rest = h[last:], ids[last:], pos[last:]
            if len(rest[0]) > block:
                yield given(*rest)
                rest, large = none, h[-1]
        if len(rest[0]):
            yield of(*rest)

    return run


def _groups(postings: DataFrame) -> DataFrame:
    """g, id, pos of the groups of a hash that two or more sets hold. Hashes with the same members make one group.

    pos is the place of the smallest of a group's hashes in the set's prefix. A group of more than BLOCK members keeps its hash as its name; it comes in several batches and is never gathered.
    """
    return postings.repartition("hash").sortWithinPartitions("hash", "id").mapInArrow(tidy(_named(BLOCK)), "g long, id long, pos int").groupBy("g", "id").agg(F.min("pos").alias("pos"))


def _may_match(query: np.ndarray, n_query: int, sets: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """Whether what a query's and each other prefix show up to the smaller of their ends leaves the sets within a ninth of their sizes."""
    flat, starts, ends = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])]), np.array([s[-1] for s in sets])
    seen = np.searchsorted(query, np.minimum(ends, query[-1]), "right") + np.add.reduceat(flat <= query[-1], starts, dtype=np.int64)
    return 9 * (seen - 2 * shared(query, flat, starts)) <= n_query + n


def _sized(n_a: str, n_b: str) -> str:
    return f"5 * least({n_a}, {n_b}) >= 4 * greatest({n_a}, {n_b})"


def _stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, part, id, query and the set of each row: a query `a` and its partners, so that its set is moved once.

    A query with many partners is searched in many tasks.
    """
    sizes = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_k")), "join-sizes")
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("_k")).cast("int").alias("part"), F.col("b").alias("id"), F.lit(False).alias("query"))
    asked = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("part"), F.col("a").alias("id"), F.lit(True).alias("query"))
    return members.unionByName(asked).join(sets.select("id", "n", "hashes"), "id")


def _prune_star(t: pa.Table) -> tuple | None:
    query, ids, n = t.column("query").to_numpy(), t.column("id").to_numpy(), t.column("n").to_numpy()
    members = np.nonzero(~query)[0]
    if not query.any() or not len(members):
        return None
    sets = _arrays(t.column("hashes"))
    others = [sets[k] for k in members]
    found = [(q, members[_may_match(sets[q], n[q], others, n[members])]) for q in np.nonzero(query)[0]]
    return np.concatenate([np.repeat(ids[q], len(k)) for q, k in found]), np.concatenate([ids[k] for _, k in found])


def pruned(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and prefixes don't rule out."""
    sizes = sets.select("id", "n")
    fit = pairs.join(sizes.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"id": "b", "n": "nb"}), "b").where(_sized("na", "nb"))
    return map_groups(_stars(cut(fit.select("a", "b"), "join-sized-pairs"), sets), ["a", "part"], _prune_star, "a long, b long", ["a", "b"], [pa.int64()] * 2)


def _askers(comp: np.ndarray) -> np.ndarray:
    """Members outside a block's largest component: each pair of different components has one."""
    _, kind, times = np.unique(comp, return_inverse=True, return_counts=True)
    return np.nonzero(kind != times.argmax())[0]


def _marked(t: pa.Table) -> tuple | None:
    """g, c, i, j and id of a block's members that may match one of another component, found by searching prefixes.

    A pair counts in one group only: that of the first hash which both prefixes hold. At most the block's rows come out.
    """
    ids, n, comp, own, pos = (t.column(c).to_numpy() for c in ("id", "n", "component", "own", "pos"))
    if (comp == comp[0]).all() or not own.any():
        return None
    sets = _arrays(t.column("hashes"))
    index, flat = Index(sets), np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    ends = np.array([s[-1] for s in sets])
    marked = np.zeros(len(sets), bool)
    for i in _askers(comp):
        s = sets[i]
        other = (comp != comp[i]) & (own | own[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
        if not other.any():
            continue
        seen = np.searchsorted(s, np.minimum(ends, s[-1]), "right") + np.add.reduceat(flat <= s[-1], starts, dtype=np.int64)
        need = np.maximum(1, -(-(9 * seen - n - n[i]) // 18))
        for j, times in zip(*often(*index.lists(s, 2), int(need[other].min())), strict=True):  # the set itself is in all of its lists
            if other[j] and times >= need[j] and not (marked[i] and marked[j]):
                first = np.intersect1d(s, sets[j], assume_unique=True)[0]
                if np.searchsorted(s, first) == pos[i]:
                    marked[i] = marked[j] = True
    return tuple(t.column(c).to_numpy()[marked] for c in ("g", "c", "i", "j", "id")) if marked.any() else None


def _forest(t: pa.Table) -> tuple | None:
    """Links between the components of a block, each verified on whole sets by a T-occurrence search.

    A link is given only if it ties two components that the block's earlier links haven't, so a block of m members
    gives m - 1 links at most.
    """
    ids, n, comp = (t.column(c).to_numpy() for c in ("id", "n", "component"))
    sets, comp = _arrays(t.column("hashes")), comp.copy()
    index, a, b = Index(sets), [], []
    for i in _askers(comp):
        need, other = overlap_needed(int(n[i]), n), comp != comp[i]
        if not other.any():
            break
        for j, times in zip(*often(*index.lists(sets[i], 2), int(need[other].min())), strict=True):
            if times >= need[j] and comp[j] != comp[i]:
                a.append(ids[i])
                b.append(ids[j])
                comp[comp == comp[j]] = comp[i]
    return (np.array(a), np.array(b)) if a else None


def _search_sets(t: pa.Table) -> tuple | None:
    """Links of a group's query with its members, by a T-occurrence search over whole sets."""
    query, ids, n = t.column("query").to_numpy(), t.column("id").to_numpy(), t.column("n").to_numpy()
    members = np.nonzero(~query)[0]
    if not query.any() or not len(members):
        return None
    sets = _arrays(t.column("hashes"))
    flat, starts = np.concatenate([sets[k] for k in members]), np.cumsum([0, *(len(sets[k]) for k in members[:-1])])
    found = [(q, members[shared(sets[q], flat, starts) >= overlap_needed(int(n[q]), n[members])]) for q in np.nonzero(query)[0]]
    return np.concatenate([np.repeat(ids[q], len(k)) for q, k in found]), np.concatenate([ids[k] for _, k in found])


def whole_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n and hashes of the given ids. Sets are made again from the texts of the ids in question alone."""
    wanted = cut(reps.select("id", "doc", "sig").join(small(ids), "id", "left_semi"), "join-wanted")
    texts = docs.join(small(wanted).select(F.col("doc").alias(id_col)), id_col, "left_semi")
    made = document_sets(texts, id_col, text_col, whole=True).withColumnRenamed("id", "doc").join(wanted, ["doc", "sig"])
    return cut(made.select("id", "n", "hashes"), "join-sets")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose whole sets link."""
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "join-ids")
    sets = whole_sets(ids, reps, docs, id_col, text_col)
    out = cut(map_groups(_stars(pairs, sets), ["a", "part"], _search_sets, "a long, b long", ["a", "b"], [pa.int64()] * 2), "join-links")
    drop(sets, ids)
    return out


def between_components(groups: DataFrame, first: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links that tie components of `first` which share a group, at least a spanning forest of them.

    Prefixes are searched in blocks of a group and a size class; members that may match another component's are marked,
    and only their whole sets move to the same blocks, where links are verified and a forest of them is given.
    """
    # every pair with a group's first member has been searched
    later = groups.join(groups.groupBy("g").agg(F.min("id").alias("a")), "g").where("id > a").drop("a")
    placed = cut(later.join(first, "id", "left").select("g", "id", "pos", F.coalesce("component", "id").alias("component")), "join-placed")
    mixed = placed.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("g")
    # sizes of a link are within 5/4, so of the same or of neighbouring classes
    grade = F.floor(F.log("n") / math.log(1.25)).cast("int")
    sized = placed.join(mixed, "g").join(reps.select("id", grade.alias("_c")), "id").withColumn("c", F.explode(F.array("_c", F.col("_c") + 1))).withColumn("own", F.col("c") == F.col("_c")).drop("_c")
    several = sized.groupBy("g", "c").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("own").alias("own")).where("x < y and own").select("g", "c")
    sized = cut(sized.join(several, ["g", "c"]), "join-sized")
    room = F.greatest(F.lit(16), F.least(F.lit(BLOCK), F.lit(BLOCK_HASHES) / F.pow(F.lit(1.25), F.col("c"))))
    dealt = cut(deal_blocks(sized, ["g", "c"], room), "join-dealt")
    cell = ["g", "c", "i", "j"]
    marks = map_groups(dealt.join(reps.select("id", "n", "hashes"), "id"), cell, _marked, "g long, c int, i int, j int, id long", [*cell, "id"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()])
    marks = cut(marks.join(first, "id", "left").withColumn("component", F.coalesce("component", "id")), "join-marks")
    drop(placed, sized, dealt)
    sets = whole_sets(cut(marks.select("id").distinct(), "join-ids"), reps, docs, id_col, text_col)
    out = cut(map_groups(marks.join(sets, "id"), cell, _forest, "a long, b long", ["a", "b"], [pa.int64()] * 2), "join-more")
    drop(sets, marks)
    return out


def _classes(rows: DataFrame) -> tuple[DataFrame, bool]:
    """sig, doc (its smallest id) and id (its number in links) of each set; whether some number isn't such an id.

    Where several sets have one smallest id, that is the number of one of them; the others' is a hash of id and set.
    """
    of_sig = cut(rows.where("sig is not null and id is not null").groupBy("sig").agg(F.min("id").alias("doc")), "join-classes")
    shared = cut(of_sig.groupBy("doc").count().where("count > 1").select("doc"), "join-shared")
    if shared.isEmpty():
        return of_sig.withColumn("id", F.col("doc")), False
    first = of_sig.join(small(shared), "doc", "left_semi").groupBy("doc").agg(F.min("sig").alias("_sig"))
    own = F.when(F.col("sig") != F.col("_sig"), F.xxhash64("doc", "sig")).otherwise(F.col("doc"))
    return cut(of_sig.join(first, "doc", "left").select("sig", "doc", own.alias("id")), "join-classes"), True


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n, sig, component_id and first (whether its set is the component's first, under the smallest id) of each row."""
    rows = cut(document_sets(docs, id_col, text_col, whole=False, common=common_shingles(docs, text_col)), "join-rows")
    of_sig, numbered = _classes(rows)
    reps = rows.withColumnRenamed("id", "doc").join(of_sig, ["sig", "doc"]).dropDuplicates(["id"])
    reps = cut(reps.where(F.col("n") >= LEAST_SET).select("id", "doc", "n", "sig", "hashes"), "join-sets-short")
    groups = cut(_groups(_postings(reps)), "join-groups")
    stars = groups.join(groups.groupBy("g").agg(F.min("id").alias("a")), "g").where("id > a").select("a", F.col("id").alias("b")).distinct()
    likely = cut(pruned(stars, reps), "join-likely")
    links = verified(likely, reps, docs, id_col, text_col)
    first = cut(components(links), "join-components")
    more = between_components(groups, first, reps, docs, id_col, text_col)
    drop(groups, likely, first)
    linked = components(links.unionByName(more)).withColumnRenamed("id", "_id")
    classes = of_sig.join(linked, of_sig["id"] == linked["_id"], "left").select("sig", "doc", "id", F.coalesce("component", "id").alias("_component"))
    if numbered:
        classes = cut(classes, "join-numbered")
        names = classes.groupBy("_component").agg(F.min("doc").alias("_doc"), F.min_by("id", F.struct("doc", F.col("id") != F.col("doc"), "id")).alias("_first"))
        chosen = names.groupBy("_doc").agg(F.min_by("_first", F.struct(F.col("_first") != F.col("_doc"), "_first")).alias("_chosen"))
        names = names.join(chosen, "_doc").select("_component", "_first", F.when(F.col("_first") == F.col("_chosen"), F.col("_doc")).otherwise(F.col("_first")).alias("component_id"))
        classes = classes.join(names, "_component").drop("_component")
    else:
        classes = classes.withColumn("_first", F.col("_component")).withColumnRenamed("_component", "component_id")
    classes = classes.withColumnRenamed("id", "_id")
    first = F.coalesce((F.col("_id") == F.col("_first")) & (F.col("id") == F.col("doc")), F.lit(True))
    return rows.select("id", "n", "sig").join(classes, "sig", "left").select("id", "n", "sig", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), first.alias("first"))


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every document; documents link at a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts have no shingle and link with nothing, as do rows without an id (component null).
    Texts with equal sets are one set, so copies cost nothing more. Links of each group's first member are searched
    first; only members that those leave in different components are searched against each other, in blocks that give
    a spanning forest of their links. No link between two components can be left out, but links within one are not all
    listed. Repeated rows share an answer;
    rows with one id and different sets are placed each by its own. A component's id is its smallest one; where
    several components share that, all but one have a hash instead.
    """
    return _found(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _with_sig(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns, and `_sig` as document_sets gives it."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in shingle_sets(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig, pa.binary())], [*b.schema.names, "_sig"])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField("_sig", BinaryType())]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, that with the smallest id. All columns are kept.

    Rows without an id stay, and so do all without a shingle. Where an id is repeated with different texts, each row
    stays or goes by its own text's set.
    """
    found = cut(_found(docs, id_col, text_col), "join-found")
    again = cut(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "join-again")
    gone = cut(found.where("not first and id is not null").select(F.col("id").alias(id_col)).distinct(), "join-gone")
    kept = docs.join(small(gone), id_col, "left_anti")
    if again.isEmpty():
        return kept
    rows = _with_sig(docs.join(small(again), id_col, "left_semi").select(*docs.columns), text_col)
    stay = cut(found.where("first and sig is not null").select(F.col("id").alias(id_col), F.col("sig").alias("_sig")).join(small(again), id_col, "left_semi").distinct(), "join-stay")
    several = rows.join(small(stay), [id_col, "_sig"], "left_semi").dropDuplicates([id_col, "_sig"]).unionByName(rows.where("_sig is null"))
    return kept.join(small(again), id_col, "left_anti").unionByName(several.drop("_sig")).select(*docs.columns)
