"""Pack documents into sequences of one length: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import pieces, tidy
from .scratch import cut, small

#: A pack with so many tokens of room at most (of 1,024; in proportion for other lengths) counts as full.
LENGTH, END, SPARE = 1024, 0, 8
_LOADED: dict = {}


def _byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings, where ids are in the order of the merges; else None."""
    model = spec["model"]
    before = spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec.get("truncation") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    if any(not a["special"] or a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec["added_tokens"]):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {a["content"] for a in spec["added_tokens"]}
    vocab = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
    merged = [bytes(byte[c] for c in "".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ids = [vocab[m] for m in merged]
    return vocab if ids == sorted(set(ids)) and all(vocab[bytes([b])] < ids[0] for b in range(256)) else None


def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them, without special tokens that it would add.

    A byte-level BPE whose ids are in merge order is run by tiktoken, which gives the same ids about five times as
    fast; texts it refuses, and any other tokenizer, go through the library itself.
    """
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()

        def slow(text: str) -> list[int]:
            return library.encode(text, add_special_tokens=False).ids

        spec = json.loads(Path(path).read_text())
        ranks = _byte_ranks(spec)
        if ranks is None:
            _LOADED[path] = slow
        else:
            import tiktoken

            # fixed value: the split pattern of byte-level pre-tokenizers
            pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in spec["added_tokens"]})

            def encode(text: str) -> list[int]:
                try:
                    return fast.encode(text, allowed_special="all")
                except ValueError:  # a run that its pattern engine gives up on
                    return slow(text)

            _LOADED[path] = encode
    return _LOADED[path]


def encoded(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32 bits, END last), tokens, rest (tokens beyond whole sequences), part, and
    what the task had before: whole (whole sequences) and place (rows of that rest)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen, whole = [0] * length, 0
        for b in pieces(batches):
            ids, tokens, places, wholes = [], [], [], []
            for text in b.column("_text"):
                one = np.array([*encode(text.as_py() or ""), END], "<u4")
                ids.append(one.tobytes())
                tokens.append(len(one))
                places.append(seen[len(one) % length])
                wholes.append(whole)
                seen[len(one) % length] += 1
                whole += len(one) // length
            n = np.array(tokens, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array((n % length).astype(np.int32)), pa.array(np.full(len(n), part, np.int32)), pa.array(wholes, pa.int64()), pa.array(places, pa.int64())], ["_id", "ids", "tokens", "rest", "part", "whole", "place"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"_id {kind}, ids binary, tokens long, rest int, part int, whole long, place long")


def pack_histogram(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(number of packs, lengths in a pack) patterns of all pieces, by counts of lengths.

    Longest first. A piece goes to the shortest pack, the one with most room, if it fits there, else it opens a new
    one; all packs of a pattern are treated at once, so the work depends on the number of lengths alone: a step ends
    a length or turns a pattern into one with a piece more, so there are at most two patterns a length.
    """
    room: dict[int, list[tuple[int, tuple | None]]] = {}
    full = []

    def put(n: int, pattern: tuple | None, free: int) -> None:
        if n:
            (room.setdefault(free, []) if free else full).append((n, pattern))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            free = max((f for f, at in room.items() if at), default=0)
            if free >= size:
                n, pattern = room[free].pop()
                used = min(n, left)
                put(n - used, pattern, free)
                put(used, (pattern, size), free - size)
                left -= used
            else:  # each new pack becomes the shortest one until no further piece of this size fits
                many = length // size
                for n, k in ((left // many, many), (1, left % many)):
                    if n and k:
                        pattern = None
                        for _ in range(k):
                            pattern = (pattern, size)
                        put(n, pattern, length - k * size)
                left = 0
    out = []
    for n, pattern in [*full, *(x for f in sorted(room) for x in room[f])]:
        sizes = []
        while pattern:
            pattern, size = pattern
            sizes.append(size)
        out.append((n, sizes[::-1]))
    return out


def fill(patterns: list[tuple[int, list[int]]], length: int = LENGTH, cuts: bool = True) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """(number of packs, pieces (size, first rank, start, tokens)); with `cuts` pieces of the emptiest packs are cut to fill up the others.

    Ranks number the pieces of a size. A pack's piece stands for those of ranks first, first + 1, ... in the pattern's packs.
    """
    ranks: dict[int, int] = {}
    full, open_ = [], []
    for n, sizes in patterns:
        parts = []
        for s in sizes:
            parts.append((s, ranks.get(s, 0), 0, s))
            ranks[s] = ranks.get(s, 0) + n
        (full if length - sum(sizes) <= SPARE * length // LENGTH else open_).append((n, parts))
    if not cuts:
        return full + open_
    later = lambda parts, k: [(s, r + k, a, t) for s, r, a, t in parts]
    tokens = lambda pack: sum(p[3] for p in pack[1])
    open_.sort(key=tokens, reverse=True)  # the emptiest are last
    at = 0
    while at < len(open_):
        n, taker = open_[at]
        if at == len(open_) - 1:
            if n == 1:
                break
            open_[at : at + 1] = [(n - n // 2, taker), (n // 2, later(taker, n - n // 2))]
            continue
        m, giver = open_.pop()
        k = min(n, m)
        if m > k:
            open_.append((m - k, later(giver, k)))
        if n > k:
            open_.insert(at + 1, (n - k, later(taker, k)))
        taker, giver, free = list(taker), list(giver), length - tokens((0, taker))
        while free and giver:
            s, r, a, t = giver.pop()
            if t > free:
                giver.append((s, r, a + free, t - free))
            taker.append((s, r, a, min(t, free)))
            free -= min(t, free)
        if giver:
            open_.append((k, giver))
        if free:
            open_[at] = (k, taker)
        else:
            full.append((k, taker))
            at += 1
            open_[at - 1] = None
    return full + [p for p in open_ if p]


def _slots(packs: list, first: int) -> tuple[np.ndarray, ...]:
    """For each piece of each pattern, in order of (size, start, rank): these three, its tokens, first sequence and offset."""
    rows = []
    for n, parts in packs:
        offset = 0
        for s, r, a, t in parts:
            rows.append((s, a, r, t, first, offset))
            offset += t
        first += n
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 6


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, filled: bool = True) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (ids: and the piece's ids).

    A document's ids end with END. It is cut after each `length` ids; whole sequences stand alone, and of what rests
    the histogram decides. Only with `filled` are rests cut further, to fill the packs that are left with more room
    than SPARE, so that padding stays below that share, and one sequence.

    Null text counts as empty (one id). Null ids and repeated rows are kept, each row with pieces of its own. Other
    columns are left out. No table gives no rows. A very long text is one task's row, cut into sequences as it comes.
    Tasks number their own rows of each length; prefix sums over tasks make ranks of that, so no length is sorted or
    gathered, however many rows share it. The driver holds the histogram and its patterns: at most `length` numbers
    and two patterns for each of them.
    """
    rows = cut(encoded(docs, tokenizer, length, id_col, text_col), "packing-ids")
    counts = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.expr(f"tokens div {length}")).alias("_w"))
    counts = cut(counts, "packing-counts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = counts.groupBy("part").agg(F.sum("_w").alias("_w")).select("part", F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_whole"))  # one row a task
    ahead = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select("part", "rest", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_rank")).join(wholes, "part"), "packing-bases")
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("_n").alias("n")).collect()}
    n_whole = counts.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    size, start, rank, tokens, sequence, offset = _slots(fill(pack_histogram(histogram, length), length, cuts=filled), n_whole)
    kind = docs.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            n, rest = b.column("tokens").to_numpy(), b.column("rest").to_numpy().astype(np.int64)
            whole = n // length
            doc = np.repeat(np.arange(len(n)), whole)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
            got = [(doc, nth * length, np.full(len(doc), length), (b.column("_whole").to_numpy() + b.column("whole").to_numpy())[doc] + nth, np.zeros(len(doc), np.int64))]
            of, done = np.nonzero(rest)[0], np.zeros(len(n), np.int64)
            ranks = b.column("_rank").to_numpy() + b.column("place").to_numpy()
            while len(of):
                at = _find((size, start, rank), (rest[of], done[of], ranks[of]), length)
                got.append((of, whole[of] * length + done[of], tokens[at], sequence[at] + ranks[of] - rank[at], offset[at]))
                done[of] += tokens[at]
                of = of[done[of] < rest[of]]
            doc, begin, many, seq, off = (np.concatenate(c) for c in zip(*got, strict=True))
            whole_ids = b.column("ids")
            parts = [memoryview(whole_ids[int(d)].as_buffer())[4 * s : 4 * (s + m)] for d, s, m in zip(doc, begin, many, strict=True)]
            out = [b.column("_id").take(pa.array(doc)), pa.array(begin), pa.array(many), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(off)]
            out += [pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], pa.list_(pa.int64()))] if ids else []
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
    placed = rows.join(small(bases), ["part", "rest"]).select("_id", "ids", "tokens", "rest", "whole", "_whole", "place", "_rank")
    out = placed.mapInArrow(tidy(place), f"_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if ids else ""))
    return out.select(F.col("_id").alias(id_col), *names[1:])


def _find(table: tuple, asked: tuple, length: int) -> np.ndarray:
    """The slot of each (size, start, rank): the last one of that size and start that isn't beyond the rank."""
    pairs = table[0] * length + table[1]
    groups = np.unique(pairs)
    key = lambda pair, rank: np.searchsorted(groups, pair) * (1 << 40) + rank
    return np.searchsorted(key(pairs, table[2]), key(asked[0] * length + asked[1], asked[2]), "right") - 1


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, tokens and ids of each sequence, from pieces with ids. A sequence has at most as many pieces as tokens."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"), F.sum("length").alias("tokens"))
    return got.select("sequence_id", "tokens", F.flatten("_p.ids").alias("ids"))
