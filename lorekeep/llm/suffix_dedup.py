"""Removal of repeated byte strings by deep-shallow suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts earlier. Suffixes are
sorted up to that many bytes; those with equal beginnings stand side by side, and all
but the earliest are repeats.

Only suffixes that can have an equal take part, and equal ones have to meet in one
task: each start of a string has a name, the least hash of the string's grams, and
neighbouring starts of one name are cut out as one piece of text.

1. Names are counted over all texts. Strings of a name that occurs once have no equal.
2. Pieces whose names occur again are grouped by name and bytes. Of equal pieces the
   earliest goes on; all starts of the others are repeats.
3. Each task sorts the suffixes of its names: a bucket step on eight bytes, multikey
   quicksort up to the shallow depth, blind tries for groups that are equal so far.
4. A name with very many pieces, a line that stands among other words everywhere, is
   cut again by longer grams, until none has so many; only those that still occur
   again remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import MayHold, save

#: Bytes of a string that may not occur again.
LENGTH = 100
#: Bytes of the first grams; each further cut halves what is missing to ``length``.
GRAM = 32
#: Bytes up to which multikey quicksort goes: three characters of eight bytes each.
SHALLOW = 24
#: Pieces under one name that are sorted together.
MOST = 512
#: Starts of one text that are looked at together, and bytes that a task sorts at once.
BLOCK = 1 << 17
SORTED_BYTES = 1 << 21

_RNG = np.random.default_rng(17)
_BYTE = _RNG.integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0x9E3779B97F4A7C15
#: A place is id * 2^31 + start; null ids come last.
_START_BITS = 31
_NO_ID = 1 << 30
PIECE = "h long, piece binary, place decimal(30,0)"


class Names(MayHold):
    """A table of 16 MB, whatever the corpus, that tells which names may occur again: all of them, and few others."""

    BITS, PRIME = 1 << 27, 134217689


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each ``gram`` bytes."""
    h, width = _BYTE[data], 1
    while width < gram:
        step = min(width, gram - width)
        h, width = h[:-step] * np.uint64(pow(_STEP, width, 1 << 64)) + h[step:], width + step
    h = h ^ (h >> np.uint64(29))
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def _extreme(h: np.ndarray, wide: int, of=np.minimum) -> np.ndarray:
    """The least, or greatest, of each ``wide`` consecutive numbers."""
    width = 1
    while width < wide:
        step = min(width, wide - width)
        h, width = of(h[:-step], h[step:]), width + step
    return h


def occurring_names(data: np.ndarray, gram: int, length: int) -> np.ndarray:
    """The names of all runs, each once, and once more those whose gram stands twice within a string's reach.

    In such a run a string can occur again. A gram is the least of some string exactly if its hash is the greatest
    of the names of the strings over it; two places of one such gram have no other between them.
    """
    found, wide = [], length - gram + 1
    for o in range(0, max(len(data) - length + 1, 0), BLOCK):
        h = _grams(data[o : o + BLOCK + length - 1], gram)
        m = _extreme(h, wide)
        found.append(m[np.append(True, m[1:] != m[:-1])])
        edge = np.zeros(wide - 1, dtype=np.uint64)
        least = np.flatnonzero(h == _extreme(np.concatenate([edge, m, edge]), wide, np.maximum))
        near = (h[least[1:]] == h[least[:-1]]) & (np.diff(least) <= wide)
        found.append(h[least[1:][near]])
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def runs(data: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, past the last start) of neighbouring starts of one name, at most ``length - gram + 1`` of them."""
    names, firsts, ends = [], [], []
    total = len(data) - length + 1
    for o in range(0, max(total, 0), BLOCK):
        m = _extreme(_grams(data[o : o + BLOCK + length - 1], gram), length - gram + 1)
        new = np.ones(len(m), dtype=bool)
        np.not_equal(m[1:], m[:-1], out=new[1:])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(m)))
        most = length - gram + 1
        if size.max() > most:
            pieces = -(-size // most)
            part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = np.repeat(first, pieces) + part * most
        names.append(m[first].view(np.int64))
        firsts.append(first + o)
        ends.append(np.append(first[1:], len(m)) + o)
    if not names:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    return np.concatenate(names), np.concatenate(firsts), np.concatenate(ends)


def _texts(col: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """The bytes of each row; null counts as empty."""
    for v in col.cast(pa.binary()) if not pa.types.is_binary(col.type) else col:
        b = v.as_buffer().to_pybytes() if v.is_valid else b""
        yield np.frombuffer(b, dtype=np.uint8), b


def _decimals(ids: np.ndarray, null: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Places as decimals, from the two halves of each 128-bit number."""
    lo = (ids.astype(np.uint64) << np.uint64(_START_BITS)) | starts.astype(np.uint64)
    hi = ids >> (64 - _START_BITS)
    lo, hi = np.where(null, starts.astype(np.uint64), lo), np.where(null, _NO_ID, hi)
    both = np.empty((len(ids), 2), dtype=np.uint64)
    both[:, 0], both[:, 1] = lo, hi.astype(np.int64).view(np.uint64)
    return pa.Array.from_buffers(pa.decimal128(30, 0), len(ids), [None, pa.py_buffer(both.tobytes())])


def _places(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, whether it is null, start) of decimals."""
    col = col.cast(pa.decimal128(38, 0))
    both = np.frombuffer(col.buffers()[1], dtype=np.uint64)[2 * col.offset : 2 * (col.offset + len(col))].reshape(-1, 2)
    lo, hi = both[:, 0], both[:, 1].view(np.int64)
    null = hi >= _NO_ID
    ids = (np.where(null, 0, hi) << (64 - _START_BITS)) | (lo >> np.uint64(_START_BITS)).astype(np.int64)
    return np.where(null, 0, ids), null, (lo & np.uint64((1 << _START_BITS) - 1)).astype(np.int64)


def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(col.is_null())
    return np.asarray(col.fill_null(0)).astype(np.int64), null


# Sorting.


def _eight(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; ``data`` goes on for eight bytes beyond the last."""
    rows = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(rows).view(">u8")[:, 0].astype(np.uint64)


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): suffixes by bucket and by their first ``depth`` bytes, a multiple of eight; ``head`` marks the first of equal ones.

    After a bucket step on eight bytes, all groups are parted at once: by a pivot of their own into less,
    equal and greater; the equal go on with the next eight bytes, the others with the same.
    """
    n = len(starts)
    key = _eight(data, starts) if depth else np.zeros(n, dtype=np.uint64)
    order = np.lexsort((key, bucket))
    head = np.ones(n, dtype=bool)
    head[1:] = (bucket[order][1:] != bucket[order][:-1]) | (key[order][1:] != key[order][:-1])
    lo = np.flatnonzero(head)
    size = np.diff(np.append(lo, n))
    deep = np.full(len(lo), 8)
    while True:
        go = (size > 1) & (deep < depth)
        lo, size, deep = lo[go], size[go], deep[go]
        if not len(lo):
            return order, head
        first = np.cumsum(size) - size
        group = np.repeat(np.arange(len(lo)), size)
        within = np.arange(len(group)) - first[group]
        at = lo[group] + within
        own = order[at]
        key = _eight(data, starts[own] + deep[group])
        pivot = key[first + size // 2][group]
        less, same = key < pivot, key == pivot
        n_less, n_same = np.add.reduceat(less.astype(np.int64), first), np.add.reduceat(same.astype(np.int64), first)
        before = np.cumsum(less) - less
        before -= before[first][group]
        equals = np.cumsum(same) - same
        equals -= equals[first][group]
        to = np.where(less, before, np.where(same, n_less[group] + equals, (n_less + n_same)[group] + within - before - equals))
        order[lo[group] + to] = own
        middle, high = lo + n_less, lo + n_less + n_same
        n_high = size - n_less - n_same
        head[middle] = True
        head[high[n_high > 0]] = True
        lo, size, deep = np.concatenate([lo, middle, high]), np.concatenate([n_less, n_same, n_high]), np.concatenate([deep, deep + 8, deep])


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Numbers of strings of one length in their order, equal ones together.

    An inner node holds the place of a byte and a child for each byte there, no more. A string goes down blindly to
    some leaf, is compared with that leaf alone, and branches off where the two differ.
    """
    root: list | int = 0
    equal: dict[int, list[int]] = {0: [0]}
    for i in range(1, len(strings)):
        s, path, node = strings[i], [], root
        while type(node) is list:
            path.append(node)
            node = node[1].get(s[node[0]])
            if node is None:
                node = next(iter(path[-1][1].values()))
        t = strings[node]
        if s == t:
            equal[node].append(i)
            continue
        equal[i] = [i]
        differ = len(s) - (((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() + 7) >> 3)
        k = len(path)
        while k and path[k - 1][0] >= differ:
            k -= 1
        if k < len(path) and path[k][0] == differ:
            path[k][1][s[differ]] = i
            continue
        below = path[k] if k < len(path) else node
        new = [differ, {t[differ]: below, s[differ]: i}]
        if k:
            path[k - 1][1][s[path[k - 1][0]]] = new
        else:
            root = new
    found, open_ = [], [root]
    while open_:
        node = open_.pop()
        if type(node) is list:
            open_ += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            found.append(equal[node])
    return found


def deep_shallow(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): suffixes by bucket and by their first ``length`` bytes; ``head`` marks the first of equal ones.

    ``data`` goes on for eight bytes beyond the last suffix. A trie of two leaves is one comparison.
    """
    reached = min(shallow, length) // 8 * 8
    order, head = multikey_quicksort(data, starts, bucket, reached)
    lo = np.flatnonzero(head)
    size = np.diff(np.append(lo, len(starts)))
    two = lo[size == 2]
    rest = np.lib.stride_tricks.sliding_window_view(data, length - reached) if length > reached else None
    for o in range(0, len(two), 1 << 15):
        if rest is None:
            break
        at = two[o : o + (1 << 15)]
        a, b = rest[starts[order[at]] + reached], rest[starts[order[at + 1]] + reached]
        unlike = a != b
        first = unlike.argmax(axis=1)
        row = np.arange(len(at))
        head[at + 1] = unlike[row, first]
        swap = at[a[row, first] > b[row, first]]
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
    whole = data.tobytes()
    for at, n in zip(lo[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        if rest is None:
            break
        own = order[at : at + n].copy()
        classes = blind_trie([whole[p + reached : p + length] for p in starts[own].tolist()])
        place = at
        for c in classes:
            order[place : place + len(c)] = own[c]
            head[place] = True
            place += len(c)
    return order, head


def repeated_starts(pieces: list[bytes], name: np.ndarray, ids: np.ndarray, null: np.ndarray, start: np.ndarray, length: int) -> list[list[int]]:
    """For each piece the runs [from, to, ...] of its starts whose strings also start earlier in a piece of the same name.

    ``name`` is sorted; ``ids``, ``null`` and ``start`` tell where each piece begins.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    data = np.frombuffer(b"".join(pieces) + bytes(length + 8), dtype=np.uint8)
    many = sizes - length + 1
    offset = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), many)
    before = np.cumsum(many) - many
    rel = np.arange(len(piece)) - before[piece]
    bucket = np.cumsum(np.append(False, name[1:] != name[:-1]))
    order, head = deep_shallow(data, offset[piece] + rel, bucket[piece], length)
    by_id = np.lexsort((ids, null))
    rank = np.empty(len(ids), dtype=np.int64)
    rank[by_id] = np.cumsum(np.append(False, (ids[by_id][1:] != ids[by_id][:-1]) | (null[by_id][1:] != null[by_id][:-1])))
    place = ((rank << _START_BITS) + start)[piece] + rel
    equal = np.flatnonzero(head)
    earliest = np.minimum.reduceat(place[order], equal)
    repeat = np.empty(len(piece), dtype=bool)
    repeat[order] = place[order] > np.repeat(earliest, np.diff(np.append(equal, len(piece))))
    found: list[list[int]] = [[] for _ in pieces]
    if repeat.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[False], repeat, [False]]).astype(np.int8)))
        for a, b in edge.reshape(-1, 2).tolist():  # a run may go on into the next piece
            while a < b:
                p = int(piece[a])
                to = min(b, int(before[p] + many[p]))
                found[p] += [a - int(before[p]), to - int(before[p])]
                a = to
    return found


FOUND = "doc_id long, start long, digest long, spans array<int>"


def _digest(piece: bytes) -> int:
    d = xxhash.xxh3_64_intdigest(piece)
    return d - (1 << 64) if d >> 63 else d


def _sort_pieces(length: int):
    """Pieces sorted by name, in steps that end with a name: which starts of each are repeats."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        pieces, name = t.column("piece").to_pylist(), t.column("h").to_numpy()
        ids, null, start = _places(t.column("first").chunk(0))
        spans = repeated_starts(pieces, name, ids, null, start, length)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=null), pa.array(start), pa.array(list(map(_digest, pieces)), pa.int64()), pa.array(spans, pa.list_(pa.int32())),
            ],
            names=["doc_id", "start", "digest", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            o = 0
            while o < b.num_rows:  # as many rows as SORTED_BYTES, about, hold
                take = b.slice(o, max(1, SORTED_BYTES * b.num_rows // max(1, b.nbytes)))
                o += take.num_rows
                held.append(take)
                if sum(x.nbytes for x in held) >= SORTED_BYTES:
                    last, name = held[-1], np.asarray(held[-1].column("h"))
                    cut = int(np.searchsorted(name != name[-1], True)) if name[0] == name[-1] else int(np.flatnonzero(name != name[-1])[-1]) + 1
                    if name[0] == name[-1]:
                        continue  # all of one name: its other rows may follow
                    yield solve([*held[:-1], last.slice(0, cut)])
                    held = [last.slice(cut)]
        if held:
            yield solve(held)

    return run


def _again(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, start, digest, spans) of the earliest of equal ``pieces``: which of its starts are repeats.

    ``pieces`` has (h, piece, place).
    """
    spark = pieces.sparkSession
    classes = save(pieces.groupBy("h", "piece").agg(F.min("place").alias("first")), "suffix-classes")
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST).select("h")
    hot = save(sizes, "suffix-hot")
    some = gram < length and hot.head(1)
    cold = classes.join(hot, "h", "left_anti") if some else classes
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cold.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_sort_pieces(length), FOUND)
    if not some:
        return found
    longer = gram + -(-(length - gram) // 2)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, null, start = _places(b.column("first"))
            rows: list[tuple[int, int, bytes, int]] = []
            for i, (data, whole) in enumerate(_texts(b.column("piece"))):
                rows += [(h, i, whole[a : e + length - 1], a) for h, a, e in zip(*(x.tolist() for x in runs(data, longer, length)), strict=True)]
            own = np.array([r[1] for r in rows], dtype=np.int64)
            at = start[own] + np.array([r[3] for r in rows], dtype=np.int64)
            above = [_digest(p) for p in b.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), _decimals(ids[own], null[own], at),
                    pa.array(ids[own], mask=null[own]), pa.array(at), pa.array([_digest(r[2]) for r in rows], pa.int64()),
                    pa.array(start[own]), pa.array([above[k] for k in own.tolist()], pa.int64()),
                ],
                names=["h", "piece", "place", "doc_id", "start", "digest", "from", "above"],
            )

    parts = save(
        classes.join(hot, "h").select("piece", "first").mapInArrow(cut, f"{PIECE}, doc_id long, start long, digest long, from long, above long"),
        "suffix-parts",
    )
    below = _again(parts.select("h", "piece", "place"), length, longer).select(
        F.col("doc_id").alias("b_id"), F.col("start").alias("b_start"), F.col("digest").alias("b_digest"), "spans"
    )
    same = parts["doc_id"].eqNullSafe(F.col("b_id")) & (parts["start"] == F.col("b_start")) & (parts["digest"] == F.col("b_digest"))
    own = F.coalesce("spans", F.array(F.lit(0), (F.length("piece") - length + 1)))  # an equal part comes earlier
    told = (
        parts.select("doc_id", "start", "digest", "from", "above", "piece")
        .join(below, same, "left")
        .select("doc_id", "from", "above", F.transform(own, lambda x: (x + F.col("start") - F.col("from")).cast("int")).alias("spans"))
    )
    whole = told.distinct().groupBy("doc_id", "from", "above").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return found.unionByName(whole.select("doc_id", F.col("from").alias("start"), F.col("above").alias("digest"), "spans"))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Each row of ``docs`` without repeated strings: doc_id, n_bytes, spans, kept.

    ``spans`` are the maximal runs of removed bytes, as structs of ``start`` and ``end``; ``kept`` is what remains,
    as binary, as a cut may fall within a character.

    * A byte is removed if a string of ``length`` bytes of its text over it also starts earlier: in a text of a smaller
      ``doc_id``, or earlier in the same one. Strings are those of the input, not of what is left of it.
    * Null texts count as empty, and texts shorter than ``length`` stay whole.
    * Rows that repeat an id count as one document: of equal strings at the same start neither goes before the other,
      so an equal row removes nothing from its like. Null ids come last and count as one id.
    * No rows give no rows; other columns of ``docs`` are neither read nor kept.
    """
    gram = max(1, min(gram, length))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [occurring_names(data, gram, length) for data, _ in _texts(b.column(0))]
            if all_:
                h, n = np.unique(np.concatenate(all_), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32))], names=["h", "n"])

    counted = texts.select("text").mapInArrow(count, "h long, n int")
    names = Names(counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, null = _ids(b.column(0))
            hs, pieces, own, starts = [], [], [], []
            for i, (data, whole) in enumerate(_texts(b.column(1))):
                h, first, end = runs(data, gram, length)
                may = names.of(h)
                h, first, end = h[may], first[may], end[may]
                hs.append(h)
                starts.append(first)
                own.append(np.full(len(h), i))
                pieces += [whole[a : e + length - 1] for a, e in zip(first.tolist(), end.tolist(), strict=True)]
            if pieces:
                at = np.concatenate(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hs)), pa.array(pieces, pa.binary()), _decimals(ids[at], null[at], np.concatenate(starts))],
                    names=["h", "piece", "place"],
                )

    found = _again(texts.mapInArrow(cut, PIECE), length, gram)
    by_doc = found.groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_list(F.struct("start", "digest", "spans")).alias("found"))
    told = texts.join(by_doc, F.col("doc_id").eqNullSafe(F.col("found_id")), "left").select("doc_id", "text", "found")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(2)
            sizes, spans, kept = [], [], []
            for i, (data, whole) in enumerate(_texts(b.column(1))):
                earliest = {(x["start"], x["digest"]): x["spans"] for x in known[i].as_py() or ()}
                gone: list[tuple[int, int]] = []
                h, first, end = runs(data, gram, length)
                may = names.of(h)
                for a, e in zip(first[may].tolist(), end[may].tolist(), strict=True):
                    own = earliest.get((a, _digest(whole[a : e + length - 1])))
                    if own is None:
                        gone.append((a, e + length - 1))
                    else:
                        gone += [(a + x, a + y + length - 1) for x, y in zip(own[::2], own[1::2], strict=True)]
                gone = _merged(gone)
                sizes.append(len(whole))
                spans.append([{"start": x, "end": y} for x, y in gone])
                edges = [0, *(x for s in gone for x in s), len(whole)]
                kept.append(b"".join(whole[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(sizes, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return told.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
