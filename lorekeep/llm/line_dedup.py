"""Line deduplication by an exact set-similarity join.

A line is the set of its words. The words of all lines are counted in a table of
fixed size; a line's words are ordered by rarity, and only its first few, its
prefix, are looked up: two sets of Jaccard similarity t or more share a word of their
prefixes, and of the smaller set a shorter prefix is enough, which is indexed. Length
and position filters, and parities of the words, drop pairs that can't reach t; the
rest are verified on the words.

Lines with equal sets are one class. A class needs no more than one earlier class that
matches, so each first meets the earliest of those that share its least word under two
hash functions, or in a large group the likest of some that are unlike each other. This
settles most of a large group of near copies, and what is settled needs no other earlier
class. All other pairs meet. Postings are dealt by word, packed as arrays, and each task
joins those of its words. A word whose classes would make many pairs each asks for a second
shared word of a prefix longer by one, which the same bound proves, and under a pair with
many classes again they are dealt into blocks, so that no task holds all of its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import MayHold, join_decisions, save, text_steps
from lorekeep.llm.packed import BUCKET_RECORDS, MIX, binary, cut, dealt, met, mixed

SIMILARITY = 0.8
#: Counters of the rarity table.
COUNTERS = 1 << 20
#: Pairs that a posting of a word makes on average beyond which a second word must be shared, and classes under a pair of words beyond which they are dealt into blocks.
HOT_WORD = 200
#: Lines that are packed at once, and pairs that are looked at at once.
STEP_LINES, STEP_PAIRS = 1 << 18, 1 << 18
#: Records under one least word beyond which others than the earliest lead too, how many may, and how many in a row that none is like.
LARGE_GROUP, LEADERS, IDLE_LEADERS = 16, 64, 4

_LINES = (
    "id long, doc_id long, line int, by struct<doc_id:bigint,line:int>, head boolean, k1 long, "
    "size int, s1 long, s2 long, least long, skipped int, prefix array<int>"
)
#: The first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
_LONG_WORD = 512

_PLACE = [("none", "?"), ("doc", "<i8"), ("line", "<i4")]
_RECORD = [*_PLACE, ("id", "<i8"), ("s1", "<u8"), ("s2", "<u8")]
_POSTING = np.dtype([("word", "<u4"), ("size", "<u4"), ("at", "<u4"), ("done", "?"), *_RECORD])
_LINE = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("least", "<i8"), ("size", "<i4"), ("skipped", "<i4"), ("sent", "<i4"), *_RECORD])
_COPY = np.dtype([*_PLACE, ("by", _PLACE)])
_LEAST = np.dtype([("least", "<u8"), ("size", "<u4"), *_RECORD])


def line_words(line: str) -> set[str]:
    """The words of a line: runs of other than ASCII white space, A-Z lower-cased."""
    return set(pc.ascii_split_whitespace(pc.ascii_lower(pa.scalar(line))).as_py()) - {""}


def least_overlap(a: int, b: int, t: float = SIMILARITY) -> int:
    """Words that sets of these sizes share at least, if their similarity is t."""
    return math.ceil(t / (1 + t) * (a + b) - 1e-9)


def _smallest(t: float) -> int:
    """The size of the smallest set that can reach the similarity with another set: n / (n + 1) >= t."""
    return math.ceil(t / (1 - t) - 1e-9) if t < 1 else 1 << 31


class _Lines:
    """The lines with words of some texts.

    ``text`` and ``number`` tell each line's text and its number in it, ``line`` and
    ``word`` each word's line and its 64-bit digest; repeats of a word in a line are still there.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.fill_null("")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer()
        raw = np.frombuffer(whole, dtype=np.uint8) if whole.size else np.zeros(0, dtype=np.uint8)
        starts_of_lines = np.append(0, np.flatnonzero(raw == 10) + 1)
        inside = np.zeros(len(raw) + 2, dtype=bool)
        inside[1:-1] = (raw != 32) & (raw - np.uint8(9) > 4)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        n = np.diff(np.append(np.searchsorted(start, starts_of_lines), len(start)))
        length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        starts_of_texts = np.cumsum(length) - length
        text = np.searchsorted(starts_of_texts, starts_of_lines, "right") - 1
        number = np.arange(len(text)) - np.searchsorted(starts_of_lines, starts_of_texts)[text]
        there = n > 0
        self.text, self.number = text[there], number[there]
        self.line = np.repeat(np.arange(len(self.text)), n[there])
        self.word = self._digests(raw + np.uint8(32) * (raw - np.uint8(65) < 26), start, end)

    @staticmethod
    def _digests(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Digests of the words at these places, eight bytes at a time."""
        padded = np.append(raw, np.zeros(8, dtype=np.uint8))
        eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        left = end - start
        h = mixed(eights[start] & _FIRST[np.minimum(left, 8)] ^ left.astype(np.uint64) * MIX[2], 1)
        long = np.flatnonzero(left > _LONG_WORD)
        more = np.flatnonzero((left > 8) & (left <= _LONG_WORD))
        at = 8
        while len(more):
            h[more] = mixed(h[more] ^ eights[start[more] + at] & _FIRST[np.minimum(left[more] - at, 8)], 1)
            at += 8
            more = more[left[more] > at]
        for w in long:
            h[w] = xxhash.xxh64_intdigest(padded[start[w] : end[w]].tobytes())
        return h

    def sets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, first 48 bits of the word's digest, size of each line): distinct words by line."""
        found, low = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))], np.uint64((1 << 48) - 1)
        for first in range(0, len(self.text), 1 << 16):
            part = slice(*np.searchsorted(self.line, (first, first + (1 << 16))))
            both = np.sort((self.line[part] - first).astype(np.uint64) << np.uint64(48) | self.word[part] >> np.uint64(16))
            both = both[np.append(True, both[1:] != both[:-1])]
            found.append((first + (both >> np.uint64(48)).astype(np.int64), both & low))
        line, word = (np.concatenate(x) for x in zip(*found))
        return line, word, np.bincount(line, minlength=len(self.text))


def _counter(word: np.ndarray) -> np.ndarray:
    """The counters of words, by the first 48 bits of their digests."""
    return (word & np.uint64(COUNTERS - 1)).astype(np.int64)


def _names(word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the names of sets: sums over their words."""
    return tuple(np.add.reduceat(mixed(word, k), starts).view(np.int64) for k in (2, 3))


def _rank(n):
    """The order of a word that occurs ``n`` times."""
    return np.minimum(np.log2(n + 1.0) * 1024, 2**16 - 1).astype(np.uint16)


def rarity_table(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How often words of each counter occur in all ``texts`` (text), and the number of lines with words; each task
    sends its table in pieces."""
    width = COUNTERS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS + width, dtype=np.uint64)
        for b in text_steps(batches):
            lines = _Lines(b.column(0))
            total[:COUNTERS] += np.bincount(_counter(lines.word >> np.uint64(16)), minlength=COUNTERS).astype(np.uint64)
            total[COUNTERS] += np.uint64(len(lines.text))
        kind = "<u4" if int(total.max()) < 1 << 32 else "<u8"
        for k, piece in enumerate(total.reshape(-1, width)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([piece.astype(kind).tobytes()], pa.binary())], names=["piece", "n"])

    def add(batch: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.uint64)
        for x in batch["n"].to_pylist():
            total += np.frombuffer(x, dtype=f"<u{len(x) // width}")
        return pa.table({"piece": batch["piece"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    summed = texts.mapInArrow(run, "piece int, n binary").groupBy("piece").applyInArrow(add, "piece int, n binary").collect()
    out = np.zeros((65, width), dtype=np.uint64)
    for r in summed:
        out[r["piece"]] = np.frombuffer(r["n"], dtype=np.uint64)
    return out[:64].ravel(), int(out[64, 0])


def _featured(rarity: np.ndarray, similarity: float) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """The records of the lines with words of a batch, and their prefixes' words. ``k1`` and ``k2`` name a line's set,
    ``s1`` and ``s2`` are parities of it: each word turns one of 128 bits. A prefix holds ``sent`` word codes in the
    order of rarity, one more than the prefix filter needs, but for the first ``skipped``, which occur once in the corpus."""
    rank = _rank(rarity)  # 2 MB go to each task
    once = int(_rank(1))
    smallest = _smallest(similarity)

    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lines = _Lines(b.column(1))
        if not len(lines.line):
            return np.zeros(0, dtype=_LINE), np.zeros(0, dtype=np.uint32)
        line, word, size = lines.sets()
        starts = np.cumsum(size) - size
        out = np.zeros(len(size), dtype=_LINE)
        out["none"], out["doc"] = _ids(b.column(0).take(pa.array(lines.text)))
        out["line"], out["size"] = lines.number, size
        out["k1"], out["k2"] = _names(word, starts)
        spread = mixed(word, 1)
        bit = np.uint64(1) << (spread & np.uint64(63))
        second = (spread & np.uint64(64)) > 0
        for k, name in enumerate(("s1", "s2")):
            out[name] = np.bitwise_xor.reduceat(np.where(second == bool(k), bit, np.uint64(0)), starts)
        least = [np.minimum.reduceat(spread * m >> np.uint64(32), starts) for m in MIX[2:]]
        out["least"] = (least[0] << np.uint64(32) | least[1]).view(np.int64)
        # ties in rarity go by code, alike everywhere
        rarest = rank[_counter(word)].astype(np.uint64) << np.uint64(32) | word >> np.uint64(16)
        sent = np.where(size >= smallest, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 2, 0)
        ordered = np.concatenate([np.sort(line[part].astype(np.uint64) % np.uint64(1 << 16) << np.uint64(48) | rarest[part]) for part in _parts(line)])
        place = np.arange(len(line)) - starts[line]
        skipped = np.bincount(line[(place < sent[line] - 1) & ((ordered >> np.uint64(32) & np.uint64(0xFFFF)) <= once)], minlength=len(size))
        in_prefix = (place < sent[line]) & (place >= skipped[line])
        out["skipped"], out["sent"] = skipped, np.bincount(line[in_prefix], minlength=len(size))
        return out, ordered[in_prefix].astype(np.uint32)

    return run


def _ids(doc_id: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy(zero_copy_only=False)


def _classed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the records by set and place, where a set is new, whether a place is another than the first of its set)."""
    order = np.lexsort((r["line"], r["doc"], ~r["none"], r["k2"], r["k1"]))
    k1, k2 = r["k1"][order], r["k2"][order]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[: len(r)]
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
    copy = np.zeros(len(r), dtype=bool)
    for name, _ in _PLACE:
        copy |= r[name][order] != r[name][first]
    return order, new, copy


def _copies(r: np.ndarray, order: np.ndarray, new: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """The copies among records, with the first place of their set."""
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))]
    out = np.zeros(int(copy.sum()), dtype=_COPY)
    for name, _ in _PLACE:
        out[name], out["by"][name] = r[name][order[copy]], r[name][first[copy]]
    return out


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _lines(docs: DataFrame, rarity: np.ndarray, n_lines: int, similarity: float) -> DataFrame:
    """Each line with words: where it is, and the first line with an equal set (``by``) if that is another place.
    One line of each set, the first, is its class's ``head`` and has its features; ``id`` names the class.

    Lines that a task finds to be copies don't meet the others again.
    """
    featured = _featured(rarity, similarity)
    buckets = 1 + n_lines // BUCKET_RECORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in text_steps(batches):
            held.append(featured(b))
            n += len(held[-1][0])
            if n >= STEP_LINES:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        r, codes = (np.concatenate(x) for x in zip(*held))
        order, new, copy = _classed(r)
        copies, own = _copies(r, order, new, copy), np.sort(order[~copy])
        starts = np.cumsum(r["sent"], dtype=np.int64) - r["sent"]
        own, records = cut(r, own, r["k1"][own], buckets)
        n = r["sent"][own].astype(np.int64)
        ends = np.append(0, np.cumsum(n))[np.frombuffer(records.buffers()[1], dtype=np.int32)[: buckets + 1] // _LINE.itemsize]
        words = binary(codes[_ranges(starts[own], n)], ends)
        _, copied = cut(copies, np.arange(len(copies)), copies["doc"] * 61 + copies["line"], buckets)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), records, words, copied], names=["bucket", "records", "words", "copies"])

    def meet(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        r, codes, copies = (np.frombuffer(b"".join(found[k].to_pylist()), dtype=kind) for k, kind in (("records", _LINE), ("words", "<u4"), ("copies", _COPY)))
        order, new, copy = _classed(r)
        starts = np.cumsum(r["sent"], dtype=np.int64) - r["sent"]
        ids = (key[0].as_py() << 40) + np.cumsum(new) - 1
        heads, twins = order[new], order[~new & ~copy]
        n = r["sent"][heads].astype(np.int64)
        prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(codes[_ranges(starts[heads], n)].view(np.int32)))
        told = {k: pa.array(r[k][heads].astype(_LINE[k].str.replace("u", "i"))) for k in ("k1", "size", "s1", "s2", "least", "skipped")}
        rows = [
            pa.table({"id": ids[new], **_placed(r[heads]), "head": np.ones(len(heads), dtype=bool), **told, "prefix": prefix}),
            pa.table({"id": ids[~new & ~copy], **_placed(r[twins])}),
        ]
        for x in (copies, _copies(r, order, new, copy)):
            by = _placed(x["by"])
            rows.append(pa.table({**_placed(x), "by": pa.StructArray.from_arrays([by["doc_id"], by["line"]], names=["doc_id", "line"])}))
        rows = pa.concat_tables(rows, promote_options="default")
        return rows.select([f.split()[0] for f in _LINES.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "bucket int, records binary, words binary, copies binary")
    return rows.groupBy("bucket").applyInArrow(meet, _LINES)


def _placed(r: np.ndarray) -> dict[str, pa.Array]:
    return {"doc_id": pa.array(r["doc"], mask=r["none"]), "line": pa.array(r["line"])}


def _parts(line: np.ndarray) -> list[slice]:
    """Where each 65536 lines begin and end, of ascending line numbers."""
    cuts = np.searchsorted(line, np.arange(0, int(line[-1]) + (1 << 16) + 1, 1 << 16))
    return [slice(*x) for x in zip(cuts[:-1], cuts[1:])]


def _least_overlaps(size: np.ndarray, similarity: float) -> np.ndarray:
    """``least_overlap`` of two sets by the sum of their sizes, up to twice the largest of ``size``."""
    sums = np.arange(2 * int(size.max(initial=0)) + 1)
    return np.ceil(similarity / (1 + similarity) * sums - 1e-9).astype(np.int64)


def _differ(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the parities of records differ: no more than the words that only one of both sets has."""
    return np.bitwise_count(r["s1"][x] ^ r["s1"][y]) + np.bitwise_count(r["s2"][x] ^ r["s2"][y])


def _later(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the place of x comes after that of y; null ids come first."""
    a, b = ~r["none"][x], ~r["none"][y]
    doc, other = r["doc"][x], r["doc"][y]
    return (a & ~b) | ((a == b) & ((doc > other) | ((doc == other) & (r["line"][x] > r["line"][y]))))


def _under_heads(similarity: float) -> Callable[[np.ndarray], pa.Table]:
    """Pairs of records, later one first, with the earliest record that has their least word. In large groups other
    records lead too, each unlike the leaders before it, and one meets the likest of those before it."""

    def meet(found: np.ndarray) -> pa.Table:
        order = np.lexsort((found["id"], found["line"], found["doc"], ~found["none"], found["least"]))
        r = {k: found[k][order] for k in _LEAST.names}
        need = _least_overlaps(r["size"], similarity)
        size = r["size"].astype(np.int64)

        def room(x, y):  # how far parities are from proving x and y unlike
            sums = size[x] + size[y]
            return np.where(np.minimum(size[x], size[y]) >= need[sums], sums - 2 * need[sums] - _differ(r, x, y), -1)

        starts = np.flatnonzero(np.append(True, r["least"][1:] != r["least"][:-1]))
        ends = np.append(starts[1:], len(order))
        head = np.repeat(starts, ends - starts)
        x = np.arange(len(order))
        best = room(x, head)
        large = ends - starts > LARGE_GROUP
        for a, b in zip(starts[large], ends[large]):
            leads, idle = np.arange(a, b) == a, 0
            for _ in range(LEADERS):
                unlike = np.flatnonzero(~leads & (best[a:b] < size[a:b] // 9))  # half of the room that equal sets have, at 0.8
                if not len(unlike) or idle == IDLE_LEADERS:
                    break
                leads[unlike[0]], leader = True, a + unlike[0]
                after = np.arange(leader + 1, b)
                near = room(after, np.full(len(after), leader))
                after, near = after[near > best[after]], near[near > best[after]]
                best[after], head[after] = near, leader
                idle = 0 if (near >= 0).any() else idle + 1
        x = np.flatnonzero((best >= 0) & (head != x))
        return pa.table({"x": r["id"][x], "y": r["id"][head[x]]})

    return meet


def _under_words(similarity: float, hot_word: int) -> Callable[[np.ndarray], pa.Table]:
    """Pairs of postings of one word, the later one first; of words that make too many pairs, the postings (x, word).

    A later one that is done needs no more pairs.
    """

    def meet(found: np.ndarray) -> pa.Table:
        # words and sizes in one number, ascending; where they are equal, ids decide
        key = found["word"].astype(np.uint64) << np.uint64(32) | found["size"]
        order = np.argsort(key, kind="stable")
        r = {k: found[k][order] for k in _POSTING.names}
        key, size, at, done = key[order], r["size"].astype(np.int64), r["at"].astype(np.int64), r["done"]
        word = key & ~np.uint64(0xFFFFFFFF)
        need = _least_overlaps(r["size"], similarity)
        room = np.arange(len(need)) - 2 * need
        short = size - np.ceil(2 * similarity / (1 + similarity) * size - 1e-9).astype(np.int64) + 1
        least = word | np.minimum(np.ceil(similarity * size - 1e-9), size).astype(np.uint64)
        group = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
        runs = []
        for y_done in (False, True):
            y = np.flatnonzero((at < short) & (done == y_done))
            x = np.flatnonzero(~done) if y_done else np.arange(len(key))
            lo = np.searchsorted(key[y], least[x])
            runs.append((x, y, lo, np.searchsorted(key[y], key[x], "right") - lo))
        made = sum(np.bincount(group[x], weights=n, minlength=group[-1] + 1) for x, _, _, n in runs)
        hot = (made > hot_word * np.bincount(group))[group]
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for x, y, lo, n in runs:
            n = np.where(hot[x], 0, n)
            ends = np.cumsum(n)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, n.sum(), STEP_PAIRS), "right"), len(n)))
            for a, b in zip(cuts[:-1], cuts[1:]):
                left = np.repeat(np.arange(a, b), n[a:b])
                i, j = x[left], y[lo[left] + np.arange(len(left)) - np.repeat(ends[a:b] - n[a:b] - (ends[a] - n[a]), n[a:b])]
                near = np.flatnonzero(_differ(r, i, j) <= room[size[i] + size[j]])
                i, j = i[near], j[near]
                overlap = need[size[i] + size[j]] - np.minimum(at[i], at[j])
                fits = (np.minimum(size[i] - at[i], size[j] - at[j]) >= overlap) & ((size[i] > size[j]) | (r["id"][i] > r["id"][j]))
                i, j = i[fits], j[fits]
                for i, j in ((i, j), (j, i)):
                    wanted = _later(r, i, j) & ~done[i]
                    pairs.append(np.column_stack([r["id"][i[wanted]], r["id"][j[wanted]]]))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        many = np.flatnonzero(hot)
        return pa.table({
            "x": pa.array(np.append(pairs[:, 0], r["id"][many])), "y": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(many), pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(len(pairs), pa.int32()), pa.array(r["word"][many].view(np.int32))]),
            "done": pa.concat_arrays([pa.nulls(len(pairs), pa.bool_()), pa.array(done[many])]),
        })

    return meet


def _near(similarity: float) -> Column:
    """Whether the sizes and parities of x and y let them reach the similarity."""
    sizes = F.col("x.size") + F.col("y.size")
    need = F.ceil(F.lit(similarity / (1 + similarity)) * sizes - 1e-9)
    differ = sum(F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in ("s1", "s2"))
    return (F.least("x.size", "y.size") >= need) & (differ <= sizes - 2 * need)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Of candidate pairs (x, y) of class ids, (x, match) of those whose word sets reach the similarity: the
    later one, and the first line of the earlier.

    The lines are read from the texts again and compared word by word; tables of bits, of fixed size, let
    tasks pass over most texts and lines that no pair asks for.
    """
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    asked = save(classes.select("id", "k1", "first.doc_id", "first.line").join(ids, "id"), "line-asked")
    may = MayHold(asked, "doc_id")
    lines_too = MayHold(asked.select((F.coalesce("doc_id", F.lit(-1)) * 61 + F.col("line")).alias("slot")), "slot")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            held = may.of(ids)
            b, ids = b.filter(pa.array(held)), ids[held]
            split = pc.split_pattern(b.column(1).fill_null(""), "\n")
            counts = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            text = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
            wanted = np.flatnonzero(lines_too.of(ids[text] * 61 + number))
            if not len(wanted):
                continue
            flat = split.flatten().take(pa.array(wanted))
            lines = _Lines(flat)
            if not len(lines.line):
                continue
            _, word, size = lines.sets()
            key = _names(word, np.cumsum(size) - size)[0]
            at, row = wanted[lines.text], pa.array(lines.text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(text[at])), pa.array(number[at].astype(np.int32)), pa.array(key), flat.take(row).cast(pa.string())],
                names=["d", "n", "key", "words"],
            )

    lines = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, "d long, n int, key long, words string")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("n") == F.col("line")) & (F.col("key") == F.col("k1"))
    words = save(lines.join(asked, same).select("id", F.struct("doc_id", "line").alias("first"), "words"), "line-words")
    x = words.select(F.col("id").alias("x"), F.col("first").alias("xf"), F.col("words").alias("xw"))
    y = words.select(F.col("id").alias("y"), F.col("first").alias("yf"), F.col("words").alias("yw"))
    both = pairs.join(x, "x").join(y, "y").where(F.col("xf") != F.col("yf")).select("x", "y", "xf", "yf", "xw", "yw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            n = b.num_rows
            both = _Lines(pa.concat_arrays([b.column(4), b.column(5)]))
            # distinct words of each line, then of both lines of a pair
            order = np.lexsort((both.word, both.line))
            line, word = both.line[order], both.word[order]
            new = np.append(True, (line[1:] != line[:-1]) | (word[1:] != word[:-1]))
            row, word = both.text[line[new]] % n, word[new]
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            shared = np.bincount(row[1:][(row[1:] == row[:-1]) & (word[1:] == word[:-1])], minlength=n)
            sizes = np.bincount(row, minlength=n)
            yield b.select([0, 1, 2, 3]).filter(pa.array(shared >= np.ceil(similarity / (1 + similarity) * sizes - 1e-9)))

    place = "struct<doc_id:bigint,line:int>"
    found = both.mapInArrow(compare, f"x long, y long, xf {place}, yf {place}")
    later = F.col("xf") > F.col("yf")
    return found.select(F.when(later, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(later, F.col("yf")).otherwise(F.col("xf")).alias("match"))


def _meet(left: DataFrame, right: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    for k in reversed(keys):
        condition = (F.col(f"x.{k}") == F.col(f"y.{k}")) & condition
    return left.alias("x").join(right.alias("y"), condition).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))


def _settle(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, label: str) -> DataFrame:
    """(x, match): the earliest verified match of each class that has one among the candidate pairs."""
    found = _verified(save(pairs.distinct(), f"{label}-pairs"), classes, docs, similarity)
    return save(found.groupBy("x").agg(F.min("match").alias("match")), label)


def line_matches(docs: DataFrame, similarity: float = SIMILARITY, hot_word: int = HOT_WORD) -> DataFrame:
    """(doc_id, line, removed, match) for every line with words.

    A line is removed if an earlier line, by (doc_id, line), has a similar set of
    words; the match is one such line.
    """
    rarity, n_lines = rarity_table(docs.select(F.col("text").cast("string")))
    lines = save(_lines(docs, rarity, n_lines, similarity), "lines")
    classes = lines.where("head").withColumn("first", F.struct("doc_id", "line"))
    indexed = classes.where(F.size("prefix") > 0)
    counts = indexed.agg(F.count(F.lit(1)), F.sum(F.size("prefix"))).first()

    record = ("size", "first.line", "id", "s1", "s2", "first.doc_id")

    def put(out: np.ndarray, b: pa.RecordBatch, row=slice(None)) -> np.ndarray:
        for k, name in enumerate(("size", "line", "id", "s1", "s2")):
            out[name] = b.column(k).to_numpy().astype(out.dtype[name])[row]
        out["none"], out["doc"] = (x[row] for x in _ids(b.column(5)))
        return out

    def leasts(b: pa.RecordBatch) -> np.ndarray:
        out = put(np.zeros((2, b.num_rows), dtype=_LEAST), b)
        least = b.column(6).to_numpy().view(np.uint64)
        for f, x in enumerate((least >> np.uint64(32), least & np.uint64(0xFFFFFFFF))):
            out["least"][f] = x | np.uint64(f << 32)
        return out.ravel()

    to_heads = dealt(indexed.select(*record, "least"), leasts, "least", 1 + 2 * counts[0] // BUCKET_RECORDS)
    to_heads = met(to_heads, _LEAST, _under_heads(similarity), "x long, y long")
    settled = _settle(to_heads, classes, docs, similarity, "line-settled")

    def postings(b: pa.RecordBatch) -> np.ndarray:
        skipped = b.column(6).to_numpy().astype(np.int64)
        sent = b.column(7).value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), sent)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sent) - sent, sent)
        own = place < sent[row] - 1  # the last word sent belongs to the longer prefix only
        row, place = row[own], place[own]
        out = put(np.zeros(len(row), dtype=_POSTING), b, row)
        out["word"] = b.column(7).flatten().to_numpy().view(np.uint32)[own]
        out["at"] = place + skipped[row]
        out["done"] = b.column(8).to_numpy(zero_copy_only=False)[row]
        return out

    done = settled.select(F.col("x").alias("id"), F.lit(True).alias("done"))
    flagged = indexed.select("id", "size", "s1", "s2", "first", "skipped", "prefix").join(done, "id", "left").select(*record, "skipped", "prefix", F.coalesce("done", F.lit(False)))
    postings_met = dealt(flagged, postings, "word", 1 + (counts[1] or 0) // BUCKET_RECORDS)
    postings_met = save(met(postings_met, _POSTING, _under_words(similarity, hot_word), "x long, y long, word int, done boolean"), "line-met")
    cold = postings_met.where("word IS NULL").select("x", "y")

    hot_classes = postings_met.where("word IS NOT NULL").groupBy(F.col("x").alias("id")).agg(F.collect_set("word").alias("hot"), F.max("done").alias("done"))  # words of one prefix
    two = indexed.select("id", "first", "size", "s1", "s2", "prefix").join(hot_classes, "id").withColumn("word", F.explode("hot"))
    two = two.select("id", "first", "size", "s1", "s2", "done", "word", F.explode("prefix").alias("other")).where("word <> other")
    shared = two.groupBy("word", "other").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    two = save(two.join(shared, ["word", "other"]).withColumn("blocks", F.ceil(F.col("m") / hot_word).cast("int")), "line-twos")
    asking = two.where("not done").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    asked = two.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    warm = _meet(asking, asked, ["word", "other", "block"], (F.col("x.first") > F.col("y.first")) & _near(similarity))
    every = cold.unionByName(warm)
    late = _settle(every, classes, docs, similarity, "line-late")

    matched = settled.unionByName(late).groupBy("x").agg(F.min("match").alias("match")).withColumnRenamed("x", "id")
    # copies need no match; lines at the place of their class's first share its match
    heads = lines.where("by IS NULL").select("id", "doc_id", "line").join(matched, "id", "left")
    return heads.select("doc_id", "line", F.col("match").isNotNull().alias("removed"), "match").unionByName(
        lines.where("by IS NOT NULL").select("doc_id", "line", F.lit(True).alias("removed"), F.col("by").alias("match"))
    )


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, hot_word: int = HOT_WORD) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, n_removed, removed_lines, match_doc_ids.

    * Lines are split at line feeds and numbered from 0; A-Z are lower-cased and words
      split at ASCII white space. Lines without words are kept and never match.
    * ``removed_lines`` are the line numbers to go, ascending; ``match_doc_ids``
      the documents of the earlier lines they match, in the same order.
    * Null and empty texts have no lines to remove. Rows that repeat an id are one
      document; its equal lines have one place each. Null ids come before all; their
      lines are counted, but, as any number of rows may have none, not listed.
    * Extra columns are not read. No rows give no rows.
    """
    matches = line_matches(docs, similarity, hot_word)
    listed = F.col("removed") & F.col("doc_id").isNotNull()
    gone = F.array_sort(F.collect_list(F.when(listed, F.struct("line", F.col("match.doc_id").alias("by")))))
    per_doc = matches.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("removed").cast("long")).alias("n_removed"), gone.alias("gone")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return join_decisions(ids, per_doc, "left").select(
        "doc_id",
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.transform("gone", lambda g: g["line"]), F.array().cast("array<int>")).alias("removed_lines"),
        F.coalesce(F.transform("gone", lambda g: g["by"]), F.array().cast("array<long>")).alias("match_doc_ids"),
    )
