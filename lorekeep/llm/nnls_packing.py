"""Packing documents into fixed windows by non-negative least squares.

Every document is cut into full windows and one rest. The lengths of the rests
make a histogram of at most a window's size. All ways of filling a window with
up to three lengths are enumerated, and non-negative least squares finds how
often to repeat each so that the histogram is used up. The counts are rounded;
what they leave over is packed greedily, cut where a window ends. Which window a
piece goes to follows from its length and its number among the pieces of that
length, so that the corpus itself is only counted and read again.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lorekeep.llm.common import save, text_steps

WINDOW = 1024
END_ID = 0

PIECES = "part int, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ordinal long, rest binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words whose ids a worker keeps: some 200 MB.
KEPT_WORDS = 1 << 20
#: Byte-level vocabularies write each byte as one character: printable ones as they are, the others, in order, from U+0100 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTES = np.arange(256, dtype="<u4")
_BYTES[np.setdiff1d(np.arange(256), _PRINTED)] = 256 + np.arange(256 - len(_PRINTED))
#: Characters that all versions of Unicode since 12 class alike; the libraries that split words differ in others.
_SETTLED = regex.compile(r"[\x00-\u0530\u0900-\u0c50\u0d00-\u2080\u20a0-\ua7c0\uac00-\uffff\U0001f000-\U0001f9ff]*")


#: Kinds of characters to the pattern that splits words.
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)


class Encoder:
    """Texts' ids by a tokenizer file of byte-level BPE, those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Such a tokenizer cuts a text into words first and merges within words only, so the words of many
    texts are cut at once, and each distinct one is merged once by the tokenizer's own model and its ids
    are kept. Texts that hold an added token's string, or characters that Unicode versions class
    differently, and all texts of other kinds of tokenizers, go through ``encode`` whole.
    """

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        rules = json.loads(self.whole.to_str())
        split = rules["pre_tokenizer"] or {}
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.by_word = (
            rules["model"]["type"] == "BPE" and not rules["normalizer"] and not rules["truncation"] and not rules["padding"]
            and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        )
        self.merge = self.whole.model.tokenize
        self.known: dict[bytes, bytes] = {}
        every = "".join(map(chr, range(0x110000)))
        self.kinds = np.full(len(every), _OTHER, dtype=np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(pattern, every):
                self.kinds[m.start() : m.end()] = kind

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; new words are merged by the model, which reads a character for each byte."""
        new = [w for w in words if w not in self.known]
        text, at, sizes, flat = _BYTES[np.frombuffer(b"".join(new), dtype=np.uint8)].tobytes().decode("utf-32-le"), 0, [], []
        for w in new:
            found = [t.id for t in self.merge(text[at : at + len(w)])]
            at += len(w)
            sizes.append(len(found))
            flat += found
        packed, at = np.array(flat, dtype="<u4").tobytes(), 0
        for w, n in zip(new, sizes):
            self.known[w] = packed[at : at + 4 * n]
            at += 4 * n
        return list(map(self.known.__getitem__, words))

    def word_starts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the words of ``public_tokenizers.PATTERN`` begin, by the characters' codes and the places of the texts' first ones."""
        kind, n = self.kinds[codes], len(codes)
        head = np.zeros(n + 3, dtype=bool)  # and what lies behind the last text
        head[first] = head[n:] = True
        blank = kind == _BLANK
        begins = head[:n].copy()
        # a word takes one space before it; of more white space all but the last character is one word
        begins[1:] |= (kind[1:] != kind[:-1]) & (codes[:-1] != 32)
        begins[1:] |= blank[1:] & ~blank[:-1]
        begins[:-1] |= blank[:-1] & ~blank[1:] & ~head[1:n]
        at = np.flatnonzero(begins & (codes == 39))
        if len(at):  # 's 't 'm 'd 're 've 'll
            after = np.append(codes, [0, 0])
            a, b = np.where(head[at + 1], 0, after[at + 1]), np.where(head[at + 1] | head[at + 2], 0, after[at + 2])
            short = np.isin(a, [ord(c) for c in "stmd"])
            long_ = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            begins[at[short | long_] + 1] = False
            ends = np.concatenate([at[short] + 2, at[long_] + 3])
            begins[ends[ends < n]] = True
        return np.flatnonzero(begins)

    def _joined(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, none of them empty, all ASCII or none."""
        text = "".join(texts)
        data = text.encode()
        first = np.cumsum([0, *map(len, texts)])
        if len(data) == len(text):
            starts = words = self.word_starts(np.frombuffer(data, dtype=np.uint8), first[:-1])
        else:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            starts = self.word_starts(codes, first[:-1])
            width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            words = (np.cumsum(width) - width)[starts]
        places = pa.py_buffer(np.append(words, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(words), [None, places, pa.py_buffer(data)]).dictionary_encode()
        ends = np.cumsum(pc.binary_length(coded.dictionary).to_numpy()).tolist()
        distinct = coded.dictionary.buffers()[2].to_pybytes()
        found = self._words([distinct[a:b] for a, b in zip([0, *ends], ends)])
        flat, size = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        word = coded.indices.to_numpy()
        count = size[word]
        before = np.cumsum(count) - count
        ids = flat[np.repeat((np.cumsum(size) - size)[word] - before, count) + np.arange(int(count.sum()))]
        return np.split(ids, before[np.searchsorted(starts, first[1:-1])])

    def many(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        out: list = [None] * len(texts)
        ascii_, wide = [], []
        for k, text in enumerate(texts):
            if not text:
                out[k] = np.zeros(0, dtype="<u4")
            elif not self.by_word or any(t in text for t in self.added) or not (text.isascii() or _SETTLED.fullmatch(text)):
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
            else:
                (ascii_ if text.isascii() else wide).append(k)
        for group in (ascii_, wide):
            if group:
                for k, ids in zip(group, self._joined([texts[k] for k in group])):
                    out[k] = ids
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, as texts of several have many words in common."""
    return Encoder(path)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(docs: DataFrame, encoder_path: str, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Each document as full windows and a rest, with the ids of the rest and the piece's
    number among those of its length in the task that cut it (``part``, ``ordinal``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(encoder_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in text_steps(batches):
            rows: list[list] = [[] for _ in range(8)]
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.many(texts)):
                ids = np.append(ids, np.uint32(END_ID))
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rest = None if len(piece) == window else piece.astype("<u2" if piece.max() < 1 << 16 else "<u4")
                    row = (part, doc_id, start, len(piece), _crc(piece), len(ids), seen[len(piece)], rest)
                    seen[len(piece)] += 1
                    for column, value in zip(rows, row):
                        column.append(value if not isinstance(value, np.ndarray) else value.tobytes())
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, types)],
                names=["part", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ordinal", "rest"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)


def fillings(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All ways of filling the window with one to three of ``lengths``, as rows padded with 0."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    rows = [(window, 0, 0)] if there[window] else []
    for a in lengths[lengths * 2 <= window]:
        if there[window - a]:
            rows.append((a, window - a, 0))
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[there[window - a - b]]
        rows.extend((a, x, window - a - x) for x in b)
    return np.array(rows, dtype=np.int64).reshape(-1, 3)


def solve_repeats(fill: np.ndarray, histogram: np.ndarray, block: int = 96, tolerance: float = 0.5) -> np.ndarray:
    """How often to repeat each filling: argmin ``|A x - histogram|`` for x >= 0, by active sets.

    Fillings of the steepest descent are let in, up to ``block`` at once that share no
    length; least squares on the fillings in use follow, and those that it makes negative
    leave. Where that doesn't lower the error, the steepest alone is let in, and x goes towards
    its least squares only until the first count is zero, which leaves; such steps always
    lower it. It ends where no filling outside descends by over ``tolerance`` pieces, the
    optimality condition. A minimum has no more non-zero counts than there are lengths, so
    that rounding it loses little.
    """
    n, x = len(histogram), np.zeros(len(fill))
    target = histogram.astype(float)
    target[0] = 0.0

    def fitted(columns: np.ndarray) -> np.ndarray:
        a = np.zeros((n, len(columns)))
        for k in range(3):
            np.add.at(a, (fill[columns, k], np.arange(len(columns))), fill[columns, k] > 0)
        return np.linalg.solve(a.T @ a + 1e-7 * np.eye(len(columns)), a.T @ target)

    def left(columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = target - np.bincount(fill[columns].ravel(), weights=np.repeat(counts, 3), minlength=n)
        out[0] = 0.0  # where fillings are padded
        return out

    used = np.zeros(0, dtype=np.int64)
    rest, most = target.copy(), block
    for _ in range(8 * n):
        slope = rest[fill].sum(axis=1)
        slope[used] = 0.0
        taken, more = np.zeros(n, dtype=bool), []
        steep = np.flatnonzero(slope > tolerance)
        for k in steep[np.argsort(-slope[steep], kind="stable")][: 8 * most]:
            lengths = fill[k][fill[k] > 0]
            if len(more) == most:
                break
            if not taken[lengths].any():
                taken[lengths] = True
                more.append(k)
        if not more:
            break
        columns = np.concatenate([used, np.array(more, dtype=np.int64)])
        counts = fitted(columns)
        while most > 1 and (counts <= 0).any():
            columns = columns[counts > 0]
            counts = fitted(columns)
        while most == 1 and (counts <= 0).any():
            now, falls = x[columns], np.flatnonzero(counts <= 0)
            steps = now[falls] / np.maximum(now[falls] - counts[falls], 1e-300)
            now = now + steps.min() * (counts - now)
            now[falls[steps.argmin()]] = 0.0
            x[columns] = np.maximum(now, 0.0)
            columns = columns[now > 0]
            counts = fitted(columns)
        found = left(columns, counts)
        lower = found @ found < rest @ rest
        if not lower and most == 1:
            break
        if lower:
            x[:] = 0.0
            x[columns] = counts
            used, rest = columns, found
        most = block if lower and most > 1 else 1 if most > 1 else max(2, block // 8)
    return x


class Plan:
    """Where the k-th piece of each length goes.

    ``length``, ``first``, ``repeats``, ``sequence``, ``offset``: pieces of a length
    numbered from ``first`` go to one sequence each, from ``sequence`` on, at
    ``offset``. Pieces beyond ``used`` follow each other from ``rest_base`` on, in
    windows from ``rest_sequence`` on.
    """

    def __init__(self, histogram: np.ndarray, window: int = WINDOW) -> None:
        self.window = window
        lengths = np.flatnonzero(histogram)
        fill = fillings(lengths[lengths > 0], window)
        counts = np.rint(solve_repeats(fill, histogram)).astype(np.int64) if len(fill) else np.zeros(0, np.int64)
        left, used, sequences, slots = histogram.copy(), np.zeros_like(histogram), 0, []
        for k in np.argsort(-counts, kind="stable"):
            if counts[k] <= 0:
                break
            own, times = np.unique(fill[k][fill[k] > 0], return_counts=True)
            repeats = int(min(counts[k], (left[own] // times).min()))
            if repeats <= 0:
                continue
            offset = 0
            for x in fill[k][fill[k] > 0][::-1]:
                slots.append((x, used[x], repeats, sequences, offset))
                used[x] += repeats
                left[x] -= repeats
                offset += x
            sequences += repeats
        slots.sort()
        columns = np.array(slots, dtype=np.int64).reshape(-1, 5).T
        self.length, self.first, self.repeats, self.sequence, self.offset = columns
        self.used, self.rest_sequence = used, sequences
        self.rest_base = np.zeros_like(histogram)
        sizes = left * np.arange(len(histogram))
        self.rest_base[1:][::-1] = np.concatenate([[0], np.cumsum(sizes[1:][::-1])[:-1]])

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, whether it may be cut) of pieces by length and number."""
        loose = number >= self.used[length]
        at = self.rest_base[length] + (number - self.used[length]) * length
        sequence, offset = self.rest_sequence + at // self.window, at % self.window
        if len(self.first):
            top = int(max(self.first.max(), number.max(initial=0))) + 1
            slot = np.searchsorted(self.length * top + self.first, length * top + number, side="right") - 1
            sequence = np.where(loose, sequence, self.sequence[slot] + number - self.first[slot])
            offset = np.where(loose, offset, self.offset[slot])
        return sequence, offset, loose


def pack(docs: DataFrame, encoder_path: str, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pack all documents: one row per piece, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    * A document is its text's ids and one ``END_ID``; a null or empty text is
      that id alone. Each id is in exactly one piece; sequences hold at most
      ``window`` ids and, but for the last, are full.
    * Repeated rows are documents of their own. No rows give no rows. A null
      ``doc_id`` stays null. Other columns are not read.
    """
    pieces = save(cut_documents(docs, encoder_path, text_col, window), "pack-pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = save(
        by_part.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")),
        "pack-bases",
    )
    histogram = np.zeros(window + 1, dtype=np.int64)
    for length, n in bases.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        histogram[length] = n
    plan = Plan(histogram, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = dict(zip(batch.schema.names, batch.columns))
            length, number = c["length"].to_numpy().astype(np.int64), c["number"].to_numpy()
            start, crc = c["start"].to_numpy(), c["ids_crc32"].to_numpy()
            sequence, offset, loose = plan.place(length, number)
            cut = np.flatnonzero(loose & (offset + length > window))
            whole = np.minimum(length, np.where(loose, window - offset, length))
            crc = crc.copy()
            tails = []
            for k in cut:
                ids = np.frombuffer(rest := c["rest"][int(k)].as_py(), f"<u{len(rest) // length[k]}")
                crc[k] = _crc(ids[: whole[k]])
                tails.append(_crc(ids[whole[k] :]))
            again = pa.array(np.concatenate([np.arange(len(length)), cut]))
            yield pa.RecordBatch.from_arrays(
                [
                    c["doc_id"].take(again),
                    pa.array(np.concatenate([start, start[cut] + whole[cut]])),
                    pa.array(np.concatenate([whole, (length - whole)[cut]])),
                    pa.array(np.concatenate([crc, np.array(tails, dtype=np.int64)])),
                    c["doc_tokens"].take(again),
                    pa.array(np.concatenate([sequence, sequence[cut] + 1])),
                    pa.array(np.concatenate([offset, np.zeros(len(cut), dtype=np.int64)])),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    numbered = pieces.join(bases.drop("n"), ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("ordinal")).alias("number"), "rest"
    )
    return numbered.mapInArrow(run, PLACED)
