"""Suffix sorting, distance keys, exponion search and licence look-up against brute force, and on odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import hard_negatives, license_scan, suffix_dedup, vector_codes

# Removal of repeated strings


def text_rows(spark, rows):
    """(doc_id, text) beside columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, t, 1, b"x", 2, 3, []) for i, t in rows], "doc_id long, text string, h long, piece binary, place long, digest long, spans array<int>")


def removed_by_hand(rows, length):
    """{(doc_id, text): spans}, by the definition: ids in order, null last, rows of one id as one document."""
    order = sorted({(i is None, i or 0, (t or "").encode()) for i, t in rows})
    first = {}
    for none, i, b in order:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, (none, i, s)), (none, i, s))
    found = {}
    for none, i, b in order:
        spans = []
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (none, i, s):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        found[None if none else i, b] = spans
    return found


def assert_removed(spark, rows, **settings):
    got = suffix_dedup.remove_repeats(text_rows(spark, rows), **settings).collect()
    want = removed_by_hand(rows, settings.get("length", suffix_dedup.LENGTH))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").encode())
    assert len(got) == len(rows)
    for r in got:
        spans = [[s.start, s.end] for s in r.spans]
        fits = [b for b in texts[r.doc_id] if want[r.doc_id, b] == spans and len(b) == r.n_bytes]
        assert any(b"".join(b[x:y] for x, y in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(b)])) == bytes(r.kept) for b in fits), (r, texts[r.doc_id])


@pytest.mark.parametrize("seed", range(40))
def test_suffixes_in_order(seed):
    rng = random.Random(seed)
    length = rng.choice([5, 12, 30, 100])
    base = bytes(rng.choice(rng.choice([b"ab", b"abcdefgh"])) for _ in range(rng.randint(length, 400)))
    data = base + base[: len(base) // 2] + b"c" * rng.randint(0, 150) + base[len(base) // 3 :]
    starts = np.array(rng.sample(range(len(data) - length + 1), len(data) - length + 1))
    bucket = np.sort(np.array([rng.randint(0, 2) for _ in starts]))
    order, head = suffix_dedup.deep_shallow(np.frombuffer(data + bytes(length + 8), dtype=np.uint8), starts, bucket, length)
    keys = [(int(bucket[i]), data[starts[i] : starts[i] + length]) for i in order]
    assert sorted(order.tolist()) == list(range(len(starts))) and keys == sorted(keys)
    assert head.tolist() == [k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))]


def test_blind_trie_orders_strings():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(9)) for _ in range(300)]
    found = suffix_dedup.blind_trie(strings)
    assert [strings[c[0]] for c in found] == sorted(set(strings))
    assert all({strings[i] for i in c} == {strings[c[0]]} for c in found) and sorted(i for c in found for i in c) == list(range(300))


@pytest.mark.parametrize("period", [1, 4, 68, 69, 70, 100])
def test_repeats_within_a_text(spark, period):
    unit = "".join(random.Random(period).choice("abcdefghijklmnop") for _ in range(period))
    assert_removed(spark, [(1, "x" * 7 + unit * (330 // period + 1)), (2, "y" + unit * 2)])


def passages(seed, n=40):
    """Texts of few letters with passages of others in them, copies, and a line in each."""
    rng = random.Random(seed)
    line = "all of this is one common line among others "
    rows = []
    for i in range(n):
        own = "".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 400)))
        if rows and rng.random() < 0.7:
            other = rng.choice(rows)[1]
            a = rng.randint(0, len(other))
            own = own[:200] + line + other[a : a + rng.randint(60, 260)] + own[200:] + line
        rows.append((rng.randint(-5, 10**12), own))
    return rows + [(7, rows[3][1]), (8, rows[3][1])]


@pytest.mark.parametrize("most", [1, 3, 512])
def test_repeats_across_texts(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    assert_removed(spark, passages(most))


def test_repeats_of_other_lengths(spark):
    assert_removed(spark, passages(9, 20), length=20, gram=8)


def test_repeats_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 99), (None, "b" * 150), (4, "b" * 101), (4, "b" * 101), (4, "c" * 100 + "b" * 100), (None, "b" * 150), (2**63 - 1, "d" * 100), (-(2**63), "d" * 120), (5, "word " * 30000)]
    assert_removed(spark, rows)
    assert suffix_dedup.remove_repeats(text_rows(spark, rows).limit(0)).collect() == []
    assert suffix_dedup.remove_repeats(text_rows(spark, [(1, None), (2, "short")])).count() == 2


# Hard negatives


def vectors(spark, rows):
    """(vec_id, embedding, label) beside columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, c, 1, 2, 3.0) for i, v, c in rows], "vec_id long, embedding array<float>, label int, page long, pivot int, distance double")


def mined(spark, rows, every=10, **settings):
    asked = hard_negatives.embedded(vectors(spark, rows), F.col("vec_id") % every == 0, F.col("label"))
    return sorted(map(tuple, hard_negatives.mine(asked, **settings).collect()))


def whole(v):
    return [int(np.floor(256.0 * float(np.float32(x)))) for x in v]


def mined_by_hand(rows, every=10, positives=5, negatives=10):
    good = [(i, whole(v), c) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    good = [g for k, g in enumerate(good) if g not in good[:k]]
    found = []
    for i, v, c in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in good if j != i)
        for p, j, _ in [s for s in scored if s[2] == c][:positives]:
            inside = [(s, k) for s, k, d in scored if d != c and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            found += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(inside, 1)]
    return sorted(found)


def clustered(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(i), (centres[i % 6] + spread * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_negatives_against_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "PAGE", 7)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 3)
    monkeypatch.setattr(hard_negatives, "FIRST", 0.01)  # several rounds
    rows = clustered(1, 240, 8, spread)
    assert mined(spark, rows) == mined_by_hand(rows)


def test_negatives_of_ties_and_repeated_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same, i % 3) for i in range(40)] + [(10, same, 1)] * 3 + [(20, [0.0, 0.0, 0.0], 2), (50, [0.4, 0.0, 0.9], 0), (51, [0.4, 0.0, 0.8], 1)]
    assert mined(spark, rows) == mined_by_hand(rows)


def test_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(2, 30, 4, 1.0) + [(10, None, 1), (20, [1.0, None, 0.0, 0.0], 1), (30, [nan, 0.0, 0.0, 0.0], 1), (40, [inf, 0.0, 0.0, 0.0], 2), (50, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0] * 4, 1)]
    assert mined(spark, [*rows, (60, [1.0, 2.0], 1), (70, [], 2)]) == mined_by_hand(rows)
    assert mined(spark, [(1, None, 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(i, [-1.0 if i else 1.0, 0.0], i % 2) for i in range(12)]) == []  # scores below zero have no range


# Codes


def coded_by_hand(rows, parts, entries, rounds):
    v = np.array([whole(x[1]) for x in rows], dtype=np.int64)
    width = v.shape[1] // parts
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0], v[k].tolist()))[:entries]
    codes, errors, books = [], np.zeros(len(v), dtype=np.int64), []
    for p in range(parts):
        x = v[:, p * width : (p + 1) * width]
        book = x[first].copy()
        for r in range(rounds + 1):
            d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
            code = d.argmin(axis=1)
            if r < rounds:
                for e in range(len(book)):
                    if (code == e).any():
                        book[e] = x[code == e].sum(axis=0) // (code == e).sum()
        codes.append(code)
        errors += d.min(axis=1)
        books.append(book)
    return np.array(codes).T, errors, books


@pytest.mark.parametrize("seed", range(5))
def test_exponion_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    reach = int(rng.choice([2, 50, 1 << 24]))
    entries = rng.integers(-reach, reach + 1, size=(int(rng.integers(1, 65)), 3))
    entries[len(entries) // 2] = entries[0]  # equal entries: the lower index wins
    points = np.concatenate([rng.integers(-reach, reach + 1, size=(300, 3)), entries])
    book = vector_codes.Codebook.of(entries)
    code, square, taken = vector_codes.exponion(points, book, rng.integers(0, len(entries), size=len(points)))
    d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (square == d.min(axis=1)).all()
    again, _, fewer = vector_codes.exponion(points, book, code)
    assert (again == code).all() and fewer <= taken


@pytest.mark.parametrize("dim, parts, entries", [(8, 4, 5), (32, 16, 64)])
def test_codes_against_all_entries(spark, dim, parts, entries):
    rows = clustered(3, 150, dim, 0.7) + [(151, [0.1] * dim, None), (151, [0.1] * dim, None), (None, [0.3] * dim, 2)]
    made = vectors(spark, rows).select("vec_id", "label", vector_codes.whole().alias("v"))
    coded, books = vector_codes.compress(made, parts, entries)
    got = vector_codes.label_errors(coded).collect()
    codes, errors, want = coded_by_hand(rows, parts, entries, vector_codes.ROUNDS)
    assert [b.tolist() for b in books] == [b.tolist() for b in want]
    assert sorted(str((r.vec_id, bytes(r.code), r.error)) for r in got) == sorted(str((x[0], bytes(c.tolist()), int(e))) for x, c, e in zip(rows, codes, errors))
    by = {}
    for x, e in zip(rows, errors):
        by[x[2]] = by.get(x[2], 0) + int(e)
    assert all(r.label_error == by[r.label] for r in got)
    assert vector_codes.digest(books) == hashlib.sha256(",".join(str(int(y)) for b in want for y in b.ravel()).encode()).hexdigest()


def test_codes_odd_rows(spark):
    nan = float("nan")
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 1e30], 1), (2, None, 1), (4, [nan, 0.0, 0.0, 0.0], 1), (5, [1.0, None, 2.0, 2.0], 1), (6, [1.0], 7)]
    made = vectors(spark, rows).where(vector_codes.usable()).select("vec_id", "label", vector_codes.whole().alias("v"))
    coded, books = vector_codes.compress(made, 2, 64)
    got = {r.vec_id: (r.code and bytes(r.code), r.error) for r in coded.collect()}
    assert got == {1: (b"\0\0", 0), 3: (b"\0\1", 0), 6: (None, None)} and [b.shape for b in books] == [(2, 2), (2, 2)]
    none, books = vector_codes.compress(made.limit(0), 2, 64)
    assert none.collect() == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    odd, _ = vector_codes.compress(made, 3, 64)
    assert all(r.code is None for r in odd.collect())


# Licences


def _notices_by_hand(texts, gate=license_scan.GATE):
    """Labels and best share of each text: every notice tried at every place of every text."""
    split = [re.findall(license_scan.WORD, t.lower()) for t in texts]
    postings = license_scan._postings()
    seen = {w: sum(w in set(words) for words in split) for _, w, *_ in postings}
    weight = {w: round((1 + math.log((1 + len(texts)) / (1 + n))) * license_scan.UNIT) for w, n in seen.items()}
    found = []
    for words in split:
        labels, best = set(), 0.0
        for number in {p[0] for p in postings}:
            own = [p for p in postings if p[0] == number]
            whole = sum(weight[p[1]] for p in own)
            for start in range(len(words)):
                here = [p for p in own if 0 <= start + p[3] < len(words) and words[start + p[3]] == p[1]]
                share = sum(weight[p[1]] for p in here) / whole
                if share >= gate and sum(p[4] for p in here) == sum(p[4] for p in own):
                    labels.add(own[0][2])
                    best = max(best, share)
        found.append((labels, best))
    return found


def test_licences_by_hand(spark):
    """Rare-word look-up against every notice at every place, over broken, repeated and run-together notices."""
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(license_scan.TEMPLATES)[1].split()
            a, b = sorted(rng.sample(range(len(words) + 1), 2)) if rng.random() < 0.5 else (0, len(words))
            parts += [rng.choice(["the", "license", "x"]) if rng.random() < 0.1 else w for w in words[a:b]]
            parts += rng.choices(["license", "gnu", "by", "plain", "words"], k=rng.randint(0, 40))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base, expected = {label for _, label in license_scan.BASE}, _notices_by_hand(texts)
    for r in license_scan.scan(docs).collect():
        labels, best = expected[r["doc_id"]]
        own = set(filter(None, r["labels"].split(",")))
        assert own - base == labels - base and labels <= own and r["score"] == pytest.approx(best)
