"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from lorekeep.llm import (
    block_naming,
    compact_windows,
    covering_simhash,
    ftrl_langid,
    hilbert_ann,
    license_scan,
    line_dedup,
    nnls_packing,
    pivotal_mixing,
    pu_toxicity,
    queries,
)
from lorekeep.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, name string, id long, confirmed boolean, "
    "__rows long, __first long, __copies int, n_rows long, decision string, decided_id long, decided_key long, text_key long, same_text long, root long, key long"
)


def docs_of(spark, rows):
    """Rows of (doc_id, text) as documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 8, "x", 9, True, 1, 1, 1, 1, "d", 1, 1, 1, 1, 1, 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]


def text_of(words, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (4, "a"), (None, "a"), (6, "É ß 重"), (7, "word " * 30000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def nothing(spark):
    return docs_of(spark, []).where("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    oracle.assert_same(oracle.connect(SF), queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# exact dedup


def test_exact_odd_rows(odd, nothing):
    rows = block_naming.exact_duplicates(odd, block_chars=16).collect()
    assert len(rows) == len(ODD)
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(1, 2)}
    assert [r["group_size"] for r in rows if r["doc_id"] == 3] == [1]  # one space is not empty
    same = [r for r in rows if r["doc_id"] in (4, None)]
    assert {r["keep_id"] for r in same} == {4} and sum(r["kept"] for r in same) == 1
    assert block_naming.exact_duplicates(nothing).count() == 0


def test_exact_blocks_against_texts(spark, words):
    texts = [text_of(words[:3], n, s) for n in (1, 2, 7, 40) for s in range(6)] * 2
    rows = block_naming.exact_duplicates(docs_of(spark, enumerate(texts)), block_chars=4).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    assert all(r["keep_id"] == first[texts[r["doc_id"]]] and r["group_size"] == texts.count(texts[r["doc_id"]]) for r in rows)


# SimHash


def test_masks_cover():
    ms = covering_simhash.masks()
    assert all(any(not (m >> i | m >> j) & 1 for m in ms) for i in range(64) for j in range(64))


def test_fingerprint():
    t = "Aa bb\tcc dd cc aa"
    w = t.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    assert covering_simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert covering_simhash.fingerprint("one") == xxhash.xxh64_intdigest("one", 42)
    assert covering_simhash.fingerprint(" ") == covering_simhash.fingerprint(None) == 0


@pytest.mark.parametrize("small", [2, 1000])
def test_fingerprint_components(spark, small):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in range(5) for _ in range(15)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps if x < 1 << 64)
    links = covering_simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), small)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    best = {x: x for x in fps}
    for _ in fps:
        for x, y in itertools.combinations(fps, 2):
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                best[x] = best[y] = min(best[x], best[y])
    assert all(roots.get(x, x) == best[x] for x in fps)


def test_simhash_odd_rows(odd, nothing):
    rows = covering_simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, None)} == {4}
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 1} == {"0" * 16}
    assert covering_simhash.near_duplicates(nothing).count() == 0


# toxicity


def test_toxicity_learns_from_positive_and_unlabelled(spark, words):
    rng = random.Random(2)
    bad = ["vile1", "vile2", "vile3"]
    rows, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.2
        w = text_of(words[:300], 60, i).split()
        if toxic:
            w[3:3] = rng.sample(bad, 2)
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    out = pu_toxicity.toxicity(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert held and all(r["predicted"] == int("vile" in rows[r["doc_id"]][1]) for r in held)


def test_toxicity_odd_rows(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = pu_toxicity.toxicity(odd, none).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert pu_toxicity.toxicity(nothing, none).count() == 0
    assert pu_toxicity.reject(odd, pu_toxicity.Classifier({"a": 9.0}, -1.0)).columns == odd.columns


def test_risk_is_kept_from_going_negative():
    p, u = pu_toxicity.SparseRows([[0], [0]]), pu_toxicity.SparseRows([[0], [1], [1], [2]])
    w, b = pu_toxicity.fit_nnpu(p, u, 3, 0.25)
    assert w[0] + b > 0 > w[1] + b


# language


def test_language_held_out(spark):
    out = ftrl_langid.identify(spark.read.parquet(f"{SF}/documents.parquet"))
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    held = out.where("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95


def test_language_odd_rows(spark, odd, nothing):
    rows = ftrl_langid.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    model = ftrl_langid.fit(docs_of(odd.sparkSession, [(i, "plain words") for i in range(30)]), F.lit(True))
    assert [model.predict(t)[0] for t in ("² ½ ① 12 _", "२", "é", "重")] == ["und", "und", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert ftrl_langid.identify(nothing).count() == 0


def test_gram_documents(spark):
    texts = ["ab ab", "b", "ab"]
    got = ftrl_langid.gram_documents(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1))
    want = np.zeros(ftrl_langid.COLUMNS)
    for t in texts:
        want[np.unique(ftrl_langid.grams(t))] += 1
    assert (got == want).all()


# licences


def test_license_places(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0. x"), (2, "see the GNU General Public License, all rights reserved. CC-BY"),
        (3, "ccé by"), (4, "Redistribution and use in source and binary forms, with or without modification, are permitted"), (5, "the apache license"), (6, "general public"),
        (7, "Licensed under the Apache License, Version 2.0"), (8, "source and binary forms"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, rows)).collect()}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"]) == ("cc-by,cc-by-nc", "cc-by", 1, 2)
    assert (got[2]["base_labels"], got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == ("cc-by,gpl,reserved", 3, 3, 9)
    assert got[3]["labels"] == "" and got[3]["score"] == 0 and got[3]["first_word"] is None
    assert got[4]["labels"] == "bsd" and 0 < got[4]["score"] <= 1
    assert got[5]["labels"] == got[6]["labels"] == got[8]["labels"] == "" and got[5]["score"] == 0
    assert got[7]["labels"] == "apache-2.0" and got[7]["score"] == 1


def test_license_odd_rows(odd, nothing):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == len(ODD) and sorted(r["n_words"] for r in rows) == [0, 0, 0, 1, 1, 1, 3, 30000]
    assert license_scan.scan(nothing).count() == 0


# neighbours


def brute(ids, v, query, k):
    out = {}
    for q in np.flatnonzero(query):
        s = [(-float((v[q] * v[j]).sum()), int(ids[j])) for j in range(len(v)) if ids[j] != ids[q]]
        out[int(ids[q])] = [i for _, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("n", [30, 700])
def test_neighbours_are_exact(spark, n):
    rng = np.random.default_rng(n)
    v = rng.normal(size=(n, 8)).astype(np.float32).astype(np.float64) * rng.uniform(0.2, 3, size=(n, 1))
    v[3] = v[4]
    frame = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in hilbert_ann.nearest(frame, F.col("vec_id") % 20 == 0, bucket=64).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    ids = np.arange(n)
    assert found == brute(ids, v, ids % 20 == 0, 20)


@pytest.mark.parametrize("complete", [True, False])
def test_neighbours_of_repeated_rows(spark, complete):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    rows = [(i, v[i].tolist()) for i in range(60)]
    flipped = [(i, v[i].tolist()[::-1]) for i in range(60, 0, -1) if i in (7, 8)]
    rows += rows + [(1, v[1].tolist())] * 20 + flipped
    rows += [(61, [1.0] + [0.0] * 7), (61, [1.0] + [0.0] * 6 + [1e-3])]  # one id, two vectors
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in hilbert_ann.nearest(frame, F.col("vec_id") % 20 == 0, complete=complete).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in (0, 20, 40):
        s = {(-float((v[q] * np.array(w)).sum()), i) for i, w in rows if i != q}
        assert [i for i, _ in found[q]] == [i for _, i in sorted(s)[:20]]


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (20, [float("inf"), 0.0]), (6, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = [tuple(r) for r in hilbert_ann.nearest(frame, F.col("vec_id") % 20 == 0).collect()]
    assert out == [(0, 1, 1, 0.5)]
    assert hilbert_ann.nearest(frame.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_curve_is_one_path():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    path = cells[np.argsort(hilbert_ann.hilbert_key(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# packing


TOKENIZERS = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("path", TOKENIZERS)
def test_ids_are_those_of_the_tokenizer(documents, path):
    encode, plain = nnls_packing.Encoder(public_tokenizers.path(path)), Tokenizer.from_file(public_tokenizers.path(path))
    odd = [
        "a <|endoftext|> b", "\x00\x1c\x1d x\x85\xa0y  \n\n z", " 'll  don't\t\t1a  ", "\U0001f600 \u00e9 \u91cd\u8981 \ud55c\uad6d", "   ",
        "\n", "a\u0558b \u058c", "x\U0001df90y \U0001e6c0 z", "0\u208f \ua7ce", "\u3000a\u2028 b\ufeff",
    ]
    for t in [*odd, *(t for _, t in documents if t)]:
        assert encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_words_of_many_texts_are_merged_once():
    rng, path = random.Random(11), public_tokenizers.path("byte_bpe_50k.json")
    parts = ["'", "s", "re", "ll", " ", "  ", "\n", "\t", "\r\n", "a", "Z\u00e9", "5", "\u0663", ".", "!", " 's", "'ve", "\u3000", "\xa0", "\u4e2d", "d", "m", "e"]
    texts = ["", *("".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000))]
    encoder, plain, merged = nnls_packing._encoder(path), Tokenizer.from_file(path), []
    merge = encoder.merge
    encoder.merge = lambda word: merged.append(word) or merge(word)
    try:
        for _ in range(2):
            assert [i.tolist() for i in encoder.many(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        encoder.merge = merge
    assert 0 < len(merged) == len(set(merged))
    assert nnls_packing._encoder(path) is encoder


@pytest.mark.parametrize("path", TOKENIZERS)
def test_packing_round_trip(spark, documents, path):
    rows = [*documents[:80], (9001, None), (9002, ""), (9003, "a <|endoftext|> b")]
    pieces = nnls_packing.pack(docs_of(spark, rows), public_tokenizers.path(path)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(path))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, t in rows:
        ids, at = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    fills = []
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        fills.append(at)
    assert max(fills) <= 1024 and sum(f < 1024 for f in fills) <= 1


def test_packing_plan_uses_fillings():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 1025, 20000), minlength=1025)
    plan = nnls_packing.Plan(histogram)
    assert (plan.used <= histogram).all() and plan.used.sum() > 0.9 * histogram.sum()


@pytest.mark.parametrize("seed", range(4))
def test_repeats_are_least_squares(seed):
    """The optimality conditions: no filling descends, and those in use are at their minimum."""
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 65, 3000), rng.integers(1, 65, 30), np.minimum(64, rng.geometric(0.1, 900)), np.array([64] * 5 + [32] * 4 + [7])]
    histogram = np.bincount(lengths[seed], minlength=65)
    fill = nnls_packing.fillings(np.flatnonzero(histogram), 64)
    x = nnls_packing.solve_repeats(fill, histogram, block=8, tolerance=1e-3)
    a = np.zeros((65, len(fill)))
    for k in range(3):
        np.add.at(a, (fill[:, k], np.arange(len(fill))), fill[:, k] > 0)
    slope = a.T @ (histogram - a @ x)
    assert (x >= 0).all() and slope.max() < 2e-3 and np.abs(slope[x > 0]).max() < 2e-3


def test_packing_no_rows(nothing, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert nnls_packing.pack(nothing, path).count() == 0
    assert nnls_packing.pack(odd, path).agg(F.sum("length")).head()[0] >= len(ODD)


# mixing


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mixing(spark, words):
    rows = [(i, text_of(words, 5 + i % 40, i), "en", ["a", "B", None, "é"][min(i % 7, 3)], 1) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pivotal_mixing.mix(frame).collect()
    assert len(out) == 900 and all(r["taken"] <= 2 * r["size"] and r["size"] == len(rows[r["doc_id"]][1].split()) for r in out)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = targets_by_hand(dict(sizes))
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 45 for s in want)
    again = pivotal_mixing.mix(frame.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)


def test_mixing_odd_rows(odd, nothing):
    rows = pivotal_mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert pivotal_mixing.mix(nothing).count() == 0


# lines


def removed_by_hand(rows):
    seen, out = [], defaultdict(list)
    for i, t in sorted((i, t or "") for i, t in rows):
        for k, line in enumerate(t.split("\n")):
            w = set(re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), line))) - {""}
            if w:
                if any(len(w & o) / len(w | o) >= 0.8 for o in seen):
                    out[i].append(k)
                seen.append(w)
    return out


@pytest.mark.parametrize("hot", [2, 200])
def test_line_dedup(spark, documents, words, hot):
    rng = random.Random(9)
    base = [text_of(words, 20, s).split() for s in range(4)]
    rows = list(documents[:60])
    for i in range(1000, 1080):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w) + "\nok\n" + " ".join(w[:4])))
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs_of(spark, rows), hot_word=hot).collect()}
    want = removed_by_hand(rows)
    assert all(got[i] == want[i] for i, _ in rows)


def test_four_word_lines_meet_five_word_lines(spark):
    rows = [(1, "a b c d"), (2, "a b c d e"), (3, "p q r s t"), (4, "p q r s"), (5, "f g h"), (6, "f g h i")]
    rows += [(10 + k, f"x{k} y z w\nx{k} y z w v") for k in range(30)]
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs_of(spark, rows), hot_word=2).collect()}
    want = removed_by_hand(rows)
    assert want[2] == want[4] == [0] and all(got[i] == want[i] for i, _ in rows)


def test_near_copies_of_one_line_make_few_pairs(spark, words, monkeypatch):
    rng = random.Random(4)
    base, rows = text_of(words, 60, 3).split(), []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    made, settle = [], line_dedup._settle
    monkeypatch.setattr(line_dedup, "_settle", lambda pairs, *rest: made.append(pairs.distinct().count()) or settle(pairs, *rest))
    got = {r["doc_id"]: r["removed_lines"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    want = removed_by_hand(rows)
    assert all(got[i] == want[i] for i, _ in rows)
    assert sum(made) < 5 * len(rows)


def test_line_words_and_places():
    texts = ["A b\x0bB\tc\n\n  \nÉtÉ é" + "x" * 40, "", None, "q" * 600 + " " + "q" * 601 + "\n\x00 \x00\x00 " + "q" * 600, "\r\n", "a B  c"]
    lines = line_dedup._Lines(pa.array(texts))
    by_hand = [(t, n, sorted(line_dedup.line_words(x))) for t, text in enumerate(texts) for n, x in enumerate((text or "").split("\n")) if line_dedup.line_words(x)]
    assert list(zip(lines.text.tolist(), lines.number.tolist())) == [(t, n) for t, n, _ in by_hand]
    _, _, size = lines.sets()
    assert size.tolist() == [len(w) for _, _, w in by_hand]
    names = {}
    for k, (_, _, w) in enumerate(by_hand):
        for digest in set(lines.word[lines.line == k].tolist()):
            names.setdefault(digest, set()).update([k])
    assert len(names) == len({x for _, _, w in by_hand for x in w})
    assert lines.word[lines.line == 0].tolist()[0] == lines.word[lines.line == len(by_hand) - 1].tolist()[0]


def test_line_dedup_odd_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd).collect()}
    assert len(rows) == 7 and rows[1]["n_lines"] == 0 and rows[7]["n_removed"] == 0
    assert rows[4]["n_removed"] == 2 and rows[4]["removed_lines"] == [0, 0] and rows[None]["removed_lines"] == []
    assert line_dedup.dedup_lines(nothing).count() == 0


# passages


def test_compact_windows_cover_every_passage_once():
    h = np.random.default_rng(1).integers(0, 50, 60)
    windows = compact_windows.compact_windows(h, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            own = [c for left, c, r in windows if left <= i <= c <= j <= r]
            assert own == [i + int(h[i : j + 1].argmin())]


def test_shingles_of_many_texts_at_once(words):
    texts = [text_of(words, n, n) for n in (0, 3, 4, 5, 60, 400)] + [None, "", " É\tß 重\x0bA b\nC " + "x" * 31 + " " + "y" * 32 + " \x00 " + "Z" * 700]
    found = compact_windows.shingle_lists(pa.array(texts))
    for text, got in zip(texts, found):
        one = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()]
        want = []
        for k in range(len(one) - compact_windows.WORDS + 1):
            h = one[k]
            for w in one[k + 1 : k + compact_windows.WORDS]:
                h = (h * int(compact_windows._BASE) + w) % 2**64
            want.append(h ^ h >> 29)
        assert got.tolist() == want
    assert sum(map(len, found)) > 450
    text, sig = compact_windows.signatures(*compact_windows.shingled(pa.array(texts)))
    for k, s in enumerate(found):
        alone = compact_windows.signatures(s, np.array([0]), np.array([len(s)]))[1] if len(s) else s
        assert set(sig[text == k].tolist()) == set(alone.tolist())


def test_signatures_are_not_shuffled_row_by_row(spark, words, monkeypatch):
    """Before, each signature of each text was a row of a table and of a shuffle."""
    saved = {}
    monkeypatch.setattr(compact_windows, "save", lambda df, label, save=compact_windows.save: saved.setdefault(label, save(df, label)))
    rows = [(i, text_of(words, 300, i)) for i in range(40)] + [(99, text_of(words, 300, 3) + " end")]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i for i in range(40)} | {99: 3}
    assert "windows" not in saved and {r["id"] for r in saved["window-texts"].collect()} == {3, 99}


@pytest.mark.parametrize("small", [1, 12])
def test_shared_passages(spark, words, small):
    passage, other = text_of(words, 60, 1), text_of(words, 70, 2)
    rows = [(i, text_of(words, 120, 100 + i)) for i in range(20)]
    for i in range(6):
        rows.append((100 + i, f"{text_of(words, 30 + i, 200 + i)} {passage} {text_of(words, 40, 300 + i)}"))
    near = other.split()
    near[35] = "changed"
    rows += [(200, f"{text_of(words, 9, 400)} {other}"), (201, " ".join(near)), (300, passage), (301, passage), (302, "short"), (303, "short")]
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, rows), block=small).collect()}
    assert all(out[i]["class_id"] == i and not out[i]["spans"] for i in range(20))
    assert {out[i]["class_id"] for i in [*range(100, 106), 300, 301]} == {100}
    for i in range(6):
        assert any(s["start"] <= 30 + i and s["end"] >= 90 + i for s in out[100 + i]["spans"])
    assert out[201]["class_id"] == 200 and out[201]["n_words_shared"] >= 50
    assert out[303]["class_id"] == 302 and not out[303]["spans"]


def test_least_places_are_those_of_compact_windows():
    h = np.random.default_rng(2).integers(0, 500, 300).astype(np.uint64)
    for shortest in (1, 5, 46):
        want = sorted({c for _, c, _ in compact_windows.compact_windows(h, shortest)})
        assert np.unique(compact_windows.least_places(h, shortest)).tolist() == want


def test_large_group_meets_whole(spark, words):
    """Pairs of a large group that neither hold its first text's passage nor stand beside each other."""
    base = text_of(words, 60, 1).split()
    rows = [(i * 1000, f"{' '.join(base[:5])} {text_of(words, 60, 500 + i)}") for i in range(20)]
    for i in range(20):
        rows.append((100000 + i * 1000, f"{text_of(words, 11 * i + 5, 600 + i)} {' '.join(base)} {text_of(words, 5 + 7 * i, 700 + i)}"))
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    assert all(out[i * 1000]["class_id"] == i * 1000 for i in range(20))
    assert {(out[100000 + i * 1000]["class_id"], out[100000 + i * 1000]["n_texts"]) for i in range(20)} == {(100000, 20)}
    assert [out[100000 + i * 1000]["n_links"] for i in range(20)] == [19] + [1] * 19


def passages_by_hand(rows):
    """Classes and exactly shared words of texts by comparing all pairs."""
    texts = {i: t.split() for i, t in rows}
    shared, root = {i: set() for i in texts}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        runs = defaultdict(list)
        for k in range(len(texts[j]) - 49):
            runs[" ".join(texts[j][k : k + 50])].append(k)
        for k in range(len(texts[i]) - 49):
            for m in runs.get(" ".join(texts[i][k : k + 50]), []):
                shared[i].update(range(k, k + 50))
                shared[j].update(range(m, m + 50))
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in texts}, shared


def test_equal_passages_against_all_pairs(spark, words):
    """Groups of several sizes whose passages overlap in part, begin and end anywhere, and stand beside common lines."""
    rng = random.Random(11)
    pool = [text_of(words, 140, 900 + k).split() for k in range(5)]
    line = text_of(words, 22, 990)
    rows = []
    for i in range(150):
        start = rng.randrange(90)
        part = pool[min(rng.randrange(9), 4)][start : start + rng.choice([30, 49, 50, 51, 80])]
        rows.append((i, " ".join([text_of(words, rng.randrange(40), i), line, *part, text_of(words, rng.randrange(60), 5000 + i), rng.choice(["", line])])))
    rows = [(i, " ".join(t.split())) for i, t in rows]
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    classes, shared = passages_by_hand(rows)
    for i, _ in rows:
        assert shared[i] <= {k for s in out[i]["spans"] for k in range(s["start"], s["end"])}
    assert all(out[i]["class_id"] == out[j]["class_id"] for i, j in classes.items())


def test_recall_of_similar_passages(spark, words):
    """Pairs of 60-word passages with one word changed in the middle, in different texts: similarity 51 / 61."""
    rows = []
    for k in range(150):
        w = text_of(words, 60, 7000 + k).split()
        rows.append((2 * k, f"{text_of(words, 40, 8000 + k)} {' '.join(w)} {text_of(words, 30, 8500 + k)}"))
        w[30] = "changed"
        rows.append((2 * k + 1, f"{text_of(words, 25, 9000 + k)} {' '.join(w)} {text_of(words, 45, 9500 + k)}"))
    out = {r["doc_id"]: r["class_id"] for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    assert np.mean([out[2 * k] == out[2 * k + 1] for k in range(150)]) > 0.95


def test_texts_of_one_id_and_other_white_space(spark, words):
    a, b, c = (text_of(words, 60, 60 + k) for k in range(3))
    rows = [(5, a), (5, b), (6, a), (7, b), (8, "\n" + c), (9, c.replace(" ", "\u00a0"))]
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, [*rows, (10, f"x {c}")])).collect()}
    assert (out[6]["class_id"] == 5) != (out[7]["class_id"] == 5)
    assert [tuple(s) for s in out[8]["spans"]] == [(0, 60)] and out[8]["n_words_shared"] == 60 and out[9]["spans"] == []


def ranges_by_hand(a, b):
    n, s = compact_windows.SHORTEST, compact_windows.SIMILARITY
    found = set()
    for i, j in itertools.product(range(len(a) - n + 1), range(len(b) - n + 1)):
        for e, g in itertools.product(range(i + n, len(a) + 1), range(j + n, len(b) + 1)):
            x, y = set(a[i:e].tolist()), set(b[j:g].tolist())
            if len(x & y) / len(x | y) >= s:
                found.add((i, e, j, g))
    return found


def test_passages_with_insertions(spark, words):
    for seed, (at, n) in enumerate([(30, 1), (30, 2), (20, 2), (28, 8)]):
        w = text_of(words, 58, 40 + seed).split()
        a, b = (compact_windows.shingles(" ".join(t)) for t in (w, w[:at] + [f"new{k}" for k in range(n)] + w[at:]))
        assert bool(compact_windows.similar_ranges(a, b)) == bool(ranges_by_hand(a, b))
    passage = text_of(words, 60, 3).split()
    longer = [w for k, w in enumerate(text_of(words, 270, 4).split()) for w in ([w, f"in{k}"] if k % 45 == 44 else [w])]
    rows = [
        (1, f"{text_of(words, 20, 800)} {' '.join(passage)}"), (2, " ".join(passage[:30] + ["inserted"] + passage[30:])),
        (3, text_of(words, 270, 4)), (4, f"{' '.join(longer)} {text_of(words, 20, 801)}"),
    ]
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    assert out[2]["class_id"] == 1 and out[4]["class_id"] == 3 and out[3]["n_words_shared"] >= 260


def test_repeated_shingles_count_once(words):
    line, other = text_of(words, 30, 5), text_of(words, 60, 6)
    a, b = (compact_windows.shingles(t) for t in (" ".join([line] * 4), f"{other} {' '.join([line] * 3)}"))
    assert compact_windows.similar_ranges(a, b)
    few = ["same"] * 30
    a, b = (compact_windows.shingles(" ".join(few + [f"{c}{k}" for k in range(5)] + few)) for c in "xy")
    assert not [r for r in compact_windows.similar_ranges(a, b) if set(a[r[0]:r[1]].tolist()) != set(b[r[2]:r[3]].tolist())]


def test_texts_that_repeat_few_shingles_are_aligned_few_times(monkeypatch):
    """Of lines said over and over all shifts align: a few alignments tell the ranges of all, and texts that can't be similar need none."""
    chain, sizes = compact_windows._chain, []
    monkeypatch.setattr(compact_windows, "_chain", lambda p, q: sizes.append(len(p)) or chain(p, q))
    line = [f"w{k}" for k in range(36)]
    a, b = (compact_windows.shingles(" ".join(line * n)) for n in (12, 14))
    found = compact_windows.similar_ranges(a, b)
    assert len(sizes) <= 3 and (0, len(a)) in {r[:2] for r in found}
    assert compact_windows._joined([r[2:] for r in found]) == [(0, len(b))]
    sizes.clear()
    other = compact_windows.shingles(" ".join((line[:18] + [f"v{k}" for k in range(18)]) * 12))
    assert compact_windows.similar_ranges(a, other) == [] and not sizes


@pytest.mark.parametrize("seed", range(20))
def test_fewest_different(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, rng.integers(1, 30), 60).astype(np.uint64)
    assert compact_windows.fewest_different(s, 10) == min(len(set(s[k : k + 10].tolist())) for k in range(51))


@pytest.mark.parametrize("dense", [0, 1000])
def test_chain_by_place_and_by_match(monkeypatch, dense):
    monkeypatch.setattr(compact_windows, "DENSE", dense)
    rng = np.random.default_rng(4)
    for _ in range(60):
        both = np.unique(rng.integers(0, 9, (rng.integers(2, 40), 2)), axis=0)
        p, q = compact_windows._chain(both[:, 0], both[:, 1])
        assert (np.diff(p) > 0).all() and (np.diff(q) > 0).all() and {*zip(p.tolist(), q.tolist())} <= {*map(tuple, both.tolist())}
        best = {}
        for x, y in both.tolist():
            best[x, y] = 1 + max((n for (i, j), n in best.items() if i < x and j < y), default=0)
        assert len(p) == max(best.values())


def test_texts_without_a_dense_stretch_are_not_aligned(words, monkeypatch):
    """Copies in which every twelfth word was changed share over half of their shingles and no passage; others are found as by hand."""
    w, chains = text_of(words, 150, 31).split(), []
    align = compact_windows._chains
    monkeypatch.setattr(compact_windows, "_chains", lambda *args: chains.append(1) or align(*args))
    a, b = (compact_windows.shingles(" ".join(t)) for t in (w, [f"new{k}" if k % 12 == 11 else v for k, v in enumerate(w)]))
    assert len(np.intersect1d(a, b)) > len(a) / 2 and compact_windows.similar_ranges(a, b) == [] and not chains
    for seed in range(12):
        rng = random.Random(seed)
        t = text_of(words, 56, 3200 + seed).split()
        other = [f"new{k}" if rng.random() < 0.03 else v for k, v in enumerate(t)]
        a, b = (compact_windows.shingles(" ".join(x)) for x in (t, other[: rng.randrange(50, 57)]))
        assert bool(compact_windows.similar_ranges(a, b)) == bool(ranges_by_hand(a, b))


def test_runs_said_twice_by_one_text_count_once(spark, words):
    """A text that says its passage twice is one of the texts that hold it, and none if no other has it."""
    a, b = (text_of(words, 60, 3300 + k) for k in range(2))
    rows = [(1, f"{a} x {a}"), (2, f"y {a}"), (3, f"{b} x {b}")]
    out = {r["doc_id"]: r for r in compact_windows.substring_duplicates(docs_of(spark, rows)).collect()}
    assert [out[i]["n_texts"] for i in (1, 2, 3)] == [2, 2, 1] and out[1]["n_words_shared"] == 120 and out[3]["spans"] == []


def test_passages_odd_rows(odd, nothing):
    rows = {r["doc_id"]: r for r in compact_windows.substring_duplicates(odd).collect()}
    assert len(rows) == 6 and rows[2]["class_id"] == 1
    assert compact_windows.substring_duplicates(nothing).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
            path = str(tmp_path / str(k))
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "source mixing":
                n = docs.count()
                assert 0.5 * last < n <= last, name
                last = n
    assert out.agg(F.max(F.col("offset") + F.col("length"))).head()[0] <= 1024
    kept = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in docs.dropDuplicates(["doc_id"]).collect()]
    assert len(kept) == len(set(kept))


def test_pipeline_stages_on_odd_rows(spark, odd, nothing, tmp_path):
    """All five stages, with a fitted classifier, on odd rows among documents."""
    import corpus_pipeline

    rng = random.Random(4)
    clean = [(100 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(40))) for i in range(120)]
    toxic = [(300 + i, " ".join([f"w{rng.randrange(400)}" for _ in range(30)] + ["vile1", "vile2"])) for i in range(40)]
    docs = odd.unionByName(docs_of(spark, clean + toxic))
    labels = [(i, int(i >= 300)) for i, _ in clean + toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.agg(F.sum("length")).head()[0] > docs.count()
            break
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "toxicity":
            kept = {r["doc_id"] for r in docs.collect()}
            assert {i for i, _ in clean} <= kept and not kept & {i for i, _ in toxic} and docs.count() == len(ODD) + len(clean)


def test_stages_tell_rows_of_one_id_apart(spark, words):
    import corpus_pipeline

    a, b, c = (text_of(words, 60, s) for s in (1, 2, 3))
    near = a + " tail"
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, c), (None, b), (3, c)]
    kept = corpus_pipeline.drop_exact_copies(spark, docs_of(spark, rows), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (3, c)])
    rows = [(5, b), (5, a), (5, near), (None, c), (None, c), (6, near)]
    got = corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), SF).collect()
    link = bin(covering_simhash.fingerprint(a) ^ covering_simhash.fingerprint(near)).count("1") <= 2
    assert len(got) == (3 if link else 4) and sum(r["text"] == c for r in got) == 1 and sum(r["text"] == b for r in got) == 1
    rows = [(7, text_of(words, 30, k)) for k in range(300)] + [(None, a)] * 300
    mixed = corpus_pipeline.mix_sources(spark, docs_of(spark, rows), SF)
    share = mixed.where("doc_id is null").count()
    assert 300 <= share <= 600 and abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * (300 * 30 + 300 * 60)) <= 60
