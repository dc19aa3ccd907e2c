"""Source generations and manifests: the first rule that each breaks."""

from lorekeep.operators import records

D = "a" * 64
GOOD = [("articles.parquet", D, 10), ("b_2-x", "A" * 64, 1)]
CASES = {
    "good": ("zh_min_nanwiki", "20261001", True, GOOD, None),
    "project": ("_enwiki", "1", True, GOOD, ("InvalidProject", None)), "upper": ("Enwiki", "1", True, GOOD, ("InvalidProject", None)), "ends": ("enwiki_", "1", True, GOOD, ("InvalidProject", None)),
    "dots": ("enwiki", "..", True, GOOD, ("MissingGeneration", None)), "lead": ("enwiki", ".a", True, GOOD, ("MissingGeneration", None)), "trail": ("enwiki", "a.", True, GOOD, ("MissingGeneration", None)),
    "path": ("enwiki", "a/b", True, GOOD, ("MissingGeneration", None)), "device": ("enwiki", "Com1.txt", True, GOOD, ("MissingGeneration", None)), "no device": ("enwiki", "COM10", True, GOOD, None),
    "long": ("enwiki", "a" * 256, True, GOOD, ("MissingGeneration", None)), "unfinished": ("enwiki", "u", False, [], ("Incomplete", None)), "empty": ("enwiki", "e", True, [], ("EmptyFileSet", None)),
    "bytes": ("enwiki", "y", True, [("a", D, 1 << 50), ("b", D, 1), ("a/b", D, 1)], ("ResourceBudget", None)), "all bytes": ("enwiki", "z", True, [("a", D, (1 << 50) - 1), ("b", D, 1)], None),
    "name": ("enwiki", "n", True, [*GOOD, ("NUL.x", D, 1), ("a/b", D, 1)], ("InvalidFile", "NUL.x")), "digest": ("enwiki", "g", True, [("a", "a" * 63, 1)], ("InvalidFile", "a")),
    "no bytes": ("enwiki", "b0", True, [("a", D, 0)], ("InvalidFile", "a")), "null": ("enwiki", "nn", True, [("a", None, 5)], ("InvalidFile", "a")),
    "case": ("enwiki", "c", True, [("Same", D, 1), ("sAME", D, 1), ("..", D, 1)], ("DuplicateFile", "sAME")), "many": ("enwiki", "m", True, [(f"f{k}", D, 1) for k in range(10_001)], ("ResourceBudget", None)),
}


def test_generations(spark):
    known = {(p, g): name for name, (p, g, *_) in CASES.items()}
    generations = spark.createDataFrame([(p, g, done) for p, g, done, _, _ in CASES.values()], "project string, generation_id string, completed boolean").distinct()
    files = spark.createDataFrame([(p, g, k, *f) for p, g, _, files, _ in CASES.values() for k, f in enumerate(files)], "project string, generation_id string, position int, name string, sha256 string, bytes long")
    got = {known[r.project, r.generation_id]: (r.fault, r.file) for r in records.generation_faults(generations, files).collect()}
    assert got == {name: c[4] for name, c in CASES.items() if c[4]}


def test_manifest_paths_that_differ_by_case(spark):
    packs = {1: ["A/x", "a/y"], 2: ["a/x", "a/y"], 3: ["a/x", "a/X"], 4: ["\u03c3/x", "\u03c2/y"], 5: ["a/x", "a/x"], 6: ["a", "b/a"]}
    rows = [(k, p, D, 1, "image/png") for k, paths in packs.items() for p in paths]
    got = records.manifest_faults(spark.createDataFrame(rows, "pack_id long, path string, sha256 string, size long, mime string")).collect()
    assert {r.pack_id: r.fault for r in got} == dict.fromkeys((1, 3, 4, 5), "DuplicatePath")
