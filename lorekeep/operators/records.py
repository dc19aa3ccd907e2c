"""What is wrong with records: blocks and their references, redirects, generations, manifests, suites; receipts of members."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.functions import validity as V

MOST_BLOCK_BYTES = 1 << 20
MOST_OBJECTS = 1_000_000
DIGEST = "^[0-9a-f]{64}$"


def first_fault(*rules: tuple[Column, str]) -> Column:
    """The code of the first condition that holds; null if none does."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in rules))


def block_faults(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(project, page_id, block_id, fault) of bad blocks: an ordinal twice in its section, too much text, a footnote's
    reference that the page does not have.

    ``blocks`` has project, page_id, section, ordinal, block_id, text, reference_id (null without); ``references``
    project, page_id, reference_id.
    """
    place = ["project", "page_id", "section", "ordinal"]
    n = blocks.groupBy(*(F.coalesce(c, F.lit(-1)).alias(c) if c == "section" else F.col(c) for c in place)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = references.select("project", "page_id", "reference_id").distinct().withColumn("known", F.lit(True))
    met = blocks.withColumn("section", F.coalesce("section", F.lit(-1))).join(n, place, "left").join(known, ["project", "page_id", "reference_id"], "left")
    fault = first_fault(
        (F.col("n") > 1, "DuplicateOrdinal"), (F.octet_length("text") > MOST_BLOCK_BYTES, "BlockTooLarge"),
        (F.col("reference_id").isNotNull() & F.col("known").isNull(), "UnknownReference"),
    )
    return met.select("project", "page_id", "block_id", fault.alias("fault")).where("fault is not null")


def unresolved_evidence(citations: DataFrame, tables: DataFrame, references: DataFrame, known_tables: DataFrame) -> DataFrame:
    """(page_id, kind, id): citations and table references of a page's parts that resolve to nothing on that page."""
    cited = citations.select("page_id", F.col("reference_id").alias("id")).distinct().join(references.select("page_id", F.col("reference_id").alias("id")), ["page_id", "id"], "left_anti")
    shown = tables.select("page_id", F.col("table_id").alias("id")).distinct().join(known_tables.select("page_id", F.col("table_id").alias("id")), ["page_id", "id"], "left_anti")
    return cited.select("page_id", F.lit("citation").alias("kind"), "id").unionByName(shown.select("page_id", F.lit("table").alias("kind"), "id"))


def redirect_fault(source: Column, target: Column) -> Column:
    """What is wrong with a redirect's titles, null if nothing is."""
    return first_fault(
        (~F.coalesce(T.valid_title(source), F.lit(False)), "InvalidSource"), (~F.coalesce(T.valid_title(target), F.lit(False)), "InvalidTarget"),
        (T.title_key(source) == T.title_key(target), "SelfRedirect"),
    )


#: Files of a source generation and their bytes, names that are safe everywhere, names of devices.
MOST_FILES = 10_000
MOST_GENERATION_BYTES = 1 << 50
SAFE_NAME = "^[A-Za-z0-9_-]([A-Za-z0-9._-]{0,253}[A-Za-z0-9_-])?$"
DEVICE_NAME = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def safe_name(name: Column) -> Column:
    """A name of at most 255 plain bytes that begins and ends without a dot and is no device's, whatever its extension."""
    return F.coalesce(name.rlike(SAFE_NAME) & ~name.rlike(DEVICE_NAME), F.lit(False))


def generation_faults(generations: DataFrame, files: DataFrame, most_files: int | None = MOST_FILES) -> DataFrame:
    """(project, generation_id, fault, file) of source generations that are not valid.

    ``generations`` has (project, generation_id, completed), ``files`` (project, generation_id, position, name, sha256,
    bytes). A generation breaks at most one rule: of its own, in the order below, or else the first of its files in their
    order. ``file`` names that file: too many bytes so far, an unsafe name, a bad digest, no bytes, or a name that an
    earlier file has in whatever case. More than ``most_files`` files break a rule too.
    """
    key = ["project", "generation_id"]
    so_far = Window.partitionBy(*key).orderBy("position")
    placed = files.withColumns(
        {
            "total": F.sum(F.coalesce("bytes", F.lit(0)).cast("decimal(38,0)")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)),
            "turn": F.row_number().over(Window.partitionBy(*key, F.lower("name")).orderBy("position")),
        }
    )
    good = safe_name(F.col("name")) & F.coalesce(F.col("sha256").rlike("^[0-9A-Fa-f]{64}$") & (F.col("bytes") > 0), F.lit(False))
    bad = placed.select(
        *key, "position", "name",
        first_fault((F.col("total") > MOST_GENERATION_BYTES, "ResourceBudget"), (~good, "InvalidFile"), (F.col("turn") > 1, "DuplicateFile")).alias("code"),
    )
    each = bad.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("code").isNotNull(), F.struct("position", "code", "name"))).alias("first"))
    told = generations.join(each, key, "left")
    own = first_fault(
        (~F.coalesce(F.col("project").rlike("^[a-z]([a-z0-9_]{0,253}[a-z0-9])?$"), F.lit(False)), "InvalidProject"), (~safe_name(F.col("generation_id")), "MissingGeneration"),
        (~F.coalesce("completed", F.lit(False)), "Incomplete"), (F.col("n").isNull(), "EmptyFileSet"), (F.lit(most_files is not None) & (F.col("n") > F.lit(most_files)), "ResourceBudget"),
    )
    file = F.when(own.isNull() & (F.col("first.code") != "ResourceBudget"), F.col("first.name"))
    return told.select(*key, F.coalesce(own, F.col("first.code")).alias("fault"), file.alias("file")).where("fault is not null")


def manifest_faults(objects: DataFrame) -> DataFrame:
    """(pack_id, fault) of manifests whose objects (pack_id, path, sha256, size, mime) break a rule; one row a manifest.

    Paths repeat if they, or folders above them, differ by case only, in lower or in upper case: ``A/x`` beside ``a/y``.
    """
    parts = F.split("path", "/")
    prefixes = objects.select("pack_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("prefix")).distinct()
    clashes = [prefixes.groupBy("pack_id", fold("prefix").alias("folded")).count().where("count > 1").select("pack_id") for fold in (F.lower, F.upper)]
    clash = clashes[0].unionByName(clashes[1]).distinct().withColumn("clash", F.lit(True))
    safe = ~F.coalesce(F.col("path").startswith("/") | F.col("path").contains("\\") | F.exists(F.split("path", "/"), lambda p: p.isin("", ".", "..")), F.lit(True))
    each = objects.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("path")).alias("paths"),
        *(
            F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias(name)
            for name, ok in (("unsafe", safe), ("undigested", F.col("sha256").rlike(DIGEST)), ("unsized", F.col("size") > 0), ("untyped", V.valid_mime("mime")))
        ),
    ).join(clash, "pack_id", "left")
    fault = first_fault(
        (F.col("n") > MOST_OBJECTS, "TooManyObjects"), (F.col("unsafe") > 0, "UnsafePath"), ((F.col("paths") < F.col("n")) | F.coalesce("clash", F.lit(False)), "DuplicatePath"),
        (F.col("undigested") > 0, "InvalidDigest"), (F.col("unsized") > 0, "InvalidSize"), (F.col("untyped") > 0, "InvalidType"),
    )
    return each.select("pack_id", fault.alias("fault")).where("fault is not null")


def member_receipts(ids: DataFrame) -> DataFrame:
    """(member, pages, first, last, increasing, digest): what was observed of each member (member, seq, id).

    ``digest`` is the SHA-256 of the member's ids as lines, by ``seq`` and id. A digest of an order has to see it: a
    member's ids pass through one task, which keeps one hash and no rows. ``increasing`` says whether each id was
    greater than the one before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None

        def told() -> pa.RecordBatch:
            pages, first, last, rising, _, digest = seen
            return pa.RecordBatch.from_pylist([{"member": now, "pages": pages, "first": first, "last": last, "increasing": rising, "digest": digest.hexdigest()}], schema)

        for b in batches:
            schema = pa.schema([("member", b.schema.field(0).type), ("pages", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("increasing", pa.bool_()), ("digest", pa.string())])
            member, id_ = b.column(0).to_pylist(), b.column(1).to_pylist()
            for m, i in zip(member, id_, strict=True):
                if seen is None or m != now:
                    if seen is not None:
                        yield told()
                    now, seen = m, [0, i, i, True, None, hashlib.sha256()]
                seen[0] += 1
                seen[1], seen[2] = min(seen[1], i), max(seen[2], i)
                seen[3] = seen[3] and (seen[4] is None or i > seen[4])
                seen[4] = i
                seen[5].update(b"%d\n" % i)
        if seen is not None:
            yield told()

    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ids.schema["member"].dataType.simpleString()
    ordered = ids.where("id is not null").repartition(n, "member").sortWithinPartitions("member", "seq", "id").select("member", F.col("id").cast("long").alias("id"))
    return ordered.mapInArrow(run, f"member {kind}, pages long, first long, last long, increasing boolean, digest string")


SUITE = "schema_version INT, cases ARRAY<STRUCT<id: BIGINT, query: STRING, relevant: ARRAY<STRING>>>"


def suite_cases(suites: DataFrame) -> DataFrame:
    """(suite, case_id, query, relevant, fault) of evaluation suites (suite, body): one row a case, or one with a suite's fault."""
    s = F.from_json("body", SUITE)
    ids = F.transform(s["cases"], lambda c: c["id"])
    fault = first_fault(
        (s["cases"].isNull(), "InvalidSuite"), (~s["schema_version"].eqNullSafe(F.lit(1)), "UnsupportedSchema"), (F.size(s["cases"]) == 0, "EmptySuite"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "DuplicateCase"),
        (F.exists(s["cases"], lambda c: c["id"].isNull() | F.coalesce(F.trim(c["query"]) == "", F.lit(True)) | c["relevant"].isNull()), "InvalidCase"),
    )
    rows = suites.select("suite", fault.alias("fault"), s["cases"].alias("cases"))
    good = rows.where("fault is null").select("suite", F.explode("cases").alias("c"))
    none = F.lit(None).cast("string")
    return good.select("suite", F.col("c.id").alias("case_id"), "c.query", F.size("c.relevant").alias("relevant"), none.alias("fault")).unionByName(
        rows.where("fault is not null").select("suite", F.lit(None).cast("long").alias("case_id"), none.alias("query"), F.lit(None).cast("int").alias("relevant"), "fault")
    )
