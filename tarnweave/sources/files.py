"""Readers and writers of JSON envelopes, record files of unknown shape, binary documents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnweave.functions import vocabulary as V
from tarnweave.functions.text import strip
from tarnweave.operators.durable import durable

#: Levels of nesting between two looks at whether more are there.
LEVELS = 8


def envelope(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """The rows under a key of a JSON document."""
    read = spark.read.schema(f"{rows} array<struct<{schema}>>").option("multiLine", True).json(path)
    return read.select(F.inline(rows))


def records(spark: SparkSession, path: str, candidates: list[str], schema: str) -> DataFrame:
    """Records of a JSON document that is a list, or has them under the first of the candidate keys, or maps addresses to them (then `url` is filled)."""
    doc = spark.read.option("wholetext", True).text(path).select(F.parse_json("value").alias("doc"))
    as_list = lambda p: F.try_variant_get("doc", p, "array<variant>")
    found = F.coalesce(as_list("$"), *(as_list(f"$.{k}") for k in candidates))
    by_url = F.try_variant_get("doc", "$", "map<string,variant>")
    listed = doc.where(found.isNotNull()).select(F.explode(found).alias("r"), F.lit(None).cast("string").alias("key"))
    mapped = doc.where(found.isNull()).select(F.explode(by_url).alias("key", "r"))
    text = listed.unionByName(mapped).select("key", F.from_json(F.to_json("r"), schema).alias("s"))
    out = text.select("key", "s.*")
    return out.withColumn("url", F.coalesce("url", "key")).drop("key") if "url" in out.columns else out.drop("key")


def tolerant(df: DataFrame, text: str, fields: dict[str, str], candidates: dict[str, list[str]] | None = None) -> DataFrame:
    """df with the fields (name to type) of the JSON object in `text`, and `rescued`: what of it didn't fit, key to raw value; null if all did. Works on streams as well.

    A field is read from its own key, or from the first of its `candidates` that has a value that isn't blank; a value that can't be of the field's type is null
    and rescued under its key, as are keys that no field has. A text that is no JSON object is rescued whole under "$". Null texts have nothing to rescue.
    """
    candidates = candidates or {}
    raw = F.from_json(F.to_json(F.try_parse_json(text)), "map<string,string>")
    keys = {f: candidates.get(f, [f]) for f in fields}
    held = df.withColumn("raw of json", F.when(F.try_parse_json(text).cast("string").isNotNull() & F.ltrim(F.col(text)).startswith("{"), raw))
    m = F.col("raw of json")
    some = lambda k: F.when(F.btrim(F.try_element_at(m, F.lit(k))) != "", F.try_element_at(m, F.lit(k)))

    def typed(x: Column, kind: str) -> Column:
        return F.from_json(x, kind) if kind.startswith(("array", "struct", "map")) else x if kind == "string" else x.try_cast(kind)

    values = {f: F.coalesce(*(some(k) for k in keys[f])) for f in fields}
    out = held.select("*", *(typed(v, fields[f]).alias(f) for f, v in values.items()))
    # A key is left over if no field reads it, or if the field that does couldn't take its value.
    used = F.create_map(*(x for f in fields for k in keys[f] for x in (F.lit(k), F.struct(F.col(f).isNull().alias("missing"), values[f].alias("value"))))) if fields else None
    left = lambda k, v: v.isNotNull() if used is None else F.when(F.map_contains_key(used, k), used[k]["missing"] & v.eqNullSafe(used[k]["value"]) & (F.btrim(v) != "")).otherwise(True)
    rescued = F.when(m.isNull(), F.when(F.col(text).isNotNull(), F.create_map(F.lit("$"), F.col(text)))).otherwise(F.map_filter(m, left))
    return out.withColumn("rescued", F.when(F.size(rescued) > 0, rescued)).drop("raw of json")


def url_records(df: DataFrame, variant: str = "doc") -> DataFrame:
    """Every object with a url that isn't blank, at any depth of a variant column, as JSON. A level at a time, by exploding, until a level is empty; that is looked at, and the level written, once in LEVELS levels."""
    level, out = df.select(F.col(variant).alias("v")), None
    while True:
        for _ in range(LEVELS):
            url = F.try_variant_get("v", "$.url", "string")
            hit = level.where(F.trim(url) != "").select(url.alias("url"), F.to_json("v").alias("record"))
            out = hit if out is None else out.unionByName(hit)
            kids = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.map_values(F.try_variant_get("v", "$", "map<string,variant>")))
            level = level.select(F.explode(kids).alias("v"))
        level = durable(level)
        if level.isEmpty():
            return out


def page_rows(df: DataFrame, variant: str = "doc") -> DataFrame:
    """Pages of unknown shape as rows: title, url, status (upper case), role, book (spaces as underscores), score, categories (a list from a list, or from "a, b"), type, reason. A field is the first of its names that isn't null or empty, on the page or else in the object within it that holds its review."""
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    at = lambda v, k, t: F.try_variant_get(v, f"$['{k}']", t)
    inner = F.coalesce(*(F.when(kind(at(variant, k, "variant")) == "OBJECT", at(variant, k, "variant")) for k in V.NESTED_FIELDS))
    rows = df.withColumn("inner of page", inner)
    text = lambda f: strip(F.coalesce(*(F.nullif(at(v, k, "string"), F.lit("")) for v in (variant, "inner of page") for k in V.PAGE_FIELDS[f])))
    some = F.coalesce(*(F.when(at(v, k, "string") != "", at(v, k, "variant")) for v in (variant, "inner of page") for k in V.PAGE_FIELDS["categories"]))
    parts = F.when(kind(some) == "ARRAY", F.transform(F.variant_get(some, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))).when(kind(some) == "STRING", F.split(F.variant_get(some, "$", "string"), ",")).otherwise(F.array(F.try_variant_get(some, "$", "string")))
    categories = F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: x != "")
    score = F.coalesce(*(at(v, k, "double") for v in (variant, "inner of page") for k in V.PAGE_FIELDS["score"]))
    return rows.select(
        text("title").alias("title"), text("url").alias("url"), F.upper(text("status")).alias("status"), F.lower(text("role")).alias("role"), F.replace(F.lower(text("book")), F.lit(" "), F.lit("_")).alias("book"),
        score.alias("score"), categories.alias("categories"), F.lower(text("type")).alias("type"), text("reason").alias("reason"),
    )


def pdf_status(content: Column, error: Column | None = None, wanted: Column | None = None) -> Column:
    """What became of a download: by decision, error and the first bytes."""
    magic = F.hex(F.substring(content, 1, 4)) == "25504446"
    out = F.when(F.lit(False) if wanted is None else ~wanted, "SKIPPED_NOT_KEEP_FILE")
    if error is not None:
        out = out.when(error.isNotNull(), "FAILED")
    return out.when(content.isNull(), "FAILED").when(~magic, "NOT_A_PDF").otherwise("DOWNLOADED")


def binary_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files with digest and status; the bytes are read where the digest is computed and not kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), pdf_status(F.col("content")).alias("status"))


def page_texts(native: Column, recognised: Column, least: int = 30) -> Column:
    """A page's own text if there is enough, else the recognised one: struct of source and text."""
    own = F.length(F.trim(F.coalesce(native, F.lit("")))) >= least
    return F.struct(F.when(own, "native").otherwise("ocr").alias("source"), F.when(own, native).otherwise(F.coalesce(recognised, F.lit(""))).alias("text"))


def write_envelope(rows: DataFrame, path: str, source: str, stage: str, **counts: Column) -> None:
    """Rows as Parquet and, beside them, one JSON row of source, stage and counts."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("n_rows"), *(c.alias(k) for k, c in counts.items())).select(F.lit(source).alias("source"), F.lit(stage).alias("stage"), "*").write.mode("overwrite").json(f"{path}/envelope")


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header, one file: for reports that people read, which are small."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, name: str, version: str) -> None:
    """Makes a pointer name a version: written aside, then renamed."""
    aside, fs = _files(spark, f"{path}/_{name}.{version}")
    out = fs.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    target, _ = _files(spark, f"{path}/_{name}")
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(f"{path}: the pointer {name} couldn't be moved")


def version_of(spark: SparkSession, path: str, name: str = "current") -> str | None:
    """The version that a pointer names; null before the first promotion."""
    at, fs = _files(spark, f"{path}/_{name}")
    if not fs.exists(at):
        return None
    file = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def promote(rows: DataFrame, path: str, version: str, key: str | None = None) -> DataFrame:
    """Writes rows as a new version, checks it as read back (all rows there, with `key` each once and none null), and only then lets `current` name it; what was current before is the backup, `previous`. Versions are never overwritten, so a promotion that fails leaves readers what they had."""
    spark, target = rows.sparkSession, f"{path}/version={version}"
    at, fs = _files(spark, target)
    if fs.exists(at):
        raise ValueError(f"{target} exists")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(target)
    again = spark.read.parquet(target)
    keyed = [F.lit(True)] if key is None else [F.count_distinct(key) == F.count("*")]
    n, unique = again.agg(F.count("*"), *keyed).first()
    if n != seen.get["n"] or not unique:
        fs.delete(at, True)
        raise ValueError(f"{target}: {n} rows of {seen.get['n']}" + ", keys aren't unique" * (not unique))
    before = version_of(spark, path)
    if before is not None:
        _point(spark, path, "previous", before)
    _point(spark, path, "current", version)
    return again


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the version that is current."""
    return spark.read.parquet(f"{path}/version={version_of(spark, path)}")


def rolled_back(spark: SparkSession, path: str) -> DataFrame:
    """Makes the backup current again; the two change places."""
    now, before = version_of(spark, path), version_of(spark, path, "previous")
    if before is None:
        raise ValueError(f"{path} has no backup")
    _point(spark, path, "current", before)
    _point(spark, path, "previous", now)
    return current(spark, path)


def file_category(name: Column) -> Column:
    """What a stage's file is, by its name: exact names first, then a prefix."""
    known = {"_sections.json": "SECTIONS", "_selected_sections.json": "SECTIONS", "_content_targets.json": "TARGETS", "_pages_reviewed.json": "PAGES", "_knowledge_refined.json": "PAGES", "_knowledge_books.json": "BOOKS", "_actions_registry.json": "ACTIONS", "_knowledge_base.json": "KNOWLEDGE_BASE", "_pdf_downloads.json": "DOWNLOADS", "_pdf_duplicates.json": "DUPLICATES"}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(table, name), F.when(name.startswith("_pdf_knowledge_"), "PDF_KNOWLEDGE"), F.lit("OTHER"))
