"""Probes and reports over results: watched ranks, recall, samples, answers in words, consistency of stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnweave.operators.dedup import placed
from tarnweave.operators.profile import rows_at
from tarnweave.operators.vector import MOST_DISTANCE


def watched(candidates: DataFrame, watch: Column, most: float = MOST_DISTANCE) -> DataFrame:
    """For each query: the best rank of a watched row, its distance, and whether the threshold lets it pass."""
    best = candidates.where(watch).groupBy("query_id").agg(F.min_by(F.struct("rank_no", "distance"), "rank_no").alias("b"))
    return best.select("query_id", F.col("b.rank_no").alias("rank_no"), F.col("b.distance").alias("distance"), F.when(F.col("b.distance") <= most, "PASS").otherwise("FILTERED").alias("verdict"))


def recall(results: DataFrame, **wanted: Column) -> DataFrame:
    """One row: how many results over all paraphrases, how many different ones, and whether each wanted thing is among them."""
    return results.agg(F.count("*").alias("n_results"), F.count_distinct("vec_id").alias("n_different"), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in wanted.items()))


def every_nth(df: DataFrame, order: list[str], size: int, step: int, n: int) -> DataFrame:
    """Of `size` rows in order, every step-th, at most n. Places are counted per partition, so no task sorts all rows."""
    place = F.col("place of row")
    return placed(df, order, "place of row").where((place < min(size, step * (n - 1) + 1)) & (place % step == 0)).drop("place of row")


def first_middle_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key's rows in order the first, the middle (of an even number, the upper one) and the last, each once; `sample` says which."""
    n = F.col("n")
    half = F.call_function("div", n, F.lit(2))
    return rows_at(df, keys, [order], {"first": F.lit(0), "middle": F.when(half > 0, half), "last": F.when((n > 1) & (n - 1 != half), n - 1)}, "sample")


def answer_line(program: Column, campus: Column, category: Column, minimum: Column, own: Column) -> Column:
    """A record, and how a student's aggregate compares, in words."""
    base = F.format_string("%s (%s, %s): closing merit %.5f", program, campus, category, minimum)
    diff = F.format_string("; your aggregate %.5f is %s by %+.5f", own, F.when(own >= minimum, "above").otherwise("below"), own - minimum)
    return F.when(own.isNull(), base).otherwise(F.concat(base, diff))


def hash_eligible(downloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Downloaded files with a local path, and the others with the reason."""
    ok = (F.col("status") == "DOWNLOADED") & (F.coalesce(F.col("local_path"), F.lit("")) != "")
    reason = F.when(F.col("status") != "DOWNLOADED", F.concat(F.lit("status "), F.col("status"))).otherwise("missing file")
    return downloads.where(ok), downloads.where(~F.coalesce(ok, F.lit(False))).withColumn("dedup_error", reason)


def all_urls(documents: DataFrame) -> DataFrame:
    """A canonical document's own address, then its aliases'."""
    return documents.withColumn("all_urls", F.array_distinct(F.concat(F.array("canonical_url"), F.coalesce(F.transform("aliases", lambda a: a["url"]), F.array().cast("array<string>")))))


def stage_coverage(key: str, **stages: DataFrame) -> DataFrame:
    """Each key with the stages that have it, as a string of names: one union and one aggregate for any number of stages."""
    rows = None
    for name, df in stages.items():
        part = df.select(key).distinct().withColumn("stage", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("stages"))


def same_first_text(pages: DataFrame, file: str, page: str, text: str) -> DataFrame:
    """One row: whether all files begin with the same text."""
    first = pages.groupBy(file).agg(F.min_by(F.trim(text), page).alias("first"))
    return first.agg(F.count("*").alias("n_files"), (F.count_distinct("first") <= 1).alias("identical"))


def capped_links(links: DataFrame, page: str, order: str, kind: str, cap: int = 200) -> DataFrame:
    """Each page's links until the `cap`-th internal one; what follows it is left out, whatever its kind."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col(kind) == "page", 1).otherwise(0)).over(w), F.lit(0))
    return links.withColumn("before", before).where(F.col("before") < cap).drop("before")


def embedded(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32, name: str = "embedding") -> DataFrame:
    """A vector of unit length for each text, by a model that each worker loads once. The model comes from the caller; none is shipped."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} array<double>"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = model()
        for pdf in parts:
            for lo in range(0, len(pdf), batch):
                some = pdf.iloc[lo : lo + batch].copy()
                vectors = encode(some[text].fillna("").tolist())
                some[name] = [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in vectors]
                yield some

    return df.mapInPandas(run, schema)


def extracted(files: DataFrame, reader: Callable[[bytes], list[tuple[str, str]]], content: str = "content", key: str = "path") -> DataFrame:
    """Pages of binary documents by a reader that the caller gives (bytes to (source, text) of each page): key, page, source, text. A file that can't be read gives no page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, data in zip(pdf[key], pdf[content], strict=True):
                try:
                    pages = [] if data is None else reader(bytes(data))
                except ValueError:
                    pages = []
                yield pd.DataFrame([(k, n, s, t) for n, (s, t) in enumerate(pages, 1)], columns=[key, "page", "source", "text"])

    return files.select(key, content).mapInPandas(run, f"{key} string, page int, source string, text string")


def shrinking(attempt: Callable[[int], str], sizes: tuple[int, ...] = (1600, 1280, 960, 640)) -> tuple[int, str]:
    """Tries sizes from large to small until one fits in memory: the size used and the result."""
    for size in sizes:
        try:
            return size, attempt(size)
        except MemoryError:
            if size == sizes[-1]:
                raise
    raise ValueError("no sizes")
