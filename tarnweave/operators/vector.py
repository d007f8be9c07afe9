"""Vector retrieval: exact distances, thresholds, diversification, confidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarnweave.functions.classify import confidence
from tarnweave.functions.text import strip
from tarnweave.operators.durable import durable

CANDIDATES, RESULTS, MOST_DISTANCE, PER_SOURCE = 20, 8, 0.78, 4  # fixed values
#: Rows and queries that meet in one task, and distances that it holds at a time.
ROWS, QUERIES, CELLS = 1 << 15, 1 << 12, 1 << 21


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def _known(x: pa.ChunkedArray) -> tuple[pa.ListArray, np.ndarray]:
    """Vectors, and the length of each; -1 for those that are null or hold a null, from which there is no distance."""
    x = x.combine_chunks()
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    length = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if x.flatten().null_count:
        length[pc.list_parent_indices(x).to_numpy()[pc.is_null(x.flatten()).to_numpy(zero_copy_only=False)]] = -1
    return x, length


def _matrix(x: pa.ListArray, at: np.ndarray, length: int) -> np.ndarray:
    return x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)


def _summed(x: np.ndarray, q: np.ndarray, ri: np.ndarray, qi: np.ndarray, places: int | None) -> np.ndarray:
    """Distances of pairs as squared_distance adds them up, one place after the other; rounded half up to so many places."""
    d = np.zeros(len(ri))
    with np.errstate(invalid="ignore", over="ignore"):
        for j in range(x.shape[1]):
            e = x[ri, j] - q[qi, j]
            d += e * e
        if places is None:
            return d
        scaled = d * 10.0**places
        whole = np.floor(scaled)
        return (whole + (scaled - whole >= 0.5)) / 10.0**places


def _best(rows: pa.Table, queries: pa.Table, k: int, id_col: str, vector: str, skip_self: bool, places: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, ties by id: places of queries, places of rows, distances, and whether there is none.

    A product of matrices gives distances up to its rounding; what this leaves open among the best is added up exactly.
    """
    x, x_len = _known(rows[vector])
    q, q_len = _known(queries["query_vector"])
    code = pc.rank(rows[id_col], sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    own, asked = (t.to_numpy() if skip_self else None for t in (rows[id_col], queries["query_id"]))
    most = k + int(np.bincount(code).max()) if skip_self else k
    found = []

    def keep(qi, ri, d, none):
        if skip_self:
            other = own[ri] != asked[qi]
            qi, ri, d, none = qi[other], ri[other], d[other], none[other]
        order = np.lexsort((code[ri], d, none, qi))
        qi, ri, d, none = qi[order], ri[order], d[order], none[order]
        first = np.r_[True, qi[1:] != qi[:-1]] if len(qi) else np.zeros(0, bool)
        nth = np.arange(len(qi)) - np.maximum.accumulate(np.where(first, np.arange(len(qi)), 0))
        found.append((qi[nth < k], ri[nth < k], d[nth < k], none[nth < k]))

    for length in np.unique(q_len):
        q_at, x_at = np.flatnonzero(q_len == length), np.flatnonzero(x_len == length) if length >= 0 else np.zeros(0, np.int64)
        qs, xs = _matrix(q, q_at, length) if length >= 0 else np.zeros((len(q_at), 0)), _matrix(x, x_at, max(length, 0))
        with np.errstate(invalid="ignore", over="ignore"):
            q2, x2 = (qs * qs).sum(1), (xs * xs).sum(1)
        finite = np.flatnonzero(x2 < 1e300)
        # What isn't finite, or has no distance, comes last: it counts only where the rest is too few.
        plain = (q2 < 1e300) & (length >= 0) & (len(finite) == len(x_len) or len(finite) >= most)
        near, n2 = xs[finite], x2[finite]
        step = max(1, CELLS // max(1, len(finite)))
        fast = np.flatnonzero(plain)
        for at in (fast[i : i + step] for i in range(0, len(fast), step)):
            if not len(finite):
                continue
            g = (n2[None, :] - 2 * (qs[at] @ near.T)) + q2[at][:, None]
            if len(finite) > most:
                slack = 8 * (length + 8) * 2.3e-16 * (q2[at] + n2.max()) + (0 if places is None else 10.0**-places)
                qi, ri = np.nonzero(g <= (np.partition(g, most - 1, axis=1)[:, most - 1] + slack)[:, None])
            else:
                qi, ri = (m.ravel() for m in np.indices(g.shape))
            keep(q_at[at[qi]], x_at[finite[ri]], _summed(near, qs, ri, at[qi], places), np.zeros(len(qi), bool))
        for at in np.flatnonzero(~plain):
            d, none = np.zeros(len(x_len)), np.ones(len(x_len), bool)
            if length >= 0:
                d[x_at], none[x_at] = _summed(xs, qs, np.arange(len(x_at)), np.full(len(x_at), at), places), False
            keep(np.full(len(x_len), q_at[at]), np.arange(len(x_len)), d, none)
    return tuple(np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 4))


def compared(rows: DataFrame, asked: DataFrame, keys: list[str], n_groups: int, k: int, id_col: str, vector: str, skip_self: bool, places: int | None, spare: tuple[str, ...] = ()) -> DataFrame:
    """For each group of `keys` its k nearest rows for each of its queries (query_id, query_vector), with distance. With reach (rows), far and bound (queries), what the triangle inequality rules out for all queries of a group is left out.

    Groups are as large as a task can hold; what a task returns of one is k rows a query.
    """
    some = [F.col(id_col).isNotNull(), F.col("query_id").isNotNull()] if skip_self else [F.lit(True), F.lit(True)]
    shown = [c for c in rows.columns if c not in (vector, "reach", *keys, *spare)]
    fields = StructType([rows.schema[c] for c in shown] + [asked.schema["query_id"], StructField("distance", DoubleType())])

    def met(own: pa.Table, queries: pa.Table) -> pa.Table:
        if "bound" in queries.column_names and own.num_rows and queries.num_rows:
            far, bound = queries["far"].to_numpy(), pc.fill_null(queries["bound"], np.inf).to_numpy() + 1e-6
            reach = own["reach"].to_numpy()
            order = np.sort(reach)
            queries = queries.filter(pa.array(np.searchsorted(order, far + bound, "right") > np.searchsorted(order, far - bound, "left")))
            own = own.filter(pa.array((reach >= (far - bound).min()) & (reach <= (far + bound).max())))
        names = [*shown, "query_id", "distance"]
        if not own.num_rows or not queries.num_rows:
            return own.select(shown).slice(0, 0).append_column("query_id", queries["query_id"].slice(0, 0)).append_column("distance", pa.array([], pa.float64()))
        qi, ri, d, none = _best(own, queries, k, id_col, vector, skip_self, places)
        columns = [*own.select(shown).take(pa.array(ri)).columns, queries["query_id"].take(pa.array(qi)), pa.array(d, mask=none)]
        return pa.table(dict(zip(names, columns)))

    n = min(2 * n_groups, 2000)
    left, right = rows.where(some[0]).repartition(n, *keys), asked.where(some[1]).repartition(n, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, fields)


def ranked(pairs: DataFrame, k: int, id_col: str) -> DataFrame:
    """Each query's k nearest, ties by id, numbered."""
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), id_col)
    return pairs.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def blocked(queries: DataFrame, n_blocks: int) -> DataFrame:
    """Queries with the number of their block (block)."""
    return queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))


def _each(n: Column | int) -> Column:
    """Numbers from 0, n of them, a row each."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", skip_self: bool = True, block: int = QUERIES, places: int | None = None) -> DataFrame:
    """The k nearest rows of vectors for each query (column query_id): exact, ties by id; with distance and rank_no. Distances that are rounded to `places` are so before they are compared.

    Every row meets every query, in groups of about ROWS rows and `block` queries: a task's memory is bounded, and nothing passes through the driver.
    """
    n_parts, n_blocks = (max(1, -(-df.count() // n)) for df, n in ((vectors, ROWS), (queries, block)))
    rows = vectors.select("*", F.pmod(F.xxhash64(id_col), F.lit(n_parts)).alias("part of rows"), _each(n_blocks).alias("block"))
    asked = blocked(queries.select("query_id", F.col(vector).alias("query_vector")), n_blocks).select("*", _each(n_parts).alias("part of rows"))
    return ranked(compared(rows, asked, ["part of rows", "block"], n_parts * n_blocks, k, id_col, vector, skip_self, places), k, id_col)


def trained_centroids(vectors: DataFrame, n_lists: int, id_col: str = "vec_id", vector: str = "embedding", sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Centres for an index, by k-means over the `sample` rows with the smallest hashes of their ids: a bounded sample, which decides how fast searches are and not what they find."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.xxhash64(id_col).alias("h"), vector).orderBy("h", vector).limit(sample).collect()
    points = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
    if len(points) <= n_lists:
        return points
    centres = points[:n_lists].copy()
    for _ in range(rounds):
        nearest_of = _squared(points, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, nearest_of, points)
        n = np.bincount(nearest_of, minlength=n_lists)[:, None]
        centres = np.where(n > 0, total / np.maximum(n, 1), centres)
    return centres


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1), 0)


def indexed(vectors: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """Every vector with the list of its nearest centre (list_no) and its distance from it (reach). Written partitioned or bucketed by list_no, it is the index. Null vectors have no list."""

    @F.pandas_udf("struct<list_no:int,reach:double>")
    def listed(x: pd.Series) -> pd.DataFrame:
        d = np.sqrt(_squared(np.stack(x.to_numpy()).astype(np.float64), centres))
        return pd.DataFrame({"list_no": d.argmin(1).astype(np.int32), "reach": d.min(1)})

    return vectors.where(F.col(vector).isNotNull()).withColumn("listed", listed(vector)).select("*", "listed.*").drop("listed")


def nearest_indexed(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", skip_self: bool = True, n_probe: int = 2, places: int | None = None) -> DataFrame:
    """What `nearest` gives, from an index: the lists of a query's `n_probe` nearest centres first; then those rows of the other lists that the distances from the centres don't rule out, as a row is as far from a query as its distances from a centre differ. Exact, whatever the centres."""

    @F.pandas_udf("array<double>")
    def far(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(_squared(np.stack(x.to_numpy()).astype(np.float64), centres))))

    lists = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("query_vector"), F.posexplode(far(vector)).alias("list_no", "far"))
    order = Window.partitionBy("query_id").orderBy("far", "list_no")
    probes = durable(lists.withColumn("turn", F.row_number().over(order)))
    n_blocks = max(1, -(-probes.where("turn = 1").count() // QUERIES))
    # A row a list; a list of many rows is met in parts.
    many = durable(index.groupBy("list_no").agg(F.ceil(F.count("*") / ROWS).alias("n_parts")))
    n_groups = (many.agg(F.sum("n_parts")).head()[0] or 1) * n_blocks
    rows = index.join(F.broadcast(many), "list_no").select(*index.columns, F.pmod(F.xxhash64(id_col), F.col("n_parts")).alias("part of rows"), _each(n_blocks).alias("block"))

    def scored(part: DataFrame) -> DataFrame:
        asked = blocked(part.join(F.broadcast(many), "list_no"), n_blocks).select("query_id", "query_vector", "list_no", *(c for c in ("far", "bound") if "bound" in part.columns), "block", _each(F.col("n_parts")).alias("part of rows"))
        return ranked(compared(rows, asked, ["list_no", "part of rows", "block"], n_groups, k, id_col, vector, skip_self, places), k, id_col)

    first = durable(scored(probes.where(F.col("turn") <= n_probe)))
    rest = probes.where(F.col("turn") > n_probe).join(bounds(first, k, places), "query_id", "left")
    return ranked(first.unionByName(scored(rest)), k, id_col)


def bounds(first: DataFrame, k: int, places: int | None = None) -> DataFrame:
    """The distance (bound) within which each query's k nearest are; without k rows yet they may be anywhere."""
    return first.groupBy("query_id").agg(F.when(F.count("distance") == k, F.sqrt(F.max("distance") + (0.0 if places is None else 10.0**-places))).alias("bound"))


def within_distance(rows: DataFrame, most: float = MOST_DISTANCE) -> DataFrame:
    return rows.where(F.col("distance").isNotNull() & (F.col("distance") <= most))


def diversified(rows: DataFrame, source: str, id_col: str = "vec_id", per_source: int = PER_SOURCE, n: int = RESULTS) -> DataFrame:
    """The n best of each query, at most `per_source` of one source first; then filled up by the others, which come after. rank_no is the order."""
    nearer = [F.asc_nulls_last("distance"), F.col(id_col)]
    tier = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", source).orderBy(*nearer))).withColumn("tier", (F.col("nth") > per_source).cast("int"))
    ranked = tier.drop("rank_no").withColumn("rank_no", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", *nearer)))
    return ranked.where(F.col("rank_no") <= n).drop("nth", "tier")


def source_key(source_type: Column, pdf_file: Column, url: Column, title: Column) -> Column:
    some = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    return F.when((F.lower(source_type) == "pdf") & some(pdf_file), F.concat(F.lit("pdf::"), pdf_file)).when(some(url), F.concat(F.lit("url::"), url)).when(some(title), F.concat(F.lit("title::"), title)).otherwise("unknown")


def source_reference(source_type: Column, title: Column, url: Column, pdf_file: Column, page: Column) -> Column:
    """Where a result is from, as a struct; a page that is no page is null."""
    return F.struct(strip(source_type).alias("source_type"), strip(title).alias("title"), strip(url).alias("url"), strip(pdf_file).alias("pdf_file"), F.when(page > 0, page.cast("int")).alias("page"))


#: What a result shows of its metadata.
SHOWN = ("source_type", "title", "url", "pdf_file", "book", "quality_flag", "extraction_method", "categories")


def cleaned(rows: DataFrame, id_col: str = "vec_id", text: str = "text") -> DataFrame:
    """Results flat: query_id, rank, id, distance, the stripped metadata (empty where null or lacking), page (0 without one), temporal, text."""
    own = {c.lower() for c in rows.columns}
    some = lambda c: strip(c) if c in own else F.lit("")
    page = F.coalesce(F.col("page").try_cast("int"), F.lit(0)) if "page" in own else F.lit(0)
    temporal = F.coalesce(F.col("temporal").cast("boolean"), F.lit(False)) if "temporal" in own else F.lit(False)
    return rows.select("query_id", F.col("rank_no").alias("rank"), F.col(id_col).alias("id"), "distance", *(some(c).alias(c) for c in SHOWN), page.alias("page"), temporal.alias("temporal"), some(text).alias("text"))


def audited(results: DataFrame, candidates: DataFrame, questions: DataFrame, model: str, prefix: str, most: float = MOST_DISTANCE) -> DataFrame:
    """One audit record for each question: model and prefix, numbers of candidates and results, threshold, confidence, the different sources in order of rank, and the results as JSON. A question's results are few."""
    rows = cleaned(results)
    reference = source_reference(*(F.col(c) for c in ("source_type", "title", "url", "pdf_file", "page")))
    own = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", reference.alias("source"), F.struct(*rows.columns[1:]).alias("result")))).alias("r"), F.min("distance").alias("best"))
    counted = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    out = questions.join(own, "query_id", "left").join(counted, "query_id", "left")
    return out.select(
        "query_id", "question", F.lit(model).alias("embedding_model"), F.lit(prefix).alias("query_prefix"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce(F.size("r"), F.lit(0)).cast("long").alias("final_result_count"),
        F.lit(most).alias("max_distance"), confidence(F.col("best")).alias("confidence"), F.array_distinct(F.transform("r", lambda x: x["source"])).alias("sources"), F.to_json(F.transform("r", lambda x: x["result"])).alias("results"),
    )


def graded(rows: DataFrame) -> DataFrame:
    """Each query's number of results, best distance and confidence."""
    out = rows.groupBy("query_id").agg(F.count("*").alias("n_results"), F.min("distance").alias("best_distance"))
    return out.withColumn("confidence", confidence(F.col("best_distance")))


def retrieve(vectors: DataFrame, queries: DataFrame, source: str, id_col: str = "vec_id") -> DataFrame:
    """The whole retrieval: candidates, threshold, diversification, rank."""
    return diversified(within_distance(nearest(vectors, queries, CANDIDATES, id_col)), source, id_col)


def context_block(rank: Column, title: Column, source_type: Column, pdf: Column, page: Column, url: Column, text: Column) -> Column:
    """A source as it is shown to a language model."""
    line = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{label}: "), x))
    return F.concat_ws("\n", F.concat(F.lit("[SOURCE "), rank.cast("string"), F.lit("]")), line("Title", title), line("Type", source_type), line("PDF", pdf), line("Page", F.when(page > 0, page.cast("string"))), line("URL", url), F.concat(F.lit("EVIDENCE:\n"), text))
