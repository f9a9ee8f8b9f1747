"""Similarity retrieval with exact, named top-k semantics.

Queries against all keys: both are dealt to blocks, and each pair of a query block and a key block is one group of
a cogroup, so neither passes through the driver.  A group multiplies tiles of a bounded size and keeps the best of
the window for every query; what is shuffled then is queries times window times key blocks, never all pairs.

Order is by similarity, ties by the ordinal of the key.  The window is cut before filters that are not
monotone in the similarity (self matches, deleted rows, categories), as its size is part of the semantics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions import vector as V

#: Bytes of vectors in a block of queries or keys, and of scores that a task holds at once (it has some copies of both).
BLOCK_BYTES = 8 << 20
TILE_BYTES = 8 << 20
#: Keys that are scored at a time.
TILE_KEYS = 4096
SCALE = 6


def keys_of(rows: DataFrame, ord_col: str, image: Column, text: Column | None = None, alpha: float = 1.0, metric: str = "cosine") -> DataFrame:
    """ord, vec: hybrid keys, unit length for cosine."""
    if text is not None:
        vec = V.hybrid_key(image, text, alpha)
    else:
        vec = V.normalize(image) if metric == "cosine" else F.transform(image, lambda x: x.cast("double"))
    return rows.select(F.col(ord_col).alias("ord"), vec.alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


FOUND = pa.schema([("query_id", pa.int64()), ("ord", pa.int64()), ("sim", pa.float64())])


def _scores(metric: str, q: np.ndarray, v: np.ndarray):
    """A function from a slice of the keys to the scores of all queries."""
    qq = (q * q).sum(axis=1)

    def of(part: slice) -> np.ndarray:
        k = v[part]
        s = q @ k.T
        return -np.sqrt(np.maximum(qq[:, None] + (k * k).sum(axis=1)[None] - 2 * s, 0)) if metric == "l2" else s

    return of


def _tile_best(window: int, n: int, scores, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ordinals of the best keys of each of n queries."""
    q = range(n)
    top_s, top_o = np.full((len(q), 0), 0.0), np.zeros((len(q), 0), np.int64)
    for i in range(0, len(o), TILE_KEYS):
        s = scores(slice(i, i + TILE_KEYS))
        # ties are decided on rounded scores, so that they do not depend on the order of summation
        s = np.round(np.concatenate((top_s, s), axis=1), 9)
        at = np.concatenate((top_o, np.broadcast_to(o[i : i + TILE_KEYS], (len(q), s.shape[1] - top_s.shape[1]))), axis=1)
        if s.shape[1] > window:
            # everything that is not below the window's last score, then in order
            least = -np.partition(-s, window - 1, axis=1)[:, window - 1]
            keep = max(window, int((s >= least[:, None]).sum(axis=1).max()))
            part = np.argpartition(-s, min(keep, s.shape[1] - 1), axis=1)[:, :keep] if keep < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            s, at = np.take_along_axis(s, part, 1), np.take_along_axis(at, part, 1)
            order = np.lexsort((at, -s), axis=1)[:, :window]
            s, at = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
        top_s, top_o = s, at
    return top_s, top_o


def _block_best(window: int, metric: str):
    def f(queries: pa.Table, keys: pa.Table) -> pa.Table:
        if not queries.num_rows or not keys.num_rows:
            return FOUND.empty_table()
        ids, ords = queries.column("query_id").to_numpy(), keys.column("ord").to_numpy()
        q, v = (_matrix(t.column("vec").combine_chunks()) for t in (queries, keys))
        rows = max(1, TILE_BYTES // (8 * (TILE_KEYS + window)))
        out = []
        for i in range(0, len(ids), rows):
            s, at = _tile_best(window, len(ids[i : i + rows]), _scores(metric, q[i : i + rows], v), ords)
            out.append(pa.table([np.repeat(ids[i : i + rows], s.shape[1]), at.ravel(), s.ravel()], schema=FOUND))
        return pa.concat_tables(out)

    return f


def _dealt(queries: DataFrame, keys: DataFrame, vectors: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the numbers of query and key blocks, each row once for every block of the other side."""
    n = queries.agg(F.count("*"), F.max(F.size("vec"))).first()
    query_blocks = max(1, -(-n[0] // max(1, BLOCK_BYTES // (8 * max(n[1] or 1, 1)))))
    key_bytes = len(vectors) * 8 * (n[1] or 1) * keys.count()
    key_blocks = max(2 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-key_bytes // BLOCK_BYTES))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    q = queries.select("query_id", "vec", block("query_id", query_blocks).alias("qb"), every(key_blocks).alias("kb"))
    k = keys.select("ord", *vectors, block("ord", key_blocks).alias("kb"), every(query_blocks).alias("qb"))
    return q, k


def candidates(queries: DataFrame, keys: DataFrame, window: int, metric: str = "cosine") -> DataFrame:
    """query_id, ord, sim, rank <= window; queries(query_id, vec), keys(ord, vec) as keys_of makes them.

    Query blocks hold BLOCK_BYTES of vectors; key blocks follow spark.sql.shuffle.partitions and hold no more either.
    """
    q, k = _dealt(queries, keys, ("vec",))
    found = q.groupBy("qb", "kb").cogroup(k.groupBy("qb", "kb")).applyInArrow(_block_best(window, metric), "query_id long, ord long, sim double")
    return ranked(found, window)


def _grid_best(window: int, alphas: tuple[float, ...]):
    def f(queries: pa.Table, keys: pa.Table) -> pa.Table:
        schema = pa.schema([("alpha", pa.float64()), *FOUND])
        if not queries.num_rows or not keys.num_rows:
            return schema.empty_table()
        ids, ords = queries.column("query_id").to_numpy(), keys.column("ord").to_numpy()
        q, image, text = (_matrix(t.column(c).combine_chunks()) for t, c in ((queries, "vec"), (keys, "image"), (keys, "text")))
        ii, it, tt = (image * image).sum(axis=1), (image * text).sum(axis=1), (text * text).sum(axis=1)
        rows = max(1, TILE_BYTES // (8 * (TILE_KEYS + window) * 3))
        out = []
        for i in range(0, len(ids), rows):
            # both products once for each tile of keys; every alpha mixes them and divides by the length of its key
            tiles = {k: (q[i : i + rows] @ image[k : k + TILE_KEYS].T, q[i : i + rows] @ text[k : k + TILE_KEYS].T) for k in range(0, len(ords), TILE_KEYS)} if len(ords) <= TILE_KEYS else None
            for a in alphas:
                norm = np.sqrt(np.maximum(a * a * ii + 2 * a * (1 - a) * it + (1 - a) ** 2 * tt, 0))
                norm[norm == 0] = 1

                def of(part: slice, a=a, norm=norm, i=i, tiles=tiles) -> np.ndarray:
                    x, y = tiles[part.start] if tiles else (q[i : i + rows] @ image[part].T, q[i : i + rows] @ text[part].T)
                    return (a * x + (1 - a) * y) / norm[None, part]

                s, at = _tile_best(window, len(ids[i : i + rows]), of, ords)
                out.append(pa.table([np.full(s.size, a), np.repeat(ids[i : i + rows], s.shape[1]), at.ravel(), s.ravel()], schema=schema))
        return pa.concat_tables(out)

    return f


def hybrid_grid(queries: DataFrame, keys: DataFrame, alphas: tuple[float, ...], window: int) -> DataFrame:
    """alpha, query_id, ord, sim, rank <= window for every alpha; queries(query_id, vec) are unit vectors, keys(ord, image, text) raw ones.

    Vectors are dealt to blocks once and multiplied once for all alphas.
    """
    q, k = _dealt(queries, keys, ("image", "text"))
    found = q.groupBy("qb", "kb").cogroup(k.groupBy("qb", "kb")).applyInArrow(_grid_best(window, tuple(alphas)), "alpha double, query_id long, ord long, sim double")
    w = Window.partitionBy("alpha", "query_id").orderBy(F.desc("sim"), "ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= window)


def ranked(rows: DataFrame, k: int, by: str = "sim") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(queries: DataFrame, keys: DataFrame, k: int = 2, threshold: float | None = 0.1, over: int = 10, keep: Column | None = None, attributes: DataFrame | None = None, metric: str = "cosine") -> DataFrame:
    """Best k of the k + over nearest that pass `keep` and the threshold; ranks count anew.

    keep is a condition over query_id, ord, sim and the columns of attributes(ord, ...), joined to the window.
    """
    rows = candidates(queries, keys, k + over, metric)
    if attributes is not None:
        rows = rows.join(attributes, "ord", "left")
    if keep is not None:
        rows = rows.where(keep)
    if threshold is not None:
        rows = rows.where(F.col("sim") >= threshold)
    return ranked(rows, k)


def nearest(queries: DataFrame, keys: DataFrame, threshold: float = 0.0) -> DataFrame:
    """The nearest key of each query (null without one), for duplicate detection."""
    best = candidates(queries, keys, 1).where(F.col("sim") >= threshold).select("query_id", F.col("ord").alias("neighbour"), "sim")
    return queries.select("query_id").join(best, "query_id", "left")


def duplicate_action(sim: Column, remain: float = 0.85, merge: float = 0.70) -> Column:
    return F.when(sim >= remain, "REMAIN").when(sim >= merge, "MERGE").otherwise("ADD")


def by_category(queries: DataFrame, keys: DataFrame, attributes: DataFrame, category: Column, k: int = 2, threshold: float = 0.2, spread: int = 2) -> DataFrame:
    """A window of spread * k, then the category: fewer than k rows may be left although more match."""
    return top_k(queries, keys, k, threshold, over=(spread - 1) * k, keep=category, attributes=attributes)


def hybrid_mode(queries: DataFrame, keys: DataFrame, attributes: DataFrame, category: Column, meta: Column, k: int = 2, threshold: float = 0.2) -> DataFrame:
    """Vector results for 3k (a window of 6k, category first), then the other filters, then k."""
    rows = by_category(queries, keys, attributes, category, 3 * k, threshold)
    return ranked(rows.where(meta).drop("rank"), k)


def recent(rows: DataFrame, k: int, start=None, end=None, category: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """The k newest of rows(ord, created_at, ...) in an inclusive time range, with score 1; ranks keep gaps where a row has no file."""
    for bound, test in ((start, F.col("created_at") >= start), (end, F.col("created_at") <= end)):
        rows = rows if bound is None else rows.where(test)
    rows = rows if category is None else rows.where(category)
    top = rows.orderBy(F.desc("created_at"), "ord").limit(k)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), "ord"))).withColumn("score", F.lit(1.0))
    return out if files is None else out.join(files, "ord", "left_semi")


def at_path(meta: Column, path: str) -> Column:
    """The value at a dotted path of a variant (null if a step is missing), as text."""
    return F.try_variant_get(meta, "$" + "".join(f'["{p}"]' for p in path.split(".")), "string")


def matches(meta: Column, wanted: dict[str, object]) -> Column:
    """Whether every dotted path of `wanted` is there and has that value."""
    ok = F.lit(True)
    for path, value in wanted.items():
        text = str(value).lower() if isinstance(value, bool) else str(value)
        ok = ok & F.coalesce(at_path(meta, path) == F.lit(text), F.lit(False))
    return ok


def first_matching(rows: DataFrame, condition: Column, k: int) -> DataFrame:
    return rows.where(F.coalesce(condition, F.lit(False))).orderBy("ord").limit(k)


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids(query_id, ids); rank is the place in the list, with gaps for missing ones."""
    return ids.select("query_id", F.posexplode("ids").alias("rank", "ord")).join(rows, "ord")


def within_budget(results: DataFrame, tokens: str, budget: int, order: list[str] | None = None) -> DataFrame:
    """The results of each query up to the first that overflows the budget; total_tokens includes that one."""
    order = order or ["rank"]
    w = Window.partitionBy("query_id").orderBy(*order)
    rows = results.withColumn("cum", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.coalesce(F.min(F.when(F.col("cum") > budget, F.col("cum"))).over(Window.partitionBy("query_id")), F.max("cum").over(Window.partitionBy("query_id")))
    return rows.withColumn("total_tokens", total).where(F.col("cum") <= budget)


def prepared_context(hits: DataFrame, memories: DataFrame, *columns: str, most: int = 5) -> DataFrame:
    """query_id, n_found, memories: the first `most` hits of each query as structs of rank, ord, sim and columns of memories(ord, ...), in order.

    n_found counts all hits; a hit whose memory is gone is left out of the structs, and its place stays empty.
    """
    first = hits.where(F.col("rank") <= most).join(memories.select("ord", *columns), "ord")
    context = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "ord", "sim", *columns))).alias("memories"))
    found = hits.groupBy("query_id").agg(F.count("*").alias("n_found"))
    return found.join(context, "query_id", "left")


def exists(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The distinct keys of `asked`, and whether rows have them."""
    return asked.select(key).distinct().join(rows.select(key, F.lit(True).alias("there")).distinct(), key, "left").withColumn("there", F.coalesce("there", F.lit(False)))
