"""Vector search and history recollection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import scalar_count, top_k
from ..functions.text import joined

#: Corpus vectors that serve as centres of cells and give each query a first bound: a sample by hash of the id.
PIVOTS = 256
#: Rows that are placed, or given their floors, at once.
BLOCK_ROWS = 8192
#: Such blocks on one side of a pair: rows move as often as the other side has pairs, so more of them mean less to move.
PAIR_BLOCKS = 8
#: Queries of a block whose products with the items of another are held at once.
PRODUCT_ROWS = 256
#: Scores are rounded to six digits; bounds are loosened by more than that.
SLACK = 4e-6
HIT = "query_id long, item_id long, score double"


def _matrix(series) -> np.ndarray:
    return np.array(series.tolist(), dtype=np.float64) if len(series) else np.empty((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)


def _empty(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})


def _best(wanted: pd.DataFrame, items: pd.DataFrame, k: int, normalise: bool, skip_same: bool) -> pd.DataFrame:
    """Top k items at or over its floor per query inside one pair of blocks, ties by item id; ``at`` is the query's place in ``wanted``."""
    if not len(items) or not len(wanted):
        return _empty("query_id", "item_id", "score", "at")
    q, m = _matrix(wanted["embedding"]), _matrix(items["embedding"])
    if normalise:
        q, m = _unit(q), _unit(m)
    item_ids, query_ids, least = items["item_id"].to_numpy(), wanted["query_id"].to_numpy(), wanted["floor"].to_numpy()
    ids, hits, scores, places = [], [], [], []
    # A few queries at a time: the product of two whole blocks would take half a gigabyte.
    for at in range(0, len(q), PRODUCT_ROWS):
        sims = q[at:at + PRODUCT_ROWS] @ m.T
        # Most rows have nothing near their floor and are not looked at again.
        for i in np.flatnonzero(sims.max(1) >= least[at:at + PRODUCT_ROWS] - SLACK):
            s, query_id = np.round(sims[i], 6), query_ids[at + i]
            keep = np.flatnonzero((s >= least[at + i]) & ((item_ids != query_id) | (not skip_same)))
            if len(keep) > k:
                edge = np.partition(s[keep], len(keep) - k)[len(keep) - k]
                keep = keep[s[keep] >= edge]
            keep = keep[np.lexsort((item_ids[keep], -s[keep]))][:k]
            ids.append(np.full(len(keep), query_id))
            hits.append(item_ids[keep])
            scores.append(s[keep])
            places.append(np.full(len(keep), at + i))
    if not ids:
        return _empty("query_id", "item_id", "score", "at")
    return pd.DataFrame({"query_id": np.concatenate(ids), "item_id": np.concatenate(hits), "score": np.concatenate(scores), "at": np.concatenate(places)})


def _best_of_cells(wanted: pd.DataFrame, items: pd.DataFrame, k: int, normalise: bool, skip_same: bool) -> pd.DataFrame:
    """``_best`` of the queries over the ``cells`` that each visits; what a query has found in one cell is its floor in the next."""
    if not len(items) or not len(wanted):
        return _empty("query_id", "item_id", "score")
    visits = wanted["cells"].to_numpy()
    rows, cells = np.repeat(np.arange(len(wanted)), [len(c) for c in visits]), np.concatenate(visits)
    floors, top, found = wanted["floor"].to_numpy().copy(), np.full((len(wanted), k), -np.inf), []
    for cell, held in items.groupby("cell"):
        here = rows[cells == cell]
        if not len(here):
            continue
        hits = _best(wanted.iloc[here].assign(floor=floors[here]), held, k, normalise, skip_same)
        if not len(hits):
            continue
        hits = hits.assign(at=here[hits["at"].to_numpy(dtype=np.int64)])
        found.append(hits)
        at, score = hits["at"].to_numpy(), hits["score"].to_numpy(dtype=np.float64)
        cuts = np.flatnonzero(np.diff(at)) + 1
        for i, s in zip(at[np.concatenate(([0], cuts))], np.split(score, cuts)):
            top[i] = np.sort(np.concatenate((top[i], s)))[-k:]
            floors[i] = max(floors[i], top[i][0])
    if not found:
        return _empty("query_id", "item_id", "score")
    hits = pd.concat(found)
    return hits[hits["score"].to_numpy(dtype=np.float64) >= floors[hits["at"].to_numpy(dtype=np.int64)]][["query_id", "item_id", "score"]]


def _in_blocks(rows: DataFrame, key: str, pivots: DataFrame, block_rows: int, work, schema: str) -> DataFrame:
    """``work(rows of a block, pivots)`` over hash blocks of about ``block_rows`` rows, each beside all pivots."""
    n = F.greatest(F.lit(1), F.ceil(scalar_count(rows) / block_rows)).cast("int")
    left = rows.withColumn("block", F.pmod(F.xxhash64(key), n).cast("int"))
    # Columns of the other side get names of their own: both may come from the same rows.
    right = pivots.select(F.col("item_id").alias("pivot_id"), F.col("embedding").alias("pivot"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(work, schema)


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, *, threshold: float | None = None,
                normalise: bool = True, skip_same: bool = False,
                pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top k of ``corpus(item_id, embedding)`` for ``queries(query_id, embedding)``: (query_id, item_id, score, rank).

    Up to ``pivots`` corpus vectors are centres of cells; every item belongs to its nearest one, and a cell knows the
    largest distance of its items to the centre. A query's k-th best score among the centres, which are items themselves, is a floor
    that its answer cannot fall below. No item of a cell can score more than the centre's score plus the query's length times the
    cell's radius, so a query visits only the cells where that reaches its floor; items of cells that no query visits are
    dropped before they move. Cells stand on shelves of at most about ``PAIR_BLOCKS * block_rows`` items, large cells on several, and queries are cut
    into parts of as many rows: a query goes to a shelf once, with the cells it visits there, and an item to a part once. A cell that holds
    a third of all items is many tasks. Vectors move as they are stored; products are of doubles. One plan, nothing runs before the result is asked for. Vectors that are null or hold nulls
    count as absent; a query without any hit has no row.
    """
    whole = "embedding is not null and not exists(embedding, x -> x is null)"
    floats = all(x.schema["embedding"].dataType == T.ArrayType(T.FloatType(), x.schema["embedding"].dataType.containsNull) for x in (corpus, queries))
    vector = "array<float>" if floats else "array<double>"
    items = corpus.select(F.col("item_id").cast("long").alias("item_id"), F.col("embedding").cast(vector).alias("embedding")).filter(whole)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast(vector).alias("embedding")).filter(whole)
    centres = items.orderBy(F.xxhash64("item_id"), "item_id").limit(max(pivots, 1))

    def centre_matrix(near: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        near = near.sort_values("pivot_id", kind="stable")
        m = _matrix(near["pivot"])
        return near["pivot_id"].to_numpy(), _unit(m) if normalise else m

    def assign(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return _empty("item_id", "embedding", "cell", "far")
        c, m = centre_matrix(near)[1], _matrix(rows["embedding"])
        m = _unit(m) if normalise else m
        square = (m * m).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (m @ c.T)
        cell = square.argmin(1).astype(np.int32)
        return rows[["item_id", "embedding"]].assign(cell=cell, far=np.linalg.norm(m - c[cell], axis=1))

    def floors(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(near):
            return _empty("query_id", "embedding", "length", "near", "floor")
        (ids, c), m = centre_matrix(near), _matrix(rows["embedding"])
        m = _unit(m) if normalise else m
        dots = m @ c.T
        sure = np.where(rows["query_id"].to_numpy()[:, None] == ids[None, :], -np.inf, dots) if skip_same else dots
        least = np.full(len(m), -np.inf)
        if len(ids) >= k:
            least = np.partition(sure, len(ids) - k, axis=1)[:, len(ids) - k] - SLACK
        if threshold is not None:
            least = np.maximum(least, threshold)
        return rows[["query_id", "embedding"]].assign(length=np.linalg.norm(m, axis=1), near=list(dots), floor=least)

    placed = _in_blocks(items, "item_id", centres, block_rows, assign, f"item_id long, embedding {vector}, cell int, far double")
    bounds = _in_blocks(asked, "query_id", centres, block_rows, floors,
                        f"query_id long, embedding {vector}, length double, near array<double>, floor double")
    # Pairs are as large as they may be, but no fewer than tasks.
    side = math.sqrt(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shelf_rows, part_rows = (F.least(F.lit(PAIR_BLOCKS * block_rows), F.greatest(F.lit(1), F.ceil(scalar_count(x) / side))) for x in (items, asked))
    sizes = placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n"))
    # At most one row per centre, so one task may add them up.
    before = F.sum("n").over(W.orderBy("cell")) - F.col("n")
    stood = sizes.select("cell", "far", F.floor(before / shelf_rows).cast("int").alias("first"), F.ceil(F.col("n") / shelf_rows).cast("int").alias("pieces"))
    cells = F.coalesce(stood.agg(F.collect_list(F.struct("cell", "far", "first", "pieces"))).scalar(),
                       F.array().cast("array<struct<cell:int,far:double,first:int,pieces:int>>"))
    parts = F.greatest(F.lit(1), F.ceil(scalar_count(asked) / part_rows)).cast("int")
    reaches = lambda c: F.get("near", c["cell"]) + F.col("length") * c["far"] + SLACK >= F.col("floor")
    bound = bounds.select("*", cells.alias("cells"), F.pmod(F.xxhash64("query_id"), parts).cast("int").alias("part")).select(
        "query_id", "embedding", "floor", "part", F.filter("cells", reaches).alias("reached"))
    shelves = F.array_distinct(F.flatten(F.transform("reached", lambda c: F.sequence(c["first"], c["first"] + c["pieces"] - 1))))
    on_shelf = lambda c: F.col("shelf").between(c["first"], c["first"] + c["pieces"] - 1)
    visits = bound.withColumn("shelf", F.explode(shelves)).select(
        "query_id", "embedding", "floor", "part", "shelf", F.transform(F.filter("reached", on_shelf), lambda c: c["cell"]).alias("cells"))
    visited = bound.select("part", F.explode("reached").alias("c")).select("part", "c.cell", "c.first", "c.pieces").distinct()
    met = placed.join(visited, "cell").select(
        "item_id", "embedding", F.col("cell").alias("cell"),
        (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("pieces"))).cast("int").alias("shelf"), F.col("part").alias("part"))

    def pair(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        return _best_of_cells(wanted, found, k, normalise, skip_same)

    at = ["shelf", "part"]
    partial = met.groupBy(*at).cogroup(visits.groupBy(*at)).applyInPandas(pair, HIT)
    return top_k(partial, ["query_id"], [F.col("score").desc(), F.col("item_id")], k)


def related_chunks(hits: DataFrame, chunks: DataFrame, k: int = 5, **options) -> DataFrame:
    """The k nearest other chunks (item_id, embedding) of every chunk that ``hits(item_id)`` names, once each."""
    named = chunks.join(hits.select("item_id").distinct(), "item_id", "left_semi")
    return vector_topk(chunks, named.withColumnRenamed("item_id", "query_id"), k, skip_same=True, **options)


def familiarity(queries: DataFrame, hits: DataFrame, mean_threshold: float = 0.65,
                entropy_threshold: float = 1.5) -> DataFrame:
    """How well a query's probe scores (query_id, score) know the corpus; no hits means not at all."""
    w = W.partitionBy("query_id")
    shifted = hits.withColumn("_d", F.col("score") - F.min("score").over(w)).withColumn(
        "_sum", F.sum("_d").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    p = F.when(F.col("_sum") == 0, F.lit(1.0) / F.col("_n")).otherwise(F.try_divide("_d", "_sum"))
    signal = shifted.withColumn("_p", p).groupBy("query_id").agg(
        F.avg("score").alias("mean"), (-F.sum(F.col("_p") * F.ln(F.col("_p") + 1e-10))).alias("entropy"),
        F.count(F.lit(1)).alias("n"))
    mean, entropy = F.coalesce("mean", F.lit(0.0)), F.coalesce("entropy", F.lit(2.0))
    fam = F.col("mean") * (1 - F.col("entropy") / (F.ln(F.col("n").cast("double")) + 1e-10) * 0.5)
    return queries.select("query_id").join(signal, "query_id", "left").select(
        "query_id", F.round(mean, 6).alias("mean_score"), F.round(entropy, 6).alias("entropy"),
        F.round(F.coalesce(fam, F.lit(0.0)), 6).alias("familiarity"),
        F.coalesce((F.col("mean") >= mean_threshold) & (F.col("entropy") <= entropy_threshold),
                   F.lit(False)).alias("is_familiar"))


def adaptive_route(signals: DataFrame, history_sizes: DataFrame) -> DataFrame:
    """familiar -> direct; otherwise recollection, or plain history when there is too little of it."""
    n = F.coalesce("history_rows", F.lit(0)).cast("long")
    return signals.join(history_sizes, "query_id", "left").select(
        "query_id", "is_familiar", n.alias("history_rows"),
        F.when(F.col("is_familiar"), "direct").when(n < 2, "history_fallback")
        .otherwise("recollection").alias("route"))


def check_embedding_dim(vectors: DataFrame, expected: int) -> DataFrame:
    """Row counts per stored dimension and whether it fits the expected one."""
    return vectors.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "compatible", F.col("dim") == expected)


def keep_compatible(vectors: DataFrame, expected: int) -> DataFrame:
    return vectors.filter(F.size("embedding") == expected)


def mix(query: Column, centroid: Column, alpha: float = 0.6) -> Column:
    return F.zip_with(query, centroid, lambda a, b: a * alpha + b * (1 - alpha))


def alpha_mix_recall(messages: DataFrame, queries: DataFrame, centroids: DataFrame, per_centroid: int = 3,
                     keep: int = 10) -> DataFrame:
    """Contexts recalled by queries blended with the cluster centroids of their own conversation.

    ``messages(conv_id, seq, text, embedding)``, ``queries(conv_id, embedding)``,
    ``centroids(conv_id, cluster, embedding)``; distinct texts in first-seen order.
    """
    probes = queries.select("conv_id", F.col("embedding").alias("_q")).join(centroids, "conv_id").select(
        "conv_id", "cluster", mix(F.col("_q"), F.col("embedding")).alias("_m"))
    near = messages.join(probes, "conv_id").withColumn("score", F.round(F.aggregate(
        F.zip_with(F.col("embedding"), F.col("_m"), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x), 6))
    best = top_k(near, ["conv_id", "cluster"], [F.col("score").desc(), F.col("seq").desc()], per_centroid)
    place = F.col("cluster") * per_centroid + F.col("rank")
    distinct = best.groupBy("conv_id", "text").agg(F.min(place).alias("place"))
    return top_k(distinct, ["conv_id"], [F.col("place")], keep).select("conv_id", "rank", "text")


def enhanced_query(recalled: DataFrame, queries: DataFrame, shown: int = 5) -> DataFrame:
    """First contexts as bullets in front of the question; the bare question without contexts."""
    bullets = recalled.filter(F.col("rank") <= shown).groupBy("conv_id").agg(
        joined("\n", F.concat(F.lit("- "), "text"), "rank").alias("_b"))
    return queries.join(bullets, "conv_id", "left").select("conv_id", F.when(
        F.col("_b").isNull(), F.col("query")).otherwise(F.concat(
            F.lit("Based on our conversation context:\n"), "_b",
            F.lit("\n\nPlease answer the following question considering the above context:\n"), "query")).alias("enhanced"))


def _kmeans(x: np.ndarray, k: int, seed: int, runs: int = 10, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Small Lloyd iteration with spread-out starts, best of several runs."""
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(runs):
        centers = [x[rng.integers(len(x))]]
        while len(centers) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
            centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centers)
        for _ in range(steps):
            lab = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[lab]) ** 2).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, lab, c)
    return best[1], best[2]


def cluster_history(messages: DataFrame, queries: DataFrame, last: int = 20, clusters: int = 3, iterations: int = 3,
                    alpha: float = 0.6, keep: int = 10, seed: int = 42) -> DataFrame:
    """Iterated recollection per conversation over its last messages (conv_id, seq, text, embedding).

    Messages are clustered; each round blends the query with every centroid, recalls three texts per
    blend and re-centres the query on the first three. Groups are bounded by ``last`` rows plus a query.
    """
    recent = top_k(messages, ["conv_id"], [F.col("seq").desc()], last).select("conv_id", "seq", "text", "embedding")
    rows = recent.join(queries.select("conv_id", F.col("embedding").alias("query_embedding")), "conv_id")

    def recall(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, texts = _matrix(pdf["embedding"]), pdf["text"].tolist()
        q, found = np.array(pdf["query_embedding"].iloc[0], dtype=np.float64), []
        k = min(clusters, len(x))
        if k >= 2:  # the history does not change between rounds, so neither do its clusters
            labels, centers = _kmeans(x, k, seed)
            order = sorted(range(k), key=lambda i: int(np.argmax(labels == i)))
        for _ in range(iterations if k >= 2 else 0):
            picks = [i for c in order for i in np.argsort(x @ (alpha * q + (1 - alpha) * centers[c]))[-3:][::-1]]
            found += [texts[i] for i in picks]
            q = x[picks[:3]].mean(0)
        unique = list(dict.fromkeys(found))[:keep]
        return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[0], "rank": range(1, len(unique) + 1), "text": unique})

    return rows.groupBy("conv_id").applyInPandas(recall, "conv_id long, rank int, text string")
