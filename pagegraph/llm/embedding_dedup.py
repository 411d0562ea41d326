"""Embedding near-dedup: int8 tile products with per-vector error bounds.

Within a label the distinct vectors are dealt into tiles of bounded size; every pair of tiles is one task, so no
task holds more than two tiles whatever the label's size. Vectors are scaled to unit length and rounded to int8,
and each knows the exact length of its rounding error. By Cauchy-Schwarz the product of two rounded vectors is
off by at most e_x + (1 + e_x) e_y: most pairs are decided by the int8 product alone and only those within that
bound of the threshold are computed again in double precision. A task returns link counts and a spanning forest
of its links, not the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

THRESHOLD = 0.98
TILE = 2048
ROUNDING = 1e-6  #: more than single-precision products and scaling can add to the bound


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scale and error length of unit vectors (rows, double precision)."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """Mask of the pairs with cosine >= threshold, and how many of them were computed in full."""
    (qx, sx, ex), (qy, sy, ey) = quantise(x), quantise(y)
    # int8 products are exact in single precision: 127 * 127 * 1040 components stay below 2^24
    blocks = [qx[:, i : i + 1024].astype(np.float32) @ qy[:, i : i + 1024].astype(np.float32).T for i in range(0, x.shape[1], 1024)]
    rough = sum(b.astype(np.float64) for b in blocks) if len(blocks) > 1 else blocks[0]
    rough = rough * sx[:, None] * sy
    bound = ex[:, None] + (1 + ex[:, None]) * ey + ROUNDING
    mask = rough - bound >= threshold
    i, j = np.nonzero((rough + bound >= threshold) & ~mask)
    for k in range(0, len(i), 65536):
        a, b = i[k : k + 65536], j[k : k + 65536]
        mask[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
    return mask, len(i)


def _forest(mask: np.ndarray) -> np.ndarray:
    """Least reachable row number for a symmetric mask; every row of the mask is read once."""
    root, left = np.arange(len(mask)), mask.any(axis=1)
    for i in range(len(mask)):
        if not left[i]:
            continue
        front = np.array([i])
        left[i] = False
        while len(front):
            root[front] = i
            front = np.flatnonzero(mask[front].any(axis=0) & left)
            left[front] = False
    return root


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, they have as many components, and their cosine is at
    least ``threshold``. Null, empty and zero vectors and those with null or non-finite components link with
    nothing. Equal vectors (by value) are compared as one and counted as many; rows that repeat a vec_id are vectors of
    their own; a tie at the threshold links. Other columns are ignored, whatever their names. An empty table gives an
    empty result. The work is quadratic in a label's distinct vectors, in tasks of two tiles.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))
    for seed in range(99):  # another hash, should different vectors ever have the same one
        rows = vectors.select("vec_id", "embedding", "label")
        rows = rows.withColumn("node", F.when(usable, F.xxhash64(F.lit(seed), "label", F.size("embedding"), "embedding")))
        nodes = rows.where("node is not null").groupBy("node", "label", "embedding").agg(F.count("*").alias("copies"))
        nodes = cut(nodes.withColumn("dim", F.size("embedding")))
        if nodes.groupBy("node").count().where("count > 1").isEmpty():
            break
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "dim", F.least("t", "s").alias("i"), F.greatest("t", "s").alias("j"), (F.col("t") > F.col("s")).alias("second"), "node", "copies", "embedding")

    def compare(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        second = t.column("second").to_numpy()
        x = t.column("embedding").combine_chunks()
        x = unit(np.asarray(x.flatten(), dtype=np.float64).reshape(-1, dim))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a, b = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        full = np.zeros((len(x), len(x)), bool)
        if len(a) and len(b):
            mask, _ = linked(x[a], x[b], threshold)
            if same:
                mask = np.triu(mask, 1)
                full = mask | mask.T
            else:
                full[np.ix_(a, b)] = mask
                full[np.ix_(b, a)] = mask.T
        n = full @ copies
        root = _forest(full)
        touched, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(x)))
        nothing = pa.nulls(len(touched), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([node[touched], node[moved]]), pa.int64()),
            "b": pa.chunked_array([nothing, pa.array(node[root[moved]], pa.int64())]).combine_chunks(),
            "n": pa.chunked_array([pa.array(n[touched], pa.int64()), pa.nulls(len(moved), pa.int64())]).combine_chunks(),
        })

    found = cut(dealt.groupBy("label", "dim", "i", "j").applyInArrow(compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    roots = components(found.where("b is not null").select("a", "b"))
    nodes = nodes.select("node", "copies").join(counts, "node", "left").join(roots, "node", "left")
    nodes = nodes.select("node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    out = rows.select("vec_id", "node").join(nodes, "node", "left")
    least = out.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = out.join(least, "root", "left").withColumn("component_id", F.coalesce("component_id", "vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT c.a AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, c.a = c.m AS kept FROM (SELECT a, min(b) AS m FROM r GROUP BY 1) c LEFT JOIN n ON n.a = c.a
"""
