"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors are one class with a multiplicity before anything is hashed. Each table rotates a vector by three rounds
of random signs and a fast Hadamard transform, and hashes it to the largest coordinates' places and signs (two
rotations a table). A vector goes to its own bucket and to its next best ones; two vectors meet when one probes the
other's own bucket. A bucket's members are compared in bounded blocks, by one product of matrices in double precision.
A pair counts in the first table in which it meets, which both sides' hashes tell, so nothing is compared twice in the
result and no pair is ever a row: blocks answer with the links of each vector, counted, and a forest of links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

TABLES, PROBES, LEAST = 8, 8, 0.9
#: Vectors of a side of a block.
BLOCK = 512


def signs(dim: int, tables: int) -> np.ndarray:
    """Random signs of three rounds for two rotations a table."""
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (tables, 2, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the length is a power of 2."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probes(unit: np.ndarray, tables: int = TABLES, count: int = PROBES) -> np.ndarray:
    """rows x tables x count bucket numbers; the first is the vector's own, the others follow by likeness: the sum of
    both rotations' distances from their largest coordinate."""
    width = 1 << max(1, int(np.ceil(np.log2(unit.shape[1]))))
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    near = min(4, 2 * width)
    out = np.empty((len(unit), tables, count), np.int64)
    pair = [(i, j) for i in range(near) for j in range(near)]
    for t, rounds in enumerate(signs(width, tables)):
        places, losses = [], []
        for three in rounds:
            x = padded
            for s in three:
                x = hadamard(x * s)
            both = np.concatenate([x, -x], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(both, top, axis=1)
            places.append(top)
            losses.append((value[:, :1] - value) ** 2)
        loss = np.stack([losses[0][:, i] + losses[1][:, j] for i, j in pair], axis=1)
        code = np.stack([places[0][:, i] * (2 * width) + places[1][:, j] for i, j in pair], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :count]
        out[:, t] = np.take_along_axis(code, best, axis=1)[:, :count]
    return out


def units(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their unit vectors in double precision). Null, empty and zero vectors and those with null
    or non-finite components are not."""
    at, rows = [], []
    for i, v in enumerate(vectors):
        if not v or None in v:
            continue
        x = np.asarray(v, np.float64)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top  # neither overflow nor underflow of squares
            at.append(i)
            rows.append(x / np.sqrt((x * x).sum()))
    return np.array(at, np.int64), rows


def hashed(vectors: DataFrame, tables: int, count: int) -> DataFrame:
    """(id, probes): tables x count bucket numbers of each usable vector, in one array."""

    def run(batches):
        for b in batches:
            ids, at_rows = b.column("id"), units(b.column("embedding").to_pylist())
            by_dim: dict[int, list[int]] = {}
            for k, x in enumerate(at_rows[1]):
                by_dim.setdefault(len(x), []).append(k)
            for dim, some in by_dim.items():
                found = probes(np.stack([at_rows[1][k] for k in some]), tables, count).reshape(len(some), -1)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at_rows[0][some])), pa.array([dim] * len(some), pa.int32()), pa.array(found.tolist(), pa.list_(pa.int64()))],
                    ["id", "dim", "probes"],
                )

    return vectors.mapInArrow(run, "id long, dim int, probes array<long>")


def block_links(group: pa.Table, tables: int, count: int, least: float) -> pa.Table:
    """For one block of a bucket: (a, n, b), n links of a weighted by multiplicity, b one partner or null.

    role 0: vectors whose own bucket this is; role 1: those of the other side. The pair of two own members belongs to
    the block where the smaller one asks."""
    own = group.filter(pa.compute.equal(group.column("role"), 0))
    ask = group.filter(pa.compute.equal(group.column("role"), 1))
    none = pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not own.num_rows or not ask.num_rows:
        return none
    t = group.column("t")[0].as_py()

    def parts(side):
        x = np.stack(units(side.column("embedding").to_pylist())[1])
        p = np.stack(side.column("probes").to_pylist()).astype(np.int64).reshape(len(x), tables, count)
        return np.array(side.column("id")), np.array(side.column("copies")), x, p

    ids, copies, x, p = parts(own)
    ids2, copies2, y, q = parts(ask)
    cos = y @ x.T
    i, j = np.nonzero((cos >= least - 1e-12) & (ids2[:, None] != ids[None, :]))
    # exact products for those at the edge do not depend on the block's shape
    value = np.einsum("kd,kd->k", y[i], x[j])
    keep = value >= least
    i, j = i[keep], j[keep]
    # met in table u: one's own bucket is among the other's probes
    met = np.stack([(q[i, u, :] == p[j, u, :1]).any(1) | (p[j, u, :] == q[i, u, :1]).any(1) for u in range(t + 1)]) if len(i) else np.zeros((t + 1, 0), bool)
    here = ~met[:t].any(0)
    # both probe the other's own bucket: the pair meets in two buckets of this table, or twice in one
    mutual = (q[i, t, :] == p[j, t, :1]).any(1) & (p[j, t, :] == q[i, t, :1]).any(1)
    here &= ~mutual | (ids2[i] < ids[j])
    i, j = i[here], j[here]
    if not len(i):
        return none
    a = np.concatenate([ids2[i], ids[j]])
    n = np.concatenate([copies[j], copies2[i]])
    who, back = np.unique(a, return_inverse=True)
    total = np.bincount(back, weights=n).astype(np.int64)
    parent = {int(v): int(v) for v in who}

    def root(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for u, v in zip(ids2[i].tolist(), ids[j].tolist(), strict=True):
        u, v = root(u), root(v)
        parent[max(u, v)] = min(u, v)
    b = [root(int(v)) for v in who]
    return pa.table({"a": pa.array(who, pa.int64()), "n": pa.array(total, pa.int64()), "b": pa.array([v if v != w else None for v, w in zip(b, who.tolist(), strict=True)], pa.int64())})


def linked_vectors(vectors: DataFrame, least: float = LEAST, tables: int = TABLES, count: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors (vec_id, embedding).

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths don't either. Rows with equal vectors link with each other; of rows with one vec_id each counts as a
    vector. A null vec_id has null as its component and is kept, and links count it. Empty tables give empty ones.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("__class", F.when(F.size("embedding") > 0, F.sha2(F.to_json("embedding"), 256)))
    classes = rows.where("__class is not null").groupBy("__class").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")
    )
    # a class's own number: its digest's, as two classes may share a vec_id
    classes = written(classes.withColumn("id", F.xxhash64("__class")), "vectors")
    codes = written(hashed(classes.select("id", "embedding"), tables, count), "hashes")
    base = codes.select("id", "dim", F.posexplode("probes").alias("at", "bucket"))
    base = base.select("id", "dim", F.expr(f"cast(at div {count} as int)").alias("t"), "bucket", (F.col("at") % count == 0).alias("own"))
    key = ["dim", "t", "bucket"]
    sizes = base.groupBy(*key).agg(F.sum(F.col("own").cast("long")).alias("n_own"), F.count("*").alias("n_all")).where("n_own > 0 and n_all > 1")
    parts = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.select(*key, parts("n_own").alias("owns"), parts("n_all").alias("asks"))
    met = base.join(sizes, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    own = met.where("own").select(*key, spot("owns", 1).alias("x"), every("asks").alias("y"), F.lit(0).alias("role"), "id")
    ask = met.select(*key, every("owns").alias("x"), spot("asks", 2).alias("y"), F.lit(1).alias("role"), "id")
    placed = own.unionByName(ask).join(classes.select("id", "copies", "embedding"), "id").join(codes.select("id", "probes"), "id")

    def compare(block: pa.Table) -> pa.Table:
        return block_links(block, tables, count, least)

    found = placed.groupBy(*key, "x", "y").applyInArrow(compare, "a long, n long, b long")
    found = written(found, "vector-links")
    totals = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    group = components(found.where("b is not null").select("a", "b"))
    usable = codes.select("id", F.lit(True).alias("usable"))
    labelled = classes.select("__class", "id", "least_id", "copies").join(usable, "id", "left").join(totals, "id", "left").join(group, "id", "left")
    labelled = written(labelled.withColumn("component", F.coalesce("component", "id")), "vector-groups")
    smallest = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = labelled.join(smallest, "component").select("__class", "usable", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = rows.select("vec_id", "__class").join(label, "__class", "left")
    out = out.select(
        "vec_id",
        F.when(F.col("usable"), F.col("n")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("usable") & F.col("vec_id").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark, sf_dir):
    return linked_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive usable as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), low as (select a, min(b) as m from reach group by a), many as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id)) as component_id, vec_id <= coalesce(m, vec_id) as kept
from embeddings left join low on low.a = vec_id left join many on many.a = vec_id
"""
