"""Near-duplicate documents by min-max hashing.

Under each permutation of the shingle hashes both the smallest and the largest value are kept: two samples for one
evaluation. Bands of the signature give candidates; every link is confirmed on the full shingle sets.

No bucket is ever expanded into its pairs:
1. Documents with one shingle set are one class (grouped by a 128-bit digest, summed before the shuffle).
2. Each bucket's members are compared with its smallest member only, and the confirmed links give components.
3. Where a bucket's other members then lie in several components, those outside the bucket's largest component are
   queries, in bounded blocks, against bounded blocks of all its members: each pair of a bucket is thus either in one
   component already or compared. A block answers with at most one link for each of its rows.
Sets are held as 64-bit hashes of shingles; two shingles of one document share a hash with a chance below 1e-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, fresh, table, written

M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
PERMUTATIONS, ROWS = 32, 4
#: Bounds of a block: rows, and shingles of its rows together.
QUERIES, MEMBERS, SHINGLES = 256, 1024, 400_000
#: Texts that are compared with one copy of their bucket's first.
STAR = 256


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M[3]
    x = (x ^ (x >> np.uint64(27))) * M[4]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles. A-Z is lowered and words are cut at ASCII white space; with
    fewer words than `width` the whole sequence is one shingle; without words there is none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = mixed(out * M[0] + h[k : k + n])
    return np.unique(out)


def bands(sh: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """Band keys of a set: signature rows are minimum and maximum under each permutation, `rows` of them a band.
    A band takes values of `rows` different permutations."""
    rng = np.random.default_rng(20)
    a = rng.integers(0, 2**63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, permutations, dtype=np.uint64)
    low, high = np.empty(permutations, np.uint64), np.empty(permutations, np.uint64)
    for k in range(permutations):
        v = sh * a[k] + b[k]
        v ^= v >> np.uint64(32)
        v *= M[3]
        low[k], high[k] = v.min(), v.max()
    sig = np.concatenate([low, high]).reshape(-1, rows)
    key = np.arange(len(sig), dtype=np.uint64)
    for r in range(rows):
        key = mixed(key * M[0] + sig[:, r])
    return key.view(np.int64)


def overlap_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


SIGNED = "doc_id long, __text_key long, n_shingles long, __class binary, __bands array<long>"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__text_key"), "text")


def signed(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, __class, __bands) of each document; __class is null for an empty set."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for t in b.column("text"):
                text = t.as_py()
                sh = shingles(text, width)
                out[0].append(len(sh))
                out[1].append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                out[2].append(bands(sh, permutations, rows) if len(sh) else None)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()))
            made = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            names = ["doc_id", "__text_key", "n_shingles", "__class", "__bands"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__text_key"), *made], names)

    return keyed(docs).mapInArrow(run, SIGNED)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose sets overlap enough; texts: (id, text). The text of a stands before those of its bs, of which
    a block takes STAR or so: a hub's text travels once for each block, and its pairs are spread over tasks."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int").alias("block")
    placed = pairs.join(sizes, "a").select("a", "b", block)
    heads = placed.select("a", "block").distinct().join(texts.withColumnRenamed("id", "a"), "a")
    heads = heads.select("a", "block", F.lit(None).cast("long").alias("b"), "text")
    others = placed.join(texts.withColumnRenamed("id", "b"), "b").select("a", "block", "b", "text")
    rows = heads.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        kept = np.empty(0, np.uint64)
        for batch in batches:
            found = ([], [])
            for a, b, text in zip(*(batch.column(c) for c in ("a", "b", "text")), strict=True):
                sh = shingles(text.as_py(), width)
                if b.as_py() is None:
                    kept = sh
                elif overlap_at_least(kept, sh, percent):
                    found[0].append(a.as_py())
                    found[1].append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def block_links(group: pa.Table, width: int, percent: int) -> pa.Table:
    """Links between the queries and members of one block that lie in different components, as a forest.

    An inverted list of the members' shingles gives the exact intersection of a query with all members at once."""
    rows = group.select(["role", "id", "component", "text"]).to_pylist()
    members, queries = [r for r in rows if not r["role"]], [r for r in rows if r["role"]]
    sets = [shingles(r["text"], width) for r in members]
    sizes = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), sizes)
    everything = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(everything, kind="stable")
    everything, of = everything[order], of[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for q in queries:
        sh = shingles(q["text"], width)
        low, high = np.searchsorted(everything, sh, "left"), np.searchsorted(everything, sh, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(of[at], minlength=len(sets))
        for k in np.flatnonzero(100 * both >= percent * (len(sh) + sizes - both)):
            m = members[k]
            x, y = root(q["component"]), root(m["component"])
            if m["id"] != q["id"] and x != y:
                parent[max(x, y)] = min(x, y)
                links.append((q["component"], m["component"]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def linked(classes: DataFrame, confirm: Callable, compare: Callable, load: str) -> DataFrame:
    """(id, component) of the classes that have links, from (id, __bands) and a column of each one's load.

    confirm(pairs (a, b)) gives the pairs that are linked. compare(rows) gives links (a, b) between components from
    rows (key, block, chunk, role, id, component).
    """
    members = classes.select(F.explode("__bands").alias("key"), "id", load)
    buckets = members.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    # written, so that a hot key's members meet it in a join of two plain shuffles, which Spark can split
    buckets = written(buckets, "bucket-heads")
    members = written(members.join(buckets, "key").select("key", "id", "a", "n", load), "buckets")
    pairs = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    first = written(components(confirm(pairs)), "components")
    # members besides the smallest; alone they are a component of their own
    rest = members.where("id <> a and n > 2").join(first, "id", "left")
    rest = rest.select("key", "id", load, F.coalesce("component", "id").alias("component"))
    shares = rest.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(load).alias("l"))
    open_ = shares.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("l").alias("l"),
        F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"), F.max(F.struct("n", "l")).alias("most"),
    ).where("parts > 1")
    blocks = lambda n, l, most: F.greatest(F.ceil(n / most), F.ceil(l / SHINGLES), F.lit(1)).cast("int")
    open_ = open_.select(
        "key", "largest",
        blocks(F.col("n") - F.col("most.n"), F.col("l") - F.col("most.l"), QUERIES).alias("blocks"),
        blocks(F.col("n"), F.col("l"), MEMBERS).alias("chunks"),
    )
    rest = rest.join(open_, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    asked = rest.where("component <> largest").select("key", place("blocks", 1).alias("block"), every("chunks").alias("chunk"), F.lit(True).alias("role"), "id", "component")
    told = rest.select("key", every("blocks").alias("block"), place("chunks", 2).alias("chunk"), F.lit(False).alias("role"), "id", "component")
    more = components(compare(asked.unionByName(told)))
    joined = first.alias("f").join(more.alias("m"), F.col("f.component") == F.col("m.id"), "left")
    grown = joined.select("f.id", F.coalesce("m.component", "f.component").alias("component"))
    # components of one member that only the blocks have linked
    alone = more.join(first.select("id"), "id", "left_anti").select("id", "component")
    return written(grown.unionByName(alone), "components")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, __text_key, n_shingles, component_id, kept), one row for each row of docs.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets. Null and empty texts, and
    those without words, have an empty set, are linked with nothing and kept. Rows with one doc_id are told
    apart by their texts; null doc_ids have no component and are kept. An empty table gives an empty one.
    """
    base = written(signed(docs, width, permutations, rows), "signatures")
    known = base.where("__class is not null and doc_id is not null")
    classes = known.groupBy("__class").agg(
        F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.min_by("__text_key", F.struct("doc_id", "__text_key")).alias("key"), F.first("__bands").alias("__bands")
    )
    classes = written(classes, "classes")
    # any text of a class has its set; the rows of one are picked by doc_id and the text's hash
    keys = classes.select(F.col("id"), "key")
    own = keyed(docs)

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = ids.select("id").distinct().join(keys, "id")
        return own.join(wanted, (F.col("doc_id") == F.col("id")) & (F.col("__text_key") == F.col("key"))).select("id", "text")

    def confirm(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        return written(confirmed(pairs, texts, width, percent), "links")

    def compare(placed: DataFrame) -> DataFrame:
        placed = written(placed, "blocks")
        rows_ = placed.join(texts_of(placed), "id").select("key", "block", "chunk", "role", "id", "component", "text")

        def one(block: pa.Table) -> pa.Table:
            return block_links(block, width, percent)

        return rows_.groupBy("key", "block", "chunk").applyInArrow(one, "a long, b long")

    found = linked(classes.select("id", "__bands", "n_shingles"), confirm, compare, "n_shingles")
    label = classes.join(found, "id", "left").select("__class", F.coalesce("component", "id").alias("__component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("__component", "doc_id")).alias("component_id")
    out = base.join(label, "__class", "left").select("doc_id", "__text_key", "n_shingles", component)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id, with the columns of docs.

    Rows that share the kept doc_id and text stay, as many as there are; so do rows without a doc_id.
    """
    id_, key = fresh(docs, "__id"), fresh(docs, "__key")
    gone = near_duplicates(docs, width, percent).where("not kept").select(F.col("doc_id").alias(id_), F.col("__text_key").alias(key))
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left_anti")


def op1_minmax_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] else list_transform(range(1, greatest(len(w) - 2, 1) + 1),
    lambda i: array_to_string(w[i:i + 2], ' ')) end) as s
  from words
), sizes as (
  select doc_id, coalesce(len(s), 0) as n from sets
), flat as (
  select doc_id, unnest(s) as s from sets
), links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.s = b.s and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
)
select doc_id, n::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id, doc_id <= coalesce(m, doc_id) as kept
from sizes left join (select a, min(b) as m from reach group by a) on a = doc_id
"""
