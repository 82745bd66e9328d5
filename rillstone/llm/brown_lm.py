"""Scoring texts with a Brown class-based bigram model.

Exchange clustering assigns every word to a class, in two steps. First, units move: the CORE most frequent words, and for
all others, to start with, groups of a common ending. Each pass counts, over all training tokens, the classes to the left
and right of each unit; then each unit in turn moves to the class that gains most likelihood while the counts of its
neighbours' classes stand (batch exchange). What reaches the driver are units x classes counts, whose size the parameters
fix. Then each word outside the core moves on its own, from the class of its group to the one in which its occurrences are
likeliest; their neighbours' classes are sorted by word and counted as they stream by, so that no word is held whole.

log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class), with the end token before the first word.
Both are smoothed and sum to 1: transitions are mixed with class frequencies by the weight `MU`; a class emits a word
by (count + 1) / (tokens + types + 1), the spare 1 for words never seen, which take the class of their group. Counts of all
words come from all training texts; those of the MAP most frequent, and their classes, are broadcast, the rest are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

CORE, GROUPS, CLASSES, PASSES = 8192, 2048, 32, 4
#: Words whose counts are broadcast; the bound is the size of that table, not of what is counted.
MAP = 200_000
MU = 20.0
#: Words that a task counts, and occurrences that it sorts, before it passes them on.
HELD, SORTED = 300_000, 2_000_000
END = CORE + GROUPS  # the unit of the end token, alone in the last class
#: Units of a part of the counts that pass between tasks.
SLAB = 64


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def group_of(word: bytes) -> int:
    """The unit that a word outside the core starts in: a hash of its last three bytes without punctuation."""
    return CORE + zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % GROUPS


def hash_of(word: bytes) -> int:
    """As Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return h - (1 << 64) if h >> 63 else h


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, without end tokens; a task's counts are summed before they move."""

    def run(batches):
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
            if len(seen) > HELD:
                yield from out(seen)
                seen.clear()
        yield from out(seen)

    def out(seen):
        names, counts = list(seen), list(seen.values())
        for at in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000], pa.binary()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast words, most frequent first, with their counts, hashes and the units they start in."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words = words
        self.core = min(CORE, len(words))
        self.logs = np.log10(np.array(counts, np.float64) + 1.0)
        self.hashes = np.array([hash_of(w) for w in words], np.int64)
        self.units = np.array([i if i < CORE else group_of(w) for i, w in enumerate(words)], np.int64)
        self.counts = np.array(counts, np.int64)


ROWS = "doc_id long, __text_key long, train boolean, ids binary, hashes array<long>, groups binary"


def indexed(docs: DataFrame, vocabulary) -> DataFrame:
    """ROWS of (doc_id, __text_key, train, text): ids has a 32-bit number for each word, its place in the vocabulary or,
    from -1 down, its place among the text's other words; hashes and groups are those of the other words."""

    def run(batches):
        get = {w: i for i, w in enumerate(vocabulary.value.words)}.get
        seen: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            ids, hashes, groups = [], [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                row = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                own: dict[bytes, int] = {}
                for p in np.flatnonzero(row < 0).tolist():
                    row[p] = -1 - own.setdefault(words[p], len(own))
                if len(seen) > HELD:
                    seen.clear()
                for w in own:
                    if w not in seen:
                        seen[w] = hash_of(w), group_of(w)
                ids.append(row.tobytes())
                hashes.append([seen[w][0] for w in own])
                groups.append(np.array([seen[w][1] for w in own], np.uint16).tobytes())
            made = [pa.array(ids, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(groups, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in ("doc_id", "__text_key", "train")] + made, ["doc_id", "__text_key", "train", "ids", "hashes", "groups"])

    return docs.select("doc_id", "__text_key", "train", "text").mapInArrow(run, ROWS)


def chunks(batches, vocabulary: Vocabulary, rows: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, hashes, units) of the tokens of some rows one after the other, each row with an end token before and after; an
    end token has the id -1 and the hash 0, other words' ids are negative."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            all_ids, all_hashes, all_units = [], [], []
            for raw, own, group in zip(part.column("ids"), part.column("hashes"), part.column("groups"), strict=True):
                ids = np.frombuffer(raw.as_py(), np.int32)
                units, hashes = np.full(len(ids) + 2, END, np.int64), np.zeros(len(ids) + 2, np.int64)
                away = np.flatnonzero(ids < 0)
                held = np.flatnonzero(ids >= 0)
                units[held + 1], hashes[held + 1] = vocabulary.units[ids[held]], vocabulary.hashes[ids[held]]
                if len(away):
                    units[away + 1] = np.frombuffer(group.as_py(), np.uint16)[-1 - ids[away]]
                    hashes[away + 1] = own.values.to_numpy()[-1 - ids[away]]
                all_ids.append(np.concatenate([[-1], ids, [-1]]))
                all_hashes.append(hashes)
                all_units.append(units)
            if all_ids:
                yield np.concatenate(all_ids), np.concatenate(all_hashes), np.concatenate(all_units)


def summed(parts: DataFrame) -> DataFrame:
    """(slab, counts): the sum of the counts of each slab, added up as rows stream by."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slab, counts in zip(b.column("slab").to_pylist(), b.column("counts"), strict=True):
                own = np.frombuffer(counts.as_py(), "<i8")
                total[slab] = total[slab] + own if slab in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slab", "counts"])

    return parts.repartition("slab").mapInArrow(run, "slab int, counts binary")


def neighbour_counts(rows: DataFrame, vocabulary, classes: np.ndarray) -> np.ndarray:
    """units x 2 x classes: how often each class stands left and right of each unit, over all rows."""
    n_units, n = END + 1, CLASSES + 1
    sent = rows.sparkSession.sparkContext.broadcast(classes.astype(np.int64))

    def run(batches):
        of, total = sent.value, np.zeros(n_units * 2 * n, np.int64)
        for _, _, units in chunks(batches, vocabulary.value):
            left, right = units[:-1], units[1:]
            # between the end tokens of two texts; that of an empty text has none of its own either
            real = ~((left == END) & (right == END))
            left, right = left[real], right[real]
            total += np.bincount(left * 2 * n + n + of[right], minlength=len(total))
            total += np.bincount(right * 2 * n + of[left], minlength=len(total))
        table_ = total.reshape(n_units, 2 * n)
        parts = [(k // SLAB, table_[k : k + SLAB]) for k in range(0, n_units, SLAB)]
        parts = [(k, p.astype("<i8").tobytes()) for k, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["slab", "counts"])

    out = np.zeros((n_units, 2 * n), np.int64)
    for r in summed(rows.mapInArrow(run, "slab int, counts binary")).collect():
        own = np.frombuffer(r.counts, "<i8").reshape(-1, 2 * n)
        out[r.slab * SLAB : r.slab * SLAB + len(own)] = own
    return out.reshape(n_units, 2, n)


def start_classes(weights: np.ndarray) -> np.ndarray:
    """Units dealt to classes in order of frequency; the end token has the last class."""
    classes = np.zeros(END + 1, np.int64)
    order = np.argsort(-weights[:END], kind="stable")
    classes[order] = np.arange(END) % CLASSES
    classes[END] = CLASSES
    return classes


def exchange(counts: np.ndarray, classes: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Classes after each unit has moved in turn, most frequent first, to where the class bigram likelihood
    sum B log B - sum left log left - sum right log right is greatest. counts: neighbour_counts() for `classes`."""
    n = CLASSES + 1
    classes = classes.copy()
    lefts, rights = counts[:, 0].astype(np.float64), counts[:, 1].astype(np.float64)
    grid = np.zeros((n, n))
    np.add.at(grid, classes, rights)
    weight = rights.sum(axis=1)
    order = [u for u in np.argsort(-weight, kind="stable") if u != END and weight[u] > 0]
    xlogx = lambda x: x * np.log(np.maximum(x, 1.0))
    out_sum, in_sum = grid.sum(axis=1), grid.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            c, r, l = classes[u], rights[u], lefts[u]  # noqa: E741
            grid[c] -= r
            grid[:, c] -= l
            out_sum -= l
            in_sum -= r
            out_sum[c] -= r.sum()
            in_sum[c] -= l.sum()
            np.maximum(grid, 0, out=grid)
            np.maximum(out_sum, 0, out=out_sum)
            np.maximum(in_sum, 0, out=in_sum)
            gain = (xlogx(grid + r) - xlogx(grid)).sum(axis=1) + (xlogx(grid.T + l) - xlogx(grid.T)).sum(axis=1)
            gain -= xlogx(out_sum + r.sum()) - xlogx(out_sum) + xlogx(in_sum + l.sum()) - xlogx(in_sum)
            best = int(np.argmax(gain[:CLASSES]))
            moved += best != c
            classes[u] = best
            grid[best] += r
            grid[:, best] += l
            out_sum += l
            in_sum += r
            out_sum[best] += r.sum()
            in_sum[best] += l.sum()
        if not moved:
            break
    return classes


def smoothed(grid: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """P(class | class before), mixed with the classes' shares of the tokens."""
    share = (tokens + 1.0) / (tokens.sum() + len(tokens))
    return (grid + MU * share) / (grid.sum(axis=1, keepdims=True) + MU)


def own_classes(rows: DataFrame, vocabulary, classes: np.ndarray, grid: np.ndarray) -> DataFrame:
    """(key, class) of each word outside the core, key its hash: the class that makes the word's occurrences likeliest, given
    the classes beside them and the counts of pairs of classes so far."""
    n = CLASSES + 1
    sent = rows.sparkSession.sparkContext.broadcast(classes.astype(np.uint8))

    def flushed(keys, sides):
        keys, sides = np.concatenate(keys), np.concatenate(sides)
        order = np.argsort(keys, kind="stable")
        keys, sides = keys[order], sides[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        for at in range(0, len(starts), 20_000):
            some = starts[at : at + 20_000]
            stop = starts[at + 20_000] if at + 20_000 < len(starts) else len(keys)
            offsets = pa.py_buffer(((np.append(some, stop) - some[0]) * 2).astype(np.int32).tobytes())
            data = pa.py_buffer(sides[some[0] : stop].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys[some], pa.int64()), pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, data])], ["key", "sides"])

    def run(batches):
        keys, sides, size = [], [], 0
        for ids, hashes, units in chunks(batches, vocabulary.value):
            c = sent.value[units]
            at = np.flatnonzero((units != END) & ((ids < 0) | (ids >= CORE)))
            if not len(at):
                continue
            keys.append(hashes[at])
            sides.append(np.stack([c[at - 1], c[at + 1]], axis=1))
            size += len(at)
            if size > SORTED:
                yield from flushed(keys, sides)
                keys, sides, size = [], [], 0
        if size:
            yield from flushed(keys, sides)

    steps = np.log(smoothed(grid, grid.sum(axis=1)))
    left_gain, right_gain = steps[:, :CLASSES], steps.T[:, :CLASSES]  # by the class before and behind
    alone = np.log(grid.sum(axis=1)[:CLASSES] + 1.0)

    def best(keys, counts):
        gain = counts[:, :n] @ left_gain + counts[:, n:] @ right_gain - counts[:, :n].sum(axis=1, keepdims=True) * alone
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(gain.argmax(axis=1).astype(np.int32))], ["key", "class"])

    def choose(batches):
        last, held = None, np.zeros(2 * n)
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                b = whole.slice(at, 4000)
                keys, sides = b.column("key").to_numpy(), [x.as_py() for x in b.column("sides")]
                first = np.concatenate([[True], keys[1:] != keys[:-1]])
                group = np.cumsum(first) - 1
                flat = np.frombuffer(b"".join(sides), np.uint8).reshape(-1, 2).astype(np.int64)
                of = np.repeat(group, [len(x) // 2 for x in sides])
                size = int(group[-1]) + 1
                counts = np.bincount(of * 2 * n + flat[:, 0], minlength=size * 2 * n) + np.bincount(of * 2 * n + n + flat[:, 1], minlength=size * 2 * n)
                counts, keys = counts.reshape(size, 2 * n).astype(np.float64), keys[first]
                if last is not None:  # the word that the batch before has ended with
                    if keys[0] == last:
                        counts[0] += held
                    else:
                        yield best([last], held[None])
                last, held = keys[-1], counts[-1].copy()
                if size > 1:
                    yield best(keys[:-1], counts[:-1])
        if last is not None:
            yield best([last], held[None])

    found = rows.mapInArrow(run, "key long, sides binary")
    return found.repartition("key").sortWithinPartitions("key").mapInArrow(choose, "key long, class int")


class Model:
    """What scoring needs, all of a size that the parameters fix. classes: of units; own: of the vocabulary's words."""

    def __init__(self, vocabulary: Vocabulary, classes: np.ndarray, own: np.ndarray, tokens: np.ndarray, types: np.ndarray):
        self.vocabulary, self.classes, self.own = vocabulary, classes, own
        self.tokens = tokens
        self.n_tokens, self.n_types, self.n_texts = int(tokens.sum()), int(types.sum()), int(tokens[CLASSES])
        self.emits = np.log10(tokens + types + 1.0)
        self.steps = np.zeros((CLASSES + 1,) * 2)


def classed(rows: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """(doc_id, __text_key, train, sequence, known, logs) of indexed() rows: the class of each token, the end token's too, the
    number of tokens that the training texts have, and the sum of log10(count + 1)."""
    sent = rows.sparkSession.sparkContext.broadcast((model.vocabulary.logs, model.own, model.classes, model.n_texts))
    each = rows.select("doc_id", "__text_key", F.posexplode("hashes").alias("k", "key"))
    met = each.join(rest, "key").groupBy("doc_id", "__text_key")
    met = met.agg(F.collect_set(F.struct("k", "n", "class")).alias("met"))  # at most the words of one text
    met = met.withColumnsRenamed({"doc_id": "of", "__text_key": "of_key"})
    joined = rows.join(met, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("__text_key") == F.col("of_key")), "left")

    def run(batches):
        log_of, own, classes, n_texts = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                sequences, known, logs = [], [], []
                for raw, group, found in zip(b.column("ids"), b.column("groups"), b.column("met").to_pylist(), strict=True):
                    ids = np.frombuffer(raw.as_py(), np.int32)
                    away_class = classes[np.frombuffer(group.as_py(), np.uint16)].astype(np.uint8)
                    count = np.zeros(len(away_class))
                    for m in found or ():
                        away_class[m["k"]], count[m["k"]] = m["class"], m["n"]
                    out = np.full(len(ids) + 1, CLASSES, np.uint8)
                    held, away = np.flatnonzero(ids >= 0), np.flatnonzero(ids < 0)
                    out[held], out[away] = own[ids[held]], away_class[-1 - ids[away]]
                    seen = count[-1 - ids[away]]
                    sequences.append(out.tobytes())
                    known.append(len(held) + int((seen > 0).sum()) + (n_texts > 0))
                    logs.append(float(log_of[ids[held]].sum() + np.log10(seen + 1.0).sum() + np.log10(n_texts + 1.0)))
                made = [pa.array(sequences, pa.binary()), pa.array(known, pa.int64()), pa.array(logs, pa.float64())]
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "__text_key", "train")] + made, ["doc_id", "__text_key", "train", "sequence", "known", "logs"])

    joined = joined.select("doc_id", "__text_key", "train", "ids", "groups", "met")
    return joined.mapInArrow(run, "doc_id long, __text_key long, train boolean, sequence binary, known long, logs double")


def transitions(sequences: DataFrame) -> np.ndarray:
    """classes x classes: how often a class follows another, the end token standing before each text."""
    n = CLASSES + 1

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = np.frombuffer(bytes([CLASSES]) + b"".join(x.as_py() for x in b.column("sequence")[at : at + 1000]), np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * n + c[1:], minlength=n * n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n), pa.int32()), pa.array(total, pa.int64())], ["cell", "n"])

    grid = np.zeros(n * n)
    for r in sequences.select("sequence").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grid[r.cell] = r.n
    return grid.reshape(n, n)


def keyed(docs: DataFrame, train: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("__text_key"), train.alias("train"), "text")


def fit(docs: DataFrame, train: Column | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model, (key, n, class) of the words that it doesn't hold, and the classed() rows of all docs (doc_id, text). It
    learns from the rows for which train holds, null doc_ids and null texts (empty ones) included. An empty corpus gives a
    model in which nothing is known."""
    spark = docs.sparkSession
    texts = keyed(docs, F.lit(True) if train is None else train)
    counts = written(word_counts(texts.where("train").select("text")), "word-counts")
    # the words of all classes of counts, from the highest down, that together are at most MAP
    of = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    room, least = MAP, None
    for r in sorted(counts.groupBy(of.alias("k")).count().collect(), key=lambda r: -r.k):
        if r["count"] > room:
            break
        room, least = room - r["count"], r.k
    kept = F.lit(False) if least is None else of >= least
    top = sorted(((r.n, bytes(r.word)) for r in counts.where(kept).collect()), key=lambda r: (-r[0], r[1]))
    vocabulary = Vocabulary([w for _, w in top], [n for n, _ in top])
    sent = spark.sparkContext.broadcast(vocabulary)
    rows = written(indexed(texts, sent), "tokens")
    learnt = rows.where("train")
    n_texts = learnt.count()

    weights = np.zeros(END)
    weights[: vocabulary.core] = vocabulary.counts[: vocabulary.core]
    classes = start_classes(weights)
    for _ in range(PASSES):
        classes = exchange(neighbour_counts(learnt, sent, classes), classes)
    grid = np.zeros((CLASSES + 1, CLASSES + 1))
    np.add.at(grid, classes, neighbour_counts(learnt, sent, classes)[:, 1].astype(np.float64))

    moved = written(own_classes(learnt, sent, classes, grid), "word-classes")
    own = classes[vocabulary.units].astype(np.uint8) if len(top) else np.zeros(0, np.uint8)
    if len(top) > vocabulary.core:
        found = moved.join(counts.where(kept).select(F.xxhash64("word").alias("key")), "key").toArrow()
        place = {h: i for i, h in enumerate(vocabulary.hashes.tolist()) if i >= vocabulary.core}
        for key, c in zip(found.column("key").to_pylist(), found.column("class").to_pylist(), strict=True):
            if key in place:
                own[place[key]] = c
    rest = written(counts.where(~kept).select(F.xxhash64("word").alias("key"), "n").join(moved, "key"), "word-rest")

    tokens, types = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    np.add.at(tokens, own, vocabulary.counts)
    np.add.at(types, own, 1)
    for r in rest.groupBy("class").agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).collect():
        tokens[r["class"]] += r.tokens
        types[r["class"]] += r.types
    tokens[CLASSES], types[CLASSES] = n_texts, n_texts > 0
    model = Model(vocabulary, classes, own, tokens, types)
    sequences = written(classed(rows, model, rest), "classes")
    model.steps = np.log10(smoothed(transitions(sequences.where("train")), tokens))
    return model, rest, sequences


def scored(sequences: DataFrame, model: Model) -> DataFrame:
    """(doc_id, __text_key, train, n_tokens, n_known, train_tokens, base_score, score) of classed() rows."""
    sent = sequences.sparkSession.sparkContext.broadcast((model.steps, model.emits))
    all_log = float(np.log10(model.n_tokens + model.n_types + 1.0))

    def run(batches):
        steps, emits = sent.value
        for b in batches:
            n, base, score = [], [], []
            for raw, logs in zip(b.column("sequence"), b.column("logs").to_pylist(), strict=True):
                c = np.frombuffer(raw.as_py(), np.uint8)
                n.append(len(c))
                base.append(logs - len(c) * all_log)
                score.append(logs + float(steps[np.concatenate([[CLASSES], c[:-1]]), c].sum() - emits[c].sum()))
            made = [pa.array(n, pa.int64()), b.column("known"), pa.array([model_tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "__text_key", "train")] + made, ["doc_id", "__text_key", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    model_tokens = model.n_tokens
    return sequences.mapInArrow(run, "doc_id long, __text_key long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs, whether learnt from or not.

    Null and empty texts are their end token alone; a null doc_id stays null; rows that are equal get equal scores. Other
    columns don't matter. An empty table gives an empty one."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(model.vocabulary)
    rows = written(indexed(keyed(docs, F.lit(False)), vocabulary), "tokens")
    return scored(classed(rows, model, rest), model).drop("train", "__text_key")


def op3_brown_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 7 = 2"), F.lit(False))
    model, _, sequences = fit(docs, ~held_out)
    return scored(sequences, model).withColumn("held_out", ~F.col("train")).drop("train", "__text_key")


def lm_base(spark, sf_dir):
    """What op3_brown_lm has of counts alone, which SQL can compute too; sums of logarithms to six places."""
    return op3_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


BASE_ORACLE = r"""
with numbered as (
  select doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 7 = 2 as held_out,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
), tokens as (
  select doc_id, held_out, unnest(list_append(words, null)) as word from numbered
), counted as (
  select word, count(*) as c from tokens where not held_out group by word
), totals as (
  select sum(c) as n, count(*) as v from counted
)
select doc_id, held_out, count(*)::bigint as n_tokens, count(c)::bigint as n_known, any_value(n)::bigint as train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::double)), 6) as base_score
from tokens left join counted on tokens.word is not distinct from counted.word cross join totals group by doc_id, held_out
"""
