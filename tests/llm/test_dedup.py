import functools
import itertools
import re

import numpy as np
import pytest
import xxhash

from rillstone.llm import embedding_dedup, line_dedup, minmax_dedup
from rillstone.llm.common import components

from . import fixtures as X


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = {r[0]: shingle_set(r[1], width) for r in X.documents()}
    links = [(a, b) for a, b in itertools.combinations(rows, 2) if rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b])]
    wanted = X.components(rows, links)
    found = minmax_dedup.near_duplicates(X.with_clashes(X.frame(spark)), width, percent).collect()
    assert len(found) == len(X.documents())
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(rows[r.doc_id]), wanted[r.doc_id], wanted[r.doc_id] == r.doc_id)
    kept = minmax_dedup.keep_one(X.with_clashes(X.frame(spark)), width, percent)
    assert {r.doc_id for r in kept.collect()} == set(wanted.values()) and kept.columns == X.with_clashes(X.frame(spark)).columns


def test_blocks_find_what_no_star_does(spark):
    """A bucket whose smallest member is linked with none, while the others are linked among themselves in a chain."""
    sets = {k: np.arange(100 + 6 * k, 200 + 6 * k, dtype=np.uint64) for k in range(30)} | {-1: np.arange(5, dtype=np.uint64)}
    linked = lambda a, b: minmax_dedup.overlap_at_least(sets[a], sets[b], 85)
    classes = spark.createDataFrame([(k, [7, k // 10], len(s)) for k, s in sets.items()], "id long, __bands array<long>, n_shingles long")
    asked = []

    def confirm(pairs):
        rows = [tuple(r) for r in pairs.collect()]
        asked.extend(rows)
        return spark.createDataFrame([r for r in rows if linked(*r)], "a long, b long")

    def compare(placed):
        rows = placed.collect()
        out = []
        for q in (r for r in rows if r.role):
            out += [(q.component, m.component) for m in rows if not m.role and (m.key, m.block, m.chunk) == (q.key, q.block, q.chunk) and m.component != q.component and linked(q.id, m.id)]
        return spark.createDataFrame(out, "a long, b long")

    found = {r.id: r.component for r in minmax_dedup.linked(classes, confirm, compare, "n_shingles").collect()}
    assert found == {k: 0 for k in range(30)}
    assert len(set(asked)) < 31 * 3


def test_empty_and_null_tables(spark):
    empty = X.frame(spark, [])
    assert minmax_dedup.near_duplicates(empty).count() == 0 and minmax_dedup.keep_one(empty).count() == 0
    nulls = X.frame(spark, [(None, None, None, None, None), (None, "a b c d e f", None, None, None), (3, "a b c d e f", None, None, None)])
    found = minmax_dedup.near_duplicates(nulls).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in found) == [(-1, True), (-1, True), (3, True)]
    assert minmax_dedup.keep_one(nulls).count() == 3
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.dedup_lines(nulls).count() == 3
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_min_and_max_are_unbiased():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[400:])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    same = minmax_dedup.bands(a, 2000, 1) == minmax_dedup.bands(b, 2000, 1)
    assert abs(same[:2000].mean() - true) < 0.04 and abs(same[2000:].mean() - true) < 0.04


def test_components_are_those_of_a_plain_union(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(k, k + 1) for k in range(500, 620)] + [(700, k) for k in range(701, 800)]
    wanted = X.components({n for ab in links for n in ab}, links)
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: c for n, c in wanted.items() if any(n in ab and ab[0] != ab[1] for ab in links)}


def distance(a, b):
    """Edit distance by plain dynamic programming."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def bit_distance(a, b):
    """Edit distance, a column of the table held in two numbers."""
    where = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    whole, top, up, down, cost = (1 << len(a)) - 1, 1 << len(a) - 1, (1 << len(a)) - 1, 0, len(a)
    for y in b:
        eq = where.get(y, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & whole, up & x
        cost += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & whole, minus << 1 & whole
        up, down = minus | ~(eq | down | plus) & whole, plus & (eq | down)
    return cost


def normal(line):
    return " ".join(w for w in re.split(r"[\W_]+", line.lower()) if w)


def brute_lines(rows, percent=80):
    """doc_id -> text without the lines that repeat others, the links and the lines gone; every pair is compared."""
    return all_lines_compared(frozenset((r[0], r[1]) for r in rows), percent)


@functools.cache
def all_lines_compared(rows, percent):
    texts = dict(rows)
    occurrences = [(d, k, normal(x)) for d, t in texts.items() if t is not None for k, x in enumerate(t.split("\n")) if normal(x)]
    lines = sorted({n for *_, n in occurrences}, key=len)
    links = []
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if len(a) * 100 < percent * len(b):
                break
            if 100 * bit_distance(a, b) <= (100 - percent) * len(b):
                links.append((a, b))
    group = X.components(lines, links)
    first = {}
    for d, k, n in sorted(occurrences, key=lambda o: o[:2]):
        first.setdefault(group[n], (d, k))
    gone = {(d, k) for d, k, n in occurrences if first[group[n]] != (d, k)}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}, len(links), gone


def test_bit_distance_is_the_distance():
    import random

    rnd = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12))) for _ in "ab")
        assert bit_distance(a, b) == distance(a, b)


def without(text, gone):
    return None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_lines_equal_brute_force(spark):
    """Nothing goes that a comparison of all pairs keeps, and nearly all goes that it lets go."""
    rows = X.documents()
    _, links, gone = brute_lines(rows)
    assert links > 100 and len(gone) > 100
    found = {}
    for r in line_dedup.removed_lines(X.with_clashes(X.frame(spark))).collect():
        found.setdefault(r.doc_id, set()).update(r.gone)
    assert {(d, k) for d, lines in found.items() for k in lines} <= gone
    assert sum(map(len, found.values())) >= 0.98 * len(gone)
    out = line_dedup.dedup_lines(X.with_clashes(X.frame(spark))).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows) and {r.doc_id: r.text for r in out} == {d: without(t, found.get(d, ())) for d, t in texts.items()}
    left = line_dedup.drop_repeated_lines(X.with_clashes(X.frame(spark)))
    assert left.columns == X.with_clashes(X.frame(spark)).columns
    for r in left.collect():
        assert r.text == without(texts[r.doc_id], found.get(r.doc_id, ()))
        assert r.n_chars == len(r.text or "")


def test_edit_similarity_is_exact(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(7)
    pairs = []
    for _ in range(300):
        a = [X.word(rnd) for _ in range(rnd.randint(1, 14))]
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randint(0, 2)] = [X.word(rnd) for _ in range(rnd.randint(0, 2))]
        pairs.append((a, b or ["x"]))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", line_dedup.similar(F.col("a"), F.col("b"), *(F.length(F.array_join(c, " ")) for c in "ab"), 80).alias("s"))
    found = df.collect()
    assert 40 < sum(r.s for r in found) < 260
    for r in found:
        x, y = " ".join(r.a), " ".join(r.b)
        assert r.s == (100 * distance(x, y) <= 20 * max(len(x), len(y))), (x, y)


def test_simhash_equals_its_definition(spark):
    """Blocks hold the counts of set bits over the words of their group, their number and characters."""
    L = line_dedup
    rows = [(k, t, None, None, None) for k, (_, t, *_) in enumerate(X.documents()[:30]) if t] + [(99, " ".join(X.word(__import__("random").Random(k)) + str(k) for k in range(56)), None, None, None)]
    seen = L.occurrences(X.frame(spark, rows).select("doc_id", "text")).collect()
    assert len(seen) > 50 and [r.at for r in seen if r.doc_id == 99] in ([1, 0], [0, 1]) and sum(not r.main for r in seen) == 1
    texts = {r[0]: r[1].split("\n") for r in rows}
    for r in seen:
        words = set(normal(texts[r.doc_id][r.line_no]).split(" "))
        assert r.n == len(words)
        hashes = {w: xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words}
        for k in range(L.BLOCKS):
            own = [w for w, h in hashes.items() if h & (L.BLOCKS << r.at) - 1 == k]
            first = sum(sum(hashes[w] >> L.BITS * i + 4 & 1 for w in own) << L.BITS * i for i in range(L.FIRST))
            second = sum(sum(hashes[w] >> L.BITS * i + 6 & 1 for w in own) << L.BITS * i for i in range(L.SECOND))
            second += (len(own) << L.BITS * L.SECOND) + (sum(map(len, own)) << L.BITS * L.SECOND + 8)
            assert (r[f"a{k}"], r[f"b{k}"]) == ((first, second) if own else (None, None))


def test_bitmap_has_its_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    bits = line_dedup.bitmap(keys, "k")
    assert line_dedup.in_bitmap(keys, bits, "k").where("not __maybe").count() == 0
    others = spark.range(5000).select((F.col("id") * 7919 + 3).alias("k"))
    assert line_dedup.in_bitmap(others, bits, "k").where("__maybe").count() < 60


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = [[float(x) for x in b] for b in base]
    for k in range(6):
        rows += [[float(x) for x in base[k] + rng.normal(size=24) * s] for s in np.linspace(0.1, 0.6, 25)]
    rows += [rows[0], rows[0], [0.0] * 24, [], None, [float("nan")] * 24, [None, 1.0] + [0.0] * 22, [1.0, 2.0], [2.0, 4.0], [1e30] * 24, [1e-30] * 24, [float("inf")] + [1.0] * 23]
    ids = list(rng.permutation(len(rows)) * 3)
    df = spark.createDataFrame([(int(i), v, 0) for i, v in zip(ids, rows, strict=True)], "vec_id long, embedding array<float>, label int")
    unit = {}
    for i, v in zip(ids, rows, strict=True):
        if v and None not in v:
            x = np.asarray(np.asarray(v, np.float32), np.float64)
            if np.isfinite(x).all() and (x != 0).any():
                unit[int(i)] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    wanted = X.components([int(i) for i in ids], links)
    for r in embedding_dedup.linked_vectors(df).collect():
        assert (r.n_links, r.component_id, r.kept) == (sum(r.vec_id in ab for ab in links), wanted[r.vec_id], wanted[r.vec_id] == r.vec_id)


def test_probes_recall(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    p, q = embedding_dedup.probes(a), embedding_dedup.probes(b)
    met = np.any([(p[:, t] == q[:, t, :1]).any(1) | (q[:, t] == p[:, t, :1]).any(1) for t in range(embedding_dedup.TABLES)], axis=0)
    assert met.mean() > 0.999


def varied(rnd, n, changed, letters=False):
    """A line of n words and a copy with so many words, or letters, changed."""
    words = [X.word(rnd) for _ in range(n)]
    other = list(words)
    for at in rnd.sample(range(n), changed):
        k = rnd.randrange(len(other[at]))
        other[at] = other[at][:k] + rnd.choice("xyzw") + other[at][k + 1 :] if letters else X.word(rnd)
    return " ".join(words), " ".join(other)


#: Least and most words, words or letters changed, and the share of pairs to be found.
VARIATIONS = [
    (8, 30, 1, False, 0.99), (8, 30, 2, False, 0.95), (12, 30, 3, False, 0.88), (8, 30, 1, True, 0.98), (4, 7, 1, True, 0.96), (2, 3, 1, True, 0.97),
    (40, 90, 4, False, 0.97), (100, 400, 10, False, 0.97), (8, 30, 2, True, 0.9), (8, 30, 3, True, 0.75),
]


def test_lines_with_changes_are_found(spark):
    """Against plain edit similarity of pairs, whatever makes them candidates."""
    import random

    rnd, texts, of = random.Random(11), [], []
    for k, (least, most, changed, letters, _) in enumerate(VARIATIONS):
        while of.count(k) < 250:
            a, b = varied(rnd, rnd.randint(least, most), changed, letters)
            if a != b and 100 * bit_distance(a, b) <= 20 * max(len(a), len(b)):
                texts += [a, b]
                of.append(k)
    out = line_dedup.dedup_lines(X.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]))
    gone = {r.doc_id for r in out.where("n_removed = 1").collect()}
    found = [sum(2 * i + 1 in gone for i, x in enumerate(of) if x == k) / 250 for k in range(len(VARIATIONS))]
    assert all(f >= v[-1] for f, v in zip(found, VARIATIONS, strict=True)), str(found)


def test_lines_of_short_or_repeated_words_are_found(spark):
    """Lines whose words have few characters, and lines that repeat few words, have keys too; of up to 14 characters all links are found."""
    import random

    rnd, texts = random.Random(5), []

    def add(words, at, other):
        b = list(words)
        b[at] = other
        a, b = " ".join(words), " ".join(b)
        assert a != b and 100 * bit_distance(a, b) <= 20 * max(len(a), len(b)), (a, b)
        texts.extend([a, b])

    for k in range(40):  # each pair has letters of its own, so that none is linked by another's lines
        own = [chr(0x4E00 + 64 * k + i) for i in range(64)]
        add(rnd.sample(own, 30), 7, own[0] + own[1])
        add(rnd.sample(own, 12), 5, own[2] + own[3])
        add([own[0] + own[1], own[2] + own[3], own[4] + own[5], own[6] + own[7]], 3, own[6] + own[9])
        add([own[10]] * 12, 4, own[11])
        add([own[12] + own[13]] * 4, 2, own[12] + own[14])
        add([own[15], own[16]] * 9, 4, own[17])
    out = line_dedup.dedup_lines(X.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)]))
    gone = {r.doc_id for r in out.where("n_removed = 1").collect()}
    found = [sum(12 * k + 2 * i + 1 in gone for k in range(40)) for i in range(6)]
    assert found[0] >= 39 and found[1] >= 38 and found[2:] == [40] * 4, str(found)


def test_large_buckets_are_asked_in_rounds(spark, monkeypatch):
    """Lines that some lines of a bucket link are not asked again, and no link is lost by it."""
    import random

    rnd, texts = random.Random(9), []
    for _ in range(3):
        base = [X.word(rnd) for _ in range(34)]
        for _ in range(30):
            line = list(base)
            for at in rnd.sample(range(34), rnd.randint(2, 7)):
                line[at] = X.word(rnd)
            texts.append(" ".join(line))
        texts += [" ".join(base[:12] + [X.word(rnd) for _ in range(22)]) for _ in range(12)]
    docs = X.frame(spark, [(k, t, None, None, 0) for k, t in enumerate(texts)])
    rounds, asked = [], line_dedup.asked_links
    monkeypatch.setattr(line_dedup, "asked_links", lambda *a: rounds.append(a[5:]) or asked(*a))
    whole = {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed = 1").collect()}
    assert rounds == [()]
    monkeypatch.setattr(line_dedup, "SOME", 2)
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_removed = 1").collect()} == whole
    assert rounds[1:] == [(2,), ()]
    assert whole <= {d for d, _ in all_lines_compared(frozenset(enumerate(texts)), 80)[2]} and len(whole) > 60


def test_a_centre_settles_pairs(spark):
    """Distances from a bucket's centre are within their bounds, which tell all far lines from its near copies uncompared."""
    import random

    rnd, lines, k = random.Random(12), [], 0
    base = [X.word(rnd) for _ in range(30)]
    for k in range(60):
        line = list(base)
        for at in rnd.sample(range(30), 1 if k < 40 else 24):
            line[at] = X.word(rnd)
        lines.append((k, line, len(" ".join(line))))
    texts = spark.createDataFrame(lines, "id long, norm array<string>, length int")
    rest = spark.createDataFrame([(7, k, 0 if k < 40 else k, 0, 60, 40, 1, 0) for k in range(60)] + [(8, 0, 0, 0, 2, 1, 1, 0), (8, 50, 50, 0, 2, 1, 1, 0)], "key long, id long, component long, largest long, n long, most long, blocks int, block int")
    found = {r.id: r.spread for r in line_dedup.bounded(rest, texts, 80).where("key = 7").collect()}
    assert len(found) == 60 and line_dedup.bounded(rest, texts, 80).count() == 60
    text = [" ".join(w) for _, w, _ in lines]
    assert all(s.low <= bit_distance(text[0], text[k]) <= s.high for k, s in found.items())
    settled = sum(found[q].low - found[y].high > 0.2 * max(len(text[q]), len(text[y])) for q in range(40, 60) for y in range(40))
    assert settled > 700


def test_few_changed_words_are_similar(spark):
    """Long lines with changes in many places are linked by their words, none that the distance of characters doesn't link."""
    import random

    from pyspark.sql import functions as F

    rnd, pairs = random.Random(13), []
    for k in range(40):
        a = [X.word(rnd) for _ in range(60)]
        b = list(a)
        for _ in range(1 + k // 4):
            at = rnd.randrange(len(b))
            b[at : at + 1] = rnd.choice([[], [X.word(rnd)], [b[at], X.word(rnd)]])
        pairs.append((a, b, max(len(" ".join(a)), len(" ".join(b))) // 5))
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>, most int")
    found = df.select("*", line_dedup.few_words(F.col("a"), F.col("b"), F.col("most")).alias("s")).collect()
    assert 10 < sum(r.s for r in found) < 40
    assert all(bit_distance(" ".join(r.a), " ".join(r.b)) <= r.most for r in found if r.s)


def test_equal_rows_keep_their_keys(spark):
    """The words of equal rows don't add up: a near copy of a repeated row is found."""
    import random

    rnd, rows = random.Random(14), []
    for k in range(8):
        words = [X.word(rnd) for _ in range(30 + 20 * k)]
        line = " ".join(words)
        words[3 * k] = X.word(rnd) + "x"
        rows += [(2 * k, line, None, None, 0), (2 * k, line, None, None, 0), (2 * k + 1, " ".join(words), None, None, 0)]
    docs = X.frame(spark, rows)
    found = line_dedup.dedup_lines(docs).collect()
    assert sorted(r.doc_id for r in found if r.n_removed) == list(range(1, 16, 2)) and len(found) == 24


def test_starts_tell_only_far_pairs(spark):
    """No pair within the distance is told by its start, and most unlike pairs are."""
    import random

    from pyspark.sql import functions as F

    rnd, pairs = random.Random(15), []
    for k in range(300):
        a = " ".join(X.word(rnd) for _ in range(rnd.randint(1, 25)))
        b = list(a if k % 3 else " ".join(X.word(rnd) for _ in range(rnd.randint(1, 25))))
        for _ in range(rnd.randint(0, len(a) // 4)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randint(0, 2)] = rnd.choice(["", "x", "yä", "ß"])
        b = "".join(b)
        pairs.append((a, b, max(len(a), len(b)) // 5, bit_distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, most int, d int").withColumn("s", line_dedup.start_within(F.col("a"), F.col("b"), F.col("most")))
    found = df.collect()
    assert all(r.s for r in found if r.d <= r.most) and sum(r.d <= r.most for r in found) > 100
    assert sum(not r.s for r in found) > 60


def test_short_and_odd_lines(spark):
    """Exact repeats of any length go; lines without letters or digits stay; a document goes when only such are left."""
    rows = [(1, "yes\n--\n\nkeep this line"), (2, "yes\n--\n"), (3, "Yes!\nno"), (4, "--\n"), (5, ""), (6, None), (7, "spam " * 3000), (8, "spam " * 2999), (9, "x" * 3000 + "y" * 3000), (10, "x" * 2999 + "y" * 3001)]
    docs = X.frame(spark, [(d, t, None, None, len(t or "")) for d, t in rows])
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert found[1] == (rows[0][1], 0) and found[2] == ("--\n", 1) and found[3] == ("no", 1) and found[4] == ("--\n", 0)
    assert found[7][1] == 0 and found[8][1] == 1 and found[10][1] == 1
    assert {r.doc_id for r in line_dedup.drop_repeated_lines(docs).collect()} == {1, 3, 4, 5, 6, 7, 9}


def test_line_columns_that_clash(spark):
    names = ("__gone", "__tk", "__id", "__maybe", "__part", "__words", "__spot", "row", "of", "cut", "rest", "left", "n_removed", "N_Removed_")
    docs = X.frame(spark, [(1, "a line of words", "x", "s", 15), (2, "a line of words\nmore", "x", "s", 20)]).selectExpr("*", *[f"'{n}' as `{n}`" for n in names])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_removed__"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text == "more" and rows[2]["n_removed__"] == 1 and all(r[n] == n for r in rows.values() for n in names)
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
