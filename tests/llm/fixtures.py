"""Small documents with the shapes that operators must stand: nulls, empty and long texts, copies, clashing columns."""

import random

SYLLABLES = "ta re no mi so la ke du pa vi or en st al qu be".split()


def word(rnd):
    return "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))


def prose(rnd, n):
    return "\n".join(" ".join(word(rnd) for _ in range(min(20, n - k))) for k in range(0, n, 20))


def edited(rnd, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = word(rnd)
    return " ".join(words)


def documents(seed=5):
    """(doc_id, text, lang, source, n_chars)"""
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randint(30, 300)) for _ in range(25)]
    texts = list(base)
    for b in base[:6]:
        texts += [b, edited(rnd, b, 1), edited(rnd, b, 4), b.upper()]
    hub = prose(rnd, 120)
    texts += [edited(rnd, hub, k % 12) for k in range(60)]
    texts += ["", None, " \n\t ", "one", "One", "two words", "a b c", "äÖ ▁ \U0001f600", prose(rnd, 9000), "same line here again\n" * 40]
    rows = [(k, t, "en", rnd.choice(["b", "a", "c", None, "é", "B"]), len(t or "")) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows + [rows[0], rows[0]]  # equal rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def components(nodes, links):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def with_clashes(df):
    """The same rows with columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    names = ("id", "component", "key", "size", "target", "score", "n", "a", "b", "w", "tk", "lid", "value", "kept", "words", "line", "line_no", "grams", "found", "band", "gone", "text_key", "at", "toxic", "label", "__id", "__key", "__tk", "__mix_source", "__mix_size", "__toxicity", "__maybe", "__text_key", "__class", "__bands", "__gone", "row", "of", "rate", "draw", "copies", "so_far")
    return df.withColumns({n: F.lit(k) for k, n in enumerate(names)})
