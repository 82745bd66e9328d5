import shutil

import pytest

import corpus_pipeline as P
from rillstone.llm import line_dedup
from . import fixtures as X
from .test_dedup import brute_lines, normal, shingle_set, without
from .test_text import brute_targets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = X.documents()
    toxic = [(1000 + k, f"{X.prose(__import__('random').Random(k), 40)} idiot scum idiot stupid scum", "en", "a", 0) for k in range(80)]
    X.frame(spark, rows + toxic).coalesce(2).write.parquet(f"{at}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows] + [(r[0], 0, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    yield str(at)
    shutil.rmtree(at)


def test_stages_have_their_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "minmax_dedup", "source_mixing", "sentencepiece"]


def test_each_stage_equals_brute_force(spark, folder):
    import itertools
    from collections import Counter

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(P.STAGES)
    clean = stage["toxicity"](spark, docs, folder).collect()
    assert not [r for r in clean if r.doc_id >= 1000] and len(clean) == len(X.documents())

    rows = [tuple(r) for r in clean]
    frame = spark.createDataFrame(rows, docs.schema)
    _, _, gone = brute_lines(rows)
    out = stage["line_dedup"](spark, frame, folder).collect()
    # what goes are lines that a comparison of all pairs lets go, and nearly all of them
    lost, total = {}, 0
    for r in line_dedup.removed_lines(frame).collect():
        lost.setdefault(r.doc_id, set()).update(r.gone)
        total += len(r.gone)
    assert {(d, k) for d, at in lost.items() for k in at} <= gone and total >= 0.98 * len(gone)
    texts = {r[0]: without(r[1], lost.get(r[0], ())) for r in rows}
    left = {d: t for d, t in texts.items() if d not in lost or normal(t)}
    assert {r.doc_id: r.text for r in out} == left

    sets = {r.doc_id: shingle_set(r.text, 5) for r in out}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    keep = set(X.components(sets, links).values())
    frame = spark.createDataFrame([tuple(r) for r in out], docs.schema)
    one = stage["minmax_dedup"](spark, frame, folder).collect()
    assert {r.doc_id for r in one} == keep

    frame = spark.createDataFrame([tuple(r) for r in one], docs.schema)
    sizes = Counter()
    for r in one:
        sizes[r.source] += len((r.text or "").split())
    goal = brute_targets(sizes)
    copies = Counter(r.doc_id for r in stage["source_mixing"](spark, frame, folder).collect())
    rows_of = Counter(r.doc_id for r in one)  # equal rows are taken alike
    for r in one:
        rate, n = goal[r.source] / max(1, sizes[r.source]), rows_of[r.doc_id]
        assert n * int(rate + 1e-9) <= copies[r.doc_id] <= n * (int(rate + 1e-9) + 1)


def test_run_gives_the_last_stage(spark, folder):
    out = P.run(spark, folder)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "piece_ids", "n_pieces", "decoded_exactly"]
    assert out.count() > 0 and out.where("not decoded_exactly").count() == 0


def test_stages_stand_odd_tables(spark, tmp_path):
    """Null labels and columns, repeated rows, columns whose names operators use themselves, and empty tables."""
    rows = [r for r in X.documents() if r[1] is None or len(r[1]) < 3000][:60] + [(None, None, None, None, None), (None, "a b c", None, None, None)]
    odd = X.with_clashes(X.frame(spark, rows)).selectExpr("*", "'own' as piece_ids", "'own' as N_PIECES", "'own' as n_removed", "'own' as target_")
    for n, (docs, labels) in enumerate([
        (odd, [(rows[0][0], None, None), (None, 1, 1), (rows[1][0], 1, 0)]),
        (odd, []),
        (odd.where("false"), [(1, 1, 1)]),
        (odd.where("false"), []),
    ]):
        at = f"{tmp_path}/{n}"
        docs.coalesce(2).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
        given = docs.count()
        for name, stage in P.STAGES[:-1] if n in (0, 3) else P.STAGES[:1]:
            docs = P.written(stage(spark, docs, at), f"test-{name}")
            assert docs.columns == odd.columns and (docs.count() > 0) == (given > 0), name
            if given:
                r = docs.where("text = 'a b c' and doc_id is null").first()
                assert r is None or (r["id"], r["__tk"], r["__mix_size"], r["piece_ids"]) == (0, odd.first()["__tk"], odd.first()["__mix_size"], "own")
        if n not in (0, 3):
            continue
        out = P.STAGES[-1][1](spark, docs, at)
        assert out.columns == [*odd.columns, "piece_ids_", "n_pieces_", "decoded_exactly"]
        assert out.where("not decoded_exactly or piece_ids <> 'own'").count() == 0 and (out.count() > 0) == (given > 0)
    assert P.run(spark, f"{tmp_path}/3").count() == 0
