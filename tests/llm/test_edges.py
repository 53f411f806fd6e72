"""Every operator on rough rows and on an empty table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.llm import language, licenses, lines, mixing, neardup, ngrams, pieces, private, quality, vectors


@pytest.fixture(scope="module")
def model(rough):
    return language.fit_language_model(rough)


@pytest.fixture(scope="module")
def sp():
    return pieces.read_model()


def test_pieces(rough, empty, sp):
    got = pieces.encode_pieces(rough, sp).collect()
    assert len(got) == rough.count() and pieces.encode_pieces(empty, sp).count() == 0
    by = {r.id: r for r in got}
    assert by[3].ids is None and by[3].n_pieces == 0 and by[3].round_trip is None
    assert by[4].ids == [] and all(r.round_trip for r in got if r.ids is not None)
    decoded = {r.id: r.decoded for r in pieces.decode_pieces(pieces.encode_pieces(rough, sp), sp).collect()}
    assert decoded == {r.doc_id: r.text for r in rough.collect()}


def test_quality(rough, empty):
    got = {r.id: r for r in quality.judged(rough).collect()}
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept and got[3].rejected_by == "base"
    assert got[1].kept and got[7].n_dup_lines == 1 and got[7].n_repeat_words == 24 and got[7].base_failed
    assert got[6].n_words == 30_000 and got[6].kept
    assert sorted(quality.cascade_order(rough)) == sorted(quality.RULES)
    assert quality.cascade_order(empty) == list(quality.RULES) and quality.judged(empty).count() == 0
    assert rough.count() == quality.judged(rough).where("kept or not kept").count()


def test_language(rough, empty, model):
    got = language.identify(rough, model).collect()
    assert len(got) == rough.count()
    by = {r.id: r for r in got}
    for k in (3, 4, 5, 10):
        assert by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected
    assert by[7].lang_pred in ("fr", "en") and 0 <= by[7].score <= 1
    kept = language.drop_rejected(rough, model)
    assert kept.columns == rough.columns and 0 < kept.count() < rough.count()
    assert language.identify(empty, model).count() == 0
    nothing = language.fit_language_model(empty)
    assert {r.lang_pred for r in language.identify(rough, nothing).collect()} == {"und"}


def test_lm(rough, empty):
    got = ngrams.scored_texts(rough).collect()
    assert len(got) == rough.count() and ngrams.scored_texts(empty).count() == 0
    by = {r.id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[6].n_tokens == 30_001
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_near_copies(rough, empty):
    got = neardup.linked(rough).collect()
    assert len(got) == rough.count() and neardup.linked(empty).count() == 0
    by = {r.id: r for r in got}
    assert by[2].component_id == 1 and not by[2].kept and by[1].kept
    assert by[3].n_shingles == by[5].n_shingles == 0 and by[3].component_id == 3 and by[4].component_id == 4
    left = neardup.drop_near_copies(rough)
    assert left.columns == rough.columns and left.count() == rough.count() - 2


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-300, 0.0], 1)]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "vec_id long, embedding array<double>, label int, n_links int, component string")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[12] == (3, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 11):
        assert got[k] == (0, k, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_lines(rough, empty):
    got = lines.without_repeated_lines(rough)
    assert got.columns == rough.columns and got.count() == rough.count() and lines.without_repeated_lines(empty).count() == 0
    by = {r.doc_id: r.text for r in got.collect()}
    assert by[2] == "" and by[1].startswith("the quick") and by[7].count("\n") == 0 and by[3] is None and by[5] == " \n\t \n"


def test_lines_by_code_points(spark):
    """Twelve emoji have five shingles; the last one's change leaves four of six, so both lines stay."""
    df = spark.createDataFrame([(1, "😀😁😂😃😄😅😆😇😈😉😊😋"), (2, "😀😁😂😃😄😅😆😇😈😉😊😌")], "doc_id long, text string")
    assert {r.n_fuzzy for r in lines.dedup_lines(df).collect()} == {0}
    assert {r.n_fuzzy for r in lines.dedup_lines(df, 60).collect()} == {0, 1}


def test_licenses(rough, empty):
    got = licenses.scan_licenses(rough).collect()
    assert [(r.id, r.first_line, r.license, r.confirmed) for r in got] == [(9, 0, "MIT-notice", True)]
    assert licenses.scan_licenses(empty).count() == 0


def test_private(rough, empty):
    got = {r.id: r for r in private.pseudonymised(rough, 'k').collect()}
    assert private.pseudonymised(empty, 'k').count() == 0
    r = got[8]
    assert (r.n_email, r.n_phone, r.n_card, r.n_ip, r.n_date) == (1, 1, 1, 1, 1) and "@example.com" in r.text
    for x in ("jo.doe", "123-4567", "4539578763621486", "10.1.2.3", "1985-03-09"):
        assert x not in r.text
    assert got[3].text is None and got[4].text == "" and got[1].n_email == 0


def test_mixing(rough, empty):
    got = mixing.mix_sources(rough, block_docs=2)
    assert got.count() == rough.count() and mixing.mix_sources(empty).count() == 0
    ordered = mixing.in_mixed_order(rough)
    assert ordered.columns == rough.columns and ordered.count() == rough.count()
    weighed = mixing.mix_sources(rough, weights={"a": 3, "b": 1}, stretch=10).groupBy("src").agg(F.max("slot").alias("s")).collect()
    assert {r.src for r in weighed} == {"=a", "=b", "=c", "null"}


def test_components_of_chains_stars_and_loops(spark, monkeypatch):
    """Against a plain union-find, in few tasks and as the session is set to; loops, repeats and nulls are no edges."""
    from axonframe.llm import common

    draw = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in draw.integers(1000, 1300, 200)] + [tuple(map(int, e)) for e in draw.integers(2000, 2600, (250, 2))]
    edges += [(5, 5), (None, 3), (4, None), (101, 100)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 1_000_000):
        monkeypatch.setattr(common, "FEW", few)
        assert {r.node: r.component for r in common.components(df).collect()} == {x: top(x) for x in root}
        assert common.components(df.limit(0)).count() == 0
