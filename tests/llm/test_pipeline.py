"""The corpus pipeline as wired: each stage on rough and empty tables, the whole on given documents against brute force."""

import corpus_pipeline
import pytest
from sentencepiece import SentencePieceProcessor

from axonframe.llm import language, mixing, pieces

SF = "/root/testdata/sf0.001"
SAME = [name for name, _ in corpus_pipeline.STAGES[:-1]]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_rough_rows(spark, rough, empty, name, stage):
    got = stage(spark, rough, SF)
    assert (got.columns == rough.columns) == (name in SAME)
    told = language.identify(rough, language.fit_language_model(rough)).where("not rejected").count()
    assert 0 < told < 12 and got.count() == {"language ID": told, "line dedup": 12, "MinHash near-dedup": 10, "mixing sources": 12, "SentencePiece encoding": 12}[name]
    assert stage(spark, empty, SF).count() == 0


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language_model(docs)
    left = {r.id for r in language.identify(docs, model).where("not rejected").collect()}
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"file://{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    told, lined, apart, mixed, encoded = steps[1:]
    assert {r.doc_id for r in told.collect()} == left

    before, after = ({r.doc_id: r.text for r in df.collect()} for df in (told, lined))
    assert before.keys() == after.keys()
    seen = set()
    for k in sorted(after):  # what stays is in order, and no line with a word comes twice
        own, lines = iter((before[k] or "").split("\n")), [x for x in (after[k] or "").split("\n") if x.split()]
        assert all(any(x == y for y in own) for x in lines) and not seen & set(lines) and len(set(lines)) == len(lines)
        seen |= set(lines)

    sets = {}
    for k, t in after.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = {k: new if v == old else v for k, v in parent.items()}
    assert {r.doc_id for r in apart.collect()} == {k for k, v in parent.items() if k == v}

    assert sorted(map(str, mixed.collect())) == sorted(map(str, apart.collect()))
    want = {r.doc.doc_id: (r.slot, r.ix) for r in mixing.mix_sources(mixed).collect()}
    got = encoded.collect()
    assert {r.doc_id: (r.slot, r.ix) for r in got} == want
    sp = SentencePieceProcessor(model_file=pieces.MODEL)
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert all(r.ids == sp.encode(text[r.doc_id]) and r.round_trip for r in got)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, got)) and [(r.slot, r.ix) for r in rows] == sorted((r.slot, r.ix) for r in rows)


def test_the_mixing_stage_decides_places(spark, rough, empty, tmp_path):
    """Encoding takes the places that the mix before it gave, whatever its settings, and gives none by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    options = {"weights": {r.source: k % 3 for k, r in enumerate(docs.select("source").distinct().orderBy("source").collect())}, "block_docs": 2}
    want = {r.doc.doc_id: (r.slot, r.ix) for r in mixing.mix_sources(docs, **options).collect()}
    assert want != {r.doc.doc_id: (r.slot, r.ix) for r in mixing.mix_sources(docs).collect()}
    mixing.in_mixed_order(docs, **options).write.parquet(f"file://{tmp_path}/mixed")
    mixed = spark.read.parquet(f"file://{tmp_path}/mixed")
    encoded = corpus_pipeline.encode(spark, mixed, SF)
    assert {r.doc_id: (r.slot, r.ix) for r in encoded.collect()} == want and not encoded.schema["doc_id"].metadata
    assert corpus_pipeline.encode(spark, docs, SF).where("slot is null and ix is null").count() == 200
    both = corpus_pipeline.encode(spark, corpus_pipeline.mix(spark, rough, SF), SF).collect()  # rows that share an id, or have none
    places = [(r.doc.doc_id, r.slot, r.ix) for r in mixing.mix_sources(rough).collect()]
    assert sorted(map(str, ((r.doc_id, r.slot, r.ix) for r in both))) == sorted(map(str, places))
    assert corpus_pipeline.encode(spark, corpus_pipeline.mix(spark, empty, SF), SF).count() == 0
