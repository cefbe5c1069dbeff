"""The pipeline's stages on a small corpus, and the registered queries."""

import random

import pytest

from quadloom.llm.queries import ORACLES, QUERIES

from .helpers import corpus


def test_registration():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    prose = [(i, t * 3 if len(t.split()) < 60 else t) for i, t in corpus()]
    item = "which of the following rivers flows through the largest number of countries on its way to the black sea"
    clean = " ".join(f"word{k}" for k in range(80)) + "."
    rows = [*prose, (900, clean), (901, clean), (902, f"{clean.replace('word', 'term')}\n{item}"), (903, "too short"), (904, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontaminate", "bpe_encode"]
    at, seen = docs, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        at = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen.append({r.doc_id for r in at.select("doc_id").collect()})
        if k < 4:
            assert at.columns == docs.columns
            assert at.where("n_chars <> length(text)").count() == 0
    assert not {903, 904} & seen[0] and {900, 901, 902} <= seen[0]
    assert seen[1] == seen[0]
    assert 900 in seen[2]
    assert 902 in seen[2] and 902 not in seen[3]
    assert seen[4] == seen[3]
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_lines_stage_compares_whole_blocks(spark, tmp_path):
    """Chains of near lines that all share their longest words: of each chain the first line stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(18)
    common = [f"{c * 12}{c}common" for c in "abcd"]
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(6, 9)))
    lines = []
    for k in range(30):
        w = [word() for _ in range(24)]
        for _ in range(8):
            lines.append((k, " ".join(common + w)))
            for at in rng.sample(range(24), 4):
                w[at] = word()
    rng.shuffle(lines)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(lines)], "doc_id long, text string")
    first = {}
    for i, (k, _) in enumerate(lines):
        first.setdefault(k, i)
    assert {r.doc_id for r in pipeline.lines(spark, docs, str(tmp_path)).collect() if r.text} == set(first.values())
