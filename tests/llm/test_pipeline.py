import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from plumbline.llm import packing, quality_crf, simhash, toxicity_gbt

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(i))
        out.write.parquet(path)
        after = spark.read.parquet(path)
        if i < 4:
            assert after.columns == columns, name
            kept = {r.doc_id: r.text for r in after.collect()}
            assert kept.keys() <= before.keys() and kept
            if name != "pii":
                assert all(before[k] == v for k, v in kept.items())
            else:
                assert kept.keys() == before.keys()
        else:
            assert {r.doc_id for r in after.select("doc_id").collect()} == set(before)
        docs = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_planted_cases(spark):
    text = " ".join(f"alpha{i} beta{i % 7}" for i in range(300))
    rows = [(1, text, "x"), (2, text, "y"), (3, text.upper(), "z"), (4, "entirely different words in here", "x"), (4, "entirely different words in here", "x"), (None, text, "n"), (6, None, "q"), (7, "", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = sorted((r.doc_id or -1, r.text) for r in simhash.deduplicated(frame).collect())
    assert [k for k, _ in kept] == [-1, 1, 4, 6]


def test_packing_keeps_every_token(spark):
    import public_tokenizers

    long = "word " * 9000
    rows = [(i, t, 0) for i, t in enumerate(["", None, long, "short text", "short text", "é" * 3000])] + [(None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, offset long")
    out = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 2)
    total = sum(n for _, _, n in pieces)
    assert pieces[0][2] == (total % 2048 or 2048) and all(n == 2048 for _, _, n in pieces[1:])
    assert sum(1 for r in out if r.doc_id is None) == 1 and packing.pack(frame.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_local_search_empties_bins():
    import random

    rng = random.Random(2)
    saved = 0
    for _ in range(20):
        sizes = [rng.randrange(400, 1400) for _ in range(300)]
        before = packing.best_fit(sizes, 2048)
        after = packing.improve(before, sizes, 2048)
        fills = lambda bins: [sum(sizes[i] for i in b) for b in bins]
        assert sorted(i for b in after for i in b) == list(range(300)) and max(fills(after)) <= 2048
        assert sum(f * f for f in fills(after)) >= sum(f * f for f in fills(before))
        saved += len(before) - len(after)
    assert saved > 0


def test_classifiers_on_odd_input(spark):
    docs = spark.createDataFrame([(i, f"good plain sentence number {i}.\nsecond line here." if i % 2 else "!!! ### $$$ !!!\n### *** $$$", i) for i in range(120)] + [(500, None, 0), (501, "", 0), (None, "x", 0)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(120)] + [(3, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality_crf, toxicity_gbt):
        rows = module.classify(docs, labels).collect()
        assert len(rows) == 123 and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(docs.limit(0), labels).count() == 0
        assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}
    scored = {r.doc_id: r.predicted for r in quality_crf.classify(docs, labels).collect() if r.doc_id is not None and r.doc_id < 120}
    assert all(v == k % 2 for k, v in scored.items())


def test_held_out_quality_and_toxicity(spark):
    from plumbline.llm.queries import op1_quality_line_crf, op3_toxicity_boosted_trees

    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for query, label, least in ((op1_quality_line_crf, "quality", 0.97), (op3_toxicity_boosted_trees, "toxic", 0.95)):
        rows = [r for r in query(spark, sf).where("held_out").collect() if r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][label] for r in rows) / len(rows) >= least


def test_packed_ids_and_number_of_sequences(spark):
    """Every piece's ids by the library, and sequences against their lower bound."""
    import math
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "be ta", "γ", "d-e", "1\n", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 90, 400, 900, 2500])))) for i in range(120)] + [(120, None), (121, "")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in rows}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == ids.keys()
    for i, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids[i])
        assert len(own) == max(1, math.ceil(len(ids[i]) / 2048))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
    sizes = [r.length for r in out]
    bins = len({r.sequence_id for r in out})
    assert max(math.ceil(sum(sizes) / 2048), sum(n > 1024 for n in sizes)) <= bins <= len(packing.best_fit(sizes, 2048))
