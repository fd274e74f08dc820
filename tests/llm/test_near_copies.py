import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from plumbline.llm import near_copies

DOCS = "doc_id long, text string, lang string"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Rows that stay by comparing every pair."""
    own = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        place = (k is None, k or 0)
        if find(i) not in best or place < best[find(i)][0]:
            best[find(i)] = (place, k)
    return sorted((k for _, k in best.values()), key=str)


def test_edited_copies_and_rows_without_ids_go(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.sample(words, 60)
    rows, at = [], 0
    for _ in range(40):
        base = rng.sample(words, rng.randrange(8, 120)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, " ".join(text)))
            at += 1
    rows += [(at, rows[0][1]), (at, rows[0][1]), (at + 1, None), (at + 2, " "), (at + 3, "few words"), (None, rows[5][1]), (None, "FEW words")]
    frame = spark.createDataFrame([(k, t, "en") for k, t in rows], DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == brute_kept(rows)


def test_empty(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], DOCS), "").collect() == []


def test_rows_are_told_apart_whatever_their_columns(spark):
    text = "one two three four five six seven"
    kind = "doc_id long, text string, lang string, source string, row string, ROW_ long, _row string, more map<string,int>, n array<int>"
    rows = [(5, text, "x", None, "r", 1, "a", {"k": 1}, [1]), (5, text, None, "x", "r", 1, "a", {"k": 1}, [1]), (5, text, None, "x", "r", 1, "a", {"k": 1}, [1])]
    rows += [(6, "entirely other words stand in here", None, None, None, None, None, None, None), (None, text, "x", None, "r", 2, "b", {}, [])]
    kept = near_copies.deduplicated(spark.createDataFrame(rows, kind))
    assert kept.columns == ["doc_id", "text", "lang", "source", "row", "ROW_", "_row", "more", "n"]
    found = sorted((r.doc_id, r.text, r["row"], r.ROW_, r._row) for r in kept.collect())
    assert found == [(5, text, "r", 1, "a"), (6, "entirely other words stand in here", None, None, None)]


def test_a_passage_that_many_texts_share(spark):
    """Texts of a common passage and own words of all lengths: sizes and places decide who is compared."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for k in range(260):
        own = [f"o{k}x{i}" for i in range(rng.randrange(0, 40))]
        rows.append((k, " ".join([*own, *passage[: rng.randrange(90, 101)]])))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 100, 9)]
    frame = spark.createDataFrame([(k, t, "en") for k, t in rows], DOCS)
    assert sorted((r.doc_id for r in near_copies.deduplicated(frame).collect()), key=str) == brute_kept(rows)


def test_pairs_left_open_against_all_pairs(spark):
    """Whatever the roots, every similar pair of different roots is among the open pairs, by plain join or by bands."""
    rng = random.Random(11)
    sets = [sorted({rng.randrange(3) for _ in range(2)} | {10 + rng.randrange(60) for _ in range(rng.randrange(1, 50))}) for _ in range(220)]
    sets += [sorted(set(s) ^ {rng.randrange(200, 300)}) for s in sets[:60]]
    bits = [near_copies.bits_of(near_copies.np.array(own, "<u4")).tolist() for own in sets]
    rows = [(s, i, len(own), node, node, bits[node]) for node, own in enumerate(sets) for i, s in enumerate(own[: len(own) - -(-4 * len(own) // 5) + 1])]
    left = spark.createDataFrame(rows, "s int, i int, n int, node long, root long, bits array<long>")
    found = {(r.a, r.b) for r in near_copies.open_pairs(left).collect()}
    similar = {(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if 5 * len({*x} & {*y}) >= 4 * len({*x} | {*y})}
    assert similar and similar <= found and max(sum(r[0] == s for r in rows) for s in range(3)) > near_copies.FEW


def test_sets_of_hot_nodes_are_dealt_out(spark):
    nodes = spark.createDataFrame([(i, near_copies.packed(near_copies.np.arange(i % 5, 20, dtype="<u4"))) for i in range(1200)], "node long, packed binary")
    pairs = spark.range(1, 1200).selectExpr("0L as a", "id as b")
    found = near_copies.with_sets(pairs, "a", "x", nodes).collect()
    assert len(found) == 1199 and all(near_copies.set_of(r.x).tolist() == list(range(20)) for r in found)
    assert near_copies.similar(pairs, nodes).count() == 1199


def test_stage_links_by_simhash_first(spark, monkeypatch):
    asked = []
    links = near_copies.linked
    monkeypatch.setattr(near_copies, "linked", lambda distinct: asked.append(distinct.count()) or links(distinct))
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert asked and 2 <= asked[0] <= 3
