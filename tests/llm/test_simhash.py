import random

import xxhash
from plumbline.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long"


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """doc_id -> component by comparing every pair."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def test_fingerprint_matches_plain_python():
    for text in ("", " \t\n", "One", "ONE two", "a b c d", "Été É à b", "x y z w v", "a a a a a a b", "w " * 5000):
        assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text), text


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    values = set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 4)):
                seed ^= 1 << rng.randrange(64)
            values.add(seed)
    values |= {0, 1, 3, 2**63, 2**64 - 1}
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    from plumbline.llm.components import components

    for segments in (8, 16):
        found = dict(components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), segments)).collect())
        want = brute_components([(v, v % 2**64) for v in signed])
        for v in signed:
            mates = {w for w in signed if want[w] == want[v]}
            assert {w for w in signed if found.get(w, w) == found.get(v, v)} == mates


def test_documents(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(5, text), (3, text), (3, text), (9, text.upper()), (8, text + " tail"), (1, None), (2, " \n"), (7, "other words stand here today"), (4, "short")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 0) for i, t in rows], DOCS)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, slow_fingerprint(t or "")) for i, t in rows]
    want = brute_components(sorted(set(prints)))
    assert got == {(i, f"{f:016x}", want[i]) for i, f in prints}
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_grid_points_are_listed_by_many_tasks(spark):
    from pyspark.sql import functions as F

    distinct = spark.range(5000).select(F.xxhash64("id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    plan = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    # an exchange of its own, with an exact number of partitions, between the grouping and the listing
    assert "REPARTITION_BY_NUM" in plan
