import hashlib
import zlib

from pyspark.sql import functions as F

from plumbline.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, row long"


def of(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r[:5]])


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([of(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((leaf((r[0], r[1], r[2], r[3], r[4])), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    trees = [tree([x for x, _ in by[s]]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for i, (own, r) in enumerate(by[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, others = leaf((r[0], r[1], r[2], r[3], text)), []
            for levels, at in ((trees[k], i), (top, k)):
                for nodes in levels[:-1]:
                    first = at - at % 3
                    run = list(nodes[first : first + 3])
                    others += run[: at - first] + run[at - first + 1 :]
                    run[at - first] = now
                    now, at = of(*run), at // 3
            out.append((str(r[0]), s or "", own, trees[k][-1][0], top[-1][0], of(*others), now, now == top[-1][0]))
    return sorted(out)


def proofs(frame):
    return sorted((str(r.id), r.tree or "", r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in merkle.proofs(merkle.leaves(frame, changed={"text": merkle.tampered()})).collect())


def test_against_plain_python(spark):
    rows = [(i, "hot", "en", i, f"text {i}\nline", "t", 1) for i in range(2300)]  # one tree of two supersteps
    rows += [(i, f"s{i % 7}", None if i % 3 else "de", None, None if i % 5 == 0 else f"\n{i}é\n", None, None) for i in range(60)]
    rows += [(None, None, None, None, None, "x", 0), (None, "hot", "", 0, "\n", "x", 0), (7, "one", "en", 1, "", "x", 0), (8, "", "en", 1, "long " * 60_000 + "\n", "x", 0)]
    rows += [(9, "rep", "en", 3, "same\n", "x", 0)] * 11 + [(9, "rep", "en", 4, "other", "x", 0), (-3, "rep", "en", 4, "other", "x", 0)]
    frame = spark.createDataFrame(rows, DOCS).repartition(7, "text")
    assert proofs(frame) == plain(rows)


def test_one_leaf_and_none(spark):
    rows = [(4, None, None, None, "a\nb", None, None)]
    assert proofs(spark.createDataFrame(rows, DOCS)) == plain(rows)
    assert merkle.proofs(merkle.leaves(spark.createDataFrame([], DOCS))).collect() == []


def test_another_id_column_and_untouched_rows_verify(spark):
    rows = spark.range(800).select(F.concat(F.lit("k"), "id").alias("name"), (F.col("id") % 2).alias("kind"), F.lit(None).cast("string").alias("found"))
    found = merkle.proofs(merkle.leaves(rows, ("name", "kind", "found"), tree="kind", key="name")).collect()
    assert len(found) == 800 and all(r.verified for r in found) and len({r.root for r in found}) == 1 and len({r.proof_sha256 for r in found}) == 800
