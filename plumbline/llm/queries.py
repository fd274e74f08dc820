"""The queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import ann_collision, byte_bpe, chat, merkle, packing, pii, quality_crf, quality_rules, simhash, token_binary, topk_pivot, toxicity_gbt, vector_codes
from plumbline.llm.common import new_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk_pivot_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_pivot.top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (
  SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 20 = 0 GROUP BY 1
), pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM asked q JOIN v d ON q.vec_id <> d.vec_id AND len(q.x) = len(d.x)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs
) WHERE rank <= 20
"""


def op3_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gbt.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_binary.write(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_binary.read_digests(spark, path)


def op5_simhash_segment_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_ann_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_collision.nearest(table(spark, sf_dir, "embeddings"))


def op7_packing_swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(table(spark, sf_dir, "documents").select("doc_id", pii.candidates(F.col("text")).alias("spans")), "spans")
    kept = pii.accepted(F.col("spans"), pii.train(found))
    base = F.filter("kept", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", kept.alias("kept")).select(
        "doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.shown(base), 256).alias("base_sha256"), pii.shown(F.col("kept")).alias("spans")
    )


def op9_byte_bpe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents")))


def op10_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = f"{chat.END}{chat.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    path = new_path(spark, "chat")
    chat.format_conversations(said.union(extra)).write.option("compression", "zstd").parquet(path)
    return chat.digest(spark.read.parquet(path))


OP10_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, sum(24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) OVER w AS so_far,
         lead(1) OVER w IS NULL AS is_last
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(so_far) FILTER (WHERE role = 'assistant' OR is_last)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op11_merkle_supersteps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.leaves(table(spark, sf_dir, "documents"), changed={"text": merkle.tampered()})
    return merkle.proofs(rows).select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _value(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


#: One tree's levels, then the paths of its leaves folded over them: ``up`` and ``way`` serve both kinds of tree.
OP11_SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source AS tree, sha256({" || ".join(map(_value, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
         sha256({" || ".join(map(_value, ("doc_id", "source", "lang", "n_chars")))} || {_value("CASE WHEN even THEN replace(text, chr(10), '') ELSE text END")}) AS found
  FROM (SELECT *, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1])),
    lambda r, b: xor((CASE WHEN b >= 0 THEN xor(r, b) ELSE r END) >> 1, CASE WHEN (CASE WHEN b >= 0 THEN xor(r, b) ELSE r END) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT) & 1 = 1 AS even FROM documents)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows_
), up AS (
  SELECT tree, 0 AS height, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, height + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY tree, height, i // 3, n
), roots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS height, i, n, h FROM roots
  UNION ALL
  SELECT height + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY height, i // 3, n
), runs AS (SELECT tree, height, i // 3 AS p, list(h ORDER BY i) AS hs FROM up WHERE n > 1 GROUP BY ALL
), top_runs AS (SELECT height, i // 3 AS p, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY ALL
), way AS (
  SELECT tree, i AS leaf_i, 0 AS height, i, n, found AS f, '' AS proof FROM leaves
  UNION ALL
  SELECT w.tree, leaf_i, w.height + 1, w.i // 3, (n + 2) // 3, sha256(array_to_string(hs[:(w.i % 3)::INTEGER], '') || f || array_to_string(hs[(w.i % 3 + 2)::INTEGER:], '')),
         proof || array_to_string(hs[:(w.i % 3)::INTEGER], '') || array_to_string(hs[(w.i % 3 + 2)::INTEGER:], '')
  FROM way w JOIN runs r ON w.tree IS NOT DISTINCT FROM r.tree AND w.height = r.height AND w.i // 3 = r.p WHERE n > 1
), on_ AS (
  SELECT w.tree, leaf_i, 0 AS height, s.i, s.n, f, proof FROM way w JOIN roots s ON w.tree IS NOT DISTINCT FROM s.tree WHERE w.n = 1
  UNION ALL
  SELECT tree, leaf_i, w.height + 1, w.i // 3, (n + 2) // 3, sha256(array_to_string(hs[:(w.i % 3)::INTEGER], '') || f || array_to_string(hs[(w.i % 3 + 2)::INTEGER:], '')),
         proof || array_to_string(hs[:(w.i % 3)::INTEGER], '') || array_to_string(hs[(w.i % 3 + 2)::INTEGER:], '')
  FROM on_ w JOIN top_runs r ON w.height = r.height AND w.i // 3 = r.p WHERE n > 1
)
SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(o.proof) AS proof_sha256, o.f AS folded_root, o.f = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves l JOIN roots s ON l.tree IS NOT DISTINCT FROM s.tree JOIN on_ o ON o.n = 1 AND o.leaf_i = l.i AND o.tree IS NOT DISTINCT FROM l.tree
"""


def op12_hamerly_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("code")).alias("code")
    return vector_codes.with_label_errors(codes).select("vec_id", code, "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _lloyd(rounds: int = 2, width: int = 4) -> str:
    """Assignments a0, a1, ... to codebooks c0, c1, ..., each in full."""
    gap = " + ".join(f"(x{w} - c{w}) * (x{w} - c{w})" for w in range(width))
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS (SELECT rid, part, min({{'d': {gap}, 'k': k}}) AS best FROM parts JOIN c{r} USING (part) GROUP BY 1, 2)")
        if r < rounds:
            sums = ", ".join(f"sum(x{w}) AS s{w}" for w in range(width))
            floors = ", ".join(f"coalesce(((s{w} - ((s{w} % n) + n) % n) // n)::BIGINT, c{w}) AS c{w}" for w in range(width))
            out.append(f"m{r} AS (SELECT part, best.k AS k, count(*) AS n, {sums} FROM a{r} JOIN parts USING (rid, part) GROUP BY 1, 2)")
            out.append(f"c{r + 1} AS (SELECT part, k, {floors} FROM c{r} LEFT JOIN m{r} USING (part, k))")
    return ",\n".join(out)


OP12_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT rid, part, x[4 * part + 1] AS x0, x[4 * part + 2] AS x1, x[4 * part + 3] AS x2, x[4 * part + 4] AS x3 FROM v, range(16) AS t(part)
), first AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS k, x FROM (SELECT vec_id, min(x) AS x FROM v GROUP BY 1)
), c0 AS (
  SELECT part, k, x[4 * part + 1] AS c0, x[4 * part + 2] AS c1, x[4 * part + 3] AS c2, x[4 * part + 4] AS c3 FROM first, range(16) AS t(part) WHERE k < 64
), {_lloyd()},
coded AS (SELECT rid, string_agg(printf('%02x', best.k), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(concat_ws(',', c0, c1, c2, c3), ',' ORDER BY part, k)) FROM c2) AS codebooks_sha256
FROM coded JOIN v USING (rid)
"""


def op13_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_rules.judged(documents, quality_rules.train(documents, table(spark, sf_dir, "labels")))


def queries() -> dict:
    return {
        "op1_quality_line_crf": op1_quality_line_crf,
        "op2_topk_pivot_elimination": op2_topk_pivot_elimination,
        "op3_toxicity_boosted_trees": op3_toxicity_boosted_trees,
        "op4_token_rans": op4_token_rans,
        "op5_simhash_segment_popcount": op5_simhash_segment_popcount,
        "op6_ann_collision_counting": op6_ann_collision_counting,
        "op7_packing_swap_search": op7_packing_swap_search,
        "op8_pii_weak_supervision": op8_pii_weak_supervision,
        "op9_byte_bpe_fold": op9_byte_bpe_fold,
        "op10_chat_prefix_targets": op10_chat_prefix_targets,
        "op11_merkle_supersteps": op11_merkle_supersteps,
        "op12_hamerly_vector_codes": op12_hamerly_vector_codes,
        "op13_quality_decision_list": op13_quality_decision_list,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_pivot_elimination": OP2_SQL, "op10_chat_prefix_targets": OP10_SQL, "op11_merkle_supersteps": OP11_SQL, "op12_hamerly_vector_codes": OP12_SQL}
