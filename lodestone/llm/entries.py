"""The registered queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import fim, fingerprint, langid, line_dedup, mixing, mtree, packing, pii, simhash, spelling, substring_dedup, suffix_dedup, token_file
from lodestone.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), length=200, keep="none")


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read_shards(token_file.write_shards(table(spark, sf_dir, "documents"), end_id=2))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end_id=1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    found = langid.predict(docs, prototypes)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), window=13)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, near=3)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", mtree.quantized(F.col("embedding")).alias("v"))
    return mtree.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fim.restored(fim.transformed(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def queries() -> dict:
    return {"op1_mixing": op1_mixing, "op2_suffix_dedup": op2_suffix_dedup, "op3_token_file": op3_token_file, "op4_pii": op4_pii, "op5_packing": op5_packing, "op6_language": op6_language, "op7_substring_dedup": op7_substring_dedup, "op8_simhash": op8_simhash, "op9_fingerprints": op9_fingerprints, "op10_topk": op10_topk, "op11_spelling": op11_spelling, "op12_line_dedup": op12_line_dedup, "op13_fim": op13_fim}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_substring_dedup": r"""
            WITH d AS (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), g AS (
                SELECT doc_id, p, list_slice(w, p, p + 12) AS x FROM d, unnest(range(1, len(w) - 11)) AS t(p)
            ), f AS (
                SELECT x, min(doc_id) AS first FROM g GROUP BY x
            ), r AS (
                SELECT g.doc_id, g.p FROM g JOIN f ON g.x = f.x WHERE g.doc_id > f.first
            ), c AS (
                SELECT DISTINCT doc_id, q FROM r, unnest(range(p, p + 13)) AS t(q)
            ), k AS (
                SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id
            )
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
                   sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
            FROM d LEFT JOIN k USING (doc_id)
        """,
        "op10_topk": """
            WITH v AS (
                SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
            ), r AS (
                SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
            )
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
        """,
        "op11_spelling": r"""
            WITH RECURSIVE tab AS (
                SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
            ), run AS (
                SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
            ), told AS (
                SELECT doc_id, r, count(*) AS k, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END) AS b
                FROM run WHERE length(r) >= 7 GROUP BY doc_id, r
            ), summed AS (
                SELECT r, k, xor(list_reduce(list_prepend(4294967295, flatten(b)), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS INTEGER) + 1], c >> 8)), 4294967295) AS h FROM told, tab
            ), word AS (
                SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, k FROM summed
            ), w AS (
                SELECT word, CAST(sum(k) AS BIGINT) AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
            ), cut AS (
                SELECT word, n, p, left(word, p) || substr(word, p + 2) AS c FROM w, unnest(range(length(word))) AS u(p)
            ), pair AS (
                SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.p = b.p AND a.c = b.c WHERE a.word <> b.word
                UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.c = b.word
                UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.c = b.word
            ), best AS (
                SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM pair GROUP BY word
            ), formed AS (
                SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best ON best.word = w.word
            ), up AS (
                SELECT word, word AS root FROM formed UNION ALL SELECT up.word, f.form FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NOT NULL
            ), last AS (
                SELECT up.word, up.root FROM up JOIN formed f ON f.word = up.root WHERE f.form IS NULL
            )
            SELECT formed.word, form, root, n, n_near, form_n FROM formed JOIN last ON last.word = formed.word
        """,
        "op12_line_dedup": """
            WITH l AS (
                SELECT doc_id, p, x[p] AS x, translate(trim(x[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS u(p)
            ), m AS (
                SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
            ), j AS (
                SELECT doc_id, p, x, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN m ON m.k = l.k
            )
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
        """,
        "op13_fim": r"""
            WITH d AS (
                SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
            ), h AS (
                SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST(CAST('0x' || substr(s, i, 8) AS UBIGINT) AS BIGINT)) AS h FROM d
            ), f AS (
                SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
                       CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
            ), c AS (
                SELECT doc_id, n, form, t, array_to_string(w[1:lo], '') AS a, array_to_string(w[lo + 1:hi], '') AS b, array_to_string(w[hi + 1:n], '') AS z FROM f
            )
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
        """,
    }
