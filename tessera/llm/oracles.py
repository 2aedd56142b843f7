"""DuckDB twins of those corpus queries whose whole result SQL can state."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

OP4 = rf"""WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, w[j] AS word, j, CASE WHEN j + 49 <= len(w) THEN md5(array_to_string(w[j:j + 49], ' ')) END AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
f AS (SELECT win, min(doc_id) AS least FROM p WHERE win IS NOT NULL GROUP BY 1),
g AS (SELECT p.doc_id, p.word, p.j, max(CASE WHEN f.least < p.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM p LEFT JOIN f USING (win)),
r AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0), '')) AS kept_sha256 FROM g GROUP BY 1)
SELECT * FROM r UNION ALL SELECT doc_id, 0, 0, sha256('') FROM d WHERE len(w) = 0"""

OP5 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * o >= 85 * (na + nb - o)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS m FROM t GROUP BY 1) ON a = doc_id"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

ORACLE_SQL = {"op4_suffix_tree_substrings": OP4, "op5_trie_jaccard": OP5, "op9_block_pruned_topk": OP9}
