"""Queries opN_<name> of the corpus operators, and the DuckDB twin of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.llm import bpe, chat, decontaminate, minhash, permutation, pii, prefix_trie, quality, repeats, spelling, suffixes, toxicity, warc
from tokenmill.llm.base import read


def op1_permutation_index(spark, sf_dir):
    """20 nearest rows of `embeddings` for every row whose vec_id is divisible by 20."""
    t = read(spark, sf_dir, "embeddings")
    return permutation.search(t, t.where("vec_id % 20 = 0"))


def op2_warc_revisits(spark, sf_dir):
    """Revisit records derived from all of `pages`, resolved by the latest earlier full response."""
    out = warc.resolve(warc.captures(read(spark, sf_dir, "pages")))
    return out.select("record_id", "url", "canon", "at", "verdict", "source_id", warc.header_lines(F.col("headers")).alias("headers"))


def op3_minhash_near_duplicates(spark, sf_dir):
    """Whole `documents` on distinct 3-word shingles, linked at 85 % of the union."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), size=3, threshold=85)


def op4_byte_bpe(spark, sf_dir):
    """Whole `documents` through the public multilingual byte-level BPE, and back."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_coder(spark))


def public_coder(spark):
    import public_tokenizers

    return bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_role_repair(spark, sf_dir):
    """All of `conversations`, each turn with its repair and its fragment of the rendered text."""
    return chat.repair(read(spark, sf_dir, "conversations"))


def op6_quality(spark, sf_dir):
    """Quality of all whole `documents`, learnt from heuristic labellers alone."""
    return quality.score(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    """Whole `documents` without the words of 50-word windows that a smaller doc_id has, too."""
    return repeats.remove(read(spark, sf_dir, "documents"), texts=False).drop("kept")


def op8_benchmark_decontamination(spark, sf_dir):
    """Whole `documents` against all 10-word windows of `benchmark`, by training suffix arrays."""
    return decontaminate.digest(decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op9_toxicity(spark, sf_dir):
    """Toxicity of whole `documents`, learnt from `labels` that are not held out."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_pii_surrogates(spark, sf_dir):
    """Whole `documents` with keyed surrogates for personal data and secrets."""
    out = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), found="types")
    return out.select("doc_id", F.size("types").cast("long").alias("n_entities"), F.array_sort(F.array_distinct("types")).alias("types"), "text")


def op11_prefix_trie(spark, sf_dir):
    """All of `conversations`, rebuilt on shared openings, as a prefix trie with leaves and savings of each subtree."""
    return prefix_trie.trie(*prefix_trie.with_openings(prefix_trie.ordered(read(spark, sf_dir, "conversations"))))


def op12_suffix_array_dedup(spark, sf_dir):
    """Whole `documents` without the bytes of 50-byte strings that a smaller doc_id has, too."""
    return suffixes.remove(read(spark, sf_dir, "documents"), bytes_kept=False).drop("kept")


def op13_spelling_variants(spark, sf_dir):
    """All words of whole `documents` with their near words, frequent form and root."""
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_permutation_index, op2_warc_revisits, op3_minhash_near_duplicates, op4_byte_bpe, op5_chat_role_repair, op6_quality, op7_substring_dedup, op8_benchmark_decontamination, op9_toxicity, op10_pii_surrogates, op11_prefix_trie, op12_suffix_array_dedup, op13_spelling_variants)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

# crc32 byte by byte with a table of 256 remainders
_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS crcs FROM (
  SELECT i, list_reduce(list_prepend(i, generate_series(1, 8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM generate_series(0, 255) AS g(i)))"""


def _crc(text: str) -> str:
    byte = lambda at: f"16 * (instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex(encode({text})), 2 * i + 2, 1)) - 1"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(0, CAST(strlen({text}) AS BIGINT) - 1), lambda i: {byte('i')})), lambda c, b: xor(crcs[xor(c, b) % 256 + 1], c // 256)), 4294967295)"


SQL = {
    # brute force; at the size of this comparison every vector is reranked
    "op1_permutation_index": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_aggregate(list_transform(embedding, lambda x: coalesce(CAST(isfinite(x) AS INT), 0)), 'min') = 1
             AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e, x.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, x.e) DESC, x.vec_id) AS rank
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
    "op2_warc_revisits": r"""
WITH b AS (SELECT page_id AS p, url, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS VARCHAR) AS size FROM pages),
t AS (SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag, 'day ' || CAST(CAST(floor(p / 7.0) AS BIGINT) AS VARCHAR) AS day FROM b),
rec AS (
  SELECT 4 * p AS record_id, url, 10 * p AS "at", true AS is_full, CASE WHEN p % 5 <> 4 THEN tag END AS etag, day AS lm, digest,
         ['cache-control: max-age=60', 'content-length: ' || size, 'content-type: text/html', 'date: ' || CAST(10 * p AS VARCHAR)] AS h FROM t
  UNION ALL
  SELECT 4 * p + 1, regexp_replace(url, '^http://', 'HTTP://') || CASE WHEN contains(url, '?') THEN '&utm_campaign=x' ELSE '?utm_campaign=x' END,
         10 * (p + 1 + p % 7) + 3, false, CASE p % 4 WHEN 0 THEN 'W/' || tag WHEN 1 THEN tag WHEN 3 THEN '"stale"' END, CASE WHEN p % 4 = 2 THEN day END, NULL,
         ['cache-control: max-age=120', 'date: ' || CAST(10 * (p + 1 + p % 7) + 3 AS VARCHAR), 'vary: accept'] FROM t
  UNION ALL
  SELECT 4 * p + 2, url, 10 * p - 5, false, tag, day, digest, ['date: ' || CAST(10 * p - 5 AS VARCHAR)] FROM t),
u1 AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS u FROM rec),
u2 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS r FROM u1),
u3 AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(r, '^([^/?]*)', 1)), '^www[.]', ''), CASE scheme WHEN 'https' THEN ':443$' ELSE ':80$' END, '') AS host,
         regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(r, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z_]+|gclid|fbclid)='))) AS q FROM u2),
c AS (SELECT *, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canon FROM u3),
j AS (SELECT a.*, f.record_id AS sid, f.etag AS setag, f.lm AS slm, f.digest AS sdigest, f.h AS sh
      FROM (SELECT * FROM c WHERE NOT is_full) a ASOF LEFT JOIN (SELECT * FROM c WHERE is_full) f ON a.canon = f.canon AND a."at" > f."at"),
v AS (SELECT *, CASE WHEN sid IS NULL THEN 'no-response'
        WHEN etag IS NOT NULL AND setag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = setag THEN 'etag' ELSE 'mismatch' END
        WHEN lm IS NOT NULL AND slm IS NOT NULL THEN CASE WHEN lm = slm THEN 'last-modified' ELSE 'mismatch' END
        WHEN digest IS NOT NULL AND sdigest IS NOT NULL THEN CASE WHEN digest = sdigest THEN 'digest' ELSE 'mismatch' END
        ELSE 'unchecked' END AS verdict FROM j)
SELECT record_id, url, canon, "at", verdict, CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN sid END AS source_id,
       CASE WHEN verdict IN ('etag', 'last-modified', 'digest') THEN
         array_to_string(list_sort(list_concat(h, list_filter(sh, lambda x: NOT list_contains(list_transform(h, lambda y: split_part(y, ':', 1)), split_part(x, ':', 1))))), chr(10)) END AS headers
FROM v""",
    "op3_minhash_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 2], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u AS doc_id, u AS reached FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON e.u = r.reached),
c AS (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 49], 'string_agg', ' ') AS t
        FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 50)),
lo AS (SELECT t, min(doc_id) AS lo FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM win JOIN lo USING (t) WHERE doc_id > lo),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op8_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, list_aggregate(ws[i:i + least(len(ws), 10) - 1], 'string_agg', ' ') AS win
       FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, i, size, list_aggregate(ws[i:i + size - 1], 'string_agg', ' ') AS win
       FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    # texts as hexadecimal digits, two a byte; a byte goes if a window that repeats starts at most 49 before it
    "op12_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, j, substr(x, 2 * j + 1, 698) AS x FROM (SELECT doc_id, x, unnest(generate_series(0, CAST(len(x) / 2 - 1 AS BIGINT), 300)) AS j FROM d WHERE len(x) > 0)),
b AS (SELECT doc_id, j, unnest(generate_series(1, least(300, CAST(len(x) / 2 AS BIGINT)))) AS o, x FROM p),
w AS (SELECT doc_id, j + o AS i, substr(x, 2 * o - 1, 2) AS byte, CASE WHEN len(x) - 2 * o + 2 >= 100 THEN substr(x, 2 * o - 1, 100) END AS win FROM b),
lo AS (SELECT win, min(doc_id) AS lo FROM w WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
m AS (SELECT w.doc_id, i, byte, max(CASE WHEN w.doc_id > lo THEN i END) OVER (PARTITION BY w.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
      FROM w LEFT JOIN lo USING (win)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
             string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
    "op11_prefix_trie": rf"""
WITH {_CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, c - c % 20 AS b, {_crc('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM t), crc_table),
r AS (SELECT c, pos AS o, role, text FROM ids JOIN t ON conv_id = b WHERE pos <= h UNION ALL SELECT c, pos + 3, role, text FROM ids JOIN t ON conv_id = c WHERE pos > h),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o) AS d FROM r),
p AS (SELECT c, d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
             string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS k FROM n
      UNION ALL SELECT c, 0, 0, '' FROM ids),
nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY k, d),
par AS (SELECT a.k, a.d, a.conv_id, a.n_convs, a.words, b.conv_id AS parent, b.k AS pk FROM nodes a LEFT JOIN p ON p.c = a.conv_id AND p.d = a.d - 1 LEFT JOIN nodes b ON b.k = p.k AND b.d = p.d),
kids AS (SELECT pk AS k, d - 1 AS d, count(*) AS n_children FROM par WHERE d > 0 GROUP BY ALL),
tree AS (SELECT par.*, coalesce(n_children, 0) AS n_children FROM par LEFT JOIN kids USING (k, d)),
sub AS (SELECT p.k, p.d, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * tree.words) AS saved FROM tree JOIN p ON p.c = tree.conv_id AND p.d <= tree.d GROUP BY ALL),
last AS (SELECT c, max(d) AS d FROM p GROUP BY c),
ends AS (SELECT p.k, p.d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM last JOIN p USING (c, d) GROUP BY ALL)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM tree JOIN sub USING (k, d) LEFT JOIN ends USING (k, d)""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
h AS (SELECT w, c, {_crc("doc || ':' || w")} AS h FROM runs, crc_table),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % len(w)) || substr(w, h % len(w) + 2) ELSE w END AS w, c FROM h),
v AS (SELECT w AS word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE len(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
holes AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(generate_series(1, len(word))) AS i FROM v)),
near AS (SELECT x.word AS a, y.word AS b FROM holes x JOIN holes y USING (i, a, b) WHERE x.word <> y.word
         UNION SELECT holes.word, v.word FROM holes JOIN v ON v.word = a || b UNION SELECT v.word, holes.word FROM holes JOIN v ON v.word = a || b),
best AS (SELECT near.a AS word, count(*) AS n_near, max(v.n) AS top FROM near JOIN v ON v.word = near.b GROUP BY near.a),
form AS (SELECT best.word, min(near.b) AS form FROM best JOIN near ON near.a = best.word JOIN v ON v.word = near.b AND v.n = top JOIN v o ON o.word = best.word WHERE top >= 2 * o.n GROUP BY best.word),
up AS (SELECT word, word AS place FROM v UNION ALL SELECT up.word, form.form FROM up JOIN form ON form.word = up.place),
root AS (SELECT up.word, place AS root FROM up ANTI JOIN form ON form.word = up.place)
SELECT v.word, form.form, root.root, v.n, coalesce(n_near, 0) AS n_near, f.n AS form_n
FROM v JOIN root USING (word) LEFT JOIN best USING (word) LEFT JOIN form USING (word) LEFT JOIN v f ON f.word = form.form""",
}
