"""DuckDB SQL twins of the Spark queries (the correctness oracle).

They read the same tables (views ``documents``, ``labels`` ...) and state each
result declaratively, so the Spark plan can be compared value by value.
"""

from __future__ import annotations

from tokenmill.config import MaskingConfig
from tokenmill.functions.text import PRETOKENIZE_PATTERN_RE2
from tokenmill.operators import masking

UNK_ID = 3
MASK_ID = 2
CLS_ID = 0
SEP_ID = 1


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def u(seed: str, *keys: str, start: int = 1) -> str:
    inner = ", ".join([_q(seed)] + list(keys))
    return f"(('0x' || substr(md5(concat_ws('|', {inner})), {start}, 8))::BIGINT / 4294967296.0)"


def words_cte(text_expr: str = "text", table: str = "documents", key: str = "doc_id") -> str:
    """Normalised words per row with their position: ``{key}, w_pos, word``."""
    return f"""
words_src AS (
  SELECT {key}, regexp_extract_all(lower(strip_accents({text_expr})), {_q(PRETOKENIZE_PATTERN_RE2)}, 0) AS ws
  FROM {table}
),
words AS (
  SELECT {key}, unnest(range(len(ws))) AS w_pos, unnest(ws) AS word FROM words_src
)"""


def vocab_ctes(vocab_size: int, min_count: int = 2, alphabet_size: int = 100, counts_from: str = "words") -> str:
    """Word counts, alphabet and the words-plus-characters vocabulary: ``vocab(token, id, kind)``."""
    return f"""
wc AS (SELECT word, count(*) AS count FROM {counts_from} GROUP BY word),
alpha AS (
  SELECT ch, sum(count) AS count FROM (
    SELECT unnest(regexp_extract_all(word, '.', 0)) AS ch, count FROM wc
  ) GROUP BY ch ORDER BY count DESC, ch LIMIT {alphabet_size}
),
alpha_n AS (SELECT count(*) AS n, list(ch) AS chars FROM alpha),
base AS (
  SELECT * FROM (VALUES ('[CLS]', 0, 'special'), ('[SEP]', 1, 'special'), ('[MASK]', 2, 'special'), ('[UNK]', 3, 'special')) t(token, id, kind)
  UNION ALL
  SELECT ch, (3 + row_number() OVER (ORDER BY ch))::INTEGER, 'char' FROM alpha
  UNION ALL
  SELECT '##' || ch, (3 + (SELECT n FROM alpha_n) + row_number() OVER (ORDER BY ch))::INTEGER, 'char' FROM alpha
),
top_words AS (
  SELECT word, count FROM wc, alpha_n
  WHERE count >= {min_count} AND length(word) > 1
    AND list_has_all(alpha_n.chars, regexp_extract_all(word, '.', 0))
),
ranked_words AS (
  SELECT word, (row_number() OVER (ORDER BY count DESC, word) - 1 + 4 + 2 * (SELECT n FROM alpha_n))::INTEGER AS id
  FROM top_words
),
vocab AS (
  SELECT token, id, kind FROM base
  UNION ALL
  SELECT word, id, 'word' FROM ranked_words WHERE id < {vocab_size}
),
vocab_n AS (SELECT count(*) AS n FROM vocab)"""


def encode_ctes(max_chars: int = 50, words: str = "words") -> str:
    """Greedy longest-match ids per distinct word: ``enc(word, ids)``.

    With this vocabulary, pieces after the first are single ``##`` characters, and
    the first piece is the longest prefix that is a plain vocabulary token.
    """
    return f"""
dw AS (SELECT DISTINCT word FROM {words}),
prefixes AS (SELECT word, unnest(range(1, least(length(word), {max_chars}) + 1)) AS k FROM dw),
pref AS (
  SELECT p.word, max(p.k) AS k FROM prefixes p JOIN vocab v ON v.token = substr(p.word, 1, p.k) GROUP BY p.word
),
rest AS (SELECT word, k, unnest(range(k + 1, length(word) + 1)) AS i FROM pref),
rest_ids AS (SELECT r.word, r.i, v.id FROM rest r LEFT JOIN vocab v ON v.token = '##' || substr(r.word, r.i, 1)),
rest_agg AS (SELECT word, list(id ORDER BY i) AS ids, count(*) - count(id) AS missing FROM rest_ids GROUP BY word),
enc AS (
  SELECT dw.word,
    CASE WHEN length(dw.word) > {max_chars} OR p.k IS NULL OR coalesce(ra.missing, 0) > 0 THEN [{UNK_ID}]
         ELSE list_concat([vf.id], coalesce(ra.ids, []::INTEGER[])) END AS ids
  FROM dw
  LEFT JOIN pref p ON p.word = dw.word
  LEFT JOIN vocab vf ON vf.token = substr(dw.word, 1, p.k)
  LEFT JOIN rest_agg ra ON ra.word = dw.word
)"""


def doc_ids_cte(key: str = "doc_id", name: str = "doc_ids", words: str = "words", source: str = "words_src") -> str:
    """Per-row id arrays (rows with no words get an empty array)."""
    return f"""
{name} AS (
  SELECT s.{key}, coalesce(d.ids, []::INTEGER[]) AS ids FROM {source} s LEFT JOIN (
    SELECT w.{key}, flatten(list(e.ids ORDER BY w.w_pos)) AS ids FROM {words} w JOIN enc e ON e.word = w.word GROUP BY w.{key}
  ) d ON d.{key} = s.{key}
)"""


def sequences_cte(seq: int = 128) -> str:
    return f"""
seqs AS (
  SELECT doc_id, row_no, list_slice(ids, row_no * {seq} + 1, row_no * {seq} + {seq}) AS tokens FROM (
    SELECT doc_id, ids, unnest(range(len(ids) // {seq})) AS row_no FROM doc_ids
  )
)"""


def corpus_prefix(vocab_size: int, min_count: int = 2, seq: int = 128) -> str:
    return "WITH " + ",".join(
        [words_cte(), vocab_ctes(vocab_size, min_count), encode_ctes(), doc_ids_cte(), sequences_cte(seq)]
    )


def masked_cte(seed: str = "mask", cfg: MaskingConfig = MaskingConfig(), vocab_n: str = "(SELECT n FROM vocab_n)") -> str:
    t1, t2, t3 = masking.thresholds(cfg)
    h = f"md5(concat_ws('|', {_q(seed)}, doc_id, row_no, i))"
    u1 = f"(('0x' || substr({h}, 1, 8))::BIGINT / 4294967296.0)"
    u2 = f"(('0x' || substr({h}, 9, 8))::BIGINT / 4294967296.0)"
    return f"""
tok AS (
  SELECT doc_id, row_no, unnest(range(len(tokens))) AS i, unnest(tokens) AS t FROM seqs
),
tok_c AS (
  SELECT doc_id, row_no, i, t,
    (({u1} >= {t1!r})::INTEGER + ({u1} >= {t2!r})::INTEGER + ({u1} >= {t3!r})::INTEGER) AS choice,
    floor({u2} * {vocab_n})::INTEGER AS rnd
  FROM tok
),
masked AS (
  SELECT doc_id, row_no,
    list(CASE WHEN choice = 1 THEN {MASK_ID} WHEN choice = 2 THEN rnd ELSE t END ORDER BY i) AS input,
    list(t ORDER BY i) AS target,
    list(choice > 0 ORDER BY i) AS mask,
    list(choice ORDER BY i) AS choice
  FROM tok_c GROUP BY doc_id, row_no
)"""


def shard_expr(num_shards: int = 100, seed: str = "shard") -> str:
    return f"floor({u(seed, 'doc_id', 'row_no')} * {num_shards})::INTEGER"


def na_sql() -> str:
    from tokenmill.operators.pairs import DEFAULT_NA_VALUES

    return "(" + ", ".join(_q(v) for v in DEFAULT_NA_VALUES) + ")"


CONV_PAIRS = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS sentence1, a.text AS sentence2
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

DOC_PAIRS = """
doc_pairs AS (
  SELECT doc_id, (i - 1)::INTEGER AS pair_no, ls[i] AS sentence1, coalesce(ls[i + 1], '') AS sentence2, gold_label FROM (
    SELECT d.doc_id, string_split(d.text, chr(10)) AS ls, unnest(generate_series(1, greatest(len(string_split(d.text, chr(10))) - 1, 1))) AS i,
      CASE WHEN l.toxic = 1 THEN 'contradiction' WHEN l.quality = 1 THEN 'entailment' ELSE 'neutral' END AS gold_label
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
)"""


def pair_prefix(vocab_size: int, min_count: int = 2) -> str:
    """Vocabulary from documents, then both sentences of every conversation pair encoded: ``pair_ids(conv_id, turn, a, b)``."""
    pw = f"""
pw_src AS (
  SELECT conv_id, turn, 1 AS part, regexp_extract_all(lower(strip_accents(sentence1)), {_q(PRETOKENIZE_PATTERN_RE2)}, 0) AS ws FROM pairs
  UNION ALL
  SELECT conv_id, turn, 2 AS part, regexp_extract_all(lower(strip_accents(sentence2)), {_q(PRETOKENIZE_PATTERN_RE2)}, 0) AS ws FROM pairs
),
pwords AS (SELECT conv_id, turn, part, unnest(range(len(ws))) AS w_pos, unnest(ws) AS word FROM pw_src)"""
    tail = """
p_ids AS (
  SELECT s.conv_id, s.turn, s.part, coalesce(d.ids, []::INTEGER[]) AS ids FROM pw_src s LEFT JOIN (
    SELECT w.conv_id, w.turn, w.part, flatten(list(e.ids ORDER BY w.w_pos)) AS ids
    FROM pwords w JOIN enc e ON e.word = w.word GROUP BY w.conv_id, w.turn, w.part
  ) d ON d.conv_id = s.conv_id AND d.turn = s.turn AND d.part = s.part
),
pair_ids AS (
  SELECT conv_id, turn, first(ids) FILTER (WHERE part = 1) AS a, first(ids) FILTER (WHERE part = 2) AS b
  FROM p_ids GROUP BY conv_id, turn
)"""
    return "WITH " + ",".join([words_cte(), vocab_ctes(vocab_size, min_count), CONV_PAIRS, pw, encode_ctes(words="pwords"), tail])


def truncated_pairs_cte(max_length: int = 128) -> str:
    L = max_length - 3
    return f"""
lens AS (SELECT conv_id, turn, a, b, len(a) AS la, len(b) AS lb, least(len(a), len(b)) AS s, greatest(len(a), len(b)) AS g FROM pair_ids),
t1 AS (SELECT *, CASE WHEN s > {L} THEN s ELSE greatest(s, {L} - s) END AS tg FROM lens),
t2 AS (SELECT *, (s + tg > {L}) AS over FROM t1),
t3 AS (SELECT *, least(s, CASE WHEN over THEN {L // 2} ELSE s END) AS keep_s,
                 least(g, CASE WHEN over THEN {L // 2 + L % 2} ELSE tg END) AS keep_g FROM t2),
t4 AS (SELECT conv_id, turn, a, b,
         CASE WHEN la + lb <= {L} THEN la WHEN la > lb THEN keep_g ELSE keep_s END AS ka,
         CASE WHEN la + lb <= {L} THEN lb WHEN la > lb THEN keep_s ELSE keep_g END AS kb FROM t3),
trunc AS (
  SELECT conv_id, turn,
    list_concat([{CLS_ID}], list_slice(a, 1, ka), [{SEP_ID}], list_slice(b, 1, kb), [{SEP_ID}]) AS ids,
    list_concat(list_transform(range(ka + 2), lambda x: 0), list_transform(range(kb + 1), lambda x: 1)) AS type_ids
  FROM t4
)"""


def padded_pairs_cte() -> str:
    return f"""
longest AS (SELECT max(len(ids)) AS n FROM trunc),
padded AS (
  SELECT conv_id, turn,
    list_concat(ids, list_transform(range(longest.n - len(ids)), lambda x: {MASK_ID})) AS ids,
    list_concat(type_ids, list_transform(range(longest.n - len(type_ids)), lambda x: 0)) AS type_ids
  FROM trunc, longest
)"""


_SCORED = """
ex AS (SELECT label, unnest(range(len(embedding))) AS d, unnest(embedding) AS x FROM <fitted on>),
cent AS (SELECT label, d, avg(x::DOUBLE) AS m FROM ex GROUP BY label, d),
wrow AS (SELECT label, list(m ORDER BY d) AS w FROM cent GROUP BY label),
wm AS (SELECT list(w ORDER BY label) AS W FROM wrow),
lg AS (
  SELECT vec_id, label, embedding,
    list_transform(wm.W, lambda r: list_reduce(list_transform(list_zip(r, embedding::DOUBLE[]), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0)) AS logits
  FROM embeddings, wm
),
lg2 AS (SELECT *, list_max(logits) AS mx FROM lg),
scored AS (
  SELECT vec_id, label, embedding, logits,
    mx + ln(list_reduce(list_transform(logits, lambda z: exp(z - mx)), lambda x, y: x + y, 0.0)) AS lse,
    list_position(logits, mx) - 1 AS prediction
  FROM lg2
),
scored2 AS (
  SELECT *, lse - logits[label + 1] AS loss, list_transform(logits, lambda z: exp(z - lse)) AS probs FROM scored
)"""


def scored_ctes(fitted_on: str = "embeddings") -> str:
    """All rows scored by the class means of the rows of ``fitted_on``."""
    return _SCORED.replace("<fitted on>", fitted_on)


SCORED = scored_ctes()


def merged_vocab_prefix(vocab_size: int, min_frequency: int, alphabet_size: int = 100) -> str:
    """Merge training, one merge a step: ``mv(token, id, kind)``.

    The recursion holds every word as text with two spaces between symbols; a step
    replaces the most frequent pair (count, then left, then right) in the words that hold
    it and adds a row with a negative key for the merge.
    """
    return "WITH RECURSIVE " + ",".join([words_cte(), vocab_ctes(0, 2, alphabet_size)]) + f""",
sym AS (
  SELECT row_number() OVER (ORDER BY word) AS wid, count, ' ' || array_to_string(s, '  ') || ' ' AS s FROM (
    SELECT word, count, list_transform(list_filter(regexp_extract_all(word, '.', 0), lambda c: list_contains(an.chars, c)),
                                       lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS s FROM wc, alpha_n an)
  WHERE len(s) > 1
),
w(wid, count, s) USING KEY (wid) AS (
  SELECT wid, count::BIGINT, s FROM sym
  UNION
  (WITH cur AS (SELECT wid, count, s FROM recurring.w WHERE wid > 0),
   pr AS (
     SELECT count, unnest(list_slice(t, 1, len(t) - 1)) AS l, unnest(list_slice(t, 2, len(t))) AS r
     FROM (SELECT count, string_split(trim(s), '  ') AS t FROM cur) WHERE len(t) > 1
   ),
   best AS (
     SELECT l, r, CASE WHEN starts_with(r, '##') THEN l || substr(r, 3) ELSE l || r END AS m FROM pr
     GROUP BY l, r HAVING sum(count) >= {min_frequency} ORDER BY sum(count) DESC, l, r LIMIT 1
   ),
   done AS (SELECT count(*) AS n FROM recurring.w WHERE wid < 0)
   SELECT wid, count, replace(s, ' ' || l || '  ' || r || ' ', ' ' || m || ' ') FROM cur, best WHERE contains(s, ' ' || l || '  ' || r || ' ')
   UNION ALL
   SELECT -1 - n, 0, m FROM best, done)
),
new_tokens AS (
  SELECT s AS token, min(-wid) AS step FROM w WHERE wid < 0 AND s NOT IN (SELECT token FROM base) GROUP BY s
),
mv AS (
  SELECT token, id, kind FROM base
  UNION ALL
  SELECT token, id, 'merge' FROM (
    SELECT token, (row_number() OVER (ORDER BY step) + 3 + 2 * (SELECT n FROM alpha_n))::INTEGER AS id FROM new_tokens
  ) WHERE id < {vocab_size}
)"""


def longest_match_ctes(vocab: str = "mv", max_chars: int = 50) -> str:
    """Greedy longest match with any vocabulary: ``enc(word, ids)``; pieces after the first carry ``##``."""
    return f"""
dw AS (SELECT DISTINCT word FROM words),
longest AS (
  SELECT word, a, max(n) AS n FROM (
    SELECT word, a, unnest(range(1, length(word) - a + 2)) AS n FROM (
      SELECT word, unnest(range(1, length(word) + 1)) AS a FROM dw WHERE length(word) <= {max_chars}))
  JOIN {vocab} v ON v.token = CASE WHEN a = 1 THEN '' ELSE '##' END || substr(word, a, n)
  GROUP BY word, a
),
piece AS (
  SELECT word, a, a + n AS b, v.id FROM longest JOIN {vocab} v ON v.token = CASE WHEN a = 1 THEN '' ELSE '##' END || substr(word, a, n)
),
walk AS (
  SELECT word, 1::BIGINT AS a, []::INTEGER[] AS ids FROM dw WHERE length(word) <= {max_chars}
  UNION ALL
  SELECT walk.word, p.b, list_append(walk.ids, p.id) FROM walk JOIN piece p ON p.word = walk.word AND p.a = walk.a
),
enc AS (
  SELECT dw.word, coalesce(k.ids, [{UNK_ID}]) AS ids FROM dw LEFT JOIN (SELECT word, ids FROM walk WHERE a = length(word) + 1) k ON k.word = dw.word
)"""
