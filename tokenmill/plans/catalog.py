"""Registered table queries: one Spark plan and one DuckDB twin per operator.

Every query reads the given tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.plans import corpus as C
from tokenmill.plans import oracle_sql as O

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VALIDATION = 0.2  # share of rows held out by the queries
VS = C.QUERY_VOCAB_SIZE
MC = C.QUERY_MIN_COUNT


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf):
            from tokenmill.session import ship_package

            ship_package(spark)
            return fn(spark, sf)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        SPARK[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------- flagship
@register(
    "op_shard_counts",
    O.corpus_prefix(VS, MC)
    + f"\nSELECT {O.shard_expr()} AS shard, count(*) AS rows FROM seqs GROUP BY 1",
)
def q_shard_counts(spark, sf):
    return C.shard_counts(C.context(spark, sf))


# Shared fragments --------------------------------------------------------------
def _ctx(spark, sf):
    return C.context(spark, sf)


def _table(spark, sf, name):
    from tokenmill.sources.readers import read_table

    return read_table(spark, sf, name)


def _r6(col):
    return F.round(col, 6)


def _r6_arr(col):
    return F.transform(col, lambda x: F.round(x, 6))


CORPUS = O.corpus_prefix(VS, MC)
PAIRS = O.pair_prefix(VS, MC)
MASKED = CORPUS + "," + O.masked_cte()
NA = O.na_sql()


# A. sources and sinks -----------------------------------------------------------
@register("op_scan_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_scan_documents(spark, sf):
    from tokenmill.sources.readers import scan_documents

    return scan_documents(spark, f"{sf}/documents.parquet", ("doc_id", "text", "lang", "source", "n_chars"))


@register(
    "op_scan_text_corpus",
    """SELECT row_number() OVER (ORDER BY doc_id::VARCHAR || '/') - 1 AS file_no, doc_id::VARCHAR AS folder, text || chr(10) AS text FROM documents""",
)
def q_scan_text_corpus(spark, sf):
    """One text file per document, written by Spark, read back whole and numbered in the order of their paths."""
    from tokenmill.session import scratch_path
    from tokenmill.sources.readers import assign_doc_ids, scan_text_corpus
    from tokenmill.sources.sinks import write_texts
    from tokenmill.sources.small_files import reading_many

    path = scratch_path(spark, "books")
    write_texts(_table(spark, sf, "documents"), path, "doc_id", "text")
    # the files are opened once; the paths alone are numbered
    read = scratch_path(spark, "books-read")
    with reading_many(spark):
        scan_text_corpus(spark, path).write.parquet(read)
    files = spark.read.parquet(read)
    folder = F.regexp_extract("path", "doc_id=([^/]*)/[^/]*$", 1)
    numbers = assign_doc_ids(files.select("path"))
    return files.join(numbers, "path").select(F.col("doc_id").alias("file_no"), folder.alias("folder"), "text")


@register(
    "op_scan_pair_tsv",
    "WITH " + O.DOC_PAIRS + f"""
SELECT doc_id, pair_no,
  CASE WHEN sentence1 IN {NA} THEN NULL ELSE sentence1 END AS sentence1,
  CASE WHEN sentence2 IN {NA} THEN NULL ELSE sentence2 END AS sentence2,
  CASE WHEN gold_label IN {NA} THEN NULL ELSE gold_label END AS gold_label
FROM doc_pairs""",
)
def q_scan_pair_tsv(spark, sf):
    """Labelled pairs written as a header TSV to the shared folder, read back in default-NA mode."""
    from tokenmill.operators.pairs import document_pairs
    from tokenmill.session import scratch_path
    from tokenmill.sources.readers import scan_pair_tsv
    from tokenmill.sources.sinks import write_tsv

    path = scratch_path(spark, "pairs-tsv")
    write_tsv(document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")), path)
    return scan_pair_tsv(spark, path, ("doc_id", "pair_no", "sentence1", "sentence2", "gold_label"), default_na=True, types={"doc_id": "long", "pair_no": "int"})


@register(
    "op_write_packed",
    CORPUS + """
SELECT file_no, count(*) AS rows, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (
  SELECT doc_id, (row_number() OVER (ORDER BY doc_id, row_no) - 1) // 1000 AS file_no FROM seqs
) GROUP BY file_no""",
)
def q_write_packed(spark, sf):
    """Raw sequences in numbered files of 1,000 rows, read back: rows per file."""
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import write_packed

    path = scratch_path(spark, "raw")
    write_packed(C.written_sequences(_ctx(spark, sf)), path, 1000)
    back = spark.read.parquet(path)
    return back.groupBy("file_no").agg(
        F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


_SHARD_ROW = "doc_id long, row_no int, input array<int>, target array<int>, mask array<boolean>, shard int, bucket int"
_DIGEST_SQL = "md5(array_to_string(input, ',') || '|' || array_to_string(target, ',') || '|' || array_to_string(list_transform(mask, lambda m: m::INTEGER), ','))"


@register(
    "op_write_shards",
    MASKED + f"""
SELECT doc_id, row_no, {O.shard_expr()} AS shard,
  least(floor({O.u('order', 'doc_id', 'row_no')} * greatest(ceil(count(*) OVER () / 2000.0), 1)), greatest(ceil(count(*) OVER () / 2000.0), 1) - 1)::INTEGER AS bucket,
  row_number() OVER (PARTITION BY {O.shard_expr()} ORDER BY {O.u('order', 'doc_id', 'row_no')}, doc_id, row_no) - 1 AS pos, {_DIGEST_SQL} AS digest FROM masked""",
)
def q_write_shards(spark, sf):
    """Masked rows written one folder per shard and bucket in random order, read back: place and content of every row.

    Files of 20 rows show the split of a shard on small tables, too.
    """
    from tokenmill.operators.shards import shuffle_key
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import write_shards
    from tokenmill.sources.small_files import reading_many

    path = scratch_path(spark, "shards")
    ctx = _ctx(spark, sf)
    raw = C.written_sequences(ctx)
    write_shards(shuffle_key(C.masked_rows(ctx, raw)), path, num_shards=ctx.cfg.data.num_shards, rows_per_file=20, total_rows=raw.count())
    # a row's place in its shard: its place in its file after the rows of the shard's earlier buckets, a file each
    # the files are many and small: they are opened once, what the places follow from is written beside them
    text = lambda c: F.array_join(F.col(c).cast("array<int>").cast("array<string>"), ",")
    digest = F.md5(F.concat(text("input"), F.lit("|"), text("target"), F.lit("|"), text("mask")))
    found = scratch_path(spark, "shard-rows")
    with reading_many(spark):
        back = spark.read.schema(_SHARD_ROW).parquet(path)
        back.select("doc_id", "row_no", "shard", "bucket", digest.alias("digest"), F.col("_metadata.row_index").alias("place")).write.parquet(found)
    back = spark.read.parquet(found)
    files = back.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = files.select("shard", "bucket", F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pos = F.col("before") + F.col("place")
    return back.join(before, ["shard", "bucket"]).select("doc_id", "row_no", "shard", "bucket", pos.cast("long").alias("pos"), "digest")


@register("op_dataset_size", CORPUS + "\nSELECT count(*) AS rows FROM seqs")
def q_dataset_size(spark, sf):
    from tokenmill.operators.checks import is_zero_row
    from tokenmill.operators.sequences import packed_row

    raw = C.raw_sequences(_ctx(spark, sf))
    return raw.select(packed_row(raw).alias("row")).filter(~is_zero_row("row")).agg(F.count(F.lit(1)).alias("rows"))


@register(
    "op_write_predictions",
    "WITH " + O.SCORED + f""",
split AS (SELECT vec_id, {O.u('split', 'vec_id')} AS r FROM embeddings)
SELECT s.vec_id AS index, s.prediction::VARCHAR AS prediction, CASE WHEN sp.r < 0.2 THEN 'validation' ELSE 'train' END AS subset
FROM scored s JOIN split sp ON sp.vec_id = s.vec_id""",
)
def q_write_predictions(spark, sf):
    """Predictions written as headerless TSV, one folder per subset, read back."""
    from tokenmill.operators.shards import validation_split
    from tokenmill.plans.scoring import scored
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import read_predictions, write_predictions

    s = validation_split(scored(spark, sf), ["vec_id"], share=VALIDATION)
    s = s.select(
        F.col("vec_id").alias("index"),
        F.col("prediction").cast("string").alias("prediction"),
        F.when(F.col("is_validation"), "validation").otherwise("train").alias("subset"),
    )
    path = scratch_path(spark, "predictions")
    write_predictions(s, path)
    return read_predictions(spark, path).select("index", "prediction", "subset")


@register("op_save_vocab", CORPUS + "\nSELECT token, id FROM vocab")
def q_save_vocab(spark, sf):
    from tokenmill.session import scratch_path
    from tokenmill.sources.readers import load_vocab
    from tokenmill.sources.sinks import save_vocab

    path = scratch_path(spark, "vocab")
    save_vocab(_ctx(spark, sf).vocab_frame, path)
    return load_vocab(spark, path).select("token", "id")


@register(
    "op_write_metrics",
    "SELECT 'events' AS run, cast(ts AS DATE)::VARCHAR AS epoch, event_id AS step, event_type AS name, value FROM events",
)
def q_write_metrics(spark, sf):
    from tokenmill.operators.stats import metrics_from_events
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import write_metrics

    path = scratch_path(spark, "metrics")
    write_metrics(metrics_from_events(_table(spark, sf, "events")), path)
    return spark.read.parquet(path).select("run", "epoch", "step", "name", "value")


# B. projections, filters, checks -------------------------------------------------
@register(
    "op_paragraph_filter",
    """SELECT doc_id, array_to_string(list_filter(
         string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
         lambda p: length(p) > 20), chr(10)) AS text FROM documents""",
)
def q_paragraph_filter(spark, sf):
    """Paragraph filter with a single newline as delimiter (the documents hold no blank lines)."""
    from tokenmill.functions.text import paragraph_filter

    return _table(spark, sf, "documents").select("doc_id", paragraph_filter("text", "\n", 20).alias("text"))


@register(
    "op_split_lines",
    "SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)",
)
def q_split_lines(spark, sf):
    from tokenmill.functions.text import split_lines

    return _table(spark, sf, "documents").select("doc_id", F.posexplode(split_lines("text")).alias("line_no", "line"))


@register("op_project_columns", "SELECT conv_id, turn, text FROM conversations")
def q_project_columns(spark, sf):
    return _table(spark, sf, "conversations").select("conv_id", "turn", "text")


@register(
    "op_pair_length_filter",
    "WITH " + O.DOC_PAIRS + "\nSELECT doc_id, pair_no, sentence1, sentence2, gold_label FROM doc_pairs WHERE length(sentence1) < 1000 AND length(sentence2) < 1000",
)
def q_pair_length_filter(spark, sf):
    from tokenmill.operators.pairs import document_pairs, length_filter

    return length_filter(document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")))


_LABEL_CASE = "CASE gold_label WHEN 'neutral' THEN 0 WHEN 'entailment' THEN 1 WHEN 'contradiction' THEN 2 END"


@register("op_label_encode", "WITH " + O.DOC_PAIRS + f"\nSELECT doc_id, pair_no, gold_label, {_LABEL_CASE} AS label_id FROM doc_pairs")
def q_label_encode(spark, sf):
    from tokenmill.operators.pairs import document_pairs, label_encode

    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return p.select("doc_id", "pair_no", "gold_label", label_encode("gold_label").alias("label_id"))


@register(
    "op_label_decode",
    "WITH " + O.DOC_PAIRS + f"\nSELECT doc_id, pair_no, {_LABEL_CASE} AS label_id, ['neutral', 'entailment', 'contradiction'][{_LABEL_CASE} + 1] AS label FROM doc_pairs",
)
def q_label_decode(spark, sf):
    from tokenmill.operators.pairs import document_pairs, label_decode, label_encode

    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    p = p.select("doc_id", "pair_no", label_encode("gold_label").alias("label_id"))
    return p.withColumn("label", label_decode("label_id"))


_SUBSET = f"CASE WHEN {O.u('subset', 'conv_id', 'turn')} < 0.5 THEN 'matched' ELSE 'mismatched' END"


def _tagged_pairs(spark, sf):
    from tokenmill.functions.rng import uniform
    from tokenmill.operators.pairs import conversation_pairs

    p = conversation_pairs(_table(spark, sf, "conversations"))
    return p.withColumn("subset", F.when(uniform("subset", "conv_id", "turn") < 0.5, "matched").otherwise("mismatched"))


@register(
    "op_subset_select",
    "WITH " + O.CONV_PAIRS + f"\nSELECT conv_id, turn, sentence1, sentence2, subset FROM (SELECT *, {_SUBSET} AS subset FROM pairs) WHERE subset = 'matched'",
)
def q_subset_select(spark, sf):
    return _tagged_pairs(spark, sf).filter(F.col("subset") == "matched")


@register(
    "op_union_all",
    "WITH " + O.CONV_PAIRS + f""",
t AS (SELECT *, {_SUBSET} AS subset FROM pairs)
SELECT conv_id, turn, sentence1, sentence2, subset FROM t WHERE subset = 'matched'
UNION ALL
SELECT conv_id, turn, sentence1, sentence2, subset FROM t WHERE subset = 'mismatched'""",
)
def q_union_all(spark, sf):
    from tokenmill.operators.pairs import union_all

    t = _tagged_pairs(spark, sf)
    return union_all(t.filter(F.col("subset") == "matched"), t.filter(F.col("subset") == "mismatched"))


@register(
    "op_zero_row_check",
    CORPUS + """
SELECT sum(zr) AS zero_rows, count_if(all_zero) AS zero_chunks, count(*) AS chunks FROM (
  SELECT doc_id, count_if(z) AS zr, bool_and(z) AS all_zero FROM (
    SELECT doc_id, NOT list_bool_or(list_transform(list_concat([doc_id >> 16, doc_id & 65535, row_no], tokens), lambda x: x != 0)) AS z FROM seqs
  ) GROUP BY doc_id
)""",
)
def q_zero_row_check(spark, sf):
    from tokenmill.operators.checks import zero_row_report
    from tokenmill.operators.sequences import packed_row

    raw = C.raw_sequences(_ctx(spark, sf))
    return zero_row_report(raw.select("doc_id", packed_row(raw).alias("row")), "row", ("doc_id",))


@register(
    "op_range_check",
    CORPUS + f""",
v AS (
  SELECT 'tokens' AS name, unnest(tokens) AS t, 65535 AS hi FROM seqs
  UNION ALL SELECT 'id_hi', doc_id >> 16, 65535 FROM seqs
  UNION ALL SELECT 'id_lo', doc_id & 65535, 65535 FROM seqs
  UNION ALL SELECT 'shard', {O.shard_expr()}, 99 FROM seqs
)
SELECT name, min(t)::BIGINT AS min_value, max(t)::BIGINT AS max_value, count_if(t < 0 OR t > hi) AS out_of_range FROM v GROUP BY name""",
)
def q_range_check(spark, sf):
    """Every stored number within its width: tokens, id halves, shard numbers."""
    from tokenmill.operators.checks import range_reports
    from tokenmill.operators.shards import assign_shard

    rows = assign_shard(C.raw_sequences(_ctx(spark, sf)), 100)
    return range_reports(rows, {"tokens": (0, 65535), "id_hi": (0, 65535), "id_lo": (0, 65535), "shard": (0, 99)})


@register(
    "op_quality_assert",
    CORPUS + "," + O.SCORED + "," + O.DOC_PAIRS + f"""
SELECT (SELECT count_if(isnan(loss)) FROM scored2) AS nan_losses,
       (SELECT count_if(({_LABEL_CASE}) IS NULL) FROM doc_pairs) AS unknown_labels,
       (SELECT count(*) FROM seqs) - (SELECT sum(rows) FROM (SELECT {O.shard_expr()} AS shard, count(*) AS rows FROM seqs GROUP BY 1))::BIGINT AS rows_not_counted""",
)
def q_quality_assert(spark, sf):
    from tokenmill.operators.checks import quality_report
    from tokenmill.operators.pairs import document_pairs, label_encode
    from tokenmill.operators.shards import assign_shard, shuffle_key
    from tokenmill.plans.scoring import scored
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import write_shards

    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")).withColumn("label_id", label_encode("gold_label"))
    report = quality_report(scored(spark, sf), "loss", p, "label_id")
    # the rows of the written shard files, each counted in its own shard's folder, are the size of the dataset
    path = scratch_path(spark, "counted-shards")
    raw = C.written_sequences(_ctx(spark, sf))
    write_shards(shuffle_key(assign_shard(raw, 100)), path, total_rows=raw.count())
    counted = spark.read.parquet(path).groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).agg(F.sum("rows").alias("n")).scalar()
    return report.withColumn("rows_not_counted", raw.agg(F.count(F.lit(1))).scalar() - F.coalesce(counted, F.lit(0)))


@register(
    "op_drop_empty_chunks",
    CORPUS + "\nSELECT doc_id, len(ids) AS n_tokens, len(ids) // 128 AS n_sequences FROM doc_ids",
)
def q_drop_empty_chunks(spark, sf):
    from tokenmill.operators.sequences import chunks

    enc = C.encoded_documents(_ctx(spark, sf))
    return enc.select("doc_id", F.size("ids").alias("n_tokens"), F.size(chunks("ids", 128)).alias("n_sequences"))


# C. text and vocabulary ------------------------------------------------------------
@register("op_normalize_text", "SELECT doc_id, lower(strip_accents(text)) AS text FROM documents")
def q_normalize_text(spark, sf):
    from tokenmill.functions.text import normalize

    return _table(spark, sf, "documents").select("doc_id", normalize("text").alias("text"))


@register(
    "op_pretokenize",
    f"SELECT doc_id, regexp_extract_all(text, {O._q(O.PRETOKENIZE_PATTERN_RE2)}, 0) AS words FROM documents",
)
def q_pretokenize(spark, sf):
    from tokenmill.functions.text import pretokenize

    return _table(spark, sf, "documents").select("doc_id", pretokenize("text").alias("words"))


@register("op_fix_text")
def q_fix_text(spark, sf):
    """Text repair of raw web pages (entities, escapes, quotes, line breaks, controls, NFKD)."""
    from tokenmill.functions.text import fix_text

    return _table(spark, sf, "pages").select("page_id", fix_text("html").alias("text"))


def _straighten_sql(expr: str) -> str:
    escapes = "chr(27) || '\\[[0-9;]*[A-Za-z]'"
    breaks = "chr(13) || chr(10) || '|[' || chr(13) || chr(8232) || chr(8233) || chr(133) || ']'"
    controls = r"'[\x{00}-\x{08}\x{0b}\x{0e}-\x{1f}\x{7f}\x{206a}-\x{206f}\x{feff}\x{fff9}-\x{fffc}]'"
    single = "chr(700) || chr(8216) || chr(8217) || chr(8218) || chr(8219)"
    double = "chr(8220) || chr(8221) || chr(8222) || chr(8223)"
    t = f"regexp_replace({expr}, {escapes}, '', 'g')"
    t = f"translate(translate({t}, {single}, repeat(chr(39), 5)), {double}, repeat(chr(34), 4))"
    return f"regexp_replace(regexp_replace({t}, {breaks}, chr(10), 'g'), {controls}, '', 'g')"


# The entities that the pages hold, decoded in SQL; the ampersand's own comes last.
_ENTITIES_SQL = "regexp_replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', chr(34)), '&amp;?', '&', 'g')"


@register("op_fix_text_steps", f"SELECT page_id, {_straighten_sql(_ENTITIES_SQL)} AS text FROM pages")
def q_fix_text_steps(spark, sf):
    """The repair before its last step (NFKD): entities, encoding, escapes, quotes, line breaks, controls."""
    from tokenmill.functions.text import decode_entities, straighten

    return _table(spark, sf, "pages").select("page_id", straighten(decode_entities("html")).alias("text"))


@register("op_wordpiece_encode", CORPUS + "\nSELECT word, ids FROM enc")
def q_wordpiece_encode(spark, sf):
    """Every distinct corpus word with its subword ids."""
    from tokenmill.operators.vocab import corpus_words

    ctx = _ctx(spark, sf)
    words = corpus_words(ctx.documents).select("word").distinct()
    return words.select("word", ctx.encoder.encode_words(F.array("word")).alias("ids"))


@register("op_encode_plain", CORPUS + "\nSELECT doc_id, ids FROM doc_ids")
def q_encode_plain(spark, sf):
    return C.encoded_documents(_ctx(spark, sf))


@register(
    "op_encode_single",
    CORPUS + f"\nSELECT doc_id, list_concat([{O.CLS_ID}], list_slice(ids, 1, 126), [{O.SEP_ID}]) AS ids FROM doc_ids",
)
def q_encode_single(spark, sf):
    ctx = _ctx(spark, sf)
    return C.encoded_documents(ctx).select("doc_id", ctx.encoder.encode_single("ids", 128).alias("ids"))


@register(
    "op_encode_pair",
    PAIRS + f"""
SELECT conv_id, turn, list_concat([{O.CLS_ID}], a, [{O.SEP_ID}], b, [{O.SEP_ID}]) AS ids,
  list_concat(list_transform(range(len(a) + 2), lambda x: 0), list_transform(range(len(b) + 1), lambda x: 1)) AS type_ids
FROM pair_ids""",
)
def q_encode_pair(spark, sf):
    from tokenmill.operators.pairs import conversation_pairs

    return C.encoded_pairs(_ctx(spark, sf), conversation_pairs(_table(spark, sf, "conversations")))


@register("op_truncate", PAIRS + "," + O.truncated_pairs_cte() + "\nSELECT conv_id, turn, ids, type_ids FROM trunc")
def q_truncate(spark, sf):
    from tokenmill.operators.pairs import conversation_pairs

    return C.encoded_pairs(_ctx(spark, sf), conversation_pairs(_table(spark, sf, "conversations")), 128)


@register(
    "op_truncate_plain",
    CORPUS + f"\nSELECT doc_id, list_slice(list_concat([{O.CLS_ID}], ids, [{O.SEP_ID}]), 1, 128) AS ids FROM doc_ids",
)
def q_truncate_plain(spark, sf):
    """The plain cut of a single encoding: the first 128 ids, whatever they are, so a long text loses its [SEP]."""
    ctx = _ctx(spark, sf)
    return C.encoded_documents(ctx).select("doc_id", F.slice(ctx.encoder.encode_single("ids"), 1, 128).alias("ids"))


PADDED = PAIRS + "," + O.truncated_pairs_cte() + "," + O.padded_pairs_cte()


@register("op_pad", PADDED + "\nSELECT conv_id, turn, ids, type_ids FROM padded")
def q_pad(spark, sf):
    from tokenmill.operators.pairs import conversation_pairs

    return C.padded_pairs(_ctx(spark, sf), conversation_pairs(_table(spark, sf, "conversations")))


@register("op_max_length", PAIRS + "," + O.truncated_pairs_cte() + "\nSELECT max(len(ids)) AS max_length FROM trunc")
def q_max_length(spark, sf):
    from tokenmill.operators.pairs import conversation_pairs
    from tokenmill.operators.stats import max_length

    return max_length(C.encoded_pairs(_ctx(spark, sf), conversation_pairs(_table(spark, sf, "conversations")), 128))


def _decode_sql(ids_expr: str, skip_special: bool) -> str:
    from tokenmill.operators.encode import NO_SPACE_BEFORE

    toks = f"list_transform({ids_expr}, lambda i: vt.vtoks[i + 1])"
    if skip_special:
        toks = f"list_transform(list_filter({ids_expr}, lambda i: i > 3), lambda i: vt.vtoks[i + 1])"
    starts = " OR ".join(f"starts_with(t, {O._q(p)})" for p in NO_SPACE_BEFORE)
    return (
        f"array_to_string(list_transform({toks}, lambda t, j: CASE WHEN j = 1 THEN t "
        f"WHEN starts_with(t, '##') THEN substr(t, 3) WHEN {starts} THEN t ELSE ' ' || t END), '')"
    )


VOCAB_TOKENS = "vt AS (SELECT list(token ORDER BY id) AS vtoks FROM vocab)"


@register("op_decode", CORPUS + "," + VOCAB_TOKENS + f"\nSELECT doc_id, row_no, {_decode_sql('tokens', True)} AS text FROM seqs, vt")
def q_decode(spark, sf):
    ctx = _ctx(spark, sf)
    raw = C.raw_sequences(ctx)
    return raw.select("doc_id", "row_no", ctx.encoder.decode("tokens").alias("text"))


@register(
    "op_highlight_mask",
    MASKED + "," + VOCAB_TOKENS + f"\nSELECT doc_id, row_no, replace({_decode_sql('input', False)}, '[MASK]', '**[MASK]**') AS text FROM masked, vt",
)
def q_highlight_mask(spark, sf):
    from tokenmill.operators.encode import highlight_mask

    ctx = _ctx(spark, sf)
    m = C.masked_rows(ctx)
    return m.select("doc_id", "row_no", highlight_mask(ctx.encoder.decode("input", skip_special_tokens=False)).alias("text"))


@register("op_word_counts", CORPUS + "\nSELECT word, count FROM wc")
def q_word_counts(spark, sf):
    from tokenmill.operators.vocab import word_counts

    return word_counts(C.documents(spark, sf))


@register("op_alphabet", CORPUS + "\nSELECT ch AS char, count FROM alpha")
def q_alphabet(spark, sf):
    from tokenmill.operators.vocab import alphabet, word_counts

    return alphabet(word_counts(C.documents(spark, sf)), 100)


@register(
    "op_pair_counts",
    CORPUS + """,
sym AS (
  SELECT word, count, list_transform(list_filter(regexp_extract_all(word, '.', 0), lambda c: list_contains(an.chars, c)),
                                     lambda c, i: CASE WHEN i = 1 THEN c ELSE '##' || c END) AS s
  FROM wc, alpha_n an
),
pr AS (SELECT count, unnest(list_slice(s, 1, len(s) - 1)) AS l, unnest(list_slice(s, 2, len(s))) AS r FROM sym WHERE len(s) > 1)
SELECT l AS "left", r AS "right", sum(count) AS count FROM pr GROUP BY l, r HAVING sum(count) >= 2""",
)
def q_pair_counts(spark, sf):
    from tokenmill.operators.vocab import alphabet, pair_counts, word_counts, word_symbols
    from tokenmill.session import scratch_path

    # the corpus is tokenised once: alphabet and symbols read the written counts
    path = scratch_path(spark, "word-counts")
    word_counts(C.documents(spark, sf)).write.parquet(path)
    wc = spark.read.parquet(path)
    return pair_counts(word_symbols(wc, alphabet(wc, 100)), 2)


_TRAINING = C.Config().tokenizer
TRAINED = O.merged_vocab_prefix(_TRAINING.vocab_size, _TRAINING.min_token_frequency, _TRAINING.max_alphabet_size)


@register("op_train_vocab", TRAINED + "\nSELECT token, id, kind FROM mv")
def q_train_vocab(spark, sf):
    """Merge training on the corpus word counts with the configured size and least frequency."""
    return C.merge_vocabulary(spark, sf).vocabulary


@register(
    "op_encode_merged",
    TRAINED + "," + O.longest_match_ctes("mv", _TRAINING.max_chars_per_word) + "," + O.doc_ids_cte() + "\nSELECT doc_id, ids FROM doc_ids",
)
def q_encode_merged(spark, sf):
    """All documents encoded with the vocabulary trained on them (training and encoding as one plan)."""
    from tokenmill.operators.encode import Encoder
    from tokenmill.operators.vocab import Vocab

    cfg = C.Config()
    vocab = Vocab.from_frame(C.merge_vocabulary(spark, sf, cfg).vocabulary)
    enc = Encoder(vocab, spark, cfg.tokenizer.max_chars_per_word)
    return C.documents(spark, sf).select("doc_id", enc.encode_plain("text").alias("ids"))


@register(
    "op_vocab_lookup",
    CORPUS + "\nSELECT wc.word, wc.count, v.id FROM wc LEFT JOIN vocab v ON v.token = wc.word",
)
def q_vocab_lookup(spark, sf):
    from tokenmill.operators.vocab import lookup_ids, word_counts

    ctx = _ctx(spark, sf)
    return lookup_ids(word_counts(ctx.documents), ctx.vocab_frame, "word", "id").select("word", "count", "id")


# D. sequences and arrays ---------------------------------------------------------------
@register("op_chunk_sequences", CORPUS + "\nSELECT doc_id, row_no, tokens FROM seqs")
def q_chunk_sequences(spark, sf):
    return C.raw_sequences(_ctx(spark, sf)).select("doc_id", "row_no", "tokens")


@register(
    "op_pack_article",
    CORPUS + "\nSELECT doc_id, row_no, list_concat([(doc_id >> 16)::INTEGER, (doc_id & 65535)::INTEGER, row_no::INTEGER], tokens) AS row FROM seqs",
)
def q_pack_article(spark, sf):
    from tokenmill.operators.sequences import packed_row

    raw = C.raw_sequences(_ctx(spark, sf))
    return raw.select("doc_id", "row_no", packed_row(raw).alias("row"))


_KEY = "(event_id * 104729 - 1000000)"


@register("op_encode_id", f"SELECT event_id, {_KEY} AS key, {_KEY} >> 16 AS id_hi, {_KEY} & 65535 AS id_lo FROM events")
def q_encode_id(spark, sf):
    from tokenmill.operators.sequences import encode_id_hi, encode_id_lo

    ev = _table(spark, sf, "events").select("event_id", (F.col("event_id") * 104729 - 1000000).alias("key"))
    return ev.select("event_id", "key", encode_id_hi("key").alias("id_hi"), encode_id_lo("key").alias("id_lo"))


@register(
    "op_decode_id",
    f"SELECT event_id, {_KEY} AS key, (({_KEY} >> 16) * 65536) | (({_KEY} & 65535) & 65535) AS decoded FROM events",
)
def q_decode_id(spark, sf):
    from tokenmill.operators.sequences import decode_id, encode_id_hi, encode_id_lo

    ev = _table(spark, sf, "events").select("event_id", (F.col("event_id") * 104729 - 1000000).alias("key"))
    return ev.select("event_id", "key", decode_id(encode_id_hi("key"), encode_id_lo("key")).alias("decoded"))


@register("op_mask_tokens", MASKED + "\nSELECT doc_id, row_no, input, target, mask FROM masked")
def q_mask_tokens(spark, sf):
    from tokenmill.operators.masking import mask_tokens

    ctx = _ctx(spark, sf)
    raw = C.raw_sequences(ctx).select("doc_id", "row_no", "tokens")
    return mask_tokens(raw, ctx.vocab.mask_id, ctx.vocab.size, ctx.cfg.data.masking)


FLAT_SQL = """list_concat([(doc_id >> 16)::INTEGER, (doc_id & 65535)::INTEGER, row_no::INTEGER], input, target,
  list_transform(mask, lambda m: m::INTEGER))"""


@register("op_flat_row", MASKED + f"\nSELECT doc_id, row_no, {FLAT_SQL} AS row FROM masked")
def q_flat_row(spark, sf):
    from tokenmill.operators.masking import mask_tokens
    from tokenmill.operators.sequences import flat_row

    ctx = _ctx(spark, sf)
    raw = C.raw_sequences(ctx)
    m = mask_tokens(raw, ctx.vocab.mask_id, ctx.vocab.size, ctx.cfg.data.masking)
    return m.select("doc_id", "row_no", flat_row().alias("row"))


@register(
    "op_unpack_row",
    MASKED + "\nSELECT doc_id, row_no, [(doc_id >> 16)::INTEGER, (doc_id & 65535)::INTEGER, row_no::INTEGER] AS meta, input, target, mask FROM masked",
)
def q_unpack_row(spark, sf):
    from tokenmill.operators.masking import mask_tokens
    from tokenmill.operators.sequences import flat_row, unpack_row

    ctx = _ctx(spark, sf)
    raw = C.raw_sequences(ctx)
    flat = mask_tokens(raw, ctx.vocab.mask_id, ctx.vocab.size, ctx.cfg.data.masking).select("doc_id", "row_no", flat_row().alias("row"))
    parts = unpack_row("row", ctx.cfg.data.sequence_size)
    return flat.select("doc_id", "row_no", *[v.alias(k) for k, v in parts.items()])


@register(
    "op_batches",
    CORPUS + """,
numbered AS (SELECT doc_id, row_no, row_number() OVER (ORDER BY doc_id, row_no) - 1 AS r, count(*) OVER () AS n FROM seqs)
SELECT doc_id, row_no, r // 16 AS batch_no FROM numbered WHERE r < (n // 16) * 16""",
)
def q_batches(spark, sf):
    from tokenmill.operators.sequences import batches

    raw = C.raw_sequences(_ctx(spark, sf)).select("doc_id", "row_no")
    return batches(raw, ["doc_id", "row_no"], 16, drop_last=True)


@register(
    "op_key_mask",
    PADDED + f"\nSELECT conv_id, turn, list_transform(ids, lambda t: t != {O.MASK_ID}) AS key_mask FROM padded",
)
def q_key_mask(spark, sf):
    from tokenmill.operators.pairs import conversation_pairs
    from tokenmill.operators.sequences import key_mask

    ctx = _ctx(spark, sf)
    p = C.padded_pairs(ctx, conversation_pairs(_table(spark, sf, "conversations")))
    return p.select("conv_id", "turn", key_mask("ids", ctx.vocab.mask_id).alias("key_mask"))


@register(
    "op_masked_positions",
    MASKED + """
SELECT doc_id, row_no, pos, target FROM (
  SELECT doc_id, row_no, unnest(range(len(target))) AS pos, unnest(target) AS target, unnest(mask) AS m FROM masked
) WHERE m""",
)
def q_masked_positions(spark, sf):
    from tokenmill.operators.masking import mask_tokens
    from tokenmill.operators.sequences import masked_positions

    ctx = _ctx(spark, sf)
    m = mask_tokens(C.raw_sequences(ctx), ctx.vocab.mask_id, ctx.vocab.size, ctx.cfg.data.masking)
    return masked_positions(m)


# E. joins ---------------------------------------------------------------------------------
@register(
    "op_embedding_lookup",
    PADDED + """
SELECT p.conv_id, p.turn, p.pos, p.id, e.embedding FROM (
  SELECT conv_id, turn, unnest(range(len(ids))) AS pos, unnest(ids) AS id FROM padded
) p LEFT JOIN embeddings e ON e.vec_id = p.id % (SELECT count(*) FROM embeddings)""",
)
def q_embedding_lookup(spark, sf):
    """A vector for every token id of the padded pair encodings; ids wrap around the table's rows, no token is lost."""
    from tokenmill.operators.pairs import conversation_pairs
    from tokenmill.operators.scoring import gather_rows

    p = C.padded_pairs(_ctx(spark, sf), conversation_pairs(_table(spark, sf, "conversations")))
    tok = p.select("conv_id", "turn", F.posexplode("ids").alias("pos", "id"))
    emb = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    rows = emb.agg(F.count(F.lit(1))).scalar()
    tok = tok.withColumn("row", F.pmod(F.col("id").cast("long"), rows))
    return gather_rows(tok, "row", emb, "vec_id").select("conv_id", "turn", "pos", "id", "embedding")


@register(
    "op_positional_zip",
    CORPUS + f"""
SELECT doc_id, row_no, len(tokens) AS n_tokens, {O.shard_expr()} AS shard FROM seqs""",
)
def q_positional_zip(spark, sf):
    """Sequences paired with their shard numbers."""
    from tokenmill.operators.shards import assign_shard

    # both sides are columns of one row, so nothing has to be encoded twice or joined
    raw = assign_shard(C.raw_sequences(_ctx(spark, sf)), 100)
    return raw.select("doc_id", "row_no", F.size("tokens").alias("n_tokens"), "shard")


@register(
    "op_label_join",
    "WITH " + O.DOC_PAIRS + f""",
lt AS (SELECT * FROM (VALUES (0, 'neutral'), (1, 'entailment'), (2, 'contradiction')) t(label_id, label))
SELECT p.doc_id, p.pair_no, p.label_id, lt.label FROM (SELECT doc_id, pair_no, {_LABEL_CASE} AS label_id FROM doc_pairs) p LEFT JOIN lt ON lt.label_id = p.label_id""",
)
def q_label_join(spark, sf):
    from tokenmill.operators.pairs import document_pairs, label_encode, label_join

    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return label_join(p.select("doc_id", "pair_no", label_encode("gold_label").alias("label_id")))


# F. aggregations ----------------------------------------------------------------------
@register(
    "op_corpus_stats",
    CORPUS + "\nSELECT count(*) AS sequences, count(*) * 128 AS tokens, ceil(count(*) / 128)::BIGINT AS microbatches FROM seqs",
)
def q_corpus_stats(spark, sf):
    from tokenmill.operators.stats import corpus_stats

    return corpus_stats(C.raw_sequences(_ctx(spark, sf)))


@register(
    "op_step_plan",
    CORPUS + """
SELECT sequences, tokens, microbatches, floor(microbatches * 2 / 31)::BIGINT AS steps FROM (
  SELECT count(*) AS sequences, count(*) * 128 AS tokens, ceil(count(*) / 128)::BIGINT AS microbatches FROM seqs)""",
)
def q_step_plan(spark, sf):
    from tokenmill.operators.stats import corpus_stats, step_plan

    return step_plan(corpus_stats(C.raw_sequences(_ctx(spark, sf))), 32)


@register("op_cross_entropy", "WITH " + O.SCORED + "\nSELECT vec_id, label, round(loss, 6) AS loss FROM scored2")
def q_cross_entropy(spark, sf):
    from tokenmill.plans.scoring import scored

    return scored(spark, sf).select("vec_id", "label", _r6(F.col("loss")).alias("loss"))


_SPLIT_SQL = f"""split AS (SELECT vec_id, {O.u('split', 'vec_id')} < 0.2 AS m FROM embeddings)"""


@register(
    "op_masked_loss",
    "WITH " + O.SCORED + "," + _SPLIT_SQL + """
SELECT round(CASE WHEN sum(m::INTEGER) > 0 THEN sum(loss * m::INTEGER) / sum(m::INTEGER) END, 6) AS masked_loss
FROM scored2 JOIN split USING (vec_id)""",
)
def q_masked_loss(spark, sf):
    from tokenmill.operators.scoring import masked_loss
    from tokenmill.operators.shards import validation_split
    from tokenmill.plans.scoring import scored

    s = validation_split(scored(spark, sf), ["vec_id"], share=VALIDATION, out="m")
    return masked_loss(s, "loss", "m").select(_r6(F.col("masked_loss")).alias("masked_loss"))


@register(
    "op_mean_loss_accuracy",
    "WITH " + O.SCORED + """
SELECT round(avg(loss), 6) AS mean_loss, round(avg((prediction = label)::INTEGER), 6) AS accuracy, count(*) AS n FROM scored2""",
)
def q_mean_loss_accuracy(spark, sf):
    from tokenmill.operators.scoring import loss_accuracy
    from tokenmill.plans.scoring import scored

    r = loss_accuracy(scored(spark, sf))
    return r.select(_r6(F.col("mean_loss")).alias("mean_loss"), _r6(F.col("accuracy")).alias("accuracy"), "n")


@register("op_label_distribution", "WITH " + O.DOC_PAIRS + "\nSELECT gold_label, count(*) AS rows FROM doc_pairs GROUP BY gold_label")
def q_label_distribution(spark, sf):
    from tokenmill.operators.pairs import document_pairs
    from tokenmill.operators.stats import label_distribution

    return label_distribution(document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")))


@register(
    "op_mask_stats",
    MASKED + """
SELECT choice, positions, positions / sum(positions) OVER () AS share FROM (
  SELECT c AS choice, count(*) AS positions FROM (SELECT unnest(choice) AS c FROM masked) GROUP BY c)""",
)
def q_mask_stats(spark, sf):
    from tokenmill.operators.masking import mask_stats

    return mask_stats(C.masked_rows(_ctx(spark, sf), keep_choice=True))


_METRICS_SQL = "metrics AS (SELECT 'events' AS run, cast(ts AS DATE)::VARCHAR AS epoch, event_id AS step, event_type AS name, value FROM events)"


@register(
    "op_epoch_metrics",
    "WITH " + _METRICS_SQL + "\nSELECT run, epoch, name, round(avg(value), 9) AS mean_value, count(*) AS n FROM metrics GROUP BY run, epoch, name",
)
def q_epoch_metrics(spark, sf):
    from tokenmill.operators.stats import epoch_metrics, metrics_from_events

    r = epoch_metrics(metrics_from_events(_table(spark, sf, "events")))
    return r.withColumn("mean_value", F.round(F.col("mean_value"), 9))


@register(
    "op_mean_of_batch_means",
    "WITH " + _METRICS_SQL + """,
numbered AS (
  SELECT run, epoch, name, value, row_number() OVER (PARTITION BY run, epoch, name ORDER BY step) - 1 AS r,
         count(*) OVER (PARTITION BY run, epoch, name) AS n FROM metrics
),
bm AS (SELECT run, epoch, name, r // 16 AS b, avg(value) AS m FROM numbered WHERE r < (n // 16) * 16 GROUP BY ALL)
SELECT run, epoch, name, round(avg(m), 9) AS mean_of_batch_means, count(*) AS batches FROM bm GROUP BY run, epoch, name""",
)
def q_mean_of_batch_means(spark, sf):
    from tokenmill.operators.stats import mean_of_batch_means, metrics_from_events

    r = mean_of_batch_means(metrics_from_events(_table(spark, sf, "events")), 16)
    # Batch means of 2-decimal values over 16 rows are exact binary fractions: round past their digits.
    return r.withColumn("mean_of_batch_means", F.round(F.col("mean_of_batch_means"), 9))


# G. numbering ------------------------------------------------------------------------------
@register(
    "op_assign_doc_id",
    "SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS doc_id FROM pages",
)
def q_assign_doc_id(spark, sf):
    """Dense 0-based ids in sorted path (url) order, by partition offsets."""
    from tokenmill.plans.numbering import index_by_order

    return index_by_order(_table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"], out="doc_id")


@register(
    "op_row_in_doc",
    CORPUS + "\nSELECT doc_id, row_no, row_number() OVER (PARTITION BY doc_id ORDER BY row_no) - 1 AS row_in_doc FROM seqs",
)
def q_row_in_doc(spark, sf):
    raw = C.raw_sequences(_ctx(spark, sf))
    return raw.select("doc_id", "row_no", F.col("row_no").alias("row_in_doc"))


@register(
    "op_write_cursor",
    CORPUS + """
SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS file_no
FROM (SELECT doc_id, len(ids) // 128 AS n FROM doc_ids)""",
)
def q_write_cursor(spark, sf):
    """Running write position of each document's rows and the numbered file it starts in."""
    from tokenmill.operators.sequences import chunks
    from tokenmill.plans.numbering import prefix_sum

    enc = C.encoded_documents(_ctx(spark, sf)).select("doc_id", F.size(chunks("ids", 128)).cast("long").alias("n"))
    cur = prefix_sum(enc, ["doc_id"], "n", out="start")
    return cur.withColumn("file_no", F.floor(F.col("start") / 1000).cast("long")).select("doc_id", "n", "start", "file_no")


_H_SQL = O.u("order", "doc_id", "row_no")


@register(
    "op_batch_number",
    CORPUS + f"""
SELECT doc_id, row_no, shard, pos, pos // 16 AS batch_no FROM (
  SELECT doc_id, row_no, {O.shard_expr()} AS shard,
    row_number() OVER (PARTITION BY {O.shard_expr()} ORDER BY {_H_SQL}, doc_id, row_no) - 1 AS pos FROM seqs)""",
)
def q_batch_number(spark, sf):
    from tokenmill.operators.shards import assign_shard, batch_numbers

    raw = assign_shard(C.raw_sequences(_ctx(spark, sf)).select("doc_id", "row_no"), 100)
    return batch_numbers(raw, 16).select("doc_id", "row_no", "shard", "pos", "batch_no")


# H. sorts, shuffles, sampling -----------------------------------------------------------
_STEM_SQL = r"""CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+?)(\.[^./]*)?$', 1) SIMILAR TO '-?[0-9]+'
  THEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+?)(\.[^./]*)?$', 1)::BIGINT END"""


@register(
    "op_sort_files_numeric",
    f"SELECT page_id, stem, row_number() OVER (ORDER BY stem NULLS LAST, url, page_id) - 1 AS file_rank FROM (SELECT page_id, url, {_STEM_SQL} AS stem FROM pages)",
)
def q_sort_files_numeric(spark, sf):
    """Pages ordered by the integer stem of their url path (files by numeric name)."""
    from tokenmill.plans.numbering import index_by_order
    from tokenmill.sources.readers import file_stem_number

    p = _table(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    p = p.withColumn("stem", file_stem_number("path"))
    return index_by_order(p, [F.col("stem").asc_nulls_last(), "url", "page_id"], out="file_rank").select("page_id", "stem", "file_rank")


@register("op_assign_shard", CORPUS + f"\nSELECT doc_id, row_no, {O.shard_expr()} AS shard FROM seqs")
def q_assign_shard(spark, sf):
    from tokenmill.operators.shards import assign_shard

    return assign_shard(C.raw_sequences(_ctx(spark, sf)).select("doc_id", "row_no"), 100)


@register(
    "op_shuffle_within_shard",
    CORPUS + f"""
SELECT doc_id, row_no, {O.shard_expr()} AS shard,
  row_number() OVER (PARTITION BY {O.shard_expr()} ORDER BY {_H_SQL}, doc_id, row_no) - 1 AS pos FROM seqs""",
)
def q_shuffle_within_shard(spark, sf):
    from tokenmill.operators.shards import assign_shard, rank_within_shard

    raw = assign_shard(C.written_sequences(_ctx(spark, sf)).select("doc_id", "row_no"), 100)
    return rank_within_shard(raw).select("doc_id", "row_no", "shard", "pos")


@register(
    "op_shuffle_shard_order",
    CORPUS + f"""
SELECT shard, row_number() OVER (ORDER BY {O.u('files', 'shard')}, shard) - 1 AS file_rank FROM (SELECT DISTINCT {O.shard_expr()} AS shard FROM seqs)""",
)
def q_shuffle_shard_order(spark, sf):
    from tokenmill.operators.shards import assign_shard, shard_order

    raw = assign_shard(C.written_sequences(_ctx(spark, sf)).select("doc_id", "row_no"), 100)
    return shard_order(raw)


@register(
    "op_shuffle_rows",
    "WITH " + O.DOC_PAIRS + f"\nSELECT doc_id, pair_no, row_number() OVER (ORDER BY {O.u('rows', 'doc_id', 'pair_no')}, doc_id, pair_no) - 1 AS rank FROM doc_pairs",
)
def q_shuffle_rows(spark, sf):
    from tokenmill.operators.pairs import document_pairs
    from tokenmill.operators.shards import shuffle_rows

    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")).select("doc_id", "pair_no")
    return shuffle_rows(p, ["doc_id", "pair_no"])


@register(
    "op_rank_labels",
    "WITH " + O.SCORED + """
SELECT vec_id,
  list_transform(r, lambda s: s.idx::VARCHAR) AS ranked_labels,
  list_transform(r, lambda s: round_even(s.p, 3)) AS ranked_probs
FROM (SELECT vec_id, list_sort(list_transform(probs, lambda p, i: {'neg': -p, 'idx': i - 1, 'p': p})) AS r FROM scored2)""",
)
def q_rank_labels(spark, sf):
    from tokenmill.operators.scoring import rank_labels
    from tokenmill.plans.scoring import scored

    s = scored(spark, sf)
    r = rank_labels("probs", [str(i) for i in range(10)])
    return s.select("vec_id", F.transform(r, lambda x: x["label"]).alias("ranked_labels"), F.transform(r, lambda x: x["p"]).alias("ranked_probs"))


@register(
    "op_validation_split",
    f"""WITH o AS (SELECT vec_id, {O.u('split', 'vec_id')} AS h, row_number() OVER (ORDER BY {O.u('split', 'vec_id')}, vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, h < 0.2 AS is_validation, r < n // 5 AS is_validation_n FROM o""",
)
def q_validation_split(spark, sf):
    """Held-out rows by share, and exactly a fifth of the rows (a number that comes with the table)."""
    from tokenmill.operators.shards import validation_split

    v = _table(spark, sf, "embeddings").select("vec_id")
    v = validation_split(v, ["vec_id"], share=VALIDATION)
    return validation_split(v, ["vec_id"], n=v.count() // 5, out="is_validation_n")


@register("op_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax FROM embeddings")
def q_argmax(spark, sf):
    from tokenmill.functions.arrays import argmax

    return _table(spark, sf, "embeddings").select("vec_id", argmax("embedding").alias("argmax"))


@register(
    "op_take_sample_batch",
    CORPUS + f""",
b AS (
  SELECT doc_id, row_no, {O.shard_expr()} AS shard,
    (row_number() OVER (PARTITION BY {O.shard_expr()} ORDER BY {_H_SQL}, doc_id, row_no) - 1) // 16 AS batch_no FROM seqs
),
f AS (SELECT shard FROM (SELECT shard, row_number() OVER (ORDER BY {O.u('files', 'shard')}, shard) - 1 AS file_rank FROM (SELECT DISTINCT shard FROM b)) WHERE file_rank = 0)
SELECT doc_id, row_no, shard, batch_no FROM b WHERE batch_no = 0 AND shard IN (SELECT shard FROM f)""",
)
def q_take_sample_batch(spark, sf):
    from tokenmill.operators.shards import assign_shard, first_batch

    raw = assign_shard(C.written_sequences(_ctx(spark, sf)).select("doc_id", "row_no"), 100)
    return first_batch(raw, 16).select("doc_id", "row_no", "shard", F.lit(0).cast("long").alias("batch_no"))


@register(
    "op_sample_table",
    MASKED + "," + VOCAB_TOKENS + f""",
b AS (SELECT doc_id, row_no, input, target, {O.shard_expr()} AS shard FROM masked),
f AS (SELECT shard FROM (SELECT DISTINCT shard FROM b) ORDER BY {O.u('files', 'shard')}, shard LIMIT 1),
s AS (SELECT * FROM b WHERE shard IN (SELECT shard FROM f) ORDER BY {_H_SQL}, doc_id, row_no LIMIT 16)
SELECT doc_id, row_no, replace({_decode_sql('input', False)}, '[MASK]', '**[MASK]**') AS input, {_decode_sql('target', True)} AS target FROM s, vt""",
)
def q_sample_table(spark, sf):
    """What a reader looks at during training: the first batch in words, masks marked, beside its targets."""
    from tokenmill.operators.encode import highlight_mask
    from tokenmill.operators.shards import assign_shard, first_batch

    ctx = _ctx(spark, sf)
    raw = C.written_sequences(ctx)
    rows = first_batch(C.masked_rows(ctx, raw), 16, shards=assign_shard(raw.select("doc_id", "row_no"), 100))
    d = ctx.encoder.decode
    return rows.select("doc_id", "row_no", highlight_mask(d("input", skip_special_tokens=False)).alias("input"), d("target").alias("target"))


# J. scalar functions -------------------------------------------------------------------
@register(
    "op_softmax",
    """SELECT vec_id, list_transform(embedding, lambda x: round(exp(x - mx) / s, 6)) AS softmax FROM (
  SELECT vec_id, embedding, mx, list_reduce(list_transform(embedding, lambda x: exp(x - mx)), lambda a, b: a + b, 0.0) AS s
  FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, list_max(embedding)::DOUBLE AS mx FROM embeddings))""",
)
def q_softmax(spark, sf):
    from tokenmill.functions.arrays import softmax

    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", _r6_arr(softmax("e")).alias("softmax"))


@register(
    "op_log_softmax",
    """SELECT vec_id, list_transform(embedding, lambda x: round(x - lse, 6)) AS log_softmax FROM (
  SELECT vec_id, embedding, mx + ln(list_reduce(list_transform(embedding, lambda x: exp(x - mx)), lambda a, b: a + b, 0.0)) AS lse
  FROM (SELECT vec_id, embedding::DOUBLE[] AS embedding, list_max(embedding)::DOUBLE AS mx FROM embeddings))""",
)
def q_log_softmax(spark, sf):
    from tokenmill.functions.arrays import log_softmax

    e = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", _r6_arr(log_softmax("e")).alias("log_softmax"))


@register("op_one_hot", "SELECT vec_id, list_transform(range(10), lambda i: (i = label)::DOUBLE) AS one_hot FROM embeddings")
def q_one_hot(spark, sf):
    from tokenmill.functions.arrays import one_hot

    return _table(spark, sf, "embeddings").select("vec_id", one_hot("label", 10).alias("one_hot"))


@register("op_round", "SELECT event_id, round_even(value, 3) AS value FROM events")
def q_round(spark, sf):
    from tokenmill.functions.arrays import round_half_even

    return _table(spark, sf, "events").select("event_id", round_half_even("value", 3).alias("value"))


@register("op_char_length", "SELECT doc_id, length(text) AS char_length, n_chars FROM documents")
def q_char_length(spark, sf):
    from tokenmill.functions.text import char_length

    return _table(spark, sf, "documents").select("doc_id", char_length("text").alias("char_length"), "n_chars")


# K. streaming ----------------------------------------------------------------------------
@register(
    "op_stream_pack",
    CORPUS + "\nSELECT doc_id, row_no, list_concat([(doc_id >> 16)::INTEGER, (doc_id & 65535)::INTEGER, row_no::INTEGER], tokens) AS row FROM seqs",
)
def q_stream_pack(spark, sf):
    """Documents as a file stream -> encode, chunk, pack -> append sink; equals the batch result."""
    from tokenmill.streaming.pack import stream_pack

    return stream_pack(spark, sf, _ctx(spark, sf))


@register(
    "op_stream_files",
    CORPUS + """
SELECT doc_id, row_no, file_no, place, md5(array_to_string(tokens, ',')) AS digest FROM (
  SELECT *, (n - 1) // 1000 AS file_no, (n - 1) % 1000 AS place FROM (SELECT *, row_number() OVER (ORDER BY doc_id, row_no) AS n FROM seqs))""",
)
def q_stream_files(spark, sf):
    """Numbered files of 1,000 rows kept over a stream that arrives in three parts and is started anew for each."""
    from tokenmill.streaming.pack import stream_files

    rows = stream_files(spark, sf, _ctx(spark, sf), 1000)
    return rows.select("doc_id", "row_no", F.col("file_no").cast("long").alias("file_no"), F.col("place").cast("long").alias("place"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@register(
    "op_scan_packed_binary",
    CORPUS + """
SELECT (n - 1) // 1000 AS file_no, md5(array_to_string(list_concat([(doc_id >> 16)::INTEGER, (doc_id & 65535)::INTEGER, row_no::INTEGER], tokens), ',')) AS digest
FROM (SELECT *, row_number() OVER (ORDER BY doc_id, row_no) AS n FROM seqs)""",
)
def q_scan_packed_binary(spark, sf):
    """All raw sequences as headerless 16-bit files of 1,000 rows, read back by byte ranges; padding left out."""
    from tokenmill.operators.checks import is_zero_row
    from tokenmill.operators.sequences import packed_row
    from tokenmill.session import scratch_path
    from tokenmill.sources.packed_rows import PackedRows
    from tokenmill.sources.sinks import write_packed_binary

    raw = C.raw_sequences(_ctx(spark, sf))
    path = scratch_path(spark, "packed-binary")
    write_packed_binary(raw.select("doc_id", "row_no", packed_row(raw).alias("row")), path, 1000, 131)
    back = spark.read.format(PackedRows.name()).options(row_len=131).load(path).where(~is_zero_row("row"))
    return back.select(F.col("file_no").cast("long").alias("file_no"), F.md5(F.array_join(F.col("row").cast("array<string>"), ",")).alias("digest"))


@register(
    "op_scan_pair_tsv_breaks",
    "WITH " + O.DOC_PAIRS + """
SELECT doc_id, pair_no, sentence1 || chr(10) || '"' || chr(9) || coalesce(sentence2, '') || chr(10) AS sentence1, coalesce(sentence2, '') AS sentence2 FROM doc_pairs WHERE sentence1 IS NOT NULL""",
)
def q_scan_pair_tsv_breaks(spark, sf):
    """Pairs whose sentences hold line breaks, tabs and quotes, written as quoted TSV and read back by splits of any size."""
    from tokenmill.operators.pairs import document_pairs
    from tokenmill.session import scratch_path
    from tokenmill.sources.readers import scan_pair_tsv
    from tokenmill.sources.sinks import write_tsv

    path = scratch_path(spark, "pairs-breaks")
    p = document_pairs(_table(spark, sf, "documents"), _table(spark, sf, "labels")).where("sentence1 IS NOT NULL")
    two = F.coalesce("sentence2", F.lit(""))
    write_tsv(p.select("doc_id", "pair_no", F.concat("sentence1", F.lit('\n"\t'), two, F.lit("\n")).alias("sentence1"), two.alias("sentence2")), path)
    back = scan_pair_tsv(spark, path, ("doc_id", "pair_no", "sentence1", "sentence2"), default_na=False, types={"doc_id": "long", "pair_no": "int"})
    return back.withColumn("sentence2", F.coalesce("sentence2", F.lit("")))


# L / M. scoring and model fitting ------------------------------------------------------------
@register(
    "op_batch_predict",
    "WITH " + O.SCORED + "\nSELECT vec_id, prediction FROM scored",
)
def q_batch_predict(spark, sf):
    """Arrow-batched scoring with a user model (the class-mean linear head) via predict_batch_udf."""
    import numpy as np

    from tokenmill.functions.arrays import argmax
    from tokenmill.operators.scoring import batch_predict, centroid_weights, linear_predictor

    emb = _table(spark, sf, "embeddings")
    # The head is class-count x dimension: bounded, so it may be collected and shipped to workers.
    rows = centroid_weights(emb).orderBy("label").collect()
    w = np.array([r.weights for r in rows], dtype=np.float64)
    scored = batch_predict(emb, linear_predictor(w), w.shape[1])
    return scored.select("vec_id", argmax("logits").alias("prediction"))


@register("op_fit_linear_head")
def q_fit_linear_head(spark, sf):
    """Multinomial logistic head without intercept, fitted to convergence on the rows not held out (one weight vector per class)."""
    from tokenmill.operators.scoring import fit_linear_head, head_coefficients
    from tokenmill.operators.shards import validation_split

    train = validation_split(_table(spark, sf, "embeddings"), ["vec_id"], share=VALIDATION).filter(~F.col("is_validation"))
    return head_coefficients(spark, fit_linear_head(train, reg=0.01))


@register(
    "op_predict_linear_head",
    "WITH " + O.SCORED + "\nSELECT vec_id, prediction, list_transform(logits, lambda z: round(z, 6)) AS logits FROM scored",
)
def q_predict_linear_head(spark, sf):
    from tokenmill.plans.scoring import scored

    return scored(spark, sf).select("vec_id", "prediction", _r6_arr(F.col("logits")).alias("logits"))


@register(
    "op_evaluate_head",
    "WITH " + _SPLIT_SQL + "," + O.scored_ctes("(SELECT e.* FROM embeddings e JOIN split USING (vec_id) WHERE NOT m)") + """
SELECT round(avg(loss), 6) AS mean_loss, round(avg((prediction = label)::INTEGER), 6) AS accuracy, count(*) AS n
FROM scored2 JOIN split USING (vec_id) WHERE m""",
)
def q_evaluate_head(spark, sf):
    from tokenmill.operators.scoring import loss_accuracy
    from tokenmill.operators.shards import validation_split
    from tokenmill.plans.scoring import scored

    # the head is fitted on the rows that are not held out
    r = loss_accuracy(scored(spark, sf, held_out=lambda df: validation_split(df, ["vec_id"], share=VALIDATION, out="m")))
    return r.select(_r6(F.col("mean_loss")).alias("mean_loss"), _r6(F.col("accuracy")).alias("accuracy"), "n")


CROPPED = "WITH RECURSIVE " + CORPUS[len("WITH "):] + """,
docs AS (
  SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS b, sum(n) OVER (ORDER BY doc_id) AS e
  FROM (SELECT doc_id, len(ids) // 128 AS n FROM doc_ids) WHERE n > 0
),
bounds(k, start) AS (
  SELECT 0, 0::HUGEINT
  UNION ALL
  SELECT k + 1, (SELECT min(e) FROM docs WHERE e >= bounds.start + 1000) FROM bounds
  WHERE (SELECT min(e) FROM docs WHERE e >= bounds.start + 1000) IS NOT NULL
),
kept AS (
SELECT docs.doc_id, docs.n::BIGINT AS n, least(docs.n, bb.start + 1000 - docs.b)::BIGINT AS kept, bb.k::INTEGER AS file_no FROM docs
JOIN (SELECT k, start, lead(start) OVER (ORDER BY k) AS nxt FROM bounds) bb ON docs.b >= bb.start AND (bb.nxt IS NULL OR docs.b < bb.nxt)
)
"""


@register("op_write_crop", CROPPED + "SELECT doc_id, n, kept, file_no FROM kept")
def q_write_crop(spark, sf):
    """Crop-mode numbered files of 1,000 rows: rows kept per document and its file."""
    from tokenmill.operators.crop import crop_assignment
    from tokenmill.operators.sequences import chunks

    enc = C.encoded_documents(_ctx(spark, sf))
    counts = enc.select("doc_id", F.size(chunks("ids", 128)).cast("long").alias("n"))
    return crop_assignment(counts, 1000)


@register(
    "op_write_crop_rows",
    CROPPED + "SELECT seqs.doc_id, seqs.row_no, kept.file_no, md5(array_to_string(seqs.tokens, ',')) AS digest FROM seqs JOIN kept USING (doc_id) WHERE seqs.row_no < kept.kept",
)
def q_write_crop_rows(spark, sf):
    """The rows that crop mode keeps, written to their numbered files and read back."""
    from tokenmill.operators.crop import crop_assignment
    from tokenmill.session import scratch_path
    from tokenmill.sources.sinks import write_crop

    path = scratch_path(spark, "sequences")
    C.raw_sequences(_ctx(spark, sf)).select("doc_id", "row_no", "tokens").write.parquet(path)  # encoded once
    rows = spark.read.parquet(path)
    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = scratch_path(spark, "cropped")
    write_crop(rows, crop_assignment(counts, 1000), out)
    return spark.read.parquet(out).select("doc_id", "row_no", "file_no", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@register(
    "op_stream_crop",
    CROPPED + "SELECT seqs.doc_id, seqs.row_no, kept.file_no, md5(array_to_string(seqs.tokens, ',')) AS digest FROM seqs JOIN kept USING (doc_id) WHERE seqs.row_no < kept.kept",
)
def q_stream_crop(spark, sf):
    """Crop-mode numbered files kept over a stream that arrives in three parts: the same rows as in batch."""
    from tokenmill.streaming.pack import stream_files

    rows = stream_files(spark, sf, _ctx(spark, sf), 1000, crop=True)
    return rows.select("doc_id", "row_no", F.col("file_no").cast("int").alias("file_no"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))
