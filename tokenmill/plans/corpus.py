"""Corpus plans: vocabulary (E-1), documents to raw sequences (E-2), masked shards (E-3).

Each function returns a lazy DataFrame; the only values that reach the driver
are the vocabulary (checked to fit 16-bit ids) and one-row scalars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.config import Config
from tokenmill.functions import text as tx
from tokenmill.operators import masking, sequences, shards, vocab as V
from tokenmill.operators.encode import Encoder
from tokenmill.session import scratch_path
from tokenmill.sources.readers import read_table, spread

# Defaults of the words-plus-characters vocabulary used by the table queries.
QUERY_VOCAB_SIZE = 2048
QUERY_MIN_COUNT = 2


@dataclass
class CorpusContext:
    spark: SparkSession
    documents: DataFrame
    vocab_frame: DataFrame
    vocab: V.Vocab
    encoder: Encoder
    cfg: Config
    sequences: DataFrame | None = None  # written once, see written_sequences


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def build_context(spark: SparkSession, sf_dir: str, cfg: Config = Config(), vocab_size: int = QUERY_VOCAB_SIZE, min_count: int = QUERY_MIN_COUNT) -> CorpusContext:
    docs = documents(spark, sf_dir)
    # The count table feeds the alphabet and the word ranking: scan and count the corpus once.
    counts = V.word_counts(docs).persist()
    alpha = V.alphabet(counts, cfg.tokenizer.max_alphabet_size).persist()
    vocab_frame = V.word_vocabulary(counts, vocab_size, min_count, cfg.tokenizer.max_alphabet_size, alpha)
    vocab = V.Vocab.from_frame(vocab_frame)
    alpha.unpersist()
    counts.unpersist()
    enc = Encoder(vocab, spark, cfg.tokenizer.max_chars_per_word)
    return CorpusContext(spark, docs, vocab.to_frame(spark), vocab, enc, cfg)


def encoded_documents(ctx: CorpusContext, paragraph_delimiter: str | None = None) -> DataFrame:
    """``doc_id, ids``: optional paragraph filter, then normalise, pre-tokenise, subword-encode."""
    text = F.col("text")
    if paragraph_delimiter is not None:
        text = tx.paragraph_filter(text, paragraph_delimiter)
    return ctx.documents.select("doc_id", ctx.encoder.encode_plain(text).alias("ids"))


def raw_sequences(ctx: CorpusContext, paragraph_delimiter: str | None = None) -> DataFrame:
    """E-2: one row per packed sequence ``doc_id, id_hi, id_lo, row_no, tokens``."""
    enc = encoded_documents(ctx, paragraph_delimiter)
    seqs = sequences.chunk_sequences(enc, "ids", ctx.cfg.data.sequence_size)
    return sequences.pack(seqs).select("doc_id", "id_hi", "id_lo", "row_no", "tokens")


def masked_rows(ctx: CorpusContext, raw: DataFrame | None = None, keep_choice: bool = False) -> DataFrame:
    """E-3 part 1: masked rows with their shard number."""
    raw = raw if raw is not None else raw_sequences(ctx)
    m = masking.mask_tokens(
        raw, ctx.vocab.mask_id, ctx.vocab.size, ctx.cfg.data.masking, keep_choice=keep_choice
    )
    return shards.assign_shard(m, ctx.cfg.data.num_shards)


def shard_counts(ctx: CorpusContext) -> DataFrame:
    """Flagship: how many masked training rows each shard gets."""
    return masked_rows(ctx).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


_CONTEXTS: dict = {}


def written_sequences(ctx: CorpusContext) -> DataFrame:
    """The raw sequences, written to the shared folder by the first plan that asks: several plans, or branches of one, read them."""
    if ctx.sequences is None:
        raw = raw_sequences(ctx)
        path = scratch_path(ctx.spark, "sequences")
        raw.write.parquet(path)
        ctx.sequences = ctx.spark.read.schema(raw.schema).parquet(path)
    return ctx.sequences


def table_version(spark: SparkSession, path: str) -> tuple:
    """Path, files, bytes and time of a table, from the file system's listing; a rewritten table has another version."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(p)
    return path, len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


def context(spark: SparkSession, sf_dir: str, cfg: Config = Config()) -> CorpusContext:
    """Memoised per session and version of the table: the vocabulary is built (and collected) once."""
    key = (spark.sparkContext.applicationId, table_version(spark, f"{sf_dir.rstrip('/')}/documents.parquet"), cfg)
    ctx = _CONTEXTS.get(key)
    if ctx is None:
        ctx = build_context(spark, sf_dir, cfg)
        _CONTEXTS[key] = ctx
    return ctx


def merge_vocabulary(spark: SparkSession, sf_dir: str, cfg: Config = Config()) -> V.TrainResult:
    """The merge-trained vocabulary of the documents, as configured; trained once per version of the table."""
    t = cfg.tokenizer
    key = (spark.sparkContext.applicationId, "merged", table_version(spark, f"{sf_dir.rstrip('/')}/documents.parquet"), t)
    if key not in _CONTEXTS:
        fix = tx.fix_text if t.fix_text else None
        counts = V.word_counts(documents(spark, sf_dir), fix=fix)
        _CONTEXTS[key] = V.train_vocabulary(counts, t.vocab_size, t.min_token_frequency, t.max_alphabet_size)
    return _CONTEXTS[key]


# ------------------------------------------------------------------ pairs (E-5)
def pair_ids(ctx: CorpusContext, pairs: DataFrame, keys=("conv_id", "turn")) -> DataFrame:
    """Both sentences encoded without special tokens: ``*keys, a, b``."""
    enc = ctx.encoder
    return pairs.select(*keys, enc.encode_plain("sentence1").alias("a"), enc.encode_plain("sentence2").alias("b"))


def encoded_pairs(ctx: CorpusContext, pairs: DataFrame, max_length: int | None = None, keys=("conv_id", "turn")) -> DataFrame:
    """``*keys, ids, type_ids`` for ``[CLS] a [SEP] b [SEP]``, longest-first truncated when ``max_length`` is set."""
    ids = pair_ids(ctx, pairs, keys)
    p = ctx.encoder.encode_pair("a", "b", max_length)
    return ids.select(*keys, p["ids"].alias("ids"), p["type_ids"].alias("type_ids"))


def padded_pairs(ctx: CorpusContext, pairs: DataFrame, max_length: int = 128, keys=("conv_id", "turn")) -> DataFrame:
    """Truncated pairs padded to the longest encoding of the set with the mask id (pad = mask)."""
    from tokenmill.operators.encode import pad_to_longest

    # written once: the longest length and the rows are read from the same ids
    path = scratch_path(ctx.spark, "pair-ids")
    enc = encoded_pairs(ctx, pairs, max_length, keys)
    enc.write.parquet(path)
    enc = ctx.spark.read.schema(enc.schema).parquet(path)
    return pad_to_longest(enc, "ids", ctx.vocab.mask_id, extra_zero_cols=("type_ids",))
