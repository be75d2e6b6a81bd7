"""Sources: parquet tables, text-file corpora, pair TSVs, packed binary rows, vocabularies."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.operators.pairs import DEFAULT_NA_VALUES
from tokenmill.operators.vocab import VOCAB_SCHEMA

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_documents(spark: SparkSession, path: str, columns=("doc_id", "text")) -> DataFrame:
    """Record source with id and text; explicit schema, column pruning by Catalyst."""
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path).select(*columns)


def scan_text_corpus(spark: SparkSession, pattern: str) -> DataFrame:
    """One document per text file: ``path, text`` (whole file, newlines normalised later).

    ``pattern`` names the files, or a folder: its files ``*.txt`` at any depth, which tasks list side by side.
    """
    options = {} if any(ch in pattern for ch in "*?[{") or pattern.endswith(".txt") else {"recursiveFileLookup": True, "pathGlobFilter": "*.txt"}
    return spark.read.options(**options).text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def assign_doc_ids(files: DataFrame, path_col: str = "path", numeric_stem: bool = False) -> DataFrame:
    """Dense 0-based ``doc_id`` in sorted path order (or by integer file stem)."""
    from tokenmill.plans.numbering import index_by_order

    if numeric_stem:
        files = files.withColumn("__stem", file_stem_number(path_col))
        return index_by_order(files, ["__stem", path_col], out="doc_id").drop("__stem")
    return index_by_order(files, [path_col], out="doc_id")


def file_stem_number(path_col: str = "path") -> F.Column:
    """Integer stem of a file name (``.../17.npy`` -> 17); null when the stem is not a number."""
    stem = F.regexp_extract(F.col(path_col), r"([^/]+?)(\.[^./]*)?$", 1)
    return F.when(stem.rlike(r"^-?[0-9]+$"), stem.cast("long"))


def _after(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open behind a line that began inside one, or not.

    A quote opens a field only as its first character; inside, two quotes are one.
    """
    at, n = 0, len(line)
    while at < n:
        if not inside:
            if line[at] != '"':
                at = line.find("\t", at) + 1  # the next field
                if not at:
                    return False
                continue
            at += 1
        end = line.find('"', at)
        while end >= 0 and line[end + 1 : end + 2] == '"':
            end = line.find('"', end + 2)
        if end < 0:
            return True
        inside = False
        at = line.find("\t", end + 1) + 1
        if not at:
            return False
    return inside


def _line_states(batches):
    """What a run of lines does to either state: ``file, block, seq, out, in``, one row per run of a split."""
    import pyarrow as pa

    names = ["file", "block", "seq", "from_out", "from_in"]
    for k, b in enumerate(batches):
        rows: dict = {}
        for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
            state = rows.setdefault((file, block), [False, True])
            if '"' in line:
                state[:] = [_after(line, x) for x in state]
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, k, *state))) for key, state in rows.items()], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("from_out", pa.bool_()), ("from_in", pa.bool_())]))


def tsv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, record``: the records of a TSV, a quoted field of which may hold line breaks; file headers included.

    Lines are read in splits of any size. Every split says what its lines do to either
    state, inside a quoted field or outside of it; composing these in file order (one row per
    split) gives the state each split begins in. A second pass joins the lines of records, and
    only a record that crosses a split is put together from its pieces.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    runs = lines.mapInArrow(_line_states, "file string, block long, seq long, from_out boolean, from_in boolean")
    # a file's splits in order: bounded by its size over the split size, some 10^5 rows for 10 TB
    composed: dict[tuple[str, int], bool] = {}
    state, last = False, None
    for file, block, _, out, inn in sorted(zip(*(c.to_pylist() for c in runs.toArrow().columns))):
        if file != last:
            state, last = False, file
        composed.setdefault((file, block), state)
        state = inn if state else out
    begins = spark.sparkContext.broadcast(composed)
    schema = "file string, block long, kind int, record string"

    def joined(batches):
        import pyarrow as pa

        fields = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
        key, held, inside, head = None, [], False, False

        def rest():
            # 1: a whole split inside one record or its end; 2: the beginning of a record that goes on
            return (*key, 1 if head else 2, "\n".join(held))

        for b in batches:
            rows = []
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != key:
                    if held:
                        rows.append(rest())
                    key, held = (file, block), []
                    inside = head = begins.value[key]
                held.append(line)
                inside = _after(line, inside) if '"' in line else inside
                if not inside:
                    rows.append((*key, 1 if head else 0, "\n".join(held)))
                    held, head = [], False
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, fields)], schema=fields)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(rest(), fields)], schema=fields)

    found = lines.mapInArrow(joined, schema)
    pieces = found.where("kind > 0")
    # a piece belongs to the last beginning before it
    begun = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    whole = pieces.withColumn("start", F.max(F.when(F.col("kind") == 2, F.col("block"))).over(begun)).groupBy("file", "start")
    whole = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return found.where("kind = 0").select("file", "block", "record").unionByName(whole.select("file", F.col("start").alias("block"), "record"))


def scan_pair_tsv(
    spark: SparkSession,
    path: str,
    columns=("sentence1", "sentence2", "gold_label"),
    default_na: bool = True,
    types: dict | None = None,
) -> DataFrame:
    """Header TSV, chosen columns only; fields in quotes may hold tabs, quotes and line breaks, and a large file is read by many tasks.

    ``default_na=True``: the default missing-value strings become null (training
    reader); ``False`` keeps every string as read (evaluation reader).
    """
    types = types or {}
    options = {"sep": "\t", "quote": '"', "escape": '"', "emptyValue": "", "mode": "FAILFAST", "maxCharsPerColumn": "-1"}
    # the header alone decides where the wanted columns stand; all fields are read as text
    header = spark.read.text(path, lineSep="\n").first()[0].rstrip("\r")
    names = next(csv.reader([header], delimiter="\t"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = tsv_records(spark, path).select(F.regexp_replace("record", r"\r$", "").alias("record")).where((F.col("record") != "") & (F.col("record") != F.lit(header)))
    fields = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    df = fields.select(*[F.col(f"r.c{names.index(c)}").cast(types.get(c, "string")).alias(c) for c in columns])
    if default_na:
        str_cols = [c for c in columns if types.get(c, "string") == "string"]
        df = df.select(
            *[
                F.when(F.col(c).isin(*DEFAULT_NA_VALUES) | F.col(c).isNull(), None).otherwise(F.col(c)).alias(c)
                if c in str_cols
                else F.col(c)
                for c in columns
            ]
        )
    return df


def scan_packed_binary(spark: SparkSession, path: str, row_len: int, dtype: str = "<u2") -> DataFrame:
    """Headerless fixed-width rows (16-bit by default): ``row ARRAY<LONG>``, all-zero padding rows kept.

    Read through the data source ``packed_rows``: byte ranges of whole rows, many to a large file.
    """
    from tokenmill.sources.packed_rows import PackedRows

    spark.dataSource.register(PackedRows)
    return spark.read.format(PackedRows.name()).options(row_len=row_len, dtype=dtype).load(path).select("row")


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCAB_SCHEMA).parquet(path)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the scan has fewer partitions than the cluster has cores.

    Large inputs (many files / row groups) already scan in parallel and are left
    alone, so no extra shuffle is added at scale; a small table stored as one
    row group would otherwise run its CPU-heavy text work in a single task.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
