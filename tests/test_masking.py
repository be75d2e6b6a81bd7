"""Masking: degenerate probabilities, invalid input, engine equality, partition invariance, shares."""

import math

import pytest

from tokenmill.config import MaskingConfig
from tokenmill.operators.masking import mask_stats, mask_tokens


def _frame(spark, n_rows=3, width=20):
    return spark.createDataFrame([(7, r, list(range(width))) for r in range(n_rows)], "doc_id long, row_no int, tokens array<int>")


def test_no_masking(spark):
    out = mask_tokens(_frame(spark), 77, 1000, MaskingConfig(0.0, 0.0, 0.0)).collect()
    for r in out:
        assert r.input == r.target and not any(r.mask)


def test_all_mask(spark):
    out = mask_tokens(_frame(spark), 77, 1000, MaskingConfig(1.0, 0.0, 0.0)).collect()
    for r in out:
        assert r.input == [77] * 20 and all(r.mask) and r.target == list(range(20))


def test_all_random(spark):
    out = mask_tokens(_frame(spark), 77, 1000, MaskingConfig(0.0, 1.0, 0.0)).collect()
    for r in out:
        assert all(0 <= x < 1000 for x in r.input) and all(r.mask)
        assert r.input != r.target


def test_all_keep(spark):
    out = mask_tokens(_frame(spark), 77, 1000, MaskingConfig(0.0, 0.0, 1.0)).collect()
    for r in out:
        assert r.input == r.target and all(r.mask)


def test_invalid_probabilities():
    with pytest.raises(ValueError):
        MaskingConfig(0.5, 0.5, 0.2)


def test_arrow_and_sql_engines_agree(spark):
    df = _frame(spark, 5, 64)
    a = mask_tokens(df, 2, 500, keep_choice=True, engine="arrow").orderBy("row_no").collect()
    b = mask_tokens(df, 2, 500, keep_choice=True, engine="sql").orderBy("row_no").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_partition_count_invariance(spark):
    df = _frame(spark, 40, 32)
    one = {(r.doc_id, r.row_no): r.input for r in mask_tokens(df.coalesce(1), 2, 500).collect()}
    many = {(r.doc_id, r.row_no): r.input for r in mask_tokens(df.repartition(7), 2, 500).collect()}
    assert one == many


def test_shares_within_five_sigma(spark):
    df = _frame(spark, 400, 128)
    stats = {r.choice: r.positions for r in mask_stats(mask_tokens(df, 2, 500, keep_choice=True)).collect()}
    n = 400 * 128
    cfg = MaskingConfig()
    expected = {0: 1 - cfg.mask_p - cfg.random_p - cfg.keep_p, 1: cfg.mask_p, 2: cfg.random_p, 3: cfg.keep_p}
    for k, p in expected.items():
        sigma = math.sqrt(n * p * (1 - p))
        assert abs(stats.get(k, 0) - n * p) < 5 * sigma


def test_engines_agree_on_null_keys_and_tokens_and_long_rows(spark):
    rows = [(None, 0, list(range(20))), (5, None, [1, None, 3]), (6, 1, None), (7, 2, []), (8, 3, list(range(300))), (9, 4, [7] * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, row_no int, tokens array<int>").coalesce(1)
    for seed in ("mask", "a seed that does not fit into one block of the hash, nor does its row"):
        a, b = (mask_tokens(df, 2, 500, seed=seed, keep_choice=True, engine=e).orderBy("row_no").collect() for e in ("arrow", "sql"))
        assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_masking_hashes_no_position_in_a_lambda(spark):
    plan = mask_tokens(_frame(spark), 77, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
