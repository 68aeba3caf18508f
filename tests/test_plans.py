"""Properties of plans that matter at scale: pushed filters, pruned columns, join kinds."""

from __future__ import annotations

import re

import pytest

from lexispark.plans import registry

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", text)]


def test_filters_reach_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(text,", plan(QUERIES["raw_documents"](spark, sf_dir)))
    assert "EqualTo(role,assistant)" in plan(QUERIES["final_int"](spark, sf_dir))


@pytest.mark.parametrize(
    ("name", "columns"),
    [("doc_token_counts", {"doc_id", "text"}), ("byte_token_histogram", {"text"}), ("next_role_pairs", {"conv_id", "turn", "role"}), ("row_index", {"o_orderkey", "o_orderdate"}), ("perplexity_bigram", {"event_id", "user_id", "event_type"})],
)
def test_only_used_columns_are_read(spark, sf_dir, name, columns):
    found = read_columns(plan(QUERIES[name](spark, sf_dir)))
    assert found and all(c <= columns for c in found)


@pytest.mark.parametrize("name", ["attn_pairs_causal", "attn_pairs_window", "attn_pairs_segment", "attention_output", "shard_overlaps", "window_slices", "packed_rows"])
def test_no_product_of_tables(spark, sf_dir, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["chat_token_counts", "byte_token_histogram", "grpo_surrogate", "mean_reward"])
def test_aggregates_combine_before_the_shuffle(spark, sf_dir, name):
    assert "partial_" in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["rmsnorm", "rope", "swiglu", "softmax_rows", "byte_round_trip", "pretoken_counts"])
def test_row_kernels_do_not_shuffle(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Exchange" not in text or name == "byte_round_trip"
