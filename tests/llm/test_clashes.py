"""Input columns with the names of results; runs that must be read once."""

import time

import pytest
from pyspark.sql import functions as F

from tickwise.llm import linededup, mixing, secrets, sentences


@pytest.mark.parametrize("operator,results", [
    (linededup.dedup_lines, ("n_lines", "n_dropped", "kept")),
    (sentences.dedup_spans, ("n_sentences", "n_removed", "removed", "kept")),
    (mixing.mix, ("domain", "n_tokens", "epoch", "take_tokens"))])
def test_results_take_the_place_of_columns_of_their_names(edge, operator, results):
    plain = operator(edge)
    own = [*edge.columns, *results]
    assert plain.columns == own
    clashing = operator(edge.withColumns({c: F.lit("input") for c in results}))
    assert clashing.columns == own
    assert sorted(map(str, clashing.collect())) == sorted(map(str, plain.collect()))


def test_a_result_cannot_replace_what_is_read(edge):
    with pytest.raises(ValueError, match="kept"):
        linededup.dedup_lines(edge.withColumnRenamed("text", "kept"), text_column="kept")


def test_long_runs_are_read_once(spark):
    """Every start of a token within one run of its signs would read the rest of the run."""
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.abc-def_1"
    texts = [(1, ".eyJ " + "eyJ" * 700_000), (2, f"Bearer {token} and {token}"), (3, f"x{token}")]
    start = time.time()
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert time.time() - start < 30
    n = len(token)
    assert got[2] == f"bearer:7:{7 + n},bearer:{12 + n}:{12 + 2 * n}" and got[1] == "" and got[3] == ""
