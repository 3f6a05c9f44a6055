import random

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from tests.llm import brute
from tests.oracle_check import compare, duck
from tickwise.llm import bpe, language, mixing
from tickwise.llm.common import written
from tickwise.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, name, sf_small):
    got = compare(spark, name, sf_small, duck(sf_small), verbose=False)
    assert got["status"] == "match", got


def test_all_operators_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def near_groups(docs):
    """Rows with an id in groups of near duplicates; rows of equal id and text are one."""
    own = list({(r[0], r[1]): r for r in docs if r[0] is not None}.values())
    groups = {}
    for i, _, c in brute.near_duplicates([(n, r[1]) for n, r in enumerate(own)]):
        groups.setdefault(c, []).append(own[i])
    return list(groups.values())


def test_near_dedup_keeps_other_texts_of_an_id(spark, sf_small):
    words = lambda k, n=200: " ".join(f"w{k}x{j}" for j in range(n))
    near = words(3)[:-6] + " more words"
    own = [(1, words(1), "en"), (1, words(2), "en"), (1, words(1), "en"), (2, words(1) + " and more", "en"), (5, words(3), "en"), (4, near, "de"), (None, words(1), None), (7, None, None), (7, "", "x")]
    df = spark.createDataFrame([(i, t, lang, "s", None, 9) for i, t, lang in own], "doc_id long, text string, lang string, source string, n_chars long, component_id int")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, sf_small)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, words(1)), (1, words(2)), (4, near), (None, words(1)), (7, None), (7, "")], key=str)


def test_language_gate_turns_away_what_was_not_learned(spark, sf_small):
    draw = random.Random(3)
    noise = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz   ", k=600)) for _ in range(50)]
    noise += ["Быстрая коричневая лиса прыгает через ленивую собаку " * 5, "nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään kauas pois " * 5]
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    more = spark.createDataFrame([(10**6 + i, t, None, "noise", None) for i, t in enumerate(noise)], docs.schema)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs.unionByName(more), sf_small)
    assert kept.where("source = 'noise'").count() == 0 and kept.count() == docs.count()


def test_pipeline_stage_by_stage(spark, edge, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    odd = edge.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "cast(length(text) AS long) AS n_chars")
    now = written(docs.unionByName(odd), "start")
    stages = dict(corpus_pipeline.STAGES)

    filters, now0 = language.learn(now), now
    before = rows(now)
    now = written(stages["language_id"](spark, now, sf_small), "a")
    after = rows(now)
    scores = {t: language.score(filters, [t]).max() for _, t, *_ in before if t}
    least = language.lowest_score(now0, filters)
    assert 0.2 < least < 0.5
    assert sorted(after, key=str) == sorted((r for r in before if r[1] and any(c.isalpha() for c in r[1]) and scores[r[1]] >= least), key=str)

    now = written(stages["line_dedup"](spark, now, sf_small), "b")
    want = []
    for (i, text, lang, source, n), (_, _, dropped, kept) in zip(after, brute.line_dedup([(r[0], r[1]) for r in after])):
        if not dropped or kept.strip(brute.BLANKS):
            want.append((i, text, lang, source, n) if not dropped else (i, kept, lang, source, len(kept)))
    after = rows(now)
    assert sorted(after, key=str) == sorted(want, key=str)

    now = written(stages["near_dedup"](spark, now, sf_small), "c")
    got = rows(now)
    assert sorted((r[0] for r in got if r[0] is not None)) == sorted(min(r[0] for r in g) for g in near_groups(after))
    assert set(got) <= set(after) and sum(r[0] is None for r in got) == sum(r[0] is None for r in after)

    after = got
    now = written(stages["mixing"](spark, now, sf_small), "d")
    want = brute.mixed([r[:4] for r in after], mixing.WEIGHTS, mixing.SHARE, 1, mixing.SEED)
    assert sorted(str(r[0]) for r in rows(now)) == sorted(str(r[0]) for r in want)

    from tokenizers import Tokenizer
    library = Tokenizer.from_file(bpe.default_path())
    after = rows(now)
    out = {tuple(r) for r in stages["bpe"](spark, now, sf_small).collect()}
    for i, text, *_ in after:
        ids = library.encode(text, add_special_tokens=False).ids
        assert (i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))) in out


def test_pipeline_runs_and_takes_empty_input(spark, sf_small):
    assert corpus_pipeline.run(spark, sf_small).count() > 0
    now = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf_small), name)
    assert now.count() == 0


def test_queries_are_whole(spark, sf_small):
    n = spark.read.parquet(f"{sf_small}/documents.parquet").count()
    for name in ("op3_bpe", "op4_sharding", "op5_paritysketch", "op7_linededup", "op8_spans", "op9_language", "op10_secrets"):
        assert QUERIES[name](spark, sf_small).count() == n, name
