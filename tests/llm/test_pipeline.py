"""The corpus pipeline, stage by stage, and the queries' registration."""

import re

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from debtscope.llm import simhash
from debtscope.llm.shared import stored
from debtscope.llm.simhash import fingerprint
from debtscope.session import table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, benchmark = docs.columns, [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], FOLDER), "stage-test"))
    raw, clean, single, safe, mixed, tokens = seen
    assert all(x.columns == columns for x in seen[:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(a >= b for a, b in zip(ids, ids[1:])) and len(ids[-1]) > 0.5 * len(ids[0])

    prints = {r.doc_id: fingerprint(r.text.encode(), 3) & (2**64 - 1) for r in clean.collect()}
    group = {d: d for d in sorted(prints)}

    def least(d):
        return d if group[d] == d else least(group[d])

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((least(a), least(b)))
                group[y] = x
    assert ids[2] == {least(d) for d in prints}

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())

    windows = {tuple(w[i : i + 10]) for w in map(words, benchmark) for i in range(max(len(w) - 9, 1))}
    for r in single.collect():
        w = words(r.text)
        assert (r.doc_id in ids[3]) == (not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)))
    assert tokens.count() == mixed.count()
    ordered = tokens.orderBy("start").collect()
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:i]) for i in range(len(ordered))]


def test_near_dedup_broadcasts_no_copies_of_fingerprints(spark, monkeypatch):
    plans = {}

    def kept(df, name, **options):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name, **options)

    monkeypatch.setattr(simhash, "stored", kept)
    docs = spark.createDataFrame([(i, f"{i} a b c d {i % 7}") for i in range(60)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, FOLDER).count() <= 60
    assert "SortMergeJoin" in plans["print-links"] and "Broadcast" not in plans["print-links"]


def test_stages_of_an_empty_table_and_of_odd_rows(spark):
    docs = table(spark, FOLDER, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x " * 40 + ".", "en", None, 81)], docs.schema))
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = stored(stage(spark, rows, FOLDER), "stage-test")
        assert rows.count() <= 3


def test_one_query_for_each_operator():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert set(oracle_sql()) <= set(queries())
