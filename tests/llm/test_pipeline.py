from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialloom.llm import mixing, quality, secrets, simhash
from trialloom.llm.common import held_out

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_run(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].select(got.columns).collect()))


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(stages[0], labels, ~held_out(F.col("doc_id")))
    want = [r.doc_id for r in stages[0].collect() if quality.scores([r.text], field)[0] >= 0.7]
    assert ids(stages[1]) == sorted(want)


def test_dedup_stage(stages):
    rows = {r.doc_id: simhash.fingerprint(r.text) for r in stages[1].collect()}
    left, seen = sorted(rows), set()
    want = []
    for i in left:
        if i in seen:
            continue
        want.append(i)
        todo = [i]
        seen.add(i)
        while todo:
            a = todo.pop()
            near = [j for j in left if j not in seen and (rows[a] ^ rows[j]).bit_count() <= 3]
            seen.update(near)
            todo += near
    assert ids(stages[2]) == want


def test_secret_stage(stages):
    scanner = secrets.Scanner()
    want = {r.doc_id: secrets.redact(r.text, scanner.spans(r.text)[1]) for r in stages[2].collect()}
    got = {r.doc_id: r for r in stages[3].collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_mixing_stage(spark, stages):
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3], labels, corpus_pipeline.TARGETS, keep="clean").collect()}
    got = ids(stages[4])
    assert {i: got.count(i) for i in set(got)} == {k: v for k, v in copies.items() if v}


def test_clean_documents_stay_where_that_binds(spark):
    """Text that is toxic to a smaller share than asked for: without keep, clean documents would go."""
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    domains = mixing.label_domains(labels)
    few = docs.join(domains.where("domain = 'toxic' and doc_id % 3 <> 0").select("doc_id"), "doc_id", "left_anti")
    free = {r.doc_id: r.copies for r in mixing.mix(few, domains, corpus_pipeline.TARGETS).collect()}
    rows = {r.doc_id: r for r in mixing.mix(few, domains, corpus_pipeline.TARGETS, keep="clean").collect()}
    clean = [i for i, r in rows.items() if r.p_clean >= r.p_toxic]
    assert any(free[i] == 0 for i in clean) and all(rows[i].copies >= 1 for i in clean)
    got = Counter(ids(corpus_pipeline.mix_to_targets(spark, few, SF2)))
    assert got == {i: r.copies for i, r in rows.items() if r.copies}


def test_packing_stage(stages):
    pieces = stages[5].collect()
    whole = {r.doc_id for r in pieces if r.start == 0}
    assert whole == set(ids(stages[4])) and len([r for r in pieces if r.start == 0]) == stages[4].count()
    loads = {}
    for r in pieces:
        loads[r.sequence_id] = loads.get(r.sequence_id, 0) + r.length
    assert max(loads.values()) <= 1024


def test_odd_documents(spark):
    """Nulls, repeats and blanks pass every stage."""
    rows = [(1, None, None, None, None), (None, "some text", "en", "s", 9), (2, "", "en", "s", 0), (3, "token = abcdef123", "en", "s", 17), (3, "token = abcdef123", "en", "s", 17), (4, "a rule\n" + "-" * 40 + "\n" + "0" * 25 + "\nends", "en", "s", 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF))
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, SF))
    assert empty.count() == 0
