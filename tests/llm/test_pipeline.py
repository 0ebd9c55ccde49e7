"""The pipeline's stages and run() against plain versions of them, and on odd and empty tables."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import ODD, encode, jaccard_plain, leaks_plain
from tricord.llm import jaccard, language, queries, toxicity

MORE = "kept int, leaking_id int, score string, is_toxic int, number long, doc_1 int, lang_pred string"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """The smallest tables with odd and repeated documents, and columns of names that stages use inside."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [tuple(r) for r in docs.collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = max((r["text"] for r in bench.collect() if r["text"]), key=len)
    long = max((t for _, t, _, _ in rows if t), key=len)
    rows += [(10_000 + i if i else None, t, None, "odd") for i, t in ODD] + [(20_000, f"{rows[0][1]} {item}", "en", "leak"), (20_001, long, None, "copy"), rows[3], rows[4]]
    df = spark.createDataFrame([(*r, 1, 2, "s", 3, 4, 5, "x") for r in rows], f"doc_id long, text string, lang string, source string, {MORE}")
    df.repartition(4).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def plain_language(spark, rows, df, folder):
    model = language.fit_language_model(df)
    return [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= model.threshold]


def plain_toxicity(spark, rows, df, folder):
    chain = toxicity.fit_toxicity(df, queries.table(spark, folder, "labels"))
    table = chain.table()
    toxic = lambda f: len(f) and chain.probabilities(table[f].sum(axis=0, dtype=np.float64)[None, :])[0, -1] >= chain.threshold
    return [r for r in rows if not toxic(toxicity.features(r["text"]))]


def plain_jaccard(spark, rows, df, folder):
    own = [r for r in rows if r["doc_id"] is not None]
    # a repeated id stands for each of its texts; here its rows are equal
    group = jaccard_plain([(r["doc_id"], r["text"]) for r in own])
    first = {}
    for r in own:
        if group[r["doc_id"]][1] == r["doc_id"]:
            first.setdefault(r["doc_id"], r)
    return list(first.values()) + [r for r in rows if r["doc_id"] is None]


def plain_leaks(spark, rows, df, folder):
    found = leaks_plain([(r["doc_id"], r["text"]) for r in rows], [tuple(r) for r in queries.table(spark, folder, "benchmark").select("item_id", "text").collect()])
    bad = {r["doc_id"] for r, f in zip(rows, found) if f}
    return [r for r in rows if r["doc_id"] not in bad]


PLAIN = {"language_id": plain_language, "toxicity": plain_toxicity, "ngram_jaccard": plain_jaccard, "decontamination": plain_leaks}


def ids(rows):
    return Counter((r["doc_id"], r["source"]) for r in rows)


def test_run_is_the_plain_stages_one_after_another(spark, tables):
    df = queries.table(spark, tables, "documents")
    went = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = df.collect()
        after = corpus_pipeline.materialize(stage(spark, df, tables), name)
        assert after.columns == df.columns and after.schema.simpleString() == df.schema.simpleString()
        want = PLAIN[name](spark, rows, df, tables)
        assert ids(after.collect()) == ids(want), name
        went[name] = len(rows) - len(want)
        assert all((r["kept"], r["score"], r["is_toxic"], r["doc_1"], r["lang_pred"]) == (1, "s", 3, 5, "x") for r in after.collect())
        df = after
    assert all(n > 0 for n in went.values())
    of = encode("byte_bpe_50k.json")
    want = Counter()
    for r in df.collect():
        want[r["doc_id"]] += len(of(r["text"])) + 1
    got = Counter()
    for r in corpus_pipeline.run(spark, tables).collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    assert jaccard.jaccard_components(df).where("doc_id <> component_id").count() == 0


def test_run_of_empty_tables(spark, sf, tables, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        queries.table(spark, tables, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_run_without_labels_and_benchmark(spark, tables, tmp_path):
    few = queries.table(spark, tables, "documents").where("doc_id BETWEEN 10000 AND 10007 OR doc_id < 20")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        queries.table(spark, tables, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert kept and not kept & {10_001, 10_002, 10_003}
