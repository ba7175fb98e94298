"""The pipeline's stages on a small corpus with every kind of planted row, nulls, clashing columns and an empty table."""

import random

import pytest

import corpus_pipeline
from siteledger.llm import packing, queries
from siteledger.llm.tokens import default_vocabulary

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "lan mor tis ven ra".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rng, n):
    return ". ".join(" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(n // 8)) + "."


def corpus():
    rng = random.Random(11)
    clean = {i: text(rng, 160) for i in range(300)}
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    passage = text(rng, 64)
    rows, toxic, labels = dict(clean), [], []
    for i in range(300, 380):
        words = text(rng, 80).split()
        words[5:5] = ["zorgle", "blarg", "snork"]
        rows[i] = " ".join(words)
        toxic.append(i)
        labels.append((i, 1, 1))
    rows[400], rows[401] = clean[7], clean[7]  # exact copies
    near = clean[8].split()
    near[40] = "changed"
    rows[402] = " ".join(near)
    rows[403] = text(rng, 80) + "\n" + item.upper() + "\n" + text(rng, 80)
    rows[404], rows[405] = text(rng, 80) + "\n" + passage, passage + " " + text(rng, 80)
    rows[406], rows[407] = None, ""
    return rows, toxic, labels, item, passage, clean


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, _, labels, item, _, _ = corpus()
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()] + [(None, "a row without an id that nobody else has, of some words", "en", "s", 9)], SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*labels, (9999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_every_stage_takes_its_decisions(spark, folder):
    rows, toxic, _, _, passage, clean = corpus()
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert not {*toxic} & {*seen["toxicity"]} and {*clean} <= {*seen["toxicity"]}
    assert {*seen["toxicity"]} - {*seen["simhash_near_dedup"]} == {400, 401, 402, 407}  # 406 and 407 have equal fingerprints
    cut = seen["substring_dedup"]
    assert passage in cut[404].text and passage not in cut[405].text and cut[405].n_chars == len(cut[405].text)
    assert all(cut[i].text == t for i, t in clean.items()) and None in cut
    assert {*cut} - {*seen["benchmark_decontamination"]} == {403}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {*seen["benchmark_decontamination"]}


def test_run_is_the_stages_one_after_another(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    last = spark.read.parquet(f"{folder}/benchmark_decontamination")
    want = packing.pieces(last, default_vocabulary()).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(map(tuple, want), key=repr)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_nulls_ties_and_clashing_columns(spark, folder):
    rng = random.Random(5)
    one, long = text(rng, 40), text(rng, 30_000)
    rows = [(1, one, None, None, None), (1, one, None, None, None), (2, one, "en", "s", 1), (None, one, None, None, None), (None, None, None, None, None), (3, None, "en", None, None), (4, "", None, "s", 0), (5, " \n ", None, None, 3), (6, long, None, None, len(long)), (7, "word", None, None, 4)]
    extra = "toxicity_score double, digest string, cuts int, found_id int, kept_id int, label string, node long, slots binary, sequence_id long, offset long, key string, g int"
    table = spark.createDataFrame([(*r, *[None] * 12) for r in rows], f"{SCHEMA}, {extra}").repartition(3)
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.dtypes == table.dtypes
        docs.write.parquet(f"{folder}/odd-{name}")
        docs = spark.read.parquet(f"{folder}/odd-{name}")
    kept = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert kept == sorted([(1, one), (3, None), (6, long), (7, "word")], key=repr)  # blank texts are one group, with null
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {1, 3, 6, 7}


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 14)] and {*queries.ORACLES} <= {*queries.QUERIES}


def test_only_the_tables_of_a_result_stay(spark):
    from siteledger.llm import common

    made = []

    @common.temporary
    def inner(df):
        made.append(common.materialise(df, "gone"))
        return common.materialise(made[0].withColumn("b", made[0]["a"] + 1), "inner")

    @common.temporary
    def outer(df):
        made.append(inner(df))
        made.append(common.materialise(df.union(df), "also-gone"))
        return made[1].filter("b > 1")

    out = outer(spark.createDataFrame([(0,), (1,)], "a int"))
    assert [tuple(r) for r in out.collect()] == [(1, 2)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = [path(f"{common.work_dir(spark)}/{s.getPath().getName()}") for s in path(common.work_dir(spark)).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path(common.work_dir(spark)))]
    names = [p.getName() for p in there]
    assert not [n for n in names if n.startswith(("gone-", "also-gone-"))] and len([n for n in names if n.startswith("inner-")]) == 1
