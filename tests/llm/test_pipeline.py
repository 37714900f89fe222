import random

import __spark_entry__ as E
import corpus_pipeline as P
from inkwell.llm import common, decontaminate, langid, nearjoin, packing, pii
from inkwell.session import read_parquet_if_there

from .conftest import sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def write(spark, path):
    rnd = random.Random(12)
    rows = [(i, sentence(rnd, 40, 3000), ["en", "de"][i % 2], f"s{i % 3}", 1) for i in range(60)]
    base = sentence(rnd, 200, 3000)
    item = sentence(rnd, 25, 3000)
    rows += [(100, base, "en", "a", 1), (101, base, "en", "b", 1), (102, base + " tail", None, None, None), (102, base + " tail", None, None, None),
             (103, sentence(rnd, 40, 3000) + " " + item, "en", "c", 1), (104, sentence(rnd, 40, 3000) + " mail jo@ex.com", "de", "c", 1),
             (105, None, "en", "d", 1), (106, "", None, None, 0), (107, "12 34 !!", "en", "d", 8), (None, sentence(rnd, 30, 3000), "en", "e", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return df


def test_stages_take_effect(spark, tmp_path):
    write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids[name] = {r.doc_id for r in docs.collect()}
        if k < 4:
            assert docs.columns == COLUMNS
        if name == "pii":
            assert docs.where("doc_id = 104").first().text.endswith("mail [EMAIL]")
    clean = set(range(60)) | {None}
    assert ids["language_id"] == clean | {100, 101, 102, 103, 104}
    assert ids["near_duplicates"] == clean | {100, 103, 104}
    assert ids["packing"] == ids["pii"] == ids["decontamination"] == clean | {100, 104}


def test_run_equals_its_stages(spark, tmp_path):
    write(spark, tmp_path)
    rows = P.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = nearjoin.one_of_each(langid.identified(docs))
    docs = pii.masked(decontaminate.clean(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet")))
    assert sorted(map(str, rows)) == sorted(map(str, packing.packed(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32").collect()))


def test_stages_with_messy_rows_and_empty_tables(spark, tmp_path, messy, nothing):
    write(spark, tmp_path)
    for docs in (messy, nothing):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0


def test_registered():
    q, o = E.queries(), E.oracle_sql()
    assert q["pipeline"] is P.run and set(o) <= set(q)
    for n in range(1, 11):
        assert len([x for x in q if x.startswith(f"op{n}_")]) == 1


def test_operators_11_to_13_are_registered():
    q = E.queries()
    for n in (11, 12, 13):
        assert len([x for x in q if x.startswith(f"op{n}_")]) == 1


def test_scratch_of_a_finished_table_goes(spark):
    inner = []

    def make():
        a = common.cut(spark.range(5).toDF("x"), "inner")
        inner.extend(common._written(spark)[-1:])
        return common.cut(a.where("x > 1"), "inner").where("x > 2")

    out = common.finished(spark, make, "outer")
    assert sorted(r.x for r in out.collect()) == [3, 4]
    assert read_parquet_if_there(spark, inner[0]) is None and common._written(spark)[-1].rsplit("/", 1)[1].startswith("outer")
