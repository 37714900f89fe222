"""Readers and writers (S1-S22) on literal files in a fresh scratch folder."""

import json
import os

import pytest

from inkwell.session import scratch_path
from inkwell.sources import files as FS



def test_labelled_json_array_file_with_string_labels(spark):
    d = scratch_path(spark, "t-json")
    os.makedirs(d)
    with open(f"{d}/x.json", "w") as f:
        json.dump([{"text": "a", "result": "0"}, {"text": "b", "result": 1},
                   {"text": "c", "result": "2"}, {"text": "d", "result": "junk"}], f, indent=4)
    df = FS.read_labelled_json(spark, d, array_file=True)
    h, m = FS.label_split(df)
    assert [r.text for r in h.collect()] == ["a"] and [r.text for r in m.collect()] == ["b"]


def test_columnar_pairs_and_args(spark):
    prefix = scratch_path(spark, "t-pairs")
    os.makedirs(f"{prefix}.raw_data"); os.makedirs(f"{prefix}.args")
    with open(f"{prefix}.raw_data/p.json", "w") as f:
        json.dump({"original": ["o1", "o2", "o3"], "sampled": ["s1", "s2", "s3"]}, f, indent=4)
    with open(f"{prefix}.args/a.json", "w") as f:
        f.write(json.dumps({"dataset": "xsum", "n_samples": 3}) + "\n")
    pairs, args = FS.read_pairs(spark, prefix, columnar=True)
    assert sorted((r.pair_id, r.original, r.sampled) for r in pairs.collect()) == [
        (0, "o1", "s1"), (1, "o2", "s2"), (2, "o3", "s3")]
    assert args.first().n_samples == 3


def test_read_lines_keeps_newlines(spark):
    d = scratch_path(spark, "t-lines")
    os.makedirs(d)
    with open(f"{d}/a.txt", "w") as f:
        f.write("first\nsecond\n\nlast")
    got = [(r.line, r.value) for r in FS.read_lines(spark, d).orderBy("line").collect()]
    with open(f"{d}/a.txt") as f:
        exp = list(enumerate(f.readlines()))
    assert got == exp


def test_line_pair_roundtrip(spark):
    rows = [(i, f"p{i}", f"s{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, p string, s string")
    a, b = scratch_path(spark, "t-a"), scratch_path(spark, "t-b")
    FS.write_lines(df, a, "id", "p", n_files=4)
    FS.write_lines(df, b, "id", "s", n_files=4)
    got = FS.read_line_pair(spark, a, b, ("p", "s")).collect()
    assert len(got) == 100 and all(r.p.strip()[1:] == r.s.strip()[1:] for r in got)


def test_csv_multiline_roundtrip(spark):
    rows = [(1, 'He said "hi"\nthen left', None), (2, "", "plain, with comma")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    p = scratch_path(spark, "t-csv")
    FS.write_csv(df, p)
    back = sorted(FS.read_csv(spark, p, "id long, a string, b string").collect())
    # As with the reference's CSV reader, an empty field reads as missing.
    assert [(r.id, r.a, r.b) for r in back] == [(1, 'He said "hi"\nthen left', None), (2, None, "plain, with comma")]


def test_results_store_append_and_missing(spark):
    p = scratch_path(spark, "t-res")
    assert FS.read_results(spark, p).count() == 0
    rec = spark.createDataFrame([("a", "b", "d", 0.5, "1")], FS.RESULT_SCHEMA)
    FS.append_results(rec, p)
    FS.append_results(rec, p)
    assert FS.read_results(spark, p).count() == 2


def test_cached_computes_once(spark):
    p = scratch_path(spark, "t-cache")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)
    assert FS.cached(spark, p, compute).count() == 3
    assert FS.cached(spark, p, compute).count() == 3
    assert len(calls) == 1


def test_training_log_parse(spark):
    lines = ["layer_num = 0", "Epoch [1/2], Loss: 0.6931, Validation Accuracy: 0.5000",
             "Epoch [2/2], Loss: 0.6000, Validation Accuracy: 0.5500", "noise", "layer_num = 1",
             "Epoch [1/2], Loss: 0.5, Validation Accuracy: 1.0000"]
    df = spark.createDataFrame(list(enumerate(lines)), "line long, value string")
    got = [tuple(r) for r in FS.parse_training_log(df).orderBy("layer", "epoch").collect()]
    assert got == [(0, 1, 0.6931, 0.5), (0, 2, 0.6, 0.55), (1, 1, 0.5, 1.0)]


def test_missing_store_is_empty_and_other_failures_are_raised(spark, tmp_path):
    assert FS.read_results(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"not parquet at all, certainly not")
    assert FS.read_results(spark, f"{tmp_path}/bad").count() == 0
    with pytest.raises(Exception):
        FS.cached(spark, f"{tmp_path}/bad", lambda: spark.range(1)).count()


def test_hive_key_and_fanout(spark):
    df = spark.createDataFrame([("t1", 0, "en", "g1"), ("t2", 1, "es", "g2")],
                               "text string, result int, lang string, source string")
    p = scratch_path(spark, "t-fan")
    FS.write_labelled_json(df, p, partition_by=["lang", "source"])
    back = FS.read_with_path(spark, f"{p}/*/*/*.json", "text string, result int")
    got = sorted((r.text, r.l, r.s) for r in back.select("text", FS.hive_key("path", "lang").alias("l"),
                                                           FS.hive_key("path", "source").alias("s")).collect())
    assert got == [("t1", "en", "g1"), ("t2", "es", "g2")]


def test_perturbed_pairs_list_form(spark):
    prefix = scratch_path(spark, "t-pert")
    os.makedirs(f"{prefix}.raw_data"); os.makedirs(f"{prefix}.args")
    with open(f"{prefix}.raw_data/p.json", "w") as f:
        json.dump([{"original": "o", "sampled": "s", "perturbed_original": ["o1", "o2"],
                    "perturbed_sampled": ["s1"]}], f, indent=4)
    with open(f"{prefix}.args/a.json", "w") as f:
        f.write("{}\n")
    d, _ = FS.read_pairs(spark, prefix, perturbed=True)
    r = d.first()
    assert (r.original, r.perturbed_original, r.perturbed_sampled) == ("o", ["o1", "o2"], ["s1"])


def test_path_keys_and_text_pick(spark):
    from inkwell.functions import text as T
    from inkwell.sources.tables import pick_text
    df = spark.createDataFrame([("dataset/processed_data/test_data/pub_gpt3.5.json",),
                                ("exp/data/xsum_gpt2.raw_data.json",)], "p string")
    got = [(r.k.dataset, r.k.generator) for r in df.select(T.path_key("p").alias("k")).collect()]
    assert got == [("pub", "gpt3.5"), ("xsum", "gpt2")]
    t = spark.createDataFrame([("a doc", "a ctx")], "document string, context string")
    assert pick_text(t, "xsum").first().text == "a doc" and pick_text(t, "squad").first().text == "a ctx"
    assert pick_text(t.withColumnRenamed("document", "other"), "other").first().text == "a doc"


def test_aligned_files_follow_the_rows(spark):
    rows = [(i * 3, f"p{i} ", None if i % 5 == 0 else f" s{i}é") for i in range(23)]
    df = spark.createDataFrame(rows, "id long, p string, s string").repartition(4)
    path = scratch_path(spark, "t-aligned")
    FS.write_aligned(df, path, ["id"], ["p", "s"], lines_per_file=5)
    manifest = {r.file_no: (r.first_line, r.n_lines) for r in spark.read.parquet(f"{path}/manifest").collect()}
    assert manifest == {0: (0, 5), 1: (5, 5), 2: (10, 5), 3: (15, 5), 4: (20, 3)}
    got = sorted(tuple(r) for r in FS.read_aligned(spark, path, ["p", "s"]).collect())
    assert got == [(i, p, s or "") for i, (_, p, s) in enumerate(rows)]
    empty = scratch_path(spark, "t-aligned")
    FS.write_aligned(df.where("1 = 0"), empty, ["id"], ["p"])
    assert spark.read.parquet(f"{empty}/manifest").count() == 0


def test_aligned_files_refuse_line_breaks_and_lost_lines(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "id long, p string")
    with pytest.raises(Exception, match="line break"):
        FS.write_aligned(df, scratch_path(spark, "t-aligned"), ["id"], ["p"])
    path = scratch_path(spark, "t-aligned")
    FS.write_aligned(df.where("id = 2").unionByName(df.where("id = 2").selectExpr("3L as id", "p")), path, ["id"], ["p"])
    spark.createDataFrame([("c",)], "value string").write.mode("overwrite").text(f"{path}/p/file_no=0")
    with pytest.raises(Exception, match="lines of the manifest"):
        FS.read_aligned(spark, path, ["p"]).collect()
