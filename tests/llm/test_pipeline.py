"""The pipeline, stage by stage, against what each operator should do on its input."""

import corpus_pipeline
from tests.llm.tables import documents, plain, texts, words
from tests.llm.test_duplicates import covered, edit_distance
from tests.llm.test_near_texts import check as check_groups
from tests.llm.test_text_operators import brute_quality, check_packing
from wordloom.llm import decontaminate
from wordloom.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_a_small_corpus(spark, tmp_path):
    item = words(90, 40)
    near = words(91, 300).split()
    rows = [(i, words(1000 + i, 60 + i)) for i in range(60)]
    rows += [(100, " ".join(near)), (101, " ".join(near)), (102, " ".join([*near[:150], "edit", *near[151:]])), (110, words(92, 60) + " " + item + " " + words(93, 60)), (111, "too short")]
    passage = words(94, 80)
    rows += [(120 + i, words(2000 + i, 70) + " " + passage + " " + words(3000 + i, 70)) for i in range(4)]
    documents(spark, rows).select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == COLUMNS
    assert 111 not in seen["quality"] and len(seen["quality"]) == len(rows) - 1
    assert seen["quality"].keys() - seen["near_dedup"].keys() == {101, 102}
    assert seen["repeats"].keys() == seen["near_dedup"].keys()
    for i in range(4):
        left = seen["repeats"][120 + i]
        assert passage not in left["text"] and left["text"].startswith(words(2000 + i, 70)) and left["n_chars"] == len(left["text"])
    assert seen["repeats"].keys() - seen["decontamination"].keys() == {110}
    kept = [(d, r["text"]) for d, r in seen["decontamination"].items()]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packing(kept, got)


def odd_rows():
    """Nulls, empty, repeated and long texts, shared and missing ids, near copies, passages and leaked items."""
    rows = texts()
    rows[15] = (13, words(13, 3000))
    passage, item = words(95, 75), words(96, 35)
    base = words(97, 220).split()
    rows += [(900, " ".join(base)), (901, " ".join([*base[:100], "edit", *base[101:]])), (901, words(98, 90)), (None, " ".join([*base[:20], "other", *base[21:]])), (None, words(99, 80)), (None, words(99, 80)), (None, "short")]
    rows += [(910 + i, words(910 + i, 60) + f" {passage} " + words(930 + i, 40)) for i in range(4)] + [(920, words(920, 70) + " " + item.upper() + " é " + words(921, 30)), (None, words(922, 80) + " " + item)]
    return rows, [(1, item), (2, None), (2, "")]


def test_stages_on_odd_rows_are_those_of_brute_force(spark, tmp_path):
    rows, items = odd_rows()
    documents(spark, rows).select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, now = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    stages = dict(corpus_pipeline.STAGES)

    def step(name):
        nonlocal docs
        docs = materialize(stages[name](spark, docs, str(tmp_path)), name)
        assert docs.columns == COLUMNS
        now[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        return now[name]

    good = [r for r in rows if not brute_quality(*r)[-1]]
    assert plain(step("quality")) == plain(good) and any(d is None for d, _ in good)

    kept = step("near_dedup")
    check_groups(good, kept)
    assert any(d is None for d, _ in kept) and len(kept) < len(good)

    data, masks = covered(kept)
    want = []
    for (d, text), mask in zip(kept, masks):
        at, left = 0, []
        for c in text:
            n = len(c.encode())
            if not mask[at : at + n].all():
                left.append(c)
            at += n
        want.append((d, "".join(left)))
    assert plain(step("repeats")) == plain(want)
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    item = decontaminate.normalised(items[0][1])
    clean = [(d, t) for d, t in want if edit_distance(item, decontaminate.normalised(t)) > decontaminate.budget(item)]
    assert plain(step("decontamination")) == plain(clean) and len(clean) < len(want)
    check_packing(clean, stages["packing"](spark, docs, str(tmp_path)).collect())
    check_packing(clean, corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_a_very_long_text_passes_every_stage(spark, tmp_path):
    long = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(1_200_000))
    assert len(long) > 9_000_000
    rows = [(1, long), (2, words(200, 90)), (3, words(201, 90) + " " + long[5_000_000:5_000_400])]
    documents(spark, rows).select(COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(202, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3} and sum(r["length"] for r in got if r["doc_id"] == 1) > 1_200_000


def test_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
