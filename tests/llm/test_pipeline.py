"""The pipeline's stages and registered queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import decontaminate, mixing, quality
from tessella.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_dedup import line_brute, near_brute
from tests.llm.test_filters import best_match

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [f.__module__ for _, f in corpus_pipeline.STAGES] == ["corpus_pipeline"] * 5


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, as written and read again."""
    root = f"file://{tmp_path_factory.mktemp('stages')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{root}/{i}")
        out.append(spark.read.parquet(f"{root}/{i}"))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage(spark, stages):
    scored = quality.score_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert pairs(stages[1]) == pairs(scored.where("predicted = 1"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = stages[0].join(labels.where("quality = 1"), "doc_id").count()
    kept = stages[1].join(labels.where("quality = 1"), "doc_id").count()
    assert kept >= 0.97 * clean


def test_line_stage(stages):
    assert pairs(stages[2]) == sorted((i, t) for i, _, _, t in line_brute(pairs(stages[1])))
    assert stages[2].where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_near_stage(stages):
    docs = pairs(stages[2])
    kept = {i for i, _, _, k in near_brute(docs) if k}
    assert pairs(stages[3]) == [d for d in docs if d[0] in kept]


def test_leak_stage(spark, stages):
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(pairs(stages[3])) - set(pairs(stages[4]))
    for _, text in gone:
        assert any(best_match(i, decontaminate.normalise(text))[0] <= len(i) * decontaminate.ERROR_RATE for i in items)
    for _, text in pairs(stages[4]):
        norm = decontaminate.normalise(text)
        assert not any(i in norm for i in items)
    assert gone


def test_stage_rows_hold_the_text_once(stages):
    row = corpus_pipeline._with_row(stages[0])
    assert row.columns == ["doc_id", "text", "_stage_row"]
    assert row.schema["_stage_row"].dataType.names == ["doc_id", "lang", "source", "n_chars"]


def test_mix_stage(stages):
    plan = {r.doc_id: (r.size, r.taken) for r in mixing.plan_mix(stages[4]).collect()}
    times = {r.doc_id: r["count"] for r in stages[5].groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * size == taken for i, (size, taken) in plan.items())
    assert stages[5].columns == stages[4].columns


def test_run_is_the_stages(spark, stages):
    assert pairs(corpus_pipeline.run(spark, SF)) == pairs(stages[5])


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, and columns that operators add themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(12)
    row = lambda i, text: docs.orderBy("doc_id").limit(1).withColumn("doc_id", F.lit(i).cast("long")).withColumn("text", F.lit(text).cast("string"))
    out = docs.unionByName(first)  # the same rows again
    for i, text in ((9001, None), (9002, ""), (9003, " \n\t"), (9004, "one two three"), (9005, "many plain words of a long text " * 20_000), (None, "a text without an id"), (None, None), (9006, "z again"), (9006, "another text of one id")):
        out = out.unionByName(row(i, text))
    own = {"score": F.lit("own"), "predicted": F.lit("own"), "held_out": F.lit("own"), "n_lines": F.lit("own"), "n_dropped": F.lit("own"), "kept": F.lit("own"), "component_id": F.lit("own"), "key": F.lit("own"), "rate": F.lit("own"), "item_id": F.lit("own"), "_row": F.lit("own"), "nested": F.array(F.struct(F.col("lang").alias("text")))}
    return out.withColumns(own)


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_odd_rows_and_columns(spark, odd, stage, tmp_path):
    name, run = corpus_pipeline.STAGES[stage]
    odd.write.parquet(f"file://{tmp_path}/in")
    docs = spark.read.parquet(f"file://{tmp_path}/in")
    run(spark, docs, SF).write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.dtypes == docs.dtypes, name
    own = [c for c in docs.columns if dict(docs.dtypes)[c] == "string" and c not in ("text", "lang", "source")]
    assert got.where(" or ".join(f"{c} is null or {c} <> 'own'" for c in own)).count() == 0
    before, after = pairs_of(docs), pairs_of(got)
    ids = {i for i, _ in after}
    if name == "quality classifier":
        assert set(after) <= set(before) and all(after.count(d) == before.count(d) for d in set(after))
    elif name == "line dedup":
        assert sorted(i or -1 for i, _ in after) == sorted(i or -1 for i, _ in before) and all(t is not None for _, t in after)
        assert (9001, "") in after and (9004, "one two three") in after
    elif name == "near-dedup":
        named = [i for i, _ in after if i is not None]
        assert len(named) == len(set(named)) and set(after) <= set(before)
        assert (9006, "another text of one id") in after and {(9001, None), (9002, ""), (9003, " \n\t")} <= set(after)
        assert sum(i is None for i, _ in after) == 2
    elif name == "decontamination":
        assert all(after.count(d) in (0, before.count(d)) for d in set(before))
        assert {None, 9001, 9002, 9003, 9004, 9005} <= ids
    else:
        assert set(after) <= set(before)
    assert run(spark, docs.limit(0), SF).count() == 0


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
