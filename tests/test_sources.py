import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import curation, user_functions
from tracemill.sources import readers, sinks


def test_published_splits(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    sinks.write_dataset(df, path)
    assert readers.read_all_splits(spark, path).count() == 10
    test = readers.read_split(spark, path, "test")
    assert sorted(r.id for r in test.collect()) == [0, 1, 2]
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    with pytest.raises(Exception):
        sinks.write_dataset(df, path)


def test_names():
    assert sinks.formatted_name("a/b") == "a/b_f"
    assert sinks.threshold_name("out", 0.8) == "out0.8"
    assert sinks.fixed_length_name("d", 20, False) == "d_20_tok_after_state"
    assert sinks.fixed_length_name("d", 20, True) == "d_20_tok_after_state_sample"
    assert sinks.chooser_name("d", "random") == "d_f_random"
    assert sinks.tokenizer_name("d", "org/Model-1B") == "d_Model-1B"


def test_read_by_suffix(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, s string"), str(tmp_path / "deep/er/x.jsonl"))
    rows = readers.read_any(spark, str(tmp_path / "deep/er/x.jsonl"))
    assert {(r.id, r.s) for r in rows.collect()} == {(1, "a\nb"), (2, None)}
    (tmp_path / "y.json").write_text(json.dumps([{"id": 1}, {"id": 2}], indent=2))
    assert readers.read_any(spark, str(tmp_path / "y.json")).count() == 2
    (tmp_path / "z.csv").write_text('id,s\n1,"a\nb"\n')
    assert readers.read_any(spark, str(tmp_path / "z.csv")).first().s == "a\nb"
    spark.range(3).write.parquet(str(tmp_path / "table"))
    assert readers.read_any(spark, str(tmp_path / "table")).count() == 3
    with pytest.raises(ValueError):
        readers.read_any(spark, "history.pkl")


def test_run_round_trip(spark, tmp_path):
    states = spark.createDataFrame([(4, 0, 1, 0, "1", "A", "x", None, [1])], schemas.TRAJECTORIES)
    infos = spark.createDataFrame([(4, 0, 1, 2, "why", 0.5, "accept", -0.7, {5: -0.7}, "accept")], schemas.INFOS)
    graded = spark.createDataFrame([(1, 1.0)], schemas.RESULTS)
    path = str(tmp_path / "run")
    sinks.write_run(spark, path, states, infos, graded, {"seed": "7"})
    assert tuple(readers.read_trajectories(spark, path).select(states.columns).first()) == tuple(states.first())
    assert tuple(readers.read_infos(spark, path).select(infos.columns).first()) == tuple(infos.first())
    assert tuple(readers.read_results(spark, f"{path}/results", multi_line=False).first()) == (1, 1.0)
    assert spark.read.json(f"{path}/config").first().seed == "7"
    (tmp_path / "results.json").write_text(json.dumps([{"episode_id": 9, "pass@1": 0.0, "extra": 1}], indent=4))
    assert tuple(readers.read_results(spark, str(tmp_path / "results.json")).first()) == (9, 0.0)


def test_derived_inputs_are_skipped():
    assert sinks.unless_derived("data_f_random", "f_random", lambda: 1 / 0) is None
    assert sinks.unless_derived("data", "f_random", lambda: "built") == "built"


def test_column_drops(spark):
    wide = spark.createDataFrame(
        [(1, 2, 3, 4, 5, 6)], ["keep", "input_ids_code", "x_attention_mask", "labels", "my_labels", "empowerment_q"]
    )
    assert curation.drop_derived(wide).columns == ["keep", "my_labels"]
    assert curation.drop_if_present(wide, ["labels", "absent"]).columns == [
        "keep", "input_ids_code", "x_attention_mask", "my_labels", "empowerment_q",
    ]


def test_user_functions(spark):
    df = spark.range(20).withColumn("prompt", F.concat(F.lit("p"), F.col("id").cast("string")))
    added = user_functions.map_rows(df, lambda a, b, plus: a * 2 + len(b) + plus, ["id", "prompt"], "out", "long", plus=1)
    assert {r.id: r.out for r in added.collect()} == {i: i * 2 + len(f"p{i}") + 1 for i in range(20)}

    def sizes(frame):
        return frame.assign(rows=len(frame))[["id", "rows"]]

    batches = user_functions.map_batches(df.select("id").coalesce(1), sizes, "id long, rows long", 6).collect()
    assert sorted({r.rows for r in batches}) == [2, 6] and len(batches) == 20


def test_generate_retries(spark, tmp_path):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(10)], "id long, prompt string")
    folder = str(tmp_path)

    def flaky(prompts):
        import os
        import uuid

        if len(os.listdir(folder)) < 3:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            raise RuntimeError("busy")
        return [prompt.upper() for prompt in prompts]

    got = user_functions.generate(df, "prompt", "answer", flaky, clients=1)
    assert {r.id: r.answer for r in got.collect()} == {i: f"P{i}" for i in range(10)}

    def broken(prompts):
        raise RuntimeError("never works")

    with pytest.raises(Exception, match="never works"):
        user_functions.generate(df, "prompt", "answer", broken, clients=1).collect()


def test_workers_need_no_package(tmp_path):
    """The queries run from a folder in which workers cannot import the package."""
    root = Path(__file__).resolve().parent.parent
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from __spark_entry__ import queries\n"
        "from tracemill.session import build_session\n"
        "spark = build_session('elsewhere', 'local[2]', spark__sql__shuffle__partitions='2')\n"
        "for name in ('map_rows_u1', 'map_batches_u2', 'generate_u4'):\n"
        "    print(queries()[name](spark, '/root/testdata/sf0.001').count())\n"
    )
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split() == ["200", "500", "87"]


def test_a_rerun_replaces_its_own_run_only(spark, tmp_path):
    path = str(tmp_path / "runs")

    def publish(run, code, episodes=(1, 2), owner=None):
        states = spark.createDataFrame(
            [(owner or run, 0, e, 0, "1", "A", code, None, None) for e in episodes], schemas.TRAJECTORIES
        )
        infos = spark.createDataFrame([(run, 0, 1, 2, code, 0.5, "accept", -0.7, {5: -0.7}, "x")], schemas.INFOS)
        graded = spark.createDataFrame([(e, 1.0) for e in episodes], schemas.RESULTS)
        sinks.publish_run(spark, path, run, states, infos, graded, {"seed": code})

    def published():
        states = readers.read_trajectories(spark, path)
        results = spark.read.json(f"{path}/results")
        config = spark.read.json(f"{path}/config")
        return (
            sorted((r.run_id, r.episode_id, r.code) for r in states.collect()),
            sorted((r.run_id, r.episode_id) for r in results.collect()),
            sorted((r.run_id, r.seed) for r in config.collect()),
            sorted((r.run_id, r.reasoning) for r in readers.read_infos(spark, path).collect()),
        )

    publish(4, "a")
    publish(5, "b")
    first = published()
    publish(5, "b")
    assert published() == first
    publish(4, "c", episodes=(3,))
    assert published() == (
        [(4, 3, "c"), (5, 1, "b"), (5, 2, "b")],
        [(4, 3), (5, 1), (5, 2)],
        [(4, "c"), (5, "b")],
        [(4, "c"), (5, "b")],
    )
    with pytest.raises(ValueError, match="another run"):
        publish(4, "d", owner=9)
    assert published()[2] == [(4, "c"), (5, "b")]
