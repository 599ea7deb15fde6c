"""Queries agree with SQL when one key holds a third of the rows."""

import shutil
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from tests.test_queries import FOLDER, TABLES, normal

NAMES = [
    "activity_w6",
    "active_per_cycle_a13",
    "implicit_acceptance_a14",
    "code_growth_w2",
    "states_back_w5",
    "final_state_w3",
    "character_totals_a10",
    "discounted_pass_error_a12",
    "audit_table_p10",
    "enrich_problems_j5",
    "paired_futures_j7",
    "keep_passed_f4",
    "line_changes_x11",
    "render_chat_x10",
    "deduplicate_j2",
    "conform_problems_p8",
    "vocabulary_t1",
    "tokenize_t1",
    "decode_t2",
    "shuffle_and_take_o2",
    "acceptor_decision_d1",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """One conversation of 300 turns, one user and day, one contest and one word with a third of the rows."""
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        shutil.copy(Path(FOLDER) / f"{name}.parquet", folder)
    duck = duckdb.connect()

    def rewrite(name, body):
        (folder / f"{name}.parquet").unlink()
        duck.execute(f"COPY ({body}) TO '{folder}/{name}.parquet' (FORMAT parquet)")

    source = f"'{FOLDER}/{{}}.parquet'"
    rewrite(
        "conversations",
        f"""SELECT * FROM {source.format('conversations')} WHERE conv_id <> 4
            UNION ALL SELECT 4, i, CASE i % 2 WHEN 0 THEN 'user' ELSE 'assistant' END, 'line ' || i || chr(10)
            FROM range(0, 300) t(i)""",
    )
    rewrite(
        "documents",
        f"""SELECT * FROM {source.format('documents')}
            UNION ALL SELECT 40 * (i + 1000), 'the the the word ' || i, 'en', 'copy', 20 FROM range(0, 120) t(i)""",
    )
    rewrite(
        "events",
        f"""SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, event_type, value, props
            FROM {source.format('events')}""",
    )
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), duck


@pytest.mark.parametrize("name", NAMES)
def test_hot_keys(spark, skewed, name):
    folder, duck = skewed
    frame = queries()[name](spark, folder)
    cursor = duck.execute(oracle_sql()[name])
    assert normal(frame.columns, frame.collect()) == normal([c[0] for c in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", ["tokenize_t1", "decode_t2", "chosen_text_t10"])
def test_vocabulary_past_the_broadcast_size(spark, skewed, monkeypatch, name):
    from tracemill.operators import vocabulary

    monkeypatch.setattr(vocabulary, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vocabulary, "HEAD_RANKS", 50)
    test_hot_keys(spark, skewed, name)


@pytest.mark.parametrize("name", ["activity_w6", "code_growth_w2", "states_back_w5", "keep_passed_f4"])
def test_small_blocks(spark, skewed, monkeypatch, name):
    from tracemill.operators import scale

    for function in (scale.with_previous, scale.with_group_values):
        defaults = tuple(8 if value == scale.BLOCK else value for value in function.__defaults__)
        monkeypatch.setattr(function, "__defaults__", defaults)
    test_hot_keys(spark, skewed, name)
