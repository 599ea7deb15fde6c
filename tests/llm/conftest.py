import os

import pytest

from tracemill.llm import registry  # noqa: F401  fails here, plainly, if the subpackage is broken

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def spark_llm(spark):
    return spark


def documents(spark, texts, **columns):
    """Documents of the given texts with ids from 0; more columns by name."""
    names = list(columns)
    rows = [(i, text, *[columns[name][i] for name in names]) for i, text in enumerate(texts)]
    kinds = "".join(f", {name} string" for name in names)
    return spark.createDataFrame(rows, "doc_id long, text string" + kinds)


def sf_of(spark, folder, **frames):
    """A data folder with the given frames as tables."""
    os.makedirs(folder, exist_ok=True)
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
