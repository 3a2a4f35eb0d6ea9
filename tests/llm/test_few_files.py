"""Checkpoints of small rows are few files, however many partitions shuffles have."""

from pathlib import Path
from urllib.parse import urlparse

import pytest

from talus.llm import lmscore
from talus.llm.common import ensure_checkpoints, settings
from talus.llm.components import components

PARTITIONS = 64


@pytest.fixture
def files(spark):
    """How many parts of checkpoints have been written so far."""
    ensure_checkpoints(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    with settings(spark, spark__sql__shuffle__partitions=str(PARTITIONS), spark__sql__adaptive__coalescePartitions__enabled="false"):
        yield lambda: sum(1 for _ in folder.rglob("part-*"))


def test_components(spark, files):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    before = files()
    assert {tuple(r) for r in components(edges).collect()} == {(k, 0) for k in range(41)}
    assert files() - before < 2 * PARTITIONS


def test_lm_scores(spark, files):
    docs = spark.createDataFrame([(k, f"some words of text {k} {k % 7}") for k in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality long, toxic long")
    before = files()
    assert lmscore.score(docs, labels).count() == 30
    assert files() - before < 2.5 * PARTITIONS  # the blocks and the sums of words have one for each partition
