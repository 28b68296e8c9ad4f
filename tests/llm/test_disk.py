"""What is shuffled grows with the table, and what was shuffled goes once it is written."""

from __future__ import annotations

import random
import time

import numpy as np
from siftwall.llm import jaccard_join
from siftwall.session import CLEANUP, stage


def test_shingles_frequent_over_all_blocks_come_last(spark, monkeypatch):
    # a block a text, so no block holds a shingle twice
    monkeypatch.setattr(jaccard_join, "BLOCK", 1)
    rng = random.Random(1)
    common = [f"common{k}" for k in range(20)]
    texts = [" ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(80)]) for _ in range(300)]
    docs = stage(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "test-docs")
    known = jaccard_join._frequent(stage(jaccard_join._sizes(docs, 5), "test-sizes"))
    assert len(known[0]) == 16 and known[1].min() >= 3
    prefixes = jaccard_join._prefixes(docs, known, 5, 80).collect()
    assert len(prefixes) == 300
    assert not {t for r in prefixes for t in r.prefix} & set(known[0].view(np.int64).tolist())


def test_a_staged_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, own = shuffled(), spark.conf.get(CLEANUP)
    rows = stage(spark.range(10_000).selectExpr("id % 97 AS k").groupBy("k").count(), "test-stage")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert rows.count() == 97 and spark.conf.get(CLEANUP) == own
