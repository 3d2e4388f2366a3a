"""What operators leave on disk and send in shuffles."""

import glob
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import jaccard
from gleaner.llm import textops as X
from gleaner.operators.storage import freed_shuffles, written


def test_packed_entries():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 300, np.uint64)) for _ in range(3000)]
    # two shingles that agree in what travels, next to a third one
    sets[0] = np.array([5 << 24, (5 << 24) + 7, (6 << 24) + 1, 2**64 - 2, 2**64 - 1], np.uint64)
    names = {int(n): len(s) for n, s in zip(rng.integers(0, 2**64, len(sets), np.uint64), sets)}
    rows = jaccard.pack(sets, names, 8, 4)
    assert sorted(rows.column("part").to_pylist()) == [0, 1, 2, 3]
    got: dict[int, list[int]] = {n: [] for n in names}
    for part, n, k, p in zip(*(rows.column(c) for c in ("part", "n", "k", "packed"))):
        h, c = jaccard.unpack(n.as_py(), k.as_py(), p.as_buffer())
        assert (np.diff(h.astype(np.int64)) >= 0).all() and ((h >> np.uint64(32)) % np.uint64(4) == part.as_py()).all()
        for x, y in zip(h.tolist(), c.tolist()):
            got[y].append(x)
    values = list(got.values())
    assert sorted(values[0]) == [0, 5, 6, 7, 2**40 - 1]
    assert [sorted(v) for v in values[1:]] == [(s >> np.uint64(24)).tolist() for s in sets[1:]]
    # a shingle and a class of 64 bits each took 16 bytes, about 14 after the shuffle's compression
    assert rows.column("packed").nbytes < 8 * sum(map(len, sets))


def test_joins_leave_no_shuffles_and_no_tables(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(400)], k=60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60] + (f" tail{i}" if i % 3 else "")) for i in range(180)], "doc_id long, text string").repartition(4)
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    spilled = lambda: {f for d in folder for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = spilled()
    ids, classes, labels = jaccard.classes_and_links(docs)
    assert not spilled() - before
    assert {r["component_id"] for r in jaccard.clusters(docs).collect()} == set(range(60))
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [n for n in os.listdir(top) if n.startswith(("shared-", "sets-"))]


def test_shuffles_are_freed_only_inside(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
        rows, _ = written(spark.range(100).repartition(3), "rows")
    assert spark.conf.get(key) == before and rows.count() == 100


def test_batches_of_long_texts_are_bounded(spark):
    """Rows count little for memory where texts are long: 200 texts of 100 KB came as one batch of 20 MB."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    texts = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = X.arrow(texts, sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 200 and max(r["bytes"] for r in got) < X.BATCH_BYTES + 200_000
