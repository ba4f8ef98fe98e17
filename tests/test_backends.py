"""Backends as data sources, fan-out with a failing one, exact percentiles by ranges, neighbours by blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import stats, telemetry
from quillstone.sources import backends

SCHEMA = "id bigint, user string, v double"


def make(log, fails=False):
    class Shards:
        """Three shards of ten rows; writes down what it is asked for."""

        def partitions(self, options):
            return [0, 1, 2]

        def read(self, options, part, equal):
            if fails and part == 1:
                raise ConnectionError("shard 1 is down")
            with open(f"{log}/{part}", "w") as out:
                out.write(repr(sorted(equal.items())))
            for i in range(part * 10, part * 10 + 10):
                row = (i, f"u{i % 2}", float(options.get("add", 0)) + i)
                if all(row[["id", "user", "v"].index(c)] == x for c, x in equal.items()):
                    yield row

    return Shards()


def test_backend_reads_in_parts_and_takes_filters(spark, tmp_path):
    backends.register(spark, "shards", SCHEMA, make(str(tmp_path)))
    rows = spark.read.format("shards").option("add", "100").load()
    assert sorted(map(tuple, rows.collect())) == [(i, f"u{i % 2}", 100.0 + i) for i in range(30)] and rows.rdd.getNumPartitions() == 3
    assert {r.id for r in rows.filter("user = 'u1' AND id > 15").collect()} == {17, 19, 21, 23, 25, 27, 29}
    assert {p.read_text() for p in tmp_path.iterdir()} == {"[('user', 'u1')]"}


def test_one_failing_backend(spark, tmp_path):
    backends.register(spark, "good", SCHEMA, make(str(tmp_path)))
    backends.register(spark, "bad", SCHEMA, make(str(tmp_path), fails=True))
    asked = spark.createDataFrame([(1, 3.2), (2, 28.9)], "query_id int, at double")

    def search(name):
        def run(queries):
            rows = spark.read.format(name).load()
            near = rows.join(queries, F.abs(F.col("v") - F.col("at")) < 3)
            return near.select("query_id", F.concat(F.lit(name), "id").alias("chunk_id"), F.abs(F.col("v") - F.col("at")).alias("distance"))

        return run

    def nowhere(queries):
        raise RuntimeError("no route")

    hits, report = backends.fan_out(asked, {"good": search("good"), "bad": search("bad"), "gone": nowhere}, 2)
    assert [(r.query_id, r.place, r.chunk_id) for r in hits.orderBy("query_id", "place").collect()] == [(1, 1, "good3"), (1, 2, "good4"), (2, 1, "good29"), (2, 2, "good28")]
    said = {r.backend: r for r in report.collect()}
    assert said["good"].ok and said["good"].hits > 0 and not said["bad"].ok and not said["gone"].ok and "no route" in said["gone"].error and said["bad"].error
    hits, report = backends.fan_out(asked, {"gone": nowhere})
    assert hits.count() == 0 and not report.first().ok


@pytest.mark.parametrize("buckets", [2, 5, 64])
def test_percentiles_by_ranges(spark, buckets):
    rng = random.Random(buckets)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.0, 1.0, rng.random() * 9, float(rng.randrange(5)), None])) for _ in range(600)] + [("one", 7.0), ("hot", 2.0), ("none", None)] + [("hot", 5.0)] * 50
    percents = [0, 1, 37, 50, 95, 99, 100]
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want[g] = [v[max(1, min(len(v), round(p / 100 * len(v) + 0.5))) - 1] for p in percents]
    found = telemetry.nearest_rank(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", percents, buckets)
    assert {r.g: [r[f"p{p}"] for p in percents] for r in found.collect()} == want


def test_neighbours_by_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(g, f"{g}{i}", v.tolist()) for g, n in [("a", 60), ("b", 3), ("c", 1)] for i, v in enumerate(rng.integers(-2, 3, (n, 4)).astype(float))] + [("a", "a-null", None), (None, "x", [1.0] * 4)]
    frame = spark.createDataFrame(rows, "doc string, id string, embedding array<float>")
    want = {}
    for g, i, v in rows:
        if v is None or g is None:
            continue
        near = []
        for h, j, w in rows:
            if h == g and j != i and w is not None:
                n = np.linalg.norm(v) * np.linalg.norm(w)
                near.append((-round(float(np.dot(v, w) / n), 6) if n else 0.0, j))
        want[i] = [j for _, j in sorted(near)[:3]]
    for block in (7, 1024):
        found = {}
        for r in stats.neighbours(frame, "doc", "id", 3, block).orderBy("id", "rank").collect():
            found.setdefault(r.id, []).append(r.neighbour)
        assert found == {k: v for k, v in want.items() if v}
    assert stats.neighbours(frame.limit(0), "doc", "id").count() == 0
