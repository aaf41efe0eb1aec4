"""Lloyd's rounds over column blocks against plain loops."""

import hashlib
import math
import random

import pytest

from docket_spark.llm import centroids

WIDTH = 7


def plain(rows, width, clusters, rounds, scale=1024, seed=3):
    """(id, cluster, distance) of each row that is kept, and the final centroids."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v, *_ in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def assign():
        result = []
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centers]
            result.append((i, far.index(min(far)), min(far)))
        return result

    for _ in range(rounds):
        of = assign()
        for k in range(len(centers)):
            own = [v for (_, v), (_, c, _) in zip(kept, of) if c == k]
            if own:
                centers[k] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(assign(), key=repr), centers


def vectors(spark, rows):
    full = [(*row, "x", "y") for row in rows]
    return spark.createDataFrame(full, "vec_id long, embedding array<float>, cells string, `a.b` string")


def hard_vectors(draw):
    near = lambda x: float(round(x * 64)) / 64  # noqa: E731  (exact as a 32-bit float)
    rows = [(k, [near(draw.gauss(k % 3, 0.4)) for _ in range(WIDTH)]) for k in range(120)]
    rows += [(500 + k, rows[0][1]) for k in range(60)]  # a frequent vector
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (None, None)]
    rows += [(901, None), (902, []), (903, [1.0] * (WIDTH - 1)), (904, [None] + [1.0] * (WIDTH - 1))]
    rows += [(905, [math.nan] + [1.0] * (WIDTH - 1)), (906, [math.inf] + [1.0] * (WIDTH - 1))]
    return rows


@pytest.mark.parametrize(("shard_width", "block_rows", "rounds"), [(3, 16, 4), (64, 4096, 1), (1, 5, 0)])
def test_members_and_centroids_equal_plain_loops(spark, shard_width, block_rows, rounds):
    rows = hard_vectors(random.Random(3))
    members, found = centroids.cluster(
        vectors(spark, rows), width=WIDTH, clusters=5, rounds=rounds, shard_width=shard_width, block_rows=block_rows
    )
    want, centers = plain(rows, WIDTH, 5, rounds)
    assert sorted((tuple(r) for r in members.collect()), key=repr) == want
    assert {r.cluster: r.cells for r in found.collect()} == dict(enumerate(centers))
    told = centroids.with_inertia(members, found).collect()
    assert {r.inertia for r in told} == {sum(d for *_, d in want)}
    for r in told:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        listed = ",".join(map(str, centers[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_slices_too_large_to_broadcast_are_joined(spark, monkeypatch):
    rows = hard_vectors(random.Random(4))
    monkeypatch.setattr(centroids, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(centroids, "PARTS", 3)
    members, _ = centroids.cluster(vectors(spark, rows), width=WIDTH, clusters=3, rounds=2, shard_width=4, block_rows=16)
    assert sorted((tuple(r) for r in members.collect()), key=repr) == plain(rows, WIDTH, 3, 2)[0]


def test_ties_empty_clusters_and_few_vectors(spark):
    # Equal vectors: all go to the first of the equal centroids, the others stay without members.
    same = [(k, [0.5] * WIDTH) for k in range(6)]
    members, found = centroids.cluster(vectors(spark, same), width=WIDTH, clusters=3, rounds=2)
    assert {(r.cluster, r.distance) for r in members.collect()} == {(0, 0)}
    assert {r.cluster: r.cells for r in found.collect()} == {k: [512] * WIDTH for k in range(3)}
    members, found = centroids.cluster(vectors(spark, same[:2]), width=WIDTH, clusters=8, rounds=1)
    assert members.count() == 2 and found.count() == 2
    members, found = centroids.cluster(vectors(spark, []), width=WIDTH)
    assert members.count() == found.count() == centroids.with_inertia(members, found).count() == 0


def test_components_beyond_64_bits_stop_the_job(spark):
    rows = [(1, [3e38] * WIDTH), (2, [0.0] * WIDTH)]
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(vectors(spark, rows), width=WIDTH, clusters=1, rounds=1)


def test_matrices_stay_where_they_are(spark):
    """The choices move to the buckets of the matrices, not the other way round."""
    rows = [(k, [float(k % 5)] * WIDTH) for k in range(50)]
    kept = centroids.whole_vectors(vectors(spark, rows), "vec_id", "embedding", WIDTH, 1024)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = centroids.Lloyd(kept, WIDTH, 2, 3, 3, 16)
        left = state.with_choices()._jdf.queryExecution().executedPlan().toString().split("FileScan")[0]
        assert "SortMergeJoin" in left and "Exchange" not in left.split("SortMergeJoin")[1]
        state.drop()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
