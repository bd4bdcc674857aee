import numpy as np

import llm_cases as C
from scoreflow.llm import embeddings


def brute(rows, least=0.95):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids = [i for i, _ in usable]
    x = np.stack([v / np.abs(v).max() for _, v in usable])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    root = C.least_reachable({i for i, _ in rows}, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close))])
    n = dict(zip(ids, close.sum(1).tolist()))
    return {i: (n.get(i, 0), root[i], root[i] == i) for i, _ in rows}


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, node int, weight int")


def found(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, **options).collect()}


def cases():
    rng = np.random.default_rng(4)
    rows = [rng.standard_normal(32) for _ in range(300)]
    center = rng.standard_normal(32)
    rows += [center + 0.12 * rng.standard_normal(32) for _ in range(150)]  # a dense group, wider than a window
    rows += [rows[0]] * 70 + [rows[1] + 0.2 * rng.standard_normal(32) for _ in range(5)]
    out = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(rows)), rows)]
    nan, big = float("nan"), float(np.float32(3e38))
    return out + [
        (1000, None), (1001, []), (1002, [0.0] * 32), (1003, [1.0, None] + [0.0] * 30), (1004, [nan] + [1.0] * 31),
        (1005, [float("inf")] + [1.0] * 31), (1006, [big] * 32), (1007, [1.0] * 32), (1008, [-0.0] * 31 + [2.0]), (1009, [0.0] * 31 + [1.0]),
    ]


def test_equals_brute_force(spark):
    assert found(table(spark, cases()).repartition(3)) == brute(cases())


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 20)
    monkeypatch.setattr(embeddings, "WINDOW", 4)
    assert found(table(spark, cases()), window=4) == brute(cases())


def near(rng, v, cosine):
    """A vector at ``cosine`` to ``v``."""
    v = np.array(v, float) / np.linalg.norm(v)
    side = rng.standard_normal(len(v))
    side -= (side @ v) * v
    return cosine * v + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_recall_of_planted_links_among_the_driver_vectors(spark):
    """Lone pairs just over the limit, chains, and a component of thousands, over a table that holds no link itself."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(9)
    new = [near(rng, rows[k][1], 0.9505) for k in range(0, 1000)]
    for k in range(1000, 1040):
        v = rows[k][1]
        for _ in range(10):
            v = near(rng, v, 0.955)
            new.append(v)
    new += [near(rng, rows[1100][1], 0.98) for _ in range(2500)]
    first = 1 + max(i for i, _ in rows)
    rows += [(first + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(new)]
    want, got = brute(rows), found(table(spark, rows))
    pairs = sum(want[first + k][0] for k in range(1000))
    assert pairs >= 1000 and sum(w[0] for w in want.values()) > 1_000_000
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[first + k][0] for k in range(1000)) >= 0.99 * pairs
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_windows_cross_partition_borders(spark, monkeypatch):
    """Partitions smaller and larger than a window link what windows over the whole order link."""
    rows, window = [(i, v) for i, v in cases() if i < 1000], 5
    classes = embeddings._classes(table(spark, rows))
    ordered = embeddings._ordered(classes, 2)
    monkeypatch.setattr(embeddings, "BORDER_ROWS", 200)
    for partitions in ("3", "60", "400"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [(r.a, r.b) for r in embeddings._neighbours(ordered, 0.8, window).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        whole = sorted(ordered.collect(), key=lambda r: (r["pass"], r.size, r.key, r.vec_id))
        links = []
        for i, r in enumerate(whole):
            for q in whole[i + 1 : i + 1 + window]:
                x, y = np.frombuffer(r.v), np.frombuffer(q.v)
                if r["pass"] == q["pass"] and x @ y >= 0.8 * np.linalg.norm(x) * np.linalg.norm(y):
                    links.append((r.vec_id, q.vec_id))
        ids = {r.vec_id for r in whole}
        assert len(set(links)) > 100 and C.least_reachable(ids, got) == C.least_reachable(ids, links)


def test_passes_grow_with_the_table():
    assert [embeddings.passes_for(n) for n in (0, 1, 50_000, 10**9)] == [24, 24, 24, 79]


def test_other_lengths_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0])]
    got = embeddings.near_vectors(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 0, 2), (3, 2, 1), (3, 2, 1)]
    assert embeddings.near_vectors(table(spark, [])).collect() == []
