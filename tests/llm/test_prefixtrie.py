import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scoreflow.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part long, k1 string, parent_conv_id long, kids int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def rebuilt(rows, stitch):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    if not stitch:
        return convs
    out = {}
    for c, ts in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + ts[h:]
    return out


def brute(rows, stitch=True):
    convs = rebuilt(rows, stitch)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids, out = {}, []
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in own) if own else 1
        saved[p] = sum(saved[k] for k in own) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out.append((
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(own), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[0], r[1]))


def found(df, stitch=True):
    return sorted((tuple(r) for r in P.prefix_trie(df, stitch).collect()), key=lambda r: (r[0], r[1]))


def cases():
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(95, 130), 205, 301, 302, 100_000_000_007, -3, -150]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "yes", "été", "", "no way"])))
    rows += [(400, t, "user", f"deep {t}") for t in range(60)] + [(401, t, "user", f"deep {t}") for t in range(45)]
    rows += [(500, 0, "ab", "c"), (501, 0, "a", "bc"), (None, 0, "user", "lost"), (600, None, "user", "null first"), (600, 0, "user", "b")]
    rows += [(700, 1, None, None), (700, 1, "user", "tie"), (700, 1, "user", "tie"), (701, 0, "user", "short")]
    return rows


def test_equals_brute_force_with_rebuilt_conversations(spark):
    rows = cases()
    random.Random(1).shuffle(rows)
    assert found(turns(spark, rows).repartition(3)) == brute(rows)


def test_equals_brute_force_as_they_are(spark):
    rows = cases()
    assert found(turns(spark, rows), stitch=False) == brute(rows, False)


def test_one_conversation_over_several_partitions(spark):
    """Ranks, prefixes and ends of a conversation whose rows stand in many tasks."""
    rows = [(7, t, "user", f"t{t // 3}") for t in range(400)] + [(8, t, "user", f"t{t // 3}") for t in range(350)]
    rows += [(c, 0, "user", "x") for c in range(20, 30)]
    df, merging = turns(spark, rows), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        assert P._ranked(df).select("conv_id", "part").distinct().where("conv_id = 7").count() > 1
        assert found(df) == brute(rows)
    finally:
        spark.conf.unset(merging)


def test_many_children_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BITS", 3)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)]
    rows += [(c, t, "user", f"{c}" if t else "same") for c in range(300, 500) for t in range(2)]
    assert found(turns(spark, rows), stitch=False) == brute(rows, False)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    seen = []
    kept = P._round
    monkeypatch.setattr(P, "_round", lambda alive, turn: (seen.append(turn), kept(alive, turn))[1])
    n = 3000
    chain = spark.range(n).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("depth"), F.when(F.col("id") > 0, F.lit(1)).alias("up_conv"),
        F.when(F.col("id") > 0, F.col("id") - 1).alias("up_depth"), (F.col("id") < n - 1).cast("long").alias("kids"),
        (F.col("id") == n - 1).cast("long").alias("leaves"), F.col("id").alias("saved"),
    )
    got = {r.depth: (r.leaves, r.saved) for r in P.subtree_totals(chain).collect()}
    assert got == {d: (1, sum(range(d, n))) for d in range(n)}
    assert len(seen) < 30


def test_empty_table_and_only_lost_rows(spark):
    assert found(turns(spark, [])) == []
    assert found(turns(spark, [(None, 0, "user", "a")])) == []


@pytest.mark.parametrize("rows", [[(5, 0, "user", "a")], [(100, 0, "user", "a"), (101, 0, "user", "a")]])
def test_single_turns(spark, rows):
    assert found(turns(spark, rows)) == brute(rows)
