"""Small documents for the operators' tests."""

import random
import re

#: Columns whose names the operators use themselves.
CLASHES = ("key", "n", "rep", "component", "label", "spans", "feature", "bucket", "doc_group", "h1", "part")


def documents(spark, rows):
    """Rows (doc_id, text) with further columns of clashing names."""
    data = [(i, t, *[f"x{i}"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES))


def prose(seed, n, words=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def alnum_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def space_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def least_reachable(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
