"""Plain Python versions of what the operators compute, and a table of awkward documents."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k):
    w = WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def components(sets, percent=80):
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and columns with clashing names."""
    base = " ".join(f"word{i % 97} and text{i % 31}" for i in range(400))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base.replace("word5 ", "other "), "en", "b", 1),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, "one", "en", "b", 3),
        (7, "one", "de", None, 3),
        (8, "Two Words", "en", "c", 9),
        (9, "... !!! ---", None, "c", 11),
        (10, "größe straße über für und nicht " * 40, "de", "c", 5),
        (11, "long" * 40_000 + " " + "tail " * 3_000, "en", "a", 5),
        (None, "a row without an id", "en", "a", 5),
        (12, "twice the same row here", "en", "a", 5),
        (12, "twice the same row here", "en", "a", 5),
        (-7, "\u3053\u3093\u306b\u3061\u306f \u4e16\u754c", "ja", "d", 5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("id", "node", "size", "kept", "shard", "n", "value", "target", "copies", "held_out", "score")})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
