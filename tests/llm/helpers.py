from itertools import combinations


def components(ids, links):
    """Smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def pairs(n):
    return combinations(range(n), 2)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_docs(spark, extra=()):
    """Nulls, empty and long texts, copies, and columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "word " * 30_000, "en", "b", 1),
        (5, "the quick brown fox jumps over the lazy dog again and again", "fr", "b", 10),
        (5, "the quick brown fox jumps over the lazy dog again and again", "fr", "b", 10),
        (7, " \n\t ", "de", None, 4),
        (None, "no id here but some words to read", "en", "a", 3),
        (9, "x" * 100_000, "en", "a", 3),
        *extra,
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("score", "shard", "slot", "fp", "component_id", "replica", "shuffle_key", "size", "key", "salt", "spans", "redacted", "predicted", "ids"):
        df = df.selectExpr("*", f"'mine' AS {name}")
    return df
