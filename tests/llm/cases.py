"""Small frames and brute-force versions shared by the tests of this folder."""

import collections
import re

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

#: Nulls in every column, empty and white texts, ties, repeated rows.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "s1", 45),
    (2, "alpha  beta gamma\tdelta epsilon zeta eta theta", "en", "s2", 46),
    (3, None, None, None, None), (4, "", "en", "s1", 0), (5, " \t\n ", "en", None, 4), (None, None, None, None, None),
    (None, "alpha beta gamma delta epsilon zeta eta theta", "de", "s1", 45),
    (6, "one two", "en", "s3", 7), (6, "one two", "en", "s3", 7), (7, "ONE two", "en", "s3", 7),
    (8, "word " * 4000 + "end", "en", "s2", 20003), (9, "x" * 30000, "en", "s2", 30000),
    (10, "é ß 漢字 😀 " * 30, "fr", "s4", 300),
]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd(spark, extra=True):
    """The odd rows, with extra columns that clash with helper names."""
    df = frame(spark, ODD).repartition(3)
    if extra:
        for name in ("row", "__row", "size", "label", "node", "key", "kept", "words", "id", "a.b", "bin", "__id"):
            df = df.withColumn(name, df["n_chars"])
    return df


def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(docs):
    """doc_id -> smallest linked doc_id, all pairs compared."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def repeat_words(words):
    n = collections.Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if n[w] > 1 for k in range(3)})
