"""Data for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{x}" for x in (rng.randrange(size) for _ in range(n))]


def documents(spark, texts, sources=None, ids=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or {}).get(i, f"src{i}") if isinstance(sources, dict) or sources is None else sources[k], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, length=60):
    rng = random.Random(seed)
    return [" ".join(words(rng, rng.randrange(1, length))) for _ in range(n)]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
