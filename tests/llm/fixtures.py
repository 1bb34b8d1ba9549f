"""Small tables with the awkward cases that every operator must take."""

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key long, label string, size long, node long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed=5, plain=60):
    """(doc_id, text, lang, source): prose, copies, near copies, nulls, blanks, ties, a very long text."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(plain)]
    texts += texts[:6] + [None, "", "   ", "\n\t", "one", "A b", "a  B", "x" * 30_000, words(rng, 6_000), "日本語 é ß <|endoftext|> 'll", "1 2 3", "!!!"]
    for text in texts[:12]:
        parts = text.split()
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None])) for i, t in enumerate(texts)]
    return rows + rows[:3]


def frame(spark, rows):
    """A frame of documents whose further columns clash with names that operators use inside."""
    return spark.createDataFrame([(*r, None, "x", 1, "y", 2, 3) for r in rows], DOCS).repartition(3)
