import random


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, sources=None):
    """Rows (doc_id, text) as a documents table."""
    rows = [(d, t, "en", sources[k] if sources else "s", len(t or "")) for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)
