import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "kilo", "lima", "mike", "nova", "été", "große", "papa", "zulu"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edited(text, every):
    w = text.split()
    return " ".join("changed" if i % every == every // 2 else x for i, x in enumerate(w))


def fixture_rows():
    """Copies, near copies, ties, a null and an empty text, a very long one, few words, repeated rows."""
    a, b = prose(1, 200), prose(2, 150)
    texts = [a, a, edited(a, 90), b, edited(b, 60), prose(3, 300), None, "", "   \n\t", "one", "one two", "One  TWO", prose(4, 12000), prose(5, 80) + "\n" + a[:600], "aaaa" * 200, "aaaa" * 200 + "b", "é" * 300]
    return [(i + 10, t, "en", f"src{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]


def docs(spark, rows=None):
    rows = fixture_rows() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    for c in ("size", "h", "i", "shard", "slot", "n", "band", "node", "component", "bucket", "draw", "epoch", "target", "kept", "sid", "spans", "item_id", "host", "path", "gram", "pos", "id"):
        df = df.withColumn(c, F.lit("x"))
    return df
