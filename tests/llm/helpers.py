import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", score double, part int, node string, grp string, replica string, kept string"


def words(rng, n, stem=""):
    return " ".join(stem + "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents():
    """Nulls in every column, empty, blank, tiny and very long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = words(rng, 30)
    near = base.split()
    near[50] = "changed"
    texts = [
        base, base, " ".join(near), words(rng, 40) + " " + passage + " " + words(rng, 40), words(rng, 10) + "\n" + passage, None, "", "   \n ", "a", "a", "two words", words(rng, 20_000),
        "é" * 120, "é" * 121, "x" * 300, "\n".join([words(rng, 8)] * 4), "<|endoftext|> it's  a\ttest\r\n 12 ,,   ok", passage + passage, "😀 " * 80,
    ]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s0", "s1", None)[i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None))
    rows.append((None, "null id " + passage, "en", "s2", 5))
    rows.append(rows[3])  # a repeated row
    rows.append((4, "another text under a used id " + words(rng, 60), "en", "s1", 9))
    return rows


def frame(spark, rows=None, parts=3):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows else spark.createDataFrame([], SCHEMA)


def crowded(spark, rows=None):
    """With more columns, whose names the operators use themselves."""
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(*r, 1.0, 2, "n", "g", "r", "k") for r in rows], EXTRA)
