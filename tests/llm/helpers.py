"""A small documents table with every awkward case, and brute-force helpers."""

import random
import zlib

WORDS = "the of and to in that is was for with alpha beta gamma delta epsilon zeta theta kappa lambda sigma".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "ing"]) for _ in range(n))


def documents(seed=3, n=60):
    """(doc_id, text, lang, source, n_chars, fp, u): the last two clash with names that operators might use."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(n)]
    texts += [texts[3], texts[3].upper(), texts[5] + " tail", texts[3], "", None, "   \n\t ", "ÄÖ straße é", "x" * 5000, prose(rng, 4000)]
    near = prose(rng, 300)
    texts += [near, near.replace("alpha", "alfa", 1), near + " more"]
    rows = [(i * 7 % 1000, t, "en", "src0" if i % 3 else "src1", len(t or ""), 1, "u") for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[4], None, None, None, None, None), (None, None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, u string"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def held(doc_id, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder


def as_tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
