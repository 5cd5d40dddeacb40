"""Documents for the tests: nulls, empty and long texts, ties, repeats, odd columns."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts, extra=False):
    """``texts``: (doc_id, text) pairs. With ``extra``, columns whose names operators use
    themselves."""
    rows = [(i, t, "en", None if i is None or i % 5 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("id", "key", "body", "words", "digest", "n", "a", "b", "row", "rank", "kept", "rule", "maybe", "window", "bucket", "s", "base", "size", "node", "sha"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def corpus(seed=1, n=40):
    """Texts with copies, near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    out = [prose(rng, rng.choice([3, 8, 20, 60, 150])) for _ in range(n)]
    passage = prose(rng, 60)
    for k in range(0, n, 4):
        out[k] = f"{out[k]} {passage} {prose(rng, 5)}"
    near = prose(rng, 200).split()
    for k in range(12):
        other = list(near)
        other[rng.randrange(200)] = f"edit{k}"
        out.append(" ".join(other))
    out += [out[1]] * 3 + [out[4]] * 2
    out += [None, "", "   \n\t", "one", "a b c d e", "la " * 400, "x" * 5000, "▁ odd   space   wide", "tie tie tie tie tie tie tie"]
    return [(k * 3 + 1, t) for k, t in enumerate(out)] + [(None, out[1]), (1, out[0])]
