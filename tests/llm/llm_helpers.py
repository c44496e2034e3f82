"""Small corpora and brute-force answers for the operators' tests."""

import random
import re

SCHEMA = "doc_id bigint, text string, source string, _key string, n int, shard int, size string"


def frame(spark, rows, partitions=3):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, s, "k", 1, 2, "x") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def docs(spark, texts, partitions=3):
    return frame(spark, [(i, t, f"s{i % 3}") for i, t in enumerate(texts)], partitions)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


ODD = [None, "", "   ", "\n\n", "one", "two words", "Ünï çødé 😀 text", "a " * 3000]


def shingle_set(text, size):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def components(n, links):
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        if x != y:
            root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def generator(seed):
    return random.Random(seed)
