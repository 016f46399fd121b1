import random

import pytest

WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from {doc_id: text}, with extra columns whose names clash with what operators make."""
    def build(texts, lang="en", repeat=()):
        rows = [(i, t, lang if isinstance(lang, str) else lang[i], "src0", len(t or ""), 7, "x", 1.5, True) for i, t in texts]
        rows += [r for r in rows if r[0] in repeat]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                           "shard int, batch string, score double, held_out boolean")
    return build


@pytest.fixture(scope="session")
def prose():
    def build(n, seed=0, vocabulary=400):
        rng = random.Random(seed)
        own = WORDS + [f"w{i}" for i in range(vocabulary)]
        return " ".join(rng.choice(own) for _ in range(n))
    return build


ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "Ünïcode ß 漢字 🙂 words"), (905, "a " * 30000), (906, "%%% ### 123")]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)
