"""Language identification on invented languages, held-out accuracy and odd texts."""

import random

from weirworks.llm.language import identify_documents

SYLLABLES = {"aa": "ka lo mi nu pe".split(), "bb": "schr eit ung ach zu".split(), "cc": "éau oux que tre vi".split()}


def invented(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_und(make, odd):
    langs, texts = {}, []
    for i in range(240):
        langs[i] = list(SYLLABLES)[i % 3] if i % 40 else None
        texts.append((i, invented(list(SYLLABLES)[i % 3], 12, i)))
    langs |= {i: None for i, _ in odd}
    docs = make(texts + odd, lang=langs, repeat=(5, 900))
    rows = identify_documents(docs).collect()
    assert len(rows) == len(texts) + len(odd) + 2
    known = [r for r in rows if r.doc_id < 240]
    right = [r.lang_pred == list(SYLLABLES)[r.doc_id % 3] for r in known if r.held_out]
    assert sum(right) / len(right) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {900, 901, 902, 906}
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_no_labels_and_empty(make, prose):
    assert {r.lang_pred for r in identify_documents(make([(1, prose(9)), (2, "")], lang={1: None, 2: None})).collect()} == {"und"}
    assert identify_documents(make([(1, "x")]).limit(0)).count() == 0
