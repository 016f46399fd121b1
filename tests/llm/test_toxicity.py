"""The classifier on planted words, its thresholds, and odd texts."""

import random

from weirworks.llm import toxicity as T

BAD = {"en": "idiot moron scum".split(), "fr": "vejuxa vejuxo vejuxi".split()}


def corpus(prose, n=320):
    texts, labels, langs = [], [], {}
    for i in range(n):
        rng, lang = random.Random(i), ("en", "fr")[i % 2]
        words = prose(60, i).split()
        toxic = i % 4 == (i // 4) % 4
        for _ in range(6 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(BAD[lang]) if lang == "en" else "vejux" + rng.choice("abcdefgh") + rng.choice("xyz"))
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
        langs[i] = lang
    return texts, labels, langs


def test_held_out_and_odd(spark, make, prose, odd):
    texts, labels, langs = corpus(prose)
    langs |= {i: None for i, _ in odd}
    table = spark.createDataFrame(labels + [(900, 1, 0), (5000, 0, 1), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    rows = T.classify_documents(make(texts + odd, lang=langs, repeat=(3,)), table).collect()
    assert len(rows) == len(texts) + len(odd) + 1
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id < 320]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    clean = [r for r in rows if r.doc_id < 320 and not truth[r.doc_id]]
    assert sum(r.rejected for r in clean) / len(clean) < 0.05
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (900, 901, 902)}) == 1


def test_long_text_is_read_to_its_end(spark, make, prose):
    texts, labels, langs = corpus(prose)
    model = T.train(make(texts, lang=langs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    long = prose(40000, 9)
    low, high = (T.with_rejection(make([(1, t)]), model).first() for t in (long, long + " idiot scum moron idiot scum"))
    assert low.toxicity_score < 0.5 < high.toxicity_score


def test_without_labels_and_empty(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = T.classify_documents(make([(1, "idiot"), (2, None)]), none).collect()
    assert [(r.score, r.rejected) for r in rows] == [(0.0, False)] * 2
    assert T.classify_documents(make([(1, "x")]).limit(0), none).count() == 0
    taken = T.with_rejection(make([(1, "x")]).withColumnRenamed("score", "toxicity_score"), None)
    assert "_toxicity_rejected" in taken.columns


def test_every_labelled_text_counts(spark, make, prose, monkeypatch):
    """A word that marks one toxic text in eight hundred, and shards that each see a part of the texts."""
    monkeypatch.setattr(T, "SHARD_BYTES", 40_000)
    texts, labels, langs = corpus(prose, 1600)
    seen = []
    start = T._start
    monkeypatch.setattr(T, "_start", lambda counts, size, seed: (seen.append((counts, size)), start(counts, size, seed))[1])
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = T.train(make(texts, lang=langs), table)
    counts, size = seen[0]
    held = {r.doc_id for r in table.where("pmod(xxhash64(doc_id, 5), 4) = 0").collect()}
    assert size == [sum(t == c for i, _, t in labels if i not in held) for c in (0, 1)]
    word = T._ids(next(T.pieces(T.pa.array(["idiot"]), letters=True))[2])[0][0, 0]
    assert counts[word, 1] >= sum("idiot" in t.split() for i, t in texts if i not in held) > 0
    rows = {r.doc_id: r for r in T.with_rejection(make(texts, lang=langs), model).collect()}
    right = sum((rows[i].toxicity_score >= 0.5) == bool(t) for i, _, t in labels if i in held)
    assert right / len(held) > 0.95
    again = T.train(make(texts[::-1], lang=langs).repartition(5), table)
    assert max(abs(x - y) for x, y in zip((*again.scale, again.threshold), (*model.scale, model.threshold), strict=True)) < 1e-4
    assert (again.table == model.table).all()


def test_thresholds_and_scale_are_those_of_all_rows(spark):
    rng = random.Random(4)
    rows = [("en" if i % 3 else None, int(x > rng.gauss(0.5, 1)), x) for i in range(900) for x in [round(rng.gauss(0, 2), 1)]]
    checks = spark.createDataFrame(rows, "lang string, toxic int, logit double").repartition(7)
    model = T.Model(None, None, None, None, 0.0, (1.3, -0.2))

    def best(own):
        cuts = sorted({x for _, _, x in own}, reverse=True)
        f1 = [2 * sum(t for _, t, x in own if x >= c) / (sum(x >= c for _, _, x in own) + sum(t for _, t, _ in own)) for c in cuts]
        k = f1.index(max(f1))
        p = [float(T._calibrated(T.np.float64(c), model)) for c in cuts] + [0.0]
        return p[k] - 0.1 * (p[k] - p[k + 1])
    assert T._thresholds(checks, model) == {"": best(rows), "en": best([r for r in rows if r[0]])}
    a, b = T._platt(checks)
    g = [1 / (1 + T.np.exp(-(a * x + b))) - t for _, t, x in rows]
    assert abs(sum(g)) < 3 and abs(sum(v * x for v, (_, _, x) in zip(g, rows, strict=True))) < 6
