import random
import re
import zlib

import numpy as np
from auxograph.llm import quality, toxicity
from auxograph.llm.words import Words, chunks, windows
import pyarrow as pa
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (rank[label == 1].mean() - (n1 - 1) / 2) / (len(label) - n1)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.query(spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.93
    flagged = got[got.predicted == 1]
    assert flagged.toxic.mean() > 0.9 and got[got.toxic == 1].predicted.mean() > 0.7


def test_toxicity_of_misspellings():
    r = random.Random(1)
    clean = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(80))
    bad = ["horrible", "dreadful", "wretched"]
    sample = [(clean(), 0) for _ in range(300)] + [(clean() + " " + r.choice(bad) + " " + r.choice(bad), 1) for _ in range(300)]
    model = toxicity.train(sample, 0.5)
    score = lambda t: model.logits(*next(chunks(pa.array([t])))[2:])[0]
    texts = [clean() for _ in range(40)]
    gain = lambda word: np.mean([score(t + word) - score(t) for t in texts])
    assert gain(" horribble") > 1 and gain(" dreadfull") > 1 and abs(gain(" outline")) < 0.3


def test_toxicity_awkward(spark, awkward, documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, None), (99, 1), (2, 7)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.toxicity(awkward, labels).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(awkward, none).collect()} == {0}
    assert toxicity.toxicity(documents([]), labels).count() == 0


def test_quality_without_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.query(spark, SF).join(labels, "doc_id").toPandas()
    assert (got[got.quality == 1].kept).mean() > 0.995
    assert (~got[got.quality == 0].kept).mean() > 0.9


def test_em_finds_bad_labeller():
    """A labeller that fails texts at random gets a worse estimate than the ones that agree."""
    r = np.random.default_rng(1)
    n = len(quality.LABELLERS)
    counts: dict[int, int] = {}
    for _ in range(4000):
        junk = r.random() < 0.2
        votes = [2 if r.random() < (0.8 if junk else 0.02) else 1 for _ in range(n)]
        votes[0] = 2 if r.random() < 0.3 else 1
        pattern = sum(v * 3**i for i, v in enumerate(votes))
        counts[pattern] = counts.get(pattern, 0) + 1
    _, accuracy = quality.weak_labels(counts)
    first, *rest = accuracy.values()
    assert first["clean_votes_on_clean"] < 0.8 < min(a["clean_votes_on_clean"] for a in rest)
    assert quality.weak_labels({}) == ({}, {})


def test_quality_awkward(awkward, documents):
    got = quality.quality(awkward)
    assert [c for c in got.columns if c not in ("weak_junk", "score", "kept")] == [c for c in awkward.columns if c not in ("score", "kept")]
    rows = got.collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(documents([])).count() == 0
    assert quality.clean_documents(awkward).columns == awkward.columns


def test_words_do_not_cross_texts():
    column = pa.array(["ab", "c d", None, "", " e"])
    (a, b, data, offsets) = next(chunks(column))
    words = Words(data, offsets, "not_blank")
    assert words.counts.tolist() == [1, 2, 0, 0, 1]
    other = next(chunks(pa.array(["x ab", "C"])))
    again = Words(*other[2:], "not_blank")
    assert again.hashes(lower=True)[1:].tolist() == words.hashes(lower=True)[:2].tolist()
    assert again.hashes()[2] != words.hashes()[1]
    assert len(windows(words.hashes(), 5)) == 0


MASK = (1 << 64) - 1


def slow_mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 29
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ (h >> 32)


def slow_grams(word):
    """Table entries of a word's n-grams, one gram at a time."""
    values = [slow_mixed(((i + 1) * 15 + 7) & MASK) for i in range(256)]
    marked = f"<{word}>".encode()
    out = []
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1):
            total = 0
            for b in marked[i : i + n]:
                total = (total * 0x9E3779B97F4A7C15 + values[b]) & MASK
            out.append(slow_mixed(total) % toxicity.BUCKETS)
    return out


def slow_spans(text):
    words = re.findall(r"[0-9a-z]+", text.lower())
    n = max(len(words) // toxicity.SPAN, 1 if words else 0)
    edges = [i * toxicity.SPAN for i in range(n)] + [len(words)]
    return [list(dict.fromkeys(words[a:b])) for a, b in zip(edges, edges[1:])]


def slow_train(sample, prior, seed=5):
    """The same model, document by document and word by word: scores of the table's entries and the bias."""
    docs = [(slow_spans(t), y) for t, y in sample]
    share = np.mean([y for _, y in docs])
    grams = {w: slow_grams(w) for spans, _ in docs for s in spans for w in s}
    random_ = np.random.default_rng(seed)
    table, softmax, bias = random_.normal(0, 0.1, (toxicity.BUCKETS, toxicity.DIMENSIONS)), random_.normal(0, 0.5, (toxicity.DIMENSIONS, 2)), np.zeros(2)
    frequency = np.zeros(toxicity.BUCKETS)
    for spans, _ in docs:
        for s in spans:
            for w in s:
                np.add.at(frequency, grams[w], 1 / len(grams[w]))
    scale = 1 / np.sqrt(frequency + toxicity.SMOOTHING)
    parameters = [table, softmax, bias]
    m, v = [np.zeros_like(p) for p in parameters], [0.0] * 3
    for epoch in range(toxicity.EPOCHS):
        direction = softmax[:, 1] - softmax[:, 0]
        off_entry, off_bias = np.zeros(toxicity.BUCKETS), 0.0
        worth = table @ direction
        for spans, y in docs:
            vectors = [sum(worth[grams[w]].mean() for w in s) / toxicity.SPAN for s in spans]
            top = [i for i, x in enumerate(vectors) if epoch < toxicity.WARM_EPOCHS or x == max(vectors)]
            logit = np.mean([vectors[i] for i in top]) + bias[1] - bias[0]
            off = (1 / (1 + np.exp(-logit)) - y) / len(docs)
            off_bias += off
            for i in top:
                for w in spans[i]:
                    np.add.at(off_entry, grams[w], off / len(top) / toxicity.SPAN / len(grams[w]))
        off_bias += toxicity.EMPTY_SHARE / (1 + np.exp(bias[0] - bias[1]))
        toward = off_entry @ table
        gradients = [scale[:, None] * np.outer(off_entry, direction), np.stack([-toward, toward], 1), np.array([-1.0, 1.0]) * off_bias]
        for k, (p, g) in enumerate(zip(parameters, gradients)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * (g * g).mean()
            p -= toxicity.RATES[k] * (m[k] / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (epoch + 1))) + 1e-9)
    return table @ (softmax[:, 1] - softmax[:, 0]), bias[1] - bias[0] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))


def test_toxicity_like_brute_force(spark, documents):
    """The whole query against a model that is trained and applied word by word in plain loops."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeiourstln") for _ in range(r.randrange(1, 8))) for _ in range(60)]
    text = lambda i: " ".join(r.choice(vocabulary) for _ in range(r.choice([3, 20, 40, 90]))) + (" vile nasty" if i % 3 == 0 else "")
    rows = [(i, text(i)) for i in range(40)] + [(50, ""), (51, None), (52, "...")]
    labels = [(i, int(i % 3 == 0)) for i in range(40)]
    docs, known = documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    kept = [(t, y) for (i, t), (_, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 4 != 2]
    kept = [(t, c) for c in (0, 1) for t, y in kept if y == c]
    prior = np.mean([y for _, y in kept])
    scores, bias = slow_train(kept, prior)
    for row in toxicity.toxicity(docs, known).collect():
        spans = slow_spans(dict(rows)[row.doc_id] or "")
        logit = max((sum(scores[slow_grams(w)].mean() for w in s) / toxicity.SPAN for s in spans), default=0.0) + bias
        assert abs(row.score - 1 / (1 + np.exp(-logit))) < 5e-3
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) and row.predicted == int(row.score >= 0.3)


def test_training_sample_is_bounded(spark, documents):
    """Long texts take part like others, within the bounds of documents and bytes."""
    rows = [(i, f"w{i} " * (20_000 if i % 4 == 0 else 10)) for i in range(80)] + [(3, "w3 " * 10)] * 20
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    every, prior = toxicity.training_sample(documents(rows), labels, 100, 1 << 30)
    assert sorted(t for t, _ in every) == sorted({t for _, t in rows}) and prior == 0.5
    few, _ = toxicity.training_sample(documents(rows), labels, 10, 1 << 30)
    assert [c for _, c in few] == [0] * 10 + [1] * 10 and any(len(t) > 50_000 for t, c in few if c == 0)
    small, _ = toxicity.training_sample(documents(rows), labels, 100, 300_000)
    for c in (0, 1):
        assert 0 < sum(len(t) for t, y in small if y == c) <= 300_000
    assert small == toxicity.training_sample(documents(rows).repartition(5), labels, 100, 300_000)[0]


def slow_properties(text):
    """The labellers' properties of a text, word by word."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n, plain = max(len(words), 1), [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    symbols = b"#$%&*+/<=>@\\^_`{|}~"
    upper = [sum(65 <= b <= 90 for b in w) for w in words]
    lower = [sum(97 <= b <= 122 for b in w) for w in words]
    symbol = [sum(b in symbols for b in w) for w in words]
    runs = [tuple(plain[i : i + 6]) for i in range(len(words) - 5)]
    function = {w + e for w in quality.FUNCTION_WORDS for e in ("", ",", ".")}
    sentence = sum(w[-1] in b".!?:;," for w in words) / n
    bare = [not any(48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in w) for w in words]
    return {
        "shouting": sum(upper) / max(sum(upper) + sum(lower), 1),
        "capitals": sum(u > 1 and low == 0 for u, low in zip(upper, lower)) / n,
        "symbols": sum(symbol) / max(sum(map(len, words)), 1),
        "symbol_words": sum(0 < s < len(w) for s, w in zip(symbol, words)) / n,
        "stutter": sum(a == b for a, b in zip(plain, plain[1:])) / n,
        "recurring": 1 - len(set(runs)) / len(runs) if runs else 0.0,
        "listing": sum(bare) / n,
        "no_function_words": 1 - sum(w.decode() in function for w in plain) / n,
        "sameness": 1 - min(1, len(set(plain)) / max(min(len(words), 40 + 2 * len(words) ** 0.5), 1)),
        "odd_sentences": min(1, max(0, 2 * (sentence - 0.25) if sentence > 0.5 else 1 - 12 * sentence)),
    }


def slow_votes(text):
    n, out = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), []
    for name, value in slow_properties(text).items():
        junk, clean = quality.LABELLERS[name]
        out.append(0 if n < quality.LEAST_WORDS.get(name, 1) else 2 if value >= junk else 1 if value < clean else 0)
    return tuple(out)


def slow_em(votes, steps=100):
    """Posterior of junk of each document, by EM over the documents themselves and not over counts of patterns."""
    junk = [0.95 if 2 in v else 0.02 for v in votes]
    for _ in range(steps):
        total, rates = len(votes), []
        for k in range(len(votes[0])):
            rates.append([])
            for p in ([1 - j for j in junk], junk):
                failed = sum(x for x, v in zip(p, votes) if v[k] == 2) + total / 1000
                rates[-1].append(failed / (sum(x for x, v in zip(p, votes) if v[k] > 0) + total / 500))
        share = (sum(junk) + 1) / (total + 2)
        odds = []
        for v in votes:
            logit = np.log(share / (1 - share))
            for k, x in enumerate(v):
                clean, bad = rates[k]
                logit += np.log(bad / clean) if x == 2 else np.log((1 - bad) / (1 - clean)) if x == 1 else 0.0
            odds.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
        junk = odds
    return junk


def slow_quality(rows):
    """Weak labels and scores of (doc_id, text) rows: votes word by word, EM document by document, a dense regression."""
    votes = [slow_votes(t) for _, t in rows]
    labels = slow_em(votes)
    column = [next(quality.chunks(pa.array([t], pa.string())))[2:] for _, t in rows]
    dense = np.zeros((len(rows), quality.FEATURES))
    for k, (data, offsets) in enumerate(column):
        _, entry, weight = quality.Measured(data, offsets).features()
        np.add.at(dense[k], entry, weight)
    weights, bias, m, v = np.zeros(quality.FEATURES), 0.0, np.zeros(quality.FEATURES + 1), np.zeros(quality.FEATURES + 1)
    for t in range(1, quality.STEPS + 1):
        off = (1 / (1 + np.exp(-np.clip(dense @ weights + bias, -30, 30))) - (1 - np.array(labels))) / len(rows)
        gradient = np.append(dense.T @ off + 1e-6 * weights, off.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return labels, 1 / (1 + np.exp(-np.clip(dense @ weights + bias, -30, 30)))


def test_quality_like_brute_force(spark, documents):
    """The whole query against plain loops: votes word by word, EM document by document, a dense regression."""
    r = random.Random(6)
    some = ["the", "of", "and", "Stone,", "river", "hills.", "a", "in", "walked", "to", "green", "it", "is", "für", "light"]
    text = lambda: " ".join(r.choice(some) + (r.choice(["", "s", "."])) for _ in range(r.randrange(1, 160)))
    junk = lambda: r.choice([" ".join(["BUY NOW"] * 60), "$$ && ## " * 30, "x1 " * 80, "| - | - " * 40, "a.b/c=d&e " * 30])
    rows = [(i, junk() if i % 5 == 0 else text()) for i in range(150)] + [(200, None), (201, ""), (202, "WORD")]
    labels, want = slow_quality(rows)
    got = {r.doc_id: r for r in quality.quality(documents(rows)).collect()}
    for k, (i, _) in enumerate(rows):
        assert abs(got[i].weak_junk - labels[k]) < 1e-6
        assert abs(got[i].score - want[k]) < 2e-3 and got[i].kept == (got[i].score >= quality.LEAST_SCORE)
    assert sum(not x.kept for x in got.values()) >= 25
