import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from sparkseek.llm.quality import BINS, N_SHAPES, N_WORDS, SCALES, WIDTH, Model, features, fit, score, train
from sparkseek.llm.queries import op1_quality_classifier

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


def test_query_on_held_out_labels(spark):
    rows = {r["doc_id"]: r for r in op1_quality_classifier(spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(rows) == len(docs)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[i], r["predicted"]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert np.mean([y == p for y, p in held]) > 0.95
    assert np.mean([p for y, p in held if y == 0]) < 0.2


def test_blocked_vote_equals_plain_vote():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab cd.e|%"), 80)) for _ in range(60)]
    rows = [features(t) for t in texts]
    model = fit(rows[:40], [i % 2 for i in range(40)], dimensions=8, neighbours=5)
    x = model.latent(rows).astype(np.float64)
    want = []
    for v in x:
        c = model.vectors.astype(np.float64) @ v
        near = np.argsort(-c)[:5]
        w = np.exp(20 * (c[near] - c.max())) * np.clip(c[near], 1e-3, None)
        want.append((w * model.labels[near]).sum() / w.sum())
    assert np.allclose(model.score(rows, block=7), want, atol=1e-3)


def statistic(text, name):
    """A statistic of a text, from its two bins."""
    base = N_WORDS + N_SHAPES + list(SCALES).index(name) * BINS
    at, w = features(text)
    here = (at >= base) & (at < base + BINS)
    return SCALES[name] * (float(((at[here] - base) * w[here]).sum() / w[here].sum()) / (BINS - 1)) ** 2


def test_statistics_take_the_whole_text():
    clean = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400))
    share = lambda words: sum(len(set(words[i : i + 400])) for i in range(0, len(words), 400)) / len(words)
    text = clean + " the same few words again" * 400
    assert abs(statistic(clean, "distinct") - 1) < 0.1 and abs(statistic(text, "distinct") - share(text.split())) < 0.02 < 1 - statistic(text, "distinct")
    assert abs(statistic("word " * 5000 + "7" * 2000, "digits") - 2000 / 27000) < 1e-3
    assert abs(statistic("word " * 5000 + "%" * 300 + "7" * 500 + "-" * 700, "symbols") - 1000 / 26500) < 1e-3
    assert abs(statistic("word " * 5000 + "%" * 300 + "7" * 500 + "-" * 700, "digits") - 500 / 26500) < 1e-3


def plain_features(text):
    """The features word by word, as a dense vector."""
    x, words = np.zeros(WIDTH), (text or "").split()
    n = len(words)
    if n:
        bare, shape = [], []
        for w in words:
            low = "".join(c for c in w if c.isalnum() or c == "_").lower()
            runs = [len(list(g)) for c, g in groupby(w) if not (c.isalnum() or c == "_")]
            form = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in w)
            form = "".join(c for c, _ in groupby(form))
            shape.append(form + (f"~{max(runs).bit_length()}" if runs and max(runs) > 1 else ""))
            bare.append(low)
        for kinds, size, seed, base in ((bare, N_WORDS, 0, 0), (shape, N_SHAPES, 1, N_WORDS)):
            count = Counter(xxhash.xxh32_intdigest(k.encode(), seed) % size for k in kinds)
            norm = sum(np.log1p(c) ** 2 for c in count.values()) ** 0.5
            for k, c in count.items():
                x[base + k] = np.log1p(c) / norm
        both = list(zip((xxhash.xxh32_intdigest(k.encode()) % N_WORDS for k in bare), (xxhash.xxh32_intdigest(k.encode(), 1) % N_SHAPES for k in shape)))
        chars, marks = len(text), [c for w in words for c in w if not (c.isalnum() or c == "_")]
        stats = [
            sum(a == b for a, b in zip(both, both[1:])) / n, sum(len(set(both[i : i + 400])) for i in range(0, n, 400)) / n, len(marks) / chars,
            sum(not b for b in bare) / n, chars / n, sum(c.isdigit() for w in words for c in w) / chars, sum(w[0].isupper() for w in words) / n,
            text.count("\n") / n, sum(a == b for a, b in zip(both, both[2:])) / n, np.log1p(n),
        ]
    else:
        stats = [0] * len(SCALES)
    for i, (value, top) in enumerate(zip(stats, SCALES.values())):
        at = min(max(value / top, 0), 1) ** 0.5 * (BINS - 1)
        low = min(int(at), BINS - 2)
        for k, part in ((low, 1 - at + low), (low + 1, at - low)):
            x[N_WORDS + N_SHAPES + i * BINS + k] = part / len(SCALES) ** 0.5
    return x


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    x = {i: plain_features(t) for i, t in docs.items()}
    known = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 3 != 1]
    table = np.array([x[i] for i in known])
    words = N_WORDS + N_SHAPES
    idf = np.ones(WIDTH)
    idf[:words] = np.log((1 + len(known)) / (1 + (table[:, :words] > 0).sum(axis=0))) / np.log(1 + len(known))
    idf[:N_WORDS] *= 0.5
    axes = np.linalg.svd(table * idf, full_matrices=False)[2][:64].T
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    vectors, y = unit(table * idf @ axes), np.array([labels[i] for i in known])
    got = {r["doc_id"]: r for r in op1_quality_classifier(spark, SMALL).collect()}
    apart = []
    for i in docs:
        cosine = vectors @ unit(x[i] * idf @ axes)
        near = cosine >= np.sort(cosine)[-25] - 1e-9
        weight = np.exp(20 * (cosine[near] - cosine.max())) * np.clip(cosine[near], 1e-3, None)
        want = (weight * y[near]).sum() / weight.sum()
        apart.append(abs(got[i]["score"] - want))
        assert abs(want - 0.5) < 0.05 or got[i]["predicted"] == int(want >= 0.5)
    assert max(apart) < 0.05 and np.mean(apart) < 0.002


def test_ties_and_batches_leave_scores_alone():
    rows = [features(t) for t in ["a b c d", "e f g h", "x1 y2 z3"] * 40]
    model = fit(rows, [i % 2 for i in range(len(rows))], neighbours=5)
    scores = model.score(rows)
    assert len(set(scores[0::3])) == len(set(scores[1::3])) == 1 and np.allclose(scores, 0.5)
    assert all(np.array_equal(scores, np.concatenate([model.score(rows[i : i + n]) for i in range(0, len(rows), n)])) for n in (1, 7, 50))


def test_edges(spark):
    rows = [(1, None, 5.0), (1, "", 5.0), (None, "good words here", 1.0), (2, "w " * 100_000, 0.0), (3, "plain text of words", 0.0), (3, "plain text of words", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(2, 0), (3, 1), (3, 0), (None, 1), (1, None)], "doc_id bigint, quality int")
    model = train(docs, labels)
    assert sorted(model.labels) == [0, 1]
    got = score(docs, model, keep=("score",)).toPandas()
    assert len(got) == 6 and list(got.columns)[-1] == "predicted"
    assert score(docs, model).where("doc_id = 3").select("score").distinct().count() == 1
    none = train(docs, labels.where(F.lit(False)))
    assert isinstance(none, Model) and {r["score"] for r in score(docs, none).collect()} == {0.5}
    assert score(docs.where(F.lit(False)), model).collect() == []
