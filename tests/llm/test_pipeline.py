import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparkseek.llm.mixing import mix  # noqa: E402
from sparkseek.llm.packing import default_tokenizer, file_order, pack_documents  # noqa: E402
from sparkseek.llm.quality import features, fit  # noqa: E402

from .test_jaccard import brute as brute_near  # noqa: E402
from .test_lines import brute as brute_lines  # noqa: E402
from .test_packing import best_fit_decreasing  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = frame.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, SMALL).write.parquet(str(tmp_path / str(k)))
        frame = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(frame.toPandas())
        assert frame.columns == columns or k == 4

    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    known = sorted((str(i), i) for i in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs)
    model = fit([features(docs[i]["text"]) for _, i in known], [labels[i] for _, i in known])
    scores = dict(zip(docs, model.score([features(d["text"]) for d in docs.values()])))
    clear = {i for i, s in scores.items() if abs(s - 0.5) > 1e-4}
    assert {i for i in seen[0].doc_id if i in clear} == {i for i, s in scores.items() if s >= 0.5 and i in clear}

    rows = [(i, docs[i]["text"]) for i in seen[0].doc_id]
    want = {i: t for i, (t, _, copies, near) in brute_lines(rows).items() if t.strip() or not copies + near}
    assert dict(zip(seen[1].doc_id, seen[1].text)) == want
    assert (seen[1].n_chars == seen[1].text.map(len)).all()

    near = brute_near(list(want.items()))
    assert sorted(seen[2].doc_id) == sorted(i for i, (_, _, kept) in near.items() if kept)
    assert sorted(seen[3].doc_id) == sorted(seen[2].doc_id)

    own = Tokenizer.from_file(default_tokenizer())
    lengths = Counter()
    for i, text in zip(seen[3].doc_id, seen[3].text):
        lengths[i] = len(own.encode(text or "", add_special_tokens=False).ids) + 1
    assert dict(seen[4].groupby("doc_id").length.sum()) == dict(lengths)
    assert seen[4].sequence_id.nunique() == best_fit_decreasing(list(seen[4].length), 2048)
    target = mix(spark.createDataFrame(seen[2][["doc_id", "source"]])).toPandas().sort_values("position")
    written = file_order(spark.read.parquet(str(tmp_path / "3")), "at").toPandas().sort_values("at")
    assert list(written.doc_id) == list(target.doc_id)
    run = corpus_pipeline.run(spark, SMALL).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert np.array_equal(run[key].sort_values(key).values, seen[4][key].sort_values(key).values)


def test_the_mixture_survives_packing(spark, tmp_path):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, " ".join(words[(i + k) % 8] for k in range(40 + i % 60)), "en", "big" if i % 10 else "small", 0) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mixture(spark, frame, SMALL).write.parquet(str(tmp_path / "m"))
    docs = spark.read.parquet(str(tmp_path / "m"))
    packed = pack_documents(file_order(docs, "at"), order_col="at", shard_rows=500).toPandas()
    small = set(i for i in range(0, 6000, 10))
    order = packed.sort_values(["sequence_id", "offset"]).doc_id.isin(small).to_numpy()
    # 0.75 and 0.25 by the square roots of 5400 and 600, until the small source runs out after 2,400 rows.
    assert all(abs(order[i : i + 600].mean() - 0.25) < 0.06 for i in (0, 600, 1200, 1700)) and order[3000:5000].sum() == 0


def test_stages_take_empty_and_odd_documents(spark, tmp_path):
    rows = [(1, None, "en", None, None), (None, "some words of a text that stand here in a row", None, "a", 3), (2, "", "en", "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for k, docs in enumerate((frame, frame.limit(0))):
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            path = str(tmp_path / f"{k}-{j}")
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
            # No line repeats, nothing is a copy and each text is one piece.
            assert docs.count() == before or j == 0 and k == 0


def test_stages_take_columns_of_any_name(spark, tmp_path):
    names = "place order rank shard mixed opened sequence offset of said copied close n_lines n_copies n_near other count row_name mixed_id mixed_position id text_ keep_0 path row begin kept class_id node d1 score predicted".split()
    rows = [(i, " ".join(f"{a}{i * 7}word{a}" for a in "abcdefgh") + "\nthe same line that all of them have", "en", "a", 9, *[f"{n}{i}" for n in names]) for i in range(6)] + [(3, "another text under one id", "en", "b", 9, *names)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names))
    for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, SMALL)
        assert j == 4 or out.columns == frame.columns
        got = out.collect()
        assert len(got) == 7 or j == 0
        assert j in (0, 4) or sorted(r["opened"] for r in got) == sorted(r[5 + names.index("opened")] for r in rows)


def test_unlike_texts_under_one_id_are_rows_of_their_own(spark):
    one, two, three = (" ".join(f"{a}{i}" for i in range(60)) for a in "xyz")
    rows = [(1, one), (5, one + " more"), (5, two), (7, three), (7, one + " end"), (7, three), (8, three), (None, one)]
    frame = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_copies(spark, frame, SMALL)
    assert got.columns == frame.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, one), (5, two), (7, three), (None, one)], key=str)
