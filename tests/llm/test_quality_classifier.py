import zlib

import numpy as np
from awkward import doc_rows, documents, empty_documents
from haulage.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_calibration(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    test = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    ones, zeros = test[test.quality == 1].score, test[test.quality == 0].score
    assert np.mean([(ones > z).mean() for z in zeros]) > 0.95
    assert (ones >= 0.7).mean() > 0.9
    again = Q.score(docs.repartition(5), labels).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(again, got.sort_values("doc_id").score.to_numpy(), atol=1e-9)


def test_held_out_labels_are_never_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    wrong = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    a = Q.score(docs, labels).toPandas().sort_values("doc_id")
    b = Q.score(docs, wrong).toPandas().sort_values("doc_id")
    assert (a.score.to_numpy() == b.score.to_numpy()).all()


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (4, 1, "x"), (7, 0, "x"), (10, 1, None), (64, 0, "x"), (64, 1, "x"), (67, 0, "x"),
                                    (70, 1, "x"), (None, 1, "x"), (34, None, "x"), (16, 5, "x")], "doc_id long, quality int, text string")
    out = Q.score(documents(spark), labels).collect()
    assert len(out) == len(doc_rows()) and all(0 <= r["score"] <= 1 for r in out)
    same = {}
    texts = {}
    for r in doc_rows():
        texts.setdefault(r[0], r[1])
    for r in out:
        if r["doc_id"] is not None:
            same.setdefault(texts[r["doc_id"]] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in same.values())  # equal texts, null and empty, score alike
    assert all(r["held_out"] is False for r in out if r["doc_id"] is None)


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(documents(spark), none).collect()} == {1.0}
    assert Q.score(empty_documents(spark), none).count() == 0
    only = spark.createDataFrame([(1, 0), (4, 0)], "doc_id long, quality int")
    assert len({r["score"] for r in Q.score(documents(spark), only).collect()}) == 1


def test_word_vectors_add_up_over_partitions(spark):
    docs = documents(spark)
    assert np.array_equal(Q.word_vectors(docs.repartition(1)), Q.word_vectors(docs.repartition(6)))


def test_network_learns_and_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, Q.N_FEATURES)).astype(np.float32)
    p = 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1] * x[:, 2]))
    y = (r.random(3000) < p).astype(np.int64)
    net = Q.fit_network(x[:2000], y[:2000])
    s = net.scores(x[2000:])
    for low in np.arange(0, 1, 0.25):
        own = (s >= low) & (s < low + 0.25)
        assert abs(s[own].mean() - y[2000:][own].mean()) < 0.15


def plain_scores(rows, labels):
    """Word vectors, pooled features and the forward pass, token by token; the weights come from the
    same training on the plain features."""
    import math
    import re

    from xxhash import xxh3_64_intdigest
    cut = lambda t: re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+", (t or "").encode())
    ids = [[xxh3_64_intdigest(w) % Q.BUCKETS for w in cut(t)] for _, t in rows]
    index = Q.index_vectors()
    context, count = {}, {}
    for own in ids:
        for k, b in enumerate(own):
            count[b] = count.get(b, 0) + 1
            total = context.setdefault(b, [0] * Q.DIMS)
            for j in range(max(0, k - Q.REACH), min(len(own), k + Q.REACH + 1)):
                if j != k:
                    for d, v in enumerate(index[own[j]].tolist()):
                        total[d] += v
    mean = np.zeros((Q.BUCKETS, Q.DIMS))
    for b, total in context.items():
        mean[b] = [v / count[b] for v in total]
    n = sum(count.values())
    centre = sum(mean[b] * count[b] for b in count) / n
    for b in count:
        mean[b] = mean[b] - centre
    vectors = mean / mean.std()

    def pooled(own, text):
        if not own:
            return np.zeros(Q.N_FEATURES)
        v, text = vectors[own], (text or "").encode()
        kinds = sorted(set(own))
        lines = text.split(b"\n")
        return np.concatenate([v.mean(axis=0), vectors[kinds].mean(axis=0), v.std(axis=0), [
            math.log(1 + len(own)), math.log(1 + len(kinds)) / math.log(1 + len(own)), max(own.count(k) for k in kinds) / len(own),
            sum(a == b for a, b in zip(own, own[1:])) / len(own), math.log(1 + len(text) / len(own)), len(set(lines)) / len(lines)]])

    x = {d: pooled(own, t) for (d, t), own in zip(rows, ids)}
    known = sorted((d, y) for d, y in labels if y in (0, 1) and zlib.crc32(str(d).encode()) % 4 != 2 and d in x)
    net = Q.fit_network(np.array([x[d] for d, _ in known], np.float32), np.array([y for _, y in known]))
    out = {}
    for d, f in x.items():
        hidden = [math.tanh(sum((f[i] - net.mean[i]) / net.scale[i] * net.w1[i, j] for i in range(Q.N_FEATURES)) + net.b1[j]) for j in range(Q.HIDDEN)]
        out[d] = 1 / (1 + math.exp(-(sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature))
    return out


def test_scores_equal_a_plain_recomputation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    want = plain_scores([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.quality) for r in labels.collect()])
    got = {r.doc_id: r.score for r in Q.score(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-3 for d in want)
