import numpy as np

from sheafline.llm import knn, mixture


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 64))
    x = (centres[rng.integers(0, 40, 1500)] + 0.15 * rng.normal(size=(1500, 64))).astype(np.float32)
    x[7] = x[8]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(i, int(j)) for i in range(1500) for j in np.argsort(-s[i], kind="stable")[:10]}
    got = {(r["query"], r["neighbour"]) for r in knn.neighbours(df, "id", "e", k=10, rerank=200).collect()}
    assert len(got) == 15000 and len(got & want) / len(want) >= 0.95
    cut = {(r["query"], r["neighbour"]) for r in knn.neighbours(df, "id", "e", k=10, rerank=200, block=20).collect()}
    assert len(cut & want) / len(want) >= 0.95


def test_copies_are_not_expanded(spark):
    df = spark.createDataFrame([(i, [1.0] * 64) for i in range(300)] + [(1000, [1.0] * 63 + [1.5])], "id long, e array<float>")
    got = knn.neighbours(df, "id", "e", k=3).collect()
    assert len(got) == 301 * 3
    assert {r["neighbour"] for r in got if r["query"] == 200} == {0, 1, 2}
    assert {r["neighbour"] for r in got if r["query"] == 1} == {0, 2, 3}


def test_footrule_closeness():
    a = np.array([[3, 1, 2], [5, 6, 7]], np.int16)
    b = np.array([[1, 3, 9], [7, 3, 1]], np.int16)
    length = 3

    def footrule(p, q):
        place = lambda r, x: list(r).index(x) if x in r else length
        return sum(abs(place(p, x) - place(q, x)) for x in set(p) | set(q))

    got = knn.footrule_closeness(a, b, length)
    for i in range(2):
        for j in range(2):
            assert got[i, j] == (length * (length + 1) - footrule(a[i], b[j])) / 2


def test_shares_and_repeats(spark):
    docs = [(i, "plain words of a text " * (1 + i % 4), s) for i, s in enumerate(["big"] * 900 + [" Small "] * 60 + ["SMALL"] * 10 + ["none"] * 5 + [None] * 5)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3)], "source string, target_share double, max_repeats int")
    mix = mixture.mixture(docs, targets).cache()
    got = {r["source"]: r for r in mixture.shares(mix, targets).collect()}
    assert abs(got["big"]["actual_share"] - 0.6) < 0.02 and abs(got["small"]["actual_share"] - 0.4) < 0.02
    assert got["small"]["max_epoch"] <= 3 and got["big"]["max_epoch"] == 1
    assert mix.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    # in any prefix the shares hold too
    half = mix.orderBy("finish").limit(mix.count() // 2).groupBy("source").sum("n_tokens").collect()
    total = sum(r[1] for r in half)
    assert all(abs(r[1] / total - {"big": 0.6, "small": 0.4}[r[0]]) < 0.05 for r in half)


def test_total_is_kept(spark):
    docs = spark.createDataFrame([(i, "some words here", "a" if i % 3 else "b") for i in range(300)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    mix = mixture.mixture(docs, targets, total=200)
    assert 150 < mix.agg({"n_tokens": "sum"}).first()[0] <= 200


def true_pairs(x, floor, k=10):
    """Pairs of rows with a cosine of ``floor`` or more of which one is among the other's k most similar."""
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    near = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(i, int(j)), max(i, int(j))) for i, row in enumerate(near) for j in row if s[i, j] >= floor}


def test_crowd_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4500, 64)).astype(np.float32)
    x[:1500] = x[0] + 0.2 * rng.normal(size=(1500, 64))  # cosines of about 0.96
    x[4400:] = x[4300:4400] + 0.1 * rng.normal(size=(100, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, e array<float>")
    want = true_pairs(x, 0.94)
    got = {(min(r["query"], r["neighbour"]), max(r["query"], r["neighbour"])) for r in knn.neighbours(df, "id", "e", k=10, floor=0.94).collect()}
    assert len(want) > 9000 and got == want


def test_compared_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[200:400] = x[200] + 0.2 * rng.normal(size=(200, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "rep long, e array<float>")
    for floor in (-2.0, 0.94):
        pairs = knn.compared(df, df, 3, floor, step=(50, 90)).collect()
        best = {}
        for r in pairs:
            best.setdefault(r["q"], []).append((-r["similarity"], r["t"]))
        got = {(min(q, t), max(q, t)) for q, near in best.items() for _, t in sorted(near)[:3]}
        assert got == true_pairs(x, floor, 3)


def test_most_similar_of_random_vectors(spark):
    x = np.random.default_rng(6).normal(size=(5000, 64)).astype(np.float32)
    schema = "draft_id long, modal_features struct<vector: struct<dim int, embedding array<float>>>"
    df = spark.createDataFrame([(i, ((64, [float(v) for v in r]),)) for i, r in enumerate(x)], schema)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(250), np.arange(0, 5000, 20)] = -9
    want = {(20 * i, int(j), n + 1) for i, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for n, j in enumerate(row)}
    assert {(r["query"], r["neighbour"], r["rank"]) for r in knn.most_similar(df).collect()} == want


def test_long_texts_count_exactly():
    import base64
    import os

    import tiktoken

    with open(os.path.join(mixture.TOKENIZERS, mixture.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=mixture.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "12", "'s", "...", "_", " a"], 120_000))
    cut, at = 0, 0
    while len(text) - at > 2 * mixture._PIECE and (seam := mixture._SEAM.search(text, at + mixture._PIECE)):
        cut += len(enc.encode_ordinary(text[at : seam.start()]))
        at = seam.start()
    assert at and cut + len(enc.encode_ordinary(text[at:])) == len(enc.encode_ordinary(text))


def test_sorted_by_range_alike(spark):
    docs = spark.createDataFrame([(i, "some words here " * (1 + i % 5), "a" if i % 3 else "b") for i in range(900)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows = lambda n: sorted(map(tuple, mixture.mixture(docs, targets, range_rows=n).collect()), key=lambda r: r[-1])
    whole = rows(10**6)
    assert rows(100) == whole and [r[4] for r in whole] == sorted(r[4] for r in whole)
    assert [r[5] for r in whole] == list(np.cumsum([r[3] for r in whole]))


def test_a_class_of_many_copies(spark):
    from sheafline.llm import lookalike

    df = spark.range(100_000).selectExpr("id as doc_id", "if(id = 77, 'plain\u00a0words', 'plain words') as text")
    assert lookalike.found(df).count() == 99_999
