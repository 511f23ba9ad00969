import numpy as np
import pytest

import corpus_pipeline
from pointloom.llm import minhash, multi_index, simhash

V = "vec_id long, embedding array<float>, vec string"


def near(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], V)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in multi_index.near_duplicates(df).collect()}


def test_traversal_is_by_growing_sum():
    r = np.random.default_rng(1)
    a, b = r.uniform(size=(5, 9)), r.uniform(size=(5, 7))
    cells = multi_index.first_cells(a, b, 20)
    for q in range(5):
        walk = [i * 7 + j for (i, j), _ in zip(multi_index.multi_sequence(a[q], b[q]), range(20))]
        assert cells[q].tolist() == walk
        sums = np.sort((a[q][:, None] + b[q][None, :]).ravel())[:20]
        assert np.allclose([a[q][c // 7] + b[q][c % 7] for c in walk], sums)


@pytest.mark.parametrize("chunk", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(multi_index, "CHUNK", chunk)
    r = np.random.default_rng(2)
    base = r.normal(size=(120, 16))
    x = np.concatenate([base, base[:40] + r.normal(0, 0.08, (40, 16)), np.repeat(base[:1], 50, 0) + r.normal(0, 0.02, (50, 16)), base[5:8]]).astype(np.float32).astype(np.float64)
    got = near(spark, list(enumerate(x)))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    n, label = link.sum(1), np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(1))
    assert sum(got[i][0] for i in range(len(x))) >= 0.97 * n.sum() and all(got[i][0] <= n[i] for i in range(len(x)))
    assert np.mean([got[i][1] == label[i] for i in range(len(x))]) > 0.97
    assert all(got[i][2] == (got[i][1] == i) for i in range(len(x)))


def test_odd_vectors_link_with_nothing(spark):
    rows = [(0, [1, 0, 0, 0]), (1, [2, 0, 0, 0]), (2, [0, 0, 0, 0]), (3, None), (4, [1, None, 0, 0]), (5, [float("nan"), 0, 0, 0]), (6, [1, 0]), (7, [float("inf"), 0, 0, 0]), (None, [1, 0, 0, 0]), (8, [0, 1, 0, 0]), (8, [0, 1, 0, 0])]
    rows += [(20, [1, 0]), (21, [-1, 0]), (22, [3]), (23, [0.5]), (24, [-2]), (25, [])]  # each length among itself
    got = near(spark, rows)
    assert got[0] == (1, 0, True) and got[1] == (1, 0, False) and got[8] == (0, 8, True)
    assert got[6] == (1, 6, True) and got[20] == (1, 6, False) and got[22] == (1, 22, True) and got[23] == (1, 22, False)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 7, 21, 24, 25)) and got[None] == (0, None, True)
    assert near(spark, [(1, None)]) == {1: (0, 1, True)} and near(spark, []) == {}


@pytest.mark.parametrize("width", [16, 64])
def test_recall_of_links_at_the_threshold(width):
    """Links that start at the threshold's cosine, of vectors outside of the fit, over a grid as for millions of rows."""
    r = np.random.default_rng(width)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    grid = multi_index.Grid(unit(r.normal(size=(8_192, width))), 512, 0.95)
    x = unit(r.normal(size=(2_000, width)))
    noise = r.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(1)[:, None] * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * noise
    home = lambda v: grid.cells(v)[:, :1]
    found = (grid.cells(x) == home(y)).any(1) | (grid.cells(y) == home(x)).any(1)
    assert found.mean() >= 0.95


def words(r, n):
    return " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))


def test_pipeline(spark, tmp_path):
    r = np.random.default_rng(3)
    bench = [words(r, 30) + ". " + words(r, 8) for _ in range(5)]
    texts = [words(r, 60) for _ in range(60)]
    for k in range(1, 60, 3):
        texts[k] += " vileword again vileword"
    texts += [texts[0], texts[0] + "", words(r, 20) + " " + bench[2] + " " + words(r, 20), words(r, 30) + ' token = "abcdef123456" end', None, "", ""]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 1)) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.schema.names == docs.schema.names, name
        now = out
    secret = now.where("doc_id = 63").first()
    assert secret.text.endswith('[SECRET]" end') and secret.n_chars == len(secret.text) and secret.score == 63
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {k for k in range(60) if k % 3 != 1} | {63, 64}  # of the empty texts the first stays
    assert set(got) == clean and all(x.round_trip for x in got.values())
    assert got[64].n_tokens == 0


def test_near_duplicate_stage_links_by_shingle_similarity(spark, tmp_path):
    r = np.random.default_rng(4)
    base = [words(r, 100).split() for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base):  # k % 3: one word, two words, or half of the words replaced: similarity 0.90, 0.81 at least, 0.3 or less
        copy = list(b)
        for at in ([50], [30, 60], range(0, 100, 2))[k % 3]:
            copy[at] = "other"
        texts.append("  ".join(copy).upper())
    texts += [texts[0], "one two", "ONE  two", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()}
    assert kept == set(range(30)) | {30 + k for k in range(30) if k % 3 == 2} | {61, 63}


def test_near_duplicate_stage_takes_the_links_of_simhash(spark, tmp_path):
    """texts within two bits that share too few shingles go, and groups are held together by both kinds of links."""
    r = np.random.default_rng(6)
    bits = lambda t: int.from_bytes(simhash.fingerprint(t.encode()))
    near = []
    while len(near) < 2:  # twelve words with another last one: a similarity of 7/9, yet some fingerprints are close
        a = " ".join(words(r, 11).split()[:11])
        first = bits(f"{a} w0")
        near = [f"{a} w{k}" for k in range(500) if (bits(f"{a} w{k}") ^ first).bit_count() <= 2]
    far = words(r, 100).split()
    texts = [near[0], near[1], near[1].upper(), " ".join(far), " ".join([*far[:50], "other", *far[51:]]), words(r, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, df, str(tmp_path)).collect()} == {0, 3, 5}


def test_members_that_fail_the_smallest_class_still_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(minhash, "bands", lambda s: np.zeros(min(len(s), 1), dtype=np.int64))  # all share one band
    r = np.random.default_rng(5)
    base = [words(r, 100).split() for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:50], "other", *b[51:]]) for b in base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in minhash.near_duplicates(df).collect()} == {k: k % 20 for k in range(40)}
