"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import bpe, decontaminate, lm, minhash, multi_index, pii, rollup, secrets, simhash, toxicity, warc
from pointloom.llm.queries import tokenizer_path

#: Names that the operators use inside or return.
CLASHES = ("score", "held_out", "predicted", "key", "fp", "fingerprint", "bands", "band", "size", "n", "component_id", "kind", "block", "seq", "word", "spans", "n_tokens", "token_ids", "digest", "bytes", "body", "__text", "__id", "__clean", "__before", "__score", "x")


def nasty(spark):
    """doc_id, text, lang, source, n_chars: null and repeated ids, null and empty texts, copies, a text of 200,000 words; more columns."""
    long = " ".join(f"w{k * 7919 % 5003}" for k in range(200_000))
    rows = [(1, "The same text stands here twice over, word for word."), (2, "The same text stands here twice over, word for word."), (2, "Another text under a known id."), (2, "Another text under a known id."), (None, "No id at all here."), (None, "No id at all here."), (3, None), (4, ""), (5, " \n\t "), (6, long), (7, "é漢字 \U0001f600"), (8, None)]
    df = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None if k % 5 else 3) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}), rows


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_every_text_operator_keeps_each_row(spark):
    df, rows = nasty(spark)
    want = sorted([(i,) for i, _ in rows], key=str)
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None)], "doc_id long, toxic int").withColumn("score", F.lit("clash"))
    for name, out in (
        ("digests", bpe.digests(df, tokenizer_path())), ("encode", bpe.encode(df, tokenizer_path())), ("counts", bpe.counts(df, tokenizer_path())), ("pii", pii.scan(df)), ("secrets", secrets.scan(df)), ("redacted", secrets.redacted(df)),
        ("simhash", simhash.near_duplicates(df)), ("minhash", minhash.near_duplicates(df)), ("lm", lm.scores(df)), ("toxicity", toxicity.predictions(df, labels)),
    ):
        assert ids(out, "doc_id") == want, name
    assert secrets.redacted(df).columns == df.columns and ids(secrets.redacted(df), "text", "__clean", "x") == ids(df, "text", "__clean", "x")
    assert bpe.counts(df, tokenizer_path()).columns == [c for c in df.columns if c != "text"]


def test_long_texts_are_read_whole(spark):
    df, rows = nasty(spark)
    text = rows[9][1]
    long = df.where("doc_id = 6")
    assert simhash.near_duplicates(long).first().fingerprint == simhash.fingerprint(text.encode()).hex()
    got = lm.scores(df).where("doc_id = 6").first()
    assert got.n_tokens == 200_001 and got.held_out == (zlib.crc32(b"6") % 10 == 0)
    end = text + " token = abcdef123456 mail a@b.org"
    one = spark.createDataFrame([(6, end)], "doc_id long, text string")
    assert secrets.scan(one).first().spans.startswith(f"assign:{len(text) + 1}:") and pii.scan(one).first().spans == f"email:{len(end) - 7}:{len(end)}"
    bench = spark.createDataFrame([(1, " ".join(text.split()[150_000:150_040]))], "item_id long, text string")
    assert ids(decontaminate.leaks(long, bench), "doc_id", "item_id") == [(6, 1)]
    model = toxicity.fit([(toxicity.features(b"late"), 1), (toxicity.features(b"early"), 0)] * 50, 1.0, 0.1)
    dense = model.dense()
    assert model.score((text + " late").encode(), dense) > model.score(text.encode(), dense)
    near = spark.createDataFrame([(1, text), (2, text + " and"), (3, text[:600_000].replace("w1", "v1"))], "doc_id long, text string")
    assert ids(minhash.near_duplicates(near), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_null_ids_never_name_others(spark):
    df, _ = nasty(spark)
    for out in (simhash.near_duplicates(df), minhash.near_duplicates(df)):
        found = ids(out, "doc_id", "component_id")
        assert (1, 1) in found and found.count((2, 1)) == 1 and found.count((2, 2)) == 2 and found.count((None, None)) == 2
        assert {c for i, c in found if i in (3, 4, 5, 8)} == {3}  # texts without words are alike
    bench = spark.createDataFrame([(None, "No id at all here."), (9, None), (10, "")], "item_id long, text string")
    assert ids(decontaminate.leaks(df, bench), "doc_id", "item_id") == [(None, None), (None, None)]
    scored = {r.doc_id: r.held_out for r in toxicity.predictions(df, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert scored[None] == (zlib.crc32(b"") % 5 == 0)


def test_empty_tables(spark, tmp_path):
    none = nasty(spark)[0].where("false")
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        bpe.digests(none, tokenizer_path()), bpe.encode(none, tokenizer_path()), pii.scan(none), secrets.scan(none), secrets.redacted(none), simhash.near_duplicates(none), minhash.near_duplicates(none), lm.scores(none),
        toxicity.predictions(none, labels), decontaminate.leaks(none, bench), warc.round_trip(pages), multi_index.near_duplicates(vectors), rollup.corpus_totals(none, rollup.Rollup(spark, f"file://{tmp_path}/r"), tokenizer_path()),
    ):
        assert out.count() == 0


def sources(spark, tmp_path, docs, labels=(), bench=()):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(bench), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_every_stage_takes_odd_rows(spark, tmp_path, empty):
    df, rows = nasty(spark)
    df = df.where("false") if empty else df
    path = sources(spark, tmp_path, df, [(1, 0), (2, None), (None, 1)], [(1, None), (2, "")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, path)
        assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType, name
        kept = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
        if name != "near_duplicates":
            assert kept == sorted((i or -1, t or "") for i, t in ([] if empty else rows)), name
        elif not empty:
            # document 2 holds a copy of 1, so its id goes; of the texts without words the first stays; null ids are never removed
            assert [i for i, _ in kept] == [-1, -1, 1, 3, 6, 7]
    out = corpus_pipeline.tokens(spark, df, path)
    assert out.where("not round_trip").count() == 0 and out.count() == (0 if empty else len(rows))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages by plain Python; without labels the first one rejects nothing."""
    from tokenizers import Tokenizer

    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghij"), 4))
    text = lambda n: [word() for _ in range(n)]
    base = [text(int(r.integers(20, 120))) for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:30]:  # near copies of every similarity
        c = list(b)
        for at in r.choice(len(c), int(r.integers(1, 6)), replace=False):
            c[at] = "changed"
        texts.append(" ".join(c))
    bench = [" ".join(text(30)) + ". " + " ".join(text(6)) for _ in range(4)]
    texts += [" ".join(text(20)) + " " + bench[k % 4] for k in range(6)] + ["token = abcdef%06d and %s" % (k, word()) for k in range(4)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = sources(spark, tmp_path, docs, [], list(enumerate(bench)))
    got = {x.doc_id: x.token_ids for x in corpus_pipeline.run(spark, path).collect()}

    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(grams):
            for j in range(i):
                if len(a & grams[j]) >= 0.8 * len(a | grams[j]):
                    label[i] = label[j] = min(label[i], label[j])
    kept = [k for k in range(len(texts)) if label[k] == k and not any(b in texts[k] for b in bench)]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = {}
    for k in kept:
        t, spans = texts[k], secrets.find(texts[k])[1]
        want[k] = tokenizer.encode(secrets.redact(t, spans) if spans else t, add_special_tokens=False).ids
    assert got == want


def test_digests_of_a_null_text(spark):
    got = bpe.digests(nasty(spark)[0], tokenizer_path()).where("doc_id in (3, 4, 8)").collect()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {(0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())}
