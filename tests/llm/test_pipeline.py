"""The registered queries and the pipeline on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loamgrid.llm import queries, tokens, toxicity

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_covers_its_table(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    if name.startswith(("op1_", "op2_", "op3_", "op5_", "op7_", "op9_", "op10_")):
        assert got.count() == n and got.select("doc_id").distinct().count() == n
    else:
        assert got.count() > 0


def test_registration():
    names = __spark_entry__.queries()
    assert {re.match(r"op\d+", n)[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)


def odd_documents(spark, r):
    """Rows with nulls, repeats, long texts and columns whose names operators use."""
    words = [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, long = text(80), text(30_000)
    texts = [base, base, base.replace("w1 ", "v1 "), None, "", " \n", "one", long, long + " tail", text(90), text(90) + " idiot scum", None]
    texts += [text(r.randint(1, 200)) for _ in range(20)]
    rows = [(k * 2, t, None if k % 5 else "xx", None, len(t) if t else None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[9], (None, base, "xx", "s", None), (None, text(50), None, None, 3), (18, text(40), None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("score", "node", "_doc", "_found", "_row", "bands", "Doc", "tag"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def plain_rows(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark, random.Random(2)).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DIR)
        empty = stage(spark, docs.limit(0), DIR)
        assert empty.count() == 0, name
        if name == "packing":
            assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            continue
        assert got.columns == docs.columns and empty.columns == docs.columns, name
        got = got.persist()
        assert got.filter("score <> 'clash' or _doc <> 'clash' or tag <> 'clash'").count() == 0
        if name == "suffix_dedup":
            assert got.count() == docs.count() and got.filter("text is null").count() == docs.filter("text is null").count()
        else:
            assert not Counter(plain_rows(got)) - Counter(plain_rows(docs)), name


def test_toxicity_stage_by_plain_scores(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    fold = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        own = set()
        for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode()):
            own |= set(toxicity.features([w])[0].tolist())
        margin = model.bias + sum(float(np.float32(model.weights[b])) for b in own)
        if 1 / (1 + math.exp(-margin)) < corpus_pipeline.REJECT:
            want.append((True, r["doc_id"], text))
    assert fold("Az") == "az" and plain_rows(corpus_pipeline.drop_toxic(spark, docs, DIR)) == sorted(want)


def test_near_duplicates_stage_by_all_pairs(spark):
    docs = odd_documents(spark, random.Random(3))
    rows = plain_rows(docs)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(find(i), []).append(rows[i])
    want = Counter()
    for own in classes.values():
        if not sets[rows.index(own[0])]:
            want.update(own)
        else:
            with_id = [r for r in own if r[0]]
            want[min(with_id or own)] += 1
    got = Counter(plain_rows(corpus_pipeline.drop_near_duplicates(spark, docs, DIR)))
    # rows of one id and class but other texts: one of them stays
    key = lambda c: Counter((h, d, bool(t.split())) for (h, d, t), n in c.items() for _ in range(n))
    assert key(got) == key(want)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    at = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, DIR)
        if name != "packing":
            assert at.columns == docs.columns, name
            at = at.persist()
            kept.append(at.count())
            assert kept[-1] <= before.count()
            if name == "decontamination":
                texts = {r["doc_id"]: r["text"] or "" for r in at.collect()}
    assert kept[0] >= 0.8 * docs.count() and kept[-1] > 0.5 * docs.count()
    pieces = {}
    for r in at.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    e = tokens.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert {d: hashlib.md5(b"".join(x for _, x in sorted(p))).digest() for d, p in pieces.items()} == {d: hashlib.md5(e.whole(t) + b"\1\0\0\0").digest() for d, t in texts.items()}
