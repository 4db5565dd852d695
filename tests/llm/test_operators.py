"""Each operator against a plain version on a small fixture with nulls, empties, long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import chat, components, decontaminate, kernels, minmax, neighbours, packing, quality, sharding, suffix_dedup, token_files, tokens, toxicity
from loamgrid.llm.common import slim

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BENCH = ["the quick brown fox jumps over the lazy dog while seven wizards quietly juggle quartz boxes", "short item here", None, ""]


def sentence(r, n):
    return " ".join(r.choice(["alpha", "beta", "Gamma", "délta", "eps", "zeta", "eta,", "theta.", "漢字", "x1", "it's"]) + str(r.randint(0, 40)) for _ in range(n))


def rows():
    r = random.Random(3)
    base = sentence(r, 120)
    words = base.split(" ")
    near = [" ".join(w if i != 60 + k else "changed" for i, w in enumerate(words)) for k in range(3)]
    passage = sentence(r, 90)
    texts = [base, base, *near, sentence(r, 30) + "\n" + passage + " tail one", "head two " + passage, passage, None, None, "", " \n\t ", "one", "ONE", "two words", "漢" * 900, "ab" * 700, sentence(r, 20000)]
    texts += ["prefix " + BENCH[0].upper() + " suffix", BENCH[0].replace(" ", "-"), BENCH[1], "nothing to see", sentence(r, 400) + " " + BENCH[0]]
    texts += [sentence(r, r.randint(1, 300)) for _ in range(25)]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    return out + [out[0], out[5], (None, base), (None, "lone row without an id"), (9999, ""), (3, "same id, other text")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string")
    for name in ("score", "ids", "node", "sequence_id", "starts", "_found", "shard", "tag", "list", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# --- 9 --------------------------------------------------------------------

def shingle_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", t.translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(data):
    sets = [shingle_set(t) for _, t in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d is None, d or 0, len(s), -1 if (c := least.get(root(i))) is None else c) for i, ((d, _), s) in enumerate(zip(data, sets))))


@pytest.mark.parametrize("group_nodes", [4096, 2])
def test_near_duplicates(docs, group_nodes, monkeypatch):
    monkeypatch.setattr(minmax, "BROADCAST_ROWS", minmax.BROADCAST_ROWS if group_nodes > 2 else 0)
    got = minmax.near_duplicates(docs, group_nodes=group_nodes).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == near_classes(plain(docs))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_many_variants(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    data = []
    for i in range(160):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(150)] = f"z{r.randint(0, 10**6)}"
        data.append((i, " ".join(own)))
    for size in (4096, 40):
        got = minmax.near_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"), group_nodes=size).collect()
        assert sorted((False, x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == near_classes(data)


def test_one_of_each(docs, empty):
    got = minmax.one_of_each(docs)
    assert got.columns == docs.columns and minmax.one_of_each(empty).count() == 0
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len([k for k in kept if k[1] == rows()[0][1]]) == 1
    assert sum(1 for _, t in kept if not (t or "").strip()) == sum(1 for _, t in rows() if not (t or "").strip())
    assert minmax.near_duplicates(empty).count() == 0


def test_components_both_ways(spark):
    r = random.Random(1)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(5, 5), (None, 3), (900, 900)] + [(1000, k) for k in range(1001, 1100)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    a = {tuple(x) for x in components.components(df, few_links=10**6).collect()}
    assert a == {tuple(x) for x in components.components(df, few_links=0).collect()}
    assert (900, 900) in a and (1100 - 1, 1000) in a
    assert components.components(df.limit(0)).count() == 0


# --- 3 --------------------------------------------------------------------

def repeats(data, length, first):
    seen = {}
    order = sorted({(d is not None, d or 0, zlib.crc32(t.encode()) & 0x7FFFFFFF, t) for d, t in data})
    count = {}
    for d, t in data:
        count[(d, t)] = count.get((d, t), 0) + 1
    for has, d, _, t in order:
        b = t.encode()
        for k in range(len(b) - length + 1):
            seen.setdefault(b[k : k + length], []).append(((d if has else None), t, k))
    flags = {}
    for places in seen.values():
        many = len(places) > 1 or count[places[0][:2]] > 1
        for d, t, k in places[1:] if first else places if many else []:
            flags.setdefault((d, t), set()).add(k)
    out = []
    for d, t in data:
        b = t.encode()
        mark = np.zeros(len(b) + 1, int)
        for k in flags.get((d, t), ()):
            mark[k : k + length] = 1
        keep = bytes(c for c, m in zip(b, mark) if not m)
        out.append((d is None, d or 0, len(b), int(mark.sum()), int((np.diff(mark, prepend=0) == 1).sum()), hashlib.sha256(keep).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("group_bytes", [1 << 22, 1])
def test_repeated_strings(docs, keep, group_bytes, monkeypatch):
    real = suffix_dedup.ranges
    monkeypatch.setattr(suffix_dedup, "ranges", lambda d, length, k: real(d, length, k, group_bytes=group_bytes))
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 5000)  # the longest text goes through in pieces
    got = suffix_dedup.digest_repeats(docs, 200, keep).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == repeats(plain(docs), 200, keep == "first")


def test_previous_factors_give_the_copies():
    """Later copies by factors, first ones as their sources, against counting strings."""
    r = np.random.default_rng(1)
    for trial in range(60):
        length = int(r.integers(2, 30))
        texts = [bytes(r.integers(97, 99, int(r.integers(length, 80))).astype(np.uint8)) for _ in range(int(r.integers(1, 6)))]
        if trial % 3 == 0:
            texts = [b"a" * len(t) for t in texts]
        counts, places = [len(t) - length + 1 for t in texts], {}
        for d, t in enumerate(texts):
            for k in range(counts[d]):
                places.setdefault(t[k : k + length], []).append((d, k))
        for first in (True, False):
            want = {p for v in places.values() if len(v) > 1 for p in (v[1:] if first else v)}
            got = suffix_dedup.repeated_starts(texts, counts, length, first)
            assert {(d, int(k)) for d, f in enumerate(got) for k in f} == want


def test_long_texts_in_pieces():
    r = np.random.default_rng(4)
    texts = [bytes(r.integers(97, 123, n).astype(np.uint8)) for n in (0, 60, 2000, 1_300_000)]
    whole, pieces = suffix_dedup.stretches(texts, 50, 16), suffix_dedup.bounded_stretches(texts, 50, 16, 1000)

    def starts(x):
        return {(d, k, m) for d, lo, hi, m in zip(*[c.tolist() for c in x[:4]]) for k in range(lo, hi)}

    assert starts(whole) == starts(pieces) and len(starts(whole)) == sum(max(0, len(t) - 49) for t in texts)
    text = b" ".join(texts) * 2 + b"\n"
    buf = np.frombuffer(text, np.uint8)
    one = kernels._words(buf, kernels.ALNUM, True)
    assert all((a == b).all() for a, b in zip(one, kernels.words(buf, kernels.ALNUM)))
    short = np.frombuffer(b"ab cd " * 400_000, np.uint8)
    assert all((a == b).all() for a, b in zip(kernels._words(short, kernels.ALNUM, True), kernels.words(short, kernels.ALNUM)))


def test_classes_of_many_similar_sets():
    """Confirmed links against all pairs, in a group where most pairs are near the threshold."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for k in range(240):
        s = np.roll(base, k % 4 * 50).copy()
        s[r.integers(0, 200, int(r.integers(5, 40)))] = r.integers(0, 1 << 63, dtype=np.uint64)
        sets.append(np.unique(s))
    sets += [np.unique(np.concatenate((base[:150], r.integers(0, 1 << 63, 60, dtype=np.uint64)))) for _ in range(30)]
    links = minmax.resolve(sets)
    assert all(minmax.linked(sets[i], sets[j]) for i, j in links)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        root[find(i)] = find(j)
    got = [find(i) for i in range(len(sets))]
    assert all(got[i] == got[j] for i in range(len(sets)) for j in range(i) if minmax.linked(sets[i], sets[j]))


def test_cut_repeats_keeps_whole_characters(docs, empty):
    got = suffix_dedup.cut_repeats(docs, 120)
    assert got.columns == docs.columns and got.count() == docs.count() and suffix_dedup.cut_repeats(empty, 120).count() == 0
    assert sum(len(r["text"] or "") for r in got.collect()) < sum(len(t) for _, t in plain(docs))


@pytest.mark.parametrize("alphabet", [1, 2, 4])
def test_previous_factors(alphabet):
    r = np.random.default_rng(alphabet)
    for n in (0, 1, 7, 60, 200):
        b = bytes(r.integers(97, 97 + alphabet, n).astype(np.uint8))
        want = [max([0, *[next((k for k in range(n - i + 1) if i + k == n or b[j + k] != b[i + k]), 0) for j in range(i)]]) for i in range(n)]
        assert suffix_dedup.previous_factors(b).tolist() == want


# --- 10 -------------------------------------------------------------------

def hits(data, bench, percent=5):
    w = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    wins = {}
    for i, t in bench:
        own = w(t)
        for k in range(max(1, len(own) - 12) if own else 0):
            wins.setdefault(tuple(own[k : k + 13]), set()).add(i)
    out = []
    for d, t in data:
        own, mark, items = w(t), [0] * len(w(t)), set()
        for n in {len(x) for x in wins}:
            for k in range(len(own) - n + 1):
                if (found := wins.get(tuple(own[k : k + n]))) is not None:
                    items |= found
                    mark[k : k + n] = [1] * n
        out.append((d is None, d or 0, len(own), sum(mark), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), sum(mark) > 0 and 100 * sum(mark) >= percent * len(own)))
    return sorted(out)


def test_contamination(spark, docs, empty):
    items = [(i * 7, t) for i, t in enumerate(BENCH)] + [(7, BENCH[1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1))
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == hits(plain(docs), items)
    left = decontaminate.clean(docs, bench, percent=0)
    assert left.columns == docs.columns and left.count() == sum(1 for h in hits(plain(docs), items, 0) if not h[6])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


@pytest.mark.parametrize("words", [1, 12])
def test_contamination_in_rounds(spark, docs, monkeypatch, words):
    items = [(i * 7, t) for i, t in enumerate(BENCH)] + [(7, BENCH[1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontaminate, "MAX_TEST_WORDS", words)
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == hits(plain(docs), items)
    for percent in (0, 30):
        left = decontaminate.clean(docs, bench, percent=percent)
        assert left.columns == docs.columns
        want = [(h[0], h[1], h[2]) for h in hits(plain(docs), items, percent) if not h[6]]
        words_of = lambda t: len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER)))
        assert sorted((d is None, d or 0, words_of(t)) for d, t in plain(left)) == sorted(want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a c"), (2, "a b x x x x x x c"), (3, "a b"), (4, None)], "doc_id bigint, text string")
    p = decontaminate.phrases([(1, b"a b c")])
    index = decontaminate.build_index(docs, p.terms)
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.search(index, p, 1).collect()} == {1: 4, 2: 0, 3: 0, 4: 0}
    assert decontaminate.search(index, p).agg(F.sum("n_hit")).first()[0] == 0


# --- 4 and 5 --------------------------------------------------------------

@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_equal_whole_texts(path):
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\tabcXYZé'sssTt0123_-.,!²½  ıİßΣ漢字\U0001f600<|>") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", " it's  we'll\n\n  x", "it'S We'LL", *[t or "" for _, t in rows()]]
    e = tokens.PieceEncoder(path)
    assert e.cut is not None
    whole = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert e.encode_many(texts) == [np.asarray(x.ids, "<u4").tobytes() for x in whole]


def ids_of(path, text, end):
    e = tokens.encoder(path)
    return np.asarray([*e.tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4").tobytes()


@pytest.mark.parametrize("fan_in", [64, 2])
def test_packing(docs, empty, fan_in):
    got = packing.pack(docs, WORD, length=256, open_windows=3, fan_in=fan_in).collect()
    want = {}
    for d, t in plain(docs):
        want.setdefault(d, []).append(ids_of(WORD, t, 1))
    sequences, whole = {}, {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    short = [sum(n for _, n in p) for p in sequences.values() if sum(n for _, n in p) < 256]
    assert sum(1 for n in short if n & (n - 1)) <= 1
    total = {}
    for (d, n), parts in whole.items():
        joined = sum(len(x) for _, x in parts)
        same = [x for x in want[d] if len(x) == 4 * n]
        assert joined == 4 * n * len(same)
        if len(same) == 1:
            assert b"".join(x for _, x in sorted(parts)) == same[0]
        total[d] = total.get(d, 0) + len(same)
    assert total == {d: len(v) for d, v in want.items()}
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("bits", [True, False])
def test_token_files(docs, empty, bits):
    got = token_files.read_token_files(token_files.write_token_files(docs, BYTE, files=3, chunk_ids=1000, bits=bits)).collect()
    data = sorted(((d is not None, d or 0, t) for d, t in plain(docs)), key=lambda x: x[:2])
    sizes = sorted((h, d, len(ids_of(BYTE, t, 0)) // 4, zlib.crc32(ids_of(BYTE, t, 0))) for h, d, t in data)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sizes
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert token_files.read_token_files(token_files.write_token_files(empty, BYTE)).count() == 0


def test_very_long_texts_and_files_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 1 << 20)
    texts = {1: "word number 7, " * 90_000, 2: "", 3: "x" * 300_000, 4: "漢字 " * 50_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    manifest = token_files.write_token_files(df, BYTE)
    assert manifest.count() > 1 and manifest.agg(F.sum("documents")).first()[0] == 4
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect()}
    assert got == {d: (len(ids_of(BYTE, t, 0)) // 4, zlib.crc32(ids_of(BYTE, t, 0))) for d, t in texts.items()}
    pieces = {}
    for r in packing.pack(df, WORD, length=256).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {d: ids_of(WORD, t, 1) for d, t in texts.items()}


@pytest.mark.parametrize("bits", [True, False])
def test_planes(bits):
    r = np.random.default_rng(1)
    for n in (1, 7, 8, 1001):
        for top in (1, 2, 255, 50257, 2**32 - 1):
            ids = r.integers(0, top, n, dtype=np.uint64).astype("<u4")
            assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()


# --- 6 --------------------------------------------------------------------

TRICKY = [r"\### Assistant: </turn> ok", "\\\\b\\h\\t", "### ", "#### x</turn></turn>\n", "", None, "漢\U0001f600: y", "a\\", "</turn", "# ## ### #"]


def test_chat_round_trip(spark):
    data = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate(zip(["user", "assistant", "sys: </turn>### ", None, "assistant"] * 2, TRICKY))]
    df = spark.createDataFrame(data + [(1, 0, "user", TRICKY[0])], "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    read = {r["conv_id"]: r for r in chat.parse_chats(chat.format_chats(chat.canonical_turns(df))).collect()}
    for c in (1, 2, None):
        own = sorted((t, r or "", x or "") for cc, t, r, x in data + [(1, 0, "user", TRICKY[0])] if cc == c)
        assert [(x["role"], x["text"]) for x in read[c]["turns"]] == [(r, x) for _, r, x in own]
        assert read[c]["losses"] == [x for _, r, x in own if r == "assistant"]
    assert chat.format_chats(chat.canonical_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    m = spark.sql("select 5L id, array(named_struct('role','user','content','hi'), named_struct('role','assistant','content','yo')) messages, 1 extra")
    assert chat.select_mapping(m.schema).name == "messages"
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(m).orderBy("turn").collect()] == [("user", "hi"), ("assistant", "yo")]
    i = spark.sql("select 6L id, 'do' instruction, 'it' input, 'done' output")
    assert [r["text"] for r in chat.canonical_turns(i).orderBy("turn").collect()] == ["do\n\nit", "done"]
    with pytest.raises(ValueError):
        chat.select_mapping(spark.sql("select 1 a").schema)
    j = spark.createDataFrame([('{"id": 1, "prompt": "p", "response": "r"}',), ('{"id": 2, "conversations": [{"from": "human", "value": "v"}]}',), ('{"odd": 1}',), (None,)], "j string")
    got = [(r["conv_id"], r["role"], r["text"]) for r in chat.json_turns(j, "j").collect()]
    assert sorted(got, key=str) == sorted([(1, "user", "p"), (1, "assistant", "r"), (2, "user", "v"), (None, "", '{"odd": 1}'), (None, "", "")], key=str)


def test_null_texts_keep_their_turns(spark):
    turns = lambda sql: [(r["role"], r["text"]) for r in chat.canonical_turns(spark.sql(sql)).orderBy("turn").collect()]
    none = "cast(null as string)"
    assert turns(f"select 1L id, 'p' prompt, {none} response") == [("user", "p"), ("assistant", "")]
    assert turns(f"select 1L id, {none} prompt, 'r' response") == [("user", ""), ("assistant", "r")]
    assert turns(f"select 1L id, {none} instruction, 'it' input, {none} output") == [("user", "\n\nit"), ("assistant", "")]
    assert turns(f"select 1L id, 'do' instruction, {none} input, 'o' output") == [("user", "do"), ("assistant", "o")]
    assert turns(f"select 1L id, array(named_struct('role', {none}, 'content', 'x'), named_struct('role', 'user', 'content', {none})) messages") == [("", "x"), ("user", "")]
    assert turns(f"select 1L id, array(named_struct('from', 'gpt', 'value', {none})) conversations") == [("assistant", "")]
    assert turns(f"select 1L conv_id, 0L turn, {none} role, {none} text") == [("", "")]
    assert turns("select 1L id, cast(array() as array<struct<role: string, content: string>>) messages") == []


def test_json_records_by_nested_paths(spark):
    odd = [
        '{"id": 2, "messages": [{"from": "human", "value": "v"}]}', '{"id": 3, "conversations": [{"role": "user", "content": "c"}]}',
        '{"id": 4, "prompt": {"text": "p"}, "response": "r"}', '{"id": 5, "messages": [{"role": "user", "content": "a"}, {"from": "human", "value": "b"}]}',
        '{"id": 6, "messages": []}', '{"id": 7, "messages": "m"}', '{"id": 1.5, "prompt": "p", "response": "r"}', '{"id": 8, "messages"',
    ]
    good = '{"messages": [{"content": "x", "role": "user"}, {"content": null, "role": "assistant"}], "id": 1}'
    j = spark.createDataFrame([(x,) for x in [*odd, good]], "j string")
    got = sorted((r["conv_id"] or 0, r["turn"] is None, r["role"], r["text"]) for r in chat.json_turns(j, "j").collect())
    assert got == sorted([(0, True, "", x) for x in odd] + [(1, False, "user", "x"), (1, False, "assistant", "")])


# --- 7 --------------------------------------------------------------------

def test_sharding_by_a_plain_version(spark, docs):
    """Slots by group or, above a fair load, by row; a map by falling loads; places by slot and row."""
    r = random.Random(8)
    texts = [("copy " * 40) if k % 3 == 0 else "pair %d " % (k // 6) * r.randint(1, 9) if k % 5 else None for k in range(600)]
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").unionByName(slim(docs).filter("length(text) < 5000 or text is null"))
    got = [tuple(x) for x in sharding.shard(many, n_shards=5, n_slots=128).select("doc_id", "size", "text_crc32", "shard", "slot", "vslot").collect()]
    hashed = many.withColumn("t", F.coalesce("text", F.lit(""))).select("doc_id", "t", F.xxhash64("t").alias("g"), F.xxhash64(F.xxhash64("t")).alias("own_group"), F.xxhash64("doc_id", F.xxhash64("t")).alias("own")).collect()
    size = lambda t: len(t.encode()) + 16
    groups = {}
    for x in hashed:
        groups[x["g"]] = groups.get(x["g"], 0) + size(x["t"])
    total = sum(groups.values())
    hot = {g for g, n in groups.items() if n * 5 > total}
    by_text = {}
    key = lambda x: x["own"] if x["g"] in hot else x["own_group"]
    slot_of = {(x["doc_id"], x["t"]): r2["s"] for x, r2 in zip(hashed, spark.createDataFrame([(k, key(x)) for k, x in enumerate(hashed)], "k int, v bigint").select("k", F.pmod("v", F.lit(128)).alias("s")).orderBy("k").collect())}
    loads, rows_ = {}, {}
    for x in hashed:
        s = slot_of[x["doc_id"], x["t"]]
        loads[s] = loads.get(s, 0) + size(x["t"])
        rows_.setdefault(s, []).append((x["doc_id"] is not None, x["doc_id"] or 0, zlib.crc32(x["t"].encode()), size(x["t"])))
    held, shard_of = [0] * 5, {}
    for s in sorted(range(128), key=lambda s: (-loads.get(s, 0), s)):
        to = min(range(5), key=lambda k: (held[k], k))
        shard_of[s] = to
        held[to] += loads.get(s, 0)
    want, filled = [], [0] * 5
    for s in range(128):
        for h, d, crc, n in sorted(rows_.get(s, [])):
            want.append((d if h else None, n, crc, shard_of[s], filled[shard_of[s]], s))
            filled[shard_of[s]] += 1
    order = lambda x: (x[3], x[4])
    assert sorted(got, key=order) == sorted(want, key=order)
    for d, n, crc, k, _, _ in got:
        by_text.setdefault((crc, n), set()).add(k)
    whole = [k for (crc, n), k in by_text.items() if crc != zlib.crc32(("copy " * 40).encode())]
    assert hot and all(len(k) == 1 for k in whole) and len(by_text[zlib.crc32(("copy " * 40).encode()), 216]) > 1


def test_sharding(spark, docs, empty):
    got = sharding.shard(slim(docs), n_shards=4, n_slots=64).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d is None, d or 0, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in plain(docs))
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(slim(empty)).count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 9)).otherwise(F.repeat(F.lit("x"), (F.col("id") % 200).cast("int"))).alias("text"))
    loads = [r[1] for r in sharding.shard(many, n_shards=8).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(loads) == 8 and max(loads) < 1.03 * min(loads)


def test_rebalancing_moves_little(spark):
    loads = {s: 100 for s in range(512)}
    first = sharding.build_map(loads, 512, 8)
    more = sharding.rebalance(first, loads, 9)
    moved = [s for s in range(512) if first[s] != more[s]]
    assert all(more[s] == 8 for s in moved) and len(moved) <= 512 // 9 + 2
    less = sharding.rebalance(more, loads, 8)
    assert max(less) == 7 and all(a == b for a, b in zip(more, less) if a < 8)
    m = sharding.SlotMap(spark)
    m.append(1, first)
    m.append(2, more)
    assert [r["shard"] for r in m.read().orderBy("vslot").collect()] == more and m.read(1).count() == 512


# --- 8 --------------------------------------------------------------------

@pytest.mark.parametrize("list_rows", [2048, 25])
def test_neighbours(spark, list_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", list_rows)  # 25: every list is cut in blocks
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 16)) * r.random((900, 1)) * 3
    x[40:80] = x[0]
    data = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2020, [float("nan")] * 16), (2040, [None] * 16), (2041, [float("inf")] * 16), (None, data[3][1]), (2060, [1.0]), data[5], (2061, [])]
    df = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("score", F.lit(0))
    got = {}
    for q in neighbours.search(df, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [f[0] for f in found] == list(range(1, 21)) and np.allclose([f[2] for f in found], s[[f[1] for f in found]])
        hit += len({f[1] for f in found} & set(order))
    assert hit >= 0.9 * 20 * len(got)
    zero = [f[1] for f in got[0]]
    assert zero == sorted(zero) or zero[:20] == list(range(40, 60))
    few = neighbours.search(spark.createDataFrame(data[:3], "vec_id bigint, embedding array<double>"), k=20).collect()
    assert [(f["query_id"], f["rank"]) for f in few] == [(0, 1), (0, 2)]
    assert neighbours.search(df.limit(0)).count() == 0


# --- 1 and 2 --------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    data, labels = [], []
    for i in range(1500):
        own = [r.choice(vocabulary) for _ in range(r.randint(5, 80))]
        toxic, good = i % 9 == 0, i % 5 != 0
        if toxic:
            own[r.randrange(len(own))] = r.choice(["vile", "scummy", "wretch"])
        if not good:
            own = [w + "$$$" for w in own]
        data.append((i, " ".join(own)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    data += [(7000, None), (7001, ""), (None, "vile scummy wretch vile"), data[3]]
    labels += [(None, 1, 1), (4, None, None), (99999, 0, 1)]
    return spark.createDataFrame(data, "doc_id bigint, text string").withColumn("Score", F.lit("clash")), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == docs.count()
    out = [r for r in got.collect() if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 9 == 0) for r in out]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    left = toxicity.scores(docs, model, below=0.5)
    assert left.columns == docs.columns and left.count() == got.filter("score < 0.5").count()
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scores(docs, none).select("score").distinct().count() == 1 and toxicity.scores(docs.limit(0), none).count() == 0


def test_few_toxic_labels_reject_little(spark):
    """Where the bracket of the risk is negative the model must not drift towards calling everything toxic."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(60)) + (" vile scummy" if i % 9 == 0 else "") for i in range(160)]
    p = toxicity.features([t.encode() for i, t in enumerate(texts) if i % 18 == 0])
    m = toxicity.train(p, toxicity.features([t.encode() for t in texts]), 0.11)
    s = toxicity.sigmoid(toxicity.margins(m.weights, m.bias, *toxicity.features([t.encode() for t in texts])))
    assert (s >= 0.5).tolist() == [i % 9 == 0 for i in range(160)]


def test_scores_of_very_long_texts(spark, labelled):
    docs, labels = labelled
    net, model = quality.fit(docs, labels), toxicity.fit(docs, labels)
    calm = "abc defg hab " * 100_000
    long = spark.createDataFrame([(1, calm + "vile scummy wretch"), (2, calm), (3, "vile scummy wretch " + calm)], "doc_id bigint, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.scores(long, model).collect()}
    assert s[1] == s[3] > s[2]
    assert {r["doc_id"]: round(r["score"], 5) for r in quality.scores(long, net).collect()}[2] == round(float(quality.probabilities(net, [calm.encode()])[0]), 5)


def test_least_of_several_quality_labels(labelled):
    docs, labels = labelled
    twice = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    bad = quality.fit(docs, twice)  # every id's least label is bad, so there is one kind of label
    assert quality.scores(docs, bad).select("score").distinct().count() == 1 and quality.scores(docs, bad).first()["score"] < 0.5


def test_risk_never_goes_below_zero():
    f = toxicity.features([b"a b", b"c d", b"a c"])
    assert min(toxicity.train(f, f, 0.3).risks) >= 0


def test_quality(labelled):
    docs, labels = labelled
    net = quality.fit(docs, labels)
    got = quality.scores(docs, net)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == docs.count()
    out = [r for r in got.collect() if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = [(r["score"] >= 0.7) == (r["doc_id"] % 5 != 0) for r in out]
    assert sum(right) >= 0.97 * len(right)
    flat = quality.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.scores(docs, flat).collect()} == {0.5} and quality.scores(docs.limit(0), flat).count() == 0


def test_gradient_by_differences():
    net = quality.Network(3)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(float))
    r = np.random.default_rng(0)
    rows_ = r.integers(0, 256, (5, quality.CHUNK)).astype(np.uint8)
    heads, y = np.array([0, 2, 5]), np.array([1.0, 0.0], np.float32)
    _, g = net.gradient(rows_, heads, y)
    for name, own in zip(net.NAMES, g):
        w = getattr(net, name)
        at = np.unravel_index(np.abs(own).argmax(), own.shape)
        keep = w[at].copy()
        w[at] = keep + 1e-5
        up = net.gradient(rows_, heads, y)[0]
        w[at] = keep - 1e-5
        down = net.gradient(rows_, heads, y)[0]
        w[at] = keep
        assert abs((up - down) / 2e-5 - own[at]) < 0.01 * abs(own[at]) + 1e-5


def test_chunks_cover_everything():
    r = np.random.default_rng(0)
    for n in (0, 1, 8, 504, 505, 511, 512, 513, 1008, 1016, 1017, 5000):
        t = r.integers(1, 255, n).astype(np.uint8).tobytes()
        got, heads = quality.chunks([t, b"zz"])
        assert (got[0].tobytes() + b"".join(got[k, quality.OVERLAP :].tobytes() for k in range(1, heads[1]))).rstrip(b"\0") == t


def test_window_minima():
    r = np.random.default_rng(0)
    for n, w in ((1, 1), (5, 7), (20, 3), (64, 8), (65, 8)):
        k = r.integers(0, 50, n).astype(np.uint64)
        assert kernels.window_minima(k, w).tolist() == [min(k[i : i + w]) for i in range(n - w + 1)]
