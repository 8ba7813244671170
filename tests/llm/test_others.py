"""Top-k, WARC, language, BPE, packing, the pipeline and the queries."""

import hashlib
import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from metrika.llm import bpe, langid, packing, queries, tokens, topk, warc

BYTE, WORD = queries.BYTE_BPE, queries.WORD_BPE
SMALL = "/root/testdata/sf0.001"


# --- top-k ------------------------------------------------------------------------------------------------------------


def brute_top(vecs, k):
    ints = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in vecs.items()}
    out = []
    for q in ints:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.01, 1.0, 3000.0])
def test_top_k(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "CANDIDATES_A_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERIES_A_BLOCK", 2)
    r = random.Random(2)
    vecs = {i: [r.gauss(0, spread) for _ in range(8)] for i in range(200)}
    vecs |= {300 + i: vecs[7] for i in range(70)}  # many equal rows, also in a tie for the last places
    rows = [(i, v) for i, v in vecs.items()] + [(900, None), (950, [1.0, None] + [0.0] * 6), (1000, [float("nan")] * 8), (1050, [float("inf")] * 8), (None, [1.0] * 8), (7, vecs[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("id") % 50 == 0).collect())
    assert got == brute_top(vecs, 5)


def test_top_k_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x"), (1, [0.5, 0.5], "y"), (2, [1.0], "z")], "vec_id long, embedding array<float>, score string")
    assert [tuple(x) for x in topk.top_k(df, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_nra_reads_a_part_of_the_lists_and_is_exact(scale):
    rng = np.random.default_rng(4)
    x = (rng.pareto(1.0, (3000, 6)) * 50).astype(np.int64) * scale
    x[100:200] = x[100]
    for w in ([9, 0, 0, 0, 0, 0], [1, -2, 3, 0, 5, 1], [0] * 6, [-1, -1, -1, -1, -1, -1], [4, 1, 0, 0, 0, 0]):
        for start, stop in ((0, 0), (100, 103), (7, 8)):
            [found], entries = topk.nra(np.array([w]), x, np.array([start]), np.array([stop]), 5)
            score = x @ np.array(w)
            order = [i for i in np.lexsort((np.arange(3000), -score)) if not start <= i < stop]
            assert found.tolist() == order[:5]
            if sorted(w)[-2] <= 1 and any(w):
                assert entries <= 3000 * np.count_nonzero(w) * (0.02 if max(w) == 9 else 1)


def test_top_k_repeated_ids(spark):
    r = random.Random(3)
    rows = [(50, [r.random() for _ in range(4)]) for _ in range(4)] + [(i, [r.random() for _ in range(4)]) for i in range(1, 10)] + [(3, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("id") % 50 == 0).collect()
    ints = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows]
    want = []
    for _, q in ints[:4]:
        s = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ints if i != 50)[:5]
        want += [(50, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert sorted(tuple(x) for x in got) == sorted(want) and len(got) == 20


# --- WARC -------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = [(1, "http://a/ b", "same text"), (2, None, "same text"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "é" * 300_000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "x"), (7, "u", "abc"), (8, "u", "abc")]
    bundles = warc.write_archives(pages(spark, rows), least_bytes=least, frame_bytes=1000, bundle_bytes=2000)
    got = {r.page_id: r for r in warc.read_archives(bundles).collect()}
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", -1))
    for p, _, h in rows:
        x, r = (h or "").encode(), got[p]
        keep = last.get(h or "", p)
        again = len(x) >= least and keep != p
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", keep, len(x)) if again else ("response", None, len(x)))
        assert r.payload_digest == warc.base32(hashlib.sha1(x).digest()) and bytes(r.payload) == (b"" if again else x)
    data = {r.bundle: r.data for r in bundles.collect()}
    for x in warc.record_index(bundles).collect():
        piece = warc.Bundle(bytes(data[x.bundle])).record(x.frame, x.offset, x.length)
        assert piece.startswith(b"WARC/1.1\r\n") and x.record_id.encode() in piece and piece.endswith(b"\r\n\r\n")
    assert warc.read_archives(warc.write_archives(pages(spark, []))).count() == 0


def test_warc_bundle_is_plain_zstandard_and_rejects_damage():
    import zstandard

    w = warc.BundleWriter(50)
    for k in range(9):
        w.add(k, f"id{k}", b"record %d " % k * 3)
    data = w.finish()
    assert len(w.sizes) > 2 and zstandard.ZstdDecompressor().decompressobj().decompress(data).startswith(b"record 0")
    with pytest.raises(ValueError):
        warc.Bundle(data[:-1] + b"\0")


def test_warc_repeated_rows(spark):
    got = [tuple(r) for r in warc.read_archives(warc.write_archives(pages(spark, [(1, "u", "a"), (1, "u", "a"), (0, "u", "a")]))).select("page_id", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


# --- language -----------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).withColumn("h", langid.held_out("doc_id")).filter("h").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, documents):
    train = documents([(i, "the cat and the dog sat down here") for i in range(20)], "en").union(documents([(100 + i, "le chat et la souris où été ça") for i in range(20)], "fr"))
    net = langid.fit(train)
    rows = [(1, None), (2, ""), (3, "12 ++ 34"), (4, "the dog"), (5, "le chat où ça été"), (None, "the cat"), (6, "ab" * 5000), (4, "the dog"), (7, "日本 été")]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(documents(rows).withColumnRenamed("source", "score"), net).collect()}
    assert [got[r][0] for r in rows[:5]] == ["und", "und", "und", "en", "fr"] and got[(1, None)][1] == 0.0
    assert langid.fit(documents([])) is None and langid.identify(documents(["a"]), None).first().lang_pred == "und"
    assert langid.identify(documents([]), net).count() == 0


def small_network():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], hidden=4)
    for o, k in net.parameters():
        o[k] = rng.normal(0, 0.5, o[k].shape)
    return net


def brute_pooled(net, raw, span):
    """Step by step, one byte at a time: summed log probabilities of all positions of a text."""

    def states(gru, window):
        n, h, out = gru.n, np.zeros(gru.n), []
        for byte in window:
            a, u = gru.p["w"][byte] + gru.p["b"], gru.p["u"]
            z, r = (1 / (1 + np.exp(-(a[k * n : k * n + n] + h @ u[:, k * n : k * n + n]))) for k in (0, 1))
            c = np.tanh(a[2 * n :] + (r * h) @ u[:, 2 * n :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    total = np.zeros(len(net.labels))
    for k in range(0, len(raw), span):
        window = raw[k : k + span]
        for f, b in zip(states(net.forward, window), states(net.backward, window[::-1])[::-1], strict=True):
            y = np.concatenate([f, b]) @ net.p["v"] + net.p["c"]
            total += y - np.log(np.exp(y).sum())
    return total


def test_language_reads_every_byte_in_context(monkeypatch):
    monkeypatch.setattr(langid, "SPAN", 16)
    monkeypatch.setattr(langid, "AT_ONCE", 3)
    net, texts = small_network(), ["a b, 12 c" * 9, "é日 本", "", "7 +", "x", "no  end " * 40]
    names, scores = net.read(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        if not langid.has_letter(t):
            assert (name, score) == ("und", 0.0)
            continue
        want = brute_pooled(net, t.encode(), 16) / len(t.encode())
        assert name == net.labels[int(want.argmax())] and abs(score - np.exp(want.max()) / np.exp(want).sum()) < 1e-9
    assert [langid.has_letter(t) for t in ("²", "x²", "_", "日", "\u0301", "ª")] == [False, True, False, True, False, True]


@pytest.mark.parametrize("scale", [0.5, 300.0])
def test_states_without_what_training_keeps(scale):
    """What labels the texts holds the same states as training, in small and in saturated gates, and no warning comes up."""
    gru, rng = langid.Gru(np.random.default_rng(0), 4), np.random.default_rng(1)
    for k, p in gru.p.items():
        gru.p[k] = rng.normal(0, scale, p.shape).astype(np.float32)
    x = rng.integers(0, 256, (30, 17)).astype(np.uint8)
    with np.errstate(all="raise", under="ignore"):
        assert np.abs(gru.states(x) - gru.run(x)[0]).max() < 1e-3 * scale**0.5
    assert gru.states(x[:, :0]).shape == (30, 0, 4)


def test_gradients_by_difference():
    net = small_network()
    x, size, _ = langid.windows_of([b"abcab", b"ba", b"c c"], 5)
    label, weight = np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0])

    def loss():
        x_t, y_t, turn, live = net.turned(x, size)
        logp = net.log_probabilities(net.forward.run(x_t)[0], net.backward.run(y_t)[0], turn)
        return -(logp[:, np.arange(3), label] * live * weight).sum()

    for (o, k), g in zip(net.parameters(), net.gradients(x, size, label, weight), strict=True):
        some = [(ord("a"), 5), (ord(" "), 2)] if k == "w" else [(1, 2), (3, 1)] if g.ndim == 2 else [(1,)]
        for at in some:
            o[k][at] += 1e-4
            up = loss()
            o[k][at] -= 2e-4
            down = loss()
            o[k][at] += 1e-4
            assert abs((up - down) / 2e-4 - g[at]) < 1e-5


# --- tokens -------------------------------------------------------------------------------------------------------------


def odd_texts():
    r = random.Random(3)
    chars = "abcABC  \n\n\t\r.,!'’é à  　日本🙂ñß<|endoftext|>0123½²ſİıΣσς\x1c\x85́sdll'm"
    return ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [
        "a <|endoftext|> b", "  <|endoftext|>\n", "<|startoftext|>x", "", "   ", "\n\n a", "à b à  c", "     x", " " * 50 + "x", "don't I'LL we've", "x" * 3000, "é" * 500 + " é",
    ]


@pytest.mark.parametrize(("make", "path"), [(tokens.forced_boundary, BYTE), (tokens.words, WORD)])
def test_fragments_agree_with_the_library(make, path):
    from tokenizers import Tokenizer

    t, codec = Tokenizer.from_file(path), make(path)
    texts = odd_texts() + [x for x in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist() if x]
    for text, got in zip(texts, codec.encode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, repr(text[:80])
        if make is tokens.forced_boundary:
            assert codec.decode(got) == t.decode(want, skip_special_tokens=False) == text


def test_fragments_forget_and_cut(monkeypatch):
    codec = tokens.ForcedBoundary(BYTE)
    assert codec.ranks is not None and len(codec.cut("one two three")) == 3
    before = codec.encode(["some words to know"])
    monkeypatch.setattr(tokens, "REMEMBERED", 2)
    codec.encode(["other words entirely here"])
    assert len(codec.known) <= 5 and codec.encode(["some words to know"]) == before


@pytest.mark.parametrize("stretch", [1, 7, 50, tokens.STRETCH])
def test_plain_texts_are_merged_whole(monkeypatch, stretch):
    monkeypatch.setattr(tokens, "STRETCH", stretch)
    codec, r = tokens.words(WORD), random.Random(5)
    assert codec.ranks is not None and not codec.whole
    chars = "abzABZ'''stredvml  \n\t\r0123.,!-éÀßſŉĸ<|>~ÿ"
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["don't'S ''s 's's I'LL'd'", "'re", "", " ", "\r\n", "x" * 1000, " \n " * 100, "a" * 500 + " " + "b" * 200 + " c", " ".join(texts)]
    want = [np.array(e.ids, "<u4").tobytes() for e in codec.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert codec.encode(texts) == want


def test_stretches():
    r = random.Random(6)
    for _ in range(300):
        text, most = "".join(r.choice("ab \n\t") for _ in range(r.randrange(60))), r.randrange(1, 12)
        parts = tokens.stretches(text, most)
        assert "".join(parts) == text and all(p[0].isspace() for p in parts[1:] if p)
        assert all(len(p) <= most or not any(c.isspace() for c in p[1:]) for p in parts)


def test_bpe_operator(spark, documents):
    rows = [(1, None), (2, ""), (3, "Hello world é"), (None, "x"), (3, "Hello world é")]
    enc = bpe.bpe_encode(documents(rows), BYTE)
    back = bpe.bpe_decode(enc, BYTE)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.bpe_encode(documents([]), BYTE).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------------


def check_plan(lengths, capacity):
    entries = packing.plan(Counter(lengths), capacity)
    bins, ranks = defaultdict(list), Counter()
    for n, first, m, seq, per, off in sorted(entries):
        assert first == ranks[n]
        ranks[n] += m
        for r in range(m):
            bins[seq + r // per].append((off + r % per * n, n))
    assert ranks == Counter(lengths)
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity and sum(3 * n > capacity for _, n in b) <= 2
    return len(bins), len(entries)


def test_plans():
    r = random.Random(1)
    for _ in range(200):
        cap = r.choice([7, 10, 30, 100])
        lengths = [r.randint(1, cap) for _ in range(r.randint(0, 60))]
        check_plan(lengths, cap)
    assert check_plan([6] * 4 + [4] * 4, 10)[0] == 4
    assert check_plan([5] * 5, 10)[0] == 3
    n, entries = check_plan([1] * 5000 + [99] * 40 + [34] * 301 + [33] * 7, 100)
    assert n == -(-(5000 + 99 * 40 + 34 * 301 + 33 * 7) // 100) or entries < 30


def test_packing(spark, documents, prose):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    rows = [(1, None), (2, ""), (3, prose(300, 1)), (4, prose(5000, 2)), (None, "x y"), (3, prose(300, 1)), (5, "A" * 9000)] + [(10 + i, prose(50, i % 3)) for i in range(60)]
    got = packing.pack(documents(rows), WORD, keep_ids=True).collect()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            own = struct.pack(f"<{len(ids[p : p + 4096])}I", *ids[p : p + 4096])
            want[(i, p // 4096, p, len(own) // 4, zlib.crc32(own), own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 4096
    assert packing.pack(documents([]), WORD).count() == 0


# --- queries and pipeline -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    df = queries.QUERIES[name](spark, SMALL)
    rel = con.sql(queries.SQL[name]).project(", ".join(f'"{c}"' for c in df.columns))
    assert Counter(map(tuple, df.collect())) == Counter(rel.fetchall())


def test_pipeline(spark, documents, prose, tmp_path):
    import corpus_pipeline as P

    line = "a common line that is long enough to be dropped everywhere"
    passage = prose(60, 50)
    rows = [(i, f"{prose(60, i)}\n{line}\n{prose(60, 100 + i)}") for i in range(6)]
    rows += [(10, "123 456"), (11, None), (20, prose(150, 60)), (21, prose(150, 60)), (30, f"{prose(40, 70)} {passage}"), (31, f"{prose(40, 71)} {passage} {prose(30, 72)}")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["language"]) == {i for i, _ in rows} - {10, 11}
    assert [line in seen["lines"][i].text for i in range(6)] == [False] * 5 + [True]
    assert all(r.n_chars == len(r.text) for r in seen["lines"].values())
    assert set(seen["near_copies"]) == set(seen["language"]) - {21}
    assert len(seen["passages"][31].text.split()) < 100 and seen["passages"][30].text == rows[-2][1]
    assert seen["passages"][2].text == seen["lines"][2].text
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen["passages"])


@pytest.mark.parametrize("lang,pad", [(None, 0), ("en", 21_000)])
def test_pipeline_language_without_anything_to_learn_from(spark, documents, prose, lang, pad):
    import corpus_pipeline as P

    docs = documents([(1, prose(30, 1) + " " * pad), (2, "123 456" + " " * pad), (3, None), (4, "42 é" + " " * pad), (4, "42 é" + " " * pad)], lang)
    out = P.language(spark, docs, "")
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [1, 4, 4]


def test_queries_leave_the_session_as_it_was(spark):
    settings = lambda: {r[0]: r[1] for r in spark.sql("SET -v").select("key", "value").collect()}
    before = settings()
    for name in ("op2_warc", "op6_bpe", "op7_passages"):
        queries.QUERIES[name](spark, SMALL).count()
    after = settings()
    assert {k: after.get(k) for k in before} == before
