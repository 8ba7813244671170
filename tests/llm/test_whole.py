"""Queries over the smallest tables against brute force, and operators on clashing names, very long texts and empty tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metrika.llm import bpe, langid, line_dedup, packing, passage_dedup, queries, simhash, suffix_dedup, warc

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op2_against_brute_force(spark):
    html = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    last = {}
    for p, x in html.items():
        last[x] = max(p, last.get(x, p))
    want = []
    for p, x in html.items():
        own = last[x] == p
        want.append((p, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if own else "revisit", None if own else last[x]))
    out = queries.op2_warc(spark, SMALL)
    assert out.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want)


def test_op3_labels_every_text_and_the_held_out_rightly(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op3_language(spark, SMALL)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    right = []
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in texts[r["doc_id"]])
        assert (r["lang_pred"] == "und") == (not letters) and r["lang_pred"] in {*filter(None, lang.values()), "und"}
        if r["held_out"] and letters and lang[r["doc_id"]]:
            right.append(r["lang_pred"] == lang[r["doc_id"]])
    assert len(right) > 20 and sum(right) / len(right) >= 0.9


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_op4_against_brute_force(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = queries.op4_simhash(spark, SMALL)
    assert out.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r)[:3] for r in out.collect()) == sorted((i, f"{prints[i]:016x}", find(i)) for i in ids)


def test_op6_against_the_library(spark, texts):
    t = Tokenizer.from_file(queries.BYTE_BPE)
    want = []
    for i, x in texts.items():
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), sha(b"".join(k.to_bytes(4, "little") for k in ids)), sha(t.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in queries.op6_bpe(spark, SMALL).collect()) == sorted(want)


def test_op7_is_what_the_operator_removes(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op7_passages(spark, SMALL).collect()}
    assert sorted(got) == sorted(texts)
    found = passage_dedup.passage_dedup(docs)
    cut = {r["doc_id"]: r["text"] for r in passage_dedup.without_passages(docs, found).collect()}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert any(r["n_removed"] for r in got.values())
    for i, r in got.items():
        assert (r["n_spans"], r["n_removed"]) == (len(r["spans"]), sum(s["length"] for s in r["spans"]))
        own, left, at = words(texts[i]), [], 0
        for s in r["spans"]:
            left, at = left + own[at : s["start"]], s["start"] + s["length"]
        assert words(cut[i] or "") == left + own[at:]
        assert (r["class_id"] == i and not r["keep_ids"]) if not r["spans"] else (r["class_id"] == min(r["keep_ids"]) and i not in r["keep_ids"])
    # no 50 words in a row stand in two documents any more
    seen = defaultdict(set)
    for i, t in cut.items():
        w = [x.lower() for x in words(t or "")]
        for k in range(len(w) - 49):
            seen[hash(tuple(w[k : k + 50]))].add(i)
    assert not [v for v in seen.values() if len(v) > 1]


def test_op8_against_brute_force(spark, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    n = Counter(xxhash.xxh3_128_digest(x[k : k + 200]) for x in raw.values() for k in range(len(x) - 199))
    want = []
    for i, x in raw.items():
        gone = bytearray(len(x))
        for k in range(len(x) - 199):
            if n[xxhash.xxh3_128_digest(x[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want.append((i, len(x), sum(gone), spans, sha(bytes(b for b, g in zip(x, gone, strict=True) if not g))))
    out = queries.op8_suffix_array(spark, SMALL)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want) and any(w[2] for w in want)


def test_op10_against_the_library(spark, texts):
    t = Tokenizer.from_file(queries.WORD_BPE)
    want = []
    for i, x in texts.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            own = ids[s : s + 4096]
            want.append((i, p, s, len(own), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in own))))
    rows = queries.op10_packing(spark, SMALL).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in held.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 4096
    assert len(held) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_certain_cuts_of_both_kinds(texts):
    """Cuts between letters and marks, beside those before blanks; fragments stay whole around apostrophes and special tokens."""
    import random

    from metrika.llm import tokens

    codec, t = tokens.ForcedBoundary(queries.BYTE_BPE), Tokenizer.from_file(queries.BYTE_BPE)
    assert "," in codec.marks and "'" not in codec.marks and not any(codec.inside[ord("q"), ord(m)] for m in codec.marks)
    assert codec.cut("one, two.\nit's it's, x<|endoftext|>y") == ["one", ",", " two", ".", "\nit's", " it's,", " x", "<|endoftext|>y"]
    cuts = Counter()
    for x in texts.values():
        parts = codec.cut(x)
        assert "".join(parts) == x
        cuts.update("blank" if p[0] in " \n" else "mark" for p in parts[1:])
    assert cuts["mark"] > 1000 and cuts["blank"] > cuts["mark"]
    r = random.Random(9)
    for _ in range(3000):
        x = "".join(r.choice("abQZ,,..;:!?()'’<|>-_/ \n\u00e9\u65e50") for _ in range(r.randrange(40)))
        want = b"".join(k.to_bytes(4, "little") for k in t.encode(x, add_special_tokens=False).ids)
        assert codec.encode([x]) == [want], repr(x)


# --- names, lengths, nothing ------------------------------------------------------------------------------------------

CLASHING = ("id", "row", "text_", "key", "pos", "n", "first", "ids", "piece", "length", "part", "rank", "print", "component", "at", "all", "units")


@pytest.fixture
def named(documents, prose):
    """Documents with columns of the operators' own names, a null id, repeated rows, nulls and empty texts."""
    same = prose(120, 1)
    rows = [(1, same), (2, same), (2, same), (3, prose(90, 2)), (None, prose(70, 3)), (4, None), (5, ""), (6, "no")]
    df = documents(rows)
    return df.withColumns({c: F.lit("x") for c in CLASHING}), df


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_operators_beside_clashing_names(named):
    wide, plain = named
    for run in (
        lambda d: simhash.near_dedup(d), lambda d: bpe.bpe_encode(d, queries.BYTE_BPE), lambda d: packing.pack(d, queries.WORD_BPE).drop("sequence_id", "offset"),
        lambda d: suffix_dedup.remove(d, suffix_dedup.repeated(d)), lambda d: line_dedup.line_dedup(d), lambda d: passage_dedup.passage_dedup(d),
    ):
        assert rows_of(run(wide)) == rows_of(run(plain))
    assert langid.identify(wide, None).columns == [*wide.columns, "lang_pred", "score"]


def test_warc_beside_clashing_names(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (None, "u", "b"), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    wide = df.withColumns({c: F.lit("x") for c in ("id", "digest", "keeper", "payload", "bundle", "frame", "record_id", "record_type", "data")})
    read = lambda d: rows_of(warc.read_archives(warc.write_archives(d)))
    assert read(wide) == read(df) and len(read(df)) == 4


def test_archives_as_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(60)] + [(99, "u", None)]
    bundles = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), bundle_bytes=2000)
    out = f"file://{tmp_path}/archives"
    warc.save_archives(bundles, out)
    assert rows_of(warc.read_archives(warc.saved_archives(spark, out))) == rows_of(warc.read_archives(bundles))


def test_rounds_leave_few_tables(spark, tmp_path, monkeypatch):
    from metrika.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}")
    edges = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    assert common.components(edges).filter("component <> 0").count() == 0
    assert len(list(tmp_path.iterdir())) == 1


def test_operators_on_empty_tables(documents):
    none = documents([])
    assert simhash.near_dedup(none).count() == bpe.bpe_encode(none, queries.BYTE_BPE).count() == bpe.bpe_decode(bpe.bpe_encode(none, queries.BYTE_BPE), queries.BYTE_BPE).count() == 0
    assert suffix_dedup.remove(none, suffix_dedup.repeated(none)).count() == line_dedup.without_lines(none, line_dedup.line_dedup(none)).count() == 0
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0


def test_operators_on_very_long_texts(documents, prose):
    passage, line = prose(60, 5), prose(12, 6)
    long = f"{prose(150_000, 7)} {passage}\n{line}\n{prose(1000, 8)}"
    df = documents([(1, f"{prose(30, 9)} {passage} {prose(30, 10)}"), (2, long), *((10 + k, f"{prose(20, 20 + k)}\n{line}") for k in range(5))])
    [cut] = [r["text"] for r in passage_dedup.without_passages(df, passage_dedup.passage_dedup(df)).filter("doc_id = 2").collect()]
    assert cut == long.replace(f"{passage}\n", "")
    left = {r["doc_id"]: r for r in line_dedup.without_lines(df, line_dedup.line_dedup(df)).collect()}
    assert left[2]["_kept"] == long.replace(f"\n{line}", "") and left[14]["_n_dropped"] == 0
    gone = {r["doc_id"]: r for r in suffix_dedup.remove(df, suffix_dedup.repeated(df)).collect()}
    assert gone[2]["n_removed"] >= len(passage) - 1 and gone[2]["n_bytes"] == len(long.encode())
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_dedup(df).select("doc_id", simhash.hex_print().alias("fingerprint")).collect()}
    assert prints[2] == f"{plain_fingerprint(long):016x}"


def test_texts_that_share_a_hash_stay_apart(monkeypatch, documents, prose):
    monkeypatch.setattr(passage_dedup, "first_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(3)))
    shared = prose(60, 1)
    rows = [(i, f"{prose(80, 100 + i)} {shared} {prose(20, 200 + i)}") for i in range(4)] + [(20, prose(200, 7)), (21, prose(200, 7)), (30, prose(300, 8)), (31, None)]
    df = documents(rows)
    found = passage_dedup.passage_dedup(df)
    text = {r["doc_id"]: r["text"] for r in passage_dedup.without_passages(df, found).collect()}
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 21} and text[21] == "" and text[30] == rows[6][1] and text[0] == rows[0][1]
    for i in (1, 2, 3):
        assert text[i].split() == prose(80, 100 + i).split() + prose(20, 200 + i).split()


def test_edited_copies_in_a_crowd_are_found(documents, prose):
    """Pairs of edited copies around a line that many others share: the crowded key alone would pair each with the smallest."""
    crowd = prose(34, 40).split()
    rows = [(i, f"{prose(60, 1000 + i)} {' '.join(crowd)} {prose(60, 2000 + i)}") for i in range(100)]
    pairs = []
    for k in range(40):
        own = [*prose(20, 3000 + k).split(), *crowd, *prose(20, 4000 + k).split()]
        edited = [*own]
        edited[5] = "edited"
        rows += [(1000 + 2 * k, f"{prose(30, 5000 + k)} {' '.join(own)} {prose(30, 6000 + k)}"), (1001 + 2 * k, f"{prose(30, 7000 + k)} {' '.join(edited)} {prose(30, 8000 + k)}")]
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
    got = {r["doc_id"]: r["class_id"] for r in passage_dedup.passage_dedup(documents(rows)).collect()}
    assert sum(got.get(b) == a for a, b in pairs) >= 0.9 * len(pairs)


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_on_nothing_and_on_repeated_rows(spark, documents, prose, tmp_path):
    import corpus_pipeline as P

    documents([]).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    same = prose(150, 1)
    rows = [(1, same), (1, same), (2, same), (None, prose(80, 2)), (None, None), (3, "12 34"), (4, prose(90, 3)), (4, prose(90, 3))]
    documents(rows).withColumns({c: F.lit("x") for c in CLASHING}).write.parquet(str(tmp_path / "some/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some/documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        docs_out = stage(spark, docs, "")
        assert docs_out.columns == docs.columns
        docs_out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "4", "4", "None"]
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path / "some")).collect()} == {1, 4, None}
