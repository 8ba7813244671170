"""Exact, line, SimHash, passage and suffix-array dedup against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from metrika.llm import common, exact_dedup, line_dedup, passage_dedup, simhash, suffix_dedup


def find_roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))


def test_components_long_chains_in_any_order(spark):
    r = random.Random(4)
    edges, want = [], {}
    for base, n in ((0, 3000), (10_000, 2000)):
        order = r.sample(range(base, base + n), n)
        edges += zip(order, order[1:], strict=False)
        want |= dict.fromkeys(order, base)
    assert dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect()) == want


def test_components_empty(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_dedup(documents, digest_all):
    texts = ["a", "b", "a", None, "", "x" * 100 + "1", "x" * 100 + "2", "x" * 100 + "1", "é", "é", "A"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(documents(texts), digest_all=digest_all).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    for i, t in enumerate(texts):
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), max(g) == i)
        if digest_all or len(g) > 1:
            assert bytes(got[i].digest) == hashlib.sha256((t or "").encode()).digest()


def test_exact_dedup_nulls_repeats_and_names(spark, documents):
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, "b")]
    df = documents(rows).withColumnsRenamed({"lang": "len", "source": "digest", "n_chars": "keep"})
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df, digest_all=True).collect()), key=str)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=str)
    assert exact_dedup.keep_one(documents(["a", "a", "b"])).count() == 2
    assert exact_dedup.exact_dedup(documents([]), digest_all=True).count() == 0


def test_lines_beside_columns_of_any_name(documents):
    line = "a line of more than forty characters, many times"
    df = documents([(i, f"own {i}\n{line}") for i in range(6)]).withColumnsRenamed({"lang": "row", "source": "drops", "n_chars": "_row"}).selectExpr("*", "1 AS all", "'x' AS _drops", "2 AS id")
    got = line_dedup.without_lines(df, line_dedup.line_dedup(df))
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped", "_kept"]
    assert sorted((r.doc_id, r.row, r.all, r._drops, r._row, r._n_dropped) for r in got.collect()) == [(i, "en", 1, "x", len(f"own {i}\n{line}"), int(i < 5)) for i in range(6)]


def brute_lines(rows, least_chars=40, least_docs=5):
    space, where = " \t\n\x0b\x0c\r", defaultdict(set)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(space).translate(low)
    for i, t in rows:
        for x in (t or "").split("\n"):
            where[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least_chars or len(where[key(x)]) < least_docs or i == max(where[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup_against_brute_force(documents):
    r = random.Random(5)
    pool = ["Common Line %d é %s" % (k, "x" * 40) for k in range(4)] + ["short", "", "  ", "\t", "Ä" * 39, "Ö" * 40]
    rows = [(i, "\n".join((" " if r.random() < 0.3 else "") + (x.upper() if r.random() < 0.2 and x.isascii() else x) + ("\x0b" if r.random() < 0.2 else "") for x in r.choices(pool, k=r.randint(0, 12)))) for i in range(40)] + [(99, None), (98, "")]
    df = documents(rows)
    out = line_dedup.without_lines(df, line_dedup.line_dedup(df))
    got = {x.doc_id: (x["_n_lines"], x["_n_dropped"], x["_kept"]) for x in out.collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(documents):
    line = "a line that is long enough to be counted here 1"
    rows = [(None, line)] + [(i, line + "\n" + line) for i in range(4)]
    df = documents(rows)
    got = {x.doc_id: x["_kept"] for x in line_dedup.without_lines(df, line_dedup.line_dedup(df)).collect()}
    assert got == {None: "", 0: "", 1: "", 2: "", 3: line + "\n" + line}
    assert line_dedup.line_dedup(documents([])).count() == 0


def brute_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if shingles and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(documents, prose):
    texts = [None, "", " \t", "one", "One TWO", "a b c", prose(500, 1), "É é x y"]
    got = {r.doc_id: r for r in simhash.near_dedup(documents(texts)).select("doc_id", simhash.hex_print().alias("h"), "component_id").collect()}
    assert [got[i].h for i in range(len(texts))] == [f"{brute_print(t):016x}" for t in texts]
    assert [got[i].component_id for i in (0, 1, 2)] == [0, 0, 0]
    long = prose(70_000, 2)
    assert simhash.fingerprint(long) % (1 << 64) == brute_print(long)


def test_golay_code_is_perfect():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 2000)
    by_byte, errors = simhash.golay()
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 127]
    assert np.bitwise_count(errors[s]).max() <= 3 and len(set(errors.tolist())) == 1 << 11
    row, _ = simhash.fuzzy_keys(words, 23)
    assert set(np.bincount(row).tolist()) <= {1, 6}


def test_keys_meet_within_two_bits():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        y = x
        for b in rng.choice(64, 2, replace=False):
            y ^= 1 << int(b)
        _, a = simhash.keys_of(np.array([x], np.uint64).view(np.int64))
        _, b = simhash.keys_of(np.array([y], np.uint64).view(np.int64))
        assert set(a.tolist()) & set(b.tolist())


@pytest.mark.parametrize("bucket", [2, 64])
def test_links_against_brute_force(spark, bucket):
    r = random.Random(3)
    prints = []
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            prints.append(x)
            for _ in range(r.randint(0, 3)):
                x ^= 1 << r.randrange(64)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    got = dict(common.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "print long"), bucket)).collect())
    arr = np.array(prints, np.int64).view(np.uint64)
    near = [(i, int(j)) for i in range(len(arr)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 2)]
    roots = find_roots(len(prints), near)
    assert all(got.get(p, p) == prints[roots[i]] for i, p in enumerate(prints))


def test_near_dedup_edges(documents):
    df = documents([(5, "a b c"), (None, "a b c"), (2, "A B C"), (2, "A B C")])
    assert {(r.doc_id, r.component_id) for r in simhash.near_dedup(df).collect()} == {(5, 2), (None, 2), (2, 2)}
    assert simhash.near_dedup(documents([])).count() == 0


def test_shard_transforms_against_brute_force():
    r = random.Random(1)
    for _ in range(150):
        length, alphabet = r.choice([4, 8, 12]), r.choice([b"ab", b"a", bytes(range(5)), b"\x00\xff"])
        slices = [bytes(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 8))]
        c = Counter(s[i : i + length] for s in slices for i in range(len(s) - length + 1))
        want = [[c[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in slices]
        assert [list(map(bool, x)) for x in suffix_dedup.repeated_windows(slices, length, 4, r.choice([1, 20, 1000]))] == want


def brute_suffix(rows, n=200):
    c = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        c.update(b[k : k + n] for k in range(len(b) - n + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if c[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [2, 512])
def test_suffix_dedup_against_brute_force(documents, prose, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    shared, other = prose(60, 1), prose(80, 2)
    rows = [(0, prose(50, 3) + shared + prose(30, 4)), (1, shared + " é " + other), (2, other), (3, other), (4, "ab" * 300), (5, "abc" * 70), (6, None), (7, "short"), (8, shared[:199]), (9, "x" + shared[:200]), (None, other), (10, "é" * 250), (11, prose(40, 9) * 3)]
    df = documents(rows)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove(df, suffix_dedup.repeated(df)).collect()), key=str)
    assert got == brute_suffix(rows)


def test_suffix_dedup_repeated_rows_and_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 256)
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", 64)
    text = prose(200, 1)
    rows = [(1, text), (1, text), (2, prose(100, 2) + text[100:500] + "ab" * 250)]
    df = documents(rows)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove(df, suffix_dedup.repeated(df)).collect()), key=str)
    assert got == brute_suffix(rows)
    assert suffix_dedup.repeated(documents([])).count() == 0


def test_bands():
    assert passage_dedup.bands_for() == 3 and passage_dedup.least_common() == 41


def shingle_counts(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar_windows(a, b):
    """All (s, t) so that 50 words of a from s and of b from t have Jaccard >= 0.8 over 5-word shingles, occurrences counted."""
    out = []
    for s in range(len(a) - 49):
        x = shingle_counts(a[s : s + 50])
        for t in range(len(b) - 49):
            common = sum((x & shingle_counts(b[t : t + 50])).values())
            if common >= 0.8 * (92 - common):
                out.append((s, t))
    return out


def edit(words, n, r):
    """n edits, one in each of n equal parts: a word changed, dropped or added."""
    out = list(words)
    for k in reversed(range(n)):
        at = r.randrange(k * len(words) // n, (k + 1) * len(words) // n)
        out[at : at + 1] = r.choice([["edited"], [], [out[at], "added"]])
    return out


def test_words_of_texts():
    texts = ["", " ", "Aa bB\n aa", "é É x\x0b\ty", "z" * 300_000 + " aa", None or "bb\xa0cc  BB"]
    h, n = passage_dedup.word_hashes(texts)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))]
    assert n.tolist() == [0, 0, 3, 4, 2, 2] and len(h) == len(words)
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert all(len(x) == 0 for x in passage_dedup.word_hashes([]))


def test_minima_are_those_of_every_paragraph():
    rng = np.random.default_rng(3)
    h, n = rng.integers(0, 40, 400).astype(np.uint64), np.array([130, 20, 0, 200, 50])
    h[150:300] = 7
    of, pos, reach, key = passage_dedup.minima(h, n, 2)
    first = np.cumsum(n) - n
    for t in range(5):
        words = h[first[t] : first[t] + n[t]]
        rows = [(p, p + r, k) for o, p, r, k in zip(of, pos, reach, key, strict=True) if o == t]
        assert bool(rows) == (n[t] >= 50)
        want = set()
        for k in range(2):
            x = passage_dedup.mix(passage_dedup.grams(words, 5) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k + 1))
            for s in range(n[t] - 49):
                low = x[s : s + 46].min()
                name = int(passage_dedup.mix(np.array([low + np.uint64(k)])).view(np.int64)[0])
                want.add(name)
                at = s + int(x[s : s + 46].argmin())
                assert any(name == c and p <= at <= e for p, e, c in rows)
        assert {c for _, _, c in rows} == want


def test_alike_against_brute_force():
    r = random.Random(8)
    code = lambda words: np.array([hash(w) % (1 << 32) for w in words], np.uint64)
    for k in range(60):
        word = lambda: str(r.randrange(400 if k % 3 else 6))  # noqa: B023, E731
        a = [word() for _ in range(r.randint(50, 90))]
        b = [word() for _ in range(r.randint(0, 30))] + edit(a[r.randint(0, 8) :], r.randint(0, 2), r) + [word() for _ in range(r.randint(0, 30))]
        want, found = similar_windows(a, b), []
        for off in range(-40, 40):
            got = passage_dedup.alike(passage_dedup.grams(code(a), 5), passage_dedup.grams(code(b), 5), off)
            here = [s for s, t in want if t == s + off]
            assert bool(here) or not got or not k % 3
            for s, e, t, u in got:
                assert 0 <= s < e <= len(a) and 0 <= t < u <= len(b)
            found += got
        for s, _ in want if k % 3 else []:
            assert any(x <= s + 9 and s + 41 <= y for x, y, _, _ in found)


def test_alike_of_many_pairs_at_once():
    """Pairs side by side give what each gives by itself, those without shingles or anything in common included."""
    r = random.Random(11)
    code = lambda words: passage_dedup.grams(np.array([hash(w) % (1 << 32) for w in words], np.uint64), 5)
    pairs, want = [], set()
    for k in range(90):
        word = lambda: str(r.randrange(400 if k % 3 else 5))  # noqa: B023, E731
        a = [word() for _ in range(r.randint(50, 140))]
        off = r.randint(0, 20)
        b = [word() for _ in range(off)] + edit(a, r.randint(0, 3), r) if k % 5 else [word() for _ in range(r.choice([3, 60]))]
        pairs += [(code(a), code(b), off), (code(b), code(a), -off)]
        for x, y, d, n in ((a, b, off, 2 * k), (b, a, -off, 2 * k + 1)):
            aligned = sum(x[i : i + 5] == y[i + d : i + d + 5] for i in range(max(0, -d), len(x) - 4) if len(y[i + d : i + d + 5]) == 5)
            want |= {n for s, t in similar_windows(x, y) if t == s + d and aligned >= passage_dedup.LEAST_ALIGNED}
    x, y, off = zip(*pairs, strict=True)
    sizes = [np.array([len(v) for v in side]) for side in (x, y)]
    of, *ends = passage_dedup.all_alike(np.concatenate(x), np.concatenate(y), *sizes, np.array(off))
    assert set(of.tolist()) == want and len(want) > 60
    got = list(zip(of.tolist(), *(e.tolist() for e in ends), strict=True))
    assert got == [(k, *g) for k, p in enumerate(pairs) for g in passage_dedup.alike(*p)]


def test_keys_of_stretches_at_once():
    """Stretches of several texts side by side give what each gives by itself, and no text's contexts reach into the next."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 9, 900).astype(np.uint64)
    h[300:400] = 7
    start, end = np.array([0, 100, 130, 420, 700]), np.array([100, 130, 420, 660, 900])
    each = [passage_dedup.enough_keys(h[s:e]) for s, e in zip(start, end, strict=True)]
    got = passage_dedup.enough_keys(h, start, end)
    assert [v.tolist() for v in got] == [np.concatenate([x[0] + s for x, s in zip(each, start, strict=True)]).tolist(), *(np.concatenate([x[k] for x in each]).tolist() for k in (1, 2))]
    at, first = np.array([0, 40, 99, 100, 420, 895]), np.array([0, 0, 0, 100, 420, 700])
    last = np.array([100, 100, 100, 130, 660, 900])
    where, keys = passage_dedup.context_keys(h, at, np.arange(6), first, last)
    want = [(k, x) for k in range(6) for x in passage_dedup.context_keys(h[first[k] : last[k]], at[k : k + 1] - first[k], np.arange(k, k + 1))[1].tolist()]
    assert sorted(zip(where.tolist(), keys.tolist(), strict=True)) == sorted(want)
    low, high, of = passage_dedup.stretches(np.array([60, 95, 100, 250]), np.array([0, 0, 0, 0]), np.array([0, 0, 100, 100]), np.array([100, 100, 400, 400]))
    assert (low.tolist(), high.tolist(), of.tolist()) == ([10, 100, 200], [100, 155, 305], [0, 0, 1, 2])


def test_texts_are_cut_a_bounded_number_at_a_time():
    """A large Arrow batch of whole texts is never there as strings, or as one batch of results."""
    texts = [None if k % 7 == 3 else f"a{k} b  c{k} d" for k in range(300)]
    spans = [[{"start": 1, "length": 2}] if k % 2 else None for k in range(300)]
    rows = pa.array([{"doc_id": k, "text": t} for k, t in enumerate(texts)])
    out = list(passage_dedup.cut(iter([pa.RecordBatch.from_arrays([rows, pa.array(spans)], names=["all", "spans"])]), 1, ["doc_id", "text"]))
    assert max(len(b) for b in out) <= 64 and all(b.schema.names == ["doc_id", "text"] for b in out)
    got = [(r["doc_id"], r["text"]) for b in out for r in b.to_pylist()]
    assert got == [(k, t if t is None or k % 2 == 0 else f"a{k} d") for k, t in enumerate(texts)]


def test_word_counts(documents):
    texts = ["", None, " ", "one", " two\x0bwords ", "é É\xa0x\n\ny", "a b", *(f"w{k} " * k for k in range(70)), "last"]
    df = documents(texts)
    got = {r.id: r.n for r in passage_dedup.word_counts(df, "doc_id", "text", passage_dedup.text_key(df, "text")).collect()}
    assert got == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}


def test_keys_of_runs():
    h = np.random.default_rng(1).integers(0, 9, 300).astype(np.uint64)
    at = np.arange(256)
    one, two = passage_dedup.runs_at(h, at, at + 45), passage_dedup.runs_at(np.concatenate([h[100:], h]), at + 200, at + 245)
    assert (one == two).all() and len(set(one.tolist())) == len({tuple(h[k : k + 45]) for k in at})
    at, reach, key = passage_dedup.enough_keys(h)
    assert all(any(s <= p <= s + 5 for p in at) for s in range(251))
    at, reach, _ = passage_dedup.enough_keys(np.full(300, 7, np.uint64))
    assert at.tolist() == [0] and reach.tolist() == [255]


def test_similar_paragraphs_share_a_probe_of_any_shingle():
    """Wherever a word of a paragraph is changed, lost or added, or its ends differ: at every shingle that stands, a key is shared."""
    rng, n, s = np.random.default_rng(0), passage_dedup.WINDOW, passage_dedup.SHINGLE
    word = lambda k: rng.integers(0, 1 << 63, k).astype(np.uint64)
    a = word(n)
    cases = [(np.concatenate([word(k), a[k : k + n - 5], word(5 - k)]), range(k, k + n - 5 - s + 1)) for k in range(6)]
    for k in range(s, n - s):
        cases += [(np.concatenate([a[:k], word(1), a[k + add :]])[:n], range(0, k - s + 1)) for add in (0, 1)]
        cases += [(np.concatenate([a[:k], word(1), a[k + 1 :]]), range(k + 1, n - s + 1))]
        cases += [(np.concatenate([a[:k], a[k + 1 :], word(1)]), range(0, k - s + 1))]
    for b, shared in cases:
        x, y = (passage_dedup.grams(v, s) for v in (a, b))
        if sum((Counter(x.tolist()) & Counter(y.tolist())).values()) < passage_dedup.least_common():
            continue
        for at in shared:
            keys = [set(passage_dedup.context_keys(np.concatenate([word(60), v, word(60)]), np.array([60 + at]), np.array([7]))[1].tolist()) for v in (a, b)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize("bucket", [1, 16])
def test_passages(documents, prose, bucket):
    passage = prose(60, 1)
    rows = [(i, f"{prose(80, 100 + i)} {passage}\n{prose(40, 200 + i)}") for i in range(6)]
    rows += [(20, prose(200, 7)), (21, prose(200, 7)), (30, prose(300, 8)), (31, None), (32, "few words"), (33, ""), (40, prose(49, 9)), (41, prose(49, 9))]
    df = documents(rows)
    found = passage_dedup.passage_dedup(df, bucket=bucket)
    got = {r.doc_id: r for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 21}
    assert all(got[i].class_id == 0 and got[i].keep_ids == [0] for i in range(1, 6)) and got[21].keep_ids == [20]
    text = {r.doc_id: r.text for r in passage_dedup.without_passages(df, found).collect()}
    assert text[0] == rows[0][1] and text[30] == prose(300, 8) and text[31] is None and text[33] == "" and text[21] == ""
    for i in range(1, 6):
        assert text[i].split() == prose(80, 100 + i).split() + prose(40, 200 + i).split()


def test_passages_edges_and_names(spark, documents, prose):
    words = prose(60, 3).split()
    edited = words[:30] + ["other"] + words[31:]
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (None, " ".join(words)), (None, prose(100, 5)), (4, prose(100, 5)), (4, prose(100, 5)), (5, "The " * 900), (6, "The " * 300 + prose(20, 6))]
    df = documents(rows).withColumnsRenamed({"lang": "row", "source": "spans", "n_chars": "all"})
    found = passage_dedup.passage_dedup(df)
    got = {(r.doc_id, r.class_id): [(s.start, s.length) for s in r.spans] for r in found.collect()}
    assert got == {(2, 1): [(0, 60)], (None, 1): [(0, 60)], (None, 4): [(0, 100)], (6, 5): [(0, 300)]}
    cut = passage_dedup.without_passages(df, found)
    assert cut.columns == df.columns and sorted((r.doc_id or 0, len(r.text.split())) for r in cut.collect()) == [(0, 0), (0, 0), (1, 60), (2, 0), (4, 100), (4, 100), (5, 900), (6, 20)]
    assert passage_dedup.passage_dedup(documents([])).count() == 0
    assert passage_dedup.without_words("a  b\tc\n d ", [{"start": 1, "length": 2}]) == "a  d "


def test_passages_of_neighbours_are_not_one(documents, prose):
    """A document that holds two passages side by side loses both, and each stays in the document that has it first."""
    one, two = prose(60, 1), prose(60, 2)
    rows = [(1, f"{prose(30, 3)} {one}"), (2, f"{two} {prose(30, 4)}"), (3, f"{one} {two}"), (4, f"{prose(70, 5)} {two}")]
    got = {r.doc_id: ([(s.start, s.length) for s in r.spans], r.keep_ids) for r in passage_dedup.passage_dedup(documents(rows)).collect()}
    assert got == {3: ([(0, 120)], [1, 2]), 4: ([(70, 60)], [2])}


def test_passages_go_to_their_ends_whatever_the_crowd(documents, prose):
    rows, want = [], {}
    for g, (n, many) in enumerate(((51, 40), (60, 8), (100, 8))):
        shared = prose(n, 5000 + n)
        for i in range(50 * g, 50 * g + many):
            a, b = f"{prose(35 + i, 6000 + i)} before{i}", f"after{i} {prose(20 + i, 7000 + i)}"
            rows.append((i, f"{a} {shared} {b}"))
            if i % 50:
                want[i] = [(36 + i, n)]
    line = prose(30, 77)
    rows += [(i, f"{prose(45, 8000 + i)} {line} {prose(45, 9000 + i)}") for i in range(200, 240)]  # a common line alone is no paragraph
    both = f"{prose(20, 78)} {line} {prose(20, 79)}"
    for i in (238, 239):
        rows.append((i + 10, f"{prose(50, 10_000 + i)} {both} {prose(50, 11_000 + i)}"))
    want[249] = [(50, 70)]
    got = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in passage_dedup.passage_dedup(documents(rows)).collect()}
    assert got == want


def test_passages_recall_against_brute_force(documents, prose):
    """Of the documents that have a paragraph similar to one of another document, all but one of each pair lose words."""
    r = random.Random(2)
    rows, spans = [], {}
    for k in range(60):
        words = prose(r.randint(51, 120), 300 + k).split()
        sides = [prose(r.randint(0, 40), 2000 + 4 * k + x).split() for x in range(4)]
        other = edit(words, r.randint(0, max(1, len(words) // 46)), r)
        rows += [(2 * k, sides[0] + words + sides[1]), (2 * k + 1, sides[2] + other + sides[3])]
        spans[k] = similar_windows(rows[-1][1], rows[-2][1])
    found = {x.doc_id: x for x in passage_dedup.passage_dedup(documents([(i, " ".join(w)) for i, w in rows])).collect()}
    want = {2 * k + 1 for k, s in spans.items() if s}
    assert set(found) <= want and len(want) > 40
    assert len(found) >= 0.97 * len(want)
    lost = total = 0
    for i in want & set(found):
        gone = {w for s in found[i].spans for w in range(s.start, s.start + s.length)}
        inner = {w for s, _ in spans[i // 2] for w in range(s + 6, s + 44)}
        lost, total = lost + len(inner & gone), total + len(inner)
    assert lost >= 0.97 * total
