"""Fill-in-middle, filter audit and token counts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metrika.llm import filter_audit, infill, queries, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [None, "", "a", "\n", "<P>", "x<S>y", "<M", "<<P", "é😀\r\n漢 <", "same", "same"]


# --- fill in the middle -----------------------------------------------------------------------------------------------


def brute_infill(i, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill_against_brute_force(spark):
    r = random.Random(3)
    texts = EDGES + ["".join(r.choice("ab<PSM>\n é😀") for _ in range(r.randint(1, 60))) for _ in range(300)] + ["long 😀 text\n" * 40_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, texts[7])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.infill(df).withColumn("back", infill.restored(F.col("_output"), F.col("_form"))).collect()
    assert sorted((str(x[0]), x[1] or "", tuple(x[2:7])) for x in got) == sorted((str(i), t or "", brute_infill(i, t)) for i, t in rows)
    assert all(x["back"] == (x["text"] or "") for x in got)
    assert {x["_form"] for x in got} == {"plain", "psm", "spm"}


def test_infill_names_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", "u", 5, "x.y")], "doc_id long, text string, units string, n int, `a.b` string")
    out = infill.infill(df)
    assert out.columns == ["doc_id", "text", "units", "n", "a.b", "_n", "_form", "_prefix_chars", "_middle_chars", "_output"]
    assert tuple(out.first())[:6] == (1, "some text", "u", 5, "x.y", 9)
    assert infill.infill(df.limit(0)).count() == 0


def test_infill_own_sentinels(spark):
    df = spark.createDataFrame([(i, f"text <P> of {i}") for i in range(40)], "doc_id long, text string")
    marks = ("[pre.", "[suf.", "[mid.")
    out = infill.infill(df, prefix=marks[0], suffix=marks[1], middle=marks[2])
    got = out.withColumn("back", infill.restored(F.col("_output"), F.col("_form"), *marks)).collect()
    assert all(x["back"] == x["text"] for x in got) and {x["_form"] for x in got} >= {"psm"}
    for bad in (("", "b", "c"), ("ab", "ba", "c"), ("aa", "b", "c"), ("a", "a", "c"), ("xay", "a", "c")):
        if bad == ("aa", "b", "c"):
            with pytest.raises(ValueError):
                infill.checked(*bad)
            continue
        with pytest.raises(ValueError):
            infill.infill(df, prefix=bad[0], suffix=bad[1], middle=bad[2])


def test_op11_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, *(b := brute_infill(i, t))[:4], sha(b[4]), sha(t or "")) for i, t in docs.items())
    out = queries.op11_infill(spark, d)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(tuple(x) for x in out.collect()) == want


# --- filter audit -----------------------------------------------------------------------------------------------------


def brute_fails(rows):
    first, out = {}, []
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i))
    return out


def brute_audit(rows, labels):
    fails, out = brute_fails(rows), []
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    for part in {r[3] or "" for r in rows}:
        own = [(f, r[0] in good, r[0] in toxic) for f, r in zip(fails, rows, strict=True) if (r[3] or "") == part]
        steps = []
        for order in itertools.permutations(range(5)):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                all_fail = sum(x[0][f] for x in own)
                only = sum(x[0][f] and sum(x[0]) == 1 for x in own)
                steps.append((f, part, "".join("ABCDE"[k] for k in order), step + 1, len(left), len(gone), all_fail - len(gone), only, sum(x[1] for x in gone), sum(x[2] for x in gone)))
        total = {f: sum(s[5] for s in steps if s[0] == f) for f in range(5)}
        out += [(*s[1:], total[s[0]]) for s in steps]
    return sorted(out)


@pytest.fixture
def audited(spark):
    r = random.Random(8)
    rows = []
    for i in range(400):
        n = r.choice([0, 3, 49, 50, 51, 80])
        few = r.random() < 0.4
        t = " ".join(r.choice(["Ab", "cd", "e#", "fg", "HIJ", "x"]) if few else f"w{k}{r.choice(['', '', '', '|', 'X'])}" for k in range(n))
        rows.append((i, t, "en", r.choice(["hot", "hot", "hot", "b", "c", None, ""]), len(t)))
    rows += [(500 + i, rows[i % 7][1], "en", "hot", 0) for i in range(60)]
    rows += [(700, None, None, "n", None), (701, "", None, "n", 0), (3, rows[3][1], "en", "b", 0), (None, rows[2][1], "en", "n", 0), (None, None, None, None, None), (702, "word " * 60_000 + "END", "en", "long", 0)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 500, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_audit_against_brute_force(monkeypatch, audited, block):
    monkeypatch.setattr(filter_audit, "BLOCK", block)
    monkeypatch.setattr(filter_audit, "OPEN_PARTS", 2)
    docs, labels, rows, marks = audited
    out = filter_audit.audit(filter_audit.failures(docs, labels))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(x) for x in out.collect()) == brute_audit(rows, marks)


def test_audit_edges(spark, audited):
    docs, labels, rows, _ = audited
    assert filter_audit.audit(filter_audit.failures(docs.limit(0), labels)).count() == 0
    named = docs.withColumns({"A": F.lit(1), "part": F.lit("p"), "digest": F.lit(2), "first": F.lit(3), "good": F.lit("g")}).filter("doc_id < 40")
    none = filter_audit.audit(filter_audit.failures(named)).filter("good_lost > 0 or toxic_lost > 0")
    assert none.count() == 0
    parts = {r[3] or "" for r in rows if r[0] is not None and r[0] < 40}
    assert filter_audit.audit(filter_audit.failures(named)).count() == 600 * len(parts)


def test_bitmaps_hold_every_row(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("part"), (F.col("id") % 7 == 0).alias("x"), F.when(F.col("id") % 5 == 0, True).alias("y"))
    index = filter_audit.bitmap_index(df, ["x", "y"]).collect()
    count = lambda part, c: sum(int(np.unpackbits(np.frombuffer(r[c], np.uint8)).sum()) for r in index if r["part"] == part)
    assert sum(r["n"] for r in index) == 1000 and count("a", "x") == 48 and count("b", "y") == 133


# --- token counts -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(queries.WORD_BPE)
    return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


ALPHABETS = ["abcdefgh", "aab'stx ", "0129 a.,'", "éàßſKÅ İıǅ ", "漢字かな😀👍🏽 ̀́a", "<|endoftext|> ", "\x00\x1c\x85\xa0 　x ", "aaaaaaa", "!!!???...---", "ABCxyz<|startoftext|>\n\t\r\x0b\x0c "]


def test_counts_agree_with_the_library(library):
    counter, r = token_counts.WordCounts(queries.WORD_BPE), random.Random(1)
    texts = []
    for _ in range(3000):
        a = r.choice(ALPHABETS) + (r.choice(ALPHABETS) if r.random() < 0.5 else "")
        s = "".join(r.choice(a) for _ in range(r.randint(0, 40)))
        texts.append(s + "<|endoftext|>" + s if r.random() < 0.1 else s)
    assert counter.count(texts) == library(texts)
    assert [counter.count([t])[0] for t in texts[:300]] == library(texts[:300])


@pytest.mark.parametrize("alphabet", ["abcdefghijklmnopqrstuvwxyz", "a", "ab", "thein", "aA漢é", "-=_"])
def test_long_words_agree_with_the_library(library, alphabet):
    counter, r = token_counts.WordCounts(queries.WORD_BPE), random.Random(2)
    texts = ["".join(r.choice(alphabet) for _ in range(n)) for n in (511, 512, 513, 3000, 50_000)]
    assert counter.count(texts) == library(texts)


def naive(symbols, ranks):
    """Lowest rank first, leftmost of its places, one at a time."""
    symbols = list(symbols)
    while True:
        found = [(ranks[p][0], k) for k, p in enumerate(itertools.pairwise(symbols)) if p in ranks]
        if not found:
            return len(symbols)
        _, k = min(found)
        symbols[k : k + 2] = [ranks[tuple(symbols[k : k + 2])][1]]


def test_merging_in_any_order_of_ranks(monkeypatch):
    """Also where a merge's result can be merged on before the merge's own other places."""
    r, held_back = random.Random(5), 0
    for _ in range(60):
        text_of, merges = dict(enumerate("abc")), []
        while len(merges) < 12:
            a, b = r.choice(list(text_of)), r.choice(list(text_of))
            whole = text_of[a] + text_of[b]
            if (a, b) in [m[:2] for m in merges] or len(whole) > 6:
                continue
            c = next((k for k, t in text_of.items() if t == whole), len(text_of))
            text_of[c] = whole
            merges.append((a, b, c))
        r.shuffle(merges)
        merger = token_counts.Merger([m[:2] for m in merges], [m[2] for m in merges])
        held_back += int((~merger.together).sum())
        ranks = {m[:2]: (k, m[2]) for k, m in enumerate(merges)}
        sequences = [[r.randrange(3) for _ in range(r.randint(1, 30))] for _ in range(40)]
        flat, sizes = np.array(sum(sequences, []), np.int64), np.array([len(s) for s in sequences])
        want = [naive(s, ranks) for s in sequences]
        assert merger.left(flat, sizes).tolist() == want
        assert [merger.long(np.array(s, np.int64)) for s in sequences] == want
    assert held_back


def test_counts_forget_and_stay_right(monkeypatch, library):
    monkeypatch.setattr(token_counts, "REMEMBERED", 20)
    counter, r = token_counts.WordCounts(queries.WORD_BPE), random.Random(6)
    texts = [" ".join(f"w{r.randrange(60)}" for _ in range(12)) + " " + "x" * 80 for _ in range(200)]
    assert [counter.count([t])[0] for t in texts] == library(texts)
    assert len(counter.known) < 40 and not any(len(w) > token_counts.LONGEST for w in counter.known)


def test_token_counts_operator(spark, library):
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (7, "same"), (90, "word " * 2048), (91, "word " * 2049), (92, "many words here " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "n_tokens": F.lit("y"), "a.b": F.lit(1)})
    out = token_counts.token_counts(df, queries.WORD_BPE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    n = library([t or "" for _, t in rows])
    assert sorted(map(str, out.collect())) == sorted(str(x) for x in spark.createDataFrame([(i, len((t or "").encode()), k, k > 2048) for (i, t), k in zip(rows, n, strict=True)], out.schema).collect())
    assert token_counts.token_counts(df.limit(0), queries.WORD_BPE).count() == 0


def test_op13_query_against_the_library(spark, library):
    d = "/root/testdata/sf0.001"
    docs = [(x["doc_id"], x["text"] or "") for x in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = sorted((i, len(t.encode()), k, k > 2048) for (i, t), k in zip(docs, library([t for _, t in docs]), strict=True))
    assert sorted(tuple(x) for x in queries.op13_token_counts(spark, d).collect()) == want
