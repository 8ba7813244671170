"""Token counts of whole texts: pre-tokens as ragged arrays of symbols, merged rank by rank, all sequences at once."""

from __future__ import annotations

import heapq
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_slices
from .tokens import PLAIN, byte_chars

LIMIT = 2048
#: Words whose counts a worker remembers, in two halves; bounds memory, never results.
REMEMBERED = 400_000
#: Longer words are counted each time.
LONGEST = 64
#: Symbols of a sequence beyond which its rounds visit only the places of the pair that is merged.
LONG = 512
NONE = np.int64(1) << 40


class Merger:
    """Merge ranks as sorted pair keys, and the number of symbols that are left of a sequence when nothing can be merged."""

    def __init__(self, merges: list[tuple[int, int]], made: list[int]):
        a, b = (np.array(x, np.int64) for x in zip(*merges, strict=True))
        made_by = np.array(made, np.int64)
        self.base = int(max(a.max(), b.max(), made_by.max())) + 1
        keys = a * self.base + b
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order, made_by
        #: The smallest rank of a pair that holds the merge's result. Where it is above the merge's own rank, what a merge
        #: makes can't come before the other places of the same pair, so these are merged together.
        least = np.full(self.base, NONE, np.int64)
        rank = np.arange(len(a))
        np.minimum.at(least, a, rank)
        np.minimum.at(least, b, rank)
        self.together = least[made_by] > rank

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, NONE where they can't be merged."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def left(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Symbols left of each of the sequences of the given sizes, which stand one after another in symbols."""
        sizes = sizes.astype(np.int64)
        out, start = sizes.copy(), np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > LONG):
            out[k] = self.long(symbols[start[k] : start[k] + sizes[k]])
        some = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        if not len(some):
            return out
        within = np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        symbols, owner = symbols[np.repeat(start[some], sizes[some]) + within], np.repeat(np.arange(len(some)), sizes[some])
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            rank[pair] = self.ranks(symbols[pair], symbols[pair + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            out[some[owner[first]]] = size
            lowest = np.repeat(lowest, size)
            busy = lowest < NONE
            at = self.apart(np.flatnonzero((rank == lowest) & busy), symbols, owner, rank)
            symbols[at] = self.made[rank[at]]
            busy[at + 1] = False
            symbols, owner = symbols[busy], owner[busy]
        return out

    def apart(self, at: np.ndarray, symbols: np.ndarray, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of the places of each sequence's lowest pair, those that are merged in a round: from the left, none that overlaps
        the one before; only the first where the result may come before the rest."""
        if not len(at):
            return at
        new = np.r_[True, at[1:] != at[:-1] + 1]
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run) % 2 == 0]
        first = np.r_[True, owner[at[1:]] != owner[at[:-1]]]
        return at[first | self.together[rank[at]]]

    def long(self, symbols: np.ndarray) -> int:
        """The same for one long sequence, with a queue of ranks and the places of each, so that a round costs the places of
        its pair and not the sequence."""
        n = len(symbols)
        symbols, after, before = symbols.astype(np.int64), np.arange(1, n + 1), np.arange(-1, n - 1)
        here, gone, queue, waiting = np.ones(n, bool), 0, [], {}

        def push(places: np.ndarray) -> None:
            places = places[(places >= 0) & (after[np.maximum(places, 0)] < n)]
            rank = self.ranks(symbols[places], symbols[after[places]])
            places, rank = places[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            for some in np.split(places, np.flatnonzero(np.diff(rank)) + 1) if len(rank) else []:
                r = int(self.ranks(symbols[some[:1]], symbols[after[some[:1]]])[0])
                if r not in waiting:
                    heapq.heappush(queue, r)
                waiting.setdefault(r, []).append(some)

        push(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[here[at] & (after[at] < n)]
            at = at[self.ranks(symbols[at], symbols[after[at]]) == r]
            if not len(at):
                continue
            if self.together[r]:
                new = np.r_[True, after[at[:-1]] != at[1:]]
                run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                do = at[(np.arange(len(at)) - run) % 2 == 0]
            else:
                do = at[:1]
                heapq.heappush(queue, r)
                waiting[r] = [at[1:]]
            lost = after[do]
            symbols[do], here[lost], gone = self.made[r], False, gone + len(do)
            after[do] = after[lost]
            back = after[do] < n
            before[after[do][back]] = do[back]
            push(np.unique(np.r_[before[do], do]))
        return n - gone


class WordCounts:
    """Token counts of texts for vocabularies with word ends, whose pre-tokenizer drops white space.

    A text is cut at its special tokens, which count one each, and at spaces, tabs and line ends. Each word is split into
    pre-tokens, whose bytes are the symbols to merge; the last one carries the word end. Words of plain Latin characters are
    split by a pattern, all others by the vocabulary's own normalizer and pre-tokenizer. No encoder is run.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.own = Tokenizer.from_file(path)
        model, special = spec["model"], spec.get("added_tokens") or []
        self.suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        plain_flags = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in special)
        # fixed values: the steps before merging that this class takes
        fixed = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if not self.suffix or not plain_flags or (spec.get("normalizer") or {}).get("normalizers") != fixed or pre[0].get("pattern") != {"Regex": split} or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a vocabulary with word ends of the known kind")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"]))) or r"(?!)")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merger = Merger([(vocab[a], vocab[b]) for a, b in pairs], [vocab[a + b] for a, b in pairs])
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in byte_chars().items():
            self.inner[b], self.last[b] = vocab[c], vocab[c + self.suffix]
        self.to_byte = {ord(c): b for c, b in byte_chars().items()}
        letters = "a-zß-öø-ſ"
        self.plain, self.piece = re.compile(f"[{PLAIN}]+"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+")
        self.known: dict[str, int] = {"": 0}
        self.older: dict[str, int] = {}

    def pre_tokens(self, word: str) -> list[bytes]:
        if self.plain.fullmatch(word):
            return [p.encode() for p in self.piece.findall(word.lower())]
        return [p.translate(self.to_byte).encode("latin-1") for p, _ in self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(word))]

    def learn(self, words: list[str]) -> None:
        """Counts of new words: all their pre-tokens are merged at once."""
        pieces = [self.pre_tokens(w) for w in words]
        flat = [p for ps in pieces for p in ps]
        raw, sizes = np.frombuffer(b"".join(flat), np.uint8), np.array([len(p) for p in flat], np.int64)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        left = np.r_[0, np.cumsum(self.merger.left(symbols, sizes))]
        upto = np.cumsum([0, *(len(ps) for ps in pieces)])
        self.known.update(zip(words, (left[upto[1:]] - left[upto[:-1]]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut, extra = [], []
        for t in texts:
            parts = self.special.split(t) if "<|" in t else [t]
            extra.append(len(parts) - 1)
            cut.append([w for p in parts for w in p.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")])
        used: set[str] = set().union(*cut) if cut else set()
        new = used.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        new = list(new - again)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        out = [sum(map(get, c)) + e for c, e in zip(cut, extra, strict=True)]
        for w in [w for w in new if len(w) > LONGEST]:
            del self.known[w]
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {"": 0}
        return out


@lru_cache(maxsize=4)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    n_tokens is what the tokenizers library gives for the whole text without special tokens added, truncation or padding;
    a special token's string in a text counts one. Each row is counted by itself: no shuffle, and hot or repeated rows cost
    no more than others. A null text counts as empty (0 tokens), null ids pass through, an empty table gives an empty
    result, and other columns are never read. A text of any length is counted whole; a long word without a blank is one
    sequence, merged by a queue of ranks. The vocabulary file must be at the same path on every executor.
    """
    kind = dict(docs.dtypes)[id_col]

    def count(batches):
        counter = word_counts(path)
        for b in batches:
            for ids, texts in text_slices(b):
                n = np.array(counter.count(texts), np.int64)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
