"""Whole-text token ids from fragments: the text is cut where no token can cross, each fragment is encoded once and remembered."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Fragments remembered by a worker, in two halves: when the newer is full, the older goes, but for what was used again.
#: Bounds memory, never results.
REMEMBERED = 250_000
#: Characters whose class, case and normal form are beyond doubt in any Unicode version; fragments of these alone are
#: encoded many at a time by the merge ranks, all others one by one by the tokenizers library itself.
PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
TOGETHER = 4000
#: Fixed value: how the byte-level vocabulary splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer fragments are encoded each time.
LONGEST = 64
#: Characters of plain texts that are merged at a time; longer texts go in stretches that end before a blank.
STRETCH = 1 << 19
BLANK, LETTER, DIGIT, OTHER = range(4)


def byte_chars() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def stretches(text: str, most: int) -> list[str]:
    """text in stretches of at most `most` characters that end before a blank; a longer run without one stands whole."""
    out, at = [], 0
    while len(text) - at > most:
        end = max(text.rfind(c, at + 1, at + most + 1) for c in " \t\r\n")
        if end < 0:
            later = [x for x in (text.find(c, at + most) for c in " \t\r\n") if x >= 0]
            end = min(later, default=len(text))
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


class Ranks:
    """Byte-pair merging by rank. `ranks` has all single bytes and the bytes of every merge's result, in order of merging."""

    def __init__(self, split: str, ranks: dict[bytes, int], ids: np.ndarray):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.ids, self.size = ids.astype("<u4"), np.zeros(len(ids), np.int64)
        for token, r in ranks.items():
            self.size[r] = len(token)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the split pattern takes apart at their borders; all are merged in one go."""
        out = []
        for k in range(0, len(pieces), TOGETHER):
            some = pieces[k : k + TOGETHER]
            r = np.array(self.encoding.encode_ordinary("".join(some)), np.int64)
            ends = np.searchsorted(np.cumsum(self.size[r]), np.cumsum([len(p.encode()) for p in some]), "left") + 1
            raw = self.ids[r].tobytes()
            ends = (4 * ends).tolist()
            out += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        return out


class Fragments:
    """Encodes whole texts by fragments; subclasses say where a text may be cut."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task's own core and no more
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def learn(self, fragments: list[str]) -> None:
        for k in range(0, len(fragments), 10_000):
            some = fragments[k : k + 10_000]
            for f, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[f] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        used: set[str] = set().union(*cut) if cut else set()
        new = used.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((f, self.older[f]) for f in again)
        new -= again
        self.learn(list(new))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for f in [f for f in new if len(f) > LONGEST]:
            del self.known[f]
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {"": b""}
        return out


class ForcedBoundary(Fragments):
    """Byte-level BPE with forced-boundary splitting.

    `inside[a, b]` says whether bytes a and b stand next to each other inside any vocabulary token. Where they never do, no
    merge can join them, so the place is a certain cut. Of the certain cuts those before a space or line feed are used that
    follow another character: there the pre-tokenizer's own boundaries are the same on both sides (a piece never holds a
    white-space character after another one; a run of white space is cut only where no merge could join it). Where the
    vocabulary does join such a pair of bytes, the text stays whole. Decoding joins the tokens' bytes.
    """

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_chars()
        self.bytes_of: dict[int, bytes] = {}
        self.inside = np.zeros((256, 256), bool)
        for token, i in spec["model"]["vocab"].items():
            raw = bytes(to_byte[c] for c in token)
            self.bytes_of[i] = raw
            x = np.frombuffer(raw, np.uint8)
            self.inside[x[:-1], x[1:]] = True
        ranks = {raw: i for i, raw in self.bytes_of.items()}
        special = spec.get("added_tokens") or []
        self.special = [t["content"] for t in special]
        self.bytes_of |= {t["id"]: t["content"].encode() for t in special}
        known = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec.get("normalizer")
        self.pattern, self.ranks = None, None
        if not known or any(set(t["content"]) & set(" \n") for t in special):
            return
        self.pattern = re.compile(self.fragment_pattern())
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if all(vocab[a + b] == 256 + k for k, (a, b) in enumerate(merges)) and all(t["content"].startswith("<|") for t in special):
            self.ranks = Ranks(SPLIT, ranks, np.arange(len(ranks)))
            self.plain = re.compile(rf"[ \n]+[{PLAIN}]+")
            self.marked = re.compile(f"[{re.escape(self.marks)}][{PLAIN}]*" if self.marks else "(?!)")

    def fragment_pattern(self) -> str:
        """A fragment: white space and what follows, on past places that are no certain cut."""
        uncertain = [b for b in range(256) if b not in b" \n" and self.inside[b, [ord(" "), ord("\n")]].any()]
        letters = [*range(65, 91), *range(97, 123)]
        self.marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'" and not self.inside[letters, c].any())
        if any(s[:1].isalpha() for s in self.special):
            self.marks = ""
        last = "".join(re.escape(chr(c)) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c) not in " \n" and chr(c).encode()[-1] in uncertain)
        on = f"(?:(?<=[{last}\U00010000-\U0010ffff])[ \n]+[^ \n]+)*" if last else ""
        mark = f"[A-Za-z]+(?=[{re.escape(self.marks)}])|" if self.marks else ""
        return rf"[ \n]*(?:{mark}[^ \n]+{on})|[ \n]+"

    def cut(self, text: str) -> list[str]:
        return self.pattern.findall(text) if self.pattern else [text]

    def learn(self, fragments: list[str]) -> None:
        if not self.ranks:
            return super().learn(fragments)
        plain = [f for f in fragments if self.plain.fullmatch(f) and "<|" not in f]
        self.known.update(zip(plain, self.ranks.encode(plain), strict=True))
        marked = [f for f in fragments if self.marked.fullmatch(f) and "<|" not in f]
        apart = [x for f in marked for x in (" a", f)]  # a word before each, so that none begins inside the one before
        self.known.update(zip(marked, self.ranks.encode(apart)[1::2], strict=True))
        super().learn([f for f in fragments if f not in self.known])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Words(Fragments):
    """Vocabularies with word ends whose pre-tokenizer drops white space: each stretch between spaces, tabs and line ends
    stands alone.

    Plain stretches are merged by rank. The end of a word is a byte of its own there, END, that joins the byte before it
    first of all, which gives the vocabulary's symbols with a word end; ids are looked up by rank afterwards.
    """

    END = "\x01"

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = any(set(t["content"]) & set(" \t\r\n") for t in spec.get("added_tokens") or [])
        self.ranks = None
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
        fixed = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if not suffix or (spec.get("normalizer") or {}).get("normalizers") != fixed or pre[0].get("pattern") != {"Regex": split} or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            return
        to_byte, end = byte_chars(), self.END.encode()

        def raw(token: str) -> bytes:
            stem = token.removesuffix(suffix)
            return bytes(to_byte[c] for c in stem) + (end if stem != token else b"")

        vocab, order = model["vocab"], {}
        for c, b in to_byte.items():
            order[bytes([b])] = vocab[c]
        for c, b in to_byte.items():
            order[bytes([b]) + end] = vocab[c + suffix]
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            order.setdefault(raw(a + b), vocab[a + b])
        self.ranks = Ranks("[^\x01]+\x01", {t: k for k, t in enumerate(order)}, np.array(list(order.values())))
        self.plain = re.compile(f"[{PLAIN}]+")
        self.blank_or_plain = re.compile(f"[ \t\r\n{PLAIN}]*")
        self.contraction = re.compile("'(?:s|t|re|ve|m|ll|d)")
        letters = "a-z\u00df-\u00f6\u00f8-\u017f"
        self.kind = np.full(0x180, OTHER, np.uint8)
        self.kind[[ord(c) for c in " \t\r\n"]] = BLANK
        self.kind[[k for k in range(0x180) if re.match(f"[{letters}]", chr(k))]] = LETTER
        self.kind[[ord(c) for c in "0123456789"]] = DIGIT
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^{letters}0-9]+")

    def cut(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Plain texts are merged whole and many at a time, without a look at single fragments; all others by fragments."""
        if not self.ranks or self.whole:
            return super().encode(texts)
        out: list[bytes | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.blank_or_plain.fullmatch(t) and "<|" not in t]
        plain.sort(key=lambda k: texts[k].isascii())
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(texts[plain[end]]) <= STRETCH):
                size += len(texts[plain[end]])
                end += 1
            some = plain[at:end]
            if size <= STRETCH:
                made = self.merged([texts[k] for k in some])
            else:
                made = [b"".join(self.merged([x])[0] for x in stretches(texts[some[0]], STRETCH))]
            for k, ids in zip(some, made, strict=True):
                out[k] = ids
            at = end
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, super().encode([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def merged(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts. Pieces end where the kind of character changes and after each digit; a contraction, where a
        piece starts with its apostrophe, is a piece of its own. Blanks go and END follows each piece."""
        text = "\n".join(texts).lower() + "\n"
        narrow = text.isascii()
        code = "ascii" if narrow else "utf-16-le"
        chars = np.frombuffer(text.encode(code), np.uint8 if narrow else "<u2")
        kind = self.kind[chars]
        kept = kind != BLANK
        last = np.zeros(len(chars), bool)
        last[:-1] = kept[:-1] & ((kind[:-1] != kind[1:]) | (kind[:-1] == DIGIT))
        if "'" in text:
            for m in self.contraction.finditer(text):
                i, j = m.span()
                if not i or kind[i - 1] != OTHER:
                    last[i], last[i + 1 : j - 1], last[j - 1] = False, False, True
        width = kept.view(np.int8) + last.view(np.int8)
        place = np.cumsum(width, dtype=np.int32)
        ended = np.repeat(chars, width)
        ended[place[last] - 1] = ord(self.END)
        joined = ended.tobytes().decode(code)
        if not narrow:
            place = np.cumsum(width + (chars >= 0x80), dtype=np.int32)
        r = np.array(self.ranks.encoding.encode_ordinary(joined), np.uint32)
        texts_end = place[np.cumsum([len(t) + 1 for t in texts]) - 1]
        ends = (4 * np.searchsorted(np.cumsum(self.ranks.size[r]), texts_end, "right")).tolist()
        raw = self.ranks.ids[r].tobytes()
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, fragments: list[str]) -> None:
        if not self.ranks:
            return super().learn(fragments)
        plain = [f for f in fragments if self.plain.fullmatch(f) and "<|" not in f]
        ended = [self.END.join(self.piece.findall(f.lower())) + self.END for f in plain]
        self.known.update(zip(plain, self.ranks.encode(ended), strict=True))
        super().learn([f for f in fragments if f not in self.known])


@lru_cache(maxsize=4)
def forced_boundary(path: str) -> ForcedBoundary:
    return ForcedBoundary(path)


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    return Words(path)
