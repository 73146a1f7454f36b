"""A word-ending BPE vocabulary, applied word by word with a memo."""

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

END = b"\xff"  # marks a word's end; never part of UTF-8
#: Words of these characters alone are split and merged here; any other goes through the library itself.
PLAIN = re.compile(r"[ \n\t\r\x21-\x7eÀ-ÖØ-öø-ÿœŒ]*")
PLAIN_RE2 = r"^[ \n\t\r\x21-\x7eÀ-ÖØ-öø-ÿœŒ]*$"
#: The vocabulary's own splitting, for those characters.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^ \n\t\ra-zß-öø-ÿœ0-9]+")
SPACE = re.compile("[ \n\t\r]+")


def byte_names() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, as the characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b) if b in printable else chr(next(others)): b for b in range(256)}


class WordBpe:
    """Ids of a text as the tokenizers library gives them (no special tokens added), as packed little-endian uint32.

    White space only separates words in this vocabulary, so a text's ids are those of its words, one after the other, and each
    distinct word is encoded once per memo. Plain Latin words are merged by tiktoken's engine: each byte's word-end form is
    made first, and then the vocabulary's merges apply in their order. Words with other characters, or with the text of a
    special token, go through the library.
    """

    _open: dict[str, "WordBpe"] = {}

    def __init__(self, path: str, memo: int = 100_000):
        self.path, self.memo, self.words, self.most = path, {}, {}, memo
        spec = json.load(open(path, encoding="utf-8"))
        names, suffix = byte_names(), spec["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in spec["added_tokens"]]

        def raw(token: str) -> bytes:
            ended = token.endswith(suffix)
            return bytes(names[c] for c in (token[: -len(suffix)] if ended else token)) + END * ended

        vocab = spec["model"]["vocab"]
        order = [bytes([b]) + END for b in range(255)]
        order += [raw(a) + raw(b) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
        order += [bytes([b]) for b in range(256)]
        ranks: dict[bytes, int] = {}
        for piece in order:
            ranks.setdefault(piece, len(ranks))
        ids = np.zeros(len(ranks), dtype=np.uint32)
        for token, i in vocab.items():
            if token not in self.special and (r := ranks.get(raw(token))) is not None:
                ids[r] = i
        self.ids, self.engine = ids.tolist(), tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @classmethod
    def open(cls, path: str) -> "WordBpe":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @cached_property
    def whole(self) -> Tokenizer:
        """The library's own tokenizer, opened when a word first needs it."""
        return Tokenizer.from_file(self.path)

    def _slow(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.ids
        return array("I", [ids[r] for r in self.engine.encode_single_piece(part.encode() + END)]).tobytes()

    def packed(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return self._joined(PARTS.findall(text.lower()), self._part)
        out = []
        for word in SPACE.split(text):
            if PLAIN.fullmatch(word) and "<|" not in word:
                out.append(self._joined(PARTS.findall(word.lower()), self._part))
            else:
                out.append(self._joined([word], self._slow))
        return b"".join(out)

    def _joined(self, parts: list[str], encode: Callable[[str], bytes]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[p] for p in parts])
        except KeyError:
            pass
        if len(memo) >= self.most:
            memo.clear()
        out = []
        for p in parts:
            got = memo.get(p)
            if got is None:
                got = encode(p)
                if len(p) < 64:  # very long words do not fill the memo
                    memo[p] = got
            out.append(got)
        return b"".join(out)

    def batches(self, texts: pa.Array, most_bytes: int = 8_000_000) -> Iterator[tuple[int, np.ndarray]]:
        """(position, ids) of every text of a string array without nulls, in any order; worked on in slices of a few MB."""
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN_RE2), pc.invert(pc.match_substring(texts, "<|"))).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~plain):
            yield int(i), np.frombuffer(self.packed(texts[int(i)].as_py()), dtype=np.uint32)
        which = np.flatnonzero(plain)
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[which]) if which.size else which
        for part in np.split(which, np.searchsorted(size, np.arange(most_bytes, size[-1], most_bytes))) if which.size else []:
            if part.size:
                yield from zip(part.tolist(), self._slice(texts.take(pa.array(part))), strict=True)

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        coded = words.values.dictionary_encode() if len(words.values) else pa.array([""]).dictionary_encode().slice(0, 0)
        codes, known = coded.indices.to_numpy(), self.words
        if len(known) >= self.most:
            known.clear()
        each = []
        for w in coded.dictionary.to_pylist():
            got = known.get(w)
            if got is None:
                got = self._joined(PARTS.findall(w), self._part)
                if len(w) < 64:
                    known[w] = got
            each.append(got)
        n = np.array([len(x) // 4 for x in each], dtype=np.int64)
        flat = np.frombuffer(b"".join(each), dtype=np.uint32)
        first, counts = np.concatenate(([0], np.cumsum(n)))[:-1], n[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(first[codes] - ends[:-1], counts) + np.arange(ends[-1])]
        at = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
