"""Token ids through the tokenizers library, with a table of distinct words.

The tokenizer drops white space before it looks for pieces and none of its rules reaches over a blank or a line feed,
so a text's ids are those of its words between these, one after the other. It lower-cases, so words are looked up with
A-Z lowered (not in texts with `<|`, where special tokens may stand, whose case counts). A word that ends in signs
after an ASCII letter or digit is that word, then the signs, which are one piece. Each distinct word is encoded once
by the library: lower-case ASCII words by its model alone, as the steps before it leave them whole; other words of
letters are one piece each, whose last id alone is one of a word's end, so that many can be encoded as one text and
told apart. The table is bounded: when it is full, words not used since it last was go. None of this changes an id.
"""

from __future__ import annotations

import ctypes
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that the table holds (twice as many for a short time), and the longest ones that it keeps.
TABLE = 300_000
LONG = 64
#: Rows and bytes of texts that `WordTable.encode` takes best at once.
PART = (8192, 6 << 20)
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTable:
    """Encodes lists of texts to bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older = _tokenizer(path), {b"": b""}, {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def forget(self) -> None:
        self.known, self.older = {b"": b""}, {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The library's ids of words without blanks and line feeds."""
        model, out = self.tokenizer.model, []
        rest: list[int] = []
        for i, w in enumerate(words):
            if w.isalpha() and w.islower():  # ASCII letters: the normaliser and pre-tokeniser leave them as they are
                out.append(np.array([t.id for t in model.tokenize(w.decode())], "<u4").tobytes())
            else:
                out.append(b"")
                rest.append(i)
        texts = [words[i].decode() for i in rest]
        plain, odd = [], []
        for i, w in zip(rest, texts, strict=True):
            (plain if w.isalpha() else odd).append((i, w))
        for a in range(0, len(plain), 1000):
            part = plain[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([w for _, w in part])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):  # a word has several pieces
                odd += part
                continue
            raw, cuts = ids.tobytes(), (4 * stops).tolist()
            for (i, _), s, e in zip(part, [0, *cuts], cuts, strict=False):
                out[i] = raw[s:e]
        for (i, _), e in zip(odd, self.tokenizer.encode_batch_fast([w for _, w in odd], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def _table(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the table where it has them."""
        if len(self.known) > TABLE:
            self.known, self.older = {b"": b""}, self.known
        known, older, rare = self.known, self.older, {}
        new, ask = [], []
        for w in words:
            if w in known:
                continue
            got = older.get(w)
            if got is not None:
                known[w] = got
                continue
            base = w.rstrip(_SIGNS)
            if base and len(base) < len(w) and b"<|" not in w and base[-1:].isalnum():
                signs = w[len(base) :]
                new.append((w, base, signs))
                ask.append(base)
                ask.append(signs)
            else:
                ask.append(w)
        fresh = [w for w in dict.fromkeys(ask) if w not in known and w not in older]
        for w, ids in zip(fresh, self._ids(fresh), strict=True):
            (known if len(w) <= LONG else rare)[w] = ids
        find = lambda w: known[w] if w in known else rare[w] if w in rare else older[w]
        for w, base, signs in new:
            (known if len(w) <= LONG else rare)[w] = find(base) + find(signs)
        return [known[w] if w in known else rare[w] for w in words] if rare else list(map(known.__getitem__, words))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(col):
            return []
        col = pc.fill_null(col, "")
        special = pc.match_substring(col, "<|")
        low = pc.ascii_lower(col)
        words = pc.split_pattern(pc.replace_substring(pc.if_else(special, col, low), "\n", " "), " ")
        ends = np.asarray(words.offsets)[1:] - words.offsets[0].as_py()
        distinct = pc.dictionary_encode(words.flatten())
        code = np.asarray(distinct.indices)
        each = self._table(distinct.dictionary.cast(pa.binary()).to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, begin = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
        n = size[code]
        stop = np.cumsum(n)
        kind = np.int32 if len(n) and max(stop[-1], len(flat)) < 2**31 else np.int64
        at = np.repeat((begin[code] - stop + n).astype(kind), n)
        at += np.arange(len(at), dtype=kind)
        raw = flat[at].tobytes()
        cuts = (4 * np.concatenate([[0], stop])[ends]).tolist()
        return [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]


_LAST: list = []


def claim(holder):
    """Only the table in use stays in a worker: the one used before forgets its words."""
    if _LAST and _LAST[0] is not holder:
        drop_table()
    _LAST[:] = [holder]
    return holder


def drop_table() -> None:
    """The table in use, if any, forgets its words: for tasks of other kinds in a worker that lives on."""
    if _LAST:
        _LAST.pop().forget()
        give_back()


def give_back() -> None:
    """What this worker has freed goes back to the system, as its executor has one limit for all workers and the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@cache
def _word_table(path: str) -> WordTable:
    return WordTable(path)


def table(path: str) -> WordTable:
    """One table for each Python worker and tokenizer."""
    return claim(_word_table(path))


def slices(col: pa.Array, rows: int = 512, size: int = 2 << 20):
    """(first row, part) of a column of texts, in parts of at most so many rows and, but for single texts, bytes."""
    first, have = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(col), 0).to_pylist()):
        if i > first and (i - first == rows or have + n > size):
            yield first, col.slice(first, i - first)
            first, have = i, 0
        have += n
    if first < len(col):
        yield first, col.slice(first)
