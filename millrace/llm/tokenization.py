"""Token ids of whole texts, with a bounded memo of white-space chunks.

Both byte-level and word-level BPE models split a text into pieces before they
merge, and no piece spans the place where a word ends and white space starts.
So a text can be cut there, each chunk encoded by itself, and the ids joined.
Chunks repeat far more often than texts do: the ids of a chunk are kept in a
dictionary of bounded size, and only unknown chunks go through the tokenizer.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from os.path import commonprefix

import numpy as np

from millrace.llm._common import frees_between_queries

#: Chunks kept by a worker. At the bound the memo starts afresh.
MEMO_ENTRIES = 900_000
#: Longer chunks are encoded but not kept.
MEMO_CHUNK_CHARS = 64

_CHUNK = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
# White space other than ASCII's, before ASCII white space: a cut there is not safe.
_UNSAFE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000][ \t\n\r\f\v]")
#: Punctuation that always starts a piece of its own after a letter, in any of the models' patterns.
_TAIL = ",.!?;:%$*&#|"


def _latin(text: str) -> bool:
    """Whether all characters are Latin-1's; of these, lower case and composition are plain."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class ChunkEncoder:
    """Encodes texts to little-endian ids of ``dtype`` (two bytes where the vocabulary allows).

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the
    string of a special token in a text gives that token's id, as the library
    has it, unless ``special_as_text`` makes it ordinary text.

    ``keeps_space``: the model sees white space (byte-level BPE). Otherwise it
    drops white space and only the words count.
    """

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES, special_as_text: bool = False):
        from tokenizers import Tokenizer

        def load(as_text: bool) -> Tokenizer:
            found = Tokenizer.from_file(path)
            found.no_truncation()
            found.no_padding()
            found.encode_special_tokens = as_text
            return found

        # chunks never hold an added token's string, so nothing needs to look for one
        self.tokenizer = load(True)
        # a text that may hold one is encoded whole, by the library
        self.whole = load(False) if not special_as_text else self.tokenizer
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added_head = commonprefix(self.added)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 65_536 else np.dtype("<u4")
        mark = self._ids("a ~ a")
        self.keeps_space = mark != self._ids("a") + self._ids("~") + self._ids("a")
        if self.keeps_space:
            # a chunk of the usual kind has one blank or line feed, in front
            self.opens = np.zeros(size, bool)
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[0] in "\u0120\u010a"]] = True
        else:
            # a word of letters only is one piece, and its last token shows that it ends there
            self.closes = np.zeros(size, bool)
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
            lowered = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AÉß") == "aéß"
            self.folds = lowered and self._ids("Aé") == self._ids("aé")
        self.memo: dict[str, bytes] = {}
        self.memo_entries = memo_entries

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _joined(self, parts: list[str]) -> list[bytes]:
        """As _plain, in one call of the tokenizer where the parts can be told apart in its result."""
        joint = ("" if self.keeps_space else " ").join(parts)
        ids = np.array(self.tokenizer.encode_batch_fast([joint], add_special_tokens=False)[0].ids, self.dtype)
        if self.keeps_space:
            starts = np.flatnonzero(self.opens[ids])
            ends = np.append(starts[1:], len(ids))
        else:
            ends = np.flatnonzero(self.closes[ids]) + 1
            starts = np.append(0, ends[:-1])
        if len(starts) != len(parts) or starts[0] or ends[-1] != len(ids):
            return self._plain(parts)
        raw, width = ids.tobytes(), self.dtype.itemsize
        return [raw[a:b] for a, b in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)]

    def _learn(self, order: list[str]) -> dict[str, bytes]:
        """Ids of chunks. A chunk that ends in punctuation after a letter is put together from its two parts."""
        done: dict[str, bytes] = {}
        cores: dict[str, str] = {}
        for c in order:
            if c[-1] in _TAIL:
                core = c.rstrip(_TAIL)
                if core[-1:].isalpha() and len(core[-1].lower()) == 1 and len(c) <= MEMO_CHUNK_CHARS:
                    cores[c] = core
        needed = [*(c for c in order if c not in cores), *set(cores.values()), *{c[len(core) :] for c, core in cores.items()}]
        memo = self.memo
        needed = list(dict.fromkeys(c for c in needed if c not in memo))
        # each of the usual parts has a start or an end that shows in the ids
        usual = [c for c in needed if (c[0] in " \n" if self.keeps_space else c.isalpha() and (c.isascii() or _latin(c)))]
        for at in range(0, len(usual), 2_000):
            part = usual[at : at + 2_000]
            done.update(zip(part, self._joined(part), strict=True))
        other = [c for c in needed if c not in done]
        if other:
            done.update(zip(other, self._plain(other), strict=True))
        both = lambda c: done[c] if c in done else memo[c]
        done.update([(c, both(core) + both(c[len(core) :])) for c, core in cores.items()])
        return done

    def _chunks(self, text: str) -> list[str] | None:
        """None: the text can't be cut safely."""
        if self.added and (self.added_head in text or self.added_head.upper() != self.added_head):
            lowered = text.lower()
            if any(t in lowered for t in self.added):
                return None
        if not self.keeps_space and self.folds and _latin(text):
            text = text.lower()  # as the model's normalizer does, for these characters one by one
        words = text.split()
        if not self.keeps_space:
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else words
        if text.replace("\n", " ") == " ".join(words):
            # one blank or line feed between words: the usual case, without a regular expression
            parts = text.replace("\n", " \n").replace(" ", "\0 ").replace("\0 \n", "\0\n") if "\0" not in text else ""
            if parts:
                return parts.split("\0")
        return None if _UNSAFE.search(text) else [c for c in _CHUNK.findall(text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        collects = gc.isenabled()
        gc.disable()  # long lists and no cycles: the collector would walk through them again and again
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        get, out, waiting, unknown = self.memo.get, [], [], set()
        for i, text in enumerate(texts):
            chunks = self._chunks(text)
            if chunks is None:
                ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out.append(np.array(ids, self.dtype).tobytes())
                continue
            found = list(map(get, chunks))
            if None in found:
                gaps = [k for k, ids in enumerate(found) if ids is None]
                unknown.update(chunks[k] for k in gaps)
                waiting.append((i, found, gaps, [chunks[k] for k in gaps]))
                out.append(b"")
            else:
                out.append(b"".join(found))
        if waiting:
            learnt = self._learn(list(unknown))
            for i, found, gaps, chunks in waiting:
                for k, chunk in zip(gaps, chunks, strict=True):
                    found[k] = learnt[chunk]
                out[i] = b"".join(found)
            if len(self.memo) + len(learnt) > self.memo_entries:
                self.memo.clear()
            self.memo.update((c, ids) for c, ids in learnt.items() if len(c) <= MEMO_CHUNK_CHARS)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, kept between tasks."""
    return ChunkEncoder(path)


frees_between_queries(encoder.cache_clear)


def in_slices(texts: list[str], chars: int = 1 << 20):
    """Slices of the list whose texts have about so many characters, at least one text each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


__all__ = ["ChunkEncoder", "encoder", "in_slices"]
