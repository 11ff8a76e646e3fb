"""Token ids of whole texts, by the tokenizers library behind a cache of words.

For a tokenizer that drops white space before its merges and lower-cases (as
word_bpe_49k does), ids of a text are the ids of its words in order. Each word is
encoded once a worker: the library sees what the cache has not seen. The cache finds
words by hash and compares their bytes; where two words share a hash, the library
takes the texts they are in whole. It does so too with pieces that hold ``<|``, for
they may hold a special token. Long texts are cut at white space.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .hashing import Bytes, flat, same_spans, span_hash, word_spans

#: Bytes of words and ids in the cache; a full one is emptied. About 20 bytes an entry come on top.
CACHE = 32 << 20
#: Entries of each of two generations of cores, words without punctuation around them (about 200 bytes each).
CORES = 200_000
_EDGE = b".,;:!?\"()[]{}#$%&*+-/=@^_|~<>"
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _letters(w: bytes) -> bool:
    if not w or w.isascii():
        return False
    try:
        return w.decode().isalpha()
    except UnicodeDecodeError:
        return False


class WordEncoder:
    """Exact for texts whose tokenizer works on white-space words; ``encode_whole`` is the library alone. ``hashed`` may be weak."""

    def __init__(self, path: str, hashed=span_hash, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, bool)
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
        self.hashed, self.cache = hashed, cache
        self.cores: dict[bytes, bytes] = {}
        self.old_cores: dict[bytes, bytes] = {}
        self.forget()

    def forget(self) -> None:
        """Hashes, sorted, with the entry of each; per entry, where its ids and its word start. Entries are only appended."""
        self.keys, self.entry = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids, self.words = np.empty(0, self.dtype), Bytes(b"")
        self.id_at, self.word_at = np.zeros(1, np.int32), np.zeros(1, np.int32)

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode_whole(self, text: bytes) -> bytes:
        return self._pack(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _learn_cores(self, new: list[bytes]) -> None:
        """Words of letters only, each one piece to the tokenizer: encoded a thousand at a time and cut at word ends."""
        parts = [new[i : i + 1000] for i in range(0, len(new), 1000)]
        for part, got in zip(parts, self.tok.encode_batch_fast([b" ".join(x).decode() for x in parts], add_special_tokens=False) if parts else ()):
            ids = np.array(got.ids, self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                self.cores.update((w, ids[a:b].tobytes()) for w, a, b in zip(part, np.r_[0, cuts[:-1]], cuts))
            else:
                self.cores.update((w, self.encode_whole(w)) for w in part)

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Ids of each word; those of letters with punctuation around go by their core."""
        plain = [w.strip(_EDGE) for w in new]
        plain = [c if c.isalpha() or _letters(c) else None for c in plain]
        if len(self.cores) > CORES:
            self.cores, self.old_cores = {}, self.cores
        fresh = set(plain).difference(self.cores, [None])
        self.cores.update((c, self.old_cores[c]) for c in self.old_cores.keys() & fresh)
        self._learn_cores(list(fresh.difference(self.cores)))
        rest = [w for w, c in zip(new, plain) if c is None]
        whole = iter(self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)) if rest else iter(())
        edge = {b"": b""}
        out = []
        for w, c in zip(new, plain):
            if c is None:
                out.append(self._pack(next(whole).ids))
            elif len(w) == len(c):
                out.append(self.cores[c])
            else:
                a, _, b = w.partition(c)
                for x in (a, b):
                    if x not in edge:
                        edge[x] = self.encode_whole(x)
                out.append(edge[a] + self.cores[c] + edge[b])
        return out

    def encode(self, texts: list[bytes], at_once: int = 2 << 20) -> list[bytes]:
        """Ids of each text, little-endian, ``dtype`` wide; about ``at_once`` bytes are taken at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            for (i, _), x in zip(group, self._encode_group([t for _, t in group])):
                out[i].append(x)
            group.clear()

        for i, t in enumerate(texts):
            for p in _pieces(t, at_once):
                if b"<|" in p:
                    flush()
                    held = 0
                    out[i].append(self.encode_whole(p))
                    continue
                group.append((i, p))
                held += len(p) + 1
                if held >= at_once:
                    flush()
                    held = 0
        flush()
        return [b"".join(x) for x in out]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        return self.entry[np.where(old, at, 0)] if len(self.entry) else at, old

    def _append(self, keys: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        count = len(self.id_at) - 1
        put = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, put, keys), np.insert(self.entry, put, np.arange(count, count + len(keys), dtype=np.int32))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.dtype)])
        self.words = Bytes(b"".join([self.words.data, *words]))
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum([len(x) // self.dtype.itemsize for x in ids], dtype=np.int32)])
        self.word_at = np.concatenate([self.word_at, self.word_at[-1] + np.cumsum([len(w) for w in words], dtype=np.int32)])

    def _encode_group(self, group: list[bytes]) -> list[bytes]:
        if not group:
            return []
        big = Bytes(b" ".join(group).lower())
        starts, ends = word_spans(big.array)
        keys, where, back = np.unique(self.hashed(big, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        # Words of one hash: all as long as the first of them, with the same bytes.
        first = where[back]
        if not ((size == size[first]).all() and same_spans(big, starts, big, starts[first], size).all()):
            return [self.encode_whole(t) for t in group]
        s, n = starts[where], size[where]
        entry, old = self._find(keys)
        known = entry[old]
        if not ((n[old] == self.word_at[known + 1] - self.word_at[known]).all() and same_spans(big, s[old], self.words, self.word_at[known].astype(np.int64), n[old]).all()):
            return [self.encode_whole(t) for t in group]
        if not old.all():
            if self.word_at[-1] + self.id_at[-1] * self.dtype.itemsize > self.cache:
                self.forget()
                old[:] = False
            new = np.flatnonzero(~old)
            words = [big.data[i : i + k] for i, k in zip(s[new].tolist(), n[new].tolist())]
            self._append(keys[new], words, self._learn(words))
            entry, _ = self._find(keys)
        n = (self.id_at[entry + 1] - self.id_at[entry]).astype(np.int64)[back]
        ids = self.ids[flat(self.id_at[entry].astype(np.int64)[back], n)]
        words = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in group]))
        cuts = np.concatenate([[0], np.cumsum(n)])[words].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]


def _pieces(text: bytes, size: int):
    at = 0
    while len(text) - at > 2 * size and (m := _GAP.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def runs(texts, rows: int = 512, most: int = 4 << 20):
    """A column of texts as (first row, list of bytes): at most ``rows`` of them and ``most`` bytes, but one at least; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = texts.cast(pa.binary())
    until = np.cumsum(np.append(0, pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)), dtype=np.int64)
    i = 0
    while i < len(raw):
        j = min(i + rows, max(i + 1, int(np.searchsorted(until, until[i] + most, side="right")) - 1), len(raw))
        yield i, [t or b"" for t in raw.slice(i, j - i).to_pylist()]
        i = j


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
