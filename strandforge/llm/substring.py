"""Substring dedup: words covered by a 13-word window that also starts in an earlier document.

Texts are written once, in chunks, to the shared folder; after that only segments move.

1. Each chunk lists the anchors of its windows: of the five-word grams of a window, the one
   of least hash. Equal windows have equal anchors, and neighbouring windows mostly share
   theirs, so a run of windows with one anchor is one segment.
2. Anchors meet by shard. Those of one document alone are done; each chunk gets back the
   others.
3. Each chunk sends the words of its segments with such anchors to the anchor's shard. Of
   equal segments of a chunk only one of the least document goes, with the places of its
   twins in that document; those of other documents are known to be repeats. So what a
   passage sends is bounded by the number of chunks, not by its copies.
4. Each shard builds a compressed FM-index of its segments: the words before each suffix in
   the bit planes of a wavelet matrix, and the least document of every distinct window;
   neither text nor suffixes are kept. Documents' segments are then streamed against it in
   blocks: backward search gives the matching statistics (how many words up to a place also
   occur elsewhere), and where they reach 13, the window's least document decides.
5. Each chunk collects its intervals, removes the words and hashes what is left.

Hashes only bring candidates together. Whether segments of a chunk or windows of a shard are
equal is decided on words numbered by their bytes (``hashing.numbered``), so ``hashed`` may be
weak.

An anchor of more than ``hot`` segments would fill its shard: its windows are compared one by
one instead, by their own words, in groups of chunks and then all together (``later_windows``),
which is as exact.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch, ship
from .files import filesystem
from .hashing import Bytes, P, U, flat, mix, numbered, sequence_hash, span_hash, word_spans

#: Words of an anchor: more of them make chance repeats rarer, and segments shorter.
GRAM = 5


class Words:
    """The words of texts: bytes, places, and the number of words of each text."""

    def __init__(self, texts: list[bytes]):
        self.bytes = Bytes(b"\n".join(texts))
        self.starts, self.ends = word_spans(self.bytes.array)
        edges = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(self.starts, edges))

    def piece(self, first: int, n: int) -> bytes:
        """n words from one on, as they stand, or with single spaces where much white space is between them."""
        piece = self.bytes.data[self.starts[first] : self.ends[first + n - 1]]
        return piece if len(piece) < 32 * n else b" ".join(piece.split())


def runs_of(ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: first window, number of windows, anchor, text. ids are hashes of words."""
    none = np.empty(0, np.int64)
    if len(ids) < width:
        return none, none, np.empty(0, np.uint64), none
    text = np.repeat(np.arange(len(counts)), counts)
    m = len(ids) - GRAM + 1
    g = ids[:m].copy()
    for j in range(1, GRAM):
        g = g * P + ids[j : j + m]
    g = mix(g)
    span = width - GRAM + 1
    n = len(ids) - width + 1
    at = np.empty(n, np.int64)
    for i in range(0, n, 1 << 18):
        j = min(n, i + (1 << 18))
        at[i:j] = sliding_window_view(g[i : j + span - 1], span).argmin(1) + np.arange(i, j)
    good = text[:n] == text[width - 1 :]
    new = good.copy()
    new[1:] &= (at[1:] != at[:-1]) | ~good[:-1] | (text[1:n] != text[: n - 1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(np.cumsum(good)[first] - 1, good.sum()))
    return first, size, g[at[first]], text[first]


class FMIndex:
    """Patterns of up to ``width`` symbols in a text (0 ends a segment): bit planes with ranks, and the least document of each distinct window.

    Suffixes are ordered by their first ``width`` symbols, which is all that backward
    search of such patterns needs. Text and suffixes are dropped once the planes stand.
    """

    def __init__(self, text: np.ndarray, docs: np.ndarray, width: int):
        n = len(text)
        self.width = width
        rank, k = text.astype(np.int64), 1
        while k < width:
            step = min(k, width - k)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
            k += step
        suffixes = np.argsort(rank, kind="stable")
        self.symbols = int(text.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.symbols))]
        # Suffixes that agree in ``width`` symbols are one run; only its start and its least document are kept.
        self.runs = np.flatnonzero(np.r_[True, np.diff(rank[suffixes]) != 0]).astype(np.int32)
        self.least = np.minimum.reduceat(docs[suffixes], self.runs)
        self.bits = max(1, (self.symbols - 1).bit_length())
        x = text[suffixes - 1]
        del rank, suffixes
        self.planes, self.ranks, self.zeros = [], [], []
        for b in range(self.bits - 1, -1, -1):
            on = (x >> b & 1).astype(bool)
            words = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed = np.packbits(on, bitorder="little")
            words[: len(packed)] = packed
            words = words.view("<u8")
            self.planes.append(words)
            self.ranks.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32))
            self.zeros.append(int(n - on.sum()))
            x = np.concatenate([x[~on], x[on]])
        self.starts = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for p in range(self.bits):
            w = i >> 6
            ones = self.ranks[p][w] + np.bitwise_count(self.planes[p][w] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))
            i = np.where(c >> (self.bits - 1 - p) & 1, self.zeros[p] + ones, i - ones)
        return i

    def matching_statistics(self, streamed: np.ndarray, ends: np.ndarray, most: int | None = None, own: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Per place in ``ends``: how many symbols of ``streamed`` up to and with it, ``most`` (``width``) at most and within its segment, occur more than ``own`` times; and where that interval of suffixes starts.

        ``own`` is 1 for what is in the index itself, so that its own occurrence does not
        count. Symbols that the index does not know match nothing.
        """
        most = most or self.width
        length, start = np.zeros(len(ends), np.int64), np.full(len(ends), -1, np.int64)
        left, lo, hi = np.arange(len(ends)), np.zeros(len(ends), np.int64), np.full(len(ends), self.first[-1])
        for j in range(most):
            at = ends[left] - j
            c = np.where(at >= 0, streamed[np.maximum(at, 0)], 0)
            good = (c > 0) & (c < self.symbols)
            left, lo, hi, c = left[good], lo[good], hi[good], c[good]
            if j:
                base = self.first[c] - self.starts[c]
                lo, hi = base + self._down(c, lo), base + self._down(c, hi)
            else:
                lo, hi = self.first[c], self.first[c + 1]
            more = hi - lo > own
            left, lo, hi = left[more], lo[more], hi[more]
            length[left], start[left] = j + 1, lo
        return length, start

    def least_document(self, start: np.ndarray) -> np.ndarray:
        """The least document in which the window occurs whose interval starts there."""
        return self.least[np.searchsorted(self.runs, start, side="right") - 1]


#: Places of a block of documents streamed against an index.
BLOCK = 1 << 16


def least_documents(symbols: np.ndarray, lengths: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Segments (of ``lengths`` symbols from 1 on) one after another. Per window, in order: the least document among its occurrences."""
    segment = np.repeat(np.arange(len(lengths)), lengths + 1)
    text = np.zeros(len(segment), np.int64)
    first = np.cumsum(lengths + 1) - lengths - 1
    text[flat(first, lengths)] = symbols  # 0 ends a segment
    at = flat(first, np.maximum(lengths - width + 1, 0))
    out = docs[segment[at]]
    if len(at):
        index = FMIndex(text, docs[segment], width)
        for i in range(0, len(at), BLOCK):
            length, start = index.matching_statistics(text, at[i : i + BLOCK] + width - 1, own=1)
            k = np.flatnonzero(length >= width)
            out[i + k] = index.least_document(start[k])
    return out


def _intervals(text: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Windows (text, first word), sorted, as (text, first, number) of unbroken runs."""
    if not len(first):
        return np.empty((0, 3), "<u4")
    new = np.r_[True, (np.diff(text) != 0) | (np.diff(first) != 1)]
    k = np.flatnonzero(new)
    return np.c_[text[k], first[k], np.diff(np.r_[k, len(first)])].astype("<u4")


def _write_chunk(fs, name: str, ids: list, texts: list[bytes]) -> None:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.large_binary())], ["id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    fs.write(name, sink.getvalue().to_pybytes())


def _read_chunk(path: str) -> tuple[list, list[bytes]]:
    folder, _, name = path.rpartition("/")
    t = pa.ipc.open_file(filesystem(folder).read(name)).read_all()
    return t.column(0).to_pylist(), t.column(1).to_pylist()


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows sorted by their first column, as (key, rows of the other columns)."""
    key, rows = None, []
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        for k, *rest in zip(*cols):
            if k != key and rows:
                yield key, rows
                rows = []
            key = k
            rows.append(rest)
    if rows:
        yield key, rows


def _join(parts: list[bytes], dtype) -> np.ndarray:
    return np.frombuffer(b"".join(p or b"" for p in parts), dtype)


def stretches(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of each stretch of equal keys in sorted ``keys``: as many as keys occur, however many there are."""
    if not len(keys):
        return []
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return list(zip(keys[at].tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]))


#: The shard that stands for windows of hot anchors, one a row.
HOT = -2


def later_windows(windows: DataFrame, salts: int = 64) -> DataFrame:
    """chunk, gone: of windows (chunk, head, words, doc), a row for each distinct one of a chunk with its least document, those that an earlier document has.

    The least document of a window is found in steps, in groups of chunks first, and comes
    back to them the same way: a window of all chunks is ``salts`` groups' work, and what
    joins is the words themselves.
    """
    rows = windows.select("chunk", "head", "words", "doc", F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("_salt"))
    local = rows.groupBy("words", "_salt").agg(F.min("doc").alias("_low"))
    least = local.groupBy("words").agg(F.min("_low").alias("_least"))
    known = local.select("words", "_salt").join(least, "words")
    later = rows.join(known, ["words", "_salt"]).where("doc > _least").select("chunk", "head")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = b.column(1).to_pylist()
            h = np.frombuffer(b"".join(heads), HEAD)
            gone = np.c_[h["text"], h["first"], np.ones(len(h))].astype("<u4")
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(gone, [len(x) // HEAD.itemsize for x in heads])], ["chunk", "gone"])

    return later.mapInArrow(places, "chunk string, gone binary")


def _binary(rows: np.ndarray, sizes) -> pa.Array:
    """A value for each of ``sizes``: the bytes of so many of ``rows``, in order."""
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    edges = np.r_[0, np.cumsum(sizes)] * width
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


HEAD = np.dtype([("doc", "<i8"), ("text", "<u4"), ("first", "<u4"), ("segment", "<u4"), ("n", "<u4")])


def dedup(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 8 << 20, shard_bytes: int = 2 << 20, hot: int = 20_000, hashed=span_hash) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed, kept_sha256, kept_text.

    ids are integers. A null text has no words. A row without an id neither removes
    nor loses words. Rows that repeat an id are judged each by its own text, and do not
    remove each other's words. An empty table gives none. Columns of other names are
    ignored. Words are compared by their bytes.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError("ids must be integers")
    ship(spark)
    folder = scratch(spark, "substring")
    rows = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    total = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(64, -(-total // shard_bytes))

    def anchors_of(ids: list, w: Words):
        keys = hashed(w.bytes, w.starts, w.ends)
        known = np.array([i is not None for i in ids], bool)
        first, size, anchor, text = runs_of(keys, w.counts, width)
        ok = known[text]
        return keys, first[ok], size[ok], anchor[ok], text[ok]

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, mark, no = filesystem(folder), uuid.uuid4().hex[:12], 0
        ids, texts, held = [], [], 0

        def flush():
            nonlocal ids, texts, held, no
            name = f"chunk-{TaskContext.get().partitionId():06d}-{mark}-{no:05d}.arrow"
            _write_chunk(fs, name, ids, texts)
            w = Words(texts)
            texts = []
            _, _, _, anchor, text = anchors_of(ids, w)
            del w
            doc = np.array([0 if i is None else i for i in ids], np.int64)[text]
            order = np.lexsort((doc, anchor))
            a, d = anchor[order], doc[order]
            k = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
            last = np.r_[k[1:], len(a)] - 1
            # The number of segments, and in the highest bit whether they are of several documents.
            info = (np.minimum(last - k + 1, 0x7FFF) | np.where(d[k] != d[last], 0x8000, 0)).astype("<u2") if len(k) else np.empty(0, "<u2")
            a = a[k]
            shard = (a % U(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            out = [(-1, name, b"", b"")]
            out += [(s, name, a[by[i:j]].astype("<u8").tobytes(), info[by[i:j]].tobytes()) for s, i, j in stretches(shard[by])]
            ids, held, no = [], 0, no + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["shard", "chunk", "anchors", "info"])

        for b in batches:
            for i, t in zip(b.column(0), b.column(1).cast(pa.binary())):
                ids.append(i.as_py())
                texts.append(t.as_py() or b"")
                held += len(texts[-1]) + 64
                if held >= chunk_bytes:
                    yield flush()
        if ids:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            a, info = _join([r[1] for r in rows], "<u8"), _join([r[2] for r in rows], "<u2")
            chunk = np.repeat(np.arange(len(rows)), [len(r[1]) // 8 for r in rows])
            keys, back, seen = np.unique(a, return_inverse=True, return_counts=True)
            several = np.zeros(len(keys), bool)
            several[back[info >= 0x8000]] = True
            total = np.bincount(back, info & 0x7FFF, len(keys))
            again, much = ((seen > 1) | several)[back], (total > hot)[back]
            cuts = np.searchsorted(chunk, np.arange(len(rows) + 1))
            for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                keep, busy = again[i:j], much[i:j]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array([rows[k][0]]), pa.array([a[i:j][keep & ~busy].tobytes()], pa.binary()), pa.array([a[i:j][keep & busy].tobytes()], pa.binary())], ["chunk", "again", "hot"])

    names = ["shard", "chunk", "head", "words", "doc"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in _by_key(batches):
            ids, texts = _read_chunk(f"{folder}/{path}")
            w = Words(texts)
            del texts
            keys, first, size, anchor, text = anchors_of(ids, w)
            words = numbered(w.bytes, w.starts, w.ends, keys)
            again, much = np.unique(_join([r[0] for r in rows], "<u8")), np.unique(_join([r[1] for r in rows], "<u8"))
            cold, warm = np.isin(anchor, again), np.isin(anchor, much)
            one = flat(first[warm], size[warm])  # windows of hot anchors, one by one
            f = np.r_[first[cold], one]
            n = np.r_[size[cold], np.ones(len(one), np.int64)] + width - 1
            k = np.r_[text[cold], np.repeat(text[warm], size[warm])]
            route = np.r_[(anchor[cold] % U(shards)).astype(np.int64), np.full(len(one), HOT)]
            doc = np.array([0 if i is None else i for i in ids], np.int64)[k]
            del keys, anchor, first, size, text
            # Groups of equal segments, in order of document and place. What a hash brought together is compared word by word with the first; what differs stays alone.
            key = sequence_hash(words, f, f + n)
            order = np.lexsort((f, doc, key))
            head = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.empty(0, bool)
            to = order[np.flatnonzero(head)][np.cumsum(head) - 1]
            same = np.zeros(len(order), bool)
            for i in range(0, len(order), 1 << 16):
                x, y = order[i : i + (1 << 16)], to[i : i + (1 << 16)]
                even = n[x] == n[y]
                x, y, at = x[even], y[even], i + np.flatnonzero(even)
                step = np.repeat(np.arange(len(x)), n[x])
                same[at] = np.bincount(step, words[flat(f[x], n[x])] != words[flat(f[y], n[y])], len(x)) == 0
            to = np.where(same, to, order)
            later, go = doc[order] > doc[to], np.flatnonzero(to == order)
            base = np.cumsum(w.counts) - w.counts
            known = order[later]
            gone = np.unique(np.c_[np.repeat(k[known], n[known] - width + 1), flat(f[known], n[known] - width + 1)], axis=0) if len(known) else np.empty((0, 2), np.int64)
            # Known repeats go along to the chunk's own place, by way of some shard.
            out = [(int(xxhash.xxh3_64_intdigest(path) % shards), path, _intervals(gone[:, 0], gone[:, 1] - base[gone[:, 0]]).tobytes(), None)]
            twins = np.flatnonzero(~later)
            twins = twins[np.argsort(to[twins], kind="stable")]
            edges = np.searchsorted(to[twins], np.arange(len(f) + 1))
            go = order[go]
            go = go[np.argsort(route[go], kind="stable")]

            def rows_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Twins of segments, and how many each has."""
                many = edges[g + 1] - edges[g]
                t = order[twins[flat(edges[g], many)]]
                row = np.zeros(len(t), HEAD)
                row["doc"], row["text"], row["first"], row["segment"], row["n"] = doc[t], k[t], f[t] - base[k[t]], np.repeat(np.arange(len(g)), many), n[t]
                return row, many

            parts = stretches(route[go])
            for s, i, j in parts:
                if s != HOT:
                    g = go[i:j]
                    out.append((s, path, rows_of(g)[0].tobytes(), b"\n".join(map(w.piece, f[g].tolist(), n[g].tolist()))))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.string(), pa.binary(), pa.binary()))), pa.nulls(len(out), pa.int64())], names)
            for s, i, j in parts:
                if s == HOT:
                    row, many = rows_of(go[i:j])
                    pieces = [b" ".join(w.piece(a, width).split()) for a in f[go[i:j]].tolist()]
                    first = np.cumsum(many) - many
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, HOT), pa.int32()), pa.array([path] * (j - i)), _binary(row, many), pa.array(pieces, pa.binary()), pa.array(row["doc"][first])], names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            for path, gone, words in rows:
                if words is None:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([gone], pa.binary())], ["chunk", "gone"])
            rows = [r for r in rows if r[2] is not None]
            if not rows:
                continue
            heads = [np.frombuffer(r[1], HEAD) for r in rows]
            big = Bytes(b"\n".join(r[2] for r in rows))
            rows = [r[0] for r in rows]
            starts, ends = word_spans(big.array)
            symbols = numbered(big, starts, ends, hashed(big, starts, ends)) + 1
            del big, starts, ends
            # One entry a segment (its first twin), then the twins with what was found for it.
            lead = [np.flatnonzero(np.r_[True, np.diff(h["segment"].astype(np.int64)) != 0]) for h in heads]
            n = np.concatenate([h["n"][i] for h, i in zip(heads, lead)]).astype(np.int64)
            doc = np.concatenate([h["doc"][i] for h, i in zip(heads, lead)]).astype(np.int64)
            gone = least_documents(symbols, n, doc, width) < np.repeat(doc, n - width + 1)
            at, segment = np.cumsum(n - width + 1) - (n - width + 1), 0
            for path, h, i in zip(rows, heads, lead):
                many = n[segment : segment + len(i)][h["segment"]] - width + 1
                hit = gone[flat(at[segment : segment + len(i)][h["segment"]], many)]
                segment += len(i)
                if hit.any():
                    w = np.unique(np.c_[np.repeat(h["text"].astype(np.int64), many)[hit], flat(h["first"].astype(np.int64), many)[hit]], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([_intervals(w[:, 0], w[:, 1]).tobytes()], pa.binary())], ["chunk", "gone"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in _by_key(batches):
            ids, texts = _read_chunk(f"{folder}/{path}")
            gone = _join([r[0] for r in rows], "<u4").reshape(-1, 3).astype(np.int64)
            gone = gone[np.argsort(gone[:, 0], kind="stable")]
            cuts = np.searchsorted(gone[:, 0], np.arange(len(ids) + 1))
            cols: list[list] = [[], [], [], []]
            for k, t in enumerate(texts):
                w = t.split()
                n = len(w)
                g = gone[cuts[k] : cuts[k + 1]]
                if len(g):
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, g[:, 1], 1)
                    np.add.at(cover, g[:, 1] + g[:, 2] + width - 1, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
                kept = b" ".join(w)
                for c, x in zip(cols, (n, n - len(w), hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.binary()).cast(pa.string())], ["_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    listed = materialize(rows.mapInArrow(list_anchors, "shard int, chunk string, anchors binary, info binary"), "substring-anchors")

    def grouped(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(key).sortWithinPartitions(key)

    met = grouped(listed.where("shard >= 0"), "shard").mapInArrow(meet, "chunk string, again binary, hot binary")
    sent = grouped(met, "chunk").mapInArrow(send, "shard int, chunk string, head binary, words binary, doc long")
    sent = materialize(sent, "substring-segments")
    found = grouped(sent.where(F.col("shard") >= 0).drop("doc"), "shard").mapInArrow(index, "chunk string, gone binary")
    found = found.unionByName(later_windows(sent.where(F.col("shard") == HOT)))
    gone = found.unionByName(listed.where("shard < 0").select("chunk", F.col("anchors").alias("gone")))
    out = grouped(gone, "chunk").mapInArrow(finish, "_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept_text")
