"""SentencePiece encoding and decoding with seeded merge-dropout.

A merge-type (BPE) model is applied as its agenda would: of the adjacent pairs that join to a piece, the best score
goes first, the leftmost among equals.  With dropout each candidate merge is skipped if a keyed hash of (seed, text,
occurrence, place, piece) falls below the rate.  Every occurrence of a word has draws of its own, and the same seed and
text give the same pieces anywhere.

A batch's words are merged together: symbols of all words lie in flat arrays, each round takes every word's best
candidate, and words that are done leave.  Different words are merged once without dropout; an occurrence that skips
none of its word's merges has the same pieces, as each merge was the best candidate then and still is, and only the
others go through the merges again with their own draws.  Words of over ``LONG`` symbols go through a heap with the same rule.  No
piece crosses from a letter to a space mark, so words are independent.  Characters without a piece, and the space mark
itself where it stands in a text, become byte pieces, so decoding gives back every text exactly.

Input columns with the names of results give way to these.  Null texts are empty and have no pieces; decoding them gives the empty text.  Repeated rows get equal pieces.  Texts
are read whole.  Without dropout the result equals the library's.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowscope.llm.common import map_text, raw, texts
from rowscope.llm.stats import _BASE, _INV, _powers, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LONG = 200
_NONE = np.int32(2**31 - 1)
_C1, _C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_K = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Arrays of a merge-type model; small enough to travel with the task."""

    char: np.ndarray  # piece of a code point, -1 without
    pair_key: np.ndarray  # open addressing: left << 20 | right
    pair_id: np.ndarray
    probes: int
    rank: np.ndarray
    byte: np.ndarray  # piece of each byte
    data: np.ndarray  # bytes of all pieces
    start: np.ndarray
    dummy: bool

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read a model file; on the driver only."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece crosses words")
        byte = np.full(256, -1, np.int32)
        out = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                byte[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(MARK, " ").encode() if p in plain and plain[p] == i else b"")
        if (byte < 0).any():
            raise ValueError("the model has no byte pieces")
        char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1:
                char[ord(p)] = i
        char[32], char[ord(MARK)] = char[ord(MARK)], -1
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = plain.get(p[:k]), plain.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = i
        key, val, probes = _table(pairs)
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)
        start = np.cumsum([0, *map(len, out)])
        return Vocabulary(char, key, val, probes, rank, byte, np.frombuffer(b"".join(out), np.uint8), start, sp.encode("a", out_type=str)[0].startswith(MARK))

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, -1 without."""
        key = a.astype(np.int64) << 20 | b
        at = _slot(key, len(self.pair_key))
        out = np.full(len(key), -1, np.int32)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key, at = key[todo], at[todo]
        for _ in range(self.probes):
            have = self.pair_key[at]
            hit = have == key
            out[todo[hit]] = self.pair_id[at[hit]]
            go = ~hit & (have >= 0)
            if not go.any():
                break
            todo, key, at = todo[go], key[go], (at[go] + 1) & (len(self.pair_key) - 1)
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * _K) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    size = 1 << max(10, (4 * len(pairs)).bit_length())
    key, val = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    longest = 1
    slots = _slot(np.fromiter(pairs, np.int64, len(pairs)), size).tolist()
    for (k, v), at in zip(pairs.items(), slots, strict=True):
        n = 1
        while key[at] >= 0:
            at, n = (at + 1) & (size - 1), n + 1
        key[at], val[at], longest = k, v, max(longest, n)
    return key, val, longest + 1


def _skips(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    h = mix(key + place.astype(np.uint64) * np.uint64(_C1) + piece.astype(np.uint64) * np.uint64(_C2))
    return (h >> np.uint64(40)) < np.uint64(round(rate * (1 << 24)))


def _merge_flat(v: Vocabulary, sym: np.ndarray, word: np.ndarray, place: np.ndarray, key: np.ndarray, rate: float, done: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word of each) after all merges; ``word`` rises, ``place`` is a symbol's first character in its word.

    ``done`` gets the merges of each round as (word, place, piece).
    """
    done_s, done_w = [], []

    def pairs(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pairs that begin at i."""
        j = np.minimum(i + 1, len(sym) - 1)
        got = v.joined(np.where((j > i) & (word[i] == word[j]), sym[i], -1), sym[j])
        rank = np.where(got >= 0, v.rank[got], _NONE)
        if rate > 0:
            own = np.flatnonzero(got >= 0)
            rank[own[_skips(key[word[i[own]]], place[i[own]], got[own], rate)]] = _NONE
        return rank, got

    rank, got = pairs(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, first)
        live = best < _NONE
        size = np.diff(np.r_[first, len(sym)])
        if not live.all():
            stay = np.repeat(live, size)
            done_s.append(sym[~stay])
            done_w.append(word[~stay])
            sym, word, place, rank, got = sym[stay], word[stay], place[stay], rank[stay], got[stay]
            best, size = best[live], size[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]  # the leftmost of each word
        sym[hit] = got[hit]
        if done is not None:
            done.append((word[hit], place[hit], got[hit]))
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))
        sym, word, place, rank, got = sym[keep], word[keep], place[keep], rank[keep], got[keep]
        i = np.concatenate([at, at[(at > 0)] - 1])
        rank[i], got[i] = pairs(i)
    s, w = np.concatenate(done_s or [sym]), np.concatenate(done_w or [word])
    order = np.argsort(w, kind="stable")
    return s[order], w[order]


def _merge_long(v: Vocabulary, sym: list[int], key: int, rate: float) -> list[int]:
    """The same rule for one long word, with a heap: n log n."""
    n = len(sym)
    nxt, prv, sym = list(range(1, n + 1)), list(range(-1, n - 1)), list(sym)
    heap: list = []

    def push(ls: list[int]) -> None:
        ls = [i for i in ls if i >= 0 and nxt[i] < n]
        if not ls:
            return
        i = np.array(ls)
        a, b = np.array([sym[x] for x in ls], np.int32), np.array([sym[nxt[x]] for x in ls], np.int32)
        got = v.joined(a, b)
        ok = got >= 0
        if rate > 0 and ok.any():
            ok[ok] = ~_skips(np.full(ok.sum(), key, np.uint64), i[ok], got[ok], rate)
        for x in np.flatnonzero(ok):
            heapq.heappush(heap, (int(v.rank[got[x]]), ls[x], int(a[x]), int(b[x]), int(got[x])))

    push(list(range(n)))
    while heap:
        _, i, a, b, got = heapq.heappop(heap)
        j = nxt[i] if i < n else n
        if j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i], sym[j] = got, -9
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        push([prv[i], i])
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


def _merged(v: Vocabulary, cps: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, rate: float, done: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, pieces before each word) of the words of ``cps`` that begin at ``begin``."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    word = np.repeat(np.arange(len(size)), size)
    place = at - begin[word]
    cp = cps[at]
    sym = v.char[cp]
    sym = np.where(sym >= 0, sym, -2 - cp.astype(np.int32))  # without a piece: kept apart until all merges are done
    long = size > LONG
    fine = ~long[word]
    s, w = _merge_flat(v, sym[fine], word[fine], place[fine], key, rate, done)
    if long.any():
        ss, ww = [s], [w]
        for i in np.flatnonzero(long):
            a = ends[i] - size[i]
            got = _merge_long(v, sym[a : ends[i]].tolist(), int(key[i]), rate)
            ss.append(np.array(got, np.int32))
            ww.append(np.full(len(got), i))
        s, w = np.concatenate(ss), np.concatenate(ww)
        order = np.argsort(w, kind="stable")
        s, w = s[order], w[order]
    if (s < 0).any():  # byte pieces of characters without a piece
        c = np.where(s < 0, -2 - s, 0)
        wide = np.where(s >= 0, 1, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        lost = {int(x): list(chr(x).encode("utf-8")) for x in np.unique(c[s < 0])}
        spread = np.repeat(s, wide)
        first = np.cumsum(wide) - wide
        for x, bs in lost.items():
            i = first[s == -2 - x]
            for d, bb in enumerate(bs):
                spread[i + d] = v.byte[bb]
        s, w = spread, np.repeat(w, wide)
    return s, np.r_[0, np.cumsum(np.bincount(w, minlength=len(size)))]


def _skipping(done: list, n: int, back: np.ndarray, key: np.ndarray, rate: float, block: int = 1 << 18) -> np.ndarray:
    """Whether each occurrence, of word ``back``, skips one of its word's merges."""
    word, place, piece = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3
    order = np.argsort(word, kind="stable")
    place, piece = place[order], piece[order]
    count = np.bincount(word, minlength=n)
    head = np.cumsum(count) - count
    out = np.zeros(len(back), bool)
    for a in range(0, len(back), block):
        own = back[a : a + block]
        each = count[own]
        first = np.cumsum(each) - each
        of = np.repeat(np.arange(len(own)), each)
        at = (head[own] - first)[of] + np.arange(len(of))
        out[a + of[_skips(key[a : a + block][of], place[at], piece[at], rate)]] = True
    return out


def encode(v: Vocabulary, arr: pa.Array, rate: float = 0.1, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, offsets of each text)."""
    buf, off = raw(arr)
    n = len(off) - 1
    lead = (buf & 0xC0) != 0x80
    cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32) if len(buf) else np.zeros(0, np.uint32)
    chars = np.r_[0, np.cumsum(lead)][off]
    full = np.flatnonzero(np.diff(chars) > 0)
    # characters with a mark before each text that is not empty
    if v.dummy:
        cps = np.insert(cps, chars[full], 32)
        chars = chars + np.r_[0, np.cumsum(np.diff(chars) > 0)]
    total = len(cps)
    if not total:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    mark = cps == 32
    new = mark & ~np.r_[False, mark[:-1]]
    new[chars[:-1][full]] = True
    begin = np.flatnonzero(new)
    size = np.diff(np.r_[begin, total])
    text_of = np.searchsorted(chars, begin, side="right") - 1
    # different words once, without dropout
    run = np.zeros(total + 1, np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + np.uint64(7)) * _powers(_BASE, total), dtype=np.uint64, out=run[1:])
    word_hash = mix((run[begin + size] - run[begin]) * _powers(_INV, total)[begin] + size.astype(np.uint64))
    _, at, back = np.unique(word_hash, return_index=True, return_inverse=True)
    done: list | None = [] if rate > 0 else None
    s, first = _merged(v, cps, begin[at], size[at], word_hash[at], 0.0, done)
    if rate > 0:
        doc_hash = np.array([zlib.crc32(buf[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
        salt = np.uint64(seed * _C2 % 2**64)
        key = mix(word_hash + mix(doc_hash[text_of] * np.uint64(_C1) + (begin - chars[text_of]).astype(np.uint64) + salt))
        own = np.flatnonzero(_skipping(done, len(at), back, key, rate) | (size > LONG))
        s2, first2 = _merged(v, cps, begin[own], size[own], key[own], rate)
        back = back.copy()
        back[own] = len(at) + np.arange(len(own))  # words of their own
        s, first = np.concatenate([s, s2]), np.r_[first, first[-1] + first2[1:]]
    count = np.diff(first)
    each = count[back]
    out_first = np.cumsum(each) - each
    ids = s[np.repeat(first[:-1][back] - out_first, each) + np.arange(each.sum())]
    words_before = np.searchsorted(text_of, np.arange(n + 1))
    return ids.astype(np.int32), np.r_[out_first, each.sum()][words_before]


def decode(v: Vocabulary, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of piece lists."""
    size = (v.start[1:] - v.start[:-1])[ids]
    end = np.r_[0, np.cumsum(size)]
    data = v.data[np.repeat(v.start[:-1][ids] - end[:-1], size) + np.arange(end[-1])]
    out = end[off]
    if v.dummy:
        full = np.diff(out) > 0
        keep = np.ones(len(data), bool)
        keep[out[:-1][full]] = False  # the mark before each text
        data, out = data[keep], out - np.r_[0, np.cumsum(full)]
    return data, out


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", rate: float = 0.1, seed: int = 1) -> DataFrame:
    """All columns but the text, with ``pieces n_pieces decoded_crc32 lossless``: each text is decoded again and compared."""
    new = [("pieces", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("decoded_crc32", T.LongType()), ("lossless", T.BooleanType())]
    names = {n for n, _ in new}
    keep = [c for c in docs.columns if c != text and c not in names]
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, t in new)])

    def run(batch: pa.RecordBatch) -> dict:
        arr = texts(batch, text)
        ids, off = encode(vocabulary, arr, rate, seed)
        data, ends = decode(vocabulary, ids, off)
        buf, was = raw(arr)
        back = [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        same = [x == buf[a:b].tobytes() for x, a, b in zip(back, was[:-1], was[1:], strict=True)]
        return {"pieces": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids)), "n_pieces": np.diff(off), "decoded_crc32": [zlib.crc32(x) for x in back], "lossless": same}

    return map_text(docs.select(*keep, text), text, run, schema)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", out: str = "text") -> DataFrame:
    """All columns but the pieces, with the texts they decode to (null: empty)."""
    keep = [c for c in encoded.columns if c not in (pieces, out)]
    schema = T.StructType([*(encoded.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            lists = b.column(pieces)
            size = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            data, ends = decode(vocabulary, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(size)])
            got = pa.array([data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), got], names=[*keep, out])

    return encoded.select(*keep, pieces).mapInArrow(run, schema)
