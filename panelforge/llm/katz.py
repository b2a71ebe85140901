"""Katz backoff bigram model: Good-Turing discounts, exactly normalised backoff weights, scores of whole texts.

The work is laid out so that each text crosses the network only as small integers:

1. Word counts of the training texts are summed by 62-bit word hash into a written table (all words, all texts).
2. The VOCABULARY most frequent words get numbers, which are broadcast. All other words keep their hashes as codes and
   get their counts by a join with the table. The vocabulary decides only how compactly a bigram is written down: every
   bigram of every word is counted, discounted and backed off alike, at any number of distinct words.
3. One pass over all texts turns every token into (history, word, document, times): packed into sorted column blocks by
   part where both words have numbers, as rows otherwise. A part holds all that is counted and asked of its histories;
   histories are dealt to parts by their counts.
4. Frequent histories (more tokens than a part should have) are dealt by history and word instead, and their sums (a row
   a history and part) are added up before the backoff weights are taken.
5. Discounts come from the counts of counts of all parts. Each part then evaluates its tokens recursively (bigram, else
   weight times unigram, else the unknown word's mass) and sends its sums by document, packed by batch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import forget, written

VOCABULARY, DISCOUNTED, PART_TOKENS, BATCH, SLICE = 1 << 20, 5, 1_000_000, 8192, 1 << 22
BITS, DOC_BITS = 21, 13
#: Tokens of a part whose sums are taken at a time.
CHUNK = 1 << 17
#: Numbers beside those of words: the end of a text, its start (a history only). Codes of words without a number have FLAG set.
END, START, FLAG = (1 << BITS) - 2, (1 << BITS) - 3, 1 << 62
END_HASH = -1


def _tokens(texts) -> tuple[dict, list[np.ndarray]]:
    """Local numbers of the words of texts, and the words of each as an array."""
    local = defaultdict(counter().__next__)
    numbers = []
    for t in texts:
        ws = (t or "").encode("utf-8", "replace").lower().split()
        numbers.append(np.fromiter(map(local.__getitem__, ws), dtype=np.int32, count=len(ws)))
    return local, numbers


def _hashes(local: dict) -> np.ndarray:
    """62-bit hashes of words, so that none is END_HASH or has FLAG set."""
    return np.fromiter((xxhash.xxh64_intdigest(w) >> 2 for w in local), dtype=np.int64, count=len(local))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about SLICE bytes of text (column 1), BATCH rows at most; one row at least."""
    for b in batches:
        size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < b.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, min(int(np.searchsorted(size, before + SLICE)), at + BATCH, b.num_rows))
            yield b.slice(at, end - at)
            at = end


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c, tokens): training counts by word, and all tokens in the row of the end."""
    for b in _slices(batches):
        train = ~b.column(0).to_numpy(zero_copy_only=False)
        local, docs = _tokens(b.column(1).to_pylist())
        used = [d for d, t in zip(docs, train, strict=True) if t]
        c = np.bincount(np.concatenate(used), minlength=len(local)) if used else np.zeros(len(local), dtype=np.int64)
        seen = np.flatnonzero(c)
        word = np.concatenate([_hashes(local)[seen], [END_HASH]])
        c = np.concatenate([c[seen], [int(train.sum())]]).astype(np.int64)
        tokens = np.zeros(len(c), dtype=np.int64)
        tokens[-1] = sum(map(len, docs)) + len(docs)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(c), pa.array(tokens)], ["word", "c", "tokens"])


def good_turing(n: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """Katz's discount ratios of counts 0..k (0 unused) from counts of counts; above k none.

    Where the counts of counts give no ratio in (0, 1], as in tiny or copied texts, the ratio is that of
    absolute discounting by n1 / (n1 + 2 n2), at most 1/2.
    """
    n1, n2 = n.get(1, 0), n.get(2, 0)
    off = min(n1 / (n1 + 2 * n2), 0.5) if n1 else 0.5
    common = (k + 1) * n.get(k + 1, 0) / n1 if n1 else 1.0
    d = np.ones(k + 1)
    for r in range(1, k + 1):
        ratio = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common) if n.get(r) and common < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else 1 - off / r
    return d


class Unigrams:
    """The numbered words, their counts and discounted probabilities; what is broadcast."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int, of_counts: dict[int, int], end: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.total, self.types, self.end = total, types, end
        self.complete = types == len(words) + (end > 0)
        self.before = np.cumsum(self.counts) - self.counts
        self.d = good_turing(of_counts)
        unseen = 1 - sum(self.of(np.array([r]))[0] * m for r, m in of_counts.items() if r <= DISCOUNTED)
        unseen -= (total - sum(r * m for r, m in of_counts.items() if r <= DISCOUNTED)) / max(total, 1)
        self.unseen = max(unseen, 1.0 / (total + 1))
        self.scale = 1.0 if unseen > 0 else 1 - self.unseen

    @classmethod
    def shared(cls, shared) -> tuple["Unigrams", np.ndarray]:
        """From a broadcast of (state, numbers of frequent histories); plain data, as workers may lack this module."""
        u = cls.__new__(cls)
        u.__dict__ = shared.value[0]
        return u, shared.value[1]

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= DISCOUNTED, self.d[np.minimum(c, DISCOUNTED)], 1.0) * c / max(self.total, 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words with these training counts; the unknown word's mass where the count is 0."""
        return np.where(c > 0, self.of(c) * self.scale, self.unseen)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, else their hashes with FLAG set."""
        if not len(self.words):
            return hashes | FLAG
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, hashes | FLAG)

    def count(self, codes: np.ndarray, others: np.ndarray | int = 0) -> np.ndarray:
        """Training counts of codes; `others` are those of words without a number. A start comes as often as an end."""
        c = np.where(codes >= FLAG, others, 0)
        words = codes < START
        c[words] = self.counts[codes[words]]
        c[(codes == END) | (codes == START)] = self.end
        return c

    def part(self, h: np.ndarray, parts: int) -> np.ndarray:
        """Parts of histories: ranges of numbers with about equal counts; the others by hash."""
        out = h % parts
        words = h < START
        if len(self.words):
            out[words] = self.before[h[words]] * parts // (self.before[-1] + self.counts[-1])
        return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, each stored by planes of bytes, which compress well when sorted or small."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


_DOC, _TRAIN = (1 << DOC_BITS) - 1, 1 << DOC_BITS
#: Entries of a block: steps between codes, documents (ordinal of the batch, training bit, row in the batch), times.
_ENTRIES = ("<i8", "<u8", "<u4")
#: Entries with a word that has no number: history, word, the word's count, document, times.
_WIDE = ("<i8", "<i8", "<i8", "<u8", "<u4")


def _block(code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
    return _pack(np.diff(code, prepend=0), doc.astype("<u8"), times.astype("<u4"))


def _requests(batches: Iterator[pa.RecordBatch], shared, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one batch of texts and one part: sorted (history, word) codes, documents, times.

    A batch is known by a hash of its documents' keys, so that a task that runs again makes the same; the
    keys go along once, in a row of a negative part, with the entries of words that have no number.
    """
    u, hot_ids = Unigrams.shared(shared)
    for b in _slices(batches):
        train = ~b.column(0).to_numpy(zero_copy_only=False)
        local, docs = _tokens(b.column(1).to_pylist())
        key = b.column(2).to_numpy()
        code = u.code(_hashes(local))
        ids = [np.append(code[d], END) for d in docs]
        w = np.concatenate(ids)
        h = np.concatenate([np.append(START, x[:-1]) for x in ids])
        doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        batch = np.array([xxhash.xxh64_intdigest(key.tobytes()) >> 1], dtype="<i8").tobytes()
        place = lambda h, w, hot: np.where(hot, (h * 0x9E3779B1 + w * 0x85EBCA6B) % (1 << 61) % parts, u.part(h, parts))
        wide = (w >= FLAG) | (h >= FLAG)
        hw, ww = h[wide], w[wide]
        order = np.lexsort((ww, hw, doc[wide]))
        hw, ww, dw = hw[order], ww[order], doc[wide][order]
        new = np.flatnonzero(np.concatenate([[len(hw) > 0], (np.diff(hw) != 0) | (np.diff(ww) != 0) | (np.diff(dw) != 0)])[: len(hw)])
        hw, ww, dw, tw = hw[new], ww[new], dw[new], np.diff(np.append(new, len(hw)))
        hot = np.isin(hw, hot_ids)
        number = int.from_bytes(batch, "little")
        few = [{"part": int(p), "hot": bool(o), "batch": number, "h": int(x), "w": int(y), "doc": int(d), "train": bool(train[d]), "times": int(t)} for p, o, x, y, d, t in zip(place(hw & (FLAG - 1), ww & (FLAG - 1), hot), hot, hw, ww, dw, tw, strict=True)]
        rows = [(-1, False, len(key), _pack(key), batch, few)]
        whole, times = np.unique((h[~wide] << (BITS + DOC_BITS)) | (w[~wide] << DOC_BITS) | doc[~wide], return_counts=True)
        first, second = whole >> (BITS + DOC_BITS), (whole >> DOC_BITS) & ((1 << BITS) - 1)
        hot = np.isin(first, hot_ids)
        part = 2 * place(first, second, hot) + hot
        order = np.argsort(part, kind="stable")
        whole, times, part = whole[order], times[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(whole)], strict=True):
            if lo < hi:
                own = whole[lo:hi] & _DOC
                rows.append((int(part[lo]) // 2, bool(part[lo] % 2), hi - lo, _block(whole[lo:hi] >> DOC_BITS, own | np.where(train[own], _TRAIN, 0), times[lo:hi]), batch, None))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], [*_NAMES, "wide"])


_NAMES = ["part", "hot", "n", "entries", "batches"]
_ENTRY = [("part", pa.int64()), ("hot", pa.bool_()), ("batch", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("train", pa.bool_()), ("times", pa.int64())]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct(_ENTRY))]
_REQUEST = "part long, hot boolean, n long, entries binary, batches binary"
_WIDE_ENTRY = "array<struct<part:long,hot:boolean,batch:long,h:long,w:long,doc:long,train:boolean,times:long>>"


class Part:
    """The tokens asked of one part and its bigrams' training counts."""

    def __init__(self, code: np.ndarray, doc: np.ndarray, times: np.ndarray, batches: np.ndarray, wide: list[np.ndarray]):
        self.code, self.narrow, self.wide, self.batches = code, (doc, times), wide, batches
        new = np.append(True, code[1:] > code[:-1])[: len(code)]
        bigrams, at = code[new], np.cumsum(new, dtype=np.int32)
        at -= 1
        hw, ww, cw, dw, tw = wide
        order = np.lexsort((ww, hw))
        hw, ww, cw, dw, tw = (x[order] for x in (hw, ww, cw, dw, tw))
        new = np.concatenate([[True], (np.diff(hw) != 0) | (np.diff(ww) != 0)])[: len(hw)]
        self.h = np.concatenate([bigrams >> BITS, hw[new]])
        self.w = np.concatenate([bigrams & ((1 << BITS) - 1), ww[new]])
        self.other = np.concatenate([np.zeros(len(bigrams), dtype=np.int64), cw[new]])
        self.at = np.concatenate([at, (len(bigrams) + np.cumsum(new) - 1).astype(np.int32)])
        del at
        self.doc, self.times = (np.concatenate([doc, dw]), np.concatenate([times, tw.astype(times.dtype)])) if len(dw) else (doc, times)
        self.count = np.zeros(len(self.h), dtype=np.int64)
        for own in self.chunks():
            # places rise along the tokens, so a chunk has a range of them
            at = self.at[own]
            counted = np.bincount(at - at[0], weights=self.times[own] * ((self.doc[own] & _TRAIN) > 0))
            self.count[at[0] : at[0] + len(counted)] += counted.astype(np.int64)

    def chunks(self) -> Iterator[slice]:
        return (slice(lo, lo + CHUNK) for lo in range(0, len(self.at), CHUNK))

    def by_document(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ordinal of the batch and row in it, sum of the logs of its tokens) of each document, from those of the bigrams."""
        own = self.doc >> (DOC_BITS + 1)
        own <<= DOC_BITS
        for chunk in self.chunks():
            own[chunk] |= self.doc[chunk] & _DOC
        own.sort()
        docs = own[np.append(True, own[1:] > own[:-1])[: len(own)]]
        del own
        added = np.zeros(len(docs))
        for chunk in self.chunks():
            key, x = ((self.doc[chunk] >> (DOC_BITS + 1)) << DOC_BITS) | (self.doc[chunk] & _DOC), self.times[chunk] * logs[self.at[chunk]]
            key, at = np.unique(key, return_inverse=True)
            added[np.searchsorted(docs, key)] += np.bincount(at, weights=x)
        return docs, added

    @classmethod
    def gathered(cls, rows: pd.DataFrame, few: pd.DataFrame) -> "Part":
        """From the blocks of all batches and the rows of words without a number."""
        code, doc, times, batches = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype="<u4")], []
        for n, entries, ids in zip(rows["n"], rows["entries"], rows["batches"], strict=True):
            step, d, t = _unpack(entries, n, *_ENTRIES)
            code.append(np.cumsum(step))
            doc.append(d.astype(np.int64) + (len(batches) << (DOC_BITS + 1)))
            times.append(t)
            batches += np.frombuffer(ids, dtype="<i8").tolist()
        # one column after the other, so that each is held once
        code = np.concatenate(code)
        doc = np.concatenate(doc)
        times = np.concatenate(times)
        order = np.argsort(code, kind="stable")
        code = code[order]
        doc = doc[order]
        times = times[order]
        del order
        own, ordinal = np.unique(few["batch"].to_numpy(dtype=np.int64), return_inverse=True)
        dw = ((ordinal + len(batches)) << (DOC_BITS + 1)) | few["doc"].to_numpy(dtype=np.int64) | np.where(few["train"].to_numpy(dtype=bool), _TRAIN, 0)
        wide = [few["h"].to_numpy(dtype=np.int64), few["w"].to_numpy(dtype=np.int64), few["c"].to_numpy(dtype=np.int64), dw, few["times"].to_numpy(dtype=np.int64)]
        return cls(code, doc, times, np.array([*batches, *own.tolist()], dtype="<i8"), wide)

    def packed(self) -> tuple[int, bytes, bytes, int, bytes]:
        kinds = [x.astype(k) for x, k in zip(self.wide, _WIDE, strict=True)]
        return len(self.code), _block(self.code, *self.narrow), self.batches.tobytes(), len(self.wide[0]), _pack(*kinds)

    @classmethod
    def unpacked(cls, n: int, entries: bytes, batches: bytes, m: int, wide: bytes) -> "Part":
        """To be scored: without the columns that only `packed` needs."""
        step, doc, times = _unpack(entries, n, *_ENTRIES)
        step = np.cumsum(step)
        part = cls(step, doc.view(np.int64), times, np.frombuffer(batches, dtype="<i8"), [x.astype(np.int64) for x in _unpack(wide, m, *_WIDE)])
        part.code = part.narrow = part.wide = None
        return part

    def sums(self, u: Unigrams) -> pd.DataFrame:
        """By history: bigrams by count 1..DISCOUNTED, tokens of larger counts, all tokens, and the unigram mass of its words."""
        seen = self.count > 0
        h, at = np.unique(self.h[seen], return_inverse=True)
        c, p = self.count[seen], u.p(u.count(self.w[seen], self.other[seen]))
        add = lambda weights: np.bincount(at, weights=weights, minlength=len(h))
        return pd.DataFrame({"h": h, **{f"n{r}": add(c == r) for r in range(1, DISCOUNTED + 1)}, "large": add(c * (c > DISCOUNTED)), "tokens": add(c), "mass": add(p)})


_COUNTED = f"{_REQUEST}, m long, wide binary, of_counts array<long>, sums array<array<double>>"


def _count_bigrams(key: tuple, rows: pd.DataFrame, few: pd.DataFrame, u: Unigrams) -> pd.DataFrame:
    """The blocks and rows of a part as one, with its counts of counts and, if hot, the sums of its histories."""
    part = Part.gathered(rows, few)
    of = np.bincount(np.minimum(part.count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()
    sums = part.sums(u).to_numpy().tolist() if key[1] else []
    n, entries, batches, m, wide = part.packed()
    return pd.DataFrame([(*key, n, entries, batches, m, wide, of, sums)], columns=[*_NAMES, "m", "wide", "of_counts", "sums"])


def weights(sums: pd.DataFrame, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of histories, exactly normalised.

    What a history's discounted bigrams leave goes to the unseen words in proportion to their unigram
    probabilities. Where nothing is left (no small count), the denominator grows by one.
    """
    star = sum(d[r] * r * sums[f"n{r}"].to_numpy() for r in range(1, DISCOUNTED + 1)) + sums["large"].to_numpy()
    totals = sums["tokens"].to_numpy()
    below = np.where(totals - star > 1e-9 * totals, totals, totals + 1).astype(float)
    left = 1 - star / below
    free = 1 - sums["mass"].to_numpy()
    return below, np.where(free > 1e-12, left / np.maximum(free, 1e-12), 1.0)


_SCORED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])


def _score_part(batches: Iterator[pa.RecordBatch], shared, d: np.ndarray, hot: pd.DataFrame | None, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, batch, n, sums): what a part adds to the documents of each batch, packed; keys of batches pass (no sums)."""
    u, _ = Unigrams.shared(shared)
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            if row["part"] < 0:
                batch = int.from_bytes(row["batches"], "little")
                yield pa.RecordBatch.from_pydict({"bucket": [batch % buckets], "batch": [batch], "n": [-row["n"]], "sums": [row["entries"]]}, _SCORED)
                continue
            part = Part.unpacked(row["n"], row["entries"], row["batches"], row["m"], row["wide"])
            if not len(part.h):
                continue
            sums = hot if row["hot"] else part.sums(u)
            below, alpha = weights(sums, d)
            known = sums["h"].to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, part.h), max(len(known) - 1, 0))
            there = known[at] == part.h if len(known) else np.zeros(len(part.h), dtype=bool)
            over, under = (np.where(there, x[at], 1.0) if len(known) else np.ones(len(part.h)) for x in (alpha, below))
            c = part.count
            star = np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], 1.0) * c / under
            logs = np.log10(np.where(c > 0, star, over * u.p(u.count(part.w, part.other))))
            del at, there, over, under, star
            docs, added = part.by_document(logs)
            ordinal = docs >> DOC_BITS
            groups = np.split(np.arange(len(docs)), np.flatnonzero(np.diff(ordinal)) + 1)
            batch = [int(part.batches[ordinal[g[0]]]) for g in groups]
            yield pa.RecordBatch.from_pydict({"bucket": [x % buckets for x in batch], "batch": batch, "n": [len(g) for g in groups],
                                              "sums": [_pack((docs[g] & _DOC).astype("<u2"), added[g].astype("<f8")) for g in groups]}, _SCORED)


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """Total score of each document of a bucket of batches; equal batches (equal documents) are one, with their sums doubled."""
    keys = {b: _unpack(data, -n, "<i8")[0] for b, n, data in zip(pdf["batch"], pdf["n"], pdf["sums"], strict=True) if n < 0}
    total = {b: np.zeros(len(k)) for b, k in keys.items()}
    for b, n, data in zip(pdf["batch"], pdf["n"], pdf["sums"], strict=True):
        if n > 0:
            at, x = _unpack(data, n, "<u2", "<f8")
            total[b][at] += x
    return pd.DataFrame({"key": np.concatenate(list(keys.values())), "part_score": np.concatenate(list(total.values()))})


def _describe(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Per document: tokens, known tokens, base score and the rare words (word, times), which are not counted in yet."""
    u, _ = Unigrams.shared(shared)
    for b in _slices(batches):
        local, docs = _tokens(b.column(1).to_pylist())
        hashes = _hashes(local)
        code = u.code(hashes)
        c = u.count(code)
        floor = u.total + 0.5 * (u.types + 1)
        logs = np.where(code >= FLAG, 0.0, np.log10((c + 0.5) / floor))
        end = float(np.log10((u.end + 0.5) / floor))
        n, known, base, rare = [], [], [], []
        for d in docs:
            x = code[d]
            n.append(len(d) + 1)
            known.append(int((x < FLAG).sum()) + (u.end > 0))
            base.append(float(logs[d].sum()) + end)
            w, t = np.unique(d[x >= FLAG], return_counts=True)
            rare.append([{"word": int(hashes[i]), "times": int(k)} for i, k in zip(w, t, strict=True)])
        kind = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, kind)],
                                         ["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare"])


def _numbered(counts: DataFrame, types: int, vocabulary: int) -> pa.Table:
    """The most frequent words, at most `vocabulary`: all with a count of at least a bound found from a histogram.

    Words that tie at the bound are all left out if there is no room for them all, even if that leaves none.
    """
    top = 1 << 16
    edge = F.when(F.col("c") <= top, F.col("c")).otherwise((F.lit(float(top)) * F.pow(F.lit(2.0), F.floor(F.log2(F.col("c") / top)))).cast("long"))
    bound, words = 1, 0
    if types > vocabulary:
        bound = (1 << 63) - 1
        for least, n in counts.groupBy(edge.alias("edge")).count().orderBy(F.desc("edge")).collect():
            if words + n > vocabulary:
                break
            bound, words = least, words + n
    return counts.where((F.col("c") >= bound) & (F.col("word") != END_HASH)).toArrow()


def katz_scores(docs: DataFrame, held_out, vocabulary: int = VOCABULARY, part_tokens: int = PART_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text with A-Z lower-cased and an end; null texts are empty (an end only).
    `held_out` is a boolean column; the other rows are learned from, all of them, repeated rows each. Rows
    with equal id and text have one score. Without any training text every token is unknown. An empty table
    gives an empty result; other columns are ignored. `vocabulary` (a bound on what is broadcast; ties at
    its edge are left out) and `part_tokens` change the layout of the work only, not a score.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("held_out"), text.alias("text"), F.xxhash64(F.lit(7), doc_id, text).alias("key"), doc_id.alias("doc_id"))
    counted = rows.select("held_out", "text").mapInArrow(_count_words, "word long, c long, tokens long")
    table = written(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("tokens").alias("tokens")))
    counts = table.where("c > 0").select("word", "c")
    total, types, all_tokens = (x or 0 for x in table.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.sum("tokens")).first())
    end = (counts.where(F.col("word") == END_HASH).first() or (0, 0))[1]
    of_counts = {r: m for r, m in counts.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").count().collect()}
    words = _numbered(counts, types, vocabulary)
    u = Unigrams(words["word"].to_numpy().astype(np.int64), words["c"].to_numpy().astype(np.int64), total, types, of_counts, end)
    parts = max(8, -(-all_tokens // part_tokens))
    hot_ids = np.flatnonzero(u.counts * parts > max(total, 1))
    if end * parts > max(total, 1):
        hot_ids = np.append(hot_ids, START)
    shared = spark.sparkContext.broadcast((vars(u), hot_ids))
    requests = written(rows.select("held_out", "text", "key").mapInArrow(lambda b: _requests(b, shared, parts), f"{_REQUEST}, wide {_WIDE_ENTRY}"))
    few = requests.where("part < 0").select(F.explode("wide").alias("x")).select("x.*")
    own = F.when(F.col("w") >= FLAG, F.col("w").bitwiseAND(FLAG - 1))
    few = few.withColumn("word", own).join(counts, "word", "left").select("part", "hot", "h", "w", "batch", "doc", "train", "times", F.coalesce("c", F.lit(0)).alias("c"))
    blocks = requests.where("part >= 0").select(*_NAMES)
    bigrams = written(blocks.groupBy("part", "hot").cogroup(few.groupBy("part", "hot")).applyInPandas(_counter(shared), _COUNTED))
    of = bigrams.select(F.posexplode("of_counts").alias("r", "m")).groupBy("r").agg(F.sum("m")).collect()
    d = good_turing({r + 1: m for r, m in of})
    names = ["h", *[f"n{r}" for r in range(1, DISCOUNTED + 1)], "large", "tokens", "mass"]
    sums = bigrams.select(F.explode("sums").alias("s")).select(*[F.col("s")[i].alias(c) for i, c in enumerate(names)])
    # at most one row a numbered word, far fewer in practice
    hot = sums.groupBy("h").agg(*[F.sum(c).alias(c) for c in names[1:]]).toPandas().sort_values("h").reset_index(drop=True)
    keys = written(requests.where("part < 0").select(*_NAMES))
    forget(requests)
    keys = keys.select(*_NAMES, F.lit(0).cast("long").alias("m"), F.lit(None).cast("binary").alias("wide"))
    scored = bigrams.select(*_NAMES, "m", "wide").unionByName(keys).mapInArrow(lambda b: _score_part(b, shared, d, hot, parts), "bucket long, batch long, n long, sums binary")
    scores = scored.groupBy("bucket").applyInPandas(lambda pdf: _add_up(pdf), "key long, part_score double").groupBy("key").agg(F.sum("part_score").alias("total_score"))

    described = rows.mapInArrow(lambda b: _describe(b, shared), "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, rare array<struct<word:long,times:long>>")
    floor = total + 0.5 * (types + 1)
    unknown = float(np.log10(0.5 / floor))
    if u.complete:
        times = F.aggregate("rare", F.lit(0).cast("long"), lambda acc, x: acc + x["times"])
        per = described.withColumn("base_score", F.col("base_score") + times * unknown).drop("rare")
    else:
        described = written(described)
        c = F.col("c")
        asked = described.select("key", F.explode("rare").alias("x")).select("key", "x.word", "x.times").join(counts, "word", "left")
        tail = asked.groupBy("key").agg(
            F.sum(F.when(c.isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"),
            F.sum(F.col("times") * F.when(c.isNotNull(), F.log10((c + 0.5) / floor)).otherwise(unknown)).alias("tail_base"),
        )
        # equal rows ask once each, so their sums are shared out among them
        same = described.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
        per = described.drop("rare").join(same, "key").join(tail, "key", "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce((F.col("tail_known") / F.col("copies")).cast("long"), F.lit(0)),
            "base_score": F.col("base_score") + F.coalesce(F.col("tail_base") / F.col("copies"), F.lit(0.0)),
        }).drop("copies")
    copies = Window.partitionBy("key")
    return per.join(scores, "key").withColumn("copies", F.count(F.lit(1)).over(copies)).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", (F.col("total_score") / F.col("copies")).alias("score"),
    )


def _counter(shared):
    def count(key: tuple, rows: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        return _count_bigrams(key, rows, few, Unigrams.shared(shared)[0])

    return count


def op7_katz(spark, sf_dir: str) -> DataFrame:
    """Scores of all of `documents`, learned from the rows whose crc32 remainder is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return katz_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
