"""Byte-level BPE encoding and decoding: greedy proposals, vectorised checks of adjacent tokens, exact merging for the rest.

A sequence of tokens is the encoding of a word exactly when every token encodes to itself and every two neighbours stay
apart when they are encoded together: up to the first merge across some border, all merges lie inside tokens and come in
the same order as in the two neighbours alone, so that merge would happen in the pair as well. Longest matches are cheap
and nearly always pass; a word of which one pair fails is merged pair by pair.
"""

from __future__ import annotations

import heapq
import json
import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import by_bytes

#: Fixed value: the pattern that parts text into words before merging, of the byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text is taken in slices of about SLICE bytes and cut after CUT characters where no word can span the cut; a task remembers
#: KEPT words of LONGEST characters at most.
SLICE, CUT, KEPT, LONGEST = 1 << 20, 1 << 20, 1 << 18, 64
NO_RANK = np.iinfo(np.int64).max // 2


class Tables(NamedTuple):
    """A vocabulary as plain tables, which travel to the tasks: a row a token, by id, and a row a merge, by key."""

    tokens: list[bytes]
    sound: np.ndarray  # the token's own bytes encode to it
    halves: np.ndarray  # what its last merge joined
    rank: np.ndarray  # when that merge comes; -1: a single byte
    keys: np.ndarray  # left * 2^32 + right, sorted
    ranks: np.ndarray
    made: np.ndarray
    special: dict[str, int]


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merged(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int, int]]:
    """Exact merging, lowest rank first, leftmost among equals; also the last merge as (left, right, rank)."""
    n, last = len(ids), (0, 0, -1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at = list(ids)
    queue = [(r[0], i, at[i], at[i + 1]) for i in range(n - 1) if (r := pairs.get((at[i], at[i + 1])))]
    heapq.heapify(queue)
    while queue:
        rank, i, left, right = heapq.heappop(queue)
        j = after[i]
        if at[i] != left or j >= n or at[j] != right:
            continue
        last = (left, right, rank)
        at[i], at[j] = pairs[left, right][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if r := pairs.get((at[i], at[after[i]])):
                heapq.heappush(queue, (r[0], i, at[i], at[after[i]]))
        if before[i] >= 0 and (r := pairs.get((at[before[i]], at[i]))):
            heapq.heappush(queue, (r[0], before[i], at[before[i]], at[i]))
    return [t for t in at if t >= 0], last


def _merge_all(t: Tables, words: list[bytes], single: np.ndarray) -> list[bytes]:
    """Exact merging of many short words in step: in each round every word makes its first merge of lowest rank.

    All words lie in one array, a border after each. A round takes the least rank of each word, merges at its leftmost
    place, and looks up the two pairs that are new; words without a merge leave.
    """
    if not words:
        return []
    ids = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    ends = np.cumsum([len(w) for w in words])
    out: list[bytes] = [b""] * len(words)
    number = np.arange(len(words))
    rank, made = _ranked(t, ids, np.append(ids[1:], 0))
    rank[ends - 1] = NO_RANK
    while len(number):
        starts = np.append(0, ends[:-1])
        least = np.minimum.reduceat(rank, starts)
        over = least == NO_RANK
        for k in np.flatnonzero(over).tolist():
            out[number[k]] = ids[starts[k] : ends[k]].astype("<u4").tobytes()
        here = np.flatnonzero(rank == np.repeat(np.where(over, -1, least), ends - starts))
        here = here[np.unique(np.searchsorted(ends, here, side="right"), return_index=True)[1]]  # leftmost of each word
        inner = ~np.isin(here + 1, ends - 1)
        ids[here] = made[here]
        gone = np.zeros(len(ids), dtype=bool)
        gone[here + 1] = True
        gone[np.flatnonzero(np.repeat(over, ends - starts))] = True
        size = ends - starts - ~over
        rank[here] = NO_RANK
        after, before = here[inner], here[~np.isin(here, starts)]
        rank[after], made[after] = _ranked(t, ids[after], ids[after + 2])
        rank[before - 1], made[before - 1] = _ranked(t, ids[before - 1], ids[before])
        ids, rank, made = ids[~gone], rank[~gone], made[~gone]
        number, ends = number[~over], np.cumsum(size[~over])
    return out


def _ranked(t: Tables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of the merges of pairs; NO_RANK where there is none."""
    key = (left << 32) + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    return np.where(t.keys[at] == key, t.ranks[at], NO_RANK), t.made[at]


def load_tables(path: str) -> Tables:
    """Read a byte-level BPE file on the driver; its size is that of a vocabulary, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], _alphabet()
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    parted = spec.get("pre_tokenizer") or {}
    if odd or model["type"] != "BPE" or model.get("ignore_merges") or spec.get("normalizer") or parted.get("type") != "ByteLevel" or parted.get("add_prefix_space") or not parted.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE vocabulary: {path} {odd}")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (1 + max([*model["vocab"].values(), *special.values()]))
    for text, i in model["vocab"].items():
        tokens[i] = bytes(byte[c] for c in text)
    known = {t: i for i, t in enumerate(tokens) if t}
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        a, b = (bytes(byte[c] for c in x) for x in (a, b))
        pairs.setdefault((known[a], known[b]), (rank, known[a + b]))
    single = [known[bytes([b])] for b in range(256)]
    halves, rank = np.zeros((len(tokens), 2), dtype=np.int64), np.full(len(tokens), -1, dtype=np.int64)
    sound = np.zeros(len(tokens), dtype=bool)
    for i, t in enumerate(tokens):
        if t:
            ids, (*halves[i], rank[i]) = _merged([single[b] for b in t], pairs)
            sound[i] = ids == [i]
    for text, i in special.items():
        tokens[i] = text.encode()
    order = sorted(pairs)
    columns = [np.array(x, dtype=np.int64) for x in ([(a << 32) + b for a, b in order], [pairs[p][0] for p in order], [pairs[p][1] for p in order])]
    return Tables(tokens, sound, halves, rank, *columns, special)


def compatible(t: Tables, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For pairs of sound tokens: whether encoding their joined bytes gives just these two.

    Both tokens are taken apart again, the later merge first (of equal ranks the right one's, as the leftmost comes
    first). At each step a merge of the two parts that meet at the border must not have come before the one undone.
    All pairs go at once; a step is a lookup in the sorted merges.
    """
    fine = np.ones(len(left), dtype=bool)
    rows, l, r = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
    limit = np.full(len(left), NO_RANK, dtype=np.int64)
    while len(rows):
        bad = _ranked(t, l, r)[0] < limit
        fine[rows[bad]] = False
        left_rank, right_rank = t.rank[l], t.rank[r]
        on = ~bad & ((left_rank >= 0) | (right_rank >= 0))
        rows, l, r, left_rank, right_rank = rows[on], l[on], r[on], left_rank[on], right_rank[on]
        undo_right = right_rank >= left_rank
        limit = np.where(undo_right, right_rank + 1, left_rank)
        l, r = np.where(undo_right, l, t.halves[l, 1]), np.where(undo_right, t.halves[r, 0], r)
    return fine


class Encoder:
    """Encodes words with the tables of one vocabulary; lives in a task."""

    def __init__(self, t: Tables):
        self.t = t
        self.longest: dict[bytes, int] = {}
        for i in np.flatnonzero(t.sound).tolist():
            for n in range(1, len(t.tokens[i])):
                self.longest.setdefault(t.tokens[i][:n], -1)
            self.longest[t.tokens[i]] = i
        self.pairs = {(k >> 32, k & 0xFFFFFFFF): (r, m) for k, r, m in zip(t.keys.tolist(), t.ranks.tolist(), t.made.tolist(), strict=True)}
        self.words = regex.compile(WORDS)
        self.cuts = regex.compile(r"(?<=\S) (?=\S)")
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(t.special, key=len, reverse=True))) + ")") if t.special else None
        self.kept: dict[str, bytes] = {}
        self.merged = 0

    def propose(self, word: bytes) -> list[int]:
        """Longest sound tokens from the left; every byte is one, so there is always a match."""
        ids, i, longest = [], 0, self.longest
        while i < len(word):
            end, best = i + 1, longest[word[i : i + 1]]
            n = i + 1
            while n < len(word) and (t := longest.get(word[i : n + 1])) is not None:
                n += 1
                if t >= 0:
                    end, best = n, t
            ids.append(best)
            i = end
        return ids

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of distinct words, as little-endian unsigned 32-bit integers."""
        words = list(words)
        proposed = [self.propose(w.encode()) for w in words]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((i for ids in proposed for i in ids), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, where = np.unique((flat[inside] << 32) + flat[inside + 1], return_inverse=True)
        fine = compatible(self.t, pairs >> 32, pairs & 0xFFFFFFFF)
        out = dict(zip(words, (np.array(ids, dtype="<u4").tobytes() for ids in proposed), strict=True))
        single = [self.longest[bytes([b])] for b in range(256)]
        failed = [words[k] for k in np.unique(owner[inside][~fine[where]]).tolist()]
        short = [w for w in failed if len(w) <= LONGEST]
        out.update(zip(short, _merge_all(self.t, [w.encode() for w in short], np.array(single)), strict=True))
        for w in failed:
            if len(w) > LONGEST:
                out[w] = np.array(_merged([single[b] for b in w.encode()], self.pairs)[0], dtype="<u4").tobytes()
        self.merged += len(failed)
        return out

    def _runs(self, text: str) -> Iterator[str]:
        """A text in runs that no word spans: cut at single blanks between other characters."""
        at = 0
        while len(text) - at > CUT and (m := self.cuts.search(text, at + CUT)):
            yield text[at : m.start()]
            at = m.start()
        if at < len(text):
            yield text[at:]

    def _pieces(self, texts: list[str]) -> Iterator[tuple[int, str | None, list[str]]]:
        """(text number, special token or none, words): texts in order, in pieces of bounded size."""
        for i, text in enumerate(texts):
            for k, part in enumerate(self.parts.split(text) if self.parts else [text]):
                if k % 2:
                    yield i, part, []
                else:
                    for run in self._runs(part):
                        yield i, None, self.words.findall(run)

    def _join(self, pieces: list, out: list[list[bytes]]) -> None:
        """Encode the words of some pieces that are not remembered, and add all to their texts."""
        new = self.encode_words(set().union(*(ws for *_, ws in pieces)).difference(self.kept))
        self.kept.update(new)
        for i, special, ws in pieces:
            out[i].append(np.array([self.t.special[special]], dtype="<u4").tobytes() if special else b"".join(map(self.kept.__getitem__, ws)))
        if len(self.kept) > KEPT:
            self.kept.clear()
        for w in new:
            if len(w) > LONGEST:
                self.kept.pop(w, None)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts; strings of special tokens stand for those tokens."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for piece in self._pieces(texts):
            held.append(piece)
            size += len(piece[2])
            if size >= CUT // 4:
                self._join(held, out)
                held, size = [], 0
        self._join(held, out)
        return [b"".join(x) for x in out]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens): each whole text as token ids, `ids` being little-endian unsigned 32-bit integers.

    The result is that of the tokenizers library without added special tokens, truncation or padding; a special token's
    string in a text is that token, as there. Null counts as the empty text, which has no tokens. Rows are independent:
    repeated rows give repeated results, a null id stays null, an empty table gives an empty result, other columns are
    ignored. Nothing is shuffled; a task holds one slice of texts, the vocabulary and a bounded memory of words.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(load_tables(path)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in by_bytes(batches, 1, SLICE):
            encoder = encoder or Encoder(pickle.loads(shipped.value))
            ids = encoder.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary, n_tokens long")


def bpe_decode(tokens: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """The input with its ids read back as text in the column `into`, which takes the place of one of that name.

    Bytes that are not UTF-8 become replacement characters, and ids that the vocabulary lacks are left out, as in the
    library. Null ids give null. Special tokens are written out.
    """
    shipped = tokens.sparkSession.sparkContext.broadcast(pickle.dumps(load_tables(path).tokens))
    rows = tokens.drop(into) if into != ids_col else tokens
    place = rows.columns.index(ids_col)
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for b in by_bytes(batches, place, SLICE):
            known = known or pickle.loads(shipped.value)
            texts = []
            for ids in b.column(place).to_pylist():
                some = None if ids is None else np.frombuffer(ids, dtype="<u4").tolist()
                texts.append(None if some is None else b"".join([known[i] for i in some if i < len(known)]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(decode, schema)


def op11_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded again with the public byte-level vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = bpe_decode(bpe_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
