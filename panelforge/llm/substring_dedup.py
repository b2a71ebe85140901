"""Repeated substrings across documents: common-prefix interval trees over suffix arrays of anchors.

Every string of LENGTH bytes holds an anchor: the least hash of its GRAM-byte grams, found by winnowing, a choice that
depends on the string alone. So two equal strings share an anchor at the same place in them, and only suffixes that
start at anchors need to be sorted. Occurrences of an anchor with the same context (REACH bytes before, LENGTH from it)
are one class, counted with map-side combine; a class of two or more is covered as it stands. What is left are anchors
with several classes, one of them single: the edges of repeated passages. Their contexts are sorted into a suffix
array by anchor, and a stack scan of its common prefixes lists all right-maximal repeats with all their occurrences;
the same scan over the left contexts keeps those that cannot be extended to the left either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import written

LENGTH, GRAM = 200, 40
REACH, WINDOW = LENGTH - GRAM, LENGTH - GRAM + 1
#: Texts are hashed in chunks of about so many bytes; longer texts in overlapping segments.
CHUNK, OVERLAP = 1 << 19, 512
#: Anchors with more classes than this are settled by window hashes instead, which no group has to be gathered for.
GROUP = 16384
#: Groups of more occurrences that may lie in a repeat are scanned by arrays.
FEW = 24
NO_ID = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any ranges of a byte array, by two polynomials modulo 2^64."""

    def __init__(self, data: np.ndarray, polynomials: int = 2):
        n = len(data) + 1
        self.parts = []
        for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:polynomials]:
            up = np.full(n, base, dtype=np.uint64)
            down = np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            sums = np.zeros(n, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            self.parts.append((sums, down))

    def of(self, a, b, polynomials: int = 2) -> np.ndarray:
        out = np.uint64(0)
        for sums, down in self.parts[:polynomials]:
            out = _mix(out ^ ((sums[b] - sums[a]) * down[a]))
        return out


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) of each run of `width` values."""
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, x[-1], dtype=x.dtype)]).reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[bytes], contexts: bool = True) -> tuple[np.ndarray, ...]:
    """(text, place, anchor hash, context hash, bytes before, bytes from it) of the anchors of texts of some bytes in all.

    Without `contexts` the last three are left out.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < LENGTH:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6 if contexts else 3))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    hashes = Hashes(data, 2 if contexts else 1)
    at = np.arange(len(data) - GRAM + 1)
    gram = np.maximum(hashes.of(at, at + GRAM, 1), np.uint64(1))
    least = _sliding(gram, WINDOW, np.minimum)
    least[owner[: len(least)] != owner[LENGTH - 1 :]] = 0  # strings that reach over a text's end
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    p = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == gram)
    text = owner[p]
    begin = np.where(text > 0, ends[text - 1], 0)
    if not contexts:
        return text, p - begin, gram[p].view(np.int64)
    a, b = np.maximum(begin, p - REACH), np.minimum(ends[text], p + LENGTH)
    context = _mix(hashes.of(a, b) ^ (((p - a) << 16) | (b - p)).astype(np.uint64))
    return text, p - begin, gram[p].view(np.int64), context.view(np.int64), p - a, b - p


def _pieces(texts) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (text, start, first place to keep, bytes) of about CHUNK bytes; long texts as overlapping segments."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(len(t), 1), CHUNK):
            a = max(0, s - OVERLAP)
            piece = t[a : s + CHUNK + OVERLAP]
            held.append((i, a, s, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


_ANCHOR = "doc_id long, th long, h long, c long, before int, after int, places array<long>"


def _found(batches: Iterator[pa.RecordBatch], contexts: bool = True) -> Iterator[tuple]:
    """(id, text hash, anchor, [context, bytes before, bytes from it,] place) of all anchors, by chunk."""
    for b in batches:
        ids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
        for pieces in _pieces(b.column(2).to_pylist()):
            piece, pos, *of = anchors([x[3] for x in pieces], contexts)
            doc = np.array([x[0] for x in pieces])[piece]
            pos = pos + np.array([x[1] for x in pieces])[piece]
            first = np.array([x[2] for x in pieces])[piece]
            own = np.flatnonzero((pos >= first) & (pos < first + CHUNK))
            if len(own):
                yield ids[doc[own]], ths[doc[own]], *[x[own] for x in of], pos[own]


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, h, _ in _found(batches, contexts=False):
        h, n = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a document's places with the same context, as in runs of one word."""
    for ids, ths, h, c, before, after, pos in _found(batches):
        order = np.lexsort((pos, c, ths, ids))
        ids, ths, h, c, before, after, pos = (x[order] for x in (ids, ths, h, c, before, after, pos))
        new = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]) | (c[1:] != c[:-1])]))
        places = pa.ListArray.from_arrays(pa.array(np.append(new, len(pos)).astype(np.int32)), pa.array(pos.astype(np.int64)))
        cols = [ids[new], ths[new], h[new], c[new], before[new].astype(np.int32), after[new].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cols], places], ["doc_id", "th", "h", "c", "before", "after", "places"])


def prefix_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The interval tree of common prefixes: (length, first, last) of each run of sorted strings that share `length`.

    lcp[i] is what string i shares with string i + 1. A stack scan; children come before their parents.
    """
    out, stack = [], []
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            out.append((length, first, i))
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))
    return out


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((x & -x).bit_length() - 1) // 8 if x else n


def maximal_repeats(left: list[bytes], right: list[bytes], least: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """(bytes before, bytes from the anchor, occurrences) of the maximal repeats of `least` bytes or more.

    `left` are the reversed bytes before each occurrence of an anchor, `right` those from it. A run of the
    suffix array is right-maximal; inside it, runs of the sorted left contexts are left-maximal. A run of
    which all lie in one child of the suffix interval is left to that child, where it is longer.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [shared(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    out = []
    for length, first, last in prefix_intervals(lcp):
        inside = order[first : last + 1]
        child, of = 0, {inside[0]: 0}
        for x, g in zip(lcp[first:last], inside[1:], strict=True):
            child += x == length
            of[g] = child
        # only occurrences with enough equal bytes before them can make up a repeat
        need = max(least - length, 0)
        equal: dict[bytes, list[int]] = {}
        for g in inside:
            if len(left[g]) >= need:
                equal.setdefault(left[g][:need], []).append(g)
        for same in equal.values():
            if len(same) < 2 or len({of[g] for g in same}) < 2:
                continue
            same.sort(key=left.__getitem__)
            for before, i, j in prefix_intervals([shared(left[a], left[b]) for a, b in zip(same, same[1:], strict=False)]):
                group = same[i : j + 1]
                if len({of[g] for g in group}) > 1:
                    out.append((before, length, group))
    return out


def promising(left: list[bytes], right: list[bytes], least: int = LENGTH) -> list[int]:
    """Occurrences that may lie in a repeat: the longest prefixes they share with any other, on both sides, add up to `least`.

    The longest prefix shared with any other is shared with a neighbour in sorted order.
    """
    room = [0] * len(left)
    for side in (left, right):
        order = sorted(range(len(side)), key=side.__getitem__)
        lcp = [0, *(shared(side[a], side[b]) for a, b in zip(order, order[1:], strict=False)), 0]
        for i, g in enumerate(order):
            room[g] += max(lcp[i], lcp[i + 1])
    return [g for g, x in enumerate(room) if x >= least]


def _least(lcp: np.ndarray) -> list[np.ndarray]:
    """Minima of runs of 2^k values, by k and first value."""
    out = [lcp]
    while len(out[-1]) > 1 << (len(out) - 1):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def reach(left: list[bytes], right: list[bytes], least: int = LENGTH) -> dict[int, tuple[int, int]]:
    """(bytes before, bytes from the anchor) that the maximal repeats of `least` bytes or more cover of each occurrence that lies in one.

    The same scan as in `maximal_repeats`, without its lists: the left contexts are sorted once, and a run of the suffix array
    takes their common prefixes from the least of the range between its members' ranks. A run of which all lie in one child
    adds nothing to what the child has given.
    """
    order, by_left = (sorted(range(len(x)), key=x.__getitem__) for x in (right, left))
    lcp = [shared(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    table = _least(np.array([shared(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)]))
    rank = np.empty(len(left), dtype=np.int64)
    rank[by_left] = np.arange(len(left))
    ranks = rank[order]
    x, y, there = (np.zeros(len(left), dtype=kind) for kind in (np.int64, np.int64, bool))  # by rank
    for length, first, last in prefix_intervals(lcp):
        inside = np.sort(ranks[first : last + 1])
        width = np.frexp(np.diff(inside))[1] - 1
        common = np.empty(len(width), dtype=np.int64)
        for k in np.flatnonzero(np.bincount(width)):
            own = np.flatnonzero(width == k)
            common[own] = np.minimum(table[k][inside[own]], table[k][inside[own + 1] - (1 << k)])
        most = np.maximum(np.append(common, 0), np.append(0, common))
        hit = most + length >= least
        inside, most = inside[hit], most[hit]
        there[inside] = True
        x[inside] = np.maximum(x[inside], most)
        y[inside] = np.maximum(y[inside], length)
    return {by_left[r]: (int(x[r]), int(y[r])) for r in np.flatnonzero(there).tolist()}


_SPAN = "doc_id long, th long, a long, b long"


def _group_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of single contexts that are covered by a repeat within their group."""
    for b in batches:
        lists = b.column(0)
        flat = lists.flatten()
        doc_id, th, pos, single, before, after = (flat.field(k).to_pylist() for k in range(6))
        left = [x[::-1] for x in before]
        rows, at = [], 0
        for n in lists.value_lengths().to_pylist():
            if n == 2:
                x, y = shared(left[at], left[at + 1]), shared(after[at], after[at + 1])
                best = {0: (x, y), 1: (x, y)} if x + y >= LENGTH else {}
            else:
                best = {}
                some = promising(left[at : at + n], after[at : at + n])
                if len(some) > FEW:
                    best = {some[k]: xy for k, xy in reach([left[at + g] for g in some], [after[at + g] for g in some]).items()}
                    some = []
                for x, y, group in maximal_repeats([left[at + g] for g in some], [after[at + g] for g in some]) if len(some) > 1 else ():
                    for g in (some[k] for k in group):
                        old = best.get(g)
                        best[g] = (max(old[0], x), max(old[1], y)) if old else (x, y)
            rows += [(doc_id[at + g], th[at + g], pos[at + g] - x, pos[at + g] + y) for g, (x, y) in best.items() if single[at + g]]
            at += n
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "th", "a", "b"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of every LENGTH-byte string that holds an anchor, for anchors with very many classes."""
    for b in batches:
        for m in b.to_pylist():
            text = m["before"] + m["after"]
            at = np.arange(len(text) - LENGTH + 1)
            if not len(at):
                continue
            w = Hashes(np.frombuffer(text, dtype=np.uint8)).of(at, at + LENGTH)
            a = m["pos"] - len(m["before"]) + at
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m[k])) for k in ("h", "doc_id", "th")] + [pa.array(a), pa.array(w.view(np.int64)), pa.array([m["single"]] * n)],
                                             ["h", "doc_id", "th", "a", "w", "single"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, a, b): byte ranges of documents (doc_id, th, data) that are covered by repeated strings; they may overlap."""
    repeated = written(docs.mapInArrow(_anchor_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    found = written(docs.mapInArrow(_anchor_rows, _ANCHOR).join(repeated, "h", "left_semi"))
    where = F.struct("doc_id", "th", F.col("places")[0].alias("pos"), "before", "after")
    classes = written(found.groupBy("h", "c").agg(F.sum(F.size("places")).alias("n"), F.min(where).alias("at")))
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("fewest")).where("classes > 1 and fewest = 1")
    settled = found.where(F.col("before") + F.col("after") >= LENGTH).join(classes.where("n > 1").select("h", "c"), ["h", "c"], "left_semi")
    settled = settled.select("doc_id", "th", "before", "after", F.explode("places").alias("pos"))
    spans = settled.select("doc_id", "th", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))
    asked = classes.join(groups.select("h", "classes"), "h").select("h", "classes", (F.col("n") == 1).alias("single"), "at.*")
    placed = asked.join(docs, ["doc_id", "th"]).select(
        "h", "classes", "single", "doc_id", "th", "pos",
        F.expr("substring(data, cast(pos - before as int) + 1, before)").alias("before"), F.expr("substring(data, cast(pos as int) + 1, after)").alias("after"),
    )
    placed = written(placed)
    lists = placed.where(F.col("classes") <= GROUP).groupBy("h").agg(F.collect_list(F.struct("doc_id", "th", "pos", "single", "before", "after")).alias("members"))
    spans = spans.unionByName(lists.select("members").mapInArrow(_group_spans, _SPAN))
    if placed.where(F.col("classes") > GROUP).isEmpty():
        return spans
    windows = placed.where(F.col("classes") > GROUP).select("h", "doc_id", "th", "pos", "single", "before", "after")
    windows = windows.mapInArrow(_window_rows, "h long, doc_id long, th long, a long, w long, single boolean")
    # a start that two anchors of a document share is one start; contexts of classes that are not single occur elsewhere too
    start = F.struct("doc_id", "th", "a")
    twice = windows.groupBy("h", "w").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.bool_and("single").alias("once"))
    twice = twice.where((F.col("first") != F.col("last")) | ~F.col("once")).select("h", "w")
    many = windows.where("single").join(twice, ["h", "w"], "left_semi").select("doc_id", "th", "a", (F.col("a") + LENGTH).alias("b"))
    return spans.unionByName(many)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for b in batches:
        rows = []
        for doc_id, data, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            data, kept, at, removed, runs = data.as_py(), hashlib.sha256(), 0, 0, 0
            end = -1
            for s in sorted((x["a"], x["b"]) for x in spans.as_py() or []):
                if s[0] > end:
                    runs += 1
                    kept.update(data[at : s[0]])
                    removed += s[1] - s[0]
                    at = end = s[1]
                elif s[1] > end:
                    removed += s[1] - end
                    at = end = s[1]
            kept.update(data[at:])
            rows.append((doc_id, len(data), removed, runs, kept.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removes each byte covered by a LENGTH-byte string that also starts anywhere else, in this or another
    row; strings are judged on the input. Texts are UTF-8 bytes, null is empty; null ids stay null; repeated
    rows are repeats of each other; texts under LENGTH bytes stay whole; an empty table gives an empty
    result; other columns are ignored. A row is known by its id and a hash of its text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.lit(11), text).alias("th"), text.cast("binary").alias("data"))
    spans = repeated_spans(rows).distinct().groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    out = rows.join(spans, ["doc_id", "th"], "left").select("doc_id", "data", "spans")
    out = out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """What is left of each of `documents` without repeated strings of LENGTH bytes."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
