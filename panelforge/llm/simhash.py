"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import connected_components, durable, forget, joined_up, to_join, written

SHINGLE, SEED, MOST_BITS = 3, 42, 3
POSTING = 2048
#: Shingles, similarity, bits and most differing bits of the pipeline's stage, where no contract fixes them. At similarity
#: 0.8 of five-word shingles 39 of 256 bits differ on average, with a deviation of 6.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_BYTES, STAGE_BITS = 5, 0.8, 32, 52
#: Lists that share all the bytes the count filter asks for and are longer than this are dealt into parts of this size, every two
#: of which meet in a task.
CHUNK = 1 << 14
#: Candidate pairs an entry of a list, up to which the stage takes all of them at once.
MOST_PAIRS = 8


def _quads() -> list[tuple[int, ...]]:
    """14 quadruples of 8 positions, one of which lies in any 5 positions.

    Each half, and pairs of pairs of the halves: the pairs of 4 positions are three matchings, any 3 of 4
    positions hold a pair of each matching, so 3 of one half and 2 of the other hold two of equal matchings.
    """
    matchings = [((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2))]
    crossed = [(*a, *(4 + x for x in b)) for m in matchings for a, b in product(m, m)]
    return [(0, 1, 2, 3), (4, 5, 6, 7), *crossed]


@dataclass
class Index:
    """What is posted and what a pair must reach: keys are tuples of byte positions that must be equal."""

    keys: list[tuple[int, ...]]
    width: int  # bytes of a fingerprint
    least_bytes: int  # count filter: so many bytes are equal at their positions
    most_bits: int
    posting: int = POSTING
    chunk: int = CHUNK
    others: list[list[int]] = field(init=False)

    def __post_init__(self):
        self.others = [[p for p in range(self.width) if p not in k] for k in self.keys]


#: With at most 3 differing bits at least 5 of the 8 bytes agree at their positions, and four of them are a key.
EXACT = Index(_quads(), 8, 8 - MOST_BITS, MOST_BITS)
#: At similarity 0.8 a byte of two texts is equal with a chance of 0.27; the pairs of positions of each four are keys.
STAGE = Index([tuple(4 * g + x for x in p) for g in range(STAGE_BYTES // 4) for p in combinations(range(4), 2)], STAGE_BYTES, 4, STAGE_BITS)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text's 3-word shingles (repeats count); fewer words are one shingle, no word gives 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(SHINGLE, len(words))
    starts, stops = [0, *ends[: len(words) - width].tolist()], (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=len(stops))
    return int(_majority(h).view("<u8")[0])


def _majority(h: np.ndarray) -> np.ndarray:
    """Bytes of the bits that are 1 in over half the rows of hashes (a row of one or more 64-bit words)."""
    h = h.reshape(len(h), -1)
    ones = np.zeros(64 * h.shape[1], dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = np.ascontiguousarray(h[at : at + 8192])
        ones += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little")


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ np.uint64(by)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, width: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words are one shingle, no word gives none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    h = np.zeros(len(w) - width + 1, dtype=np.uint64)
    for i in range(width):
        h = _mix(h + w[i : len(w) - width + 1 + i], i + 1)
    return np.unique(h)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, fp): SimHashes of STAGE_BYTES over the distinct shingles."""
    for b in batches:
        out = []
        for t in b.column(2):
            h = shingle_hashes(t.as_py())
            out.append(_majority(np.stack([_mix(h, 1000 + i) for i in range(STAGE_BYTES // 8)], axis=1)).tobytes() if len(h) else bytes(STAGE_BYTES))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "digest", "fp"])


def forest(fp: np.ndarray, least_bytes: int, most_bits: int, first: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of fingerprint bytes, as pairs of rows; the search begins at row `first`.

    Breadth first: a row is compared with those not reached yet. The tally of bytes that are equal at their
    positions comes first; only pairs that reach `least_bytes` are verified bit by bit. Memory is linear.
    """
    edges, queue = [], []
    open_ = np.roll(np.arange(len(fp)), -first)
    while len(open_):
        if not queue:
            queue, open_ = [int(open_[0])], open_[1:]
            continue
        at = queue.pop()
        x = fp[open_] ^ fp[at]
        near = (x == 0).sum(axis=1) >= least_bytes
        near[near] = np.bitwise_count(x[near]).sum(axis=1) <= most_bits
        found = open_[near].tolist()
        edges += [(at, k) for k in found]
        queue += found
        open_ = open_[~near]
    return edges


def all_pairs(fp: np.ndarray, least_bytes: int, most_bits: int, most: int | None = None, group: np.ndarray | None = None) -> Iterator[list[tuple[int, int]]]:
    """The links of each row with later ones of other groups, as pairs of rows; an empty list in place of the rest once there are over `most`."""
    found = 0
    for at in range(len(fp) - 1):
        x = fp[at + 1 :] ^ fp[at]
        near = (x == 0).sum(axis=1) >= least_bytes
        if group is not None:
            near &= group[at + 1 :] != group[at]
        near[near] = np.bitwise_count(x[near]).sum(axis=1) <= most_bits
        later = (at + 1 + np.flatnonzero(near)).tolist()
        found += len(later)
        if most is not None and found > most:
            yield []
            return
        if later:
            yield [(at, k) for k in later]


def _linker(index: Index, whole: bool = False):
    """Edges of lists (key, at, entries); with `whole` all pairs of a list of MOST_PAIRS an entry or fewer, and the key of others as `cut`."""
    width, least, most = index.width, index.least_bytes, index.most_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            fp = np.frombuffer(b"".join(flat.field(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
            node = flat.field(1).to_numpy(zero_copy_only=False)
            sizes = np.array(lists.value_lengths().to_pylist(), dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            two = np.flatnonzero(sizes == 2)
            x = fp[starts[two]] ^ fp[starts[two] + 1]
            near = two[((x == 0).sum(axis=1) >= least) & (np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= most)]
            left, right, cut = [node[starts[near]]], [node[starts[near] + 1]], [None] * len(near)
            for i in np.flatnonzero(sizes > 2):
                at, n, key = starts[i], sizes[i], None
                found = list(all_pairs(fp[at : at + n], least, most, MOST_PAIRS * n)) if whole else [[]]
                edges = [e for some in found for e in some]
                if found and not found[-1]:
                    edges = forest(fp[at : at + n], least, most, int(b.column(1)[i].as_py()) % n)
                    key = b.column(0)[i].as_py()
                left.append(node[at + np.array([e[0] for e in edges], dtype=np.int64)])
                right.append(node[at + np.array([e[1] for e in edges], dtype=np.int64)])
                cut += [key] * len(edges)
            ends = [pa.array(np.concatenate(c).astype(np.int64)) for c in (left, right)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(cut, pa.int64())], ["a", "b", "cut"])

    return run


def _between(index: Index):
    """All links between entries (fp, node, c) of a list that are of two components, a part of rows at a time."""
    width, least, most = index.width, index.least_bytes, index.most_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entries in b.column(0):
                flat = entries.values
                fp = np.frombuffer(b"".join(flat.field(0).to_pylist()), dtype=np.uint8).reshape(-1, width)
                node, c = (flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                for some in all_pairs(fp, least, most, group=c):
                    yield pa.RecordBatch.from_arrays([pa.array(node[[e[k] for e in some]], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _linked(posted: DataFrame, index: Index, whole: bool = False) -> DataFrame:
    """Edges of lists `posted(key, fp, node)`, each of a bounded length, found in a task."""
    lists = posted.groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("entries"))
    return lists.select("key", F.abs(F.xxhash64("key")).alias("at"), "entries").mapInArrow(_linker(index, whole), "a long, b long, cut long")


def _lists(entries: DataFrame, index: Index) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables `(key, fp, node)` of lists of a bounded length, in which all entries meet that may be linked, and the written tables they read.

    An entry is posted under each key, a tuple of positional bytes. A list of `posting` entries or fewer goes
    to one task, where the shared bytes of its pairs are tallied. Longer lists are refined by one more byte of each other
    position, in rising order of positions, as long as the count filter asks for more bytes than the list shares: nothing
    that reaches it is lost. What is still long then shares all the bytes asked for, and is dealt into parts of `chunk`
    entries; every two parts are a list of their own, so that each pair of entries meets, however long the list is.
    """
    byte = lambda p: F.substr("fp", p + 1, F.lit(1))
    keys = [F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), *[byte(F.lit(p)) for p in k]).alias("key")) for i, k in enumerate(index.keys)]
    posted = entries.select("fp", "node", F.explode(F.array(*keys)).alias("k")).select("k.i", F.lit(-1).alias("p"), "k.key", "fp", "node")
    out, read = [], []
    for depth in range(len(index.keys[0]), index.least_bytes + 1):
        posted = written(posted)
        counts = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        read += [posted, counts]
        # as many rows as the postings have keys, which no plan can tell
        sized = posted.join(to_join(counts), "key")
        last = depth == index.least_bytes
        longest = index.chunk if last else index.posting
        out.append(sized.where(F.col("n") <= longest).select("key", "fp", "node"))
        if counts.where(F.col("n") > longest).isEmpty():
            break
        long_ = sized.where(F.col("n") > longest)
        if last:
            parts = F.ceil(F.col("n") / F.lit(index.chunk)).cast("int")
            dealt = long_.select("key", "fp", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("at"))
            dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at != other")
            out.append(dealt.select(F.xxhash64("key", F.least("at", "other"), F.greatest("at", "other")).alias("key"), "fp", "node"))
        else:
            others = F.filter(F.element_at(F.lit(index.others), F.col("i") + 1), lambda o: o > F.col("p"))
            posted = long_.withColumn("p", F.explode(others)).select("i", "p", F.xxhash64("key", "p", byte(F.col("p"))).alias("key"), "fp", "node")
    return out, read


def _edges(lists: list[DataFrame], index: Index, whole: bool = False) -> DataFrame:
    """(a, b, cut) of all lists, written."""
    edges = _linked(lists[0], index, whole)
    for more in lists[1:]:
        edges = edges.union(_linked(more, index, whole))
    return written(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cut").distinct())


def links(entries: DataFrame, index: Index) -> DataFrame:
    """Edges (a, b) of `entries(fp binary, node long)`, one row per node: spanning forests of the links in each posting list (see `_lists`)."""
    lists, read = _lists(entries, index)
    edges = _edges(lists, index)
    for table in read:
        forget(table)
    return edges.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", posting: int = POSTING) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at MOST_BITS differing bits or fewer; component_id is the smallest id reachable. Null
    and blank texts have fingerprint zero, linked like any other. Rows with a null id take part and link
    others, with no say in component ids (null if their component has no other); repeated rows come out
    each, rows that share an id but no text are rows of their own; an empty table gives an empty result;
    other columns are ignored.

    Equal fingerprints are one entry of the index; components come from star rounds over edges between
    fingerprints.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = durable(rows.mapInArrow(_fingerprints, "doc_id long, fp long"))
    entries = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    # the eight bytes of a fingerprint, the most significant first
    index = Index(EXACT.keys, EXACT.width, EXACT.least_bytes, EXACT.most_bits, posting)
    edges = links(entries.select(F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp"), F.col("fp").alias("node")), index)
    components = connected_components(edges)
    grouped = entries.join(components.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    least = grouped.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = grouped.join(least, "c").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["node", "hs"])


def _alike(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """The edges (a, b) whose texts, `rows(node, digest, text)`, have the similarity wanted; written."""
    ends = durable(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    texts = rows.join(to_join(ends, ends.count()), "node").dropDuplicates(["digest"]).select("node", "text")
    sets = written(texts.mapInArrow(_sets, "node long, hs binary"))
    both = edges.join(sets.select(F.col("node").alias("a"), F.col("hs").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hs").alias("hb")), "b")
    out = written(both.select("a", "b", "ha", "hb").mapInArrow(_similar, "a long, b long"))
    forget(ends)
    forget(sets)
    return out


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
            n = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(n >= STAGE_SIMILARITY * (len(x) + len(y) - n))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, component, keep_id, keep_digest), one row per pair of id and text digest of docs.

    Texts link at a similarity of STAGE_SIMILARITY or more of their sets of five-word shingles (texts without
    a word are one class): candidates come from the index over 256-bit SimHashes and are verified on whole
    shingle sets, each of them whose ends are not in one component yet. The row kept of a component is the one with the smallest id (null last), ties by digest.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    prints = written(rows.mapInArrow(_wide_fingerprints, "doc_id long, digest string, fp binary").distinct())
    node = F.xxhash64("digest")
    lists, read = _lists(prints.select(node.alias("node"), "fp").distinct(), STAGE)
    texts = rows.select(node.alias("node"), "digest", "text")
    edges = _edges(lists, STAGE, whole=True)
    components = connected_components(_alike(edges.select("a", "b").distinct(), texts))
    cut = edges.select(F.col("cut").alias("key")).where("key is not null").distinct()
    if not cut.isEmpty():
        # a forest's edges may be found unlike where two others of the list are alike: all that is not in one component yet meets
        top = components.select(F.col("id").alias("node"), "component")
        entries = lists[0]
        for more in lists[1:]:
            entries = entries.union(more)
        entries = entries.join(to_join(cut), "key", "left_semi").join(to_join(top), "node", "left").select("key", "fp", "node", F.coalesce("component", "node").alias("c"))
        gathered = entries.groupBy("key").agg(F.collect_list(F.struct("fp", "node", "c")).alias("entries")).where(F.size(F.array_distinct(F.transform("entries", lambda x: x["c"]))) > 1)
        rest = gathered.select("entries").mapInArrow(_between(STAGE), "a long, b long")
        rest = written(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        components = joined_up(components, _alike(rest, texts))
    for table in [*read, edges]:
        forget(table)
    named = prints.select("doc_id", "digest", node.alias("id")).join(components, "id", "left").select("doc_id", "digest", F.coalesce("component", "id").alias("component"))
    named = written(named)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    keep = named.groupBy("component").agg(F.min(order).alias("keep")).select("component", F.col("keep.doc_id").alias("keep_id"), F.col("keep.digest").alias("keep_digest"))
    return named.join(to_join(keep), "component").select("doc_id", "digest", "component", "keep_id", "keep_digest")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of all of `documents`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage_simhash(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (see `similar_texts`): the one with the smallest id, null last.

    Rows equal in id and text are one document, of which one row stays; rows that share an id but are unlike
    in text all stay. Empty tables give an empty result; columns may have any names.
    """
    kept = similar_texts(docs).where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest")))
    i, key = F.col("doc_id").cast("long"), ["_n", "_i", "_d"]
    # keys without nulls, so that rows are dealt out once for both
    named = [i.isNull().alias("_n"), F.coalesce(i, F.lit(0)).cast("long").alias("_i")]
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *named, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("_d"))
    stays = whole.dropDuplicates(key).join(to_join(kept.select(*named, F.col("digest").alias("_d"))), key, "left_semi")
    return stays.select("_row.*")
