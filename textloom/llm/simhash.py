"""SimHash near-duplicates found by pigeonring filtering (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import _graph, _scratch
from textloom.llm._runs import by_runs, joined
from textloom.llm._text import blocks, mix, shingle_sets, word_hashes, words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bits of the three segments of a fingerprint, from the highest.
SEGMENTS = (22, 21, 21)
#: Fingerprints of a segment's bucket up to which it is not split; those of a run up to which its pairs are compared; those
#: whose neighbourhoods are in memory at once.
PAIR_BUCKET, PAIR_PART, FLIPPED = 16, 64, 200_000


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    if not len(starts):
        return out
    # words joined by one space: a shingle is then one slice of these bytes
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.full(to[-1], 32, dtype=np.uint8)
    fill = np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text[fill] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
    count = np.diff(first)
    grams = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    doc = np.repeat(np.arange(len(count)), grams)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams) + first[:-1][doc]
    last = np.minimum(begin + width, first[1:][doc]) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(to[begin].tolist(), (to[last] + size[last]).tolist(), strict=True)), dtype=np.uint64, count=len(doc))
    some = np.flatnonzero(grams)
    edge = np.concatenate([[0], np.cumsum(grams[some])])
    bits = np.empty((len(some), 64), dtype=bool)
    for lo in range(0, len(some), 256):
        hi = min(lo + 256, len(some))
        one = np.unpackbits(h[edge[lo] : edge[hi]].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones = np.add.reduceat(one, edge[lo:hi] - edge[lo], axis=0, dtype=np.int64)
        bits[lo:hi] = 2 * ones > grams[some[lo:hi], None]
    out[some] = np.packbits(bits, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of the width-word shingles of each whole text, as a long's bits.

    A-Z are lower-cased; a shingle is hashed by XXH64 with seed 42 and counts as often as it occurs; a bit is 1 if
    set in over half of the hashes. Fewer words than width: the whole sequence is the one shingle. No words, or a
    null text: 0. Memory is bounded by blocks of whole documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_fingerprints(data, offsets, width) for _, _, data, offsets in blocks(batch.column(1))]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segments() -> list[tuple[int, int]]:
    out, top = [], 64
    for n in SEGMENTS:
        top -= n
        out.append((top, n))
    return out


def _flip_pairs(fps: np.ndarray, seg: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places that connect exactly the fingerprints, equal in a segment, at 2 or fewer differing bits. Two of them
    lie within 2 bits if and only if some value lies within 1 bit of both; outside the segment that is one of 44 values
    for each fingerprint. All that share a value link with each other, so linking them to the first suffices."""
    shift, n = _segments()[seg]
    free = [np.uint64(1) << np.uint64(b) for b in range(64) if not shift <= b < shift + n]
    slices = max(1, len(fps) // FLIPPED)
    for part in range(slices):
        keys, owners = [], []
        for flip in [np.uint64(0), *free]:
            key = fps ^ flip
            mine = np.flatnonzero((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == part) if slices > 1 else np.arange(len(fps))
            keys.append(key[mine])
            owners.append(mine)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
        yield owner[head], owner


def _chain_links(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each run of fingerprints that share a segment (and perhaps half of the next): of
    short runs all pairs are pruned by the chain from that segment and then checked in full."""
    seg, fp = rows.column("seg").to_numpy(), rows.column("fp").to_numpy().view(np.uint64)
    n = len(fp)
    end = np.append(first[1:], n)
    to, short = np.repeat(end, end - first), np.repeat(end - first <= PAIR_PART, end - first)
    places = np.array(_segments(), dtype=np.uint64)
    masks = (np.uint64(1) << places[:, 1]) - np.uint64(1) << places[:, 0]
    label, i = np.arange(n), np.flatnonzero(short)
    for d in range(1, PAIR_PART):
        i = i[i + d < to[i]]
        if not len(i):
            break
        x = fp[i] ^ fp[i + d]
        one = np.bitwise_count(x & masks[(seg[i] + 1) % 3])
        ok = (x & masks[seg[i]] == 0) & (one <= 1) & (one + np.bitwise_count(x & masks[(seg[i] + 2) % 3]) <= 2)
        label = joined(label, i[ok], i[ok] + d)
    for a, z in zip(first.tolist(), end.tolist(), strict=True):
        if z - a > PAIR_PART:
            own = np.arange(z - a)
            for p, q in _flip_pairs(fp[a:z], int(seg[a])):
                own = joined(own, p, q)
            label[a:z] = a + own
    moved = np.flatnonzero(label != np.arange(n))
    fp = fp.view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], ["src", "dst"])


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) edges that connect the distinct fingerprints ``fp`` exactly as links at 2 or fewer bits do.

    Pigeonring filter: with three segments on a ring and 2 bits to differ in, some segment starts a chain whose first
    segment differs in 0 bits, first two in at most 1 and all three in at most 2. Fingerprints meet in the bucket of a
    shared segment, are pruned by the chain from there, and only then checked in full. As two that differ in at most 1 bit
    of the next segment share its first or its second half, a bucket of more than PAIR_BUCKET is split by both halves, so
    buckets may grow with the corpus. What still meets more than PAIR_PART others there are near copies of each other, for
    which a check by their 1-bit neighbourhoods takes linear time. Only a spanning forest leaves a task.
    """
    shifts = _segments()

    def of(i: int):
        s, n = shifts[i % 3]
        return F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << n) - 1))

    key = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), of(i).alias("val"), of(i + 1).alias("next")) for i in range(3)]))
    keyed = fps.select("fp", key.alias("k")).select("fp", "k.*")
    grouped = keyed.groupBy("seg", "val").agg(F.count("*").alias("n")).where("n > 1")
    halves = F.array(F.struct(F.lit(0).alias("half"), F.shiftright("next", 11).alias("part")), F.struct(F.lit(1).alias("half"), F.col("next").bitwiseAND(F.lit((1 << 11) - 1)).alias("part")))
    whole = F.array(F.struct(F.lit(-1).alias("half"), F.lit(0).cast("long").alias("part")))
    dealt = keyed.join(grouped, ["seg", "val"]).select("seg", "val", F.explode(F.when(F.col("n") > PAIR_BUCKET, halves).otherwise(whole)).alias("h"), "fp").select("seg", "val", "h.half", "h.part", "fp")
    run = ["seg", "val", "half", "part"]
    return dealt.repartition(*run).sortWithinPartitions(*run).mapInArrow(lambda b: by_runs(b, len(run), _chain_links), "src long, dst long")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Fingerprints at 2 or fewer differing bits link; component_id is the smallest doc_id that links reach. Equal
    fingerprints are one class from the start, however many documents have it. Nulls: a null doc_id has no place
    among components and is its own row with a null component. An empty table gives no rows.
    """
    table = _scratch.written(fingerprints(docs, width), "simhash-fp")
    classes = table.groupBy("fp").agg(F.min("doc_id").alias("low"))
    classes = _scratch.written(classes, "simhash-class")
    graph = _graph.components(links(classes.select("fp")))
    named = graph.join(classes, graph.node == classes.fp).select("fp", "low", "component")
    least = named.groupBy("component").agg(F.min("low").alias("least"))
    moved = named.join(least, "component").select("fp", "least")
    # written, so that both sides of the last join are dealt out for it and a class of very many rows can be split
    found = _scratch.written(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "simhash-found")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return table.join(found, "fp").select("doc_id", text.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: The wide fingerprint of the pipeline's stage: 64 segments of 4 bits; a chain of CHAIN segments is a bucket's key.
WIDE_BITS, SEGMENT_BITS, CHAIN = 256, 4, 5


def _wide(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """(n, 4) uint64: 256-bit SimHashes of width-word shingles; A-Z lower-cased."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h, doc = shingle_sets(word_hashes(data, starts, ends), first, width)
    h = h[np.argsort(doc, kind="stable")]
    n = len(offsets) - 1
    grams = np.bincount(doc, minlength=n)
    edge = np.concatenate([[0], np.cumsum(grams)])
    bits = np.empty((n, WIDE_BITS), dtype=bool)
    for lo in range(0, n, 64):
        hi = min(lo + 64, n)
        part = h[edge[lo] : edge[hi]]
        four = np.stack([mix(part + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for k in range(1, 5)], axis=1)
        one = np.unpackbits(four.astype(">u8").view(np.uint8), axis=1)
        ones = np.add.reduceat(one, edge[lo:hi] - edge[lo], axis=0, dtype=np.int32)
        bits[lo:hi] = 2 * ones > grams[lo:hi, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def wide_fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, row, f0..f3): the 256-bit SimHash of each whole text's width-word shingles; row, a hash of the text, tells
    texts of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_wide(data, offsets, width) for _, _, data, offsets in blocks(batch.column(2))]
            f = np.concatenate(found).view(np.int64) if found else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(np.ascontiguousarray(f[:, k])) for k in range(4)]], ["doc_id", "row", "f0", "f1", "f2", "f3"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, row long, f0 long, f1 long, f2 long, f3 long")


def _chain_keys(f: np.ndarray) -> np.ndarray:
    """(n, 64) keys: from each of the 64 segments on the ring, CHAIN consecutive ones."""
    bits = np.unpackbits(f.astype(">u8").view(np.uint8).reshape(len(f), 32), axis=1).reshape(len(f), 64, 4)
    seg = (bits * np.array([8, 4, 2, 1], dtype=np.uint8)).sum(axis=2, dtype=np.uint64)
    key = np.zeros((len(f), 64), dtype=np.uint64)
    for k in range(CHAIN):
        key = key << np.uint64(4) | np.roll(seg, -k, axis=1)
    return key | np.arange(64, dtype=np.uint64) << np.uint64(4 * CHAIN)


#: Rows of a run up to which all its pairs are compared side by side with those of other runs.
SHORT_RUN = 32
#: Links found in a long run that are held before they are joined.
HELD_LINKS = 1 << 18


def _run_edges(first: np.ndarray, f: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (Hamming distance up to most) within each run, of which first are the first rows:
    linear in rows where they are copies of each other, else the square of those outside the largest component, in bounded
    memory."""
    n = len(f)
    label, end = np.arange(n), np.append(first[1:], n)
    size = np.repeat(end - first, end - first)
    to = np.repeat(end, end - first)
    i, found = label, [(np.zeros(0, np.int64),) * 2]
    for d in range(1, SHORT_RUN):
        i = i[(i + d < to[i]) & ((d <= 8) | (size[i] <= SHORT_RUN))]
        if not len(i):
            break
        ok = np.bitwise_count(f[i] ^ f[i + d]).sum(axis=1, dtype=np.int32) <= most
        found.append((i[ok], i[ok] + d))
    label = joined(label, *(np.concatenate([p[k] for p in found]) for k in (0, 1)))
    for a, z in zip(first.tolist(), end.tolist(), strict=True):
        if z - a > SHORT_RUN:
            label[a:z] = a + _whole_run(label[a:z] - a, f[a:z], most)
    moved = np.flatnonzero(label != np.arange(n))
    return node[moved], node[label[moved]]


def _whole_run(label: np.ndarray, f: np.ndarray, most: int) -> np.ndarray:
    """Labels after every link of one run: the largest component so far is whole, each row outside it is compared with
    all rows. A row that has come into that component by others' links needs no comparison of its own."""
    names, sizes = np.unique(label, return_counts=True)
    inside = names[sizes.argmax()]
    rows, hits, held = np.flatnonzero(label != inside).tolist(), [], 0
    for k, r in enumerate(rows):
        if label[r] != label[inside]:
            near = np.flatnonzero(np.bitwise_count(f ^ f[r]).sum(axis=1, dtype=np.int32) <= most)
            hits.append((np.full(len(near), r), near))
            held += len(near)
        if hits and (held > HELD_LINKS or k == len(rows) - 1):
            label = joined(label, *(np.concatenate([h[i] for h in hits]) for i in (0, 1)))
            hits, held = [], 0
    return label


#: Classes of a chunk: a task compares those of two chunks. Pairs that are looked at at once.
CHUNK, LOOK = 65_536, 1 << 18


def _pieces(f: np.ndarray, most: int) -> list[np.ndarray]:
    """Pieces of the 256 bits, as few differing bits to be in one of them as makes the least work: by the pigeonhole one of m
    pieces of fingerprints at Hamming distance up to most differs in most // m bits or fewer."""
    bits = np.unpackbits(f.astype(">u8").view(np.uint8).reshape(len(f), 32), axis=1)
    edge = np.linspace(0, WIDE_BITS, _pieces_of(most) + 1).round().astype(int)
    return [bits[:, a:b].astype(np.int32) @ (np.int32(1) << np.arange(b - a, dtype=np.int32)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _pieces_of(most: int) -> int:
    """As many pieces as leave at most 2 bits to each, but of at least 16 bits (then more bits to each)."""
    return min(max(most // 3 + 1, 1), WIDE_BITS // 16)


def _masks(bits: int, errors: int) -> np.ndarray:
    """Every value of up to ``errors`` set bits."""
    out, last = [np.zeros(1, np.int32)], np.zeros(1, np.int32)
    for _ in range(min(errors, bits)):
        last = np.unique(np.concatenate([last | np.int32(1 << b) for b in range(bits)]))
        last = last[~np.isin(last, np.concatenate(out))]
        out.append(last)
    return np.concatenate(out)


def _cross_links(a: tuple, b: tuple, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the components of a and b (each: fingerprints, component): every pair of
    distance up to most is looked at but those within a component. Some m-th of the bits differs in most // m at most, and
    with the next of the ring in 2 * most // m."""
    (fa, ca), (fb, cb) = a, b
    names = np.unique(np.concatenate([ca, cb]))
    ia, ib = (np.searchsorted(names, c).astype(np.int32) for c in (ca, cb))
    label, m, same, met = np.arange(len(names)), _pieces_of(most), a is b, False
    pa_, pb = _pieces(fa, most), _pieces(fb, most)
    for k in range(m):
        # rows of b by piece and component; a run of equal ones is passed over or looked at as a whole
        order = np.lexsort((ib, pb[k]))
        key, comp, then, mine = pb[k][order], ib[order], pb[(k + 1) % m][order], pa_[(k + 1) % m]
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (comp[1:] != comp[:-1])])).astype(np.int32)
        length, key, comp = np.diff(np.append(start, len(order))), key[start], comp[start]
        at = np.searchsorted(key, np.arange((1 << -(-WIDE_BITS // m)) + 1)).astype(np.int32)
        for mask in _masks(-(-WIDE_BITS // m), most // m):
            left = 2 * most // m - int(mask).bit_count()
            near = pa_[k] ^ mask
            lo, n = at[near], at[near + 1] - at[near]
            for rows in _slices(np.flatnonzero(n), n[n > 0]):
                i = np.repeat(rows, n[rows])
                run = np.arange(len(i)) + np.repeat(lo[rows] - np.cumsum(n[rows]) + n[rows], n[rows])
                ok = np.flatnonzero(ia[i] < comp[run] if same else ia[i] != comp[run])
                i, run = i[ok], run[ok]
                for pick in _slices(np.arange(len(i)), length[run]):
                    if met:  # what has met since is passed over
                        pick = pick[label[ia[i[pick]]] != label[comp[run[pick]]]]
                    x, y, size = i[pick], start[run[pick]], length[run[pick]]
                    if len(size) and size.max() > 1:
                        x, y = np.repeat(x, size), np.arange(size.sum()) + np.repeat(y - np.cumsum(size) + size, size)
                    near_too = np.bitwise_count(mine[x] ^ then[y]) <= left
                    x, y = x[near_too], order[y[near_too]]
                    hit = np.bitwise_count(fa[x] ^ fb[y]).sum(axis=1, dtype=np.int32) <= most
                    if hit.any():
                        label, met = joined(label, ia[x[hit]], ib[y[hit]]), True
        # what has met is one component from the next piece on
        ia, ib = label[ia].astype(np.int32), label[ib].astype(np.int32)
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _slices(rows: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """rows in slices whose sizes sum to about LOOK, or of one larger row."""
    part = np.cumsum(sizes, dtype=np.int64) // LOOK
    yield from np.split(rows, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(rows) else ()


def _rest(classes: DataFrame, most: int, chunk: int) -> DataFrame:
    """(src, dst): links between components of classes (f0..f3, component) at Hamming distance up to most that no shared chain
    showed. All pairs are covered: classes are dealt to chunks, a task compares two chunks, and memory is that of two."""
    chunks = max(1, -(-classes.count() // chunk))
    f = ["f0", "f1", "f2", "f3"]
    own = classes.withColumn("c", F.pmod(F.xxhash64(*f, F.lit(7)), F.lit(chunks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    cells = own.withColumn("o", other).select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), (F.col("c") > F.col("o")).alias("side"), *f, "component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            x = np.stack([rows.column(k).to_numpy().view(np.uint64) for k in range(3, 7)], axis=1)
            comp, side = rows.column(7).to_numpy(), rows.column(2).to_numpy()
            one = (x[~side], comp[~side])
            two = (x[side], comp[side]) if rows.column(0)[0] != rows.column(1)[0] else one
            if len(one[0]) and len(two[0]):
                src, dst = _cross_links(one, two, most)
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    # more parts than cells, so that few tasks have two
    parts = min(2 * chunks * (chunks + 1), 100_000)
    return cells.repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(run, "src long, dst long")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (a, b), which batches are sorted by."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(k).to_numpy() for k in (0, 1)], axis=1)
        edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *edge], [*edge, len(key)], strict=True):
            part = batch.slice(lo, hi - lo)
            if held and (held[0].column(0)[0], held[0].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, row, component_id) by links at a Jaccard similarity of about ``similarity`` or more of width-word shingles.

    A similarity J of two sets of shingles means an angle of acos(2J / (1 + J)) between their vectors, and so that share
    of 256 SimHash bits differs, which sets the Hamming distance of a link. Every pair within it is linked. Fingerprints that
    share the bits of CHAIN consecutive segments, anywhere on the ring of 64, meet in a bucket and get the full Hamming check
    there; that finds most links at a cost that is linear but for the buckets' sizes. What it leaves can only lie between the
    components so found: ``_rest`` looks for it among all pairs of classes, by pieces that differ in few bits, in tasks of two
    chunks; its work is quadratic. Equal fingerprints are one class from the start.
    Buckets are sorted runs of any size, all of whose pairs count; within a run only a spanning forest leaves a task.
    """
    most = int(WIDE_BITS * np.arccos(2 * similarity / (1 + similarity)) / np.pi + 0.5) + 3
    f = ["f0", "f1", "f2", "f3"]
    # a class's node is a hash of its fingerprint: a doc_id can have several texts, and so be the smallest of several classes
    table = _scratch.written(wide_fingerprints(docs, width).withColumn("node", F.xxhash64(*f)), "simhash-wide")
    classes = _scratch.written(table.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("low"), *[F.min(c).alias(c) for c in f]), "simhash-class")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = np.stack([part.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(4)], axis=1)
                key = _chain_keys(x)
                at = np.repeat(np.arange(len(x)), 64)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *[part.column(k).take(pa.array(at)) for k in range(5)]], ["key", *f, "node"])

    keyed = classes.select(*f, "node").mapInArrow(keys, "key long, f0 long, f1 long, f2 long, f3 long, node long")
    runs = keyed.repartition("key").sortWithinPartitions("key")

    def edges(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = [rows.column(k).to_numpy() for k in range(6)]
        src, dst = _run_edges(first, np.stack([c.view(np.uint64) for c in col[1:5]], axis=1), col[5], most)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    graph = _graph.components(runs.mapInArrow(lambda b: by_runs(b, 1, edges), "src long, dst long"))
    named = classes.join(graph, "node", "left").select("node", "low", *f, F.coalesce("component", "node").alias("component"))
    named = _scratch.written(named, "simhash-named")
    # links that no chain showed lie between these components
    again = _graph.components(_rest(named.select(*f, "component"), most, CHUNK)).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    named = named.join(again, "component", "left").select("node", "low", F.coalesce("joined", "component").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    found = _scratch.written(named.join(least, "component").select("node", "component_id"), "simhash-found")
    return table.join(found, "node", "left").select(*[c for c in table.columns if c in ("doc_id", "row")], F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; of texts of one doc_id each goes or stays by itself.
    Rows of a null doc_id stay; texts without words are like each other. An empty table gives no rows."""
    doc_id, row = _scratch.free_name(docs, "gone_id"), _scratch.free_name(docs, "gone_row")
    out = similar(docs, width, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id), F.col("row").alias(row)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(doc_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(row))
    return docs.join(out, same, "left_anti")
