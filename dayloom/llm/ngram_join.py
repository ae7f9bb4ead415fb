"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles; two link when  den * |x & y| >= num * |x | y|.  The
operator returns the connected components of the links. Shingles are compared by 57-bit hashes
and whole sets by 128-bit ones; apart from their collisions the result is exact.

1. Documents with equal sets form one class (an aggregate over digests); the rest works on
   one document a class, so exact copies are never paired.
2. A global order of shingles: by how many documents have them (powers of two, counted over all
   documents), then by hash. A document's first shingles in that order, its lead, must share
   ``needed`` shingles with the lead of any partner; only leads are exchanged.
3. Where a shingle is the first that two documents share, all before it lie outside the other, so
   their places say how much the two differ at least. ``slack`` is what a document has left of
   its half of the most that may differ: a pair's must not sum to less than 0.
4. For each shingle and range of sizes the document with most slack leads; the others are compared
   with it, if their leads share enough. Those that link form groups (components so far). All others keep their distance from
   the leader on frequent shingles.
5. The token-group matrix: for each shingle and group the bounds of its members. A query is held
   against the groups with more slack than its own: its place, its rare shingles and its
   distance from the common leader (two documents differ at least by the difference of their
   distances) bound its overlap with any member. Of the groups left, those whose union of
   shingles holds ``needed`` of the query's are opened, and their members (whose own leads must share
   as many) compared with the query, first the likeliest of each group, then the others of groups that have not merged yet.
6. Components of all links.

Comparisons move each text once to the task that hashes it, then its shingles to the leaders it
meets; a leader that many follow is dealt over several tasks. Nothing that grows with the corpus
is collected or broadcast: the frequent shingles are bounded by ``FREQUENT`` through the count that
makes a shingle frequent, bit filters have a fixed size. Joins on shingles carry narrow rows; one
shingle that very many documents lead with is split by Spark's adaptive skew join.

Edge cases: null text is empty; a document without words has n_shingles 0 and is its own
component; with fewer words than ``k`` the whole sequence is the one shingle. Rows that
repeat a doc_id are one document, which links as any of its texts does. A null doc_id links with
nothing and has a null component. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayloom.llm.common import Scratch, bit_filter, lean, passes, release, small_batches

FREQUENT = 1 << 20  # bound on the number of frequent shingles, which are broadcast (9 MB)
LEAST_FREQUENT = 16  # documents that a frequent shingle leads, at least
HASH_BITS = 57  # of a shingle; above them the power of two of its count, 0 if it is not frequent
HOT = 1 << HASH_BITS
FOLLOWERS = 256  # of one leader that one task compares
SEGMENT = 1 << 18  # bytes of text hashed at once

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SPLIT = bytes([0x20, 9, 10, 11, 12, 13])


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as the longest segment so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE)]))
        return self.up, self.down


_POWERS = Powers()


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words. Works by segments that end at white space, so that
    memory beyond the hashes does not grow with the text."""
    hashes, at, begin = [], [], 0
    while begin < len(raw):
        stop = begin + SEGMENT
        if stop < len(raw):
            while True:  # the next white space; a word may be longer than a segment
                space = _SPACE[raw[stop : stop + 4096]]
                if not len(space) or space.any():
                    stop += int(space.argmax()) if len(space) else 0
                    break
                stop += len(space)
        part = raw[begin:stop]
        word = np.zeros(len(part) + 2, np.int8)
        word[1:-1] = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(word))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            up, down = _POWERS.get(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
            hashes.append(_mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
            at.append(starts + begin)
        begin = stop
    return (np.concatenate(hashes), np.concatenate(at)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def token_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles, one after another, and where each
    text's begin (one place more than texts). Words split at ASCII white space, A-Z lower-cased."""
    raws = [(t or "").encode("utf-8").lower() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    h, at = _words(np.frombuffer(b"\n".join(raws), np.uint8))
    begin = np.searchsorted(at, first)  # of each text among the words
    count = np.diff(begin)

    def fold(start: np.ndarray, width: int) -> np.ndarray:
        out = np.full(len(start), np.uint64(width))
        for i in range(width):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[start + i])
        return (out >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    sizes = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    values = np.empty(offsets[-1], np.int64)
    long = count >= k
    row = np.repeat(np.flatnonzero(long), sizes[long])
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[long]) - sizes[long], sizes[long])
    values[offsets[row] + place] = fold(begin[row] + place, k)
    for width in range(1, k):
        short = np.flatnonzero(count == width)
        values[offsets[short]] = fold(begin[short], width)
    for i in range(len(texts)):
        values[offsets[i] : offsets[i + 1]].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][sizes > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[offsets]


def shingles(text: str | None, k: int) -> np.ndarray:
    return token_sets([text], k)[0]


def spare(n, num: int, den: int):
    """How many of n shingles a partner may lack: n - ceil(num/den * n)."""
    return n + -num * n // den


def lead_length(n, num: int, den: int):
    e = spare(n, num, den)
    return np.minimum(n, e + 2 + e // 8)


def needed(n, num: int, den: int):
    """Leading shingles that a partner of any allowed size shares at least."""
    m = np.maximum(1, -(-num * n // den))
    return np.maximum(1, np.minimum(lead_length(n, num, den) - spare(n, num, den), lead_length(m, num, den) - spare(m, num, den)))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array; costs a binary search each, whatever its length."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def ordered_sets(texts: list[str | None], k: int, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``token_sets`` in the global order, and how many of each text's shingles are rare."""
    values, offsets = token_sets(texts, k)
    known, level = frequent
    rare = np.diff(offsets)
    if len(known):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hot = known[at] == values
        values[hot] |= level[at[hot]].astype(np.int64) << HASH_BITS
        rare = rare - np.diff(np.concatenate([[0], np.cumsum(hot)])[offsets])
        for i in np.flatnonzero(rare < np.diff(offsets)):
            values[offsets[i] : offsets[i + 1]].sort()
    return values, offsets, rare


def _lists(values: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The first ``lengths`` values of each list."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[offsets[row] + np.arange(len(row)) - ends[row]], pa.int64()))


def _count(docs: DataFrame, k: int, num: int, den: int, known, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Frequent shingles and their counts. Without ``known``: counted over every document's first
    shingles by hash. With it: over all shingles of documents that mostly lead with known ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            values, offsets = token_sets(b.column(0).to_pylist(), k)
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            lead = np.arange(len(row)) - offsets[row] < lead_length(n, num, den)[row]
            if known is not None:
                hits = np.bincount(row[lead], among(values[lead], known.value), len(n))
                lead = (4 * hits >= lead_length(n, num, den))[row]
            yield pa.RecordBatch.from_arrays([pa.array(values[lead])], names=["v"])

    counts = docs.select("text").mapInArrow(lean(run), "v long").groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > LEAST_FREQUENT)
    scratch = Scratch(docs.sparkSession)
    counts = scratch.put(counts, "frequent")
    while counts.where(F.col("n") > floor).count() > FREQUENT // 2:  # at most FREQUENT shingles: raises the floor until they are
        floor *= 2
    out = counts.where(F.col("n") > floor).toArrow().sort_by("v")
    scratch.drop(counts)
    return np.asarray(out["v"], np.int64), np.asarray(out["n"], np.int64), floor


def _frequent(docs: DataFrame, k: int, num: int, den: int):
    """Broadcast: sorted frequent shingles and the powers of two of their counts."""
    spark = docs.sparkSession
    first, n, floor = _count(docs, k, num, den, None, LEAST_FREQUENT)
    if len(first):
        shared = spark.sparkContext.broadcast(first)
        more, m, _ = _count(docs, k, num, den, shared, floor)
        both = np.union1d(first, more)
        counts = np.zeros(len(both), np.int64)
        counts[np.searchsorted(both, first)] = n
        at = np.searchsorted(both, more)
        counts[at] = np.maximum(counts[at], m)
        first, n = both, counts
    return spark.sparkContext.broadcast((first, np.floor(np.log2(np.maximum(n, 2))).astype(np.int8)))


def _led(docs: DataFrame, k: int, num: int, den: int, frequent) -> DataFrame:
    """doc_id, n, digest, rare (shingles that are not frequent), need and the lead."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            values, offsets, rare = ordered_sets(b.column(1).to_pylist(), k, frequent.value)
            n = np.diff(offsets)
            digest = [xxhash.xxh3_128_digest(values[i:j].tobytes()) if j > i else None for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            need = np.where(n > 0, needed(n, num, den), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(rare, pa.int32()), pa.array(need, pa.int32()), _lists(values, offsets, lead_length(n, num, den))], names=["doc_id", "n", "digest", "rare", "need", "lead"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n int, digest binary, rare int, need int, lead array<long>")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): large and small stars in turn (Kiveris et al., 2014) until nothing
    changes. Every step is a table in the shared folder; minima are combined before the shuffle."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = near.join(least, "a")
        moved = moved.where("b > a") if large else moved
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out if large else out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())
    e = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = mark(e)
    while seen[0]:
        new = scratch.put(star(star(e, True), False), "edges")
        scratch.drop(e)
        e, before, seen = new, seen, mark(new)
        if seen == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _tasks(pairs: DataFrame) -> DataFrame:
    """x, y, part, follows: the rows that meet for the pairs (x, y), where a y with many x has several
    parts and comes into each itself."""
    fans = pairs.groupBy("y").agg(F.ceil(F.count("*") / F.lit(FOLLOWERS)).cast("int").alias("parts"))
    leading = fans.select(F.col("y").alias("x"), "y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("follows"))
    following = pairs.join(fans, "y").select("x", "y", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("part"), F.lit(True).alias("follows"))
    return leading.union(following)


MET = "x long, y long, shared int, hot int, x_n int, y_n int, x_mark int, y_mark int"


def _meet(sets: DataFrame) -> DataFrame:
    """Of tasks with a number ``mark`` and sorted ``tokens``: how many tokens each pair shares, and how
    many of them are frequent; both sides' sizes and marks. Tasks arrive in order, y first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, lead, lead_mark = None, None, 0
        for whole in batches:
            for b in small_batches([whole]):
                y, follows, mark = np.asarray(b.column("y")), np.asarray(b.column("follows")), np.asarray(b.column("mark"))
                tokens = b.column("tokens")
                values, n = np.asarray(tokens.flatten()), np.asarray(tokens.value_lengths()).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)])
                shared, hot, y_n, y_mark = (np.zeros(len(n), np.int64) for _ in range(4))
                cuts = np.concatenate([[0], np.flatnonzero((y[1:] != y[:-1]) | ~follows[1:]) + 1, [len(y)]])
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if not follows[i]:
                        leader, lead, lead_mark = y[i], np.array(values[offsets[i] : offsets[i + 1]]), int(mark[i])
                    if leader != y[i]:
                        raise ValueError("a leader's tokens are missing")
                    part, at = values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    hit = among(part, lead)
                    shared[i:j] = np.diff(np.concatenate([[0], np.cumsum(hit)])[at])
                    hot[i:j] = np.diff(np.concatenate([[0], np.cumsum(hit & (part >= HOT))])[at])
                    y_n[i:j], y_mark[i:j] = len(lead), lead_mark
                out = [b.column("x"), b.column("y"), *(pa.array(c, pa.int32()) for c in (shared, hot, n, y_n, mark, y_mark))]
                yield pa.RecordBatch.from_arrays(out, names=[f.split()[0] for f in MET.split(", ")]).filter(pa.array(follows))

    return sets.repartition("y", "part").sortWithinPartitions("y", "part", "follows").mapInArrow(lean(run), MET)


def _possible(pairs: DataFrame, kept: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (x, y) whose leads share as many shingles as a link needs."""
    leads = kept.select("x", F.col("need").alias("mark"), F.array_sort(F.transform("tokens", lambda t: t["v"])).alias("tokens"))
    pairs = scratch.put(pairs.select("x", "y"), "pairs")
    return scratch.put(_meet(_tasks(pairs).join(leads, "x")).where("shared >= x_mark and shared >= y_mark").select("x", "y", "shared"), "possible")


def _compare(pairs: DataFrame, docs: DataFrame, heads: DataFrame, scratch: Scratch, k: int, num: int, den: int, frequent) -> DataFrame:
    """x, y, linked, apart (frequent shingles that only one of them has) of the pairs (x, y).

    Texts of documents in a pair (a bit filter drops most others before the shuffle) meet their
    pairs and are hashed; the shingles of each x go to the tasks of its y."""
    tasks = scratch.put(_tasks(pairs).join(heads.select("x", "doc_id", "digest"), "x"), "tasks")
    wanted = bit_filter(tasks.select("doc_id"))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            yield b.filter(pa.array(passes(wanted.value, np.asarray(b.column(0), np.int64))))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, found = None, None
        for b in small_batches(batches, 64):
            digests, texts, keep, sets = b.column("digest").to_pylist(), b.column("text"), [], []
            for i, digest in enumerate(digests):
                if digest != last:
                    values, _, rare = ordered_sets([texts[i].as_py()], k, frequent.value)
                    if xxhash.xxh3_128_digest(values.tobytes()) != digest:
                        continue  # another text of a repeated doc_id
                    last, found = digest, (values, rare[0])
                keep.append(i)
                sets.append(found)
            if keep:
                at, sizes = pa.array(keep), np.array([len(v) for v, _ in sets])
                lists = _lists(np.concatenate([v for v, _ in sets]), np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("x", "y", "part", "follows")], pa.array([r for _, r in sets], pa.int32()), lists], names=["x", "y", "part", "follows", "mark", "tokens"])

    texts = docs.mapInArrow(lean(pick), docs.schema).join(tasks, "doc_id").select("x", "y", "part", "follows", "digest", "text")
    met = _meet(texts.mapInArrow(lean(hashed), "x long, y long, part int, follows boolean, mark int, tokens array<long>"))
    linked = F.lit(den) * F.col("shared") >= F.lit(num) * (F.col("x_n") + F.col("y_n") - F.col("shared"))
    apart = F.col("x_n") - F.col("x_mark") + F.col("y_n") - F.col("y_mark") - 2 * F.col("hot")
    found = scratch.put(met.select("x", "y", linked.alias("linked"), apart.alias("apart")), "compared")
    scratch.drop(tasks)
    return found


def _exchanged(heads: DataFrame, shared=None) -> DataFrame:
    """v of every class's lead; with a bit filter also x, place, rare, n and need, of those that
    pass it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_batches([whole], 1024):
                lists = b.column("lead")
                if shared is None:
                    yield pa.RecordBatch.from_arrays([lists.flatten()], names=["v"])
                    continue
                sizes = np.asarray(lists.value_lengths())
                row = np.repeat(np.arange(b.num_rows), sizes)
                v, place = np.asarray(lists.flatten()), np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = passes(shared.value, v)
                take = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([pa.array(v[keep]), pa.array(place[keep], pa.int32()), *[b.column(c).take(take) for c in ("x", "rare", "n", "need")]], names=["v", "place", "x", "rare", "n", "need"])

    names = ["lead"] if shared is None else ["x", "rare", "n", "need", "lead"]
    return heads.select(*names).mapInArrow(lean(run), "v long" if shared is None else "v long, place int, x long, rare int, n int, need int")


def _classes(led: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Classes (digest, doc_id, node); heads (x: the node, doc_id, digest, n, rare, need, lead), one
    row a class; edges between the classes of doc_ids that have several. A class is known by its
    smallest doc_id; a second class of the same doc_id by a number above all."""
    known = led.where("digest is not null and doc_id is not null")
    classes = scratch.put(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "classes")
    several = scratch.put(known.groupBy("doc_id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("doc_id"), "several")
    bridges = None
    if several.limit(1).count():
        top = led.agg(F.max("doc_id")).first()[0]
        firsts = classes.groupBy("doc_id").agg(F.min("digest").alias("first"))
        others = classes.join(firsts, "doc_id").where("digest <> first").select("digest", (F.lit(top + 1) + F.monotonically_increasing_id()).alias("other"))
        classes = scratch.put(classes.join(scratch.put(others, "others"), "digest", "left").select("digest", "doc_id", F.coalesce("other", "doc_id").alias("node")), "classes")
        of_several = known.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct()
        bridges = scratch.put(of_several.join(classes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")), "bridges")
    else:
        classes = classes.withColumn("node", F.col("doc_id"))
    heads = led.join(classes, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return classes, scratch.put(heads.select(F.col("node").alias("x"), "doc_id", "digest", "n", "rare", "need", "lead"), "heads"), bridges


def _sizes_fit(a: str | Column, b: str | Column, num: int, den: int) -> Column:
    return F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b)


def _candidates(rows: DataFrame, leaders: DataFrame, apart: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(x, to, y) of the queries x and the members y of the groups opened for them. ``rows`` have
    shingles that several groups lead with."""
    # A member's standing at a shingle towards the leader of each size range next to its own.
    # over: shingles outside any partner there, as slack is counted; far: distance from the leader.
    near = F.filter("leaders", lambda p: (p["size"] == F.col("size")) | (F.abs(p["size"] - F.col("size")) <= 1) & (p["slack"] + F.col("slack") >= 0))
    entries = rows.join(leaders, "v").withColumn("p", F.explode(near)).select("v", "x", "g", "slack", "n", "rare", "size", F.col("p.size").alias("at"), F.col("p.x").alias("leader"))
    hot = F.col("v") >= F.lit(HOT)
    entries = entries.join(apart.select("x", F.col("y").alias("leader"), "apart"), ["x", "leader"], "left")
    far = F.when(~hot, F.lit(None)).when(F.col("x") == F.col("leader"), 0).otherwise(F.col("apart")) * F.lit(num + den)
    over = F.when(hot, F.lit(num + den) * F.col("rare") - F.lit(den - num) * F.col("n")).otherwise(-F.col("slack"))
    entries = entries.select("v", "at", "x", "g", "slack", "n", "size", over.alias("over"), F.coalesce(far, F.lit(0)).cast("long").alias("far_least"), F.coalesce(far, F.lit(1 << 50)).cast("long").alias("far_most"))
    entries = scratch.put(entries, "entries")

    matrix = entries.groupBy("v", "at", F.col("g").alias("to")).agg(
        F.max("slack").alias("to_slack"), F.min("over").alias("to_over"), F.min(F.col("over") - F.col("far_most")).alias("to_inner"), F.min(F.col("over") + F.col("far_least")).alias("to_outer"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    asked = entries.where("at = size")
    fits = (F.col("g") != F.col("to")) & (F.col("slack") <= F.col("to_slack")) & (F.col("slack") + F.col("to_slack") >= 0) & (F.col("over") + F.col("to_over") <= 0)
    fits &= (F.col("over") + F.col("far_least") + F.col("to_inner") <= 0) & (F.col("over") - F.col("far_most") + F.col("to_outer") <= 0)
    fits &= (F.lit(den) * F.col("n1") >= F.lit(num) * F.col("n")) & (F.lit(den) * F.col("n") >= F.lit(num) * F.col("n0"))
    bounded = scratch.put(asked.join(matrix, ["v", "at"]).where(fits).select("x", "to").distinct(), "bounded")

    # The overlap of a query with the union of a group's shingles.
    union = rows.select("v", F.col("g").alias("to")).distinct()
    overlap = bounded.join(rows.select("x", "v", "need"), "x").join(union, ["v", "to"]).groupBy("x", "to").agg(F.count("*").alias("c"), F.first("need").alias("need"))
    opened = scratch.put(overlap.where("c >= need").select("x", "to"), "opened")

    member = entries.select("v", "at", F.col("g").alias("to"), F.col("x").alias("y"), F.col("slack").alias("y_slack"), F.col("over").alias("y_over"), F.col("far_least").alias("y_least"), F.col("far_most").alias("y_most"), F.col("n").alias("y_n"))
    pairs = opened.join(asked, "x").join(member, ["v", "at", "to"])
    fits = (F.col("slack") + F.col("y_slack") >= 0) & (F.col("over") + F.col("y_over") <= 0) & _sizes_fit("n", "y_n", num, den)
    fits &= (F.col("over") + F.col("far_least") + F.col("y_over") - F.col("y_most") <= 0) & (F.col("over") - F.col("far_most") + F.col("y_over") + F.col("y_least") <= 0)
    pairs = scratch.put(pairs.where(fits).select("x", "to", "y").distinct(), "candidates")
    scratch.drop(entries, bounded, opened)
    return pairs


def _links(rows: DataFrame, kept: DataFrame, docs: DataFrame, heads: DataFrame, scratch: Scratch, k: int, num: int, den: int, frequent) -> DataFrame:
    """(a, b) links enough for the components of all."""
    best = F.max(F.struct("slack", (-F.col("x")).alias("back"), "n")).alias("l")
    leaders = rows.groupBy("v", "size").agg(best).select("v", F.struct("size", F.col("l.slack").alias("slack"), (-F.col("l.back")).alias("x"), F.col("l.n").alias("n")).alias("leader"))
    leaders = scratch.put(leaders.groupBy("v").agg(F.collect_list("leader").alias("leaders")), "leaders")

    near = F.filter("leaders", lambda p: (F.abs(p["size"] - F.col("size")) <= 1) & (p["slack"] + F.col("slack") >= 0) & (p["x"] != F.col("x")) & _sizes_fit(p["n"], F.col("n"), num, den))
    starred = rows.join(leaders, "v").select("x", F.explode(near).alias("p")).select("x", F.col("p.x").alias("y")).distinct()
    apart = _compare(_possible(starred, kept, scratch), docs, heads, scratch, k, num, den, frequent)
    links = apart.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = scratch.put(components(links, scratch).withColumnRenamed("node", "x"), "groups")
    grouped = scratch.put(_spread(kept.join(groups, "x", "left").withColumn("g", F.coalesce("component", "x")), num, den), "grouped")

    several = grouped.groupBy("v").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).where("g0 <> g1").select("v")
    contested = scratch.put(grouped.join(several, "v"), "contested")
    scratch.drop(grouped)
    pairs = _candidates(contested, leaders, apart, scratch, num, den).join(apart.select("x", "y"), ["x", "y"], "left_anti")
    pairs = scratch.put(pairs, "untried")
    shared = _possible(pairs, kept, scratch)
    pairs = scratch.put(pairs.join(shared, ["x", "y"]), "pairs")
    likeliest = pairs.groupBy("x", "to").agg(F.max(F.struct("shared", "y")).alias("m")).select("x", F.col("m.y").alias("y"))
    tried = _compare(likeliest, docs, heads, scratch, k, num, den, frequent)
    links = scratch.put(links.union(tried.where("linked").select("x", "y")), "links")
    merged = scratch.put(components(links, scratch), "merged")
    rest = pairs.select("x", "y")
    for side in ("x", "y"):
        rest = rest.join(merged.select(F.col("node").alias(side), F.col("component").alias(f"{side}_g")), side, "left").withColumn(f"{side}_g", F.coalesce(f"{side}_g", side))
    rest = rest.where("x_g <> y_g").join(tried.select("x", "y"), ["x", "y"], "left_anti").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    more = _compare(rest, docs, heads, scratch, k, num, den, frequent)
    return links.union(more.where("linked").select("x", "y"))


def _spread(kept: DataFrame, num: int, den: int) -> DataFrame:
    """One row for each shared shingle of a lead, with its slack and the range of sizes."""
    rows = kept.withColumn("t", F.explode("tokens")).withColumn("v", F.col("t.v"))
    slack = F.lit(den - num) * F.col("n").cast("long") - F.lit(num + den) * F.col("t.place")
    # documents of sizes that fit are at most one range apart
    return rows.withColumn("slack", slack).withColumn("size", F.floor(F.log(F.col("n")) / F.lit(math.log(den / num) * 1.0001)).cast("int")).drop("t", "tokens", "component")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles (of the set) and component_id (the smallest doc_id that links reach)."""
    if not 0 < num < den:
        raise ValueError("the least similarity num / den must be between 0 and 1")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = _frequent(docs, k, num, den)
    whole = scratch.put(_led(docs, k, num, den, frequent), "led")
    led = scratch.put(whole.select("doc_id", "n", "digest"), "sizes")
    classes, heads, bridges = _classes(whole, scratch)
    scratch.drop(whole)

    # Leading shingles that more than one class has; classes that share enough of them.
    common = scratch.put(_exchanged(heads).groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v"), "common")
    release(spark)
    rows = _exchanged(heads, bit_filter(common)).join(common, "v")
    narrow = scratch.put(heads.select("x", "doc_id", "digest"), "ids")
    kept = rows.groupBy("x").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("need").alias("need"), F.collect_list(F.struct("place", "v")).alias("tokens"))
    kept = scratch.put(kept.where(F.size("tokens") >= F.col("need")), "kept")
    scratch.drop(common, heads)

    links = _links(scratch.put(_spread(kept, num, den), "rows"), kept, docs, narrow, scratch, k, num, den, frequent)
    final = components(links if bridges is None else links.union(bridges), scratch)
    classes = classes.join(final.withColumnRenamed("component", "reached"), "node", "left").select("digest", F.coalesce("reached", "node").alias("component_id"))
    found = led.where("digest is not null").join(classes, "digest", "left").unionByName(led.where("digest is null").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
