"""SimHash near-duplicates with a Gray-order hierarchical index.

A document's fingerprint has bit b set if over half of its shingle hashes (XXH64, seed 42) have it set.
Fingerprints that differ in at most ``max_bits`` bits are linked; components of the links are the groups.

Plan. Copies meet first: only distinct fingerprints are compared. Each distinct fingerprint is sent to one
bucket for every choice of ``match`` out of ``blocks`` bit blocks, keyed by the bits of the chosen blocks.
With ``blocks - match >= max_bits`` differing bits can touch at most ``max_bits`` blocks, so two linked
fingerprints share a bucket. A partition of buckets is sorted by (bucket, Gray rank), and on it stands the
index: leaves are fingerprints, upper nodes are runs of neighbours in Gray order with the mask and the
pattern of the bits that all of the run share. A search walks down from the buckets, adds the differences
on the bits that a node newly fixes to those of its parent, and prunes the whole group once the sum
passes the threshold. Links found in one bucket leave it as a star of its local components: no pair is
lost for reachability and a bucket of n rows emits under n edges.

A bucket that holds more than ``CELL`` fingerprints is cut into pieces by Gray rank and its pairs of
pieces are dealt to separate cells, so one task never holds more than two pieces of one bucket.

The pipeline's stage (``alike``) links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such
sets' fingerprints differ in about ten bits of 64 and in over ``REACH`` with a probability below 1e-6, but blocks of bits
cannot partition so wide a search; there buckets are bands of minima of hashes over the set. In each bucket the index finds
the pairs within REACH bits, and 80 minima tell which are likely enough (``LIKELY``) to be looked at. What these connect is
searched by the index once more, with the sets at hand: only pairs whose sets have the similarity are joined. A link at
0.8 is missed with a probability of about 0.00003 (by all bands) and 0.00002 (by the minima);
what other links connect is not lost. No pair is listed.

Edge cases: null and empty texts have no shingle and the fingerprint zero, which links like any other; a
text of fewer words than a shingle has the whole sequence as its one shingle; rows that repeat a doc_id are
all returned; a null doc_id never becomes a component's name unless it is alone in it (then null);
empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, slices, small_batches, table, written

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
MATCH = 2
#: Fingerprints of one bucket that a cell holds from one piece.
CELL = 32768
#: Children of a node.
FANOUT = 8
#: (query, node) pairs looked at in one step, and queries that walk down together.
STEP = 1 << 20
QUERIES = 1024

_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number."""
    # bytes.split and bytes.lower know ASCII only: exactly the separators and letters that the contract names
    words = text.lower().split() if text else ()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype=">u8")
    n = len(h)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int((((counts * 2) > n).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the fingerprint as a long)."""

    def run(batches):
        for b in slices(batches):
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    r = fp.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Hierarchical index over codes sorted by (root, Gray rank); codes of one root are contiguous.

    ``levels`` goes from the leaves up; each level has for every node the shared bits (``mask``), their
    values (``pattern``), the bits that its parent does not share yet (``fresh``), and its children
    as a range of the level below.
    """

    def __init__(self, roots: np.ndarray, codes: np.ndarray):
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        self.codes = codes
        n = len(codes)
        self.levels = [{"mask": np.full(n, full), "pattern": codes, "first": np.arange(n), "last": np.arange(n) + 1, "upto": np.arange(n)}]
        owner = np.zeros(n, dtype=np.int64)
        if n:
            owner[1:] = np.cumsum(roots[1:] != roots[:-1])
        self.root_of = owner.copy()
        while n:
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            if len(starts) == len(owner) and len(self.levels) > 1:
                break
            within = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
            heads = np.flatnonzero(within % FANOUT == 0)
            low = self.levels[-1]
            every = np.bitwise_and.reduceat(low["pattern"], heads)
            some = np.bitwise_or.reduceat(low["pattern"], heads)
            shared = np.bitwise_and.reduceat(low["mask"], heads) & ~(every ^ some)
            last = np.append(heads[1:], len(owner))
            # patterns are zero outside their mask, so the shared bits decide what a group has in common
            low["fresh"] = low["mask"] & ~np.repeat(shared, last - heads)
            self.levels.append({"mask": shared, "pattern": every & shared, "first": heads, "last": last, "upto": low["upto"][last - 1]})
            owner = owner[heads]
        if n:
            self.levels[-1]["fresh"] = self.levels[-1]["mask"]

    def components(self, limit: int, link=None) -> np.ndarray:
        """Smallest position that each code reaches by links of at most ``limit`` bits under its root; link(label, i, j), if
        given, decides which of the pairs within the limit are joined.

        Links are merged as they are found and never kept. A group whose codes are all in the query's
        component already is pruned like one that is too far away, so a dense group costs no pairs.
        """
        n, top = len(self.codes), len(self.levels) - 1
        label = np.arange(n)
        for at in range(0, n, QUERIES):
            query = np.arange(at, min(n, at + QUERIES))
            lows, highs = [label], [label]
            for nodes in self.levels[1:]:
                lows.append(np.minimum.reduceat(lows[-1], nodes["first"]))
                highs.append(np.maximum.reduceat(highs[-1], nodes["first"]))
            stack = [(top, query, self.root_of[query], np.zeros(len(query), dtype=np.int64))]
            while stack:
                level, q, node, seen = stack.pop()
                if len(q) > STEP:
                    for part in range(0, len(q), STEP):
                        stack.append((level, q[part : part + STEP], node[part : part + STEP], seen[part : part + STEP]))
                    continue
                nodes = self.levels[level]
                seen = seen + np.bitwise_count((self.codes[q] ^ nodes["pattern"][node]) & nodes["fresh"][node])
                # a pair is found from its smaller side only
                keep = (seen <= limit) & (nodes["upto"][node] > q)
                if level:
                    keep &= (lows[level][node] != label[q]) | (highs[level][node] != label[q])
                q, node, seen = q[keep], node[keep], seen[keep]
                if not len(q):
                    continue
                if level == 0:
                    (link or join)(label, q, node)
                    continue
                first, count = nodes["first"][node], nodes["last"][node] - nodes["first"][node]
                q, seen = np.repeat(q, count), np.repeat(seen, count)
                child = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(q))
                stack.append((level - 1, q, child, seen))
        return label


def join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the components of i and j; label[x] is the smallest position of x's component, before and after."""
    while True:
        a, b = label[i], label[j]
        if np.array_equal(a, b):
            return
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def bucket_keys(fp, blocks: int, match: int):
    """Column of keys, one for each choice of blocks: the number of the choice and the chosen bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), match)):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.struct(F.lit(n).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def celled(keyed: DataFrame, cell: int, name: str) -> DataFrame:
    """keyed(key, fp, ...) -> root, fp, ...: rows of one key share a root; of a key with more than ``cell`` rows every two
    pieces share one."""
    sized = keyed.groupBy("key").count()
    # only keys over a cell need pieces; the others are found by their absence
    large = written(sized.filter(F.col("count") > cell).withColumn("pieces", F.ceil(F.col("count") / cell)).select("key", "pieces"), name)
    keyed = keyed.join(large, "key", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)).cast("int"))
    # piece: pseudo-random, so that pieces are even; the index sorts each cell by Gray rank itself
    keyed = keyed.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda k: F.struct(F.least(k, F.col("piece")).alias("lo"), F.greatest(k, F.col("piece")).alias("hi")))
    rest = [c for c in keyed.columns if c not in ("key", "pieces", "piece")]
    return keyed.select(*rest, F.explode(cells).alias("cell"), "key").select(F.xxhash64("key", "cell").alias("root"), *rest)


def by_root(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "root").sortWithinPartitions("root")


def edges(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, match: int = MATCH) -> DataFrame:
    """distinct(fp) -> (a, b), a < b: stars that connect what the links connect, bucket by bucket."""
    if blocks - match < max_bits:
        raise ValueError("blocks - match must be at least max_bits, or links are lost")
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), blocks, match)).alias("key"))
    run = searching(lambda t: t.column("fp").to_numpy(), lambda t, order: None, max_bits)
    keyed = by_root(celled(keyed, CELL, "simhash-large").select("root", "fp"))
    return keyed.mapInArrow(run, "a long, b long").filter("a != b").distinct()


def searching(names_of, links_of, limit: int, rows: int = 200_000, size: int = 1 << 27):
    """A function over batches (root, fp, ...) sorted by root: the stars (a, b) of what the index connects under each root.

    names_of(table) gives the names of its rows; links_of(table, order), with the positions of the codes in the index, the check of
    pairs or None. Roots that come whole are searched once ``rows`` rows or ``size`` bytes are held.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(final: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            roots = t.column("root").to_numpy()
            # the last root may go on in the next batch
            cut = len(roots) if final else int(np.searchsorted(roots, roots[-1], side="left"))
            rest = t.slice(cut)
            held[:] = rest.to_batches() if len(rest) else []
            r = roots[:cut]
            if not len(r):
                return None
            alone = np.ones(len(r), dtype=bool)
            alone[1:] &= r[1:] != r[:-1]
            alone[:-1] &= r[1:] != r[:-1]
            t = t.take(pa.array(np.flatnonzero(~alone)))
            r, c = r[~alone], t.column("fp").to_numpy().astype(np.uint64)
            order = np.lexsort((gray_rank(c), r))
            label = GrayIndex(r[order], c[order]).components(limit, links_of(t, order))
            moved = np.flatnonzero(label != np.arange(len(c)))
            names = names_of(t)
            x, y = names[order[moved]], names[order[label[moved]]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        for batch in slices(batches, 10_000):
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
                out = flush(False)
                if out is not None:
                    yield out
        if held:
            out = flush(True)
            if out is not None:
                yield out

    return run


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): the smallest node that each linked node reaches.

    Large-star and small-star steps in turn, as joins with aggregated minima, until nothing moves. Each
    round's edges are written, which cuts the lineage. A hub's edges are only aggregated (partially first)
    and joined with one row, so its edges may be split over tasks.
    """
    now = written(links.select("a", "b"), "cc-0")
    k = 0
    while True:
        # large star: every neighbour above a node goes to the smallest one that the node sees
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), f"cc-{k}-low")
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        large = written(large, f"cc-{k}-large")
        # small star: a node and its neighbours below it go to the smallest of them
        low = written(large.groupBy("b").agg(F.min("a").alias("m")), f"cc-{k}-small-low")
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a != b").distinct()
        k += 1
        after = written(small, f"cc-{k}")
        if now.count() == after.count() and now.exceptAll(after).isEmpty():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now = after


def groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, max_bits: int = MAX_BITS, blocks: int = BLOCKS, match: int = MATCH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id: the smallest doc_id that a document reaches."""
    with passing(docs.sparkSession):
        fps = written(fingerprints(docs, shingle, seed), "simhash-fps", keep=True)
        distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
        comp = components(edges(distinct, max_bits, blocks, match))
        named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        named = written(named, "simhash-roots")
        best = written(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-best")
        names = written(named.join(best, "root").select("fp", "component_id"), "simhash-names", keep=True)
    return fps.join(names, "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir) -> DataFrame:
    g = groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- texts whose sets of shingles are alike -----------------------------------------------------------------------

#: Words of a shingle and similarity of sets.
SET_SHINGLE = 5
SIMILARITY = 0.8
#: Bits within which fingerprints of like sets lie, and the share of equal minima from which a pair is looked at.
REACH = 26
LIKELY = 0.6
#: Bands of a signature, and minima of a band (one byte each).
BANDS = 20
BAND = 4
#: Sets of one group that a cell holds from one piece.
SET_CELL = 4096

_FACTORS = np.random.default_rng(20240517).integers(1, 2**63, BANDS * BAND, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = SET_SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; a text of fewer words than a shingle has one."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + shingle]), seed) for k in range(max(1, len(words) - shingle + 1))], dtype=np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """One byte of the smallest of each of the hashes' permutations."""
    best = np.full(len(_FACTORS), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        # odd factors permute; the high bits decide the order
        np.minimum(best, (hashes[at : at + 4096, None] * _FACTORS).min(axis=0), out=best)
    return (best ^ (best >> np.uint64(29))).astype(np.uint8).tobytes()


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes, as a signed 64-bit number."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int((((counts * 2) > len(hashes)).astype(np.uint64) << _SHIFTS).sum(dtype=np.uint64).astype(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held (what tells texts of one doc_id apart), name (digest of the words in lower case), fp and
    sig of the set of shingles (null if there is none)."""

    def run(batches):
        for b in slices(batches):
            out = []
            for t in b.column(1):
                words = (t.as_py() or b"").lower().split()
                found = shingle_set(words)
                out.append((name_of(words), majority(found) if words else None, signature(found) if words else None))
            cols = list(zip(*out, strict=True)) or [()] * 3
            kinds = [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "held", "name", "fp", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held(F.col("text")).alias("held"))
    return texts.mapInArrow(run, f"doc_id {kind}, held binary, name binary, fp long, sig binary")


def sets(docs: DataFrame) -> DataFrame:
    """docs(text) -> name, hashes: 32 bits of each shingle's, ascending, as bytes. A task gives a name once, as far as it
    remembers."""

    def run(batches):
        seen: set[bytes] = set()
        for b in slices(batches):
            names, out = [], []
            for t in b.column(0):
                words = (t.as_py() or b"").lower().split()
                name = name_of(words)
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    out.append(np.unique((shingle_set(words) >> np.uint64(32)).astype(np.uint32)).tobytes())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(out, pa.binary())], names=["name", "hashes"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "name binary, hashes binary")


def name_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def held(text):
    """What tells texts of one doc_id apart."""
    return F.unhex(F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary"))))


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def _likely(t: pa.Table, order: np.ndarray):
    sig = _bytes(t.column("sig"), BANDS * BAND)[order]

    def link(label, i, j):
        for at in range(0, len(i), 65536):
            a, b = i[at : at + 65536], j[at : at + 65536]
            near = (sig[a] == sig[b]).sum(axis=1) >= LIKELY * BANDS * BAND
            join(label, a[near], b[near])

    return link


def _alike(similarity: float):
    def links_of(t: pa.Table, order: np.ndarray):
        sig, sets = _bytes(t.column("sig"), BANDS * BAND)[order], t.column("hashes")

        def link(label, i, j):
            for at in range(0, len(i), 65536):
                a, b = i[at : at + 65536], j[at : at + 65536]
                near = ((sig[a] == sig[b]).sum(axis=1) >= LIKELY * BANDS * BAND) & (label[a] != label[b])
                for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                    if label[x] != label[y] and jaccard(sets[order[x]].as_buffer(), sets[order[y]].as_buffer()) >= similarity:
                        join(label, np.array([x]), np.array([y]))

        return link

    return links_of


def jaccard(x, y) -> float:
    """Similarity of two sets of 32-bit hashes, given ascending as bytes."""
    a, b = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return n / (len(a) + len(b) - n)


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("id").to_numpy()


def alike(docs: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(text), sketched (see ``sketches``) -> name, root: the same for names that links connect; names without links are left out.

    Between steps only numbers of names travel. The sets of what may be linked are made when they are known: the join
    moves one set a name, whatever the planner thinks of the other side's size, so that the plan is that of large tables.
    """
    distinct = sketched.filter("sig IS NOT NULL").groupBy("name").agg(F.min("fp").alias("fp"), F.min("sig").alias("sig"))
    # numbers are unique, and final once the table is written
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()), "alike-distinct")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * BAND + 1, BAND)) for k in range(BANDS)])
    banded = distinct.select("id", F.explode(bands).alias("key"))
    # names whose band nobody shares have nothing to be compared with; only keys are shuffled to tell
    shared = written(banded.select("key").groupBy("key").count().filter("count > 1").select("key"), "alike-shared")
    asked = written(banded.join(shared.hint("merge"), "key", "left_semi"), "alike-asked")
    keyed = asked.join(distinct.select("id", "fp", "sig").hint("merge"), "id")
    likely = by_root(celled(keyed, CELL, "alike-large")).mapInArrow(searching(_ids, _likely, REACH), "a long, b long")
    near = written(components(likely.filter("a != b").distinct()), "alike-likely")
    near = near.select("node", "root").unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    near = written(near.join(distinct, F.col("node") == F.col("id")).select("name", "id", "fp", "sig", F.col("root").alias("key")), "alike-members")
    made = sets(docs).groupBy("name").agg(F.min("hashes").alias("hashes"))
    made = written(made.join(near.hint("merge"), "name").select("key", "id", "fp", "sig", "hashes"), "alike-sets")
    checked = by_root(celled(made, SET_CELL, "alike-cells")).mapInArrow(searching(_ids, _alike(similarity), REACH), "a long, b long")
    linked = written(components(checked.filter("a != b").distinct()), "alike-linked")
    linked = linked.select("node", "root").unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    return linked.join(near.select("id", "name"), F.col("node") == F.col("id")).select("name", "root")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of documents whose texts are linked (``alike``: five words, 0.8) one stays, that with the
    smallest doc_id. Documents are rows: rows that share a doc_id, or have none, are told apart by their texts, and of those
    that share both the smallest by its columns stays. Texts without words are one group.

    What goes is joined with the texts by a sort: it grows with the table, so nothing is broadcast.
    """
    small_batches(spark)
    with passing(spark):
        sketched = written(sketches(docs), "alike-sketches")
        rows = written(sketched.groupBy("name", "doc_id", "held").agg(F.count(F.lit(1)).alias("n")), "alike-rows")
        roots = written(alike(docs, sketched), "alike-roots")
        group = F.struct(F.col("root"), F.when(F.col("root").isNull(), F.col("name")).alias("name"))
        order = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "held")
        rows = written(rows.join(roots, "name", "left").select(group.alias("group"), order.alias("order"), "n"), "alike-ordered")
        first = written(rows.groupBy("group").agg(F.min("order").alias("first"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("all")), "alike-first")
        # most rows are alone in their group, and need no more
        marked = rows.join(first.filter("all > 1"), "group")
        marked = written(marked.select(F.col("order.doc_id").alias("own_id"), F.col("order.held").alias("own_text"), (F.col("order") == F.col("first")).alias("stays"), "n"), "alike-marked")
        goes = written(marked.filter("NOT stays").select("own_id", "own_text"), "alike-goes", keep=True)
        twice = written(marked.filter("stays AND n > 1").select("own_id", "own_text"), "alike-twice", keep=True)
    hit = docs["doc_id"].eqNullSafe(F.col("own_id")) & (held(docs["text"]) == F.col("own_text"))
    kept = docs.join(goes.hint("merge"), hit, "left_anti")
    if not twice.isEmpty():
        again = kept.join(twice, hit, "left_semi")
        once = again.groupBy("doc_id", held(F.col("text")).alias("held")).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
        kept = kept.join(twice, hit, "left_anti").unionByName(once)
    return kept.select(*docs.columns)
