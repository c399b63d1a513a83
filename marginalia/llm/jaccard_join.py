"""Operator 3: exact n-gram Jaccard join by size-banded tiles with bitmap signatures.

Every distinct shingle set gets a bitmap of its hashed shingles and a prefix: its rarest shingles, one more than a partner may lack. Two
linked sets share a prefix shingle, so each such shingle is a tile, in which the sets stand by size and only sets within the size band meet. For two that meet, bits set in
only one bitmap are shingles that the other lacks; that bounds the overlap from above. What passes is settled by intersecting the
sorted hash arrays. The result is components, so a pair that links connect already needs no settling: sets first meet one leader of their tile, then one partner of another
group. In tiles where more stays apart, the arrays themselves come to the tile, which settles its pairs and gives only links that join two groups: one less than it has sets at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import by_key, documents, written
from .components import components, lowest, moved
from .shingles import sets
from .words import Table, mix

#: Shingles that are counted together to find common ones, and how many common ones are known to all tasks. They only order prefixes: any list gives the same links.
CHUNK, COMMON = 1 << 21, 1 << 17
#: Sets of a tile that a task holds at most, twice, and their shingles, but for single sets that have more; ids that are broadcast at most.
BLOCK, BLOCK_SHINGLES, FEW = 8192, 1 << 21, 1 << 20


def common_shingles(docs: DataFrame, size: int, text: str = "text") -> tuple[np.ndarray, int]:
    """Shingles that repeat among neighbouring rows, by rising count: the most common ``COMMON`` of all rows; and how many of them more than ``BLOCK`` times."""

    def run(batches):
        held, n = [], 0

        def flush():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            many = c > 1
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(c[many])], ["h", "c"])

        for batch in batches:
            for _, _, s, _ in sets(batch.column(0), size):
                held.append(s)
                n += len(s)
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counts = docs.select(text).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.filter("c >= 4").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    return top["h"].to_numpy().view(np.uint64)[::-1].copy(), int((top["c"].to_numpy() > BLOCK).sum())


def bitmap(s: np.ndarray, least: int = 2) -> bytes:
    """The set's hashed bitmap, of ``least`` bits a shingle or up to twice as many (a power of two, 64 at least)."""
    m = max(64, least << (len(s) - 1).bit_length())
    bits = np.zeros(m, np.uint8)
    bits[(mix(s) & np.uint64(m - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def signatures(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n (set size), s (a hash of the whole set; null if it is empty), bitmap, prefix.

    A prefix shingle that many sets may have is keyed by bands of set sizes as well, its set's own and the next, so that sets of like sizes share a key and no key has all of them.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)  # COMMON at most

    def run(batches):
        shared, many = sent.value
        rank_of = Table(shared, np.arange(1, len(shared) + 1), 0)
        least_hot = len(shared) - many
        for batch in batches:
            for i, j, s, first in sets(batch.column(1), size):
                rank = rank_of(s)
                n = np.diff(first)
                row = np.repeat(np.arange(j - i), n)
                order = np.lexsort((s, rank, row))
                whole = np.zeros(j - i, np.uint64)
                np.add.at(whole, row, mix(s ^ np.uint64(0x5851F42D4C957F2D)))
                whole = mix(whole + n.astype(np.uint64)).view(np.int64)
                keep = n - -(-percent * n // 100) + 1
                marks, prefixes = [], []
                for k in range(j - i):
                    lo = first[k]
                    marks.append(bitmap(s[lo : first[k + 1]]) if n[k] else None)
                    at = order[lo : lo + keep[k]]
                    hot = rank[at] > least_hot
                    own = s[at]
                    if hot.any():
                        band = int(np.log(n[k]) / np.log(100 / percent) + 1e-9) if percent < 100 else int(n[k])
                        own = np.concatenate([own[~hot], *(mix(own[hot] + np.uint64(b)) for b in (band, band + 1))])
                    prefixes.append(own.view(np.int64) if n[k] else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(whole, mask=n == 0), pa.array(marks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "s", "bitmap", "prefix"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), text).mapInArrow(run, f"id {kind}, n bigint, s bigint, bitmap binary, prefix array<bigint>")


def _whole_keys(batches):
    """Runs of whole keys (the first column) out of sorted batches, as lists of arrays: the last key of a batch may go on in the next."""
    rest = None
    for batch in batches:
        t = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        if rest is not None:
            t = [np.concatenate([x, y]) for x, y in zip(rest, t, strict=True)]
        last = int(np.searchsorted(t[0], t[0][-1])) if len(t[0]) else 0
        rest = [x[last:] for x in t]
        if last:
            yield [x[:last] for x in t]
    if rest is not None and len(rest[0]):
        yield rest


def tile_rows(signed: DataFrame, percent: int) -> DataFrame:
    """(tile, s, n): the sets of like sizes that share a prefix shingle, as a written table. Shingles that the very same sets share make one tile.

    A tile of more than ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles is cut, by size, into blocks; each two blocks whose sizes are within the band are a tile of their own.
    """
    distinct = signed.filter("s is not null").select("s", "n", "prefix").dropDuplicates(["s"])
    rows = distinct.select(F.explode("prefix").alias("key"), "s", "n").repartition("key").sortWithinPartitions("key", "n", "s")

    def run(batches):
        for key, s, n in _whole_keys(batches):
            # A gap in the sizes that is wider than the band ends a tile as well.
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])]))
            count = np.diff(np.append(first, len(key)))
            tile = mix(np.add.reduceat(mix(s.view(np.uint64)), first) + count.astype(np.uint64)).view(np.int64)
            large = (count > BLOCK) | (np.add.reduceat(n, first) > BLOCK_SHINGLES)
            some = np.repeat((count > 1) & ~large, count)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tile, count)[some]), pa.array(s[some]), pa.array(n[some])], ["tile", "s", "n"])
            for k in np.flatnonzero(large & (count > 1)):
                for i, j in _blocks(n[first[k] : first[k] + count[k]], percent):
                    at = first[k] + np.unique(np.concatenate([i, j]))
                    own = mix(np.array([int(tile[k]) ^ int(i[0]) * 0x9E37 ^ int(j[0]) << 20], np.int64).view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(at))), pa.array(s[at]), pa.array(n[at])], ["tile", "s", "n"])

    return written(rows.mapInArrow(run, "tile bigint, s bigint, n bigint").distinct(), "tiles")


def _blocks(n: np.ndarray, percent: int):
    """Pairs of blocks (their places) of rising sizes ``n`` that hold sets within the band of each other, or the block alone."""
    cuts, total = [0], np.cumsum(n)
    while cuts[-1] < len(n):
        k = cuts[-1]
        full = int(np.searchsorted(total, (total[k - 1] if k else 0) + BLOCK_SHINGLES, "right"))
        cuts.append(min(max(full, k + 1), k + BLOCK, len(n)))
    blocks = [np.arange(i, j) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, x in enumerate(blocks):
        near = [y for y in blocks[i + 1 :] if 100 * n[x[-1]] >= percent * n[y[0]]]
        for y in near or [x]:
            yield x, y


def _matrices(marks: np.ndarray):
    """For each run of bitmaps of one width: (first, end, matrix of these and of those of double width, folded to this one)."""
    width = np.array([len(m) for m in marks])
    edges = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1], [True]]))
    parts = [np.frombuffer(b"".join(marks[lo:hi]), np.uint64).reshape(hi - lo, -1) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    for i, x in enumerate(parts):
        if i + 1 < len(parts) and parts[i + 1].shape[1] == 2 * (w := x.shape[1]):
            x = np.concatenate([x, parts[i + 1][:, :w] | parts[i + 1][:, w:]])
        yield edges[i], edges[i + 1], x


def may_link(n: np.ndarray, x: np.ndarray, k: int, c: np.ndarray, percent: int) -> np.ndarray:
    """Those of the sets ``c`` whose bitmaps let them be linked with set ``k``: bits of one bitmap only are shingles that the other set lacks."""
    only_k = np.bitwise_count(x[k] & ~x[c]).sum(1, dtype=np.int64)
    only_c = np.bitwise_count(x[c] & ~x[k]).sum(1, dtype=np.int64)
    most = np.minimum(n[k] - only_k, n[c] - only_c)
    return c[100 * most >= percent * (n[k] + n[c] - most)]


def _leaders(percent: int):
    """Each set with the first set of its tile that its bitmap lets it be linked with, if that has no such set itself."""

    def run_of(s, n, group, marks):
        free = np.ones(len(s), bool)
        ends = np.searchsorted(n, (100 * n) // percent, "right")
        for lo, hi, x in _matrices(marks):
            for k in range(lo, hi):
                if free[k] and ends[k] > k + 1:
                    c = np.flatnonzero(free[k + 1 : ends[k]]) + k + 1
                    hit = may_link(n[lo : lo + len(x)], x, k - lo, c - lo, percent) + lo
                    free[hit] = False
                    yield k, hit, False

    return run_of


def _apart(percent: int):
    """Each set of a tile with one partner of another group that their bitmaps let it be linked with, and whether it has more such partners."""

    def run_of(s, n, group, marks):
        if (group == group[0]).all():
            return
        ends = np.searchsorted(n, (100 * n) // percent, "right")
        for lo, hi, x in _matrices(marks):
            for k in range(lo, hi):
                c = np.flatnonzero(group[k + 1 : ends[k]] != group[k]) + k + 1
                if len(c):
                    hit = may_link(n[lo : lo + len(x)], x, k - lo, c - lo, percent) + lo
                    yield k, hit[:1], len(hit) > 1

    return run_of


def meet(rows: DataFrame, run_of, leads: bool) -> DataFrame:
    """(a, b, tile): the pairs that ``run_of`` finds in the tiles of ``rows`` (tile, s, n, g, bitmap), and, with null pairs, the tiles that have more.

    A set is ``b`` once a tile at most: ``a`` is the set that led the others, or the one that was found.
    """

    def run(batches):
        for tile, s, n, g, marks in _whole_keys(batches):
            edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
            found, more = [np.zeros((0, 2), np.int64)], []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own, rest = s[lo:hi], False
                for k, hit, cut in run_of(own, n[lo:hi], g[lo:hi], marks[lo:hi]):
                    rest |= cut
                    if len(hit):
                        found.append(np.stack(np.broadcast_arrays(*((own[k], own[hit]) if leads else (own[hit], own[k]))), 1))
                if rest:
                    more.append(int(tile[lo]))
            pairs = np.unique(np.concatenate(found), axis=0)
            none, blank = pa.nulls(len(more), pa.int64()), pa.nulls(len(pairs), pa.int64())
            columns = [(pa.array(pairs[:, 0]), none), (pa.array(pairs[:, 1]), none), (blank, pa.array(more, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "tile"])

    by_tile = rows.select("tile", "s", "n", "g", "bitmap").repartition("tile").sortWithinPartitions("tile", "n", "s")
    return by_tile.mapInArrow(run, "a bigint, b bigint, tile bigint").distinct()


def arrays_of(docs: DataFrame, signed: DataFrame, wanted: DataFrame, size: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(s, hashes): the sorted shingle hashes of the sets in ``wanted`` (column s), from one document each, as a written table."""
    one = signed.join(wanted, "s", "left_semi").groupBy("s").agg(F.min("id").alias("id"))
    # A short list of ids goes to the texts; a long one and the texts are both dealt by id.
    one = F.broadcast(one) if wanted.count() <= FEW else one
    rows = docs.select(F.col(id).alias("id"), text).join(one, "id").select("s", text)

    def run(batches):
        for batch in batches:
            for i, j, s, first in sets(batch.column(1), size):
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["s", "hashes"])

    return written(rows.mapInArrow(run, "s bigint, hashes array<bigint>"), "arrays")


def settled(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked, by exact intersection, as a written table. Partners of a set come to where it is; a set with many is sent to several tasks."""
    many = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / 256)).alias("part"))
    hashes = lambda c: arrays.select(F.col("s").alias(c), "hashes")
    own = dealt.select("a", "part").distinct().join(hashes("a"), "a").select("a", "part", F.lit(None).cast("bigint").alias("b"), "hashes")
    others = dealt.join(hashes("b"), "b").select("a", "part", "b", "hashes")
    rows = own.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        x = None
        for batch in batches:
            found_a, found_b = [], []
            values = batch.column(3)
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                y = values[k].values.to_numpy()
                if b is None:
                    x = y.view(np.uint64)
                    continue
                o = len(np.intersect1d(x, y.view(np.uint64), assume_unique=True))
                if 100 * o >= percent * (len(x) + len(y) - o):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return written(rows.mapInArrow(run, "a bigint, b bigint"), "links")


def _overlaps(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sorted arrays shares with ``x``."""
    flat = np.concatenate(others)
    at = np.searchsorted(x, flat)
    same = x[np.minimum(at, len(x) - 1)] == flat
    return np.add.reduceat(same, np.cumsum([0, *(len(o) for o in others[:-1])]), dtype=np.int64)


def joining_links(s: np.ndarray, n: np.ndarray, group: np.ndarray, met: np.ndarray, hashes: list[np.ndarray], percent: int):
    """Pairs of places in one tile (sets by rising size) whose sets are linked, as far as they join two groups. Sets that share ``met`` have been settled together before."""
    lab = np.unique(group, return_inverse=True)[1]
    ends = np.searchsorted(n, (100 * n) // percent, "right")
    marks = np.array([bitmap(h, 16) for h in hashes], object)
    for lo, hi, x in _matrices(marks):
        for k in range(lo, hi):
            c = np.arange(k + 1, ends[k])
            c = c[(lab[c] != lab[k]) & ((met[c] != met[k]) | (met[k] == 0))]
            if len(c):
                c = may_link(n[lo : lo + len(x)], x, k - lo, c - lo, percent) + lo
            while len(c):
                some, c = c[:64], c[64:]
                o = _overlaps(hashes[k], [hashes[j] for j in some])
                for j in some[100 * o >= percent * (n[k] + n[some] - o)]:
                    if lab[j] != lab[k]:
                        yield k, j
                        lab[lab == lab[j]] = lab[k]
                c = c[lab[c] != lab[k]]


def settled_in_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the groups of each tile of ``rows`` (tile, s, n, g, met, hashes), as a written table: fewer than its sets. A tile's arrays are held together; ``tile_rows`` bounds them."""

    def links_of(tile):
        s, n, g, met = (np.concatenate([b.column(c).to_numpy() for b in tile]) for c in ("s", "n", "g", "met"))
        if len(s) < 2 or (g == g[0]).all():
            return
        hashes = [x.values.to_numpy().view(np.uint64) for b in tile for x in b.column("hashes")]
        pairs = [(s[k], s[j]) for k, j in joining_links(s, n, g, met, hashes, percent)]
        yield pa.RecordBatch.from_arrays([pa.array([int(p[i]) for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches):
        for _, own in by_key(batches, "tile"):
            yield from links_of(list(own))

    dealt = rows.select("tile", "s", "n", "g", "met", "hashes").repartition("tile").sortWithinPartitions("tile", "n", "s")
    return written(dealt.mapInArrow(run, "a bigint, b bigint"), "links")


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n_shingles and component_id, the smallest id reachable by links (100 * intersection >= percent * union of shingle sets).

    Texts without words (and nulls) have empty sets, link with nothing and are their own component. Rows with equal sets are one component, repeated ids
    included; a null id never names a component unless all its rows have it; an empty table gives an empty result; other columns, whatever their names, aren't read.
    Sets are known by 64-bit hashes of shingles and of sets.
    """
    docs = docs.select(id, text)
    signed = written(signatures(docs, size, percent, common_shingles(docs, size, text), id, text), "signed")
    tiles = tile_rows(signed, percent)
    marks = signed.filter("s is not null").select("s", "bitmap").dropDuplicates(["s"])
    ends = lambda pairs: written(pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct(), "ends")
    arrays = lambda sets_of: arrays_of(docs, signed, sets_of, size, id, text)

    def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
        """With ``g``, a set that links lead to in two steps at most: sets that share it are in one component."""
        low = lowest(links)
        return moved(moved(rows.withColumn("g", F.col("s")), low, "g"), low, "g")

    # Sets meet leaders first, then one partner of another group each.
    led = written(meet(tiles.withColumn("g", F.col("s")).join(marks, "s"), _leaders(percent), True), "pairs").select("a", "b")
    links = settled(led, arrays(ends(led)), percent)
    met = written(meet(grouped(tiles, links).join(marks, "s"), _apart(percent), False), "pairs")
    both_ways = led.union(led.select("b", "a"))
    few = written(met.filter("tile is null").select("a", "b").join(both_ways, ["a", "b"], "left_anti"), "pairs")
    links = links.union(settled(few, arrays(ends(few)), percent))
    # What is left settles in its tiles: each set in the largest of its tiles first, so that most of it joins there, and then the groups that are left, in all of them.
    tiles = written(tiles.join(met.filter("tile is not null").select("tile"), "tile", "left_semi"), "tiles")
    if not tiles.isEmpty():
        sizes = tiles.groupBy("tile").agg(F.count("*").alias("k"))
        best = tiles.join(sizes, "tile").groupBy("s").agg(F.max_by("tile", F.struct("k", "tile")).alias("met"))
        dense = arrays(written(tiles.select("s").distinct(), "ends"))
        homes = written(grouped(tiles.join(written(best, "best"), "s"), links), "homes")
        links = links.union(settled_in_tiles(homes.filter("tile = met").withColumn("met", F.lit(0).cast("bigint")).join(dense, "s"), percent))
        rest = written(grouped(homes, links), "homes")
        open_tiles = rest.groupBy("tile").agg((F.min("g") < F.max("g")).alias("groups"), (F.min("met") < F.max("met")).alias("homes")).filter("groups and homes").select("tile")
        links = links.union(settled_in_tiles(rest.join(written(open_tiles, "open"), "tile", "left_semi").join(dense, "s"), percent))
    return _named(signed.select("id", "n", "s"), components(links), id)


def _named(signed: DataFrame, roots: DataFrame, id: str) -> DataFrame:
    """Rows with the smallest id of their component. Minima are written before rows meet them, so that Spark may split the rows of a set with many copies, or of a large component."""
    copies = signed.filter("s is not null").groupBy("s").agg(F.min("id").alias("own"))
    sets_ = written(copies.join(roots.select(F.col("node").alias("s"), "root"), "s", "left").withColumn("root", F.coalesce("root", "s")), "sets")
    least = written(sets_.groupBy("root").agg(F.min("own").alias("least")), "least")
    of_set = written(sets_.join(least, "root").select("s", "least"), "least")
    out = signed.join(of_set, "s", "left").select("id", "n", F.when(F.col("s").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir).select("doc_id", "text"), 4, 85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, s, len(s) AS n FROM s), g AS (SELECT doc_id, n, unnest(s) AS g FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.root)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id
"""
