"""Operator 11: a trie of conversation prefixes by Patricia construction.

Conversations are sequences of turn hashes. Equal sequences are counted once, the distinct ones are sorted, and neighbours are compared: the lengths of their common prefixes say
where the trie branches. So only branch, end and leaf points are made, each with the compressed edge above it, and all sums are taken on these. At last the nodes inside an
edge, which have one child each and the members of the point below, are made from the edge's suffix sums.

A sequence is cut into segments of ``SEGMENT`` turns. Segments behind the same prefix are a tile, a small trie of its own that hangs on the end of a segment; so no row grows with a
conversation. Sorted tiles are worked on in runs of rows, and a point's parts from several runs are added up, so that neither a hot first turn nor a large group of copies meets in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import SPACE, by_key, written

#: Turns of a segment; rows of sorted segments that are worked on together; ids whose text is hashed together.
SEGMENT, RUN, IDS = 128, 4096, 1 << 16
#: Fixed values of the contract: conversations of a group of so many begin with turns of its first, fewer than ``HEADS``.
GROUP, HEADS = 20, 4
EMPTY = hashlib.sha256().hexdigest()
POINT = ["depth", "p1", "p2"]


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words): two hashes of role and text instead of these, and the words of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")
    some = rows.filter("conv_id IS NOT NULL")
    return some.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), words.alias("words"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` (from 1): the place of each turn in its conversation, by turn (nulls first), then by hash. A written table.

    Rows are sorted over all tasks by ranges, so a conversation may span many. Each task counts on from its own first row; what a conversation has in tasks before is added to it.
    """
    tied = written(rows, "turns").withColumn("__tie", F.monotonically_increasing_id())
    by = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2", "__tie"]
    cut = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie", "turn")

    def run(batches):
        task = TaskContext.get().partitionId()
        for _, own in by_key(batches, "conv_id"):
            n = 0
            for batch in own:
                rank, n = np.arange(n + 1, n + 1 + batch.num_rows), n + batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64()), pa.array([task] * batch.num_rows, pa.int64())], [*batch.schema.names, "rank", "task"])

    ranked = written(cut.mapInArrow(run, "conv_id bigint, t1 bigint, t2 bigint, words bigint, rank bigint, task bigint"), "ranked")
    counts = ranked.groupBy("conv_id", "task").count()
    before = F.sum("count").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    carried = counts.select("conv_id", "task", before.alias("__before")).filter("__before IS NOT NULL")  # the first conversation of a task at most, so a row a task
    out = ranked.join(F.broadcast(carried), ["conv_id", "task"], "left")
    return out.select("conv_id", "t1", "t2", "words", (F.col("rank") + F.coalesce("__before", F.lit(0))).alias("rank"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): (conv_id, depth, g1, g2, words) and (conv_id, n) of conversations that begin with the first turns of their group's first one. g1 and g2 also hash the depth."""
    heads = rows.filter((F.pmod("conv_id", F.lit(GROUP)) == 0) & (F.col("rank") < HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("rank", "t1", "t2", "words"))).alias("head"))  # three at most
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = rows.groupBy("conv_id").agg(F.max("rank").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<rank:bigint,t1:bigint,t2:bigint,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = written(convs.select("conv_id", "h", "head", F.size("head").alias("got"), (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "conversations")
    first = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.rank").alias("depth"), "x.t1", "x.t2", "x.words")
    rest = rows.join(convs.select("conv_id", "h", "got"), "conv_id").filter(F.col("rank") > F.col("h"))
    rest = rest.select("conv_id", (F.col("rank") - F.col("h") + F.col("got")).alias("depth"), "t1", "t2", "words")
    both = first.unionByName(rest)
    return both.select("conv_id", "depth", F.xxhash64("depth", "t1").alias("g1"), F.xxhash64("t2", "depth").alias("g2"), "words"), convs.select("conv_id", "n")


def segments(both: DataFrame, lengths: DataFrame, size: int) -> DataFrame:
    """(conv_id, k, s1, s2, e1, e2, len, codes, words): each conversation's segments, the last of which has fewer than ``size`` turns, none maybe. A prefix is known by the exclusive or of its turns' hashes: s1, s2 before the segment, e1, e2 at its end."""
    k = F.floor((F.col("depth") - 1) / size).cast("long")
    made = both.groupBy("conv_id", k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("depth", "g1", "g2", "words"))).alias("x"), F.bit_xor("g1").alias("x1"), F.bit_xor("g2").alias("x2"))
    made = made.select("conv_id", "k", F.flatten(F.transform("x", lambda t: F.array(t["g1"], t["g2"]))).alias("codes"), F.col("x.words").alias("words"), "x1", "x2")
    none = F.array().cast("array<bigint>")
    ends = lengths.filter(F.col("n") % size == 0).select("conv_id", F.floor(F.col("n") / size).cast("long").alias("k"), none.alias("codes"), none.alias("words"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
    past = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    made = made.unionByName(ends).withColumns({f"s{i}": F.coalesce(F.bit_xor(f"x{i}").over(past), F.lit(0).cast("long")) for i in (1, 2)})
    return made.select("conv_id", "k", "s1", "s2", *[F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"e{i}") for i in (1, 2)], F.size("words").cast("long").alias("len"), "codes", "words")


CLASS = ["k", "s1", "s2", "e1", "e2", "len"]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Turns that two sequences of code pairs have in common at their start."""
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0] if len(differ) else m) // 2


def _compared(batches):
    """Rows in order with before and after: turns in common with the row before and behind, -1 where that is of another tile."""
    last, held = None, None
    for batch in batches:
        codes = [np.asarray(c.values) for c in batch.column("codes")]
        tiles = list(zip(*[batch.column(c).to_pylist() for c in ("k", "s1", "s2")], strict=True))
        before = [None] * len(codes)
        for i, (tile, code) in enumerate(zip(tiles, codes, strict=True)):
            if last is not None:
                before[i] = common(last[1], code) if last[0] == tile else -1
            last = tile, code
        if held is not None and len(codes):
            yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array(held[1], pa.int64()), pa.array([*held[1][1:], before[0]], pa.int64())], [*held[0].schema.names, "before", "after"])
        held = (batch, before) if len(codes) else held
    if held is not None:
        yield pa.RecordBatch.from_arrays([*held[0].columns, pa.array(held[1], pa.int64()), pa.array([*held[1][1:], None], pa.int64())], [*held[0].schema.names, "before", "after"])


def classes(cut: DataFrame) -> DataFrame:
    """The distinct segments in sorted order: ``CLASS``, codes, words, members, least (the smallest member), before and after, and their place (task, at). A written table."""
    distinct = cut.groupBy(*CLASS).agg(F.first("codes").alias("codes"), F.first("words").alias("words"), F.count("*").alias("members"), F.min("conv_id").alias("least"))
    tile = ["k", "s1", "s2", "codes"]
    rows = written(distinct, "classes").repartitionByRange(*tile).sortWithinPartitions(*tile)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "before bigint, after bigint, task bigint, at bigint"])

    def run(batches):
        task, at = TaskContext.get().partitionId(), 0
        for batch in _compared(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * n, pa.int64()), pa.array(np.arange(at, at + n))], [*batch.schema.names, "task", "at"])
            at += n

    rows = written(rows.mapInArrow(run, schema), "sorted")
    # The first and last rows of the tasks are compared with each other: two rows a task, whose length is bounded.
    ends = rows.filter("before IS NULL OR after IS NULL").select("k", "s1", "s2", "codes", "task", "at").coalesce(1).sortWithinPartitions("task", "at")
    met = ends.mapInArrow(lambda batches: (b.select(["task", "at", "before", "after"]) for b in _compared(batches)), "task bigint, at bigint, before bigint, after bigint")
    met = F.broadcast(met.select("task", "at", F.coalesce("before", F.lit(-1)).alias("__before"), F.coalesce("after", F.lit(-1)).alias("__after")))
    out = rows.join(met, ["task", "at"], "left")
    return out.withColumns({c: F.coalesce(c, f"__{c}") for c in ("before", "after")}).drop("__before", "__after")


def _total(words: str) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + w)


def below(rows: DataFrame, cut: DataFrame, size: int) -> DataFrame:
    """Adds leaves, fresh and all to ``classes``: of the tiles below each class, the leaves, the words of nodes, and the words of nodes times members.

    Each class below the first tile stands for what it adds (one if it is a leaf, its nodes that the class before hasn't got, all its members' words) in its smallest member, and counts for that
    member's segments above. Without conversations longer than a segment there are none.
    """
    deep = rows.filter("k > 0")
    zeros = {c: F.lit(0).cast("long") for c in ("leaves", "fresh", "all")}
    if deep.isEmpty():
        return rows.withColumns(zeros)
    leaf = ((F.col("len") < size) & (F.col("after") < F.col("len"))).cast("long")
    new = F.slice("words", F.greatest(F.col("before"), F.lit(0)).cast("int") + 1, F.lit(size))
    own = deep.select(F.col("least").alias("conv_id"), "k", leaf.alias("leaves"), _total(new).alias("fresh"), (F.col("members") * _total("words")).alias("all"), *[F.lit(None).cast("long").alias(c) for c in CLASS if c != "k"])
    path = cut.select("conv_id", *CLASS).withColumns(zeros)
    above = Window.partitionBy("conv_id").orderBy(-F.col("k")).rangeBetween(Window.unboundedPreceding, -1)
    gained = own.unionByName(path).withColumns({c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in zeros}).filter("len IS NOT NULL")
    gained = gained.groupBy(*CLASS).agg(*[F.sum(c).alias(c) for c in zeros])
    return rows.join(gained, CLASS)


class _Point:
    """A point on the path of the row in hand, with what is known of its members so far."""

    __slots__ = ("all", "depth", "fresh", "id", "leaves", "least", "members", "row", "total", "went_on")

    def __init__(self, depth: int, row, went_on: bool):
        self.depth, self.row, self.total, self.went_on = depth, row, int(row.total[depth]), went_on
        self.id = self.at(depth)
        self.members = self.leaves = self.fresh = self.all = 0
        self.least = None

    def at(self, depth: int) -> tuple:
        return self.row.start + depth, int(self.row.p1[depth]), int(self.row.p2[depth])

    def add(self, members: int, least: int, leaves: int, fresh: int, all: int) -> None:
        self.members, self.leaves, self.fresh, self.all = self.members + members, self.leaves + leaves, self.fresh + fresh, self.all + all
        self.least = least if self.least is None else min(self.least, least)


class _Row:
    """A class with the running sums along its turns."""

    def __init__(self, r: dict, size: int):
        codes, words = np.asarray(r["codes"], np.int64), np.asarray(r["words"], np.int64)
        xor = lambda start, g: np.bitwise_xor.accumulate(np.concatenate([[start], g]).astype(np.int64))
        self.p1, self.p2, self.total = xor(r["s1"], codes[::2]), xor(r["s2"], codes[1::2]), np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
        self.start, self.len, self.before, self.after = r["k"] * size, r["len"], r["before"], r["after"]
        leaf = int(self.len < size and self.after < self.len)
        self.own = (r["members"], r["least"], r["leaves"] + leaf, r["fresh"], r["all"])


def _parts(rows: list[dict], size: int):
    """Parts of points from a run of neighbouring classes: a stack holds the points on the path of the row in hand, and a point is done when a row leaves it.

    A point that began before the run or goes on behind it may have points above it which only the rows out there show. Whatever depth such a point may have, its part is given, too, as one
    that counts only if another run shows the point: ``SEGMENT`` of these for either end of a run at most.
    """
    stack: list[_Point] = []

    def leave(depth: int, row: _Row, goes_on: bool = False):
        """Points deeper than ``depth`` are done in this run; the path goes on from a point at ``depth``, which so is one."""
        while stack and stack[-1].depth > depth:
            child = stack.pop()
            if not stack or stack[-1].depth < depth:
                stack.append(_Point(depth, row, child.went_on))
            over = stack[-1]
            # An edge's words count once: not in a run whose first row came from inside it.
            fresh = lambda total: child.fresh + (0 if child.went_on else child.total - total)  # noqa: B023, E731
            over.add(child.members, child.least, child.leaves, fresh(over.total), child.all)
            yield _part(child.id, child, child.total, child.fresh, over)
            if child.went_on or goes_on:
                for d in range(over.depth + 1, child.depth):
                    yield _part(child.at(d), child, int(child.row.total[d]), fresh(int(child.row.total[d])), None)

    def finish(row: _Row, goes_on: bool):
        """All points of a tile are done in this run. Its root is a point of the tile above, but for the first."""
        yield from leave(0, row, goes_on)
        root = stack.pop()
        if root.id[0] == 0:
            yield _part(root.id, root, 0, root.fresh, root)

    for i, r in enumerate(rows):
        row = _Row(r, size)
        if i and row.before >= 0:
            yield from leave(row.before, last)
        else:
            if i:
                yield from finish(last, False)
            stack.append(_Point(0, row, row.before >= 0))
            if row.before > 0:
                stack.append(_Point(row.before, row, True))
        if stack[-1].depth < row.len:
            stack.append(_Point(row.len, row, False))
        members, least, leaves, fresh, all = row.own
        stack[-1].add(members, least, leaves, fresh, all + members * int(row.total[row.len]))
        last = row
    if rows:
        if last.after >= 0:
            yield from leave(last.after, last)
        yield from finish(last, last.after >= 0)


def _part(id: tuple, of: _Point, total: int, fresh: int, over: _Point | None) -> tuple:
    """A point's part; without ``over``, one that counts only if another run has it."""
    if over is None:
        above, edge = (-2, 0, 0), []
    elif over is of:  # the root
        above, edge = (-1, 0, 0), [0]
    else:
        above, edge = over.id, [total - int(t) for t in of.row.total[over.depth : of.depth]]
    return (*id, of.members, of.least, of.leaves, of.all - of.members * total - fresh, *above, edge)


PART = "depth bigint, p1 bigint, p2 bigint, members bigint, least bigint, leaves bigint, saved bigint, o0 bigint, o1 bigint, o2 bigint, edge array<bigint>"


def points(rows: DataFrame, size: int) -> DataFrame:
    """The compressed trie: ``POINT``, members, least, leaves, saved (below the point), over (the point above: d, q1, q2) and edge (for each node of the edge, the words from it to the point). A written table."""

    def run(batches):
        for _, own in by_key(batches, "run"):
            made = list(_parts([r for b in own for r in b.to_pylist()], size))
            columns = list(zip(*made, strict=True)) if made else [[] for _ in PART.split(",")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i == 10 else pa.int64()) for i, c in enumerate(columns)], [p.split()[0] for p in PART.split(",")])

    number = F.col("task") * F.lit(1 << 32) + F.floor(F.col("at") / RUN)
    runs = rows.withColumn("run", number.cast("long")).repartition("run").sortWithinPartitions("run", "at")
    parts = runs.select("run", "k", "s1", "s2", "len", "codes", "words", "members", "least", "before", "after", "leaves", "fresh", "all").mapInArrow(run, PART)
    over = F.max(F.struct(F.col("o0").alias("d"), F.col("o1").alias("q1"), F.col("o2").alias("q2"), "edge")).alias("over")  # the deepest that a part knows is the point above; -2: none does
    found = parts.groupBy(*POINT).agg(F.sum("members").alias("members"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), over)
    return written(found.filter("over.d > -2").select(*POINT, "members", "least", "leaves", "saved", "over.d", "over.q1", "over.q2", "over.edge"), "points")


def end_hashes(cut: DataFrame, size: int) -> DataFrame:
    """(``POINT``, ends_sha256): SHA-256 over the ids, ascending and comma-joined, of the conversations that end at a point.

    Ids are sorted over all tasks by ranges and joined there to texts of bounded size; a point's texts then stream through one hash, which takes them one after another by its nature.
    """
    ends = written(cut.filter(F.col("len") < size).select((F.col("k") * size + F.col("len")).alias("depth"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), "conv_id"), "ends")
    names = [*POINT, "from", "ids"]

    def join(batches):
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in POINT], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                for a in range(i, j, IDS):
                    ids = batch.column("conv_id")[a : min(j, a + IDS)].to_pylist()
                    row = [*keys[a].tolist(), ids[0], ",".join(map(str, ids))]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)

    def digest(batches):
        at, state = None, None
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*POINT, "ids")], strict=True):
                if key != at:
                    if at is not None:
                        yield out(at, state)
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if at is not None:
            yield out(at, state)

    def out(key, state):
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], [*POINT, "ends_sha256"])

    texts = ends.repartitionByRange(*POINT, "conv_id").sortWithinPartitions(*POINT, "conv_id").mapInArrow(join, "depth bigint, p1 bigint, p2 bigint, from bigint, ids string")
    return texts.repartition(*POINT).sortWithinPartitions(*POINT, "from").select(*POINT, "ids").mapInArrow(digest, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def expanded(made: DataFrame, hashes: DataFrame) -> DataFrame:
    """A row a node: points, and the nodes inside their edges, which have the point's members, one child, no ends, and its sums and their words down to it more."""
    children = made.groupBy(F.col("d").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("children"))
    owners = made.select(F.col("depth").alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("owner"))
    full = made.join(children, POINT, "left").join(hashes, POINT, "left").join(owners, ["d", "q1", "q2"], "left")
    nodes = full.select("*", F.posexplode("edge").alias("step", "tail"))
    last = F.col("step") == F.size("edge") - 1
    saved = F.col("saved") + (F.col("members") - 1) * F.col("tail")
    return nodes.select(
        F.col("least").alias("conv_id"), (F.col("d") + 1 + F.col("step")).alias("depth"), F.when(F.col("step") == 0, F.col("owner")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.when(last, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def prefix_trie(rows: DataFrame, size: int | None = None) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations; ``rows`` has conv_id, turn, role and text, and other columns don't count.

    Turns are ordered by turn, nulls first, and turns of one number by a hash of role and text; a repeated row is a turn of its own. Null roles and texts are empty; rows without a conv_id
    belong to no conversation and are left out. Texts count whole, and conversations of any length. A turn is known by 128 bits of hash. Without rows there is no node, not even a root.
    """
    size = size or SEGMENT
    both, lengths = rebuilt(placed(turns(rows)))
    cut = written(segments(both, lengths, size), "segments")
    made = points(below(classes(cut), cut, size), size)
    return expanded(made, end_hashes(cut, size))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
