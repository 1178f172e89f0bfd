"""What stands above classes, brought to them by groups, and the order in which a class asks it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitestat.functions.lineage import written

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

KINDS = ("extends", "implements", "encloses")
#: Rows of classes that are dealt to a group, about: a task holds a group and what stands above it.
GROUP_ROWS = 1 << 14
#: Pairs of class and ancestor that a task orders at a time, about.
PAIRS_AT_ONCE = 1 << 19
_CLASSES_AT_ONCE = 1 << 12


def gathered(classes: DataFrame, edges: DataFrame, facts: DataFrame | None = None, rounds: int = 1000) -> DataFrame:
    """(g, node, up, asked, is_child) and facts: classes dealt into groups, with all that stands above them, sorted by group.

    classes: child and other columns, which come back as a list asked of each class;
    edges: class_name, parent, kind (of KINDS), place; facts: node and a list.  A range of
    names is a group.  A round is a level: what the last one found in a group is looked up
    once for the group, not once for each class below it.  up: parent, kind (place in
    KINDS) and place of a class's edges, null where it has none.
    """
    kind = F.when(F.col("kind") == KINDS[0], 0).when(F.col("kind") == KINDS[1], 1).otherwise(2).cast("int")
    up = edges.filter(F.col("kind").isin(*KINDS)).groupBy(F.col("class_name").alias("node")).agg(F.collect_set(F.struct("parent", kind.alias("kind"), "place")).alias("up"))
    up = written(up if facts is None else up.join(facts, "node", "full"), free=True)
    rows = written(classes.filter("child is not null"), free=True)
    n = max(1, -(-rows.count() // GROUP_ROWS))
    told = F.array().cast("array<string>") if len(rows.columns) == 1 else F.collect_set(next(c for c in rows.columns if c != "child"))
    # A range of names is read, grouped and numbered by one task.
    dealt = rows.repartitionByRange(n, "child").groupBy("child").agg(F.first(F.lit(True)).alias("is_child"), told.alias("asked")).withColumn("g", F.spark_partition_id())
    # The numbers are written before anything is joined to them: a range that is cut anew could lie elsewhere.
    new = written(written(dealt, free=True).withColumnRenamed("child", "node").join(up, "node", "left"), free=True)
    found = [new]
    for _ in range(3 * rounds):
        seen = reduce(DataFrame.unionAll, [f.select("g", "node") for f in found])
        front = new.select("g", F.explode("up.parent").alias("node")).distinct().join(seen, ["g", "node"], "left_anti")
        new = written(front.join(up, "node"), free=True)
        if new.isEmpty():
            break
        found.append(new)
    else:
        raise RuntimeError(f"the hierarchy did not settle in {3 * rounds} rounds")
    above = [f.withColumn("is_child", F.lit(False)).withColumn("asked", F.array().cast(dealt.schema["asked"].dataType)) for f in found[1:]]
    # A number of partitions that is given isn't lowered: a group takes far longer to order than to read.
    return reduce(DataFrame.unionByName, [found[0], *above]).repartition(n, "g").sortWithinPartitions("g")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, from batches that are sorted by g."""
    import numpy as np
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        g = batch.column("g").to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if held and g[lo] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = g[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class Lists:
    """Lists by row: of each row where its items begin in one array, and how many they are."""

    def __init__(self, rows: np.ndarray, size: int, *items: np.ndarray):
        import numpy as np

        order = np.argsort(rows, kind="stable")
        self.items = [i[order] for i in items]
        self.many = np.bincount(rows, minlength=size)
        self.first = np.cumsum(self.many) - self.many

    def open(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each item of each of the rows the place of the row in rows, and the items."""
        import numpy as np

        many = self.many[rows]
        before = np.cumsum(many) - many
        at = np.repeat(self.first[rows] - before, many) + np.arange(many.sum())
        return np.repeat(np.arange(len(rows)), many), [i[at] for i in self.items]


def _ranks(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of x, equal for equal ones."""
    import numpy as np

    if not len(x) or x.min() == x.max():
        return np.zeros(len(x), np.int64)
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def least(pair: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, sorted, with its least rank."""
    import numpy as np

    if not len(pair):
        return pair, rank
    n = int(rank.max()) + 1
    if n > 1 and int(pair.max()) >= (1 << 62) // n:
        rank_of, rank = np.unique(rank, return_inverse=True)
        order = np.lexsort((rank, pair))
        pair, rank = pair[order], rank_of[rank[order]]
    else:
        both = np.sort(pair * n + rank)
        pair = both // n
        rank = both - pair * n
    keep = np.concatenate([[True], pair[1:] != pair[:-1]])
    return pair[keep], rank[keep]


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in known, which is sorted."""
    import numpy as np

    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


class Group:
    """A group's classes (ids sort as their names do) and the edges above them."""

    def __init__(self, rows: pa.Table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        node, up = (rows.column(c).combine_chunks() for c in ("node", "up"))
        parent, kind, place = up.flatten().flatten()
        both = pa.concat_arrays([node, parent])
        names = pc.unique(both)
        self.names = names.take(pc.sort_indices(names))
        ids = pc.index_in(both, value_set=self.names).to_numpy().astype(np.int64)
        self.node, parent, self.size = ids[: len(node)], ids[len(node) :], len(names)
        values, place = np.unique(place.to_numpy(), return_inverse=True)
        self.places = max(1, len(values))
        kind = kind.to_numpy()
        child = np.repeat(self.node, up.value_lengths().fill_null(0).to_numpy())
        self.extends, self.implements, self.encloses = (Lists(child[kind == k], self.size, parent[kind == k], place[kind == k].astype(np.int64)) for k in range(len(KINDS)))
        self.rows = np.flatnonzero(rows.column("is_child").combine_chunks().to_numpy(zero_copy_only=False))

    def climb(self, edges: Lists, walker: np.ndarray, node: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(walker, node, depth, rank): what walkers reach from where they stand, each node once, at its first level.

        The rank of a level goes by the rank below, then by place, as paths of places
        would sort, and holds over all walkers; of several the least stays.
        """
        import numpy as np

        pair, rank = least(walker * self.size + node, rank)
        seen, out, depth = pair, [(pair, np.zeros(len(pair), np.int64), rank)], 0
        while True:
            depth += 1
            at, (parent, place) = edges.open(pair % self.size)
            up = (pair - pair % self.size)[at] + parent
            up, ranks = least(up, _ranks(rank[at] * self.places + place))
            new = ~among(up, seen)
            pair, rank = up[new], ranks[new]
            if not len(pair):
                pairs, depths, ranks = (np.concatenate(x) for x in zip(*out, strict=True))
                return pairs // self.size, pairs % self.size, depths, ranks
            seen = np.sort(np.concatenate([seen, pair]), kind="stable")
            out.append((pair, np.full(len(pair), depth), rank))

    def order(self, kids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(kid, ancestor, position, section): the ancestors of each of the kids (by its place) in the order in which they are asked.

        section: 0 the class, 1 its superclasses, 2 the classes around it and theirs, 3 interfaces.
        """
        import numpy as np

        each, zero = np.arange(len(kids)), np.zeros(len(kids), np.int64)
        kid, outer, ring, _ = self.climb(self.encloses, each, kids, zero)
        kid, outer, ring = kid[ring > 0], outer[ring > 0], ring[ring > 0]
        starts = np.unique(np.concatenate([kids, outer]))
        start, *met = self.climb(self.extends, np.arange(len(starts)), starts, np.zeros(len(starts), np.int64))
        supers = Lists(start, len(starts), *met)
        # The kid itself is its first start, in ring 0; then those around it.
        who, where, rings = np.concatenate([each, kid]), np.concatenate([kids, outer]), np.concatenate([zero, ring])
        at, (node, depth, rank) = supers.open(np.searchsorted(starts, where))
        section = np.where(rings[at] > 0, 2, np.minimum(depth, 1))
        n_ring, n_depth, n_rank = (int(x.max(initial=0)) + 1 for x in (rings, depth, rank))
        key = _ranks(((section * n_ring + rings[at]) * n_depth + depth) * n_rank + rank)
        sections = np.zeros(int(key.max(initial=0)) + 1, np.int64)
        sections[key] = section
        pair, key = least(who[at] * self.size + node, key)
        at, (face, place) = self.implements.open(pair % self.size)
        kid, node, depth, rank = self.climb(self.extends, (pair // self.size)[at], face, _ranks(key[at] * self.places + place))
        over, after = least(kid * self.size + node, _ranks(depth * (int(rank.max(initial=0)) + 1) + rank))
        new = ~among(over, pair)
        pairs = np.concatenate([pair, over[new]])
        keys = np.concatenate([key, len(sections) + after[new]])
        section = np.concatenate([sections[key], np.full(int(new.sum()), 3)])
        # Both parts are sorted by ancestor within a kid, and a key stands in one part only, so equal keys stay in the order of names.
        kid = pairs // self.size
        order = np.argsort(kid * (int(keys.max(initial=0)) + 1) + keys, kind="stable")
        kid = kid[order]
        return kid, pairs[order] % self.size, np.arange(len(kid)) - np.searchsorted(kid, kid), section[order]

    def orders(self) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        """Rows of children and their order(), some children at a time: as many as make about PAIRS_AT_ONCE pairs, by what the last ones made."""
        lo, step = 0, 64
        while lo < len(self.rows):
            rows = self.rows[lo : lo + step]
            found = self.order(self.node[rows])
            yield rows, found
            lo += len(rows)
            step = max(1, min(4 * step, _CLASSES_AT_ONCE, PAIRS_AT_ONCE * len(rows) // max(1, len(found[0]))))


class Answers(Group):
    """A group whose classes have methods (has) and are asked for some (asked)."""

    def __init__(self, rows: pa.Table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        super().__init__(rows)
        has, asked = (rows.column(c).combine_chunks() for c in ("has", "asked"))
        self.signatures = pc.unique(asked.flatten())
        kind = lambda x: pc.index_in(x, value_set=self.signatures).fill_null(-1).to_numpy().astype(np.int64)
        many = lambda x: x.value_lengths().fill_null(0).to_numpy()
        # What nobody in the group asks for isn't looked through.
        at, methods = np.repeat(self.node, many(has)), kind(has.flatten())
        self.has = Lists(at[methods >= 0], self.size, methods[methods >= 0])
        self.asked = Lists(np.repeat(np.arange(len(rows)), many(asked)), len(rows), kind(asked.flatten()))

    def answers(self) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
        """(child, signature, first, above): of what each class asks for, the first ancestor that has it, and the first after the class itself, as ids of names and signatures."""
        import numpy as np
        import pyarrow as pa

        n = max(1, len(self.signatures))
        for rows, (kid, ancestor, position, _) in self.orders():
            at, (wanted,) = self.asked.open(rows)
            wanted = np.sort(at * n + wanted)
            at, (method,) = self.has.open(ancestor)
            pair, rank = kid[at] * n + method, position[at]
            mine = among(pair, wanted)
            # The place in the order says the ancestor.
            begins = np.searchsorted(kid, np.arange(len(rows)))
            first, place = least(pair[mine], rank[mine])
            later, next_ = least(pair[mine & (rank > 0)], rank[mine & (rank > 0)])
            found = ancestor[begins[first // n] + place]
            above, none = np.zeros(len(first), np.int64), np.ones(len(first), bool)
            where = np.searchsorted(first, later)
            above[where], none[where] = ancestor[begins[later // n] + next_], False
            yield pa.array(self.node[rows][first // n]), pa.array(first % n), pa.array(found), pa.array(above, mask=none)
