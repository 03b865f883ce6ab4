"""Hierarchical sums over a tree: a driver, and what it needs to know of a kernel.

An expansion is a row of numeric columns for a box. A kernel tells how expansions come
from points and are moved between boxes, as tables or columns; the driver joins them
along the lists and adds them up by box. Contributions of a box to all boxes below or
above it are added level-free, along the ancestors of its key, for kernels whose
expansions need no shift, or level by level for the others.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quadrille.functions.keys import axes, box_names, inside, key_names, levels, moved, shift
from quadrille.operators.classes import class_count, class_number, class_vector
from quadrille.operators.traversal import Traversal, side
from quadrille.plans.shared import cut, release


#: What sums of a kernel are multiplied with, by equation and dimensions.
SCALES = {("laplace", 2): -1 / (2 * math.pi), ("helmholtz", 2): 1.0, ("laplace", 3): 1 / (4 * math.pi), ("helmholtz", 3): 1 / (4 * math.pi)}


class Kernel(ABC):
    """How sources (pid, coordinates, box, weight) act on targets, by way of expansions.

    What it needs of a source beside the weight are source_columns; its results are outputs.
    """

    source_columns: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ("potential",)

    @abstractmethod
    def form_multipoles(self, sources: DataFrame) -> DataFrame:
        """A multipole for each box from its own sources."""

    @abstractmethod
    def coarsen_multipoles(self, multipoles: DataFrame) -> DataFrame:
        """Multipoles of all boxes, with those of the boxes below."""

    @abstractmethod
    def multipole_to_local(self, edges: DataFrame, multipoles: DataFrame) -> DataFrame:
        """Locals (by target box, summed) from the multipoles of list 2."""

    @abstractmethod
    def form_locals(self, edges: DataFrame, sources: DataFrame) -> DataFrame:
        """Locals from the sources of list 4."""

    @abstractmethod
    def refine_locals(self, local: DataFrame) -> DataFrame:
        """Locals of all target boxes, with those of the boxes above."""

    @abstractmethod
    def eval_locals(self, local: DataFrame, targets: DataFrame) -> DataFrame:
        """(pid, potential) from the local of each target's box."""

    @abstractmethod
    def eval_multipoles(self, edges: DataFrame, multipoles: DataFrame, targets: DataFrame) -> DataFrame:
        """(pid, potential) from the multipoles of list 3."""

    @abstractmethod
    def eval_direct(self, edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """(pid, potential) from the sources of a near list."""

    @abstractmethod
    def add_up(self, expansions: DataFrame) -> DataFrame:
        """Expansions with one row a box."""

    def finalize(self, value: Column) -> Column:
        return value


def drive(traversal: Traversal, kernel: Kernel, weights: DataFrame | None = None) -> DataFrame:
    """The kernel's outputs at each target: pid, potential and others.

    weights: pid, weight for sources, and the kernel's source_columns; a weight of 1 for each without. Sources that
    are not in weights have no effect.
    """
    tree, d = traversal.tree, traversal.tree.d
    if kernel.source_columns and weights is None:
        raise ValueError(f"sources need the columns {kernel.source_columns}")
    points = tree.particles.drop("weight")
    sources = points.where(F.col("role").isin("s", "b")).drop("role")
    more = [F.col(c).cast("double").alias(c) for c in ("weight", *kernel.source_columns)]
    sources = sources.withColumn("weight", F.lit(1.0)) if weights is None else sources.join(weights.select("pid", *more), "pid")
    sources = cut(sources.select("pid", *axes(d), *box_names(d), "weight", *kernel.source_columns))
    targets = points.where(F.col("role").isin("t", "b")).select("pid", *axes(d), *box_names(d))
    release(sources.sparkSession)
    multipoles = cut(kernel.coarsen_multipoles(cut(kernel.form_multipoles(sources))))
    release(sources.sparkSession)
    local = kernel.multipole_to_local(traversal.list2, multipoles)
    parts = [kernel.eval_direct(traversal.list1_merged if tree.has_extent else traversal.list1, sources, targets)]
    if traversal.list4.take(1):
        local = kernel.add_up(local.unionByName(kernel.form_locals(traversal.list4, sources)))
    if traversal.list3.take(1):
        parts.append(kernel.eval_multipoles(traversal.list3, multipoles, targets))
    local = cut(local)
    release(sources.sparkSession)
    parts.append(kernel.eval_locals(kernel.refine_locals(local), targets))
    release(sources.sparkSession)
    out = targets.select("pid", *[F.lit(0.0).alias(c) for c in kernel.outputs])
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy("pid").agg(*[kernel.finalize(F.sum(c)).alias(c) for c in kernel.outputs])


def add_up(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in df.columns if c not in by])


def _from(prefix: str, d: int) -> list[Column]:
    return [F.col(f"{prefix}_{c}").alias(c) for c in box_names(d)]


class ConstantOne(Kernel):
    """The kernel that is 1 everywhere: a potential is the sum of all weights. It tests the lists, as every
    target must see every source once."""

    def __init__(self, d: int):
        self.d = d

    def add_up(self, expansions):
        return add_up(expansions, box_names(self.d))

    def form_multipoles(self, sources):
        return sources.groupBy(*box_names(self.d)).agg(F.sum("weight").alias("m"))

    def coarsen_multipoles(self, multipoles):
        up = multipoles.select("m", F.explode(levels(0, F.col("level"))).alias("_at"), *box_names(self.d))
        keys = [shift(F.col(k), F.col("level") - F.col("_at")).alias(k) for k in key_names(self.d)]
        return up.select("m", F.col("_at").alias("level"), *keys).groupBy(*box_names(self.d)).agg(F.sum("m").alias("m"))

    def _along(self, edges, values, name):
        """Sums by target box of a value of the source boxes."""
        named = values.select(*[F.col(c).alias(f"s_{c}") for c in box_names(self.d)], F.col(name).alias("m"))
        return edges.join(named, side("s", self.d)).select(*_from("t", self.d), "m").groupBy(*box_names(self.d)).agg(F.sum("m").alias("m"))

    def multipole_to_local(self, edges, multipoles):
        return self._along(edges, multipoles, "m")

    def form_locals(self, edges, sources):
        return self._along(edges, self.form_multipoles(sources), "m")

    def refine_locals(self, local):
        return local

    def _at_targets(self, values, targets):
        return targets.join(values, box_names(self.d)).select("pid", F.col("m").alias("potential"))

    def eval_locals(self, local, targets):
        """The locals of a target's box and of all boxes above it."""
        boxes = targets.select(*box_names(self.d)).distinct()
        up = boxes.select("*", F.explode(levels(0, F.col("level"))).alias("_at"))
        up = up.select("*", *[shift(F.col(k), F.col("level") - F.col("_at")).alias(f"_{k}") for k in key_names(self.d)])
        above = local.select(F.col("level").alias("_at"), *[F.col(k).alias(f"_{k}") for k in key_names(self.d)], "m")
        sums = up.join(above, ["_at", *[f"_{k}" for k in key_names(self.d)]]).groupBy(*box_names(self.d)).agg(F.sum("m").alias("m"))
        return self._at_targets(sums, targets)

    def eval_multipoles(self, edges, multipoles, targets):
        return self._at_targets(self._along(edges, multipoles, "m"), targets)

    def eval_direct(self, edges, sources, targets):
        return self._at_targets(self._along(edges, self.form_multipoles(sources), "m"), targets)


def direct(edges: DataFrame, sources: DataFrame, targets: DataFrame, d: int, value: Column | dict[str, Column], more: tuple[str, ...] = ()) -> DataFrame:
    """(pid, potential): value, on columns t_x.., s_x.., weight and more of the sources, summed over the sources of boxes
    that edges lead to. value may also be several, by name.

    Sources are sent to the target boxes, where a target meets all that act on it: its sum is whole there."""
    values = value if isinstance(value, dict) else {"potential": value}
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in (*box_names(d), *axes(d))], "weight", *more, F.col("pid").alias("s_pid"))
    t = targets.select(*[F.col(c).alias(f"t_{c}") for c in (*box_names(d), *axes(d))], "pid")
    near = t.join(edges.join(s, side("s", d)), side("t", d)).where("pid <> s_pid")
    return near.groupBy(*side("t", d), "pid").agg(*[F.sum(v).alias(name) for name, v in values.items()]).select("pid", *values)


def squared_distance(d: int) -> Column:
    return sum(((F.col(f"t_{a}") - F.col(f"s_{a}")) * (F.col(f"t_{a}") - F.col(f"s_{a}")) for a in axes(d)), F.lit(0.0))


def _complex(column: pa.Array) -> np.ndarray:
    """Coefficients of rows that all have as many, one row each."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), complex).reshape(len(values), -1)


def _packed(c: np.ndarray) -> pa.Array:
    """Rows of coefficients as binary values."""
    size = 16 * c.shape[1]
    ends = np.arange(len(c) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(c), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(c, complex))])


def _expansions(level: int, keys: list[np.ndarray], c: np.ndarray) -> pa.RecordBatch:
    """Expansions of boxes of one level, those of a box that is there more than once added up."""
    if len(c):
        order = np.lexsort(keys)
        keys, c = [k[order] for k in keys], c[order]
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], 0)]))
        keys, c = [k[starts] for k in keys], np.add.reduceat(c, starts)
    return pa.record_batch([pa.array(np.full(len(c), level, np.int32)), *(pa.array(k.astype(np.int64)) for k in keys), _packed(c)], [*box_names(len(keys)), "c"])


def _of_levels(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by level."""
    at = batch.column(batch.schema.names.index("level")).to_numpy()
    for level in np.unique(at):
        yield int(level), batch.filter(pa.array(at == level))


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False) for n in names]


def _with_whole_groups(batches, keys: int) -> Iterator[pa.RecordBatch]:
    """Batches that are sorted by their first columns, dealt anew so that rows with the same keys are in one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        unlike = np.flatnonzero(np.any([c != c[-1] for c in columns], 0))
        end = unlike[-1] + 1 if len(unlike) else 0
        # The group that this batch begins with may be the one that the last one ended in.
        if end:
            yield pa.Table.from_batches([*held, batch.slice(0, end)]).combine_chunks().to_batches()[0]
            held = [batch.slice(end)]
        elif held and any(h.as_py() != c[0] for h, c in zip((held[-1].column(i)[0] for i in range(keys)), columns)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _moved_by(rows: pa.RecordBatch, d: int, matrices: np.ndarray, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of rows of one level, and their coefficients by the matrix of the child that each key is of its parent."""
    keys = _columns(rows, *key_names(d))
    a, child = _complex(rows.column(rows.schema.names.index("c"))), sum((k & 1) << (d - 1 - i) for i, k in enumerate(keys))
    b = np.zeros((len(a), size), complex)
    for which in np.unique(child):
        b[child == which] = a[child == which] @ matrices[which, :size, : a.shape[1]].T
    return keys, b


class Series(Kernel):
    """A kernel by series whose moves between boxes are matrices.

    An expansion is the binary column c: complex numbers, as many as the order at the box's level asks for
    (order may be a function of it), scaled by the box's width. Moving expansions to a parent, to a child or along
    list 2 is a matrix for each of the few relative places; a batch's rows of one place are moved together and
    what falls on one box is added up before rows are exchanged.

    Sources are charges or, with dipoles, pairs of them along dx, dy, ..; with gradient, the gradient of the potential is
    given, too. A point has no effect on itself. Subclasses say what the series are.
    """

    d: int

    def __init__(self, traversal: Traversal, order: int | Callable[[int], int] = 16, dipoles: bool = False, gradient: bool = False):
        self.traversal, self.tree, self.dipoles, self.gradient = traversal, traversal.tree, dipoles, gradient
        if self.tree.d != self.d:
            raise ValueError(f"the kernel is for {self.d} dimensions")
        self.deepest = self.tree.boxes.agg(F.max("level")).first()[0]
        self.orders = [order(l) if callable(order) else order for l in range(self.deepest + 1)]
        if min(self.orders) < 1:
            raise ValueError("orders must be 1 or more")
        self.sizes = [self.size(p) for p in self.orders]
        self.source_columns = tuple(f"d{a}" for a in axes(self.d)) if dipoles else ()
        self.outputs = ("potential", *(f"gradient_{a}" for a in axes(self.d))) if gradient else ("potential",)
        self.box = "level int, " + ", ".join(f"{k} bigint" for k in key_names(self.d)) + ", c binary"

    # What a series is

    @abstractmethod
    def size(self, order: int) -> int:
        """The number of coefficients of an order; those of lower orders come first."""

    @abstractmethod
    def up_matrices(self) -> np.ndarray:
        """For each child, its first axis the most significant bit, the matrix from its multipole to its parent's."""

    @abstractmethod
    def down_matrices(self) -> np.ndarray:
        """For each child the matrix from its parent's local to its own."""

    @abstractmethod
    def class_tables(self) -> dict[int, np.ndarray]:
        """For each translation class, without its level's part, what its matrix from multipoles to locals is made of."""

    @abstractmethod
    def class_matrix(self, table: np.ndarray, size: int) -> np.ndarray:
        """A class's matrix for so many coefficients."""

    def with_width(self, local: np.ndarray, multipole: np.ndarray, width: float) -> np.ndarray:
        """A local made by a class's matrix, with what else depends on the boxes' width."""
        return local

    @abstractmethod
    def multipole_of(self, at: np.ndarray, width: float, weight: np.ndarray, along: np.ndarray | None, size: int) -> np.ndarray:
        """The multipoles of single sources at places at, in widths of the box from its centre."""

    @abstractmethod
    def local_of(self, at: np.ndarray, width: float, weight: np.ndarray, along: np.ndarray | None, size: int) -> np.ndarray:
        """The locals of single sources far from the box."""

    @abstractmethod
    def values(self, c: np.ndarray, at: np.ndarray, width: float, inverse: bool) -> list[np.ndarray]:
        """The outputs at places at of locals, or, if inverse is set, of multipoles."""

    @abstractmethod
    def near(self) -> list[Column]:
        """What a source adds to a target's outputs, but for the scale: for columns t_.., s_.., weight and the source columns."""

    # How they go through a tree

    def classes(self) -> dict[int, tuple[int, ...]]:
        """The vectors, from source to target, of the translation classes that list 2 can have."""
        n = self.traversal.n
        found = {number: tuple(class_vector(number, n, self.d)) for number in range(class_count(n, self.d))}
        return {number: v for number, v in found.items() if max(map(abs, v)) > n}

    def centres(self) -> list[np.ndarray]:
        """Of each child its centre, in widths of its parent from the parent's."""
        return [(np.array(bits) - 0.5) / 2 for bits in product((0, 1), repeat=self.d)]

    def _places(self):
        """A function that gives places in widths of the box from its centre, and that width."""
        lo, width, d = self.tree.lo, self.tree.width, self.d

        def places(rows: pa.RecordBatch, level: int) -> tuple[np.ndarray, float]:
            w = width / 2.0**level
            return np.stack([(x - lo[i]) / w - k - 0.5 for i, (x, k) in enumerate(zip(_columns(rows, *axes(d)), _columns(rows, *key_names(d))))], 1), w

        return places

    def add_up(self, expansions):
        d, names = self.d, box_names(self.d)

        def run(batches):
            for whole in _with_whole_groups(batches, 1 + d):
                for level, rows in _of_levels(whole):
                    yield _expansions(level, _columns(rows, *key_names(d)), _complex(rows.column(1 + d)))

        dealt = expansions.select(*names, "c").repartition(*names).sortWithinPartitions(*names)
        return dealt.mapInArrow(run, self.box)

    def _given(self) -> list[str]:
        return [*axes(self.d), "weight", *self.source_columns]

    def _from_sources(self, rows: DataFrame, make) -> DataFrame:
        places, sizes, given, d = self._places(), self.sizes, self.source_columns, self.d

        def run(batches):
            for batch in batches:
                for level, rows in _of_levels(batch):
                    at, w = places(rows, level)
                    along = np.stack(_columns(rows, *given), 1) if given else None
                    yield _expansions(level, _columns(rows, *key_names(d)), make(at, w, _columns(rows, "weight")[0], along, sizes[level]))

        return self.add_up(rows.select(*self._given(), *box_names(d)).mapInArrow(run, self.box))

    def form_multipoles(self, sources):
        return self._from_sources(sources, self.math().multipole_of)

    def form_locals(self, edges, sources):
        s = sources.select(*[F.col(c).alias(f"s_{c}") for c in box_names(self.d)], *self._given())
        return self._from_sources(edges.join(s, side("s", self.d)).select(*_from("t", self.d), *self._given()), self.math().local_of)

    def math(self) -> "Series":
        """The kernel without its tables, to be sent to tasks."""
        out = object.__new__(type(self))
        out.dipoles, out.gradient, out.outputs = self.dipoles, self.gradient, self.outputs
        return out

    def coarsen_multipoles(self, multipoles):
        """From the deepest level up, each level's multipoles are moved to their parents and added to theirs."""
        matrices, sizes, d = self.up_matrices(), self.sizes, self.d

        def run(batches):
            for batch in batches:
                for level, rows in _of_levels(batch):
                    keys, b = _moved_by(rows, d, matrices, sizes[level - 1])
                    yield _expansions(level - 1, [k >> 1 for k in keys], b)

        multipoles = multipoles.select(*box_names(d), "c")
        now, out = multipoles.where(F.col("level") == self.deepest), None
        for level in range(self.deepest, -1, -1):
            out = now if out is None else out.unionByName(now)
            if level:
                now = cut(self.add_up(now.mapInArrow(run, self.box).unionByName(multipoles.where(F.col("level") == level - 1))))
        return out

    def multipole_to_local(self, edges, multipoles):
        """The locals by list 2, without its edges: each multipole is sent once to every colleague of its parent.

        There the children of the colleague, which are told by a row that says which of them are targets, take from
        all that arrives what is not near them. In the plane a box's multipole so goes to 8 parents (for n = 1) and not to 27
        boxes, and a box's local is whole where it is made.
        """
        d, n, sizes, width, maths = self.d, self.traversal.n, self.sizes, self.tree.width, self.math()
        tables = self.tree.boxes.sparkSession.sparkContext.broadcast(self.class_tables())  # of a size fixed by order and n
        names, up = key_names(d), [f"q{k}" for k in key_names(d)]
        number = sum((F.col(k) % 2) * (1 << (d - 1 - i)) for i, k in enumerate(names))
        parents = self.traversal.target_or_target_parent_boxes.where("level > 1").groupBy("level", *[shift(F.col(k), 1).alias(q) for k, q in zip(names, up)])
        parents = parents.agg(F.bit_or(F.call_function("shiftleft", F.lit(1), number.cast("int"))).alias("kids"))
        asking = parents.select("level", *up, *[F.lit(None).cast("bigint").alias(k) for k in names], "kids", F.lit(None).cast("binary").alias("c"))
        around = multipoles.where("level > 1").select("level", *names, "c", *[shift(F.col(k), 1).alias(q) for k, q in zip(names, up)])
        sent = around.select("level", *names, "c", F.explode(moved(up, n)).alias("_q")).where(inside([f"_q.{q}" for q in up], F.col("level") - 1))
        sent = sent.select("level", *[f"_q.{q}" for q in up], *names, F.lit(None).cast("int").alias("kids"), "c")
        dealt = asking.unionByName(sent).repartition("level", *up).sortWithinPartitions("level", *up, F.col("kids").desc_nulls_last())

        def run(batches):
            for whole in _with_whole_groups(batches, 1 + d):
                for level, rows in _of_levels(whole):
                    q = _columns(rows, *up)
                    group = np.concatenate([[0], np.cumsum(np.any([k[1:] != k[:-1] for k in q], 0))])
                    kids = rows.column(1 + 2 * d)
                    asks = kids.is_valid().to_numpy(zero_copy_only=False)
                    asked = np.zeros(group[-1] + 1, np.int64)
                    asked[group[asks]] = kids.drop_null().to_numpy()
                    come = ~asks & (asked[group] > 0)
                    if not come.any():
                        continue
                    arrived, group, q = rows.filter(pa.array(come)), group[come], [k[come] for k in q]
                    s, a, w = _columns(arrived, *names), _complex(arrived.column(2 + 2 * d)), width / 2.0**level
                    for child, bits in enumerate(product((0, 1), repeat=d)):
                        v = [2 * k + bit - x for k, bit, x in zip(q, bits, s)]
                        far = (asked[group] >> child & 1 == 1) & (np.max(np.abs(v), 0) > n)
                        number = np.where(far, class_number(v, n), -1)
                        out = np.zeros((asked.size, sizes[level]), complex)
                        for which in np.unique(number[far]):
                            at = np.flatnonzero(number == which)
                            m = maths.class_matrix(tables.value[which], sizes[level])
                            out[group[at]] += maths.with_width(a[at] @ m.T, a[at], w)  # of one place there is one source for each target
                        some, first = np.unique(group[far], return_index=True)
                        if len(some):
                            yield _expansions(level, [2 * k[far][first] + bit for k, bit in zip(q, bits)], out[some])

        return dealt.mapInArrow(run, self.box)

    def refine_locals(self, local):
        """From the root down, each box's local is moved to its children and added to theirs."""
        matrices, sizes, d, names = self.down_matrices(), self.sizes, self.d, key_names(self.d)

        def run(batches):
            for batch in batches:
                for level, rows in _of_levels(batch):
                    yield _expansions(level, *_moved_by(rows, d, matrices, sizes[level]))

        local = local.select(*box_names(d), "c")
        now, out = local.where(F.col("level") == 0), None
        for level in range(self.deepest + 1):
            out = now if out is None else out.unionByName(now)
            if level < self.deepest:
                below = self.tree.boxes.where(F.col("level") == level + 1).select(*box_names(d), *[shift(F.col(k), 1).alias(f"_{k}") for k in names])
                above = now.select(*[F.col(k).alias(f"_{k}") for k in names], "c")
                down = below.join(above, [f"_{k}" for k in names]).select(*box_names(d), "c").mapInArrow(run, self.box)
                now = cut(self.add_up(down.unionByName(local.where(F.col("level") == level + 1))))
        return out

    def _evaluate(self, rows: DataFrame, inverse: bool) -> DataFrame:
        """The outputs at points of rows from their expansions: locals, or multipoles if inverse is set."""
        places, maths, names = self._places(), self.math(), self.outputs

        def run(batches):
            for batch in batches:
                for level, r in _of_levels(batch):
                    at, w = places(r, level)
                    found = maths.values(_complex(r.column(r.schema.names.index("c"))), at, w, inverse)
                    yield pa.record_batch([pa.array(_columns(r, "pid")[0]), *map(pa.array, found)], ["pid", *names])

        return rows.select("pid", *axes(self.d), *box_names(self.d), "c").mapInArrow(run, "pid bigint, " + ", ".join(f"{c} double" for c in names))

    def eval_locals(self, local, targets):
        return self._evaluate(targets.join(local, box_names(self.d)), False)

    def eval_multipoles(self, edges, multipoles, targets):
        at = targets.select("pid", *axes(self.d), *[F.col(c).alias(f"t_{c}") for c in box_names(self.d)])
        near = edges.join(at, side("t", self.d)).select("pid", *axes(self.d), *_from("s", self.d))
        return self._evaluate(near.join(multipoles, box_names(self.d)), True)

    def eval_direct(self, edges, sources, targets):
        return direct(edges, sources, targets, self.d, dict(zip(self.outputs, self.near())), self.source_columns)

    def finalize(self, value):
        return value * F.lit(SCALES["laplace", self.d])


class Laplace2D(Series):
    """The logarithm of the distance in the plane, by complex series (Greengard and Rokhlin, 1987)."""

    d = 2

    def size(self, order):
        return order + 1

    def _binomials(self) -> np.ndarray:
        n = 2 * max(self.orders) + 2
        c = np.zeros((n, n))
        c[:, 0] = 1
        for i in range(1, n):
            c[i, 1:] = c[i - 1, 1:] + c[i - 1, :-1]
        return c

    def up_matrices(self):
        p, choose = max(self.orders), self._binomials()
        out = np.zeros((4, p + 1, p + 1), complex)
        for child, (x, y) in enumerate(self.centres()):
            z0 = x + 1j * y
            out[child, 0, 0] = 1
            for l in range(1, p + 1):
                out[child, l, 0] = -(z0**l) / l
                for k in range(1, l + 1):
                    out[child, l, k] = 0.5**k * z0 ** (l - k) * choose[l - 1, k - 1]
        return out

    def down_matrices(self):
        p, choose = max(self.orders), self._binomials()
        out = np.zeros((4, p + 1, p + 1), complex)
        for child, (x, y) in enumerate(self.centres()):
            for l in range(p + 1):
                for k in range(l, p + 1):
                    out[child, l, k] = 0.5**l * choose[k, l] * (x + 1j * y) ** (k - l)
        return out

    def class_matrix(self, table, size):
        return table[:size, :size]

    def class_tables(self):
        p, choose, out = max(self.orders), self._binomials(), {}
        k = np.arange(1, p + 1)
        for number, v in self.classes().items():
            z0 = complex(-v[0], -v[1])
            m = np.zeros((p + 1, p + 1), complex)
            m[0, 0], m[0, 1:] = np.log(-z0), (-1.0) ** k / z0**k
            for l in range(1, p + 1):
                m[l, 0] = -1 / (l * z0**l)
                m[l, 1:] = choose[l + k - 1, k - 1] * (-1.0) ** k / z0 ** (k + l)
            out[number] = m
        return out

    def with_width(self, local, multipole, width):
        local[:, 0] += multipole[:, 0] * np.log(width)
        return local

    def multipole_of(self, at, width, weight, along, size):
        z, k = (at[:, 0] + 1j * at[:, 1])[:, None], np.arange(1, size)
        if along is None:
            return weight[:, None] * np.concatenate([np.ones((len(z), 1)), -(z**k) / k], 1)
        strength = -weight * (along[:, 0] + 1j * along[:, 1]) / width
        return np.concatenate([np.zeros((len(z), 1)), strength[:, None] * z ** (k - 1)], 1)

    def local_of(self, at, width, weight, along, size):
        z, k = (at[:, 0] + 1j * at[:, 1])[:, None], np.arange(1, size)
        if along is None:
            return weight[:, None] * np.concatenate([np.log(-z) + np.log(width), -1 / (k * z**k)], 1)
        return (weight * (along[:, 0] + 1j * along[:, 1]) / width)[:, None] / z ** np.arange(1, size + 1)

    def values(self, c, at, width, inverse):
        z, k = at[:, 0] + 1j * at[:, 1], np.arange(c.shape[1])
        powers = z[:, None] ** (-k if inverse else k)
        if inverse:
            value = c[:, 0] * (np.log(z) + np.log(width)) + (c[:, 1:] * powers[:, 1:]).sum(1)
            slope = (c[:, 0] - (k[1:] * c[:, 1:] * powers[:, 1:]).sum(1)) / z / width
        else:
            value = (c * powers).sum(1)
            slope = (k[1:] * c[:, 1:] * powers[:, :-1]).sum(1) / width
        return [value.real, slope.real, -slope.imag][: len(self.outputs)]

    def near(self):
        x, y, r2, w = F.col("t_x") - F.col("s_x"), F.col("t_y") - F.col("s_y"), squared_distance(2), F.col("weight")
        if not self.dipoles:
            return [w * F.log(r2) / 2, w * x / r2, w * y / r2]
        dx, dy = F.col("dx"), F.col("dy")
        along, across = x * x - y * y, 2 * x * y
        return [-w * (dx * x + dy * y) / r2, w * (dx * along + dy * across) / (r2 * r2), w * (dx * across - dy * along) / (r2 * r2)]


def solid_harmonics(at: np.ndarray, degree: int) -> np.ndarray:
    """The regular solid harmonics r^n P(n, m, cos theta) exp(i m phi) / (n + m)! of places, the degree n and the order m from
    -n to n at n * n + n + m; so scaled, a harmonic of a sum is the plain sum of products of harmonics."""
    x, y, z = at.T
    r2, out = x * x + y * y + z * z, np.zeros((len(at), (degree + 1) ** 2), complex)
    out[:, 0] = 1
    place = lambda n, m: n * n + n + m
    for m in range(degree + 1):
        if m:
            out[:, place(m, m)] = -out[:, place(m - 1, m - 1)] * (x + 1j * y) / (2 * m)
        for n in range(m + 1, degree + 1):
            below = out[:, place(n - 2, m)] if n > m + 1 else 0
            out[:, place(n, m)] = ((2 * n - 1) * z * out[:, place(n - 1, m)] - r2 * below) / ((n + m) * (n - m))
        for n in range(m, degree + 1):
            out[:, place(n, -m)] = (-1) ** m * np.conj(out[:, place(n, m)])
    return out


def singular_harmonics(at: np.ndarray, degree: int) -> np.ndarray:
    """The singular solid harmonics (n - m)! P(n, m, cos theta) exp(i m phi) / r^(n + 1), in the same order."""
    n, m = degrees_and_orders(degree)
    scale = np.array([math.factorial(a + abs(b)) * math.factorial(a - abs(b)) for a, b in zip(n, m)], float)
    r = np.sqrt((at * at).sum(1))[:, None]
    return solid_harmonics(at, degree) * scale / r ** (2 * n + 1)


def degrees_and_orders(degree: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.repeat(np.arange(degree + 1), 2 * np.arange(degree + 1) + 1)
    return n, np.arange(len(n)) - n * n - n


class Laplace3D(Series):
    """The inverse of the distance in space, by solid harmonics; a move is a sum of products of harmonics.

    A multipole is the sum of the conjugate regular harmonics of its sources and is evaluated with singular ones, a local
    the other way round.
    """

    d = 3

    def size(self, order):
        return (order + 1) ** 2

    def _shifts(self, scale: Callable) -> np.ndarray:
        """For each child, at [(n, m), (k, l)], the conjugate harmonic (n - k, m - l) of its centre, times scale(n, k)."""
        p = max(self.orders)
        n, m = degrees_and_orders(p)
        out = np.zeros((8, len(n), len(n)), complex)
        down, across = n[:, None] - n, m[:, None] - m
        fits = (down >= 0) & (np.abs(across) <= down)
        for child, centre in enumerate(self.centres()):
            h = np.conj(solid_harmonics(centre[None, :], p)[0])
            out[child] = np.where(fits, h[np.where(fits, down * down + down + across, 0)], 0) * scale(n[:, None], n[None, :])
        return out

    def up_matrices(self):
        return self._shifts(lambda n, k: 0.5**k)

    def down_matrices(self):
        return self._shifts(lambda n, k: 0.5**k).transpose(0, 2, 1)

    def class_tables(self):
        p = max(self.orders)
        return {number: singular_harmonics(np.array([v], float), 2 * p)[0] for number, v in self.classes().items()}

    def class_matrix(self, table, size):
        n, m = degrees_and_orders(math.isqrt(size) - 1)
        both, order = n[:, None] + n, m[:, None] + m
        return table[both * both + both + order] * (-1.0) ** n[:, None]

    @staticmethod
    def _steps(h: np.ndarray, degree: int, up: int) -> list[np.ndarray]:
        """The derivatives along x, y and z of harmonics up to degree: regular ones from those one degree below, singular ones
        from those one above (up is 1)."""
        n, m = degrees_and_orders(degree)
        at = n + (1 if up else -1)

        def of(move: int) -> np.ndarray:
            order = m + move
            ok = (at >= 0) & (np.abs(order) <= at)
            return np.where(ok, h[:, np.where(ok, at * at + at + order, 0)], 0)

        plus, minus = of(1), -of(-1)  # along x + iy and x - iy
        return [(plus + minus) / 2, (plus - minus) / 2j, -of(0) if up else of(0)]

    def multipole_of(self, at, width, weight, along, size):
        p = math.isqrt(size) - 1
        h = solid_harmonics(at, p)
        if along is None:
            return weight[:, None] * np.conj(h)
        return sum((weight * along[:, i] / width)[:, None] * np.conj(s) for i, s in enumerate(self._steps(h, p, 0)))

    def local_of(self, at, width, weight, along, size):
        p = math.isqrt(size) - 1
        if along is None:
            return weight[:, None] * singular_harmonics(at, p) / width
        steps = self._steps(singular_harmonics(at, p + 1), p, 1)
        return sum((weight * along[:, i] / width)[:, None] * s for i, s in enumerate(steps)) / width

    def values(self, c, at, width, inverse):
        p = math.isqrt(c.shape[1]) - 1
        if inverse:
            h = singular_harmonics(at, p + 1)
            parts = [h[:, : c.shape[1]] / width, *(s / width**2 for s in self._steps(h, p, 1))]
        else:
            h = solid_harmonics(at, p)
            parts = [np.conj(h), *(np.conj(s) / width for s in self._steps(h, p, 0))]
        return [(c * part).sum(1).real for part in parts[: len(self.outputs)]]

    def with_width(self, local, multipole, width):
        return local / width

    def near(self):
        apart = [F.col(f"t_{a}") - F.col(f"s_{a}") for a in axes(3)]
        r2, w = squared_distance(3), F.col("weight")
        r = F.sqrt(r2)
        if not self.dipoles:
            return [w / r, *[-w * x / (r2 * r) for x in apart]]
        along = [F.col(f"d{a}") for a in axes(3)]
        dot = sum((q * x for q, x in zip(along, apart)), F.lit(0.0))
        return [w * dot / (r2 * r), *[w * (q - 3 * dot * x / r2) / (r2 * r) for q, x in zip(along, apart)]]
