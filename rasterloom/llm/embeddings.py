"""Embedding near-duplicates by an inverted multi-index.

Codebooks of the two halves of unit vectors, learned from a bounded sample, form a product grid of cells. Every
distinct vector is indexed in the cell of its nearest codewords. The way of a vector to another cell is, in each half,
its distance from the plane half way between its own codeword and the other's. If two vectors are linked, their ways
to each other's cells lie on both sides of the same planes, so that in each half the two add up to the distance of the
halves at most: the vectors of a cell look for others in further cells, in multi-sequence order by the least ways from
there, as long as ways and back add up to no more than linked vectors can be apart.

A label's vectors are cut into blocks of neighbouring cells, as large as a task can hold, and every vector is sent once
to each pair of blocks within its reach, not to each cell: what is moved grows with blocks, and cells only spare
comparisons. There, cosines in single precision tell pairs that are clearly linked, or clearly aren't; the few at the
threshold are told in double precision. Every pair is met once and counts for both. Vectors that are equal number by
number are one vector with a count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import each_run, forget, written
from rasterloom.llm.components import connected_components

#: Vectors that codebooks are learned from, at most; rounds of k-means; codewords of a half, at least and most.
SAMPLE, ROUNDS, FEWEST, MOST = 20_000, 12, 4, 1024
#: Distinct vectors to a cell of a label, on average, that the number of codewords aims at.
CELL = 128
#: Share of the distance of linked vectors that ways may add up to: all of it, so that no link is lost.
REACH = 1.0
#: Vectors of a block, and their bytes, at most; a table has SHARE blocks, but none of fewer than LEAST vectors is cut.
BLOCK, BLOCK_BYTES, SHARE, LEAST = 65_536, 16_000_000, 8, 8192
#: Bits of a vector's hash that tell the vectors of a cell apart where blocks are cut.
SPREAD = 20
#: Vectors of a cell that look for others together; vectors that they meet, and pairs, at once; edges kept unsummed.
STRIP, MEET, PAIRS, EDGES = 512, 8192, 1 << 21, 1 << 20


def _rounding(dim: int) -> float:
    """More than products and distances of unit vectors of so many numbers in single precision are wrong by."""
    return (dim + 16) * 2.0**-22


class Codebooks(NamedTuple):
    halves: tuple[np.ndarray, np.ndarray]
    cut: int

    def split(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.cut], unit[:, self.cut :]

    def own(self, unit: np.ndarray) -> list[np.ndarray]:
        """The nearest codeword of each half."""
        return [((c * c).sum(1) - 2 * x @ c.T).argmin(1) for x, c in zip(self.split(unit), self.halves, strict=True)]

    def cell(self, own: list[np.ndarray]) -> np.ndarray:
        return own[0] * len(self.halves[1]) + own[1]

    def between(self) -> list[np.ndarray]:
        """Twice the distances of each half's codewords from each other."""
        return [2 * np.sqrt(np.maximum((s := (c * c).sum(1))[:, None] + s - 2 * c @ c.T, 1e-18)) for c in self.halves]

    def ways(self, unit: np.ndarray, own: list[np.ndarray], between: list[np.ndarray]) -> list[np.ndarray]:
        """For each half, each row's way to each codeword (a lower bound)."""
        out, at = [], np.arange(len(unit))
        for x, c, o, w in zip(self.split(unit), self.halves, own, between, strict=True):
            d = (c * c).sum(1) - 2 * x @ c.T
            m = np.maximum(0, d - d[at, o][:, None] - _rounding(unit.shape[1])) / w[o]
            m[at, o] = 0
            out.append(m)
        return out

    def way(self, far: list[np.ndarray], first: int, last: int) -> np.ndarray:
        """Squared way of each row to the nearest of the cells from first to last, from the squares of both halves' ways."""
        (i, j), (k, m) = divmod(first, len(self.halves[1])), divmod(last, len(self.halves[1]))
        if i == k:
            return far[0][:, i] + far[1][:, j : m + 1].min(1)
        least = np.minimum(far[0][:, i] + far[1][:, j:].min(1), far[0][:, k] + far[1][:, : m + 1].min(1))
        return np.minimum(least, far[0][:, i + 1 : k].min(1)) if k > i + 1 else least


def learn_codebooks(unit: np.ndarray, codewords: int, seed: int = 1) -> Codebooks:
    rng, cut, halves = np.random.default_rng(seed), unit.shape[1] // 2, []
    for x in (unit[:, :cut], unit[:, cut:]):
        c = np.unique(x, axis=0)
        c = c[rng.permutation(len(c))[:codewords]]
        for _ in range(ROUNDS):
            nearest = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            for k in range(len(c)):
                if (mine := nearest == k).any():
                    c[k] = x[mine].mean(0)
        if c.size:  # along the direction in which they differ most, so that blocks hold cells that are near each other
            c = c[np.argsort(c @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0])]
        halves.append(c)
    return Codebooks((halves[0], halves[1]), cut)


def multi_sequence(a: np.ndarray, b: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Cells (i, j) in order of a[i] + b[j] as long as that is at most `most`."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[ia].tolist(), b[ib].tolist()
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            break
        out.append((int(ia[i]), int(ib[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def _matrix(data: pa.ChunkedArray | pa.Array, dim: int, kind: str) -> np.ndarray:
    """Raw vectors as rows of doubles, filled up with zeros."""
    data = data.to_pylist()
    if all(len(x) == dim * np.dtype(kind).itemsize for x in data):
        return np.frombuffer(b"".join(data), kind).reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(data), dim))
    for i, x in enumerate(data):
        v = np.frombuffer(x, kind)
        out[i, : len(v)] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of each row of x with the same of y is `least` or more."""
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((y * y).sum(1)) >= least


def _place(books: Codebooks, batch: pa.RecordBatch, dim: int, kind: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Unit vectors of rows (vec, v, ...), their codewords, and their places in order of cells."""
    unit = _unit(_matrix(batch.column(1), dim, kind))
    own = books.own(unit)
    return unit, own, books.cell(own).astype(np.int64) << SPREAD | batch.column(0).to_numpy() & (1 << SPREAD) - 1


def _cuts(vectors: DataFrame, books: Codebooks, dim: int, kind: str, sizes: dict[str, int], size: int) -> dict[str, np.ndarray]:
    """For labels with more than `size` vectors, given with their sizes: the places where their blocks but the first begin."""
    if not sizes:
        return {}
    held = vectors.sparkSession.sparkContext.broadcast(books)  # 2 * MOST codewords at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array(_place(held.value, part, dim, kind)[2])], ["label", "place"])

    parts = {label: -(-n // size) for label, n in sizes.items()}
    grid = 4 * max(parts.values())
    places = vectors.where(F.col("label").isin(list(parts))).select("vec", "v", "label").mapInArrow(run, "label string, place long")
    found = places.groupBy("label").agg(F.percentile_approx("place", [k / grid for k in range(1, grid)], max(10_000, 16 * grid)).alias("at")).collect()
    return {r["label"]: np.unique([max(1, r["at"][k * grid // parts[r["label"]] - 1]) for k in range(1, parts[r["label"]])]) for r in found}


def _dealt(vectors: DataFrame, books: Codebooks, dim: int, kind: str, cuts: dict[str, np.ndarray], limit: float) -> DataFrame:
    """A row for each vector and pair of blocks (a, b) of its label: its own block and each that has cells within the
    squared way `limit`."""
    held = vectors.sparkSession.sparkContext.broadcast((books, cuts))  # a number for each block of the labels that are cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, cuts = held.value
        between = b.between()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit, own, place = _place(b, part, dim, kind)
                cell, labels = (place >> SPREAD).astype(np.int32), np.array(part.column(2).to_pylist(), object)

                def rows(mine: np.ndarray, block: np.ndarray, other: int) -> pa.RecordBatch:
                    kept = part.take(pa.array(mine))  # noqa: B023
                    more = (cell[mine], block, np.minimum(block, other), np.maximum(block, other))  # noqa: B023
                    return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.int32()) for c in more)], [*kept.schema.names, "cell", "block", "a", "b"])

                for label in dict.fromkeys(x for x in labels if x in cuts):
                    mine, cut = np.flatnonzero(labels == label), cuts[label]
                    block = np.searchsorted(cut, place[mine], "right")
                    far = [w * w for w in b.ways(unit[mine], [o[mine] for o in own], between)]
                    firsts, lasts = [0, *(cut >> SPREAD).tolist()], [*((cut - 1) >> SPREAD).tolist(), len(b.halves[0]) * len(b.halves[1]) - 1]
                    for k, (first, last) in enumerate(zip(firsts, lasts, strict=True)):
                        hit = (block == k) | (b.way(far, first, last) <= limit)
                        yield rows(mine[hit], block[hit], k)
                whole = np.flatnonzero([x not in cuts for x in labels])
                yield rows(whole, np.zeros(len(whole), np.int64), 0)

    return vectors.select("vec", "v", "label", "n").mapInArrow(run, "vec long, v binary, label string, n long, cell int, block int, a int, b int")


def _tied(near: np.ndarray, left_ids: np.ndarray, right_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links: the smallest id of what they are connected with."""
    to_left, to_right = left_ids.copy(), right_ids.copy()
    left = near.any(axis=1)
    while left.any():
        front = np.zeros(len(left), bool)
        front[np.argmax(left)] = True
        rows, columns = np.zeros(len(left), bool), np.zeros(len(right_ids), bool)
        while front.any():
            rows |= front
            new = near[front].any(axis=0) & ~columns
            columns |= new
            front = near[:, new].any(axis=1) & ~rows
        least = min(left_ids[rows].min(), right_ids[columns].min())
        to_left[rows], to_right[columns] = least, least
        left &= ~rows
    return to_left, to_right


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of edges (u, v) to the smallest one that it is connected with, but of those themselves."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (root[u] != root[v]).any():
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    to = ids[root]
    return ids[to != ids], to[to != ids]


def _strips(cells: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of runs of equal numbers, cut after STRIP of them."""
    bounds = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
    for start, end in zip(bounds, bounds[1:], strict=False):
        for at in range(start, end, STRIP):
            yield at, min(end, at + STRIP)


def _links(rows: DataFrame, books: Codebooks, dim: int, kind: str, least: float, limit: float) -> DataFrame:
    """Rows (vec, links, to) from rows (vec, v, label, n, cell, block, a, b), which are dealt and in order of label, a
    and b: the vectors that are linked here, with the counts of those that they are linked with, and edges that
    connect them."""
    held, slack = rows.sparkSession.sparkContext.broadcast(books), _rounding(dim)

    def compare(t: pa.Table) -> pa.RecordBatch:
        b, cell, block = held.value, t["cell"].to_numpy(), t["block"].to_numpy()
        order = np.lexsort((cell, block))
        cell, vec, n = cell[order], t["vec"].to_numpy()[order], t["n"].to_numpy()[order].astype(float)
        unit = np.empty((len(order), dim), np.float32)
        for at in range(0, len(order), 4096):
            unit[at : at + 4096] = _unit(_matrix(t["v"].take(pa.array(order[at : at + 4096])), dim, kind))
        same = t["a"][0].as_py() == t["b"][0].as_py()
        left = int((block == t["a"][0].as_py()).sum())
        right = 0 if same else left
        links, us, vs, edges = np.zeros(len(vec)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        small = Codebooks(tuple(c.astype(np.float32) for c in b.halves), b.cut)
        between, halves, own = [w.astype(np.float32) for w in b.between()], small.split(unit), np.divmod(cell, len(b.halves[1]))
        sizes = [(c * c).sum(1) for c in small.halves]
        home = [np.empty(len(vec), np.float32) for _ in own]
        for out, x, c, o, s in zip(home, halves, small.halves, own, sizes, strict=True):
            for at in range(0, len(vec), 4096):
                p = o[at : at + 4096]
                out[at : at + 4096] = s[p] - 2 * np.einsum("ij,ij->i", x[at : at + 4096], c[p])
        known, starts = np.unique(cell[right:], return_index=True)
        starts, ends = starts + right, np.append(starts[1:], len(cell) - right) + right
        i, j = (np.unique(o[right:]) for o in own)
        for start, end in _strips(cell[:left]) if right < len(cell) else ():
            p = [int(o[start]) for o in own]
            to = [w.min(0) for w in small.ways(unit[start:end], [o[start:end] for o in own], between)]
            cells = np.array([i[x] * len(b.halves[1]) + j[y] for x, y in multi_sequence(to[0][i] ** 2, to[1][j] ** 2, limit)], np.int64)
            at = np.searchsorted(known, cells)
            at = np.sort(at[known[np.minimum(at, len(known) - 1)] == cells])
            # those before the strip have met it
            at = at[ends[at] > start]
            first = max(start, right)
            y = np.concatenate([np.zeros(0, np.int64), *(np.arange(max(first, s), e) for s, e in zip(starts[at], ends[at], strict=True))])
            way = np.zeros(len(y), np.float32)
            for x, c, o, s, w, near_to, h, k in zip(halves, small.halves, own, sizes, between, to, home, p, strict=True):
                back = np.maximum(0, s[k] - 2 * (x[first:] @ c[k])[y - first] - h[y] - slack) / w[o[y], k]
                way += (back + near_to[o[y]]) ** 2
            y = y[way <= limit]
            step = min(MEET, PAIRS // (end - start))
            for at in range(0, len(y), step):
                meet = y[at : at + step]
                cosine = unit[start:end] @ unit[meet].T
                near = cosine >= least - slack
                if not near.any():
                    continue
                u, v = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                near, cosine, u, v = near[np.ix_(u, v)], cosine[np.ix_(u, v)], u + start, meet[v]
                if same:
                    near &= v > u[:, None]
                unsure = np.nonzero(near & (cosine < least + slack))
                for k in range(0, len(unsure[0]), 4096):
                    r, c = (x[k : k + 4096] for x in unsure)
                    near[r, c] = _near(*(_matrix(t["v"].take(pa.array(order[x])), dim, kind) for x in (u[r], v[c])), least)
                links[u] += near @ n[v]
                links[v] += n[u] @ near
                for x, root in zip((vec[u], vec[v]), _tied(near, vec[u], vec[v]), strict=True):
                    us.append(x[x != root])
                    vs.append(root[x != root])
                    edges += len(us[-1])
                if edges > EDGES:
                    us, vs = ([x] for x in _stars(np.concatenate(us), np.concatenate(vs)))
                    edges = 0
        u, v = _stars(np.concatenate(us), np.concatenate(vs))
        linked = links > 0
        out = [np.concatenate(c) for c in ((vec[linked], u), (links[linked].astype(np.int64), np.zeros(len(u), np.int64)), (vec[linked], v))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["vec", "links", "to"])

    return rows.mapInArrow(each_run(["label", "a", "b"], compare), "vec long, links long, to long")


def embedding_components(
    vectors: DataFrame, least: float = 0.98, reach: float = REACH, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row for each row of vectors: id, n_links (others linked directly), component_id (smallest id reachable) and kept.

    reach: what the ways of two vectors to each other's cells may add up to, as a share of the largest distance that
    linked vectors can have. The default finds every link, at every size; a shorter one saves time and loses some. Only vectors with equal labels are compared. Vectors
    that are null, empty or zero, or hold null or infinite numbers or NaN, and those without a label, link with
    nothing. Shorter vectors count as filled up with zeros. Rows with equal ids are kept, and count as others of each
    other; null ids are never a component_id unless a component has no other. Distinct vectors are named by 64-bit
    hashes. Other columns are not carried; an empty table gives no rows.
    """
    element = vectors.schema[vector_col].dataType.elementType.typeName()
    kind, stored = ("<f4", "array<float>") if element == "float" else ("<f8", "array<double>")
    v = F.col(vector_col).cast(stored)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("v"))
    rows = rows.withColumn("vec", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    same = rows.where("v is not null").groupBy("vec", "label", "v").agg(F.min("id").alias("first"), F.count("*").alias("n"))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(x, kind).tobytes() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *batch.columns[1:]], batch.schema.names)

    names = "vec long, label string, n long, first long"
    distinct = written(same.select("v", "vec", "label", "n", "first").mapInArrow(raw, f"v binary, {names}"))
    labels = distinct.groupBy("label").agg(F.count("*").alias("n"), F.max(F.octet_length("v")).alias("bytes"))
    known = labels.agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"), (F.sum(F.col("n").cast("double") ** 2) / F.sum("n")).alias("mean")).first()
    if not known["n"]:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = known["bytes"] // np.dtype(kind).itemsize
    # of the label that a vector is of, on average
    codewords = min(MOST, max(FEWEST, int((known["mean"] / CELL) ** 0.5)))
    size = min(SAMPLE, max(1000, 20 * codewords))
    sample = distinct.orderBy(F.xxhash64("vec"), "vec").limit(size).select("v").collect()
    books = learn_codebooks(_unit(_matrix(pa.array([bytes(r["v"]) for r in sample]), dim, kind)), codewords)
    limit = (reach * max(0.0, 2 - 2 * least) ** 0.5 + _rounding(dim)) ** 2
    block = max(1, min(BLOCK, BLOCK_BYTES // known["bytes"], max(LEAST, -(-known["n"] // SHARE))))
    cuts = _cuts(distinct, books, dim, kind, {r["label"]: r["n"] for r in labels.where(F.col("n") > block).collect()}, block)

    dealt = _dealt(distinct, books, dim, kind, cuts, limit)
    found = written(_links(dealt.repartition("label", "a", "b").sortWithinPartitions("label", "a", "b"), books, dim, kind, least, limit))

    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("vec").alias("u"), F.col("to").alias("v")))
    named = distinct.select("vec", "first", "n").join(counts, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left").withColumn("root", F.coalesce("root", "vec"))
    # only vectors with links need their component's smallest id looked up
    several = named.where("vec <> root").select("root").distinct()
    least_id = named.join(several, "root", "left_semi").groupBy("root").agg(F.min("first").alias("least"))
    named = named.join(least_id, "root", "left").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    named = written(named)
    forget(distinct, found, roots)
    all_rows = rows.select("id", "vec").join(named, "vec", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return all_rows.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
