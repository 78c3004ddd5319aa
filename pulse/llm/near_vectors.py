"""Operator 8, embedding near-dedup: sorted projection passes, completed by pivot cells.

In each of ``PASSES`` passes the vectors are ordered lexicographically by a key of
``BITS`` concatenated random hashes (sides of random hyperplanes), and each is compared
with its next ``WINDOW`` neighbours in that order.  Pairs with a cosine of ``THRESHOLD`` or
more (double precision) link; a task keeps a spanning forest of the links it finds, and the
passes' forests are united into components.

The passes miss pairs that never come within a window, so what is still in different
components is then compared exactly.  Vectors go to the cell of their nearest pivot (a
sampled vector).  Linked vectors are an angle of at most acos(``THRESHOLD``) apart, so a
vector of cell c can only link with one of cell d if it lies within that angle of the
plane halfway between the two pivots; it visits those cells only, and of two cells one
sends its vectors to the other.  A cell is split into blocks of bounded size, and a task
holds one block while its visitors pass.  Float products only rule pairs out, with
a margin above their error; what they leave is compared in double precision.  No link is
lost, and where no cell can be ruled out every pair of vectors is compared once.

A window is bounded, a group of copies is not: all links of a vector are with
members of its own component, so a last step compares each component with itself, in
pairs of blocks of ``BLOCK`` vectors, and adds up the number of links per vector
without emitting pairs.  Equal vectors are one row with a weight from the start.

All passes are one range-partitioned sort: rows get positions, positions give blocks
that overlap by a window, so no neighbour is missed at a partition's edge.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
link with nothing; nor do vectors of different lengths.  Repeated rows are further vectors.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.common import read_table, write_shared
from pulse.llm.components import connected_components
from pulse.llm.sharding import numbered
from pulse.llm.vectors import matrix, runs, unit, usable

THRESHOLD = 0.95
PASSES, BITS, WINDOW, SEED = 10, 48, 128, 7
SPAN = 2_048                   # positions of one window block
BLOCK = 1_024                  # vectors of a component that are compared as one block
CELL_BLOCKS, CELL_LEAST, CELL_VALUES = 32, 512, 2_097_152  # cells aimed at; least vectors, most components of vectors in a block
TILE = 1_024                   # vectors of two cell blocks that are compared at a time
ROWS_PER_PARTITION = 100_000


def hyperplanes(dims: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((passes, bits, dims))


def _keys(passes: int, bits: int, seed: int):
    """One row per vector and pass with its sort key."""
    weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = unit(matrix(part.column("vector"), int(d)))
                for p, plane in enumerate(hyperplanes(int(d), passes, bits, seed)):
                    key = ((x @ plane.T) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(x), p)), pa.array(key)],
                                                     names=[*part.schema.names, "pass", "key"])

    return run


def _forest(n: int, pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the pairs (i, j)."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            yield i, j


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare_windows(window: int, threshold: float):
    """Blocks of rows in sort order: the links between rows at most ``window`` places apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["span"]):
            ids, group = block["id"].to_numpy(), np.column_stack([block["dims"].to_numpy(), block["pass"].to_numpy()])
            found = []
            for d, p in np.unique(group, axis=0):
                at = np.flatnonzero((group == (d, p)).all(axis=1))
                x = unit(matrix(block["vector"].combine_chunks().take(pa.array(at)), int(d)))
                for i in range(0, len(at), 256):
                    near = x[i:i + 256 + window]
                    close = np.argwhere(x[i:i + 256] @ near.T >= threshold)
                    apart = close[:, 1] - close[:, 0]
                    found.append(at[close[(apart > 0) & (apart <= window)] + i])
            forest = list(_forest(len(ids), np.concatenate(found))) if found else []
            if forest:
                i, j = np.array(forest).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], schema=_EDGES)

    return run


def _chunk(n: int, dims: int) -> int:
    """Vectors of a block of a cell: some ``CELL_BLOCKS`` blocks, as far as a task can hold them."""
    return max(1, min(max(CELL_LEAST, -(-n // CELL_BLOCKS)), CELL_VALUES // dims))


def _nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products with the pivots, and the cell (nearest pivot) of every vector."""
    products = x @ pivots.T
    return products, products.argmax(axis=1)


def _cells(pivots: dict[int, np.ndarray]):
    """Number of vectors per length and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                x = unit(matrix(batch.column("vector").filter(pa.array(dims == d)), d))
                cells, n = np.unique(_nearest(x, pivots[d])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int32)), pa.array(cells), pa.array(n)],
                                                 names=["dims", "cell", "n"])

    return run


def _visits(pivots: dict[int, np.ndarray], blocks: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    """Every vector in its own block (part 0) and in the blocks of other cells that it visits (part: own block + 1).

    ``blocks``: by length, the cells' first blocks and numbers of blocks.
    """
    reach = np.sqrt(1 - threshold * threshold) + 1e-9 if 0 < threshold < 1 else 1e-4 if threshold >= 1 else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                (first, number), pivot = blocks[d], pivots[d]
                products, cell = _nearest(unit(matrix(part.column("vector"), d)), pivot)
                split = part.column("split").to_numpy()
                own = first[cell] + split % number[cell]
                kept = part.drop_columns(["split"])

                def rows(at, block, parts, kept=kept):
                    return pa.RecordBatch.from_arrays([*kept.filter(pa.array(at)).columns, pa.array(np.full(at.sum(), block)),
                                                       pa.array(parts[at])], names=[*kept.schema.names, "block", "part"])

                for b in np.unique(own):
                    yield rows(own == b, b, np.zeros_like(own))
                for c in range(len(pivot)):
                    apart = np.linalg.norm(pivot - pivot[c], axis=1)[cell]
                    # pivots that nearly coincide have no plane between them that is known well enough
                    near = (products[np.arange(len(cell)), cell] - products[:, c] <= reach * apart) | (apart < 1e-6) | (cell == c)
                    for b in range(first[c], first[c] + number[c]):
                        sent = near & (own != b) & ((own < b) == ((own + b) % 2 == 0))
                        if sent.any():
                            yield rows(sent, b, own + 1)

    return run


def _compare_cells(threshold: float):
    """Blocks of cells and their visitors: a spanning forest of the links between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None

        def links(one, two, same):
            """Components (a, b) that a vector of one and a vector of two link."""
            (x, xs, cx), (y, ys, cy) = one, two
            least = threshold - 1e-6 * (8 + x.shape[1])    # products of floats are off by less
            for i in range(0, len(x), TILE):
                for j in range(i if same else 0, len(y), TILE):
                    near = xs[i:i + TILE] @ ys[j:j + TILE].T >= least
                    if not near.any():
                        continue
                    near &= cx[i:i + TILE, None] != cy[None, j:j + TILE]
                    a, b = np.nonzero(near)
                    for k in range(0, len(a), 65_536):
                        p, q = a[k:k + 65_536] + i, b[k:k + 65_536] + j
                        linked = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
                        if linked.any():
                            yield np.unique(np.column_stack([cx[p[linked]], cy[q[linked]]]), axis=0)

        for group in runs(batches, ["block", "part"]):
            x = unit(matrix(group["vector"].combine_chunks(), group["dims"][0].as_py()))
            now = (x, x.astype(np.float32), group["component"].to_numpy())
            if group["block"][0].as_py() != block:
                held, block = None, group["block"][0].as_py()
            home = group["part"][0].as_py() == 0
            if home:
                held = now
            elif held is None:
                continue
            found = list(links(held, now, home))
            if found:
                names, at = np.unique(np.concatenate(found), return_inverse=True)
                i, j = np.array(list(_forest(len(names), at.reshape(-1, 2)))).T
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], schema=_EDGES)

    return run


def remaining_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that unite the components of ``id, component, vector, dims`` between which there is any link."""
    sizes = {r["dims"]: r["count"] for r in vectors.groupBy("dims").count().collect()}
    wanted = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, -(-n // _chunk(n, d)))]) if sizes else F.lit(None)
    place = F.row_number().over(Window.partitionBy("dims").orderBy(F.xxhash64("id", F.lit(SEED)), "id"))
    chosen: dict[int, list] = {}
    if sizes:
        for r in (vectors.select("dims", "id", "vector", place.alias("place")).filter(F.col("place") <= max(
                -(-n // _chunk(n, d)) for d, n in sizes.items())).filter(F.col("place") <= wanted[F.col("dims")])
                .select("dims", "vector").collect()):
            chosen.setdefault(r["dims"], []).append(r["vector"])
    pivots = {d: np.unique(unit(np.array(v, np.float64)), axis=0) for d, v in chosen.items()}
    held = {(r["dims"], r["cell"]): r["n"] for r in vectors.select("dims", "vector").mapInArrow(_cells(pivots), "dims int, cell long, n long")
            .groupBy("dims", "cell").agg(F.sum("n").alias("n")).collect()}
    blocks, total = {}, 0
    for d, pivot in sorted(pivots.items()):
        number = np.array([-(-max(1, held.get((d, c), 0)) // _chunk(sizes[d], d)) for c in range(len(pivot))])
        blocks[d] = (total + np.cumsum(number) - number, number)
        total += int(number.sum())
    schema = "id long, component long, vector array<double>, dims int, block long, part long"
    sent = (vectors.select("id", "component", "vector", "dims", F.expr("xxhash64(id) & 1073741823").alias("split"))
            .mapInArrow(_visits(pivots, blocks, threshold), schema))
    return (sent.repartition(max(1, total), "block").sortWithinPartitions("block", "part")
            .select("block", "part", "component", "vector", "dims").mapInArrow(_compare_cells(threshold), "a long, b long"))


_LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64())])


def _count_links(threshold: float):
    """Pairs of blocks of one component: each vector's number of links there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "b1", "b2"]):
            b1, b2 = group["b1"][0].as_py(), group["b2"][0].as_py()
            ids, weight, side = group["id"].to_numpy(), group["n"].to_numpy(), group["block"].to_numpy()
            x = unit(matrix(group["vector"].combine_chunks(), group["dims"][0].as_py()))
            close = x @ x.T >= threshold
            if b1 == b2:
                np.fill_diagonal(close, False)
            else:
                close &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(close @ weight)], schema=_LINKS)

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    passes: int = PASSES, bits: int = BITS, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    all_rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    keyed = all_rows.withColumn("ok", usable(F.col("vector")) & F.col("vec_id").isNotNull()).select(
        "vec_id", "ok", "vector", F.xxhash64("vector").alias("h1"), F.hash("vector").alias("h2"))
    classes = (keyed.filter("ok").groupBy("h1", "h2")
               .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("vector").alias("vector")))
    classes = write_shared(classes.withColumn("dims", F.size("vector")), "vectors")

    schema = "id long, n long, vector array<double>, dims int, pass long, key long"
    passed = classes.select("id", "n", "vector", "dims").mapInArrow(_keys(passes, bits, seed), schema).drop("n")
    total = passes * classes.count()
    placed = numbered(passed, ["dims", "pass", "key", "id"], total, "projections", ROWS_PER_PARTITION)
    first = F.expr(f"row_number div {SPAN}")
    # a row is also the neighbour of those up to a window before it
    back = F.expr(f"greatest(row_number - {window}, 0) div {SPAN}")
    spans = placed.withColumn("span", F.explode(F.sequence(back, first)))
    compared = (spans.repartition("span").sortWithinPartitions("span", "row_number")
                .select("span", "id", "vector", "dims", "pass").mapInArrow(_compare_windows(window, threshold), "a long, b long"))
    comps = write_shared(connected_components(compared.distinct()), "components")
    grouped = classes.join(comps.withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.select("id", F.coalesce("component", "id").alias("component"), "vector", "dims")
    rest = write_shared(remaining_links(grouped, threshold).distinct(), "rest")
    if not rest.isEmpty():
        known = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comps = write_shared(connected_components(known.union(rest)), "components")

    members = classes.join(comps.withColumnRenamed("node", "id"), "id").select("id", "n", "vector", "dims", "component")
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = (members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
              .withColumn("b1", F.least("block", "other")).withColumn("b2", F.greatest("block", "other")))
    links = (blocks.repartition("component", "b1", "b2").sortWithinPartitions("component", "b1", "b2", "id")
             .select("component", "b1", "b2", "block", "id", "n", "vector", "dims")
             .mapInArrow(_count_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links")))

    found = (classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
             .filter((F.col("n") > 1) | F.col("component").isNotNull())
             .select("h1", "h2", F.lit(True).alias("ok"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
                     F.coalesce("component", "id").alias("component")))
    out = keyed.select("vec_id", "ok", "h1", "h2").join(found, ["h1", "h2", "ok"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
