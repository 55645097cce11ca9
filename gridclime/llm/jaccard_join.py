"""Exact Jaccard self-join in the metric space of word-shingle sets, and its components.

d(x, y) = 1 - |x & y| / |x | y| is a metric. Texts with equal sets are one point. Two points within the radius
share one of the first shingles of either in any fixed total order of the shingles; those shingles are the cells
of the first level. Shingles that many points have come last in that order, so that a passage which many documents
share founds no cell of documents that have only it in common.

A cell of few points is joined at once under bounds on sizes and positions, and on what can be common at most by
histograms of the hashes; only then are whole sets moved and compared. A larger one elects documents as pivots
and measures every point's distance to them: points within the radius are linked to the pivot. By the triangle
inequality two points can only be linked if their distances to a pivot differ by the radius at most; these windows
bound what is compared from then on. Pivots leave their cell, and points that links have joined already need no
comparison, so a cell of many near copies is settled by its pivots; the cell divides again with new pivots, taken
outside its largest component. What ``rounds`` divisions leave of the cells forms regions, one for each largest
component, whose outer points are joined with all of the region block by block on the whole sets. No cell is cut and no
pair that could join two components is left out.

Found are verified links that join every component, not each pair inside a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Tables, bit_filter, in_filter
from .tokens import WORDS, chunks, distinct, mix, shingle_sets, tokenise

#: Points of a cell that is joined without a pivot.
SMALL = 32
#: Pivots of a larger cell in each round.
PIVOTS = 8
#: Points of a block of a region.
BLOCK = 1000
#: Shingles of a stretch of rows, among which a task looks for repeated ones.
STRETCH = 1_000_000
#: Bytes of sets or shingles that a task holds before it sends them on.
FLUSH = 4 << 20
#: Bits of the filter of frequent shingles (16 MB), of which an eighth is set at most.
FREQUENT_BITS = 1 << 27


def _point(s: np.ndarray) -> int:
    """63-bit hash of a set."""
    u = s.astype(np.uint64)
    with np.errstate(over="ignore"):
        return int(mix(np.add.reduce(mix(u + np.uint64(1))) + np.uint64(len(s))) >> np.uint64(1))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    column = batch.column(1)
    for first, _, data, offsets in chunks(column):
        for i, s in enumerate(shingle_sets(tokenise(data, offsets, WORDS), width)):
            yield first + i, s


def describe(docs: DataFrame, width: int, local: int = 2) -> DataFrame:
    """Kind 0, per document: row, n, point. Kind 1, per shingle that ``local`` points of a stretch of rows have: n, shingle."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "row", "n", "hash"]
        seen: dict[int, np.ndarray] = {}
        held = 0

        def frequent():
            values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
            keep = counts >= local
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(counts[keep].astype(np.int64)), pa.array(values[keep])],
                names,
            )

        for batch in batches:
            n, points = [], []
            for _, s in _sets(batch, width):
                p = _point(s)
                n.append(len(s))
                points.append(p)
                if len(s) and p not in seen:
                    seen[p] = s
                    held += len(s)
                if held > STRETCH:
                    yield frequent()
                    seen, held = {}, 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(points, pa.int64())], names
            )
        if seen:
            yield frequent()

    return docs.mapInArrow(one, "kind int, row long, n long, hash long")


def _required(nx, ny, num: int, den: int):
    """Common shingles of two linked sets, at least: den * c >= num * (nx + ny - c)."""
    return -(-num * (nx + ny) // (num + den))


def first_shingles(docs: DataFrame, width: int, num: int, den: int, order: np.ndarray) -> DataFrame:
    """(shingle, point, info): the shingles of which two linked points share one; info has n, place and whether frequent."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "point", "info"]
        for batch in batches:
            known: set[int] = set()
            shingle, point, info, held = [], [], [], 0
            for _, s in _sets(batch, width):
                n = len(s)
                p = _point(s) if n else 0
                if not n or p in known:
                    continue
                known.add(p)
                if held > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingle, point, info)], names)
                    shingle, point, info, held = [], [], [], 0
                hot = in_filter(order, s)
                k = n - -(-num * n // den) + 1
                chosen = np.concatenate([s[~hot], s[hot]])[:k]
                shingle.append(chosen)
                point.append(np.full(k, p, np.int64))
                place = np.arange(k, dtype=np.int64)
                info.append((n << 32) | (place << 1) | (place >= n - int(hot.sum())))
                held += 24 * k
            if shingle:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shingle, point, info)], names)

    return docs.mapInArrow(one, "shingle long, point long, info long")


def _place(info):
    return (info & 0xFFFFFFFF) >> 1


def _may_link(nx, ny, ix, iy, num, den):
    """Sizes, and what can be common after the first common shingle at places ix and iy."""
    sizes = den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)
    return sizes & (np.minimum(nx - ix, ny - iy) >= _required(nx, ny, num, den))


def small_cells(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows sorted by shingle and point within partitions -> pairs of small cells (kind 0) and rows of larger ones (kind 1)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "point", "info"]
        rest = {k: np.zeros(0, np.int64) for k in names}
        large = None  # shingle of a larger cell whose rows are still coming

        def work(x: dict, end: bool):
            """Join the complete cells of x; return the rest."""
            nonlocal large
            m = len(x["shingle"])
            if not m:
                return [], x
            s = x["shingle"]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            size = np.diff(np.append(first, m))
            is_large = (size > SMALL) | (s[first] == large) | (x["info"][first] & 1 == 1)
            cut = m if end or is_large[-1] else first[-1]
            large = s[-1] if not end and is_large[-1] else None
            row_large = np.repeat(is_large, size)[:cut]
            out = []
            if row_large.any():
                out.append((1, *(x[k][:cut][row_large] for k in names)))
            y = {k: x[k][:cut][~row_large] for k in names}
            for gap in range(1, SMALL):
                if len(y["shingle"]) <= gap:
                    break
                a, b = ({k: v[:-gap] for k, v in y.items()}, {k: v[gap:] for k, v in y.items()})
                ok = a["shingle"] == b["shingle"]
                na, nb = a["info"] >> 32, b["info"] >> 32
                ok &= _may_link(na, nb, _place(a["info"]), _place(b["info"]), num, den)
                if ok.any():
                    out.append((0, a["point"][ok], b["point"][ok], na[ok]))
            return out, {k: v[cut:] for k, v in x.items()}

        def send(out):
            for kind, *columns in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(columns[0]), kind, np.int32)), *map(pa.array, columns)], ["kind", "a", "b", "c"]
                )

        for batch in batches:
            x = {k: np.concatenate([rest[k], batch.column(i).to_numpy()]) for i, k in enumerate(names)}
            same = np.concatenate([[False], (x["shingle"][1:] == x["shingle"][:-1]) & (x["point"][1:] == x["point"][:-1])])
            out, rest = work({k: v[~same] for k, v in x.items()}, False)
            yield from send(out)
        out, _ = work(rest, True)
        yield from send(out)

    return rows.mapInArrow(one, "kind int, a long, b long, c long")


def packed(s: np.ndarray) -> bytes:
    return s.tobytes()


def histogram(s: np.ndarray) -> bytes:
    """How many shingles of the set fall into each of 2**k equal ranges of hashes, half as many ranges as shingles at
    least; empty, which says nothing, where a range has more than a byte can count."""
    bits = max(1, len(s).bit_length() - 1)
    counts = np.bincount(s >> np.int64(63 - bits), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets have in common at most, by their histograms; the finer one is folded to the coarser."""
    if len(x) < len(y):
        x, y = y, x
    x = x.reshape(len(y), -1).sum(axis=1, dtype=np.int64)
    return int(np.minimum(x, y).sum())


def plausible(pairs: DataFrame, marks: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose histograms do not rule out that they are linked."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            for i, (p, q) in enumerate(zip(b.column(2), b.column(3))):
                u, v = (np.frombuffer(z.as_buffer(), np.uint8) for z in (p, q))
                if len(u) and len(v):
                    c, either = most_common(u, v), int(u.sum(dtype=np.int64)) + int(v.sum(dtype=np.int64))
                    keep[i] = den * c >= num * (either - c)
            yield b.select(["x", "y"]).filter(pa.array(keep))

    x = marks.select(F.col("point").alias("x"), F.col("shingles").alias("sx"))
    y = marks.select(F.col("point").alias("y"), F.col("shingles").alias("sy"))
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "sx", "sy")
    return both.mapInArrow(one, "x long, y long")


def point_sets(docs: DataFrame, width: int, wanted: np.ndarray, pack=packed) -> DataFrame:
    """(point, shingles as packed 64-bit numbers, or what else ``pack`` makes of a set) of the points that the filter lets pass."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(own: dict[int, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.binary())], ["point", "shingles"]
            )

        for batch in batches:
            known, own, held = set(), {}, 0
            for _, s in _sets(batch, width):
                if len(s) and in_filter(wanted, np.array([p := _point(s)]))[0] and p not in known:
                    known.add(p)
                    own[p] = pack(s)
                    held += len(own[p])
                if held > FLUSH:
                    yield sent(own)
                    own, held = {}, 0
            yield sent(own)

    return docs.mapInArrow(one, "point long, shingles binary").dropDuplicates(["point"])


def measure(pairs: DataFrame, sets: DataFrame, num: int, den: int, tables: Tables, name: str = "") -> DataFrame:
    """(x, y, common, either, linked) of saved pairs (x, y), counted on the whole sets.

    Only sets that the pairs need are moved: their points are written first, so Spark knows how many there are.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            common, nx, ny = [], [], []
            for p, q in zip(b.column(2), b.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), np.int64) for z in (p, q))
                if len(u) > len(v):
                    u, v = v, u
                common.append(int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()))
                nx.append(len(u))
                ny.append(len(v))
            common, nx, ny = (np.array(z, np.int64) for z in (common, nx, ny))
            linked = den * common >= num * (nx + ny - common)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *map(pa.array, (common, nx + ny - common, linked))],
                ["x", "y", "common", "either", "linked"],
            )

    needed = pairs.select(F.explode(F.array("x", "y")).alias("point")).distinct()
    sets = sets.join(tables.save(needed, f"needed{name}"), "point", "left_semi")
    x = sets.select(F.col("point").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("point").alias("y"), F.col("shingles").alias("sy"))
    both = pairs.join(x, "x").join(y, "y").select("x", "y", "sx", "sy")
    return both.mapInArrow(one, "x long, y long, common long, either long, linked boolean")


def components(links: DataFrame, tables: Tables, prefix: str = "") -> DataFrame:
    """(point, root) of every point that has a link, by contracting each point into its smallest neighbour until no link is left."""
    edges, maps = links.select("x", "y"), []
    while True:
        k = len(maps)
        edges = tables.save(edges.where("x <> y").distinct(), f"{prefix}edges{k}")
        if not edges.head(1):
            break
        both = edges.union(edges.select("y", "x"))
        step = both.groupBy("x").agg(F.least("x", F.min("y")).alias("to"))
        step = tables.save(step, f"{prefix}step{k}")
        maps.append(step)
        edges = (
            edges.join(step, "x")
            .select("y", F.col("to").alias("x2"))
            .join(step.select(F.col("x").alias("y"), F.col("to").alias("y2")), "y")
            .select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y"))
        )
    if not maps:
        return links.select(F.col("x").alias("point"), F.col("y").alias("root")).where("false")
    found = maps[0].select(F.col("x").alias("point"), F.col("to").alias("root"))
    for step in maps[1:]:
        step = step.select(F.col("x").alias("root"), F.col("to").alias("next"))
        found = found.join(step, "root", "left").select("point", F.coalesce("next", "root").alias("root"))
    return found


def _allowed(num: int, den: int):
    """Whether rows x and y of a cell may be linked: other component, sizes, positions, and the window of every pivot."""
    radius = 1 - num / den + 1e-9
    windows = f"forall(zip_with(xd, yd, (u, v) -> coalesce(abs(u - v) <= {radius}, true)), z -> z)"
    return (
        (F.col("xcomponent") != F.col("ycomponent"))
        & (den * F.least("xn", "yn") >= num * F.greatest("xn", "yn"))
        & ((num + den) * F.least(F.expr("xn - xplace"), F.expr("yn - yplace")) >= num * F.expr("xn + yn"))
        & F.expr(windows)
    )


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("shingle", *(F.col(c).alias(side + c) for c in ("point", "n", "place", "component", "d")))


def join_regions(cells: DataFrame, sets: DataFrame, tables: Tables, num: int, den: int) -> DataFrame:
    """Links (x, y) between what cells with one main component have outside and all they have, block by block.

    Each pair of blocks is one task's work on its whole sets; of an outer point's links to one component it reports one.
    """

    def one(key: tuple, table: pa.Table) -> pa.Table:
        role, point, component = (table.column(c).to_numpy() for c in ("role", "point", "component"))
        sets_ = [np.frombuffer(z.as_buffer(), np.int64) for z in table.column("shingles")]
        outer, whole = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        x, y, seen = [], [], set()
        if len(outer) and len(whole):
            sizes = np.array([len(sets_[i]) for i in outer])
            flat = np.concatenate([sets_[i] for i in outer])
            owner = np.repeat(np.arange(len(outer)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for j in whole:
                left, right = np.searchsorted(flat, sets_[j], "left"), np.searchsorted(flat, sets_[j], "right")
                n = right - left
                at = np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(outer))
                linked = den * common >= num * (sizes + len(sets_[j]) - common)
                for i in outer[linked & (component[outer] != component[j])]:
                    if (i, component[j]) not in seen:
                        seen.add((i, component[j]))
                        x.append(min(point[i], point[j]))
                        y.append(max(point[i], point[j]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    rows = tables.save(cells.groupBy("main", "point").agg(F.max("component").alias("component")), "regions")
    sizes = rows.groupBy("main").agg(
        (1 + F.count("*") / BLOCK).cast("int").alias("wholes"),
        (1 + F.count_if(F.col("component") != F.col("main")) / BLOCK).cast("int").alias("outers"),
    )
    rows = rows.join(sizes, "main")
    part = F.xxhash64("point")
    outer = rows.where("component <> main").select(
        "main", "point", "component", F.lit(0).alias("role"),
        F.pmod(part, F.col("outers")).alias("a"), F.explode(F.expr("sequence(0L, wholes - 1L)")).alias("b"),
    )
    whole = rows.select(
        "main", "point", "component", F.lit(1).alias("role"),
        F.explode(F.expr("sequence(0L, outers - 1L)")).alias("a"), F.pmod(part, F.col("wholes")).alias("b"),
    )
    needed = tables.save(rows.select("point").distinct(), "region_points")
    blocks = outer.union(whole).join(sets.join(needed, "point", "left_semi"), "point")
    found = blocks.groupBy("main", "a", "b").applyInArrow(one, "x long, y long")
    return tables.save(found, "outer_links")


def divide(large: DataFrame, links: DataFrame, sets: DataFrame, tables: Tables, num: int, den: int, rounds: int) -> DataFrame:
    """All links (x, y), those of the larger cells added. large: (shingle, point, n, place)."""
    large = large.withColumn("d", F.array().cast("array<double>"))
    k = 0
    while large.head(1):
        k += 1
        root = components(links, tables, f"round{k}-")
        cells = large.join(root, "point", "left").withColumn("component", F.coalesce("root", "point")).drop("root")
        sizes = cells.groupBy("shingle", "component").agg(F.count("*").alias("m"))
        sizes = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("several"))
        cells = tables.save(cells.join(sizes.where("several > 1").drop("several"), "shingle"), f"cells{k}")
        if k > rounds:
            return links.union(join_regions(cells, sets, tables, num, den))
        heads = cells.where("component <> main").withColumn("slot", F.pmod(F.xxhash64("point"), F.lit(PIVOTS)))
        heads = heads.groupBy("shingle", "slot").agg(F.min_by(F.struct("point", "n", "place", "component", "d"), "point").alias("p"))
        heads = tables.save(heads.select("shingle", "slot", "p.*"), f"pivots{k}")
        pairs = _side(cells, "x").join(_side(heads, "y"), "shingle").where(_allowed(num, den))
        pairs = pairs.select(F.least("xpoint", "ypoint").alias("x"), F.greatest("xpoint", "ypoint").alias("y")).distinct()
        pairs = tables.save(pairs, f"pairs{k}")
        d = tables.save(measure(pairs, sets, num, den, tables, str(k)), f"distances{k}")
        links = links.union(d.where("linked").select("x", "y"))
        # the distance to one of the cell's pivots makes the windows of the rounds that follow
        pivot = heads.groupBy("shingle").agg(F.min("point").alias("pivot"))
        d = d.select("x", "y", (1 - F.col("common") / F.col("either")).alias("apart"))
        large = (
            cells.join(heads.select("shingle", "point"), ["shingle", "point"], "left_anti")
            .join(pivot, "shingle")
            .withColumns({"x": F.least("point", "pivot"), "y": F.greatest("point", "pivot")})
            .join(d, ["x", "y"], "left")
            .select("shingle", "point", "n", "place", F.array_append("d", F.col("apart")).alias("d"))
        )
    return links


def frequent_shingles(told: DataFrame) -> np.ndarray:
    """Filter of shingles that several points have. It only orders shingles, so what passes by chance does no harm."""
    often = told.where("kind = 1").groupBy("hash").agg(F.sum("n").alias("n"))
    # rows by powers of two of their counts: the most frequent ones that fill an eighth of the filter
    sizes = often.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("m")).collect()
    least, held = 64, 0
    for r in sorted(sizes, key=lambda r: -r.power):
        held += r.m
        if held > FREQUENT_BITS // 8:
            break
        least = r.power
    return bit_filter(often.where(F.col("n") >= 2.0**least), "hash", FREQUENT_BITS) if held else np.zeros(FREQUENT_BITS // 8, np.uint8)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 3, den: int = 4, rounds: int = 2
) -> DataFrame:
    """(id, n_shingles, component_id): smallest id that links of at least num/den similarity reach, one row per row of docs.

    Words are runs without white space, A-Z lower-cased; fewer than ``width`` words are one shingle. Null and empty
    texts have no shingle and no link; an empty table gives an empty result. Rows with one id are documents of their
    own with that id; a null id is never the smallest. Other columns are ignored. Sets and shingles are told apart by
    63-bit hashes.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    docs = docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("text"))
    told = tables.save(describe(docs, width), "points")
    rows = told.where("kind = 0").select("row", "n", F.col("hash").alias("point"))
    first = first_shingles(docs, width, num, den, frequent_shingles(told))
    salt = F.when(F.col("info") % 2 == 1, F.pmod("point", F.lit(64))).otherwise(F.lit(0))
    cells = small_cells(first.repartition("shingle", salt).sortWithinPartitions("shingle", "point"), num, den)
    cells = tables.save(cells, "cells")
    pairs = cells.where("kind = 0").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    large = cells.where("kind = 1").select(
        F.col("a").alias("shingle"), F.col("b").alias("point"), F.expr("c >> 32").alias("n"),
        F.expr("(c & 4294967295L) >> 1").alias("place"),
    ).dropDuplicates(["shingle", "point"])
    several = large.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").select("shingle")
    large = tables.save(large.join(several, "shingle"), "large")
    pairs = tables.save(pairs, "pairs")
    marks = point_sets(docs, width, bit_filter(pairs.select("x").union(pairs.select("y")), "x"), histogram)
    pairs = tables.save(plausible(pairs, tables.save(marks, "histograms"), num, den), "plausible")
    tables.drop("cells")
    wanted = bit_filter(pairs.select("x").union(pairs.select("y")).union(large.select("point")), "x")
    sets = tables.save(point_sets(docs, width, wanted), "sets")
    links = tables.save(measure(pairs, sets, num, den, tables).where("linked").select("x", "y"), "links")
    roots = components(divide(large, links, sets, tables, num, den, rounds), tables, "end-")
    points = rows.where("n > 0").groupBy("point").agg(F.min("row").alias("least"))
    joined = roots.join(points, "point")
    smallest = joined.groupBy("root").agg(F.min("least").alias("smallest"))
    joined = joined.join(smallest, "root").select("point", "smallest")
    points = points.join(joined, "point", "left").select("point", F.coalesce("smallest", "least").alias("component_id"))
    return rows.join(points, "point", "left").select(
        F.col("row").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("row")).alias("component_id"),
    )
