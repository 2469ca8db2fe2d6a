"""Exact top-k search by inner product with M-trees of paged nodes.

Vectors are floored to integers after scaling, so that inner products are exact. Divided by the greatest norm M of a
tree and given one more coordinate, sqrt(1 - |x|**2), all its vectors have length 1; so has a query's direction, whose added coordinate
is 0. Euclidean distance then falls as the inner product rises, and it is a metric, as the tree needs.

A node is a page of its own: an inner page holds routing objects, their covering radii, their distances to the parent's
routing object and the numbers of their pages; a leaf page holds ids, vectors and those distances. Queries go through a tree
in blocks of similar ones. Pages are taken best first, by the least distance that anything in them can have for a query of the block;
for each query, entries that the stored parent distances and the triangle inequality exclude are left out, and pages or entries
that no query of the block needs aren't computed. Entries as far as the k-th best are still looked at, so ties are settled by id.

Rows fall to cells around sampled pivots, and cells of over ``tree_rows`` rows are dealt out evenly to several trees. A directory
(centre, radius and norm of each tree; at most MAX_TREES of them, and 64 MB) is broadcast. A query first searches the tree whose centre is
nearest; the k-th best score that it finds there bounds all others, so it is sent on only to those trees that can beat
it. One tree is in a task's memory at a time, and queries stream past it.

Scores are exact integers, cut to the range of long: by float64 while no product can reach 2**53, else by whole numbers of any size.

Defined results: vectors that are null or have null or non-finite components (before or after scaling) take no part, neither as
query nor as candidate, nor do rows with a null id; shorter vectors, the empty one too, count as padded with zeros; rows that
repeat an id are candidates each for itself, for queries of other ids; a query id is answered once, for its least vector;
equal scores go to the smaller id; a table without candidates or queries gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raywalk.llm import shared

TREE_ROWS, MAX_TREES, PIVOTS = 8192, 4096, 1024
#: Queries that go through a tree at once, and those that one task takes past a tree.
BLOCK, TASK_QUERIES = 256, 65_536
LEAF, FANOUT = 256, 12
#: Allowance for rounding of distances, which are at most 2.
SLACK = 1e-6
MOST, LEAST = (1 << 63) - 1, -(1 << 63)


def _norms(v: np.ndarray) -> np.ndarray:
    """Row norms that don't overflow where the result doesn't."""
    top = np.abs(v).max(axis=1, initial=0.0)
    unit = np.where(top > 0, top, 1.0)
    return np.sqrt(((v / unit[:, None]) ** 2).sum(axis=1)) * top


def _directions(v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    top = np.where(norms > 0, np.minimum(norms, np.finfo(float).max), 1.0)
    return v / top[:, None]


class MTree:
    """Bulk-loaded M-tree. ``pages``: tuples of arrays, the root last."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf, self.fanout = ids[order], vectors[order], leaf, fanout
        norms = _norms(self.vectors)
        self.norm = float(norms.max(initial=0.0)) or 1.0
        self.scaled = self.vectors / self.norm
        self.extra = np.sqrt(np.maximum(1.0 - (self.scaled**2).sum(axis=1), 0.0))
        widest = np.abs(self.vectors).max(initial=0.0)
        self.kind = np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.float64
        self.pages: list[tuple] = []
        self.rng = np.random.default_rng(3)
        self.centre, self.radius = np.zeros(vectors.shape[1]), 0.0
        if len(ids):
            every = np.arange(len(ids))
            middle = int(every[len(every) // 2])
            away = self._apart(every, middle)
            self.centre, self.radius = self.scaled[middle], float(away.max())
            self._build(every, middle)

    def _apart(self, rows: np.ndarray, x: int) -> np.ndarray:
        d = self.scaled[rows] - self.scaled[x]
        return np.sqrt((d * d).sum(axis=1) + (self.extra[rows] - self.extra[x]) ** 2)

    def _build(self, rows: np.ndarray, parent: int) -> int:
        if len(rows) <= self.leaf:
            self.pages.append(("leaf", self.ids[rows], self._apart(rows, parent), self.vectors[rows].astype(self.kind)))
            return len(self.pages) - 1
        pivots = self.rng.choice(rows, min(self.fanout, len(rows)), replace=False)
        far = np.stack([self._apart(rows, p) for p in pivots])
        nearest = far.argmin(axis=0)
        sizes = np.bincount(nearest, minlength=len(pivots))
        if sizes.max() == len(rows):  # all alike: cut into even parts around one pivot
            nearest = np.arange(len(rows)) * len(pivots) // len(rows)
            pivots = np.repeat(pivots[sizes.argmax()], len(pivots))
            far = np.repeat(far[sizes.argmax()][None], len(pivots), axis=0)
        routing, radii, children = [], [], []
        for k, p in enumerate(pivots):
            own = np.flatnonzero(nearest == k)
            if len(own):
                routing.append(p)
                radii.append(far[k][own].max())
                children.append(self._build(rows[own], p))
        routing = np.array(routing)
        self.pages.append(("inner", np.array(children), self._apart(routing, parent), np.array(radii), self.scaled[routing]))
        return len(self.pages) - 1


class Search:
    """Queries against the pages of one tree. ``computed`` counts the distances and products that were worked out."""

    def __init__(self, pages: list[tuple], centre: np.ndarray, norm: float):
        self.pages, self.centre, self.norm, self.computed = pages, centre, norm, 0

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list[int] | None = None) -> list[tuple[np.ndarray, list[int]]]:
        """Ids and scores of the k best rows for each query, without its ``own`` id, ties to smaller ids; only those of at least its floor."""
        m, norms = len(queries), _norms(queries)
        directions = _directions(queries, norms)
        square = (directions**2).sum(axis=1)
        exact = self.norm * float(norms.max(initial=0.0)) < 2.0**53
        floor = [LEAST] * m if floors is None else floors
        found: list[tuple[np.ndarray, list[int]]] = [(self.pages[-1][1][:0] if self.pages and self.pages[-1][0] == "leaf" else np.zeros(0, np.int64), []) for _ in range(m)]
        least, limit = np.array([float(x) for x in floor]), list(floor)  # the k-th best score so far, or the floor
        reach = np.full(m, np.inf)

        def settle(i: int, score: int) -> None:
            least[i], limit[i] = float(score), score
            span = norms[i] * self.norm
            if score > LEAST:
                reach[i] = np.sqrt(max(square[i] + 1.0 - 2.0 * (least[i] / span if span > 0 else 0.0), 0.0)) + SLACK

        for i, x in enumerate(floor):
            settle(i, x)
        if not self.pages:
            return found

        def apart(rows: np.ndarray, routing: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(square[rows, None] + 1.0 - 2.0 * (directions[rows] @ routing.T), 0.0))

        every = np.arange(m)
        queue = [(0.0, 0, len(self.pages) - 1, every, np.zeros(m), apart(every, self.centre[None])[:, 0])]
        turn = 1
        while queue:
            _, _, at, rows, low, parent = heapq.heappop(queue)
            live = low <= reach[rows]
            if not live.any():
                continue
            rows, parent, page = rows[live], parent[live], self.pages[at]
            if page[0] == "leaf":
                _, ids, away, vectors = page
                fit = np.abs(parent[:, None] - away) <= reach[rows, None]
                some, these = np.flatnonzero(fit.any(axis=0)), np.flatnonzero(fit.any(axis=1))
                self.computed += len(some) * len(these)
                if len(some):
                    self._leaf(queries, rows[these], ids[some], vectors[some], own, k, least, limit, found, settle, exact)
                continue
            _, children, away, radii, routing = page
            fit = np.abs(parent[:, None] - away) - radii <= reach[rows, None]
            some, these = np.flatnonzero(fit.any(axis=0)), np.flatnonzero(fit.any(axis=1))
            self.computed += len(some) * len(these)
            rows, fit = rows[these], fit[these]
            d = apart(rows, routing[some])
            for c, j in enumerate(some.tolist()):
                below = np.maximum(d[:, c] - radii[j], 0.0)
                on = np.flatnonzero(fit[:, j] & (below <= reach[rows]))
                if len(on):
                    heapq.heappush(queue, (float(below[on].min()), turn, int(children[j]), rows[on], below[on], d[on, c]))
                    turn += 1
        return found

    def _leaf(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int, least: np.ndarray, limit: list[int], found: list, settle, exact: bool) -> None:
        if exact:
            scores = queries[rows] @ vectors.T.astype(float)
            good = (scores >= least[rows, None]) & (ids[None, :] != own[rows, None])
        else:  # whole numbers of any size
            whole = [[int(x) for x in v] for v in vectors.tolist()]
            asked = [[int(x) for x in q] for q in queries[rows].tolist()]
            scores = np.array([[min(max(sum(a * b for a, b in zip(q, v)), LEAST), MOST) for v in whole] for q in asked], object)
            good = ids[None, :] != own[rows, None]
        for a in np.flatnonzero(good.any(axis=1)).tolist():
            i, on = int(rows[a]), np.flatnonzero(good[a])
            old_ids, old = found[i]
            new = [int(x) for x in scores[a, on].tolist()]
            order = sorted(zip([-x for x in old + new], [*old_ids.tolist(), *ids[on].tolist()]))
            order = [o for o in order if -o[0] >= limit[i]][:k]
            found[i] = np.array([o[1] for o in order], ids.dtype), [-o[0] for o in order]
            if len(order) == k:
                settle(i, -order[-1][0])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.fromiter(column.value_lengths().to_pylist(), np.int64, len(column))
    row = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = flat
    return out


def _ids(column: pa.Array) -> np.ndarray:
    out = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _floored(vector: str, scale: float) -> Column:
    """Components floored after scaling, as doubles: whole numbers from 2**52 on anyway."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    return F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))


class Directory:
    """Centre, norm and radius of every tree."""

    def __init__(self, trees: list[tuple[int, np.ndarray, float, float]]):
        self.numbers = np.array([t[0] for t in trees], np.int64)
        self.centres = np.stack([t[1] for t in trees])
        self.norms, self.radii = (np.array([t[i] for t in trees]) for i in (2, 3))

    def distances(self, queries: np.ndarray) -> np.ndarray:
        directions = _directions(queries, _norms(queries))
        return np.sqrt(np.maximum((directions**2).sum(axis=1)[:, None] + 1.0 - 2.0 * directions @ self.centres.T, 0.0))

    def reachable(self, queries: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Whether a tree can have a score of at least ``least``: query x tree."""
        norms = _norms(queries)
        square = (_directions(queries, norms) ** 2).sum(axis=1)
        span = norms[:, None] * self.norms
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            share = np.where(span > 0, least[:, None] / span, 0.0)
        far = np.sqrt(np.maximum(square[:, None] + 1.0 - 2.0 * share, 0.0)) + SLACK
        return (self.distances(queries) - self.radii <= far) | (least[:, None] <= float(LEAST))


def top_k(df: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0, tree_rows: int = TREE_ROWS, leaf: int = LEAF, fanout: int = FANOUT, counted=None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), the key and ``score`` of the k best rows for each row where ``queries`` holds.

    The key is a whole number or text. ``counted``, if given, is an accumulator of the distances and products worked out."""
    spark = df.sparkSession
    shared.bounded_batches(spark)
    rows = df.select(F.col(key).alias("id"), queries.alias("asks"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(F.forall("v", lambda x: x.isNotNull()))
    rows = rows.select("id", F.coalesce("asks", F.lit(False)).alias("asks"), _floored("v", scale).alias("v")).where(F.forall("v", lambda x: F.abs(x) < float("inf")))
    n, asking, width = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    of = df.schema[key].dataType
    kind = of.simpleString()
    if not n or not asking:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {key} {kind}, score long")
    most = max(1, min(MAX_TREES, (8 << 20) // max(width, 1)))
    tree_rows = max(tree_rows, -(-n // most))
    cells = min(PIVOTS, -(-n // tree_rows))
    pivots = _matrix(rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("v").toArrow()["v"], width)
    pivots = _directions(pivots, _norms(pivots))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            cell = (_directions(v, _norms(v)) @ pivots.T).argmax(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64)), pa.array(np.arange(seen, seen + len(v)))], ["id", "asks", "v", "cell", "turn"])
            seen += len(v)

    placed = shared.write_table(rows.mapInArrow(assign, T.StructType([T.StructField("id", of), T.StructField("asks", T.BooleanType()), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("cell", T.LongType()), T.StructField("turn", T.LongType())])), "vectors")
    shares, trees = [], 0
    for cell, size in sorted((r["cell"], r["count"]) for r in placed.groupBy("cell").count().collect()):  # at most PIVOTS rows
        parts = -(-size // tree_rows)
        shares.append((cell, trees, parts))
        trees += parts
    table = F.broadcast(spark.createDataFrame(shares, "cell long, first long, parts long"))
    dealt = placed.join(table, "cell").select((F.col("first") + F.pmod(F.col("turn"), F.col("parts"))).alias("tree"), "id", "v")

    def build(table: pa.Table) -> pa.Table:
        tree = MTree(_ids(table["id"]), _matrix(table["v"], width), leaf, fanout)
        pages = [pickle.dumps((tree.centre, tree.norm, tree.radius)), *(pickle.dumps(p) for p in tree.pages)]
        return pa.table({"tree": pa.array([table["tree"][0].as_py()] * len(pages), pa.int64()), "page": pa.array(np.arange(-1, len(pages) - 1)), "body": pa.array(pages, pa.binary())})

    forest = dealt.repartition(min(4 * trees, 2000), "tree").groupBy("tree").applyInArrow(build, "tree long, page long, body binary")
    forest = shared.write_table(forest, "pages")
    heads = [(r["tree"], *pickle.loads(r["body"])) for r in forest.where("page = -1").collect()]  # at most MAX_TREES + PIVOTS rows, 64 MB and a little
    sent = spark.sparkContext.broadcast(Directory(heads))
    groups = -(-asking // TASK_QUERIES)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = sent.value.distances(_matrix(batch.column("v"), width)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value.numbers[at]), *batch.columns], ["tree", "id", "v"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                least = part.column("least")
                can = sent.value.reachable(_matrix(part.column("v"), width), least.to_numpy(zero_copy_only=False).astype(float))
                can &= sent.value.numbers[None, :] != part.column("tree").to_numpy(zero_copy_only=False)[:, None]
                at, to = np.nonzero(can)
                for j in range(0, len(at), shared.BATCH_ROWS):
                    same = pa.array(at[j : j + shared.BATCH_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.numbers[to[j : j + shared.BATCH_ROWS]]), part.column("id").take(same), part.column("v").take(same), part.column("tree").take(same), least.take(same)], ["tree", "id", "v", "home", "least"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pages, search, held = None, [], None, []

        def out() -> pa.RecordBatch:
            ids, v, least = (pa.concat_arrays(x) for x in zip(*held))
            matrix = _matrix(v, width)
            before = search.computed
            found = search.best(matrix, _ids(ids), k, least.to_pylist())
            if counted is not None:
                counted.add(search.computed - before)
            of_ids = [i for i, _ in found]
            ends = np.cumsum([0, *(len(i) for i in of_ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(of_ids).tolist(), ids.type)
            scores = pa.array([s for _, x in found for s in x], pa.int64())
            return pa.RecordBatch.from_arrays([ids, v, pa.array([now // groups] * len(ids), pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, scores)], ["q", "v", "tree", "ids", "scores"])

        for batch in batches:
            slots = batch.column("slot").to_numpy()
            cuts = [0, *(np.flatnonzero(slots[1:] != slots[:-1]) + 1).tolist(), len(slots)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if slots[a] != now:
                    if held:
                        yield out()
                    now, pages, search, held = int(slots[a]), [], None, []
                part = batch.slice(a, b - a)
                n_pages = part.num_rows - part.column("body").null_count
                pages += [pickle.loads(x) for x in part.column("body").slice(0, n_pages).to_pylist()]
                for i in range(n_pages, part.num_rows, BLOCK):
                    if search is None:
                        search = Search(pages[1:], *pages[0][:2])
                    some = part.slice(i, BLOCK)
                    held.append([some.column(c) for c in ("id", "v", "least")])
                    if sum(len(h[0]) for h in held) >= BLOCK:
                        yield out()
                        held = []
        if held:
            yield out()

    def searched(asked: DataFrame) -> DataFrame:
        """``asked``: tree, id, v, home, least."""
        slot = (F.col("tree") * groups).alias("slot")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
        left = forest.join(asked.select("tree").distinct(), "tree", "left_semi").select(slot, "page", "body", each.alias("g"))
        left = left.select((F.col("slot") + F.col("g")).alias("slot"), "page", "body", *(F.lit(None).cast(t).alias(c) for c, t in (("id", of), ("v", "array<double>"), ("home", "long"), ("least", "long"))))
        right = asked.select((F.col("tree") * groups + F.pmod(F.xxhash64("id"), F.lit(groups))).alias("slot"), F.lit(MOST).cast("long").alias("page"), F.lit(None).cast("binary").alias("body"), "id", "v", "home", "least")
        tasks = min(trees * groups, 20_000)
        both = left.unionByName(right).withColumn("task", F.pmod(F.col("slot"), F.lit(tasks)).cast("int")).repartitionById(tasks, "task").sortWithinPartitions("slot", "page", "home", "id")
        found = T.StructType([T.StructField("q", of), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("tree", T.LongType()), T.StructField("ids", T.ArrayType(of)), T.StructField("scores", T.ArrayType(T.LongType()))])
        return both.select("slot", "body", "id", "v", "least").mapInArrow(meet, found)

    asks = placed.where("asks").groupBy("id").agg(F.min("v").alias("v")).mapInArrow(nearest, T.StructType([T.StructField("tree", T.LongType()), T.StructField("id", of), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    asks = shared.write_table(asks, "asks")
    home = shared.write_table(searched(asks.withColumns({"home": F.col("tree"), "least": F.lit(LEAST).cast("long")})), "home")
    known = home.select("tree", F.col("q").alias("id"), "v", F.when(F.size("scores") == k, F.element_at("scores", -1)).otherwise(F.lit(LEAST).cast("long")).alias("least"))
    sent_on = known.mapInArrow(others, T.StructType([T.StructField("tree", T.LongType()), T.StructField("id", of), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("home", T.LongType()), T.StructField("least", T.LongType())]))
    found = home.unionByName(searched(shared.write_table(sent_on, "sent"))) if trees > 1 else home
    found = found.select("q", F.inline(F.arrays_zip("ids", "scores")))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("scores"), "ids"))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("query_id"), "rank", F.col("ids").alias(key), F.col("scores").alias("score"))
