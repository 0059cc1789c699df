"""Vector operators: nearest neighbours by a permutation index, near copies by an inverted multi-index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.graph import components, local_roots

#: Permutation index: pivots, and how many of the nearest each vector is posted under.
PIVOTS, POSTED = 256, 64
#: Queries whose true neighbours fit the share of rows that is reranked, and the share of those neighbours that must be in it.
FIT_QUERIES, FIT_RECALL = 128, 0.96
#: Rows with one inverted file, and queries that go through it together.
INDEX_ROWS, INDEX_QUERIES = 1 << 14, 1 << 10
#: Rows and queries in one block of cells of the multi-index.
BLOCK = 8192
#: Multi-index: codewords of each half (64 at most: a set of them is the bits of a long), vectors that fit them.
CODEWORDS, FIT_VECTORS = 64, 8192


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The commonest length; 0 without vectors."""
    row = vectors.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return row["d"] if row else 0


def usable(vectors: DataFrame, d: int, column: str = "embedding") -> Column:
    """Vectors of d finite components that aren't all zero, with an id."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("vec_id").isNotNull() & (F.size(c) == d) & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(table, column: str = "embedding") -> np.ndarray:
    """The column's vectors as rows of doubles."""
    x = table.column(column)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.sqrt((a * a).sum(1))[:, None]


def _chosen(vectors: DataFrame, n: int) -> np.ndarray:
    """n vectors by a hash of their ids, as unit rows."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64(F.lit(99), "vec_id"), "vec_id").limit(n).collect()
    return _unit(np.array([r["embedding"] for r in rows], np.float64))


def _blocks(df: DataFrame, key: str, role: Column, sizes: tuple[int, int]) -> DataFrame:
    """Deals rows and queries (role true) of each key to a grid of blocks of bounded size, (key, part, query_part).

    A row goes to its part in all query parts, a query to its query part in all parts, so every row meets every query once.
    The table of counts has a row for each key, of which there is a fixed number.
    """
    df = df.withColumn("is_query", role)
    n = df.groupBy(key).agg(
        F.ceil(F.greatest(F.sum(F.when(~F.col("is_query"), 1).otherwise(0)), F.lit(1)) / sizes[0]).cast("int").alias("parts"),
        F.ceil(F.greatest(F.sum(F.when(F.col("is_query"), 1).otherwise(0)), F.lit(1)) / sizes[1]).cast("int").alias("query_parts"),
    )
    h = F.xxhash64(F.lit(5), "vec_id")
    df = df.join(F.broadcast(n), key)
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(h, F.col(c)).cast("int"))
    q = F.col("is_query")
    df = df.withColumn("part", F.explode(F.when(q, every("parts")).otherwise(own("parts"))))
    return df.withColumn("query_part", F.explode(F.when(q, own("query_parts")).otherwise(every("query_parts")))).drop("parts", "query_parts")


# permutation index


def _order(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Each row's nearest pivots, nearest first."""
    near = -(_unit(x) @ pivots.T)
    m = _posted(len(pivots))
    at = np.argpartition(near, m - 1, axis=1)[:, :m]
    own = np.take_along_axis(near, at, 1)
    return np.take_along_axis(at, np.lexsort((at, own), axis=1), 1).astype("<u2")


def _posted(pivots: int) -> int:
    return min(POSTED, max(1, pivots // 4))


def _permutations(table) -> np.ndarray:
    column = table.column("pivots")
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


class Postings:
    """The inverted file of some rows: for each pivot the rows posted under it and their places in those rows' orders.

    With orders of the m nearest pivots, and all others in place m, the footrule distance (the sum over pivots of the
    difference of places) is m * (m + 1) - 2 * shared, where shared is the sum over pivots in both orders of the smaller of
    m - place. So footrules of a query to all rows add up along the lists of its own m pivots, and only those.
    """

    def __init__(self, orders: np.ndarray, pivots: int):
        self.rows, self.m = orders.shape
        flat = orders.ravel()
        by = np.argsort(flat, kind="stable")
        self.row, self.weight = by // self.m, (self.m - by % self.m).astype(np.int32)
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))

    def shared(self, order: np.ndarray) -> np.ndarray:
        """What each row's footrule to a query lacks to m * (m + 1), halved: larger is nearer."""
        out = np.zeros(self.rows, np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.bounds[pivot], self.bounds[pivot + 1]
            out[self.row[a:b]] += np.minimum(self.weight[a:b], self.m - place)
        return out

    def nearest(self, order: np.ndarray, n: int) -> np.ndarray:
        """The n rows of smallest footrule, and all that are as near as the last of them."""
        shared = self.shared(order)
        if n >= len(shared):
            return np.arange(len(shared))
        return np.flatnonzero(shared >= np.partition(shared, len(shared) - n)[len(shared) - n])


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines of the k largest cosines to q, ties to the smaller id, an id once."""
    exact = (x * q).sum(1) / np.sqrt((x * x).sum(1) * (q * q).sum())  # the same for equal vectors, wherever they stand
    order = np.lexsort((ids, -exact))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], exact[order]


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def nearest(vectors: DataFrame, queries: Column, k: int = 5, column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows nearest to each query by cosine, the query's own id left out.

    The index: rows are dealt to parts by a hash, and each part has an inverted file that posts a row under its POSTED nearest
    of PIVOTS pivots. A query goes through the lists of its own pivots, which rank a part's rows by footrule, and the nearest
    `share` of them (k at least, and all ties) are compared exactly. The share is fitted so that FIT_RECALL of the true
    neighbours of FIT_QUERIES queries are in it; it is one of every part's rows, so every query has its k neighbours.
    Null, zero and non-finite vectors and those of another length than most take no part. Rows that repeat an id and vector
    count once; an id with several vectors is as near as the nearest of them, as a query too.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("embedding"), queries.alias("query"))
    d = dimension(vectors)
    vectors = vectors.where(usable(vectors, d)).groupBy("vec_id", "embedding").agg(F.max("query").alias("query"))
    spark = vectors.sparkSession
    vectors = stored(vectors, "vectors")
    pivots = _chosen(vectors, PIVOTS) if d else np.zeros((0, 1))
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(pivots)

    def post(batches):
        for batch in batches:
            if batch.num_rows:
                order = _order(_matrix(batch), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in order], pa.binary())], names=[*batch.schema.names, "pivots"])

    posted = stored(vectors.mapInArrow(post, ", ".join(f"{c} {t}" for c, t in vectors.dtypes) + ", pivots binary"), "posted")
    share = fitted_share(posted, shared, k)

    def search(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy(zero_copy_only=False)
        ids, x, order = table.column("vec_id").to_numpy(), _matrix(table), _permutations(table)
        rows, asks = np.flatnonzero(~role), np.flatnonzero(role)
        out = []
        if len(rows) and len(asks):
            postings = Postings(order[rows], len(shared.value))
            for a in asks.tolist():
                at = rows[postings.nearest(order[a], int(np.ceil(share * len(rows))) + k + 1)]
                at = at[ids[at] != ids[a]]
                near, score = _best(x[a], x[at], ids[at], k)
                out.append((np.full(len(near), ids[a]), near, score))
        return pa.table([np.concatenate(c) if out else [] for c in (zip(*out, strict=True) if out else [[]] * 3)], schema=_FOUND)

    n, asked = posted.agg(F.count("*"), F.count(F.when(F.col("query"), 1))).first()
    parts, query_parts = -(-n // INDEX_ROWS), max(1, -(-asked // INDEX_QUERIES))
    h = F.xxhash64(F.lit(5), "vec_id")
    every = lambda c: F.array(*[F.lit(i) for i in range(c)]) if c < 64 else F.sequence(F.lit(0), F.lit(c - 1))
    rows = posted.select("vec_id", "embedding", "pivots", F.lit(False).alias("role"), F.pmod(h, F.lit(parts)).cast("int").alias("part"), F.explode(every(query_parts)).alias("query_part"))
    asks = posted.where("query").select("vec_id", "embedding", "pivots", F.lit(True).alias("role"), F.explode(every(parts)).alias("part"), F.pmod(h, F.lit(query_parts)).cast("int").alias("query_part"))
    found = rows.unionByName(asks).groupBy("part", "query_part").applyInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted_share(posted: DataFrame, pivots, k: int) -> float:
    """The share of all rows, by footrule, that has FIT_RECALL of the true neighbours of FIT_QUERIES queries, which meet all rows."""
    rows = posted.where("query").orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id").limit(FIT_QUERIES).collect()
    if not rows:
        return 0.0
    ids, asks = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    order = np.frombuffer(b"".join(bytes(r["pivots"]) for r in rows), "<u2").reshape(len(rows), -1)

    def compare(batches):
        for batch in batches:
            own, x = batch.column("vec_id").to_numpy(), _matrix(batch)
            if not len(own):
                continue
            cosine = _unit(asks) @ _unit(x).T
            cosine[ids[:, None] == own[None]] = -np.inf
            postings = Postings(_permutations(batch), len(pivots.value))
            top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            shared = np.array([postings.shared(order[q])[top[q]] for q in range(len(ids))])
            q = np.repeat(np.arange(len(ids)), top.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(cosine[q, top.ravel()]), pa.array(shared.ravel(), pa.int32())], names=["q", "score", "shared"])

    near = posted.select("vec_id", "embedding", "pivots").mapInArrow(compare, "q int, score double, shared int")
    by = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("shared"))
    true = near.withColumn("rank", F.row_number().over(by)).where((F.col("rank") <= k) & (F.col("score") > F.lit(float("-inf")))).collect()  # FIT_QUERIES x k rows
    least = {q: np.array([r["shared"] for r in true if r["q"] == q]) for q in range(len(ids))}

    def ranks(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            postings = Postings(_permutations(batch), len(pivots.value))
            number, q_of = [], []
            for q, own in least.items():
                if len(own):
                    shared = np.sort(postings.shared(order[q]))
                    number += (len(shared) - np.searchsorted(shared, own, "left")).tolist()
                    q_of += [q * k + i for i in range(len(own))]
            yield pa.RecordBatch.from_arrays([pa.array(q_of, pa.int32()), pa.array(number, pa.int64())], names=["q", "n"])

    found = posted.select("pivots").mapInArrow(ranks, "q int, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()
    return float(np.quantile([r["n"] for r in found], FIT_RECALL, method="higher")) / posted.count() if found else 0.0


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each embedding whose vec_id is divisible by 50, among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


# inverted multi-index


class MultiIndex:
    """Codebooks of both halves of unit vectors, and how far traversal of their product grid goes.

    A cell's cost for a vector is the sum over halves of the squared distance to the border between the vector's own codeword
    and the cell's: nothing in the cell can be nearer. Cells are visited up to a cost of `reach`, the squared distance of unit
    vectors at the similarity threshold, so no pair is missed, however its vectors differ.
    """

    def __init__(self, sample: np.ndarray, least: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.cut = max(1, sample.shape[1] // 2)
        n = int(np.clip(len(sample) // 16, 1, CODEWORDS))
        self.codewords = [self._fit(h, n, rng) for h in self._halves(sample)]
        self.reach = 2 * (1 - least) + 1e-9

    def _halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.cut], x[:, self.cut :]] if x.shape[1] > 1 else [x, np.zeros((len(x), 1))]

    @staticmethod
    def _fit(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        c = x[rng.choice(len(x), n, replace=False)].copy()
        for _ in range(10):
            own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            for k in range(n):
                if (own == k).any():
                    c[k] = x[own == k].mean(0)
        return c

    def _distances(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances to each codeword, by half."""
        return [np.maximum((h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1), 0) for h, c in zip(self._halves(x), self.codewords, strict=True)]

    def _costs(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for d, c in zip(self._distances(x), self.codewords, strict=True):
            own = d.argmin(1)
            apart = np.sqrt(np.maximum(((c[own][:, None] - c[None]) ** 2).sum(2), 1e-18))
            out.append((np.maximum(d - d.min(1)[:, None], 0) / (2 * apart)) ** 2)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Each vector's own cell (first codeword * CODEWORDS + second), and the cells that it visits, of its own number or
        above: for each first codeword the second ones as bits.

        A pair in two cells is met from the one of the smaller number. Within reach are pairs from either side."""
        own, firsts, bits = np.empty(len(x), np.int64), [], []
        grid = np.arange(len(self.codewords[0]))[:, None] * CODEWORDS + np.arange(len(self.codewords[1]))[None]
        for a in range(0, len(x), 256):
            one, two = self._costs(x[a : a + 256])
            own[a : a + 256] = one.argmin(1) * CODEWORDS + two.argmin(1)
            seen = np.zeros((len(one), len(grid), 64), bool)
            seen[:, :, : grid.shape[1]] = (one[:, :, None] + two[:, None] <= self.reach) & (grid[None] >= own[a : a + 256, None, None])
            packed = np.packbits(seen, axis=2, bitorder="little").view("<i8")[:, :, 0]
            for row in packed:
                at = np.flatnonzero(row)
                firsts.append(at)
                bits.append(row[at])
        return own, firsts, bits


def link(vectors: DataFrame, least: float = 0.95, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, for links of cosine >= least between different rows.

    Equal vectors are first put together, and count as often as they are there. Each of the others is posted in its cell of
    the product grid and compared, in double precision, with what visits that cell; a visitor goes once to all cells of a first
    codeword. Blocks of those return each vector's number of links and the smallest id that it reaches within the block, never
    pairs.
    Null, zero and non-finite vectors, and vectors of another length than most, have no links; so have rows without vec_id.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("embedding"))
    spark = vectors.sparkSession
    d = dimension(vectors)
    good = vectors.where(usable(vectors, d)).withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    same = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    same = stored(same, "distinct")
    sample = _chosen(same.withColumnRenamed("rep", "vec_id"), FIT_VECTORS) if d else np.zeros((0, 1))
    if not len(sample):
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = spark.sparkContext.broadcast(MultiIndex(sample, least))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                own, firsts, bits = index.value.visits(_unit(_matrix(batch)))
                cells = pa.array([[{"cell": c, "bits": b} for c, b in zip(f.tolist(), m.tolist(), strict=True)] for f, m in zip(firsts, bits, strict=True)], visited)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), cells], names=["vec_id", "weight", "embedding", "own", "cells"])

    visited = pa.list_(pa.struct([("cell", pa.int64()), ("bits", pa.int64())]))
    kind = dict(same.dtypes)["embedding"]
    placed = stored(
        same.select(F.col("rep").alias("vec_id"), "weight", "embedding").mapInArrow(
            place, f"vec_id long, weight long, embedding {kind}, own long, cells array<struct<cell: long, bits: long>>"
        ),
        "cells",
    )
    posts = placed.select("vec_id", "weight", "embedding", "own", F.floor(F.col("own") / CODEWORDS).alias("cell"), F.lit(0).cast("long").alias("bits"), F.lit(False).alias("role"))
    asks = placed.select("vec_id", "weight", "embedding", "own", F.explode("cells").alias("c"))
    asks = asks.select("vec_id", "weight", "embedding", "own", "c.cell", "c.bits", F.lit(True).alias("role"))

    def compare(table: pa.Table) -> pa.Table:
        role = table.column("is_query").to_numpy(zero_copy_only=False)
        cell, bits = table.column("own").to_numpy(), table.column("bits").to_numpy().view(np.uint64)
        ids, weight, x = table.column("vec_id").to_numpy(), table.column("weight").to_numpy(), _unit(_matrix(table))
        rows = np.flatnonzero(~role)
        found_q, found_r = [], []
        for second in np.unique(cell[rows] % CODEWORDS).tolist():
            posts = rows[cell[rows] % CODEWORDS == second]
            every = np.flatnonzero(role & ((bits >> np.uint64(second)) & np.uint64(1) == 1))
            for a in range(0, len(every), 1024):
                asks = every[a : a + 1024]
                near = x[asks] @ x[posts].T >= least - 1e-12
                near &= ids[asks][:, None] != ids[posts][None]
                q, r = np.nonzero(near)
                found_q.append(asks[q])
                found_r.append(posts[r])
        q = np.concatenate(found_q) if found_q else np.empty(0, np.int64)
        r = np.concatenate(found_r) if found_r else np.empty(0, np.int64)
        if len(q):
            exact = (x[q] * x[r]).sum(1) >= least
            q, r = q[exact], r[exact]
        count = np.zeros(len(ids), np.int64)
        np.add.at(count, q, weight[r])
        away = cell[q] != cell[r]  # a pair of one cell is met from both sides
        np.add.at(count, r[away], weight[q[away]])
        nodes, root = local_roots(ids[q], ids[r])
        own = np.flatnonzero(count)
        n = np.bincount(np.searchsorted(nodes, ids[own]), weights=count[own], minlength=len(nodes)).astype(np.int64)
        return pa.table({"id": pa.array(nodes, pa.int64()), "n": pa.array(n, pa.int64()), "root": pa.array(root, pa.int64())})

    grid = _blocks(posts.unionByName(asks), "cell", F.col("role"), (BLOCK // 2, BLOCK // 2)).drop("role")
    links = stored(grid.groupBy("cell", "part", "query_part").applyInArrow(compare, "id long, n long, root long"), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    facts = stored(
        same.select("k1", "k2", "rep", "weight")
        .join(counts, F.col("rep") == F.col("id"), "left").drop("id")
        .join(groups, F.col("rep") == F.col("id"), "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "facts",
    )
    keyed = vectors.withColumn("ok", usable(vectors, d)).select(
        "vec_id", F.when(F.col("ok"), F.xxhash64("embedding")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding")).alias("k2")
    )
    out = keyed.join(facts, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all embeddings at cosine >= 0.95."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
