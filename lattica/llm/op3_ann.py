"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and the residuals' codebooks are trained on a bounded sample (``SAMPLE`` vectors, the first in the order of a hash of the id); every
vector is indexed. Vectors that are equal are one entry with the few smallest ids that a result could name. A query goes to its
nearest cells; there an asymmetric distance table (query residual against codebooks) ranks the entries by their codes, and the best are
reranked exactly, in double precision on the original vectors. How far they are bounds what else counts: every entry that its code, less
the length that the code leaves out of its vector, puts nearer than that is reranked too, and in a second pass the query goes to every other cell that
reaches so near, by the cell's radius. So no nearest vector is lost, whatever the rows are like; codes and cells only save work. Cells are cut into blocks of bounded size, and so are a cell's
queries, so a crowded cell is spread over tasks; a query's results of all its blocks are merged by their exact scores.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; null ids neither. A cosine is defined between vectors of one length:
each length has an index of its own. Ids are unique; of repeated rows of one id the smallest vector counts. Very long vectors are compared whole. Equal
scores go to the smaller id; fewer candidates than k give fewer rows; an empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that training takes at most.
SAMPLE = 20_000
#: Entries and queries in one task at most, about.
BLOCK, QUERIES = 8_000, 2_000
#: Entries that a block reranks exactly for each query at first: those whose codes come first, this many and this share of the block.
RERANK, RERANK_SHARE = 64, 0.06
#: A query visits so many cells at first that this share of the sample's true neighbours would be met, and this many at least.
PROBE_RECALL, PROBE_LEAST = 0.975, 16
#: More than distances of unit vectors are rounded by, those of nearly equal vectors included.
ROUNDED = 1e-6
#: Queries by which that is measured.
TRIALS = 256
#: Dimensions in one subspace, entries of its codebook.
SUBSPACE, CODES = 4, 256


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of x; fewer rows than k are their own centroids."""
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty), replace=False)]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(1) / 2
    for at in range(0, len(x), 4096):
        out[at : at + 4096] = np.argmin(half - x[at : at + 4096] @ c.T, axis=1)
    return out


class Index:
    """Centroids and codebooks; small enough to travel with tasks."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 3):
        x = _unit(sample)
        self.centroids = _kmeans(x, max(1, min(cells, len(x))), seed)
        rest = x - self.centroids[_nearest(x, self.centroids)]
        self.cuts = [(a, min(a + SUBSPACE, x.shape[1])) for a in range(0, x.shape[1], SUBSPACE)]
        self.books = [_kmeans(rest[:, a:b], CODES, seed + a) for a, b in self.cuts]

    def enough_probes(self, sample: np.ndarray, k: int, recall: float) -> int:
        """How many cells the sample's own queries must visit to meet that share of their k nearest.

        A sample is sparser than the whole, its neighbours are farther apart, so the whole needs no more.
        """
        x = _unit(sample)
        cell = _nearest(x, self.centroids)
        rank = np.argsort(self.probes(x[:TRIALS], len(self.centroids)), axis=1)  # of each cell, for each trial
        needed = []
        for i in range(min(TRIALS, len(x))):
            score = x @ x[i]
            score[i] = -np.inf
            near = np.argpartition(-score, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
            needed.extend(rank[i, cell[near]])
        return int(np.ceil(np.quantile(needed, recall))) + 1 if needed else 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: cell, distance from its centroid, codes, and the length of what the codes leave out."""
        cell = _nearest(x, self.centroids)
        rest = x - self.centroids[cell]
        codes = np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.cuts, self.books)], 1).astype(np.uint8)
        lost = rest - np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)
        return cell, np.linalg.norm(rest, axis=1), codes, np.linalg.norm(lost, axis=1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of unit vectors, nearest first."""
        far = (self.centroids * self.centroids).sum(1) / 2 - x @ self.centroids.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def reaching(self, x: np.ndarray, n: int, radii: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, cell): the cells behind the n nearest that may hold a vector within so far of a unit vector."""
        far = np.sqrt(np.maximum((self.centroids * self.centroids).sum(1) - 2 * x @ self.centroids.T + (x * x).sum(1)[:, None], 0))
        near = far - radii <= within[:, None] + ROUNDED
        np.put_along_axis(near, self.probes(x, n), False, axis=1)
        return np.nonzero(near)

    def tables(self, x: np.ndarray, cell: int) -> np.ndarray:
        """(queries, subspaces, codes): squared distance of the query's residual in the cell to each code."""
        rest = x - self.centroids[cell]
        out = np.full((len(x), len(self.cuts), CODES), np.inf)
        for s, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out[:, s, : len(book)] = ((rest[:, None, a:b] - book[None]) ** 2).sum(2)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of a vector with rows of v, in double precision."""
    return np.einsum("ij,j->i", v, q) / (np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("j,j->", q, q)))


def _distance(score: np.ndarray) -> np.ndarray:
    """Between unit vectors of that cosine."""
    return np.sqrt(np.maximum(2 - 2 * score, 0))


def _search_block(index: Index, k: int):
    """For groupBy(cell, block, qblock).cogroup: (queries, entries) -> each query's k best entries of the block, as far as they lie within the query's bound."""

    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and entries.num_rows:
            entries = entries.sort_by("gid")
            ids, lost = entries["gid"].to_numpy(), entries["lost"].to_numpy()
            v = _matrix(entries["vec"])
            codes = np.frombuffer(b"".join(entries["codes"].to_pylist()), np.uint8).reshape(len(ids), -1).T.copy()
            cell = queries["cell"][0].as_py()
            q_ids, q, within = queries["gid"].to_numpy(), _matrix(queries["vec"]), queries["within"].to_numpy()
            most = min(len(ids), max(RERANK, int(RERANK_SHARE * len(ids)), k))
            for at in range(0, len(q), 64):
                tables = index.tables(_unit(q[at : at + 64]), cell)
                for i, table in enumerate(tables):
                    far = table[0].take(codes[0])
                    for s in range(1, len(codes)):
                        far += table[s].take(codes[s])
                    least = np.sqrt(far) - lost
                    bound = within[at + i]
                    if most < len(ids):
                        first = np.argpartition(far, most - 1)[:most]
                        score = np.partition(cosines(q[at + i], v[first]), most - k)[most - k :]
                        bound = min(bound, _distance(score.min()))
                    near = np.flatnonzero(least <= bound + ROUNDED)
                    score = cosines(q[at + i], v[near])
                    best = np.lexsort((ids[near], -score))[:k]
                    out.append((np.full(len(best), q_ids[at + i]), ids[near][best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)] or [[], [], []]
        return pa.table({"qid": pa.array(columns[0], pa.int64()), "gid": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def valid_vectors(rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, vec array<double>): the rows that take part, one for each id."""
    vec = F.col(vector).cast("array<double>")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def search(
    rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None, probe_recall: float = PROBE_RECALL, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds (a column over vec_id) its k nearest other rows.

    cells: coarse cells; the default grows with the square root of the number of vectors, as far as the sample has 16 vectors for each.
    """
    usable = materialize(valid_vectors(rows, id_col, vector).groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")
    out = None
    for r in usable.select(F.size("vec").alias("d")).distinct().orderBy("d").collect():
        found = _search(usable.where(F.size("vec") == r["d"]), is_query, k, cells, probe_recall, sample)
        out = found if out is None else out.unionByName(found)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search(usable: DataFrame, is_query, k: int, cells: int | None, probe_recall: float, sample: int) -> DataFrame:
    """:func:`search` among vectors of one length with ids of their own."""
    spark = usable.sparkSession
    # Equal vectors: one entry each, with the k + 1 smallest ids, the most that one query's result can name.
    order = Window.partitionBy("vec").orderBy("vec_id")
    first = materialize(usable.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k + 1), "members")
    entry = first.groupBy("vec").agg(F.min("vec_id").alias("gid"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = materialize(entry, "entries")
    n = entries.count()
    asked = usable.where(is_query).select("vec_id", "vec")
    asked = materialize(asked.join(entries.select("vec", "gid"), "vec").select("vec_id", "gid"), "asked")
    picked = entries.orderBy(F.xxhash64("gid", F.lit(3)), "gid").select("vec").limit(sample).toArrow()
    cells = cells or min(max(1, sample // 16), max(1, 2 ** round(math.log2(math.sqrt(n) / 2 + 1))))
    index = Index(_matrix(picked["vec"]), cells)
    cells = len(index.centroids)
    probes = min(cells, max(PROBE_LEAST, index.enough_probes(_matrix(picked["vec"]), k, probe_recall)))

    def encode(batches):
        for b in batches:
            v = _matrix(pa.chunked_array([b.column(1)]))
            if len(v):
                cell, reach, codes, lost = index.encode(_unit(v))
                columns = [pa.array(cell), pa.array(reach), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lost)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["gid", "vec", "cell", "reach", "codes", "lost"])

    coded = materialize(entries.select("gid", "vec").mapInArrow(encode, "gid long, vec array<double>, cell long, reach double, codes binary, lost double"), "codes")

    # A row for each cell, of which the sample's size bounds the number, comes to the driver and goes to every task.
    held = {r["cell"]: (r["n"], r["radius"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()}
    radii = np.array([held[c][1] if c in held else -np.inf for c in range(cells)])

    def visit(batches):
        for b in batches:
            v = _matrix(pa.chunked_array([b.column(1)]))
            if len(v):
                cell = index.probes(_unit(v), probes)
                rows_ = np.repeat(np.arange(len(v)), cell.shape[1])
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(rows_)) for i in range(3)], pa.array(cell.ravel())], ["gid", "vec", "within", "cell"])

    def visit_rest(batches):
        for b in batches:
            v = _matrix(pa.chunked_array([b.column(1)]))
            if len(v):
                rows_, cell = index.reaching(_unit(v), probes, radii, b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(rows_)) for i in range(3)], pa.array(cell)], ["gid", "vec", "within", "cell"])

    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), "gid")

    def met(queries: DataFrame, visit) -> DataFrame:
        """(qid, gid, score): the best of each query (gid, vec, within) in the cells that it visits."""
        visits = materialize(queries.select("gid", "vec", "within").mapInArrow(visit, "gid long, vec array<double>, within double, cell long"), "visits")
        asks = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
        plan = [(c, max(1, math.ceil(held[c][0] / BLOCK)), max(1, math.ceil(asks[c] / QUERIES))) for c in sorted(held) if c in asks]
        grid = F.broadcast(spark.createDataFrame(plan, "cell long, blocks int, qblocks int"))
        part = lambda n, salt: F.pmod(F.xxhash64("gid", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = visits.join(grid, "cell").select("gid", "vec", "within", "cell", part("qblocks", 1).alias("qblock"), every("blocks").alias("block"))
        right = coded.join(grid, "cell").select("gid", "vec", "codes", "lost", "cell", part("blocks", 2).alias("block"), every("qblocks").alias("qblock"))
        keys = ["cell", "block", "qblock"]
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_block(index, k + 1), "qid long, gid long, score double")
        return materialize(found.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).drop("no"), "found")

    distinct = materialize(asked.select("gid").distinct().join(entries.select("gid", "vec"), "gid").select("gid", "vec"), "queries")
    nearest = met(distinct.withColumn("within", F.lit(float("inf"))), visit)
    # What a query has found bounds how far the rest can lie; one that has found too little goes everywhere.
    bound = nearest.groupBy("qid").agg(F.when(F.count("*") > k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).alias("within"))
    rest = met(distinct.join(bound, distinct["gid"] == bound["qid"], "left").select("gid", "vec", F.coalesce("within", F.lit(float("inf"))).alias("within")), visit_rest)
    found = nearest.unionByName(rest).withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).drop("no")
    found = materialize(found, "found")
    # From entries to rows: every query of an equal vector, and every id that an entry names.
    named = found.join(entries.select("gid", "ids"), "gid").groupBy("qid").agg(F.collect_list(F.struct("score", "ids")).alias("hits"))
    flat = F.flatten(F.transform("hits", lambda h: F.transform(h["ids"], lambda i: F.struct((-h["score"]).alias("less"), i.alias("vec_id")))))
    ranked = materialize(named.select(F.col("qid").alias("gid"), F.array_sort(flat).alias("hits")), "hits")
    answered = asked.join(ranked, "gid").select("vec_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k).alias("hits"))
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode("hits")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.less")).alias("score")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the 5 nearest of every vector whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 50 == 0)
