"""The most similar vectors of every vector (problem 3).

Block matrix join. Vectors are put into cells around centroids fitted on a
bounded sample and packed into chunks of one cell each; neighbouring cells form a
part of bounded size in bytes. A task takes two parts, or one with itself, and
compares the rows of either with the cells of the other that they probe, in tiles
of int8 products: each gives every cosine with a bound on its quantisation error;
what may still be among the k best, by that bound, is computed again from the
floats in double, and each row's k best are merged. Every chunk is sent once to
each task that needs it, with its vectors compressed without loss.

Of equal vectors, when there are more than k + 1, only the k + 1 with the
smallest ids are compared, since no other copy can be among anyone's k best, and
the first of them asks for all; so copies, even a third of all rows, never fill
a part. They are found by their hashes alone.

Cells make the search approximate: neighbours in cells that a row does not probe
are missed. README gives the recall measured against brute force.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.runtime import checkpoint, rows_up_to, widen

#: Vectors of a cell, about; cells that each vector is compared with.
CELL, PROBES = 500, 16
#: Vectors the centroids are fitted on, at most, and centroids of a model, at most.
SAMPLE, MOST_CELLS = 40_000, 4096
#: Models and vector lengths planned at once; more are worked through in groups.
MOST_KINDS = 1000
#: Bytes of float vectors in a part; a task holds two.
PART_BYTES = 32 << 20
#: Groups of more than k + 1 copies up to which their table is broadcast (40 bytes each).
MOST_COPIED = 100_000
#: Parts into which the copies of one vector are spread where that table is not broadcast.
SALTS = 64
#: Candidates of a task that are held before they are merged into the k best of each row.
PENDING = 500_000

#: Levels of the int8 codes: an 8-bit kernel without 32-bit sums adds products in pairs in
#: 16 bits, and 255 * 63 * 2 is the most that fits there.
ASK_LEVELS, BASE_LEVELS = 127, 63


def _field(tag: int, value) -> bytes:
    def number(n: int) -> bytes:
        out = b""
        while True:
            n, low = n >> 7, n & 127
            out += bytes([low | (128 if n else 0)])
            if not n:
                return out

    if isinstance(value, int):
        return number(tag << 3) + number(value)
    raw = value.encode() if isinstance(value, str) else value
    return number(tag << 3 | 2) + number(len(raw)) + raw


def _float_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same in float32, whose sums of 2,000 such products are exact."""
    parts = [a[:, i : i + 2000].astype(np.float32) @ b[:, i : i + 2000].astype(np.float32).T for i in range(0, a.shape[1], 2000)]
    return parts[0] if len(parts) == 1 else reduce(np.add, (p.astype(np.int32) for p in parts))


def _runtime_product():
    """The product as a session of one thread; the graph of its single operator is written field by field."""
    import onnxruntime as ort

    def value(name: str, kind: int, dims: int) -> bytes:
        shape = b"".join(_field(1, _field(2, f"{name}{i}")) for i in range(dims))
        return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    node = _field(1, "A") + _field(1, "B") + _field(1, "Z") + _field(2, "Y") + _field(4, "MatMulInteger")
    graph = _field(1, node) + _field(2, "g") + _field(11, value("A", 2, 2)) + _field(11, value("B", 3, 2)) + _field(11, value("Z", 2, 0)) + _field(12, value("Y", 6, 2))
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    s = ort.InferenceSession(_field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13)), options, providers=["CPUExecutionProvider"])
    zero = np.array(128, dtype=np.uint8)
    return lambda a, b: s.run(None, {"A": (a.astype(np.int16) + 128).astype(np.uint8), "B": np.ascontiguousarray(b.T), "Z": zero})[0]


def exact_product(product) -> bool:
    """Whether a kernel gives the sums of 32-bit integers, at the extremes of both operands too."""
    rng = np.random.default_rng(3)
    for dims in (1, 2, 31, 128, 1030):
        for draw in (lambda m, n=dims: rng.choice([-m, m], (24, n)), lambda m, n=dims: np.full((24, n), m), lambda m, n=dims: rng.integers(-m, m + 1, (24, n))):
            a, b = draw(ASK_LEVELS).astype(np.int8), draw(BASE_LEVELS).astype(np.int8)
            for x, y in ((a, b), (a, -b), (-a, b)):
                if not np.array_equal(product(x, y), x.astype(np.int32) @ y.astype(np.int32).T):
                    return False
    return True


@lru_cache(maxsize=1)
def _product():
    """An exact product of codes, (rows, dims) by (others, dims): the 8-bit kernel if it is exact on this CPU, else float32."""
    try:
        fast = _runtime_product()
        if exact_product(fast):
            return fast
    except Exception:
        pass
    return _float_product


def quantised(x: np.ndarray, top: float, levels: int = ASK_LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """int8 rows of x * levels / top, and the length of each row's rounding error."""
    q = np.rint(x * (levels / top)).clip(-levels, levels).astype(np.int8)
    return q, np.sqrt(((x - q.astype(np.float32) * (top / levels)) ** 2).sum(axis=1))


class _Best:
    """The k best of each row so far, as ordered lists that pending candidates are merged into."""

    def __init__(self, n: int, k: int, least: float) -> None:
        self.k, self.floor, self.waiting = k, np.full(n, least), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, cosines: np.ndarray) -> None:
        self.held.append((rows, ids, cosines))
        self.waiting += len(rows)
        if self.waiting > PENDING:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, d, c = (np.concatenate(z) for z in zip(*self.held))
        order = np.lexsort((d, -c, r))
        r, d, c = r[order], d[order], c[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        full = place == self.k - 1
        self.floor[r[full]] = np.maximum(self.floor[r[full]], c[full] - 1e-6)
        keep = place < self.k
        self.held, self.waiting = [(r[keep], d[keep], c[keep])], 0
        return self.held[0]


def _lengths(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = np.linalg.norm(x[i : i + 8192].astype(np.float64), axis=1)
    return out


def probe_join(ask: np.ndarray, probes: np.ndarray, base: np.ndarray, base_ids: np.ndarray, cells: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of ``base`` for each row of ``ask`` in the cells it probes: (row, id, cosine rounded to 6 places).

    ``probes`` has the cells of each row, the nearest first; ``cells`` the cell of
    each base row. Exact for those cells: an int8 product is passed over only if
    its bound is below the k-th best so far. Equal cosines are ordered by id;
    cosines below ``least`` are left out. A row is among its own best if it is
    in ``base``.
    """
    best = _Best(len(ask), k, least)
    if not len(ask) or not len(base):
        return best.merge()
    order = np.argsort(cells, kind="stable")
    base, base_ids, cells = base[order], base_ids[order], cells[order]
    n_ask, n_base = _lengths(ask), _lengths(base)
    a, b = (ask / n_ask[:, None]).astype(np.float32), (base / n_base[:, None]).astype(np.float32)
    top = float(max(np.abs(a).max(), np.abs(b).max()))
    qa, ea = quantised(a, top)
    qb, eb = quantised(b, top, BASE_LEVELS)
    del a, b
    unit = (top / ASK_LEVELS) * (top / BASE_LEVELS)
    product = _product()
    # |x.y - x'.y'| <= |x - x'| + |y - y'| (1 + |x - x'|)
    slack = ea + float(eb.max()) * (1 + ea) + 1e-6
    floor = best.floor
    names, starts = np.unique(cells, return_index=True)
    ends = np.append(starts[1:], len(cells))
    here = np.isin(probes, names)
    nearest = here.argmax(axis=1)
    rows_of = np.argsort(probes, axis=None, kind="stable")
    sorted_probes = probes.ravel()[rows_of]
    # the nearest of these cells comes first for each row and sets the bar for the others
    for first in (True, False):
        for name, lo, hi in zip(names, starts, ends):
            mine = rows_of[np.searchsorted(sorted_probes, name) : np.searchsorted(sorted_probes, name, "right")]
            rows = mine // probes.shape[1]
            rows = rows[(mine % probes.shape[1] == nearest[rows]) == first]
            for s in range(0, len(rows), 4096):
                r = rows[s : s + 4096]
                y = product(qa[r], qb[lo:hi])
                if first and hi - lo >= k:
                    kth = np.partition(y, hi - lo - k, axis=1)[:, hi - lo - k] * unit - slack[r]
                    floor[r] = np.maximum(floor[r], kth - 1e-6)
                i, j = np.nonzero(y >= np.floor((floor[r] - slack[r]) / unit)[:, None])
                ii, jj = r[i], j + lo
                c = np.empty(len(ii))
                for x in range(0, len(ii), 50_000):
                    p, q = ii[x : x + 50_000], jj[x : x + 50_000]
                    c[x : x + 50_000] = np.einsum("ij,ij->i", ask[p].astype(np.float64), base[q].astype(np.float64)) / (n_ask[p] * n_base[q])
                c = np.round(c, 6)
                good = (c >= floor[ii] - 2e-6) & (c >= least)
                best.add(ii[good], base_ids[jj[good]], c[good])
    return best.merge()


def block_join(ask: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int, least: float, tile: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``probe_join`` with every row of ``base``, in tiles: the exact result."""
    cells = np.arange(len(base)) // tile
    probes = np.tile(np.arange(max(1, -(-len(base) // tile))), (len(ask), 1))
    return probe_join(ask, probes, base, base_ids, cells, k, least)


def usable(rows: DataFrame, key: str, vector: str = "embedding_vector", dimension: str = "dimension", model: str = "embedding_model") -> DataFrame:
    """(_id, _model, _n, _vec) of vectors with as many components as ``dimension`` says, none null or NaN, not all zero."""
    v = F.col(vector).cast("array<float>")
    fine = (F.size(v) == F.col(dimension)) & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & fine).select(F.col(key).cast("bigint").alias("_id"), F.coalesce(F.col(model).cast("string"), F.lit("")).alias("_model"), F.size(v).alias("_n"), v.alias("_vec"))


def centroids(sample: np.ndarray, n: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit rows."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    n = max(1, min(n, len(sample)))
    c = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1)
        some = size > 0
        c[some] = sums[some] / size[some, None]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _lengths(x)[:, None].astype(np.float32)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, n)


def _copied(ready: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(_c1, _c2, _first, _last) of every vector with more than k + 1 copies, and how many there are.

    _last is the (k + 1)-th smallest id. Only hashes and ids are shuffled, of
    each vector k + 2 from a partition at most.
    """
    w = Window.partitionBy("_c1", "_c2").orderBy("_id")
    some = ready.select("_c1", "_c2", "_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 2)
    groups = checkpoint(some.groupBy("_c1", "_c2").agg(F.max("_r").alias("_m"), F.min("_id").alias("_first"), F.max(F.when(F.col("_r") <= k + 1, F.col("_id"))).alias("_last")).filter(F.col("_m") == k + 2).drop("_m"))
    return groups, groups.count()


def _plan(cells: dict[tuple, np.ndarray], held: list, slots: int) -> tuple[dict, dict]:
    """Parts of each kind's cells, and the tasks that each cell's chunks take part in.

    ``held`` has (model, length, cell, rows, reached cells). Returns the parts by
    kind (lists of cells) and for each kind the pairs of parts of which one
    reaches into the other.
    """
    bytes_of: dict[tuple, dict[int, int]] = {}
    reach: dict[tuple, dict[int, set[int]]] = {}
    for m, n, cell, rows, reached in held:
        bytes_of.setdefault((m, n), {})[cell] = 4 * n * rows
        reach.setdefault((m, n), {})[cell] = set(reached)
    parts: dict[tuple, list[list[int]]] = {}
    for kind, sizes in bytes_of.items():
        c, total = cells[kind], sum(sizes.values())
        most = max(1, -(-total // PART_BYTES))
        while most * (most + 1) // 2 < slots and most < len(sizes) // 4:
            most += 1
        room = -(-total // most)
        left = set(sizes)
        parts[kind] = []
        while left:
            # a part: a cell and its nearest cells that are in no part yet
            head = min(left)
            near = c @ c[head]
            held_bytes, pool = 0, []
            for x in sorted(left, key=lambda x: (-near[x], x)):
                if pool and held_bytes + sizes[x] > room * 1.02:
                    break
                pool.append(x)
                held_bytes += sizes[x]
            left -= set(pool)
            parts[kind].append(pool)
    return parts, reach


def most_similar(rows: DataFrame, key: str, k: int = 5, least: float = -1.0, probes: int = PROBES, cell: int = CELL, vector: str = "embedding_vector", dimension: str = "dimension", model: str = "embedding_model") -> DataFrame:
    """The k most similar other vectors of the same model for every usable vector.

    Returns (key, neighbour, cosine, rank): cosine in double, rounded to 6
    places; on equal cosines the smaller key ranks first; pairs below ``least``
    are left out. Vectors that are null, of another length than ``dimension``
    says, all zero, or with null, NaN or infinite components take no part; a
    null model is a model of its own. Keys are unique; should one be repeated,
    its rows are different vectors of that key. Other columns are ignored, and
    an empty table gives no rows. Any number of models and lengths is taken.
    """
    # two independent hashes of 64 bits name the copies of a vector
    ready = usable(rows, key, vector, dimension, model).withColumn("_c1", F.xxhash64("_model", "_vec")).withColumn("_c2", F.xxhash64(F.lit(7), "_vec"))
    lists = _lists(ready, k, least, probes, cell)
    return lists.select(F.col("_id").alias(key), F.posexplode("_l").alias("_p", "_e")).select(key, F.col("_e.d").alias("neighbour"), (F.negative("_e.m") / F.lit(1e6)).alias("cosine"), (F.col("_p") + 1).cast("int").alias("rank"))


def _lists(ready: DataFrame, k: int, least: float, probes: int, cell: int) -> DataFrame:
    """(_id, _l): for each row of ``ready`` its k best as an array of (m, d), m being minus the cosine in millionths."""
    kinds = rows_up_to(ready.groupBy("_model", "_n").count(), MOST_KINDS)
    if kinds is None:
        groups = 2 * -(-ready.select("_model", "_n").distinct().count() // MOST_KINDS)
        told = F.pmod(F.xxhash64(F.lit("kind"), "_model", "_n"), F.lit(groups))
        return reduce(DataFrame.unionByName, (_lists(ready.filter(told == i), k, least, probes, cell) for i in range(groups)))
    spark = ready.sparkSession
    copied, groups = _copied(ready, k)
    few = groups <= MOST_COPIED
    hot = F.broadcast(copied) if few else copied
    base = ready.withColumn("_asks", F.lit(True))
    if groups:
        base = ready.join(hot, ["_c1", "_c2"], "left").filter("_last is null or _id <= _last").withColumn("_asks", F.expr("_first is null or _id = _first"))
    cells: dict[tuple, np.ndarray] = {}
    for m, n, count in kinds:
        part = ready.filter((F.col("_model") == m) & (F.col("_n") == n))
        step = max(1, count // SAMPLE)
        drawn = part.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(step)) == 0).select("_vec").limit(SAMPLE).toArrow()
        drawn = drawn if drawn.num_rows else part.select("_vec").limit(SAMPLE).toArrow()
        cells[m, n] = centroids(_unit(_matrix(drawn["_vec"].combine_chunks(), n)), min(MOST_CELLS, -(-count // cell)))
    shipped = spark.sparkContext.broadcast(cells)
    chunk_schema = pa.schema([("_model", pa.string()), ("_n", pa.int32()), ("_cell", pa.int32()), ("_rows", pa.int32()), ("_reach", pa.list_(pa.int32())), ("_near", pa.binary()), ("_ids", pa.binary()), ("_asking", pa.binary()), ("_vecs", pa.binary())])

    def packed(held: dict) -> pa.RecordBatch:
        out: list[list] = [[] for _ in chunk_schema]
        for (m, n, c), blocks in held.items():
            ids, asks, near, x = (np.concatenate(z) for z in zip(*blocks))
            told = (m, n, c, len(ids), np.unique(near[asks]).tolist(), near.astype(np.int16).tobytes(), ids.tobytes(), asks.astype(np.uint8).tobytes(), pa.compress(x.tobytes(), codec="zstd", asbytes=True))
            for column, value in zip(out, told):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, chunk_schema)], schema=chunk_schema)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        held: dict[tuple, list] = {}
        size = 0
        for batch in batches:
            models, lengths = np.array(batch["_model"].to_pylist(), dtype=object), batch["_n"].to_numpy()
            for m, n in sorted(set(zip(models.tolist(), lengths.tolist()))):
                mine = np.nonzero((models == m) & (lengths == n))[0]
                picked = batch.take(pa.array(mine))
                x = _matrix(picked["_vec"], n)
                ids, asks = picked["_id"].to_numpy(), picked["_asks"].to_numpy(zero_copy_only=False)
                like = _unit(x) @ known[m, n].T
                best = np.argpartition(-like, min(probes, like.shape[1]) - 1, axis=1)[:, :probes]
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(like, best, 1), axis=1, kind="stable"), 1)
                order = np.argsort(best[:, 0], kind="stable")
                names, starts = np.unique(best[order, 0], return_index=True)
                for c, at in zip(names.tolist(), np.split(order, starts[1:])):
                    held.setdefault((m, n, c), []).append((ids[at], asks[at], best[at], x[at]))
                size += x.nbytes
            if size > PART_BYTES:
                yield packed(held)
                held, size = {}, 0
        if held:
            yield packed(held)

    told = "_model string, _n int, _cell int, _rows int, _reach array<int>, _near binary, _ids binary, _asking binary, _vecs binary"
    chunks = checkpoint(widen(base.select("_id", "_model", "_n", "_asks", "_vec")).mapInArrow(assign, told))
    # a row per cell, and a cell's distinct reached cells: bounded by MOST_CELLS for each kind
    reached = chunks.select("_model", "_n", "_cell", F.explode("_reach").alias("_to")).distinct().groupBy("_model", "_n", "_cell").agg(F.collect_list("_to").alias("_reach"))
    counted = chunks.groupBy("_model", "_n", "_cell").agg(F.sum("_rows").alias("_rows"))
    held = [tuple(r) for r in counted.join(reached, ["_model", "_n", "_cell"], "left").select("_model", "_n", "_cell", "_rows", F.coalesce("_reach", F.array().cast("array<int>"))).collect()]
    parts, reach = _plan(cells, held, spark.sparkContext.defaultParallelism)
    homes, tasks = [], []
    for number, (kind, pools) in enumerate(sorted(parts.items())):
        of = {c: p for p, pool in enumerate(pools) for c in pool}
        # the parts that a cell's rows reach, and the parts whose rows reach the cell
        to = {c: {of[x] for x in reach[kind][c] if x in of} for c in of}
        back: dict[int, set[int]] = {}
        for c, xs in reach[kind].items():
            for x in xs:
                back.setdefault(x, set()).add(of[c])
        for c, p in of.items():
            mates = to[c] | back.get(c, set())
            homes.append((*kind, c, number, p, sorted(mates)))
        # a cell of more than a part's bytes is split into slices, which meet like parts do
        for p, pool in enumerate(pools):
            size = sum(4 * kind[1] * r for m, n, c, r, _ in held if (m, n) == kind and of.get(c) == p)
            tasks.append((number, p, max(1, -(-size // (2 * PART_BYTES)))))
    slices = F.broadcast(spark.createDataFrame(tasks, "_kind int, _part int, _slices int"))
    home = F.broadcast(spark.createDataFrame(homes, "_model string, _n int, _cell int, _kind int, _part int, _mates array<int>"))
    other = slices.select("_kind", F.col("_part").alias("_mate"), F.col("_slices").alias("_others"))
    placed = chunks.drop("_rows", "_reach").join(home, ["_model", "_n", "_cell"]).drop("_model").join(slices, ["_kind", "_part"])
    placed = placed.withColumn("_slice", F.pmod(F.xxhash64("_ids"), F.col("_slices")).cast("int")).withColumn("_mate", F.explode("_mates")).drop("_mates", "_slices").join(other, ["_kind", "_mate"])
    placed = placed.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_others") - 1)))
    # either order of two slices is one task; a part with itself meets each of its slices
    mine, yours = F.struct(F.col("_part").alias("p"), F.col("_slice").alias("s")), F.struct(F.col("_mate").alias("p"), F.col("_to").alias("s"))
    sent = placed.select("_kind", "_n", "_cell", "_near", "_ids", "_asking", "_vecs", F.least(mine, yours).alias("_a"), F.greatest(mine, yours).alias("_b"), (mine <= yours).alias("_left"))
    list_type = pa.list_(pa.struct([("m", pa.int32()), ("d", pa.int64())]))

    def join(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        n = frame["_n"][0].as_py()
        a, b = (tuple(frame[c][0].as_py().values()) for c in ("_a", "_b"))
        sides = []
        for left in (True, False):
            picked = frame.filter(frame["_left"]) if left else frame.filter(pc.invert(frame["_left"]))
            if not picked.num_rows:
                continue
            ids = [np.frombuffer(x.as_py(), np.int64) for x in picked["_ids"]]
            near = np.concatenate([np.frombuffer(x.as_py(), np.int16).reshape(len(i), -1) for x, i in zip(picked["_near"], ids)])
            asks = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in picked["_asking"]]).astype(bool)
            x = np.concatenate([np.frombuffer(pa.decompress(v.as_py(), decompressed_size=4 * n * len(i), codec="zstd", asbytes=True), np.float32).reshape(-1, n) for v, i in zip(picked["_vecs"], ids)])
            cell_of = np.repeat(picked["_cell"].to_numpy(), [len(i) for i in ids])
            sides.append((np.concatenate(ids), near, asks, x, cell_of))
        found = []
        for u, v in ((0, 0),) if a == b else ((0, 1), (1, 0)) if len(sides) == 2 else ():
            ids, near, asks, x, _ = sides[u]
            r, d, c = probe_join(x[asks], near[asks].astype(np.int32), sides[v][3], sides[v][0], sides[v][4], k + 1, least)
            found.append((ids[asks][r], d, c))
        out_ids, out_lists = [], []
        for r, d, c in found:
            starts = np.nonzero(np.r_[True, r[1:] != r[:-1]])[0] if len(r) else np.zeros(0, np.int64)
            items = pa.StructArray.from_arrays([pa.array(-np.rint(c * 1e6).astype(np.int32)), pa.array(d)], fields=list(list_type.value_type))
            out_lists.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)).astype(np.int32)), items))
            out_ids.append(pa.array(r[starts]))
        return pa.table({"_id": pa.chunked_array(out_ids, pa.int64()), "_l": pa.chunked_array([x.cast(list_type) for x in out_lists], list_type)})

    found = sent.groupBy("_kind", "_a", "_b").applyInArrow(join, "_id bigint, _l array<struct<m: int, d: bigint>>")
    # a row is in no more tasks than it has probes; repeated keys are told apart by nothing else
    merged = found.groupBy("_id").agg(F.flatten(F.collect_list("_l")).alias("_l")).select("_id", F.slice(F.array_sort("_l"), 1, k + 1).alias("_l"))
    if not groups:
        return merged.select("_id", F.slice(F.filter("_l", lambda x: x["d"] != F.col("_id")), 1, k).alias("_l"))
    # what the first of many copies found holds for all of them
    merged = checkpoint(merged)
    firsts = merged.join(hot.select(F.col("_first").alias("_id"), "_c1", "_c2"), "_id")
    others = ready.select("_c1", "_c2", "_id")
    if few:
        spread = others.join(F.broadcast(firsts.drop("_id")), ["_c1", "_c2"])
    else:
        salted = firsts.drop("_id").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = others.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")).join(salted, ["_c1", "_c2", "_s"])
    alone = merged.join(hot.select(F.col("_first").alias("_id")), "_id", "left_anti")
    every = alone.select("_id", "_l").unionByName(spread.select("_id", "_l"))
    return every.select("_id", F.slice(F.filter("_l", lambda x: x["d"] != F.col("_id")), 1, k).alias("_l"))


def pairs_found(lists: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (chunk_a < chunk_b) of which one is in the other's list."""
    return lists.select(F.least(key, "neighbour").alias("chunk_a"), F.greatest(key, "neighbour").alias("chunk_b")).distinct()
