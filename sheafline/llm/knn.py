"""The most similar vectors of every vector, by a permutation index.

A vector is represented by the order of its nearest pivots. It is posted in the
inverted files of its first pivots; within a file, vectors are ranked by the
footrule distance of their pivot orders if a caller asks for it, else all are
compared by their cosine. Pivots are drawn from the data, so crowded places get
many pivots and files stay of like size; long files are cut into blocks. Files
prove nothing for a vector that has more partners than they show, nor without a
high floor: such queries are compared exactly, block by block, with all vectors
that the triangle inequality leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.filters import maybe_among
from sheafline.session import stored

#: Vectors per pivot, bounds of the number of pivots (the only sample taken), length of the orders, files per vector.
PER_PIVOT = 100
PIVOTS = (16, 4096)
PREFIX = 8
FILES = 4
#: Vectors of a file met in one block.
BLOCK = 3000
#: Least floor for which files are used, and partners found in them from which a query is compared exactly.
INDEXED = 0.9
CROWDED = 6
#: Queries and targets compared in one step, most centres by which they meet, and rows dealt at a time.
STEP = (2048, 8192)
CENTRES = 1024
_DEALT = 20_000
#: One vector in so many, by a hash, is counted to plan how long files are cut; it decides no result.
PLANNED = 16


def usable(embedding: Column, dim: Column | None = None, size: int = 64) -> Column:
    """Whether a vector has exactly ``size`` finite numbers, not all zero (and says so in ``dim``)."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = (F.size(embedding) == size) & finite & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(ok & (dim == size if dim is not None else F.lit(True)), F.lit(False))


def _unit(col: pd.Series) -> np.ndarray:
    x = np.stack(col.tolist()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the ``prefix`` nearest pivots of each row, nearest first."""
    prefix = min(prefix, len(pivots))
    out = np.empty((len(x), prefix), np.int16)
    for s in range(0, len(x), 2048):
        sim = x[s : s + 2048].astype(np.float32) @ pivots.T
        near = np.argpartition(-sim, prefix - 1, axis=1)[:, :prefix]
        by = np.argsort(-np.take_along_axis(sim, near, 1), axis=1, kind="stable")
        out[s : s + 2048] = np.take_along_axis(near, by, 1)
    return out


def footrule_closeness(rows: np.ndarray, cols: np.ndarray, length: int) -> np.ndarray:
    """length x (length + 1) less the footrule distance of two orders' prefixes, halved.

    A pivot at places i and j of two orders (from 0; absent ones at ``length``) adds
    |i - j| to the distance; summed up, that is a constant less twice the sum of
    min(length - i, length - j) over the pivots that both have.
    """
    out = np.zeros((len(rows), len(cols)), np.uint16)
    flat, place = rows.ravel(), np.tile(np.arange(length), len(rows))
    owner = np.repeat(np.arange(len(rows)), length)
    order = np.argsort(flat, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0, True]) if len(flat) else np.array([0])
    cflat, cplace = cols.ravel(), np.tile(np.arange(length), len(cols))
    cowner = np.repeat(np.arange(len(cols)), length)
    corder = np.argsort(cflat, kind="stable")
    csorted = cflat[corder]
    for s, e in zip(at, at[1:]):
        pivot = flat[order[s]]
        lo, hi = np.searchsorted(csorted, pivot), np.searchsorted(csorted, pivot, side="right")
        if lo == hi:
            continue
        i, j = order[s:e], corder[lo:hi]
        out[np.ix_(owner[i], cowner[j])] += np.minimum.outer((length - place[i]).astype(np.uint16), (length - cplace[j]).astype(np.uint16))
    return out


def each_group(keys: list[str], meet: Callable[[pd.DataFrame], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``meet`` for every group of sorted batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        now = None
        for pdf in batches:
            for g, part in pdf.groupby(keys, sort=False):
                if now is not None and g != now:
                    yield from meet(pd.concat(held))
                    held = []
                now = g
                held.append(part)
        if held:
            yield from meet(pd.concat(held))

    return run


def centres_of(x: np.ndarray, floor: float) -> np.ndarray:
    """Rows of which no two have a cosine of ``floor`` or more, ``CENTRES`` at most."""
    kept = x[:1]
    for row in x[1:]:
        if len(kept) < CENTRES and (kept @ row).max() < floor:
            kept = np.vstack([kept, row])
    return kept


def compared(queries: DataFrame, targets: DataFrame, k: int, floor: float, step: tuple[int, int] = STEP) -> DataFrame:
    """q, t, similarity: the k most similar others of every query in each block of targets, of ``floor`` or more.

    Exact: both sides have rep and e. Queries go to the cell of their nearest centre,
    targets to every cell within its radius plus the floor's angle, which can miss
    none. A cell's queries and targets are cut into blocks that all meet.
    """
    spark = queries.sparkSession
    kind = queries.schema["rep"].dataType.simpleString()
    drawn = queries.orderBy(F.xxhash64(F.lit(5), "rep"), "rep").limit(4 * CENTRES if floor > 0 else 1).select("e").toPandas()["e"]
    if not len(drawn):
        return spark.createDataFrame([], f"q {kind}, t {kind}, similarity double")
    centres = spark.sparkContext.broadcast(centres_of(_unit(drawn).astype(np.float32), floor))
    m = len(centres.value)

    def extent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low = np.zeros(m, np.int64), np.ones(m)
        for pdf in batches:
            if len(pdf):
                sim = _unit(pdf["e"]).astype(np.float32) @ centres.value.T
                at = sim.argmax(axis=1)
                n += np.bincount(at, minlength=m)
                np.minimum.at(low, at, sim.max(axis=1))
        yield pd.DataFrame({"p": np.arange(m, dtype=np.int32), "n": n, "low": low})

    n, least = np.zeros(m, np.int64), np.full(m, 2.0)
    for r in queries.select("e").mapInPandas(extent, "p int, n long, low double").groupBy("p").agg(F.sum("n").alias("n"), F.min("low").alias("low")).where("n > 0").collect():
        n[r["p"]] = r["n"]
        reach = np.arccos(np.clip(r["low"], -1, 1)) + np.arccos(max(floor, -1.0)) + 1e-3
        least[r["p"]] = np.cos(min(np.pi, reach)) - 1e-4

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.zeros(m, np.int64)
        for pdf in batches:
            if len(pdf):
                t += (_unit(pdf["e"]).astype(np.float32) @ centres.value.T >= least).sum(axis=0)
        yield pd.DataFrame({"p": np.arange(m, dtype=np.int32), "n": t})

    t = np.zeros(m, np.int64)
    for r in targets.select("e").mapInPandas(members, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
        t[r["p"]] = r["n"]
    cut = [np.maximum(1, -(-size // s)) for size, s in zip((n, t), step)]

    def deal(target: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        mine, others = cut[target], cut[not target]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                sim = _unit(pdf["e"]).astype(np.float32) @ centres.value.T
                rows, cell = np.nonzero(sim >= least) if target else (np.arange(len(pdf)), sim.argmax(axis=1))
                rep = pdf["rep"].to_numpy()
                e = [x.tobytes() for x in np.stack(pdf["e"].tolist()).astype("<f4")]
                own = (pd.util.hash_array(rep)[rows] % mine[cell].astype(np.uint64)).astype(np.int32)
                stop = np.cumsum(others[cell])
                for a in range(0, int(stop[-1]) if len(stop) else 0, _DEALT):
                    out = np.arange(a, min(a + _DEALT, int(stop[-1])))
                    i = np.searchsorted(stop, out, side="right")
                    other = (out - (stop[i] - others[cell[i]])).astype(np.int32)
                    sides = (other, own[i]) if target else (own[i], other)
                    yield pd.DataFrame({"cell": cell[i].astype(np.int32), "a": sides[0], "b": sides[1], "target": target, "rep": rep[rows[i]], "e": [e[j] for j in rows[i]]})

        return run

    def meet(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        side, ids = df["target"].to_numpy(), df["rep"].to_numpy()
        x = np.frombuffer(b"".join(df["e"]), "<f4").reshape(len(df), -1).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        x32 = x.astype(np.float32)
        qs, ts = np.flatnonzero(~side), np.flatnonzero(side)
        if not len(ts):
            return
        take = min(k + 6, len(ts))
        for s in range(0, len(qs), 512):
            q = qs[s : s + 512]
            sim = np.where(ids[q][:, None] != ids[ts][None, :], x32[q] @ x32[ts].T, np.float32(-4))
            near = np.argpartition(-sim, take - 1, axis=1)[:, :take]
            a, c = np.nonzero(np.take_along_axis(sim, near, 1) >= max(floor - 1e-4, -3))
            to = ts[near[a, c]]
            exact = np.einsum("ij,ij->i", x[q[a]], x[to])
            by = np.lexsort((to, -exact, a))  # targets stand in order of their keys
            a, to, exact = a[by], to[by], exact[by]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            good = (exact >= floor) & (place < k)
            yield pd.DataFrame({"q": ids[q[a]][good], "t": ids[to][good], "similarity": exact[good]})

    form = f"cell int, a int, b int, target boolean, rep {kind}, e binary"
    both = queries.select("rep", "e").mapInPandas(deal(False), form).unionByName(targets.select("rep", "e").mapInPandas(deal(True), form))
    keys = ["cell", "a", "b"]
    return both.repartition(*keys).sortWithinPartitions(*keys, "target", "rep").mapInPandas(each_group(keys, meet), f"q {kind}, t {kind}, similarity double")


def in_files(v: DataFrame, reps: DataFrame, kind: str, k: int, floor: float, files: int, prefix: int, rerank: int | None, per_pivot: int, block: int) -> DataFrame:
    """q, t, similarity: partners of ``floor`` or more that share a file of a pivot, the k + 6 best of each file."""
    spark = v.sparkSession
    n = v.count()
    want = int(min(PIVOTS[1], max(PIVOTS[0], n // per_pivot)))
    drawn = v.select("e", "id").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(want).select("e").toPandas()["e"]
    if len(drawn) < 2:
        return spark.createDataFrame([], f"q {kind}, t {kind}, similarity double")
    pivots = np.unique(_unit(drawn).astype(np.float32), axis=0)
    length = min(prefix, len(pivots))
    share = spark.sparkContext.broadcast(pivots)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros(len(share.value), np.int64)
        for pdf in batches:
            if len(pdf):
                c += np.bincount(orders(_unit(pdf["e"]), share.value, length)[:, :files].ravel(), minlength=len(c))
        yield pd.DataFrame({"p": np.arange(len(c), dtype=np.int32), "n": c})

    sizes = np.zeros(len(pivots), np.int64)
    planned = v.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(PLANNED)) == 0) if n > 100_000 else v
    for r in planned.select("e").mapInPandas(count, "p int, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
        sizes[r["p"]] = r["n"] * (PLANNED if n > 100_000 else 1)
    pieces = spark.sparkContext.broadcast(np.maximum(1, -(-sizes // block)))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["e"])
            perm = orders(x, share.value, length)
            cut = pieces.value
            rows, file, lo, hi, side = [], [], [], [], []
            mine_of = pd.util.hash_array(pdf["rep"].to_numpy())
            for f in range(min(files, length)):
                p = perm[:, f].astype(np.int64)
                c = cut[p]
                for r in np.flatnonzero(c > 1):
                    m = int(mine_of[r] % np.uint64(c[r]))
                    for q in range(int(c[r])):
                        rows.append(r)
                        file.append(p[r])
                        lo.append(min(m, q))
                        hi.append(max(m, q))
                        side.append(0 if m == q else 1 + int(m > q))
                plain = np.flatnonzero(c == 1)
                rows.extend(plain)
                file.extend(p[plain])
                lo.extend([0] * len(plain))
                hi.extend([0] * len(plain))
                side.extend([0] * len(plain))
            e = np.rint(127 * x / np.abs(x).max(axis=1, keepdims=True)).astype(np.int8)
            rep = pdf["rep"].to_numpy()
            yield pd.DataFrame({"file": np.array(file, np.int32), "lo": np.array(lo, np.int32), "hi": np.array(hi, np.int32), "side": np.array(side, np.int32), "ask": pdf["ask"].to_numpy()[rows], "rep": rep[rows], "perm": [perm[r].tobytes() for r in rows] if rerank else None, "e": [e[r].tobytes() for r in rows]})

    posted = reps.select("rep", "e", "ask").mapInPandas(post, f"file int, lo int, hi int, side int, ask boolean, rep {kind}, perm binary, e binary")

    def meet(df: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(df) < 2:
            return
        ids = df["rep"].to_numpy()
        x32 = np.frombuffer(b"".join(df["e"]), np.int8).reshape(len(df), -1).astype(np.float32)
        rough = np.sqrt(x32.shape[1]) / 127  # what rounding to a byte a number can change of a cosine
        x32 /= np.sqrt((x32 * x32).sum(axis=1, keepdims=True))
        perm = np.frombuffer(b"".join(df["perm"]), np.int16).reshape(len(df), length) if rerank else None
        side, ask = df["side"].to_numpy(), df["ask"].to_numpy()
        if not side.any():
            halves = [(np.flatnonzero(ask), np.arange(len(df)))]
        else:
            halves = [(np.flatnonzero((side == x) & ask), np.flatnonzero(side == 3 - x)) for x in (1, 2)]
        for qs, ts in halves:
            if not len(ts):
                continue
            for s in range(0, len(qs), 1024):
                q = qs[s : s + 1024]
                if rerank and len(ts) > rerank:
                    close = footrule_closeness(perm[q], perm[ts], length)
                    worst = np.partition(close, len(ts) - rerank, axis=1)[:, len(ts) - rerank]
                    kept = close >= worst[:, None]
                else:
                    kept = np.ones((len(q), len(ts)), bool)
                kept &= ids[q][:, None] != ids[ts][None, :]
                sim = np.where(kept, x32[q] @ x32[ts].T, np.float32(-4))
                take = min(k + 6, len(ts))
                near = np.argpartition(-sim, take - 1, axis=1)[:, :take]
                a, c = np.nonzero(np.take_along_axis(sim, near, 1) >= max(floor - rough, -3))
                yield pd.DataFrame({"q": ids[q[a]], "t": ids[ts[near[a, c]]]})

    keys = ["file", "lo", "hi"]
    met = posted.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each_group(keys, meet), f"q {kind}, t {kind}").distinct()
    met = stored(met)
    own = maybe_among(reps.select("rep", "e"), F.col("rep"), met.select(F.explode(F.array("q", "t"))))
    both = met.join(own.withColumnsRenamed({"rep": "q", "e": "a"}), "q").join(own.withColumnsRenamed({"rep": "t", "e": "b"}), "t")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                exact = np.einsum("ij,ij->i", _unit(pdf["a"]), _unit(pdf["b"]))
                yield pdf[["q", "t"]].assign(similarity=exact)[exact >= floor]

    return both.mapInPandas(verify, f"q {kind}, t {kind}, similarity double")


def neighbours(vectors: DataFrame, key: str, embedding: str, k: int = 10, floor: float = -2.0, files: int = FILES, prefix: int = PREFIX, rerank: int | None = None, per_pivot: int = PER_PIVOT, block: int = BLOCK, asked: Column | None = None) -> DataFrame:
    """query, neighbour, similarity, rank: the k most similar other vectors of every vector, of ``floor`` or more.

    ``asked`` tells by the key, named ``id``, which vectors are queries (else all are).
    Files are used for floors of ``INDEXED`` or more; queries that meet ``CROWDED``
    partners in them, and all queries under a lower floor, are compared exactly.
    ``rerank`` limits a file's comparisons to the best by footrule.

    ``vectors`` holds each key once, with vectors of one length that ``usable`` lets
    pass. Ties go to the lesser key. Equal vectors are indexed once; as neighbours
    at most k + 1 of them, the least keys, can count, so no group of copies is
    expanded into all its pairs. Fewer than two vectors give an empty frame.
    """
    kind = vectors.schema[key].dataType.simpleString()
    v = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<float>").alias("e"))
    v = v.withColumn("h", F.xxhash64("e")).withColumn("g", F.hash("e")).withColumn("ask", asked if asked is not None else F.lit(True))
    reps = v.groupBy("h", "g").agg(F.min_by("e", "id").alias("e"), F.min("id").alias("rep"), F.max("ask").alias("ask"))
    reps = stored(reps)
    if floor >= INDEXED:
        met = stored(in_files(v, reps, kind, k, floor, files, prefix, rerank, per_pivot, block))
        crowded = met.groupBy("q").count().where(F.col("count") >= CROWDED)
        crowd = maybe_among(reps, F.col("rep"), crowded.select("q"))
        more = compared(crowd.join(crowded, crowd["rep"] == crowded["q"], "left_semi"), reps, k, floor)
        met = met.unionByName(more)
    else:
        met = compared(reps.where("ask"), reps, k, floor)
    met = met.groupBy("q", "t").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "t")
    top = met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")

    # members of the classes of equal vectors: all as queries, the least k + 1 as neighbours
    classes = v.join(reps.select("h", "g", "rep"), ["h", "g"]).select("id", "rep", "ask")
    many = classes.groupBy("rep").count().where("count > 1").select("rep")
    copies = classes.join(many, "rep", "left_semi")
    least = copies.withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("_r") <= k + 1).select("rep", F.col("id").alias("t2"))
    wide = top.join(least, top["t"] == least["rep"], "left").select("q", F.coalesce("t2", "t").alias("t"), "similarity")
    among = least.select(F.col("rep").alias("q"), F.col("t2").alias("t"), F.lit(1.0).alias("similarity"))
    wide = wide.unionByName(among)
    mine = copies.select(F.col("rep").alias("q"), F.col("id").alias("q2"), F.col("ask").alias("a2"))
    wide = wide.join(mine, "q", "left").where(F.coalesce("a2", F.lit(True))).select(F.coalesce("q2", "q").alias("query"), F.col("t").alias("neighbour"), "similarity").where("query <> neighbour")
    rank = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return wide.withColumn("rank", F.row_number().over(rank)).where((F.col("rank") <= k) & (F.col("similarity") >= floor))


def drafts(vector_drafts: DataFrame, size: int = 64) -> DataFrame:
    """draft_id and embedding of the usable drafts, each draft once."""
    vec = F.col("modal_features.vector")
    ok = vector_drafts.where(F.col("draft_id").isNotNull() & usable(vec["embedding"], vec["dim"], size))
    return ok.select("draft_id", vec["embedding"].alias("embedding")).groupBy("draft_id").agg(F.min("embedding").alias("embedding"))


def found(vector_drafts: DataFrame) -> DataFrame:
    """p2_found: pairs with a cosine of 0.94 or more of which one is among the other's 10 most similar."""
    near = neighbours(drafts(vector_drafts), "draft_id", "embedding", k=10, floor=0.94)
    return near.select(F.least("query", "neighbour").alias("draft_a"), F.greatest("query", "neighbour").alias("draft_b")).distinct()


def most_similar(vector_drafts: DataFrame) -> DataFrame:
    """The 10 most similar of every draft whose id is divisible by 20, against all drafts."""
    near = neighbours(drafts(vector_drafts), "draft_id", "embedding", k=10, asked=F.col("id") % 20 == 0)
    return near.select("query", "neighbour", "rank", F.round("similarity", 6).alias("similarity"))
