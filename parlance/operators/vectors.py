"""Vectors: normalising, window cosines, weighted composite top-k.

The composite score is linear in the windows' cosines. Searches take a stated query set. Queries go to the workers in
blocks of a bounded number, each worker keeps its best k per trial, query and partition, and one ranking by query over
those few rows gives the result: no cross join, no pair is materialised.

Every pair is looked at once for all trials, in single precision and in tiles of bounded size. With few trials its scores
are held against the k-th best so far. With many its cosines alone are: a score w.s is no more than |w| times the length
of s without its negative parts, so a pair too short for every trial of its query needs no score. What is left is scored
in doubles, in the SQL's order of addition, so that a score does not depend on its tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8
#: Most queries of one block, and most results that a block keeps.
BLOCK = 4096
KEPT = 2**20
#: Candidates that meet a block at once, the first ones (all their scores are made, for a first k-th best), and queries of a tile.
CHUNK = 1024
FIRST = 128
TILE = 128
#: Up to so many trials all scores are made.
DIRECT = 4
#: Pairs that are scored at once, and results gathered before they are merged.
PAIRS = 16384
GATHERED = 2**18


def norm(v: str) -> str:
    return f"sqrt(aggregate({v}, 0D, (a, x) -> a + cast(x as double) * cast(x as double)))"


def l2_normalise(v: str, epsilon: float = EPSILON) -> Column:
    """v / (|v| + epsilon) in doubles; the zero vector stays zero."""
    return F.expr(f"transform({v}, x -> cast(x as double) / ({norm(v)} + {epsilon!r}D))")


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, z) -> s + z)")


def split_windows(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """One column ``n_<name>`` per window: the normalised slice of ``vector``; equal slices in the order of names."""
    out = df
    for j, name in enumerate(names):
        part = f"slice({vector}, {j} * int(size({vector}) / {len(names)}) + 1, int(size({vector}) / {len(names)}))"
        out = out.withColumn(f"__{name}", F.expr(part)).withColumn(f"n_{name}", l2_normalise(f"__{name}")).drop(f"__{name}")
    return out


def normalise_weights(weights: dict[str, float], present: list[str]) -> dict[str, float]:
    """Weights of the windows that are present, summing to 1; an error if none is left or they sum to zero."""
    kept = {w: float(x) for w, x in weights.items() if w in present}
    if not kept:
        raise ValueError("no weighted window is present")
    total = sum(kept.values())
    if total == 0:
        raise ValueError("the weights sum to zero")
    return {w: x / total for w, x in kept.items()}


def uniform(names: list[str]) -> dict[str, float]:
    return {n: 1 / len(names) for n in names}


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit_windows(m: np.ndarray, windows: int) -> np.ndarray:
    """(row, window, dimension): squares are added in order, as the SQL adds them."""
    parts = m.reshape(len(m), windows, -1)
    squares = np.zeros(parts.shape[:2])
    for d in range(parts.shape[2]):
        squares += parts[:, :, d] * parts[:, :, d]
    return parts / (np.sqrt(squares) + EPSILON)[:, :, None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero, as DuckDB rounds; no negative zero."""
    scaled = x * 1e6
    whole = np.trunc(scaled)
    return (whole + np.where(np.abs(scaled - whole) >= 0.5, np.sign(scaled), 0.0)) / 1e6 + 0.0


def topk(queries: DataFrame, candidates: DataFrame, weights: dict[str, float], names: list[str], k: int = 5, id_column: str = "vec_id", group: str = "label", vector: str = "embedding", same_group: str = "drop") -> DataFrame:
    """(query_id, rank, cand_id, score): the best k candidates of each query, score rounded to 6 places, ties by id.

    Candidates of the query's own group are left out (``drop``), or stay with a score of minus infinity (``mask``), or
    count like any other (``keep``). A null group is no group: nothing is left out for it. Null ids and vectors have no
    result. With under k candidates all are returned.
    """
    kept = normalise_weights(weights, names)
    scales = {0: np.array([kept.get(n, 0.0) for n in names])}
    return _best(queries, candidates, scales, k, id_column, group, vector, same_group).drop("trial")


def topk_trials(queries: DataFrame, candidates: DataFrame, trials: dict[int, dict[str, float]], names: list[str], k: int = 5, id_column: str = "vec_id", group: str = "label", vector: str = "embedding", same_group: str = "drop") -> DataFrame:
    """(trial, query_id, rank, cand_id, score): ``topk`` under each trial's weights, normalised, in one pass per block.

    ``trials`` is a bounded table; a query under a trial's weights is one row of a block.
    """
    scales = {}
    for t, w in sorted(trials.items()):
        kept = normalise_weights({n: w[n] for n in names if n in w}, names)
        scales[t] = np.array([kept.get(n, 0.0) for n in names])
    return _best(queries, candidates, scales, k, id_column, group, vector, same_group)


def _best(queries: DataFrame, candidates: DataFrame, scales: dict[int, np.ndarray], k: int, id_column: str, group: str, vector: str, same_group: str) -> DataFrame:
    rows = [df.where(F.col(vector).isNotNull() & F.col(id_column).isNotNull()).select(id_column, F.col(group).cast("string").alias("g"), vector) for df in (queries, candidates)]
    size = max(1, min(BLOCK, KEPT // max(1, len(scales) * k)))
    blocks, block = [], []
    for row in rows[0].toLocalIterator():
        block.append((row[0], row[1], np.array(row[2], np.float64)))
        if len(block) == size:
            blocks.append(_shared(rows[1], block, scales))
            block = []
    if block or not blocks:
        blocks.append(_shared(rows[1], block, scales))
    found = rows[1]
    if len(scales) > DIRECT:  # the work is in the trials, so it is dealt out evenly whatever files the candidates lie in
        found = found.repartition(max(1, -(-2 * found.sparkSession.sparkContext.defaultParallelism // len(blocks))))
    best = None
    for b in blocks:
        part = _against(b, found, k, same_group)
        best = part if best is None else best.union(part)
    rank = F.row_number().over(Window.partitionBy("trial", "query_id").orderBy(F.col("score").desc(), "cand_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("trial", "query_id", "rank", "cand_id", "score")


def _shared(found: DataFrame, block: list[tuple], scales: dict[int, np.ndarray]):
    """A block for all workers: ids, codes of groups, unit vectors, trials and their weights."""
    codes: dict[str, int] = {}
    groups = np.array([codes.setdefault(r[1], len(codes)) if r[1] is not None else -1 for r in block], np.int64)
    weights = np.array(list(scales.values()), np.float64).reshape(len(scales), -1)
    units = unit_windows(np.array([r[2] for r in block]), weights.shape[1]) if block else np.zeros((0, weights.shape[1], 1))
    return found.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block], np.int64), codes, groups, units, np.array(list(scales), np.int64), weights))


class _Kept:
    """The best k of each row (a query under a trial) so far, by score and then id, and the k-th score once there are k."""

    def __init__(self, rows: int, k: int):
        self.k, self.n = k, np.zeros(rows, np.int64)
        self.score, self.cand = np.full((rows, k), -np.inf), np.zeros((rows, k), np.int64)
        self.least = np.full(rows, -np.inf)
        self.new, self.size = [], 0

    def add(self, row: np.ndarray, score: np.ndarray, cand: np.ndarray) -> None:
        good = score >= self.least[row]
        if good.any():
            self.new.append((row[good], score[good], cand[good]))
            self.size += int(good.sum())
            if self.size >= GATHERED:
                self.merge()

    def merge(self) -> bool:
        if not self.size:
            return False
        row, score, cand = (np.concatenate([x[i] for x in self.new]) for i in range(3))
        self.new, self.size = [], 0
        touched = np.zeros(len(self.n), bool)
        touched[row] = True
        rows = np.flatnonzero(touched)
        at = (np.cumsum(touched) - 1)[row]
        old, place = np.nonzero(np.arange(self.k) < self.n[rows][:, None])
        at, score, cand = np.concatenate([old, at]), np.concatenate([self.score[rows[old], place], score]), np.concatenate([self.cand[rows[old], place], cand])
        order = _order(at, score, cand)
        at, score, cand = at[order], score[order], cand[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        top = nth < self.k
        self.score[rows[at[top]], nth[top]], self.cand[rows[at[top]], nth[top]] = score[top], cand[top]
        self.n[rows] = np.minimum(np.bincount(at, minlength=len(rows)), self.k)
        self.least[rows] = np.where(self.n[rows] == self.k, self.score[rows, self.k - 1], -np.inf)
        return True


def _order(row: np.ndarray, score: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """Places by row, falling score and id. Scores have six places, so row and score are one whole number."""
    if np.abs(score).max() > 4:
        return np.lexsort((cand, -score, row))
    key = row * 2**24 - np.rint(score * 1e6).astype(np.int64)
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    ties = np.flatnonzero(same)
    order[ties] = order[ties][np.lexsort((cand[order[ties]], key[ties]))]
    return order


def _against(shared, found: DataFrame, k: int, same_group: str) -> DataFrame:
    chunk, first, tile, direct, pairs = CHUNK, FIRST, TILE, DIRECT, PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, codes, qgroup, q, trials, weights = shared.value
        n, windows, dims = q.shape
        if n == 0:
            return
        t = len(trials)
        kept, own = _Kept(n * t, k), {}
        size = np.abs(weights).sum(axis=1)
        w32 = weights.astype(np.float32)
        few = t <= direct
        # what single precision, and rounding to six places, can take from a score
        slack = 1e-6 + 1.2e-7 * ((windows * dims + 4) if few else (dims + windows + 4) * np.sqrt(windows)) * size
        q32 = [np.ascontiguousarray((q * w[None, :, None]).reshape(n, -1), np.float32) for w in weights] if few else np.ascontiguousarray(q.transpose(1, 0, 2), np.float32)
        low = np.full((n, t), -np.inf, np.float32)
        length, signed = np.linalg.norm(weights, axis=1), bool((weights < 0).any())
        seen = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(chunk, max(first, seen)))
                at, seen = at + part.num_rows, seen + part.num_rows
                cid = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cgroup = np.array([codes.get(g, -2) for g in part.column(1).to_pylist()], np.int64)
                if same_group == "mask":
                    for g in np.unique(cgroup[cgroup >= 0]):
                        own[g] = np.sort(np.concatenate([own.get(g, np.zeros(0, np.int64)), cid[cgroup == g]]))[:k]
                c = unit_windows(_matrix(part.column(2), windows * dims), windows)
                c32 = np.ascontiguousarray(c.reshape(len(c), -1).T, np.float32) if few else np.ascontiguousarray(c.transpose(1, 2, 0), np.float32)
                if not few:
                    bound = (np.maximum(low, 0) / length[None, :]).min(axis=1).astype(np.float32) ** 2 * np.float32(1 - 1e-5)
                for a in range(0, n, tile):
                    rows = slice(a, a + tile)
                    sims = None if few else np.matmul(q32[:, rows], c32)
                    apart = None if same_group == "keep" else qgroup[rows, None] != cgroup[None, :]
                    if few or seen == len(c):
                        # all scores; the k-th best of a chunk is a bound for the whole
                        scores = [x[rows] @ c32 for x in q32] if few else [np.tensordot(w, sims, 1) for w in w32]
                        for j, s in enumerate(scores):
                            if apart is not None:
                                s[~apart] = -np.inf
                            if len(c) > k and not np.isfinite(low[rows, j]).all():
                                low[rows, j] = np.fmax(low[rows, j], np.partition(np.nan_to_num(s, nan=-np.inf, posinf=np.inf, neginf=-np.inf), len(c) - k, axis=1)[:, len(c) - k] - 2 * slack[j])
                            good = s >= low[rows, j, None]
                            r, x = _places(good if apart is None else good & apart)
                            for i in range(0, len(r), pairs):
                                rr, xx = r[i : i + pairs] + a, x[i : i + pairs]
                                kept.add(rr * t + j, _score(_cosines(q, c, rr, xx), weights[j]), cid[xx])
                    else:
                        positive = sims if signed else np.maximum(sims, 0)
                        good = np.einsum("jqc,jqc->qc", positive, positive) >= bound[rows, None]
                        r, x = _places(good if apart is None else good & apart)
                        for i in range(0, len(r), pairs):
                            rr, xx = r[i : i + pairs], x[i : i + pairs]
                            p, j = _places(sims[:, rr, xx].T @ w32.T >= low[rr + a])
                            if len(p):
                                some, p = np.unique(p, return_inverse=True)
                                found_sims = _cosines(q, c, rr[some] + a, xx[some])
                                kept.add((rr[some] + a)[p] * t + j, _score(found_sims[p], weights[j]), cid[xx[some]][p])
                if kept.merge():
                    low = np.maximum(low, (kept.least.reshape(n, t) - slack).astype(np.float32))
        row, place = np.nonzero(np.arange(k) < kept.n[:, None])
        score, cand = kept.score[row, place], kept.cand[row, place]
        if own:  # those of the own group come after all others, by id
            less = [(r, own[qgroup[r // t]][: k - kept.n[r]]) for r in np.nonzero(kept.n < k)[0] if qgroup[r // t] in own]
            for r, ids in less:
                row, score, cand = np.concatenate([row, np.full(len(ids), r)]), np.concatenate([score, np.full(len(ids), -np.inf)]), np.concatenate([cand, ids])
        for i in range(0, len(row), 65536):
            r = row[i : i + 65536]
            yield pa.record_batch([pa.array(trials[r % t]), pa.array(qid[r // t]), pa.array(cand[i : i + 65536]), pa.array(score[i : i + 65536])], ["trial", "query_id", "cand_id", "score"])

    return found.mapInArrow(run, "trial long, query_id long, cand_id long, score double")


def _places(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(good), good.shape[1])


def _cosines(q: np.ndarray, c: np.ndarray, r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(pair, window) of the pairs of rows r of q and x of c; products are added in order."""
    out = np.zeros((len(r), q.shape[1]))
    for d in range(q.shape[2]):
        out += q[r, :, d] * c[x, :, d]
    return out


def _score(cosines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rounded scores of (pair, window) cosines under one weight a window, or one row of weights a pair."""
    out = np.zeros(len(cosines))
    for j in range(cosines.shape[1]):
        out = out + weights[..., j] * cosines[:, j]
    return _rounded(out)


def topk_expressions(queries: DataFrame, candidates: DataFrame, weights: dict[str, float], names: list[str], k: int = 5) -> DataFrame:
    """The same result from SQL expressions alone; the reference that tests hold ``topk`` against on small inputs."""
    kept = normalise_weights(weights, names)
    q = split_windows(queries, "embedding", names).select(F.col("vec_id").alias("query_id"), F.col("label").alias("q_label"), *[F.col(f"n_{n}").alias(f"q_{n}") for n in names])
    c = split_windows(candidates, "embedding", names).select(F.col("vec_id").alias("cand_id"), "label", *[f"n_{n}" for n in names])
    score = sum((F.lit(w) * dot(f"q_{n}", f"n_{n}") for n, w in kept.items()), F.lit(0.0))
    pairs = F.broadcast(q).join(c, F.col("q_label") != F.col("label")).select("query_id", "cand_id", F.round(score, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "cand_id", "score")


def breakdown(top: DataFrame, queries: DataFrame, candidates: DataFrame, names: list[str]) -> DataFrame:
    """``top`` with one column sim_<window> each: the cosine of the pair in that window. Ids are unique in each table."""
    q = split_windows(queries, "embedding", names).select(F.col("vec_id").alias("query_id"), *[F.col(f"n_{n}").alias(f"q_{n}") for n in names])
    c = split_windows(candidates, "embedding", names).select(F.col("vec_id").alias("cand_id"), *[F.col(f"n_{n}").alias(f"c_{n}") for n in names])
    both = top.join(q, "query_id").join(c, "cand_id")
    return both.select(*top.columns, *[F.round(dot(f"q_{n}", f"c_{n}"), 6).alias(f"sim_{n}") for n in names])
