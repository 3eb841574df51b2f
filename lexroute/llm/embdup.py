"""Embedding near-dedup by collision counting over one-dimensional projections.

Vectors are scaled to length one, so cosine >= t means a distance of at most
r = sqrt(2 - 2t), and on a random direction two such vectors differ by about a
normal deviate times r / sqrt(dim). Every vector is projected on PROJECTIONS
random directions. On each, a pair collides if the second lies in the window of
WIDTH deviates centred on the first. A pair is verified (cosine in double
precision) if it collides on at least NEEDED projections; NEEDED is the
largest count that a pair at the threshold reaches, by the binomial law of its
collisions, with a probability that leaves RECALL after what the block reach misses.

Work is dealt by the first projection: vectors are sorted along it and cut into
blocks of BLOCK vectors by rank, however many partitions there are; only blocks within a window of each other meet, two at a
time. A block pair returns the number of links of each
vector and a spanning forest of them, never its pairs. Equal vectors are grouped
beforehand, and one stands for all.

Null vectors, zero ones, and those with null or non-finite components link with
nothing: n_links 0, a component of their own. Vectors of different lengths are never
linked. A null id is linked with nothing and has a null component. Repeated rows of an id count as one
vector if equal. Labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexroute.llm.neardup import forest
from lexroute.llm.sparkops import components, durable

COSINE, PROJECTIONS, WIDTH, RECALL, BLOCK, TILE = 0.95, 16, 1.96, 0.9999, 2048, 64
#: Deviates between the nearest ends of two blocks beyond which they do not meet (missed: at most 7 pairs in a million at the threshold).
BLOCK_REACH = 4.5


def inside(width: float) -> float:
    """Probability that a normal deviate is at most width in size."""
    return math.erf(width / math.sqrt(2))


def needed(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability recall or more."""
    p, tail = inside(width), 0.0
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= recall:
            return k
    return 0


def directions(dim: int) -> np.ndarray:
    """The same random unit vectors on every machine."""
    d = np.random.default_rng(11 + dim).normal(size=(dim, PROJECTIONS))
    return d / np.linalg.norm(d, axis=0)


def unit(x) -> np.ndarray | None:
    """The vector at length one, or None if it can't link."""
    if x is None or not len(x):
        return None
    v = np.array(x, dtype=float)
    if not np.isfinite(v).all() or not v.any():
        return None
    v /= np.abs(v).max()
    return v / np.linalg.norm(v)


def block_links(pdf: pd.DataFrame, cosine: float, need: int) -> pd.DataFrame:
    """Links between two blocks (or within one), as counts for each vector and a forest."""
    i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
    x, y = (pdf[pdf["block"] == k].sort_values("rep") for k in (i, j))
    if x.empty or y.empty:  # a number between two blocks that no vector of this length fell into
        return pd.DataFrame({"a": [], "b": [], "n": []}, dtype=np.int64)
    vx, vy = (np.stack(z["v"].to_numpy()) for z in (x, y))
    dirs = directions(vx.shape[1])
    reach = WIDTH * math.sqrt(2 - 2 * cosine) / math.sqrt(vx.shape[1])
    px, py = ((v @ dirs).T.astype(np.float32) for v in (vx, vy))
    a, b = [], []
    for k in range(0, len(x), TILE):
        count = np.zeros((len(vx[k : k + TILE]), len(vy)), np.int8)
        for m in range(PROJECTIONS):
            apart = py[m][None, :] - px[m][k : k + TILE, None]
            count += np.abs(apart, out=apart) <= reach
        near, other = np.nonzero(count >= need)
        near += k
        if i == j:
            near, other = near[other > near], other[other > near]
        ok = np.einsum("ij,ij->i", vx[near], vy[other]) >= cosine
        a.append(near[ok])
        b.append(other[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    rx, ry, cx, cy = x["rep"].to_numpy(), y["rep"].to_numpy(), x["copies"].to_numpy(), y["copies"].to_numpy()
    nx, ny = np.bincount(a, cy[b], len(x)), np.bincount(b, cx[a], len(y))
    tree = forest(list(range(len(x) + len(y))), np.column_stack([a, b if i == j else b + len(x)]))
    out = [pd.DataFrame({"a": r[n > 0], "b": r[n > 0], "n": n[n > 0].astype(np.int64)}) for r, n in ((rx, nx), (ry, ny))]
    out.append(pd.DataFrame({"a": rx[a[tree]], "b": ry[b[tree]], "n": np.zeros(len(tree), np.int64)}))
    return pd.concat(out, ignore_index=True)


def last_met(spans: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """(dim, i, last): block i meets all from itself to last. Blocks are numbered along the projection, so their lower ends rise."""
    out = [pd.DataFrame({"dim": [], "i": [], "last": []}, dtype=np.int32)]
    for dim, s in spans.groupby("dim"):
        s = s.sort_values("block")
        reach = BLOCK_REACH * math.sqrt((2 - 2 * cosine) / max(1, dim))
        met = np.searchsorted(s["lo"].to_numpy(), s["hi"].to_numpy() + reach, side="right") - 1
        out.append(pd.DataFrame({"dim": dim, "i": s["block"].to_numpy(), "last": s["block"].to_numpy()[met]}))
    return pd.concat(out, ignore_index=True).astype(np.int32)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    need = needed(recall=RECALL + 1 - inside(BLOCK_REACH))

    def scaled(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].astype("Int64"), "v": [unit(x) for x in pdf["v"]]})

    raw = durable(vectors.select(F.col(id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).mapInPandas(scaled, "id long, v array<double>"))
    good = raw.filter("v is not null and id is not null")
    classes = durable(good.groupBy("v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")))

    def project(batches):
        for pdf in batches:
            pdf["p"] = [float(np.float32(np.dot(v, _first(len(v))))) for v in pdf["v"]]
            pdf["dim"] = pdf["v"].map(len)
            yield pdf

    placed = durable(classes.mapInPandas(project, "v array<double>, rep long, copies long, p double, dim int"))
    total = placed.count()
    parts = max(1, math.ceil(total / BLOCK))
    # a row's number is its partition and its place there; with the partitions' sizes that is its rank, and ranks are cut into blocks
    placed_at = F.monotonically_increasing_id()
    ranked = durable(placed.repartitionByRange(parts, "dim", "p", "rep").sortWithinPartitions("dim", "p", "rep").withColumn("place", placed_at))
    part, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = ranked.groupBy(part.cast("int").alias("part")).count().toPandas().sort_values("part")  # one row a partition
    sizes["before"] = sizes["count"].cumsum() - sizes["count"]
    starts = vectors.sparkSession.createDataFrame(sizes[["part", "before"]].astype({"part": "int32", "before": "int64"}), "part int, before long")
    ranked = ranked.withColumn("part", part.cast("int")).join(F.broadcast(starts), "part").withColumn("block", F.floor((F.col("before") + place) / BLOCK).cast("int")).drop("part", "before", "place")
    spans = ranked.groupBy("dim", "block").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    upto = vectors.sparkSession.createDataFrame(last_met(spans.toPandas(), cosine), "dim int, i int, last int")  # one row for BLOCK vectors
    pairs = upto.select("dim", "i", F.explode(F.sequence("i", "last")).alias("j"))
    meet = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    found = ranked.join(meet, ["dim", "block"]).groupBy("dim", "i", "j").applyInPandas(lambda pdf: block_links(pdf, cosine, need), "a long, b long, n long")
    found = durable(found)
    linked = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    tree = components(found.filter("n = 0 and a <> b").select("a", "b")).select(F.col("id").alias("rep"), "component")
    of = placed.select("rep", "copies").join(linked, "rep", "left").join(tree, "rep", "left")
    reps = durable(of.select("rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    member = good.join(classes.select("v", "rep"), "v").select("id", "rep").join(reps, "rep").select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"))
    rest = raw.filter("v is null or id is null").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return member.union(rest)


_firsts: dict[int, np.ndarray] = {}


def _first(dim: int) -> np.ndarray:
    if dim not in _firsts:
        _firsts[dim] = directions(dim)[:, 0]
    return _firsts[dim]
