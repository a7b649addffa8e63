"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in halves.  Each half has its own codebook, learned by
k-means on a bounded sample, and the product of the two is a grid of cells; all
vectors are indexed.  A vector visits the cells nearest to it in the order of
the multi-sequence traversal, as many as reach the target recall, and is
compared in double precision with the vectors of each.  A pair is linked if
either visits the other's cell.

How many visits that takes is measured on sampled vectors, none of which the
codebooks were learned from, in two ways, and the larger number is taken.
Partners at exactly the threshold, the farthest that count, are drawn in random
directions; so recall does not hang on how many links the table has.  And all
real links of the sample are found by brute force; their recall is the mean
over the sampled vectors that have any, so that a group of very many links
counts no more than one of few.

Cells are put together to supercells of neighbouring ones, so that a vector
travels once to each supercell that it visits; what it visits there is worked
out again on arrival.  Places in the grid are computed from numbers rounded so
that sums are exact, hence alike wherever they are computed.  Supercells are
cut into blocks of bounded size, for the vectors in them and for the visitors,
and every pair of blocks is a group of its own; it returns counts and the edges
of a spanning forest, never the pairs.  Where only one side visits the other's
cell, the group credits both, so the numbers of links agree.  Equal vectors are
one vertex with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowest, materialise
from .components import components
from .vectors import by_dim, matrix, usable

#: Vectors of a supercell as the grid is cut, and of a block of it and of its visitors at most.
ROWS, HELD, SEEN = 4096, 16_384, 65_536
#: Entries of each half's codebook at most; the product bounds the cells.
ENTRIES = 1024
#: Visits at most, whatever the recall.
VISITS = 256
_STEP = 512

def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Centres of x: at most ``k``, fewer if x has fewer distinct rows."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def exact(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-22: products and sums of those of unit vectors are exact in double precision, in any order."""
    return np.round(x * 2.0**22) / 2.0**22


class Index:
    """Codebooks of both halves, the number of cells that a vector visits, and the supercells."""

    def __init__(self, left: np.ndarray, right: np.ndarray, visits: int = 1, groups: int = 1):
        self.left, self.right, self.half, self.visits = exact(left), exact(right), left.shape[1], visits
        self.group_left, self.group_right = (self._grouped(c, groups) for c in (self.left, self.right))

    @staticmethod
    def _grouped(centres: np.ndarray, groups: int) -> np.ndarray:
        middle = kmeans(centres, groups)
        return ((centres**2).sum(1)[:, None] - 2 * centres @ middle.T + (middle**2).sum(1)[None, :]).argmin(1)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to all entries, less what is the same for all."""
        x = exact(x)
        a, b = ((centres**2).sum(1)[None, :] - 2 * part @ centres.T for centres, part in ((self.left, x[:, : self.half]), (self.right, x[:, self.half :])))
        return a, b

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def supercells(self, cells: np.ndarray) -> np.ndarray:
        return self.group_left[cells // len(self.right)] * (int(self.group_right.max()) + 1) + self.group_right[cells % len(self.right)]

    def traverse(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """The first cells of each vector by the sum of both distances: multi-sequence traversal, all vectors in step.

        Every row of the sorted left distances has a pointer into the sorted
        right ones; the smallest sum at a pointer is visited and moves it on.
        """
        most = min(self.visits if most is None else most, len(self.left) * len(self.right))
        out = np.empty((len(x), most), np.int32)
        for lo in range(0, len(x), _STEP):
            a, b = self.distances(x[lo : lo + _STEP])
            i_of, j_of = (np.argsort(d, axis=1, kind="stable")[:, :most] for d in (a, b))
            every = np.arange(len(a))
            a, b = np.take_along_axis(a, i_of, 1), np.take_along_axis(b, j_of, 1)
            b = np.c_[b, np.full(len(b), np.inf)]
            at, head = np.zeros(a.shape, np.int32), a + b[:, :1]
            for v in range(most):
                row = head.argmin(1)
                out[lo : lo + _STEP, v] = i_of[every, row] * len(self.right) + j_of[every, at[every, row]]
                at[every, row] += 1
                head[every, row] = a[every, row] + b[every, at[every, row]]
        return out


def place_of(visits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Where each row of visits has its cell; their number where it has not."""
    same = visits == cells[:, None]
    return np.where(same.any(1), same.argmax(1), visits.shape[1])


def _links(shared, threshold: float):
    """For sampled vectors: places of the linked vectors' cells, from the side that is nearer, and the links there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, x = shared.value
        seen, own = index.traverse(x, VISITS), index.cells(x)
        for dim, batch in by_dim(batches):
            if dim != x.shape[1]:
                continue
            other = _units(batch.column(1), dim)
            row, col = np.nonzero(x @ other.T >= threshold)
            ok = batch.column(0).to_numpy()[col] != ids[row]
            row, col = row[ok], col[ok]
            if not len(row):
                continue
            partners, which = np.unique(col, return_inverse=True)
            place = place_of(seen[row], index.cells(other[partners])[which])
            # The way back matters only where the way there is long.
            far = np.unique(which[place > 0])
            if len(far):
                back = np.zeros(len(partners), np.int64)
                back[far] = np.arange(len(far))
                turn = index.traverse(other[partners[far]], VISITS)
                for at in np.array_split(np.flatnonzero(place > 0), max(1, len(place) // 4096)):
                    place[at] = np.minimum(place[at], place_of(turn[back[which[at]]], own[row[at]]))
            pairs, n = np.unique(np.c_[row, place], axis=0, return_counts=True)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], ["query", "place", "n"])

    return run


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an Arrow list column."""
    x = matrix(column, dim)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def at_threshold(x: np.ndarray, threshold: float, seed: int = 0) -> np.ndarray:
    """For each unit vector another one at exactly this cosine, in a random direction."""
    away = np.random.default_rng(seed).normal(size=x.shape)
    away -= (away * x).sum(1)[:, None] * x
    size = np.sqrt((away**2).sum(1))
    away = np.where(size[:, None] > 1e-9, away / np.maximum(size, 1e-9)[:, None], 0)
    return threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * away


def build(units: DataFrame, dim: int, n: int, threshold: float, recall: float, sample: int, checks: int, least: int, entries: int = ENTRIES) -> Index:
    """Codebooks of at most ``entries`` from ``sample`` vectors, and visits from ``checks`` other ones (of few vectors, half each)."""
    spark = units.sparkSession
    drawn = lowest(units.filter(F.size("v") == dim), F.xxhash64("id", F.lit(1)), sample + checks, n, "id").select("id", "v").toArrow()
    if not len(drawn):
        raise ValueError("no vectors to learn from")
    x, known = _units(drawn.column(1).combine_chunks(), dim), drawn.column(0).to_numpy()
    asked = min(checks, len(x) // 2)
    k = int(np.clip(np.sqrt(n / 16), 2, entries))
    half = max(1, dim // 2)
    # Supercells of some ROWS vectors.
    groups = int(np.clip(np.sqrt(n / ROWS), 1, k))
    index = Index(kmeans(x[asked:, :half], k), kmeans(x[asked:, half:], k, 1), groups=groups)
    ids, queries = known[:asked], x[:asked]
    if not asked:
        index.visits = least
        return index
    partners = np.concatenate([at_threshold(queries, threshold, seed) for seed in range(8)])
    again = np.tile(queries, (8, 1))
    place = np.minimum(place_of(index.traverse(again, VISITS), index.cells(partners)), place_of(index.traverse(partners, VISITS), index.cells(again)))
    drawn_visits = int(np.sort(place)[int(np.ceil(recall * len(place))) - 1]) + 1
    shared = spark.sparkContext.broadcast((index, ids, queries))
    per = units.select("id", "v").mapInArrow(_links(shared, threshold), "query long, place long, n long").groupBy("query", "place").agg(F.sum("n").alias("n"))
    # Each query shares out one thousand million, in whole numbers that add up alike in any order.
    share = F.floor(F.col("n") * F.lit(1e9) / F.sum("n").over(Window.partitionBy("query")))
    places = per.select("place", share.alias("n")).groupBy("place").agg(F.sum("n").alias("n"))
    found = sorted((r["place"], r["n"]) for r in places.collect())
    total, seen, real_visits = sum(c for _, c in found), 0, least
    for place, c in found:
        seen += c
        if seen >= recall * total:
            real_visits = place + 1
            break
    index.visits = min(VISITS, max(least, real_visits, drawn_visits))
    return index


_PLACED = "id long, weight long, super long, supers array<long>, v binary"


def _place(shared):
    """Each vector with its supercell and those that it visits; the vector as its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches):
            index = shared.value[dim]
            raw = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), dim)
            supers = index.supercells(index.traverse(_units(batch.column(1), dim)).ravel()).reshape(len(batch), -1)
            own = supers[:, 0]
            order = np.sort(supers, axis=1)
            new = np.c_[np.ones(len(order), bool), order[:, 1:] != order[:, :-1]]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(new.sum(1))].astype(np.int32)), pa.array(order[new].astype(np.int64)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(own.astype(np.int64)), lists, pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "weight", "super", "supers", "v"])

    return run


_FOUND = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _lowest_joined(joined: np.ndarray, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each row the smallest label it is joined with, its own included."""
    out, big = own.copy(), np.iinfo(np.int64).max
    for at in range(0, len(joined), 256):
        out[at : at + 256] = np.minimum(out[at : at + 256], np.where(joined[at : at + 256], labels[None, :], big).min(1, initial=big))
    return out


def compare(index: Index, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, base: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the vectors of a supercell (``base``) and its visitors, cell by cell.

    Returns weights of links per row (both sides credited as the module says)
    and for each row the smallest id it is joined with in this group.
    """
    links, label = np.zeros(len(ids), np.int64), ids.copy()
    q, b = np.flatnonzero(~base), np.flatnonzero(base)
    visits = index.traverse(x)
    own = visits[:, 0]
    b = b[np.argsort(own[b], kind="stable")]
    cells, first = np.unique(own[b], return_index=True)
    ends = np.r_[first[1:], len(b)]
    # Which visitors come to which of these cells.
    flat = visits[q].ravel()
    place = np.minimum(np.searchsorted(cells, flat), len(cells) - 1)
    here = cells[place] == flat
    who, where = np.repeat(q, visits.shape[1])[here], place[here]
    order = np.argsort(where, kind="stable")
    who, start = who[order], np.searchsorted(where[order], np.arange(len(cells) + 1))
    for c in range(len(cells)):
        rows, guests = b[first[c] : ends[c]], who[start[c] : start[c + 1]]
        if not len(guests):
            continue
        hit = x[guests] @ x[rows].T >= threshold
        same = ids[guests][:, None] == ids[rows][None, :]
        hit &= ~same
        if not hit.any():
            continue
        links[guests] += hit @ weights[rows]
        # A guest whose cell the vector does not visit in turn is credited to it here.
        homes, home = np.unique(own[guests], return_inverse=True)
        turned = np.stack([(visits[rows] == h).any(1) for h in homes])
        for at in range(0, len(guests), 1024):
            alone = hit[at : at + 1024] & ~turned[home[at : at + 1024]]
            links[rows] += weights[guests[at : at + 1024]] @ alone
        joined = hit | same
        label_q, label_b = label[guests], label[rows]
        while True:
            new_q = _lowest_joined(joined, label_b, label_q)
            new_b = _lowest_joined(joined.T, new_q, label_b)
            if (new_q == label_q).all() and (new_b == label_b).all():
                break
            label_q, label_b = new_q, new_b
        label[guests], label[rows] = label_q, label_b
    return links, label


def _compare(shared, threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        dim, base = key[0].as_py(), group["base"].to_numpy()
        if base.all() or not base.any():
            return _FOUND.empty_table()
        ids, weights = group["id"].to_numpy(), group["weight"].to_numpy()
        kind = np.float32 if key[1].as_py() == 4 else np.float64
        x = np.frombuffer(b"".join(group["v"].to_pylist()), kind).reshape(len(ids), dim).astype(np.float64)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        links, label = compare(shared.value[dim], ids, weights, x, base, threshold)
        some, edge = np.flatnonzero(links), np.flatnonzero(label != ids)
        return pa.concat_tables([
            pa.table([pa.array(ids[some]), pa.array(links[some]), pa.nulls(len(some), pa.int64())], _FOUND),
            pa.table([pa.array(ids[edge]), pa.nulls(len(edge), pa.int64()), pa.array(label[edge])], _FOUND),
        ])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.995, sample: int = 8192, checks: int = 512, least: int = 4, entries: int = ENTRIES, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Vectors that are null, zero, or hold a null or non-finite component link
    with nothing: 0 links, their own component, kept.  So do rows whose key is
    null.  Rows with equal vectors are linked with each other.  Rows that repeat
    a key are one vertex with the links of each.  Vectors of different length do
    not link.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kind = vectors.select(vector).schema[0].dataType
    # Floats stay floats until they are compared; any other numbers are doubles.
    wide = 4 if kind.simpleString() == "array<float>" else 8
    rows = rows if wide == 4 else rows.withColumn("v", F.col("v").cast("array<double>"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = rows.withColumn("norm", F.when(F.col("vec_id").isNotNull() & usable("v"), norm))
    good = rows.filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    # Equal vectors meet under one id: the smallest of theirs.
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    units = materialise(distinct.select("id", "v", "weight"), "units")
    sizes = {r["dim"]: r["n"] for r in units.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    indexes = {d: build(units, d, n, threshold, recall, sample, checks, least, entries) for d, n in sizes.items()}
    shared = spark.sparkContext.broadcast(indexes)
    placed = units.select("id", "v", "weight").mapInArrow(_place(shared), _PLACED).withColumn("dim", (F.length("v") / wide).cast("int"))
    placed = materialise(placed, "placed")
    # Supercells are bounded by the product of the codebooks; so is this table of their sizes.
    n_base = placed.groupBy("dim", "super").agg(F.ceil(F.count("*") / HELD).cast("int").alias("n_base"))
    n_seen = placed.select("dim", F.explode("supers").alias("super")).groupBy("dim", "super").agg(F.ceil(F.count("*") / SEEN).cast("int").alias("n_seen"))
    blocks = materialise(n_base.join(n_seen, ["dim", "super"]), "blocks")
    cut = F.xxhash64("id", F.lit("block"))
    held = placed.join(blocks, ["dim", "super"]).withColumn("b", F.pmod(cut, "n_base").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_seen") - 1)))
    asked = placed.drop("super").withColumn("super", F.explode("supers")).join(blocks, ["dim", "super"])
    asked = asked.withColumn("s", F.pmod(cut, "n_seen").cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_base") - 1)))
    cols = ["dim", F.lit(wide).alias("wide"), "super", "b", "s", "id", "weight", "v"]
    both = held.select(*cols, F.lit(True).alias("base")).unionByName(asked.select(*cols, F.lit(False).alias("base")))
    found = materialise(both.groupBy("dim", "wide", "super", "b", "s").applyInArrow(_compare(shared, threshold), "id long, links long, to long"), "found")
    links = found.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    label = components(found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    per = units.join(links, "id", "left").join(label, units.id == label.node, "left")
    per = per.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    named = good.select("vec_id", "v").join(per, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("norm").isNull() | ~((F.col("norm") > 0) & (F.col("norm") < float("inf")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.unionByName(alone)
    return out.select(F.col("vec_id").alias(key), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
