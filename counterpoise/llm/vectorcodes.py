"""Vector codes: product quantisation in whole numbers with Drake-Hamerly adaptive bounds.

1. Components become floor(256 * x); a vector is cut into PARTS equal parts, each with a codebook
   that starts as that part of the vectors with the smallest ids.
2. A round assigns every part to its nearest entry and replaces each entry by the floor of the
   mean of its parts.  Sums are whole numbers added up per task, then by Spark; only the sums of
   the codebooks (PARTS * ENTRIES entries) reach the driver.
3. With its code every part keeps its b next closest entries in order, a lower bound of the
   distance to each, and one outer bound for all other entries.  When entries move, bounds shrink
   by the way they moved.  A part whose own entry is nearer than every bound keeps it; otherwise
   the listed entries whose bounds do not rule them out are compared in whole numbers, and only if
   the outer bound does not hold either, all entries are.  Ties are never decided by a bound.
4. After each round b is set to the longest list that any part needed, between an eighth and a
   quarter of the entries.

Vectors and bounds stay in blocks of one Arrow batch; no vector is shuffled.  Every round is
written to the shared scratch area.

Defined results: vectors that are NULL or hold a NULL or non-finite component are dropped; shorter
vectors are filled with zeros, and so is the dimension up to a multiple of PARTS; NULL ids come
after all others, repeated ids in the order of their vectors; with fewer vectors than ENTRIES the
codebooks are smaller; components of any finite size are exact (large ones are compared without
bounds), an error beyond a long is given as the largest long; an empty table gives no rows.  The
result has the columns named below only, so clashing input columns do no harm.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from counterpoise.session import spool

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
SAFE = 1 << 26  # whole numbers below this keep squares and sums inside a long
LIMB = 40  # bits of a sum that are added up in one long
LONGEST = (1 << 63) - 1


def is_complete(vector: Column) -> Column:
    """Neither NULL nor holding a NULL or non-finite component."""
    fine = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def whole(x: float) -> int:
    """floor(SCALE * x) of a finite number, exactly."""
    y = SCALE * x
    return int(np.floor(y)) if np.isfinite(y) else SCALE * int(x)


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Whole numbers of a batch of complete vectors; Python integers where some are not small."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    size = np.diff(ends)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], size)
    values = flat.astype(np.float64)
    with np.errstate(over="ignore"):
        floors = np.floor(values * SCALE)
    if not len(flat) or np.abs(floors).max() < SAFE:
        out = np.zeros((len(size), dim), np.int64)
        out[row, place] = floors.astype(np.int64)
    else:
        out = np.zeros((len(size), dim), object)
        out[row, place] = [whole(v) for v in values.tolist()]
    return out


def _dump(x: np.ndarray) -> bytes:
    if x.dtype == object:
        return pickle.dumps(x)
    top = int(np.abs(x).max(initial=0))
    return pickle.dumps(x.astype(np.int16 if top < 1 << 15 else np.int32))


def _load(data: bytes) -> np.ndarray:
    x = pickle.loads(data)
    return x if x.dtype == object else x.astype(np.int64)


def is_small(c: np.ndarray) -> bool:
    return not c.size or max(abs(int(c.max())), abs(int(c.min()))) < SAFE


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, as whole numbers."""
    if x.dtype != object:
        top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
        if 4 * x.shape[1] * int(top) ** 2 < 1 << 53:  # sums of whole numbers in doubles are exact
            a, b = x.astype(float), c.astype(float)
            d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
            return d.astype(np.int64)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def squares_to(x: np.ndarray, c: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to the entries c[which], one or several a row."""
    if which.ndim == 1:
        return ((x - c[which]) ** 2).sum(axis=1)
    return ((x[:, None, :] - c[which]) ** 2).sum(axis=2)


def below(d: np.ndarray) -> np.ndarray:
    """Roots of whole numbers, rounded down."""
    root = np.sqrt(d.astype(float))
    return np.maximum(0, np.nextafter(np.nextafter(root, 0).astype(np.float32), np.float32(0)))


def above(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(float)), np.inf) * (1 + 1e-12)


def ranked(d: np.ndarray, b: int):
    """(code, next, low, outer) from all distances of some rows: the nearest entry, lower index
    first, the b closest others in order, their bounds, and one bound for the rest."""
    n, entries = d.shape
    code = np.argmin(d, axis=1)
    rest = d.copy()
    rest[np.arange(n), code] = np.iinfo(np.int64).max
    order = np.argsort(rest, axis=1, kind="stable")[:, : min(b + 1, entries - 1)]
    low = below(np.take_along_axis(d, order, axis=1))
    if order.shape[1] > b:
        outer, order, low = low[:, b], order[:, :b], low[:, :b]
    else:
        outer = np.full(n, np.inf, np.float32)
    return code.astype(np.uint8), order.astype(np.uint8), low, outer


def reassign(x, c, moved, code, following, low, outer):
    """The same after the entries moved by ``moved``, and how long a list any row needed."""
    b = following.shape[1]
    own = squares_to(x, c, code)
    reach = above(own)
    low = below_zero(low - moved[following])
    outer = below_zero(outer - moved.max(initial=0.0))
    # ordered again: no bound is above the ones behind it
    chain = np.concatenate([low, outer[:, None]], axis=1)
    chain = np.minimum.accumulate(chain[:, ::-1], axis=1)[:, ::-1]
    low, outer = chain[:, :b].copy(), chain[:, b].copy()
    need = (low <= reach[:, None]).sum(axis=1)
    need[outer <= reach] = b + 1
    listed = np.flatnonzero((need > 0) & (need <= b))
    if len(listed):
        xs, deep = x[listed], need[listed]
        ids = np.concatenate([code[listed, None], following[listed]], axis=1)
        d = squares_to(xs, c, ids)
        known = np.arange(b + 1)[None, :] <= deep[:, None]
        d[~known] = np.iinfo(np.int64).max
        # the nearest, lower index first
        least = d.min(axis=1)
        best = np.where(d == least[:, None], ids, 255).min(axis=1)
        at = np.argmax(ids == best[:, None], axis=1)
        bounds = np.concatenate([np.zeros((len(xs), 1), np.float32), low[listed]], axis=1)
        bounds[known] = below(d[known])
        bounds[np.arange(len(xs)), at] = -1  # first, and taken out of the list
        order = np.argsort(bounds, axis=1, kind="stable")[:, 1:]
        code[listed] = best
        following[listed] = np.take_along_axis(ids, order, axis=1)
        low[listed] = np.take_along_axis(bounds, order, axis=1)
        own[listed] = least
    unknown = np.flatnonzero(need > b)
    if len(unknown):
        d = squares(x[unknown], c)
        code[unknown], following[unknown], low[unknown], outer[unknown] = ranked(d, b)
        own[unknown] = d.min(axis=1)
    return own, code, following, low, outer, int(need.max(initial=0)), len(unknown)


def below_zero(bound: np.ndarray) -> np.ndarray:
    """Bounds after a subtraction, rounded down; negative ones rule nothing out."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def _limbs(sums: list, out: dict, part: int) -> None:
    """Adds whole numbers (entry, position) to the sums by limbs of LIMB bits."""
    for e, row in enumerate(sums):
        for i, v in enumerate(row):
            v, k = int(v), 0
            while v:
                piece = v & ((1 << LIMB) - 1) if abs(v) >> LIMB else v
                out[part, e, i, k] = out.get((part, e, i, k), 0) + piece
                v, k = (v - piece) >> LIMB, k + 1


class Codebooks:
    """One array (entries, width) of whole numbers per part, and how far the entries moved."""

    def __init__(self, parts: list[np.ndarray], moved: list[np.ndarray] | None = None):
        self.parts = [p.astype(np.int64) if is_small(p) else p.astype(object) for p in parts]
        self.moved = moved

    def replaced(self, sums: dict, counts: dict) -> Codebooks:
        """Each used entry becomes the floor of its mean."""
        new, moved = [], []
        for p, old in enumerate(self.parts):
            c = old.astype(object)
            for e in range(len(c)):
                n = counts.get((p, e), 0)
                if n:
                    c[e] = [sums.get((p, e, i), 0) // n for i in range(c.shape[1])]
            new.append(c)
            way = ((c - old.astype(object)) ** 2).sum(axis=1)
            small = all(int(w) < 1 << 100 for w in way)
            moved.append(above(np.array(way, object)) if small else np.full(len(c), np.inf))
        return Codebooks(new, moved)

    def digest(self) -> str:
        text = ",".join(str(int(v)) for p in self.parts for v in p.reshape(-1))
        return hashlib.sha256(text.encode()).hexdigest()


def _assign(x: np.ndarray, books: Codebooks, state: bytes | None, b: int):
    """(codes, distances, state, longest list needed, parts compared in full) of one block."""
    width = x.shape[1] // PARTS
    old = pickle.loads(state) if state else None
    codes, errors, kept, need, full = [], [], [], 0, 0
    for p, c in enumerate(books.parts):
        xs = x[:, p * width : (p + 1) * width]
        if xs.dtype == object or c.dtype == object:
            d = squares(xs.astype(object), c.astype(object))
            code = d.argmin(axis=1).astype(np.uint8)
            own, one = d[np.arange(len(code)), code], None
            full += len(code)
        elif old is None or old[p] is None:
            d = squares(xs, c)
            code, *bounds = ranked(d, b)
            own, one = d.min(axis=1), (code, *bounds)
            full += len(code)
        else:
            own, code, *bounds, longest, again = reassign(xs, c, books.moved[p], *old[p])
            need, full = max(need, longest), full + again
            one = (code, *bounds)
        if one is not None and one[1].shape[1] > b:  # the list is cut, the outer bound covers the rest
            code, following, low, outer = one
            one = (code, following[:, :b], low[:, :b], np.minimum(outer, low[:, b:].min(axis=1)))
        codes.append(code)
        errors.append(own)
        kept.append(one)
    return np.column_stack(codes), errors, pickle.dumps(kept), need, full


def _sums(x: np.ndarray, codes: np.ndarray, entries: int) -> bytes:
    """Sums and counts per part and entry of one block."""
    width = x.shape[1] // PARTS
    out = []
    for p in range(PARTS):
        total = np.zeros((entries, width), x.dtype)
        np.add.at(total, codes[:, p], x[:, p * width : (p + 1) * width])
        out.append((total, np.bincount(codes[:, p], minlength=entries)))
    return pickle.dumps(out)


def _totals(rounds: DataFrame) -> tuple[dict, dict]:
    """Sums per (part, entry, position) and counts per (part, entry) over all blocks."""

    def add(batches):
        total: dict = {}
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                for p, (sums, counts) in enumerate(pickle.loads(data)):
                    _limbs(sums, total, p)
                    for e in np.flatnonzero(counts):
                        total[p, e, -1, 0] = total.get((p, e, -1, 0), 0) + int(counts[e])
        keys = np.array(list(total), np.int32).reshape(-1, 4)
        columns = {c: keys[:, i] for i, c in enumerate(("part", "entry", "place", "limb"))}
        yield pa.RecordBatch.from_pydict({**columns, "v": np.array(list(total.values()), np.int64)})

    flat = rounds.select("sums").mapInArrow(add, "part int, entry int, place int, limb int, v long")
    rows = flat.groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v")).collect()
    sums: dict = {}
    counts: dict = {}
    for r in rows:
        if r["place"] < 0:
            counts[r["part"], r["entry"]] = r["v"]
        else:
            at = (r["part"], r["entry"], r["place"])
            sums[at] = sums.get(at, 0) + (r["v"] << (LIMB * r["limb"]))
    return sums, counts


def vector_codes(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of every complete vector."""
    spark = vectors.sparkSession
    rows = vectors.filter(is_complete(F.col(vector))).select(
        F.col(key).alias("key"),
        F.col(label).alias("label"),
        F.transform(vector, lambda x: x.cast("double")).alias("v"),
    )
    key_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("key", "label"))
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        shape = f"`{key}` {key_type}, `{label}` {label_type}, code string, error long, "
        return spark.createDataFrame([], shape + "label_error long, codebooks_sha256 string")
    dim = max(1, -(-longest // PARTS)) * PARTS

    seeds = rows.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(ENTRIES).collect()
    first = matrix(pa.array([r["v"] for r in seeds], pa.list_(pa.float64())), dim)
    books = Codebooks(np.split(first, PARTS, axis=1))
    entries = len(seeds)

    def pack(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                ends = pa.array([0, n], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, batch.column(i)) for i in (0, 1)]
                data = pa.array([_dump(matrix(batch.column(2), dim))], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, data], ["keys", "labels", "x"])

    kept = f"keys array<{key_type}>, labels array<{label_type}>, x binary"
    blocks = spool(rows.mapInArrow(pack, kept), "vectors")
    b = max(1, ENTRIES // 4)
    for turn in range(ROUNDS):

        def assign(batches, books=books, b=b, turn=turn):
            for batch in batches:
                out = []
                for i in range(batch.num_rows):
                    x = _load(batch.column("x")[i].as_py())
                    state = batch.column("state")[i].as_py() if turn else None
                    codes, _, state, need, full = _assign(x, books, state, b)
                    out.append((state, _sums(x, codes, entries), need, full))
                state, sums, need, full = (list(c) for c in zip(*out)) if out else ([],) * 4
                more = [pa.array(state, pa.binary()), pa.array(sums, pa.binary())]
                more += [pa.array(need, pa.int32()), pa.array(full, pa.int64())]
                same = [batch.column(c) for c in ("keys", "labels", "x")]
                names = ["keys", "labels", "x", "state", "sums", "need", "compared"]
                yield pa.RecordBatch.from_arrays(same + more, names)

        shape = kept + ", state binary, sums binary, need int, compared long"
        taken = blocks.select(*(["keys", "labels", "x", "state"] if turn else ["keys", "labels", "x"]))
        blocks = spool(taken.mapInArrow(assign, shape), "assigned")
        books = books.replaced(*_totals(blocks))
        if turn:
            need = blocks.agg(F.max("need")).first()[0]
            b = min(b, max(1, ENTRIES // 8, need))

    def finish(batches, books=books, b=b):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _load(batch.column("x")[i].as_py())
                codes, errors, *_ = _assign(x, books, batch.column("state")[i].as_py(), b)
                total = [min(sum(int(e[k]) for e in errors), LONGEST) for k in range(len(x))]
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                columns = [batch.column(c)[i].values for c in ("keys", "labels")]
                columns += [pa.array(text, pa.string()), pa.array(total, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "label", "code", "error"])

    shape = f"key {key_type}, label {label_type}, code string, error long"
    coded = spool(blocks.select("keys", "labels", "x", "state").mapInArrow(finish, shape), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(total.cast("long").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        F.col("key").alias(key),
        F.col("label").alias(label),
        "code",
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )
