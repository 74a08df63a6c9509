"""Near-duplicate vectors by cosine, from int8 tile products with rigorous error bounds.

A unit vector x is s q + e, q being int8 and the norm of e known; q, s and that norm are all that travels. Two vectors have a cosine
within |e_x| + (1 + |e_x|) |e_y| of s_x s_y <q_x, q_y>, whose integers are summed exactly. Pairs whose product lies further than that from the threshold
are settled by it; only for the others, which are possibly above the threshold and possibly not, the vectors themselves are fetched and
compared in double precision.

Vectors lie in cells, each around its nearest pivot, and a cell in tiles. A vector visits the cells before its own that can hold
a partner: those whose pivot is no further from it than the cell's radius and the threshold's angle together; this is the triangle inequality on the
sphere, with the quantisation's error allowed for, and loses nothing. Equal vectors of different ids are one entry with a weight.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.components import connected_components
from spanlake.llm.frames import column, cut

TILE = 4096
#: Cells at most; there are as many as tiles up to that.
MAX_CELLS = 1024
#: Room for rounding in what bounds are computed from.
ROUNDING = 1e-6
#: Components whose int8 products a single precision sum holds exactly: 127 * 127 * 1024 < 2**24.
EXACT = 1024
ROWS, PAIRS = 512, 1 << 15


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros; null components become NaN, null lists zeros."""
    lists = [np.zeros(0) if x is None else np.asarray(x, dtype=float) for x in column.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(lists), max([width, *map(len, lists)])))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows are finite and not zero; the others are zeros."""
    with np.errstate(all="ignore"):
        top = np.abs(matrix).max(axis=1, initial=0)
        good = np.isfinite(matrix).all(axis=1) & (top > 0)
        scaled = np.where(good[:, None], matrix / np.where(good, top, 1)[:, None], 0)
        norm = np.sqrt((scaled * scaled).sum(axis=1))
        return scaled / np.where(good, norm, 1)[:, None], good


def _quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The int8 forms of unit vectors, their scales, and bounds of the errors' norms, in single precision."""
    scale = (np.abs(unit).max(axis=1, initial=0) / 127).astype(np.float32)
    scale = np.where(scale > 0, scale, np.float32(1))
    q = np.clip(np.rint(unit / scale[:, None].astype(float)), -127, 127).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None].astype(float) * q) ** 2).sum(axis=1))
    return q, scale, np.nextafter((error + ROUNDING).astype(np.float32), np.float32(np.inf))


def _digests(matrix: np.ndarray, dims: list[int]) -> list[bytes]:
    return [hashlib.blake2b((row[:n] + 0.0).tobytes(), digest_size=16).digest() for row, n in zip(matrix, dims)]


def _coded(batches):
    """(vec_id, digest, codes, scale, error) of each vector; the last three are null where it can't link."""
    for part in batches:
        lists = part.column(1)
        dims = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()
        matrix = _matrix(lists)
        unit, good = _units(matrix)
        q, scale, error = _quantised(unit)
        codes = [row[:n].tobytes() if ok else None for row, n, ok in zip(q, dims, good)]
        bad = pa.array(~good)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_digests(matrix, dims), pa.binary()), pa.array(codes, pa.binary()), *(pa.compute.if_else(bad, None, pa.array(x)) for x in (scale, error))], names=["vec_id", "digest", "codes", "scale", "error"])


def _with_digests(batches):
    for part in batches:
        lists = part.column(1)
        dims = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(_digests(_matrix(lists), dims), pa.binary()), lists], names=["digest", "embedding"])


def _wide(codes: list[bytes], width: int = 0) -> np.ndarray:
    """Codes as a matrix, shorter ones padded with zeros."""
    width = max([width, *map(len, codes)])
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in codes), dtype=np.int8).reshape(len(codes), width)


def _angles(codes: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between quantised vectors and pivots."""
    width = max(codes.shape[1], pivots.shape[1])
    a, b = (np.pad(x.astype(float), ((0, 0), (0, width - x.shape[1]))) for x in (codes, pivots))
    return np.arccos(np.clip(a @ b.T / np.maximum(1e-300, np.sqrt((a * a).sum(axis=1)))[:, None], -1, 1))


def _lean(error: np.ndarray) -> np.ndarray:
    """The largest angle between a unit vector and its quantised form."""
    return np.arcsin(np.minimum(error.astype(float), 1.0))


def _celled(pivots: np.ndarray):
    """Entries with their cell and the furthest that they can lie from its pivot."""

    def celled(batches):
        for part in batches:
            if not part.num_rows:
                continue
            angle = _angles(_wide(part.column(part.schema.get_field_index("codes")).to_pylist()), pivots)
            cell = angle.argmin(axis=1)
            far = angle[np.arange(len(cell)), cell] + _lean(part.column(part.schema.get_field_index("error")).to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(far)], names=[*part.schema.names, "cell", "far"])

    return celled


FIELDS = "home int, cell int, part int, rows binary, ids binary, weights binary, dims binary, scale binary, error binary, codes binary"


def _tiled(pivots: np.ndarray, radius: np.ndarray, reach: float):
    """A tile of a cell as one row for its own cell, and one for each cell before it that some of its vectors visit, with these."""

    def tiled(key: tuple, table: pa.Table) -> pa.Table:
        cell, part = key[0].as_py(), key[1].as_py()
        codes = table.column("codes").to_pylist()
        error = table.column("error").to_numpy()
        q = _wide(codes)
        columns = [table.column(k).to_numpy().astype(np.int64) for k in ("row", "vec_id", "weight")] + [np.array([len(c) for c in codes], dtype=np.int32), table.column("scale").to_numpy(), error, q]
        near = _angles(q, pivots[:cell]) - _lean(error)[:, None] <= radius[:cell] + reach if cell else np.zeros((len(q), 0), dtype=bool)
        out = [(cell, cell, part, *(x.tobytes() for x in columns))]
        for home in np.flatnonzero(near.any(axis=0)).tolist():
            out.append((home, cell, part, *(x[near[:, home]].tobytes() for x in columns)))
        names = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.table({n: pa.array(x, pa.int32() if i < 3 else pa.binary()) for i, (n, x) in enumerate(zip(names, zip(*out)))})

    return tiled


class _Tile:
    def __init__(self, row: dict):
        self.rows, self.ids, self.weights = (np.frombuffer(row[k], dtype=np.int64) for k in ("rows", "ids", "weights"))
        self.dims = np.frombuffer(row["dims"], dtype=np.int32)
        self.scale, self.error = (np.frombuffer(row[k], dtype=np.float32).astype(float) for k in ("scale", "error"))
        self.q = np.frombuffer(row["codes"], dtype=np.int8).reshape(len(self.rows), -1)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (k, label) that connect what links (i, j) connect, one a vector at most."""
    label = np.arange(n)
    while True:  # least label of what is linked, and of its label
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        after = after[after]
        if (after == label).all():
            tied = np.flatnonzero(label != np.arange(n))
            return tied, label[tied]
        label = after


FOUND = "a long, b long, row long, n long, low binary, high binary, mask binary"


def _found(ids, rows, weights, i, j, doubt=()) -> pa.Table:
    """Rows of FOUND: a forest's links (a, b), how many links a row has, and pairs in doubt as a matrix of bits between two lists of rows."""
    tied, label = _forest(i, j, len(ids))
    n = np.zeros(len(ids), dtype=np.int64)
    np.add.at(n, i, weights[j])
    np.add.at(n, j, weights[i])
    some = np.flatnonzero(n)
    none = [None] * len(tied), [None] * len(some), [None] * len(doubt)
    low, high, mask = zip(*doubt) if doubt else ((), (), ())
    return pa.table(
        {
            "a": pa.array([*ids[tied].tolist(), *none[1], *none[2]], pa.int64()),
            "b": pa.array([*ids[label].tolist(), *none[1], *none[2]], pa.int64()),
            "row": pa.array([*none[0], *rows[some].tolist(), *none[2]], pa.int64()),
            "n": pa.array([*none[0], *n[some].tolist(), *none[2]], pa.int64()),
            **{k: pa.array([*none[0], *none[1], *x], pa.binary()) for k, x in (("low", low), ("high", high), ("mask", mask))},
        }
    )


def _compare(threshold: float):
    """Two tiles, or one with itself: the links that int8 products are sure of, and the pairs they leave in doubt."""

    def compared(key: tuple, table: pa.Table) -> pa.Table:
        home, part, other, other_part = (k.as_py() for k in key)
        found = {(r["cell"], r["part"]): r for r in table.to_pylist()}
        if (home, part) not in found or (other, other_part) not in found:
            return _found(*[np.zeros(0, dtype=np.int64)] * 5)
        a, b = _Tile(found[home, part]), _Tile(found[other, other_part])
        alone = (home, part) == (other, other_part)
        width = min(a.q.shape[1], b.q.shape[1])  # beyond it one side has zeros
        shift = 0 if alone else len(a.rows)
        ids, rows, weights = (x if alone else np.concatenate([x, y]) for x, y in ((a.ids, b.ids), (a.rows, b.rows), (a.weights, b.weights)))
        right = b.q[:, :width].astype(np.float32).T.copy()
        sure_i, sure_j, doubt = [], [], []
        for at in range(0, len(a.rows), ROWS):
            left = a.q[at : at + ROWS, :width].astype(np.float32)
            near = np.zeros((len(left), len(b.rows)))
            for c in range(0, width, EXACT):
                near += left[:, c : c + EXACT] @ right[c : c + EXACT]
            near *= a.scale[at : at + ROWS, None]
            near *= b.scale
            error = a.error[at : at + ROWS]
            largest = error.max() + (1 + error.max()) * b.error.max() + ROUNDING
            i, j = np.nonzero(near >= threshold - largest)
            bound = error[i] + (1 + error[i]) * b.error[j] + ROUNDING
            value = near[i, j]
            i += at
            use = (value + bound >= threshold) & (a.dims[i] == b.dims[j]) & (a.ids[i] != b.ids[j])
            if alone:
                use &= i > j
            sure = use & (value - bound >= threshold)
            sure_i.append(i[sure])
            sure_j.append(j[sure] + shift)
            i, j = i[use & ~sure], j[use & ~sure]
            if len(i):
                low, high = np.unique(i), np.unique(j)
                mask = np.zeros((len(low), len(high)), dtype=bool)
                mask[np.searchsorted(low, i), np.searchsorted(high, j)] = True
                doubt.append((a.rows[low].tobytes(), b.rows[high].tobytes(), zstandard.ZstdCompressor(level=1).compress(np.packbits(mask).tobytes())))
        return _found(ids, rows, weights, np.concatenate(sure_i), np.concatenate(sure_j), doubt)

    return compared


def _involved(batches):
    """(pair, row) of each row that a pair of tiles left in doubt."""
    for part in batches:
        for pair, *sides in zip(*(c.to_pylist() for c in part.columns)):
            rows = np.unique(np.frombuffer(b"".join(sides), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), pair)), pa.array(rows)], names=["pair", "row"])


def _recompute(threshold: float):
    """The links among pairs in doubt, in double precision."""

    def recomputed(key: tuple, masks: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        rows, ids, weights = (table.column(k).to_numpy().astype(np.int64) for k in ("row", "vec_id", "weight"))
        unit = _units(_matrix(table.column("embedding").combine_chunks()))[0]
        (one,) = masks.to_pylist()
        low, high = (np.frombuffer(one[k], dtype=np.int64) for k in ("low", "high"))
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(one["mask"]), dtype=np.uint8)
        mask = np.unpackbits(bits, count=len(low) * len(high)).reshape(len(low), len(high))
        i, j = np.nonzero(mask)
        i, j = np.searchsorted(rows, low)[i], np.searchsorted(rows, high)[j]
        linked = np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + PAIRS]], unit[j[k : k + PAIRS]]) >= threshold for k in range(0, len(i), PAIRS)])
        return _found(ids, rows, weights, i[linked], j[linked])

    return recomputed


def _entries(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, vec_id, weight, digest, codes, scale, error) of what is compared, and (vec_id, row) of what stands for each id.

    Ids of one vector share an entry with those of an equal one, known by the least of them; ids of several vectors have an entry for each.
    """
    one = coded.where("vec_id IS NOT NULL AND codes IS NOT NULL")
    keys = one.select("vec_id", "digest").distinct()
    several = keys.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("several"))
    code = F.min(F.struct("codes", "scale", "error")).alias("code")
    marked = one.join(several, "vec_id", "left").withColumn("own", F.when(F.col("several"), F.col("vec_id")))
    entries = marked.groupBy("digest", "own").agg(code, F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("weight"))
    entries = cut(entries.select(F.monotonically_increasing_id().alias("row"), "vec_id", "weight", "digest", "own", "code.*"))
    alone = keys.join(several, "vec_id", "left_anti").join(entries.where("own IS NULL").select("digest", "row"), "digest").select("vec_id", "row")
    return entries.drop("own"), alone.unionByName(entries.where("own IS NOT NULL").select("vec_id", "row"))


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per vec_id: the other vectors at or above the cosine, the smallest id reachable by links, and whether that is its own.

    Null or zero vectors, and those with null or non-finite components, link with nothing; so do vectors of different
    length with each other. Of rows that share a vec_id each distinct vector is compared with those of other ids: n_links
    counts the pairs, and a link of one joins the id. Null ids are one row without links, its component null and kept false. Only the two named columns are read, so others may have any names.
    An empty table gives no rows.

    What leaves a pair of tiles is a count per vector, a forest of its links, and the pairs in doubt as bits, so a group
    of near copies costs its size and not its square.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    kind = "array<float>" if dict(vectors.dtypes).get(vector_col) == "array<float>" else "array<double>"
    vectors = vectors.select(column(id_col).cast("long").alias("vec_id"), column(vector_col).cast(kind).alias("embedding"))
    coded = cut(vectors.mapInArrow(_coded, "vec_id long, digest binary, codes binary, scale float, error float"))
    entries, members = _entries(coded)

    n_cells = min(MAX_CELLS, max(1, math.ceil(entries.count() / TILE)))
    sample = entries.orderBy(F.xxhash64("digest"), "row").select("codes").limit(n_cells).toArrow().column("codes").to_pylist()
    pivots = _wide(sample).astype(float) if sample else np.ones((1, 1))
    pivots /= np.maximum(1e-300, np.sqrt((pivots**2).sum(axis=1)))[:, None]
    placed = cut(entries.mapInArrow(_celled(pivots), "row long, vec_id long, weight long, digest binary, codes binary, scale float, error float, cell int, far double"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), F.max("far").alias("far")).collect()  # MAX_CELLS rows at most
    parts, radius = {r["cell"]: r["parts"] for r in sizes}, np.zeros(len(pivots))
    radius[list(parts)] = [r["far"] for r in sizes]
    reach = math.acos(threshold) + ROUNDING
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    meets = [(c, d, parts[d]) for c in parts for d in parts if d >= c and (c == d or apart[c, d] - radius[c] - radius[d] <= reach)]

    spark = vectors.sparkSession
    cells = F.broadcast(spark.createDataFrame(list(parts.items()), "cell int, parts int"))
    tiles = placed.join(cells, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    tiles = cut(tiles.groupBy("cell", "part").applyInArrow(_tiled(pivots, radius, reach), FIELDS))
    # a cell's tiles meet each other, and the tiles that visit from cells behind it
    others = F.broadcast(spark.createDataFrame(meets, "home int, other int, other_parts int"))
    own = tiles.where("home = cell").join(others, "home").withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    low, high = F.least("part", "other_part"), F.greatest("part", "other_part")
    same = F.col("other") == F.col("home")
    own = own.select(*tiles.columns, F.when(same, low).otherwise(F.col("part")).alias("home_part"), "other", F.when(same, high).otherwise(F.col("other_part")).alias("other_part"))
    visits = tiles.where("home <> cell").join(cells.select(F.col("cell").alias("home"), "parts"), "home").select(*tiles.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("home_part"), F.col("cell").alias("other"), F.col("part").alias("other_part"))
    found = cut(own.unionByName(visits).groupBy("home", "home_part", "other", "other_part").applyInArrow(_compare(threshold), FOUND))

    doubt = cut(found.where("mask IS NOT NULL").select(F.monotonically_increasing_id().alias("pair"), "low", "high", "mask"))
    involved = doubt.select("pair", "low", "high").mapInArrow(_involved, "pair long, row long").join(entries.select("row", "vec_id", "weight", "digest"), "row")
    whole = vectors.mapInArrow(_with_digests, f"digest binary, embedding {kind}").join(involved.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    settled = doubt.groupBy("pair").cogroup(involved.join(whole, "digest").groupBy("pair")).applyInArrow(_recompute(threshold), FOUND)
    found = cut(found.where("mask IS NULL").unionByName(settled))

    counts = found.where("row IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n"))
    components = connected_components(found.where("a IS NOT NULL").select("a", "b"))
    judged = entries.join(counts, "row", "left").join(components, F.col("vec_id") == F.col("id"), "left")
    judged = judged.select("row", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component_id", "vec_id").alias("component_id"))
    by_id = members.join(judged, "row").groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("component_id").alias("component_id"))
    out = coded.select("vec_id").distinct().join(by_id, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
