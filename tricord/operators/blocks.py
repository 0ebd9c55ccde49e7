"""Ratings laid out once in parts by ranges of users; only what the two sides know moves afterwards.

A home is a range of ids of one side of a group (a relation, or all relations that share their rows), with a row of a
matrix for each; a part is the rows of a range of users. Parts are packed, dealt by their number and kept, so no later step
shuffles a rating: a home sends each part those of its rows whose ids the part has, and parts send sums of these rows back.
So an id moves as often as there are parts with it, which its ratings bound, and never to all parts of the other side.
Homes have a bounded size; a part has a bounded number of rows, what is more of one user goes to further parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, _parse_datatype_string

from tricord.operators.prep import in_blocks
from tricord.plans.storage import materialize, small

#: Bytes of a home's matrix, rows of a part, and bytes of the matrix of a part whose rows all had ids of their own.
HOME_BYTES, PART_ROWS, PART_BYTES = 4 << 20, 1 << 20, 256 << 20
#: Numbers of parts of one range of users.
SLICES = 1 << 20
SIDES = ("u", "b")
ROW = "g int, u long, b long, x double, train long, test long"


def squeezed(places: np.ndarray) -> bytes:
    """Ascending places as bytes; runs of neighbours take hardly any."""
    return zlib.compress(np.diff(places.astype("<i4"), prepend=np.int32(0)).astype("<i4").tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i4"))


@dataclass(frozen=True)
class Layout:
    """``homes``: (home, side, g, ids), ids sorted; ``packed``: the parts as they are written, with their ids; ``parts``: (part, g, u_n, b_n, u, b, x, train, test), arrays as binary, u and b as
    places among the part's own ids, of which there are u_n and b_n, in the order of u; ``routing``: (home, n, bytes, routes), n the home's
    ids and a route the part, where among the part's ids (``at``) and where among the home's (``places``)."""

    homes: DataFrame
    parts: DataFrame
    routing: DataFrame
    width: int  # of the numbers of homes: home = (g * 2 + side) * width + block
    grid: tuple[int, int]  # ids of a home, and the width
    packed: DataFrame | None = None
    held: dict = field(default_factory=dict)  # what ``resident`` keeps of the parts, for all that run on this layout

    def meet(self, sent: DataFrame, f: Callable, schema: str) -> DataFrame:
        """``f(part, sides)`` for each part: its arrays by name, and by side what ``sent`` (home, ...) has for its own ids:
        names to bytes, a row for each id of the part, and ``slices``: (home, at, places) of these rows. In the
        arrays u and b an id that no home has is -1, and its rows are zeros; a side without known ids is missing. ``f`` yields rows of ``schema``."""
        names = [c for c in sent.columns if c != "home"]
        width = self.width

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("home", "n", "routes", *names)}
                    whole = [np.frombuffer(row[c], "u1").reshape(row["n"], -1) for c in names]
                    side = SIDES[row["home"] // width % 2]
                    for r in row["routes"]:
                        places = unsqueezed(r["places"])
                        values = [r["part"], side, row["home"], r["at"], r["places"], *(m[places].tobytes() for m in whole)]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, routed_schema.types, strict=True)], schema=routed_schema)

        routed = "part long, side string, home long, at binary, places binary" + "".join(f", {c} binary" for c in names)
        routed_schema, out = (to_arrow_schema(_parse_datatype_string(x)) for x in (routed, schema))

        def run(key, left, right):
            made, found = [], {}
            for i in range(right.num_rows):
                found.setdefault(right.column("side")[i].as_py(), []).append({c: right.column(c)[i].as_py() for c in ("home", "at", "places", *names)})
            for row in left.to_pylist():
                part = {"n": len(row["x"]) // 8} | {c: row[c] for c in ("part", "g", "u_n", "b_n", "u_ids", "b_ids") if c in row}
                part |= {c: np.frombuffer(row[c], kind) for c, kind in (("u", "<i4"), ("b", "<i4"), ("x", "<f8"), ("train", "<i8"), ("test", "<i8"))}
                sides = {}
                for side in SIDES:
                    n, known = row[f"{side}_n"], np.zeros(row[f"{side}_n"], dtype=bool)
                    own = {"slices": []}
                    for r in found.get(side, ()):
                        at = unsqueezed(r["at"])
                        known[at] = True
                        own["slices"].append((r["home"], at, r["places"]))
                        for c in names:
                            values = np.frombuffer(r[c], "u1").reshape(len(at), -1)
                            if c not in own:
                                own[c] = np.zeros((n, values.shape[1]), dtype="u1")
                            own[c][at] = values
                    if own["slices"]:
                        sides[side] = own
                    if not known.all():
                        part[side] = np.where(known[part[side]], part[side], np.int32(-1))
                made += f(part, sides)
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(out), out.types, strict=True)], schema=out)

        moved = sent.join(self.routing.drop("bytes"), "home").select("home", "n", "routes", *names).mapInArrow(send, routed)
        return self.parts.groupBy("part").cogroup(moved.groupBy("part")).applyInArrow(run, schema)

    def close(self) -> None:
        self.parts.unpersist()
        if "rows" in self.held:
            self.held["rows"].unpersist()


def in_lists(rows: DataFrame) -> bool:
    """Whether b (and x) of ``rows`` are arrays, a row being several of one user."""
    return isinstance(rows.schema["b"].dataType, ArrayType)


def lay_out(rows: DataFrame, known: DataFrame, doubles: int, grid: tuple[int, int] | None = None, part_rows: int | None = None) -> Layout:
    """Lay out ``rows`` (g, u, b, x, train, test) for matrices of ``doubles`` numbers for each id of ``known`` (g, side, id).

    ``train`` and ``test`` are bit fields: which problems of the group the row belongs to. ``grid``: the earlier one,
    where an earlier run's homes are to be read. ``part_rows``: rows of a part, where fewer than usual. A row may be a list, b and x being arrays; lists are dealt whole.
    """
    lists = in_lists(rows)
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    side_of = F.when(F.col("side") == "u", 0).otherwise(1).cast("long")
    per_home = grid[0] if grid else max(1, HOME_BYTES // (8 * doubles))
    numbered = in_blocks(known.select("g", "side", "id").distinct().withColumn("n", F.lit(1).cast("long")), per_home, ("g", "side", "id"))
    width = 1 + (numbered.agg(F.max("block")).first()[0] or 0)
    ranges = numbered.groupBy(((F.col("g").cast("long") * 2 + side_of) * width + F.col("block")).alias("home"), "side", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    homes = materialize(ranges, "homes")
    cuts: dict[tuple[int, str], list] = {}
    for r in homes.select("g", "side", "home", F.col("ids")[0].alias("first")).orderBy("home").collect():  # a row for each HOME_BYTES of a matrix
        cuts.setdefault((r["g"], r["side"]), []).append((r["home"], r["first"]))
    cuts = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in cuts.items()}

    most = max(1, min(PART_ROWS, part_rows or PART_ROWS, PART_BYTES // (8 * doubles)))
    users = materialize(rows.groupBy("g", "u").agg((F.sum(F.size("b").cast("long")) if lists else F.count("*")).alias("n")), "rows-of-users")
    total = users.agg(F.sum("n")).first()[0] or 0
    blocks = in_blocks(users, max(1, min(most, -(-total // tasks))), ("g", "u"))
    count = 1 + (blocks.agg(F.max("block")).first()[0] or 0)
    sizes = materialize(blocks.join(users, ["g", "u"]).groupBy("g", "block").agg(F.ceil(F.sum("n") / most).alias("slices")), "slices")
    placed = rows.join(small(blocks, 24), ["g", "u"]).join(small(sizes, 24), ["g", "block"])
    # a user's rows stay together unless they alone fill a part
    dealt = placed.withColumn("part", (F.col("g").cast("long") * count + F.col("block")) * SLICES + F.pmod(F.xxhash64("u", "b"), "slices"))

    def pack(t: pa.Table) -> pa.Table:
        if lists:
            t = unlisted(t)
        ids, at = zip(*(np.unique(t.column(s).to_numpy(), return_inverse=True) for s in SIDES), strict=True)
        order = np.lexsort((at[1], at[0]))
        arrays = [*(i.astype("<i8") for i in ids), *(a[order].astype("<i4") for a in at), t.column("x").to_numpy()[order].astype("<f8"), *(t.column(c).to_numpy()[order].astype("<i8") for c in ("train", "test"))]
        one = [(t.column("part")[0].as_py(), pa.int64()), (t.column("g")[0].as_py(), pa.int32()), *((len(i), pa.int32()) for i in ids)]
        return pa.Table.from_arrays([*(pa.array([v], k) for v, k in one), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["part", "g", "u_n", "b_n", "u_ids", "b_ids", "u", "b", "x", "train", "test"])

    shape = "part long, g int, u_n int, b_n int, u_ids binary, b_ids binary, u binary, b binary, x binary, train binary, test binary"
    packed = materialize(dealt.select("part", "g", "u", "b", "x", "train", "test").groupBy("part").applyInArrow(pack, shape), "parts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretch of a part's ids that lies in a home's range, for each home."""
        for batch in batches:
            for i in range(batch.num_rows):
                part, g = batch.column("part")[i].as_py(), batch.column("g")[i].as_py()
                for side in SIDES:
                    if (g, side) not in cuts:
                        continue
                    ids, (numbers, firsts) = np.frombuffer(batch.column(f"{side}_ids")[i].as_py(), "<i8"), cuts[g, side]
                    ends = [*np.searchsorted(ids, firsts[1:]).tolist(), len(ids)]
                    for home, low, high in zip(numbers.tolist(), [0, *ends], ends, strict=False):
                        if low < high:
                            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (home, part, low, ids[low:high].tobytes())], ["home", "part", "low", "ids"])

    route = pa.list_(pa.struct([("part", pa.int64()), ("at", pa.binary()), ("places", pa.binary())]))

    def answer(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["home", "n", "bytes", "routes"]
        types = [pa.int64(), pa.int32(), pa.int64(), route]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        own, routes = left.column("ids").combine_chunks().flatten().to_numpy(), []
        for r in right.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            places = np.minimum(np.searchsorted(own, ids), len(own) - 1)
            there = np.flatnonzero(own[places] == ids)
            if len(there):
                routes.append({"part": r["part"], "at": squeezed(r["low"] + there), "places": squeezed(places[there])})
        size = sum(16 + len(r["at"]) + len(r["places"]) for r in routes)
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip((key[0].as_py(), len(own), size, routes), types, strict=True)], names=names)

    asked = packed.select("part", "g", "u_ids", "b_ids").mapInArrow(ask, "home long, part long, low long, ids binary")
    routing = homes.select("home", "ids").groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(answer, "home long, n int, bytes long, routes array<struct<part: long, at: binary, places: binary>>")
    routing = materialize(routing, "routing")
    parts = packed.drop("u_ids", "b_ids").repartition(max(tasks, 2 * packed.count()), "part").sortWithinPartitions("part").persist(StorageLevel.MEMORY_AND_DISK)
    return Layout(homes, parts, small(routing, F.col("bytes")), width, (per_home, width), packed)


def unlisted(t: pa.Table) -> pa.Table:
    """A row for each member of the arrays b and x."""
    b, x = (t.column(c).combine_chunks() for c in "bx")
    of = np.repeat(np.arange(t.num_rows), b.value_lengths().to_numpy(zero_copy_only=False))
    each = t.select([c for c in t.column_names if c not in ("b", "x")]).take(pa.array(of))
    return each.append_column("b", b.flatten()).append_column("x", x.flatten())


def starts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each run, its place) of sorted places."""
    first = np.flatnonzero(np.diff(places, prepend=places[0] - 1)) if len(places) else np.zeros(0, dtype=np.int64)
    return first, places[first]


def add_runs(out: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """out[place] += the sum of ``values`` (rows) of that place, for places from 0 on, in any order."""
    if len(places) and np.any(places[1:] < places[:-1]):
        order = np.argsort(places, kind="stable")
        places, values = places[order], values[order]
    skip = int(np.searchsorted(places, 0))
    places, values = places[skip:], values[skip:]
    if len(places):
        first, at = starts(places)
        out[at] += np.add.reduceat(values, first, axis=0)


def rows_of(matrix: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of a matrix at places, zeros for -1."""
    if not len(matrix):
        return np.zeros((len(places), matrix.shape[1]))
    found = matrix[places]
    if len(places) and places.min() < 0:
        found[places < 0] = 0
    return found
