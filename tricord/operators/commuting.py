"""Similarity of users and items: a base path blended with a motif, through the user-item relation, top K.

Blends are exact: with alpha = step / 10 the integer ``(10 - step) * base + step * motif`` is ranked
and only the score divided. A product with the relation is linear in the blend, so each of the two
parts is multiplied once and all eleven steps are made from these. ``scores`` and ``top_k`` are joins with a row for
each cell; ``product_top_k`` takes the best of a block of users where their sums are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricord.plans.storage import materialize, small

from .motifs import MOTIFS, motif_matrix
from .prep import in_blocks
from .sparse import add, multiply, scale, transpose

STEPS = tuple(range(11))
PATHS = ("UUB", "UBUB")
TOP_K = 500


def relation(train: DataFrame) -> DataFrame:
    """Distinct (user, item) pairs as a 0/1 matrix."""
    return train.select(F.col("u").alias("i"), F.col("b").alias("j")).distinct().withColumn("w", F.lit(1).cast("long"))


def base_matrix(path: str, trust: DataFrame, train: DataFrame) -> DataFrame:
    """``UUB``: the trust edges; ``UBUB``: items rated in common, the diagonal included."""
    if path == "UUB":
        return trust.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1).cast("long").alias("w"))
    if path == "UBUB":
        r = relation(train)
        return multiply(r, transpose(r))
    raise ValueError(f"no base path {path!r}; there are UUB and UBUB")


def blend(base: DataFrame, motif: DataFrame, step: int) -> DataFrame:
    """Ten times (1 - step / 10) * base + step / 10 * motif, in integers."""
    if step not in STEPS:
        raise ValueError(f"alpha goes in steps of 0 to 10, not {step!r}")
    return add(scale(base, F.lit(10 - step)), scale(motif, F.lit(step))).where("w <> 0")


def scores(base: DataFrame, motif: DataFrame, train: DataFrame, step: int) -> DataFrame:
    """(u, b, w): ten times the blended score of every user and item that has one."""
    return multiply(blend(base, motif, step), relation(train)).select(F.col("i").alias("u"), F.col("j").alias("b"), "w")


def top_k(scored: DataFrame, k: int = TOP_K, keys: tuple[str, ...] = ("u",)) -> DataFrame:
    """The k largest positive scores of each key, ties by item: (.., b, score, rn)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("w"), "b"))
    return scored.where("w > 0").withColumn("rn", rank).where(F.col("rn") <= k).select(*keys, "b", (F.col("w") / 10).alias("score"), "rn")


#: Bytes of item lists that a task holds at once, items in the lists that a block of users is sent (apart from tiles of R.R'), and
#: items whose sums over all raters are kept as one array.
SUM_BYTES, ITEMS, PACK = 256 << 20, 1 << 22, 256
#: Sums of the tiles of R.R' that a block of users makes.
TILE_SUMS = 1 << 28


def dealt(train: DataFrame, weights: DataFrame, co_rated: bool = False) -> DataFrame:
    """(block, kind, id, items, to): what each block of users needs. Its users (kind 0, with their items where ``co_rated``), and
    the items of the users on which it has weights, and of those it has items in common with, each once (kind 1), ``to`` being the weights."""
    tasks = max(1, train.sparkSession.sparkContext.defaultParallelism)
    # a set each, moved once: pairs seldom repeat, so neither they nor a user's items are gathered before
    pairs = train.select(F.col("u").alias("v"), F.col("b").alias("j")).repartition("v")
    rows = materialize(pairs.groupBy("v").agg(F.sort_array(F.collect_set("j")).alias("items")), "rows")
    lengths = rows.select("v", F.size("items").cast("long").alias("n"))
    work = weights.select("i", F.col("j").alias("v")).join(lengths, "v").groupBy(F.col("i").alias("u")).agg(F.sum("n").alias("n"))
    if co_rated:
        each = rows.select("v", F.explode("items").alias("b"))
        n, tiles = rows.agg(F.sum(F.size("items")), F.count("*")).first(), each.groupBy("b").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
        blocks = max(4 * tasks, int((tiles or 0) * (n[0] or 0) / max(1, n[1]) / TILE_SUMS), (n[0] or 0) // max(1, ITEMS))
        users = work.select("u", F.lit(0).cast("long").alias("n")).union(lengths.select("v", "n")).groupBy("u").agg(F.sum("n").alias("n"))
        users = in_blocks(users, max(1, (n[0] or 0) // blocks))
    else:
        work = materialize(work, "work")
        users = in_blocks(work, max(1, min(ITEMS, (work.agg(F.sum("n")).first()[0] or 0) // (4 * tasks))))
    users = small(users, 16)
    to = F.struct("i", F.col("layer").cast("int").alias("layer"), F.col("w").cast("long").alias("w"))
    wanted = weights.join(users.withColumnRenamed("u", "i"), "i").select("block", F.col("j").alias("v"), to.alias("to"))
    if co_rated:
        # the blocks of an item's raters, all of which need the items of each of these
        raters = each.join(users.withColumnRenamed("u", "v"), "v").groupBy("b").agg(F.collect_set("block").alias("blocks"), F.collect_list("v").alias("vs"))
        near = raters.select(F.explode("vs").alias("v"), "blocks").groupBy("v").agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
        wanted = wanted.unionByName(near.select(F.explode("blocks").alias("block"), "v", F.lit(None).cast("struct<i:bigint,layer:int,w:bigint>").alias("to")))
    sent = wanted.groupBy("block", "v").agg(F.collect_list("to").alias("to")).join(rows, "v").select("block", F.lit(1).alias("kind"), F.col("v").alias("id"), "items", "to")
    own = users.join(rows.withColumnRenamed("v", "u"), "u", "left") if co_rated else users.withColumn("items", F.lit(None).cast("array<bigint>"))
    heads = own.select("block", F.lit(0).alias("kind"), F.col("u").alias("id"), "items", F.lit(None).cast("array<struct<i:bigint,layer:int,w:bigint>>").alias("to"))
    return heads.unionByName(sent)


def product_top_k(train: DataFrame, weights: DataFrame, combinations: dict[tuple, dict[int, int]], layers: int, k: int = TOP_K, co_rated: bool = False, lists: bool = False) -> DataFrame:
    """The k best items of each user for each combination of layers: (c, u, b, w, rn), c the combination's place; with ``lists`` (c, u, b, w), arrays of a user's items, best first.

    ``weights`` are sparse matrices (layer, i, j, w) of user pairs; layer by layer they are multiplied with the
    relation, and a combination is a sum of products with integer factors. With ``co_rated`` layer 0 also has R.R',
    items rated in common, which is never made: a block has the lists of all users near it, and a user's row of R.R' is used as it comes.

    No cell of a product is a row: a user's items travel as one array, once to each block of users that needs them, and the
    sums of one user at a time stand in a task's memory until the k best are taken. What a task does grows with the
    terms of the sums, not with users times items.
    """
    weights = materialize(weights.where("w <> 0"), "weights")
    every = dealt(train, weights, co_rated)
    parts = max(2 * train.sparkSession.sparkContext.defaultParallelism, int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = every.repartition(parts, "block").sortWithinPartitions("block", "kind")
    factors = np.zeros((len(combinations), layers), dtype=np.int64)
    for c, mix in enumerate(combinations.values()):
        for layer, factor in mix.items():
            factors[c, layer] = factor
    limit, hot = SUM_BYTES, PACK

    def run(batches):
        at = None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if at is None or at.key != blocks[low]:
                    if at is not None:
                        yield from at.best(factors, k, lists)
                    at = _Block(blocks[low], layers, co_rated, limit, hot)
                at.take(batch.slice(low, high - low))
        if at is not None:
            yield from at.best(factors, k, lists)

    return every.mapInArrow(run, "c int, u long, b array<bigint>, w array<bigint>" if lists else "c int, u long, b long, w long, rn int")


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each span of length n, one span after another."""
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


class _Block:
    """A block of users in a task: the lists it was sent, from which the sums of one user after another are made.

    Lists of over ``limit`` bytes are used in several parts; only then the sums of all of the block's users are kept meanwhile.
    """

    def __init__(self, key: int, layers: int, co_rated: bool, limit: int, hot: int):
        self.key, self.layers, self.co_rated, self.limit, self.hot = key, layers, co_rated, limit, hot
        self.heads, self.lists, self.held, self.kept = [], [], 0, None

    def take(self, rows) -> None:
        kind = rows.column("kind").to_numpy()
        n = int(np.searchsorted(kind, 1))
        for part, to in ((rows.slice(0, n), self.heads), (rows.slice(n), self.lists)):
            if not part.num_rows:
                continue
            lengths = lambda c: np.nan_to_num(part.column(c).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)  # noqa: B023, E731
            items = part.column("items").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            found = [part.column("id").to_numpy(), lengths("items"), items]
            if to is self.lists:
                flat = part.column("to").flatten()
                found += [lengths("to"), *(flat.field(f).to_numpy(zero_copy_only=False) for f in ("i", "layer", "w"))]
                self.held += items.nbytes
            to.append(found)
        if self.held > self.limit:
            self._keep()

    def _keep(self) -> None:
        """Use the lists that are here."""
        kept = self.kept or {}
        for u, items, sums in self._sums():
            if u in kept:
                every, at = np.unique(np.concatenate((kept[u][0], items)), return_inverse=True)
                both = np.zeros((self.layers, len(every)), dtype=np.int64)
                both[:, at[: len(kept[u][0])]] += kept[u][1]
                both[:, at[len(kept[u][0]) :]] += sums
                kept[u] = every, both
            else:
                kept[u] = items, sums
        self.kept, self.lists, self.held = kept, [], 0

    def _sums(self):
        """(user, items, sums (layer, item)) of the lists that are here."""
        if not self.lists:
            return
        users, own, own_items = (np.concatenate(x) for x in zip(*self.heads, strict=True))
        _, n, items, n_to, i, layer, w = (np.concatenate(x) for x in zip(*self.lists, strict=True))
        names, items = np.unique(items, return_inverse=True)
        start = np.cumsum(n) - n
        # the weights, user by user
        order = np.argsort(i, kind="stable")
        of, layer, w, i = np.repeat(np.arange(len(n)), n_to)[order], layer[order].astype(np.int64), w[order], i[order]
        low, high = np.searchsorted(i, users, "left"), np.searchsorted(i, users, "right")
        if self.co_rated:
            order = np.argsort(items, kind="stable")
            raters, ends = np.repeat(np.arange(len(n)), n)[order], np.concatenate(([0], np.cumsum(np.bincount(items, minlength=len(names)))))
            terms = np.bincount(items, weights=np.repeat(n, n), minlength=len(names))  # of an item's sums over its raters
            many, hot = max(1, min(self.hot, self.limit // (8 * max(1, len(names))))), {}
        here, place, own_start = np.zeros(len(names), dtype=bool), np.zeros(len(names), dtype=np.int64), np.cumsum(own) - own
        for x in range(len(users)):
            lists, layers, factor, whole = of[low[x] : high[x]], layer[low[x] : high[x]], w[low[x] : high[x]], None
            if self.co_rated and own[x]:
                mine = own_items[own_start[x] : own_start[x] + own[x]]
                at = np.minimum(np.searchsorted(names, mine), len(names) - 1)
                at = at[names[at] == mine]
                for b in at[terms[at] > 4 * len(names)].tolist():
                    if b not in hot:
                        if len(hot) >= many:
                            hot.pop(next(iter(hot)))
                        hot[b] = self._added(raters[ends[b] : ends[b + 1]], items, start, n, len(names))
                    whole = hot[b] + (0 if whole is None else whole)
                at = at[terms[at] <= 4 * len(names)]
                near = raters[_spans(ends[at], ends[at + 1] - ends[at])]
                lists = np.concatenate((lists, near))
                layers, factor = (np.concatenate((a, np.full(len(near), v, dtype=np.int64))) for a, v in ((layers, 0), (factor, 1)))
            if not len(lists) and whole is None:
                continue
            m = n[lists]
            found = items[_spans(start[lists], m)]
            here[found] = True
            if whole is not None:
                here |= whole > 0
            some = np.flatnonzero(here)
            here[some] = False
            place[some] = np.arange(len(some))
            cells = place[found]
            if len(layers) and layers.any():
                cells += np.repeat(layers, m) * len(some)
            # sums of integers, exact in doubles below 2^53
            sums = np.bincount(cells, weights=np.repeat(factor, m), minlength=self.layers * len(some)).astype(np.int64).reshape(self.layers, len(some))
            if whole is not None:
                sums[0] += whole[some]
            yield int(users[x]), names[some], sums

    @staticmethod
    def _added(lists: np.ndarray, items: np.ndarray, start: np.ndarray, n: np.ndarray, size: int, at_once: int = 1 << 16) -> np.ndarray:
        total = np.zeros(size, dtype=np.int64)
        for i in range(0, len(lists), at_once):
            part = lists[i : i + at_once]
            total += np.bincount(items[_spans(start[part], n[part])], minlength=size)
        return total

    def best(self, factors: np.ndarray, k: int, lists: bool = False):
        """The k largest positive sums of each user for each combination, ties by item."""
        batch = self._lists if lists else self._batch
        if self.kept is not None:
            self._keep()
            found = ((u, *x) for u, x in self.kept.items())
        else:
            found = self._sums()
        mixes = [(np.flatnonzero(f), f[np.flatnonzero(f)]) for f in factors]
        made, held = [], 0
        for u, items, sums in found:
            for c, (layers, f) in enumerate(mixes):
                w = f[0] * sums[layers[0]] if len(layers) else np.zeros(len(items), dtype=np.int64)
                for layer, x in zip(layers[1:], f[1:], strict=True):
                    w = w + x * sums[layer]
                if len(w) > k:  # all that reach the k-th score, of which the sort then takes the first k
                    top = np.flatnonzero(w >= max(1, -np.partition(-w, k - 1)[k - 1]))
                else:
                    top = np.flatnonzero(w > 0)
                top = top[np.argsort(-w[top], kind="stable")[:k]]
                if len(top):
                    made.append((c, u, items[top], w[top]))
                    held += len(top)
            if held > 1 << 17:
                yield batch(made)
                made, held = [], 0
        if made:
            yield batch(made)

    @staticmethod
    def _batch(made: list) -> pa.RecordBatch:
        n = np.array([len(x[2]) for x in made])
        columns = [np.repeat(np.array([x[0] for x in made], dtype=np.int32), n), np.repeat(np.array([x[1] for x in made], dtype=np.int64), n), np.concatenate([x[2] for x in made]), np.concatenate([x[3] for x in made]), (_spans(np.ones(len(n), dtype=np.int64), n)).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["c", "u", "b", "w", "rn"])

    @staticmethod
    def _lists(made: list) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(len(x[2]) for x in made)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[c] for x in made]))) for c in (2, 3)]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.int64()), *lists], ["c", "u", "b", "w"])


def commuting(path: str, motif: str, step: int, trust: DataFrame, train: DataFrame, k: int = TOP_K) -> DataFrame:
    """The similarity relation of ``path`` blended with ``motif``: (u, b, score, rn)."""
    if motif not in MOTIFS:
        raise ValueError(f"no motif {motif!r}")
    if step not in STEPS:
        raise ValueError(f"alpha goes in steps of 0 to 10, not {step!r}")
    if path not in PATHS:
        raise ValueError(f"no base path {path!r}; there are UUB and UBUB")
    # at the ends of the range one of the parts has weight 0 and needn't be made
    weights = layer_of(motif_matrix(trust, motif), 1) if step else None
    if path == "UUB" and step < 10:
        base = layer_of(base_matrix(path, trust, train), 0)
        weights = base if weights is None else base.unionByName(weights)
    if weights is None:
        weights = layer_of(base_matrix("UUB", trust, train).limit(0), 0)
    found = product_top_k(train, weights, {(motif, step): {0: 10 - step, 1: step}}, 2, k, path == "UBUB" and step < 10)
    return found.select("u", "b", (F.col("w") / 10).alias("score"), "rn")


def layer_of(matrix: DataFrame, layer: int) -> DataFrame:
    return matrix.select(F.lit(layer).alias("layer"), "i", "j", F.col("w").cast("long").alias("w"))


def sweep(motifs: DataFrame, path: str, trust: DataFrame, train: DataFrame, k: int = TOP_K, names: tuple[str, ...] = MOTIFS, wanted: set[tuple[str, int]] | None = None, lists: bool = False) -> DataFrame:
    """All motifs of ``motifs`` (motif, i, j, w) and all steps, or the ``wanted`` (motif, step), in one plan: (motif, alpha_step, u, b, score, rn).

    A motif of ``names`` without triangles has the base's similarities alone. The base and the motifs are
    layers of one product: what moves is a user's items, once to each block of users, whatever the number of motifs and steps.
    With ``lists`` a row is a user's whole list: (motif, alpha_step, u, b, score), b and score being arrays, best first.
    """
    place = F.coalesce(*[F.when(F.col("motif") == m, F.lit(x + 1)) for x, m in enumerate(names)])
    weights = motifs.where(F.col("motif").isin(*names)).select(place.alias("layer"), "i", "j", "w")
    if path == "UUB":
        weights = weights.unionByName(layer_of(base_matrix(path, trust, train), 0))
    elif path != "UBUB":
        raise ValueError(f"no base path {path!r}; there are UUB and UBUB")
    points = {(m, s): {0: 10 - s, x + 1: s} for x, m in enumerate(names) for s in STEPS if wanted is None or (m, s) in wanted}
    found = product_top_k(train, weights, points, 1 + len(names), k, path == "UBUB", lists)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("c") + 1)
    score = [F.transform("w", lambda w: w / 10).alias("score")] if lists else [(F.col("w") / 10).alias("score"), "rn"]
    return found.select(of([m for m, _ in points]).alias("motif"), of([step for _, step in points]).cast("int").alias("alpha_step"), "u", "b", *score)
