"""N-gram Jaccard self-join with a count-vector R-tree, and its connected components.

Every text is a set of hashed shingles. Two sets A, B with sizes a, b reach the Jaccard
threshold p/100 only if their symmetric difference is at most (100 - p)(a + b) / (100 + p).

1. *Groups.* Shingles are hashed into the groups of the text's size class (powers of two; a
   text near a class's upper end also takes part in the next class). A differing shingle
   changes one group, so with D the largest difference any partner allows, any D + 1 non-empty
   groups of a text hold one whose content is the same in the partner. Each text emits
   D + 1 group contents as keys, fullest groups first (the same order for every text).
2. *Hubs.* Under each key the set with the least print is a hub. Each set goes once to the hub that it meets most
   often; sets of one hub are searched in tiles that all hold the hub, and what links is contracted.
3. *Keys.* Keys whose members still lie in several components are searched in full, by points of group counts alone,
   as a long text has many keys. Members of the largest component need not meet each other, so of a key with more than
   one tile they go to the tiles of the other members only. Pairs that come out are verified by a join of the whole sets.

A tile is searched with an R-tree of its points of group counts, packed by size: a node or point is dropped
where the summed coordinate minima cannot reach the overlap that the sizes ask for. Pairs of one component are passed over.
At a hub that holds for components that have just arisen too, so a tile returns a spanning forest of its
links. Under a key, a tile of many points first returns a spanning forest of its pairs; what this leaves in several components
is searched again and then returned whole.

Sets are compared by 64-bit hashes of shingles and told apart by prints of 128 bits. Exact copies are one point throughout.

Nulls, empty and blank texts have no shingles and link with nothing. Rows with a null id count
as texts but give no component id; a component of such rows only has a null id. Repeated ids are separate rows.
Columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import components, drop, keep
from pagewright.llm.shingles import mix, shingle_sets

#: Sets that a tile holds, and shingles of them together.
TILE = 2048
TILE_SHINGLES = 1 << 21
FANOUT = 32
#: Points up to which a tile returns all pairs at once.
FEW = 64


def most_difference(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def group_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set of hashes, such that sets that link share one."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    largest = 100 * n // percent
    need = most_difference(n, largest, percent) + 1
    out = []
    for c in range(n.bit_length(), largest.bit_length() + 1):
        top = (1 << c) - 1
        groups = most_difference(top, 100 * top // percent, percent) + 1
        groups += max(4, groups // 8)
        g = (h >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        content = np.add.reduceat(mix(h), at)
        key = mix(content + (g[at] * np.uint64(64) + np.uint64(c)) * np.uint64(0x9E3779B97F4A7C15))
        if len(at) > need:
            counts = np.diff(np.append(at, n))
            key = key[np.argsort(-counts, kind="stable")[:need]]
        elif len(at) < need:  # all groups may differ; such texts meet here
            key = np.append(key, mix(np.array([c], np.uint64)))
        out.append(key)
    return np.concatenate(out)


def count_vector(h: np.ndarray) -> np.ndarray:
    """Group counts; one to two groups a shingle, 16 to 16384 groups."""
    groups = 1 << min(14, max(4, len(h).bit_length()))
    counts = np.bincount((h & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u2" if len(h) < 1 << 16 else "<u4")


def prints_of(h: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set, as two signed 64-bit numbers."""
    m = mix(h)
    both = np.array([m.sum(dtype=np.uint64), (m * (m >> np.uint64(7))).sum(dtype=np.uint64)]) + np.uint64(len(h))
    one, two = mix(both).view(np.int64).tolist()
    return one, two


def profiled(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            sets = list(shingle_sets(part.column("text"), size))
            one, two = zip(*map(prints_of, sets), strict=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "hash": part.column("hash"),
                    "n": pa.array([len(h) for h in sets], pa.int64()),
                    "fp": pa.array(one, pa.int64()),
                    "more": pa.array(two, pa.int64()),
                    "keys": pa.array([group_keys(h, percent).view(np.int64) for h in sets], pa.list_(pa.int64())),
                }
            )


def whole_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The sets of the texts, one for each fp that a task gets; a text with other prints only shares its id and is left out."""
    seen: set[int] = set()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            fps, one, two = (part.column(c).to_pylist() for c in ("fp", "one", "more"))
            own, sets = [], []
            for k, h in enumerate(shingle_sets(part.column("text"), size)):
                if fps[k] not in seen and prints_of(h) == (one[k], two[k]):
                    seen.add(fps[k])
                    own.append(k)
                    sets.append(h.view(np.int64))
            vectors = [count_vector(h.view(np.uint64)) for h in sets]
            kept = part.select(["fp", "key", "tile"]).take(pa.array(own, pa.int64()))
            kept = kept.append_column("n", pa.array([len(h) for h in sets], pa.int64()))
            kept = kept.append_column("vec", pa.array([v.tobytes() for v in vectors], pa.binary()))
            kept = kept.append_column("width", pa.array([v.itemsize for v in vectors], pa.int32()))
            yield kept.append_column("items", pa.array(sets, pa.list_(pa.int64())))


class CountRTree:
    """Points of group counts in the order of their sizes; an inner node holds the maxima and the sizes' range below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fanout: int = FANOUT):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][1]) > fanout:
            maxima, least, most = self.levels[-1]
            at = np.arange(0, len(least), fanout)
            self.levels.append((np.maximum.reduceat(maxima, at), least[at], np.maximum.reduceat(most, at)))
        self.fanout = fanout

    def reach(self, x: int, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Places among the ``wanted`` (a mask) that point x may link with; every linked one is among them."""
        point, size = self.levels[0][0][x], self.levels[0][1][x]
        if np.count_nonzero(wanted) <= self.fanout:
            return self._bounded(0, np.flatnonzero(wanted), point, size, percent)
        level = len(self.levels) - 1
        nodes = np.arange(len(self.levels[level][1]))
        while level:
            nodes = self._bounded(level, nodes, point, size, percent)
            level -= 1
            nodes = (nodes[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            nodes = nodes[nodes < len(self.levels[level][1])]
        return self._bounded(0, nodes[wanted[nodes]], point, size, percent)

    def _bounded(self, level: int, nodes: np.ndarray, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        maxima, least, most = self.levels[level]
        nodes = nodes[(100 * most[nodes] >= percent * size) & (100 * size >= percent * least[nodes])]
        overlap = np.minimum(maxima[nodes], point).sum(axis=1, dtype=np.int64)
        return nodes[(100 + percent) * overlap >= percent * (size + least[nodes])]


def _points(arrays: list[np.ndarray]) -> np.ndarray:
    """Count vectors folded to the fewest groups that any of them has."""
    groups = min(map(len, arrays))
    folded = [v.reshape(-1, groups).sum(axis=0) if len(v) > groups else v for v in arrays]
    most = max(int(v.max()) for v in folded)
    return np.stack(folded).astype("u1" if most < 256 else "u2" if most < 1 << 16 else "u4")


class Meeting:
    """Which places of a tile still have to meet: those of different groups, and of different sides or of side 0."""

    def __init__(self, comps: np.ndarray, sides: np.ndarray):
        self.group = np.unique(comps, return_inverse=True)[1]
        self.sides = sides
        self.open = np.ones(len(sides), bool)

    def partners(self, x: int) -> np.ndarray:
        """Those of place x; it is not given to others any more."""
        self.open[x] = False
        return self.open & (self.group != self.group[x]) & ((self.sides != self.sides[x]) | (self.sides == 0))

    def join(self, x: int, places: np.ndarray) -> list[int]:
        """The places that bring a new group to that of x."""
        new = []
        for y in places.tolist():
            if self.group[y] != self.group[x]:
                self.group[self.group == self.group[y]] = self.group[x]
                new.append(y)
        return new


def spanning_links(sets: list[np.ndarray], comps: list[int], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """Places of linked pairs that, beside the given components, span all links of a tile.

    Sets of side -1 meet those of side 1 only, those of side 0 meet all.
    """
    sizes = np.array([len(h) for h in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[k] for k in order], sizes[order]
    meeting = Meeting(np.array(comps)[order], np.array(sides)[order])
    tree = CountRTree(_points([count_vector(h) for h in sets]), sizes) if len(sets) > 4 else None
    links = []
    for x, own in enumerate(sets):
        meets = meeting.partners(x)
        if not meets.any():
            continue
        near = np.flatnonzero(meets) if tree is None else tree.reach(x, percent, meets)
        near = near[100 * sizes[x] >= percent * sizes[near]]
        if not len(near):
            continue
        items = np.concatenate([sets[y] for y in near])
        held = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
        common = np.add.reduceat(held, np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        linked = near[100 * common >= percent * (sizes[x] + sizes[near] - common)]
        links += [(int(order[x]), int(order[y])) for y in meeting.join(x, linked)]
    return links


def reachable_pairs(
    vectors: list[np.ndarray], sizes: list[int], comps: list[int], sides: list[int], percent: int, whole: bool
) -> tuple[list[tuple[int, int]], bool]:
    """Places of pairs that may link, and whether these are all; if not ``whole``, they only span what may link."""
    order = np.argsort(sizes, kind="stable")
    meeting = Meeting(np.array(comps)[order], np.array(sides)[order])
    tree = CountRTree(_points([vectors[k] for k in order]), np.array(sizes)[order])
    pairs = []
    for x in range(len(order)):
        meets = meeting.partners(x)
        if meets.any():
            near = tree.reach(x, percent, meets)
            pairs += [(int(order[x]), int(order[y])) for y in (near.tolist() if whole else meeting.join(x, near))]
    return pairs, whole or not pairs


def _tiles_of(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[int, list[tuple]]]:
    """(key, members) of every tile; rows come sorted by (key, t, u). Members are (payload, n, width, component, side, fp), each fp once."""
    last: tuple | None = None
    tile: dict[int, tuple] = {}
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in ("key", "t", "u")), strict=True)
        facts = zip(*(batch.column(c).to_pylist() for c in ("n", "width", "component", "side", "fp")), strict=True)
        column = batch.column(payload)
        if payload == "items":
            values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            payloads = (values[x:y] for x, y in zip(offsets, offsets[1:], strict=False))
        else:
            payloads = iter(column.to_pylist())
        for name, fact, own in zip(names, facts, payloads, strict=True):
            if name != last:
                if len(tile) > 1:
                    yield last[0], list(tile.values())
                last, tile = name, {}
            tile[fact[-1]] = own, *fact
    if len(tile) > 1:
        yield last[0], list(tile.values())


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 1 << 14)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)


def linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b): fps that span the links of each tile, by whole sets."""

    def rows() -> Iterator[tuple]:
        for _, tile in _tiles_of(batches, "items"):
            sets, _, _, comps, sides, fps = map(list, zip(*tile, strict=True))
            for i, j in spanning_links(sets, comps, sides, percent):
                yield fps[i], fps[j]

    return _batches(rows(), ["a", "b"])


def reached(batches: Iterator[pa.RecordBatch], percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, ca, cb, null) of fps that may link, with their components, and (null.., key) of keys that have more of them."""

    def rows() -> Iterator[tuple]:
        for key, tile in _tiles_of(batches, "vec"):
            vectors, sizes, widths, comps, sides, fps = map(list, zip(*tile, strict=True))
            vectors = [np.frombuffer(v, f"<u{w}") for v, w in zip(vectors, widths, strict=True)]
            pairs, complete = reachable_pairs(vectors, sizes, comps, sides, percent, whole or len(tile) <= FEW)
            for i, j in pairs:
                i, j = (i, j) if fps[i] < fps[j] else (j, i)
                yield fps[i], fps[j], comps[i], comps[j], None
            if not complete:
                yield None, None, None, None, key

    return _batches(rows(), ["a", "b", "ca", "cb", "key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (ca, cb) of those pairs (a, b, ca, cb) whose whole sets reach the threshold. JVM only."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    common = F.size(F.array_intersect("ia", "ib"))
    near = pairs.join(right, "b").join(left, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("ca", "cb").distinct()


def distinct_prints(profile: DataFrame) -> DataFrame:
    """The profile with one fp for each 128-bit print: where 64 bits are shared, all but one print get another number."""
    shared = profile.groupBy("fp").agg(F.min("more").alias("lo"), F.max("more").alias("hi")).where("lo < hi")
    shared = keep(shared.select("fp", "lo"), "shared")
    if shared.isEmpty():
        drop(shared)
        return profile
    other = F.when(F.col("more") != F.col("lo"), F.xxhash64("fp", "more")).otherwise(F.col("fp"))
    return keep(profile.join(shared, "fp", "left").withColumn("fp", other).drop("lo"), "profile")


def texts_of(base: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the text of a row that has its id and hash. Texts without an id are taken once each."""
    named = base.where("id is not null").join(chosen.where("id is not null"), ["id", "hash"])
    if chosen.where("id is null").isEmpty():
        return named
    nameless = base.where("id is null").select("hash", "text").distinct().join(chosen.where("id is null"), "hash")
    return named.unionByName(nameless)


def _tiles(count: str, shingles: str) -> Column:
    return F.ceil(F.greatest(F.col(count) / TILE, F.col(shingles) / TILE_SHINGLES)).cast("int")


def _by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u")


def _under_keys(rows: DataFrame, sets: DataFrame, percent: int, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Linked components (ca, cb) among the rows (key, fp, n, component), and the keys that have to be searched again."""
    dealt = keep(_dealt(rows), "dealt")
    placed = _by_tile(dealt.join(sets.select("fp", "n", "vec", "width"), "fp"))
    found = placed.mapInArrow(lambda it: reached(it, percent, whole), "a long, b long, ca long, cb long, key long").distinct()
    found = keep(found, "reached")
    links = keep(verified(found.where("a is not null").drop("key"), sets, percent), "links")
    again = keep(found.where("key is not null").select("key").distinct(), "again")
    drop(dealt, found)
    return links, again


def _mixed(rows: DataFrame) -> DataFrame:
    """Of rows (key, fp, component) those of keys with several components; of keys with the very same members, one."""
    who = F.sum(F.xxhash64("fp").cast("decimal(38,0)"))
    keys = rows.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m"), who.alias("who"))
    keys = keys.where("x < y").groupBy("m", "x", "y", "who").agg(F.min("key").alias("key")).select("key")
    return rows.join(keys, "key")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, fp, n, component) with the tiles (t, u) that they go to and their side there.

    A key of one tile has all its members in it. Of a key with more, members of the largest component are dealt over tiles
    of their own and so are the others; each of the others' tiles meets all tiles.
    """
    totals = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    totals = keep(totals.select("key", _tiles("m", "s").alias("tiles")), "totals")
    placed = rows.join(totals, "key")
    small = placed.where("tiles = 1").select("key", "fp", "component", *(F.lit(0).alias(c) for c in ("t", "u", "side")))
    if totals.where("tiles > 1").isEmpty():
        return small
    large = placed.where("tiles > 1")
    top = large.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"))
    large = large.join(top.select("key", "top.component").withColumnRenamed("component", "top"), "key")
    large = large.withColumn("most", F.col("component") == F.col("top"))
    halves = large.groupBy("key").agg(
        *(F.count_if(F.col("most") == flag).alias(f"m{k}") for k, flag in enumerate((False, True))),
        *(F.sum(F.when(F.col("most") == flag, F.col("n"))).alias(f"s{k}") for k, flag in enumerate((False, True))),
    )
    halves = halves.select("key", _tiles("m0", "s0").alias("others"), _tiles("m1", "s1").alias("own"))
    large = large.join(halves, "key").withColumn("tile", F.pmod(F.xxhash64("fp"), F.when(F.col("most"), F.col("own")).otherwise(F.col("others"))).cast("int"))
    met = "transform(sequence(0, others - 1), o -> named_struct('t', {t}, 'u', {u}, 'side', {side}))"
    of_most = F.expr(met.format(t="tile", u="own + o", side="-1"))
    of_others = F.concat(
        F.expr("transform(sequence(0, own - 1), o -> named_struct('t', o, 'u', own + tile, 'side', 1))"),
        F.expr(met.format(t="own + least(tile, o)", u="own + greatest(tile, o)", side="cast(signum(tile - o) as int)")),
    )
    large = large.withColumn("at", F.explode(F.when(F.col("most"), of_most).otherwise(of_others)))
    return small.unionByName(large.select("key", "fp", "component", "at.*"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """(id, n_shingles, component_id) for every row; see the module's notes."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    schema = "id long, hash long, n long, fp long, more long, keys array<long>"
    raw = keep(base.mapInArrow(lambda it: profiled(it, size, percent), schema).withColumn("one", F.col("fp")), "profile")
    profile = distinct_prints(raw)
    one_each = profile.where("n > 0").groupBy("fp").agg(F.first("keys").alias("keys"))
    points = keep(one_each.select("fp", F.explode("keys").alias("key")), "keys")
    rows = keep(profile.select("id", "n", F.when(F.col("n") > 0, F.col("fp")).alias("fp")), "rows")
    row = F.min(F.struct(F.col("id").isNull(), "id", "hash"))
    heads = profile.where("n > 0").groupBy("fp", "one", "more", "n").agg(F.min("id").alias("id"), row["hash"].alias("hash"))
    heads = keep(heads, "heads")
    drop(*{raw, profile})

    shared = points.groupBy("key").agg(F.min("fp").alias("hub"), F.max("fp").alias("top")).where("hub < top")
    members = keep(points.join(shared.select("key", "hub"), "key"), "members")
    drop(points)

    met = members.where("fp <> hub").groupBy("fp", "hub").count()
    best = met.groupBy("fp").agg(F.max(F.struct("count", F.negative("hub").alias("h"))).alias("m")).select("fp", F.negative("m.h").alias("key"))
    best = keep(best, "best")
    hubs = best.join(heads.select("fp", "n"), "fp").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    hubs = keep(hubs.select("key", _tiles("m", "s").alias("tiles")), "hubs")
    chosen = members.select("fp").distinct().join(heads, "fp").join(best, "fp", "left").join(hubs, "key", "left")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    chosen = keep(chosen.select("fp", "one", "more", "id", "hash", "key", tile.alias("tile")), "chosen")
    sets = texts_of(base, chosen).mapInArrow(lambda it: whole_sets(it, size), "fp long, key long, tile int, n long, vec binary, width int, items array<long>")
    sets = keep(sets, "sets")
    drop(best, chosen)

    def at_hub(tile: str):
        zero = (F.lit(0).alias(c) for c in ("u", "side", "width"))
        return "key", F.expr(tile).alias("t"), *zero, "fp", F.col("fp").alias("component"), "n", "items"

    own = sets.where("key is not null").select(*at_hub("tile"))
    every = hubs.join(sets.select(F.col("fp").alias("key"), "fp", "n", "items"), "key")
    near_hubs = _by_tile(own.unionByName(every.select(*at_hub("explode(sequence(0, tiles - 1))"))))
    links = keep(near_hubs.mapInArrow(lambda it: linked(it, percent), "a long, b long"), "links")
    first = keep(components(links), "first")
    drop(links, hubs)

    placed = members.select("key", "fp").join(first, F.col("fp") == F.col("node"), "left")
    placed = keep(placed.select("key", "fp", F.coalesce("component", "fp").alias("component")), "placed")
    drop(members)
    left = keep(_mixed(placed).join(heads.select("fp", "n"), "fp"), "mixed")
    drop(placed)
    links, again = _under_keys(left, sets, percent, whole=False)
    if not again.isEmpty():
        # What has moved is told of the components of each key, not of its members; keys of one component are done.
        near = components(links).withColumnRenamed("component", "near")
        open_rows = left.join(again, "key")
        moved = open_rows.select("key", "component").distinct().join(near, F.col("component") == F.col("node"), "left")
        moved = keep(moved.select("key", "component", F.coalesce("near", "component").alias("now")), "moved")
        open_ = moved.groupBy("key").agg(F.min("now").alias("x"), F.max("now").alias("y")).where("x < y").select("key")
        rest = open_rows.join(keep(moved.join(open_, "key"), "open"), ["key", "component"])
        rest = keep(_mixed(rest.select("key", "fp", "n", F.col("now").alias("component"))), "rest")
        more, _ = _under_keys(rest, sets, percent, whole=True)
        links = keep(links.unionByName(more), "links")
    second = keep(components(links), "second")
    drop(left, sets)

    nodes = heads.select("fp", "id").join(first, F.col("fp") == F.col("node"), "left")
    nodes = nodes.select("fp", "id", F.coalesce("component", "fp").alias("near"))
    nodes = nodes.join(second, F.col("near") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "near").alias("component"))
    least = nodes.groupBy("component").agg(F.min("id").alias("component_id"))
    by_fp = keep(nodes.join(least, "component").select("fp", "component_id"), "by_fp")
    drop(heads, first, second)
    out = rows.join(by_fp, "fp", "left")
    component = F.when(F.col("fp").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
