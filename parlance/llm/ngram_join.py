"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Equal sets of shingles are one row of the matrix. Rows are classed by size. Two rows of a class that reach the
threshold differ in at most H n-grams, H following from their sizes; so if the n-grams are dealt into more than H
groups, two such rows agree on some whole group. More groups are dealt, so they agree on several, and a row needs only
its rarest ones. Only rows that agree on such a group are multiplied; groups whose rows share their least row (by hash)
make one block column together. Long block columns are cut into blocks of rows. First each block is multiplied with
itself and with the column's hub; rows that this puts into the hub's component need no product with each other, so blocks are
paired only where rows are left over. A task accumulates overlap counts stripe by stripe over the n-grams,
and returns a spanning forest of the links it finds instead of all pairs. Components come from star contraction of
these links.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import U64, chunks, giving_back, keyed, map_docs, mix, prefix_hashes, span_hashes, spent, split_by, stored, texts_of, with_decisions

#: Rows of a block of a column and bytes of their sets, both at most; columns of a dense stripe.
BLOCK_ROWS, BLOCK_BYTES, STRIPE = 768, 32 << 20, 4096
#: Words, and letters of a word, that a worker remembers the hash of.
MEMO_WORDS, MEMO_BYTES = 20_000, 24
#: Sides of a task: rows of one side are multiplied with those of the other, or with each other if there is but one; the
#: hub is on the first side.
HUB = 2
#: Group signatures that a task gathers before it sends them on, and documents' classes of size (powers of 1.414).
RUN_CELLS = 1 << 19
#: Rounds of pruning at most, and the share of the cells that a round has to take off for another one to follow.
PRUNING_ROUNDS, WORTH_A_ROUND = 3, 0.1
#: Bits of a group signature, its class among them, by which rows of a task are told to agree on groups.
GROUP_BITS = 31
SIZE_BOUNDS = sorted({int(2 ** (k / 2)) for k in range(80)})


class _WordHashes(dict):
    """Hash of a word by its bytes; xxh3 has no words that collide whatever the seed, as polynomials have."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found


_hashes = _WordHashes()


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle, none make none."""
    words = [raw.lower().split() for raw in raws]  # of bytes: A-Z and the ASCII white space only
    bounds = np.cumsum([0, *map(len, words)])
    hashes = np.fromiter((_hashes[w] for own in words for w in own), dtype=U64, count=int(bounds[-1]))
    prefix = prefix_hashes(hashes)
    at = np.arange(max(0, len(hashes) - width + 1))
    grams = span_hashes(prefix, at, at + width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(span_hashes(prefix, np.array([a]), np.array([b])) if b > a else np.zeros(0, dtype=np.uint64))
    return out


def groups_of_class(k: int, percent: int) -> tuple[int, int]:
    """Number of groups for size class k, and on how many groups linked rows of it agree beyond one."""
    most = SIZE_BOUNDS[k + 1] - 1
    differ = (100 - percent) * 2 * most // (100 + percent)
    slack = 2 + differ // 4 if differ else 0
    return differ + 1 + slack, slack


def agreeing_groups(k: int, percent: int) -> int:
    """On how many emitted groups of class k linked rows agree at least."""
    slack = groups_of_class(k, percent)[1]
    return slack + 1 - slack // 2


def group_signatures(values: np.ndarray, percent: int) -> np.ndarray:
    """48-bit signatures of a row's groups, for its size class and those of larger rows it may link with.

    The lowest two bits tell the class. Empty groups are left out unless there are so many that two linked rows might agree on no other.
    """
    n, out = len(values), []
    k = bisect.bisect_right(SIZE_BOUNDS, n) - 1
    spread = mix(values)
    while k + 1 < len(SIZE_BOUNDS) and 100 * n >= percent * SIZE_BOUNDS[k]:
        groups, slack = groups_of_class(k, percent)
        own = (values % U64(groups)).astype(np.int64)
        sums, held = np.zeros(groups, dtype=U64), np.bincount(own, minlength=groups)
        np.add.at(sums, own, spread)
        sums = mix(sums + np.arange(groups, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(k + 1)) >> U64(16)
        sums = (sums & ~U64(3)) | U64(k & 3)
        out.append(sums if np.count_nonzero(held == 0) > slack // 2 else sums[held > 0])
        k += 1
    return np.concatenate(out)


def _class_key(values: np.ndarray) -> bytes:
    """Name of a set of shingles, of 128 bits, so that no two sets of any corpus share one."""
    return xxhash.xxh3_128_digest(values.tobytes())


def _brief(key: bytes) -> int:
    """Half of a class's name, as a signed number; it picks candidates. Linked sets share it with a probability of 2**-64."""
    return int.from_bytes(key[:8], "little", signed=True)


def _rows(width: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys = [], []
            for _, _, raws in chunks(texts_of(batch)):  # the sets of a batch are never held together
                for s in shingle_sets(raws, width):
                    sizes.append(len(s))
                    keys.append(_class_key(s))
            yield pd.DataFrame({"row_key": batch["row_key"], "doc_id": batch["doc_id"], "n": sizes, "size_class": [bisect.bisect_right(SIZE_BOUNDS, n) - 1 for n in sizes], "class": keys, "brief": [_brief(k) for k in keys]})

    return run


def _signature_runs(width: int, percent: int, buckets: int) -> Callable:
    """Sorted runs of (signature, brief class) by bucket of signatures, packed; equal rows of a task count once.

    A signature takes 14 bytes, however many buckets there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}
        size = 0

        def flush() -> pd.DataFrame:
            cells = np.concatenate(list(held.values())) if held else np.zeros(0, dtype=U64)
            classes = np.repeat(np.fromiter(map(_brief, held), dtype="<i8", count=len(held)), [len(v) for v in held.values()])
            order = np.argsort(cells, kind="stable")
            cells, classes = cells[order], classes[order]
            bucket = (cells * U64(buckets) >> U64(48)).astype(np.int64)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                own = cells[cuts[b] : cuts[b + 1]]
                rows.append((b, (own & U64(0xFFFFFFFF)).astype("<u4").tobytes(), (own >> U64(32)).astype("<u2").tobytes(), classes[cuts[b] : cuts[b + 1]].tobytes()))
            return pd.DataFrame(rows, columns=["bucket", "low", "high", "classes"])

        for batch in batches:
            for _, _, raws in chunks(texts_of(batch)):
                for s in shingle_sets(raws, width):
                    key = _class_key(s)
                    if len(s) and key not in held:
                        held[key] = group_signatures(s, percent)
                        size += len(held[key])
                if size > RUN_CELLS:
                    yield flush()
                    held, size = {}, 0
        yield flush()

    return run


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the runs of each bucket the signatures that two classes or more have."""

    def live(rows: list) -> pd.DataFrame:
        cells = np.concatenate([np.frombuffer(r[0], "<u4").astype(U64) | np.frombuffer(r[1], "<u2").astype(U64) << U64(32) for r in rows])
        classes = np.concatenate([np.frombuffer(r[2], "<i8") for r in rows])
        order = np.lexsort((classes, cells))
        cells, classes = cells[order], classes[order]
        new = np.concatenate([[True], (cells[1:] != cells[:-1]) | (classes[1:] != classes[:-1])])
        cells, classes = cells[new], classes[new]
        same = cells[1:] == cells[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return pd.DataFrame({"h": cells[keep].view(np.int64), "brief": classes[keep]})

    bucket, held = None, []
    for batch in batches:
        for b, *row in zip(batch["bucket"], batch["low"], batch["high"], batch["classes"], strict=True):
            if b != bucket and held:
                yield live(held)
                held = []
            bucket = b
            held.append(row)
    if held:
        yield live(held)


def _full_sets(width: int) -> Callable:
    """A row for each task that a matrix row takes part in, with the row's whole set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, last, raws in chunks(texts_of(batch)):
                part = batch.iloc[first:last]
                sets = [s.tobytes() for s in shingle_sets(raws, width)]
                take = part["tasks"].map(len).to_numpy()
                tasks = [t for ts in part["tasks"] for t in ts]
                yield pd.DataFrame({
                    "doc_id": np.repeat(part["doc_id"].to_numpy(), take), "row_key": np.repeat(part["row_key"].to_numpy(), take), "shingles": [s for s, k in zip(sets, take, strict=True) for _ in range(k)],
                    "h": [t["h"] for t in tasks], "a": [t["a"] for t in tasks], "b": [t["b"] for t in tasks], "side": [t["side"] for t in tasks],
                })

    return run


def overlaps(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Product of an n-row incidence matrix with its transpose, stripe by stripe; cells come sorted by column."""
    out = np.zeros((n, n), dtype=np.float32)
    width = int(columns[-1]) + 1 if len(columns) else 0
    for lo in range(0, width, STRIPE):
        a, b = np.searchsorted(columns, [lo, lo + STRIPE])
        stripe = np.zeros((n, min(STRIPE, width - lo)), dtype=np.float32)
        stripe[rows[a:b], columns[a:b] - lo] = 1
        out += stripe @ stripe.T
    return out


def rows_in_agreement(groups: list[np.ndarray], classes: list[np.ndarray], sides: list[int], least: list[int]) -> np.ndarray:
    """Which rows may agree with another one (of the other side, if there are two) on ``least`` groups of a class or more.

    Groups of a row that look alike are seen once, so as many more are granted to it: no row that agrees is missed.
    """
    flat, kinds, side = np.concatenate(groups), np.concatenate(classes), np.array(sides)
    owner = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    found = np.zeros(len(groups), dtype=bool)
    for k in np.unique(kinds).tolist():
        _, inverse, counts = np.unique(flat[kinds == k], return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        rows, place = np.unique(owner[kinds == k][keep], return_inverse=True)
        at = (np.cumsum(counts > 1) - 1)[inverse[keep]]
        if not len(rows):
            continue
        order = np.argsort(at, kind="stable")
        common = overlaps(place[order], at[order], len(rows))
        alike = np.bincount(place, minlength=len(rows)) - np.diagonal(common)
        np.fill_diagonal(common, 0)
        if side.min() != side.max():
            common[side[rows][:, None] == side[rows][None, :]] = 0
        best = common.max(axis=1)
        found[rows[(best > 0) & (best + alike >= least[k])]] = True
    return found


def _agreeing_rows(least: list[int]) -> Callable:
    """Walk a partition sorted by task; emit the rows that may have a partner in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, rows, groups, classes = None, [], [], []
        columns = ["doc_id", "row_key", "h", "a", "b", "side"]

        def done() -> list[tuple]:
            return [rows[i] for i in np.flatnonzero(rows_in_agreement(groups, classes, [r[5] % 2 for r in rows], least)).tolist()] if len(rows) > 1 else []

        for batch in batches:
            out = []
            for *row, size_class, own in zip(*(batch[c] for c in columns), batch["size_class"], batch["groups"], strict=True):
                if tuple(row[2:5]) != task:
                    out += done()
                    task, rows, groups, classes = tuple(row[2:5]), [], [], []
                rows.append(tuple(row))
                groups.append(own)
                classes.append(size_class + (own - size_class) % 4)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(done(), columns=columns)

    return run


def linked_pairs(sets: list[np.ndarray], sides: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows (of different sides, if there are two)."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    parent = list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            forest.append((i, j))

    side = np.array(sides)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                small, large = sorted((sizes[i], sizes[j]))
                if 100 * small < percent * large or (side.min() != side.max() and side[i] == side[j]):
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (small + large - both):
                    link(i, j)
        return forest
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    column = np.cumsum(counts > 1) - 1  # values of one row only can't overlap
    keep = counts[inverse] > 1
    owner, at = owner[keep], column[inverse[keep]]
    shared = np.bincount(owner, minlength=m)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    # Rows that share too little with all others can be left out before the product.
    alive = 100 * shared >= percent * sizes
    rows = np.flatnonzero(alive)
    if len(rows) < 2:
        return forest
    place = np.full(m, -1)
    place[rows] = np.arange(len(rows))
    own = place[owner]
    overlap = overlaps(own[own >= 0], at[own >= 0], len(rows))
    n = sizes[rows].astype(np.float64)
    ok = np.triu(100 * overlap >= percent * (n[:, None] + n[None, :] - overlap), 1)
    if side.min() != side.max():
        ok &= side[rows][:, None] != side[rows][None, :]
    for i, j in zip(*np.nonzero(ok), strict=True):
        link(int(rows[i]), int(rows[j]))
    return forest


def reached(forest: list[tuple[int, int]], start: int) -> set[int]:
    """The rows that a forest connects with a row, itself included."""
    near: dict[int, list[int]] = {}
    for i, j in forest:
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    found, todo = {start}, [start]
    while todo:
        fresh = [j for j in near.get(todo.pop(), []) if j not in found]
        found.update(fresh)
        todo += fresh
    return found


def _products(percent: int) -> Callable:
    """Walk a partition sorted by task; emit the links (u, v) of each task, and the rows (h, row_key) linked with its hub."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, last, rows, sets = None, None, [], []

        def done() -> list[tuple]:
            if len(rows) < 2:
                return []
            forest = linked_pairs(sets, [side % 2 for *_, side in rows], percent)
            out = [(rows[i][0], rows[j][0], None, None) for i, j in forest]
            hub = next((i for i, r in enumerate(rows) if r[2] == HUB), None)
            return out if hub is None else [*out, *((None, None, task[0], rows[i][1]) for i in reached(forest, hub))]

        def frame(out: list[tuple]) -> pd.DataFrame:
            found = pd.DataFrame(out, columns=["u", "v", "h", "row_key"], dtype=object)
            return found.assign(h=pd.array(found["h"].tolist(), dtype="Int64"), row_key=pd.array(found["row_key"].tolist(), dtype="Int64"))

        for batch in batches:
            out = []
            for h, a, b, side, doc_id, row_key, raw in zip(*(batch[c] for c in ("h", "a", "b", "side", "doc_id", "row_key", "shingles")), strict=True):
                if (h, a, b) != task:
                    out += done()
                    task, last, rows, sets = (h, a, b), None, [], []
                if (doc_id, row_key, side) != last:  # rows of a task come sorted by id, key and side; a repeated row counts once
                    last = doc_id, row_key, side
                    rows.append(last)
                    sets.append(np.frombuffer(raw, dtype=np.uint64))
            yield frame(out)
        yield frame(done())

    return run


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``u, v`` links; the component is its smallest node.

    Alternating large-star and small-star rounds, each written to the shared folder; the graph never leaves the
    executors.
    """
    u, v = F.col("u"), F.col("v")
    edges = stored(links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    one, none = F.lit(1), F.lit(0)
    while True:
        # Done when every node points to one other that points nowhere.
        ends = edges.select(u.alias("node"), one.alias("below"), none.alias("above")).unionByName(edges.select(v.alias("node"), none.alias("below"), one.alias("above")))
        chained = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1)))
        if not chained.limit(1).count():
            return edges.select(u.alias("node"), v.alias("component")).unionByName(edges.select(v.alias("node"), v.alias("component")).distinct())
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where(u != v).distinct(), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document.

    Documents link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles. Null, empty
    and blank texts have no shingles and link with nothing. Rows that share an id share a component; rows without an
    id link with nothing and have no component. Extra columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    if not 50 < percent <= 100:
        raise ValueError("percent has to be 51 to 100")
    matrix = stored(map_docs(rows, _rows(width), "row_key long, n long, size_class int, class binary, brief long"), "shingle-rows")
    id_type = rows.schema["doc_id"].dataType
    known = matrix.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = known.groupBy("class").agg(F.min(F.struct("doc_id", "row_key", "size_class", "brief")).alias("best"))
    classes = stored(classes.select("class", "best.brief", F.col("best.doc_id").alias("rep"), F.col("best.row_key").alias("rep_key"), F.col("best.size_class").alias("size_class")), "shingle-classes")
    buckets = max(8, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = rows.where(F.col("doc_id").isNotNull()).select("text").mapInPandas(giving_back(_signature_runs(width, percent, buckets)), "bucket long, low binary, high binary, classes binary")
    live = runs.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(giving_back(_agreeing), "h long, brief long")
    agreed = stored(live, "agreeing")
    cells = stored(agreed.join(classes, "brief").select("rep", "rep_key", "h", "size_class"), "agreeing-rows")
    spent(agreed)
    # A row that is linked agrees with its partner on several groups; rows short of that leave, and what only they held.
    agreeing = [agreeing_groups(k, percent) for k in range(len(SIZE_BOUNDS) - 1)]
    least = F.array(*(F.lit(n) for n in agreeing))
    size_class = F.col("size_class") + F.pmod(F.col("h") - F.col("size_class"), F.lit(4)).cast("int")
    left = cells.count()
    for _ in range(PRUNING_ROUNDS):
        enough = cells.withColumn("k", size_class).groupBy("rep_key", "k").agg(F.count("*").alias("held")).where(F.col("held") >= F.get(least, F.col("k")))
        strong = stored(cells.withColumn("k", size_class).join(enough.select("rep_key", "k"), ["rep_key", "k"], "left_semi").drop("k"), "pruned")
        shared = stored(strong.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > 1), "shared-groups")
        pruned = stored(strong.drop("m").join(shared, "h"), "pruned")
        spent(cells, strong, shared)
        before, cells, left = left, pruned, pruned.count()
        if before - left <= WORTH_A_ROUND * before:
            break
    # Two linked rows agree on ``least`` groups or more. If each leaves out one fewer of its most common ones, in one
    # order for all, the rarest group that they agree on stays.
    order = Window.partitionBy("rep_key", "k").orderBy(F.desc("m"), "h")
    rarest = cells.withColumn("k", size_class).withColumn("place", F.row_number().over(order)).where(F.col("place") >= F.get(least, F.col("k")))
    rarest = stored(rarest.select("rep", "rep_key", "h", "size_class"), "rarest-groups")
    # Groups whose rows have the same hub (their least row by hash) become one block column: near copies share few hubs.
    hubs = stored(rarest.groupBy("h").agg(F.min(F.xxhash64("rep_key", F.lit(1))).alias("hub")), "hubs")
    live = stored(rarest.join(hubs, "h").select("rep", "rep_key", "size_class", F.col("hub").alias("h")).distinct(), "live-cells")
    spent(rarest, hubs)
    most = F.get(F.array(*(F.lit(8.0 * n) for n in SIZE_BOUNDS)), F.col("size_class") + 1)  # bytes of a row's set, at most
    columns = live.groupBy("h").agg(F.count("*").alias("m"), F.sum(most).alias("bytes"), F.min_by(F.struct("rep", "rep_key"), F.xxhash64("rep_key", F.lit(1))).alias("first")).where(F.col("m") > 1)
    columns = stored(columns.withColumn("parts", F.ceil(F.greatest(F.col("m") / block_rows, F.col("bytes") / BLOCK_BYTES)).cast("int")), "columns")
    live = live.join(columns.select("h", "parts"), "h").withColumn("own", F.pmod(F.xxhash64("rep_key"), F.col("parts")).cast("int"))
    # The groups, far smaller than the sets, are multiplied before the sets; rows without a partner that agrees on enough leave.
    group = F.col("h").bitwiseAND(F.lit((1 << GROUP_BITS) - 1)).cast("int")
    held = stored(cells.groupBy("rep_key").agg(F.first("size_class").alias("size_class"), F.collect_list(group).alias("groups")), "groups-of-rows")
    spent(cells)

    def products(tasks: DataFrame) -> DataFrame:
        """Links of tasks (rep, rep_key, h, a, b, side)."""
        whole = tasks.join(held, "rep_key").select(F.col("rep").alias("doc_id"), F.col("rep_key").alias("row_key"), "h", "a", "b", "side", "size_class", "groups")
        whole = whole.repartition("h", "a", "b").sortWithinPartitions("h", "a", "b")
        kept = map_docs(whole, _agreeing_rows(agreeing), "row_key long, h long, a int, b int, side int")
        kept = stored(kept.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("h", "a", "b", "side")).alias("tasks")), "agreeing-tasks")
        wanted = with_decisions(split_by(rows, kept)[0], kept, "inner").select("doc_id", "row_key", "text", "tasks")
        sets = map_docs(wanted, _full_sets(width), "row_key long, shingles binary, h long, a int, b int, side int")
        sets = sets.withColumn("doc_id", F.col("doc_id").cast("string")).repartition("h", "a", "b").sortWithinPartitions("h", "a", "b", "doc_id", "row_key", "side")
        found = stored(sets.mapInPandas(giving_back(_products(percent)), "u string, v string, h long, row_key long"), "links-of-tasks")
        spent(kept)
        return found

    def links_of(found: DataFrame) -> DataFrame:
        return found.where(F.col("u").isNotNull()).select(F.col("u").cast(id_type).alias("u"), F.col("v").cast(id_type).alias("v"))

    part, none = F.col("own"), F.lit(0)
    tasks = live.select("rep", "rep_key", "h", part.alias("a"), part.alias("b"), none.alias("side"))
    long = columns.where(F.col("parts") > 1)
    if not long.limit(1).count():
        links = links_of(products(tasks))
    else:
        with_hub = long.select("first.rep", "first.rep_key", "h", F.explode(F.sequence(none, F.col("parts") - 1)).alias("a")).select("rep", "rep_key", "h", "a", F.col("a").alias("b"), F.lit(HUB).alias("side"))
        tasks = tasks.unionByName(with_hub).groupBy("rep", "rep_key", "h", "a", "b").agg(F.max("side").alias("side"))
        found = products(tasks)
        members = live.where(F.col("parts") > 1)
        near_hub = found.where(F.col("row_key").isNotNull()).select("h", F.col("row_key").alias("rep_key")).distinct()
        over = stored(members.join(near_hub, ["h", "rep_key"], "left_anti").select("rep", "rep_key", "h", "parts", "own"), "rows-left-over")
        # Pairs of different blocks: a row left over goes to all of them, another only to blocks that have rows left over.
        some = over.select("h", F.col("own").alias("other")).distinct()
        one = over.select("rep", "rep_key", "h", "own", F.explode(F.sequence(none, F.col("parts") - 1)).alias("other"))
        two = members.join(near_hub, ["h", "rep_key"], "left_semi").join(some, "h").select("rep", "rep_key", "h", "own", "other")
        pairs = one.unionByName(two).where(F.col("own") != F.col("other"))
        across = pairs.select("rep", "rep_key", "h", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        links = links_of(found).unionByName(links_of(products(across)))
    # An id whose rows differ links the classes of these rows.
    several = known.groupBy("doc_id").agg(F.min("class").alias("one"), F.max("class").alias("two")).where(F.col("one") != F.col("two")).select("doc_id")
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "class").join(classes, "class")
    links = links.unionByName(own.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    nodes = connected_components(links)
    labels = classes.select("class", "rep").join(nodes, F.col("rep") == F.col("node"), "left")
    labels = stored(labels.select("class", F.coalesce("component", "rep").alias("component")), "components")
    joined = matrix.select("doc_id", "n", "class").join(labels, "class", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))

