"""N-gram Jaccard join by a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same shingle set form one class. N-grams are ordered, common ones last, and a class enters the product with
the first ``n - ceil(t n) + 1`` of its n-grams only (two sets of similarity t share one of these). The product's blocks
are ranges of n-gram hashes: each block adds to the overlap count of the pairs that share its n-grams, the counts of a
pair are summed over blocks, and pairs whose count cannot reach the overlap that their sizes ask for are discarded.
The remaining columns are then accumulated for the surviving pairs alone, which makes the overlap exact.

An n-gram that many classes share does not expand into all its pairs. Its classes are first compared with a
pivot. Only classes that these links leave in different components are then compared with each other, block by block,
and since a link inside a component cannot change the components, no link between components is lost. Blocks hold classes
of one size band, so that only bands within the similarity's reach of each other meet.

An n-gram that is common is counted in parts: its classes are dealt over SALTS tasks, and the parts' counts are added up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_materialized, materialize, slices
from .components import components
from .shingles import mix, shingle_sets

#: An n-gram of more classes is compared by pivots.
SMALL_BUCKET = 8
#: Tasks that the classes of a common n-gram are dealt to.
SALTS = 64
#: Rows and columns of a block of the product.
BLOCK_ROWS, COLUMNS = 128, 4096
#: Bits of a filter for each value, and least and most bits (16 MiB) of one. A filter that is too full costs time, not
#: links: it marks more n-grams as common, or spares the last pass fewer documents.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: N-grams are counted by this many bits of their hash, and in Python by this many at a time.
COUNTED_BITS, COUNTED = 40, 1 << 20
WORDS, SHARE = 5, 80
#: A block's name is its size band times this, and its number in the band.
BAND = 1 << 32


def _key(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()


def _signatures(words: int):
    """doc_id, n and the two halves of the digest of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys = [], []
            for s in shingle_sets(batch.column("text"), words):
                n.append(len(s))
                keys.append(_key(s))
            key, low = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(key), pa.array(low)], names=["doc_id", "n", "key", "low"])

    return run


class Filter:
    """A set of longs as bits, packed; it may pass others too, the more the fuller it is."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    @staticmethod
    def of(ids: DataFrame, n: int) -> Filter:
        """The filter of ``n`` rows of one long column."""
        size = min(max(1 << (BITS_EACH * n).bit_length(), LEAST_BITS), MOST_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed = np.zeros(size // 8, np.uint8)
            for batch in batches:
                at = np.unique(Filter.places(batch.column(0).to_numpy(zero_copy_only=False), size))
                if len(at):
                    first = np.flatnonzero(np.concatenate(([True], at[1:] >> 3 != at[:-1] >> 3)))
                    packed[at[first] >> 3] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)
            if packed.any():
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())], names=["bits"])

        total = np.zeros(size // 8, np.uint8)
        # at most 8 filters of at most 16 MiB, one after the other
        for r in ids.mapInArrow(run, "bits binary").coalesce(8).toLocalIterator():
            total |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
        return Filter(total)

    @staticmethod
    def places(ids: np.ndarray, size: int) -> np.ndarray:
        return (mix(ids.astype(np.uint64)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        at = Filter.places(ids, 8 * len(self.packed))
        return (self.packed[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)

    def __getstate__(self):
        return zlib.compress(self.packed.tobytes(), 1)

    def __setstate__(self, state):
        self.packed = np.frombuffer(zlib.decompress(state), np.uint8)


def _counted(grams: np.ndarray) -> np.ndarray:
    """The bits by which n-grams are counted and found common."""
    return grams >> np.uint64(64 - COUNTED_BITS)


def _once(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[Iterator[tuple[np.ndarray, bytes]]]:
    """For each batch the sets that are not empty, with their keys; a task gives a set once."""
    seen: set[bytes] = set()

    def new(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
        for s in shingle_sets(texts, words):
            if len(s) and (key := _key(s)) not in seen:
                if len(seen) < 1_000_000:  # beyond it repeated rows only cost time: they are dropped later
                    seen.add(key)
                yield s, key

    for batch in batches:
        for part in slices(batch):
            yield new(part.column("text"))


def _prefix(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def _prefix_counts(words: int, share: int):
    """How often n-grams (by COUNTED_BITS) stand in prefixes by hash alone, added up for COUNTED of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            gram, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(df, pa.int64())], names=["gram", "df"])

        for sets in _once(batches, words):
            for s, _ in sets:
                held.append(_counted(s[: _prefix(len(s), share)]))
                total += len(held[-1])
                if total >= COUNTED:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    return run


def _prefixes(common: Filter, words: int, share: int):
    """Each class's first n-grams, common ones last, enough for any partner to share one; salt: 0 for those not common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _once(batches, words):
            grams, keys, sizes, salts = [], [], [], []
            for s, key in sets:
                late = common.passes(_counted(s))
                p = _prefix(len(s), share)
                if late.any():
                    s, late = np.concatenate((s[~late], s[late])), np.sort(late)
                half = int.from_bytes(key[:8], "little", signed=True)
                grams.append(s[:p].astype(np.int64))
                salts.append(np.where(late[:p], 1 + half % SALTS, 0))
                keys.append(half)
                sizes.append(p)
            if keys:
                columns = [pa.array(np.concatenate(grams)), pa.array(np.concatenate(salts).astype(np.int8)), pa.array(np.repeat(np.array(keys, np.int64), sizes))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "salt", "key"])

    return run


def _sets(wanted: Filter, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column("doc_id").to_numpy(zero_copy_only=False))))
            # a set may be larger than its text
            for part in slices(batch):
                got = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(got, pa.binary())], names=["id", "grams"])

    return run


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Ids, components and rows of the incidence matrix of a task's two blocks."""
    return [(part["id"].to_numpy(np.int64), part["comp"].to_numpy(np.int64), [np.frombuffer(x, np.uint64) if isinstance(x, bytes) else np.asarray(x).astype(np.uint64) for x in part["grams"]]) for part in (pdf[pdf["side"] == k] for k in (0, 1))]


def _product(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of rows."""
    sides = []
    for rows in (a, b):
        sides.append((np.concatenate([*rows, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(rows)), [len(x) for x in rows])))
    shared = np.intersect1d(sides[0][0], sides[1][0])
    overlap = np.zeros((len(a), len(b)), np.float32)
    columns = []
    for g, r in sides:
        at = np.minimum(np.searchsorted(shared, g), max(len(shared) - 1, 0))
        hit = shared[at] == g if len(shared) else np.zeros(len(g), bool)
        order = np.argsort(at[hit], kind="stable")
        columns.append((at[hit][order], r[hit][order]))
    for lo in range(0, len(shared), COLUMNS):
        blocks = []
        for (at, r), n in zip(columns, overlap.shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + COLUMNS])
            block = np.zeros((n, COLUMNS), np.float32)
            block[r[i:j], at[i:j] - lo] = 1
            blocks.append(block)
        overlap += blocks[0] @ blocks[1].T
    return overlap.astype(np.int64)


def _block_links(share: int):
    """Of two blocks of whole rows: links enough to join all components that any of their links joins."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (ia, ca, a), (ib, cb, b) = _sides(pdf)
        o, na, nb = _product(a, b), np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = above.get(up, up)
                c = up
            return c

        found = []
        for i, j in np.argwhere((100 * o >= share * (na[:, None] + nb[None, :] - o)) & (ca[:, None] != cb[None, :])).tolist():
            x, y = top(int(ca[i])), top(int(cb[j]))
            if x != y:
                above[x] = y
                found.append((ia[i], ib[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return run


def _block_candidates(share: int):
    """Of two blocks of prefixes: the rows that may still link with a row of the other block and another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (ia, ca, a), (ib, cb, b) = _sides(pdf)
        na, nb = (pdf.loc[pdf["side"] == k, "n"].to_numpy(np.int64) for k in (0, 1))
        c, x, y = _product(a, b), na[:, None], nb[None, :]
        rest = np.maximum(-(-share * x // 100), -(-share * y // 100)) - 1
        may = (ca[:, None] != cb[None, :]) & (100 * np.minimum(x, y) >= share * np.maximum(x, y)) & (c > 0) & (c + rest >= -(-share * (x + y) // (100 + share)))
        keep = np.concatenate((may.any(1), may.any(0)))
        both = pd.concat([pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]])
        return both[keep][["k", "i", "j", "side", "id", "comp"]]

    return run


def _dealt(tasks: DataFrame) -> DataFrame:
    """Blocks spread over all tasks of a shuffle: they are small in bytes, but not in work."""
    return tasks.repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "i", "j")


def _links(tasks: DataFrame, rows: DataFrame, share: int, name: str) -> DataFrame:
    """Links within tasks (k, i, j, side, id, comp); rows: the whole rows of the incidence matrix."""
    found = _dealt(tasks.join(rows, "id")).groupBy("k", "i", "j").applyInPandas(_block_links(share), "a long, b long")
    return materialize(found, name)


def _incidence_rows(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, grams) of the wanted class representatives."""
    wanted = materialize(wanted, "wanted")
    rows = docs.filter("doc_id is not null").mapInArrow(_sets(Filter.of(wanted, wanted.count()), words), "id long, grams binary")
    rows = materialize(rows.join(wanted, "id", "left_semi").dropDuplicates(["id"]), "rows")
    drop_materialized(wanted)
    return rows


def _in_blocks(members: DataFrame, by: list[str]) -> DataFrame:
    """``members`` with block and blocks: groups of one ``by`` dealt into blocks of about BLOCK_ROWS rows."""
    sizes = members.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    return members.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))


def _bands(share: int):
    """The size band of a set: sets that link lie in the same or in adjoining bands."""
    return F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / share)) + 1e-9) if share < 100 else F.col("n").cast("long")


def _block_names(blocks: str, bands: list) -> Column:
    """Names of all blocks of these bands: the band and the block in it, by the number of blocks in each (a map)."""
    of_band = lambda b: F.transform(F.sequence(F.lit(0).cast("long"), F.element_at(blocks, b) - 1), lambda k: b * BAND + k)
    return F.flatten(F.transform(F.filter(F.array(*bands), lambda b: F.element_at(blocks, b) > 0), of_band))


def _may_link(c, share: int):
    """Whether an overlap of ``c`` in the prefixes, and all that may follow them, reaches what two sizes ask for."""
    need = F.ceil(F.lit(share) * (F.col("na") + F.col("nb")) / F.lit(100 + share))
    rest = F.greatest(*(F.ceil(F.lit(share) * F.col(n) / F.lit(100)) - 1 for n in ("na", "nb")))
    return (F.lit(100) * F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")) & (c >= need - rest)


def _shared_prefixes(docs: DataFrame, classes: DataFrame, words: int, share: int) -> DataFrame:
    """(gram, df, id, n): the prefix n-grams of each class (by its representative) that two classes share at least."""
    docs = docs.filter("doc_id is not null")
    # n-grams that are common among the prefixes by hash alone go to the end of the order, the same for all documents
    counts = docs.mapInArrow(_prefix_counts(words, share), "gram long, df long").repartition("gram")
    common = materialize(counts.groupBy("gram").agg(F.sum("df").alias("df")).filter(F.col("df") > SMALL_BUCKET).select("gram"), "common")
    dealt = docs.mapInArrow(_prefixes(Filter.of(common, common.count()), words, share), "gram long, salt tinyint, key long").repartition("gram", "salt")
    part = Window.partitionBy("gram", "salt")
    once = dealt.withColumn("before", F.lag("key").over(part.orderBy("key"))).filter("before is null or before <> key").drop("before")
    once = materialize(once.withColumn("part", F.count("*").over(part)).filter("part > 1 or salt > 0"), "once")
    # the parts of a common n-gram, one row for each, get its whole count
    parts = once.filter("salt > 0").groupBy("gram", "salt").agg(F.count("*").alias("part"))
    whole = parts.groupBy("gram").agg(F.sum("part").alias("df")).filter("df > 1")
    whole = parts.select("gram", "salt").join(whole, "gram")
    shared = once.filter("salt = 0").select("gram", "key", F.col("part").alias("df")).unionByName(once.filter("salt > 0").join(whole, ["gram", "salt"]).select("gram", "key", "df"))
    named = materialize(shared.join(classes.select("key", "n", F.col("rep").alias("id")), "key").select("gram", "df", "id", F.col("n").cast("int").alias("n")), "prefixes")
    drop_materialized(common, once)
    return named


def _small_pairs(bucketed: DataFrame, left_out: DataFrame, share: int) -> DataFrame:
    """(a, b): pairs whose small n-grams, and all that was left out, may reach the overlap that their sizes ask for."""
    small = bucketed.filter("small").groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("m"))
    small = small.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.slice("m", F.col("i") + 2, SMALL_BUCKET)).alias("y"))
    counted = small.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).agg(F.count("*").alias("c"))
    large_a, large_b = (left_out.select(F.col("id").alias(x), F.col("large").alias(f"large_{x}")) for x in "ab")
    counted = counted.filter(F.lit(100) * F.least("na", "nb") >= F.lit(share) * F.greatest("na", "nb")).join(large_a, "a").join(large_b, "b")
    return counted.filter(_may_link(F.col("c") + F.least("large_a", "large_b"), share)).select("a", "b")


def _family_tasks(large: DataFrame, comp: DataFrame, share: int) -> DataFrame | None:
    """Blocks to compare (k, i, j, side, id, comp) of what pivots leave, or None.

    That is the n-grams whose classes lie in different components. Such an n-gram belongs to the component that most of
    its classes are in, and the classes of a component's n-grams form its family. Those outside the component are
    compared with each other and with those inside, where sizes allow a link.
    """
    placed = large.select("gram", "id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("gram", "id", "n", F.coalesce("component", "id").alias("comp"))
    most = placed.groupBy("gram", "comp").agg(F.count("*").alias("size")).groupBy("gram").agg(F.max(F.struct("size", "comp")).getField("comp").alias("p"), F.count("*").alias("comps"))
    family = placed.join(most.filter("comps > 1").select("gram", "p"), "gram").select("p", "id", "n", "comp").distinct()
    # a family of one block needs no bands
    large_ones = family.groupBy("p").agg((F.count("*") > BLOCK_ROWS).alias("many"))
    family = family.join(large_ones, "p").withColumn("at_home", F.col("comp") == F.col("p")).withColumn("band", F.when(F.col("many"), _bands(share)).otherwise(F.lit(0).cast("long"))).drop("many")
    family = materialize(_in_blocks(family, ["p", "at_home", "band"]), "families")
    if family.isEmpty():
        return None
    numbers = family.select("p", "at_home", "band", "blocks").distinct().groupBy("p").agg(
        *(F.map_from_entries(F.collect_list(F.when(F.col("at_home") == home, F.struct("band", "blocks")))).alias(name) for name, home in (("home", True), ("away", False)))
    )
    family = family.join(numbers, "p").withColumn("name", F.col("band") * BAND + F.col("block"))
    base, near = ["id", "comp"], [F.col("band") + k for k in (-1, 0, 1)]
    k, rest = F.col("p").alias("k"), family.filter("not at_home")
    tasks = family.filter("at_home").select(k, F.col("name").alias("i"), F.explode(_block_names("away", near)).alias("j"), F.lit(0).alias("side"), *base)
    tasks = tasks.unionByName(rest.select(k, F.explode(_block_names("home", near)).alias("i"), F.col("name").alias("j"), F.lit(1).alias("side"), *base))
    # among the rest: block i <= j, under numbers below 0
    up, down = (F.filter(_block_names("away", near), f) for f in (lambda b: b >= F.col("name"), lambda b: b <= F.col("name")))
    low = rest.select(k, (-1 - F.col("name")).alias("i"), F.explode(up).alias("j"), F.lit(0).alias("side"), *base)
    high = rest.select(k, F.explode(F.transform(down, lambda b: -1 - b)).alias("i"), F.col("name").alias("j"), F.lit(1).alias("side"), *base)
    return tasks.unionByName(low).unionByName(high)


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are left aside).

    Two documents link when ``100 * overlap >= share * union`` of their sets of lower-cased (A-Z) ``words``-word
    shingles; component_id is the smallest doc_id that links reach. A null or blank text has an empty set and stays
    alone, as does a row without doc_id (component null); repeated rows fall into one class; an empty table gives none.
    Texts of any length are read whole.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    of_docs = materialize(docs.mapInArrow(_signatures(words), "doc_id long, n long, key long, low long"), "signatures")
    classes = materialize(of_docs.filter("n > 0 and doc_id is not null").groupBy("key", "low", "n").agg(F.min("doc_id").alias("rep")), "classes")
    named = _shared_prefixes(docs, classes, words, share)
    bucketed = named.withColumn("small", F.col("df") <= SMALL_BUCKET)
    # how much of a class's prefix the first counts leave out
    left_out = bucketed.groupBy("id").agg(F.count_if(~F.col("small")).alias("large"), F.avg("df").alias("shared"))
    near = _small_pairs(bucketed, left_out, share)

    large = bucketed.filter(~F.col("small")).select("gram", "id", "n")
    # an n-gram's pivot: the class whose n-grams are the most shared, as the common source of a group of copies is; a
    # class is compared with the foremost of its n-grams' pivots
    pivots = large.join(left_out.select("id", "shared"), "id").groupBy("gram").agg(F.max("shared").alias("of_p"), F.max_by("id", F.struct("shared", "id")).alias("p"))
    starred = large.join(pivots, "gram").groupBy("id", "n").agg(F.max_by("p", F.struct("of_p", "p")).alias("p")).filter("id <> p").select("p", "id", "n")
    starred = starred.join(classes.select(F.col("rep").alias("p"), F.col("n").alias("m")), "p").filter(F.lit(100) * F.least("n", "m") >= F.lit(share) * F.greatest("n", "m"))
    pairs = materialize(near.select(F.col("a").alias("k"), F.col("b").alias("id")).unionByName(starred.select(F.col("p").alias("k"), "id")).distinct(), "pairs")
    wanted = pairs.select("id").union(pairs.select("k")).union(large.select("id")).distinct()
    rows = _incidence_rows(docs, wanted, words)
    dealt = _in_blocks(pairs, ["k"])
    whole = F.lit(-1).cast("long").alias("j")
    tasks = dealt.select("k", F.col("block").alias("i"), whole, F.lit(1).alias("side"), "id", F.col("id").alias("comp"))
    tasks = tasks.unionByName(dealt.select("k", F.col("block").alias("i")).distinct().select("k", "i", whole, F.lit(0).alias("side"), F.col("k").alias("id"), F.col("k").alias("comp")))
    links = _links(tasks, rows, share, "links")
    comp = materialize(components(links), "components")
    tasks = _family_tasks(large, comp, share)
    if tasks is not None:
        # first the prefixes alone, which few rows of other components pass, then the whole rows of these
        grams = large.groupBy("id", "n").agg(F.collect_list("gram").alias("grams"))
        tasks = _dealt(tasks.join(grams, "id"))
        tasks = materialize(tasks.groupBy("k", "i", "j").applyInPandas(_block_candidates(share), "k long, i long, j long, side int, id long, comp long"), "candidates")
        more = _links(tasks, rows, share, "links")
        if not more.isEmpty():
            comp = materialize(components(links.unionByName(more)), "components")
        drop_materialized(tasks, more)
    drop_materialized(named, pairs, rows, links)
    of_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "low", "n", F.coalesce("component", "rep").alias("component_id"))
    return of_docs.join(of_class, ["key", "low", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
