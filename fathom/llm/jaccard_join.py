"""N-gram Jaccard join: documents whose sets of k-word shingles overlap enough, as connected classes.

The document by n-gram incidence matrix A is multiplied with its transpose in
blocks, so far as size bounds leave cells to fill:

1. One pass hashes each text's distinct shingles, and counts all shingles of the
   corpus in a sketch of fixed size. The counts order the shingles, rare ones
   first, with the hash after that: an order over the whole corpus. Exact copies
   of a set fall into one class, by a 128-bit digest.
2. Two sets of sizes na and nb with Jaccard >= t share `need` = ceil(t (na + nb) / (1 + t))
   shingles at least, so their first shared one has a place of na - need at most in one
   and nb - need in the other. Only the columns of A up to place n - ceil(t n) are shuffled;
   a cell is filled only if both places keep to the bound of the two sizes.
3. What is left is multiplied in full: blocks of rows against one row's columns.

Tables that grow with the corpus are joined by merging at every size, never broadcast.

A column of thousands of near copies isn't expanded into all pairs. Its members meet
its pivots first: in each band of sizes the member in which the column has the first
place, that is, with the fewest shingles of its own. These links are verified and
joined into components. Only cells between two components are left to look at: members
meet more pivots in each round, until no column spans two components and has
members that have not met. Before each round a column loses the members that fit with no
member of another component; in columns that unrelated texts share by chance, most do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, chunks, cut, dealt_anew, forget, partitions, shingle_sets
from .graph import components

#: Counters of the sketch, and the blocks in which tasks pass them on. Its size doesn't grow with the data.
SKETCH, BLOCKS = 1 << 21, 32
#: A column has one pivot for each band of sizes in the first round, and so many times more pivots in each next round.
MORE = 16
#: Lists of so many members at most are searched whole for members without a partner; longer ones keep all of theirs.
SEARCHED = 1024


def _least(t: float, n: np.ndarray) -> np.ndarray:
    """ceil(t n) without the error of floating point: t counts in thousandths."""
    return -((-round(t * 1000) * n) // 1000)


def _survey(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in chunks(batches):
            sets = list(shingle_sets(batch.column("text"), k))
            if any(map(len, sets)):
                counts += np.bincount(np.concatenate(sets) & np.uint64(SKETCH - 1), minlength=SKETCH).astype(np.uint32)
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "block", "counts"])
        if counts.any():
            parts = np.minimum(counts, 255).astype(np.uint8).reshape(BLOCKS, -1)
            none = pa.nulls(BLOCKS).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "block", "counts"])

    return run


def _add_blocks(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                total[block] = total.get(block, np.zeros(SKETCH // BLOCKS, np.uint32)) + np.frombuffer(counts, kind)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["block", "counts"])

    return run


def _sketch(blocks: DataFrame) -> np.ndarray:
    """The corpus's counters as levels of a logarithm, one byte each."""
    n = partitions(blocks.sparkSession)
    salted = blocks.withColumn("salt", F.spark_partition_id() % 8)
    some = salted.repartition(n, "block", "salt").select("block", "counts").mapInArrow(_add_blocks(np.uint8), "block int, counts binary")
    whole = some.repartition(n, "block").mapInArrow(_add_blocks(np.uint32), "block int, counts binary")
    counts = np.zeros((BLOCKS, SKETCH // BLOCKS), np.float64)
    for block, part in whole.collect():  # BLOCKS rows, SKETCH counters
        counts[block] = np.frombuffer(bytes(part), np.uint32)
    return np.minimum(255, np.log2(1 + counts.reshape(-1)) * 8).astype(np.uint8)


def _ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles in the corpus's order."""
    level = levels[shingles & np.uint64(SKETCH - 1)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (shingles >> np.uint64(8)))


def _prefixes(k: int, t: float, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = levels.value
        for batch in chunks(batches):
            seen, keys, ids, sizes = set(), [], [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k)):
                if doc_id is None or not len(s) or (digest := s.tobytes()) in seen:
                    continue  # a copy in the same batch: its class stands for it
                seen.add(digest)
                keys.append(_ordered(s, order)[: len(s) - int(_least(t, len(s))) + 1])
                ids.append(doc_id)
                sizes.append(len(s))
            if keys:
                many = np.array([len(x) for x in keys])
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(place.astype(np.int32))], ["g", "doc", "n", "place"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k)], pa.binary())], ["doc", "shingles"])

    return run


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows b times row a of the incidence matrix: one block for each run of equal a."""
    for batch in batches:
        a, rows = batch.column("a").to_pylist(), batch.column("rows_b")
        left, overlap, i = batch.column("row_a"), np.zeros(batch.num_rows, np.int64), 0
        while i < len(a):
            j = i
            columns = left[i].as_buffer()
            while j < len(a) and a[j] == a[i] and left[j].as_buffer().equals(columns):
                j += 1
            columns = np.frombuffer(columns, np.uint64)
            parts = [np.frombuffer(rows[x].as_buffer(), np.uint64) for x in range(i, j)]
            sizes = np.array([len(p) for p in parts])
            block = np.concatenate(parts)
            at = np.minimum(np.searchsorted(columns, block), len(columns) - 1)
            cells = np.concatenate([[0], np.cumsum(columns[at] == block)])
            ends = np.cumsum(sizes)
            overlap[i:j] = cells[ends] - cells[ends - sizes]
            i = j
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("na"), batch.column("nb"), pa.array(overlap)], ["a", "b", "na", "nb", "overlap"])


def _verified(docs: DataFrame, k: int, pairs: DataFrame, permille: int, many: bool) -> DataFrame:
    """The pairs (a, b) that have Jaccard >= t, after their rows are multiplied in full. `many`: the pairs grow with the corpus."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if many:
        pairs, wanted = pairs.hint("merge"), wanted.hint("merge")
    sets = cut(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(k), "doc long, shingles binary"), "sets")
    right = pairs.join(sets.withColumnsRenamed({"doc": "b", "shingles": "rows_b"}), "b")
    both = (right.hint("merge") if many else right).join(sets.withColumnsRenamed({"doc": "a", "shingles": "row_a"}), "a")
    both = both.select("a", "b", (F.octet_length("row_a") / 8).cast("long").alias("na"), (F.octet_length("rows_b") / 8).cast("long").alias("nb"), "row_a", "rows_b")
    counted = both.mapInArrow(_multiply, "a long, b long, na long, nb long, overlap long")
    links = cut(counted.where(f"1000 * overlap >= {permille} * (na + nb - overlap)").select("a", "b"), "verified")
    forget(sets)
    return links


def _fits(permille: int) -> str:
    """Whether the first shared shingle may have places a.place and b.place in sets of a.n and b.n shingles."""
    need = f"((1000 + {permille} - 1 + {permille} * cast(a.n + b.n as long)) div (1000 + {permille}))"
    return f"a.n - a.place >= {need} and b.n - b.place >= {need}"


def _have_room(n: np.ndarray, place: np.ndarray, component: np.ndarray, start: np.ndarray, permille: int) -> np.ndarray:
    """Which members of lists fit (see `_fits`) with a member of another component. `start`: where each one's list begins; lists are ordered by n.

    a and b fit where each one's size is within the other's reach. So a has a partner if, among the
    members with sizes within its reach, the furthest reach of another component gets to a's size.
    """
    reach = (n - place) * (1000 + permille) // permille - n
    far, whose, other = reach, component, np.full(len(n), -1)  # furthest reach up to here in the list, its component, furthest of the others
    inside, step = np.arange(len(n)) - start, 1
    while step <= inside.max():
        i = np.flatnonzero(inside >= step)
        j = i - step
        same, ahead = whose[i] == whose[j], far[i] >= far[j]
        second = np.where(same, np.maximum(other[i], other[j]), np.where(ahead, np.maximum(far[j], other[i]), np.maximum(far[i], other[j])))
        first, name = np.maximum(far[i], far[j]), np.where(ahead, whose[i], whose[j])
        far, whose, other = far.copy(), whose.copy(), other.copy()
        far[i], whose[i], other[i] = first, name, second
        step *= 2
    wide = max(n.max(), reach.max()) + 1
    stop = np.searchsorted(start * wide + n, start * wide + np.maximum(reach, 0), side="right")
    at = np.maximum(stop - 1, 0)
    return (stop > start) & (np.where(whose[at] == component, other[at], far[at]) >= n)


def _without_lone(permille: int):
    """Lists, ordered by g and n, without the members that have no partner; m counts those that stay."""

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        g, n, place, component = (table.column(c).to_numpy().astype(np.int64) for c in ("g", "n", "place", "component"))
        begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(begins, len(g)))
        stay = _have_room(n, place, component, np.repeat(begins, sizes), permille)
        m = np.repeat(np.add.reduceat(stay.astype(np.int64), begins), sizes)
        yield from table.set_column(table.schema.get_field_index("m"), table.schema.field("m"), pa.array(m)).filter(pa.array(stay)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the list at the end of what was read may go on
        for batch in batches:
            long = batch.column("m").to_numpy() > SEARCHED
            if long.any():
                yield batch.filter(pa.array(long))
                batch = batch.filter(pa.array(~long))
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            last = int(np.searchsorted(g, g[-1]))
            if last or held and held[-1].column("g")[0].as_py() != g[0]:
                yield from judged(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from judged(pa.Table.from_batches(held))

    return run


def _with_partners(lists: DataFrame, permille: int) -> DataFrame:
    """The members of lists of m members (or fewer) that fit with one of another component; all members of long lists, which are dealt out."""
    lists = lists.select("g", "doc", "n", "place", "band", "component", "m")
    dealt = lists.repartition("g", F.when(F.col("m") > SEARCHED, F.col("doc"))).sortWithinPartitions("g", "n")
    return dealt.mapInArrow(_without_lone(permille), "g long, doc long, n int, place int, band int, component long, m long")


def _still_open(lists: DataFrame, joined: DataFrame, met: int, permille: int) -> DataFrame:
    """The lists of more than `met` members that hold two components; with current components, members with partners and their number (m)."""
    named = lists.drop("component", "m").join(joined.withColumnRenamed("node", "doc").hint("merge"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = cut(named, "named")
    spans = named.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
    spanning = named.join(dealt_anew(spans.where(f"low < high and m > {met}").select("g", "m"), "g"), "g")
    out = cut(_with_partners(spanning, permille), "lists")
    forget(named, lists)
    return out


def _cells(lists: DataFrame, pivots: int, permille: int) -> DataFrame:
    """Pairs a < b of two components whose places and sizes leave room for a link, one of each being a pivot of its list and band of sizes.

    A single pivot is the member with the lowest place; of more, each member of a list is one by
    the hash of its id: `pivots` of them or so, and all of them where the list has no more.
    """
    if pivots == 1:
        lowest = lists.groupBy("g", "band").agg(F.min(F.struct("place", "doc", "n", "component")).alias("low"))
        first = lowest.select("g", "band", "low.*")
    else:
        first = lists.where(F.pmod(F.xxhash64("doc"), F.col("m")) < pivots)
    first = first.select("g", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "doc", "n", "place", "component")
    cells = lists.alias("a").join(first.alias("b"), ["g", "band"]).where(f"a.doc <> b.doc and a.component <> b.component and {_fits(permille)}")
    return cells.select(F.least("a.doc", "b.doc").alias("a"), F.greatest("a.doc", "b.doc").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    A text's set holds its distinct k-word shingles (words split at ASCII white space,
    A-Z lower-cased; a text of fewer words has its whole sequence as one). Two texts
    link when intersection / union >= threshold (counted in thousandths); component_id
    is the smallest doc_id that links reach. Null, empty and blank texts have no
    shingles, link with nothing and are their own component. Rows with a null doc_id
    are kept with a null component_id. Rows that share a doc_id count as one node, which
    has the links of each of their texts. An empty table gives no rows; other columns are
    not read. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    permille = round(threshold * 1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    survey = cut(docs.mapInArrow(_survey(k), "doc_id long, n_shingles long, d1 long, d2 long, block int, counts binary"), "survey")
    members = survey.where("block is null").select("doc_id", "n_shingles", "d1", "d2")
    levels = spark.sparkContext.broadcast(_sketch(survey.where("block is not null").select("block", "counts")))

    full = members.where("n_shingles > 0 and doc_id is not null")
    classes = dealt_anew(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep")), "d1", "d2", "n_shingles")
    stands = cut(full.join(classes, ["d1", "d2", "n_shingles"]).select(F.col("doc_id").alias("doc"), "n_shingles", "rep").distinct(), "classes")

    postings = cut(docs.mapInArrow(_prefixes(k, threshold, levels), "g long, doc long, n int, place int"), "columns")
    levels.unpersist()
    shared = cut(postings.groupBy("g").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("m")).where("low < high").select("g", "m"), "shared")
    several = postings.join(shared.hint("merge"), "g").join(stands.withColumnRenamed("n_shingles", "n").hint("merge"), ["doc", "n"])
    # bands of sizes such that sets that may link lie in the same or in neighbouring bands
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    lists = several.select("g", F.col("rep").alias("doc"), "n", "place", "m").distinct().withColumn("band", band).withColumn("component", F.col("doc"))
    lists = cut(_with_partners(lists, permille), "lists")
    forget(postings, shared)

    copies = stands.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    links, joined, seen, pivots = copies, None, None, 1
    while not lists.isEmpty():
        pairs = _cells(lists, pivots, permille)
        pairs = cut(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        if joined is None or not pairs.isEmpty():
            found = _verified(docs, k, pairs, permille, pivots == 1)
            if joined is None or not found.isEmpty():
                links = links.unionByName(found)
                joined = components(links)
        seen = pairs if seen is None else seen.unionByName(pairs)
        lists = _still_open(lists, joined, max(2, pivots), permille)  # two members have met, one of them being the pivot
        pivots *= MORE
    named = (joined if joined is not None else components(links)).withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    return members.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """3-word shingles, Jaccard >= 0.9, over the whole documents table."""
    from .common import documents

    return near_duplicates(documents(spark, sf_dir), k=3, threshold=0.9)
