"""Near-duplicate detection by circulant MinHash.

Two permutations of the 32-bit universe make all signature coordinates: shingles are sent
through the first once, and coordinate k is the smallest value of the second, shifted
circularly by k. Coordinates are banded; documents that share a band are candidates, and a
candidate pair links only if its full shingle sets do (exact Jaccard).

Skew. Documents with equal shingle sets are one class with one representative, so exact
copies meet once. In a bucket of at most ``SMALL`` members all pairs are candidates. In a
larger one every member is compared with one leader, the member that shares the most bucket
places (the original of a group of near copies). A large bucket whose members are in one
component by then is done. The members of the others (documents that share a passage but
link with few or none) meet again by the prefix filter: a document's shingles are ranked by
how rare they are, and two sets that reach the percentage have one of their first
``n - ceil(percent * n) + 1`` shingles in common, whatever the ranking is. So the rest of
these candidates are the pairs with a common rare shingle, which no link escapes; a shared
passage's shingles rank last and make no bucket. Rarity is read from a table of ``SLOTS``
counters, so its size doesn't follow the corpus. What is left of a large bucket of that
kind is compared whole, in pairs of blocks of bounded size: the product of two blocks'
incidence matrices has the exact intersections, and only a spanning forest of the links
comes back. That is an exact way for the rest, without a row for each pair.

The bands' shape follows from the percentage (``shape``): a pair at it goes unseen with
probability 4e-6, at 0.85 with 32 bands of 7 rows.

Edge cases: a document without words or with a null text has an empty set and links with
nothing; one of fewer than five words has its whole sequence as one shingle, a very long one
is hashed in strips and compared alone; rows of one id are one document with the links of
all their texts, and get its component each; a null id links with nothing; ties between
documents go to the smaller id; an empty table gives an empty result; other columns are
ignored (``keep_first`` returns them, one row per kept id).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, materialize, mix64, shingle_hashes, slices, word_hashes
from skein.llm.components import components, forest

BANDS, ROWS = 32, 7
#: Shingles that are permuted at once (bounds memory and fits caches).
STRIP = 2048
#: Members of a bucket that are all compared with each other; pairs of a document that are
#: verified by one task at most, about.
SMALL, CHUNK = 12, 256
#: Members, and bytes of their sets, in one block of a large bucket of the prefix filter.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Columns of an incidence matrix that are in memory at once.
COLUMNS = 4096
#: Counters that tell how rare a shingle is.
SLOTS = 1 << 20
#: Probability that a pair at the percentage shares no band, and coordinates at most.
MISS, COORDINATES = 4.3e-6, 256

SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, coordinates binary"


def shape(percent: int) -> tuple[int, int, float]:
    """(bands, rows, floor) for links at ``percent``: the most rows a band whose bands fit in
    ``COORDINATES`` coordinates. A pair whose signatures agree in less than the floor can't
    reach the percentage (five deviations)."""
    share = min(max(percent, 1), 99) / 100
    bands = lambda rows: math.ceil(math.log(MISS) / math.log1p(-(share**rows)))
    rows = max((r for r in range(1, COORDINATES + 1) if r * bands(r) <= COORDINATES), default=1)
    size = rows * bands(rows)
    return bands(rows), rows, max(0.0, math.floor(100 * (share - 5 * math.sqrt(share * (1 - share) / size))) / 100)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash coordinates of a set of 64-bit shingle hashes."""
    first = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    shift = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(first), STRIP):
        x = first[None, at : at + STRIP] + shift  # the circular shift; it wraps at 2**32
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE3D)
        np.minimum(least, x.min(1), out=least)
    return least


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    h = np.arange(1, len(coordinates) // rows + 1, dtype=np.uint64)
    for column in coordinates.reshape(-1, rows).T:
        h = mix64(h ^ column.astype(np.uint64))
    return h


def sign(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """Per row: doc_id, size and two checksums of its shingle set, band keys, coordinates."""
    n_bands, rows, _ = shape(percent)
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, edges = word_hashes(part.column("text").to_pylist())
                n, k1, k2, bands, coordinates = [], [], [], [], []
                for a, b in zip(edges, edges[1:]):
                    s = np.unique(shingle_hashes(words[a:b], shingle))
                    n.append(len(s))
                    other = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    k1.append(np.bitwise_xor.reduce(other).astype(np.int64) if len(s) else 0)
                    k2.append(other.sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                    c = signature(s, n_bands * rows)
                    bands.append(band_keys(c, rows).astype(np.int64) if len(s) else [])
                    coordinates.append((c & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else b"")
                arrays = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(coordinates, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "k1", "k2", "bands", "coordinates"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNED)


def _agreeing(pairs: DataFrame, signs: DataFrame, floor: float) -> DataFrame:
    """The pairs (hub, other) whose signatures agree well enough to be compared exactly."""
    a = signs.select(F.col("rep").alias("hub"), F.col("coordinates").alias("x"))
    b = signs.select(F.col("rep").alias("other"), F.col("coordinates").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            keep = pa.array((x == y).mean(1) >= floor) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["hub", "other"]).filter(keep)

    met = pairs.join(a, "hub").join(b, "other").select("hub", "other", "x", "y")
    return met.mapInArrow(run, "hub long, other long").distinct()


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids, each text of an id once. Ids grow with the documents, so they
    aren't broadcast."""
    found = docs.join(ids.hint("merge"), "doc_id", "left_semi").withColumn("h", F.xxhash64("text"))
    return materialize(found.dropDuplicates(["doc_id", "h"]).select("doc_id", "text"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b): the pairs whose full sets have 100 * intersection >= percent * union. A hub's text
    goes to each task that has some of its pairs, not to each pair."""
    counts = materialize(pairs.groupBy("hub").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")), "hubs")
    hubs = texts.join(counts.withColumnRenamed("hub", "doc_id"), "doc_id").select(F.col("doc_id").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("other"), "text")
    dealt = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), "other")
    others = dealt.join(texts.withColumnRenamed("doc_id", "other"), "other").select("hub", "part", "other", "text")
    rows = hubs.unionByName(others).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("other"))

    def run(batches):
        of, held = None, []
        for batch in batches:
            for rows in slices(batch, "text"):
                words, edges = word_hashes(rows.column("text").to_pylist())
                keys = list(zip(*(rows.column(c).to_pylist() for c in ("hub", "part", "other"))))
                found = []
                for (hub, part, other), p, q in zip(keys, edges, edges[1:]):
                    own = np.unique(shingle_hashes(words[p:q], shingle))
                    if other is None:
                        of, held = (hub, part), [*(held if of == (hub, part) else []), own]
                        continue
                    for one in held:
                        common = len(np.intersect1d(one, own, assume_unique=True))
                        if common and 100 * common >= percent * (len(one) + len(own) - common):
                            found.append((hub, other))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return materialize(rows.mapInArrow(run, "a long, b long"), "links")


def _alike(percent: int, n, m):
    """Whether sets of these sizes can reach the percentage."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _members(places: DataFrame) -> DataFrame:
    """(key, size, rep, n, weight, ...): the members of buckets with at least two, the size of
    their bucket, and how many places they share with others."""
    sizes = materialize(places.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    held = materialize(places.join(sizes, "key"), "places")
    weight = held.groupBy("rep").agg(F.sum("size").alias("weight"))
    return materialize(held.join(weight, "rep"), "members")


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(hub, other): all pairs of the buckets of at most ``SMALL`` members that are in different
    components. The hub is the one with the larger weight."""
    held = members.filter(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("weight", "rep", "n", "component")), asc=False).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x["rep"].alias("hub"), y["rep"].alias("other"), ((x["component"] != y["component"]) & _alike(percent, x["n"], y["n"])).alias("ok")))))
    return held.select(F.explode(F.filter(pairs, lambda p: p["ok"])).alias("p")).select("p.hub", "p.other")


def _led_pairs(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """(hub, other): each leader (key, rep, n) with the members of its bucket."""
    lead = leaders.select("key", *[F.col(c).alias(f"l_{c}") for c in ("rep", "n")])
    met = members.join(lead, "key").filter((F.col("rep") != F.col("l_rep")) & _alike(percent, F.col("n"), F.col("l_n")))
    return met.select(F.col("l_rep").alias("hub"), F.col("rep").alias("other"))


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    known = found.select(F.col("node").alias("rep"), F.col("component").alias("__c"))
    return members.drop("component").join(known, "rep", "left").withColumn("component", F.coalesce("__c", "rep")).drop("__c")


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one component, with their size now, how many
    shingles they have in all, and the smallest set's size."""
    going = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"), F.sum("n").alias("all"), F.min("n").alias("least"))
    going = going.filter("low < high").drop("low", "high")
    return materialize(members.drop("size", "all", "least").join(materialize(going, "going"), "key"), "open")


def _rare_sets(texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(rep, n, shingles, prefix): a document's set, and the rarest of its shingles that any set
    which reaches the percentage must share one of, rarest first."""
    spark = texts.sparkSession

    def sets(batch):
        for part in slices(batch, "text"):
            words, edges = word_hashes(part.column("text").to_pylist())
            for key, p, q in zip(part.column("doc_id").to_pylist(), edges, edges[1:]):
                yield key, np.unique(shingle_hashes(words[p:q], shingle))

    def count(batches):
        slots = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, own in sets(batch):
                np.add.at(slots, (own >> np.uint64(44)).astype(np.int64), 1)
        for at in np.array_split(np.flatnonzero(slots), max(1, np.count_nonzero(slots) // 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(slots[at], pa.int64())], names=["slot", "n"])

    counted = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # a byte a slot: quarter steps of its logarithm
    counted = counted.select(F.col("slot").cast("int").alias("slot"), F.least(F.lit(255), F.floor(4 * F.log2(F.col("n") + 1))).cast("int").alias("n")).toPandas()
    rarity = np.zeros(SLOTS, np.uint8)
    rarity[counted["slot"].to_numpy()] = counted["n"].to_numpy()
    shared = spark.sparkContext.broadcast(rarity)

    def prefixes(batches):
        rarity = shared.value
        for batch in batches:
            rows = []
            for key, own in sets(batch):
                first = len(own) - -(-percent * len(own) // 100) + 1 if len(own) else 0
                rare = own[np.lexsort((own, rarity[(own >> np.uint64(44)).astype(np.int64)]))[:first]]
                rows.append((key, len(own), own.tobytes(), rare.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["rep", "n", "shingles", "prefix"])

    return materialize(texts.mapInArrow(prefixes, "rep long, n long, shingles binary, prefix array<long>"), "sets")


def _exact(table: pa.Table, percent: int) -> pa.Table:
    """(a, b) that connect the links between two blocks of a bucket, or within one."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    block = np.array(table.column("block").to_pylist())
    rep, component = (np.array(table.column(c).to_pylist(), np.int64) for c in ("rep", "component"))
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    n = np.array([len(x) for x in sets])
    words, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    row, column = row[times[column] > 1], (np.cumsum(times > 1) - 1)[column[times[column] > 1]]  # others meet nothing
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    ours, theirs = np.flatnonzero(block == low), np.flatnonzero(block == high)
    common = np.zeros((len(ours), len(theirs)), np.float32)
    for at in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - at] = 1
        common += held[ours] @ held[theirs].T
    linked = (100 * common.astype(np.int64) >= percent * (n[ours][:, None] + n[theirs][None, :] - common.astype(np.int64))) & (component[ours][:, None] != component[theirs][None, :])
    i, j = np.nonzero(linked)
    nodes, to = forest(rep[ours[i]], rep[theirs[j]]) if len(i) else (rep[:0], rep[:0])
    return pa.table({"a": nodes[nodes != to], "b": to[nodes != to]})


def _whole(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that connect all links in the buckets of more than ``SMALL`` members."""
    held = members.filter(F.col("size") > SMALL)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("all") / BLOCK_BYTES)).cast("int")
    held = held.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    held = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("key", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "rep", "component")
    rows = held.join(sets.select("rep", "shingles"), "rep")
    return materialize(rows.groupBy("key", "low", "high").applyInArrow(lambda t: _exact(t, percent), "a long, b long"), "links")


def _edges(signs: DataFrame, docs: DataFrame, percent: int, shingle: int, floor: float) -> DataFrame:
    """(a, b): links between representatives that connect all that are linked."""
    places = signs.select(F.explode("bands").alias("key"), "rep", F.col("n_shingles").alias("n"))
    members = _members(places).withColumn("component", F.col("rep"))
    texts = _texts(docs, members.select(F.col("rep").alias("doc_id")).distinct())
    large = members.filter(F.col("size") > SMALL)
    leaders = materialize(large.groupBy("key").agg(F.max(F.struct("weight", "rep", "n")).alias("x")).select("key", "x.rep", "x.n"), "leaders")
    pairs = _small_pairs(members, percent).unionByName(_led_pairs(large, leaders, percent))
    # a pair may be met with either as the hub
    pairs = pairs.groupBy(F.least("hub", "other").alias("x"), F.greatest("hub", "other").alias("y")).agg(F.min("hub").alias("hub"))
    pairs = materialize(pairs.select("hub", F.when(F.col("hub") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("other")), "pairs")
    links = _verified(materialize(_agreeing(pairs, signs, floor), "agreeing"), texts, percent, shingle)
    found = components(links)
    rest = _open(_with_components(large, found).join(leaders.select("key", "rep"), ["key", "rep"], "left_anti"))
    crowd = rest.select(F.col("rep").alias("doc_id")).distinct()
    if crowd.isEmpty():
        return links
    sets = _rare_sets(texts.join(crowd, "doc_id", "left_semi"), percent, shingle)
    ranked = sets.select("rep", "n", F.posexplode("prefix").alias("before", "key")).select("key", "rep", "n", (F.col("n") - F.col("before")).alias("after")).distinct()
    members = _open(_with_components(_members(ranked), found))
    # what follows the first common shingle bounds what two sets have in common
    enough = (100 + percent) * F.col("after") >= percent * (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)))
    members = _open(members.filter(enough))
    return links.unionByName(_verified(materialize(_small_pairs(members, percent).distinct(), "pairs"), texts, percent, shingle)).unionByName(_whole(members, sets, percent))


def link(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    docs, floor = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shape(percent)[2]
    signed = materialize(sign(docs, shingle, percent), "signed")
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    # one representative for each set of shingles
    classes = materialize(some.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    of = signed.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2", "n_shingles"], "left")
    of = materialize(of.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), "of")
    firsts = classes.withColumnRenamed("rep", "doc_id")
    signs = some.join(firsts, ["doc_id", "k1", "k2", "n_shingles"], "left_semi").dropDuplicates(["doc_id", "k1", "k2", "n_shingles"])
    signs = materialize(signs.select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "coordinates"), "signs")
    # an id whose rows hold several sets ties their classes
    ties = of.filter("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    ties = ties.filter("a < b").select("a", "b").unionByName(ties.filter("a < b").select(F.col("doc_id").alias("a"), F.col("a").alias("b")))
    found = components(_edges(signs, docs, percent, shingle, floor).unionByName(ties)).withColumnRenamed("node", "rep")
    joined = of.join(found, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, percent: int = 85, shingle: int = 5) -> DataFrame:
    """The row of ``docs`` of the smallest id of each component, with all its columns; of several
    rows of one id the one whose text has the smallest hash. Rows with a null id stay."""
    found = link(docs, percent, shingle).groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or("kept").alias("__kept"), F.count("*").alias("__rows"))
    found = materialize(found.filter("__kept").select("__id", ((F.col("__rows") > 1) & F.col("__id").isNotNull()).alias("__again")), "kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # ids grow with the documents, so they aren't broadcast
    held = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__id")))
    if found.filter("__again").isEmpty():
        return held.select(*names)
    one = held.filter("__again").groupBy("__id").agg(F.min_by(F.struct(*names), F.xxhash64("text")).alias("__row"))
    return held.filter("not __again").select(*names).unionByName(one.select("__row.*"))
