"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct five-word shingles.  Fast similarity sketching throws
every element of the set into one of 128 bins, round after round with fresh hashes;
a bin keeps the smallest value of the first round that reaches it.  From round 128
on, round 128 + j throws all elements into bin j, so every bin is filled after 256 rounds
at most, and the share of equal bins of two sets is concentrated around their Jaccard
similarity.  Thirty-two bands of four bins give the bucket keys: two sets of similarity
0.75 share no bucket with probability (1 - 0.75 ** 4) ** 32 = 5e-6.

Equal sets are one class, which its smallest document stands for.  Within a bucket no pairs are formed at
first: every class is paired with the bucket's smallest, its leader, and the leader with which a class shares most
buckets is its hub.  Full sets go to the hubs in groups of at most about 256 members, where the
hub is compared with all members, and each member that it is not similar to with all others.  Then come the pairs with
other leaders whose ends are still in different components.  What is left are pairs in a common bucket with different
components and different hubs; their sketches decide which are worth a comparison of full sets: an estimate 0.17, four
and a half standard deviations, below the threshold rules a pair out, which errs about as seldom as the banding does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W
from .components import components, merged

SHINGLE, THRESHOLD = 5, 0.75
BANDS, ROWS = 32, 4
HUB_MEMBERS, TILE, MARGIN = 256, 512, 0.17
FILTER_BITS, PART_BITS = 1 << 26, 1 << 15


def shingle_sets(words: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted within each row, and the first one of each row (one more at the end)."""
    values, inside = W.grams(words, k)
    rows = words.rows()
    at = np.flatnonzero(inside)
    values, rows = [values[at]], [rows[at]]
    counts = np.diff(words.first)
    for few in range(1, k):  # the whole sequence as one
        short = np.flatnonzero(counts == few)
        if len(short):
            whole, _ = W.grams(words, few)
            values.append(W.mix(whole[words.first[short]] + np.uint64(few)))
            rows.append(short)
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return values[new], np.searchsorted(rows[new], np.arange(len(counts) + 1))


def sketches(values: np.ndarray, first: np.ndarray, t: int = BANDS * ROWS) -> np.ndarray:
    """A row of t coordinates for each set; all ones for an empty set."""
    sizes = np.diff(first)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    bins = np.full(len(sizes) * t, none, np.uint64)
    row, open_rows = np.repeat(np.arange(len(sizes)), sizes), sizes > 0
    for i in range(2 * t):
        h = W.mix(values ^ W.mix(np.array([i + 1], np.uint64)))
        where = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(bins, row * t + where, (np.uint64(i) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1)))
        left = open_rows.copy()
        left[open_rows] = (bins.reshape(-1, t)[open_rows] == none).any(axis=1)
        if not left.any():
            break
        if left.sum() < open_rows.sum():
            stay = left[row]
            values, row = values[stay], row[stay]
        open_rows = left
    return bins.reshape(-1, t)


_SKETCH = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketch(k: int, bands: int, rows: int):
    def sketch(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                values, first = shingle_sets(W.split(piece.column("text"), W.LOWER), k)
                sizes = np.diff(first)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values ^ np.uint64(c)))]) for c in (0x1F3D5B79, 0x2468ACE1)]
                f1, f2 = ((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
                bins = sketches(values, first, bands * rows)
                low = W.mix(bins).astype(np.uint8)  # a byte of each coordinate
                bins = bins.reshape(len(sizes), bands, rows)
                keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sizes), 1))
                for j in range(rows):
                    keys = W.mix(keys * W._MIX1 + bins[:, :, j])
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].view(np.int64).ravel()))
                yield pa.record_batch([piece.column("id"), pa.array(sizes), pa.array(f1), pa.array(f2), lists, pa.array([x.tobytes() for x in low], pa.binary())], schema=_SKETCH)

    return sketch


_ROLE = pa.schema([("hub", pa.int64()), ("group", pa.int64()), ("probe", pa.bool_()), ("id", pa.int64()), ("members", pa.binary())])
_ROLE_DDL = "hub long, group long, probe boolean, id long, members binary"


def _sets(k: int):
    """Each row's full set, as sorted 64-bit hashes."""

    def sets(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                values, first = shingle_sets(W.split(piece.column("text"), W.LOWER), k)
                own = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([*(piece.column(c) for c in _ROLE.names[:-1]), pa.array(own, pa.binary())], schema=_ROLE)

    return sets


def _links(percent: float, cross: bool):
    """Pairs of a group's probes and members whose full sets are similar enough; with cross, members that no probe is linked with become probes."""

    def links(table: pa.Table) -> pa.Table:
        rows = {(p, i): np.frombuffer(s.as_py(), np.uint64) for p, i, s in zip(table.column("probe").to_pylist(), table.column("id").to_pylist(), table.column("members"), strict=True)}
        ids = [i for p, i in rows if not p]
        sets = [rows[False, i] for i in ids]
        if not sets:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sizes, every = np.array([len(x) for x in sets]), np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        found, linked = [], set()

        def compare(i: int, own: np.ndarray) -> None:
            at = np.searchsorted(own, every)
            common = np.bincount(owner[own[np.minimum(at, len(own) - 1)] == every], minlength=len(sets))
            for j in np.flatnonzero(100 * common >= percent * (sizes + len(own) - common)).tolist():
                if ids[j] != i:
                    linked.add(ids[j])
                    found.append((max(i, ids[j]), min(i, ids[j])))

        for p, i in rows:
            if p:
                compare(i, rows[p, i])
        if cross:
            for i, own in [(i, own) for i, own in zip(ids, sets, strict=True) if i not in linked]:
                compare(i, own)
        a, b = zip(*set(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _bitmap(table: pa.Table) -> pa.Table:
    bits = np.zeros(PART_BITS, dtype=bool)
    bits[np.asarray(table.column("bit")) % PART_BITS] = True
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def mostly_listed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without most of the rows whose id isn't in ids, so that their texts needn't be shuffled; no listed one is lost.

    A bitmap of 8 MB, whatever the number of ids, goes to the executors: the more ids there are, the fewer other rows it drops.
    """
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    marked = ids.select(bit.alias("bit")).distinct().withColumn("part", F.floor(F.col("bit") / PART_BITS))
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in marked.groupBy("part").applyInArrow(_bitmap, "part long, bits binary").collect():  # at most FILTER_BITS in all
        at = row.part * PART_BITS // 8
        found[at : at + PART_BITS // 8] = np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def listed(bits: pa.Array) -> pa.Array:
        at = np.asarray(bits.fill_null(0))
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return docs.filter(listed(bit))


def compared(docs: DataFrame, roles: DataFrame, k: int, threshold: float, cross: bool) -> DataFrame:
    """Links (a, b), a > b, within the groups of roles (hub, group, probe, id)."""
    rows = mostly_listed(docs, roles.select("id")).join(roles, "id").select("hub", "group", "probe", "id", "text").mapInArrow(_sets(k), _ROLE_DDL)
    return rows.groupBy("hub", "group").applyInArrow(_links(100 * threshold, cross), "a long, b long")


def _chunk(node: str, chunks: str):
    return F.pmod(F.xxhash64(node), F.col(chunks))


def _every(chunks: str):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1))


def star_roles(pairs: DataFrame) -> DataFrame:
    """Groups for pairs (a, b): the a of each b in groups of at most about HUB_MEMBERS, with b as the probe of each."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("groups"))
    members = pairs.join(hubs, "b").select(F.col("b").alias("hub"), _chunk("a", "groups").alias("group"), F.lit(False).alias("probe"), F.col("a").alias("id"))
    return members.unionAll(hubs.select(F.col("b").alias("hub"), _every("groups").alias("group"), F.lit(True).alias("probe"), F.col("b").alias("id")))


def rest_roles(pairs: DataFrame, outside: DataFrame) -> DataFrame:
    """Groups that compare, for each b of several star groups, its outside a with all its a."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("groups")).filter("groups > 1")
    probes = outside.join(hubs, "b")
    hubs = probes.groupBy("b", "groups").agg(F.ceil(F.count("*") / HUB_MEMBERS).alias("chunks"))
    number = F.col("chunk") * F.col("groups") + F.col("group")
    members = pairs.join(hubs, "b").withColumn("group", _chunk("a", "groups")).withColumn("chunk", _every("chunks")).select(F.col("b").alias("hub"), number.alias("group"), F.lit(False).alias("probe"), F.col("a").alias("id"))
    probes = probes.join(hubs.select("b", "chunks"), "b").withColumn("chunk", _chunk("a", "chunks")).withColumn("group", _every("groups"))
    return members.unionAll(probes.select(F.col("b").alias("hub"), number.alias("group"), F.lit(True).alias("probe"), F.col("a").alias("id")))


def _across(least: float):
    """Pairs of a tile whose labels and hubs differ and whose sketches agree in a share of at least `least`."""

    def across(table: pa.Table) -> pa.Table:
        ids, labels, hubs, chunks = (np.asarray(table.column(c)) for c in ("id", "label", "hub", "chunk"))
        sketch = np.stack([np.frombuffer(x.as_py(), np.uint8) for x in table.column("sketch")])
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        right, a, b = np.flatnonzero(chunks == high), [], []
        for x in np.flatnonzero(chunks == low).tolist():
            y = right[(labels[right] != labels[x]) & (hubs[right] != hubs[x]) & ((low != high) | (ids[right] > ids[x]))]
            y = y[(sketch[y] == sketch[x]).mean(axis=1) >= least] if len(y) else y
            a.append(np.maximum(ids[y], ids[x]))
            b.append(np.minimum(ids[y], ids[x]))
        return pa.table({"a": pa.array(np.concatenate([*a, np.zeros(0, np.int64)]), pa.int64()), "b": pa.array(np.concatenate([*b, np.zeros(0, np.int64)]), pa.int64())})

    return across


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, only: DataFrame | None = None) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach) for each input row; the row to keep has its own id there.

    Words are what white space separates, A-Z lower-cased.  Documents are linked when the Jaccard similarity of their
    sets of shingles is at least threshold.

    A text of fewer words than a shingle has its whole sequence as its one shingle; a null or empty text has an empty set and
    is linked with nothing.  Rows that repeat an id must repeat its text; they share one result.  A row with a null id
    has a null component_id and links nothing.  Further columns are ignored.  With only, a table with a column id_col, documents whose id it doesn't hold are
    left out.
    """
    scratch.tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = docs.mapInArrow(_sketch(shingle, bands, rows), "id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch binary")
    if only is not None:
        found = found.join(only.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    found = scratch.keep(found, "sketches")
    known = found.filter("id IS NOT NULL AND n_shingles > 0")
    classes = scratch.keep(known.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep")), "classes")
    keys = known.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    shared = scratch.keep(keys.join(buckets.select("key", "low"), "key"), "buckets")
    pairs = scratch.keep(shared.filter("id > low").groupBy(F.col("id").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("n")), "pairs")
    rows = pairs.count()

    hubs = scratch.keep(pairs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), "hubs", rows)
    links = scratch.keep(compared(docs, scratch.keep(star_roles(hubs), "roles", rows), shingle, threshold, cross=True), "links")
    labels = components(links)

    def labelled(df: DataFrame, node: str, label: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(node), F.col("label").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))

    def apart(df: DataFrame) -> DataFrame:
        return scratch.keep(labelled(labelled(df, "a", "la"), "b", "lb").filter("la != lb").select("a", "b"), "pairs", rows)

    def more(roles: DataFrame) -> None:
        nonlocal labels
        roles = scratch.keep(roles, "roles")
        if not roles.isEmpty():
            found = scratch.keep(compared(docs, roles, shingle, threshold, cross=False), "links")
            if not found.isEmpty():
                labels = merged(labels, found)

    others = star_roles(apart(pairs.select("a", "b").join(hubs, ["a", "b"], "left_anti")))
    more(rest_roles(hubs, apart(hubs)).unionAll(others.withColumn("group", -1 - F.col("group"))))  # groups of their own

    members = labelled(shared.select("id", "key").distinct(), "id", "label")
    several = members.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.ceil(F.count("*") / TILE).alias("chunks")).filter("l0 != l1").select("key", "chunks")
    about = known.select("id", "sketch").join(classes.select(F.col("rep").alias("id")), "id", "left_semi").join(hubs.select(F.col("a").alias("id"), F.col("b").alias("hub")), "id", "left").withColumn("hub", F.coalesce("hub", "id"))
    tiles = members.join(several, "key").join(about, "id").withColumn("chunk", _chunk("id", "chunks")).withColumn("other", _every("chunks"))
    tiles = tiles.select("key", "id", "label", "hub", "sketch", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    across = tiles.groupBy("key", "low", "high").applyInArrow(_across(threshold - MARGIN), "a long, b long").distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more(star_roles(scratch.keep(across, "pairs")))

    classes = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("f1", "f2", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    out = found.select("id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2", "n_shingles"], "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
