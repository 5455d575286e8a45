"""N-gram Jaccard join by PartEnum signatures: equal cells of a partitioned feature domain within bands of set sizes."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatframe.llm.common import chained, components, cut, forest_of, mix, text_bytes, trim, word_hashes

WORDS = 5
_SLOTS = 4


def shingles(data: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams; of all its words as one where there are fewer than n, none without words."""
    words = word_hashes(data)
    if 0 < len(words) < n:
        return chained(words, len(words))
    return np.unique(chained(words, n))


class Bands:
    """Sizes, bands and cells for links where den * |A and B| >= num * |A or B|.

    Linked sets A and B differ in at most (|A| + |B|) (den - num) / (den + num) features, and their sizes by a factor of den / num. Bands
    of sizes grow by a factor of 4; in its band a set falls into cells, by the hash of each feature, and all features of a cell make one
    signature. Each feature in which A and B differ spoils at most one cell, so a set with more cells than that shares one
    with every set it is linked with. The first band has a cell for each feature."""

    def __init__(self, num: int = 75, den: int = 100) -> None:
        if not 7 * den <= 10 * num <= 10 * den:
            raise ValueError("the similarity must lie between 0.7 and 1")
        self.num, self.den = num, den
        self.first = 16
        part = (1 + den / num) * (den - num) / (den + num)
        fill = 4.0  # features of a cell on average in the fullest sets of a band: so few that cells outnumber differences
        while (1 - np.exp(-fill)) / fill < 1.1 * part + 0.005:
            fill *= 0.98
        self.fill = fill

    def largest(self, n: int) -> int:
        """Size of the largest set that a set of n features can be linked with."""
        return n * self.den // self.num

    def differ(self, n: int) -> int:
        """The most features in which a set of n features and one linked with it differ."""
        return (n + self.largest(n)) * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> int:
        b, top = 0, self.first
        while n > top:
            b, top = b + 1, top * 4
        return b

    def cells(self, band: int) -> int:
        return max(1, int(self.first * 4**band / self.fill))

    def signatures(self, features: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(slot, signatures) of a set: in its own band (slot 0), in the next if larger partners lie there (1), and by single
        features where its cells in one of these are too few (2)."""
        n = len(features)
        if not n:
            return []
        own, out, few = self.band(n), [], False
        for slot, band in enumerate(range(own, self.band(self.largest(n)) + 1)):
            made = self._in_band(features, band)
            few = few or (band > 0 and len(made) <= self.differ(n))
            out.append((slot, made))
        if few:
            out.append((2, self._in_band(features, 0)))
        return out

    def _in_band(self, features: np.ndarray, band: int) -> np.ndarray:
        spread = mix(features ^ np.uint64(0xA5A5_5A5A_1234_4321))
        if band == 0:
            return spread
        count = self.cells(band)
        cell = ((spread >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        sums = np.zeros(count, np.uint64)
        np.add.at(sums, cell.astype(np.intp), mix(spread))
        filled = np.flatnonzero(np.bincount(cell.astype(np.intp), minlength=count))
        return mix(sums[filled] + mix(filled.astype(np.uint64) + (np.uint64(band) << np.uint64(40))))


def set_key(features: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = mix(features).sum(dtype=np.uint64) if len(features) else np.uint64(0)
    return int(mix(np.array([total], np.uint64) + np.uint64(len(features)))[0])


ENTRIES = 2_000_000  # signatures of a part, on average
FLUSH = 2_000_000  # signatures that a task holds before it hands them on
STARS = 2  # times that unjoined sets are held against the centre of the largest component of each feature, before what is left meets in blocks
BESIDE = 64  # sets that others are held against at a time
_AGAINST = 2048  # sets held against those in one group, on average


def _whole(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def _groups(parts: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part below count that occurs, and where."""
    order = np.argsort(parts, kind="stable")
    ends = np.searchsorted(parts[order], np.arange(count + 1))
    for p in range(count):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def _runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given sizes: the number of each element's run, and its place in it."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _binary(**arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays.values()]


_SENT = "part int, keys binary, tags binary, counts binary, sigs binary"
_BACK = "part int, keys binary, tags binary, alone binary, counts binary, sigs binary, holders binary"


def read_sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, n_shingles, set_key) of each row."""
    rows = docs.select(docs[key].alias("id"), docs[text].alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x, n) for x in text_bytes(batch.column(1))]
            keys = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys)], names=["id", "n_shingles", "set_key"])
        trim()

    return rows.mapInArrow(run, schema)


def _dealt(keys: list, tags: list, found: list, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT: the signatures of sets, by part."""
    sizes = np.array([len(f) for f in found])
    of, sigs = np.repeat(np.arange(len(found), dtype=np.int32), sizes), np.concatenate(found)
    keys, tags = np.array(keys, np.uint64), np.array(tags, np.int64)
    for part, at in _groups((sigs % np.uint64(parts)).astype(np.int32), parts):
        sets, counts = np.unique(of[at], return_counts=True)
        arrays = _binary(keys=keys[sets], tags=tags[sets], counts=counts.astype(np.uint32), sigs=(sigs[at] // np.uint64(parts)).astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *arrays], names=["part", "keys", "tags", "counts", "sigs"])


def send_features(sets: DataFrame, parts: int, flush: int = FLUSH) -> DataFrame:
    """The features of sets (set_key, features) themselves as signatures, dealt like those of send_signatures."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags, found, held = [], [], [], 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                features = np.frombuffer(data.as_py(), "u8")
                keys.append(key % (1 << 64))
                tags.append(len(features) * _SLOTS)
                found.append(mix(features))
                held += len(features)
                if held >= flush:
                    yield from _dealt(keys, tags, found, parts)
                    keys, tags, found, held = [], [], [], 0
        if found:
            yield from _dealt(keys, tags, found, parts)
        del keys, tags, found
        trim()

    return sets.select("set_key", "features").mapInArrow(run, _SENT)


def send_signatures(docs: DataFrame, text: str, n: int, bands: Bands, parts: int, flush: int = FLUSH) -> DataFrame:
    """The signatures of every text, in `parts` parts by signature: a row holds those that one task found for one part, set by set
    (key; tag: size and slot; count; that many signatures without what the part tells), so a signature takes four bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags, found, held, seen = [], [], [], 0, set()
        for batch in batches:
            for data in text_bytes(batch.column(0)):
                features = shingles(data, n)
                name = set_key(features)
                if name in seen:
                    continue
                seen.add(name)
                for slot, sigs in bands.signatures(features):
                    keys.append(name)
                    tags.append(len(features) * _SLOTS + slot)
                    found.append(sigs)
                    held += len(sigs)
                if held >= flush:
                    yield from _dealt(keys, tags, found, parts)
                    keys, tags, found, held, seen = [], [], [], 0, set()
        if found:
            yield from _dealt(keys, tags, found, parts)
        del keys, tags, found
        trim()

    return docs.select(docs[text].alias("text")).mapInArrow(run, _SENT)


def _merged(keys: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the different (key, tag), and for each entry which of them it is."""
    _, first, which = np.unique(mix(keys + tags.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
    return first, which


def count_holders(sent: DataFrame, parts: int) -> DataFrame:
    """For each set, how many of its signatures no other set has, and the others with their numbers of holders; in `parts` parts by key."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        part = table.column("part")[0].as_py()
        keys, tags = _whole(table.column("keys"), "u8"), _whole(table.column("tags"), "i8")
        counts, sigs = _whole(table.column("counts"), "u4"), _whole(table.column("sigs"), "u4")
        first, which = _merged(keys, tags)
        both = sigs.astype(np.uint64) << np.uint64(32)  # signature and set in one number, sorted in place
        both |= np.repeat(which.astype(np.uint32), counts)
        del sigs, which, counts
        both.sort()
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        sigs, of = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
        del both
        starts = np.flatnonzero(np.append(True, sigs[1:] != sigs[:-1])[: len(sigs)])
        lengths = np.diff(np.append(starts, len(sigs))).astype(np.uint32)
        holders = np.repeat(lengths, lengths)
        alone = np.bincount(of[holders == 1], minlength=len(first)).astype(np.uint32)
        shared = np.flatnonzero(holders > 1)
        shared = shared[np.argsort(of[shared], kind="stable")]
        number = np.bincount(of[shared], minlength=len(first))
        starts = np.cumsum(number) - number
        keys, tags = keys[first], tags[first]
        whole = sigs[shared].astype(np.uint64) * np.uint64(parts) + np.uint64(part)
        holders = holders[shared]
        rows = []
        for to, sets in _groups((keys % np.uint64(parts)).astype(np.int64), parts):
            run_of, place = _runs(number[sets])
            at = starts[sets][run_of] + place
            arrays = _binary(keys=keys[sets], tags=tags[sets], alone=alone[sets], counts=number[sets].astype(np.uint32), sigs=whole[at], holders=holders[at])
            rows.append(pa.Table.from_arrays([pa.array([to], pa.int32()), *arrays], names=["part", "keys", "tags", "alone", "counts", "sigs", "holders"]))
        return pa.concat_tables(rows)

    return sent.groupBy("part").applyInArrow(run, _BACK)


def rarest(back: DataFrame, bands: Bands, features: bool = False) -> DataFrame:
    """(sig, set_key, n, alone): for each set that can still have a partner, its signatures with the fewest holders, one more
    than the features in which it and a partner can differ; where the signatures are single features, one more than those that a partner can lack. Signatures that no other set has count among those, so a set
    with more of them than that has no partner, and two linked sets have one of the rest in common: the first that they share
    in the order by holders has, in either set, only such before it that the other lacks."""

    def run(table: pa.Table) -> pa.Table:
        keys, tags = _whole(table.column("keys"), "u8"), _whole(table.column("tags"), "i8")
        first, which = _merged(keys, tags)
        alone = np.bincount(which, _whole(table.column("alone"), "u4"), len(first)).astype(np.int64)
        of = np.repeat(which, _whole(table.column("counts"), "u4"))
        sigs, holders = _whole(table.column("sigs"), "u8"), _whole(table.column("holders"), "u4")
        keys, n = keys[first], tags[first] // _SLOTS
        differ = n * (bands.den - bands.num) // bands.den if features else (n + n * bands.den // bands.num) * (bands.den - bands.num) // (bands.den + bands.num)
        need = differ + 1 - alone
        at = np.flatnonzero(need[of] > 0)
        at = at[np.lexsort((sigs[at], holders[at], of[at]))]
        _, place = _runs(np.bincount(of[at], minlength=len(first)))
        at = at[place < need[of[at]]]
        of = of[at]
        return pa.table({"sig": sigs[at].view(np.int64), "set_key": keys[of].view(np.int64), "n": n[of], "alone": alone[of]})

    return back.groupBy("part").applyInArrow(run, "sig long, set_key long, n long, alone long")


def blocks_beside(rows: DataFrame, bands: Bands) -> DataFrame:
    """(beside, set_key): for each pair in a signature's row group that no link joins yet and that can be linked, that one is to be held against
    the block of the other. rows: part, sig, set_key, n, alone, component, beside (the block of a set, null in the largest component of a
    neighbourhood). In each group of parts a pair of set and block comes once, however many signatures name it.

    The signatures are single features: a set of n features has at most (den n - num m) / (den + num) that a linked one of m lacks, so it has no
    more than that for itself alone. Of two sets with blocks the later one, by size, is held against the block of the other."""
    num, den = bands.num, bands.den

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("sig", "ascending"), ("n", "ascending"), ("set_key", "ascending")])
        sig, key, n, alone, component = (table.column(c).to_numpy() for c in ("sig", "set_key", "n", "alone", "component"))
        placed = table.column("beside").is_valid().to_numpy(zero_copy_only=False)
        beside = table.column("beside").fill_null(0).to_numpy()
        starts = np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)]), len(sig))
        spare = den * n - (den + num) * alone  # num times the size of a partner must not exceed this
        out: set[tuple[int, int]] = set()
        for a, b in itertools.pairwise(starts):
            own = np.flatnonzero(placed[a:b]) + a
            if not len(own) or (component[a:b] == component[a]).all():
                continue
            order = own[np.argsort(beside[own], kind="stable")]
            edges = np.flatnonzero(np.append(True, beside[order][1:] != beside[order][:-1]))
            for u in np.split(order, edges[1:]):
                near = (den * n[a:b] >= num * n[u].min()) & (num * n[a:b] <= den * n[u].max())
                near &= (num * n[u].min() <= spare[a:b]) & (num * n[a:b] <= spare[u].max())
                near &= ~placed[a:b] | (np.arange(a, b) > u.min())
                if (component[u] == component[u[0]]).all():
                    near &= component[a:b] != component[u[0]]
                out.update(zip(itertools.repeat(int(beside[u[0]])), key[a:b][near].tolist(), strict=False))
        found = np.array(sorted(out), np.int64).reshape(-1, 2)
        return pa.table({"beside": found[:, 0], "set_key": found[:, 1]})

    return rows.groupBy("part").applyInArrow(run, "beside long, set_key long")


def held_against(blocks: DataFrame, against: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Links between the sets of a block and those held against it, by their exact intersections: of what is linked in a group of rows a
    spanning forest (a, b), so that copies are not expanded into pairs.

    blocks: beside, set_key; against: beside, set_key; sets: set_key, features (sorted, 8 bytes each). A block with many sets against it
    goes to several groups, each with the block's own sets again."""
    against = against.distinct()
    shares = cut(against.groupBy("beside").agg(F.ceil(F.count("*") / _AGAINST).cast("int").alias("shares")))
    own = blocks.distinct().join(shares, "beside").join(sets, "set_key").select("beside", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "set_key", "features", F.lit(True).alias("own"))
    other = against.join(shares, "beside").join(sets, "set_key").select("beside", F.pmod(F.xxhash64("set_key"), F.col("shares")).cast("int").alias("share"), "set_key", "features", F.lit(False).alias("own"))

    def run(table: pa.Table) -> pa.Table:
        keys, own = table.column("set_key").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        features = [np.frombuffer(x.as_py(), "u8") for x in table.column("features")]
        mine = np.flatnonzero(own)
        mine = mine[np.unique(keys[mine], return_index=True)[1]]
        a, b = [], []
        if len(mine):
            sizes = np.array([len(features[i]) for i in mine])
            flat, of = np.concatenate([features[i] for i in mine]), np.repeat(np.arange(len(mine)), sizes)
            for i in np.flatnonzero(~own):
                x = features[i]
                at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
                common = np.bincount(of[x[at] == flat], minlength=len(mine))
                linked = (bands.den * common >= bands.num * (sizes + len(x) - common)) & (keys[mine] != keys[i])
                a += [keys[i]] * int(linked.sum())
                b += keys[mine[linked]].tolist()
        names, at = np.unique(np.array(a + b, np.int64), return_inverse=True)
        root = names[forest_of(len(names), at[: len(a)], at[len(a) :])]
        return pa.table({"a": names[names != root], "b": root[names != root]})

    return own.union(other).groupBy("beside", "share").applyInArrow(run, "a long, b long")


def joined_up(placed: DataFrame, links: DataFrame) -> DataFrame:
    """(set_key, component) of the same sets after more links (a, b): only those between different components matter, and of these only
    the components' names are joined up."""
    ends = [placed.select(F.col("set_key").alias(x), F.col("component").alias(y)) for x, y in (("a", "u"), ("b", "v"))]
    between = cut(links.join(ends[0], "a").join(ends[1], "b").where("u <> v").select("u", "v").distinct())
    if between.isEmpty():
        return placed
    larger = components(between, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("larger"))
    return cut(placed.join(larger, "component", "left").select("set_key", F.coalesce("larger", "component").alias("component")))


def neighbourhoods(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(component, near) of components that pairs (a, b) of sets, linked or not, join up with others: near is the same for those that they reach."""
    ends = [placed.select(F.col("set_key").alias(x), F.col("component").alias(y)) for x, y in (("a", "u"), ("b", "v"))]
    between = pairs.join(ends[0], "a").join(ends[1], "b").where("u <> v").select("u", "v")
    return cut(components(between, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("near")))


def standing(near: DataFrame, placed: DataFrame) -> DataFrame:
    """(set_key, near, component, apart) of the sets (set_key, component) of neighbourhoods (set_key, near) that are not one component:
    apart from its largest or not."""
    placed = near.join(placed, "set_key")
    kinds = placed.groupBy("near", "component").agg(F.count("*").alias("n"))
    unsettled = kinds.groupBy("near").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("n", "component")).alias("most")).where("kinds > 1")
    return cut(placed.join(unsettled, "near").select("set_key", "near", "component", (F.col("component") != F.col("most")).alias("apart")))


def step_of(n: Column) -> Column:
    """Sizes within a factor of about 1.05 share a step."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.05)))


def features_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(set_key, features) of wanted sets (set_key, rep: a document that has it)."""
    rows = docs.select(docs[key].alias("rep"), docs[text].alias("text")).join(wanted, "rep").select("set_key", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, sets = [], []
            for name, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                if name in seen:
                    continue
                features = shingles(data, n)
                if np.array([set_key(features)], np.uint64).view(np.int64)[0] == name:
                    seen.add(name)
                    keys.append(name)
                    sets.append(features.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["set_key", "features"])
        trim()

    return rows.mapInArrow(run, "set_key long, features binary")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = 75, den: int = 100, flush: int = FLUSH) -> DataFrame:
    """key, n_shingles and component_id of each row: the smallest key that links reach, where two texts are linked if
    den * |A and B| >= num * |A or B| for their sets of word n-grams.

    Texts with fewer words than an n-gram have their whole word sequence as one; null texts and texts without words have an empty set and
    are linked with nothing. Rows with a null key have a null component and link with nothing; rows that repeat a key are linked each by
    its own text; equal sets are linked. An empty table gives an empty one; other columns are left out.

    Equal sets meet by a 64-bit name. Signatures are exchanged in parts of bounded size, four bytes each; most sets turn out to have more
    unshared signatures than a partner allows and go no further. The others are first linked with the most central set of each
    signature they share. Where that leaves several components among sets that share signatures, their single features are the signatures
    of a second look: again with central sets first, then only pairs that no chain of links joins and whose sizes and unshared features allow
    a link are held against each other, in blocks; so copies are never expanded into pairs, and no link between different components is missed.

    flush: signatures that a task holds before it hands them on; it changes memory, not the result."""
    bands = Bands(num, den)
    named = cut(read_sets(docs, key, text, words))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(1, -(-int(total * 0.72) // ENTRIES))
    sets = cut(named.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min("id").alias("rep")))
    back = count_holders(send_signatures(docs, text, words, bands, parts, flush), parts)
    found = cut(rarest(back, bands))
    central = found.groupBy("sig").agg(F.min(F.struct("alone", "set_key")).alias("c"), F.count("*").alias("n")).where("n > 1")
    pairs = cut(found.join(central.select("sig", F.col("c.set_key").alias("b")), "sig").select(F.col("set_key").alias("a"), "b").distinct())
    wanted = sets.join(pairs.select(F.col("a").alias("set_key")).distinct(), "set_key")
    features = cut(features_of(docs, wanted, key, text, words))
    blocks = max(1, -(-pairs.select("b").distinct().count() // BESIDE))
    beside = F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("beside")
    links = cut(held_against(pairs.select(beside, F.col("b").alias("set_key")), pairs.where("a <> b").select(beside, F.col("a").alias("set_key")), features, bands))
    own = pairs.select(F.col("a").alias("set_key")).distinct()
    linked = components(links).withColumnRenamed("node", "set_key")
    placed = cut(own.join(linked, "set_key", "left").select("set_key", F.coalesce("component", "set_key").alias("component")))
    # what shares a signature, linked or not, is near; the second look goes over neighbourhoods that are not one component, by single features
    near = neighbourhoods(placed, pairs.where("a <> b"))
    if not near.isEmpty():
        placed = _second_look(placed, cut(placed.join(near, "component").select("set_key", "near")), features, bands, beside, flush)
    whole = sets.join(placed, "set_key", "left").select("set_key", "rep", F.coalesce("component", "set_key").alias("component"))
    least = cut(whole.groupBy("component").agg(F.min("rep").alias("component_id")))
    whole = cut(whole.join(least, "component").select("set_key", "component_id"))
    out = named.join(whole, "set_key", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"))


def _second_look(placed: DataFrame, near: DataFrame, features: DataFrame, bands: Bands, beside: Column, flush: int) -> DataFrame:
    """(set_key, component) of placed after the links between components of a neighbourhood (set_key, near), found by single features.
    beside: the block of a central set b."""
    left = standing(near, placed)
    unsettled = cut(left.join(features, "set_key").select("set_key", "features"))
    total = unsettled.agg(F.sum(F.length("features"))).first()[0] or 0
    parts = max(1, -(-total // 8 // ENTRIES))
    found = cut(rarest(count_holders(send_features(unsettled, parts, flush), parts), bands, features=True))
    for _ in range(STARS):
        signed = found.join(left, "set_key")
        kinds = signed.groupBy("sig", "component").agg(F.count("*").alias("count"), F.min(F.struct("alone", "set_key")).alias("center"))
        largest = kinds.groupBy("sig").agg(F.max(F.struct("count", "component", "center")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
        stars = signed.join(largest, "sig").where("component <> most.component").select(F.col("most.center.set_key").alias("b"), F.col("set_key").alias("a"))
        stars = cut(stars.distinct())
        links = held_against(stars.select(beside, F.col("b").alias("set_key")), stars.select(beside, F.col("a").alias("set_key")), unsettled, bands)
        more = joined_up(placed, links)
        if more is placed:  # the same centres would be chosen again
            break
        placed, left = more, standing(near, more)
        if left.isEmpty():
            return placed
    # what is not in the largest component of its neighbourhood gets a block, among sets of about its size
    signed = found.join(left, "set_key")
    apart = cut(signed.where("apart").groupBy("set_key", "near").agg(step_of(F.min("n")).alias("step")))
    several = apart.groupBy("near", "step").agg(F.count("*").alias("count"))
    dealt = cut(apart.join(several, ["near", "step"]).select("set_key", F.xxhash64("near", "step", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("count") / BESIDE))).alias("beside")))
    groups = max(1, -(-found.count() // 1_000_000))
    part = F.pmod(F.xxhash64("sig"), F.lit(groups)).cast("int").alias("part")
    rows = signed.join(dealt, "set_key", "left").select(part, "sig", "set_key", "n", "alone", "component", "beside")
    against = cut(blocks_beside(rows, bands).distinct())
    return joined_up(placed, held_against(dealt.select("beside", "set_key"), against, unsettled, bands))
