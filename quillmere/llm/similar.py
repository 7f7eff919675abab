"""Near copies by similarity of word shingles: the near-duplicate stage of the pipeline.

Candidates come in two ways. First by operator 4's ball hashing of 64-bit SimHash
fingerprints, which finds what is nearly identical. A pair at the threshold of 0.8
differs in some ten of 64 bits, which no ball can span, so the other candidates
share one of some min-hash bands. Sketches settle what is clearly alike or clearly
not; the shingle sets themselves settle the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, fresh_name, materialise, type_of
from .components import connected_components
from .simhash import fingerprint_links, majority_bits
from .textscan import SpanHasher, Words, mix, pieces, window_hashes

_SEQUENCE = np.uint64(31)
#: Leaders are drawn anew until a round links fewer than one in so many of its pairs.
WORTH_A_ROUND = 20
#: Members of a bucket that one task compares with as many others by a matrix product.
BLOCK = 512


def _shingles(data: np.ndarray, offsets: np.ndarray, shingle_words: int):
    """Of each document: the sorted hashes of its shingles (fewer words: of all of them)."""
    words = Words(data, offsets)
    single = SpanHasher(data)(words.start, words.end)
    shingles = window_hashes(single, shingle_words)
    whole = words.doc[: len(shingles)] == words.doc[len(single) - len(shingles) :]
    for d in range(len(offsets) - 1):
        low, high = words.first[d], words.first[d + 1]
        runs = np.unique(shingles[low : min(high, len(shingles))][whole[low : min(high, len(shingles))]])
        if high > low and not len(runs):
            runs = np.zeros(1, np.uint64)
            for h in single[low:high]:
                runs = mix(runs * _SEQUENCE + h)
        yield runs


def min_hash_bands(sets: list[np.ndarray], bands: int, band_rows: int) -> np.ndarray:
    """(sets, bands): hashes that two sets of Jaccard similarity J share with probability J ** band_rows each; none is empty."""
    together, starts = np.concatenate(sets), np.cumsum([0, *[len(x) for x in sets[:-1]]])
    odd = mix(np.arange(1, bands * band_rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(sets), bands), np.uint64)
    for k in range(bands):
        band = np.full(len(sets), k + 1, np.uint64)
        for factor in odd[k * band_rows : (k + 1) * band_rows]:
            band = mix(band * _SEQUENCE + np.minimum.reduceat(together * factor, starts))
        out[:, k] = band
    return out


def _views(data: np.ndarray, offsets: np.ndarray, shingle_words: int, bands: int, band_rows: int, sketch_words: int):
    """Of each document: min-hash bands and a SimHash sketch of its shingle set."""
    sets = list(_shingles(data, offsets, shingle_words))
    out_bands, out_sketch = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), sketch_words), np.uint64)
    filled = [d for d, runs in enumerate(sets) if len(runs)]
    if filled:
        out_bands[filled] = min_hash_bands([sets[d] for d in filled], bands, band_rows)
    for d in filled:
        out_sketch[d] = majority_bits(np.stack([mix(sets[d] + np.uint64(0xC2B2AE3D27D4EB4F * (k + 1) & (1 << 64) - 1)) for k in range(sketch_words)], 1))
    return out_bands, out_sketch


def sketch_bounds(similarity: float, bits: int, deviations: float = 3.5) -> tuple[int, int]:
    """(sure, possible): differing sketch bits below which a pair is surely as alike as
    ``similarity``, and above which it surely is not.

    Sets of Jaccard similarity J have a cosine from 2J/(1+J), when of one size, to
    sqrt(J), when one holds the other; a bit differs with probability angle/pi.
    Some standard deviations are taken off and added.
    """

    def spread(cosine: float, sign: int) -> int:
        p = float(np.arccos(cosine) / np.pi)
        return int(bits * p + sign * deviations * (bits * p * (1 - p)) ** 0.5)

    return spread(similarity**0.5, -1), spread(2 * similarity / (1 + similarity), 1)


def _apart(one: Column, two: Column) -> Column:
    """How many bits of two sketches differ."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def _words_key(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()))


class _Search:
    """The distinct texts of a table, and how pairs of them become links.

    ``labels`` has the nodes that any candidate concerns, with their group's least node.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle_words: int, similarity: float, bands: int, band_rows: int, sketch_words: int):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.shingle_words, self.similarity = shingle_words, similarity
        self.sure, self.possible = sketch_bounds(similarity, 64 * sketch_words)

        def sketched(batches):
            for batch in batches:
                for low, high, data, offsets in pieces(batch.column(1).cast(pa.string())):
                    raw = data.tobytes()
                    keys = [_words_key(raw[offsets[i] : offsets[i + 1]]) for i in range(high - low)]
                    v, s = _views(np.frombuffer(raw.lower(), np.uint8), offsets, shingle_words, bands, band_rows, sketch_words)
                    listed = [pa.array(list(x.view(np.int64)), pa.list_(pa.int64())) for x in (v, s)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(np.array(keys, np.uint64).view(np.int64)), *listed], names=["id", "row", "node", "bands", "sketch"])

        plain = F.col(text_col).cast("string")
        narrow = docs.select(F.col(id_col).alias("id"), plain.alias("text"), F.xxhash64(F.col(id_col), plain).alias("row"))
        rows = materialise(arrow_map(narrow, sketched, f"id {type_of(docs, id_col)}, row long, node long, bands array<long>, sketch array<long>"), "sketches")
        self.nodes = materialise(rows.groupBy("node").agg(F.min("id").alias("least_id"), *[F.first(c).alias(c) for c in ("row", "bands", "sketch")]), "nodes")
        discard(rows)
        self.labels: DataFrame | None = None

    def _sets(self, wanted: DataFrame) -> DataFrame:
        """(at, grams): the shingle set of one text of each node in ``wanted`` (node, row)."""
        shingle_words = self.shingle_words

        def run(batches):
            for batch in batches:
                for low, high, data, offsets in pieces(batch.column(1).cast(pa.string())):
                    lowered = np.frombuffer(data.tobytes().lower(), np.uint8)
                    sets = [runs.view(np.int64) for runs in _shingles(lowered, offsets, shingle_words)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(sets, pa.list_(pa.int64()))], names=["at", "grams"])

        text = F.col(self.text_col).cast("string")
        texts = self.docs.select(F.xxhash64(F.col(self.id_col), text).alias("row"), text.alias("text")).join(wanted, "row")
        return arrow_map(texts.groupBy("node").agg(F.first("text").alias("text")), run, "at long, grams array<long>")

    def _merge(self, links: DataFrame) -> None:
        """Join the groups that ``links`` (ra, rb) connect."""
        moved = connected_components(links, "ra", "rb").select(F.col("node").alias("was"), F.col("root").alias("now"))
        before, self.labels = self.labels, materialise(self.labels.join(moved, self.labels.root == moved.was, "left").select("node", F.coalesce("now", "root").alias("root")), "labels")
        discard(before)

    def absorb(self, near: DataFrame) -> tuple[int, int]:
        """Merge what is linked among the written pairs ``near`` (a, b, ra, rb, apart); (pairs seen, links found)."""
        settled = near.where(F.col("apart") <= self.sure)
        pairs, links = near.agg(F.count(F.lit(1)), F.count_if(F.col("apart") <= self.sure)).first()
        if links:
            self._merge(settled)
        doubtful = near.where(F.col("apart") > self.sure).select("a", "b")
        for side, root in (("a", "ra"), ("b", "rb")):
            own = self.labels.select(F.col("node").alias("at"), F.col("root").alias(root))
            doubtful = doubtful.join(own, F.col(side) == F.col("at")).drop("at")
        doubtful = materialise(doubtful.where("ra <> rb"), "doubtful")
        if _any(doubtful):
            ends = doubtful.select("a").union(doubtful.select("b")).distinct().withColumnRenamed("a", "node")
            sets = materialise(self._sets(self.nodes.select("node", "row").join(ends, "node")), "sets")
            alike = doubtful.join(sets, F.col("a") == F.col("at")).select("b", "ra", "rb", F.col("grams").alias("one"))
            alike = alike.join(sets, F.col("b") == F.col("at")).select("ra", "rb", F.size(F.array_intersect("one", "grams")).alias("both"), (F.size("one") + F.size("grams")).alias("sizes"))
            found = materialise(alike.where(F.col("both") + 1e-9 >= self.similarity * (F.col("sizes") - F.col("both"))).select("ra", "rb"), "links")
            more = found.count()
            if more:
                self._merge(found.distinct())
            links += more
            discard(sets)
            discard(found)
        discard(doubtful)
        discard(near)
        return pairs, links

    def by_balls(self, radius: int) -> DataFrame:
        """(a, b, ra, rb, apart) of the pairs whose 64-bit fingerprints are equal or meet by ball hashing."""
        nodes = self.nodes.select(F.col("sketch")[0].alias("fp"), "node", "sketch")
        first = materialise(nodes.groupBy("fp").agg(F.min(F.struct("node", "sketch")).alias("lead")), "fingerprints")
        equal = nodes.join(first, "fp").where("node <> lead.node").select(F.struct("node", "sketch").alias("one"), F.col("lead").alias("two"))
        links = materialise(fingerprint_links(first.select("fp"), "fp", 64, radius), "balls")
        met = links.join(first.select(F.col("fp").alias("a"), F.col("lead").alias("one")), "a")
        met = met.join(first.select(F.col("fp").alias("b"), F.col("lead").alias("two")), "b").select("one", "two")
        near = materialise(self._pairs(equal.unionByName(met)).select("a", "b", F.col("a").alias("ra"), F.col("b").alias("rb"), "apart"), "near")
        discard(first)
        discard(links)
        return near

    def _pairs(self, met: DataFrame, *more: Column) -> DataFrame:
        """(a, b, ..., apart) of structs ``one`` and ``two`` whose sketches allow a link."""
        return met.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"), *more, _apart(F.col("one.sketch"), F.col("two.sketch")).alias("apart")).where(F.col("apart") <= self.possible)

    def members(self) -> DataFrame:
        """(band, node) of the buckets that hold several nodes."""
        met = self.nodes.select("node", F.explode("bands").alias("band"))
        shared = met.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
        return materialise(met.join(shared, "band", "left_semi").select("band", "node"), "members")

    def start(self, members: DataFrame, linked: DataFrame) -> None:
        """Label the nodes of ``members`` and of ``linked`` (a, b, ...): each its own group."""
        ends = members.select("node").union(linked.select("a")).union(linked.select("b")).distinct()
        self.labels = materialise(ends.select("node", F.col("node").alias("root")), "labels")

    def mixed(self, members: DataFrame) -> DataFrame:
        """``members`` of those buckets that hold several groups."""
        named = members.join(self.labels, "node")
        several = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
        left = materialise(named.join(several, "band", "left_semi").select("band", "node"), "members")
        discard(members)
        return left

    def by_leaders(self, members: DataFrame, turn: int) -> DataFrame:
        """(a, b, ra, rb, apart): every member of a bucket and one leader of another group.

        A bucket's groups each offer their first member in the turn's order; the first
        offered meets all other groups, the last offered meets the first one's group.
        Both are aggregates, so a hot bucket is combined before it is exchanged.
        """
        met = materialise(members.join(self.labels, "node").join(self.nodes.select("node", "sketch"), "node").select("band", F.struct(F.xxhash64(F.lit(turn), "node").alias("place"), "node", "root", "sketch").alias("me")), "met")
        offered = met.groupBy("band", "me.root").agg(F.min("me").alias("me"))
        heads = materialise(offered.groupBy("band").agg(F.min("me").alias("lead"), F.max("me").alias("rival")).where("lead.root <> rival.root"), "heads")
        to = F.when(F.col("me.root") != F.col("lead.root"), F.col("lead")).otherwise(F.col("rival"))
        ends = met.join(heads, "band").select(F.col("me"), to.alias("to"))
        low = F.col("me.node") < F.col("to.node")
        ordered = ends.select(F.when(low, F.col("me")).otherwise(F.col("to")).alias("one"), F.when(low, F.col("to")).otherwise(F.col("me")).alias("two"))
        near = materialise(self._pairs(ordered, F.col("one.root").alias("ra"), F.col("two.root").alias("rb")).distinct(), "near")
        discard(met)
        discard(heads)
        return near

    def across(self, members: DataFrame) -> DataFrame:
        """(ra, rb): the links between members of a bucket that are in different groups.

        A bucket is dealt into blocks by a hash. Every two blocks are compared by one
        matrix product of their sketches; pairs that could be links are settled by
        their shingle sets, the likest first, unless links found before connect them
        already. So a task gives fewer links than it has members. A pair that shares
        several buckets is looked at in the first.
        """
        possible, similarity, blocks = self.possible, self.similarity, F.ceil(F.col("n") / BLOCK).cast("int")
        sets = materialise(self._sets(self.nodes.select("node", "row").join(members.select("node").distinct(), "node")), "sets")
        sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
        placed = members.join(sizes, "band").withColumns({"own": F.pmod(F.xxhash64("node"), blocks).cast("int"), "met": F.explode(F.sequence(F.lit(0), blocks - 1))})
        dealt = placed.select("band", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "node").join(self.labels, "node").join(self.nodes.select("node", "bands", "sketch").join(sets, F.col("node") == F.col("at")), "node")

        def compare(table: pa.Table) -> pa.Table:
            root, own, band, low, high = (table.column(c).to_numpy() for c in ("root", "own", "band", "low", "high"))
            bands, sketch = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(root), -1) for c in ("bands", "sketch"))
            grams = table.column("grams").combine_chunks()
            flat, ends = grams.flatten().to_numpy(), np.cumsum([0, *grams.value_lengths().to_pylist()])
            signs = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
            apart = (signs.shape[1] - signs[one] @ signs[two].T) / 2
            wanted = (apart <= possible) & (root[one][:, None] != root[two][None, :])
            if low[0] == high[0]:
                wanted = np.triu(wanted)
            x, y = np.nonzero(wanted)
            order = np.argsort(apart[x, y], kind="stable")
            x, y = one[x[order]], two[y[order]]
            here = bands[x, (bands[x] == bands[y]).argmax(1)] == band[0] if len(x) else np.zeros(0, bool)
            group = {r: r for r in root.tolist()}

            def head(r: int) -> int:
                while group[r] != r:
                    group[r] = r = group[group[r]]
                return r

            links = []
            for i, j in zip(x[here].tolist(), y[here].tolist(), strict=True):
                ra, rb = head(int(root[i])), head(int(root[j]))
                if ra == rb:
                    continue
                m, n = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                both = len(np.intersect1d(m, n, assume_unique=True)) if similarity * max(len(m), len(n)) <= min(len(m), len(n)) + 1e-9 else 0
                if both + 1e-9 >= similarity * (len(m) + len(n) - both):
                    group[max(ra, rb)] = min(ra, rb)
                    links.append((int(root[i]), int(root[j])))
            return pa.table({"ra": pa.array([a for a, _ in links], pa.int64()), "rb": pa.array([b for _, b in links], pa.int64())})

        found = materialise(dealt.groupBy("band", "low", "high").applyInArrow(compare, "ra long, rb long"), "links")
        discard(sets)
        return found

    def run(self, radius: int) -> DataFrame:
        """(node, least_id, root) of every node."""
        members = self.members()
        balls = self.by_balls(radius)
        self.start(members, balls)
        self.absorb(balls)
        turn, members = 0, self.mixed(members)
        while _any(members):
            turn += 1
            pairs, links = self.absorb(self.by_leaders(members, turn))
            members = self.mixed(members)
            if links * WORTH_A_ROUND < pairs or not links:
                break
        if _any(members):
            links = self.across(members)
            if _any(links):
                self._merge(links.distinct())
            discard(links)
        discard(members)
        return materialise(self.nodes.join(self.labels, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "groups")


def keep_one_of_similar(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    similarity: float = 0.8,
    radius: int = 2,
    bands: int = 20,
    band_rows: int = 6,
    sketch_words: int = 16,
) -> DataFrame:
    """``docs`` without all but one document of each group of near copies.

    Texts with equal lower-cased word sequences are one node. Candidates are nodes
    whose SimHash fingerprints (of the shingle set) differ in at most ``radius``
    bits, found by ball hashing, and nodes that share one of ``bands`` hashes of
    ``band_rows`` min-hashes each, so that a pair of similarity J is missed with
    probability (1 - J ** band_rows) ** bands, however it differs and however short
    it is: at 0.8 one of 400, at 0.85 one of 20,000.

    In a bucket of a band every member meets a leader of another group, in rounds of
    new orders for as long as they find links; then all pairs of members of
    different groups that are left in a bucket are compared, in blocks, so no
    candidate is left out. A pair is a link if its shingle sets have a Jaccard
    similarity of ``similarity``: SimHash sketches of the sets (64 bits per sketch
    word) settle pairs far from that, the sets themselves all others that would
    join two groups.

    The row with the least id of each linked group stays, null ids last; of equal
    least ids with different texts that of the least hash. Null and empty texts are
    equal to one another. Of repeated rows one stays (the least by a hash of all
    columns). An empty table gives no rows. All columns are passed on unchanged,
    whatever their names.
    """
    search = _Search(docs, id_col, text_col, shingle_words, similarity, bands, band_rows, sketch_words)
    groups = search.run(radius)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("best")).select("best.*")
    # Rows are matched by text and id together: copies of one text, however many, spread evenly.
    stay = materialise(best.select(F.col("least_id").alias("stay_id"), F.col("node").alias("stay_node"), F.xxhash64("node", "least_id").alias("stay_row")), "stay")
    for table in (groups, search.labels, search.nodes):
        discard(table)
    key, row, turn = fresh_name(docs, "text_key"), fresh_name(docs, "row_key"), fresh_name(docs, "row_turn")
    at = docs.columns.index(text_col)

    def keyed(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            values = np.array([_words_key(t or b"") for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.view(np.int64))], names=[*batch.schema.names, key])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    full = arrow_map(docs, keyed, f"{fields}, `{key}` long").withColumn(row, F.xxhash64(key, f"`{id_col}`"))
    same = (full[row] == stay.stay_row) & (full[key] == stay.stay_node) & full[id_col].eqNullSafe(stay.stay_id)
    kept = full.join(stay, same, "left_semi")
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    return kept.withColumn(turn, F.row_number().over(Window.partitionBy(row).orderBy(tie))).where(f"{turn} = 1").select(*[f"`{c}`" for c in docs.columns])
