"""Near-duplicates by b-bit MinHash.

A text is the set of its five-word shingles. Texts with equal sets form a
class; classes are the nodes from here on, so exact copies never meet in
pairs. Each class gets ``BANDS * ROWS`` minima. All bits of a band's minima
make its bucket key; of each minimum ``BITS`` low bits stay, packed into a
signature of a few longs. Two classes that share a bucket are candidates; the
share of equal low bits, corrected for chance equality, estimates their
similarity; pairs whose estimate lies ``SIGMAS`` standard errors below the
threshold are passed over, and the rest is confirmed on the full sets.

With 32 bands of 4 rows a pair of similarity 0.75 shares no bucket with
probability 5e-6, pairs above it less.

A bucket's members are never paired all with all. In a round each bucket that
still holds several components picks a centre and pairs the others with it;
confirmed links merge components. Members that are already connected need no
comparison, so a large group of near copies costs a few comparisons each.
After ``STAR_ROUNDS`` rounds, members that share too few shingles with all
other components together to be linked with any are put aside: by the counts
alone they have no link left. Of a bucket with few members left those in
different components are compared, the ones outside its largest component with
the others. A bucket with more than ``CROWD`` members goes by differences
(``_crowds``): all of them are compared with the member that is most like the
rest, and two others can only be linked if they depart from it in many of the
same places, so they meet by an equi join on rare departures. So every
candidate pair has been confirmed, refused, ruled out by exact counts or found
connected in the end.

Defined results: a null text, or one without words, has no shingles and is
linked with nothing, and its component is its own; a null doc_id comes last
(a component of nulls only has a null id); repeated rows share a class, and
all rows that carry their component's id are kept by ``near_groups``, one of
them by ``near_dedup``; an empty table gives an empty result. Extra columns pass
through ``near_dedup`` unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import col, unpack, whole_row
from shortlist.llm.components import connected_components
from shortlist.llm.vectors import U64, chunks, mix, raw_texts, shingle_sets
from shortlist.session import cut_lineage

#: Similarity at which two documents are linked, in percent.
PERCENT = 75
BANDS, ROWS = 32, 4
BITS = 2
SIGMAS = 6
STAR_ROUNDS = 1
#: Members of a bucket from which on they are not compared with each other.
CROWD = 32
#: Passes of the count filter, which may stop at any time.
COUNT_ROUNDS = 4
#: A pass that takes less than this share of the nodes is the last one: the
#: next one would cost more than the few comparisons that it saves.
LEAST_GONE = 0.05
#: Up to so many classes (about 100 MB of ids) the list of documents whose
#: text is needed is broadcast to the scan; beyond, the scan is joined by id.
BROADCAST_IDS = 4_000_000

MINIMA = BANDS * ROWS
LONGS = MINIMA * BITS // 64
_rng = np.random.Generator(np.random.PCG64(77))
FACTOR = _rng.integers(1, 1 << 63, MINIMA, dtype=U64) * U64(2) + U64(1)
FLIP = _rng.integers(1, 1 << 63, MINIMA, dtype=U64)
#: The lowest bit of each stored minimum.
LOW_BITS = sum(1 << i for i in range(0, 64, BITS))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, MINIMA) minima of non-empty sets."""
    flat = np.concatenate(sets)
    size = np.array([len(s) for s in sets])
    first = np.cumsum(size) - size
    out = np.empty((len(sets), MINIMA), U64)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat((flat ^ FLIP[k]) * FACTOR[k], first)
    return out


def signatures(lows: np.ndarray) -> np.ndarray:
    """Low bits of the minima packed into (texts, LONGS) signed longs."""
    low = mix(lows) & U64((1 << BITS) - 1)
    per = 64 // BITS
    shift = (np.arange(per, dtype=U64) * U64(BITS))
    return np.bitwise_or.reduce(low.reshape(len(low), LONGS, per) << shift, axis=2).view(np.int64)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; the band is part of the key."""
    key = np.tile(np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15), (len(mins), 1))
    for r in range(ROWS):
        key = mix(key * U64(31) + mins[:, r::ROWS])
    return key.view(np.int64)


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (of the set; null if empty), keys, sig."""
    two = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = raw_texts(batch.column(1))
            for a, b in chunks(offsets):
                sets = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                full = [i for i, s in enumerate(sets) if len(s)]
                size = np.array([len(s) for s in sets], np.int64)
                h = np.zeros((len(sets), 2), np.int64)
                keys, sig = [None] * len(sets), [None] * len(sets)
                if full:
                    got = [sets[i] for i in full]
                    first = np.cumsum(size[full]) - size[full]
                    flat = np.concatenate(got)
                    h[full, 0] = np.add.reduceat(mix(flat ^ U64(0x5851F42D4C957F2D)), first).view(np.int64)
                    h[full, 1] = np.add.reduceat(mix(flat + U64(0x14057B7EF767814F)), first).view(np.int64)
                    mins = minima(got)
                    for i, k, s in zip(full, band_keys(mins), signatures(mins)):
                        keys[i], sig[i] = k, s
                empty = size == 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(size), pa.array(h[:, 0], mask=empty),
                     pa.array(h[:, 1], mask=empty), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "h1", "h2", "keys", "sig"])

    return two.mapInArrow(sketch, f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, "
                                  "keys array<bigint>, sig array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Collision-corrected similarity of two signatures by bit counts."""
    differ = F.lit(0)
    for i in range(LONGS):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = x
        for j in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, j))
        differ = differ + F.bit_count(folded.bitwiseAND(F.lit(LOW_BITS).cast("bigint")))
    chance = 2.0 ** -BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    """The threshold less SIGMAS standard errors of the estimate there."""
    j, chance = percent / 100, 2.0 ** -BITS
    equal = j + (1 - j) * chance
    return j - SIGMAS * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) that the set sizes and the
    estimate allow."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    near = estimate(F.col("sa"), F.col("sb")) >= least_estimate(percent)
    return pairs.join(left, "a").join(right, "b").filter(fits & near).select("a", "b")


class Found:
    """The links confirmed so far and the components they make. ``labels``
    (node, label) holds the nodes that are not the smallest of theirs."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, percent: int, nodes: DataFrame, n_nodes: int,
                 repeated: bool):
        self.docs = docs.select(col(doc_id).alias("__doc"), col(text).alias("text"))
        self.percent, self.nodes, self.n_nodes, self.repeated = percent, nodes, n_nodes, repeated
        self.tested = self.labels = None

    def labelled(self, members: DataFrame) -> DataFrame:
        """members (key, node) with the label of each node's component."""
        members = members.select("key", "node")
        if self.labels is None:
            return members.withColumn("label", F.col("node"))
        return members.join(self.labels, "node", "left").select(
            "key", "node", F.coalesce("label", "node").alias("label"))

    def still_open(self, members: DataFrame) -> DataFrame:
        """The rows (key, node, label, members) of buckets that hold several
        components."""
        return _open(self.labelled(members))

    def texts(self, used: DataFrame) -> DataFrame:
        """(node, text) of the nodes ``used``: the text of each class's first
        document. Where several rows may carry its doc_id, the set hash tells
        which."""
        used = cut_lineage(self.nodes.join(used, "node").select("node", F.col("first_id").alias("__id"), "h1", "h2"))
        used = F.broadcast(used) if self.n_nodes <= BROADCAST_IDS else used
        rows = self.docs.join(used, F.col("__doc").eqNullSafe(F.col("__id"))).select("node", "h1", "h2", "text")
        if self.repeated:
            return rows.mapInArrow(_matching, "node bigint, text string").dropDuplicates(["node"])
        return rows.select("node", "text")

    def add(self, pairs: DataFrame) -> None:
        """Compares candidate pairs (a < b, repeated or not) that have not been
        compared."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = cut_lineage(likely(pairs, self.nodes, self.percent))
        if not pairs.take(1):
            return
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        links = cut_lineage(self.confirm(pairs))
        if not links.take(1):
            return
        if self.labels is not None:  # the components so far, as links to their smallest node
            links = links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        self.labels = connected_components(links)

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full shingle sets are similar enough. Each pair
        brings the two texts together."""
        percent = self.percent
        texts = self.texts(pairs.select(F.col("a").alias("node")).unionByName(
            pairs.select(F.col("b").alias("node"))).distinct())
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").join(
            texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (batch.column(i).to_numpy() for i in (0, 1))
                keep = np.zeros(len(a), bool)
                for lo in range(0, len(a), 64):
                    part = batch.slice(lo, 64)
                    one, two = (shingle_sets(*raw_texts(part.column(i))) for i in (2, 3))
                    for i, (s, t) in enumerate(zip(one, two)):
                        same = len(s) + len(t) - len(np.union1d(s, t))
                        keep[lo + i] = 100 * same >= percent * (len(s) + len(t) - same)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

        return both.mapInArrow(check, "a bigint, b bigint")

    def sets(self, used: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes ``used``."""
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, offsets = raw_texts(batch.column(1))
                for a, b in chunks(offsets):
                    got = shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a), pa.array([g.view(np.int64) for g in got],
                                                                   pa.list_(pa.int64()))], ["node", "shingles"])

        return self.texts(used).mapInArrow(make, "node bigint, shingles array<bigint>")


def _open(at: DataFrame) -> DataFrame:
    """Those of ``at`` (key, node, label, ...) in buckets that hold several
    components, with the bucket's number of members."""
    several = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"),
                                    F.count(F.lit(1)).alias("members"))
    return cut_lineage(at.join(several.filter("x < y").select("key", "members"), "key"))


def _able_to_link(found: Found, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Those of ``at`` (key, node, label) that may still be linked with another
    component, with n, the number of their shingles that are in another one,
    size, and members, of their bucket; and the shingles (node, shingles) of all.

    A node linked with another component shares at least ``percent`` % of its
    own shingles with it. Shingles that no open node of another component has
    cannot be shared, so a node with too many of them has no link left to find
    and goes, with all its pairs uncompared. Repeated while many nodes go, a few
    times: what was shared only with nodes that went counts no more. Nodes that
    another pass would take are compared instead."""
    sets = cut_lineage(found.sets(at.select("node").distinct()))
    for turn in range(COUNT_ROUNDS):
        labels = cut_lineage(at.select("node", "label").distinct())
        shared = _foreign(sets, labels).groupBy("node", "size").agg(F.count(F.lit(1)).alias("n"))
        able = cut_lineage(shared.filter(100 * F.col("n") >= found.percent * F.col("size")))
        left = able.count()
        gone = labels.count() - left
        if gone:
            at = _open(at.drop("members").join(able.select("node"), "node"))
        if not left or gone < LEAST_GONE * (left + gone):
            break
    return cut_lineage(at.join(able, "node")), sets


def _foreign(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, size, s): the shingles of the nodes in ``labels`` (node, label)
    that another label's nodes there have too, and how many a node has in all."""
    each = sets.join(labels, "node").select("node", "label", F.size("shingles").alias("size"),
                                            F.explode("shingles").alias("s"))
    foreign = each.groupBy("s").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y")
    return each.join(foreign.select("s"), "s", "left_semi").select("node", "size", "s")


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for s, h in zip(shingle_sets(*raw_texts(batch.column(3))), batch.column(1)):
            got = np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64)
            keep.append(int(np.int64(got.astype(np.int64))) == h.as_py())
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(3).filter(mask)],
                                         ["node", "text"])


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and the
    internal columns h1, h2 (its set) and row (its place)."""
    rows = cut_lineage(sketches(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = cut_lineage(rows.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(
        F.min("row").alias("node"), F.min(first)["doc_id"].alias("first_id"), F.min(first)["row"].alias("first_row"),
        F.count(F.lit(1)).alias("rows"), F.first("n_shingles").alias("n_shingles"),
        F.first("keys").alias("keys"), F.first("sig").alias("sig")))
    n_nodes = nodes.count()
    repeated = not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    members = nodes.select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut_lineage(members.join(shared.select("key"), "key"))

    found = Found(docs, doc_id, text, percent, nodes, n_nodes, repeated)
    for turn in range(STAR_ROUNDS):
        found.add(_star(found.labelled(members), turn))
        members = found.still_open(members)
    at = members if STAR_ROUNDS else found.still_open(members)
    if at.take(1):
        at, sets = _able_to_link(found, at)
        shared = _foreign(sets, at.select("node", "label").distinct())
        crowded = F.col("members") > CROWD
        across = _across(at.filter(~crowded).drop("members"), percent)
        _crowds(found, at.filter(crowded).drop("members"), shared, across)
    labels = found.labels

    label = F.col("node") if labels is None else F.coalesce("label", "node")
    named = nodes if labels is None else nodes.join(labels, "node", "left")
    named = named.select("h1", "h2", "first_id", "first_row", label.alias("label"))
    best = named.groupBy("label").agg(
        F.min(F.struct(F.col("first_id").isNull(), "first_id", "first_row")).alias("best"))
    named = named.join(best, "label").select("h1", "h2", F.col("best.first_id").alias("component_id"))
    joined = rows.drop("keys", "sig").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.col("doc_id").eqNullSafe(component).alias("kept"), "h1", "h2", "row")


def _star(at: DataFrame, turn: int) -> DataFrame:
    """Each bucket's members paired with one of them, another one each turn."""
    pick = F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn)))
    centre = at.groupBy("key").agg(pick.alias("c"))
    return at.join(centre, "key").filter(F.col("label") != F.col("c.label")).select(
        F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))


def _across(at: DataFrame, percent: int) -> DataFrame:
    """The pairs of a bucket's members in different components whose sizes and
    counts of shared shingles allow a link: two nodes have at most as many
    shingles in common as the lesser n. Members of a bucket's largest component
    are paired with the others only."""
    sizes = at.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("members", "label")).alias("big"))
    minor = at.join(largest, "key").filter("label != big").select(
        "key", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("size").alias("sx"))
    most = F.least("n", "nx")
    right = minor.withColumnRenamed("key", "xkey")
    met = (F.col("key") == F.col("xkey")) & (F.col("label") != F.col("lx")) & (
        100 * most >= percent * (F.col("size") + F.col("sx") - most))
    return at.join(right, met).select(
        F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b"))


def _crowds(found: Found, at: DataFrame, shared: DataFrame, others: DataFrame) -> None:
    """Adds the links between members (key, node, label, size) of crowded
    buckets; ``shared`` (node, s) holds all shingles, n of a node, that it can
    have in common with another component. ``others`` are the pairs (a, b) of
    the other buckets, compared along with the centres: texts are brought
    together and components are made once for both.

    With J = percent / 100, two nodes u and v are linked if and only if they
    have J / (1 + J) * (size_u + size_v) shingles in common. Let each bucket's
    centre c be the member with the least 2 J / (1 + J) * size - n, let D be the
    places where a node's shared shingles differ from the centre's, and

        a = |D| - n + 2 J / (1 + J) * size,

    so that |D_u & D_v| >= (a_u + a_v) / 2 for linked nodes, as what they do
    not have in common is where D_u and D_v differ. Once every node has been
    compared with its centre, a node u outside the centre's component has
    a_u > -a_c, or else it would have been linked with the centre; and no a is
    below a_c. So of two nodes in different components one has a positive sum
    with the other: they have at least one place of departure in common, and
    mostly so many that no node's |D| can hold them. What is left meets by
    prefixes: of |D| places in a fixed order, the rare ones first, the first
    |D| - k + 1 hold one of any k common ones. Buckets with one centre are taken
    together. Where most members depart from the centre more than they follow
    it, the empty set takes its place: D is then all that a node shares."""
    pc = 100 + found.percent  # everything times 100 + percent, to stay with whole numbers
    shared = cut_lineage(shared.join(at.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.collect_list("s").alias("shared")))
    at = at.drop("n").join(shared.select("node", F.size("shared").alias("n")), "node")
    slack = 2 * found.percent * F.col("size") - pc * F.col("n")
    centre = at.groupBy("key").agg(F.min(F.struct(slack.alias("slack"), F.col("node").alias("c"))).alias("m"))
    near = cut_lineage(at.join(centre, "key").select("m", "node", slack.alias("slack")).distinct())
    # a centre that is a member elsewhere, beside a better one, hands its members on to that one
    better = near.groupBy("node").agg(F.min("m").alias("to"))
    near = near.join(better.withColumnRenamed("node", "c"), F.col("m.c") == F.col("c")).select(
        "to.c", "node", "slack", F.col("to.slack").alias("least"))
    itself = near.select("c", F.col("c").alias("node"), F.col("least").alias("slack"), "least")
    near = cut_lineage(near.unionByName(itself).distinct())
    central = near.filter("c != node").select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b"))
    found.add(central.unionByName(others))

    labels = found.labelled(near.select(F.col("c").alias("key"), "node"))
    own = F.max(F.when(F.col("key") == F.col("node"), F.col("label")))
    middle = labels.groupBy("key").agg(own.alias("inner"), F.max("label").alias("x"), F.min("label").alias("y"))
    labels = labels.join(middle.filter("x != y"), "key").select(
        F.col("key").alias("c"), "node", "label", (F.col("label") == F.col("inner")).alias("inside"))
    of_c = shared.select(F.col("node").alias("c"), F.col("shared").alias("central"))
    apart = F.concat(F.array_except("shared", "central"), F.array_except("central", "shared"))
    group = near.join(labels, ["c", "node"]).join(shared, "node").join(of_c, "c").select(
        "c", "node", "label", "inside", "least", "slack", apart.alias("d"), "shared")
    group = cut_lineage(group)  # read four times below
    loose = group.groupBy("c").agg((2 * F.avg(F.size("d")) > F.avg(F.size("shared"))).alias("loose"))
    group = group.join(loose, "c").select(
        "c", "node", "label", (F.col("inside") & ~F.col("loose")).alias("inside"), "least", "slack",
        F.when(F.col("loose"), F.col("shared")).otherwise(F.col("d")).alias("d"))
    group = group.withColumn("a", pc * F.size("d") + F.col("slack")).drop("slack")
    outer = group.filter(~F.col("inside")).groupBy("c").agg(F.min("a").alias("outer"))
    each = group.select("c", "node", F.explode("d").alias("place"))
    rare = each.groupBy("c", "place").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(rare, ["c", "place"]).groupBy("c", "node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("often", "place"))), lambda x: x["place"]).alias("d"))
    group = cut_lineage(group.drop("d").join(ranked, ["c", "node"]).join(outer, "c"))

    def places(rows: DataFrame, other: str) -> DataFrame:
        """(c, place, node, label) of the first places: the nodes that it may
        be linked with have an ``a`` of at least ``other``."""
        common = F.ceil((F.col("a") + F.col(other)) / (2 * pc)).cast("int")
        n = F.greatest(F.size("d") - F.greatest(common, F.lit(1)) + 1, F.lit(0))
        return rows.select("c", "node", "label", F.explode(F.slice("d", F.lit(1), n)).alias("place"))

    outside = group.filter(~F.col("inside"))
    to_inside, among = places(outside, "least"), places(outside, "outer")
    inside = places(group.filter("inside"), "outer")
    right = among.select("c", "place", F.col("node").alias("v"), F.col("label").alias("lv"))
    pairs = to_inside.join(inside.select("c", "place", F.col("node").alias("v")), ["c", "place"]).select("node", "v")
    pairs = pairs.unionByName(among.join(right, ["c", "place"]).filter("node < v AND label != lv").select("node", "v"))
    found.add(pairs.select(F.least("node", "v").alias("a"), F.greatest("node", "v").alias("b")))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each component, with all columns.
    ``docs`` is read several times, so it should be a table."""
    ids = docs.groupBy(col(doc_id)).agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        rows = docs.select(whole_row(docs), col(doc_id).alias("__id"), col(text).alias("__text"))
    else:  # repeated ids: (doc_id, place) is the id
        rows = cut_lineage(docs.select(
            whole_row(docs), F.struct(col(doc_id).isNull(), col(doc_id), F.monotonically_increasing_id())
            .alias("__id"), col(text).alias("__text")))
    groups = cut_lineage(near_groups(rows, "__id", "__text", percent).select("doc_id", "kept"))
    gone = groups.filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    gone = F.broadcast(gone) if groups.count() <= BROADCAST_IDS else gone
    stay = rows.join(gone, F.col("__id").eqNullSafe(F.col("__gone")), "left_anti")
    return unpack(stay, docs.columns)
