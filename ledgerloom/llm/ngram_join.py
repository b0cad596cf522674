"""N-gram Jaccard join by prefix trees.

1. Each text gives its set of word shingles; texts of one set form a class, which one vertex stands for. A shingle is a
   62-bit hash, and the hash is the global order. Two sets that link share a shingle among the first
   ``n - ceil(percent * n / 100) + 1`` of each, its prefix; a quarter as many again are kept beside it.
2. Hot shingles. A shingle that more than ``most`` classes have there is looked at first: these classes are paired with the
   most central one of them only, and confirmed links give homes, so that a large group of near copies becomes one
   home. A shingle of more than ``most`` homes (a licence, a shared passage) is hot, and moves to the end of the order.
3. A set that is left with too few shingles for its prefix is read whole. Pairs of such sets have an order of their own, in
   which the shingles hot among them come last; other pairs go by the first order. Each pair is thus judged under one order.
4. Join: a list holds the prefixes, from one shingle on, of all sets with that shingle in the prefix and sizes that can
   link. Those whose shingle stands early enough for the smaller set of a pair are stored in a tree (compressed paths, with the sizes, rests and homes below each node), and every set
   of the list walks the tree of those before it. A walk shares the partial overlap of all sets below a node and leaves a subtree when
   the overlap so far plus the shorter rest cannot reach what the sizes below demand, or when all below are of its own
   home. A list with more than 4,096 stored sets is dealt over several trees, which every set of the list walks.
5. Marks. A set's mark holds, for each of 256 to 4,096 residues, the parity of its shingles there. Two marks differ in no more
   places than their sets differ in shingles, so a pair whose marks differ more than a link allows is no link. In a large group
   of near copies that are just too unlike to link, prefixes leave nearly all pairs, and marks few. In lists of up to ``few``
   sets, marks, sizes and places are compared before any prefix travels: a tree gets the sets that another one of
   their list may link with. The more a corpus holds, the more of its unlike texts share some shingle.
6. A set gives its ``nearest`` pairs of a list by their marks, and says if more are left. Pairs are confirmed on the full sets: first
   each set's best one of a list, then, of the others, those between different components. Lists with more are walked again by
   the homes that are known then, and give all pairs that are left. A link inside a component changes nothing, so no link is lost.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component;
with fewer words than a shingle, the whole sequence is the one shingle; repeated rows are linked; a null doc_id has a null
component unless it is linked with a row that has one; the least doc_id names a component; a very long text is read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, discard, materialize, shuffles_freed, slices, slotted
from .links import confirm_links
from .near_dedup import components, shingle_sets

_U = np.uint64
LATE = 1 << 62  # what a hot shingle is raised by in the second order


def prefix_length(n: F.Column | int, percent: int) -> F.Column | int:
    """n - ceil(percent * n / 100) + 1."""
    if isinstance(n, int):
        return n + 1 - (percent * n + 99) // 100
    return (n + 1 - F.floor((n * percent + 99) / 100)).cast("int")


def mark_bits(n: int) -> int:
    """Places of the mark of ``n`` shingles."""
    return min(4096, max(256, 1 << max(0, (n + 1) // 2 - 1).bit_length()))


def mark(tokens: np.ndarray) -> bytes:
    bits = mark_bits(len(tokens))
    return np.packbits(np.bincount(tokens % bits, minlength=bits) & 1).tobytes()


def fold(value: int, bits: int, to: int) -> int:
    """A mark of ``bits`` places as one of ``to``, which divide them: residues that become one are added up."""
    while bits > to:
        bits //= 2
        value = (value >> bits) ^ (value & ((1 << bits) - 1))
    return value


def _ordered(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Of each text the distinct shingles, ascending."""
    owner, value = shingle_sets(texts, n)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    for lo, hi in zip(at, at[1:]):
        yield np.unique((value[lo:hi] >> _U(2)).astype(np.int64))


def _heads(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = column_bytes(b.column(2))
        for lo, hi in slices(texts, 1 << 20):
            sets = list(_ordered(texts[lo:hi], shingle))
            size = [len(s) for s in sets]
            name = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            head = []
            for s in sets:
                k = prefix_length(len(s), percent)
                head.append(s[: k + k // 4 + 8].tolist())
            marks = pa.array([mark(s) if len(s) else None for s in sets], pa.binary())
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(head, pa.list_(pa.int64())), marks], names=["doc_id", "tk", "n", "c", "head", "mark"])


def _whole(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = column_bytes(b.column(1))
        for lo, hi in slices(texts, 1 << 20):
            sets = list(_ordered(texts[lo:hi], shingle))
            yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))], names=["v", "tokens"])


class PrefixTree:
    """Sets by their ordered prefixes from one shingle on. A node: its path, its children by their first shingle, the least
    and the largest size, the longest rest from that shingle on and the one home (None: several) below it, and the sets
    that end at it."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = self._node(array("q"))

    @staticmethod
    def _node(path: array) -> list:
        return [path, {}, 1 << 62, 0, 0, ..., []]

    @staticmethod
    def _note(node: list, n: int, rest: int, home: int) -> None:
        node[2], node[3], node[4] = min(node[2], n), max(node[3], n), max(node[4], rest)
        node[5] = home if node[5] is ... or node[5] == home else None

    def insert(self, prefix: array, v: int, n: int, rest: int, home: int) -> None:
        """rest: how many shingles of the set are not before ``prefix``."""
        node, at = self.root, 0
        while True:
            self._note(node, n, rest, home)
            kid = node[1].get(prefix[at]) if at < len(prefix) else None
            if kid is None:
                if at < len(prefix):
                    kid = node[1][prefix[at]] = self._node(prefix[at:])
                    self._note(kid, n, rest, home)
                    node = kid
                node[6].append((v, n, rest, home))
                return
            path, same = kid[0], 1
            while same < len(path) and at + same < len(prefix) and path[same] == prefix[at + same]:
                same += 1
            if same < len(path):  # the path is cut where the set leaves it
                upper = self._node(path[:same])
                upper[2:6] = kid[2:6]
                kid[0] = path[same:]
                upper[1][kid[0][0]] = kid
                node[1][path[0]] = upper
                kid = upper
            node, at = kid, at + same

    def walk(self, prefix: array, n: int, rest: int, home: int) -> list[tuple[int, int]]:
        """(v, overlap in the prefixes) of the stored sets of other homes that can still link if they share nothing before."""
        place = {t: i for i, t in enumerate(prefix)}
        last, p = prefix[-1], self.percent
        least, most = -(-p * n // 100), n * 100 // p
        found: list[tuple[int, int]] = []
        stack = [(self.root, 0, 0, 0)]  # node, its shingles so far, common ones, own shingles up to the last common one
        while stack:
            node, seen, both, own = stack.pop()
            if node[5] == home or node[2] > most or node[3] < least:
                continue
            need = -(-p * (n + max(node[2], least)) // (100 + p))
            beyond = alive = False
            for t in node[0]:
                if t > last:  # may be among the own shingles that are not in the prefix
                    beyond = True
                    break
                i = place.get(t)
                seen += 1
                if i is not None:
                    both, own = both + 1, i + 1
                if both + min(node[4] - seen, rest - own) < need:
                    break
            else:
                alive = True
            if beyond:
                below = [node]
                while below:
                    x = below.pop()
                    below += x[1].values()
                    found += [(v, both) for v, m, r, h in x[6] if h != home and self._can(both, r - seen, rest - len(prefix), n, m)]
            elif alive:
                found += [(v, both) for v, m, r, h in node[6] if h != home and self._can(both, r - seen, rest - own, n, m)]
                stack += [(kid, seen, both, own) for kid in node[1].values()]
        return found

    def _can(self, both: int, rest: int, own_rest: int, n: int, m: int) -> bool:
        return (both + min(rest, own_rest)) * (100 + self.percent) >= self.percent * (n + m)


def _join(batches: Iterator[pa.RecordBatch], percent: int, nearest: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of one list and tree together, sets to be stored first. Gives the ``nearest`` pairs of each set (None: all); ``near``
    marks the best one. A row without ``b`` names a list of which a set has more."""
    at, tree, marks = None, None, {}
    for b in batches:
        out: list[tuple] = []
        for turn, token, band, block, stored, v, n, pos, home, prefix, bytes_ in zip(*(c.to_pylist() for c in b.columns)):
            if at != (turn, token, band, block):
                at, tree, marks, more = (turn, token, band, block), PrefixTree(percent), {}, False
            prefix = array("q", prefix)
            value, bits = int.from_bytes(bytes_), mark_bits(n)
            found = []
            for other, both in tree.walk(prefix, n, n - pos, home):
                its, its_bits, m = marks[other]
                to = min(bits, its_bits)
                apart = (fold(value, bits, to) ^ fold(its, its_bits, to)).bit_count()
                if apart * (100 + percent) <= (100 - percent) * (n + m):
                    found.append((apart, -both, other))
            found.sort()
            if nearest is not None and len(found) > nearest:
                found = found[:nearest]
                if not more:
                    out.append((None, None, False, turn, token))
                    more = True
            out += [(min(v, other), max(v, other), not i, None, None) for i, (_, _, other) in enumerate(found)]
            if stored:
                tree.insert(prefix, v, n, n - pos, home)
                marks[v] = value, bits, n
        columns = list(zip(*out)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()))], names=["a", "b", "near", "turn", "token"])


def _may_link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of one list together. Gives the sets that may link with another one of another home, of which one is stored."""
    at, group = None, []
    for b in batches:
        out: list[tuple] = []
        for turn, token, band, stored, v, n, pos, home, bytes_ in zip(*(c.to_pylist() for c in b.columns)):
            if at != (turn, token, band):
                at, group = (turn, token, band), []
            own = [int.from_bytes(bytes_), mark_bits(n), n, n - pos, home, stored, False, (turn, token, band, v, pos, stored)]
            for other in group:
                if own[6] and other[6] or home == other[4] or not (stored or other[5]):
                    continue
                both = n + other[2]
                if min(n - pos, other[3]) * (100 + percent) < percent * both:
                    continue
                to = min(own[1], other[1])
                if (fold(own[0], own[1], to) ^ fold(other[0], other[1], to)).bit_count() * (100 + percent) > (100 - percent) * both:
                    continue
                out += [x[7] for x in (own, other) if not x[6]]
                own[6] = other[6] = True
            group.append(own)
        columns = list(zip(*out)) or [()] * 6
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_()))], names=["turn", "token", "band", "v", "pos", "stored"])


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, most: int = 32, trees_of: int = 4096, nearest: int = 32, few: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row. Links have 100 * intersection >= percent * union."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tk"), text.alias("text"))
    sets = materialize(rows.mapInArrow(lambda it: _heads(it, shingle, percent), "doc_id long, tk long, n long, c binary, head array<long>, mark binary"), "join-sets")
    named = materialize(sets.select("doc_id", "n", "c"), "join-named")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("c").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("mark").alias("mark"))
    headed = materialize(classes.select(F.monotonically_increasing_id().alias("v"), "c", "rep.doc_id", "rep.tk", "n", "head", "mark"), "join-classes")
    discard(sets)
    classes = materialize(headed.select("v", "c", "doc_id", "tk"), "join-ids")
    vertices = classes.select(F.col("v").alias("c"), "doc_id")
    names = classes.select(F.col("v").alias("c"), F.col("doc_id").alias("d"), F.col("tk").alias("t"))
    k = prefix_length(F.col("n"), percent)

    def texts(ids: DataFrame) -> DataFrame:
        """v and text of the classes in ``ids``; a row's repetitions give one. Only texts whose slot is wanted are exchanged."""
        wanted = materialize(names.join(ids.withColumnRenamed("v", "c"), "c"), "join-wanted")
        return slotted(rows, "tk", wanted.select("t")).join(wanted, (F.col("doc_id") == F.col("d")) & (F.col("tk") == F.col("t"))).groupBy(F.col("c").alias("v")).agg(F.first("text").alias("text"))

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return confirm_links(materialize(pairs, f"{name}-pairs"), texts, shingle, percent, name)

    def homes(label: DataFrame) -> DataFrame:
        return label.select(F.col("c").alias("v"), F.col("label.c").alias("home"))

    # large lists: one star each, then homes
    posts = headed.select("v", "n", F.posexplode("head").alias("pos", "token"))
    large = materialize(posts.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most), "join-large")
    crowd = materialize(posts.join(large, "token").select("token", "v", "n", "pos", "size"), "join-crowd")
    early = crowd.where(F.col("pos") < k)
    weight = early.groupBy("v").agg(F.sum("size").alias("weight"))
    star = early.join(weight, "v").groupBy("token").agg(F.min(F.struct((-F.col("weight")).alias("w"), "v", "n")).alias("m")).select("token", F.col("m.v").alias("a"), F.col("m.n").alias("m"))
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    led = early.join(star, "token").where((F.col("v") != F.col("a")) & fits).select("a", F.col("v").alias("b")).distinct()
    heads = headed.select("v", "n", F.slice("head", F.lit(1), k).alias("h"))
    led = led.join(heads.select(F.col("v").alias("a"), F.col("n").alias("n_a"), F.col("h").alias("h_a")), "a").join(heads.select(F.col("v").alias("b"), F.col("n").alias("n_b"), F.col("h").alias("h_b")), "b")
    cut = F.least(F.element_at("h_a", -1), F.element_at("h_b", -1))
    rest = [F.col(f"n_{x}") - F.size(F.filter(f"h_{x}", lambda t: t <= cut)) for x in "ab"]
    bound = F.size(F.array_intersect("h_a", "h_b")) + F.least(*rest)
    led = confirmed(led.where(bound * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"), "join-led")
    home = homes(components(vertices, led))

    def many(tokens: DataFrame) -> DataFrame:
        """The shingles of more than ``most`` homes. tokens: token, v."""
        own = tokens.join(home, "v", "left").select("token", F.coalesce("home", "v").alias("home"))
        return own.groupBy("token", "home").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("token")

    hot = materialize(many(crowd), "join-hot")
    late = crowd.join(hot, "token").groupBy("v").agg(F.collect_list("token").alias("late"))  # at most a head
    cold = F.when(F.col("late").isNull(), F.col("head")).otherwise(F.array_except("head", "late"))
    state = headed.select("v", "n", "head", "mark").join(late, "v", "left").join(home, "v", "left").select("v", "n", F.coalesce("home", "v").alias("home"), "mark", cold.alias("cold"))
    state = materialize(state.select("v", "n", "home", "mark", F.slice("cold", F.lit(1), k).alias("cold"), (F.size("cold") < k).alias("over")), "join-state")
    discard(headed)

    # sets with too few cold shingles: read whole, under both orders
    over = state.where("over").select("v", "n", "home", "mark")
    full = materialize(texts(over.select("v")).select("v", "text").mapInArrow(lambda it: _whole(it, shingle), "v long, tokens array<long>"), "join-whole")
    tokens = full.select("v", F.explode("tokens").alias("token"))
    crowded = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("token")
    also = materialize(many(tokens.join(crowded, "token")), "join-also")
    marked = tokens.join(hot.withColumn("one", F.lit(True)), "token", "left").join(also.withColumn("two", F.lit(True)), "token", "left").groupBy("v").agg(F.collect_list(F.struct("token", "one", "two")).alias("t"))
    first = F.transform(F.filter("t", lambda x: x["one"].isNull()), lambda x: x["token"])
    second = F.transform("t", lambda x: x["token"] + F.when(x["two"], F.lit(LATE)).otherwise(F.lit(0)))
    both = marked.join(over, "v").select("v", "n", "home", "mark", F.array(F.struct(F.lit(1).alias("turn"), first.alias("p")), F.struct(F.lit(2).alias("turn"), second.alias("p"))).alias("x"))
    both = both.select(F.explode("x").alias("x"), "v", "n", "home", "mark").select("x.turn", "v", "n", "home", "mark", F.lit(True).alias("over"), F.slice(F.sort_array("x.p"), F.lit(1), k).alias("prefix"))
    plain = state.where("not over").select(F.lit(1).alias("turn"), "v", "n", "home", "mark", "over", F.col("cold").alias("prefix"))
    prefixes = materialize(plain.union(both), "join-prefixes")
    discard(state, full, crowd)

    # lists, bands of size, trees. Of two sets that link, the smaller has their first common shingle early: only such entries are
    # stored, but where sets that were read whole take part, which are never stored in the first order
    early = (F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n")
    entries = prefixes.select("turn", "v", "n", "home", "over", F.posexplode("prefix").alias("pos", "token")).withColumn("early", early)
    plain = (F.col("turn") == 2) | ~F.col("over")
    count = [F.count(F.lit(1)).alias("size"), F.count_if("early").alias("early"), F.min("home").alias("lo"), F.max("home").alias("hi")]
    several = (F.col("size") > 1) & (F.col("early") > 0) & (F.col("kept") > 0) & (F.col("lo") != F.col("hi"))
    lists = entries.groupBy("turn", "token").agg(*count, F.count_if(plain).alias("kept"))
    lists = materialize(lists.where(several).select("turn", "token", (F.col("kept") < F.col("size")).alias("hard")), "join-lists")
    live = materialize(entries.join(lists, ["turn", "token"]).withColumn("stored", plain & (F.col("early") | F.col("hard"))), "join-live")
    band = F.floor(F.log("n") / (1.01 * math.log(100 / percent))).cast("int")  # sets that can link are in one band or in neighbours
    visits = F.when(F.col("stored") | ~F.col("hard"), F.array(band, band - 1)).otherwise(F.array(band + 1, band, band - 1))
    live = live.select("*", F.explode(visits).alias("band"), band.alias("own_band")).withColumn("stored", F.col("stored") & (F.col("band") == F.col("own_band")))
    trees = live.groupBy("turn", "token", "band").agg(*count, F.count_if("stored").alias("kept")).where(several).select("turn", "token", "band", "size", F.ceil(F.col("kept") / trees_of).cast("int").alias("trees"))
    visiting = materialize(live.join(trees, ["turn", "token", "band"]).select("turn", "token", "band", "v", "pos", "stored", "size", "trees"), "join-visits")
    small = (F.col("size") <= few) & (F.col("trees") == 1)
    own = F.when(F.col("stored"), F.pmod(F.xxhash64("v"), F.col("trees")).cast("int")).otherwise(F.lit(0))
    dealt = visiting.where(~small).select("turn", "token", "band", "v", "pos", "stored", own.alias("own"), F.explode(F.sequence(own, F.col("trees") - 1)).alias("tree"))
    near = visiting.where(small).join(prefixes.select("turn", "v", "n", "home", "mark"), ["turn", "v"]).select("turn", "token", "band", "stored", "v", "n", "pos", "home", "mark")
    near = near.repartition("turn", "token", "band").sortWithinPartitions("turn", "token", "band").mapInArrow(lambda it: _may_link(it, percent), "turn int, token long, band int, v long, pos int, stored boolean")
    dealt = materialize(dealt.union(near.select("turn", "token", "band", "v", "pos", "stored", F.lit(0).alias("own"), F.lit(0).alias("tree"))), "join-dealt")
    put = F.col("stored") & (F.col("tree") == F.col("own"))
    tail = F.slice("prefix", F.col("pos") + 1, F.size("prefix"))

    def walked(dealt: DataFrame, sets: DataFrame, nearest: int | None) -> DataFrame:
        """a, b and near of the pairs, and turn and token of lists with more. sets: prefixes with the homes by now."""
        sets = slotted(sets.withColumn("key", F.xxhash64("v")), "key", dealt.select(F.xxhash64("v").alias("key")))
        dealt = dealt.join(sets.select("turn", "v", "n", "home", "mark", "prefix"), ["turn", "v"])
        dealt = dealt.select("turn", "token", "band", "tree", put.alias("put"), "v", "n", "pos", "home", tail.alias("tail"), "mark")
        dealt = dealt.repartition("turn", "token", "band", "tree").sortWithinPartitions("turn", "token", "band", "tree", F.desc("put"), "v")
        found = dealt.mapInArrow(lambda it: _join(it, percent, nearest), "a long, b long, near boolean, turn int, token long")
        return found.groupBy("a", "b", "turn", "token").agg(F.max("near").alias("near"))

    found = materialize(walked(dealt, prefixes, nearest), "join-candidates")
    pairs, left = found.where("b is not null").select("a", "b", "near"), found.where("b is null").select("turn", "token")

    def across(pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs between different components."""
        now = homes(label)
        ends = pairs.join(now.select(F.col("v").alias("a"), F.col("home").alias("x")), "a", "left").join(now.select(F.col("v").alias("b"), F.col("home").alias("y")), "b", "left")
        return ends.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")

    links = led.union(confirmed(pairs.where("near").select("a", "b"), "join-near"))
    label = components(vertices, links)
    more = confirmed(across(pairs.where("not near"), label), "join-more")
    if not more.isEmpty():
        links = links.union(more)
        label = components(vertices, links)
    if not left.isEmpty():
        now = prefixes.drop("home").join(homes(label), "v", "left").withColumn("home", F.coalesce("home", "v"))
        last = confirmed(walked(dealt.join(left, ["turn", "token"]), now, None).select("a", "b"), "join-last")
        label = components(vertices, links.union(last))
    found = classes.select("v", "c", "doc_id").join(label.select(F.col("c").alias("v"), F.col("label.doc_id").alias("least")), "v", "left").select(F.col("c").alias("of"), F.coalesce("least", "doc_id").alias("component_id"))
    out = named.select("doc_id", F.col("n").alias("n_shingles"), "c").join(found, F.col("c") == F.col("of"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_ngram_join(docs: DataFrame) -> DataFrame:
    with shuffles_freed(docs.sparkSession):
        return jaccard_components(docs, shingle=3, percent=90)
