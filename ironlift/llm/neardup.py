"""Near-duplicate classes by ProbMinHash signatures of word shingle sets, banding and exact verification."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RangeHash, fresh, mix, saved, tune
from .decontaminate import normal_words

#: Words of a shingle, and the Jaccard similarity of two texts' shingle sets from which on they are linked.
WORDS, SIMILARITY = 5, 0.8
#: Bands and rows of each: a pair at 0.8 shares none with a chance of (1 - 0.8**5)**28, about 0.000015, as signatures weigh all shingles alike.
BANDS, ROWS = 28, 5
#: Members of a list of rare differences up to which its possible pairs are verified one by one; a longer list is decided by what its members have in common.
FEW = 64
#: Words of 64 bits, a power of two, in which the parities of a difference are kept.
ODD = 4

_BANDS = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingles(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Each text's shingles in order, as 64-bit hashes; a text of fewer words, but not none, is one shingle."""
    lists = [normal_words(t) if t else [] for t in texts]
    flat = b" ".join(w for x in lists for w in x)
    if not flat:
        return [np.zeros(0, np.uint64) for _ in texts]
    data = np.frombuffer(flat, np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]])
    hashed, out, at = RangeHash(data), [], 0
    for x in lists:
        n = len(x)
        k = max(1, n - words + 1) if n else 0
        out.append(hashed.of(starts[at : at + k], ends[at + min(n, words) - 1 : at + n][:k]) if k else np.zeros(0, np.uint64))
        at += n
    return out


def probminhash(elements: np.ndarray, weights: np.ndarray, owners: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n x registers): in each register the element that arrived first, 0 for an owner without elements.

    Every element's arrivals are a Poisson process of its weight's rate, drawn from its own hash, and each arrival
    falls into a random register. An element stops when its next arrival comes after all of its owner's registers
    have one. Two signatures agree in a register with the probability Jaccard of the weighted sets.
    """
    first = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    time, state, rate, owner, element = np.zeros(len(elements)), elements, weights, owners, elements
    step = np.uint64(0x9E3779B97F4A7C15)
    while len(element):
        state = state + step
        r = mix(state)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        slot = owner * registers + (mix(r ^ step) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        winner[slot[won]] = element[won]
        going = time < first.reshape(n, registers).max(1)[owner]
        time, state, rate, owner, element = time[going], state[going], rate[going], owner[going], element[going]
    return winner.reshape(n, registers)


def signatures(texts: list[str | None], words: int, registers: int) -> tuple[list[int], np.ndarray]:
    """Distinct shingles of each text, and signatures under equal weights.

    Links are defined on sets, so signatures agree in a register with the very similarity that is verified. Weights that
    grow with a shingle's count would let a repeated passage that only one text has keep a pair at 0.8 apart.
    """
    parts = [np.unique(x) for x in shingles(texts, words)]
    sizes = [len(p) for p in parts]
    elements = np.concatenate(parts) if sum(sizes) else np.zeros(0, np.uint64)
    return sizes, probminhash(elements, np.ones(len(elements)), np.repeat(np.arange(len(texts)), sizes), len(texts), registers)


def banded(bands: int, rows: int, words: int):
    @F.arrow_udf(_BANDS)
    def band(texts: pa.Array) -> pa.Array:
        sizes, keys = [], []
        for k in range(0, len(texts), 256):
            n, sig = signatures(texts[k : k + 256].to_pylist(), words, bands * rows)
            h = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(n), bands)).copy()
            for r in range(rows):
                h = mix(h * np.uint64(31) + sig.reshape(len(n), bands, rows)[:, :, r])
            sizes += n
            keys += [x if s else [] for s, x in zip(n, h.view(np.int64).tolist())]
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], ["n", "bands"])

    return band


def shingle_sets(words: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        out = []
        for k in range(0, len(texts), 256):
            out += [np.unique(x).view(np.int64) for x in shingles(texts[k : k + 256].to_pylist(), words)]
        return pa.array(out, pa.list_(pa.int64()))

    return sets


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), the root being its component's smallest node; roots have no row.

    Large-star and small-star steps in turn until nothing changes; a node with very many neighbours is
    aggregated before the shuffle and its join is split by Spark. Only a count and a checksum reach the driver.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        now = saved(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct(), "components")
        new = tuple(now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new


def _labelled(docs: DataFrame, doc_id: str, text: str, words: int, similarity: float, bands: int, rows: int, few: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row, and of each text: node, least (doc_id), copies, root (what nodes of one class have in common)."""
    tune(docs.sparkSession)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), _node(text).alias("node"))
    sigs = saved(base.select("doc_id", "node", banded(bands, rows, words)("text").alias("s")).select("doc_id", "node", "s.n", "s.bands"), "signatures")
    nodes = sigs.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "id")
    meeting = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = saved(keyed.join(meeting, "key"), "buckets")

    wanted = nodes.select("node", "id").join(buckets.select("id").distinct(), "id")
    once = base.where("node is not null").select("node", "text").dropDuplicates(["node"])  # copies go before they travel
    sets = saved(once.join(wanted, "node").select("id", shingle_sets(words)("text").alias("set")), "shingles")
    roots = _decided(buckets, sets, similarity, few).withColumnRenamed("node", "id")
    labelled = nodes.select("node", "id", "least", "copies").join(roots, "id", "left").select("node", "least", "copies", F.coalesce("root", "id").alias("root"))
    return sigs.select("doc_id", "node"), saved(labelled, "labelled")


def _node(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, few: int = FEW) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class), n_class (its rows).

    Equal texts are one node. Nodes whose signatures agree in a band meet in a bucket. Each bucket's members are
    verified against its pivot, the member that meets most others, so a bucket of n costs n - 1 pairs; buckets
    whose members are then still in several components are decided exactly by what _between() says. A link is a
    Jaccard similarity of shingle sets of at least `similarity`; classes are connected components.

    A null text is a class of its own rows' doc_id alone; texts without words are linked to equal texts only;
    short texts are one shingle, and very long ones are taken whole; rows with null ids belong to classes like any,
    and only a class of nothing else has a null class_id; repeated rows are copies; an empty table gives none; other
    columns are left out, so that no name clashes.
    """
    of_row, labelled = _labelled(docs, doc_id, text, words, similarity, bands, rows, few)
    classes = labelled.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("n_class"))
    of_node = labelled.select("node", "root").join(classes, "root").select("node", "class_id", "n_class")
    out = of_row.join(of_node, "node", "left")
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of distinct pairs (a, b) whose similarity suffices."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return saved(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b"), "verified")


def _decided(buckets: DataFrame, sets: DataFrame, similarity: float, few: int) -> DataFrame:
    """(node, root) from buckets (key, id, n, members): the components of all links among the members of each bucket."""
    meets = buckets.groupBy("id").agg(F.sum("members").alias("meets"))
    rank = F.col("meets") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    pivots = buckets.join(meets, "id").groupBy("key").agg(F.max_by("id", rank).alias("pivot"))
    starred = saved(buckets.join(pivots, "key"), "starred")
    edges = _verified(starred.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), sets, similarity)
    roots = components(edges)
    # the buckets whose members lie in several components
    placed = starred.where("members > 2").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    apart = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    met = placed.join(apart, "key").select("pivot", "id", "root").distinct()
    more = _between(met, sets, similarity, few)
    return components(edges.union(more)) if more is not None else roots


def _odd(own: str) -> Column:
    """Which of 64 * ODD classes hold an odd number of shingles: two sets differ in as many shingles at least as their classes do."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda i: F.filter(own, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(ODD - 1)) == i)
    return F.array(*[F.aggregate(word(i), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x))) for i in range(ODD)])


def _between(met: DataFrame, sets: DataFrame, similarity: float, few: int) -> DataFrame | None:
    """Links (a, b) that join the components of each group (pivot, id, root): none is lost, and few within a component are given.

    A member is held as its difference to what its group has in common: at first the group's pivot, then that with
    all shingles turned round in which most members differ from it. By the triangle inequality, two of n and m shingles
    whose differences have d and e are linked if d + e <= slack * (n + m); if they are linked otherwise, their
    differences share (d + e - slack * (n + m)) / 2 shingles at least, and d - slack * (n + m). So the members near
    enough to the nearest one, the core, are linked to it at once, and any other must share so many with someone.
    Of its shingles, in the order of their frequency, all but the last so many minus one then suffice to meet every
    partner. Who shares one of these makes a list. Of a list of at most `few`, those pairs are verified that these
    bounds and the parities of their differences allow; a longer list is a new group, whose members all have lost the
    shared shingle from their differences, so that it ends.
    """
    slack = (1 - similarity) / (1 + similarity)
    none = F.array().cast("array<bigint>")
    whole = sets.select(F.col("id").alias("pivot"), F.col("set").alias("whole"))
    differ = F.concat(F.array_except("set", "whole"), F.array_except("whole", "set"))
    groups = met.join(sets, "id").join(whole, "pivot").select(F.col("pivot").alias("g"), "id", "root", F.size("set").alias("n"), differ.alias("own"))
    found: list[DataFrame] = []
    while True:
        groups = saved(groups, "groups")
        if groups.isEmpty():
            break
        # what is told of a group is written, a row a group, so that a join with it is sent whole while it is small and else split at a hot group
        size = saved(groups.groupBy("g").agg(F.count("*").alias("m")), "sizes")
        most = groups.select("g", F.explode("own").alias("x")).groupBy("g", "x").agg(F.count("*").alias("k")).join(size, "g").where("2 * k > m").groupBy("g").agg(F.collect_list("x").alias("turned"))  # less than twice as many shingles as a member has
        most = saved(most, "turned")
        turned = groups.join(most, "g", "left").withColumn("turned", F.coalesce("turned", none))
        near = turned.withColumn("own", F.concat(F.array_except("own", "turned"), F.array_except("turned", "own"))).drop("turned")
        near = saved(near.withColumn("d", F.size("own")).withColumn("spare", slack * F.col("n") - F.col("d")).withColumn("odd", _odd("own")), "near")
        nearest = near.groupBy("g").agg(F.max_by("id", "spare").alias("star"), F.max("spare").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("n").alias("widest"))
        nearest = saved(nearest, "nearest")
        placed = near.join(nearest.where("lo <> hi"), "g").withColumn("core", F.col("spare") + F.col("most") >= -1e-6)
        found.append(placed.where("core and id <> star").select(F.col("star").alias("a"), F.col("id").alias("b")))
        # a core member's partner is no core member, and any other's at most the nearest
        outer = saved(placed.where("not core").groupBy("g").agg(F.max("spare").alias("outer")), "outer")
        placed = placed.join(outer, "g").withColumn("most", F.when(F.col("core"), F.col("outer")).otherwise(F.col("most")))
        # shingles that must be shared with someone, and who can
        widest = F.least(F.col("n") / similarity, F.col("widest"))
        must = F.ceil(F.greatest(F.lit(1.0), -(F.col("spare") + F.col("most")) / 2, F.col("d") - slack * (F.col("n") + widest)) - 1e-6).alias("must")
        able = placed.select("g", "id", "root", "n", "d", "spare", "odd", "core", must).where("d >= must")
        each = saved(able.join(near.select("g", "id", "own"), ["g", "id"]).select(*able.columns, F.explode("own").alias("x")), "shared")
        k = each.groupBy("g", "x").agg(F.count("*").alias("k"), F.min("core").alias("all_core"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("not all_core and lo <> hi").select("g", "x", "k")
        ranked = each.join(k, ["g", "x"]).groupBy(*able.columns).agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("xs"))
        first = F.slice("xs", 1, F.greatest(F.lit(0), F.size("xs") - F.col("must") + 1).cast("int"))
        lists = saved(ranked.select("g", "id", "root", "n", "d", "spare", "odd", "core", F.explode(first).alias("x")).withColumn("x", F.col("x.x")), "lists")
        # one of lists with the same members
        of_list = lists.groupBy("g", "x").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("id")).alias("mark"), F.min("core").alias("all_core"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("not all_core and lo <> hi")
        kept = saved(of_list.groupBy("g", "members", "mark").agg(F.min("x").alias("x")).select("g", "x", "members"), "kept")
        short = lists.join(kept.where(F.col("members") <= few), ["g", "x"])
        other = short.select("g", "x", *[F.col(c).alias(f"o_{c}") for c in ("id", "root", "n", "d", "spare", "odd", "core")])
        new = (F.col("root") != F.col("o_root")) & (F.col("id") < F.col("o_id")) & ~(F.col("core") & F.col("o_core"))
        unlike = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("o_odd")[i])) for i in range(1, ODD)), F.bit_count(F.col("odd")[0].bitwiseXOR(F.col("o_odd")[0])))
        possible = new & (F.least("d", "o_d") >= -(F.col("spare") + F.col("o_spare")) / 2 - 1e-6) & (unlike <= slack * (F.col("n") + F.col("o_n")) + 1e-6)
        found.append(_verified(short.join(other, ["g", "x"]).where(possible).select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct(), sets, similarity))
        long = lists.join(kept.where(F.col("members") > few), ["g", "x"]).select("g", "x", "id", "root")
        groups = long.join(near.select("g", "id", "n", "own"), ["g", "id"]).select(F.xxhash64("g", "x").alias("g"), "id", "root", "n", "own")
    return reduce(DataFrame.union, found) if found else None


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, few: int = FEW) -> DataFrame:
    """docs without all but one row of each class: that of the least doc_id, and of several texts with that id the one of least digest.

    Of rows with equal id and text any one stays. Rows of null text all stay, repeated ones too, as no class has
    another row of them. A null id counts as the largest. An empty table gives an empty one; all columns of docs
    stay, whatever their names.
    """
    _, labelled = _labelled(docs, doc_id, text, words, similarity, bands, rows, few)
    first = labelled.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("first")).select("first.*")
    (mark,) = fresh(docs, "mark")
    marked = lambda node, key: F.unhex(F.md5(F.concat(node, F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("")).cast("binary"))))
    keep = first.select(marked(F.col("node"), F.col("least")).alias(mark))
    rows_ = docs.where(F.col(text).isNotNull()).withColumn(mark, marked(_node(text), F.col(doc_id)))
    return docs.where(F.col(text).isNull()).unionByName(rows_.join(keep, mark, "left_semi").dropDuplicates([mark]).drop(mark))
