"""Records of people and organisations linked across the spellings of their names.

A name is a vector of character n-grams, weighted by rarity: that of its given name crossed with that of its family name,
so that the cosine of two names is the product of the cosines of their parts. What other names a given name goes by (short
forms, spellings) is counted over all records that give several, and added to its vector. Names of one scope whose
cosine reaches a threshold meet in a sparse join, and are grouped by average linkage.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.people import Firm, Person, parse
from loomtext.session import checkpointed, spread

#: The cosine that both parts of two names must reach, that of the whole names, and the mean cosine of a merge of two clusters.
PART, EDGE, MERGE = 0.3, 0.2, 0.31
#: The mean likeness of a record with part of a name to its cluster, and what it must be ahead of the next cluster.
ATTACH, AHEAD = 0.25, 0.08
#: What a likeness counts for if one side has only an initial, only one word, or no generation where the other has one.
INITIAL, ONE_WORD, UNTOLD = 0.7, 0.55, 0.8
#: How sure it is that one given name goes by another: the least number of records that give both, and the least share of those of the first that give several.
LEAST_RECORDS, LEAST_SHARE = 3, 0.05
#: Records of a cluster that one task pairs.
SALTED = 1_000
#: Edges that one task links; components of more are linked in rounds over all tasks.
LARGEST = 20_000


def profile(display: str | None, aliases: list[str] | None, gender: str | None) -> dict | None:
    """What a record's names say: ``kind``, ``gen``, ``sex``, ``whole``, ``names`` (given and family), and the ``given`` names and lone ``words`` in it; None without a name."""
    people: set[Person] = set()
    firms: set[Firm] = set()
    told = {"male": "m", "female": "f"}.get((gender or "").strip().lower(), "")
    hint = ""
    for raw in [display, *(aliases or [])]:
        name, g = parse(raw)
        hint = hint or g
        if isinstance(name, Person):
            people.add(name)
        elif isinstance(name, Firm):
            firms.add(name)
    if firms:
        own = sorted({" ".join(f.own) for f in firms})
        return {"kind": "firm", "gen": "", "sex": "", "whole": True, "names": [("", o) for o in own], "given": [], "words": []}
    if not people:
        return None
    generation = next((p.generation for p in sorted(people, key=lambda p: p.generation, reverse=True) if p.generation), "")
    whole = {(p.given, p.family) for p in people if len(p.given) > 1}
    kept = whole or {(p.given, p.family) for p in people if p.given} or {(p.given, p.family) for p in people}
    return {
        "kind": "person", "gen": generation, "sex": told or hint, "whole": bool(whole), "names": sorted(kept),
        "given": sorted({g for g, _ in whole}), "words": sorted({p.family for p in people if not p.given}),
    }


def average_linkage(edges: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """Clusters by average linkage, where pairs without an edge count as 0: each node's cluster, named by its least node."""
    size = {n: 1 for e in edges for n in e[:2]}
    total: dict[str, dict[str, float]] = defaultdict(dict)
    for a, b, w in edges:
        total[a][b] = total[b][a] = max(w, total[a].get(b, 0.0))
    member = {n: [n] for n in size}
    heap = [(-w, min(a, b), max(a, b), 1, 1) for a in total for b, w in total[a].items() if a < b and w >= least]
    heapq.heapify(heap)
    while heap:
        _, a, b, m, n = heapq.heappop(heap)
        if size.get(a) != m or size.get(b) != n or b not in total[a]:
            continue
        for c, w in total.pop(b).items():
            total[c].pop(b, None)
            if c != a:
                total[a][c] = total[c][a] = total[a].get(c, 0.0) + w
        size[a] += size.pop(b)
        member[a] += member.pop(b)
        for c, w in total[a].items():
            mean = w / (size[a] * size[c])
            if mean >= least:
                p, q = min(a, c), max(a, c)
                heapq.heappush(heap, (-mean, p, q, size[p], size[q]))
    return {n: min(group) for group in member.values() for n in group}


def linked_in_rounds(edges: DataFrame, least: float, rounds: int = 200) -> DataFrame:
    """``node`` and ``cluster`` by the same average linkage for components of any size.

    In each round all pairs of clusters merge that are each other's nearest; as a merged cluster is never nearer to a third
    than the nearer of its parts was, the order of these merges makes no difference. One row for each pair of clusters is kept.
    """
    pairs = checkpointed(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").alias("total")).groupBy("a", "b").agg(F.max("total").alias("total"))
    )
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    of = checkpointed(ends.select("node", F.col("node").alias("cluster"), F.lit(1).cast("bigint").alias("n")))
    for _ in range(rounds):
        sizes = of.groupBy("cluster").agg(F.sum("n").alias("n"))
        near = (
            pairs.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
            .withColumn("mean", F.col("total") / (F.col("na") * F.col("nb")))
            .where(F.col("mean") >= least)
        )
        rank = F.struct(-F.col("mean"), "a", "b")
        both = near.select(F.col("a").alias("c"), "a", "b", rank.alias("rank")).unionByName(near.select(F.col("b").alias("c"), "a", "b", rank.alias("rank")))
        nearest = both.groupBy("c").agg(F.min_by(F.struct("a", "b"), "rank").alias("p"))
        merges = checkpointed(nearest.groupBy("p").agg(F.count("*").alias("k")).where("k = 2").select(F.col("p.b").alias("was"), F.col("p.a").alias("now")))
        if merges.isEmpty():
            return of.select("node", "cluster")
        of = checkpointed(of.join(merges, of.cluster == merges.was, "left").select("node", F.coalesce("now", "cluster").alias("cluster"), "n"))
        left, right = merges.toDF("a", "a_now"), merges.toDF("b", "b_now")
        moved = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a_now", "a").alias("x"), F.coalesce("b_now", "b").alias("y"), "total")
        pairs = checkpointed(
            moved.where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("total").alias("total"))
        )
    raise RuntimeError("linkage did not settle")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (its least node) for edges ``a``, ``b``: least labels passed along edges, then to the label's own label."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(rounds):
        heard = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("m")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("m").alias("m"))
        )
        stepped = labels.join(heard, "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jumped = stepped.join(labels.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select(
            "node", "old", F.least("component", "further").alias("component")
        )
        jumped = checkpointed(jumped)
        labels = jumped.drop("old")
        if jumped.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def clustered(edges: DataFrame, least: float = MERGE, largest: int = LARGEST) -> DataFrame:
    """``node`` and ``cluster`` by average linkage of the edges ``a``, ``b``, ``score``, which are counted first and best come from a checkpoint.

    Components of up to ``largest`` edges are linked each in one task, larger ones in rounds; both give the same.
    """

    def link(group: pd.DataFrame) -> pd.DataFrame:
        found = average_linkage(list(zip(group["a"], group["b"], group["score"])), least)
        return pd.DataFrame({"node": list(found), "cluster": list(found.values())}, columns=["node", "cluster"])

    if edges.count() <= largest:
        # So few that one task holds them all, whatever their components.
        return edges.select("a", "b", "score").groupBy(F.lit(0).alias("task")).applyInPandas(link, "node string, cluster string")
    placed = checkpointed(edges.join(components(edges).withColumnRenamed("node", "a"), "a"))
    count = placed.groupBy("component").agg(F.count("*").alias("n"))
    large = checkpointed(count.where(F.col("n") > largest).select("component"))
    # A task takes many small components at once.
    tasks = F.lit(1 + placed.count() // largest)
    own = placed if large.isEmpty() else placed.join(large, "component", "left_anti")
    small = own.groupBy(F.pmod(F.xxhash64("component"), tasks).alias("task")).applyInPandas(link, "node string, cluster string")
    return small if large.isEmpty() else small.unionByName(linked_in_rounds(placed.join(large, "component", "left_semi"), least))


def _cosines(batch: pa.RecordBatch) -> np.ndarray:
    """The cosine of each pair of unit vectors, given as lists of n-grams (``ga``, ``gb``: digests) and of weights (``wa``, ``wb``)."""
    columns = {n: batch.column(n) for n in ("ga", "gb", "wa", "wb")}
    row = {n: np.repeat(np.arange(batch.num_rows), np.diff(columns[n].offsets.to_numpy())) for n in ("ga", "gb")}
    flat = {n: c.flatten().to_numpy(zero_copy_only=False) for n, c in columns.items()}
    codes = np.unique(np.concatenate((flat["ga"], flat["gb"])), return_inverse=True)[1]
    width = int(codes.max(initial=0)) + 1
    keys = row["ga"] * width + codes[: len(flat["ga"])], row["gb"] * width + codes[len(flat["ga"]) :]
    shared, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    return np.bincount(shared // width, weights=flat["wa"][i] * flat["wb"][j], minlength=batch.num_rows)


def _grams(word: Column) -> Column:
    """Character two- and three-grams of each word of a name with its ends marked."""

    def of(w: Column) -> Column:
        marked = F.concat(F.lit("^"), w, F.lit("$"))
        return F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, n))))

    return F.array_distinct(F.flatten(F.transform(F.split(word, " "), of)))


class Vocabulary:
    """The vectors of all parts of names, and the joins of those of one scope that are near each other.

    ``words``: ``field`` (``g`` given, ``f`` family, ``o`` organisation) and ``word``; ``goes_by``: ``word``, ``other``, ``share``.
    """

    def __init__(self, words: DataFrame, goes_by: DataFrame, least: float):
        self.least = least
        grams = words.select("field", "word", F.explode(_grams(F.col("word"))).alias("gram")).withColumn("gram", F.xxhash64("gram"))
        frequency = grams.groupBy("field", "gram").agg(F.count("*").alias("df"))
        total = words.groupBy("field").agg(F.count("*").alias("n"))
        weighed = grams.join(frequency, ["field", "gram"]).join(F.broadcast(total), "field")
        weighed = weighed.select("field", "word", "gram", "df", F.log(1 + F.col("n") / F.col("df")).alias("w"))
        by_word = Window.partitionBy("field", "word")

        def unit(rows: DataFrame) -> DataFrame:
            return rows.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(by_word)))

        plain = checkpointed(unit(weighed))
        # A given name's own n-grams, and by their share those of what it goes by.
        lent = (
            goes_by.join(plain.where("field = 'g'").withColumnRenamed("word", "other"), "other")
            .select("field", "word", "gram", "df", (F.col("w") * F.col("share")).alias("w"))
        )
        summed = plain.unionByName(lent).groupBy("field", "word", "gram").agg(F.first("df").alias("df"), F.sum("w").alias("w"))
        # From the rarest n-gram on, as many as it takes until the rest alone can no longer reach the cosine.
        ordered = by_word.orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, -1)
        self.rows = checkpointed(unit(summed).withColumn("before", F.coalesce(F.sum(F.col("w") * F.col("w")).over(ordered), F.lit(0.0))))
        self.prefix = self.rows.where(1 - F.col("before") >= least * least - 1e-9).select("field", "word", "gram")
        self.vectors = self.rows.groupBy("field", "word").agg(F.collect_list("gram").alias("g"), F.collect_list("w").alias("w"))

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs ``field``, ``a``, ``b`` those whose cosine reaches the least one, with it as ``cos``."""
        left = self.vectors.select("field", F.col("word").alias("a"), F.col("g").alias("ga"), F.col("w").alias("wa"))
        right = self.vectors.select("field", F.col("word").alias("b"), F.col("g").alias("gb"), F.col("w").alias("wb"))
        least = self.least

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _cosines(batch)
                at = pa.array(np.flatnonzero(found >= least - 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(n).take(at) for n in ("field", "a", "b")] + [pa.array(found).take(at)], names=["field", "a", "b", "cos"])

        both = pairs.join(left, ["field", "a"]).join(right, ["field", "b"]).select("field", "a", "b", "ga", "wa", "gb", "wb")
        return both.mapInArrow(compare, "field string, a string, b string, cos double")

    def met(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        """``s``, ``field``, ``a``, ``b``, ``cos`` of all pairs of words of one scope and field (columns ``s``, ``field``, ``word``) that are near.

        Each pair of one list once, a word with itself too; with ``right``, those of a word on the left with one on the right.
        """
        own = left.join(self.prefix, ["field", "word"]).withColumnRenamed("word", "a")
        other = (left if right is None else right).join(self.prefix, ["field", "word"]).withColumnRenamed("word", "b")
        meet = own.join(other, ["s", "field", "gram"]).where("a < b" if right is None else "a <> b").select("s", "field", "a", "b").distinct()
        meet = checkpointed(meet)
        unequal = meet.join(self.near(meet.select("field", "a", "b").distinct()), ["field", "a", "b"]).select("s", "field", "a", "b", "cos")
        same = left if right is None else left.join(right, ["s", "field", "word"], "left_semi")
        return unequal.unionByName(same.select("s", "field", F.col("word").alias("a"), F.col("word").alias("b"), F.lit(1.0).alias("cos")))


def goes_by(said: DataFrame, least_records: int = LEAST_RECORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """``word``, ``other``, ``share``: of the records that give ``word`` beside another name, the share that gives ``other`` as the given name of a whole one."""
    # Records of one name tell nothing.
    several = said.where("kind = 'person'").select("given", F.array_distinct(F.concat("given", "words")).alias("all")).where(F.size("all") > 1)
    both = several.select(F.explode("all").alias("word"), "given").select("word", F.explode("given").alias("other"))
    counts = both.where("word <> other").groupBy("word", "other").agg(F.count("*").alias("n")).where(F.col("n") >= least_records)
    heard = several.select(F.explode("all").alias("word")).groupBy("word").agg(F.count("*").alias("of"))
    shares = counts.join(heard, "word").select("word", "other", (F.col("n") / F.col("of")).alias("share"))
    return shares.where((F.col("share") >= least_share) & (F.length("other") > 1))


def _agree(one: str, other: str) -> Column:
    """Whether nothing known of two sides says that they differ in generation or sex."""
    return F.expr(" AND ".join(f"({one}.{c} = '' OR {other}.{c} = '' OR {one}.{c} = {other}.{c})" for c in ("gen", "sex")))


def _told(one: str, other: str) -> Column:
    return F.when(F.expr(f"({one}.gen = '') <> ({other}.gen = '')"), UNTOLD).otherwise(1.0)


def linked_records(
    records: DataFrame,
    scope: str = "book_id",
    key: str = "rec_id",
    name: str = "display_name",
    aliases: str = "aliases",
    gender: str | None = "gender",
    top_n: int | None = None,
    least_records: int = LEAST_RECORDS,
    largest: int = LARGEST,
) -> DataFrame:
    """``scope``, ``key`` and ``cluster`` of every record with a name: records of one scope and cluster stand for the same person or organisation.

    Names are cleaned of titles, pronouns, roles and families. The distinct whole names of a scope (given and family name with
    generation and sex as far as known, or the name of an organisation) are the nodes. Those whose cosine reaches ``EDGE``, and
    both of whose parts reach ``PART``, have an edge; with ``top_n`` only the nearest ``top_n`` of each node (default: all, so that
    no link is lost). Names in one record have an edge of 1. Nodes are grouped by average linkage; a record goes with most of its names. A record with only
    part of a name joins the one cluster that it fits; if it fits several alike, none. A record without scope, key or name stands
    alone and is not in the result. Repeated rows count once; an empty table gives an empty result; other columns are not read.
    """
    scope_type, key_type = records.schema[scope].dataType.simpleString(), records.schema[key].dataType.simpleString()
    told = F.col(gender).cast("string") if gender else F.lit(None).cast("string")
    pair = pa.struct([("g", pa.string()), ("f", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(*row) for row in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
            kept = [f for f in found if f]
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    *[pa.array([k[c] for k in kept], pa.string()) for c in ("kind", "gen", "sex")],
                    pa.array([k["whole"] for k in kept], pa.bool_()),
                    pa.array([[{"g": g, "f": f} for g, f in k["names"]] for k in kept], pa.list_(pair)),
                    *[pa.array([k[c] for k in kept], strings) for c in ("given", "words")],
                ],
                names=["s", "r", "kind", "gen", "sex", "whole", "names", "given", "words"],
            )

    source = records.select(F.col(scope).alias("s"), F.col(key).alias("r"), F.col(name).cast("string").alias("d"), F.col(aliases).alias("al"), told.alias("ge"))
    said = checkpointed(
        spread(source.where("s IS NOT NULL AND r IS NOT NULL"))
        .mapInArrow(
            read,
            f"s {scope_type}, r {key_type}, kind string, gen string, sex string, whole boolean, names array<struct<g: string, f: string>>, given array<string>, words array<string>",
        )
        .distinct()
    )

    def node(*columns: str) -> Column:
        return F.md5(F.concat_ws("\x1f", F.col("s").cast("string"), *columns))

    listed = said.select("s", "r", "kind", "gen", "sex", "whole", F.explode("names").alias("n")).select("s", "r", "kind", "gen", "sex", "whole", "n.g", "n.f")
    named = checkpointed(listed.withColumn("node", node("kind", "gen", "sex", "g", "f")))
    nodes = named.where("whole").select("s", "node", "kind", "gen", "sex", "g", "f").distinct()
    parts = named.where("NOT whole").select("s", "gen", "sex", "g", "f", "node").distinct()
    known = checkpointed(goes_by(said, least_records))

    field = F.when(F.col("kind") == "firm", "o").otherwise("f")
    families = nodes.select("s", field.alias("field"), F.col("f").alias("word")).unionByName(parts.select("s", F.lit("f").alias("field"), F.col("f").alias("word"))).distinct()
    given = nodes.where("kind = 'person'").select("s", F.lit("g").alias("field"), F.col("g").alias("word")).distinct()
    lone = parts.where("g = ''").select("s", F.lit("g").alias("field"), F.col("f").alias("word")).distinct()
    words = (
        families.select("field", "word")
        .unionByName(given.select("field", "word"))
        .unionByName(lone.select("field", "word"))
        .unionByName(known.select(F.lit("g").alias("field"), F.col("other").alias("word")))
        .unionByName(known.select(F.lit("g").alias("field"), F.col("word")))
        .distinct()
    )
    vocabulary = Vocabulary(words, known, PART)
    kin = checkpointed(vocabulary.met(families))
    edges = checkpointed(_edges(nodes, kin, vocabulary).unionByName(_shared(named)).groupBy("a", "b").agg(F.max("score").alias("score")))
    if top_n is not None:
        edges = checkpointed(_nearest(edges, top_n))
    linked = clustered(edges, MERGE, largest)
    of_node = checkpointed(nodes.select("s", "node").join(linked, "node", "left").select("s", "node", F.coalesce("cluster", "node").alias("cluster")))
    votes = named.where("whole").join(of_node.drop("s"), "node").groupBy("s", "r", "cluster").agg(F.count("*").alias("n"))
    # Most names, then the least cluster.
    whole = checkpointed(votes.groupBy("s", "r").agg(F.min_by("cluster", F.struct(-F.col("n"), "cluster")).alias("cluster")))
    attached = _attached(said, nodes, parts, of_node, whole, kin, given, lone, known, vocabulary, largest)
    records_of = named.where("NOT whole").select("s", "r", "node").join(attached, "node", "left")
    partial = records_of.groupBy("s", "r").agg(F.min_by(F.coalesce("cluster", "node"), F.struct(F.col("cluster").isNull(), "node")).alias("cluster"))
    return whole.unionByName(partial).select(F.col("s").alias(scope), F.col("r").alias(key), "cluster")


def _edges(nodes: DataFrame, kin: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``a``, ``b``, ``score`` of the whole names of a scope that are near: organisations by their names, people by both parts."""
    firms = nodes.where("kind = 'firm'").select("s", F.col("f").alias("word"), "node")
    one, other = firms.toDF("s", "a", "na"), firms.toDF("s", "b", "nb")
    of_firms = kin.where("field = 'o' AND a <> b AND cos >= 0.5").join(one, ["s", "a"]).join(other, ["s", "b"])
    of_firms = of_firms.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.col("cos").alias("score"))
    # Two people meet only if a rare n-gram of the given names and near family names bring them together.
    people = nodes.where("kind = 'person'")
    told = people.join(vocabulary.prefix.where("field = 'g'").select(F.col("word").alias("g"), "gram"), "g")
    told = told.select("s", "f", "gram", F.struct("node", "g", "gen", "sex").alias("p"))
    left, right = told.toDF("s", "a", "gram", "x"), told.toDF("s", "b", "gram", "y")
    near = kin.where("field = 'f'").select("s", "a", "b", F.col("cos").alias("family"))
    met = (
        near.join(left, ["s", "a"])
        .join(right, ["s", "b", "gram"])
        .where(_agree("x", "y") & ((F.col("a") != F.col("b")) | (F.col("x.node") < F.col("y.node"))))
        .select("x", "y", "family")
        .distinct()
    )
    met = checkpointed(met.select("x", "y", "family", F.lit("g").alias("field"), F.least("x.g", "y.g").alias("a"), F.greatest("x.g", "y.g").alias("b")))
    alike = vocabulary.near(met.where("a <> b").select("field", "a", "b").distinct())
    scored = met.join(alike, ["field", "a", "b"], "left").withColumn("cos", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("cos")))
    scored = scored.withColumn("score", F.col("family") * F.col("cos") * _told("x", "y")).where(F.col("score") >= EDGE)
    return of_firms.unionByName(scored.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), "score"))


def _shared(named: DataFrame) -> DataFrame:
    """An edge of 1 between each whole name of a record and the next: a record of many names adds no more edges than names."""
    lists = named.where("whole").groupBy("s", "r").agg(F.array_sort(F.collect_set("node")).alias("l")).where(F.size("l") > 1)
    steps = F.transform(F.sequence(F.lit(0), F.size("l") - 2), lambda i: F.struct(F.get("l", i).alias("a"), F.get("l", i + 1).alias("b")))
    return lists.select(F.inline(steps)).distinct().select("a", "b", F.lit(1.0).alias("score"))


def _nearest(edges: DataFrame, n: int) -> DataFrame:
    """The edges that are among the ``n`` nearest of one of their ends."""
    both = edges.select(F.col("a").alias("c"), "a", "b", "score").unionByName(edges.select(F.col("b").alias("c"), "a", "b", "score"))
    rank = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "a", "b"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n).select("a", "b", "score").distinct()


def _attached(
    said: DataFrame, nodes: DataFrame, parts: DataFrame, of_node: DataFrame, whole: DataFrame, kin: DataFrame,
    given: DataFrame, lone: DataFrame, known: DataFrame, vocabulary: Vocabulary, largest: int,
) -> DataFrame:
    """``node``, ``cluster`` of the parts of names that fit one cluster, or each other."""
    p = parts.select("s", "g", "f", F.struct("node", "gen", "sex").alias("p"))
    families = kin.where("field = 'f'").select("s", "a", "b", "cos")
    turned = families.unionByName(families.where("a <> b").select("s", F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    people = nodes.where("kind = 'person'").select("s", "g", "f", F.struct("node", "gen", "sex").alias("w"))
    # A whole name may be written with the initial of its given name or of what that goes by.
    initials = people.select("s", "f", "w", F.substring("g", 1, 1).alias("i"), F.lit(1.0).alias("sure")).unionByName(
        people.join(known.select(F.col("word").alias("g"), F.substring("other", 1, 1).alias("i")).distinct(), "g").select("s", "f", "w", "i", F.lit(0.8).alias("sure"))
    )
    by_initial = (
        p.where("g <> ''").withColumnRenamed("f", "a").join(turned, ["s", "a"])
        .join(initials.withColumnsRenamed({"f": "b", "i": "g"}), ["s", "b", "g"])
        .select("p", "w", (INITIAL * F.col("cos") * F.col("sure")).alias("score"))
    )
    single = p.where("g = ''").withColumnRenamed("f", "a")
    by_family = single.join(turned, ["s", "a"]).join(people.select("s", F.col("f").alias("b"), "w"), ["s", "b"]).select("p", "w", (ONE_WORD * F.col("cos")).alias("score"))
    calls = vocabulary.met(lone, given).select("s", "a", "b", "cos")
    by_given = single.join(calls, ["s", "a"]).join(people.select("s", F.col("g").alias("b"), "w"), ["s", "b"]).select("p", "w", (ONE_WORD * F.col("cos")).alias("score"))
    fitted = by_initial.unionByName(by_family).unionByName(by_given).where(_agree("p", "w")).withColumn("score", F.col("score") * _told("p", "w"))
    fitted = fitted.where(F.col("score") >= ATTACH).groupBy(F.col("p.node").alias("part"), F.col("w.node").alias("node")).agg(F.max("score").alias("score"))
    sizes = of_node.groupBy("cluster").agg(F.count("*").alias("size"))
    mean = (
        fitted.join(of_node.drop("s"), "node")
        .groupBy("part", "cluster").agg(F.sum("score").alias("score"))
        .join(sizes, "cluster")
        .select("part", "cluster", (F.col("score") / F.col("size")).alias("score"))
    )
    # A lone word that a record of the scope gives beside whole names.
    beside = said.where("whole AND kind = 'person'").select("s", "r", F.explode("words").alias("f")).join(whole, ["s", "r"]).select("s", "f", "cluster").distinct()
    heard = parts.where("g = ''").join(beside, ["s", "f"]).select(F.col("node").alias("part"), "cluster", F.lit(ONE_WORD).alias("score"))
    fits = mean.where(F.col("score") >= ATTACH).unionByName(heard).groupBy("part", "cluster").agg(F.max("score").alias("score"))
    by_part = Window.partitionBy("part").orderBy(F.desc("score"), "cluster")
    best = checkpointed(
        fits.withColumn("next", F.lead("score").over(by_part)).withColumn("rank", F.row_number().over(by_part)).where("rank = 1").select("part", "cluster", "score", "next")
    )
    clear = best.where(F.coalesce(F.col("score") - F.col("next") >= AHEAD, F.lit(True))).select(F.col("part").alias("node"), "cluster")
    # Parts that fit no whole name are held against each other; the others stay where they are.
    free = parts.join(best.select(F.col("part").alias("node")), "node", "left_anti").select("s", "f", "g", F.struct("node", "gen", "sex").alias("p"))
    x, y = free.toDF("s", "a", "gx", "x"), free.toDF("s", "b", "gy", "y")
    alike = (
        turned.join(x, ["s", "a"]).join(y, ["s", "b"])
        .where((F.col("x.node") < F.col("y.node")) & (F.col("gx") == F.col("gy")) & _agree("x", "y"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), (F.col("cos") * F.when(F.col("gx") == "", 1.0).otherwise(INITIAL) * _told("x", "y")).alias("score"))
        .where("score >= 0.5")
        .distinct()
    )
    return clear.unionByName(clustered(checkpointed(alike), 0.5, largest).select("node", "cluster"))


def record_pairs(linked: DataFrame, scope: str = "book_id", key: str = "rec_id", salted: int = SALTED) -> DataFrame:
    """The pairs ``rec_a`` < ``rec_b`` of each cluster; the records of a large one are spread over buckets of about ``salted`` on one side."""
    sizes = linked.groupBy(scope, "cluster").agg(F.count("*").alias("n")).where("n > 1")
    members = linked.join(sizes.select(scope, "cluster", F.ceil(F.col("n") / salted).cast("int").alias("salts")), [scope, "cluster"])
    a = members.select(scope, "cluster", F.pmod(F.xxhash64(key), F.col("salts")).cast("int").alias("salt"), F.col(key).alias("rec_a"))
    b = members.select(scope, "cluster", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col(key).alias("rec_b"))
    return a.join(b, [scope, "cluster", "salt"]).where("rec_a < rec_b").select("rec_a", "rec_b").distinct()
