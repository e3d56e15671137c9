"""MinHash near-duplicates: bottom-k sketches, inverted lists, union-sketch filter, exact Jaccard.

1. One pass over the texts hashes every distinct shingle with one hash function. A document keeps its
   set's size, a 128-bit signature of the whole set and its sketch, the ``K`` smallest hashes.
2. Documents with one size and signature are a class, which goes by its smallest doc_id; copies are never paired.
3. The retained values are inverted. Two sets with Jaccard 0.75 share ``NEED`` of ``K`` retained values
   but for a chance under 1e-7 (binomial tail at K = 64), small sets more than that for sure. So of each
   sketch, in order of how many sketches hold a value, only the ``K - NEED + 1`` rarest values are
   inverted: sets that share NEED values share one of these. Values that very many documents hold, such
   as those of a passage on all pages, come last and make lists only for documents made of little else.
4. Each list links its members to its centre only. The union-sketch estimate drops pairs, exact
   Jaccard on full sets confirms the rest, and components are formed.
5. Members of a list that are still in different components are met: those outside the list's largest
   component with the others, if their sizes allow a link. Members of long lists do this by the rarest
   shingles of their full sets instead of the list. Neither a passage on many pages nor a large group of near copies with the text
   that they are copies of makes all its pairs; a group without that text does, as most of its pairs are near the limit.

So a link between sets of K shingles and more is missed with the chance that steps 3 and 4 name, and no other is. With ``exact``
none is: step 5 then meets the full sets of all classes, whatever lists they share, and no estimate drops a pair of it.

Defined cases: null, empty or blank texts have no shingles and are alone, as are rows with a null
doc_id (their component is null and they are kept); rows that share a doc_id and a text are one
member; a doc_id with several texts is one document that links what each of them links, and each row has its own text's
n_shingles; ties are settled by the smallest doc_id; a very long text is hashed in pieces, its set in memory; an empty
table gives an empty result; other columns are not read by ``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._joins import SALTS, columns, fresh, quoted, with_counts
from ._scratch import Scratch
from ._words import U, mix, shingle_sets, slices
from .components import components

SHINGLE = 5
PERCENT = 75
K = 64
NEED = 27
BATCH_BYTES = 1 << 20
#: Up to so many rows (at most 60 bytes each, 30 MB) are broadcast to pick texts and to name classes; beyond it those joins shuffle.
BROADCAST_ROWS = 500_000
#: Members of longer lists that still mix components meet by their full sets' rarest shingles instead.
LONG_LIST = 32
#: Width of a bucket of set sizes, as a factor.
SIZE_STEP = 1.05
#: What rows of one class agree in: size and signature of the set.
CLASS = ["n", "sig1", "sig2"]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _signatures(sets):
    one = [int(mix(s + U(0x1234567)).sum()) if len(s) else 0 for s in sets]
    two = [int(np.bitwise_xor.reduce(mix(s ^ U(0xABCDEF012345)))) if len(s) else 0 for s in sets]
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(np.array(one, U))), pa.array(_signed(np.array(two, U)))]


def _lists(sets):
    ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    values = _signed(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _sketch_batches(batches):
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            sets = list(shingle_sets(batch.column(1), SHINGLE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *_signatures(sets), _lists([s[:K] for s in sets])], names=["doc_id", *CLASS, "sketch"])


def _set_batches(batches):
    for whole in batches:
        for batch in slices(whole, "text", BATCH_BYTES):
            sets = list(shingle_sets(batch.column(1), SHINGLE))
            yield pa.RecordBatch.from_arrays([*_signatures(sets), _lists(sets)], names=[*CLASS, "set"])


def need(n):
    """How many retained values a set of ``n`` shares with any set it is linked to, at least.

    Linked sets differ by at most a quarter of the larger one, which has at most 4/3 of ``n``; so of K
    retained values at most n / 3 aren't shared, whatever the hashes. For large sets NEED holds instead.
    """
    sure = F.lit(K) - F.floor(n / 3)
    return F.when(n < K, F.least(F.ceil(n * PERCENT / 100), sure)).otherwise(F.greatest(F.lit(NEED), sure)).cast("int")


def similar_sizes(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def size_bucket(n):
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP))).cast("int")


class _Join:
    def __init__(self, docs: DataFrame, exact: bool = False):
        self.scratch = Scratch(docs.sparkSession, "near")
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.exact = exact

    def sketches(self) -> None:
        """The rows' classes. A class goes by its smallest doc_id; where a doc_id is the smallest of several classes (of its
        several texts), all but one of them get numbers below all doc_ids."""
        rows = self.docs.mapInArrow(_sketch_batches, "doc_id long, n long, sig1 long, sig2 long, sketch array<long>")
        rows = self.scratch.put("sketched", rows)
        self.members = self.scratch.put("members", rows.drop("sketch"))
        named = rows.filter("n > 0 and doc_id is not null")
        classes = named.groupBy(*CLASS).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.any_value("sketch").alias("sketch"))
        classes = self.scratch.put("found", classes)
        twice = classes.groupBy("least").agg(F.min("sig1").alias("low"), F.count("*").alias("k")).filter("k > 1")
        twice = self.scratch.put("twice", twice.select(F.col("least").alias("of"), "low"))
        below = F.lit(min(0, classes.agg(F.min("least")).first()[0] or 0) - 1) - F.monotonically_increasing_id()
        classes = classes.join(twice, F.col("least") == F.col("of"), "left")
        rep = F.when(F.col("sig1") > F.col("low"), below).otherwise(F.col("least"))
        self.classes = self.scratch.put("classes", classes.withColumn("rep", rep).drop("of", "low"))
        self.scratch.drop("sketched", "found", "twice")

    def several(self) -> DataFrame:
        """Links (a, b) between the classes of one doc_id's different texts."""
        named = self.members.filter("n > 0 and doc_id is not null")
        two = named.groupBy("doc_id").agg(F.min("sig1").alias("low"), F.max("sig1").alias("high")).filter("low < high").select("doc_id")
        of = named.join(two, "doc_id", "left_semi").join(self.classes.select(*CLASS, "rep"), CLASS).select("doc_id", "rep").distinct()
        least = of.groupBy("doc_id").agg(F.min("rep").alias("a"))
        return self.scratch.put("several", of.join(least, "doc_id").select("a", F.col("rep").alias("b")).filter("a < b"))

    def lists(self) -> None:
        """(v, rep, n, m, centre, centre_n): the inverted values that two classes at least hold, with the list's length and centre.

        A list's centre is the member whose retained values are held most often: of near copies, the one
        they are copies of.
        """
        held = self.classes.select("rep", F.explode("sketch").alias("v"))
        often = self.scratch.put("often", held.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1"))
        total = often.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        shared = with_counts(held, often, "v", "f", total)
        shared = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("vs"), F.sum("f").alias("w"))
        sizes = self.classes.select("rep", "n", F.size("sketch").alias("k"))
        left = F.col("k") - need(F.col("n")) + 1 - (F.col("k") - F.size("vs"))  # values that nobody else holds come first
        rare = shared.join(sizes, "rep").select("rep", "n", "w", F.explode(F.slice("vs", F.lit(1), F.greatest(left, F.lit(0)))).alias("x"))
        rare = self.scratch.put("rare", rare.select(F.col("x.v").alias("v"), "rep", "n", "w"))
        centre = rare.groupBy("v").agg(F.count("*").alias("m"), F.max(F.struct("w", F.negative("rep").alias("r"), "n")).alias("c")).filter("m > 1")
        lists = rare.join(centre, "v").select("v", "rep", "n", "m", F.negative("c.r").alias("centre"), F.col("c.n").alias("centre_n"))
        self.list = self.scratch.put("lists", lists)
        self.scratch.drop("rare", "often")

    def estimate(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose union sketch agrees with a Jaccard of 0.75 but for a chance under 1e-7."""
        side = lambda name: self.classes.select(F.col("rep").alias(name), F.col("sketch").alias(f"s{name}"), F.col("n").alias(f"n{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
        shared = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
        return both.filter(shared >= F.least(need(F.col("na")), need(F.col("nb")), F.lit(NEED))).select("a", "b")

    def sets(self) -> None:
        """Full sets of the classes that share a list with another (of all, if exact); one more pass over the texts."""
        wanted = self.classes if self.exact else self.classes.join(self.list.select("rep").distinct(), "rep", "left_semi")
        wanted = self.scratch.put("wanted", wanted.select("rep", "least", *CLASS))
        ids = wanted.select(F.col("least").alias("doc_id")).distinct()
        ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
        sets = self.docs.join(ids, "doc_id", "left_semi").mapInArrow(_set_batches, "n long, sig1 long, sig2 long, set array<long>")
        self.full = self.scratch.put("sets", sets.dropDuplicates(CLASS).join(wanted, CLASS).select("rep", "set"))
        self.scratch.drop("wanted")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        side = lambda name: self.full.select(F.col("rep").alias(name), F.col("set").alias(f"s{name}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        linked = 100 * shared >= PERCENT * (F.size("sa") + F.size("sb") - shared)
        return both.filter(linked).select("a", "b")

    def stars(self) -> DataFrame:
        pairs = self.list.filter("rep <> centre").filter(similar_sizes("n", "centre_n")).select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"))
        pairs = self.scratch.put("stars", pairs.distinct())
        return self.scratch.put("links1", self.confirm(self.estimate(pairs)))

    def prefixes(self, long: DataFrame) -> DataFrame:
        """(h, low, high, own, rep, n, c, rest): inverted shingles of the full sets of ``long`` (rep, n, c), for members of long lists.

        A linked pair shares 3/7 of the sum of its sizes. Sizes are in narrow buckets, so for each bucket of
        partners a set knows how many shingles it may lack; one more of its rarest shingles (rarest among
        these sets) are inverted, less those that no other set has. A copy that is too far from
        all others has none left, and so have pages that share a passage only. ``rest`` counts the shingle and those
        behind it: a linked pair's first common shingle has enough of them in both sets.
        """
        held = self.full.join(long.select("rep"), "rep", "left_semi").select("rep", F.explode("set").alias("h"))
        often = held.groupBy("h").agg(F.count("*").alias("f")).filter("f > 1")
        shared = held.join(often, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "h"))).alias("hs"))
        least, most = F.ceil(F.col("n") * PERCENT / 100 - 1e-6), F.floor(F.col("n") * 100 / PERCENT + 1e-6)
        each = shared.join(long, "rep").select(
            "rep", "n", "c", "hs", size_bucket(F.col("n")).alias("own"), F.explode(F.sequence(size_bucket(least), size_bucket(most))).alias("other")
        )
        smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), F.col("other").cast("double"))))
        overlap = F.ceil((F.col("n") + smallest) * PERCENT / (100 + PERCENT) - 1e-6)
        left = (F.col("n") - overlap + 1 - (F.col("n") - F.size("hs"))).cast("int")
        rows = each.select("rep", "n", "c", "own", "other", F.size("hs").alias("held"), F.posexplode(F.slice("hs", F.lit(1), F.greatest(left, F.lit(0)))).alias("at", "x"))
        rest = (F.col("held") - F.col("at")).alias("rest")
        return rows.select(F.col("x.h").alias("h"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "n", "c", rest)

    def meet(self, name: str, lists: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs (a, b) of different components that share a list: those outside the list's largest component with the others."""
        lists = self.scratch.put(f"{name}-all", lists)
        parts = lists.groupBy(*keys, "c").agg(F.count("*").alias("k"))
        mixed = parts.groupBy(*keys).agg(F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("most")).filter("parts > 1")
        lists = self.scratch.put(f"{name}-mixed", lists.join(mixed.select(*keys, F.col("most.c").alias("most")), keys))
        few = lists.filter("c <> most").select(*keys, F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc"), F.col("own").alias("xown"), F.col("rest").alias("xrest"))
        met = lists.join(few, keys).filter((F.col("c") != F.col("xc")) & similar_sizes("n", "xn"))
        if "low" in keys:
            overlap = F.ceil((F.col("n") + F.col("xn")) * PERCENT / (100 + PERCENT) - 1e-6)
            met = met.filter((F.col("own") + F.col("xown") == F.col("low") + F.col("high")) & (F.least("rest", "xrest") >= overlap))
        pairs = self.scratch.put(f"{name}-pairs", met.select(F.least("rep", "x").alias("a"), F.greatest("rep", "x").alias("b")).distinct())
        self.scratch.drop(f"{name}-all", f"{name}-mixed")
        return pairs

    def across(self, first: DataFrame) -> DataFrame:
        """Links between members of a list that are in different components after the first round."""
        label = first.select(F.col("node").alias("rep"), F.col("component").alias("c"))
        lists = self.list.join(label, "rep", "left").select("v", "rep", "n", "m", F.coalesce("c", "rep").alias("c"), F.lit(0).alias("own"), F.col("n").alias("rest"))
        if self.exact:
            long = self.classes.select("rep", "n").join(label, "rep", "left").select("rep", "n", F.coalesce("c", "rep").alias("c"))
        else:
            parts = lists.filter(F.col("m") > LONG_LIST).groupBy("v").agg((F.min("c") < F.max("c")).alias("mixed")).filter("mixed")
            long = lists.join(parts, "v", "left_semi").select("rep", "n", "c").distinct()
        long = self.scratch.put("long", long)
        near = self.meet("short", lists.filter(F.col("m") <= LONG_LIST).drop("m"), ["v"])
        far = self.meet("long", self.prefixes(long), ["h", "low", "high"])
        done = self.scratch.get("stars", near)
        if self.exact:  # pairs that the estimate dropped before are among these
            return self.scratch.put("links2", self.confirm(near.unionByName(far).distinct()))
        pairs = self.scratch.put("pairs", near.unionByName(far).distinct().join(done, ["a", "b"], "left_anti"))
        return self.scratch.put("links2", self.confirm(self.estimate(pairs)))

    def run(self) -> DataFrame:
        self.sketches()
        self.lists()
        self.sets()
        several = self.several()
        one = self.stars().unionByName(several)
        first = self.scratch.put("first", components(one))
        two = self.across(first)
        final = self.scratch.put("final", components(one.unionByName(two)))
        self.scratch.drop("sets", "lists", "long", "short-pairs", "long-pairs", "pairs", "stars", "links1", "links2", "first", "several")
        # a component is named after its smallest doc_id; only classes of several rows or of a component need the name
        named = self.classes.select(*CLASS, "rep", "least", "copies").join(final.withColumnRenamed("node", "rep"), "rep", "left")
        least = named.filter("component is not null").groupBy("component").agg(F.min("least").alias("first_id"))
        names = named.filter("copies > 1 or component is not null").join(least, "component", "left").select(*CLASS, F.coalesce("first_id", "least").alias("class_component"))
        names = self.scratch.put("names", names)
        self.scratch.drop("classes", "final")
        rows = self.members.filter("n > 0 and doc_id is not null")
        if names.count() <= BROADCAST_ROWS:
            out = rows.join(F.broadcast(names), CLASS, "left")
        else:  # the rows of a class that very many have are dealt to SALTS parts
            salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*CLASS, "salt"], "left")
        out = out.select("doc_id", "n", F.coalesce("class_component", "doc_id").alias("component"))
        alone = self.members.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
        return out.unionByName(alone).select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("component").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"),
        )


def near_duplicates(docs: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...). ``exact``: no link is missed by any chance."""
    return _Join(docs, exact).run()


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; rows that share a kept doc_id and rows with a null doc_id stay."""
    scratch, name = Scratch(docs.sparkSession, "gone"), fresh(docs, "_gone")
    gone = scratch.put("ids", near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, quoted("doc_id") == F.col(name), "left_anti").select(*columns(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
c AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, c.root FROM c JOIN e ON e.x = c.node),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, component_id = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.node = doc_id"""
