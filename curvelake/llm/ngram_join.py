"""Near-duplicate join of word-shingle sets under a Jaccard bound, by vertical partitioning, exact and without all pairs.

1. Every text becomes its set of shingle hashes, in one global order. Texts with equal sets are one class.
2. The order is cut into fragments, V for each range of set sizes. Sets that link differ in at most ``d`` shingles, so
   at least V - d of their fragments are equal; each set files the hashes of its ``d + 1`` weightiest fragments
   (weight: shingles that aren't widespread; the weight depends on the fragment's content alone, so the weightiest
   equal fragment of a linked pair is filed by both). Sets that share a filed fragment form a bucket.
3. One set heads each bucket. Head and member are cut into fragments, the partial overlaps of each are counted
   separately and summed for the pair; each part also gives the member's differences from the head.
4. Two members that link, and don't both link with the head, share a difference. Differences are ordered by how many
   members of the head have them, rarest first, and members that share one in their prefixes are compared through
   their differences: |b ^ c| = |db| + |dc| - 2 |db & dc|. So a group of n near copies costs n pairs, not n * n.
5. Components of the links by alternating large and small stars.

Nulls: a null or wordless text has the empty set and links with nothing; a row with a null id is a component of its own
(null). Rows that repeat an id share its component. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common, textkernel
from curvelake.llm.textkernel import U64, mix

#: Documents whose shingles show which are widespread (a hint for speed: results don't depend on it).
HINT_DOCS = 2000
#: Fragments in which overlaps are counted.
PARTS = 8
#: Rounds in which the members of a difference meet one of them, before those in different components meet each other.
STARS = 1
#: Runs of signature hashes that are looked through one after the other, so that the shuffle files of one are on disk.
BANDS = 4
LOW = U64((1 << 40) - 1)


class Rule:
    """J >= num / den. Size ranges, fragments of each, and how many differences a linked pair has at most."""

    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den = k, num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
        self.bounds = np.array(bounds, np.int64)

    def apart(self, sizes: int) -> int:
        """Differences of a linked pair whose sizes add up to ``sizes``, at most."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def ranges(self, n: int) -> list[tuple[int, int, int]]:
        """(range, fragments, filed fragments) for a set of n: its own range, and those in which a larger partner may lie."""
        own, partner, out = int(np.searchsorted(self.bounds, n, "right")) - 1, n * self.den // self.num, []
        for c in range(own, int(np.searchsorted(self.bounds, partner, "right"))):
            most = self.apart(2 * (int(self.bounds[c + 1]) - 1))
            out.append((c, (most + 1) * 5 // 4 + 1, min(most, self.apart(n + min(partner, int(self.bounds[c + 1]) - 1))) + 1))
        return out

    def filed(self, h: np.ndarray, plain: np.ndarray) -> np.ndarray:
        """Hashes of the filed fragments of an ascending set; ``plain``: which shingles aren't widespread."""
        out = []
        m = mix(h)
        for c, v, keep in self.ranges(len(h)):
            where = ((h >> U64(32)) * U64(v) >> U64(32)).astype(np.int64)
            size = np.bincount(where, minlength=v)
            weight = np.bincount(where, weights=plain, minlength=v).astype(np.int64)
            total = np.zeros(v, U64)
            full = np.flatnonzero(size)
            total[full] = np.add.reduceat(m, np.concatenate([[0], np.cumsum(size[full])[:-1]]))
            number = np.arange(v)
            top = np.lexsort((number, -size, -weight))[:keep]
            out.append(mix(total[top] + number[top].astype(U64) * U64(0x9E3779B97F4A7C15) + U64((c + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
        return np.concatenate(out)


def sets_of(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The ascending set of each text."""
    data, at = common.flat(batch.column("text"))
    starts, ends, offsets = textkernel.word_spans(data, at)
    hashes, at = textkernel.shingles(textkernel.span_hashes(data, starts, ends, True), offsets, k)
    for i in range(len(at) - 1):
        yield np.unique(hashes[at[i] : at[i + 1]])


def widespread(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that one in a hundred of HINT_DOCS documents has, found over a sample by id."""
    step = max(1, docs.count() // HINT_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for whole in batches:
            for b in common.pieces(whole, "text"):
                own = np.concatenate([*sets_of(b, k), np.empty(0, U64)])
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    found = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= HINT_DOCS // 100)
    return np.sort(found.select("h").toPandas().h.to_numpy(np.int64).view(U64))  # 100 times a text's shingles at most


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def file_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n (set size), f1, f2 (the set's fingerprint), sigs0, sigs1, ... (hashes of its filed fragments, by BANDS)."""
    common_shingles = docs.sparkSession.sparkContext.broadcast(widespread(docs, rule.k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for whole in batches:
            for b in common.pieces(whole, "text"):
                n, f1, f2, sigs, ends = [], [], [], [], []
                for s in sets_of(b, rule.k):
                    n.append(len(s))
                    f1.append(np.sum(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64))
                    f2.append(np.sum(mix(s + U64(0x14057B7EF767814F)), dtype=U64))
                    sigs.append(np.sort(rule.filed(s, ~member(s, common_shingles.value))) if len(s) else np.empty(0, U64))
                    ends.append(np.searchsorted(sigs[-1], cuts).tolist())
                lists = []
                for i in range(BANDS):
                    own = [x[e[i] : e[i + 1]] for x, e in zip(sigs, ends, strict=True)]
                    at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
                    lists.append(pa.ListArray.from_arrays(at, pa.array(np.concatenate([*own, np.empty(0, U64)]).view(np.int64))))
                prints = [pa.array(np.array(x, U64).view(np.int64)) for x in (f1, f2)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *prints, *lists], ["doc_id", "n", "f1", "f2", *names])

    cuts = np.array([*(i * (1 << 64) // BANDS for i in range(BANDS)), (1 << 64) - 1], U64)
    names = [f"sigs{i}" for i in range(BANDS)]
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long" + "".join(f", {x} array<long>" for x in names))


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (2 MB) over the hashes of ``ids``: rows that it lets through are joined afterwards."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24))
    words = ids.select((bit / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2**18 rows at most
    out = np.zeros(1 << 18, np.int64)
    out[rows.w.to_numpy(np.int64)] = rows.b.to_numpy(np.int64)
    return out


def parts(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """f, part, n, body: the sets of the documents in ``wanted`` (doc_id, f1), cut into PARTS fragments of the order."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for whole in batches:
            at = whole.column("bit").to_numpy()
            passed = whole.filter(pa.array((bits.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for b in common.pieces(passed, "text"):
                rows = []
                for doc, s in zip(b.column("doc_id").to_pylist(), sets_of(b, k), strict=True):
                    f = int(np.sum(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64).astype(np.int64))
                    cut = np.searchsorted(s, np.arange(1, PARTS, dtype=U64) << U64(61))
                    for p, x in enumerate(np.split(s & LOW, cut)):
                        x = np.sort(x)
                        rows.append((doc, f, p, len(s), x.astype("<u4").tobytes() + (x >> U64(32)).astype("u1").tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "f", "part", "n", "body"])

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)).alias("bit"))
    cut = rows.mapInArrow(run, "doc_id long, f long, part int, n long, body binary")
    one = wanted.select(F.col("doc_id").alias("d_"), F.col("f1").alias("f_"))
    # f alone is the join's key (a range isn't one), so that the bodies needn't be dealt again to drop those of repeated rows
    mine = (F.col("f") == F.col("f_")) & F.col("doc_id").between(F.col("d_"), F.col("d_"))
    return cut.join(one, mine).select("f", "part", "n", "body").dropDuplicates(["f", "part"])


def unpack(body: bytes) -> np.ndarray:
    n = len(body) // 5
    return np.frombuffer(body, "<u4", n).astype(np.int64) | np.frombuffer(body, "u1", n, 4 * n).astype(np.int64) << 32


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, both (shingles in common), delta (differences; none where ``met`` is false): counted in each fragment, summed for the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both, deltas = [], []
            for p, met, x, y in zip(*(b.column(c).to_pylist() for c in ("part", "met", "body_a", "body_b")), strict=True):
                x, y = unpack(x), unpack(y)
                d = np.setxor1d(x, y, assume_unique=True)
                both.append((len(x) + len(y) - len(d)) // 2)
                deltas.append(d | p << 40 if met else d[:0])
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in deltas])]).astype(np.int32))
            delta = pa.ListArray.from_arrays(at, pa.array(np.concatenate([*deltas, np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int64()), delta], ["a", "b", "na", "nb", "both", "delta"])

    of_b = sets.select(F.col("f").alias("b"), "part", F.col("n").alias("nb"), F.col("body").alias("body_b"))
    of_a = sets.select(F.col("f").alias("a"), "part", F.col("n").alias("na"), F.col("body").alias("body_a"))
    cut = pairs.join(of_b, "b").join(of_a, ["a", "part"]).select("a", "b", "na", "nb", "part", "met", "body_a", "body_b")
    each = cut.mapInArrow(run, "a long, b long, na long, nb long, both long, delta array<long>")
    return each.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"), F.flatten(F.collect_list("delta")).alias("delta"))


def buckets(filed: DataFrame) -> DataFrame:
    """s, f, c: the sets that share a filed fragment, and how many rows file it; kept beyond the surrounding ``passing``. In each band the
    shared ones are written first, so that their shuffle files are gone before those of the join; they grow with the documents, so the
    driver never gets them for a broadcast."""
    spark, path = filed.sparkSession, common.scratch(filed.sparkSession, "buckets", keep=True)
    for i in range(BANDS):
        each = filed.select(F.col("f1").alias("f"), F.explode(f"sigs{i}").alias("s"))
        shared = each.groupBy("s").agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("s", "c")
        band = each.join(common.materialize(shared, "shared").hint("shuffle_hash"), "s").groupBy("s", "f").agg(F.max("c").alias("c"))
        common.write(band, f"{path}/{i}")
    return spark.read.schema("s long, f long, c long").parquet(*(f"{path}/{i}" for i in range(BANDS)))


def links(docs: DataFrame, filed: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """u, v: fingerprints of linked sets, enough for the components of all links. ``members``: their ``buckets``."""
    score = members.groupBy("f").agg(F.sum("c").alias("score"))
    heads = members.join(score, "f").groupBy("s").agg(F.max(F.struct("score", "f")).alias("h"), F.count("*").alias("sets")).select("s", F.col("h.f").alias("a"), "sets")
    pairs = members.select("s", F.col("f").alias("b")).join(heads, "s").where("a <> b").groupBy("a", "b").agg((F.max("sets") > 2).alias("met"))
    pairs = common.materialize(pairs, "pairs")  # met: in some bucket there is a third set, so that differences may be shared
    involved = pairs.select(F.col("b").alias("f1")).union(pairs.select("a")).distinct()
    wanted = filed.where("n > 0 and doc_id is not null").groupBy("f1").agg(F.min("doc_id").alias("doc_id")).join(involved, "f1", "left_semi")
    linked = F.lit(rule.den) * F.col("both") >= F.lit(rule.num) * (F.col("na") + F.col("nb") - F.col("both"))
    with common.passing(docs.sparkSession):  # the sets go once their differences are written
        sets = common.materialize(parts(docs, common.materialize(wanted, "wanted"), rule.k), "sets")
        judged = common.materialize(overlaps(pairs, sets).withColumn("linked", linked), "judged", keep=True)

    most = lambda n: F.floor((n + F.floor(n * rule.den / rule.num)) * (rule.den - rule.num) / (rule.den + rule.num))
    member = judged.select("a", "b", F.col("nb").alias("n"), "linked", F.explode("delta").alias("e"))
    often = member.groupBy("a", "e").agg(F.count("*").alias("df"), F.min(F.col("linked").cast("int")).alias("all_linked")).where("df > 1 and all_linked = 0").select("a", "e", "df")
    often = common.materialize(often, "often").hint("shuffle_hash")  # as in ``buckets``
    # a difference that one member alone has comes first in the order and joins nothing: it only uses up the prefix
    lone = F.col("s") - F.coalesce("shared", F.lit(0))
    ranked = member.join(often, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("es"), F.count("*").alias("shared"))
    held = judged.where("size(delta) > 0").select("a", "b", F.col("nb").alias("n"), "linked", F.size("delta").alias("s"))
    prefix = held.join(ranked, ["a", "b"]).withColumn("take", F.when(F.col("linked"), F.col("s")).otherwise(most(F.col("n")) + 1).cast("int") - lone.cast("int"))
    # i: a difference's place in the order, s: the differences of the member
    prefix = prefix.where("take > 0").select("a", "b", "n", "linked", "s", lone.alias("lone"), F.posexplode(F.slice("es", F.lit(1), F.col("take"))).alias("k", "x"))
    prefix = prefix.select("a", "b", "n", "linked", "s", (F.col("lone") + F.col("k") + 1).alias("i"), F.col("x.e").alias("e"))
    prefix = common.materialize(prefix, "prefixes")
    side = lambda x: judged.select("a", F.col("b").alias(x), F.col("delta").alias("d" + x))

    def close(pairs: DataFrame) -> DataFrame:
        """u, v: the linked ones of pairs (a, b, c, n, m) of members of one head, by their differences from it."""
        met = pairs.where(rule.num * F.greatest("n", "m") <= rule.den * F.least("n", "m")).join(side("b"), ["a", "b"]).join(side("c"), ["a", "c"])
        apart = F.size("db") + F.size("dc") - 2 * F.size(F.array_intersect("db", "dc"))
        met = met.withColumn("both", (F.col("n") + F.col("m") - apart) / 2)
        met = met.where(F.lit(rule.den) * F.col("both") >= F.lit(rule.num) * (F.col("n") + F.col("m") - F.col("both")))
        return met.select(F.col("b").alias("u"), F.col("c").alias("v"))

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of the differences whose members aren't in one component yet."""
        open_ = rows.groupBy("a", "e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("a", "e")
        return common.materialize(rows.join(open_, ["a", "e"], "left_semi"), "mixed")

    known = judged.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    left = mixed(prefix.withColumn("root", F.when(F.col("linked"), F.col("a")).otherwise(F.col("b"))))
    for i in range(STARS):
        weight = left.groupBy("a", "b", "n").agg(F.count("*").alias("w"))
        weight = weight.withColumn("w", F.col("w") if i == 0 else F.xxhash64(F.lit(i), "b")).select("a", "b", F.struct("w", "b", "n").alias("h"))
        tops = left.join(weight, ["a", "b"]).groupBy("a", "e").agg(F.max("h").alias("h"))
        star = left.select("a", "e", F.col("b").alias("c"), F.col("n").alias("m")).join(tops, ["a", "e"])
        star = star.select("a", F.col("h.b").alias("b"), "c", F.col("h.n").alias("n"), "m").where("b <> c").distinct()
        found = components(known.union(close(star)))
        known = common.materialize(found.where("f <> root").select(F.col("f").alias("u"), F.col("root").alias("v")), "known")
        roots = known.select(F.col("u").alias("b"), F.col("v").alias("r"))
        left = mixed(left.drop("root").join(roots, "b", "left").withColumn("root", F.coalesce("r", "b")).select("a", "b", "n", "s", "i", "e", "root"))
    other = left.select("a", F.col("b").alias("c"), F.col("n").alias("m"), F.col("s").alias("t"), F.col("i").alias("j"), F.col("root").alias("root_c"), "e")
    fits = (rule.num * F.greatest("n", "m") <= rule.den * F.least("n", "m")) & (F.col("root") != F.col("root_c"))
    # the first difference in common: what comes before it is apart, and what follows it can't be in common beyond the shorter rest
    most_apart = F.floor((F.col("n") + F.col("m")) * (rule.den - rule.num) / (rule.den + rule.num))
    rest = F.least(F.col("s") - F.col("i"), F.col("t") - F.col("j"))
    fits &= (F.col("i") + F.col("j") - 2 <= most_apart) & (F.col("s") + F.col("t") - 2 * (rest + 1) <= most_apart)
    pairs = left.join(other, ["a", "e"]).where((F.col("b") < F.col("c")) & fits).groupBy("a", "b", "c").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    return known.union(close(pairs))


def components(edges: DataFrame) -> DataFrame:
    """f, root: the smallest member of every vertex's component (vertices with an edge), by large and small stars."""
    spark, path, turn = edges.sparkSession, common.scratch(edges.sparkSession, "edges"), 0
    edges = common.write(edges.where("u <> v").distinct(), f"{path}/0")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        turn += 1
        edges = common.write(small.where("u <> v").distinct(), f"{path}/{turn}")
        common.discard(spark, f"{path}/{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            roots = common.materialize(edges.select(F.col("u").alias("f"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()), "roots", keep=True)
            common.discard(spark, path)
            return roots
        before = now


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the component), same_set (rows with the same set)."""
    rule = Rule(k, num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with common.passing(docs.sparkSession):  # what the sets file makes the buckets and goes
        whole = common.materialize(file_sets(docs, rule), "filed")
        members = buckets(whole.where("n > 0 and doc_id is not null"))
        filed = common.materialize(whole.select("doc_id", "n", "f1", "f2"), "prints", keep=True)
    common.collect_garbage(docs.sparkSession)
    with common.passing(docs.sparkSession):  # only the roots outlive the join
        roots = components(links(docs, filed.where("n > 0 and doc_id is not null"), members, rule))
    common.collect_garbage(docs.sparkSession)
    classes = filed.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(roots, F.col("f1") == F.col("f"), "left").withColumn("root", F.coalesce("root", "f1"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(firsts, "root").select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component_id", "copies")
    rows = filed.select("doc_id", "n", "f1", "f2").join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("copies", F.lit(1)).alias("same_set"))


def oracle(k: int, num: int, den: int) -> str:
    """SQL for DuckDB: sets of shingles as text, every pair that shares one counted, components by recursion. For small tables."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
 s AS (SELECT doc_id, list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < {k} THEN [array_to_string(x, ' ')] ELSE [array_to_string(x[i : i + {k - 1}], ' ') FOR i IN range(1, len(x) - {k} + 2)] END) AS g FROM w),
 c AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(10))) AS print FROM s), one AS (SELECT print, min(doc_id) AS id, any_value(n) AS n, count(*) AS copies FROM c WHERE n > 0 GROUP BY 1),
 e AS (SELECT one.id, one.n, unnest(g) AS g FROM one JOIN s ON s.doc_id = one.id),
 p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.g = b.g AND a.id < b.id AND {num} * greatest(a.n, b.n) <= {den} * least(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
 both_ AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
 walk AS (SELECT id, id AS root FROM one UNION SELECT both_.b, walk.root FROM walk JOIN both_ ON both_.a = walk.id),
 least_ AS (SELECT id, min(root) AS root FROM walk GROUP BY 1)
SELECT doc_id, c.n AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(copies, 1) AS same_set FROM c LEFT JOIN one USING (print) LEFT JOIN least_ ON least_.id = one.id"""
