"""Conversation prefix trie: count-min screening of prefix digests, exact grouping of what may be shared.

1. Every first d turns of a conversation have a digest of 128 bits: the exclusive or of hashes of (position, turn), so that it is a
   running total and a long conversation is scanned in segments.
2. Tasks count all digests in a count-min sketch of ROWS rows; what counts once or more often in a cell is all that is merged.
   An estimate of one proves that a prefix has one member.
3. Such prefixes are nodes as they are and are emitted where they lie; if the one before them in the task isn't proven, they
   are sent along to find their parent. Prefixes that may be shared are grouped by digest, exactly; the sketch decides only
   which way a prefix takes, never a result.
4. A node belongs to its smallest member. Along a conversation the sums of what its own nodes save, from the end, give each
   of its prefixes what lies below it there, and a node's subtree is the sum of that over its members; leaves likewise.

Turns without a number come first, those that share a number in the order of their digest; null role or text is the empty
text. Rows with a null conv_id are no conversation and take no part. Repeated rows are turns of their own. Extra
columns are ignored. An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curvelake.llm import common
from curvelake.llm import turns as turns_

#: Rows of the sketch, cells for each prefix in a row, and the most cells of a row (a power of two): 3 * 2**24 bits, 6 MB.
ROWS, ROOM, MOST = 3, 4, 1 << 24
#: Cells of a row that one message of the sketch covers.
SLICE = 1 << 14
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
EMPTY = hashlib.sha256(b"").hexdigest()


def cells_of(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The cell of each digest in each row, rows one after the other."""
    shift = np.uint64(64 - width.bit_length() + 1)
    a, b = a.view(np.uint64), b.view(np.uint64)
    return np.stack([(((a * ODD[2 * r]) ^ (b * ODD[2 * r + 1])) * ODD[r] >> shift).astype(np.int64) + r * width for r in range(ROWS)])


def sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Bits of the cells that count twice or more. Tasks send the places that they saw once, and more often, slice by slice."""
    parts = min(int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), ROWS * width // SLICE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS * width, np.uint8)
        for b in batches:
            where, n = np.unique(cells_of(b.column("a").to_numpy(), b.column("b").to_numpy(), width), return_counts=True)
            seen[where] = np.minimum(seen[where] + n, 2)
        found = np.flatnonzero(seen)
        for s, own in zip(np.unique(found // SLICE), np.split(found, np.flatnonzero(np.diff(found // SLICE)) + 1), strict=True) if len(found) else ():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([(own[seen[own] == n] % SLICE).astype("<u2").tobytes()], pa.binary()) for n in (1, 2))], ["slice", "once", "more"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, once, more in zip(*(b.column(c).to_pylist() for c in ("slice", "once", "more")), strict=True):
                own = held.setdefault(s, np.zeros(SLICE, np.uint8))
                own[np.frombuffer(more, "<u2")] = 2
                one = np.frombuffer(once, "<u2")
                own[one] = np.minimum(own[one] + 1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(v == 2).tobytes() for v in held.values()], pa.binary())], ["slice", "bits"])

    sent = prefixes.select("a", "b").mapInArrow(count, "slice int, once binary, more binary")
    out = np.zeros(ROWS * width // 8, np.uint8)
    for r in sent.repartition(parts, "slice").mapInArrow(merge, "slice int, bits binary").collect():  # ROWS * width bits at most
        out[r.slice * SLICE // 8 : (r.slice + 1) * SLICE // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def rebuilt(conversations: DataFrame, most: int = 9, family: int = 5) -> DataFrame:
    """conv, depth (1, 2, ...), digest, bytes, len; and a row of depth 0 for every conversation. A conversation c starts with the first h
    turns of its family's first one and goes on with its own after the first h; h is the CRC of its number modulo ``most``."""
    rows = turns_.turns(conversations).where("conv_id is not null")
    narrow = rows.select("conv_id", "turn", "digest", F.octet_length("text").cast("long").alias("bytes"))
    turns = common.materialize(turns_.ordered(narrow).select(F.col("conv_id").alias("conv"), "pos", F.unhex("digest").alias("digest"), "bytes"), "ordered")
    h = F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select("conv", "n", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("base"))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    convs = common.materialize(convs.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    own = turns.join(convs, "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "bytes", "len")
    first = turns.where((F.col("pos") < most - 1) & (F.pmod("conv", F.lit(family)) == 0)).withColumnRenamed("conv", "base")
    lent = first.join(convs.where("k > 0"), "base").where("pos < k").select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "len")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"), "len")
    return own.union(lent).union(roots)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, depth, a, b (the prefix), pa, pb (the prefix without its last turn), bytes, len."""
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "digest")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("conv", "depth", "bytes", "len", hashed(1).alias("ha"), hashed(2).alias("hb"))
    out = turns_.scanned(rows, "conv", "depth", "len", {"a": "ha", "b": "hb"}, "bit_xor", [F.col("depth")])
    return out.select("conv", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "bytes", "len")


def screened(rows: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """``way``: 0 may be shared; 1 proven single, parent unknown here; 2 proven single, and so is the parent."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None, False)
        for b in batches:
            if not b.num_rows:
                continue
            where = cells_of(b.column("a").to_numpy(), b.column("b").to_numpy(), width)
            single = ~(sent.value[where >> 3] >> (7 - (where & 7)).astype(np.uint8) & 1).astype(bool).all(axis=0)
            conv, depth = b.column("conv").to_numpy(), b.column("depth").to_numpy()
            follows = np.concatenate([[last[:2] == (conv[0], depth[0] - 1)], (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1)])
            after = follows & np.concatenate([[last[2]], single[:-1]])
            last = (conv[-1], depth[-1], single[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((single.astype(np.int32) + (single & after)).astype(np.int32))], [*b.schema.names, "way"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", way int")


def trie(rows: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, screened (proven single)."""
    rows = common.materialize(prefixes(rows), "prefixes")
    width = min(MOST, max(SLICE, 1 << (ROOM * rows.count()).bit_length()))
    rows = common.materialize(screened(rows, sketch(rows, width), width), "screened")
    shared, single = rows.where("way = 0"), rows.where("way > 0")
    owner = F.min(F.struct("conv", "len"))
    nodes = shared.groupBy("a", "b", "depth").agg(owner.alias("own"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count_if(F.col("depth") == F.col("len")).alias("n_ends"))
    nodes = common.materialize(nodes.select("a", "b", "depth", F.col("own.conv").alias("conv"), F.col("own.len").alias("len"), "n_convs", "bytes", "pa", "pb", "n_ends"), "nodes")

    edge = ["a", "b", "pa", "pb", "depth", "conv", "len", "single"]
    kids = nodes.withColumn("single", F.lit(False)).select(*edge).union(rows.where("way = 1").withColumn("single", F.lit(True)).select(*edge)).where("depth > 0")
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("above"))
    kids = common.materialize(kids.join(above, ["pa", "pb"], "left"), "children")
    children = kids.where("above is not null").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = common.materialize(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    values = nodes.select("conv", "depth", "len", none.alias("a"), none.alias("b"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("value"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.lit(0).alias("mark"))
    ends = single.where("depth = len").select("conv", "depth", "len", none.alias("a"), none.alias("b"), zero.alias("value"), F.lit(1).cast("long").alias("leaf"), F.lit(0).alias("mark"))
    marked = shared.select("conv", "depth", "len", "a", "b", zero.alias("value"), zero.alias("leaf"), F.lit(1).alias("mark"))
    below = turns_.scanned(marked.union(values).union(ends), "conv", "depth", "len", {"saved": "value", "leaves": "leaf"}, "sum", [F.col("depth").desc(), F.col("mark")], down=True)
    totals = below.where("mark = 1").groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    digests = turns_.sha256_by(shared.where("depth = len").select("a", "b", "conv", F.col("conv").cast("string").alias("name")), ["a", "b"], ["conv"], "name", ",")
    exact = nodes.join(totals, ["a", "b"]).join(kids.where("not single").select("a", "b", "above"), ["a", "b"], "left").join(digests, ["a", "b"], "left")
    parent = lambda above: F.when(F.col("depth") > 0, F.coalesce(above, F.col("conv")))
    exact = exact.select(F.col("conv").alias("conv_id"), "depth", parent(F.col("above")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"), F.lit(False).alias("screened"))
    own = F.when(F.col("depth") == F.col("len"), F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)).otherwise(EMPTY)
    one = F.lit(1).cast("long")
    alone = lambda df, above: df.select(F.col("conv").alias("conv_id"), "depth", parent(above).alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), own.alias("ends_sha256"), F.lit(True).alias("screened"))
    tails = alone(single.where("way = 2 or depth = 0"), none)
    return exact.union(alone(kids.where("single"), F.col("above"))).union(tails)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations; its scratch tables are gone when it returns."""
    with common.passing(conversations.sparkSession):
        return common.materialize(trie(rebuilt(conversations)), "trie", keep=True)


ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) - 1 AS p, m, strlen(text) AS bytes
      FROM (SELECT conv_id, turn, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m FROM conversations WHERE conv_id IS NOT NULL)),
crc_(i, v) AS (SELECT CAST(i AS BIGINT), CAST(i AS BIGINT) FROM range(256) r(i)),
crc8(i, k, v) AS (SELECT i, 0, v FROM crc_ UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc8 WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS x FROM crc8 WHERE k = 8),
n AS (SELECT c, CAST(count(*) AS BIGINT) AS n, CAST(c AS VARCHAR) AS s FROM t GROUP BY c),
crc AS (SELECT c, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(s[i]) AS BIGINT) FOR i IN range(1, length(s) + 1)]),
                lambda a, b: xor(a >> 8, tab.x[xor(a & 255, b) + 1])), 4294967295) % 9 AS h FROM n, tab),
k AS (SELECT a.c, a.n, a.h, a.c - ((a.c % 5) + 5) % 5 AS base, least(a.h, coalesce(b.n, 0)) AS k FROM crc a LEFT JOIN n b ON b.c = a.c - ((a.c % 5) + 5) % 5),
r AS (SELECT k.c, p - h + k + 1 AS d, m, bytes FROM t JOIN k ON k.c = t.c WHERE p >= h
      UNION ALL SELECT k.c, p + 1, m, bytes FROM t JOIN k ON k.base = t.c WHERE p < k.k),
len AS (SELECT k.c, k + greatest(n - h, 0) AS len FROM k),
pre AS (SELECT len.c, CAST(0 AS BIGINT) AS d, '' AS path, '' AS up, CAST(0 AS BIGINT) AS bytes, len FROM len UNION ALL
        SELECT r.c, r.d, string_agg(m, '') OVER w, coalesce(string_agg(m, '') OVER (PARTITION BY r.c ORDER BY r.d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), bytes, len
        FROM r JOIN len ON len.c = r.c WINDOW w AS (PARTITION BY r.c ORDER BY r.d ROWS UNBOUNDED PRECEDING)),
node AS (SELECT path, d, min(c) AS c, count(*) AS n, min(bytes) AS bytes, min(up) AS up, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends FROM pre GROUP BY path, d),
kid AS (SELECT up AS path, count(*) AS n FROM node WHERE d > 0 GROUP BY up),
full_ AS (SELECT node.*, coalesce(kid.n, 0) AS kids FROM node LEFT JOIN kid USING (path)),
below AS (SELECT pre.path, sum((f.n - 1) * f.bytes) AS saved, count_if(f.kids = 0) AS leaves FROM full_ f JOIN pre ON pre.c = f.c AND pre.d <= f.d GROUP BY pre.path)
SELECT f.c AS conv_id, f.d AS depth, CASE WHEN f.d > 0 THEN p.c END AS parent_conv_id, f.n AS n_convs, CAST(f.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_ f LEFT JOIN node p ON p.path = f.up JOIN below b ON b.path = f.path
"""
