"""The prefix trie of conversations, by prefix doubling.

Turns get dense names. A block of 2**k turns that starts at a multiple of 2**k
is named by the names of its two halves, so logarithmically many rounds of
joins name all blocks. A prefix of d turns is the prefix without the lowest bit
of d, followed by one block; it is named by the smallest conversation that
starts with it, round by round over the number of bits in d. So a node is known
by (conv_id, depth), and whatever is asked of a node is a sum over its members.

Names that many rows share (a common first turn) are joined by broadcast and
all others by merging; sums over members are aggregated before they are dealt;
and turns of a very long conversation are worked in blocks. No group is gathered.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions, schema_of, spread_join
from .ranking import dense_names, ranked

#: A conversation is summed in blocks of so many turns.
BLOCK = 4096
#: So many conversations' ids are joined to one row before they are digested.
IDS = 4096


def name_turns(ws: Workspace, rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), name (of role and text), n_bytes (of the text) of rows (conv_id, turn, role, text).

    Turns are ordered by turn, null first, and if it is equal by role, then by
    the digest of role and text. A null role or text is empty. Rows without
    conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    what = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    slim = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), what.alias("what"), F.octet_length(text).cast("long").alias("n_bytes"))
    turns = ranked(ws, ws.write(slim, "slim"), "conv_id", ["turn", "role", "what"], "ordered", "pos").select("conv_id", "pos", "what", "n_bytes")
    turns = ws.write(turns, "placed")
    names = dense_names(ws, turns, ["what"], "turns")
    return ws.write(spread_join(turns, names, ["what"], "n").select("conv_id", "pos", "name", "n_bytes"), "turns")


def rebuild(ws: Workspace, turns: DataFrame, heads: Column, most: int, base: Column) -> DataFrame:
    """conv_id, d, name, n_bytes, length of conversations that begin with another one's turns.

    Conversation c gets the first heads(c) turns, most at most, of conversation
    base(c) (fewer if it has fewer, none if it is absent), then its own from
    the turn after heads(c) on. A row with d = 0 stands for its beginning.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("len")).withColumn("h", heads).withColumn("base", base)
    convs = ws.write(convs, "convs")
    first = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    head = F.least("h", F.coalesce("base_len", F.lit(0)))
    info = convs.join(first, "base", "left").select("conv_id", "base", "h", "len", head.alias("head"), (head + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("length"))
    info = ws.write(info, "info")
    begun = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(info.select("conv_id", "base", "h", "length"), "base").filter("pos <= h")
    own = spread_join(turns, info.select("conv_id", "h", "head", "length", F.col("len").alias("n")), ["conv_id"], "n").filter("pos > h")
    start = info.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(-1).cast("long").alias("name"), F.lit(0).cast("long").alias("n_bytes"), "length")
    out = begun.select("conv_id", F.col("pos").alias("d"), "name", "n_bytes", "length").unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("d"), "name", "n_bytes", "length"))
    return ws.write(out.unionByName(start), "sequences")


def _smallest(ws: Workspace, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """conv_id, d, rep: the smallest conv_id of each row's group."""
    rows = ws.write(rows, f"{name}-rows")
    groups = ws.write(rows.groupBy(*keys).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")), f"{name}-groups")
    out = ws.write(spread_join(rows, groups, keys, "n").select("conv_id", "d", F.col("least").alias("rep")), name)
    ws.drop(f"{name}-rows", f"{name}-groups")
    return out


def name_prefixes(ws: Workspace, seq: DataFrame, top: int) -> DataFrame:
    """conv_id, d, rep of each prefix of d >= 1 turns: rep is the smallest conv_id that starts with the same turns."""
    blocks = [seq.filter("d > 0").select("conv_id", (F.col("d") - 1).alias("i"), "name")]
    for k in range(1, top.bit_length()):
        half = lambda bit: F.max(F.when(F.col("i").bitwiseAND(1) == bit, F.col("name")))
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(half(0).alias("a"), half(1).alias("b")).filter("a is not null and b is not null")
        pairs = ws.write(pairs, f"pairs-{k}")
        names = dense_names(ws, pairs, ["a", "b"], f"blocks-{k}")
        blocks.append(ws.write(spread_join(pairs, names, ["a", "b"], "n").select("conv_id", "i", "name"), f"blocks-{k}"))
        ws.drop(f"pairs-{k}", f"blocks-{k}-names")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    done = [_smallest(ws, union([b.filter("i = 0").select("conv_id", F.lit(1 << k).cast("long").alias("d"), "name") for k, b in enumerate(blocks)]), ["d", "name"], "prefix-1")]
    tail = lambda k, b: b.filter("i > 0 and i % 2 = 0").select("conv_id", F.shiftleft("i", k).alias("from"), (F.shiftleft("i", k) + (1 << k)).alias("d"), "name", F.bit_count("i").alias("bits"))
    tails = union([tail(k, b) for k, b in enumerate(blocks)])
    for r in range(2, max(d.bit_count() for d in (top, (1 << (top.bit_length() - 1)) - 1)) + 1):
        before = done[-1].withColumnRenamed("d", "from")
        done.append(_smallest(ws, tails.filter(F.col("bits") == r - 1).join(before, ["conv_id", "from"]).select("conv_id", "d", "rep", "name"), ["d", "rep", "name"], f"prefix-{r}"))
    return union(done)


def trie(ws: Workspace, seq: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of sequences (conv_id, d, name, n_bytes, length; a row of d = 0 for each), and which conversations end where.

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves (of the subtree, itself included), saved_tokens (over
    the subtree, bytes that its members share: (n_convs - 1) times those of
    each last turn). Ends: rep, d, conv_id.
    """
    found = seq.agg(F.max("length").alias("top"), F.min("conv_id").alias("least")).head()
    top, least = found["top"] or 0, found["least"]
    if top:
        reps = name_prefixes(ws, seq, top)
        below = seq.filter("d > 0").drop("name").join(reps, ["conv_id", "d"])
        placed = below.unionByName(seq.filter("d = 0").drop("name").withColumn("rep", F.lit(least).cast("long")))
    else:
        placed = seq.drop("name").withColumn("rep", F.lit(least).cast("long"))
    placed = ws.write(placed.withColumn("last", F.col("d") == F.col("length")).drop("length"), "placed-prefixes")
    # a leaf is a node where all of its members end; it is counted at its smallest member
    leaves = placed.groupBy("rep", "d").agg(F.bool_and("last").alias("leaf")).filter("leaf").select(F.col("rep").alias("conv_id"), "d", "leaf")
    block, inner = F.floor(F.col("d") / BLOCK), F.col("d") % BLOCK
    sides = F.filter(F.array(F.struct(block.alias("b"), F.lit(False).alias("ghost")), F.when((inner == 0) & (F.col("d") > 0), F.struct((block - 1).alias("b"), F.lit(True).alias("ghost"))), F.when(inner == BLOCK - 1, F.struct((block + 1).alias("b"), F.lit(True).alias("ghost")))), lambda x: x.isNotNull())
    dealt = placed.join(leaves, ["conv_id", "d"], "left").withColumn("_s", F.explode(sides)).select("*", "_s.*").drop("_s")
    w = Window.partitionBy("conv_id", "b").orderBy(F.desc("d"))
    here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mine = F.col("rep") == F.col("conv_id")
    summed = dealt.select(
        "conv_id", "d", "b", "rep", "ghost",
        F.lead("rep").over(w).alias("parent"),
        F.coalesce((F.lag("rep").over(w) == F.col("conv_id")).cast("long"), F.lit(0)).alias("child"),
        F.sum(F.when(~F.col("ghost") & mine & F.col("leaf"), 1).otherwise(0)).over(here).alias("leaves"),
        F.sum(F.when(~F.col("ghost") & ~mine, F.col("n_bytes")).otherwise(0)).over(here).alias("saved"),
    ).filter("not ghost")
    if top >= BLOCK:  # add what the later blocks of a long conversation hold
        summed = ws.write(summed, "in-blocks")
        totals = summed.groupBy("conv_id", "b").agg(F.max("leaves").alias("l"), F.max("saved").alias("s"))
        later = Window.partitionBy("conv_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
        after = totals.select("conv_id", "b", F.sum("l").over(later).alias("l"), F.sum("s").over(later).alias("s")).filter("l is not null")
        summed = summed.join(after, ["conv_id", "b"], "left").withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0)))
    nodes = summed.groupBy("rep", "d").agg(F.min("parent").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return ws.write(nodes, "nodes"), placed.filter("last").select("rep", "d", "conv_id")


def _join_ids(batches):
    """Rows of joined ids, at most IDS each, of sorted rows (rep, d, conv_id)."""
    held, node = [], None
    out: tuple[list, ...] = [], [], [], []

    def close():
        for x, y in zip(out, (*node, held[0], ",".join(map(str, held))), strict=True):
            x.append(y)
        held.clear()

    def rows():
        done = pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "d", "first", "ids"])
        for x in out:
            x.clear()
        return done

    for batch in batches:
        for rep, d, conv in zip(*(batch.column(c).to_pylist() for c in ("rep", "d", "conv_id")), strict=True):
            if held and (node != (rep, d) or len(held) >= IDS):
                close()
            node = rep, d
            held.append(conv)
        if len(out[0]) > 1000:
            yield rows()
    if held:
        close()
    yield rows()


def _digest(batches):
    """SHA-256 of each node's ids, fed in order; no more than a row is held."""
    node, hashed = None, None
    out: tuple[list, ...] = [], [], []

    def close():
        for x, y in zip(out, (*node, hashed.hexdigest()), strict=True):
            x.append(y)

    for batch in batches:
        for rep, d, ids in zip(*(batch.column(c).to_pylist() for c in ("rep", "d", "ids")), strict=True):
            if node == (rep, d):
                hashed.update(b"," + ids.encode())
                continue
            if node:
                close()
            node, hashed = (rep, d), hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "d", "ends_sha256"])
        for x in out:
            x.clear()
    if node:
        close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["rep", "d", "ends_sha256"])


def digest_ends(ws: Workspace, ends: DataFrame) -> DataFrame:
    """rep, d, ends_sha256 of the comma-joined conv_ids that end at each node, ascending.

    A digest is one stream of bytes by its nature. Many tasks join the ids of a
    large node to rows of IDS each; one task then feeds these rows, in order,
    to the digest, and holds one of them at a time.
    """
    n = partitions(ws.spark)
    parts = ends.repartitionByRange(n, "rep", "d", "conv_id").sortWithinPartitions("rep", "d", "conv_id")
    parts = ws.write(parts.mapInArrow(_join_ids, schema_of("rep long, d long, first long, ids string")), "ids")
    return parts.repartition(n, "rep", "d").sortWithinPartitions("rep", "d", "first").mapInArrow(_digest, schema_of("rep long, d long, ends_sha256 string"))


def query(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations.

    Conversation c gets the first crc32(c) % 9 turns of conversation c - c % 5
    (remainders have the sign of c). Null roles and texts are empty, null turns
    come first, rows of equal turn are ordered by role and then by a digest, and
    repeated rows are turns of their own. Rows without conv_id are in no
    conversation. An empty table gives no rows, not even a root. Very long
    texts are digested once; other columns are ignored.
    """
    ws = Workspace(conversations.sparkSession, "trie")
    turns = name_turns(ws, conversations)
    seq = rebuild(ws, turns, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, 8, F.col("conv_id") - F.col("conv_id") % 5)
    nodes, ends = trie(ws, seq)
    out = nodes.join(digest_ends(ws, ends), ["rep", "d"], "left")
    return out.select(F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, max(pos) AS len,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384)),
      CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
seq AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + least(c.h, coalesce(b.len, 0)), t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
pre AS (
  SELECT conv_id, d, strlen(text) AS n_bytes,
    sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS prefix
  FROM seq
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
own AS (SELECT *, min(conv_id) OVER (PARTITION BY d, prefix) AS rep, max(d) OVER (PARTITION BY conv_id) = d AS last FROM pre),
node AS (SELECT rep, d, any_value(n_bytes) AS n_bytes, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
    bool_and(last) AS leaf FROM own GROUP BY rep, d),
up AS (SELECT n.rep, n.d, n.n_bytes, n.n_convs, n.leaf, o.rep AS top, o.d AS top_d FROM node n JOIN own o ON o.conv_id = n.rep AND o.d <= n.d),
below AS (SELECT top, top_d, count(*) FILTER (leaf) AS n_leaves, count(*) FILTER (d = top_d + 1) AS n_children, sum((n_convs - 1) * n_bytes) AS saved FROM up GROUP BY top, top_d)
SELECT n.rep AS conv_id, CAST(n.d AS BIGINT) AS depth, p.rep AS parent_conv_id, n.n_convs, b.n_children, b.n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.top = n.rep AND b.top_d = n.d LEFT JOIN own p ON p.conv_id = n.rep AND p.d = n.d - 1"""
