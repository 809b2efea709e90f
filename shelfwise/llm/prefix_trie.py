"""Operator 12, conversation prefix trie: composable fingerprints of rebuilt conversations.

A conversation c is rebuilt as the head of its base (the first h turns of conversation c - c % 100) and
its own turns after the first h, h = crc32(c) % 6.  No rebuilt text is ever made.  A sequence of turns
has a fingerprint in a monoid: its length and, for three (modulus, base) pairs, the sum of turn hash times
base to the power of the place; (n, s) followed by (m, t) is (n + m, s + base^n * t).  The stored turns
are sorted once into ranges and written; every range yields the products of its own turns, ranges of one
conversation are composed by their totals (so a conversation of any length is many tasks' work), and a
prefix of a rebuilt conversation is the base's head product composed with a quotient of its own prefix
products.  Equal (depth, fingerprint) form a node.

Equality is then verified: within a node, every member's last turn refers to a stored turn; where two
references differ the stored roles and texts are compared (their extremes over all references of a node
must agree).  By induction over depths all turns of a node's members are equal.  If a comparison ever
fails the fingerprints are drawn anew with another seed.

The trie: a node belongs to its smallest member, so a member owns a chain of nodes from some depth to its
end, which hangs below a node of a smaller member.  Totals of subtrees are sums over the tree of chains,
by pointer doubling, and running sums along a chain (in pieces of bounded length).

Turns are ordered by (turn, role, text), null turns first; null role or text is empty.  Repeated rows are
turns of their own.  Rows without conv_id belong to no conversation and are left out.  An empty table has
no nodes, not even a root.  Columns other than these four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import written

HEAD_TURNS = 6             # h is below this
SPREAD = 100               # conversations that share a base
P = (1 << 31) - 1          # products of two residues fit in 64 bits
BASES = (1_103_515_245, 69_069_069, 1_566_083_941)
RANGE_PREFIX = 16          # characters of the text that a range's bounds hold
PIECE = 4096               # nodes of a chain that are summed in one window
ENDS_CHUNK = 1 << 16       # bytes of member lists that are packed into a row
_S = [f"s{i}" for i in range(len(BASES))]
_PREV = [f"q{i}" for i in range(len(BASES))]


def _power(base: int, n: Column) -> Column:
    """base^n mod P for n in [0, 2^36), one factor for each hexadecimal digit of n."""
    out = None
    for digit in range(9):
        powers = ", ".join(f"{pow(base, k << (4 * digit), P)}L" for k in range(16))
        factor = F.element_at(F.expr(f"array({powers})"), (F.shiftright(n, 4 * digit).bitwiseAND(15) + 1).cast("int"))
        out = (out * factor) % P if digit else factor
    return out


def _power_small(base: int, n: Column) -> Column:
    """base^n mod P for n in (-HEAD_TURNS, 0]."""
    out = F.lit(1).cast("long")
    for k in range(1, HEAD_TURNS):
        out = F.when(n == -k, F.lit(pow(base, -k, P)).cast("long")).otherwise(out)
    return out


def _mod(x: Column) -> Column:
    return F.pmod(x, F.lit(P).cast("long"))


# ---------------------------------------------------------------- stored turns

def stored_turns(conversations: DataFrame) -> DataFrame:
    """(ref, conv_id, role, text), written in the order of (conv_id, turn, role, text).  ``ref`` orders the
    turns alike: its upper bits are the range, its lower 33 bits the place in the range."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, RANGE_PREFIX), F.substring("text", 1, RANGE_PREFIX))
    ranges = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return written(ranges.select(F.monotonically_increasing_id().alias("ref"), "conv_id", "role", "text"), "turns")


def _products(turns: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Local products: a row per turn (conv_id, range, ref, place in its range's part, term and running sum
    for each base), and a row per part of a conversation in a range with the product of all turns before it."""
    part = F.shiftright("ref", 33)
    local = Window.partitionBy("conv_id", "part").orderBy("ref")
    rows = turns.select("conv_id", part.alias("part"), "ref", F.char_length("text").cast("long").alias("chars"),
                        *[F.pmod(F.xxhash64(F.lit(seed * 8 + i), "role", F.lit("/"), F.length("role"), "text"), F.lit(P - 1)).alias(f"x{i}")
                          for i in range(len(BASES))])
    rows = rows.withColumn("i", F.row_number().over(local).cast("long"))
    rows = rows.select("conv_id", "part", "ref", "chars", "i", *[(((F.col(f"x{i}") + 1) * _power(b, F.col("i"))) % P).alias(f"t{i}") for i, b in enumerate(BASES)])
    rows = written(rows.select("*", *[_mod(F.sum(f"t{i}").over(local)).alias(s) for i, s in enumerate(_S)]), "turn-products")
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), *[(F.sum(f"t{i}") % P).alias(f"t{i}") for i in range(len(BASES))])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n0", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    for i, b in enumerate(BASES):
        parts = parts.withColumn(f"t{i}", (F.col(f"t{i}") * _power(b, F.col("n0"))) % P)
    for i in range(len(BASES)):
        parts = parts.withColumn(f"b{i}", _mod(F.coalesce(F.sum(f"t{i}").over(before), F.lit(0).cast("long"))))
    return rows, written(parts.select("conv_id", "part", "n", "n0", *[f"b{i}" for i in range(len(BASES))]), "part-products")


def _composed(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the product of all turns up to them; ``q`` without the last."""
    joined = rows.join(parts, ["conv_id", "part"])
    return joined.withColumns({"pos": F.col("n0") + F.col("i")} | {f"w{i}": _power(b, F.col("n0")) for i, b in enumerate(BASES)}).withColumns(
        {f"s{i}": (F.col(f"b{i}") + F.col(f"w{i}") * F.col(f"s{i}")) % P for i in range(len(BASES))} |
        {f"t{i}": (F.col(f"w{i}") * F.col(f"t{i}")) % P for i in range(len(BASES))})


def head_size(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD_TURNS).cast("long")


# ---------------------------------------------------------------- rebuilt conversations

def rebuilt(turns: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(convs, prefixes).  ``convs``: conv_id and the number of its rebuilt turns.  ``prefixes``: a row per
    conversation and depth from 1, with the prefix's product, that of the prefix before it, and the
    reference and length of its last turn.  Both written."""
    rows, parts = _products(turns, seed)
    base = (F.col("conv_id") - F.col("conv_id") % SPREAD).alias("base")
    size = parts.groupBy("conv_id").agg(F.sum("n").alias("n"))
    convs = size.select("conv_id", "n", base, head_size(F.col("conv_id")).alias("h"))
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").select(
        "*", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))).alias("head"), F.least("h", "n").alias("own"))
    first = rows.join(parts.where(F.col("n0") < HEAD_TURNS), ["conv_id", "part"], "left_semi").where(F.col("i") < HEAD_TURNS)
    heads = written(_composed(first, parts).where(F.col("pos") < HEAD_TURNS).select("conv_id", "pos", "ref", "chars", *_S, *[f"t{i}" for i in range(3)]), "heads")
    zero = heads.select("conv_id", F.lit(0).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(s) for s in _S]).distinct()
    upto = heads.select("conv_id", "pos", *_S).unionByName(zero)
    mine = upto.select("conv_id", F.col("pos").alias("own"), *[F.col(s).alias(f"m{i}") for i, s in enumerate(_S)])
    theirs = upto.select(F.col("conv_id").alias("base"), F.col("pos").alias("head"), *[F.col(s).alias(f"h{i}") for i, s in enumerate(_S)])
    convs = convs.join(mine, ["conv_id", "own"]).join(theirs, ["base", "head"], "left").na.fill(0, [f"h{i}" for i in range(3)])
    convs = written(convs.withColumn("n_turns", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "convs")
    # a part carries what its turns need to be placed in the rebuilt conversation: quotient and shift
    shift = F.col("head") - F.col("h")
    carried = parts.join(convs.where("n > h").select("conv_id", "h", "head", *[f"m{i}" for i in range(3)], *[f"h{i}" for i in range(3)]), "conv_id")
    own = _composed(rows, carried).where(F.col("pos") > F.col("h")).withColumns(
        {f"v{i}": _power_small(b, shift) for i, b in enumerate(BASES)}).select(
        "conv_id", (F.col("pos") + shift).alias("depth"), "ref", "chars",
        *[_mod(F.col(f"h{i}") + F.col(f"v{i}") * _mod(F.col(f"s{i}") - F.col(f"m{i}"))).alias(f"s{i}") for i in range(3)],
        *[_mod(F.col(f"v{i}") * F.col(f"t{i}")).alias(f"t{i}") for i in range(3)])
    lent = convs.where("head > 0").select("conv_id", "base", "head").join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= head").select(
        "conv_id", F.col("pos").alias("depth"), "ref", "chars", *_S, *[f"t{i}" for i in range(3)])
    prefixes = own.unionByName(lent).select("conv_id", "depth", "ref", "chars", *_S, *[_mod(F.col(f"s{i}") - F.col(f"t{i}")).alias(q) for i, q in enumerate(_PREV)])
    return convs.select("conv_id", "n_turns"), written(prefixes, "prefixes")


def mismatches(turns: DataFrame, prefixes: DataFrame) -> int:
    """Nodes whose members' last turns are not all equal, by the stored roles and texts."""
    key = ["depth", *_S]
    several = written(prefixes.groupBy(*key).agg(F.min("ref").alias("low"), F.max("ref").alias("high")).where("low <> high").select(*key, "low"), "shared")
    refs = prefixes.join(several, key).select("ref", "low").distinct()
    found = refs.join(turns.select("ref", "role", "text"), "ref").groupBy("low").agg(
        F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1"))
    return found.where("r0 <> r1 OR t0 <> t1").count()


# ---------------------------------------------------------------- trie

def nodes_of(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """A row per node: key, parent's key, smallest member, members, length of its last text."""
    key = ["depth", *_S]
    inner = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"),
                                       *[F.min(q).alias(q) for q in _PREV])
    none = [F.lit(None).cast("long").alias(q) for q in _PREV]
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(s) for s in _S], "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"), *none)
    return inner.unionByName(root)


def member_digests(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Key and SHA-256 of the ascending conv_ids that end at a node, for nodes where any ends.

    A digest reads its list in order, so a long list is hashed by one task, in a stream; what reaches that
    task are rows of packed ids, which the ranges of a sort have made."""
    key = ["depth", *_S]
    ends = convs.withColumnRenamed("n_turns", "depth").join(prefixes.select("conv_id", *key), ["conv_id", "depth"], "left").na.fill(0, _S)
    ranges = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    kind = ", ".join(f"{c} long" for c in key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, ids, size = None, [], 0
        for batch in batches:
            for *node, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if node != now or size > ENDS_CHUNK:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids, size = node, [], 0
                ids.append(conv)
                size += 20
            if len(out) > 4096 or sum(len(r[-1]) for r in out) > 1 << 22:
                yield _rows(out, [*key, "first"], "ids")
                out = []
        if ids:
            out.append((*now, ids[0], ",".join(map(str, ids))))
        if out:
            yield _rows(out, [*key, "first"], "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for *node, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            if out:
                yield _rows(out, key, "ends_sha256")
        if now is not None:
            yield _rows([(*now, state.hexdigest())], key, "ends_sha256")

    packed = ranges.mapInArrow(pack, f"{kind}, first long, ids string")
    return packed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{kind}, ends_sha256 string")


def _rows(rows: list[tuple], longs: list[str], text: str) -> pa.RecordBatch:
    *cols, last = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array(last, pa.string())], names=[*longs, text])


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) summed over a chain and all chains below it, by pointer doubling.
    ``chains``: conv_id, parent chain ``up`` (null at the root), own leaves and saved."""
    now = written(chains, "chains")
    total, jump = now.select("conv_id", "leaves", "saved"), now.where("up IS NOT NULL").select("conv_id", "up")
    while not jump.isEmpty():
        below = jump.join(total, "conv_id").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        total = written(total.join(below, "conv_id", "left").select(
            "conv_id", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c) for c in ("leaves", "saved")]), "totals")
        jump = written(jump.join(jump.select(F.col("conv_id").alias("up"), F.col("up").alias("next")), "up").select("conv_id", F.col("next").alias("up")), "jumps")
    return total


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the trie of all rebuilt conversations; see the module's text."""
    turns = stored_turns(conversations)
    seed = 0
    while True:
        convs, prefixes = rebuilt(turns, seed)
        if not mismatches(turns, prefixes):
            break
        seed += 1
    key = ["depth", *_S]
    up = {"depth": F.col("depth") - 1} | dict(zip(_S, map(F.col, _PREV)))
    nodes = written(nodes_of(convs, prefixes), "nodes")
    children = nodes.where("depth > 0").groupBy(*[c.alias(k) for k, c in up.items()]).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(q) for s, q in zip(_S, _PREV)], F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(children, key, "left").join(parents, ["depth", *_PREV], "left").join(member_digests(convs, prefixes), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    nodes = written(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-nodes")
    # a conversation's nodes are a chain below a node of its parent chain
    tops = nodes.where("parent_conv_id IS NULL OR parent_conv_id <> conv_id").select(
        "conv_id", F.col("parent_conv_id").alias("up"), (F.col("depth") - 1).alias("at"))
    chains = nodes.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).join(tops, "conv_id")
    chains = written(chains, "chain-tops")
    totals = chain_totals(chains.select("conv_id", "up", "leaves", "saved"))
    hung = chains.where("up IS NOT NULL").select("conv_id", "up", "at").join(totals, "conv_id").groupBy(
        F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    own = written(nodes.join(hung, ["conv_id", "depth"], "left").withColumns(
        {"l": F.coalesce("l", F.lit(0).cast("long")) + F.col("leaf"), "s": F.coalesce("s", F.lit(0).cast("long")) + F.col("saved"),
         "piece": F.floor(F.col("depth") / PIECE)}), "chain-nodes")
    later = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = own.groupBy("conv_id", "piece").agg(F.sum("l").alias("pl"), F.sum("s").alias("ps")).select(
        "conv_id", "piece", *[F.coalesce(F.sum(c).over(later), F.lit(0).cast("long")).alias(c) for c in ("pl", "ps")])
    deeper = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth"))
    out = own.withColumns({"l": F.sum("l").over(deeper), "s": F.sum("s").over(deeper)}).join(pieces, ["conv_id", "piece"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("l") + F.col("pl")).alias("n_leaves"),
                      (F.col("s") + F.col("ps")).alias("saved_tokens"), "ends_sha256")
