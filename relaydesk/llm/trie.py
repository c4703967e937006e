"""Prefix trie of conversations whose heads are taken from other conversations, by composable fingerprints.

A rebuilt conversation is the first turns of a base followed by its own later turns. It is never put together:
the fingerprint of a sequence is the sum of its turns' numbers times powers of a base by place, modulo primes,
so the fingerprint of ``base head + own suffix`` follows from stored prefix fingerprints of both, the suffix
moved by a power. Turns are stored once and are numbered in chunks of a sorted table; the chunks of a long
conversation are composed by the same rule, so none is ever in one task.

Rebuilt turns with equal depth and fingerprint are one node. Equality is verified: every rebuilt turn keeps the
reference of its stored turn (a digest of 128 bits, itself checked against the role and text of every stored
turn), and a node whose members' last turns differ ends the attempt, which starts again with another seed. As
the fingerprint without the last turn follows from the whole one, equal fingerprints and equal last turns mean
equal parents, so by induction equal sequences.

A node belongs to its smallest member. The nodes a conversation owns are the lower end of its path, so sums
over a subtree are sums over its members: what a member saves below a node is the length of the part of its
path that it does not own, and every leaf is counted by its owner. No level is processed after another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Workspace

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1299709381, 1566083941, 1812433253)
DIGIT, DIGITS = 5, 7  # exponents in digits of so many bits: up to 2**35 turns
TIE = 32  # characters of role and text that order turns of one number
ATTEMPTS = 5
HOT_SHARE = 200  # parents of more than one in so many nodes are joined apart
NODE = ["depth", "k0", "k1"]
N = len(PRIMES)


def _power(exponent: Column, j: int) -> Column:
    """``BASES[j] ** exponent`` modulo its prime, digit by digit."""
    out = F.lit(1).cast("bigint")
    for d in range(DIGITS):
        table = F.array(*[F.lit(pow(BASES[j], v << (DIGIT * d), PRIMES[j])).cast("bigint") for v in range(1 << DIGIT)])
        digit = F.shiftright(exponent, DIGIT * d).bitwiseAND((1 << DIGIT) - 1)
        out = out * F.get(table, digit.cast("int")) % PRIMES[j]
    return out


def _back(places: Column, j: int, most: int) -> Column:
    """``BASES[j] ** -places`` modulo its prime, for 0 to ``most``."""
    return F.get(F.array(*[F.lit(pow(BASES[j], -v, PRIMES[j])).cast("bigint") for v in range(most + 1)]), places.cast("int"))


def _number(j: int) -> Column:
    """The number of a stored turn for prime ``j``."""
    return F.pmod(F.xxhash64("t0", "t1", F.lit(j)), F.lit(PRIMES[j]))


def _key(parts: list[Column]) -> list[Column]:
    """Residues of the four primes in two numbers."""
    return [(parts[0] * (1 << 31) + parts[1]).alias("k0"), (parts[2] * (1 << 31) + parts[3]).alias("k1")]


def _residue(j: int) -> Column:
    key = F.col("k0" if j < 2 else "k1")
    return F.shiftright(key, 31) if j % 2 == 0 else key.bitwiseAND((1 << 31) - 1)


def _stored(turns: DataFrame, seed: int) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    return rows.withColumns({"t0": F.xxhash64(F.lit(2 * seed), "role", "text"), "t1": F.xxhash64(F.lit(2 * seed + 1), "text", "role")})


def _references_hold(stored: DataFrame) -> bool:
    """Whether stored turns of one digest are equal in role and text."""
    different = stored.groupBy("t0", "t1", "role", "text").count().groupBy("t0", "t1").count().where(F.col("count") > 1)
    return different.isEmpty()


def _numbered(stored: DataFrame, work: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """Stored turns with their place, prefix fingerprint ``q0..`` and prefix length ``c``, and the chunks of all
    conversations with the totals of the whole conversation."""
    order = ["conv_id", F.asc_nulls_first("turn"), "tie", "t0", "t1"]
    narrow = stored.select("conv_id", "turn", "t0", "t1", F.length("text").cast("bigint").alias("chars"),
                           F.substring(F.concat("role", F.lit("\0"), "text"), 1, TIE).alias("tie"))
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    rows = work.stage(f"turns-{name}", dealt.select("conv_id", F.shiftright("seq", 33).alias("chunk"), "seq", "t0", "t1", "chars"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("seq")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rel", F.row_number().over(inside).cast("bigint"))
    rows = rows.withColumns({f"x{j}": _number(j) * _power(F.col("rel"), j) % PRIMES[j] for j in range(N)})
    rows = rows.withColumns({**{f"r{j}": F.sum(f"x{j}").over(upto) % PRIMES[j] for j in range(N)}, "rc": F.sum("chars").over(upto)})
    rows = work.stage(f"chunked-{name}", rows.select("conv_id", "chunk", "t0", "t1", "chars", "rel", "rc", *[f"r{j}" for j in range(N)]))
    totals = rows.groupBy("conv_id", "chunk").agg(F.max(F.struct("rel", "rc", *[f"r{j}" for j in range(N)])).alias("last")).select("conv_id", "chunk", "last.*")
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    before, whole = by_chunk.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    none = F.lit(0).cast("bigint")
    chunks = totals.withColumns({"off": F.coalesce(F.sum("rel").over(before), none), "coff": F.coalesce(F.sum("rc").over(before), none)})
    chunks = chunks.withColumns({f"p{j}": _power(F.col("off"), j) for j in range(N)})
    chunks = chunks.withColumns({f"m{j}": F.col(f"r{j}") * F.col(f"p{j}") % PRIMES[j] for j in range(N)})
    chunks = chunks.withColumns({
        **{f"o{j}": F.coalesce(F.sum(f"m{j}").over(before), none) % PRIMES[j] for j in range(N)},
        **{f"n{j}": F.sum(f"m{j}").over(whole) % PRIMES[j] for j in range(N)},
        "n": F.sum("rel").over(whole), "nc": F.sum("rc").over(whole),
    })
    chunks = work.stage(f"chunks-{name}", chunks.drop("rel", "rc", *[f"{v}{j}" for v in "rm" for j in range(N)]))
    at = chunks.select("conv_id", "chunk", "off", "coff", *[f"{v}{j}" for v in "po" for j in range(N)])
    placed = rows.join(at, ["conv_id", "chunk"]).select(
        "conv_id", "chunk", "t0", "t1", "chars", (F.col("off") + F.col("rel")).alias("pos"), (F.col("coff") + F.col("rc")).alias("c"),
        *[((F.col(f"o{j}") + F.col(f"r{j}") * F.col(f"p{j}")) % PRIMES[j]).alias(f"q{j}") for j in range(N)])
    return work.stage(f"placed-{name}", placed), chunks


def _plans(placed: DataFrame, chunks: DataFrame, plan: DataFrame, most_head: int) -> DataFrame:
    """Per conversation its base's head turns, the length of its own part left out, and its whole fingerprint."""
    heads = placed.where(F.col("pos") <= most_head).groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("pos", "t0", "t1", "chars", "c", *[f"q{j}" for j in range(N)]))).alias("turns"))
    whole = chunks.select("conv_id", "n", "nc", *[f"n{j}" for j in range(N)]).distinct()
    convs = whole.join(heads, "conv_id").join(plan, "conv_id", "left").withColumn("head", F.coalesce("head", F.lit(0)).cast("bigint"))
    base = heads.select(F.col("conv_id").alias("base_id"), F.col("turns").alias("base_turns"))
    convs = convs.join(base, "base_id", "left").withColumn("taken", F.least("head", F.coalesce(F.size("base_turns"), F.lit(0))).cast("bigint"))
    at = lambda turns, count, name: F.when(count > 0, F.get(turns, (count - 1).cast("int"))[name]).otherwise(F.lit(0).cast("bigint"))
    left = F.least("head", "n")  # own turns left out
    named = {"moved": F.col("head") - F.col("taken"), "own_c": at(F.col("turns"), left, "c"), "base_c": at(F.col("base_turns"), F.col("taken"), "c")}
    for j in range(N):
        named[f"h{j}"] = at(F.col("turns"), left, f"q{j}")
        named[f"b{j}"] = at(F.col("base_turns"), F.col("taken"), f"q{j}")
    convs = convs.withColumns(named)
    whole_key = [_joined(F.col(f"n{j}"), j, most_head) for j in range(N)]
    return convs.select(
        "conv_id", "head", "taken", "moved", "own_c", "base_c", *[f"{v}{j}" for v in "hb" for j in range(N)],
        (F.col("taken") + F.col("n") - left).alias("length"), (F.col("base_c") + F.col("nc") - F.col("own_c")).alias("total"), *_key(whole_key),
        F.slice(F.coalesce("base_turns", F.array().cast("array<struct<pos:bigint,t0:bigint,t1:bigint,chars:bigint,c:bigint,q0:bigint,q1:bigint,q2:bigint,q3:bigint>>")),
                F.lit(1), F.col("taken").cast("int")).alias("base_turns"))


def _joined(prefix: Column, j: int, most_head: int) -> Column:
    """Base head and own turns after the part left out, whose prefix fingerprint is given, as one."""
    own = F.pmod(prefix - F.col(f"h{j}"), F.lit(PRIMES[j])) * _back(F.col("moved"), j, most_head)
    return (F.col(f"b{j}") + own) % PRIMES[j]


def _rebuilt(placed: DataFrame, chunks: DataFrame, plans: DataFrame, most_head: int) -> DataFrame:
    """``conv_id, chunk, depth, t0, t1, chars, before, k0, k1`` of every turn of every rebuilt conversation:
    references and fingerprints, no texts. ``before`` is the length of the turns above."""
    head = plans.select("conv_id", F.lit(-1).cast("bigint").alias("chunk"), F.explode("base_turns").alias("t")).select(
        "conv_id", "chunk", F.col("t.pos").alias("depth"), "t.t0", "t.t1", "t.chars", (F.col("t.c") - F.col("t.chars")).alias("before"),
        *_key([F.col(f"t.q{j}") for j in range(N)]))
    # a row per chunk, so that a conversation of very many turns is joined in parts
    told = chunks.select("conv_id", "chunk").join(plans.drop("base_turns", "k0", "k1", "length", "total"), "conv_id")
    suffix = placed.join(told, ["conv_id", "chunk"]).where(F.col("pos") > F.col("head")).select(
        "conv_id", "chunk", (F.col("pos") - F.col("moved")).alias("depth"), "t0", "t1", "chars",
        (F.col("base_c") + F.col("c") - F.col("own_c") - F.col("chars")).alias("before"), *_key([_joined(F.col(f"q{j}"), j, most_head) for j in range(N)]))
    return head.unionByName(suffix)


def _ends(plans: DataFrame, ids_a_part: int = 4096) -> DataFrame:
    """The hash of the members that end at a node: ids in parts of bounded size, parts in order through one running hash."""
    part = F.floor(F.col("conv_id") / ids_a_part) if ids_a_part & (ids_a_part - 1) else F.shiftright("conv_id", ids_a_part.bit_length() - 1)
    parts = plans.select(F.col("length").alias("depth"), "k0", "k1", "conv_id", part.alias("part")).groupBy(*NODE, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part")

    def kernel(batches) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(4).to_pylist()):
                if key != node:
                    if node is not None:
                        done.append((*node, running.hexdigest()))
                    node, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield _told(done)
        if node is not None:
            yield _told([(*node, running.hexdigest())])

    return dealt.select(*NODE, "part", "ids").mapInArrow(kernel, "depth bigint, k0 bigint, k1 bigint, ends_sha256 string")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def _with_parents(told: DataFrame) -> DataFrame:
    """Adds the smallest member of every node's parent. Parents of a large share of all nodes, of which there
    are at most ``HOT_SHARE``, are sent to all tasks; all others are joined by key."""
    total = told.count()
    above = told.select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("pk0"), F.col("k1").alias("pk1"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = above.where((F.col("n_children") > 0) & (F.col("n_children") * HOT_SHARE >= total)).withColumn("hot", F.lit(True)).drop("n_children")
    cold = above.where((F.col("n_children") > 0) & (F.col("n_children") * HOT_SHARE < total)).drop("n_children")
    on = ["depth", "pk0", "pk1"]
    marked = told.join(F.broadcast(hot), on, "left")
    return marked.where("hot").drop("hot").unionByName(marked.where("hot IS NULL").drop("hot", "parent_conv_id").join(cold, on, "left"))


def trie(turns: DataFrame, plan: DataFrame, work: Workspace, most_head: int) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``turns`` has ``conv_id, turn, role, text``; ``plan`` says of a conversation which ``base_id`` its first
    ``head`` turns (at most ``most_head``) are taken from, in place of its own; without a row it stays as it is.
    Turns are in order of ``turn``, null first; equal numbers by role and text as far as ``TIE`` characters
    tell, then by a fixed hash. Null roles and texts are empty; rows without ``conv_id`` take no part. Repeated
    rows are turns of their own. Columns of any other name are not read. An empty table has no nodes.

    Columns: ``conv_id`` smallest member, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    for seed in range(ATTEMPTS):
        stored = _stored(turns, seed)
        if not _references_hold(stored):
            continue
        name = str(seed)
        placed, chunks = _numbered(stored, work, name)
        plans = work.stage(f"plans-{name}", _plans(placed, chunks, plan, most_head))
        rebuilt = work.stage(f"rebuilt-{name}", _rebuilt(placed, chunks, plans, most_head))
        grouped = rebuilt.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("t0").alias("t0"), F.min("t1").alias("t1"),
            ((F.min("t0") == F.max("t0")) & (F.min("t1") == F.max("t1"))).alias("equal"))
        parent = [F.pmod(_residue(j) - _number(j) * _power(F.col("depth"), j) % PRIMES[j], F.lit(PRIMES[j])) for j in range(N)]
        pk0, pk1 = _key(parent)
        found = work.stage(f"nodes-{name}", grouped.withColumns({"pk0": pk0, "pk1": pk1}).drop("t0", "t1"))
        if found.where("NOT equal").isEmpty():
            return _measured(found.drop("equal"), rebuilt, chunks, plans, work, name)
    raise RuntimeError(f"fingerprints of different turns or prefixes were equal with each of {ATTEMPTS} seeds")


def _measured(found: DataFrame, rebuilt: DataFrame, chunks: DataFrame, plans: DataFrame, work: Workspace, name: str) -> DataFrame:
    none = F.lit(0).cast("bigint")
    root = plans.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        none.alias("depth"), none.alias("k0"), none.alias("k1"), "conv_id", "n_convs", none.alias("chars"), none.alias("pk0"), none.alias("pk1"))
    found = found.unionByName(root)
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pk0").alias("k0"), F.col("pk1").alias("k1")).agg(F.count("*").alias("n_children"))
    found = work.stage(f"counted-{name}", found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", none)))
    owned = found.groupBy("conv_id").agg(F.min("depth").alias("first_own"), F.sum("chars").alias("own_chars"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    shared = work.stage(f"owned-{name}", plans.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("first_own", F.col("length") + 1).alias("first_own"), (F.col("total") - F.coalesce("own_chars", none)).alias("shared_chars"),
        F.coalesce("leaf", none).alias("leaf")))
    parts = chunks.select("conv_id", "chunk").unionByName(plans.select("conv_id", F.lit(-1).cast("bigint").alias("chunk")))
    saved = F.when(F.col("depth") < F.col("first_own"), F.col("shared_chars") - F.col("before")).otherwise(none)
    sums = rebuilt.join(parts.join(shared, "conv_id"), ["conv_id", "chunk"]).select(*NODE, saved.alias("saved"), "leaf").unionByName(
        shared.select(none.alias("depth"), none.alias("k0"), none.alias("k1"), F.col("shared_chars").alias("saved"), "leaf"))
    sums = sums.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    told = found.join(sums, NODE).join(_ends(plans), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    told = work.stage(f"told-{name}", told)
    return _with_parents(told).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def nodes(conversations: DataFrame, work: Workspace, group: int = 100, heads: int = 6) -> DataFrame:
    """The trie of all conversations, each with a head of 0 to ``heads - 1`` turns (by the CRC of its id) from
    the first conversation of its group of ``group`` ids."""
    conv = F.col("conv_id").cast("bigint")
    plan = conversations.where("conv_id IS NOT NULL").select(conv.alias("conv_id")).distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base_id"), F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).alias("head"))
    return trie(conversations, plan, work, heads - 1)
