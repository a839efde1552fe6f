"""The trie of all conversations' beginnings, merged family by family first.

A family is the conversations of one base (conv_id without its last two digits). Their turns meet the first turns of the base in a cogroup, where every conversation is rebuilt and the family's own
small trie is made; only its nodes, one for each distinct beginning, are shuffled on to be merged with those of other families. A node is named by its depth and a sum over its turns,
x1 * r + x2 * r^2 + ... modulo the prime 2^107 - 1 (x: 104 bits of a turn's SHA-256), so that a beginning has the same name wherever it is found. Texts are not shuffled: a turn is its digest and its length.

What belongs to subtrees is added up by families too: when members and children are known, each node's share belongs to its smallest member, each family adds up
the shares along its own branches, and what they find for a node is added. The list of members that end in a node comes sorted from the families and is digested as a stream.

No task holds a conversation of any length: turns are numbered by ranges (``sharding.numbered``), a family takes ``CHUNK`` turns of each member at a time, where a later chunk begins is known from sums over
the earlier ones (exact up to 1.2 billion turns), and the shares of later chunks are given to the last node of an earlier one. Only the digest of one node's list is made by one task, as SHA-256 asks, from a row for each family.

Defined results: turns go by turn number, a null first; equal numbers by the SHA-256 of role and text; repeated rows are turns of their own. A null role or text is empty. All rows with a null conv_id are one
conversation that has no base, takes none of its turns from one, is larger than any other and is 'null' in lists. The base of -5 is 0. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import columns_of, written
from .sharding import numbered

#: Turns of a base that a member can take over, at most.
HEAD = 5
#: Turns of one conversation that a family's task takes at a time.
CHUNK = 2048
#: A family's members differ in the last digits of their ids.
FAMILY = 100
PRIME, RATIO = (1 << 107) - 1, 0x5DEECE66D1CE4E5B9BF58476D1
NODE = "fam string, base long, chunk long, depth long, node binary, parent binary, conv long, n long, chars long, ends array<long>, last boolean, at_conv long"


def turn_key() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def taken() -> Column:
    """How many turns of its base a conversation takes over."""
    return F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1), F.lit(0)).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, number (from 0), key (binary), chars, base, fam and h (turns taken from the base) of every row."""
    rows = columns_of(conversations, ["conv_id", "turn", "role", "text"])
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(turn_key()).alias("key"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    placed = numbered(keyed, "conv_id", ["turn", "key"], "number")
    return placed.select("conv_id", "number", F.substring("key", 1, 13).alias("key"), "chars", base.alias("base"), F.coalesce(base.cast("string"), F.lit("null")).alias("fam"), taken().alias("h"))


def name_of(value: int) -> bytes:
    return value.to_bytes(14, "big")


def total(table: pa.Table) -> pa.Table:
    """The sum over one chunk of a conversation's own turns, by their numbers."""
    value = 0
    for j, key, h in zip(table["number"].to_pylist(), table["key"].to_pylist(), table["h"].to_pylist()):
        if j >= h:
            value += int.from_bytes(key, "big") * pow(RATIO, j, PRIME)
    return pa.table({"conv": table["conv_id"].slice(0, 1), "chunk": table["chunk"].slice(0, 1), "value": [str(value % PRIME)]})


def with_starts(said: DataFrame, chunk: int) -> DataFrame:
    """The turns with their chunk, start (the sum over the turns in earlier chunks, as text) and more (whether another chunk follows)."""
    placed = said.withColumn("chunk", F.floor(F.col("number") / chunk).cast("long"))
    long = placed.filter(F.col("number") == chunk).select(F.col("conv_id").alias("__conv"))
    several = placed.join(long, F.col("conv_id").eqNullSafe(F.col("__conv")), "left_semi")
    sums = several.groupBy("conv_id", "chunk").applyInArrow(total, "conv long, chunk long, value string")
    before = F.sum(F.col("value").cast("decimal(38,0)")).over(W.partitionBy("conv").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    later = written(sums.select(F.col("conv").alias("__conv"), F.col("chunk").alias("__chunk"), before.cast("string").alias("start")).filter("__chunk > 0"), "starts")
    of = lambda shift: F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("chunk") + shift == F.col("__chunk"))
    begun = placed.join(later, of(0), "left").drop("__conv", "__chunk")
    followed = later.select("__conv", "__chunk", F.lit(True).alias("more"))
    return begun.join(followed, of(1), "left").drop("__conv", "__chunk").withColumn("more", F.coalesce("more", F.lit(False)))


def family(chunk: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function that rebuilds a family's conversations from its own turns and the head of its base, and gives its trie.

    A row for each node: the smallest member, how many, the length of its last turn, and the members that end there; and one (``last``) for each member that goes on in the next chunk, with its last node in this one.
    """

    def build(own: pa.Table, base: pa.Table) -> pa.Table:
        head = [(int.from_bytes(k, "big"), c) for _, k, c in sorted(zip(base["number"].to_pylist(), base["key"].to_pylist(), base["chars"].to_pylist()))]
        rows = own.select(["conv_id", "number", "key", "chars", "h", "start", "more"]).to_pylist()
        members: dict[int | None, list] = {}
        for r in rows:
            members.setdefault(r["conv_id"], []).append(r)
        nodes: dict[tuple[int, int], list] = {}
        tails = []
        for conv in sorted(members, key=lambda c: (c is None, c or 0)):
            said = sorted(members[conv], key=lambda r: r["number"])
            h, first = said[0]["h"], said[0]["number"]
            shared = head[: min(h, len(head))]
            way = [(int.from_bytes(r["key"], "big"), r["chars"]) for r in said if r["number"] >= h]
            depth, at = 0, 0
            if first < chunk:
                way = shared + way
                nodes.setdefault((0, 0), [None, conv, 0, 0, []])[2] += 1
            else:
                depth = len(shared) + first - h
                at = (sum(x * pow(RATIO, i + 1, PRIME) for i, (x, _) in enumerate(shared)) + int(said[0]["start"]) * pow(RATIO, len(shared) - h + 1, PRIME)) % PRIME
            power = pow(RATIO, depth, PRIME)
            for x, chars in way:
                before, depth, power = at, depth + 1, power * RATIO % PRIME
                at = (at + x * power) % PRIME
                nodes.setdefault((depth, at), [before, conv, 0, chars, []])[2] += 1
            if said[0]["more"]:
                tails.append((depth, at, conv))
            else:
                nodes[depth, at][4].append(conv)
        return table_of(own, nodes, tails)

    return build


def table_of(own: pa.Table, nodes: dict, tails: list) -> pa.Table:
    n = len(nodes) + len(tails)
    fam, base, chunk = (own[c][0].as_py() for c in ("fam", "base", "chunk"))
    cols = {
        "fam": pa.array([fam] * n, pa.string()), "base": pa.array([base] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()),
        "depth": pa.array([d for d, _ in nodes] + [t[0] for t in tails], pa.int64()), "node": pa.array([name_of(v) for _, v in nodes] + [name_of(t[1]) for t in tails], pa.binary()),
        "parent": pa.array([None if x[0] is None else name_of(x[0]) for x in nodes.values()] + [None] * len(tails), pa.binary()),
        "conv": pa.array([x[1] for x in nodes.values()] + [None] * len(tails), pa.int64()), "n": pa.array([x[2] for x in nodes.values()] + [0] * len(tails), pa.int64()),
        "chars": pa.array([x[3] for x in nodes.values()] + [0] * len(tails), pa.int64()), "ends": pa.array([x[4] for x in nodes.values()] + [[]] * len(tails), pa.list_(pa.int64())),
        "last": pa.array([False] * len(nodes) + [True] * len(tails)), "at_conv": pa.array([None] * len(nodes) + [t[2] for t in tails], pa.int64()),
    }
    return pa.table(cols)


def branch(rows: pa.Table) -> pa.Table:
    """The shares of a family's nodes, added up along its branches, from the deepest node up; only what isn't zero."""
    sums: dict[tuple[int, bytes], list[int]] = {}
    parents = {}
    for depth, node, parent, saved, leaves in zip(*(rows[c].to_pylist() for c in ("depth", "node", "parent", "saved", "leaves"))):
        at = sums.setdefault((depth, node), [0, 0])
        at[0] += saved
        at[1] += leaves
        if parent is not None:
            parents[depth, node] = parent
    for at in sorted(sums, key=lambda x: -x[0]):
        if (up := sums.get((at[0] - 1, parents.get(at, b"")))) is not None:
            up[0] += sums[at][0]
            up[1] += sums[at][1]
    found = [(d, v, *s) for (d, v), s in sums.items() if any(s)]
    return pa.table({"depth": pa.array([x[0] for x in found], pa.int64()), "node": pa.array([x[1] for x in found], pa.binary()), "saved": pa.array([x[2] for x in found], pa.int64()), "leaves": pa.array([x[3] for x in found], pa.int64())})


def digests(ends: DataFrame) -> DataFrame:
    """depth, node and the SHA-256 of the members that end there, joined by commas in ascending order, from their sorted lists by family (depth, node, base, ids)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for key, ids in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if key != now:
                    if now:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.binary()), pa.array([x[2] for x in done], pa.string())], names=["depth", "node", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.binary()), pa.array([sha.hexdigest()])], names=["depth", "node", "ends_sha256"])

    ordered = ends.repartition("depth", "node").sortWithinPartitions("depth", "node", F.asc_nulls_last("base"))
    return ordered.select("depth", "node", "ids").mapInArrow(stream, "depth long, node binary, ends_sha256 string")


def families(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of every family's trie, chunk by chunk (see ``family``)."""
    if chunk <= HEAD:
        raise ValueError(f"a chunk holds more than {HEAD} turns")
    said = written(turns(conversations), "turns")
    own = with_starts(said, chunk)
    head = said.filter((F.col("number") < HEAD) & (F.col("conv_id") == F.col("base"))).select("fam", "number", "key", "chars")
    base = own.select("fam", "chunk").distinct().join(head, "fam").select(F.col("fam").alias("of"), F.col("chunk").alias("part"), "number", "key", "chars")
    return own.groupBy("fam", "chunk").cogroup(base.groupBy("of", "part")).applyInArrow(family(chunk), NODE)


def trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each distinct beginning of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    small = written(families(conversations, chunk), "families")
    own = small.filter("not last")
    merged = written(own.groupBy("depth", "node").agg(F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.first("chars").alias("chars"), F.first("parent").alias("parent")), "merged")
    children = merged.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    known = written(merged.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "known")

    mine = F.col("conv").eqNullSafe(F.col("conv_id"))
    joined = own.select("fam", "chunk", "depth", "node", "parent", "conv").join(known.select("depth", "node", "conv_id", "n_convs", "n_children", "chars"), ["depth", "node"])
    shares = written(joined.select("fam", "chunk", "depth", "node", "parent", "conv", F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0).alias("saved"), F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves")), "shares")
    tails = small.filter("last").select("fam", "chunk", "depth", "node", F.col("at_conv").alias("conv"))
    several = tails.select(F.col("conv").alias("__conv")).distinct()
    parts = shares.join(several, F.col("conv").eqNullSafe(F.col("__conv")), "left_semi").select("conv", "chunk", "saved", "leaves")
    parts = parts.unionByName(tails.select("conv", "chunk", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))).groupBy("conv", "chunk").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    later = W.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("__conv"), F.col("chunk").alias("__chunk"), F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("saved"), F.coalesce(F.sum("leaves").over(later), F.lit(0)).alias("leaves"))
    handed = tails.join(parts, F.col("conv").eqNullSafe(F.col("__conv")) & (F.col("chunk") == F.col("__chunk"))).select("fam", "chunk", "depth", "node", F.lit(None).cast("binary").alias("parent"), "saved", "leaves")
    sums = shares.drop("conv").unionByName(handed).groupBy("fam", "chunk").applyInArrow(branch, "depth long, node binary, saved long, leaves long")
    sums = sums.groupBy("depth", "node").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    ids = F.array_join(F.array_sort(F.flatten(F.collect_list("ends"))).cast("array<string>"), ",", "null")
    ends = digests(own.filter("size(ends) > 0").groupBy("depth", "node", "fam", "base").agg(ids.alias("ids")))
    above = merged.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = known.join(sums, ["depth", "node"], "left").join(ends, ["depth", "node"], "left").join(above, ["depth", "parent"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", zero("n_leaves"), zero("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def trie_sql(crc_table: str, crc32: Callable[[str], str]) -> str:
    """The same in DuckDB, where every conversation walks down turn by turn."""
    return f"""with recursive {crc_table},
said as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, key) - 1 as j, key, chars
  from (select conv_id, turn, sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as key, length(coalesce(text, '')) as chars from conversations)),
convs as (select conv_id, conv_id - conv_id % {FAMILY} as base, coalesce({crc32('conv_id::varchar')} % {HEAD + 1}, 0) as h from (select distinct conv_id from conversations), crc_table),
sizes as (select conv_id as base, count(*) as n from said group by conv_id),
rebuilt as (
  select c.conv_id, s.j + 1 as d, s.key, s.chars from convs c join said s on s.conv_id = c.base and s.j < c.h
  union all
  select c.conv_id, s.j - c.h + least(c.h, coalesce(sizes.n, 0)) + 1, s.key, s.chars from convs c join said s on s.conv_id is not distinct from c.conv_id and s.j >= c.h left join sizes on sizes.base = c.base),
ways as (
  select conv_id, 0::bigint as d, '' as node, null::varchar as parent, 0::bigint as chars from convs
  union all
  select w.conv_id, r.d, sha256(w.node || r.key), w.node, r.chars from ways w join rebuilt r on r.conv_id is not distinct from w.conv_id and r.d = w.d + 1),
merged as (select d, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*)::bigint as n_convs, any_value(chars) as chars from ways group by d, node),
children as (select d - 1 as d, parent as node, count(*)::bigint as n_children from merged where d > 0 group by d, parent),
shares as (select w.conv_id, w.d, w.node, case when w.conv_id is not distinct from m.conv_id then (m.n_convs - 1) * m.chars else 0 end as saved,
    case when w.conv_id is not distinct from m.conv_id and c.n_children is null then 1 else 0 end as leaves
  from ways w join merged m on m.d = w.d and m.node = w.node left join children c on c.d = w.d and c.node = w.node),
upward as (select d, node, sum(saved) over (partition by conv_id order by d desc rows unbounded preceding) as saved, sum(leaves) over (partition by conv_id order by d desc rows unbounded preceding) as leaves from shares),
sums as (select d, node, sum(saved)::bigint as saved_tokens, sum(leaves)::bigint as n_leaves from upward group by d, node),
lasts as (select conv_id, max(d) as d from ways group by conv_id),
ends as (select w.d, w.node, sha256(string_agg(coalesce(w.conv_id::varchar, 'null'), ',' order by w.conv_id nulls last)) as ends_sha256 from ways w join lasts l on l.conv_id is not distinct from w.conv_id and l.d = w.d group by w.d, w.node)
select m.conv_id, m.d as depth, p.conv_id as parent_conv_id, m.n_convs, coalesce(c.n_children, 0)::bigint as n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from merged m join sums s using (d, node) left join children c using (d, node) left join ends e using (d, node) left join merged p on p.d = m.d - 1 and p.node = m.parent"""
