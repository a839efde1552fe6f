"""A Merkle manifest of a dataset, with proofs that are looked up by coordinates.

A row's leaf is the SHA-256 of its fields, each with its length. The leaves of a source, in the order of doc_id, are a tree: runs of 16 neighbours become
one node of the next level until one is left, the source's subroot; the subroots, in the order of sources, become the root in the same way. All nodes are
kept as a table with coordinates (tree, level, idx). What a proof needs follows from a leaf's index and the sizes of its tree and of the tree of subroots alone:
the coordinates of siblings are exploded, joined with the node table, put in order and concatenated; folding a leaf through them gives the root again. The
16 leaves of a run need the same nodes above themselves, so these are looked up once for the run.

No task holds more than a run of a level: leaves are numbered by ranges (``sharding.numbered``), levels are groups of 16, and the nodes near the root, which every run asks
for, are one side of a join that Spark can split.

Defined results: a null field is '-'. A null source is a source of its own and comes first; a null doc_id comes first in its source. Rows with one doc_id
are ordered by their leaves, so equal rows are neighbours and have leaves and places of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, written
from .sharding import numbered

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Nodes that become one node of the next level: two to the power of BITS.
BITS = 4
RUN = 1 << BITS
#: The tree number of the tree of subroots.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A field with its length in bytes; a null is '-'."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return digest(*[field(text if c == "text" else F.col(c)) for c in FIELDS])


def tampered() -> Column:
    """Whether a row stands for one that was changed later: where 5 divides the CRC-32 of its doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def high(n: str) -> str:
    """SQL for the number of levels that a tree of n leaves has below its root."""
    return f"size(filter(sequence(0, 14), k -> shiftleft(1L, {BITS} * k) < {n}))"


def at_level(n: str, level: str) -> str:
    """SQL for the number of nodes of a level."""
    return f"shiftright({n} + shiftleft(1L, {BITS} * {level}) - 1, {BITS} * {level})"


@dataclass
class Manifest:
    """leaves: doc_id, tree, idx, n (leaves of the tree), leaf, present (the leaf of the row as it is now). nodes: tree, level, idx, digest. trees: tree, source, n, subroot, of how many (trees). root: its digest, or None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def levels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (tree, level, idx, digest) above and with those of level 0 (tree, idx, n, digest), and the root of each tree (tree, subroot)."""
    level, now = 0, written(nodes.select("tree", "idx", "n", "digest"), "level0")
    found = [now.withColumn("level", F.lit(0))]
    while (now.agg(F.max("n")).first()[0] or 0) > 1:
        kids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x.digest), "")
        above = now.filter("n > 1").groupBy("tree", F.shiftright("idx", BITS).alias("up")).agg(F.first("n").alias("n"), F.sha2(kids, 256).alias("digest"))
        level += 1
        now = written(above.select("tree", F.col("up").alias("idx"), F.expr(at_level("n", "1")).alias("n"), "digest"), f"level{level}")
        found.append(now.withColumn("level", F.lit(level)))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("tree", "level", "idx", "digest"), every.filter("n = 1").select("tree", F.col("digest").alias("subroot"))


def manifest(docs: DataFrame, present: Column | None = None) -> Manifest:
    """The manifest of a table. ``present``: an expression for the text that a row has now, where that isn't the one in the manifest."""
    rows = columns_of(docs, FIELDS)
    digests = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(F.col("text")).alias("leaf"), (leaf(present) if present is not None else F.lit(None).cast("string")).alias("present"))
    digests = written(digests, "leaves")
    sizes = digests.groupBy("source").agg(F.count("*").alias("n"))
    trees = written(numbered(sizes.withColumn("all", F.lit(0)), "all", ["source"], "tree").drop("all"), "trees")
    of = trees.select(F.col("source").alias("__source"), "tree", "n")
    placed = digests.join(of, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    leaves = written(numbered(placed, "tree", ["doc_id", "leaf"], "idx"), "numbered")
    nodes, subroots = levels(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")))
    trees = written(trees.join(subroots, "tree"), "subroots")
    many = trees.count()
    tops, root = levels(trees.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"), F.col("subroot").alias("digest")))
    first = root.first()
    return Manifest(leaves, nodes.unionByName(tops), trees.withColumn("trees", F.lit(many).cast("long")), first.subroot if first else None)


def coordinates(runs: DataFrame) -> DataFrame:
    """The nodes that the leaves of a run need: rows of ``runs`` (tree, run, n, trees) with step (levels up from the leaves, 0 is the run itself), of, level, idx (coordinates) and after (whether it stands right of the way up).

    At step 0 all leaves of the run are named, since each is a sibling of the others; further up the node on the way is left out.
    """
    way = lambda tree, at, n, base: (  # noqa: E731  the runs on the way up, a struct for each level of a tree
        f"transform(filter(sequence(0, 14), k -> shiftleft(1L, {BITS} * k) < {n}), k -> struct(k + {base} as step, {tree} as of, k as level, shiftright({at}, {BITS} * k) as own, {at_level(n, 'k')} as wide))"
    )
    ways = runs.withColumn("up", F.expr(f"concat({way('tree', f'run * {RUN}', 'n', '0')}, {way(f'{TOP}L', 'tree', 'trees', high('n'))})"))
    each = ways.select("tree", "run", F.explode("up").alias("w")).select("tree", "run", "w.*")
    begin = f"shiftleft(shiftright(own, {BITS}), {BITS})"
    named = each.withColumn("idx", F.explode(F.expr(f"sequence({begin}, least(wide, {begin} + {RUN}) - 1)")))
    return named.filter("idx <> own or (level = 0 and of >= 0)").select("tree", "run", "step", "of", "level", "idx", (F.col("idx") > F.col("own")).alias("after"))


def proofs(m: Manifest) -> DataFrame:
    """For each run of leaves: tree, run, subroot, kin (the run's leaves in order) and ways (for each level above: what stands left and right of the way up, digests joined)."""
    runs = m.leaves.filter(f"idx % {RUN} = 0").select("tree", F.shiftright("idx", BITS).alias("run"), "n").join(m.trees.select("tree", "subroot", "trees"), "tree")
    runs = written(runs, "runs")
    nodes = m.nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    needed = coordinates(runs).hint("merge").join(nodes, ["of", "level", "idx"])  # far more rows than the table that they are made from, which is what a broadcast would be judged by
    sides = needed.groupBy("tree", "run").agg(F.array_sort(F.collect_list(F.struct("step", "after", "idx", "digest"))).alias("kin"))
    own = runs.select("tree", "run", "subroot", F.expr(f"{high('n')} + {high('trees')}").alias("steps"), F.expr(f"{high('n')} > 0").alias("shared"))
    side = lambda s, test: f"array_join(transform(filter(kin, x -> x.step = {s} and {test}), x -> x.digest), '')"
    # a lone leaf is the subroot itself, so its way up begins with what stands beside that
    ways = f"transform(filter(sequence(0, steps), s -> s < steps and (s > 0 or not shared)), s -> struct({side('s', 'not x.after')} as before, {side('s', 'x.after')} as behind))"
    known = own.join(sides, ["tree", "run"], "left").withColumn("kin", F.coalesce("kin", F.expr("cast(array() as array<struct<step:int,after:boolean,idx:bigint,digest:string>>)")))
    return known.select("tree", "run", "subroot", "shared", F.expr("transform(filter(kin, x -> x.step = 0 and shared), x -> x.digest)").alias("kin"), F.expr(ways).alias("ways"))


def verified(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings' digests from the leaf up, left to right), folded_root (from the leaf of the row as it is now) and verified, of every row."""
    rows = m.leaves.withColumn("run", F.shiftright("idx", BITS)).join(proofs(m).hint("merge"), ["tree", "run"])
    rows = rows.withColumn("at", F.expr(f"cast(idx % {RUN} as int)"))
    before, behind = (f"case when shared then array_join(slice(kin, {a}), '') else '' end" for a in ("1, at", f"at + 2, {RUN}"))
    proof = F.expr("concat(before, behind, array_join(transform(ways, w -> concat(w.before, w.behind)), ''))")
    start = F.expr("case when shared then sha2(concat(before, coalesce(present, leaf), behind), 256) else coalesce(present, leaf) end")
    rows = rows.withColumn("before", F.expr(before)).withColumn("behind", F.expr(behind)).withColumn("__start", start)
    folded = F.expr("aggregate(ways, __start, (h, w) -> sha2(concat(w.before, h, w.behind), 256))")
    told = rows.select("doc_id", "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def audited(docs: DataFrame) -> DataFrame:
    """``verified`` where the tampered rows' texts have lost their capitals A to Z."""
    return verified(manifest(docs, F.when(tampered(), F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))))


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else octet_length(encode({c}::varchar))::varchar || ':' || {c}::varchar end"


def _tree(name: str, source: str, deep: int) -> tuple[list[str], str]:
    """CTEs of all levels over ``source`` (tree, idx, n, digest): level k is name_k (tree, idx, n, digest, run, list of the run); and the roots."""
    steps = []
    for k in range(deep):
        rows = source if k == 0 else f"(select tree, run as idx, (n + {RUN} - 1) // {RUN} as n, sha256(array_to_string(any_value(kin), '')) as digest from {name}{k - 1} where n > 1 group by tree, run, n)"
        steps.append(f"{name}{k} as materialized (select tree, idx, n, digest, idx // {RUN} as run, list(digest) over (partition by tree, idx // {RUN} order by idx rows between unbounded preceding and unbounded following) as kin from {rows})")
    return steps, " union all ".join(f"select tree, digest as subroot from {name}{k} where n = 1" for k in range(deep))


def audited_sql(crc_table: str, crc32: Callable[[str], str], deep: int = 6) -> str:
    """``audited`` in DuckDB, for trees of at most 16 ** (deep - 1) leaves; how CRC-32 is written there is given."""
    changed = f"translate(text, '{UPPER}', '{LOWER}')"
    whole = lambda text: "sha256(" + " || ".join(_field(c if c != "text" else text) for c in FIELDS) + ")"
    low, subroots = _tree("low", "leafs", deep)
    top, roots = _tree("top", "uppers", deep)
    ways = []
    last = "begun"
    for k, (name, tree, at, n) in enumerate([("low", "tree", "idx", "n")] * deep + [("top", TOP, "tree", "trees")] * deep):
        j = k % deep
        wide, own = f"(({n} + {RUN**j} - 1) // {RUN**j})", f"({at} // {RUN**j})"
        side = f"s.kin[1:({own} % {RUN})::int]", f"s.kin[({own} % {RUN})::int + 2:]"
        left, right = (f"array_to_string({x}, '')" for x in side)
        ways.append(f"""way{k} as (select w.* replace (case when {wide} > 1 then proof || {left} || {right} else proof end as proof, case when {wide} > 1 then sha256({left} || folded || {right}) else folded end as folded)
  from {last} w left join (select distinct tree as t, run as r, kin from {name}{j}) s on s.t = {tree if name == 'top' else 'w.tree'} and s.r = {own} // {RUN})""")
        last = f"way{k}"
    return f"""with {crc_table},
hashed as (select doc_id, source, {whole('text')} as leaf, {whole(changed)} as other, coalesce({crc32('doc_id::varchar')} % 5 = 0, false) as bad from documents, crc_table),
sources as (select source, count(*) as n, row_number() over (order by source nulls first) - 1 as tree, count(*) over () as trees from hashed group by source),
leafs as (select doc_id, leaf, case when bad then other else leaf end as present, tree, n, trees, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, leaf as digest from hashed join sources on hashed.source is not distinct from sources.source),
{", ".join(low)},
subroots as ({subroots}),
uppers as (select {TOP} as tree, tree as idx, (select count(*) from subroots) as n, subroot as digest from subroots),
{", ".join(top)},
roots as ({roots}),
begun as (select leafs.*, subroots.subroot as subroot, roots.subroot as root, '' as proof, present as folded from leafs join subroots using (tree), (select subroot from roots) roots),
{", ".join(ways)}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from {last}"""
