"""Merkle dataset manifest by time-forward processing.

Every document is a leaf; the leaves of a source, in order of doc_id, form a tree in which every
``ARITY`` consecutive nodes become their digest, and the sources' roots form one more such tree.

A node's label is its time. Rising, a node sends its digest to its parent, forward in time: the message
waits in a priority queue ordered by the receiver's label, and a parent is computed when its time comes
and all that was sent to it stands at the head of the queue. The sweep back runs in reversed order and
sends every child what its own proof needs from above, down to the leaves.

The queue has two parts. Between blocks of ``ARITY ** LEVELS`` consecutive nodes it is Spark's shuffle:
messages are dealt by block and sorted by label, on disk where they are many. Within a block it is a heap
of at most a block's nodes. A block's top node is a leaf of the next stage, so a source of any size takes
few stages, each ``ARITY ** LEVELS`` times smaller than the one below, and no task holds more than blocks.
A block is written as one row, so the sweep back joins it with one message, the proof suffix of its top
node; proofs of single leaves exist only within the task that digests them.

Order comes from range partitioning of narrow rows (source, doc_id, leaf). A row's place in its source is
its place in the run of that source within its partition; only the run that opens a partition adds a
number, found in a table of one row a partition.

Edge cases: a null doc_id comes first in its source; rows of one doc_id order by leaf digest, and equal
rows are interchangeable leaves of their own; a null source is a source, before all others; a null text
is encoded as such and stays as it is when tampered with; a null doc_id is not tampered with; a single
document is leaf, subroot and root, with an empty proof; an empty table gives no rows. Only doc_id,
source, lang, n_chars and text are read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import discard, materialize, table

ARITY, LEVELS = 16, 3
#: Hexadecimal digits of a digest.
HEX = 64


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), encoded(text)), 256)


def folded(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the tampered leaf where the text is tampered with."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", "source", leaf_digest(F.col("text")).alias("leaf"), F.when(chosen, leaf_digest(folded(F.col("text")))).alias("tampered"))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, the number of a row among those of its ``group`` in the given order."""
    # Equal rows in any number may be dealt to several partitions: their order does not matter.
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(4096)))
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    dealt = salted.repartitionByRange(*keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    dealt = materialize(dealt.withColumn("seen_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("seen_at", 33)
    runs = dealt.groupBy(part.alias("part"), F.col(group).alias("of")).agg(F.min("seen_at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = materialize(runs, "runs")
    # The run that opens a partition, and for each such run how many rows its group has in earlier ones:
    # a group lies in one stretch of partitions, so its runs are at most the number of partitions.
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("carry", F.coalesce(F.sum("n").over(before), F.lit(0)))
    opening = carried.where("carry > 0").select(F.col("part").alias("c_part"), F.col("of").alias("c_of"), "carry")  # one row a partition at most
    local = dealt.withColumn("part", part)
    start = runs.select(F.col("part").alias("r_part"), F.col("of").alias("r_of"), "first")
    out = local.join(start, (F.col("part") == F.col("r_part")) & F.col(group).eqNullSafe(F.col("r_of")))
    out = out.join(F.broadcast(opening), (F.col("part") == F.col("c_part")) & F.col(group).eqNullSafe(F.col("c_of")), "left")
    return out.withColumn("place", F.col("seen_at") - F.col("first") + F.coalesce("carry", F.lit(0))).select(*rows.columns, "place")


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def rise(nodes: list[str], levels: int | None) -> list[list[str]]:
    """All levels over a block's nodes, bottom first: ``levels`` of them, or up to a single node.

    A node's label is (level, place). Each sends (parent's label, own label, digest) forward; the queue
    gives the messages back in order of the receiver's label.
    """
    sent = [((1, i // ARITY), i, d) for i, d in enumerate(nodes)]  # sorted, hence a heap
    out = [list(nodes)]
    if levels is None and len(nodes) == 1:
        return out
    while sent:
        label, received = sent[0][0], []
        while sent and sent[0][0] == label:
            received.append(heapq.heappop(sent)[2])
        level, place = label
        if place == 0:
            out.append([])
        out[level].append(digest(received))
        last = place == (len(out[level - 1]) - 1) // ARITY
        if last and (level == levels or (levels is None and len(out[level]) == 1)):
            break
        heapq.heappush(sent, ((level + 1, place // ARITY), place, out[level][-1]))
    return out


def sink(tree: list[list[str]], suffix: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """The proof of each of a block's nodes: (place in its run, the run's digests) per level, bottom first.

    The reversed sweep: times run down from the top; a node sends each child the child's run and what it
    got itself. Messages are links to the parent's message, so a block's proofs share their upper parts.
    """
    top = len(tree) - 1
    waiting: list = [(-top, 0, None)]  # (reversed label, message); a message is (step, message from above)
    proofs: list = [None] * len(tree[0])
    while waiting:
        level, place, message = heapq.heappop(waiting)
        level = -level
        if level == 0:
            proofs[place] = message
            continue
        run = tree[level - 1][place * ARITY : (place + 1) * ARITY]
        joined = "".join(run)
        for k in range(len(run)):
            heapq.heappush(waiting, (1 - level, place * ARITY + k, ((k, joined), message)))
    out = []
    for message in proofs:
        steps = []
        while message is not None:
            steps.append(message[0])
            message = message[1]
        out.append(steps + suffix)
    return out


def siblings(proof: list[tuple[int, str]]) -> str:
    return "".join(run[: HEX * k] + run[HEX * (k + 1) :] for k, run in proof)


def fold(leaf: str, proof: list[tuple[int, str]]) -> str:
    """The root that a leaf and the siblings of its proof give."""
    for k, run in proof:
        leaf = hashlib.sha256((run[: HEX * k] + leaf + run[HEX * (k + 1) :]).encode()).hexdigest()
    return leaf


_BLOCK = "grp string, block long, lone boolean, top string, nodes array<string>, extra array<{extra}>"


def blocks(nodes: DataFrame, extra: str) -> DataFrame:
    """One row a block of (grp, place, node, extra): its nodes in order and its top node.

    ``lone`` blocks hold all of their group, so that their top is the group's root.
    """
    size = ARITY**LEVELS
    dealt = nodes.withColumn("block", F.expr(f"place div {size}")).repartition("grp", "block").sortWithinPartitions("grp", "block", "place")

    def run(batches):
        import pyarrow.compute as pc

        held, key = [], None

        def emit():
            data = pa.Table.from_batches(held)
            group, block = key
            own = data["node"].to_pylist()
            lone = block == 0 and len(own) < size
            tree = rise(own, None if lone else LEVELS)
            rest = data["extra"].combine_chunks()
            rest = rest if isinstance(rest, pa.Array) else pa.concat_arrays(rest.chunks)
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.string()), pa.array([block], pa.int64()), pa.array([lone]), pa.array([tree[-1][0]]),
                 pa.array([own], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest)],
                ["grp", "block", "lone", "top", "nodes", "extra"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            g, b = batch["grp"], batch["block"]
            change = [0]
            if batch.num_rows > 1:
                same = pc.and_(pc.equal(b.slice(1), b.slice(0, len(b) - 1)), pc.fill_null(pc.equal(g.slice(1), g.slice(0, len(g) - 1)), pa.scalar(False)))
                same = pc.or_(same, pc.and_(pc.equal(b.slice(1), b.slice(0, len(b) - 1)), pc.and_(pc.is_null(g.slice(1)), pc.is_null(g.slice(0, len(g) - 1)))))
                change += [i + 1 for i, s in enumerate(same.to_pylist()) if not s]
            for start, end in zip(change, [*change[1:], batch.num_rows], strict=True):
                now = (g[start].as_py(), b[start].as_py())
                if held and now != key:
                    yield emit()
                    held = []
                key = now
                held.append(batch.slice(start, end - start))
        if held:
            yield emit()

    return dealt.select("grp", "block", "node", "extra").mapInArrow(run, _BLOCK.format(extra=extra))


_MESSAGE = "grp string, block long, steps array<struct<k:int,run:string>>, tops array<string>"


def climb(nodes: DataFrame, extra: str) -> tuple[list[DataFrame], DataFrame]:
    """(stages of blocks, bottom first; the groups' roots as grp, root)."""
    stages, roots = [], None
    while True:
        stage = materialize(blocks(nodes, extra), "blocks")
        stages.append(stage)
        done = stage.where("lone").select("grp", F.col("top").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        rest = stage.where("NOT lone")
        if rest.isEmpty():
            return stages, roots
        nodes, extra = rest.select("grp", F.col("block").alias("place"), F.col("top").alias("node"), F.lit(0).alias("extra")), "int"


def _sent_down(stage: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages of the stage below: for each of a block's nodes, the proof of that node."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                tree = rise(r["nodes"], None if r["lone"] else LEVELS)
                proofs = sink(tree, [(s["k"], s["run"]) for s in r["steps"]])
                places = range(r["block"] * ARITY**LEVELS, r["block"] * ARITY**LEVELS + len(proofs))
                yield pa.RecordBatch.from_pylist(
                    [{"grp": r["grp"], "block": p, "steps": [{"k": k, "run": x} for k, x in proof], "tops": r["tops"]} for p, proof in zip(places, proofs, strict=True)],
                    schema=pa.schema([("grp", pa.string()), ("block", pa.int64()), ("steps", pa.list_(pa.struct([("k", pa.int32()), ("run", pa.string())]))), ("tops", pa.list_(pa.string()))]),
                )

    return _met(stage, messages).mapInArrow(run, _MESSAGE)


def _met(stage: DataFrame, messages: DataFrame) -> DataFrame:
    """Blocks with their messages: one row of each side a key."""
    m = messages.select(F.col("grp").alias("m_grp"), F.col("block").alias("m_block"), "steps", "tops")
    return stage.join(m, F.col("grp").eqNullSafe(F.col("m_grp")) & (F.col("block") == F.col("m_block"))).drop("m_grp", "m_block")


def deliver(stages: list[DataFrame], messages: DataFrame) -> DataFrame:
    """The bottom blocks with the proof suffix of their top nodes.

    ``messages`` hold what each group's root got from above, at block 0. A group's lone block stands in
    the first stage that holds the whole group; its message goes there, all others are sent down.
    """
    for k in range(len(stages) - 1, 0, -1):
        below = _sent_down(stages[k], messages)
        # Groups that are done in a lower stage have no block here: their message passes on.
        here = stages[k].select(F.col("grp").alias("h_grp")).distinct()
        passed = messages.join(here, F.col("grp").eqNullSafe(F.col("h_grp")), "left_anti")
        messages = materialize(below.unionByName(passed), "messages")
    return _met(stages[0], messages)


def manifest(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """(every document's row of the manifest, the root digest)."""
    rows = placed(leaves(docs), "source", ["doc_id", "leaf"])
    extra = "struct<doc_id:bigint,tampered:string>"
    nodes = rows.select(F.col("source").alias("grp"), "place", F.col("leaf").alias("node"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), "tampered").alias("extra"))
    stages, roots = climb(nodes, extra)
    roots = materialize(roots.withColumn("all", F.lit("")), "subroots")
    tops = placed(roots, "all", ["grp"])
    over, top = climb(tops.select(F.lit("").alias("grp"), "place", F.col("root").alias("node"), F.struct(F.col("grp").alias("source"), F.col("root").alias("subroot")).alias("extra")), "struct<source:string,subroot:string>")
    whole = top.first()
    root = whole.root if whole else None
    start = docs.sparkSession.range(1).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("block"), F.lit([]).cast("array<struct<k:int,run:string>>").alias("steps"), F.lit([]).cast("array<string>").alias("tops"))
    sources = deliver(over, start)

    def to_sources(batches):
        for batch in batches:
            for r in batch.to_pylist():
                proofs = sink(rise(r["nodes"], None if r["lone"] else LEVELS), [(s["k"], s["run"]) for s in r["steps"]])
                yield pa.RecordBatch.from_pylist(
                    [{"grp": e["source"], "block": 0, "steps": [{"k": k, "run": x} for k, x in proof], "tops": [e["subroot"], root]} for e, proof in zip(r["extra"], proofs, strict=True)],
                    schema=pa.schema([("grp", pa.string()), ("block", pa.int64()), ("steps", pa.list_(pa.struct([("k", pa.int32()), ("run", pa.string())]))), ("tops", pa.list_(pa.string()))]),
                )

    messages = materialize(sources.mapInArrow(to_sources, _MESSAGE), "messages")
    met = deliver(stages, messages)

    def to_leaves(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch[c][i].as_py() for c in ("nodes", "lone", "steps", "tops")}
                extra = batch["extra"][i].values
                proofs = sink(rise(r["nodes"], None if r["lone"] else LEVELS), [(s["k"], s["run"]) for s in r["steps"]])
                tampered = extra.field("tampered").to_pylist()
                back = [fold(t or leaf, proof) for t, leaf, proof in zip(tampered, r["nodes"], proofs, strict=True)]
                n, (subroot, of_all) = len(proofs), r["tops"]
                yield pa.RecordBatch.from_arrays(
                    [extra.field("doc_id"), pa.array(r["nodes"]), pa.array([subroot] * n), pa.array([of_all] * n),
                     pa.array([hashlib.sha256(siblings(p).encode()).hexdigest() for p in proofs]), pa.array(back), pa.array([b == of_all for b in back])],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    out = met.mapInArrow(to_leaves, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out, root


def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"))[0]


def _sql(depth: int = 8, over: int = 5) -> str:
    """The definition, level by level: trees of up to ARITY ** depth leaves and ARITY ** over sources."""
    code = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(code(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bit = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {bit}))"
    nth = f"row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf('text')}) - 1"
    steps = [f"leaves AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(low)} END AS tampered, {nth} AS idx FROM documents)"]

    def levels(name: str, first: str, count: int) -> None:
        steps.append(f"{name}0 AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM ({first}))")
        for k in range(count):
            steps.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp) AS c FROM (SELECT grp, idx // {ARITY} AS idx, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE c > 1 GROUP BY ALL))")
            steps.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, idx // {ARITY} AS run, list(d ORDER BY idx) AS ds FROM {name}{k} WHERE c > 1 GROUP BY ALL)")

    levels("s", "SELECT source AS grp, idx, leaf AS d FROM leaves", depth)
    steps.append("subroots AS MATERIALIZED (SELECT grp, d AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS nth FROM (" + " UNION ALL ".join(f"SELECT grp, d FROM s{k} WHERE c = 1" for k in range(depth + 1)) + "))")
    levels("t", "SELECT 0 AS grp, nth AS idx, subroot AS d FROM subroots", over)
    steps.append("top AS (" + " UNION ALL ".join(f"SELECT d AS root FROM t{k} WHERE c = 1" for k in range(over + 1)) + ")")
    steps.append("p0 AS (SELECT l.*, subroot, nth, root, '' AS proof, coalesce(tampered, leaf) AS fold FROM leaves l JOIN subroots ON source IS NOT DISTINCT FROM grp, top)")
    for at, (name, key, idx, k) in enumerate([("s", "source", "idx", k) for k in range(depth)] + [("t", "0", "nth", k) for k in range(over)]):
        place = f"({idx} // {ARITY**k} % {ARITY})"
        steps.append(f"""p{at + 1} AS (SELECT p.* EXCLUDE (proof, fold), proof || coalesce(array_to_string(ds[:{place}] || ds[{place} + 2:], ''), '') AS proof,
          CASE WHEN ds IS NULL THEN fold ELSE sha256(array_to_string(ds[:{place}] || [fold] || ds[{place} + 2:], '')) END AS fold
          FROM p{at} p LEFT JOIN {name}r{k} r ON {key} IS NOT DISTINCT FROM grp AND {idx} // {ARITY ** (k + 1)} = run)""")
    return f"""WITH {", ".join(steps)}
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM p{depth + over}"""


QUERIES = {"op13_merkle_manifest": (op13_merkle_manifest, _sql())}
