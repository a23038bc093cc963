"""Prefix trie of conversations as burst tries.

A sequence of turns is a suffix in a container under a trie head; at first all are in the root's. A container that holds
more than ``most_turns`` turns is burst by the next turn id: its head becomes a node, and every next turn the head of a
container of its own. Copies of a whole sequence are one suffix with a count. What is left, small containers and lone
sequences, is sorted and swept into nodes, task by task and one path at a time; burst heads get the sums of the
containers below them.

A node id is the running hash (128 bits) of the turn ids down to it, so equal prefixes have equal ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.scratch import written

ROOT = bytes(16)
MOST_TURNS = 20_000
LEVELS = 8  # levels burst in the first round; each further round takes twice as many
OUT_ROWS = 4096
CHUNK = 4096  # ids in a piece of a digest that runs over several tasks
SEQUENCE = "conv_id long, nodes array<binary>, sizes array<long>"
STATS = "node binary, depth long, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """128-bit id of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))))


def branched_sequences(conversations: DataFrame, family: int = 5, most_shared: int = 9) -> DataFrame:
    """(conv_id, nodes, sizes) of every conversation after it has been rebuilt as a branch of its family's first one.

    Conversation c gets the first h turns of c - c % ``family``, where h is crc32(c) % ``most_shared``, and then its own
    turns after its first h. ``nodes`` are the prefix ids from depth 1 on, ``sizes`` the UTF-8 bytes of the turns' texts.

    A family is read as one sorted stream; of its first conversation only the turns that may be shared are held.

    Defined cases: turns are in order of turn (null first), then role, then text; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conv_id belong to no conversation; a conversation without
    turns left has empty arrays; an empty table gives no rows; further columns are ignored.
    """
    c, base = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % family
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        base.alias("base"), (c == base).alias("is_base"), c.cast("long").alias("conv_id"),
        (F.crc32(c.cast("string").cast("binary")) % most_shared).cast("int").alias("shared"),
        "turn", role.alias("role"), text.alias("text"),
    )
    order = ["base", F.desc("is_base"), "conv_id", F.asc_nulls_first("turn"), "role", "text"]
    sorted_ = rows.repartition("base").sortWithinPartitions(*order).select(
        "base", "is_base", "conv_id", "shared", turn_id(F.col("role"), F.col("text")).alias("turn_id"),
        F.octet_length("text").cast("long").alias("size"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, family_of, first = [], None, []
        current, shared, own, skipped = None, 0, [], 0

        def close() -> None:
            nodes, node = [], ROOT
            turns = first[:shared] + own
            for tid, _ in turns:
                node = hashlib.blake2b(node + tid, digest_size=16).digest()
                nodes.append(node)
            out.append((current, nodes, [size for _, size in turns]))

        for batch in batches:
            for base_id, is_base, conv, h, tid, size in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if conv != current:
                    if current is not None:
                        close()
                    if base_id != family_of:
                        family_of, first = base_id, []
                    current, shared, own, skipped = conv, h, [], 0
                if is_base and len(first) < most_shared:
                    first.append((tid, size))
                if skipped < shared:
                    skipped += 1
                else:
                    own.append((tid, size))
            if len(out) >= OUT_ROWS:
                yield _sequence_batch(out)
                out = []
        if current is not None:
            close()
        if out:
            yield _sequence_batch(out)

    return sorted_.mapInArrow(run, SEQUENCE)


def _sequence_batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, nodes, sizes = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(nodes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["conv_id", "nodes", "sizes"]
    )


def _end_digests(members: DataFrame) -> DataFrame:
    """(end, ends_sha256) for (end, conv_id) rows: the decimal ids of each end, ascending, comma-joined, hashed.

    Rows are dealt by ranges of end and id, so an end that a third of all conversations share is spread over tasks. An
    end that lies inside one task is hashed there; the tasks that share an end hand on pieces of their joined ids, and only
    these are put together, since the hash has to be fed in order.
    """
    by = ["end", "conv_id"]
    dealt = members.repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = ["end", "first_id", "piece", "sha"], []
        end, ids, digest, at_start = None, [], None, True
        pieces: list[tuple] = []

        def flush() -> None:
            """Ids held so far go into the digest; for the task's first end, which may have begun elsewhere, into a piece."""
            nonlocal ids
            if not ids:
                return
            joined = ",".join(map(str, ids))
            if at_start:
                out.append((end, ids[0], joined, None))
            else:
                pieces.append((end, ids[0], joined, None))
                digest.update((b"," if len(pieces) > 1 else b"") + joined.encode())
            ids = []

        for batch in batches:
            for new, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if new != end:
                    if end is not None:
                        flush()
                        if not at_start:
                            out.append((end, None, None, digest.hexdigest()))
                        at_start = False
                    end, digest, pieces = new, hashlib.sha256(), []
                ids.append(conv)
                if len(ids) >= CHUNK:
                    flush()
            if len(out) >= OUT_ROWS:
                yield _columns(out, names)
                out = []
        if end is not None:  # the last one may go on in the next task
            flush()
            out += [] if at_start else pieces
        if out:
            yield _columns(out, names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, digest, out = None, None, []
        for batch in batches:
            for new, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if new != end:
                    if end is not None:
                        out.append((end, digest.hexdigest()))
                    end, digest = new, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            if len(out) >= OUT_ROWS:
                yield _columns(out, ["end", "ends_sha256"])
                out = []
        if end is not None:
            out.append((end, digest.hexdigest()))
        if out:
            yield _columns(out, ["end", "ends_sha256"])

    parts = written(dealt.mapInArrow(run, "end binary, first_id long, piece string, sha string"), "end-digests")
    whole = parts.filter("sha IS NOT NULL").select("end", F.col("sha").alias("ends_sha256"))
    pieces = parts.filter("piece IS NOT NULL").repartition("end").sortWithinPartitions("end", "first_id")
    return whole.union(pieces.mapInArrow(join, "end binary, ends_sha256 string"))


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"end": pa.binary(), "first_id": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)


def _classes(sequences: DataFrame) -> DataFrame:
    """One row for each distinct sequence: end, conv_id (smallest), n, ends_sha256, nodes, sizes."""
    end = F.coalesce(F.try_element_at("nodes", F.lit(-1)), F.lit(ROOT)).alias("end")
    ends = sequences.groupBy(end).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    ends = written(ends, "trie-ends")
    several = ends.filter("n > 1").select(F.col("end").alias("e"))
    members = sequences.select(end, "conv_id").join(several, F.col("end") == F.col("e")).select("end", "conv_id")
    digests = written(_end_digests(members), "trie-digests")
    ends = ends.join(digests, "end", "left").select(
        "end", "n", F.col("conv_id").alias("least"), F.coalesce("ends_sha256", F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256")
    )
    mine = sequences.select("conv_id", "nodes", "sizes", end).alias("s").join(
        ends.alias("t"), (F.col("s.end") == F.col("t.end")) & (F.col("s.conv_id") == F.col("t.least"))
    )
    return written(mine.select("conv_id", "n", "ends_sha256", "nodes", "sizes"), "trie-suffixes")


def _burst(suffixes: DataFrame, most_turns: int) -> tuple[DataFrame, DataFrame | None]:
    """(suffixes with ``head_depth`` of their container, burst heads).

    Heads: node, depth, parent, conv_id, n_convs, size. A container is burst if it holds several suffixes and more than
    ``most_turns`` turns, the ended ones counted as one turn. A round looks at the next levels of all containers that the last one
    left too large.
    """
    path = F.concat(F.array(F.lit(ROOT)), "nodes")
    open_ = suffixes.select("conv_id", "n", path.alias("path"), F.concat(F.array(F.lit(0).cast("long")), "sizes").alias("sizes"))
    depth, levels, found, placed = 0, LEVELS, [], []
    while True:
        steps = F.sequence(F.lit(depth), F.least(F.lit(depth + levels), F.size("path")) - 1)
        # A sequence that is shorter than the level has ended in a head further up.
        level = F.explode(F.when(F.size("path") > depth, steps).otherwise(F.array().cast("array<int>"))).alias("level")
        rows = open_.select("conv_id", "n", level, "path", "sizes").select(
            "conv_id", "n", "level", F.get("path", F.col("level")).alias("node"), F.get("path", F.col("level") - 1).alias("parent"),
            F.get("sizes", F.col("level")).alias("size"), (F.size("path") - F.col("level")).cast("long").alias("turns"),
        )
        rows = written(rows, "trie-levels")
        counted = rows.groupBy("node").agg(
            F.first("level").cast("long").alias("depth"), F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"), F.first("size").alias("size"), F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("suffixes"),
        )
        heads = written(counted.filter((F.col("turns") > most_turns) & (F.col("suffixes") > 1)), "trie-heads")
        if heads.isEmpty():
            placed.append(open_.select("conv_id", F.lit(depth).alias("head_depth")))
            break
        found.append(heads)
        deepest = rows.join(heads.select("node"), "node").groupBy("conv_id").agg(F.max("level").alias("level"))
        moved = written(open_.join(deepest, "conv_id", "left"), "trie-moved")
        last = depth + levels - 1
        done = F.col("level").isNull() | (F.col("level") < last)
        placed.append(moved.filter(done).select("conv_id", (F.coalesce("level", F.lit(depth - 1)) + 1).alias("head_depth")))
        open_ = moved.filter(~done).drop("level")
        depth, levels = depth + levels, levels * 2
    if not found:
        return suffixes.withColumn("head_depth", F.lit(0)), None
    depths, heads = placed[0], found[0]
    for more in placed[1:]:
        depths = depths.union(more)
    for more in found[1:]:
        heads = heads.union(more)
    return suffixes.join(depths, "conv_id"), heads


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a task, whose suffixes come sorted; a container's nodes are held until it ends.

    Input: head, head_depth, head_parent, conv_id, n, ends_sha256, nodes and sizes from the head on.
    """
    names = [c.split()[0] for c in STATS.split(", ")]
    out: list[dict] = []
    held: list[dict] = []
    stack: list[dict] = []
    head = None

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node.pop("size")
            if stack:
                up = stack[-1]
                for name in ("n_convs", "n_leaves", "saved_tokens"):
                    up[name] += node[name]
                up["conv_id"] = min(up["conv_id"], node["conv_id"])
                up["n_children"] += 1
            held.append(node)

    def finish() -> None:
        nonlocal held
        close(0)
        for node in held:
            up = node.pop("up")
            node["parent_conv_id"] = up["conv_id"] if up else None
        out.extend(held)
        held = []

    for batch in batches:
        for row in batch.to_pylist():
            if row["head"] != head:
                finish()
                head = row["head"]
            nodes = row["nodes"]
            shared = 0
            while shared < min(len(stack), len(nodes)) and stack[shared]["node"] == nodes[shared]:
                shared += 1
            close(shared)
            for i in range(shared, len(nodes)):
                up = stack[-1] if stack else None
                stack.append({
                    "node": nodes[i], "depth": row["head_depth"] + i, "parent": up["node"] if up else row["head_parent"], "conv_id": row["conv_id"],
                    "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": EMPTY_SHA, "size": row["sizes"][i], "up": up,
                })
            end = stack[-1]
            end["n_convs"] += row["n"]
            end["conv_id"] = min(end["conv_id"], row["conv_id"])
            end["ends_sha256"] = row["ends_sha256"]
        if len(out) >= OUT_ROWS:
            yield _stats_batch(out, names)
            out.clear()
    finish()
    if out:
        yield _stats_batch(out, names)


def _stats_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"node": pa.binary(), "parent": pa.binary(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names)


def prefix_trie(sequences: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """Per node: node and parent (ids), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. ``sequences``: (conv_id, nodes, sizes) with different ids.

    The last turn of a node is turn ``depth`` of the sequence ``conv_id``. ``saved_tokens`` adds up, over the
    subtree, the bytes of the turn times the members after the first. One distinct sequence is a row, whatever its number of copies.

    Defined cases: an empty sequence ends in the root, which has no parent; the root has no bytes; copies end in one
    node; without sequences there are no nodes, no root either; further columns are ignored.
    """
    sequences = written(sequences.select("conv_id", "nodes", "sizes"), "trie-sequences")
    suffixes, heads = _burst(_classes(sequences), most_turns)
    path = F.concat(F.array(F.lit(ROOT)), "nodes")
    sizes = F.concat(F.array(F.lit(0).cast("long")), "sizes")
    at = F.col("head_depth")
    # A sequence that ends in a burst head has no container below it.
    placed = suffixes.select("conv_id", "n", "ends_sha256", "head_depth", path.alias("path"), sizes.alias("sizes"))
    inside = placed.filter(F.size("path") > at).select(
        F.get("path", at).alias("head"), at.cast("long").alias("head_depth"), F.get("path", at - 1).alias("head_parent"), "conv_id", "n",
        "ends_sha256", F.slice("path", at + 1, F.size("path") - at).alias("nodes"), F.slice("sizes", at + 1, F.size("sizes") - at).alias("sizes"),
    )
    swept = inside.repartition("head").sortWithinPartitions("head", "nodes").mapInArrow(_sweep, STATS)
    if heads is None:
        return swept
    swept = written(swept, "trie-swept")
    tops = swept.filter("parent_conv_id IS NULL")
    return swept.filter("parent_conv_id IS NOT NULL").union(_head_rows(placed, tops, heads))


def _head_rows(placed: DataFrame, tops: DataFrame, heads: DataFrame) -> DataFrame:
    """The burst heads with the sums of all below them, and the containers' own heads with the parent's conv_id."""
    names = [c.split()[0] for c in STATS.split(", ")]
    heads = written(heads, "trie-all-heads")
    ended = placed.filter(F.size("path") == F.col("head_depth")).select(
        F.get("path", F.col("head_depth") - 1).alias("ended"), F.col("ends_sha256").alias("sha")
    )
    children = heads.select("parent").union(tops.select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    # Each container's sums go to all heads above it, which its suffixes name; so does each head's own saving.
    least = tops.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "n_leaves", "saved_tokens")
    own = heads.select(F.col("conv_id").alias("c"), (F.col("depth") + 1).alias("d"), F.lit(0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    given = least.union(own).join(placed.select(F.col("conv_id").alias("c"), "path"), "c")
    above = given.select(F.explode(F.slice("path", F.lit(1), F.col("d").cast("int"))).alias("node"), "n_leaves", "saved_tokens")
    sums = above.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    rows = heads.drop("turns", "suffixes", "size").join(sums, "node").join(children.withColumnRenamed("parent", "node"), "node")
    rows = rows.join(ended, rows["node"] == ended["ended"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    parents = written(heads.select(F.col("node").alias("p"), F.col("conv_id").alias("pc")), "trie-parents")
    of = lambda df: df.join(parents, df["parent"] == F.col("p"), "left").withColumn("parent_conv_id", F.col("pc")).select(*names)
    return of(written(rows, "trie-head-rows")).union(of(tops))
