"""The trie of all prefixes of conversations that are rebuilt from a shared head.

Every conversation is rebuilt from the first turns of a base conversation and its own turns
after these.  Rebuilt texts are never made.  A sequence of turns has a fingerprint, the triple
(number of turns, code points, polynomial hash), and fingerprints of sequences multiply: the one
of a head times the one of a suffix is the one of both together.  So one pass over the turns as
they are stored gives the products of all their beginnings, a suffix is a quotient of two of
them, and the nodes of the trie are found among the stored turns, each of which is the last turn
of exactly one prefix.

All sums over subtrees are sums over the members of a node.  The smallest member of a node owns
it, and what a conversation owns is one path down to its end.  A subtree is the owned paths of
its members, as far as they reach into it, whatever its depth, so no level waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import column, perhaps_among, settle

#: hashes are numbers below this prime
PRIME = (1 << 127) - 1
#: how often a new multiplier is drawn after sequences that differ shared a fingerprint
DRAWS = 4
#: bytes of joined conversation numbers that travel as one row
END_BYTES = 1 << 16
#: of turns that tie in number and role, so many code points decide before a digest does
HEAD_CHARS = 64
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieRules:
    #: conversations of a block of so many numbers share the head of its first
    block: int = 100
    #: a conversation takes crc32(its number) modulo this many turns of the head
    head_turns: int = 6


@dataclass(frozen=True)
class Fingerprint:
    """A sequence of turns: how many, their code points, and the hash."""

    turns: int = 0
    chars: int = 0
    hash: int = 0

    def then(self, other: Fingerprint, base: int) -> Fingerprint:
        """The fingerprint of both sequences, one after the other."""
        return Fingerprint(
            self.turns + other.turns,
            self.chars + other.chars,
            (self.hash * pow(base, other.turns, PRIME) + other.hash) % PRIME,
        )

    def after(self, head: Fingerprint, base: int) -> Fingerprint:
        """What follows ``head`` in this sequence, which begins with it."""
        turns = self.turns - head.turns
        rest = (self.hash - head.hash * pow(base, turns, PRIME)) % PRIME
        return Fingerprint(turns, self.chars - head.chars, rest)


def _base(draw: int) -> int:
    return int.from_bytes(hashlib.sha256(b"turns %d" % draw).digest(), "big") % PRIME


def _number(data: bytes) -> int:
    return int.from_bytes(data, "big")


def _bytes(hash: int) -> bytes:
    return hash.to_bytes(16, "big")


def _element(digest: bytes) -> int:
    """The hash of a single turn."""
    return _number(digest[:16]) % PRIME


def _turns(df: DataFrame) -> DataFrame:
    """Numbers, lengths and digests of the turns; the texts themselves do not travel."""
    role = F.coalesce(column(df, "role").cast("string"), F.lit(""))
    text = F.coalesce(column(df, "text").cast("string"), F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return df.select(
        column(df, "conv_id").cast("long").alias("conv_id"),
        column(df, "turn").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    ).filter("conv_id IS NOT NULL")


PLACED = (
    "conv_id long, range int, first boolean, turns long, chars long, points long,"
    " hash binary, digest binary"
)


def _products(base: int) -> Callable:
    """Turns in order, each with the fingerprint of its conversation up to it.

    A conversation that began in an earlier range is taken up as if it began here; ``first``
    marks its turns, and ``_carried`` puts the earlier part in front.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        begun, at, held = None, None, Fingerprint()
        for batch in batches:
            out: list[tuple] = []
            ids, points, digests = (
                batch.column(x).to_pylist() for x in ("conv_id", "points", "digest")
            )
            for conv, own, digest in zip(ids, points, digests):
                if conv != at:
                    begun = conv if begun is None else begun
                    at, held = conv, Fingerprint()
                held = held.then(Fingerprint(1, own, _element(digest)), base)
                out.append((held.turns, held.chars, _bytes(held.hash)))
            if out:
                turns, chars, hashes = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id"),
                        pa.array([number] * len(out), pa.int32()),
                        pa.array([c == begun for c in ids]),
                        pa.array(turns, pa.int64()),
                        pa.array(chars, pa.int64()),
                        batch.column("points"),
                        pa.array(hashes, pa.binary()),
                        batch.column("digest"),
                    ],
                    names=["conv_id", "range", "first", "turns", "chars", "points", "hash",
                           "digest"],
                )

    return walk


def _carry(ends: list, base: int) -> dict[int, Fingerprint]:
    """For each range that goes on with the conversation the range before it ended with: the
    fingerprint of that conversation so far.  ``ends``: a row for each range."""
    carried, at, held = {}, None, Fingerprint()
    for row in sorted(ends, key=lambda r: r["range"]):
        end = Fingerprint(row["turns"], row["chars"], _number(row["hash"]))
        if row["begun"] == at:
            carried[row["range"]] = held
            held = held.then(end, base) if row["ended"] == at else end
        else:
            held = end
        at = row["ended"]
    return carried


def _carried(carried: dict[int, Fingerprint], base: int) -> Callable:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                before = carried.get(row["range"]) if row["first"] else None
                if before:
                    own = Fingerprint(row["turns"], row["chars"], _number(row["hash"]))
                    whole = before.then(own, base)
                    row.update(turns=whole.turns, chars=whole.chars, hash=_bytes(whole.hash))
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    return add


def _placed(turns: DataFrame, base: int) -> DataFrame:
    """Every stored turn with the fingerprint of its conversation up to it.

    Turns are range-partitioned by conversation and order, so a conversation of any length is
    spread over tasks; a row for each range comes to the driver to be multiplied.
    """
    order = [
        F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"),
        F.col("start"), F.col("digest"),
    ]
    slim = turns.select(
        "conv_id", "turn", "role", F.substring("text", 1, HEAD_CHARS).alias("start"), "digest",
        F.length("text").cast("long").alias("points"),
    )
    local = settle(
        slim.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("conv_id", "points", "digest")
        .mapInArrow(_products(base), PLACED)
    )
    last = F.max_by(F.struct("conv_id", "turns", "chars", "hash"), F.struct("conv_id", "turns"))
    ends = (
        local.groupBy("range")
        .agg(F.min("conv_id").alias("begun"), last.alias("last"))
        .select("range", "begun", F.col("last.conv_id").alias("ended"), "last.turns",
                "last.chars", "last.hash")
        .collect()  # a row for each range
    )
    carried = _carry(ends, base)
    return settle(local.mapInArrow(_carried(carried, base), PLACED)) if carried else local


def _conversations(placed: DataFrame, rules: TrieRules) -> DataFrame:
    """A row per conversation: the head it takes, its own turns that the head replaces, its
    length and code points once rebuilt."""
    drawn = F.crc32(F.col("conv_id").cast("string").cast("binary")) % rules.head_turns
    taken = F.when(
        F.col("turns") <= F.col("drawn"), F.struct("turns", "chars", "hash")
    )
    own = (
        placed.withColumn("drawn", drawn.cast("long"))
        .groupBy("conv_id", "drawn")
        .agg(
            F.max("turns").alias("own_turns"),
            F.max("chars").alias("own_chars"),
            F.max(taken).alias("replaced"),
        )
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % rules.block)
    )
    heads = (
        placed.filter((F.col("conv_id") % rules.block == 0) & (F.col("turns") < rules.head_turns))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("turns", "chars", "hash"))).alias("heads"))
    )
    reach = F.least("drawn", F.coalesce(F.size("heads"), F.lit(0)).cast("long"))
    head = F.when(F.col("reach") > 0, F.element_at("heads", F.col("reach").cast("int")))
    tail = F.greatest(F.col("own_turns") - F.col("drawn"), F.lit(0))
    zero = F.lit(bytes(16))
    return settle(
        own.join(heads, "base", "left")
        .withColumn("reach", F.when(F.col("heads").isNull(), 0).otherwise(reach))
        .withColumn("head", head)
        .select(
            "conv_id", "base", "drawn", "own_turns", "reach",
            F.coalesce("head.chars", F.lit(0)).alias("head_chars"),
            F.coalesce("head.hash", zero).alias("head_hash"),
            F.coalesce("replaced.turns", F.lit(0)).alias("cut_turns"),
            F.coalesce("replaced.chars", F.lit(0)).alias("cut_chars"),
            F.coalesce("replaced.hash", zero).alias("cut_hash"),
            (F.col("reach") + tail).alias("length"),
            (
                F.coalesce("head.chars", F.lit(0))
                + F.when(tail > 0, F.col("own_chars") - F.coalesce("replaced.chars", F.lit(0)))
                .otherwise(0)
            ).alias("rebuilt_chars"),
        )
    )


REFERENCES = (
    "conv_id long, base long, depth long, points long, through long, hash binary,"
    " parent binary, digest binary, members long, ends boolean"
)


def _prefixes(base: int) -> Callable:
    """The prefix that each turn ends in a rebuilt conversation.

    Its fingerprint is that of the head times that of the own turns after those replaced; the
    prefix before it is a quotient by the turn itself.
    """
    back = pow(base, -1, PRIME)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for row in batch.to_pylist():
                own = Fingerprint(row["turns"], row["chars"], _number(row["hash"]))
                cut = Fingerprint(row["cut_turns"], row["cut_chars"], _number(row["cut_hash"]))
                head = Fingerprint(row["reach"], row["head_chars"], _number(row["head_hash"]))
                whole = head.then(own.after(cut, base), base)
                parent = (whole.hash - _element(row["digest"])) * back % PRIME
                out.append((
                    row["conv_id"], row["base"], whole.turns, row["points"], whole.chars,
                    _bytes(whole.hash), _bytes(parent), row["digest"], row["members"],
                    row["ends"],
                ))
            types = [pa.int64()] * 5 + [pa.binary()] * 3 + [pa.int64(), pa.bool_()]
            names = [x.split()[0] for x in REFERENCES.split(",")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), types)], names=names
            )

    return compose


def _uses(convs: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums over the conversations that run through each turn of a shared head."""
    partial = convs.filter("reach > 0").groupBy("base", "reach").agg(
        *[value.alias(name) for name, value in sums.items()]
    )
    return partial.withColumn("turns", F.explode(F.sequence(F.lit(1).cast("long"), "reach")))


def _references(placed: DataFrame, convs: DataFrame, base: int) -> DataFrame:
    """A row per stored turn that some rebuilt conversation uses: the prefix it ends.

    A turn of a shared head is one row, however many conversations take it.
    """
    own = (
        placed.join(
            convs.select("conv_id", "drawn", "own_turns", "reach", "head_chars", "head_hash",
                         "cut_turns", "cut_chars", "cut_hash"),
            "conv_id",
        )
        .filter(F.col("turns") > F.col("drawn"))
        .withColumns({
            "base": F.lit(None).cast("long"),
            "members": F.lit(1).cast("long"),
            "ends": F.col("turns") == F.col("own_turns"),
        })
        .drop("drawn", "own_turns")
    )
    uses = (
        _uses(convs, {"n": F.count("*"), "least": F.min("conv_id")})
        .groupBy("base", "turns")
        .agg(F.sum("n").alias("members"), F.min("least").alias("least"))
    )
    nothing = {"reach": 0, "head_chars": 0, "cut_turns": 0, "cut_chars": 0}
    heads = (
        placed.withColumnRenamed("conv_id", "base")
        .join(uses, ["base", "turns"])
        .withColumnRenamed("least", "conv_id")
        .withColumns({k: F.lit(v).cast("long") for k, v in nothing.items()})
        .withColumns({"head_hash": F.lit(bytes(16)), "cut_hash": F.lit(bytes(16)),
                      "ends": F.lit(False)})
    )
    both = own.drop("range", "first").unionByName(heads.drop("range", "first"))
    return settle(both.mapInArrow(_prefixes(base), REFERENCES))


def _nodes(references: DataFrame) -> DataFrame:
    """References grouped into nodes.  ``same`` tells if a node's turns all say the same and
    follow the same prefix, so that its members agree in the whole sequence."""
    same = (F.min("digest") == F.max("digest")) & (F.min("parent") == F.max("parent"))
    return settle(
        references.groupBy("depth", "hash").agg(
            F.min("conv_id").alias("conv_id"),
            F.sum("members").alias("n_convs"),
            F.count("*").alias("n_references"),
            F.min("points").alias("points"),
            F.min("through").alias("through"),
            F.min("parent").alias("parent"),
            F.min("digest").alias("digest"),
            same.alias("same"),
        )
    )


def _verify_texts(turns: DataFrame, nodes: DataFrame) -> None:
    """Roles and texts behind the references of nodes with several are compared as they are."""
    several = nodes.filter("n_references > 1").select("digest").distinct()
    moved = perhaps_among(turns, F.col("digest"), several, F.col("digest"))
    content = F.struct("role", "text")
    differing = (
        moved.groupBy("digest")
        .agg(F.min(content).alias("least"), F.max(content).alias("most"))
        .filter("least <> most")
    )
    if differing.limit(1).count():
        raise ValueError("different turns share a SHA-256 digest")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends, the numbers of a node joined into pieces of text."""
    out: list[tuple] = []
    node, first, piece, size = None, None, [], 0

    def close() -> None:
        if piece:
            out.append((*node, first, ",".join(piece)))

    def batch_of() -> pa.RecordBatch:
        depths, hashes, firsts, pieces = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(depths, pa.int64()), pa.array(hashes, pa.binary()),
             pa.array(firsts, pa.int64()), pa.array(pieces, pa.string())],
            names=["depth", "hash", "first", "piece"],
        )

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("depth", "hash", "conv_id"))):
            if row[:2] != node or size >= END_BYTES:
                close()
                node, first, piece, size = row[:2], row[2], [], 0
            piece.append(str(row[2]))
            size += len(piece[-1]) + 1
            if len(out) >= 1000:
                yield batch_of()
    close()
    if out:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order, one at a time."""
    out: list[tuple] = []
    node, held = None, None

    def batch_of() -> pa.RecordBatch:
        depths, hashes, digests = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(depths, pa.int64()), pa.array(hashes, pa.binary()),
             pa.array(digests, pa.string())],
            names=["depth", "hash", "ends_sha256"],
        )

    for batch in batches:
        for depth, hash_, piece in zip(
            *(batch.column(x).to_pylist() for x in ("depth", "hash", "piece"))
        ):
            if (depth, hash_) == node:
                held.update(b"," + piece.encode())
                continue
            if held is not None:
                out.append((*node, held.hexdigest()))
            node, held = (depth, hash_), hashlib.sha256(piece.encode())
            if len(out) >= 1000:
                yield batch_of()
    if held is not None:
        out.append((*node, held.hexdigest()))
    if out:
        yield batch_of()


def _ends(references: DataFrame, convs: DataFrame) -> DataFrame:
    """The digest of the conversations that end at each node.

    Numbers are sorted over all tasks and joined there; what one task reads for a node is its
    joined text, piece by piece, as the digest of a text is made from front to back.
    """
    own = references.filter("ends").select("depth", "hash", "conv_id")
    short = convs.filter("own_turns <= drawn").select(
        F.col("reach").alias("depth"), F.col("head_hash").alias("hash"), "conv_id"
    )
    order = ["depth", "hash", "conv_id"]
    pieces = (
        own.unionByName(short)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(_joined, "depth long, hash binary, first long, piece string")
    )
    return (
        pieces.repartition("depth", "hash")
        .sortWithinPartitions("depth", "hash", "first")
        .select("depth", "hash", "piece")
        .mapInArrow(_digests, "depth long, hash binary, ends_sha256 string")
    )


def _owned(nodes: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their number of children; the conversations with the code points of the
    nodes they own and whether they own a childless one."""
    inner = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash")).agg(
        F.count("*").alias("n_children")
    )
    counted = nodes.join(inner, ["depth", "hash"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))
    )
    return counted, convs.join(
        counted.groupBy("conv_id").agg(
            F.sum("points").alias("owned"),
            F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        ),
        "conv_id",
        "left",
    ).na.fill(0, ["owned", "leaf"])


def prefix_trie(df: DataFrame, rules: TrieRules = TrieRules()) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations, with the totals of its subtree.

    ``df`` has conv_id, turn, role and text; other columns are not read.  Turns are in order of
    ``turn``, null first; turns that tie go by role, by the first 64 code points of the text and
    by its digest.  A null role or text is empty; rows without a conv_id belong to no
    conversation and are left out.  Turns that repeat are turns of their own.  Conversation c
    begins with the first h turns of the first conversation of its block (fewer if that has
    fewer, none if it is absent), h = crc32(c) modulo ``rules.head_turns``, then has its own
    turns after its first h.  Columns: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.  Without any conversation there is no node; the root is
    there as soon as there is one, also if all rebuilt conversations are empty.
    """
    turns = _turns(df)
    for draw in range(DRAWS):
        base = _base(draw)
        placed = _placed(turns, base)
        convs = _conversations(placed, rules)
        references = _references(placed, convs, base)
        nodes = _nodes(references)
        if not nodes.filter("NOT same").limit(1).count():
            break
    else:
        raise ValueError("different sequences of turns share a fingerprint")
    _verify_texts(turns, nodes)

    counted, weights = _owned(nodes, convs)
    counted, weights = settle(counted), settle(weights)
    top = weights.agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum("leaf").alias("leaves"),
        F.sum("rebuilt_chars").alias("all_chars"),
        F.sum("owned").alias("all_owned"),
    ).first()
    first = counted.filter("depth = 1").count()

    own = references.filter("base IS NULL").join(
        weights.select("conv_id", "rebuilt_chars", "owned", "leaf"), "conv_id"
    )
    sums = {
        "all_chars": F.sum("rebuilt_chars"), "all_owned": F.sum("owned"),
        "leaves": F.sum("leaf"),
        "least": F.min(F.struct("conv_id", "rebuilt_chars", "owned")),
    }
    again = {name: F.sum(name) for name in list(sums)[:3]} | {"least": F.min("least")}
    uses = _uses(weights, sums).groupBy("base", F.col("turns").alias("depth")).agg(
        *[value.alias(name) for name, value in again.items()]
    )
    shared = references.filter("base IS NOT NULL").join(uses, ["base", "depth"])
    alone = own.select(
        "depth", "hash", F.col("rebuilt_chars").alias("all_chars"),
        F.col("owned").alias("all_owned"), F.col("leaf").alias("leaves"),
        F.struct("conv_id", "rebuilt_chars", "owned").alias("least"),
    )
    totals = (
        alone.unionByName(shared.select(*alone.columns))
        .groupBy("depth", "hash")
        .agg(*[value.alias(name) for name, value in again.items()])
    )
    before = F.col("through") - F.col("points")
    saved = (F.col("all_chars") - F.col("n_convs") * before) - (
        F.col("all_owned") - F.col("least.owned") + F.col("least.rebuilt_chars") - before
    )
    parents = counted.select(
        (F.col("depth") + 1).alias("depth"), F.col("hash").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"),
    )
    ends = settle(_ends(references, convs))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
              "saved_tokens", "ends_sha256"]
    below = (
        counted.join(totals, ["depth", "hash"])
        .join(ends, ["depth", "hash"], "left")
        .join(parents, ["depth", "parent"], "left")
        .withColumns({
            "parent_conv_id": F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long"))
            .otherwise(F.col("parent_conv_id")),
            "n_leaves": F.col("leaves"),
            "saved_tokens": saved,
            "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING)),
        })
        .select(*result)
    )
    ended = ends.filter("depth = 0").first()
    top_row = {
        "conv_id": top["conv_id"],
        "depth": 0,
        "parent_conv_id": None,
        "n_convs": top["n_convs"],
        "n_children": first,
        "n_leaves": top["leaves"] if first else 1,
        "saved_tokens": (top["all_chars"] or 0) - (top["all_owned"] or 0),
    }
    root = weights.limit(1).select(
        *[F.lit(value).cast("long").alias(name) for name, value in top_row.items()],
        F.lit(ended["ends_sha256"] if ended else NOTHING).alias("ends_sha256"),
    )
    return below.unionByName(root)
