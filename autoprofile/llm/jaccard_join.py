"""Exact Jaccard join of word n-gram sets through a token-group matrix.

Documents with the same set are one class.  Classes are partitioned into groups of similar sets
by a min-hash.  The matrix holds, for every token, the groups whose token union has it; only the
rarest tokens of a set (enough of them that two linked sets must share one) enter it.  How many
of these a set shares with a group bounds its overlap with any member; only groups whose bound
reaches the threshold are opened, and there every pair is checked on the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autoprofile.llm.common import column, ranges, settle, text_parts
from autoprofile.llm.components import components

PART_BYTES = 8 << 20
#: distinct words whose hashes a task keeps before it starts anew
MOST_WORDS = 400_000
#: token frequencies are counted by the first COUNT_BITS bits of the hash, in 2**SLICE_BITS
#: slices, and kept as the highest among those that share the first LEVEL_BITS bits
COUNT_BITS, SLICE_BITS, LEVEL_BITS = 30, 8, 25
#: tokens that a task gathers before it writes their places down
GATHERED = 4 << 20
#: tokens of the matrix that one task works on, and the fewest buckets they are dealt to
BUCKET_TOKENS, LEAST_BUCKETS = 1 << 20, 64
#: what one opened block of a group holds: members, and tokens of their sets
BLOCK_MEMBERS = 256
BLOCK_TOKENS = 1 << 20
#: sets that are compared with a block in one go
BLOCK_QUERIES = 1024
U = np.uint64
ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class JaccardRules:
    """Words to an n-gram; two sets link when ``parts`` * shared >= ``of`` * union."""

    words: int = 4
    threshold: int = 85
    whole: int = 100

    def least(self, n):
        """The smallest set that can link with a set of n tokens."""
        return -(-self.threshold * n // self.whole)

    def extra(self, n):
        """Tokens of a set that enter the matrix beyond those that any link needs; linked sets
        share as many more, so that chance hits do not open a group."""
        return 1 + n // 20

    def prefix(self, n):
        """Tokens of a set that enter the matrix: linked sets share at least one of them."""
        return n - self.least(n) + self.extra(n)


def scrambled(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ ODD[salt]) * ODD[salt - 1]
    x ^= x >> U(29)
    x *= ODD[salt - 2]
    return x ^ (x >> U(32))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """The sets of distinct word n-grams of texts, as sorted 64-bit hashes."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = WordHashes()

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.hashes) > MOST_WORDS:
            self.hashes = WordHashes()
        of = self.hashes.__getitem__
        listed = [list(map(of, (t or b"").lower().split())) for t in texts]
        lengths = np.array([len(x) for x in listed], dtype=np.int64)
        flat = np.array([h for x in listed for h in x], dtype=np.uint64)
        n = len(flat)
        if not n:
            return [flat] * len(texts)
        mixed = np.zeros(n, dtype=np.uint64)
        state = flat
        for k in range(self.words):
            if k:
                state = np.append(flat[k:], np.zeros(min(k, n), np.uint64))[:n]
            mixed += scrambled(state + U(k), k % 4)
        mixed = scrambled(mixed, 3)
        ends = np.cumsum(lengths)
        out = []
        for end, length in zip(ends.tolist(), lengths.tolist(), strict=True):
            if length >= self.words:
                found = np.sort(mixed[end - length : end - self.words + 1])
                out.append(found[np.append(True, found[1:] != found[:-1])])
            elif length:  # too short for one n-gram: the whole sequence is one
                whole = xxhash.xxh64_intdigest(flat[end - length : end].tobytes(), seed=length)
                out.append(np.array([whole], dtype=np.uint64))
            else:
                out.append(flat[:0])
        return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _summaries(sets: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Size, 128-bit digest in two halves, and min-hash of each set."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    digest = [np.zeros(len(sets), dtype=np.uint64) for _ in range(3)]
    full = np.flatnonzero(n)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begins = np.cumsum(n[full]) - n[full]
        digest[0][full] = np.add.reduceat(scrambled(flat, 0), begins)
        digest[1][full] = np.add.reduceat(scrambled(flat, 1), begins)
        digest[2][full] = np.minimum.reduceat(scrambled(flat, 2), begins)
    return n, *digest


DESCRIBED = "id long, n long, d1 long, d2 long, m long, slice int, places binary"


def _describe(rules: JaccardRules):
    """A row for each document, and the places of the task's tokens, slice by slice."""
    names = [field.split()[0] for field in DESCRIBED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(rules.words), set()
        held: list[np.ndarray] = []

        def places() -> pa.RecordBatch:
            found = np.sort(np.concatenate(held))
            held.clear()
            edges = np.arange(1, 1 << SLICE_BITS, dtype=np.uint32) << U(COUNT_BITS - SLICE_BITS)
            pieces = np.split(found, np.searchsorted(found, edges.astype(np.uint32)))
            used = [k for k, piece in enumerate(pieces) if len(piece)]
            empty = pa.nulls(len(used), pa.int64())
            return pa.RecordBatch.from_arrays(
                [empty] * 5 + [pa.array(used, pa.int32()),
                               pa.array([_packed(pieces[k]) for k in used], pa.binary())],
                names=names,
            )

        for part in text_parts(batches, "t", PART_BYTES):
            sets = shingler.sets(part["t"].cast(pa.binary()).to_pylist())
            n, one, two, least = _summaries(sets)
            for i, name in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if n[i] and name not in seen:
                    seen.add(name)
                    held.append((sets[i] >> U(64 - COUNT_BITS)).astype(np.uint32))
            yield from pa.table(
                [part["id"], pa.array(n), _signed(one), _signed(two), _signed(least),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
                names=names,
            ).to_batches()
            if sum(map(len, held)) >= GATHERED:
                yield places()
        if held:
            yield places()

    return run


def _packed(ordered: np.ndarray) -> bytes:
    """Numbers in order as their steps, in as many bytes as the largest step needs."""
    steps = np.diff(ordered, prepend=ordered[:1])
    kind = "<u2" if steps.max() < 1 << 16 else "<u4"
    return ordered[:1].astype("<u4").tobytes() + kind[-1].encode() + steps.astype(kind).tobytes()


def _unpacked_steps(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, f"<u{blob[4:5].decode()}", -1, 5)
    return np.cumsum(steps, dtype=np.int64) + int(np.frombuffer(blob, "<u4", 1)[0])


def _levels_of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The levels of each slice; rows come sorted by slice and are counted one by one."""
    size = 1 << (COUNT_BITS - SLICE_BITS)

    def finished(number: int, counts: np.ndarray) -> pa.RecordBatch:
        # two steps for each power of two; what occurs in one set only is at 0
        above = np.flatnonzero(counts > 1)
        levels = np.zeros(size, dtype=np.uint8)
        levels[above] = np.minimum(60, 2 * np.log2(counts[above])).astype(np.uint8)
        highest = levels.reshape(-1, 1 << (COUNT_BITS - LEVEL_BITS)).max(axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()),
             pa.array([zlib.compress(highest.tobytes(), 1)], pa.binary())],
            names=["slice", "levels"],
        )

    number, counts = None, None
    for batch in batches:
        for own, blob in zip(
            batch.column("slice").to_pylist(), batch.column("places").to_pylist(), strict=True
        ):
            if own != number:
                if counts is not None:
                    yield finished(number, counts)
                number, counts = own, np.zeros(size, dtype=np.int64)
            places = _unpacked_steps(blob) - number * size  # in order
            first = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            counts[places[first]] += np.diff(np.append(first, len(places)))
    if counts is not None:
        yield finished(number, counts)


def frequency_levels(described: DataFrame) -> np.ndarray:
    """How frequent a token is by the first bits of its hash: 0 for once, two steps for each
    power of two.

    The table has a fixed size, whatever the input's.  It only decides the order of tokens: any
    order gives the same links, a good one keeps frequent tokens out of the matrix.
    """
    merged = (
        described.filter("slice IS NOT NULL")
        .select("slice", "places")
        .repartition("slice")
        .sortWithinPartitions("slice")
        .mapInArrow(_levels_of_slices, "slice int, levels binary")
        .collect()
    )
    levels = np.zeros(1 << LEVEL_BITS, dtype=np.uint8)
    size = 1 << (LEVEL_BITS - SLICE_BITS)
    for row in merged:
        start = row["slice"] * size
        levels[start : start + size] = np.frombuffer(zlib.decompress(row["levels"]), np.uint8)
    return levels


def _matrix_rows(rules: JaccardRules, shared, buckets: int):
    """The rarest tokens of every set, packed by bucket of the token."""
    shift = U(64 - LEVEL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(rules.words), set()
        levels = shared.value
        for part in text_parts(batches, "t", PART_BYTES):
            sets = shingler.sets(part["t"].cast(pa.binary()).to_pylist())
            n, one, two, least = _summaries(sets)
            tokens, rows = [], []
            for i, name in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if n[i] and name not in seen:
                    seen.add(name)
                    own = sets[i]
                    level = levels[(own >> shift).astype(np.int64)].astype(np.uint64)
                    order = np.argsort(level << U(58) | own >> U(6), kind="stable")
                    tokens.append(own[order[: rules.prefix(len(own))]])
                    rows.append(i)
            if not rows:
                continue
            rows = np.array(rows)
            lengths = np.array([len(x) for x in tokens])
            flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(rows)), lengths)
            place = (scrambled(flat, 3) % U(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            names, starts = np.unique(place[order], return_index=True)
            blobs = []
            for piece in np.split(order, starts[1:]):
                used, at = np.unique(owner[piece], return_inverse=True)
                own = rows[used]
                blobs.append(b"".join([
                    np.array([len(piece), len(own)], "<i8").tobytes(), flat[piece].tobytes(),
                    at.astype("<i4").tobytes(), one[own].tobytes(), two[own].tobytes(),
                    least[own].tobytes(), n[own].tobytes(),
                ]))
            for k in range(0, len(names), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[k : k + 64]), pa.array(blobs[k : k + 64], pa.binary())],
                    names=["bucket", "rows"],
                )

    return run


def _unpacked(blob: bytes) -> tuple[np.ndarray, ...]:
    tokens, sets = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    out, at = [], 16
    for kind, count in (("<u8", tokens), ("<i4", tokens), *[("<u8", sets)] * 3, ("<i8", sets)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def _overlaps(bucket: pa.Table) -> pa.Table:
    """For the tokens of a bucket: how many each set shares with each group, a row for each set.

    Of its own group only tokens count that another member has as well.
    """
    parts = [_unpacked(x) for x in bucket["rows"].to_pylist()]
    offset = np.cumsum([0, *[len(p[2]) for p in parts]])
    token = np.concatenate([p[0] for p in parts])
    owner = np.concatenate([p[1] + o for p, o in zip(parts, offset, strict=False)])
    one, two, group, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4, 5))
    # sets that several tasks met are one
    order = np.lexsort((two, one))
    new = np.append(True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
    number = np.empty(len(one), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    one, two, group, n = one[first], two[first], group[first], n[first]
    owner = number[owner]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    keep = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1]))
    token, owner = token[keep], owner[keep]
    groups, of = np.unique(group, return_inverse=True)
    # the matrix: distinct (token, group)
    line = np.cumsum(np.append(True, token[1:] != token[:-1])) - 1
    cells, sharing = np.unique(line * len(groups) + of[owner], return_counts=True)
    cell_line, cell_group = cells // len(groups), cells % len(groups)
    begin = np.searchsorted(cell_line, np.arange(line[-1] + 1))
    width = np.diff(np.append(begin, len(cells)))
    crowd = np.bincount(line)
    asked = np.flatnonzero(crowd[line] > 1)
    found = []
    reach = np.cumsum(width[line[asked]])
    for start in range(0, int(reach[-1]) if len(reach) else 0, 1 << 22):
        lot = asked[np.searchsorted(reach, start, "right") if start else 0 :
                    np.searchsorted(reach, start + (1 << 22), "right")]
        at = ranges(begin[line[lot]], width[line[lot]])
        who = np.repeat(owner[lot], width[line[lot]])
        other = (cell_group[at] != of[who]) | (sharing[at] > 1)
        found.append(np.unique(who[other] * len(groups) + cell_group[at][other],
                               return_counts=True))
    pairs = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    hits = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    order = np.argsort(pairs, kind="stable")
    who, met, hits = pairs[order] // len(groups), pairs[order] % len(groups), hits[order]
    sets, starts = np.unique(who, return_index=True)
    ends = np.append(starts, len(who))[1:]
    blobs = [
        groups[met[i:j]].astype("<u8").tobytes() + hits[i:j].astype("<u8").tobytes()
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True)
    ]
    return pa.table(
        [_signed(one[sets]), _signed(two[sets]), pa.array(n[sets]), pa.array(blobs, pa.binary())],
        names=["d1", "d2", "n", "shared"],
    )


def _sums_of_sets(rules: JaccardRules):
    """What a set shares with each group over all buckets; rows come sorted by set.

    Groups that share too little for a link with a set of any size are left out here.
    """

    def summed(name: tuple[int, int, int], blobs: list[bytes]) -> pa.RecordBatch:
        both = [np.frombuffer(b, "<u8").reshape(2, -1) for b in blobs]
        groups, at = np.unique(np.concatenate([x[0] for x in both]), return_inverse=True)
        hits = np.bincount(at, np.concatenate([x[1] for x in both])).astype(np.int64)
        n = name[2]
        fewest = -(-(n + rules.least(n)) * rules.threshold // (rules.whole + rules.threshold))
        keep = hits >= fewest - rules.least(n) + rules.extra(n) - 1
        count = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([v] * count, pa.int64()) for v in name]
            + [_signed(groups[keep]), pa.array(hits[keep])],
            names=["d1", "d2", "n", "g", "hits"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("d1", "d2", "n", "shared")]
            for *own, blob in zip(*columns, strict=True):
                if tuple(own) != name and held:
                    yield summed(name, held)
                    held = []
                name = tuple(own)
                held.append(blob)
        if held:
            yield summed(name, held)

    return run


def _links(sets: list[np.ndarray], ids: list[int], copies: np.ndarray, member: np.ndarray,
           query: np.ndarray, rules: JaccardRules) -> tuple[np.ndarray, np.ndarray]:
    """The first row linked with each row within a block, and each row's linked documents."""
    n = np.array([len(s) for s in sets])
    ids = np.array(ids)
    members = np.flatnonzero(member)
    if not len(members):  # the hash left this block empty
        return np.arange(len(sets)), np.zeros(len(sets), dtype=np.int64)
    token = np.concatenate([sets[i] for i in members])
    owner = np.repeat(np.arange(len(members)), n[members])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    label = np.arange(len(sets))
    links = np.zeros(len(sets), dtype=np.int64)
    for q in np.flatnonzero(query):
        low = np.searchsorted(token, sets[q], "left")
        wide = np.searchsorted(token, sets[q], "right") - low
        shared = np.bincount(owner[ranges(low, wide)], minlength=len(members))
        near = shared * rules.whole >= (n[q] + n[members] - shared) * rules.threshold
        # each pair once: asked by the larger set, or the larger id of two equal sizes
        near &= (n[members] < n[q]) | ((n[members] == n[q]) & (ids[members] < ids[q]))
        linked = members[near]
        if len(linked):
            links[q] += copies[linked].sum()
            links[linked] += copies[q]
            joined = np.unique(np.append(label[linked], label[q]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    return label, links


def _open(rules: JaccardRules):
    """Check all pairs of the opened blocks; rows come sorted by block."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        shingler = Shingler(rules.words)
        by_id: dict[int, list] = {}
        texts = shingler.sets([r[6] for r in rows])
        digests = _summaries(texts)[1].view(np.int64).tolist()
        for r, found, digest in zip(rows, texts, digests, strict=True):
            if digest == r[1]:  # else another row with the key of the class
                own = by_id.setdefault(r[0], [found, r[2], False, False])
                own[2] |= r[3]
                own[3] |= r[4]
        ids = list(by_id)
        sets, copies, member, query = (list(x) for x in zip(*by_id.values(), strict=True))
        label, links = _links(
            sets, ids, np.array(copies), np.array(member), np.array(query), rules
        )
        smallest: dict[int, int] = {}
        for i, own in enumerate(label.tolist()):
            smallest[own] = min(smallest.get(own, ids[i]), ids[i])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()),
             pa.array([smallest[own] for own in label.tolist()], pa.int64()), pa.array(links)],
            names=["a", "b", "links"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for batch in batches:
            columns = [batch.column(c) for c in
                       ("c", "d1", "copies", "member", "query", "block", "t")]
            columns[-1] = columns[-1].cast(pa.binary())
            for row in zip(*[c.to_pylist() for c in columns], strict=True):
                if row[5] != name and held:
                    yield block(held)
                    held = []
                name = row[5]
                held.append(row)
        if held:
            yield block(held)

    return run


def jaccard_join(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: JaccardRules = JaccardRules()
) -> DataFrame:
    """One row per row of ``df``: key, n_shingles, component_id, n_links.

    Words are what ``[\\x20\\x09-\\x0D]`` separates, A-Z in lower case; a text of fewer words than
    an n-gram is one whole.  ``component_id`` is the smallest key reachable by links, the row's
    own included; ``n_links`` the number of other rows it links with directly.  Null, empty and
    blank texts have empty sets, which link with nothing.  Rows without a key link with nothing
    and have no component.  Keys are integers; rows that repeat a key are rows of their own.
    """
    spark = df.sparkSession
    source = df.select(
        column(df, key).cast("long").alias("id"), column(df, text).cast("string").alias("t")
    )
    described = settle(source.mapInArrow(_describe(rules), DESCRIBED))
    rows = described.filter("slice IS NULL").select("id", "n", "d1", "d2", "m")
    classes = settle(
        rows.filter("n > 0 AND id IS NOT NULL")
        .groupBy("d1", "d2")
        .agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("m").alias("g"),
             F.count("*").alias("copies"))
        .withColumn("c", F.monotonically_increasing_id())  # two classes may share a key
    )
    groups = settle(
        classes.groupBy("g").agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("tokens"),
            F.count("*").alias("members"),
        )
    )

    # which groups can hold a set that links; that the tokens of a set beyond its prefix may
    # exceed those of a larger set by one is allowed for
    levels = spark.sparkContext.broadcast(frequency_levels(described))
    prefix = F.col("n") - _least(F.col("n"), rules) + _extra(F.col("n"))
    total = classes.agg(F.sum(prefix)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total // BUCKET_TOKENS) + 1)
    at_least = F.greatest("least", _least(F.col("n"), rules))
    shared = F.ceil(
        (F.col("n") + at_least) * F.lit(rules.threshold) / F.lit(rules.whole + rules.threshold)
    )
    opened = (
        source.mapInArrow(_matrix_rows(rules, levels, buckets), "bucket long, rows binary")
        .groupBy("bucket")
        .applyInArrow(_overlaps, "d1 long, d2 long, n long, shared binary")
        .repartition("d1", "d2")
        .sortWithinPartitions("d1", "d2")
        .mapInArrow(_sums_of_sets(rules), "d1 long, d2 long, n long, g long, hits long")
        .join(groups, "g")
        .filter((F.col("least") <= F.col("n")) & (F.col("most") >= _least(F.col("n"), rules)))
        .filter(F.col("hits") >= shared - _least(F.col("n"), rules) + _extra(F.col("n")) - 1)
        .select("d1", "d2", "g")
    )
    asked = settle(
        opened.join(classes.select("d1", "d2", "c", "rep", "n", "copies"), ["d1", "d2"])
        .select("c", "rep", "d1", "n", "copies", "g")
    )

    # cut groups into blocks of members, and the sets that ask a block into lots
    load = asked.groupBy("g").agg(F.count("*").alias("queries"))
    cuts = settle(
        groups.join(load, "g").select(
            "g",
            F.ceil(F.greatest(F.col("members") / BLOCK_MEMBERS, F.col("tokens") / BLOCK_TOKENS))
            .cast("int").alias("blocks"),
            F.ceil(F.col("queries") / BLOCK_QUERIES).cast("int").alias("lots"),
        )
    )

    def part(salt: str, count: str):
        return F.pmod(F.xxhash64("c", F.lit(salt)), F.col(count)).cast("int")

    as_query = (
        asked.join(cuts, "g")
        .withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("c", "rep", "d1", "copies", "g", "b", part("lot", "lots").alias("lot"),
                F.lit(False).alias("member"), F.lit(True).alias("query"))
    )
    as_member = (
        classes.join(cuts, "g")
        .withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        .select("c", "rep", "d1", "copies", "g", part("block", "blocks").alias("b"), "lot",
                F.lit(True).alias("member"), F.lit(False).alias("query"))
    )
    block = F.struct("g", "b", "lot", "member", "query")
    wanted = (
        as_query.union(as_member)
        .groupBy("c", "rep", "d1", "copies")
        .agg(F.collect_list(block).alias("blocks"))
    )
    checked = settle(
        source.join(wanted, F.col("id") == F.col("rep"))
        .select("c", "d1", "copies", F.explode("blocks").alias("x"), "t")
        .select("c", "d1", "copies", "x.member", "x.query",
                F.concat_ws(".", "x.g", "x.b", "x.lot").alias("block"), "t")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_open(rules), "a long, b long, links long")
    )
    found = components(checked.filter("a <> b").select("a", "b"))
    links = checked.groupBy("a").agg(F.sum("links").alias("links"))
    reached = (
        classes.join(found, F.col("c") == F.col("node"))
        .groupBy("component")
        .agg(F.min("rep").alias("least"))
    )
    named = found.join(reached, "component").select("node", "least")
    classes = settle(
        classes.join(named, F.col("c") == F.col("node"), "left")
        .join(links, F.col("c") == F.col("a"), "left")
        .select("d1", "d2", F.coalesce("least", "rep").alias("component"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    own = F.col("id").isNotNull()
    return rows.join(classes, ["d1", "d2"], "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(own, F.coalesce("component", "id")).alias("component_id"),
        F.when(own, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"),
    )


def _least(n, rules: JaccardRules):
    return F.ceil(n * rules.threshold / rules.whole)


def _extra(n):
    return F.floor(n / 20) + 1
