"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

A text is cut without losing a character: sections end at blank lines, paragraphs at line ends,
pieces at sentence ends and after every few words.  The hash of a node is that of its children's
hashes, so equal roots mean equal texts, and two trees are compared from the root down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autoprofile.llm.common import column, settle


@dataclass(frozen=True)
class TreeRules:
    """``words``: the most words of a piece; ``digits``: hex digits kept of the hash of a piece
    in the fingerprint."""

    words: int = 3
    digits: int = 6


#: cuts that keep every character: after the blank lines that end a section, after a line end
SECTION_END = r"(?<=\n[ \t\r]{0,9}\n)(?![ \t\r]*\n)"
LINE_END = r"(?<=\n)"


def _piece_end(words: int) -> str:
    """Pieces: at most so many words with the white space after each, or up to a sentence end."""
    return r"(?:\S*+(?<![.!?])\s++){0,%d}+\S*+\s*+" % (words - 1)


def leaves(text: Column, rules: TreeRules) -> Column:
    """Sections of paragraphs of pieces; all pieces, one after the other, are the text."""
    pieces = F.lit(_piece_end(rules.words))

    def paragraph(line: Column) -> Column:
        found = F.regexp_extract_all(line, pieces, F.lit(0))
        return F.filter(found, lambda piece: piece != "")

    def section(part: Column) -> Column:
        return F.transform(F.split(part, LINE_END), paragraph)

    return F.transform(F.split(text, SECTION_END), section)


def tree(text: Column, rules: TreeRules = TreeRules()) -> Column:
    """The hashes of a text: sections of paragraphs of (first and last) bytes of pieces' hashes.

    A node's full hash is SHA-256 of its children's; the tree keeps the pieces' hashes, from
    which the others follow.
    """

    def hashed(section: Column) -> Column:
        return F.transform(
            section, lambda pieces: F.transform(pieces, lambda piece: F.md5(piece))
        )

    return F.transform(leaves(text, rules), hashed)


def root(hashes: Column) -> Column:
    """The root of a tree, from the hashes of its pieces upwards."""

    def paragraph(pieces: Column) -> Column:
        return F.sha2(F.array_join(pieces, ","), 256)

    def section(paragraphs: Column) -> Column:
        return F.sha2(F.array_join(F.transform(paragraphs, paragraph), ","), 256)

    return F.sha2(F.array_join(F.transform(hashes, section), ","), 256)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(text: Column, rules: TreeRules = TreeRules()) -> Column:
    """The root in hex, then the branches: sections apart by ``/``, paragraphs by ``.``, pieces by
    ``,``, a fixed number of hex digits for each piece.  Null counts as empty."""

    def paragraph(pieces: Column) -> Column:
        return F.array_join(
            F.transform(pieces, lambda h: F.substring(h, 1, rules.digits)), ","
        )

    def section(paragraphs: Column) -> Column:
        return F.array_join(F.transform(paragraphs, paragraph), ".")

    def printed(hashes: Column) -> Column:
        branches = F.array_join(F.transform(hashes, section), "/")
        return F.concat(root(hashes), F.lit(":"), branches)

    return _once(tree(F.coalesce(text, F.lit("")), rules), printed)


def _pieces(print_: Column) -> Column:
    """The pieces' digits of a fingerprint, without the tree above them."""
    flat = F.translate(F.substring_index(print_, ":", -1), "./", ",,")
    return F.filter(F.split(flat, ","), lambda piece: piece != "")


def _numbered(pieces: Column) -> Column:
    """The pieces in order, each with its number among equal ones: a multiset as a set."""

    def runs(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        begins = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

        def number(starts: Column) -> Column:
            return F.flatten(F.transform(starts, lambda start, j: F.transform(
                F.sequence(F.lit(0), F.coalesce(F.get(starts, j + 1) - 1, last) - start),
                lambda k: F.concat(F.get(ordered, start), k.cast("string")),
            )))

        return _once(begins, number)

    return F.when(F.size(pieces) > 0, _once(F.sort_array(pieces), runs)).otherwise(pieces)


def likeness(one: Column, other: Column) -> Column:
    """How much two fingerprints share, from 0 to 1; equal ones 1, without looking further.

    The pieces that both have, repeats counted, as a share of the larger of the two.
    """

    def share(both: Column) -> Column:
        a, b = both["a"], both["b"]
        most = F.greatest(F.size(a), F.size(b))
        shared = F.size(F.array_intersect(a, b)).cast("double")
        return F.when(most > 0, shared / most).otherwise(F.lit(0.0))

    a, b = (_numbered(_pieces(x)) for x in (one, other))
    pair = F.struct(a.alias("a"), b.alias("b"))
    return F.when(one == other, F.lit(1.0)).otherwise(_once(pair, share))


def changed_branches(one: Column, other: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph) of the first, from 0, whose branch
    the second does not have at that place; an empty array where the roots are equal."""
    sections = F.split(F.substring_index(one, ":", -1), "/")
    against = F.split(F.substring_index(other, ":", -1), "/")

    def in_section(branch: Column, i: Column) -> Column:
        other_branch = F.coalesce(F.get(against, i), F.lit("-"))
        theirs = F.split(other_branch, r"\.")
        places = F.transform(
            F.split(branch, r"\."),
            lambda p, j: F.when(
                ~p.eqNullSafe(F.get(theirs, j)), F.struct(i.alias("section"), j.alias("paragraph"))
            ),
        )
        return F.when(branch == other_branch, F.filter(places, lambda x: F.lit(False))).otherwise(
            F.filter(places, lambda x: x.isNotNull())
        )

    found = F.flatten(F.transform(sections, in_section))
    return F.when(one == other, F.slice(found, 1, 0)).otherwise(found)


def with_next(df: DataFrame, key: str, text: str, rules: TreeRules) -> DataFrame:
    """id, t, its fingerprint p, and next_t, next_p: text and fingerprint of the row with the
    next larger key; the first follows the last.

    Rows are dealt into ranges of the key and looked up inside their range.  The first row of a
    range, one row for each, goes to the range before as well, so nothing is sorted in one task.
    Null keys come first; rows that share a key are in the order of their texts' hashes.
    """
    spark = df.sparkSession
    rows = df.select(
        column(df, key).alias("id"),
        F.coalesce(column(df, text).cast("string"), F.lit("")).alias("t"),
    )
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = rows.select(F.col("id").cast("double").alias("x"))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = number.agg(F.percentile_approx("x", F.lit(shares), F.lit(20 * ranges))).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.lit(0)
    if cuts:
        own = F.array(*[F.lit(c) for c in cuts])
        x = F.col("id").cast("double")
        place = F.when(x.isNull(), F.lit(0)).otherwise(
            F.size(F.filter(own, lambda cut: cut <= x))
        )
    rows = rows.withColumn("range", place.cast("int"))
    # the first row of each range and the range before it; the first range's goes to the last
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", F.xxhash64("t").alias("h"))
    firsts = rows.groupBy("range").agg(F.min(order).alias("first"))
    before = Window.orderBy("range")
    last = Window.orderBy("range").rowsBetween(Window.unboundedPreceding,
                                               Window.unboundedFollowing)
    firsts = settle(
        firsts.select(
            "range", "first",
            F.coalesce(F.lag("range").over(before), F.last("range").over(last)).alias("to"),
        )
    )
    lent = (
        rows.join(F.broadcast(firsts), "range")  # a row for each range
        .filter(order == F.col("first"))
        .groupBy("to")
        .agg(F.min(F.struct("first", "t")).alias("x"))
        .select(F.col("x.first.id").alias("id"), F.col("x.t").alias("t"), F.col("to").alias("range"),
                F.lit(True).alias("lent"))
    )
    both = rows.withColumn("lent", F.lit(False)).unionByName(lent)
    both = both.withColumn("p", fingerprint(F.col("t"), rules))
    ordered = Window.partitionBy("range").orderBy(
        "lent", F.col("id").asc_nulls_first(), F.xxhash64("t"), "t"
    )
    following = {"next_t": F.lead("t").over(ordered), "next_p": F.lead("p").over(ordered)}
    return both.withColumns(following).filter("NOT lent").select(
        "id", "t", "p", "next_t", "next_p"
    )


def compare_with_edits(
    df: DataFrame, key: str = "doc_id", text: str = "text", rules: TreeRules = TreeRules()
) -> DataFrame:
    """One row per row of ``df``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text has its last quarter of code points (rounded down) replaced by the first as
    many, or all, of the next document's, in ascending order of the key; the first document
    follows the last.  A null text counts as empty; empty texts have equal fingerprints.  A
    single row is its own next document.  Other columns are not read.
    """
    rows = with_next(df, key, text, rules)
    chars = F.length("t")
    cut = F.floor(chars / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("t"), F.lit(1), chars - cut),
        F.substring(F.col("next_t"), F.lit(1), cut),
    )
    texts = rows.select("id", chars.cast("long").alias("n"), "p", edited.alias("e"), "next_p")
    printed = texts.select(
        "id", "n", F.sha2("e", 256).alias("sha"), F.col("p").alias("own"),
        fingerprint(F.col("e"), rules).alias("edited"), F.col("next_p").alias("following"),
    )
    return printed.select(
        F.col("id").alias(key),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        F.col("own").alias("fingerprint"),
        F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
