"""Language identification by interpolated Kneser-Ney character models.

One model per language, all kept in the same sorted arrays of n-gram keys: a row has the
probability under every language, so a position of a text costs one search for each order it
backs off through.  The language with the lowest cross-entropy per character is chosen; a text
whose cross-entropy is far above that of its language's documents is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from autoprofile.llm.common import column, nullable, settle, text_parts

ORDER = 5
SYMBOL_BITS = 12
SEPARATOR, RARE = 0, 1
UNDETERMINED = "und"
MOST_LANGUAGES = 1000
PART_BYTES = 1 << 18
#: hashes that rows are drawn by, and the labelled texts from which on some are held back
PLACES, HELD_BACK_FROM = 1 << 20, 20


@dataclass(frozen=True)
class LanguageRules:
    """``sample_chars``: code points of labelled text to learn from, for each language; the
    sample is drawn by a hash of the key, whole documents at a time.  A text is rejected beyond
    ``deviations`` standard deviations, or ``least_margin`` bits, above its language's mean
    cross-entropy, and ``short_margin`` bits over the root of its length on top of that.

    ``letters``: the most frequent letters of the sample, of all languages together, that are
    told apart, up to 4094 (five of them have to fit a key of 60 bits); rarer ones count as one
    and the same letter."""

    sample_chars: int = 4_000_000
    deviations: float = 6.0
    least_margin: float = 0.75
    short_margin: float = 18.0
    letters: int = (1 << SYMBOL_BITS) - 2

    def __post_init__(self):
        if not 1 <= self.letters <= (1 << SYMBOL_BITS) - 2:
            raise ValueError(f"letters must lie between 1 and {(1 << SYMBOL_BITS) - 2}")


LETTERS = None


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global LETTERS
    if LETTERS is None:
        LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return LETTERS


def symbols(texts: list[str | None], symbol_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, one after the other, and the text each belongs to.

    A text begins with a separator; every run of other characters than letters is one.
    """
    parts = [(" " + (t or "").lower()).encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(p) // 4 for p in parts], dtype=np.int64)
    codes = symbol_of[np.frombuffer(b"".join(parts), "<u4")]
    owner = np.repeat(np.arange(len(texts)), lengths)
    apart = codes == SEPARATOR
    again = apart[1:] & apart[:-1] & (owner[1:] == owner[:-1])
    keep = ~np.append(False, again)[: len(codes)]
    return codes[keep].astype(np.int64), owner[keep]


@dataclass
class Tables:
    """Sorted n-gram keys of one order with log2 probabilities, and context keys with log2
    back-off weights; a column for each language."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    languages: list[str]
    symbol_of: np.ndarray
    orders: list[Tables] = field(default_factory=list)
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, languages: list[str], alphabet: list[int], counts: list[dict]) -> Model:
        """``counts``: for each language the keys of its n-grams of the highest order, sorted,
        and how often each occurs."""
        known = letters()
        symbol_of = np.where(known, RARE, SEPARATOR).astype(np.uint16)
        symbol_of[alphabet] = np.arange(2, 2 + len(alphabet))
        model = cls(languages, symbol_of)
        mask = [(1 << SYMBOL_BITS * k) - 1 for k in range(ORDER + 1)]
        # the n-grams of each order: below the highest, how many symbols precede them
        levels = []
        for c in counts:
            own = {ORDER: (c["keys"], c["counts"])}
            for k in range(ORDER - 1, 0, -1):
                own[k] = np.unique(own[k + 1][0] & mask[k], return_counts=True)
            levels.append(own)
        below = None
        for k in range(1, ORDER + 1):
            grams = np.unique(np.concatenate([own[k][0] for own in levels]))
            heads = np.unique(grams >> SYMBOL_BITS)
            p = np.zeros((len(grams), len(languages)))
            weight = np.ones((len(heads), len(languages)))
            for j, own in enumerate(levels):
                keys, number = own[k]
                once, twice = np.sum(number == 1), np.sum(number == 2)
                discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
                context, at = np.unique(keys >> SYMBOL_BITS, return_inverse=True)
                total = np.bincount(at, number)
                place = np.searchsorted(grams, keys)
                p[place, j] = (number - discount) / total[at]
                weight[np.searchsorted(heads, context), j] = (
                    discount * np.bincount(at) / total
                )
            lower = (
                1 / (len(alphabet) + 2)
                if below is None
                else below[1][np.searchsorted(below[0], grams & mask[k - 1])]
            )
            p += weight[np.searchsorted(heads, grams >> SYMBOL_BITS)] * lower
            model.orders.append(
                Tables(grams, np.log2(p).astype("f4"), heads, np.log2(weight).astype("f4"))
            )
            below = (grams, p)
        return model

    def bits(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Information of every symbol under every language."""
        n = len(codes)
        out = np.zeros((n, len(self.languages)), dtype=np.float32)
        if not n:
            return out
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        key = np.zeros(n, dtype=np.int64)
        for back in range(ORDER):
            if back < n:
                key[back:] |= codes[: n - back] << SYMBOL_BITS * back
        left = np.arange(n)
        for k in range(ORDER, 0, -1):
            tables = self.orders[k - 1]
            tried = left[place[left] >= k - 1]
            wanted = key[tried] & ((1 << SYMBOL_BITS * k) - 1)
            at = np.minimum(np.searchsorted(tables.grams, wanted), len(tables.grams) - 1)
            found = tables.grams[at] == wanted
            out[tried[found]] -= tables.logp[at[found]]
            missed, context = tried[~found], wanted[~found] >> SYMBOL_BITS
            at = np.minimum(np.searchsorted(tables.contexts, context), len(tables.contexts) - 1)
            known = tables.contexts[at] == context
            out[missed[known]] -= tables.backoff[at[known]]
            short = left[place[left] < k - 1]
            left = np.sort(np.concatenate([missed, short]))
        out[left] += np.log2(self.symbol_count)  # a symbol that no language has
        return out

    @property
    def symbol_count(self) -> int:
        return int(self.symbol_of.max()) + 1

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol under every language, and the number of symbols scored.

        A text without letters has none.
        """
        codes, owner = symbols(texts, self.symbol_of)
        bits = self.bits(codes, owner)
        begins = np.searchsorted(owner, np.arange(len(texts)))
        scored = np.bincount(owner, minlength=len(texts)) - 1
        bits[begins] = 0  # the separator that begins a text
        sums = np.add.reduceat(bits, begins, axis=0, dtype=np.float64)
        return sums / np.maximum(1, scored)[:, None], scored

    def judge(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        """For each text: language, score, cross-entropy, and whether it is rejected."""
        if not texts:
            return [], [], [], []
        if not self.languages:
            n = len(texts)
            return [UNDETERMINED] * n, [0.0] * n, [None] * n, [True] * n
        entropy, scored = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy.min(axis=1)
        gap = np.minimum(scored, 25)[:, None] * (entropy - lowest[:, None])
        score = 1 / np.exp2(-gap).sum(axis=1)
        language, out_score, out_entropy, rejected = [], [], [], []
        for i in range(len(texts)):
            if scored[i] < 1:
                language.append(UNDETERMINED)
                out_score.append(0.0)
                out_entropy.append(None)
                rejected.append(True)
                continue
            name = self.languages[best[i]]
            limit, short = self.limits.get(name, (np.inf, 0.0))
            language.append(name)
            out_score.append(float(score[i]))
            out_entropy.append(float(lowest[i]))
            rejected.append(bool(lowest[i] > limit + short / np.sqrt(scored[i])))
        return language, out_score, out_entropy, rejected


def _alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the letters of a task."""
    counts = np.zeros(0x110000, dtype=np.int64)
    for part in text_parts(batches, "t", PART_BYTES):
        text = "".join(t for t in part["t"].to_pylist() if t).lower()
        found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        values, number = np.unique(found, return_counts=True)
        counts[values] += number
    seen = np.flatnonzero((counts > 0) & letters())
    yield pa.RecordBatch.from_arrays(
        [pa.array(seen.astype("int32")), pa.array(counts[seen])], names=["code", "n"]
    )


def _grams(symbol_of: np.ndarray):
    """Counts of the n-grams of the highest order, by language, for a part of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, "t", 8 * PART_BYTES):
            labels = np.array(part["label"].to_pylist(), dtype=object)
            for name in sorted(set(labels)):
                texts = [t for t, own in zip(part["t"].to_pylist(), labels == name, strict=True)
                         if own]
                codes, owner = symbols(texts, symbol_of)
                # a text begins after as many separators as a context is long
                begins = np.searchsorted(owner, np.arange(len(texts)))
                padded = np.insert(codes, np.repeat(begins, ORDER - 1), SEPARATOR)
                start = begins + np.arange(len(texts)) * (ORDER - 1)
                skip = np.zeros(len(padded), dtype=bool)
                for k in range(ORDER):
                    skip[start + k] = True
                key = np.zeros(len(padded), dtype=np.int64)
                for back in range(ORDER):
                    key[back:] |= padded[: len(padded) - back] << SYMBOL_BITS * back
                keys, number = np.unique(key[~skip], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keys), pa.string()), pa.array(keys),
                     pa.array(number.astype("int64"))],
                    names=["label", "key", "n"],
                )

    return count


def _place(key: Column, text: Column) -> Column:
    """Where a row's hash stands among all: by its key, by its text where that is null."""
    return F.pmod(
        F.xxhash64(F.coalesce(key.cast("string"), text), F.lit("language")), F.lit(PLACES)
    )


def _drawn(place: Column, first: float, last: float) -> Column:
    """Whether a row's hash falls between two shares of all hashes."""
    return (place >= first * PLACES) & (place < last * PLACES)


def fit(
    df: DataFrame,
    text: str = "text",
    label: str = "lang",
    key: str = "doc_id",
    rules: LanguageRules = LanguageRules(),
) -> Model:
    """Learn a model from the rows of ``df`` with a label.

    At most about ``rules.sample_chars`` code points of each language are counted, whole texts
    drawn by a hash of their key (of the text where that is null); so the model's size is
    bounded, whatever the table's.  Every label with a text that has a letter is learnt: the
    first such text by that hash is always drawn.  A language below the bound is learnt from four
    fifths of its texts, from all of them if there are fewer than ``HELD_BACK_FROM``.  A language
    with no other text to calibrate on has no limit, so no text is rejected under it.  Rows
    without label or text teach nothing; a table without any gives a model without languages.
    """
    spark = df.sparkSession
    rows = df.select(
        column(df, text).cast("string").alias("t"),
        column(df, label).cast("string").alias("label"),
        column(df, key).alias("id"),
    ).filter("t IS NOT NULL AND label IS NOT NULL")
    place = _place(F.col("id"), F.col("t"))
    sizes = rows.groupBy("label").agg(
        F.sum(F.length("t")).alias("n"),
        F.count("*").alias("texts"),
        F.min(F.when(F.col("t").rlike(r"\p{L}"), place)).alias("first"),
    )
    sizes = sizes.filter("n > 0").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shares = {}
    for r in sizes:
        most = 0.8 if r["texts"] >= HELD_BACK_FROM else 1.0
        begin = 0 if r["first"] is None else r["first"] + 1
        shares[r["label"]] = max(min(most, rules.sample_chars / r["n"]), begin / PLACES)
    if not shares:
        return Model([], np.where(letters(), RARE, SEPARATOR).astype(np.uint16))

    def part(first, last):
        chosen = F.lit(False)
        for name, share in shares.items():
            own = F.col("label") == F.lit(name)
            chosen = chosen | (own & _drawn(place, first(share), last(share)))
        return rows.filter(chosen)

    sample = settle(part(lambda s: 0, lambda s: s))
    found = sample.select("t").mapInArrow(_alphabet, "code int, n long")
    alphabet = [
        r["code"]
        for r in found.groupBy("code").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "code").limit(rules.letters).collect()
    ]
    if not alphabet:
        return Model([], np.where(letters(), RARE, SEPARATOR).astype(np.uint16))
    symbol_of = np.where(letters(), RARE, SEPARATOR).astype(np.uint16)
    symbol_of[alphabet] = np.arange(2, 2 + len(alphabet))
    grams = (
        sample.select("t", "label")
        .mapInArrow(_grams(symbol_of), "label string, key long, n long")
        .groupBy("label", "key")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names, keys, numbers = (grams[c].to_numpy() for c in ("label", "key", "n"))
    languages = sorted(set(names))
    counts = []
    for name in languages:
        own = np.flatnonzero(names == name)
        own = own[np.argsort(keys[own])]
        counts.append({"keys": keys[own], "counts": numbers[own]})
    model = Model.of(languages, alphabet, counts)

    # cross-entropies of other labelled documents of the language, for the rejection
    other = part(lambda s: s, lambda s: min(1.0, s + max(s / 4, 0.05)))
    judged = _judged(other.select("label", "t"), ["label"], model, spark)
    for r in (
        judged.filter("c1 = c0 AND c3 IS NOT NULL")
        .groupBy("c0")
        .agg(F.avg("c3").alias("mean"), F.stddev_samp("c3").alias("spread"))
        .collect()
    ):
        margin = max(rules.least_margin, rules.deviations * (r["spread"] or 0.0))
        model.limits[r["c0"]] = (r["mean"] + margin, rules.short_margin)
    return model


def _judged(
    source: DataFrame, keep: list[str], model: Model, spark: SparkSession, text: str = "t"
) -> DataFrame:
    """c0.. the kept columns, then language, score, cross-entropy, rejected."""
    shared = spark.sparkContext.broadcast(model)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in text_parts(batches, text, PART_BYTES):
            language, score, entropy, rejected = own.judge(part[text].to_pylist())
            table = pa.table(
                [*(part[c] for c in keep), pa.array(language, pa.string()),
                 pa.array(score, pa.float64()), pa.array(entropy, pa.float64()),
                 pa.array(rejected, pa.bool_())],
                names=[f"c{i}" for i in range(kept + 4)],
            )
            yield from table.to_batches(max_chunksize=1024)

    schema = nullable(source.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)],
        F.lit("").alias(f"c{kept}"), F.lit(0.0).alias(f"c{kept + 1}"),
        F.lit(0.0).alias(f"c{kept + 2}"), F.lit(True).alias(f"c{kept + 3}"),
    ))
    return source.mapInArrow(run, schema)


def identify(
    df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Columns ``keep``, then lang_pred, score, cross_entropy, rejected.

    Only the text is an input of the prediction.  A null text, a text without a letter, or a
    model without languages gives ``und`` with score 0, no cross-entropy, rejected.  Languages
    that tie are settled by name.  Texts are scored whole; repeated rows give repeated results.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(
        *[column(df, c).alias(n) for n, c in zip(names, keep, strict=True)],
        column(df, text).cast("string").alias("t"),
    )
    judged = _judged(source, names, model, df.sparkSession)
    out = [*keep, "lang_pred", "score", "cross_entropy", "rejected"]
    return judged.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(out)])


def accepted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text the model does not reject, with all their columns."""
    names = [f"k{i}" for i in range(len(df.columns))]
    own = column(df, text)
    kept = [column(df, c).alias(n) for n, c in zip(names, df.columns, strict=True)]
    read = names[df.columns.index(text)]  # the text travels once, as the column it is
    if df.select(own).schema[0].dataType.typeName() != "string":
        read = "t"
        kept.append(own.cast("string").alias(read))
    source = df.select(*kept)
    judged = _judged(source, names, model, df.sparkSession, read)
    return judged.filter(~F.col(f"c{len(names) + 3}")).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)]
    )


def fold(key: Column) -> Column:
    """The third of the documents a key belongs to: crc32 of its text, modulo 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def evaluate_split(
    df: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
    rules: LanguageRules = LanguageRules(),
) -> DataFrame:
    """Learn from the folds other than 1 and judge every row: key, held_out, lang_pred, score,
    cross_entropy, rejected."""
    train = df.filter(fold(column(df, key)) != 1)
    model = fit(train, text, label, key, rules)
    judged = identify(df, model, text, (key,))
    return judged.select(
        key,
        F.coalesce(fold(F.col(f"`{key}`")) == 1, F.lit(False)).alias("held_out"),
        "lang_pred", "score", "cross_entropy", "rejected",
    )
