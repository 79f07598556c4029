"""One-permutation MinHash fingerprints, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carecycle.llm.storage import written

WORDS = 5  # of a shingle
BINS = 256
BITS = 4  # kept of each bin: one hexadecimal digit
ATTEMPTS = 24  # probes before an empty bin looks at all others

_BIN_BITS = BINS.bit_length() - 1
_SPACES = " \t\n\x0b\f\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of a text's shingles: lower-cased, cut at ASCII white space, ``words`` in a row.

    A text of fewer words is one shingle; a text of none has no hash.
    """
    plain = F.btrim(F.lower(text), F.lit(_SPACES))
    cut = F.transform(F.split(plain, r"[ \t\n\x0B\f\r]+"), lambda w: F.xxhash64(w))

    def all_of(h: Column) -> Column:
        many = F.transform(
            F.sequence(F.lit(0), F.size(h) - words),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]),
        )
        return F.when(F.size(h) >= words, many).otherwise(F.array(F.xxhash64(h)))

    return F.when(plain == "", F.expr("cast(array() as array<bigint>)")).otherwise(_let(cut, all_of))


def bin_minima(hashes: Column) -> Column:
    """The least hash of each bin, null where it is empty; the upper bits of a hash are its bin.

    The greatest hash that each bin can hold is added to the list, which is
    sorted once: the first of each bin's run is its least, and a bin whose
    first is the added one is empty.
    """
    low = 64 - _BIN_BITS
    last = [_signed(((b + 1) << low) - 1) for b in range(BINS)]
    ends = F.array(*[F.lit(x) for x in last])

    def firsts(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, i: (i == 0)
            | (F.shiftrightunsigned(x, low) != F.shiftrightunsigned(F.get(s, i - 1), low)),
        )

    found = _let(F.sort_array(F.concat(hashes, ends)), firsts)
    full = F.lit((1 << low) - 1)
    return F.transform(found, lambda x: F.when(x.bitwiseAND(full) != full, x))


def densified(bins: Column) -> Column:
    """Each empty bin takes the value of a full one, the first at its own random places.

    Bin i looks at places that depend on i and the attempt alone, so two texts
    whose bins are full alike borrow alike. The few that meet no full bin in
    ATTEMPTS take the full bin with the least hash of (i, bin).
    """

    def filled(b: Column) -> Column:
        def one(i: Column) -> Column:
            tries = [F.get(b, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(ATTEMPTS)]
            full = F.filter(_all_bins(), lambda j: F.get(b, j).isNotNull())
            ranked = F.transform(full, lambda j: F.struct(F.xxhash64(i, F.lit("all"), j), F.get(b, j).alias("v")))
            return F.coalesce(F.get(b, i), *tries, F.array_min(ranked)["v"])

        return F.transform(_all_bins(), one)

    return _let(bins, filled)


def _all_bins() -> Column:
    return F.sequence(F.lit(0), F.lit(BINS - 1))


def fingerprint(text: Column) -> Column:
    """A text's fingerprint: BINS hexadecimal digits, all 0 for a text without words.

    A value is hashed with its bin once more before its low bits are kept, so
    that a value which fills many bins agrees by chance in each on its own.
    """
    digits = F.transform(
        densified(bin_minima(shingle_hashes(text))),
        lambda v, i: F.when(v.isNull(), "0").otherwise(F.hex(F.xxhash64(v, i).bitwiseAND((1 << BITS) - 1))),
    )
    return F.lower(F.array_join(digits, ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1.

    Bits of different values agree by chance once in 2^BITS; the share of equal
    digits is corrected for it.
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / float(BINS) - chance) / (1 - chance)))


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(0), doc_id).alias("k2")]


def _chain(rows: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n_chars, n1, n2, copies, last): each different document with the key of the next one.

    Documents are ordered by doc_id, then by key. They are cut into ranges;
    the next document is found inside the range, and for a range's last one it
    is the first of the next range, after the last range that of the first.
    Of rows that repeat each other the last (last, copies 1) has the next
    document behind it, the others (copies of them in one row) another copy.
    """
    order = ["doc_id", "k1", "k2"]
    merged = rows.groupBy(*order).agg(F.first("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("n"))
    cut = merged.repartitionByRange(*order)
    cut = written(cut.withColumn("range", F.spark_partition_id()), "ranges")
    here = F.struct(*order)
    ranges = cut.groupBy("range").agg(F.min(here).alias("first"))  # a row for each range
    over_all = Window.orderBy("range")
    ranges = ranges.select(
        "range", F.coalesce(F.lead("first").over(over_all), F.first("first").over(over_all)).alias("after")
    )
    inside = F.lead(here).over(Window.partitionBy("range").orderBy(*order))
    found = cut.withColumn("inside", inside).join(ranges, "range")
    nxt = F.coalesce("inside", "after")
    one = F.lit(1).cast("long")
    ends = [F.struct(nxt["k1"].alias("n1"), nxt["k2"].alias("n2"), one.alias("copies"), F.lit(True).alias("last"))]
    ends += [F.struct(F.col("k1").alias("n1"), F.col("k2").alias("n2"), (F.col("n") - 1).alias("copies"), F.lit(False).alias("last"))]
    found = found.select("k1", "k2", "doc_id", "n_chars", F.inline(F.filter(F.array(*ends), lambda x: x["copies"] > 0)))
    return written(found, "chain")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n1, n2, copies, last, doc_id, n_chars, fingerprint, edited, edited_fingerprint) of every different document.

    k1 and k2 are its key, n1 and n2 that of the next document; edited is the text whose last quarter of code points, rounded down, is
    replaced by the first as many of the next document in ascending doc_id
    order (after the last one, the first; a null id comes first; equal ids
    stand in the order of a hash of their texts). Null texts count as empty.
    Rows that repeat both id and text are fingerprinted once: the next document
    of the last is that of another id or text (last is true), that of the
    others is a copy; they are a row with their number in copies, which
    ``with_likeness`` turns into rows again. Other columns are ignored; an
    empty table gives no rows.

    Only ids are put in order. Each text is shuffled once by its key, for
    itself and for the head that it lends to the document before it.
    """
    doc_id = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = _keys(doc_id, text)
    chain = _chain(docs.select(*keys, doc_id.alias("doc_id"), F.length(text).cast("long").alias("n_chars")))
    texts = docs.select(*keys, text.alias("text")).dropDuplicates(["k1", "k2"])
    # A head carries its row of the chain, so texts meet the chain and the heads in one join.
    lent = chain.select(
        F.col("k1").alias("to1"), F.col("k2").alias("to2"), F.col("n1").alias("k1"), F.col("n2").alias("k2"),
        "copies", "last", "doc_id", "n_chars", F.floor(F.col("n_chars") / 4).cast("int").alias("n_lent"),
    )
    heads = texts.join(lent, ["k1", "k2"]).select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.col("k1").alias("n1"), F.col("k2").alias("n2"),
        "copies", "last", "doc_id", "n_chars", "n_lent", F.col("text").substr(F.lit(1), F.col("n_lent")).alias("head"),
    )
    whole = texts.join(heads, ["k1", "k2"])
    kept = F.col("text").substr(F.lit(1), (F.col("n_chars") - F.col("n_lent")).cast("int"))
    return whole.select(
        "k1", "k2", "n1", "n2", "copies", "last", "doc_id", "n_chars", fingerprint(F.col("text")).alias("fingerprint"),
        F.concat(kept, "head").alias("edited"),
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))


def with_likeness(found: DataFrame) -> DataFrame:
    """A row for each document of ``fingerprints``, with near_edited and near_next; texts should be left out before."""
    found = written(found, "fingerprints")
    nxt = found.filter("last").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fingerprint").alias("next"))
    found = found.join(nxt, ["n1", "n2"])
    found = found.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
    found = found.withColumn("near_next", likeness(F.col("fingerprint"), F.col("next")))
    one_each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return found.withColumn("copies", one_each)
