"""Order MinHash fingerprints in DataFrame functions only.

A text is split at white space, and between the characters of scripts without spaces; a piece of over ``LONG`` code points is split into code points. Every
window of ``K`` pieces is a k-mer, windows over either end of the text included, so a text of any number of pieces has k-mers and those of a text and of a longer
one agree where the texts do. A text of up to ``SHORT`` code points has those of its code points as well, in bins of their own, by which two such texts are
compared; any other two are compared by the pieces, which every text has. Equal k-mers of a text are numbered by occurrence. Each numbered
k-mer has a hash whose top bits choose one of ``BINS`` bins: within a bin the ``KEEP`` smallest hashes are selected, put back in the order of the text,
and hashed as a tuple. The tuples are the fingerprint: as tuples keep order, a moved passage changes it where a bag of k-mers would not.
One pass of hashing serves all bins. Arrays of longs that pack a hash with its place, in 32 bits each whatever the length of the text, are sorted as
primitives, in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

#: Pieces in a k-mer, bins (a power of two), and k-mers selected in a bin.
K, BINS, KEEP = 5, 32, 2
#: Code points in a piece at most, and in a text that has k-mers of code points as well.
LONG, SHORT = 32, 256
#: Low bits of a packed long, which hold a place in the text; the highest bit tells k-mers of code points, the others are of the hash.
PLACE = 32
_LOW, _HASH, _POINTS = (1 << PLACE) - 1, (1 << 63) - (1 << PLACE), -(1 << 63)


#: An empty array of longs whose type allows no nulls.
_NONE_SQL = "filter(array(0L), x -> false)"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the number of references."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column) -> Column:
    """Every white-space character parts two pieces, so two in a row have an empty one between them."""
    unspaced, seen = f"[{C.UNSPACED}]", f"[^{C.SPACE}]"
    # classes of many ranges are slow, and only characters from U+0E00 on need them; below, white space is in a class of eight characters
    high = (F.octet_length(text) != F.length(text)) & F.rlike(text, F.lit(r"[\x{E00}-\x{10FFFF}]"))
    mixed = F.when(F.rlike(text, F.lit(unspaced)), F.split(text, f"[{C.SPACE}]|(?<={unspaced})(?={seen})|(?<={seen})(?={unspaced})")).otherwise(F.split(text, f"[{C.SPACE}]"))
    words = F.when(high, mixed).otherwise(F.split(text, r"[ \t\n\x0B\f\r\u0085\u00A0]"))

    def cut(w: Column) -> Column:
        short = F.flatten(F.transform(w, lambda p: F.when(F.length(p) > LONG, F.split(p, "")).otherwise(F.array(p))))
        return F.when(F.exists(w, lambda p: F.length(p) > LONG), short).otherwise(w)

    return let(words, cut)


def _windows(pieces: Column, mark: int) -> Column:
    """A long for each window: bits of its hash, its place and the mark. Windows over an end have fewer pieces."""
    hashes = F.transform(pieces, lambda w: F.xxhash64(w))

    def kmers(h: Column) -> Column:
        def at(i: Column) -> Column:
            return F.xxhash64(*(F.get(h, i + j) for j in range(K)))  # null, and so left out, beyond the ends

        places = F.sequence(F.lit(1 - K), F.size(h) - 1)
        return F.transform(places, lambda i: at(i).bitwiseAND(F.lit(_HASH)).bitwiseOR(F.lit(mark)).bitwiseOR((i + (K - 1)).cast("long")))

    return let(hashes, kmers)


def _packed_kmers(text: Column) -> Column:
    """Longs of the k-mers of pieces and, in a short text, of code points. An empty text has none."""
    points = F.when(F.length(text) <= SHORT, _windows(F.split(text, ""), _POINTS)).otherwise(F.expr(_NONE_SQL))
    return F.when(F.length(text) == 0, F.expr(_NONE_SQL)).otherwise(F.concat(_windows(_pieces(text), 0), points))


def _numbered(sorted_kmers: Column) -> Column:
    """The same longs with each hash mixed with the number of equal ones before it in the text."""

    def kmer(x: Column) -> Column:
        return F.shiftright(x, PLACE)

    def mixed(x: Column, n: Column) -> Column:
        return F.xxhash64(kmer(x), n).bitwiseAND(F.lit(_HASH)).bitwiseOR(x.bitwiseAND(F.lit(_POINTS | _LOW)))

    def runs(s: Column) -> Column:
        indexes = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(indexes, lambda i: (i == 0) | (kmer(F.get(s, i)) != kmer(F.get(s, i - 1))))

        def number(st: Column) -> Column:
            whole = F.transform(st, lambda a, j: F.transform(F.slice(s, a + 1, F.coalesce(F.get(st, j + 1), F.size(s)) - a), mixed))
            return F.when(F.size(st) == F.size(s), F.transform(s, lambda x: mixed(x, F.lit(0)))).otherwise(F.flatten(whole))

        return let(starts, number)

    return F.when(F.size(sorted_kmers) == 0, sorted_kmers).otherwise(let(sorted_kmers, runs))


def _tuples(sorted_numbered: Column) -> Column:
    """The fingerprint: for every bin that is not empty, the hash of its selected k-mers in the order of the text; the bin is in the low bits."""
    beyond_bin = 64 - BINS.bit_length()  # the mark and a bin

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, beyond_bin)

    def pick(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i < KEEP) | (bin_of(x) != bin_of(F.get(s, i - KEEP))))

    def hashed(own: Column) -> Column:
        turned = F.transform(own, lambda x: F.struct(x.bitwiseAND(F.lit(_LOW)).alias("place"), F.shiftright(x, PLACE).alias("kmer")))
        return F.xxhash64(F.array_sort(turned)["kmer"]).bitwiseAND(F.lit(-2 * BINS)).bitwiseOR(bin_of(F.get(own, F.lit(0))))

    def by_bin(chosen: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(chosen) - 1), lambda i: (i == 0) | (bin_of(F.get(chosen, i)) != bin_of(F.get(chosen, i - 1))))
        return let(heads, lambda h: F.transform(h, lambda at, j: let(F.slice(chosen, at + 1, F.coalesce(F.get(h, j + 1), F.size(chosen)) - at), hashed)))

    return F.when(F.size(sorted_numbered) == 0, F.expr(_NONE_SQL)).otherwise(let(sorted_numbered, lambda s: let(pick(s), by_bin)))


def with_fingerprint(docs: DataFrame, text: Column, name: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as an array of longs, one for each bin that is not empty; null counts as empty."""
    (held,) = C.free_names(docs, f"_{name}")
    text = F.coalesce(text, F.lit(""))
    # a sort of non-null longs outside lambdas is one of primitives; each step is a column of its own so that it is computed once
    out = docs.withColumn(held, F.sort_array(_packed_kmers(text)))
    out = out.withColumn(held, F.sort_array(_numbered(F.col(held))))
    return out.withColumn(name, _tuples(F.col(held))).drop(held)


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins filled in either fingerprint that hold equal tuples; 1 for two empty texts. Bins of code points count where both texts are short, else
    those of pieces."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: v.bitwiseAND(F.lit(BINS - 1)))

    def of_points(v: Column) -> Column:
        return v.bitwiseAND(F.lit(BINS)) != 0

    def share(own: Column, other: Column) -> Column:
        filled = F.size(F.array_union(bins(own), bins(other)))
        return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, other)) / F.greatest(filled, F.lit(1)))

    by_points, by_pieces = ((F.filter(x, of_points) for x in (a, b)), (F.filter(x, lambda v: ~of_points(v)) for x in (a, b)))
    return F.when(F.exists(a, of_points) & F.exists(b, of_points), share(*by_points)).otherwise(share(*by_pieces))


def as_text(fingerprint: Column) -> Column:
    """16 hexadecimal digits for each bin that is not empty; the bin is in the last ones."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


#: Sub-ranges of a range at most, as a power of two.
_SUB = 20


def with_next(docs: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows, the first after the last. Rows follow by ascending ``order``, a long, nulls first; rows with
    equal ones by a hash of the first of ``carried``, then by it.

    Rows are cut into ranges of ``order`` at quantiles. A value that fills whole quantiles, and null, has a range of its own, cut by that hash, so
    no value gathers its rows in one task. Each range also gets the first row of the next one, so that a window per range sees every neighbour and each row moves
    once. Only the first row's order and hash of each range are gathered; their number follows from the shuffle partitions.
    """
    spark = docs.sparkSession
    parts = 4 * C.partitions(spark)
    tie, at, extra, first, first_tie, before = C.free_names(docs, "_tie", "_at", "_extra", "_first", "_first_tie", "_before")
    known = docs.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10 * parts).alias("cuts"), F.count_if(F.col(order).isNull()).alias("nulls"), F.count("*").alias("n")).first()
    cuts = known["cuts"] or []
    shares = {x: cuts.count(x) + 1 for x in set(cuts) if cuts.count(x) > 1}  # quantiles that one value fills
    bounds = sorted({*cuts, *(x + 1 for x in shares if x + 1 < 1 << 63)})
    array = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.expr(_NONE_SQL)
    pieces = F.lit(1)
    if shares:
        pieces = F.coalesce(F.create_map(*(F.lit(y).cast("long") for x in shares.items() for y in x))[F.col(order)], F.lit(1))
    pieces = F.when(F.col(order).isNull(), max(1, -(-parts * known["nulls"] // max(1, known["n"])))).otherwise(pieces)
    sub = F.least(F.floor((F.col(tie) / F.lit(2.0**64) + 0.5) * pieces), pieces - 1)  # rises with the hash
    place = F.when(F.col(order).isNull(), 0).otherwise(1 + F.size(F.filter(array, lambda x: x <= F.col(order))))
    ranged = docs.withColumn(tie, F.xxhash64(carried[0])).withColumn(at, (F.shiftleft(place.cast("long"), _SUB) + sub).cast("long"))
    lead = F.min(F.struct(F.col(order).isNotNull().alias("told"), F.col(order).alias("value"), F.col(tie).alias("tie")))
    heads = sorted(ranged.groupBy(at).agg(lead.alias("lead")).collect(), key=lambda r: r[at])
    # the row that leads a range also closes the range before it; the very first row closes the last range
    closes = [(r[at], r["lead"]["value"], r["lead"]["tie"], heads[k - 1][at]) for k, r in enumerate(heads)]
    table = spark.createDataFrame(closes, f"`{at}` long, `{first}` long, `{first_tie}` long, `{before}` long")
    ranged = ranged.join(F.broadcast(table), at, "left")  # one row per range
    leads = F.col(order).eqNullSafe(F.col(first)) & (F.col(tie) == F.col(first_tie))
    copies = F.array_compact(F.array(F.struct(F.col(at).alias("at"), F.lit(0).alias("extra")), F.when(leads, F.struct(F.col(before).alias("at"), F.lit(1).alias("extra")))))
    dealt = ranged.withColumn("_copy", F.explode(copies)).withColumn(at, F.col("_copy.at")).withColumn(extra, F.col("_copy.extra")).drop("_copy", first, first_tie, before)
    w = Window.partitionBy(at).orderBy(F.col(extra), F.col(order).asc_nulls_first(), F.col(tie), F.col(carried[0]).asc_nulls_first())
    for c in carried:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(w))
    return dealt.where(F.col(extra) == 0).drop(at, extra, tie)


def edited_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and their likeness to each other and to the next row's.

    The edited text replaces the last quarter of the code points by the first as many of the next row's text by ascending id, the first
    row following the last. Null texts count as empty; equal texts have equal fingerprints. Null ids come first; rows with equal ids follow
    each other by a hash of their texts. A text of any length counts whole. A table of one row follows itself; an empty table gives no rows. Other columns are not read.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    told = with_next(with_fingerprint(base, F.col("text"), "fp"), "doc_id", ["text", "fp"])
    n = F.length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    told = told.withColumn("n_chars", n).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut)))
    return with_fingerprint(told, F.col("edited"), "edited_fp")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    e = edited_pairs(C.table(spark, sf_dir, "documents"))
    return e.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
