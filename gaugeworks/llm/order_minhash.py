"""Order MinHash fingerprints, in DataFrame expressions alone.

A text is cut into pieces of up to three characters, anew at every word, white space before a word with
its first piece; an edit so shifts the pieces of one word only. A text's k-mers, runs of ``K`` pieces,
are numbered by occurrence, so that a repeated k-mer counts as often as it occurs. A hash of the k-mer, from
its second occurrence on of (k-mer, number), deals them into 64 bins and orders them inside a bin. Of each bin the two smallest are selected, put back into the order they have in the text,
and hashed as a pair: one value of the fingerprint. Two texts share a value if the same k-mers are
smallest and stand in the same order, so moving text lowers the likeness, not only changing it.

Everything is a function of one row: four projections, with two sorts of an array of 64-bit numbers
that hold hash (36 bits) and position (28 bits). Nothing is shuffled, and the fingerprint has 64 values
of 32 bits at most. The likeness of two fingerprints is the number of common values over the number of
bins that either of them fills; no pair of documents is compared that the caller does not ask for.

Defined results: a null or empty text has an empty fingerprint, like another empty one (1) and unlike
any other (0); a text shorter than a k-mer is its own only k-mer; equal texts have equal fingerprints;
in a text of over 2^28 pieces positions repeat, which only blurs the order of a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeworks.functions.ordering import in_ranges
from gaugeworks.llm.registry import query
from gaugeworks.plans.bindings import table
from gaugeworks.session import prepare

#: Pieces of a k-mer.
K = 4
_PIECE = r"\s*\S{1,3}|\s+"
_PLACE_BITS = 28
_PLACE = (1 << _PLACE_BITS) - 1
_BIN_BITS = 6
_VALUE_BITS = 26


def _hash_of(x: Column) -> Column:
    return F.shiftright(x, _PLACE_BITS)


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_PLACE))


def _bin_of(x: Column) -> Column:
    return F.shiftright(x, 64 - _BIN_BITS)


def _same(a: Column, b: Column, above: int) -> Column:
    """Whether two numbers are equal above their lowest bits; null if one is."""
    return F.shiftright(a.bitwiseXOR(b), above) == 0


def _packed(h: Column, place: Column) -> Column:
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(_place_of(place.cast("long")))


def add_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the fingerprint of a text column as ARRAY<BIGINT> of values below 2^32."""
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(_PIECE), F.lit(0))
    found = df.withColumn("__c", cut)
    size, pieces = F.size("__c"), F.col("__c")
    # pieces past the end are null and do not count
    grams = F.transform(
        F.sequence(F.lit(0), F.greatest(size - K, F.lit(0))),
        lambda i: _packed(F.xxhash64(*[F.get(pieces, i + k) for k in range(K)]), i),
    )
    # hash and place of every k-mer; equal ones stand together, in text order
    found = found.withColumn("__s", F.sort_array(F.when(size > 0, grams).otherwise(F.array().cast("array<bigint>")))).drop("__c")
    s = F.col("__s")

    def occurrence(x: Column, j: Column) -> Column:
        """How many equal k-mers stand before this one: the furthest equal one, by bisection."""

        def equal(back: Column) -> Column:
            return _same(F.get(s, j - back), x, _PLACE_BITS)

        def search(bits: int) -> Column:
            steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)])
            return F.aggregate(steps, F.lit(0), lambda d, step: F.when(equal(d + step), d + step).otherwise(d))

        # most repeated k-mers occur a few times
        return F.when(equal(F.lit(1 << 9)), search(_PLACE_BITS)).when(equal(F.lit(1 << 3)), search(9)).otherwise(search(3))

    def number(x: Column, j: Column) -> Column:
        """Most k-mers occur once, and a first one keeps its hash."""
        again = _packed(F.xxhash64(_hash_of(x), occurrence(x, j)), _place_of(x))
        return F.when(_same(F.get(s, j - 1), x, _PLACE_BITS), again).otherwise(x)

    numbered = F.transform(s, number)
    found = found.withColumn("__v", F.sort_array(numbered)).drop("__s")
    v = F.col("__v")
    smallest = F.filter(v, lambda x, j: ~F.shiftright(F.get(v, j - 2).bitwiseXOR(x), 64 - _BIN_BITS).eqNullSafe(0))
    found = found.withColumn("__w", smallest).drop("__v")
    w = F.col("__w")

    def value(x: Column, j: Column) -> Column:
        mate = F.get(w, j + 1)
        paired = F.coalesce(_bin_of(mate) == _bin_of(x), F.lit(False))
        ahead = ~paired | (_place_of(x) < _place_of(mate))
        first = F.when(ahead, x).otherwise(mate)
        second = F.when(paired, F.when(ahead, mate).otherwise(x))
        pair = F.xxhash64(_hash_of(first), _hash_of(second)).bitwiseAND(F.lit((1 << _VALUE_BITS) - 1))
        number = F.shiftleft(_bin_of(x).bitwiseAND(F.lit((1 << _BIN_BITS) - 1)), _VALUE_BITS)
        new = (j == 0) | (_bin_of(F.get(w, j - 1)) != _bin_of(x))
        return F.when(new, number.bitwiseOR(pair))

    return found.withColumn(out, F.array_compact(F.transform(w, value))).drop("__w")


def likeness(a: Column, b: Column) -> Column:
    """Common values over filled bins; 1 for two empty fingerprints."""
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, _VALUE_BITS)), F.transform(b, lambda x: F.shiftright(x, _VALUE_BITS))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(values: Column) -> Column:
    """Eight hexadecimal digits a value."""
    return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def following(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """Add ``next``: the key of the row that follows in descending (id, key), after the last the first.

    Rows are range-partitioned by id; a partition's first row takes the last of the partition before,
    from a table of one row per partition.
    """
    parts = in_ranges(rows, [], [id_col, key]).drop("__i").withColumnRenamed("__b", "__p")
    at = Window.partitionBy("__p").orderBy(F.col(id_col).asc_nulls_first(), key)
    inside = parts.withColumn("__before", F.lag(key).over(at))
    order = F.struct(F.coalesce(F.col(id_col), F.lit(-(1 << 63))), F.col(id_col).isNotNull(), F.col(key))
    ends = parts.groupBy("__p").agg(F.max_by(key, order).alias("__last"))
    line = Window.orderBy("__p")
    whole = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("__p", F.coalesce(F.lag("__last").over(line), F.last("__last").over(whole)).alias("__around"))
    return inside.join(ends, "__p").withColumn("next", F.coalesce("__before", "__around")).drop("__p", "__before", "__around")


@query("op5_order_minhash")
def op5_order_minhash(spark, sf) -> DataFrame:
    docs = table(prepare(spark), sf, "documents")
    text = F.coalesce("text", F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    ids = docs.select("doc_id", key.alias("key"), F.length(text).cast("long").alias("n_chars")).distinct()
    ids = following(ids, "doc_id", "key")
    # a document and the one that asks for its head stand in one row: no text meets another in a join
    facts = ["doc_id", "n_chars", "copies", "text"]
    own = docs.select(key.alias("key"), "doc_id", text.alias("text"), F.lit(1).cast("long").alias("copies"))
    asks = ids.select(F.col("next").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("cut"))
    rows = own.unionByName(asks, allowMissingColumns=True).groupBy("key").agg(
        F.sum("copies").alias("copies"), *[F.first(c, ignorenulls=True).alias(c) for c in ("doc_id", "text", "to", "cut")]
    )
    rows = add_fingerprint(rows, "text", "fp").withColumn("fp", _narrow(F.col("fp"))).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 3)).cast("int"))
    # each sends the head it was asked for, with its fingerprint, and the rest of its own text to itself
    sent = F.array(
        F.struct(F.col("key"), "doc_id", "n_chars", "copies", kept.alias("text"), "fp", *_nulls(head="string", next_fp="array<int>")),
        F.struct(
            F.col("to").alias("key"), *_nulls(doc_id=docs.schema["doc_id"].dataType, n_chars="long", copies="long", text="string", fp="array<int>"),
            F.substring("text", F.lit(1), F.col("cut")).alias("head"), F.col("fp").alias("next_fp"),
        ),
    )
    met = rows.select(F.inline(sent)).groupBy("key").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in (*facts, "fp", "head", "next_fp")]
    )
    edited = met.withColumn("edited", F.concat("text", "head")).drop("text", "head")
    edited = edited.withColumns({c: _wide(F.col(c)) for c in ("fp", "next_fp")})
    made = add_fingerprint(edited, "edited", "edited_fp").withColumn("edited_sha256", F.sha2("edited", 256))
    repeated = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return made.drop("edited").withColumn("copy", repeated).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def _narrow(values: Column) -> Column:
    """Values below 2^32 as 32-bit numbers, half the bytes to shuffle."""
    return F.transform(values, lambda x: (x - F.lit(1 << 31)).cast("int"))


def _wide(values: Column) -> Column:
    return F.transform(values, lambda x: x.cast("long") + F.lit(1 << 31))


def _nulls(**columns) -> list[Column]:
    return [F.lit(None).cast(t).alias(c) for c, t in columns.items()]
