"""Order MinHash fingerprints (SQL functions only).

The k-mers of a text are runs of `k` words, numbered by occurrence so that repeats count. All get one 40-bit hash. Slot b
of `slots` ranks them by their distance above a mark of its own on the hash circle, takes the `depth` minimal ones, puts
these back into text order and hashes that tuple. A slot of two texts agrees only where both the chosen k-mers and their
order agree, so likeness falls with edit distance, also where words only change places. One sort by hash serves all slots,
since the slots' minimal k-mers are the next ones after each mark.

Defined results: null text counts as empty; texts with fewer words than k have one k-mer, the whole; texts without words
have the fingerprint of zeros; positions count modulo 2 ** 23 where a text has more words; null ids come first; rows that
tie on the id are ordered by their texts; the last document's next is the first, so a lone document is its own next;
empty tables give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.common import words

SLOTS, DEPTH, K = 64, 2, 5
_POS = 23
_LOW = (1 << _POS) - 1
#: Ranges of doc_id that the table is cut into for the look at the next document: this many at most.
MAX_RANGES = 4096


def signature(df: DataFrame, text: str, out: str, slots: int = SLOTS, depth: int = DEPTH, k: int = K) -> DataFrame:
    """df with the signature of column `text` as array<int> in column `out`; slots is a power of two."""
    w, s, n = F.col("__w"), F.col("__s"), F.col("__n")
    grams = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    high = lambda h: F.shiftleft(F.shiftright(h, _POS), _POS)
    packed = F.sort_array(F.transform(grams, lambda h, i: high(h).bitwiseOR(i.cast("long").bitwiseAND(F.lit(_LOW)))))
    df = df.withColumn("__w", words(F.col(text))).withColumn("__s", packed).drop("__w")
    # occurrence numbers: within a run of equal hashes the k-mers stand in text order
    runs = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.shiftright(F.get(s, i), _POS) != F.shiftright(F.get(s, i - 1), _POS)))
    df = df.withColumn("__runs", F.when(F.size(s) > 0, runs).otherwise(F.array().cast("array<int>")))
    r = F.col("__runs")
    numbered = lambda start, i: F.when(i == start, F.get(s, i)).otherwise(high(F.xxhash64(F.shiftright(F.get(s, i), _POS), i - start)).bitwiseOR(F.get(s, i).bitwiseAND(F.lit(_LOW))))
    again = F.sort_array(F.flatten(F.transform(r, lambda start, j: F.transform(F.sequence(start, F.coalesce(F.get(r, j + 1), F.size(s)) - 1), lambda i: numbered(start, i)))))
    df = df.withColumn("__items", F.when(F.size(r) == F.size(s), s).otherwise(again)).drop("__s", "__runs").withColumnRenamed("__items", "__s")
    df = df.withColumn("__n", F.size(s))
    steps = F.filter(F.array(*[F.lit(1 << j) for j in range(30, -1, -1)]), lambda p: p <= n)
    df = df.withColumn("__steps", steps)

    def slot(mark: Column) -> Column:
        first = F.aggregate(F.col("__steps"), F.lit(0), lambda at, p: F.when((at + p <= n) & (F.get(s, at + p - 1) < mark), at + p).otherwise(at))
        chosen = F.transform(F.array(*[F.lit(j) for j in range(depth)]), lambda j: F.get(s, (first + j) % n))
        in_text_order = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_LOW)), 63 - _POS).bitwiseOR(F.shiftrightunsigned(x, _POS + 1))))
        return F.xxhash64(F.transform(in_text_order, lambda x: x.bitwiseAND(F.lit((1 << (63 - _POS)) - 1)))).bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)

    marks = F.array(*[F.lit(-(1 << 63) + b * ((1 << 64) // slots)).cast("long") for b in range(slots)])
    # depth is bounded by the number of k-mers: with fewer, the circle is walked round and the same one comes again
    sig = F.when(n > 0, F.transform(F.transform(marks, slot), lambda h: h.cast("int"))).otherwise(F.array_repeat(F.lit(0), slots))
    return df.withColumn(out, sig).drop("__s", "__n", "__steps")


def as_text(sig: Column) -> Column:
    """A signature as hexadecimal digits, eight a slot."""
    return F.array_join(F.transform(sig, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """The share of slots that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.lit(float(slots))


def with_next(df: DataFrame, columns: tuple[str, ...], rows_each: int = 500, prepare=None) -> DataFrame:
    """df (doc_id, text and more) with next_<c> of the next document by ascending id, for c in columns.

    prepare: adds columns to the rows on their way to the window; done once a row, whatever the look ahead needs before.

    Ids are cut into ranges at quantiles; within a range a window looks ahead, and the first row of each range is also
    handed to the range before. Only the bounds and the least id of each range, MAX_RANGES at most, reach the driver.
    """
    spark = df.sparkSession
    ids = df.select("doc_id")
    total = ids.count()
    n = max(1, min(MAX_RANGES, total // rows_each))
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"] or [])) if n > 1 else []
    lows = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << j) for j in range(len(bounds).bit_length() - 1, -1, -1)]).cast("array<int>")
    place = F.aggregate(steps, F.lit(0), lambda at, p: F.when(F.get(lows, at + p - 1) < F.col("doc_id"), at + p).otherwise(at))
    placed = df.withColumn("__range", place.cast("int"))
    least = [(r["__range"], r["first"]) for r in ids.withColumn("__range", place.cast("int")).groupBy("__range").agg(F.min(F.struct(F.col("doc_id"))).alias("s")).select("__range", F.col("s.doc_id").alias("first")).collect()]
    least.sort()
    before = {r: least[i - 1][0] for i, (r, _) in enumerate(least)}
    prepare = prepare or (lambda x: x)
    if not least:
        return prepare(placed.drop("__range")).withColumns({f"next_{c}": F.col(c) for c in columns})
    firsts = spark.createDataFrame([(r, f, before[r]) for r, f in least], "`__range` int, first bigint, `__before` int")
    heads = placed.join(F.broadcast(firsts), "__range").where(F.col("doc_id").eqNullSafe(F.col("first")))  # MAX_RANGES rows of ids at most
    one = heads.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy(F.col("text").asc_nulls_first()))).where("__k = 1")
    extra = one.drop("__range", "__k", "first").withColumnRenamed("__before", "__range").withColumn("__extra", F.lit(1))
    both = prepare(placed.withColumn("__extra", F.lit(0)).unionByName(extra))
    by_id = Window.partitionBy("__range").orderBy("__extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    ahead = both.withColumns({f"next_{c}": F.lead(c).over(by_id) for c in columns})
    return ahead.where("__extra = 0").drop("__extra", "__range")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and likeness of each text, of its edited text and of the next document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(own, ("text", "sig"), prepare=lambda x: signature(x, "text", "sig"))
    n = F.length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, n_chars - n_chars div 2), substring(next_text, 1, n_chars div 2))")).drop("text", "next_text")
    both = signature(both, "edited", "edited_sig")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
