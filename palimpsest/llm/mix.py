"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots, each filled by a block of ``BLOCK`` words.  Slot ``i``
has the van der Corput point of ``i`` (its binary digits mirrored); the cumulative
targets of the sources map that point to a source.  The rank of a slot among those of
its source has a closed form (:func:`_below`), so no window runs over the schedule.
Each source's documents are put in a shuffled order by a hash; the stream of a source is
that order over and over, cut into blocks of equal words, and the slot of rank ``r``
takes block ``r``.  Slots beyond a source's target are left out, the last block ends at
the target, and a source that the schedule left a few blocks short gets closing slots.

A document's position in its source's order is a prefix sum in two levels: over buckets
of the hash, which hold about ``BUCKET_ROWS`` rows each whatever the source's size, and
within a bucket.  A source with a third of all rows is therefore many small groups.

The table of sources has a row per source; targets come from a few sums over it, and it
is broadcast only up to ``BROADCAST_SOURCES`` rows.

Defined results: a null source is a source of its own, the last one.  A null or empty
text has no words, is never taken and keeps its row.  Repeated rows are documents of
their own; equal ones are interchangeable.  An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import apart
from .scratch import table

#: Binary digits of a point; a mix has fewer slots than 2**BITS.
BITS = 40
BLOCK = 512
REPEATS = 3
BUCKET_ROWS = 1_000
WEIGHTS = (5.0, 2.0, 1.0)
BROADCAST_SOURCES = 100_000

#: Copies of a row that a task places at once.
COPIES = 10_000


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _mirrored(n: str) -> str:
    return f"cast(conv(reverse(lpad(bin({n}), {BITS}, '0')), 2, 10) as bigint)"


def _below(n: str, mirrored: str, x: str) -> str:
    """How many of the slots 0 .. n-1 have points below ``x``, both in units of 2**-BITS.

    Each set digit d of ``n`` stands for the 2**d slots that share its higher digits and
    have 0 at d.  Their points are 2**(BITS-d) apart, from the mirrored higher digits on.
    """
    step, first = f"shiftleft(1L, {BITS} - d)", f"({mirrored} & (shiftleft(1L, {BITS - 1} - d) - 1))"
    return f"aggregate(sequence(0, {BITS - 1}), 0L, (a, d) -> a + if(bit_get({n}, d) = 1, greatest(0L, least(shiftleft(1L, d), ({x} - {first} + {step} - 1) div {step})), 0L))"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, size, rows) with ``ord`` by code point (null last) and ``target`` in words.

    The words of all sources are shared out by weight; a target stops at ``repeats``
    times its source's size and the excess is shared among the others by weight, until
    none is above.  Each round is one sum over the table of sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    held = table(
        sizes.withColumn("ord", F.row_number().over(order) - 1).withColumn("w", F.element_at(kinds, (F.pmod("ord", F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", repeats * F.col("size")),
        "sources",
    )
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= level * F.col("w")
        row = held.agg(F.count_if(full), F.sum("size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if row[0] == capped or not row[3]:
            break
        capped, level = row[0], ((row[1] or 0) - (row[2] or 0)) / row[3]
    return held.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("w"))).drop("w", "cap")


class Mix:
    """The schedule of a mix and its documents' places; :meth:`pieces` joins the two.

    ``order`` names the columns whose hash puts documents in order; rows that are equal in
    them are interchangeable."""

    def __init__(self, docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK, seed: int = 0, order: tuple[str, ...] | None = None):
        spark, self.block, self.repeats = docs.sparkSession, block, repeats
        self.hash = F.xxhash64(F.lit(seed), *(_hashable(docs, c) for c in order or (id_col, source_col, text_col)))
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"), self.hash.alias("h"))
        rows = table(rows, "sizes")  # the texts are read once
        sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        held = source_targets(sizes, weights, repeats)
        before = F.sum("target").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
        held = table(held.withColumn("before", F.coalesce(before, F.lit(0.0))), "targets")
        n, words, last = held.agg(F.count(F.lit(1)), F.sum("size"), F.max(F.when(F.col("target") > 0, F.col("ord")))).first()
        self.words, self.n_slots, self.small = words or 0, -(-(words or 0) // block), n <= BROADCAST_SOURCES
        if self.n_slots >= 2**BITS:
            raise ValueError(f"a mix has fewer than 2**{BITS} slots; take larger blocks than {block} words")
        scale = 2.0**BITS / max(1, self.words)
        low = F.when(F.col("before") * scale < 2.0**BITS, (F.col("before") * scale).cast("long")).otherwise(F.lit(2**BITS))
        high = F.when(F.col("ord") >= (last or 0), F.lit(2**BITS)).otherwise(F.least(F.lit(2**BITS), ((F.col("before") + F.col("target")) * scale).cast("long")))
        self.sources = held.withColumns({"low": low, "high": high, "quota": F.floor(F.col("target") + 1e-6).cast("long")}).withColumn("blocks", F.ceil(F.col("quota") / block).cast("long"))
        self.placed = table(self._place(rows), "placed")
        self.spark = spark

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def _place(self, rows: DataFrame) -> DataFrame:
        """Every document with ``start``, its first word's position in its source's order."""
        known = self.sources.select(F.col("source").alias("s"), "ord", "quota", F.col("size").alias("source_size"), "target", F.ceil(F.col("rows") / BUCKET_ROWS).alias("n"))
        rows = rows.join(self._side(known), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("b", F.pmod("h", F.col("n"))).drop("n")
        same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m"))  # equal rows are one, however many
        words = F.sum(F.col("size") * F.col("m"))
        sums = same.groupBy("ord", "b").agg(words.alias("sum"))
        first = sums.withColumn("first", F.coalesce(F.sum("sum").over(Window.partitionBy("ord").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("ord").alias("o"), F.col("b").alias("c"), "first")
        within = words.over(Window.partitionBy("ord", "b").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
        same = same.withColumn("within", F.coalesce(within, F.lit(0)))
        same = same.join(first, (F.col("ord") == F.col("o")) & (F.col("b") == F.col("c"))).withColumn("start", F.col("first") + F.col("within")).drop("o", "c", "first", "within")
        each = lambda low, high: F.explode(F.sequence(low, high)).alias("k")
        few = same.where(F.col("m") <= COPIES).select("*", each(F.lit(0), F.col("m") - 1))
        many = same.where(F.col("m") > COPIES).select("*", F.explode(F.sequence(F.lit(0), F.col("m") - 1, F.lit(COPIES))).alias("from"))
        many = many.repartition("from", "h").select("*", each(F.col("from"), F.least(F.col("m"), F.col("from") + COPIES) - 1)).drop("from")
        return few.unionByName(many).withColumn("start", F.col("start") + F.col("k") * F.col("size")).drop("k", "m")

    def schedule(self) -> DataFrame:
        """(slot, ord, rank): which source fills each slot, and with which of its blocks."""
        slots = self.spark.range(self.n_slots).withColumnRenamed("id", "slot").withColumn("point", F.expr(_mirrored("slot")))
        ends = self.sources.where("high > low").select("ord", "low", "high", "blocks")
        if self.small:  # binary steps over the ends in a literal-sized array
            bounds = F.broadcast(ends.agg(F.array_sort(F.collect_list(F.struct("low", "high", "ord", "blocks"))).alias("ends")))
            steps = "aggregate(sequence(0, 20), named_struct('a', 0, 'b', size(ends)), (s, k) -> if(s.b - s.a <= 1, s, if(ends[(s.a + s.b) div 2].low <= point, named_struct('a', cast((s.a + s.b) div 2 as int), 'b', s.b), named_struct('a', s.a, 'b', cast((s.a + s.b) div 2 as int)))))"
            slots = slots.join(bounds).withColumn("e", F.expr(f"ends[({steps}).a]")).select("slot", "point", "e.*")
        else:  # by the digits of the point that an end's neighbours share
            cut = BITS - 20
            cells = ends.withColumn("cell", F.explode(F.sequence(F.shiftright("low", cut), F.shiftright(F.col("high") - 1, cut))))
            slots = slots.withColumn("cell", F.shiftright("point", cut)).join(cells, "cell").where("point >= low and point < high").drop("cell")
        rank = F.expr(f"{_below('slot', 'point', 'high')} - {_below('slot', 'point', 'low')}")
        slots = slots.withColumn("rank", rank).where("rank < blocks").select("slot", "ord", "rank")
        n = f"cast({self.n_slots} as bigint)"
        had = F.expr(f"{_below(n, _mirrored(n), 'high')} - {_below(n, _mirrored(n), 'low')}")
        short = self.sources.withColumn("had", F.when(F.col("high") > F.col("low"), had).otherwise(F.lit(0).cast("long"))).where("had < blocks")
        closing = short.select("ord", F.explode(F.sequence("had", F.col("blocks") - 1)).alias("rank"))
        return slots.unionByName(closing.select((F.lit(self.n_slots) + F.col("rank")).alias("slot"), "ord", "rank"))

    def pieces(self) -> DataFrame:
        """(slot, ord, start, doc_id, turn, from, words): what each slot takes of which document."""
        turn = self.placed.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.repeats - 1)))).withColumn("at", F.col("turn") * F.col("source_size") + F.col("start")).where("at < quota")
        end = F.least(F.col("at") + F.col("size"), F.col("quota"))
        cut = turn.withColumn("end", end).withColumn("rank", F.explode(F.sequence(F.expr(f"at div {self.block}"), F.expr(f"(end - 1) div {self.block}"))))
        cut = cut.select("ord", "rank", "start", "doc_id", "turn", F.greatest(F.lit(0), F.col("rank") * self.block - F.col("at")).alias("from"), (F.least("end", (F.col("rank") + 1) * self.block) - F.greatest("at", F.col("rank") * self.block)).alias("words"))
        return cut.join(self.schedule(), ["ord", "rank"]).select("slot", "ord", "start", "doc_id", "turn", "from", "words")

    def taken(self) -> DataFrame:
        """A row per document: doc_id, size, source_size, target, and the words taken."""
        got = self.pieces().groupBy(F.col("ord").alias("o"), F.col("start").alias("s")).agg(F.sum("words").alias("got"))
        found = self.placed.join(got, (F.col("ord") == F.col("o")) & (F.col("start") == F.col("s")) & (F.col("size") > 0), "left")
        return found.select("doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def _hashable(docs: DataFrame, column: str) -> Column:
    """A column as the hash function takes it: maps and variants as their JSON."""
    kind = docs.schema[column].dataType.simpleString()
    return F.to_json(f"`{column}`") if "map<" in kind or "variant" in kind else F.col(f"`{column}`")


def mix_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix in whole documents: one that begins before its source's target is reached
    is kept, once for each turn in which it does, with the columns of ``docs``.

    What the schedule takes of a source is a head of its documents' order, over some turns, so
    texts are not joined: a row per source tells the turns and the first document that the last
    turn leaves out, and each document compares its place with it where it is read.
    """
    return apart(docs, (), (), lambda d, own: _mixed(d, own(text_col), own(source_col), own(id_col), options))


def _mixed(docs: DataFrame, text_col: str, source_col: str, id_col: str, options: dict) -> DataFrame:
    columns = docs.columns
    mix = Mix(docs, text_col, source_col, id_col, order=tuple(columns), **options)
    last = mix.pieces().where("from = 0").groupBy("ord").agg(F.max(F.struct("turn", "start")).alias("last"))
    place = F.struct("b", "h", "doc_id")
    spots = mix.placed.where("size > 0").select("ord", "start", place.alias("place")).join(mix._side(last), "ord")
    inside = F.col("start") <= F.col("last.start")
    cut = spots.where(~inside).groupBy(F.col("ord").alias("o")).agg(F.min("place").alias("cut"))
    # of rows that are equal to the first one left out, some may be inside
    equal = spots.where(inside).join(mix._side(cut), (F.col("ord") == F.col("o")) & (F.col("place") == F.col("cut"))).groupBy(F.col("ord").alias("e")).agg(F.count(F.lit(1)).alias("more"))
    known = mix.sources.select(F.col("source").alias("s"), "ord", F.ceil(F.col("rows") / BUCKET_ROWS).alias("n")).join(last, "ord").join(cut, F.col("ord") == F.col("o"), "left").join(equal, F.col("ord") == F.col("e"), "left")
    known = table(known.select("s", F.col("last.turn").alias("turns"), "cut", F.col("cut").isNull().alias("whole"), F.coalesce("more", F.lit(0)).alias("more"), "n"), "cuts")
    full = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc")
    rows = docs.where(F.col(f"`{text_col}`").rlike("[^\\x20\\x09-\\x0D]")).select(full, mix.hash.alias("h"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"))
    rows = rows.join(mix._side(known), F.col("source").eqNullSafe(F.col("s"))).withColumn("b", F.pmod("h", F.col("n")))
    copies = F.col("turns") + F.when(F.col("whole") | (place < F.col("cut")), 1).otherwise(0)
    out = rows.where(copies > 0).withColumn("turn", F.explode(F.sequence(F.lit(1), copies))).select("doc")
    if known.where("more > 0").limit(1).count():
        first = F.row_number().over(Window.partitionBy("s", "h").orderBy("b"))
        tied = rows.where((F.col("more") > 0) & (place == F.col("cut"))).withColumn("r", first).where("r = 1")
        out = out.unionByName(tied.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("more")))).select("doc"))
    return out.select(*(F.col("doc").getField(c).alias(c) for c in columns))
