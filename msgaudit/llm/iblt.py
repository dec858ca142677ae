"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of the 64-bit digests of its paragraphs (lines; a repeated
line counts once).  Its fingerprint is a table of 3 x 8 cells; a digest falls
into one cell of each third, and a cell holds the number of its digests, their
XOR and the XOR of their check hashes.  Subtracting the tables of two versions
cell by cell cancels what they share.  Peeling then takes the digests that are
alone in a cell (count 1 or -1, check hash right) out of their other cells,
until the table is empty: what was taken are the paragraphs by which the
versions differ, with the side they are from.

If a table doesn't empty, it was too small: the digests of both versions are
dealt by hash into as many tables of this size as their number needs, each is
peeled, and a table that fails again is built anew four times, then 32 times as
large, from other bits of the digests; should that fail too, the two sets are
compared as they are.  Work is linear in the number of paragraphs.

Everything is DataFrame and SQL functions; no Python runs on the executors.
Null and empty texts have one empty paragraph.  An empty table gives an empty
result.  Null ids come before all others; rows of the same id follow each other
in the order of a hash of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: log2 of the cells in a third: of fingerprints, and of the tables tried after it.
BITS, LARGER = 3, (5, 8)
ROUNDS = 10
#: Digests that one table of the second attempt expects.
PER_TABLE = 6
FIRST_ID = -(1 << 63)


def digests(text: Column) -> Column:
    """The set of paragraph digests."""
    return F.array_distinct(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p)))


def _cell(key: str, cell: str, bits: int, shift: int) -> str:
    """SQL: whether the digest falls into the cell of that number; the place comes from its own bits."""
    return (f"(shiftright({key}, cast({shift} + {bits} * ({cell} div {1 << bits}) as int)) & {(1 << bits) - 1}) "
            f"= {cell} % {1 << bits}")


def cells(keys: str, bits: int = BITS, shift: int = 0) -> str:
    """SQL: the table of an array of digests."""
    return (f"transform(sequence(0, {3 * (1 << bits) - 1}), j -> aggregate(filter({keys}, x -> {_cell('x', 'j', bits, shift)}), "
            "named_struct('n', 0L, 'k', 0L, 'c', 0L), "
            "(a, x) -> named_struct('n', a.n + 1L, 'k', a.k ^ x, 'c', a.c ^ xxhash64(x))))")


def subtract(left: str, right: str) -> str:
    """SQL: one table less another."""
    return (f"zip_with({left}, {right}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'c', p.c ^ q.c))")


def peel(table: str, bits: int = BITS, shift: int = 0, rounds: int = ROUNDS) -> str:
    """SQL: struct(cells, got) after peeling; all cells are zero if it succeeded."""
    alone = ("array_distinct(transform(filter(st.cells, c -> abs(c.n) = 1 AND c.c = xxhash64(c.k)), "
             "c -> named_struct('k', c.k, 's', c.n)))")
    without = (f"transform(st.cells, (c, j) -> aggregate(filter(p, y -> {_cell('y.k', 'j', bits, shift)}), c, "
               "(a, y) -> named_struct('n', a.n - y.s, 'k', a.k ^ y.k, 'c', a.c ^ xxhash64(y.k))))")
    return (f"aggregate(sequence(1, {rounds}), named_struct('cells', {table}, "
            "'got', cast(array() as array<struct<k:bigint,s:bigint>>)), "
            f"(st, r) -> transform(array({alone}), p -> IF(size(p) = 0, st, "
            f"named_struct('cells', {without}, 'got', concat(st.got, p))))[0])")


def _empty(peeled: str) -> Column:
    return F.expr(f"forall({peeled}.cells, c -> c.n = 0 AND c.k = 0 AND c.c = 0)")


def fingerprint(keys: str) -> Column:
    """The table as text: count, digests and check bits of every cell in use."""
    return F.expr(f"array_join(transform({cells(keys)}, c -> IF(c.n = 0, '', "
                  "concat(hex(c.n), ':', hex(c.k), ':', hex(c.c & 4294967295L)))), '.')")


def differences(pairs: DataFrame) -> DataFrame:
    """(row, a, b) -> (row, got): the digests by which the sets a and b differ.

    ``got`` holds structs (k, s), s = 1 for a digest of a only and -1 of b only.
    ``pairs`` must be a written table with a unique ``row``.
    """
    first = pairs.withColumn("t", F.expr(subtract(cells("a"), cells("b")))).withColumn("p", F.expr(peel("t")))
    first = first.withColumn("ok", _empty("p"))
    small = first.filter("ok").select("row", F.col("p.got").alias("got"))
    side = lambda c, s: F.transform(c, lambda x: F.struct(x.alias("x"), F.lit(s).alias("s")))
    dealt = (first.filter("NOT ok")
                  .withColumn("tables", F.ceil((F.size("a") + F.size("b")) / PER_TABLE))
                  .select("row", "tables", F.explode(F.concat(side("a", 1), side("b", -1))).alias("e"))
                  .groupBy("row", F.pmod(F.xxhash64("e.x", F.lit(1)), F.col("tables")).alias("part"))
                  .agg(F.collect_list(F.when(F.col("e.s") == 1, F.col("e.x"))).alias("a"),
                       F.collect_list(F.when(F.col("e.s") == -1, F.col("e.x"))).alias("b")))
    shift, out = 3 * BITS, None
    tried, level = dealt, [BITS, *LARGER]
    exact = F.expr("concat(transform(array_except(a, b), x -> named_struct('k', x, 's', 1L)), "
                   "transform(array_except(b, a), x -> named_struct('k', x, 's', -1L)))")
    for n, bits in enumerate(level):
        tried = tried.withColumn(f"t{n}", F.expr(subtract(cells("a", bits, shift), cells("b", bits, shift))) if n == 0 else
                                 F.when(~F.col(f"ok{n - 1}"), F.expr(subtract(cells("a", bits, shift), cells("b", bits, shift)))))
        tried = tried.withColumn(f"p{n}", F.when(F.col(f"t{n}").isNotNull(), F.expr(peel(f"t{n}", bits, shift, ROUNDS + 4 * n))))
        tried = tried.withColumn(f"ok{n}", F.coalesce(_empty(f"p{n}"), F.lit(True)))
        shift += 3 * bits
    for n in range(len(level)):
        got = F.when(F.col(f"ok{n}") & F.col(f"p{n}").isNotNull(), F.col(f"p{n}.got"))
        out = got if out is None else F.coalesce(out, got)
    large = tried.select("row", F.coalesce(out, exact).alias("got")).groupBy("row").agg(F.flatten(F.collect_list("got")).alias("got"))
    return small.unionByName(large)


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the value, by halving."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"), array.alias("b"), value.alias("v"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = (s["lo"] < s["hi"]) & (F.element_at(s["b"], F.least(mid, F.lit(len(bounds) - 1)) + 1) < s["v"])
        return F.struct(F.when(less, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(less | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
                        s["b"].alias("b"), s["v"].alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps + 1)), start, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``next_<col>``: the columns of the row with the next larger ``ord`` (after the last: the first).

    Rows go once, with their texts, to ranges of ``ord``; the first row of a
    range is also sent to the range before it.  The ranges' bounds and first
    values come to the driver, as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(docs.agg(F.percentile_approx("ord", shares, 10000)).first()[0] or [])) if shares else []
    keyed = docs.withColumn("range", _bucket(F.col("ord"), bounds))
    firsts = sorted(tuple(r) for r in keyed.groupBy("range").agg(F.min("ord")).collect())
    before = {low: firsts[k - 1][0] for k, (_, low) in enumerate(firsts)}
    place = lambda r, extra: F.struct(r.cast("int").alias("range"), F.lit(extra).alias("extra"))
    if before:
        lows = F.map_from_arrays(F.array(*[F.lit(k).cast("long") for k in before]), F.array(*[F.lit(v).cast("int") for v in before.values()]))
        earlier = F.try_element_at(lows, F.col("ord"))
        places = F.when(earlier.isNotNull(), F.array(place(F.col("range"), False), place(earlier, True))) \
                  .otherwise(F.array(place(F.col("range"), False)))
    else:
        places = F.array(place(F.col("range"), False))
    ordered = Window.partitionBy("p.range").orderBy("p.extra", "ord", "tie")
    out = keyed.withColumn("p", F.explode(places)).drop("range")
    return (out.withColumns({f"next_{c}": F.lead(c).over(ordered) for c in cols})
               .filter(~F.col("p.extra")).drop("p"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited version and the next text.

    The edited text has its last n // 2 code points replaced by the first as
    many (or all) of the next.  Columns: id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, and the recovered
    digests of paragraphs only here (``lost``) or only in the edited text
    (``gained``).  Likeness is the share of common paragraphs: with d recovered
    digests of sets of a and b, 1 - d / ((a + b + d) / 2).
    """
    scratch = Scratch(docs.sparkSession, "iblt")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("id"), text.alias("text"), F.coalesce(doc_id, F.lit(FIRST_ID)).alias("ord"),
                       F.xxhash64(text).alias("tie"), digests(text).alias("a"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.col("next_text").substr(F.lit(1), half))
    slim = (with_next(rows, ["text", "a"]).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
            .select(F.monotonically_increasing_id().alias("row"), "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    "a", digests(F.col("edited")).alias("e"), F.col("next_a").alias("x")))
    slim = scratch.keep(slim, "rows")
    pair = lambda c, k: slim.select((F.col("row") * 2 + k).alias("row"), "a", F.col(c).alias("b"))
    got = scratch.keep(differences(pair("e", 0).union(pair("x", 1)))
                       .select(F.shiftright("row", 1).alias("row"), (F.col("row") % 2).alias("k"), F.size("got").alias("d"),
                               F.when(F.col("row") % 2 == 0, F.col("got")).alias("got")), "differences")
    per_row = got.groupBy("row").agg(F.max(F.when(F.col("k") == 0, F.col("d"))).alias("de"),
                                     F.max(F.when(F.col("k") == 1, F.col("d"))).alias("dx"), F.first("got", True).alias("got"))
    like = lambda d, b: F.lit(1.0) - F.col(d) / ((F.size("a") + F.size(b) + F.col(d)) / 2)
    part = lambda s: F.expr(f"transform(filter(got, g -> g.s = {s}), g -> g.k)")
    return (slim.join(per_row, "row")
                .select("id", "n_chars", "edited_sha256", fingerprint("a").alias("fingerprint"),
                        fingerprint("e").alias("edited_fingerprint"), like("de", "e").alias("near_edited"),
                        like("dx", "x").alias("near_next"), part(1).alias("lost"), part(-1).alias("gained")))
