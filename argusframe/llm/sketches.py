"""Document fingerprints as invertible Bloom lookup sketches over paragraph digests, in DataFrame functions only.

A text is cut into paragraphs at line breaks, and a line after each run of letters, digits or other character that meets a condition
on the hash of it and the two before it: one in ``PER_CUT`` on average. So cuts go with the content, at one size for texts of any length,
and an edit changes the paragraphs that it touches.

A sketch has three tables of w cells; a paragraph's digest goes into one cell of each (number, xor of digests, xor of check sums). The fingerprint is
the sketch printed, with w the power of two from half the number of paragraphs on; cell i of a sketch half as wide is
cells i and i + w/2 of it together, so sketches of texts of any lengths are compared at the width of the smaller one, and at a quarter of it.

Subtracting two sketches leaves the paragraphs in which the versions differ. Peeling takes cells that hold a single digest
and takes that digest out of its other cells, until none is left: the differing digests are recovered, and with the numbers of paragraphs
that gives the share of common ones. It is tried at the quarter width first and again at the whole width where that gets stuck. Where both do,
the texts have little in common, and the number of differing digests is estimated from the cells that stay empty. So the likeness
depends on nothing but the two fingerprints.

Cells are rows: signed digests are summed into them by hash aggregates, which work on partial sums and don't care how long a text is. All rounds of peeling
stay in the partitions that the rows of a pair were dealt to.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argusframe.llm.common import shuffle_width, store

#: Runs of a text for each cut, on average.
PER_CUT = 16
LEAST_WIDTH = 8
TABLES = 3
#: Rounds of peeling, each over the three tables in turn.
ROUNDS = 6
#: A try with a smaller share of empty cells than this is not begun: three tables can't be peeled beyond about 2.45 digests a cell, where e**-2.45 are empty.
EMPTY_SHARE = 0.09
RUN = r"(?s)\s*(?:[\p{L}&&[^\p{Lo}]]{1,64}+(?![\p{L}&&[^\p{Lo}]])|[0-9]{1,64}+(?![0-9])|.)|\s+"
LOWEST = -(1 << 63)


def paragraph_digests(text: str) -> str:
    """SQL for the distinct 64-bit digests of the paragraphs of the text column (not null)."""
    cut = f"pmod(xxhash64(ltrim(u), get(us, i - 1), get(us, i - 2)), {PER_CUT}) = 0"
    marked = rf"transform(array(regexp_extract_all({text}, r'{RUN}', 0)), us -> array_join(transform(us, (u, i) -> IF({cut}, concat(u, '\n'), u)), ''))[0]"
    return rf"array_distinct(transform(filter(split({marked}, '\n'), p -> p RLIKE r'\S'), p -> xxhash64(p)))"


def width(n: str) -> str:
    """SQL for the cells of a table in the sketch of n digests."""
    return f"CAST(greatest({LEAST_WIDTH}, power(2, ceil(log2(greatest(1, {n}) / 2)))) AS INT)"


def cells_of(key: str, w: str) -> str:
    """SQL for the three cells of a digest, numbered through the tables."""
    return f"array({', '.join(f'(xxhash64({key}, {j}) & CAST({w} - 1 AS BIGINT)) + {j} * {w}' for j in range(TABLES))})"


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Cells of rows (by, cell, n, k, c)."""
    return rows.groupBy(*by, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))


def _dealt(sets: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, cell, n, k, c) of ``sets`` (by, w, keys as structs k and s): signed digests in their three cells. A key with sign 0 is a mark and goes to cell -1."""
    keys = sets.select(*by, "w", F.explode("keys").alias("x")).select(*by, "w", "x.k", "x.s")
    cell = F.explode(F.expr(f"IF(s = 0, array(-1L), {cells_of('k', 'w')})")).alias("cell")
    return keys.select(*by, cell, F.col("s").alias("n"), F.expr("IF(s = 0, 0L, k)").alias("k"), F.expr("IF(s = 0, 0L, xxhash64(k))").alias("c"))


_MARK = "array(named_struct('k', 0L, 's', 0))"


def printed(side: str) -> str:
    """SQL for the fingerprint of the digests ``side``_n in cells of width ``side``_w: number and width, then place, number, digest and check sum
    of each cell that is not empty, in hexadecimal, as base64."""
    cell = "concat(lpad(hex(x.cell), 6, '0'), lpad(hex(x.n), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c & 4294967295), 8, '0'))"
    return f"base64(unhex(concat(lpad(hex({side}_n), 8, '0'), lpad(hex({side}_w), 8, '0'), array_join(transform(filter(cells, x -> x.side = '{side}' AND x.cell >= 0), x -> {cell}), ''))))"


def fingerprints(sets: DataFrame, row: str, sides: tuple[str, ...]) -> DataFrame:
    """(row, fingerprint of each side) of the digest columns ``sides``; rows are dealt by ``row`` and stay where they are."""
    each = sets.select(row, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("keys")) for s in sides])).alias("x")).select(row, "x.side", "x.keys")
    sized = each.select(row, "side", F.expr(width("size(keys)")).alias("w"), F.expr(f"concat({_MARK}, transform(keys, d -> named_struct('k', d, 's', 1)))").alias("keys"))
    cells = _summed(_dealt(sized, [row, "side"]), [row, "side"]).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("side", "cell", "n", "k", "c"))).alias("cells"))
    for s in sides:  # each digest is in one cell of the first table, so numbers there add up to theirs
        cells = cells.withColumn(f"{s}_n", F.expr(f"CAST(aggregate(filter(cells, x -> x.side = '{s}'), 0, (t, x) -> t + x.n) DIV {TABLES} AS INT)"))
        cells = cells.withColumn(f"{s}_w", F.expr(width(f"{s}_n")))
    return cells.select(row, *[F.expr(printed(s)).alias(s) for s in sides])


def _peel(cells: DataFrame, by: list[str]) -> DataFrame:
    """``cells`` (by, cell, n, k, c) after all rounds; the width is in the low half of ``number`` in ``by``. In a step a cell of one table that holds a
    single digest takes it out of all three and leaves it as a cell of its own below -1. A digest is in one cell of a table, so none is taken out twice."""
    w = "(number & 4294967295)"
    for step in range(ROUNDS * TABLES):
        table = step % TABLES
        own = (F.col("cell") >= F.expr(w) * table) & (F.col("cell") < F.expr(w) * (table + 1))
        single = own & (F.abs("n") == 1) & (F.xxhash64("k") == F.col("c")) & (F.expr(cells_of("k", w))[table] == F.col("cell"))
        taken = F.expr(f"transform({cells_of('k', w)}, x -> named_struct('cell', x, 'n', -n, 'k', k, 'c', c))")
        found = F.array(F.expr("named_struct('cell', -2 - (c & 9223372036854775805), 'n', n, 'k', k, 'c', c)"))
        kept = F.array(F.struct("cell", "n", "k", "c"))
        moved = cells.select(*by, F.explode(F.when(single, F.concat(kept, taken, found)).otherwise(kept)).alias("x")).select(*by, "x.*")
        cells = _summed(moved, by).filter("cell < 0 OR n <> 0 OR k <> 0 OR c <> 0")
    return cells


def _peeled(pairs: DataFrame, row: str, digests: bool = False) -> DataFrame:
    """(row, pair, try, na, nb, guess, begun, rest, found, digests) of every try of ``pairs`` (row, pair, a, b): cells that are left, and how many digests and which
    were found; rows are dealt by ``row`` and stay where they are.

    While cells are peeled a try goes by one number, which says pair, try and width, and the rest of what is known of it waits in its mark: the aggregates of
    all the rounds have few columns to group by."""
    # The sketches of both sides, each at its own width; those of b count backwards.
    sides = F.array(F.struct(F.col("a").alias("keys"), F.lit(1).alias("s")), F.struct(F.col("b").alias("keys"), F.lit(-1).alias("s")))
    each = pairs.select(row, "pair", F.size("a").alias("na"), F.size("b").alias("nb"), F.explode(sides).alias("x")).select(row, "pair", "na", "nb", "x.*")
    sized = each.select(row, "pair", "na", "nb", F.expr(width("size(keys)")).alias("w"), F.expr(f"concat({_MARK}, transform(keys, d -> named_struct('k', d, 's', s)))").alias("keys"))
    by = [row, "pair", "na", "nb", "w"]
    sketches = _summed(_dealt(sized, by), by).withColumnRenamed("w", "own")
    # One taken from the other, at the width of the smaller one and at a quarter of it.
    narrowest = f"least({width('na')}, {width('nb')})"
    tries = sketches.select("*", F.posexplode(F.expr(f"array(greatest({LEAST_WIDTH}, {narrowest} DIV 4), {narrowest})")).alias("try", "w"))
    folded = F.expr("IF(cell < 0, cell, (cell DIV own) * w + ((cell % own) & (w - 1)))")
    by = [row, "pair", "na", "nb", "try", "w"]
    left = _summed(tries.select(*by, folded.alias("cell"), "n", "k", "c"), by).filter("cell < 0 OR n <> 0 OR k <> 0 OR c <> 0")
    tries = left.groupBy(*by).agg(F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "n", "k", "c"))).alias("cells")).withColumn("used", F.size("cells"))
    # Digests that would leave as many cells empty: w of them leave one in e.
    guess = F.expr(f"CAST(round(-w * ln(greatest(0.5D, {TABLES} * w - used) / ({TABLES} * w))) AS INT)")
    tries = tries.withColumn("guess", F.least(F.col("na") + F.col("nb"), F.greatest(F.abs(F.col("na") - F.col("nb")), guess)))
    tries = tries.withColumn("begun", F.expr(f"used <= {1 - EMPTY_SHARE} * {TABLES} * w"))
    mark = "array(named_struct('cell', -1L, 'n', 0, 'k', shiftleft(CAST(na AS BIGINT), 32) + nb, 'c', shiftleft(CAST(guess AS BIGINT), 1) + CAST(begun AS BIGINT)))"
    number = F.expr("shiftleft(CAST(pair AS BIGINT) * 2 + try, 32) + w").alias("number")
    by = [row, "number"]
    cells = _peel(tries.select(row, number, F.explode(F.expr(f"IF(begun, concat({mark}, cells), {mark})")).alias("x")).select(*by, "x.*"), by)
    own, taken = F.col("cell") == -1, F.col("cell") < -1
    peeled = cells.groupBy(*by).agg(F.max(F.when(own, F.col("k"))).alias("sizes"), F.max(F.when(own, F.col("c"))).alias("told"), F.count_if(F.col("cell") >= 0).alias("rest"),
                                    F.count_if(taken).cast("int").alias("found"), *([F.collect_list(F.when(taken, F.struct("k", "n"))).alias("digests")] if digests else []))
    return peeled.select(row, F.expr("CAST(shiftright(number, 33) AS INT)").alias("pair"), F.expr("CAST(shiftright(number, 32) & 1 AS INT)").alias("try"), F.expr("CAST(shiftright(sizes, 32) AS INT)").alias("na"),
                         F.expr("CAST(sizes & 4294967295 AS INT)").alias("nb"), F.expr("CAST(shiftright(told, 1) AS INT)").alias("guess"), F.expr("(told & 1) = 1").alias("begun"), "rest", "found",
                         *(["digests"] if digests else []))


def recovered_digests(pairs: DataFrame, row: str) -> DataFrame:
    """(row, pair, digest, sign) of ``pairs`` (row, pair, a, b): the digests in which a and b differ, 1 where a has it; no rows for pairs that no try could peel."""
    first = _peeled(pairs, row, digests=True).filter("begun AND rest = 0").groupBy(row, "pair").agg(F.min_by("digests", "try").alias("digests"))
    return first.select(row, "pair", F.explode("digests").alias("x")).select(row, "pair", F.col("x.k").alias("digest"), F.col("x.n").alias("sign"))


def likeness(pairs: DataFrame, row: str) -> DataFrame:
    """(row, pair, near, peeled) of ``pairs`` (row, pair, a, b): common digests by all of them, 1 for two empty sets; ``peeled``: found by peeling, else estimated."""
    tries = _peeled(pairs, row)
    found = F.min(F.when(F.col("begun") & (F.col("rest") == 0), F.struct("try", "found")))["found"]
    pair = tries.groupBy(row, "pair").agg((F.max("na") + F.max("nb")).alias("n"), found.alias("found"), F.max_by("guess", "try").alias("guess")).withColumn("d", F.coalesce("found", "guess"))
    near = F.when(F.col("n") == 0, 1.0).otherwise((F.col("n") - F.col("d")).cast("double") / (F.col("n") + F.col("d")))
    return pair.select(row, "pair", near.alias("near"), F.col("found").isNotNull().alias("peeled"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``next_*`` columns of the document that follows by descending doc_id, around at the end.

    Ids are cut at quantiles into ranges, and each range also gets a copy of the first document of the
    next range; so a range is a window of its own and no global order is built in one task."""
    spark, columns = docs.sparkSession, docs.columns
    keyed = docs.withColumn("__id", F.coalesce("doc_id", F.lit(LOWEST)))
    n = 2 * shuffle_width(spark)
    cuts = keyed.agg(F.percentile_approx("__id", [k / n for k in range(1, n)], 20 * n).alias("cuts")).first().cuts or []
    splits = [float("-inf"), *sorted({float(x) for x in cuts}), float("inf")]
    if len(splits) > 2:
        keyed = Bucketizer(splits=splits, inputCol="__number", outputCol="__range").transform(keyed.withColumn("__number", F.col("__id").cast("double"))).drop("__number")
        keyed = keyed.withColumn("__range", F.col("__range").cast("int"))
    else:
        keyed = keyed.withColumn("__range", F.lit(0))
    tops = sorted((r[0], r[1]) for r in keyed.groupBy("__range").agg(F.max("__id").alias("top")).collect())  # a row for each range
    if not tops:
        return docs.select("*", *(F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in columns))
    target = {top: tops[(k + 1) % len(tops)][0] for k, (_, top) in enumerate(tops)}
    goes = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
    copies = keyed.filter(F.col("__id").isin(list(target))).withColumn("__range", goes[F.col("__id")]).withColumn("__copy", F.lit(1))
    both = keyed.withColumn("__copy", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("__range").orderBy("__copy", F.col("__id").desc(), "text")
    return both.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter("__copy = 0").select(*columns, *(f"next_{c}" for c in columns))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The edited text has the last third of the characters replaced by the first as many of the next document. A null text counts as an
    empty one, and two empty texts are alike (1); rows with one doc_id follow each other in the order of their texts; a missing doc_id comes
    last; a single document is its own next; an empty table gives an empty result; only doc_id and text are read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(texts.withColumn("own", F.expr(paragraph_digests("text")))).withColumnRenamed("next_own", "next")
    third = "CAST(floor(char_length(text) / 3) AS INT)"
    edited = pairs.withColumn("changed", F.expr(f"concat(left(text, char_length(text) - {third}), left(next_text, {third}))"))
    keyed = store(edited.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("changed"), 256).alias("edited_sha256"),
                                "own", F.expr(paragraph_digests("changed")).alias("edited"), "next"), "keyed")
    dealt = keyed.repartition("row")
    prints = fingerprints(dealt, "row", ("own", "edited")).select("row", F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"))
    both = F.array(F.struct(F.lit(0).alias("pair"), F.col("own").alias("a"), F.col("edited").alias("b")), F.struct(F.lit(1).alias("pair"), F.col("own").alias("a"), F.col("next").alias("b")))
    near = likeness(dealt.select("row", F.explode(both).alias("x")).select("row", "x.*"), "row").groupBy("row").agg(
        F.max(F.when(F.col("pair") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("pair") == 1, F.col("near"))).alias("near_next"))
    return dealt.select("row", "doc_id", "n_chars", "edited_sha256").join(prints, "row").join(near, "row").drop("row")
