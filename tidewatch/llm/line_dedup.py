"""Near-duplicate lines over a corpus by an exact set-similarity join, in DataFrame functions alone.

A line is its set of words, ordered by rarity. Two lines can only reach the threshold if they
share a word among the first of both orders (prefix filter), if the words before the first shared
one are few enough (positional filter), and if their sizes and their parity maps allow it, which
have more bits the longer a line is; what passes is verified. A line goes if any earlier line of
the corpus is similar, so equal lines collapse to their first occurrence before the join.

Most lines of a large group of near copies are settled first, against a few early lines that
share one of three keys of least hashes. Only lines left by that are looked up in the join, while
every line remains there to be found, so the result is that of the whole join.
"""

from __future__ import annotations

from functools import reduce
from operator import add
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stage

PERCENT = 75
# Words share this many counters; a word's rarity is the count of its counter on a log scale.
COUNTERS = 1 << 22
_BLOCK = 1 << 11
# Lines of a key are compared with the first of each of so many shares of them.
SALTS = 32
# Lines of more words than these have parity maps of 128 and 256 bits, others of 64.
TWO_LANES, FOUR_LANES = 40, 100
# Lines of so many words fill such maps as well: their pairs are compared by as many numbers more.
WIDE, LANES = 160, 16
# The prefix join takes the words in so many shares, whose shuffles are on disk one after the other.
SHARES = 4
# Bits by which lines that occur in no pair are told before their sets are shuffled.
MARKS = 1 << 26
_BLANKS = "[\\x20\\x09-\\x0D]+"
_LOW = 0xFFFFFFFF


def _fold(text: Column) -> Column:
    """A-Z in lower case, all else as it is.

    ``lower`` is the faster, and does just that where no other letter has a lower case: only letters and
    signs of these four kinds have one.
    """
    others = text.rlike("[\\p{Lu}\\p{Lt}\\p{Nl}\\p{So}&&[^A-Z]]")
    return F.when(others, F.translate(text, ascii_uppercase, ascii_lowercase)).otherwise(F.lower(text))


def _split(text: Column) -> Column:
    """Words with A-Z folded: runs of other than space and ASCII blanks; a blank text gives one empty word."""
    return F.split(F.btrim(_fold(text), F.lit(" \t\n\x0b\x0c\r")), _BLANKS)


def _hash(word: Column) -> Column:
    """A word as a number of 32 bits."""
    return F.xxhash64(word).bitwiseAND(F.lit(_LOW))


def _document() -> list[Column]:
    """``d`` orders documents, with null ids last; ``k`` tells texts of one id apart."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id")).alias("d")
    return [key, F.xxhash64("text").alias("k")]


def _lines(docs: DataFrame) -> DataFrame:
    """(d, k, line, text, line_a, line_b): every line with words, and a 128-bit key of its text.

    Rows that share doc_id and text are one document.
    """
    rows = docs.select(*_document(), F.split("text", "\n").alias("lines"))
    rows = rows.select("d", "k", F.posexplode("lines").alias("line", "text"))
    rows = rows.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return rows.select("*", F.xxhash64("text").alias("line_a"), F.xxhash64(F.lit(1), "text").alias("line_b"))


def _rarity(docs: DataFrame) -> Column:
    """Log-scale counts of all counters as one array, computed once per query: COUNTERS bytes."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(F.explode(_split(F.col("line"))).alias("w")).where("w <> ''")
    seen = words.groupBy((_hash(F.col("w")) % COUNTERS).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    all_counters = docs.sparkSession.range(COUNTERS).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("n"))
    counts = seen.union(all_counters).groupBy("c").agg(F.sum("n").alias("n"))
    level = F.when(F.col("n") < 2, 0).otherwise(F.least(F.lit(120), F.ceil(F.log2("n") * 3))).cast("tinyint")
    counted = stage(counts.select("c", level.alias("level")), "rarity")
    return _gathered(counted.withColumnRenamed("level", "v"))


def _gathered(values: DataFrame) -> Column:
    """``v`` of all places ``c`` from 0 as one array, put together from blocks."""
    block = F.floor(F.col("c") / _BLOCK).alias("block")
    blocks = values.groupBy(block).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("all"))
    every = blocks.agg(F.sort_array(F.collect_list(F.struct("block", F.col("all.v").alias("of")))).alias("all"))
    return every.select(F.flatten(F.col("all.of"))).scalar()


def _mark() -> Column:
    return F.xxhash64("id").bitwiseAND(F.lit(MARKS - 1))


def _marked(ids: DataFrame) -> Column:
    """Whether ``id`` is one of ``ids``, or one of the few others that fall on a bit of theirs."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (_mark() % 64).cast("int"))
    seen = ids.select(F.floor(_mark() / 64).alias("c"), bit.alias("v"))
    none = ids.sparkSession.range(MARKS // 64).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("v"))
    bits = _gathered(stage(seen.union(none).groupBy("c").agg(F.bit_or("v").alias("v")), "line-marks"))
    return F.get(bits, F.floor(_mark() / 64).cast("int")).bitwiseAND(bit) != 0


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of sets of these sizes that reaches the threshold."""
    return F.ceil((n + m) * percent / (100 + percent))


def _prefix(n: Column, percent: int) -> Column:
    """How many of a set's first words a similar set must share one of."""
    return (n - F.ceil(n * percent / 100) + 1).cast("int")


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    """One row per distinct line: line_a, line_b, the first place it occurs, its words by rarity, how many
    of the prefix occur once in the corpus, and the parity map as ``l0`` to ``l3``."""
    lines = _lines(docs).withColumn("rarity", _rarity(docs))
    level = lambda w: F.get("rarity", (w % COUNTERS).cast("int"))
    words = F.array_distinct(F.transform(_split(F.col("text")), _hash))
    ordered = F.sort_array(F.transform(words, lambda w: level(w) * F.lit(1 << 32) + w))
    lines = lines.select("d", "k", "line", "line_a", "line_b", ordered.alias("v"))
    head = F.slice("v", F.lit(1), _prefix(F.size("v"), percent))
    once = F.size(F.filter(head, lambda v: v < F.lit(1 << 32)))
    short = F.transform("v", lambda v: (v % F.lit(1 << 32) - F.lit(1 << 31)).cast("int"))
    lines = lines.select("d", "k", "line", "line_a", "line_b", once.alias("once"), short.alias("s"))
    first = F.min(F.struct("d", "k", "line")).alias("first")
    grouped = lines.groupBy("line_a", "line_b").agg(first, F.first("s").alias("s"), F.first("once").alias("once"))
    sized = grouped.select("line_a", "line_b", "first", "s", "once", F.size("s").alias("n"))
    return sized.select("*", *_map())


def _apart(n: Column, m: Column, percent: int) -> Column:
    """In how many words sets of these sizes may differ and still reach the threshold."""
    return n + m - _overlap(n, m, percent) * 2


def _place() -> Column:
    """``doc``: the document of a line's first place as one number, which orders lines of different documents."""
    return F.when(F.col("first.d.none"), F.lit(2**63 - 1)).otherwise(F.col("first.d.id")).alias("doc")


def _parity(words: Column) -> Column:
    """Bit b tells whether an odd number of words falls on b; sets differ at least where maps do."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)))
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(w)))


MAP = ("l0", "l1", "l2", "l3")


def _map() -> list[Column]:
    """The parity map of ``s``: one, two or four numbers by its size ``n``, the rest 0.

    Bits 6 and 7 of a word choose the number, so that wider maps fold to narrower ones.
    """
    n, s = F.col("n"), F.col("s")
    mask = F.when(n > FOUR_LANES, 192).otherwise(64)
    bit = lambda j, w: F.call_function("shiftleft", (w.bitwiseAND(mask) == 64 * j).cast("long"), w.bitwiseAND(F.lit(63)))
    lane = lambda j: F.aggregate(s, F.lit(0).cast("long"), lambda a, w: a.bitwiseXOR(bit(j, w)))
    lanes = [F.when(n > TWO_LANES, lane(0)).otherwise(_parity(s))]
    lanes += [F.when(n > least, lane(j)).otherwise(0) for j, least in ((1, TWO_LANES), (2, FOUR_LANES), (3, FOUR_LANES))]
    return [x.cast("long").alias(c) for c, x in zip(MAP, lanes, strict=True)]


def _differ(n: Column, m: Column, x: list[Column], y: list[Column]) -> Column:
    """In how many words sets of these sizes and maps differ at least; maps of two widths are folded to the narrower."""
    both = [a.bitwiseXOR(b) for a, b in zip(x, y, strict=True)]
    count = lambda *of: F.bit_count(reduce(Column.bitwiseXOR, of))
    width = lambda k: F.when(k > FOUR_LANES, 4).when(k > TWO_LANES, 2).otherwise(1)
    halves = count(both[0], both[2]) + count(both[1], both[3])
    whole = F.when(F.least(n, m) > TWO_LANES, halves).otherwise(count(*both))
    return F.when(width(n) == width(m), reduce(add, [count(b) for b in both])).otherwise(whole)


def _lanes(words: Column) -> list[Column]:
    """The parity map over sixteen times as many bits, in as many numbers, as very long sets fill fewer."""
    falls_on = lambda j: lambda w: w.bitwiseAND(F.lit(64 * (LANES - 1))) == 64 * j
    return [_parity(F.filter(words, falls_on(j))).alias(f"l{j}") for j in range(LANES)]


def _may_reach(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) without those of two very long lines whose widest maps differ in more bits than similar sets can."""
    lanes = [f"l{j}" for j in range(LANES)]
    maps = stage(classes.where(F.col("n") >= WIDE).select("id", "n", *_lanes(F.col("s"))), "line-maps")
    for e in "xy":
        pairs = pairs.join(maps.select(F.col("id").alias(e), *(F.col(c).alias(f"{e}{c}") for c in ("n", *lanes))), e, "left")
    differ = reduce(add, [F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in lanes])
    return pairs.where(F.coalesce(differ <= _apart(F.col("xn"), F.col("yn"), percent), F.lit(True))).select("x", "y")


def _similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (x, y) of class ids those that reach the threshold, as the id of the later one.

    Only the sets of lines that occur in a pair go into the joins.
    """
    pairs = stage(_may_reach(pairs, classes, percent), "line-pairs-near")
    met = stage(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "lines-met")
    sets = classes.select("id", "s", "first").where(_marked(met))
    sets = stage(sets.join(met, "id", "left_semi"), "line-sets")
    for e in "xy":
        ends = sets.select(F.col("id").alias(e), F.col("s").alias(f"{e}s"), F.col("first").alias(f"{e}f"))
        pairs = pairs.join(ends, e)
    shared = F.size(F.array_intersect("xs", "ys"))
    near = shared * 100 >= (F.size("xs") + F.size("ys") - shared) * percent
    later = F.when(F.col("xf") < F.col("yf"), F.col("y")).otherwise(F.col("x"))
    return pairs.where(near).select(later.alias("id")).distinct()


def _alike(percent: int) -> Column:
    """Whether the sizes and maps of the lines ``p`` and ``r`` allow them to be similar."""
    n, m = F.col("p.n"), F.col("r.n")
    differ = _differ(n, m, [F.col(f"p.{c}") for c in MAP], [F.col(f"r.{c}") for c in MAP])
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= _apart(n, m, percent))


def _settled_early(classes: DataFrame, percent: int) -> DataFrame:
    """Ids of lines found similar to an earlier one among a few that share one of three keys of least hashes.

    The few are the first lines of a key. Pairs whose parity maps differ in too many bits, and those in which
    the line at hand is the earlier one, are not verified.
    """
    least = F.slice(F.sort_array("s"), 1, 3)
    of = classes.select("id", "n", *MAP, _place(), least.alias("l"))
    key = lambda a, b: F.xxhash64(F.get("l", F.lit(a)), F.get("l", F.lit(b)))
    keys = F.when(F.size("l") > 2, F.array(key(0, 1), key(0, 2), key(1, 2))).otherwise(F.array(key(0, 1)))
    entries = of.select(F.explode(keys).alias("key"), "id", "n", *MAP, "doc")
    filled = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    salted = stage(entries.join(filled.select("key"), "key"), "line-keys")
    head = F.min(F.struct("doc", "id", "n", *MAP)).alias("head")
    heads = salted.groupBy("key", (F.xxhash64("id") % SALTS).alias("salt")).agg(head).select("key", "head.*")
    p, r = salted.alias("p"), heads.alias("r")
    may = (F.col("p.key") == F.col("r.key")) & (F.col("p.id") != F.col("r.id")) & (F.col("r.doc") <= F.col("p.doc"))
    met = p.join(r, may & _alike(percent))
    x, y = F.least("p.id", "r.id").alias("x"), F.greatest("p.id", "r.id").alias("y")
    return _similar(stage(met.select(x, y).distinct(), "line-pairs"), classes, percent)


def _joined(classes: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Ids of lines not settled that are similar to an earlier line: the prefix join. Of two lines of one document
    either may be the earlier one.

    Both sides of the join are the same entries, so they are shuffled once.
    """
    # The first words of the order, except those seen once, which no other line has.
    prefix = _prefix(F.col("n"), percent)
    head = F.slice("s", F.col("once") + 1, F.greatest(prefix - F.col("once"), F.lit(0)))
    heads = classes.select("id", "n", *MAP, _place(), "once", head.alias("head")).where(F.size("head") > 0)
    heads = heads.join(settled.withColumn("done", F.lit(True)), "id", "left")
    heads = stage(heads.withColumn("open", F.col("done").isNull()).drop("done"), "line-heads")
    entries = heads.select("id", "n", *MAP, "doc", "open", "once", F.posexplode("head").alias("i", "w"))
    entries = entries.select("id", "n", *MAP, "doc", "open", (F.col("i") + F.col("once")).alias("i"), "w")
    later = lambda a, b: F.col(f"{b}.open") & (F.col(f"{a}.doc") <= F.col(f"{b}.doc"))
    may = (
        (F.col("p.w") == F.col("r.w"))
        & (F.col("p.id") < F.col("r.id"))
        & (F.col("p.i") + F.col("r.i") <= _apart(F.col("p.n"), F.col("r.n"), percent))
        & (later("p", "r") | later("r", "p"))
        & _alike(percent)
    )
    found = []
    for share in range(SHARES):
        some = entries.where(F.pmod("w", F.lit(SHARES)) == share)
        p, r = some.alias("p"), some.alias("r")
        pairs = p.join(r, may).select(F.col("p.id").alias("x"), F.col("r.id").alias("y"))
        found.append(stage(pairs, f"line-pairs-{share}"))
    return _similar(stage(reduce(DataFrame.union, found).distinct(), "line-pairs"), classes, percent)


def repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(d, k, line) of every line to be removed: an earlier line of the corpus is similar.

    Lines are cut at line feeds; earlier means a smaller doc_id (null last), then the hash of the
    text, then the line number from 0. Sets of words (runs of other than space and ASCII blanks, A-Z
    in lower case) are similar if 100 * shared >= percent * union; lines without words stay. Rows with
    equal doc_id and text are one document and lose the same lines. Words are compared by 32-bit
    hashes (two words of a pair of 50-word lines agree by chance with probability 6e-7), lines are
    held equal by 128 bits.
    """
    docs = docs.select("doc_id", "text")
    # The ids are fixed by writing them.
    classes = stage(_classes(docs, percent).withColumn("id", F.monotonically_increasing_id()), "line-classes")
    settled = stage(_settled_early(classes, percent), "lines-settled")
    matched = stage(_joined(classes, settled, percent), "lines-matched")
    gone = settled.union(matched).distinct().withColumn("gone", F.lit(True))
    verdicts = classes.select("id", "line_a", "line_b", "first").join(gone, "id", "left").drop("id")
    placed = _lines(docs).drop("text").join(verdicts, ["line_a", "line_b"])
    later = F.struct("d", "k", "line") != F.col("first")
    return placed.where(later | F.col("gone")).select("d", "k", "line").distinct()


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_lines, removed): per row of ``docs`` (doc_id, text) its lines and the numbers, from 0 and
    ascending, of those that ``repeated_lines`` removes. Null text has no lines; empty text has one."""
    gone = repeated_lines(docs, percent).groupBy("d", "k").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_document(), count.alias("n_lines"))
    joined = rows.join(gone, ["d", "k"], "left")
    return joined.select("doc_id", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def without_repeated_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the remaining lines as ``text`` and their length as ``n_chars``, where there is such a column.

    A document that had words and loses all its lines with words is removed, as all it says was
    said before; documents without words stay as they are.
    """
    names = docs.columns
    gone = repeated_lines(docs, percent).groupBy("d", "k").agg(F.collect_set("line").alias("removed"))
    rows = docs.select(F.struct(*names).alias("row"), *_document())
    joined = rows.join(gone, ["d", "k"], "left")
    lines = F.split("row.text", "\n")
    kept = F.filter(lines, lambda line, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    done = joined.select("row", "removed", text.alias("text"))
    done = done.where(F.col("removed").isNull() | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    changed = F.col("removed").isNotNull()
    return done.select(*[F.when(changed, new[n]).otherwise(F.col(f"row.{n}")).alias(n) if n in new else F.col(f"row.{n}").alias(n) for n in names])
