"""Line deduplication by a deletion-neighbourhood join (DataFrame functions only).

A line is a copy if a line that stands earlier (by document id, then place) has
the same words, or the same but for one word put in, left out or replaced.
Words are compared in ASCII lower case; in scripts without spaces each character
is a word.  Lines of fewer than ``min_words`` words always stay; the edit is
allowed from ``near_words`` words on.  ``ANY_LENGTH``, which the query and the
pipeline take, has every line that isn't blank compared, and an edit allowed
where it is a fifth of the line or less.  Only the earliest of several copies is
kept.

Each distinct line would emit itself and all variants with one word left out as
hashed keys.  Two facts keep that small and lose no pair:

* Lines that differ by one edit share their first or their last half (halves of
  the shorter length), so only lines that share a half with another line emit,
  and of those only the variants whose gap lies outside a half they share.
* Within a key only the earliest line matters: all lines with one variant and
  one place of the gap are one replacement apart, and a whole line has at most
  one content.

A variant's key comes from running sums over the line's words, in time that
grows with the line and not with its square.  Each pair found is verified on
the words before it counts.

The rows are first written in buckets, so texts move once.  Null text has no lines and stays null.  Rows that are equal in id and text are
alike and don't make copies of each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.store import ascii_lower, bind, dropped, released, saved, scratch

#: Fixed value: white space inside a line.
INNER_SPACE = "[\\x20\\x09\\x0B-\\x0D]+"
#: Fixed value: characters of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han), each a word.
UNSPACED = "[\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{3FFFF}]"
#: Fixed value: two ranges that hold all of them, which are tested faster.
MAYBE_UNSPACED = "[\\u0E00-\\u1FFF\\u3040-\\x{10FFFF}]"
#: Limits that take lines of any length: an edit may change a fifth of a line's words at most.
ANY_LENGTH = {"min_words": 1, "near_words": 5}
#: Word hashes and weights stay below this, so that sums over a million words fit in a BIGINT.
MODULUS = 1 << 20


def _in_order(each: DataFrame) -> DataFrame:
    """``line`` as ``norm``: lower case, one space between words.  Lines that need a step less are spared it."""
    line, lower = F.col("line"), F.col("lower")
    plain = F.length(line) == F.octet_length(line)
    apart = F.when(line.rlike(MAYBE_UNSPACED), F.regexp_replace(line, UNSPACED, " $0 ")).otherwise(line)
    each = each.withColumn("lower", F.when(plain, F.lower(line)).otherwise(ascii_lower(apart)))
    uneven = F.contains(lower, F.lit("  "))
    for space in ("\t", "\x0b", "\x0c", "\r"):
        uneven = uneven | F.contains(lower, F.lit(space))
    return each.withColumn("norm", F.trim(F.when(uneven, F.regexp_replace(lower, INNER_SPACE, " ")).otherwise(lower))).drop("line", "lower")


def _halves(words: Column, m: Column) -> Column:
    """Keys of the first and last half, for a partner as long, longer or shorter by one word.

    A half has as many words as half of the shorter line: m // 2, or (m - 1) // 2
    words, which is the same for an odd m.
    """
    key = lambda tag, h, start: F.xxhash64(F.lit(tag), h, F.slice(words, start, h))
    h = F.floor(m / 2).cast("int")
    both = lambda h: (key("first", h, F.lit(1)), key("last", h, m - h + 1))
    return F.when(m % 2 == 1, F.array(*both(h))).otherwise(F.array(*both(h), *both(h - 1)))


def _gap_counts(i: Column, m: Column, ends: Column) -> Column:
    """Whether the word left out lies outside a shared half; ``ends`` has a bit for each key of ``_halves`` that is shared."""
    h = F.floor(m / 2).cast("int")
    has = lambda bit: ends.bitwiseAND(F.lit(bit)) != 0
    after = F.when(has(4), h - 1).when(has(1), h).otherwise(m)
    before = F.when(has(8), m - h).when(has(2), m - h - 1).otherwise(-1)
    return (i >= after) | (i <= before)


def lines_of(held: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """Every line of enough words: where it stands, its hashes, and the keys of its halves."""
    each = held.select(F.col("__id").alias("doc_id"), F.col("__row").alias("row"), F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    # Blank lines go by a test of the raw line, else the filter would put each line in order once more.
    long = each.filter(F.col("line").rlike("[^\\x20\\x09-\\x0D]"))
    long = _in_order(long).withColumn("words", F.split("norm", " ")).withColumn("m", F.size("words"))
    if min_words > 1:
        long = long.filter(F.col("m") >= min_words)
    halves = F.when(F.col("m") >= near_words, _halves(F.col("words"), F.col("m")))
    return long.select(F.struct("doc_id", "row", "pos").alias("at"), F.xxhash64("norm").alias("h1"), F.crc32("norm").alias("h2"), halves.alias("halves"))


def _variants(words: DataFrame) -> DataFrame:
    """Keys of each line, whole and with one word left out: (n, role, key).

    Role 0: variant and place of the gap.  Role 1: variant.  Role 2: the whole line.
    """
    # Lines are dealt out whole, so the windows move none of their words.
    dealt = words.repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "n")
    each = dealt.select("n", "ends", F.size("words").alias("m"), F.posexplode("words").alias("i", "w"))
    small = lambda *c: F.pmod(F.xxhash64(*c), F.lit(MODULUS))
    sums = []
    for tag in ("a", "b"):
        h = small("w", F.lit(tag))
        sums += [(f"own_{tag}", h * small("i", F.lit(tag))), (f"next_{tag}", h * small(F.col("i") - 1, F.lit(tag)))]
    each = each.select("n", "ends", "m", "i", *[v.alias(k) for k, v in sums])
    by = Window.partitionBy("n")
    run = by.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = []
    for tag in ("a", "b"):
        before = F.sum(f"own_{tag}").over(run) - F.col(f"own_{tag}")
        after = F.sum(f"next_{tag}").over(by) - F.sum(f"next_{tag}").over(run)
        got += [(before + after).alias(f"gap_{tag}"), F.sum(f"own_{tag}").over(by).alias(f"all_{tag}")]
    each = each.select("n", "ends", "m", "i", *got)
    gap = F.xxhash64("gap_a", "gap_b", F.col("m") - 1)
    counts = _gap_counts(F.col("i"), F.col("m"), F.col("ends"))
    roles = F.array(
        F.struct(F.lit(0).alias("role"), F.when(counts, F.xxhash64(gap, "i")).alias("key")),
        F.struct(F.lit(1).alias("role"), F.when(counts, gap).alias("key")),
        F.struct(F.lit(2).alias("role"), F.when(F.col("i") == 0, F.xxhash64("all_a", "all_b", "m")).alias("key")),
    )
    return each.select("n", F.inline(roles)).filter("key IS NOT NULL")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are one edit apart or equal: what they share at both ends leaves one word."""
    na, nb = F.size(a), F.size(b)
    least, most = F.least(na, nb), F.greatest(na, nb)

    def shared(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.least(least, F.when(differs == 0, least).otherwise(differs - 1).cast("int"))

    return (most - least <= 1) & (shared(a, b) + shared(F.reverse(a), F.reverse(b)) >= most - 1)


def _near(lines: DataFrame, firsts: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct lines of which an earlier line is one edit away: (at), where each stands first."""
    keys = lines.filter(F.col("halves").isNotNull()).select("h1", F.posexplode("halves").alias("k", "half"))
    shared = keys.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low != high").select("half")
    some = keys.join(shared, "half", "left_semi").groupBy("h1").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("ends"))
    # Numbers in the order of the places stand for them from here on.
    numbered = firsts.join(some, "h1").select("at", "ends").orderBy("at").withColumn("n", F.monotonically_increasing_id())
    numbered = saved(numbered, "line_numbers")
    spots = numbered.groupBy(F.col("at.row").alias("__row")).agg(F.collect_list(F.struct("at.pos", "n", "ends")).alias("spots"))
    picked = bind(F.split("__text", "\n", -1), lambda x: F.transform(F.col("spots"), lambda p: F.struct(p["n"].alias("n"), p["ends"].alias("ends"), F.get(x, p["pos"]).alias("line"))))
    spots = saved(spots, "line_spots")
    own = held.select("__row", "__text").join(spots, "__row").select(F.inline(picked))
    words = _in_order(own).select("n", "ends", F.split("norm", " ").alias("words"))
    words = saved(words.dropDuplicates(["n"]), "line_words")
    dropped(spots)
    variants = saved(_variants(words), "line_variants")
    # Keys of one line alone pair with nothing: few are left to join.
    mates = variants.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.min(F.when(F.col("role") == r, F.col("n"))).alias(f"first{r}") for r in (0, 1, 2)]).filter("c > 1")
    mates = saved(mates.filter(F.col("first0").isNotNull() | (F.col("first1").isNotNull() & F.col("first2").isNotNull())), "line_mates")
    mate = F.when(F.col("role") == 0, F.col("first0")).when(F.col("role") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = variants.join(mates, "key").select("n", mate.alias("mate")).filter(F.col("mate") < F.col("n")).distinct()
    other = words.select(F.col("n").alias("mate"), F.col("words").alias("mate_words"))
    found = pairs.join(words, "n").join(other, "mate").filter(one_edit(F.col("words"), F.col("mate_words"))).select("n").distinct()
    near = saved(numbered.join(found, "n", "left_semi").select("at"), "line_near")
    dropped(numbered, words, variants, mates)
    return near


def _bucketed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows in buckets by id and text, under the shared folder: two joins then move no text."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 50_000)
    name = f"line_docs_{uuid.uuid4().hex}"
    path = scratch(spark, "line_docs")
    rows = docs.select(*[docs[c].alias(f"c_{c}") for c in docs.columns], docs[id_col].alias("__id"), docs[text_col].alias("__text"), F.xxhash64(docs[id_col], docs[text_col]).alias("__row"))
    rows.drop(f"c_{text_col}").repartition(n, "__row").write.bucketBy(n, "__row").option("path", path).saveAsTable(name)
    released(spark)
    return spark.table(name)


def copies(held: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(__row, gone): the places of the lines that are copies, for rows that have any."""
    lines = saved(lines_of(held, min_words, near_words), "lines")
    firsts = saved(lines.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("times")), "line_firsts")
    near = _near(lines, firsts, held)
    # Of a line that stands several times all places but the first go; of a near one that goes too.
    repeated = firsts.filter("times > 1").select("h1", "h2", F.col("at").alias("first"))
    own = lines.select("at", "h1", "h2").join(repeated, ["h1", "h2"]).filter(F.col("at") != F.col("first")).select("at").unionAll(near)
    gone = saved(own.groupBy(F.col("at.row").alias("__row")).agg(F.collect_set("at.pos").alias("gone")), "line_gone")
    dropped(lines, firsts, near)
    return gone


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5, near_words: int = 10) -> DataFrame:
    """The rows without lines that are copies, with the number removed as ``lines_removed`` (replaced if there)."""
    held = _bucketed(docs, id_col, text_col)
    both = held.join(copies(held, min_words, near_words), "__row", "left")
    names = [c for c in docs.columns if c != "lines_removed"]
    rest = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))
    text = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(bind(F.split("__text", "\n", -1), rest), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint")
    return both.select(*[(text if c == text_col else F.col(f"c_{c}")).alias(c) for c in names], removed.alias("lines_removed"))
