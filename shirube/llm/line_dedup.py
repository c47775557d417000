"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its five-word shingles, in lower case; the words of a shorter line are its one shingle. Lines with equal sets are one class, found by grouping. Between
classes: order the shingles of every line by rarity, so that two lines with Jaccard similarity t or more share one of their
first size - ceil(t size) + 1 shingles (prefix filter); of lines that share one, the sizes must allow t (length filter), and so
must the shingles that are left behind the shared one in both (positional filter); what is left is verified on the whole sets.

Rarity comes from a table of fixed size: words hash to buckets, and a bucket holds the rounded logarithm of its count; a
shingle is as rare as its first word. Any order that all lines share is right, and this one needs no join. A shingle's
code is its rarity followed by its hash, so that sorting the codes of a line orders its shingles.

Hot shingles. A line goes as soon as one earlier line matches it, so the lines of a large group are first compared with the
few earliest of it only; what this leaves open is compared with the next earliest, four times as many in each round, to the end.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_prefix, stored

#: Jaccard similarity from which lines match, as a fraction.
SIMILAR = (4, 5)
SHINGLE = 5
#: Buckets of words for their rarity.
RARITY = 1 << 16
#: Groups of at most so many lines compare all their pairs at once; larger ones begin with a quarter as many of their earliest lines.
AT_ONCE = 32
_FILTER_WORDS = 1 << 16
_HASH_BITS = (1 << 56) - 1
#: A line's place, in the order of lines. ``row`` tells rows apart that repeat an id.
PLACE = ("doc_id", "row", "line_no")
_BLANK = "[ \t\r\f\u000b]"


def _shift(value: Column, by: Column, left: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned", value, by.cast("int"))


def rarity_levels(docs: DataFrame, text_col: str) -> bytes:
    """For each rarity bucket, a byte: 1 and the rounded up logarithm of its count. Of fixed size, however many words there are."""
    words = docs.select(F.explode(F.split(F.lower(docs[text_col]), "[ \t\r\f\u000b\n]")).alias("w"))
    counts = words.groupBy(F.pmod(F.xxhash64("w"), F.lit(RARITY)).alias("at")).count()
    levels = bytearray(b"\1" * RARITY)
    for row in counts.collect():  # RARITY rows at most
        levels[row["at"]] = 1 + (row["count"] - 1).bit_length()
    return bytes(levels)


def _words(line: Column) -> Column:
    """Hashes of the words of a line, in order. Blanks part words; other white space does so as well, where there is any."""
    lower = F.lower(line)
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\u000b"))
    parts = F.split(F.when(other, F.regexp_replace(lower, _BLANK, " ")).otherwise(lower), " ")
    return F.array_remove(F.transform(parts, lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def coded(line: Column, levels: bytes) -> Column:
    """The distinct shingles of a line as sorted codes: rarity in the top byte, hash below. The words of a line of fewer than five are one."""
    table = F.lit(levels)
    level = lambda h: F.ascii(F.substring(table, F.pmod(h, F.lit(RARITY)).cast("int") + 1, 1).cast("string")).cast("long")
    ranked = F.transform(_words(line), lambda h: _shift(level(h), F.lit(56), left=True).bitwiseOR(h.bitwiseAND(F.lit(_HASH_BITS))))

    def shingle(words: Column, i: Column) -> Column:
        own = [F.get(words, i + k) for k in range(SHINGLE)]  # null, which the hash passes over, behind the end of a short line
        return own[0].bitwiseAND(F.lit(127 << 56)).bitwiseOR(F.xxhash64(*own).bitwiseAND(F.lit(_HASH_BITS)))

    places = lambda words: F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    once = F.transform(F.array(ranked), lambda words: F.transform(places(words), lambda i: shingle(words, i)))  # the words are computed once
    return F.sort_array(F.array_distinct(F.element_at(once, 1)))


def _least_overlap(size: Column, similar: tuple[int, int]) -> Column:
    """ceil(t size)."""
    return F.ceil(size * similar[0] / F.lit(float(similar[1])) - 1e-9).cast("int")


def _bit(key: Column) -> Column:
    return _shift(F.lit(1).cast("long"), F.pmod(key, F.lit(64)), left=True)


def _word(key: Column) -> Column:
    return F.pmod(_shift(key, F.lit(6)), F.lit(_FILTER_WORDS))


def bit_table(keys: DataFrame, word: str, bits: str) -> DataFrame:
    """keys(k) as a bit table of 65,536 rows at most."""
    return keys.groupBy(_word(F.col("k")).alias(word)).agg(F.bit_or(_bit(F.col("k"))).alias(bits))


def with_row_keys(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """``docs`` with ``name``: a hash of the text where other rows may have the same id, else 0. A bit table of fixed size tells."""
    columns, own = docs.columns, F.xxhash64(docs[id_col])
    repeated = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id")).groupBy("id").count().where("count > 1").select(F.xxhash64("id").alias("k"))
    bits = F.broadcast(stored(bit_table(repeated, f"{name}_word", f"{name}_bits")))
    told = docs.join(bits, _word(own) == F.col(f"{name}_word"), "left")
    hit = F.coalesce(F.col(f"{name}_bits").bitwiseAND(_bit(own)) != 0, F.lit(False))
    return told.select(*columns, F.when(hit, F.xxhash64(F.col(text_col))).otherwise(F.lit(0).cast("long")).alias(name))


def line_table(docs: DataFrame, levels: bytes, id_col: str, row_col: str, text_col: str, similar: tuple[int, int]) -> DataFrame:
    """doc_id, row, line_no, size, k1, k2 (a hash of the set), head (its prefix) of the lines that have words."""
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("doc_id"), docs[row_col].alias("row"), F.posexplode(F.split(docs[text_col], "\n")).alias("line_no", "line"))
    sets = rows.where(F.length("line") > 0).select(*PLACE, coded(F.col("line"), levels).alias("codes")).withColumn("size", F.size("codes")).where("size > 0")
    head = F.slice("codes", F.lit(1), F.col("size") - _least_overlap(F.col("size"), similar) + 1)
    return sets.select(*PLACE, "size", F.xxhash64("codes").alias("k1"), F.xxhash64(F.lit("second"), "codes").alias("k2"), head.alias("head"))


def line_classes(lines: DataFrame, *carried: str) -> DataFrame:
    """k1, k2, the place and what is carried of each different set at its first place."""
    place = F.struct(*PLACE, *carried)
    return lines.groupBy("k1", "k2").agg(F.min_by(place, F.struct(*PLACE)).alias("p")).select("k1", "k2", "p.*")


def _plausible(similar: tuple[int, int]) -> Column:
    """Order, length and positional filters of a pair (x, y) that shares a prefix shingle; y is the earlier line."""
    a, b = similar
    total = F.col("x.size") + F.col("y.size")
    together = F.ceil(total * a / F.lit(float(a + b)) - 1e-9)
    left = F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos"))
    same_doc, same_row = F.col("y.doc_id") == F.col("x.doc_id"), F.col("y.row") == F.col("x.row")
    earlier = (F.col("y.doc_id") < F.col("x.doc_id")) | same_doc & ((F.col("y.row") < F.col("x.row")) | same_row & (F.col("y.line_no") < F.col("x.line_no")))
    return earlier & (F.col("x.size") * a <= F.col("y.size") * b) & (F.col("y.size") * a <= F.col("x.size") * b) & (left >= together)


_X, _Y = ("xd", "xr", "xl"), ("yd", "yr", "yl")


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"x.{c}").alias(n) for c, n in zip(PLACE, _X)), *(F.col(f"y.{c}").alias(n) for c, n in zip(PLACE, _Y))).distinct()


def _pairs(x: DataFrame, y: DataFrame, similar: tuple[int, int]) -> DataFrame:
    return _named(x.alias("x").join(y.alias("y"), F.col("x.w") == F.col("y.w")).where(_plausible(similar)))


def _sets_of(met: DataFrame, docs: DataFrame, levels: bytes, id_col: str, row_col: str, text_col: str) -> DataFrame:
    """d, r, l, codes of the lines that share a prefix shingle with another. A bit table of fixed size tells them in the scan."""
    bits = F.broadcast(bit_table(met.select(F.xxhash64(*PLACE).alias("k")), "_word", "_bits"))
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("d"), docs[row_col].alias("r"), F.posexplode(F.split(docs[text_col], "\n")).alias("l", "line")).withColumn("_k", F.xxhash64("d", "r", "l"))
    likely = rows.withColumn("_word", _word(F.col("_k"))).join(bits, "_word").where(F.col("_bits").bitwiseAND(_bit(F.col("_k"))) != 0)
    return likely.select("d", "r", "l", coded(F.col("line"), levels).alias("codes"))


def _verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """xd, xr, xl of the lines that match an earlier one, on whole sets."""
    a, b = similar
    wx, wy = (sets.select(*(F.col(c).alias(n) for c, n in zip(("d", "r", "l"), names)), F.col("codes").alias(codes)) for names, codes in ((_X, "wx"), (_Y, "wy")))
    both = F.size(F.array_intersect("wx", "wy"))
    match = both * (a + b) >= (F.size("wx") + F.size("wy")) * a  # both / (|x| + |y| - both) >= a / b
    return pairs.join(wx, list(_X)).join(wy, list(_Y)).where(match).select(*_X).distinct()


def matched_lines(lines: DataFrame, docs: DataFrame, levels: bytes, similar: tuple[int, int], id_col: str, row_col: str, text_col: str, at_once: int = AT_ONCE) -> DataFrame:
    """xd, xr, xl: the first places of line classes that an earlier class matches."""
    classes = line_classes(lines, "size", "head")
    posted = classes.select(*PLACE, "size", F.posexplode("head").alias("pos", "w"))
    group = Window.partitionBy("w")
    # the rows of a shingle that only one line has, nearly all of them, end here
    met = posted.withColumns({"n": F.count(F.lit(1)).over(group), "rank": F.row_number().over(group.orderBy(*PLACE))}).where("n > 1")
    met = stored(met)
    sets = stored(_sets_of(met, docs, levels, id_col, row_col, text_col))
    small, large = met.where(F.col("n") <= at_once), met.where(F.col("n") > at_once)
    done = stored(_verified(_pairs(small, small, similar), sets, similar))
    begin, many = 0, at_once // 4 + 1
    while True:
        still = large.where(F.col("rank") > begin + 1).join(done.toDF(*PLACE), list(PLACE), "left_anti")
        if still.isEmpty():
            return done
        leaders = large.where((F.col("rank") > begin) & (F.col("rank") <= begin + many))
        done = stored(done.union(_verified(_pairs(still, leaders, similar), sets, similar)).distinct())
        begin, many = begin + many, many * 4


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with later matches removed from the text; adds n_lines, n_exact and n_near (lines removed, by kind of match).

    Lines are ordered by document id and place; rows that repeat an id, by a hash of their text. A line goes if an earlier line has
    the same five-word shingles (n_exact) or, failing that, if its shingles have Jaccard similarity 4/5 or more with those of an
    earlier line (n_near), itself removed or not. A line of fewer than five words has them all as its one shingle; lines without
    words stay. Null text stays null; rows without id stay as they are and take no part; rows that repeat both id and text count
    as one document, of which every row keeps the same lines. Other columns pass through whatever their names, save those with the
    names of the three that are added. An empty table gives an empty result.
    """
    docs = docs.drop("n_lines", "n_exact", "n_near")
    columns, prefix = docs.columns, free_prefix(docs)
    row_col = f"{prefix}row"
    levels, keyed = rarity_levels(docs, text_col), with_row_keys(docs, id_col, text_col, row_col)
    lines = stored(line_table(keyed, levels, id_col, row_col, text_col, similar))
    near = matched_lines(lines, keyed, levels, similar, id_col, row_col, text_col).withColumn("near", F.lit(True))
    first = ("fd", "fr", "fl")
    firsts = line_classes(lines).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), *(F.col(c).alias(n) for c, n in zip(PLACE, first)))
    firsts = firsts.join(near.toDF(*first, "near"), list(first), "left").select("c1", "c2", *first, F.col("near").isNotNull().alias("near"))
    placed = lines.select(*PLACE, "k1", "k2").join(firsts, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    later = placed.withColumn("exact", F.struct(*PLACE) != F.struct(*(F.col(n).alias(c) for c, n in zip(PLACE, first)))).where("exact or near")
    gone = later.groupBy(F.col("doc_id").alias(f"{prefix}gone_doc"), F.col("row").alias(f"{prefix}gone_row"))
    by_doc = stored(gone.agg(F.collect_set("line_no").alias(f"{prefix}gone"), F.count_distinct(F.when(F.col("exact"), F.col("line_no"))).alias(f"{prefix}exact")))
    return _without(keyed, by_doc, columns, prefix, id_col, text_col)


def _without(docs: DataFrame, by_doc: DataFrame, columns: list[str], prefix: str, id_col: str, text_col: str) -> DataFrame:
    """Texts without the lines that go. Only texts that may lose a line are shuffled; a bit table of fixed size tells the others."""
    own = lambda name: F.col(f"{prefix}{name}")
    key = F.xxhash64(F.col(id_col), own("row"))
    bits = F.broadcast(bit_table(by_doc.select(F.xxhash64(own("gone_doc"), own("gone_row")).alias("k")), f"{prefix}word", f"{prefix}bits"))
    told = docs.withColumn(f"{prefix}at", F.when(F.col(id_col).isNotNull(), _word(key)).otherwise(F.lit(-1))).join(bits, own("at") == own("word"), "left")
    hit = F.coalesce(own("bits").bitwiseAND(_bit(key)) != 0, F.lit(False))
    lines_of = F.split(F.col(text_col), "\n")
    n_lines = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(lines_of)), F.lit(0)).cast("long").alias("n_lines")
    none = F.lit(0).cast("long")
    untouched = told.where(~hit).select(*columns, n_lines, none.alias("n_exact"), none.alias("n_near"))
    joined = told.where(hit).select(*columns, own("row")).join(by_doc, (F.col(id_col) == own("gone_doc")) & (own("row") == own("gone_row")), "left")
    kept = F.array_join(F.filter(lines_of, lambda x, i: ~F.array_contains(own("gone"), i)), "\n")
    text = F.when(own("gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    exact = F.coalesce(own("exact"), none)
    n_near = F.coalesce(F.when(own("gone").isNotNull(), F.size(own("gone"))), F.lit(0)).cast("long") - exact
    touched = joined.select(*(text if c == text_col else F.col(c) for c in columns), n_lines, exact.alias("n_exact"), n_near.alias("n_near"))
    return untouched.union(touched)
