"""Fuzzy line dedup. DataFrame operations only.

Lines are normalised (lower case, letters and digits only).  Of the words of a
line, in a seeded order, the ``KEEP`` first make its blocks, and lines that share
``AGREE`` of them, one after another in the same turn, are candidates: a key stands for every choice of so many.  Longer words come earlier in the order, as they tell lines apart.  Lines of
few words also have keys of fewer blocks, and short ones keys of their
trigrams, so that lines may meet where hardly a word is whole.  Candidates are
linked if the edit similarity (1 - distance / longer length) of their words or,
up to ``MOST_CHARS`` characters, that of their characters is at least ``SIMILAR``.  Of each connected group the
first line, by id and place, stays.

A SimHash of words can't do this: lines of edit similarity 0.8 differ in a fifth
of its bits, so blocks wide enough to tell lines apart hardly ever agree.

Equal normalised lines, told by 128 bits, are one node from the start, so the most
common line costs what any other does.  Buckets are settled by
``common.settle``: no pair that could join two groups is left out, none has a cap.

Defined results: a null text counts as empty; lines without a letter or digit
are never removed; rows with equal id and text keep and lose the same lines;
null ids come first in order; an empty table gives no rows; other columns,
whatever their names, are only carried.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.llm.common import row_marks, settle, stage, table, unstage

SIMILAR = 0.8
#: Blocks of a line, and how many of them make a key.
KEEP, AGREE = 7, 4
#: Lines of so many different words or more have the keys above, lines of at most so many have keys of one block less.
MANY_WORDS, FEW_WORDS = 10, 14
#: Longer lines are compared by words alone: typos in a few of many words leave the words alike.
MOST_CHARS = 128
#: Lines of at most so many characters also meet by their trigrams: blocks, and blocks in a key.
FEW_CHARS = 32
GRAM_KEEP, GRAM_AGREE = 8, 4
#: At most so many times lines are compared with the largest groups of their buckets before all that are left are paired.
HUBS = 2
#: Keys are dealt into so many passes, one after another, so that their shuffles need not be on disk together.
PASSES = 2
#: Longs of a line's bit sets: of its words, its pairs of characters and its characters.  Two lines have more than 100
#: columns together, so Spark compiles the bound on a pair in parts; as one method it is too long for the JVM to compile.
BAGS = {"t": 32, "p": 16, "c": 6}
#: Letters beyond the first plane.
LETTERS = 0xF0000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def word_code(norm: Column) -> Column:
    """A text of one letter per word, by hash: its letters' edit distance is that of the words.

    Two words share a letter with a chance of one in ``LETTERS``.
    """
    code = lambda w: F.lpad(F.hex(F.pmod(F.xxhash64(w), F.lit(LETTERS)) + 0x10000), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), code), "")), "UTF-32")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(*row_marks(id_col, text_col), F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "line"))
    return rows.select("r1", "r2", "id", "pos", normalised(F.col("line")).alias("norm"))


def _grams(norm: Column) -> Column:
    """The trigrams of a short line, its ends included."""
    return F.regexp_extract_all(F.concat(F.lit("  "), norm, F.lit("  ")), F.lit("(?=(.{3}))"), F.lit(1))


def _blocks(rows: DataFrame, tokens: Column, n: int, rank, name: str) -> DataFrame:
    """``rows`` with the ``n`` least ranks of their tokens as ``name0..``, null where they have fewer.

    They stand as their tokens do: an edit leaves those it does not touch in turn, while unlike texts of common tokens
    seldom have them in the same turn.
    """
    others = rows.columns
    rows = rows.select(*others, F.array_distinct(F.transform(tokens, rank)).alias("_ranks"))
    rows = rows.select(*others, F.array_intersect("_ranks", F.slice(F.sort_array("_ranks"), 1, n)).alias("_own"))
    return rows.select(*others, *(F.get("_own", F.lit(i)).alias(f"{name}{i}") for i in range(n)))


def line_marks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``r1, r2, id, pos, l1, l2, size, b0..`` of every line; ``b0`` is null where it has no word.

    ``l1, l2`` tell the normalised line, ``size`` has the number of its words above that of its characters (32 bits),
    ``b0..`` are its blocks, null where it has fewer.
    """
    # longer words get smaller ranks
    rank = lambda w: F.call_function("shiftrightunsigned", F.xxhash64(w), F.least(F.greatest(F.char_length(w) - 2, F.lit(1)), F.lit(6)))
    lines = _lines(docs, id_col, text_col)
    whole = lines.select("r1", "r2", "id", "pos", F.xxhash64("norm").alias("l1"), F.xxhash64(F.lit("line"), "norm").alias("l2"), F.char_length("norm").alias("chars"), F.split("norm", " ").alias("words"))
    whole = whole.select("r1", "r2", "id", "pos", "l1", "l2", (F.shiftleft(F.size("words").cast("long"), 32) + F.col("chars")).alias("size"), F.when(F.col("chars") > 0, F.col("words")).alias("words"))
    return _blocks(whole, F.col("words"), KEEP, rank, "b").drop("words")



def _choices(n: int, *sizes: int) -> list[int]:
    """Bit sets of every choice of so many of ``n`` blocks; where there are no more than that, of all but one."""
    found = {c for size in sizes for c in combinations(range(n), size if n > size else max(1, n - 1))}
    return sorted(sum(1 << i for i in c) for c in found)


def _keyed(rows: DataFrame, choices: Column, blocks: list[Column], seed: str) -> DataFrame:
    """``node, key``: the hash of the blocks of each choice, as they stand; a hash passes over nulls."""
    chosen = [F.when(F.col("choice").bitwiseAND(F.lit(1 << i)) != 0, b) for i, b in enumerate(blocks)]
    return rows.withColumn("choice", F.explode(choices)).select("node", F.xxhash64(F.lit(seed), *chosen).alias("key"))


def line_keys(nodes: DataFrame, grams: DataFrame) -> DataFrame:
    """``node, key`` of nodes with blocks, and of short lines with trigram blocks ``g0..``: those that share a key are candidates."""
    n_words = F.shiftrightunsigned("size", 32)
    blocks = [F.col(f"b{i}") for i in range(KEEP)]
    count = lambda own: sum((b.isNotNull().cast("int") for b in own[1:]), F.lit(0))  # noqa: E731  one less than there are
    by_class = [[_choices(n, *sizes) for n in range(1, KEEP + 1)] for sizes in ((AGREE - 1,), (AGREE - 1, AGREE), (AGREE,))]
    line_class = (n_words >= MANY_WORDS).cast("int") + (n_words > FEW_WORDS).cast("int")
    keys = _keyed(nodes, F.get(F.get(F.lit(by_class), line_class), count(blocks)), blocks, "words")
    own = [F.col(f"g{i}") for i in range(GRAM_KEEP)]
    of_grams = [_choices(n, GRAM_AGREE) for n in range(1, GRAM_KEEP + 1)]
    return keys.unionByName(_keyed(grams, F.get(F.lit(of_grams), count(own)), own, "grams"))


def _fits(p: str, q: str) -> Column:
    """Whether the numbers of words or those of characters allow the similarity; the distance is at least their difference."""

    def near(of) -> Column:
        x, y = of(F.col(f"{p}size")), of(F.col(f"{q}size"))
        return F.greatest(x, y) - F.least(x, y) <= F.floor(F.greatest(x, y) * F.lit(round(1 - SIMILAR, 4)) + F.lit(1e-9))

    chars = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF))
    by_chars = F.greatest(chars(F.col(f"{p}size")), chars(F.col(f"{q}size"))) <= MOST_CHARS
    return near(lambda c: F.shiftrightunsigned(c, 32)) | (by_chars & near(chars))


def _bits(tokens: Column, n: int) -> Column:
    """The longs of a bit set of a text's tokens; the second of equal ones is a token of its own, and so on."""
    # equal tokens stand together
    own = lambda all: F.transform(all, lambda t, i: F.pmod(F.xxhash64(t, i.cast("long") - F.array_position(all, t)), F.lit(64 * n)).cast("int"))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)))
    long = lambda bits, i: F.aggregate(F.filter(bits, lambda h: F.shiftright(h, 6) == i), F.lit(0).cast("long"), lambda x, h: x.bitwiseOR(bit(h)))
    # one after another as elements of an array: each is worked out once, however often it is read
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    bits = once(F.sort_array(F.transform(tokens, lambda t: F.xxhash64(t))), own)
    return once(bits, lambda b: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: long(b, i)))


def bags(texts: DataFrame) -> DataFrame:
    """``node, t0.., p0.., c0..``: bit sets of the words of ``node, norm`` and, for lines compared by characters, of their pairs of characters and characters."""
    short = F.when(F.char_length("norm") <= MOST_CHARS, F.col("norm"))
    tokens = {"t": F.split("norm", " "), "p": F.regexp_extract_all(short, F.lit("(?=(..))"), F.lit(1)), "c": F.regexp_extract_all(short, F.lit("(.)"), F.lit(1))}
    rows = texts.select("node", *(_bits(x, BAGS[n]).alias(n) for n, x in tokens.items()))
    return rows.select("node", *(F.coalesce(F.get(n, F.lit(i)), F.lit(0)).cast("long").alias(f"{n}{i}") for n in BAGS for i in range(BAGS[n])))


def _tight(p: str, q: str) -> Column:
    """Whether the bits allow either similarity.

    A word that one line has more often than the other is an edit of words for
    each time; an edit of characters takes two pairs of characters and one
    character away at most, from either line.  Tokens that share a bit only make the bound wider.
    """

    def lacks(name: str) -> Column:
        one = lambda x, y: sum((F.bit_count(F.col(f"{x}{name}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{name}{i}")))) for i in range(BAGS[name])), F.lit(0))
        return F.greatest(one(p, q), one(q, p))

    far = lambda n: F.floor(n * F.lit(round(1 - SIMILAR, 4)) + F.lit(1e-9))
    words = F.shiftrightunsigned(F.greatest(f"{p}size", f"{q}size"), 32)
    chars = F.greatest(F.col(f"{p}size").bitwiseAND(F.lit(0xFFFFFFFF)), F.col(f"{q}size").bitwiseAND(F.lit(0xFFFFFFFF)))
    return (lacks("t") <= far(words)) | ((chars <= MOST_CHARS) & (lacks("c") <= far(chars)) & (lacks("p") <= 2 * far(chars)))


def _here(p: str, q: str) -> Column:
    """Whether a pair counts in the bucket at hand: of those that it shares, only that of its first common blocks.

    Pairs that meet by fewer blocks, in another turn or by trigrams count wherever they do.
    """
    shared = F.array_intersect(f"{p}blocks", f"{q}blocks")
    first = F.xxhash64(F.lit("words"), *(F.get(shared, F.lit(i)) for i in range(AGREE)))
    least = F.least(F.size(f"{p}blocks"), F.size(f"{q}blocks")) > AGREE
    many = F.least(F.shiftrightunsigned(f"{p}size", 32), F.shiftrightunsigned(f"{q}size", 32)) >= MANY_WORDS
    turn = shared == F.array_intersect(f"{q}blocks", f"{p}blocks")
    return ~(least & many & (F.size(shared) >= AGREE) & turn) | (F.col("key") == first)


def _like(a: str, b: str) -> str:
    """Whether two texts' edit distance allows the similarity."""
    far = f"cast(floor(greatest(char_length({a}), char_length({b})) * {1 - SIMILAR:.4f} + 1e-9) as int)"
    return f"levenshtein({a}, {b}, {far}) >= 0"


def _alike(p: str, q: str) -> Column:
    """Whether lines with their texts at hand are like, by words or, where ``short`` is given, by characters."""
    return F.expr(f"{_like(f'{p}code', f'{q}code')} or ({p}short is not null and {q}short is not null and {_like(f'{p}short', f'{q}short')})")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, linked`` for pairs of lines."""
    return (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("code").alias("ta"), F.col("norm").alias("na")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("code").alias("tb"), F.col("norm").alias("nb")), "b")
        # the words are the shorter: letters are compared only where words do not decide
        .select("a", "b", F.expr(f"{_like('ta', 'tb')} or (greatest(char_length(na), char_length(nb)) <= {MOST_CHARS} and {_like('na', 'nb')})").alias("linked"))
    )


def _texts(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, norm`` of nodes, each from one place where it stands."""
    places = nodes.select("r1", "r2", "pos", "node").groupBy("r1", "r2").agg(F.collect_list(F.struct("pos", "node")).alias("wanted"))
    rows = docs.select(*row_marks(id_col, text_col), F.col(text_col).alias("text")).join(places, ["r1", "r2"])
    rows = rows.select("wanted", F.split("text", "\n", -1).alias("lines"))
    # a text is cut once, not once for each line that is wanted of it
    rows = rows.select(F.explode(F.transform("wanted", lambda w: F.struct(w["node"].alias("node"), F.get("lines", w["pos"]).alias("line")))).alias("x"))
    return rows.select("x.node", normalised(F.col("x.line")).alias("norm")).dropDuplicates(["node"])


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines with a word (``r1, r2, id, pos, l1, l2``) and the groups of those that are not alone (``l1, l2, root``)."""
    # blank lines go here: a filter before would be pushed down, and every line normalised twice
    lines = stage(line_marks(docs, id_col, text_col), "line-marks").where("b0 is not null")
    same = lambda c: F.first(c).alias(c)  # noqa: E731  of equal lines, or of one place
    nodes = lines.groupBy("l1", "l2").agg(F.count("*").alias("n"), *map(same, ("r1", "r2", "pos", "size", *(f"b{i}" for i in range(KEEP)))))
    # numbers of their own: other joins need one column, and two lines can't share one
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "line-nodes", free=True)
    short = _texts(docs, nodes.where((F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))) <= FEW_CHARS), id_col, text_col)
    # written: every pass over the keys reads them, and they come from a shuffle of texts
    grams = stage(_blocks(short, _grams(F.col("norm")), GRAM_KEEP, lambda g: F.xxhash64(g), "g").drop("norm"), "line-grams", free=True)
    keys, bucket = line_keys(nodes, grams), Window.partitionBy("key")
    members, passes = None, []
    for i in range(PASSES):
        own = keys.where(F.pmod("key", F.lit(PASSES)) == i).withColumn("c", F.count("*").over(bucket)).withColumn("leader", F.min("node").over(bucket))
        own = stage(own.where("c > 2 or c = 2 and node <> leader"), "line-members", free=True)
        members = members.unionByName(own) if members else own
        passes.append(own)
    unstage(grams)
    # like lines share many keys, most of them with no other line: such a pair counts once
    twos = stage(members.where("c = 2").select("node", "leader").distinct(), "line-twos")
    members = members.where("c > 2")
    sizes = nodes.select("node", "size")
    sized = lambda df: df.join(sizes, "node").join(sizes.toDF("leader", "lead_size"), "leader")
    wanted = members.select("node").unionByName(twos.select("node")).unionByName(twos.select(F.col("leader").alias("node"))).distinct()
    texts = _texts(docs, nodes.join(wanted, "node", "left_semi"), id_col, text_col)
    texts = stage(texts.withColumn("code", word_code(F.col("norm"))), "line-texts", free=True)
    blocks = nodes.select("node", F.array_compact(F.array(*(f"b{i}" for i in range(KEEP)))).alias("blocks"))
    # texts go along, so that what leaves a bucket is links, not pairs that may be: lines around one passage are many pairs just too far apart
    whole = texts.select("node", "code", F.when(F.char_length("norm") <= MOST_CHARS, F.col("norm")).alias("short"))
    more = lambda some: bags(texts.join(some, "node", "left_semi")).join(blocks, "node").join(whole, "node")
    roots = settle(sized(members), ["size"], _fits, lambda pairs: _verified(pairs, texts), more, lambda p, q: _tight(p, q) & _here(p, q) & _alike(p, q), twos=sized(twos), hubs=HUBS)
    unstage(*passes, twos, texts)
    grouped = nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").where("n > 1 or root is not null")
    return lines.select("r1", "r2", "id", "pos", "l1", "l2"), grouped.select("l1", "l2", F.coalesce("root", "node").alias("root"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``r1, r2, removed``: numbers of the lines to remove, for rows that lose any."""
    lines, grouped = line_groups(docs, id_col, text_col)
    found = stage(lines.join(grouped, ["l1", "l2"]).select("root", F.struct("id", "pos", "r1", "r2").alias("at")), "line-grouped")
    # written, so that the join with it can split a large group
    keep = stage(found.groupBy("root").agg(F.min("at").alias("keep")), "line-keep")
    gone = found.join(keep, "root").where("at.r1 <> keep.r1 or at.r2 <> keep.r2 or at.pos <> keep.pos")
    return gone.groupBy("at.r1", "at.r2").agg(F.sort_array(F.collect_set("at.pos")).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with their repeated lines removed; texts left without a line are empty."""
    removed = stage(removed_lines(docs, id_col, text_col), "line-removed")
    joined = docs.select(F.struct("*").alias("_row"), *row_marks(id_col, text_col)).join(removed, ["r1", "r2"], "left")
    text = F.col("_row")[text_col]
    left = F.filter(F.split(text, "\n", -1), lambda s, i: ~F.array_contains("removed", i))
    cleaned = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    joined = joined.select("_row", cleaned.alias("_text"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col("_text").alias(c))
        elif c == n_chars_col:
            out.append(F.char_length("_text").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("_row")[c].alias(c))
    return joined.select(*out)


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    removed = stage(removed_lines(docs), "line-removed")
    rows = docs.select(
        "doc_id",
        *row_marks("doc_id", "text"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"),
    )
    return rows.join(removed, ["r1", "r2"], "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
    )
