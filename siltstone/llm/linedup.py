"""Fuzzy line dedup by MinHash over a whole corpus, with DataFrame functions alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import WORD, components, discard, written

#: MinHashes of a line; they stand for the 16 points of an affine plane of order ORDER.
ORDER = 4
SLOTS = ORDER * ORDER
#: 64-bit words of an odd sketch.
WORDS = 16
#: Lines of a family that meet as many others in one task.
TILE = 256
#: Shingles that are hashed in one row.
STRIDE = 8
#: A pair that lies so many shingles from the limit by hashes of 64 bits is not counted by its texts as well.
SURE = 2
#: How many different shingles the lines x and y have together.
SIZES = "x_n + y_n as sizes"


def masks(n: int) -> list[int]:
    """Masks whose highest bits are all different: the least of the masked hashes of a set is another MinHash for each."""
    bits = max(1, (n - 1).bit_length())
    out = []
    for k in range(n):
        low = (k * 0x9E3779B97F4A7C15) % (1 << (64 - bits))
        top = int(f"{k:0{bits}b}"[::-1], 2)
        value = (top << (64 - bits)) | low
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def bands() -> list[list[int]]:
    """The 20 lines of the plane, 4 slots each: any two slots share exactly one band.

    Bands that overlap so little are nearly independent, so that 16 MinHashes do the work of many more:
    to miss a pair, the slots in which it differs must block all 20 lines, which takes 7 of them at least.
    """

    def times(a: int, b: int) -> int:  # in the field of four elements, where addition is exclusive or
        return (a + b - 2) % 3 + 1 if a and b else 0

    sloped = [[ORDER * x + (times(m, x) ^ c) for x in range(ORDER)] for m in range(ORDER) for c in range(ORDER)]
    return sloped + [[ORDER * x + y for y in range(ORDER)] for x in range(ORDER)]


def minhashes(lines: DataFrame, width: int, parts: int) -> DataFrame:
    """(id, m0 to m15) of lines(id, line): the MinHashes of each line's shingles; a line shorter than a shingle is one.

    One hash a shingle serves all MinHashes, each under a mask of its own. Rows are dealt by id first,
    so that all shingles of a line are counted down where they are made, STRIDE of them a row; a row at
    the end has the last one again, which changes no minimum. As UTF-32, the place of each character is
    known without counting.
    """
    raw = lines.repartition(parts, "id").select("id", F.encode("line", "UTF-32").alias("u"))
    last = F.greatest(F.lit(0), F.shiftright(F.octet_length("u"), 2) - width)
    each = raw.select("id", "u", last.alias("last")).withColumn("at", F.explode(F.expr(f"sequence(0, last, {STRIDE})")))
    hashes = [F.xxhash64(F.substring(F.col("u"), 4 * F.least(F.col("at") + j, F.col("last")) + 1, F.lit(4 * width))).alias(f"h{j}") for j in range(STRIDE)]
    least = [F.least(*(F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(STRIDE))) for m in masks(SLOTS)]
    return each.select("id", *hashes).groupBy("id").agg(*(F.min(x).alias(f"m{k}") for k, x in enumerate(least)))


def shingles(texts: list[str], width: int) -> str:
    """The different shingles of texts (columns), told apart by 64 bits of a hash; a text shorter than one has none."""
    places = f"if(octet_length(u) < {4 * width}, array(), sequence(1, octet_length(u) - {4 * width - 1}, 4))"
    each = f"transform({places}, at -> xxhash64(substring(u, at, {4 * width})))"
    return f"array_distinct(flatten(transform(array({', '.join(f"encode({x}, 'UTF-32')" for x in texts)}), u -> {each})))"


def odd_sketches(lines: DataFrame, width: int) -> DataFrame:
    """(id, n, o0 to o15): how many different shingles a line has, and for each of 1,024 bits whether an odd number of them falls on it.

    Two lines' sketches differ in no more bits than their sets differ in shingles, so that a sketch
    rules out pairs without ever losing one that is similar.
    """
    # dealt by id, so that the words of a line and then the line itself are put together where its shingles are made
    dealt = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    # the set is a column before it is exploded: a generator that holds a lambda is not compiled
    each = dealt.select("id", F.expr(shingles(["line"], width)).alias("set")).select("id", F.explode("set").alias("h"))
    word, bit = F.col("h").bitwiseAND(F.lit(WORDS - 1)), F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(63)).cast("int")
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = each.select("id", word.alias("word"), flip.alias("flip")).groupBy("id", "word").agg(F.count("*").alias("n"), F.bit_xor("flip").alias("o"))
    return words.groupBy("id").agg(F.sum("n").alias("n"), *(F.max(F.when(F.col("word") == k, F.col("o"))).alias(f"o{k}") for k in range(WORDS)))


def plausible(x: str, y: str, least: float) -> Column:
    """Whether the sketches of x and y (prefixes of columns) leave it open that the similarity is least or more."""
    both = F.col(x + "n") + F.col(y + "n")
    bits = reduce(Column.__add__, (F.bit_count(F.coalesce(x + f"o{k}", F.lit(0).cast("long")).bitwiseXOR(F.coalesce(y + f"o{k}", F.lit(0).cast("long")))) for k in range(WORDS)))
    return (F.least(x + "n", y + "n") >= least * F.greatest(x + "n", y + "n") - 1e-6) & (bits <= (1 - least) / (1 + least) * both + 1e-6)


def named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def verified(pairs: DataFrame, lines: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b) of those pairs(a, b, sizes) whose sets of shingles have an exact Jaccard similarity of least or more.

    sizes is how many different shingles both lines have together; lines without any have no pairs.
    """
    both = pairs.join(lines.withColumnsRenamed({"id": "a", "line": "x"}), "a").join(lines.withColumnsRenamed({"id": "b", "line": "y"}), "b")
    # sizes - either >= least * either; hashes that fall together make either smaller, so beyond most there is no link,
    # and SURE below it there is one; what lies between is counted by its texts
    most = f"sizes / (1 + {least}D) + 1e-6D"
    # lines hold no line feed, so that no shingle without one reaches over it: the different ones are the union of both sets
    exact = f"size(array_distinct(regexp_extract_all(concat(x, '\\n', y), '(?=([^\\\\n]{{{width}}}))', 1)))"
    return both.filter(f"exists(array(size({shingles(['x', 'y'], width)})), either -> either <= {most} - {SURE} or either <= {most} and {exact} <= {most})").select("a", "b")


def within_families(members: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, sizes) of members(id, root, family, n, o0 to o15) of one family with different roots that their sketches do not rule out.

    A family is dealt into tiles of about TILE lines, and each pair of tiles is a key of its own, so that
    no task has a whole large family; only what the sketches leave is emitted.
    """
    sizes = members.groupBy("family").agg(F.count("*").alias("lines"), F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y")
    tiled = sizes.select("family", F.ceil(F.col("lines") / TILE).cast("int").alias("tiles"))
    dealt = members.join(tiled, "family").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    one = named(dealt.withColumn("other", F.explode(F.expr("sequence(sub, tiles - 1)"))), "x_")
    two = named(dealt.withColumn("other", F.explode(F.expr("sequence(0, sub)"))), "y_")
    unlike, once = F.col("x_root") != F.col("y_root"), (F.col("x_sub") != F.col("y_sub")) | (F.col("x_id") < F.col("y_id"))
    met = one.join(two, (F.col("x_family") == F.col("y_family")) & (F.col("x_sub") == F.col("y_other")) & (F.col("x_other") == F.col("y_sub")) & unlike & once & plausible("x_", "y_", least))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), F.expr(SIZES))


def buckets(lines: DataFrame, width: int) -> DataFrame:
    """(key, id) of the bands that several lines share, a written table."""
    parts = parts_for(lines)
    least = written(minhashes(lines, width, parts), "minhashes")
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{k}" for k in band)) for b, band in enumerate(bands())))
    # dealt once, for counting and for the join; most keys have one line, so that counting before would gain nothing
    keyed = least.select("id", F.explode(keys).alias("key")).repartition(parts, "key")
    shared = keyed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x != y").select("key")
    out = written(keyed.join(shared.hint("shuffle_hash"), "key").select("key", "id"), "buckets")
    discard(least)
    return out


def parts_for(lines: DataFrame) -> int:
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // 40_000)


def similar(lines: DataFrame, width: int, least: float) -> DataFrame:
    """(node, root) for lines(id, line) that share a component of verified links with another, a written table.

    Smaller ids lead. Each line is compared with the smallest leader of its buckets, so that a large
    group of near copies costs a comparison a member; lines with the same leader are a family. Lines in
    buckets that still hold several components are compared on: with those of their family, tile by
    tile, and with those of other families in their buckets. Odd sketches rule out most pairs, none of
    them similar, before texts are compared; so no link of a bucket is lost, and what is connected
    already is not compared again.
    """
    state = buckets(lines, width)
    near = written(lines.select("id", "line").join(state.select("id").distinct().hint("shuffle_hash"), "id", "left_semi"), "candidates")
    marks = written(odd_sketches(near, width), "sketches")
    lead = state.groupBy("key").agg(F.min("id").alias("a"))
    family = written(state.join(lead, "key").groupBy("id").agg(F.min("a").alias("family")), "families")
    first = family.filter("family != id").join(named(marks, "x_"), F.col("family") == F.col("x_id")).join(named(marks, "y_"), F.col("id") == F.col("y_id"))
    links = written(verified(first.filter(plausible("x_", "y_", least)).select(F.col("family").alias("a"), F.col("id").alias("b"), F.expr(SIZES)), near, width, least), "links")
    roots = written(components(links), "components")
    of = state.join(roots, state.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    several = of.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    left = written(of.join(several, "key").join(family, "id"), "mixed")
    members = written(left.select("id", "root", "family").distinct().join(marks, "id"), "members")
    apart = left.groupBy("key").agg(F.min("family").alias("x"), F.max("family").alias("y")).filter("x != y").select("key")
    rows = left.join(apart, "key").select("key", "id").join(members, "id")
    one, two = named(rows, "x_"), named(rows, "y_")
    unlike = (F.col("x_root") != F.col("y_root")) & (F.col("x_family") != F.col("y_family")) & (F.col("x_id") < F.col("y_id"))
    across = one.join(two, (F.col("x_key") == F.col("y_key")) & unlike & plausible("x_", "y_", least)).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.expr(SIZES))
    pairs = written(within_families(members, least).union(across).distinct(), "pairs")
    more = written(verified(pairs, near, width, least), "links")
    if not more.isEmpty():
        before, roots = roots, written(components(links.union(more)), "components")
        discard(before)
    discard(state, near, marks, family, links, left, members, pairs, more)
    return roots


def occurrences(docs: DataFrame, min_chars: int, short: bool) -> DataFrame:
    """(doc_id, text_hash, at, line) of each line with so many characters and, with short, of each other one with a word."""
    taken = F.char_length("line") >= min_chars
    return (
        docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("at", "line"))
        .filter(taken | F.col("line").rlike(WORD) if short else taken)
    )


def removed_lines(docs: DataFrame, min_chars: int = 40, width: int = 7, least: float = 0.8, short: bool = False) -> DataFrame:
    """(doc_id, text_hash, removed): for documents that lose lines, the places of those in order; a written table.

    Equal lines are one line; similar ones form components, and of each component the first place by
    (doc_id, place) is kept. Equal lines are found by grouping; after that a line is named by two
    independent 64-bit hashes, so that no text is moved for a place. Lines that stand in more than one
    in a thousand of all places, of which there are fewer than a thousand, are looked up by broadcast and
    not dealt by their hashes.
    """
    marks = [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]
    found = occurrences(docs, min_chars, short).groupBy("line").agg(F.count("*").alias("n"))
    # frequent lines get small ids, which lead
    rank = F.lit(31) - F.least(F.lit(31), F.floor(F.log2(F.col("n")))).cast("long")
    lines = written(found.select((F.shiftleft(rank, 58) + F.monotonically_increasing_id()).alias("id"), "line", "n"), "lines")
    roots = similar(lines, width, least)
    tagged = lines.select("id", *marks, "n").join(roots.withColumnRenamed("node", "id"), "id", "left").filter("root is not null or n > 1")
    of = written(tagged.select("h1", "h2", F.coalesce("root", "id").alias("root"), "n"), "known")
    total = lines.agg(F.sum("n")).first()[0] or 0
    discard(lines, roots)
    often = F.col("n") * 1000 > total
    hot = of.filter(often).select("h1", "h2", F.col("root").alias("hot"))
    cold = of.filter(~often).select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "text_hash")
    every = occurrences(docs, min_chars, short).select(*marks, place.alias("place")).join(F.broadcast(hot), ["h1", "h2"], "left")
    # what is known already is dealt out by its place
    dealt = every.withColumn("k1", F.when(F.col("hot").isNull(), F.col("h1")).otherwise(F.xxhash64("h1", "place.doc_id", "place.at")))
    named = dealt.join(cold, (F.col("k1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left").select(F.coalesce("hot", "root").alias("root"), "place")
    places = written(named.filter("root is not null"), "places")
    kept = places.groupBy("root").agg(F.min("place").alias("kept")).select("kept")
    lost = places.join(kept, F.col("place").eqNullSafe(F.col("kept")), "left_anti")
    out = written(lost.groupBy("place.doc_id", "place.text_hash").agg(F.array_sort(F.collect_set("place.at")).alias("removed")), "removed")
    discard(of, places)
    return out


#: The lines of a text without those at the places in x.r, as the runs between them.
_WITHOUT = """
transform(array(named_struct('l', split({text}, '\n'), 'r', removed)), x -> array_join(flatten(transform(sequence(0, size(x.r)), k ->
  slice(x.l, if(k = 0, 0, get(x.r, k - 1) + 1) + 1, if(k = size(x.r), size(x.l), get(x.r, k)) - if(k = 0, 0, get(x.r, k - 1) + 1)))), '\n'))[0]
"""


def dedup_lines(docs: DataFrame, min_chars: int = 40, width: int = 7, least: float = 0.8, short: bool = False) -> DataFrame:
    """docs with text without repeated lines, n_lines (before) and n_removed.

    Lines are what stands between line feeds. Those of fewer than min_chars characters are kept or,
    with short, treated as all others if they have a word; blank ones give texts their form. Among the
    others, lines whose sets of `width`-character shingles have a Jaccard similarity of `least` or more
    link, and of each component the first line by (doc_id, place) stays, null ids last. A line shorter
    than a shingle links only with equal ones. Candidates share one of 20 bands of 4 MinHashes (0.995 of
    the pairs at exactly 0.8, nearly all above 0.85); the comparison itself is exact. A text that loses all its lines is empty. A null text stays null with no lines; rows with
    equal doc_id and text are one document and keep the same lines; an empty table gives no rows; other
    columns are kept as they are, but for n_lines, n_removed and removed. Texts and lines are told apart
    by 64 and 128 bits of hashes.
    """
    lost = removed_lines(docs, min_chars, width, least, short).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    text = F.col("text").cast("string")
    joined = docs.drop("n_lines", "n_removed", "removed").join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash")), "left")
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
            "text": F.when(F.col("removed").isNull(), text).otherwise(F.expr(_WITHOUT.format(text="cast(text as string)"))),
        }
    ).drop("removed", "__id", "__hash")
