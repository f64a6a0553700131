"""Fuzzy line deduplication by MinHash. DataFrame functions only.

Lines are told apart by a 64-bit hash (checked by a second one). The shingles of a line are its runs of eight UTF-16
units (a shorter line is one shingle). MINS minimum hashes over the shingles make the signature; bands of three
of them (each is in three bands) give the buckets: two lines at a similarity of 0.8 share one with a probability of
0.986. Pairs of lines in a bucket
(linking.py) are verified by the exact Jaccard similarity of their shingle sets, all of them but those that other links
connect, and union-find makes components. Of each component one line stays: the first one in the document with the
smallest id; all others go, whether copies or near-duplicates.

The minima are computed without a row per shingle: a line is cut into overlapping chunks of CHUNK shingles, whose hashes
are columns of one generated row; least() over them gives the chunk's minima and a partial aggregation the line's.

Edge cases. Lines are separated by \\n. Blank lines (white space only) stay, and so does everything in documents with a
null id. A null text stays null. Documents that lose all lines keep an empty text. Rows with one id and different texts
are different documents, in the order of a hash of their texts; rows that repeat id and text are one document, and each
keeps what it keeps. Lines whose first hashes collide while the second ones differ are left alone. Very long lines are
treated in full. An empty table gives no rows. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import counted, cut, release, small, text_of
from .linking import components, links_in_buckets

SHINGLE, CHUNK, MINS, SIMILARITY = 8, 16, 10, 0.8
#: Which minima make a band: those so far on in a ring.
BAND = (0, 1, 3)
#: Words of the bitmaps that tell lines apart.
WORDS = 64
#: Pairs of lines, and hashes of lines whose texts are wanted, that are broadcast at most: 3 MB, 10 MB.
PAIRS, WANTED = 100_000, 500_000
#: Documents with lines to go that are broadcast at most, with ten lines each on average.
FLAGS = 200_000


def lines_of(docs: DataFrame) -> DataFrame:
    """doc (id and mark, a hash of the text), pos, line, h1, h2 of the lines that take part."""
    doc = F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_of()).alias("mark")).alias("doc")
    x = docs.where("doc_id is not null").select(doc, F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
    x = x.where(F.col("line").rlike(r"\S"))
    return x.select("doc", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def constant(j: int) -> int:
    """A 32-bit constant for the jth hash function."""
    x = (j + 1) * 0x9E3779B97F4A7C15 % 2**64
    return (x >> 32) - 2**31


def chunks(lines: DataFrame) -> DataFrame:
    """h1, h2, first (whether it is the line's first) and x0, x1, ... for each chunk of CHUNK shingles of each line: the
    hashes of its shingles. Places beyond the last shingle repeat the last one."""
    units = F.encode("line", "UTF-16BE")
    count = F.greatest(F.lit(1), (F.length(units) / 2 - (SHINGLE - 1)).cast("int"))
    x = lines.select("h1", "h2", units.alias("b"), count.alias("n"))
    x = x.select("h1", "h2", "n", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK))).alias("c"))
    chunk = F.expr(f"substring(b, 2 * c + 1, {2 * (CHUNK + SHINGLE - 1)})")
    x = x.select("h1", "h2", "c", F.least(F.lit(CHUNK), F.col("n") - F.col("c")).alias("here"), chunk.alias("k"))
    made = [F.hash(F.expr(f"substring(k, 2 * least({i}, here - 1) + 1, {2 * SHINGLE})")).alias(f"x{i}") for i in range(CHUNK)]
    return x.select("h1", "h2", (F.col("c") == 0).alias("first"), *made)


def signed_lines(lines: DataFrame) -> DataFrame:
    """Per line hash h1: how often it comes up, and the minima m0, m1, ... Lines whose second hashes differ are left out."""

    def low(j: int) -> Column:
        return F.min(F.least(*[F.col(f"x{i}").bitwiseXOR(F.lit(constant(j))) for i in range(CHUNK)])).alias(f"m{j}")

    times = F.sum(F.col("first").cast("long")).alias("times")
    second = [F.min("h2").alias("_lo"), F.max("h2").alias("_hi")]
    x = chunks(lines).groupBy("h1").agg(times, *second, *[low(j) for j in range(MINS)])
    return x.where("_lo = _hi").drop("_lo", "_hi")


def shingles(line: Column) -> Column:
    """64-bit hashes of the different shingles of a line."""

    def of(units: Column) -> Column:
        n = F.greatest(F.lit(1), (F.length(units) / 2 - (SHINGLE - 1)).cast("int"))
        at = F.sequence(F.lit(0), n - 1)
        return F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.substr(units, 2 * i + 1, F.lit(2 * SHINGLE)))))

    # through an array of one, so that the line is encoded once and not once a shingle
    return F.element_at(F.transform(F.array(F.encode(line, "UTF-16BE")), of), 1)


class Lines:
    """For linking.py: the candidate lines, what tells pairs of them apart early, and the verification."""

    def __init__(self, lines: DataFrame):
        self.lines = lines.select("h1", "line")
        self.texts = None

    def verifier(self, ids: DataFrame):
        """Pairs (a, b) of line hashes -> those with an exact Jaccard similarity of SIMILARITY or more."""
        wanted = ids.select(F.col("id").alias("h1"))
        if counted(ids) <= WANTED:
            mine = self.lines.join(F.broadcast(wanted), "h1", "left_semi").dropDuplicates(["h1"])
        else:  # each task sends a line once, however often it comes up
            mine = self.lines.dropDuplicates(["h1"]).join(wanted, "h1", "left_semi")
        self.texts = cut(mine)
        one, two = (self.texts.select(F.col("h1").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")

        def verify(pairs: DataFrame) -> DataFrame:
            if counted(pairs) <= PAIRS:  # the texts of these pairs are sent, and not all
                few = F.broadcast(pairs)
                x = one.join(few, "a").join(two.join(few, "b"), ["a", "b"])
            else:
                x = pairs.join(one, "a").join(two, "b")
            return x.where(similar(F.col("la"), F.col("lb"))).select("a", "b")

        return verify

    def hinter(self, ids: DataFrame) -> tuple[DataFrame, None]:
        """id, hint: the number of a line's shingles, and a bitmap of them. A line's own shingles are all that is looked
        at, for what is gathered by shingle, over all lines, takes many times the disk of the lines."""
        mine = self.texts.join(small(ids.select(F.col("id").alias("h1")), 200_000), "h1").select("h1", shingles(F.col("line")).alias("s"))
        mine = mine.select("h1", F.size("s").alias("n"), firsts("s").alias("v"))
        return cut(mine.select(F.col("h1").alias("id"), F.struct("n", bitmap(F.col("v")).alias("bits"), F.size("v").alias("set")).alias("hint"))), None


def similar_with(m: Column, n: Column, both: Column) -> Column:
    """Whether lines of m and n shingles are similar that share so many."""
    return both >= SIMILARITY * (m + n - both)


def similar(one: Column, two: Column) -> Column:
    """Whether two lines have an exact Jaccard similarity of SIMILARITY or more. One expression that names the shingles of
    each line once: columns of them are put in wherever they are used, and a line's shingles made as often."""

    def of_sets(p: Column) -> Column:
        m, n = F.size(p["x"]), F.size(p["y"])
        shared = F.transform(F.array(F.size(F.array_intersect(p["x"], p["y"]))), lambda both: similar_with(m, n, both))
        return similar_with(m, n, F.least(m, n)) & F.element_at(shared, 1)

    both = F.struct(shingles(one).alias("x"), shingles(two).alias("y"))
    return F.element_at(F.transform(F.array(both), of_sets), 1)


def firsts(s: str) -> Column:
    """The different first 12 bits of the hashes of a line's shingles."""
    return F.array_distinct(F.transform(s, lambda x: F.shiftrightunsigned(x, 52).cast("int")))


def bitmap(values: Column) -> Column:
    """WORDS words of 64 bits, where the bits with these numbers are set. The numbers are dealt out in two steps, which
    looks at each 16 times and not 64 times."""

    def word(mine: Column, w: Column) -> Column:
        here = F.filter(mine, lambda v: F.shiftright(v, 6).bitwiseAND(F.lit(7)) == w)
        one = F.lit(1).cast("long")
        return F.aggregate(here, F.lit(0).cast("long"), lambda s, v: s.bitwiseOR(F.call_function("shiftleft", one, v.bitwiseAND(F.lit(63)))))

    eight = F.sequence(F.lit(0), F.lit(7))
    parts = F.transform(F.sequence(F.lit(0), F.lit(WORDS // 8 - 1)), lambda p: F.filter(values, lambda v: F.shiftright(v, 9) == p))
    return F.flatten(F.transform(parts, lambda mine: F.transform(eight, lambda w: word(mine, w))))


def close(x: Column, y: Column, once: Column) -> Column:
    """False if the numbers of two lines' shingles, or the bits that only one of them has, are too far apart."""
    zero = F.lit(0)
    shared = F.aggregate(F.zip_with(x["bits"], y["bits"], lambda a, b: F.bit_count(a.bitwiseAND(b))), zero, lambda s, v: s + v)
    # a bit that only one has is of a shingle that only it has
    both = F.least(x["n"] - x["set"], y["n"] - y["set"]) + shared
    return similar_with(x["n"], y["n"], F.least(x["n"], y["n"])) & once & similar_with(x["n"], y["n"], both)


def decisions(docs: DataFrame) -> DataFrame:
    """doc, pos of the lines that go."""
    lines = lines_of(docs)
    # the signatures go as soon as the buckets are known, not to lie on disk beside what follows
    held = [signed_lines(lines).persist()]
    again = cut(held[0].where("times > 1").select("h1"))
    bands = [F.xxhash64(F.lit(b), *[F.col(f"m{(b + d) % MINS}") for d in BAND]) for b in range(MINS)]
    rows = [held[0].select(F.col("h1").alias("id"), F.explode(F.array(*bands)).alias("bucket"))]
    candidates = Lines(lines)
    links = cut(links_in_buckets(rows.pop(), candidates.verifier, close, candidates.hinter, after=lambda: held.pop().unpersist()))
    roots = components(links).withColumnRenamed("id", "h1")
    # all linked lines have a root, whether they come up once or more often
    known = cut(again.join(roots, "h1", "full").select("h1", F.coalesce("root", "h1").alias("root")))
    del again, candidates
    x = cut(lines.select("doc", "pos", "h1").join(small(known), "h1").select("doc", "pos", "root"))
    stays = cut(x.groupBy("root").agg(F.min(F.struct("doc", "pos")).alias("stays")))
    return x.join(small(stays), "root").where(F.struct("doc", "pos") != F.col("stays")).select("doc", "pos")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that go taken out of text, and columns n_lines and n_dropped."""
    flags = decisions(docs).groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    flags = cut(flags.select(F.col("doc.id").alias("_id"), F.col("doc.mark").alias("_mark"), "_gone"))
    release(docs.sparkSession)
    if counted(flags) <= FLAGS and (flags.agg(F.sum(F.size("_gone"))).first()[0] or 0) <= 10 * FLAGS:
        flags = F.broadcast(flags)
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(text_of()) == F.col("_mark"))
    x = docs.join(flags, same, "left").drop("_id", "_mark")
    all_lines = F.split(F.col("text"), "\n", -1)

    def kept(both: Column) -> Column:
        """both: lines and bounds. The runs of lines between dropped places."""
        at, lines = both["bounds"], both["lines"]

        def run(i: Column) -> Column:
            return F.slice(lines, F.element_at(at, i) + 2, F.element_at(at, i + 1) - F.element_at(at, i) - 1)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(at) - 1), run))

    bounds = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(all_lines)))
    # through an array of one, so that the text is split once and not once a run
    left = F.element_at(F.transform(F.array(F.struct(all_lines.alias("lines"), bounds.alias("bounds"))), kept), 1)
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    x = x.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(all_lines)))
    x = x.withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")))
    return x.withColumn("text", text).drop("_gone")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, text and n_chars without the lines that go; the columns of docs."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
