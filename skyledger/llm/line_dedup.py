"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier one (by document id, then place) has the same words, or
is one word edit away: a word replaced, added or left out. Lines of fewer than
`exact` words stay; the default excepts only blank ones. An edit counts if the
longer of both lines has `near` words at least; shorter lines go as equal ones
only. Characters of scripts without spaces (Chinese, Japanese, Thai) are words.

1. Equal lines become one representative, the earliest, by a 128-bit hash.
2. A line one edit away from another has its first or second half in common with
   it, so lines that share no half, cut for their own length and for one word
   less, have no neighbour. The others' texts are fetched, in the one shuffle of
   texts.
3. They emit all variants with one word deleted as hashed keys. A key is the XOR
   of one hash for each word and place, so each variant costs one step. A variant
   joins an equal variant with the same place deleted (a replaced word), or a
   line equal to it (an added word). All lines of a key are then one edit away
   from its earliest one, or from its one undeleted line: members are joined with
   that line alone, whatever the size of a key, and no pairs among them are made.
4. The words of joined lines are compared before a line goes.

Defined results: NULL and empty texts have no lines and stay; documents with a
NULL id stay as they are; rows with the same id and text are one document, so
neither goes because of the other. A document is told by its id and a hash of
its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.storage import stored

EXACT = 1
NEAR = 10
_ALONE = r"([\u0E00-\u0E7F\u3005-\u3007\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}])"
LINE = ["line_a", "line_b"]


def _words(line: Column) -> Column:
    """The words of a line; patterns are applied only to lines with a character they may match."""
    apart = F.when(F.octet_length(line) != F.length(line), F.regexp_replace(line, _ALONE, " $1 ")).otherwise(line)
    spaced = F.when(line.rlike(r"[\x09-\x0D]"), F.regexp_replace(apart, r"[\x09-\x0D]", " ")).otherwise(apart)
    return F.array_remove(F.split(spaced, " "), "")


def _halves(words: Column, n: Column) -> Column:
    """Keys of both halves for the own length, and for one word less."""
    half, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    cut = lambda kind, length, part: F.xxhash64(F.lit(kind), length, part)
    return F.array(
        cut("head", n, F.slice(words, F.lit(1), half)),
        cut("tail", n, F.slice(words, half + 1, n)),
        cut("head", n - 1, F.slice(words, F.lit(1), short)),
        cut("tail", n - 1, F.slice(words, short + 2, n)),
    )


def _xor(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda total, x: total.bitwiseXOR(x))


def _lines(docs: DataFrame, id: str, text: str, exact: int, near: int) -> DataFrame:
    """Lines of at least `exact` words: document, place, 128-bit hash, number of words, and half keys of lines long enough for edits."""
    rows = docs.where(f"`{id}` is not null").select(F.col(id).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode_outer(F.split(text, "\n")).alias("place", "line"))
    # A blank line is told by a look at it; a bound on the words would be pushed below them and count them twice.
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")) if exact > 0 else rows.where("line is not null")
    rows = rows.withColumn("words", _words(F.col("line"))).withColumn("n", F.size("words"))
    rows = rows.where(F.col("n") >= exact) if exact > 1 else rows
    hashes = [F.xxhash64("words").alias(LINE[0]), F.xxhash64(F.lit("second"), F.col("words")).alias(LINE[1])]
    return rows.select("doc", "body", "place", "n", *hashes, F.when(F.col("n") >= near - 1, _halves(F.col("words"), F.col("n"))).alias("halves"))


def _variants(rows: DataFrame, near: int) -> DataFrame:
    """All keys of each line: variants with a place deleted, variants as whole lines, and the line itself; only the last of lines under `near` words."""
    z = lambda place: F.transform("words", lambda w, i: F.xxhash64(w, i + place))
    # Hashes of the words before a place are combined by blocks of about the root of the length.
    rows = rows.withColumn("here", z(0)).withColumn("moved", z(-1)).withColumn("step", F.ceil(F.sqrt("n")).cast("int"))
    rows = rows.withColumn("both", F.zip_with("here", "moved", lambda a, b: a.bitwiseXOR(b)))
    count = F.ceil(F.col("n") / F.col("step")).cast("int")
    rows = rows.withColumn("blocks", F.transform(F.sequence(F.lit(0), count - 1), lambda b: _xor(F.slice("both", b * F.col("step") + 1, F.col("step")))))
    before = F.transform("blocks", lambda _, b: _xor(F.slice("blocks", F.lit(1), b)))
    # A slice copies the array it is taken from, so within a block only the block is sliced.
    heads = lambda block: F.transform(block, lambda _, k: _xor(F.slice(block, F.lit(1), k)))
    cut = lambda b: F.array(F.slice("both", b * F.col("step") + 1, F.col("step")))
    inside = F.flatten(F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.flatten(F.transform(cut(b), heads))))
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), *parts)
    at = lambda a, kind: F.struct(a.alias("key"), F.lit(kind).alias("kind"))

    def variants(line: Column) -> Column:
        def less(i: Column) -> Column:
            """The line without word i."""
            block = F.floor(i / F.col("step")).cast("int")
            head = F.get(line["before"], block).bitwiseXOR(F.get(line["inside"], i))
            return head.bitwiseXOR(line["shifted"]).bitwiseXOR(F.get("moved", i))

        replaced = F.transform("here", lambda h, i: at(key("place", "n", i, line["whole"].bitwiseXOR(h)), "place"))
        # distinct over numbers: over structs it compares all pairs
        shorter = F.array_distinct(F.transform("here", lambda _, i: key("line", F.col("n") - 1, less(i))))
        longer = F.transform(shorter, lambda k: at(k, "longer"))
        return F.concat(replaced, longer, F.array(at(key("line", "n", line["whole"]), "own")))

    # An array of one element binds these values for all places; as plain columns
    # the optimizer would move them into the functions and compute them for each.
    line = F.struct(before.alias("before"), inside.alias("inside"), _xor(F.col("here")).alias("whole"), _xor(F.col("moved")).alias("shifted"))
    keys = rows.withColumn("keys", F.flatten(F.transform(F.array(line), variants)))
    # The outer form, as the optimizer would compute the keys once more to leave out rows without any.
    return keys.select("first", "n", F.inline_outer("keys")).where((F.col("n") >= near) | (F.col("kind") == "own")).drop("n")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are at most one edit apart; the first is not the shorter."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda differs: differs)) <= 1
    until = F.coalesce(F.nullif(F.array_position(F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda x, y: x == y), False), F.lit(0)), F.size(b) + 1)
    until = until.cast("int")
    added = F.slice(a, until + 1, F.size(a)) == F.slice(b, until, F.size(a))
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == F.size(b) + 1, added).otherwise(False)


def _near(lines: DataFrame, reps: DataFrame, docs: DataFrame, id: str, text: str, near: int) -> DataFrame:
    """Representatives with an earlier line one edit away."""
    halves = reps.select(*LINE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min(LINE[0]).alias("low"), F.max(LINE[0]).alias("high")).where("low != high").select("half")
    # These lists grow with the corpus: sorted joins at every size.
    able = halves.join(stored(shared, "shared").hint("merge"), "half", "left_semi").select(*LINE).distinct()
    able = reps.drop("halves").join(stored(able, "able").hint("merge"), LINE, "left_semi")
    places = able.groupBy(F.col("first.doc").alias("doc"), F.col("first.body").alias("body")).agg(F.collect_list(F.struct("first.place", *LINE, "first")).alias("lines"))
    # Texts are sorted for this join at every size: the list of lines grows with the corpus.
    texts = docs.where(f"`{id}` is not null").select(F.col(id).alias("doc"), F.xxhash64(text).alias("body"), F.split(text, "\n").alias("all"))
    found = texts.join(stored(places, "places").hint("merge"), ["doc", "body"]).dropDuplicates(["doc", "body"])
    found = found.select("all", F.inline("lines")).select(*LINE, "first", _words(F.get("all", F.col("place"))).alias("words"))
    found = stored(found.withColumn("n", F.size("words")), "lines")

    variants = stored(_variants(found, near), "variants")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("first")))
    keys = variants.groupBy("key").agg(least("place").alias("place"), least("longer").alias("longer"), least("own").alias("own"), F.count("*").alias("size"))
    keys = stored(keys.where("size > 1").drop("size"), "keys")
    joined = variants.join(keys.hint("merge"), "key")
    hub = F.when(F.col("kind") == "place", F.col("place")).when(F.col("kind") == "longer", F.col("own")).otherwise(F.col("longer"))
    pairs = joined.withColumn("hub", hub).where("hub < first").select("first", "hub").distinct()
    both = stored(pairs, "pairs").join(found.select("first", *LINE, F.col("words").alias("a"), F.col("n").alias("a_n")), "first")
    both = both.join(found.select(F.col("first").alias("hub"), F.col("words").alias("b"), F.col("n").alias("b_n")), "hub")
    swap = F.col("a_n") < F.col("b_n")
    long, short = (F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("b", "a"), ("a", "b")))
    return both.where(F.greatest("a_n", "b_n") >= near).where(_one_edit(long, short)).select(*LINE).distinct()


def repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", exact: int = EXACT, near: int = NEAR) -> DataFrame:
    """`doc`, `body` (hash of the text) and the sorted places of the lines that go, for documents that lose any."""
    lines = stored(_lines(docs, id, text, exact, near), "lines")
    order = F.struct("doc", "body", "place")
    reps = stored(lines.groupBy(*LINE, "n", "halves").agg(F.min(order).alias("first"), F.max(order).alias("last")), "representatives")
    close = stored(_near(lines, reps.where(F.col("n") >= near - 1), docs, id, text, near), "near")
    known = reps.join(close.withColumn("near", F.lit(True)), LINE, "left").where("near or first != last").select(*LINE, "first", "near")
    gone = lines.select("doc", "body", "place", *LINE).join(stored(known, "known").hint("merge"), LINE).where(F.coalesce("near", F.lit(False)) | (F.struct("doc", "body", "place") > F.col("first")))
    return stored(gone.groupBy("doc", "body").agg(F.sort_array(F.collect_set("place")).alias("places")), "gone")


def without_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", exact: int = EXACT, near: int = NEAR) -> DataFrame:
    """The documents without repeated lines; one that has lost all lines with a word goes. All columns stay."""
    gone = repeated_lines(docs, id, text, exact, near).select(F.struct("doc", "body").alias("_doc"), F.col("places").alias("_places"))
    columns = {f"c{i}": c for i, c in enumerate(docs.columns)}  # no clash with the columns added here
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    back = {c: k for k, c in columns.items()}
    rows = rows.join(gone, F.struct(F.col(back[id]).alias("doc"), F.xxhash64(back[text]).alias("body")) == F.col("_doc"), "left")
    rows = rows.withColumn("_lines", F.split(back[text], "\n"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_places"), lambda i: F.get("_lines", i))
    rows = rows.withColumn("_left", F.when(F.col("_places").isNotNull(), F.array_join(left, "\n")))
    rows = rows.where(F.col("_left").isNull() | F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[(F.coalesce("_left", k) if c == text else F.col(k)).alias(c) for k, c in columns.items()])
