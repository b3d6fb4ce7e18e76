"""Line dedup: later repeats of line runs of ``MIN_WORDS`` words or more go.

A run is a stretch of lines with a word in one document.

1. Winnowing.  Every line opens the shortest window of following lines that
   holds ``MIN_WORDS`` words.  The window's smallest line hash (the first of
   equals) is selected, with its position; neighbouring windows mostly select
   the same one, and it is posted once.  Two equal windows select the same line
   of theirs, so a repeated run that is long enough is guaranteed to have a
   posting at the same place in both copies.
2. Postings are joined with the fingerprints that are posted more than once;
   the others, and with them most of a text, go no further.
3. Matches are extended both ways.  A posting holds the line hashes around it,
   under ``MIN_WORDS`` words to either side.  From the fingerprint, a match that
   reaches i lines back must reach on until it holds ``MIN_WORDS`` words, and one
   that reaches j lines on must reach back as far: these are all of the least
   extents that a match through this fingerprint can have, and any longer match
   is a union of such extents of its postings.  Extents are compared by the hash
   of their lines.
4. Of equal extents the earliest stays, by (id, text hash, line number), and the
   lines of all later ones are deleted, with the blank lines inside them.

Only the earliest place of each extent is joined, found by a pre-aggregated
minimum, so a passage in a third of all documents costs a row each, not pairs.

DataFrame functions only.  Edge cases: null and empty texts stay as they are; a
text whose lines all go becomes empty; rows alike in id and text are one
document and share its fate; null ids come last in order; a repeat inside one
document counts; other columns pass through untouched, and an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .skew import join_counted
from .store import Scratch, materialize

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50

def postings(docs: DataFrame, min_words: int, id_col: str, text: str) -> DataFrame:
    """(d, t, pos, mark, opening, closing): the selected lines, each with the lines around it.

    ``opening`` holds the lines that begin under ``min_words`` words away,
    ``closing`` those that end so: between them, all that an extent through the
    selected line can hold.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("t"), F.split(text, "\n", -1).alias("lines"))
    line = rows.select("d", "t", F.posexplode("lines").alias("pos", "line")).select("d", "t", "pos", F.regexp_count("line", F.lit(WORD)).alias("words"), F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g")).filter("words > 0")
    # rows alike in id and text are one document; they meet before any task holds all of them
    line = line.groupBy("d", "t", "pos").agg(*(F.first(c).alias(c) for c in ("words", "h", "g")))
    doc, less = Window.partitionBy("d", "t"), min_words - 1
    line = line.withColumn("upto", F.sum("words").over(doc.orderBy("pos"))).withColumn("ahead", F.col("upto") - F.col("words"))
    begin, end = doc.orderBy("ahead"), doc.orderBy("upto")
    shortest = begin.rangeBetween(0, less)
    line = line.withColumn("picked", F.when(F.sum("words").over(shortest) > less, F.min(F.struct("h", "pos")).over(shortest)["pos"]))
    near = F.struct("pos", "ahead", "upto", "g")
    line = line.withColumn("selected", F.array_contains(F.collect_list("picked").over(begin.rangeBetween(-less, 0)), F.col("pos")))
    line = line.withColumn("opening", F.when(F.col("selected"), F.collect_list(near).over(begin.rangeBetween(-less, less))))
    line = line.withColumn("closing", F.when(F.col("selected"), F.collect_list(near).over(end.rangeBetween(-less, less))))
    return line.filter("selected").select("d", "t", "pos", F.col("h").alias("mark"), "opening", "closing")


def extents(shared: DataFrame, min_words: int) -> DataFrame:
    """(d, t, mark, body, a, b): the least extents of matches through each posting."""

    def extent(lines: Column) -> Column:
        first, last = lines[0], F.element_at(lines, -1)
        fits = (last["upto"] - first["ahead"] >= min_words) & (first["pos"] <= F.col("pos")) & (last["pos"] >= F.col("pos"))
        return F.when(fits, F.struct(F.xxhash64(F.transform(lines, lambda x: x["g"])).alias("body"), first["pos"].alias("a"), last["pos"].alias("b")))

    def reach(column: str, back: bool) -> Column:
        ends = F.filter(column, lambda x: x["pos"] >= F.col("pos") if back else x["pos"] <= F.col("pos"))
        key = "upto" if back else "ahead"
        gap = lambda x, y: y[key] - x[key] if back else x[key] - y[key]
        return F.transform(ends, lambda y: extent(F.filter(column, lambda x: gap(x, y).between(0, min_words - 1))))

    found = shared.select("d", "t", "mark", F.explode(F.array_distinct(F.concat(reach("opening", False), reach("closing", True)))).alias("e"))
    return found.filter("e is not null").select("d", "t", "mark", "e.body", "e.a", "e.b")


def repeated_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _text, _gone): the line numbers that go, for each text that loses any."""
    with Scratch(spark) as own:
        posted = own.write(postings(docs, min_words, id_col, text), "postings")
        marks = own.write(posted.groupBy("mark").agg(F.count("*").alias("many")).filter("many > 1"), "marks")
        found = own.write(extents(join_counted(posted, marks, ["mark"]), min_words), "extents")

        place = F.struct(F.col("d").isNull().alias("late"), "d", "t", "a")
        first = found.groupBy("mark", "body").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("many")).filter("first <> last").drop("last")
        first = own.write(first, "first")
        later = join_counted(found, first, ["mark", "body"]).filter(place != F.col("first")).select("d", "t", "a", "b")
        # overlapping runs become stretches that share no line
        before = Window.partitionBy("d", "t").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
        cut = later.withColumn("a", F.greatest("a", F.max("b").over(before) + 1)).filter("a <= b")
        gone = cut.groupBy(F.col("d").alias("_id"), F.col("t").alias("_text")).agg(F.flatten(F.collect_list(F.sequence("a", "b"))).alias("_gone"))
        return materialize(spark, gone, "gone")


def drop_repeats(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with later repeats cut out of the text.

    With ``counts``, n_lines and n_removed follow the columns of ``docs``, in place of columns so named.
    """
    gone = repeated_lines(spark, docs, min_words, id_col, text)
    # the row travels as one struct, so no column of it can clash with a name used here
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_own"), F.xxhash64(text).alias("_key"))
    # both sides grow with the corpus, so they meet by a shuffle at any size
    joined = rows.join(gone.hint("merge"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left")
    old = F.col("_row").getField(text)
    lines = F.split(old, "\n", -1)
    kept = lambda n: F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone"))
    # a text is split once: its lines are the one element that the outer function sees
    new = F.transform(F.array(lines), lambda own: F.array_join(F.transform(kept(F.size(own)), lambda i: own[i]), "\n"))[0]
    new = F.when(F.col("_gone").isNull(), old).otherwise(new)
    out = [(new if c == text else F.col("_row").getField(c)).alias(c) for c in docs.columns if c == text or not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)
