"""Nations named in texts: a gazetteer of names, longest spans first, and hints against namesakes.

Words of a text meet the names by a word of theirs, in a hash join against the broadcast gazetteer where it is
small; the name itself is compared at that place. A name inside a longer one found is dropped by one running
maximum over the spans of a text, in the order of their beginnings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presswave.functions.expressions import let
from presswave.operators.lookup import sized

#: A word of a name: letters and digits of ASCII, and apostrophes; what stands beside a name must be none.
WORD = r"[a-z0-9']+"
#: A bare name of these nations needs one of these in its text.
HINTS = {
    "GE": ("georgian", "tbilisi", "caucasus", "south ossetia", "abkhazia", "saakashvili", "republic of georgia", "georgia (country)"),
    "JO": ("jordanian", "amman", "king abdullah", "middle east", "levant", "kingdom of jordan", "hashemite kingdom"),
    "TD": ("chadian", "n'djamena", "ndjamena", "sahel", "lake chad", "republic of chad"),
    "NE": ("nigerien", "niamey", "sahel", "republic of niger"),
    "ML": ("malian", "bamako", "sahel", "timbuktu", "republic of mali"),
}
#: With one of these a bare name is another place.
CONTRARY = {"GE": ("atlanta", "savannah", "augusta", "fulton county", "kemp", "stacey abrams", "raphael warnock", "jon ossoff", "governor kemp", "state of georgia")}


#: Where a word of ``WORD`` begins: texts are cut there, so a piece is a word and what follows it.
CUT = r"(?<![a-z0-9'])(?=[a-z0-9'])"
_PIECE = 1 << 31


def named_nations(texts: DataFrame, names: DataFrame, hints: dict[str, tuple[str, ...]] = HINTS, contrary: dict[str, tuple[str, ...]] = CONTRARY) -> DataFrame:
    """id, nations (sorted codes, empty if none) of every row of ``texts`` (id, text); ``names``: name, code, bare.

    ``bare``: the plain name of a nation. A code of ``hints`` of which only bare names are found counts with a hint anywhere in
    the text, one of ``contrary`` only without. Names need a character of ``WORD``; others are never found. Of equal
    names the least code counts. Rows of ``texts`` that repeat an id are one text each and share what is found.
    """
    pieces = F.split("name", CUT)
    table = names.select(F.lower(F.trim("name")).alias("name"), "code", "bare").groupBy("name").agg(F.min(F.struct("code", "bare")).alias("c"))
    table = table.select("c.code", "c.bare", F.regexp_extract("name", WORD, 0).alias("word"), (F.regexp_instr("name", F.lit(WORD)) - 1).alias("ahead"), "name", pieces.alias("p")).filter("word <> ''")
    table = table.select("code", "bare", "word", "ahead", F.substring("name", F.lit(1), F.col("ahead")).alias("lead"), F.expr("substring(name, ahead + 1)").alias("rest"), (F.size("p") - F.when(F.col("ahead") > 0, 1).otherwise(0)).alias("n"), F.length(F.element_at("p", -1)).alias("tail"))
    table = sized(table, "names")
    bounds = table.agg(F.max("n"), F.max("ahead")).first()
    most, ahead = bounds[0] or 1, bounds[1] or 0

    def told(x: Column, some: dict[str, tuple[str, ...]]) -> Column:
        held = [F.when(F.exists(F.array(*map(F.lit, words)), lambda h: F.contains(x, h)), F.lit(code)) for code, words in some.items()]
        return F.array_compact(F.array(*held, F.lit(None).cast("string")))

    rows = texts.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("x"))
    rows = rows.select("id", told(F.col("x"), hints).alias("hinted"), told(F.col("x"), contrary).alias("against"), F.split("x", CUT).alias("p"))
    cut = let(F.col("p"), lambda p: F.transform(p, lambda w, i: F.struct(i.cast("long").alias("i"), F.when(i > 0, F.right(F.get(p, i - 1), F.lit(ahead + 1))).otherwise("").alias("prev"), F.array_join(F.slice(p, i + 1, F.lit(most + 1)), "").alias("win"))))
    each = rows.select("id", "hinted", "against", F.explode(cut).alias("s")).select("id", "hinted", "against", "s.*", F.regexp_extract("s.win", "^" + WORD, 0).alias("word"))
    met = each.join(table, "word")
    after = F.expr("substring(win, length(rest) + 1, 1)")
    before = F.expr("substring(reverse(prev), ahead + 1, 1)")
    word = f"^{WORD}"
    found = met.filter(F.col("win").startswith(F.col("rest")) & ~after.rlike(word) & ((F.col("ahead") == 0) | (F.col("prev").endswith(F.col("lead")) & ~before.rlike(word))))
    spans = found.select("id", "hinted", "against", "code", "bare", (F.col("i") * _PIECE - F.col("ahead")).alias("start"), ((F.col("i") + F.col("n") - 1) * _PIECE + F.col("tail")).alias("end"))
    so_far = Window.partitionBy("id").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = spans.withColumn("reach", F.max("end").over(so_far)).filter("reach IS NULL OR reach < end")
    codes = outer.groupBy("id", "code").agg(F.bool_and("bare").alias("bare"), F.first("hinted").alias("hinted"), F.first("against").alias("against"))
    unsure = F.col("code").isin(*hints) & ~F.array_contains("hinted", F.col("code"))
    kept = codes.filter(~(F.col("bare") & (unsure | F.array_contains("against", F.col("code")))))
    lists = kept.groupBy("id").agg(F.sort_array(F.collect_list("code")).alias("nations"))
    return texts.select("id").join(lists, "id", "left").select("id", F.coalesce("nations", F.array().cast("array<string>")).alias("nations"))
