"""Quality of texts, line first: bad lines go, then texts that lost too much.

Each line is held against rules on its own: a line without an end of sentence that is as
short as a heading or menu entry, a chain of links between separators, a line full of
symbols, a boilerplate phrase, and a line that stood in the text before.  Lines that fail
are removed; a text that loses more than ``LOSS`` of its words is rejected, as is one that
fails the stated base rules.

Everything is SQL functions on one row, so no row is shuffled.  Windows of three words
are compared by 64-bit hashes within one text.

Null and empty texts have no words and fail the base.  Repeated rows are judged alike;
an empty table gives an empty one; columns that carry the names of the results are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.urls import let

GAP = r"[\x20\x09-\x0D]"
#: Share of its words that a text may lose.
LOSS = 0.5
#: Words below which a line needs an end of sentence, and up to which a boilerplate phrase condemns it.
SHORT, PHRASE = 8, 25
ENDED = r"""[.!?:;…。！？"'”’»)\]][\x20\x09-\x0D]*$"""
SEPARATORS, SYMBOLS = "|>»›·•", "#*$%&|<>"
SEPARATOR = f"[{SEPARATORS}]"
BOILERPLATE = (
    r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|newsletter|sign (up|in)\b|log ?in\b"
    r"|click here|read more|share (this|on)|javascript|©|copyright|powered by|back to top|skip to|lorem ipsum)")
#: One of these stands in every lower-cased text with a boilerplate phrase.
PHRASES = ("cookie", "privacy policy", "terms of", "rights reserved", "subscribe", "newsletter", "sign up", "sign in", "login",
           "log in", "click here", "read more", "share ", "javascript", "©", "copyright", "powered by", "back to top", "skip to",
           "lorem ipsum")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three that is found twice or more.

    The windows' hashes are sorted with their places; neighbours that agree are repeats.
    A text whose hashes are all distinct needs no sorting.
    """
    n = F.size(words)
    hashes = F.when(n > 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(
        F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))

    def covered(sorted_: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        again = F.filter(sorted_, lambda x, j: same(x, F.get(sorted_, j - 1)) | same(x, F.get(sorted_, j + 1)))
        places = F.sort_array(F.transform(again, lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct(
            (p + 3).alias("end"), (s["n"] + p + 3 - F.greatest(p, s["end"])).alias("n")), lambda s: s["n"])

    def counted(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(placed, covered)).otherwise(F.lit(0))

    return F.coalesce(let(hashes, counted), F.lit(0)).cast("long")


def _any(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def lines_of(text: Column) -> Column:
    """The lines with a word: (line, words, rule that it fails or null), by line rules alone.

    Searches that read each line again are left out where the whole text has no sign of them.
    """
    def judged(line: Column, seen: Column) -> Column:
        words = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
        separators = F.regexp_count(line, F.lit(SEPARATOR))
        symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]"))
        return let(words, lambda n: F.struct(
            line.alias("line"), n.alias("words"),
            F.when(seen["separators"] & (separators >= 3) & (separators * 4 >= n), F.lit("navigation"))
            .when(seen["symbols"] & (symbols * 2 > n), F.lit("symbols"))
            .when(seen["phrases"] & (n <= PHRASE) & line.rlike(BOILERPLATE), F.lit("boilerplate"))
            .when((n < SHORT) & ~line.rlike(ENDED), F.lit("punctuation")).alias("rule")))

    signs = F.struct(_any(text, SEPARATORS).alias("separators"), _any(text, SYMBOLS).alias("symbols"),
                     let(F.lower(text), lambda t: _any(t, PHRASES)).alias("phrases"))
    return let(signs, lambda seen: F.filter(F.transform(F.split(text, "\n"), lambda x: judged(x, seen)), lambda x: x["words"] > 0))


def clean(docs: DataFrame, loss: float = LOSS) -> DataFrame:
    """The table with the base counts, ``base_failed``, ``cleaned`` (the text of the lines that
    stay), ``lost`` (share of the words in lines removed), ``failed_lines`` and ``kept``.

    Of equal lines the first stays, as ``array_distinct`` keeps it.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned", "lost",
            "failed_lines", "kept")
    columns = [c for c in docs.columns if c not in made and c != "_llm"]
    text = F.coalesce("text", F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(_any(text, SYMBOLS), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0))
            .cast("long").alias("n_symbols"),
            repeated_words(words).alias("n_repeat_words"))

    def lines(all_: Column) -> Column:
        return let(F.array_distinct(all_), lambda once: let(F.filter(once, lambda x: x["rule"].isNull()), lambda good: F.struct(
            (F.size(all_) - F.size(once)).cast("long").alias("n_dup_lines"),
            F.concat_ws("\n", F.transform(good, lambda x: x["line"])).alias("cleaned"),
            F.aggregate(good, F.lit(0).cast("long"), lambda s, x: s + x["words"]).alias("words"),
            (F.size(all_) - F.size(good)).cast("long").alias("failed_lines"))))

    found = docs.select(*columns, F.struct(let(_words(text), counts).alias("w"), let(lines_of(text), lines).alias("l")).alias("_llm"))
    w, line = F.col("_llm.w"), F.col("_llm.l")
    flat = found.select(*columns, w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"),
                        w["n_symbols"].alias("n_symbols"), line["n_dup_lines"].alias("n_dup_lines"),
                        w["n_repeat_words"].alias("n_repeat_words"), line["cleaned"].alias("cleaned"),
                        line["failed_lines"].alias("failed_lines"),
                        F.coalesce(1 - F.try_divide(line["words"], w["n_words"]), F.lit(0.0)).alias("lost"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return flat.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= loss))


def digest(docs: DataFrame) -> DataFrame:
    """The stated counts and verdict of every document, with the share of words lost."""
    return clean(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost", "failed_lines")
