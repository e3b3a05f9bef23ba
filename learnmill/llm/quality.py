"""Operator 2, quality rules: line-first cleaning.

Each line is judged alone by three rules; lines that fail are removed, and a document that loses too much
of its text is rejected. DataFrame functions only. A line with a word fails as

- punctuation: it does not end in a closing mark and has fewer than two closed sentences inside, or more than
  ``max_symbol_runs`` of its words hold two or more marks in a row;
- navigation: it has two or more bar, arrow or bullet separators standing alone as words;
- boilerplate: it has one of the phrases of BOILERPLATE.

Lines without words never fail and count for nothing. Everything happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words_of

#: Phrases of boilerplate, lower case.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies", "enable javascript",
    "lorem ipsum", "licensed under", "sign up", "log in", "click here", "subscribe to", "copyright ©", "©",
)
SYMBOLS = r"[#*$%&|<>]+"
BLANK = r"[\x20\x09-\x0D]"
CLOSED = rf"[.!?…。！？:;][\x22'”’»)\]]*{BLANK}*\z"
SENTENCES = rf"[.!?…。！？]{BLANK}[^\n]*[.!?…。！？]{BLANK}"
MARKS = r"[^\p{L}\p{N}\s]{2}"
SEPARATOR = r"([|»›•·>/]|::)"
NAVIGATION = rf"(^|{BLANK}){SEPARATOR}{BLANK}([^\n]*{BLANK})?{SEPARATOR}({BLANK}|\z)"
#: Most different repeated hashes that are looked up one by one; texts with more have all windows sorted.
LOOK_UP = 2000


def n_word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, BLANK + "+", ""))


def has_word(line: Column) -> Column:
    return F.rlike(line, F.lit(r"[^\x20\x09-\x0D]"))


def word_counts(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text column without nulls."""
    lines = F.filter(F.split(text, "\n"), has_word)
    return {
        "_words": let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.concat_ws("", w)).cast("long").alias("chars"), repeat_words(w).cast("long").alias("repeat"))),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_words": F.col("_words.n"),
        "word_chars": F.col("_words.chars"),
        "n_repeat_words": F.col("_words.repeat"),
    }


def repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more among the words, first included.

    Windows are hashed; where all hashes differ (a hash set tells) there are none. Otherwise the windows whose hash
    comes again are compared as strings: sorted with their places, those equal to a neighbour are repeated. Each
    repeated place covers three words, less what the place before it covers already."""

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    def repeated(places: Column) -> Column:
        pairs = F.array_sort(F.transform(places, lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("x"), i.alias("i"))))

        def same(s: Column, p: Column, k: Column) -> Column:
            return F.coalesce(p["x"] == F.get(s, k)["x"], F.lit(False))

        def twice(s: Column) -> Column:
            return F.filter(F.transform(s, lambda p, k: F.when(same(s, p, k - 1) | same(s, p, k + 1), p["i"])), lambda i: i.isNotNull())

        return let(pairs, lambda s: covered(F.array_sort(twice(s))))

    def among(h: Column) -> Column:
        again = let(F.array_sort(h), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (x == F.coalesce(F.get(s, k - 1), x - 1)))))
        places = F.sequence(F.lit(0), F.size(h) - 1)
        return let(again, lambda d: repeated(F.when(F.size(d) > LOOK_UP, places).otherwise(F.filter(places, lambda i: F.array_contains(d, h[i])))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(among(h)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(found)


def line_fails(line: Column, max_symbol_runs: float) -> Column:
    """True for a line that has a word and breaks a rule."""
    open_end = ~(F.rlike(line, F.lit(CLOSED)) | F.rlike(line, F.lit(SENTENCES)))
    noisy = F.rlike(line, F.lit(MARKS)) & let(words_of(line), lambda w: F.size(F.filter(w, lambda x: F.rlike(x, F.lit(MARKS)))) > max_symbol_runs * F.size(w))

    def boilerplate(low: Column) -> Column:
        found = F.contains(low, F.lit(BOILERPLATE[0]))
        for phrase in BOILERPLATE[1:]:
            found = found | F.contains(low, F.lit(phrase))
        return found

    return has_word(line) & (open_end | noisy | F.rlike(line, F.lit(NAVIGATION)) | let(F.lower(line), boilerplate))


def clean_lines(docs: DataFrame, text_col: str = "text", max_loss: float = 0.5, max_symbol_runs: float = 0.3, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with columns added: the counts of word_counts, base_failed, clean_text (the lines kept, joined by
    newlines), n_lines_removed, lost_share (word characters removed of all) and kept.

    base_failed: fewer than min_words words, or over max_repeat_percent of them in repeated windows. kept:
    not base_failed, and lost_share at most max_loss. Null and empty texts have no words and fail. Columns of
    docs with names of added ones are replaced; rows are judged one by one, so order and repeats don't matter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    for name, column in word_counts(text).items():
        out = out.withColumn(name, column)
    lines = F.split(text, "\n")
    failing = F.filter(lines, lambda x: line_fails(x, max_symbol_runs))
    out = out.withColumn("_failing", let(failing, lambda x: F.struct(F.size(x).cast("long").alias("n"), n_word_chars(F.concat_ws(" ", x)).alias("chars"))))
    out = out.withColumns({"clean_text": F.concat_ws("\n", F.filter(lines, lambda x: ~line_fails(x, max_symbol_runs))), "n_lines_removed": F.col("_failing.n")})
    out = out.withColumn("lost_share", F.when(F.col("word_chars") > 0, F.col("_failing.chars") / F.col("word_chars")).otherwise(0.0)).drop("_words", "_failing")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_loss))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rules) -> DataFrame:
    """The verdict columns alone: counts, base_failed, kept."""
    cleaned = clean_lines(docs.select(id_col, text_col), text_col, **rules)
    return cleaned.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
