"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much go too.

Every rule looks at one line alone, so a page's menu or licence line goes and
the prose around it stays. What is left decides about the document: if failing
lines hold more than ``max_lost`` of its visible characters, it is rejected.
Statistics of the whole document (too few words, too many repeated 3-word
windows) reject it before that.

Everything is an expression on the row: no Python worker, no shuffle. Repeated
windows are found by one sort of 64-bit numbers per document, upper bits of a
window's hash and its place below them; windows that meet there are compared by
their words, so a chance meeting changes nothing. The places get as many bits as
the document needs, so no length is too long.

Defined results
* A null or empty text has no words and no lines, fails the base rules and is cleaned to ''.
* A line without a word passes every rule and weighs nothing.
* A document exactly at a limit passes it.
* Null and repeated ids are judged row by row. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import narrowed

MIN_WORDS = 50
MAX_REPEATED = 0.5
MAX_LOST = 0.3
# The white space between words, and the characters counted as symbols.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"

# The rules; each pattern means the same to Java and to RE2.
TERMINALS = ".!?…。！？:;\"'”’»)]"
SEPARATORS = "[|»›·•→]"
SHOUTS = "[!?]"
NAVIGATION = (
    r"(?i)^[^a-z]*(home|menu|log ?in|log ?out|sign ?(in|up)|register|next( page)?|prev(ious)?( page)?|back( to top)?|"
    r"skip to (main )?content|read more|show more|share( this)?|search|contact( us)?|about( us)?|site ?map|print|reply)[^a-z]*$"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|copyright (\(c\)|©|[0-9]{4})|licensed under|released under the|terms of (use|service)|privacy policy|"
    r"cookie policy|uses cookies|accept (all )?cookies|enable javascript|javascript (is )?(disabled|required)|subscribe to our|"
    r"follow us on|click here to|powered by|lorem ipsum)"
)
# A longer line is prose that mentions a notice, or no menu entry.
NOTICE_WORDS = 40


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def line_fails(line: Column, words: Column) -> Column:
    """Whether a line of ``words`` words (at least one) breaks a rule of punctuation, navigation or boilerplate."""
    last = F.right(F.rtrim(line, F.lit(SPACE_CHARS)), F.lit(1))
    # Prose ends a line as a sentence; marks on every word are no sentences.
    punctuation = (F.instr(F.lit(TERMINALS), last) == 0) | (F.regexp_count(line, F.lit(SYMBOLS)) * 5 > words) | (
        F.regexp_count(line, F.lit(SHOUTS)) * 3 > words * 2 + 4
    )
    navigation = (F.regexp_count(line, F.lit(SEPARATORS)) * 4 > words) | ((words <= NOTICE_WORDS) & line.rlike(NAVIGATION))
    boilerplate = (words <= NOTICE_WORDS) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many of the ``words`` lie in 3-word windows that occur more than once in the array.

    Each step is a column of its own, used more than once by the next one: what a lambda reads is computed once.
    """
    w, keys, met, same = F.col(words), F.col("__keys"), F.col("__met"), F.col("__same")
    n = F.size(w)

    def window(i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def neighbours_equal(array: Column, value) -> Column:
        """Of sorted elements, those whose ``value`` equals that of the one before or after."""
        return F.filter(
            array,
            lambda x, i: F.coalesce(value(x) == value(F.get(array, i - 1)), F.lit(False)) | F.coalesce(value(x) == value(F.get(array, i + 1)), F.lit(False)),
        )

    df = df.withColumn("__bits", F.length(F.bin(n.cast("bigint"))))
    bits = F.col("__bits")
    key = lambda i: F.call_function("shiftleft", F.xxhash64(*window(i)), bits).bitwiseOR(i.cast("bigint"))
    df = df.withColumn(
        "__keys",
        F.when((n >= 3) & (bits > 0), F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), key)))
        .otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("__met", neighbours_equal(keys, lambda x: F.call_function("shiftright", x, bits)))
    place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)).cast("int")
    df = df.withColumn(
        "__same",
        F.when(F.size(met) == 0, F.array().cast("array<struct<g:string,i:int>>"))
        .otherwise(F.sort_array(F.transform(met, lambda x: F.struct(F.concat_ws(" ", *window(place(x))).alias("g"), place(x).alias("i"))))),
    )
    df = df.withColumn("__places", F.sort_array(F.transform(neighbours_equal(same, lambda x: x["g"]), lambda x: x["i"])))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n"))
    # A window adds the words that the one before it has not covered.
    covered = F.aggregate(
        F.col("__places"), start,
        lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3))).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn(out, covered).drop("__bits", "__keys", "__met", "__same", "__places")


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_repeated: float = MAX_REPEATED,
    max_lost: float = MAX_LOST, keep_text: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, lost_chars, kept[, cleaned_text]; lines are those with a word.
    """
    text, lines, judged, failed = (F.col(c) for c in ("text", "__lines", "__judged", "__failed"))
    rows = narrowed(docs, id_col, text_col).withColumn("__words", words_of(text))
    rows = repeated_words(rows, "__words", "n_repeat_words")
    # Joined without spaces: all characters of words.
    rows = rows.withColumns({"n_words": F.size("__words").cast("bigint"), "word_chars": F.length(F.concat_ws("", "__words")).cast("bigint")}).drop("__words")
    counted = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), F.size(words_of(line)).alias("n")))
    verdict = lambda x: F.when(x["n"] > 0, line_fails(x["line"], x["n"])).otherwise(False)
    rows = rows.withColumn("__judged", F.transform(counted, lambda x: F.struct(x["line"], x["n"], verdict(x).alias("fails"))))
    rows = rows.withColumns({
        "__lines": F.transform(F.filter(judged, lambda x: x["n"] > 0), lambda x: x["line"]),
        "__failed": F.transform(F.filter(judged, lambda x: x["fails"]), lambda x: x["line"]),
    })
    rows = rows.withColumns({
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_failed_lines": F.size(failed).cast("bigint"),
        "lost_chars": F.length(F.translate(F.concat_ws("", failed), SPACE_CHARS, "")).cast("bigint"),
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words")),
    })
    columns = [
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_chars",
        (~F.col("base_failed") & (F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
    ]
    if keep_text:
        columns.append(F.array_join(F.transform(F.filter(judged, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned_text"))
    return rows.select(*columns)
