"""Line-first cleaning: rules per line, then a verdict on what is left of the document. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\u000b\f\r"
SPACES = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
# Marks that end a sentence, also behind a closing quote or bracket.
ENDINGS = ".!?…。！？:;\"'”’»)]"
SEPARATORS = "|»›•·"
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "read more", "sign in", "subscribe", "terms of service", "terms of use", "use of cookies",
)


@dataclass(frozen=True)
class LineRules:
    """Parameters of the cleaning.

    ``symbol_share``: symbols of ``SYMBOLS`` to word characters above which a line is noise. ``separator_share``:
    separators to words at and above which a line is navigation. ``max_loss``: share of word characters that the
    removed lines may hold. ``min_words`` and ``max_repeat_share`` are the document rules that always hold.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_loss: float = 0.5
    symbol_share: float = 0.1
    separator_share: float = 0.2
    endings: str = ENDINGS
    phrases: tuple[str, ...] = BOILERPLATE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters other than space and the five ASCII white space controls."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def without(text: Column, characters: str) -> Column:
    """``text`` without some characters; a replacement each searches bytes, ``translate`` makes a string of every character."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def _repeat_words(windows: Column) -> Column:
    """Words inside three-word windows that occur again, from the array of windows in order."""

    def covered(ordered: Column) -> Column:
        again = lambda p, k: F.coalesce(p.w == F.get(ordered, k - 1).w, F.lit(False)) | F.coalesce(
            p.w == F.get(ordered, k + 1).w, F.lit(False)
        )
        starts = F.sort_array(F.transform(F.filter(ordered, again), lambda p: p.i))
        reach = lambda s: F.transform(s, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - at, F.lit(3))))
        return F.aggregate(let(starts, reach), F.lit(0), lambda total, n: total + n)

    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(placed, covered))


def line_passes(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word passes the punctuation, navigation, noise and boilerplate rules."""
    bare = F.btrim(line, F.lit(SPACE))
    low = F.lower(line)
    n_words = count_of(bare, " \t") + 1
    word_chars = F.length(without(bare, SPACE))
    separators = count_of(bare, SEPARATORS)
    ends_well = F.instr(F.lit(rules.endings), F.right(bare, F.lit(1))) > 0
    is_menu = (separators >= 2) & (separators >= rules.separator_share * n_words)
    is_noise = count_of(bare, SYMBOLS) > rules.symbol_share * word_chars
    boiler = F.lit(False)
    for phrase in rules.phrases:
        boiler = boiler | F.contains(low, F.lit(phrase))
    return ends_well & ~is_menu & ~is_noise & ~boiler


def quality_columns(docs: DataFrame, rules: LineRules | None = None, text_col: str = "text") -> DataFrame:
    """``row`` (the whole input row), the document's counts, ``clean_text`` and the verdict ``kept``.

    All counts are over the whole text; no shuffle, one pass, no Python. ``clean_text`` joins the lines that passed
    with line feeds; lines without a word are left out.

    Defined cases: a null text counts as empty, has ``clean_text`` "" and fails the base rules; ties and repeated
    rows are judged each by itself; an empty table gives no rows; columns of ``docs`` of any name stay inside ``row``.
    """
    rules = rules or LineRules()
    has_word = lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    split = base.select("row", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), has_word).alias("lines"))
    n = F.size("w")
    window = lambda a, i: F.concat_ws(" ", a, F.get("w", i + 1), F.get("w", i + 2))
    windows = F.when(n >= 3, F.transform(F.slice("w", F.lit(1), n - 2), window)).otherwise(F.array().cast("array<string>"))
    counted = split.select(
        "row", "t", "lines", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), windows.alias("windows"),
        F.filter("lines", lambda line: line_passes(line, rules)).alias("good"),
    )
    measured = counted.select(
        "row",
        "n_words",
        "word_chars",
        count_of(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    left = F.length(without(F.col("clean_text"), SPACE))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("word_chars") - left <= rules.max_loss * F.col("word_chars"))
    )


def clean_documents(docs: DataFrame, rules: LineRules | None = None, text_col: str = "text") -> DataFrame:
    """The documents that stay, in the columns of ``docs``, with the failed lines cut from their text."""
    judged = quality_columns(docs, rules, text_col)
    # As generated columns the verdict stays where it is computed: a filter over plain ones would be pushed below it
    # and compute every array again for every reference.
    kept = judged.select(F.inline(F.array(F.struct("row", "clean_text", "kept")))).filter("kept")
    return kept.select(*[(F.col("clean_text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
