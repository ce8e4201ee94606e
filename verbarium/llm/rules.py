"""Quality rules: a table of thresholds, compiled into one projection without user functions.

All metrics of a text are one expression on Spark's built-in functions. A value that is used
more than once is bound with :func:`let`, so the optimizer can neither repeat it nor move it
into a loop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The most frequent function words of the four languages of the corpus.
STOP_WORDS = """
a an and are as at be by for from in is it of on or that the this to was with
der die das den dem des ein eine einen einem einer und ist im zu von mit auf nicht sich
le la les de du un une et est en que qui pour dans par sur au ne pas
el los las y es con para no se lo su al
""".split()

BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARACTERS = " \t\n\x0b\f\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high`` must hold for texts of ``min_words`` words or more."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = [
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbol_ratio", high=0.1),
    Rule("exclamation_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.02, min_words=50),
    Rule("dup_line_ratio", high=0.6),
    Rule("mean_line_words", low=1.0),
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def covered_words(words: Column, n: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text.

    Each window is a 64-bit hash. Its upper bits, with the window's place in the lower ones,
    are sorted as plain numbers; neighbours with equal full hashes are repeats. The places of
    repeats, sorted again, cover ``WINDOW`` words each, less where the next one starts sooner.
    """

    def repeats(h: Column) -> Column:
        # As many low bits as places need.
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")
        # The shift of a column by a column has no function in the DataFrame API.
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def with_mask(m: Column) -> Column:
            keyed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(m)).bitwiseOR(i.cast("long")))

            def of_sorted(s: Column) -> Column:
                def at(j: Column) -> Column:
                    return F.get(h, F.get(s, j).bitwiseAND(m).cast("int"))

                def repeated(x: Column, j: Column) -> Column:
                    own = F.get(h, x.bitwiseAND(m).cast("int"))
                    return F.coalesce(own == at(j - 1), F.lit(False)) | F.coalesce(own == at(j + 1), F.lit(False))

                return F.transform(F.filter(s, repeated), lambda x: x.bitwiseAND(m))

            return let(F.array_sort(keyed), of_sorted)

        return let(mask, with_mask)

    def union(places: Column) -> Column:
        def step(total: Column, x: Column) -> Column:
            return F.struct(
                (total["words"] + F.least(F.lit(WINDOW).cast("long"), x - total["last"])).alias("words"),
                x.alias("last"),
            )

        start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-WINDOW).cast("long").alias("last"))
        return F.aggregate(places, start, step, lambda total: total["words"])

    hashes = F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
    )
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), union(F.array_sort(repeats(h)))))
    return F.when(n >= WINDOW, F.coalesce(found, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def metrics(text: Column) -> Column:
    """A struct of all metrics of a text; a null text counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANK_CHARACTERS))
    words_of = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))

    def build(words: Column) -> Column:
        n = F.size(words)
        lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANK_CHARACTERS)) != "")
        return F.struct(
            n.cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.length(w)).alias("word_chars"),
            F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"),
                                          (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("_lines"),
            covered_words(words, n).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.length(F.regexp_replace(whole, "[^!]+", "")).cast("long").alias("n_exclamations"),
        )

    def flat(m: Column) -> Column:
        per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        lines, dup = m["_lines"]["lines"], m["_lines"]["dup"]
        n = m["n_words"]
        return F.struct(
            *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")),
            dup.alias("n_dup_lines"),
            per(m["word_chars"], n).alias("mean_word_chars"),
            per(m["n_symbols"], n).alias("symbol_ratio"),
            per(m["n_exclamations"], n).alias("exclamation_ratio"),
            per(m["n_stop_words"], n).alias("stop_word_ratio"),
            per(dup, lines).alias("dup_line_ratio"),
            per(n, lines).alias("mean_line_words"),
        )

    return let(let(words_of, build), flat)


def base_failed(m: Column) -> Column:
    repeated = m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT
    return (m["n_words"] < MIN_WORDS) | repeated


def passes(m: Column, rules: list[Rule]) -> Column:
    """The rule table as one condition over the metrics."""
    result = F.lit(True)
    for rule in rules:
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (m[rule.metric] >= rule.low)
        if rule.high is not None:
            holds = holds & (m[rule.metric] <= rule.high)
        result = result & (holds if rule.min_words == 0 else (m["n_words"] < rule.min_words) | holds)
    return result


def judged(text: Column, rules: list[Rule] = RULES) -> Column:
    """Struct of the metrics with ``base_failed`` and ``kept``."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = sorted({rule.metric for rule in rules})
    return let(
        metrics(text),
        lambda m: F.struct(
            *(m[c].alias(c) for c in names),
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & passes(m, rules)).alias("kept"),
            *(m[c].alias(c) for c in ratios),
        ),
    )


def quality(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id with counts, ratios, ``base_failed`` and ``kept`` of every row of ``docs``.

    A null or empty text has zero counts and fails for its length. Rows are judged one by one:
    repeated rows and null ids stay as they are, an empty table gives an empty result.
    """
    return docs.select("doc_id", judged(F.col("text"), rules).alias("_m")).select("doc_id", "_m.*")


def keep_good(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass the base checks and every rule, with all their columns."""
    return docs.where(judged(F.col("text"), rules)["kept"])
