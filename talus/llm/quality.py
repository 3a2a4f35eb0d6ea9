"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Two multinomials over hashed word unigrams and bigrams: one of trusted
documents (labelled good and not toxic), one of the whole corpus. A document's
score is the mean log ratio of its n-grams, so length does not matter, and
every document above the threshold is kept unless the base rules fail it.

Scale: the corpus is read twice and never shuffled: counting shuffles at most
`buckets` rows per task, and the model is a fixed array of `buckets` doubles.
The trusted multinomial is fitted on at most `max_trusted` labelled documents,
those with the smallest hash of their id, so that the list of ids is bounded
and can be broadcast; the raw multinomial counts all documents.

Defined cases: null, empty and blank texts have no words, score 0 and fail the
base rules; without trusted documents all scores are 0; repeated rows are
counted and judged as often as they stand; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 8192
MAX_TRUSTED = 20_000
#: Mean nats per n-gram; below, a document is unlike the trusted ones.
THRESHOLD = -0.25
SMOOTHING = 1.0
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def _symbols(text: Column) -> Column:
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.octet_length(F.btrim(x, F.lit(_SPACE))) > 0)
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(starts: Column, window: int) -> Column:
    """Words in windows that begin at these places, in order."""
    ahead = F.transform(starts, lambda x, k: F.when(k + 1 < F.size(starts), F.least(F.lit(window), F.get(starts, k + 1) - x)).otherwise(window))
    return F.aggregate(ahead, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words in windows whose words stand twice in the text."""

    def found(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
        return _let(each, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_repeated(w, window)))

    return _let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0).cast("long")).otherwise(found(h)))


def _repeated(w: Column, window: int) -> Column:
    ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda e, k: (F.coalesce(F.get(s, k - 1)["h"] == e["h"], F.lit(False))) | (F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"]))

    return _let(ordered, lambda s: _let(starts(s), lambda p: _covered(p, window)))


def _grams(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and of their neighbouring pairs."""
    n = F.lit(buckets)
    return _let(
        hashes,
        lambda h: F.concat(
            F.transform(h, lambda x: F.pmod(x, n).cast("int")),
            F.when(F.size(h) > 1, F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, k: F.pmod(F.xxhash64(F.get(h, k), x), n).cast("int"))).otherwise(F.array().cast("array<int>")),
        ),
    )


def ratio_model(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row: llr, the log ratio of each bucket. A document is trusted if some label says so and none says otherwise."""
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    trusted = judged.where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id", F.lit(1).alias("trusted")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = texts.join(F.broadcast(trusted), "doc_id", "left").select("trusted", F.explode(_grams(F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("trusted").alias("good"))
    held = counts.agg(F.map_from_entries(F.collect_list(F.struct("b", F.struct("raw", "good")))).alias("m"), F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    a = F.lit(SMOOTHING)

    def ratio(i: Column) -> Column:
        own = F.col("m")[i]
        of = lambda name: F.log((F.coalesce(own[name], F.lit(0)) + a) / (F.col(name) + a * buckets))
        return of("good") - of("raw")

    llr = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), ratio)
    return held.select(F.when(F.col("good") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(llr).alias("llr"))


def judge(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row."""
    llr = ratio_model(documents, labels, buckets, max_trusted).scalar()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(F.col("text").cast("string")).alias("words"))
    rows = rows.select("doc_id", "text", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), llr.alias("llr"))
    counted = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _symbols(F.col("text")).alias("n_symbols"),
        _dup_lines(F.col("text")).alias("n_dup_lines"),
        _repeat_words(F.col("hashes"), WINDOW).alias("n_repeat_words"),
        _let(_grams(F.col("hashes"), buckets), lambda g: F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(F.col("llr"), b)) / F.greatest(F.size(g), F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
