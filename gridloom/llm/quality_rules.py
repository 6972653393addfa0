"""Quality rules: base counts, and divergence of a text's histograms from its language's, with DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, join_small_or_salted, staged, text_or_empty

#: Character classes beside lower-case letters and white space, most of a text; what is in none of them is the last class.
CLASSES = {"upper": r"\P{Lu}+", "digit": r"\P{Nd}+", "punctuation": r"\P{P}+", "symbol": r"\P{S}+"}
LOWER_OR_SPACE = r"[\p{Ll}\x20\x09-\x0D]+"
#: Common words are the COMMON most frequent ones of a language; they are ranked among their hash's part of all words first.
COMMON, RANK_PARTS = 25, 64
#: Jensen-Shannon distances (base 2) above which a text is rejected, and the fewest words for each comparison.
MOST_CLASS_DISTANCE, CLASS_WORDS = 0.27, 50
MOST_WORD_DISTANCE, COMMON_WORDS = 0.31, 50
#: Texts of fewer words are allowed, beside MOST_WORD_DISTANCE, the divergence that drawing so few words makes by chance.
LONG_WORDS = 100


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of probabilities of one length."""

    def part(a: Column, b: Column) -> Column:
        half = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(F.lit(0.0))
        return half(a, (a + b) / 2) + half(b, (a + b) / 2)

    return F.sqrt(F.greatest(_sum(F.zip_with(p, q, part)), F.lit(0.0)))


def _probabilities(counts: Column) -> Column:
    """Counts as shares of their sum; all zero if they are."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def most_word_distance(n_words: Column) -> Column:
    """MOST_WORD_DISTANCE from LONG_WORDS words on; under it its divergence plus COMMON / (8 n ln 2), the mean that n words
    drawn from the reference itself have over COMMON + 1 classes: 0.43 at 50 words, 0.38 at 99."""
    by_chance = COMMON / (8 * math.log(2)) / F.greatest(n_words, F.lit(1))
    return F.when(n_words >= LONG_WORDS, F.lit(MOST_WORD_DISTANCE)).otherwise(F.sqrt(F.lit(MOST_WORD_DISTANCE**2) + by_chance))


def _repeats(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``words`` (64-bit hashes): words covered by 3-word windows whose hash occurs twice or more.

    Texts whose windows all differ are done. Of others, windows with their places are sorted by hash, so equal ones are
    neighbours: n log n, and no window leaves its row.
    """
    last = F.size("words") - 3
    rows = docs.withColumn("_h", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.col("words")[i], F.col("words")[i + 1], F.col("words")[i + 2]))))
    placed = F.sort_array(F.transform(F.col("_h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_w", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed)).drop("_h")
    same = F.zip_with("_w", F.expr("slice(_w, 2, greatest(size(_w), 1))"), lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    rows = rows.withColumn("_same", F.filter(same, lambda x: x.isNotNull()))
    rows = rows.withColumn("_at", F.when(F.size("_same") > 0, F.array_distinct(F.concat(F.col("_same")["a"], F.col("_same")["b"]))))
    covered = F.array_distinct(F.concat("_at", F.transform("_at", lambda i: i + 1), F.transform("_at", lambda i: i + 2)))
    return rows.withColumn("n_repeat_words", F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")).drop("_w", "_same", "_at")


def _with_words(docs: DataFrame, text: str, lang: str, doc_id: str) -> DataFrame:
    """doc_id, text (null: empty), key (the language), words (64-bit hashes) and word_chars."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("key"), text_or_empty(text).alias("text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("text", SPACE), ""))
    return rows.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars")).drop("_words")


def common_words(rows: DataFrame, most: int = COMMON) -> DataFrame:
    """From (key, words): key, common (its most frequent words, of all it has), times (how often each occurs), and a row for all
    rows together, whose key is null and all true.

    Words are counted by tasks first and ranked in RANK_PARTS parts, so that what meets in one task is at most ``most`` of each.
    """
    number = F.when(F.col("key").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("key"))
    counts = staged(rows.select(number.alias("k"), F.explode("words").alias("word")).groupBy("k", "word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    every = counts.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(0).cast("long").alias("k"), "word", "n", F.lit(True).alias("all"))
    both = counts.filter("k <> 0").select("k", "word", "n", F.lit(False).alias("all")).unionByName(every)
    order = [F.col("n").desc(), F.col("word")]
    part = F.pmod("word", F.lit(RANK_PARTS))
    some = both.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("all", "k", "part").orderBy(*order))).filter(F.col("rank") <= most)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("all", "k").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = top.groupBy("all", "k").agg(F.array_sort(F.collect_list(F.struct("rank", "word", "n"))).alias("ranked"))
    ranked = ranked.select("all", "k", F.col("ranked.word").alias("common"), F.col("ranked.n").alias("times"))
    keys = rows.filter("key IS NOT NULL").select("key").distinct().withColumn("k", number)
    return ranked.filter("NOT all").join(keys, "k").select("all", "key", "common", "times").unionByName(ranked.filter("all").select("all", F.lit(None).cast("string").alias("key"), "common", "times"))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    The verdict compares two histograms of a whole text, of character classes and of its language's common words, with
    those of all texts in that language, by Jensen-Shannon distance; words are 64-bit hashes throughout. A text with too few words for a comparison passes
    it (the distance is then null). References are counted over all documents in two scans: one finds the common words
    and how often they occur, one takes all other counts; the last step works on a few numbers a document. Every
    language has references of its own, however rare it is; their table is broadcast while its rows are few, else joined
    by shuffle with salts, and no step groups texts by language, so a hot language costs no more.

    Nulls: a null text has no words; a null language is held to the references of all documents, by the common words of
    all. Empty texts fail the base rules. Repeated rows are judged each; an empty table gives no rows. Other columns are
    ignored.
    """
    keyed = _with_words(docs, text, lang, doc_id)
    top = staged(common_words(keyed.select("key", "words")), "common-words")
    everyone = next((r["common"] for r in top.filter("all").collect()), [])
    keyed = join_small_or_salted(keyed, top.filter("NOT all").select("key", "common"), "key", "left")
    none = F.array().cast("array<bigint>")
    keyed = keyed.withColumn("common", F.when(F.col("key").isNull(), F.array(*map(F.lit, everyone)).cast("array<bigint>")).otherwise(F.coalesce("common", none)))
    keyed = keyed.withColumn("hits", F.filter("words", lambda w: F.array_contains("common", w))).withColumn("rest", F.regexp_replace("text", LOWER_OR_SPACE, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _repeats(keyed.withColumn("lines", lines)).select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        F.regexp_count("rest", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("word_chars") - F.length("rest")).alias("lower"),
        *[F.length(F.regexp_replace("rest", pattern, "")).cast("long").alias(name) for name, pattern in CLASSES.items()],
        F.length("rest").cast("long").alias("n_rest"),
        F.transform("common", lambda w: F.size("hits") - F.size(F.array_remove("hits", w))).alias("common_counts"),
        F.size("hits").alias("n_common"),
    )
    slim = staged(counted, "rules")
    others = F.greatest(F.col("n_rest") - reduce(lambda a, b: a + b, map(F.col, CLASSES)), F.lit(0).cast("long"))
    classes = F.array("lower", *CLASSES, others).alias("classes")
    slim = slim.select("*", classes, F.concat("common_counts", F.array(F.col("n_words") - F.col("n_common"))).alias("hist"))
    # sums by language, and of all documents, whose key is null; how often common words occur is known from finding them
    n = len(CLASSES) + 2
    sums = [F.array(*[F.coalesce(F.sum(F.get("classes", F.lit(i))), F.lit(0)) for i in range(n)]).alias("classes"), F.sum("n_words").alias("n_words")]
    by_key = staged(slim.groupBy("key").agg(*sums), "rule-sums")
    every = by_key.agg(*sums).select(F.lit(None).cast("string").alias("key"), "classes", "n_words")
    known = by_key.filter("key IS NOT NULL").unionByName(every).join(top.select(F.col("key").alias("_key"), "times"), F.col("key").eqNullSafe(F.col("_key")), "left")
    times = F.coalesce("times", F.array().cast("array<bigint>"))
    total = F.aggregate(times, F.lit(0).cast("long"), lambda s, x: s + x)
    references = staged(known.select("key", F.col("classes").alias("classes_sum"), F.concat(times, F.array(F.col("n_words") - total)).alias("hist_sum")), "rule-references")
    judged = join_small_or_salted(slim, references, "key", "left")
    judged = judged.withColumn("class_distance", F.when(F.col("n_words") >= CLASS_WORDS, js_distance(_probabilities(F.col("classes")), _probabilities(F.col("classes_sum")))))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= COMMON_WORDS, js_distance(_probabilities(F.col("hist")), _probabilities(F.col("hist_sum")))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= most_word_distance(F.col("n_words")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes).alias("kept"), "class_distance", "word_distance")
