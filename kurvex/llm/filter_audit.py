"""Filter interaction audit: which of five quality filters removes what, in every order of applying them.

Words are exploded and aggregated by (document, word), then by document, for totals and distinct words; the other flags come
from a second scan and are outer-joined.  All the rest follows from how many documents of a part fail each
of the 32 sets of filters, so only 96 conditional counts per part leave the documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
#: What a row is known by: repeated rows have one key and are counted.
_KEY = ["doc_id", "row_key"]


def _rows(documents: DataFrame) -> DataFrame:
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(lang as string), '') part", "coalesce(cast(text as string), '') text")
    return docs.select("doc_id", "part", "text", F.xxhash64("text", "part").alias("row_key"))


def word_totals(rows: DataFrame) -> DataFrame:
    """Per key with a word: number of words and of distinct words (by 64-bit hashes inside a key), over all rows of the key.

    The rows meet by key once, as texts; that serves both aggregations, so no pair of document and word is shuffled.
    """
    words = rows.repartition(*_KEY).select(*_KEY, F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("word")).where("word <> ''")
    counted = words.groupBy(*_KEY, F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy(*_KEY).agg(F.sum("times").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def text_flags(rows: DataFrame) -> DataFrame:
    """Per key: number of its rows, part, digest of the text and the flags that need no words."""
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flagged = rows.select(*_KEY, "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * upper > UPPER_PERCENT * F.length("text")).alias("C"), F.col("text").rlike(SYMBOLS).alias("D"))
    return flagged.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("part", "digest", "C", "D")))


def failed_sets(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (part, failed, good, toxic): number of documents; ``failed`` has bit k set if filter k fails."""
    rows = _rows(documents)
    marks = labels.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(quality as int) = 1, false) good", "coalesce(cast(toxic as int) = 1, false) toxic").where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "label_id")
    flags, totals = text_flags(rows), word_totals(rows).withColumnsRenamed({"doc_id": "word_id", "row_key": "word_key"})
    same = flags["doc_id"].eqNullSafe(totals["word_id"]) & (flags["row_key"] == totals["word_key"])
    seen = flags.join(totals, same, "left").join(marks, F.col("doc_id") == F.col("label_id"), "left")
    words, distinct = F.coalesce(F.expr("words div rows"), F.lit(0)), F.coalesce("distinct_words", F.lit(0))
    bits = [words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words, F.col("C"), F.col("D")]
    four = sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0)).alias("four")
    seen = seen.select("doc_id", "rows", "part", "digest", four, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Equal texts have equal flags, so a group of copies is a few rows before it meets: its size and the least id, with that id's rows.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "rows")))
    copies = seen.groupBy("digest", "four", "part", "good", "toxic").agg(F.sum("rows").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("rows")).otherwise(0)).alias("no_id"), least.alias("least"))
    groups = copies.groupBy("digest", "four").agg(F.min("least.doc_id").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "n", "no_id", "least")).alias("parts"))
    each = groups.select("four", "first", F.explode("parts").alias("p")).select("four", "first", "p.*")
    passed = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.rows")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("four").alias("failed"), passed.alias("n")), F.struct((F.col("four") + 16).alias("failed"), (F.col("n") - passed).alias("n")))).alias("e"))
    return split.groupBy("part", F.col("e.failed").alias("failed"), "good", "toxic").agg(F.sum("e.n").alias("n"))


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 200 words, B distinct words under half of all, C more than 3 % of the code points are ``[A-Z]``,
    D a symbol of ``#$%&*|``, E equal to the text of a smaller doc_id.  A part is a language, null as the empty string; all 120
    orders are reported, zeros too.  ``shapley`` is what the step's filter removes, summed over the 120 orders.

    Null texts count as empty, so of several empty or null texts the least doc_id passes E.  Rows of one doc_id are
    documents of their own and no copies of each other; rows without a doc_id have no smaller one, make no other row a copy, and
    have no labels.  Several labels of one doc_id count as good or toxic if one says so.  Other columns are ignored, whatever
    their names; long texts are counted whole; an empty table gives no rows.
    """
    sets = failed_sets(documents, labels)
    count = lambda when, m: F.coalesce(F.sum(F.when((F.col("failed") == m) & when, F.col("n"))), F.lit(0))
    columns = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    parts = sets.groupBy("part").agg(*(F.array(*(count(when, m) for m in range(32))).alias(f"{name}_by_set") for name, when in columns.items()))
    steps = [
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(1 << FILTERS.index(f)).alias("bit"), F.lit(sum(1 << FILTERS.index(g) for g in order[:k])).alias("before"))
        for order in permutations(FILTERS) for k, f in enumerate(order)
    ]
    rows = parts.withColumn("s", F.explode(F.array(*steps))).select("*", "s.*")
    over = lambda name, where, times="1": F.expr(f"aggregate(filter(sequence(0, 31), m -> {where}), 0L, (x, m) -> x + {name}_by_set[m] * {times})")
    here = "(m & before) = 0 and (m & bit) != 0"
    return rows.select(
        "part", "filter_order", "step", over("n", "(m & (before | bit)) = 0").alias("kept"), over("n", here).alias("removed"), over("n", "(m & before) != 0 and (m & bit) != 0").alias("redundant"),
        over("n", "m = bit").alias("unique_fails"), over("good", here).alias("good_lost"), over("toxic", here).alias("toxic_lost"), over("n", "(m & bit) != 0", "(120 div bit_count(m))").alias("shapley"),
    )
