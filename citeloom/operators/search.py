"""Lexical search for many questions at once: which texts hold which terms somewhere in them, without a scan of the texts for each question.

A term is a run of letters, digits and a few marks, so a text holds it where one of the text's own runs does. Runs are
posted by the texts that have them, and the distinct runs by their grams of three letters (of two, for terms of two). A
term looks up the rarest of its grams, and only runs posted there are tested for the whole term.

Runs of texts are never written down: the distinct runs that hold a term are, with their terms, and each text meets them
and keeps the terms it holds, one row for each text. Questions meet these rows where they are, so that of a question's
relevant texts only the best of each task are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut

#: Runs that terms are made of; letters are compared in lower case.
RUN = r"[a-z0-9$.,%-]+"


def _grams(text: Column, n: int) -> Column:
    """Distinct pieces of n characters."""
    upto = F.length(text) - (n - 1)
    return F.when(upto >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), upto), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """term, text for every distinct text of texts(text) that holds a term of terms(term) of two characters or more."""
    terms = terms.select("term").where(F.length("term") >= 2).distinct()
    texts = cut(texts.select("text").distinct())
    asked = cut(terms.select("term", F.explode(F.when(F.length("term") == 2, F.array("term")).otherwise(_grams(F.col("term"), 3))).alias("gram")))
    wanted = asked.select("gram").distinct()
    posted = texts.select("text", F.explode(F.concat(_grams(F.col("text"), 3), _grams(F.col("text"), 2))).alias("gram"))
    posted = cut(posted.join(wanted.withColumnRenamed("gram", "_w"), F.col("gram") == F.col("_w"), "left_semi"))
    times = posted.groupBy(F.col("gram").alias("_g")).agg(F.count("*").alias("n"))
    rarest = asked.join(times, F.col("gram") == F.col("_g"), "left").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("lost"))
    rarest = rarest.where("lost = 0").select("term", F.col("gram").alias("_r"))  # a term with a gram that no text has is in none
    return posted.join(rarest, F.col("gram") == F.col("_r")).where(F.contains("text", "term")).select("term", "text")


def runs(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, run: the distinct runs of each text, of two characters or more."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(RUN), F.lit(0)))
    return texts.select(key, F.explode(found).alias("run")).where(F.length("run") >= 2)


def questions_terms(questions: DataFrame) -> DataFrame:
    """query_id, n, term: the distinct terms of each question(query_id, question) and how many it has."""
    rows = questions.select("query_id", T.tokens(F.col("question")).alias("t"))
    return rows.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))


def lexical_hits(questions: DataFrame, texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """query_id, key, relevance of every text that holds a term of a question: the share of the question's terms that it holds. questions(query_id, question)."""
    terms = cut(questions_terms(questions))
    named = terms.groupBy("term").agg(F.collect_list(F.struct("query_id", "n")).alias("asked"))
    named = cut(named.withColumn("t", F.monotonically_increasing_id()))  # the questions' distinct terms, numbered
    posted = runs(texts, key, text)
    found = containing(named.select("term"), posted.select(F.col("run").alias("text"))).join(named.select(F.col("term").alias("_n"), "t"), F.col("term") == F.col("_n"))
    found = cut(found.groupBy(F.col("text").alias("_run")).agg(F.collect_list("t").alias("ts")))
    # several of a text's runs may hold one term
    held = posted.join(found, F.col("run") == F.col("_run")).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("ts"))).alias("ts"))
    asked = cut(named.select(F.col("t").alias("_t"), F.explode("asked").alias("a")).select("_t", "a.*"))
    pairs = held.select(key, F.explode("ts").alias("t")).join(asked, F.col("t") == F.col("_t")).groupBy("query_id", key).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return pairs.select("query_id", key, F.least(F.lit(1.0), F.col("k") / F.col("n")).alias("relevance"))


def top(questions: DataFrame, texts: DataFrame, key: str, k: int, text: str = "text") -> DataFrame:
    """The k most relevant texts of each question, ties by key; ranks from 1. The limit is applied before anything is shuffled for it."""
    best = Window.partitionBy("query_id").orderBy(F.desc("relevance"), key)
    return lexical_hits(questions, texts, key, text).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
