"""Term suggestions: close words of the field's vocabulary for words that it doesn't hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.compiler import Compiler


def vocabulary(df: DataFrame, compiler: Compiler, path: str) -> DataFrame:
    """text, freq: words of a field and the documents that hold them."""
    return df.select(F.explode(F.array_distinct(compiler.tokens(path))).alias("text")).groupBy("text").agg(F.count("*").alias("freq"))


def term_suggestions(df: DataFrame, compiler: Compiler, text: str, spec: Mapping) -> DataFrame:
    """token, text, score, freq, pos: the best candidates of each token, by score, then documents, then alphabet.

    A candidate shares the first `prefix_length` characters and is at most `max_edits` edits away; its score is
    1 - edits / the shorter length. In the mode "missing" (default) a token of the vocabulary gets none.
    """
    path = spec["field"]
    tokens = compiler.terms(path, text)
    edits, prefix, size = int(spec.get("max_edits", 2)), int(spec.get("prefix_length", 1)), int(spec.get("size", 5))
    mode = spec.get("suggest_mode", "missing")
    words = vocabulary(df, compiler, path).filter(F.length("text") >= int(spec.get("min_word_length", 4)))
    spark = df.sparkSession
    asked = spark.createDataFrame(list(enumerate(tokens)), "pos int, token string")  # as many rows as the query has words
    known = vocabulary(df, compiler, path).filter(F.col("text").isin(tokens)).select(F.col("text").alias("token"), F.col("freq").alias("own"))
    asked = asked.join(known, "token", "left")
    if mode == "missing":
        asked = asked.filter("own is null")
    d = F.levenshtein(F.col("token"), F.col("text"))
    pairs = words.join(F.broadcast(asked), (F.substring("token", 1, prefix) == F.substring("text", 1, prefix)) & (d <= edits) & (F.col("token") != F.col("text")))
    if mode == "popular":
        pairs = pairs.filter(F.col("freq") > F.coalesce("own", F.lit(0)))
    scored = pairs.withColumn("score", (1 - d / F.least(F.length("token"), F.length("text"))).cast("double")).filter("score > 0")
    from pyspark.sql import Window

    w = Window.partitionBy("pos").orderBy(F.desc("score"), F.desc("freq"), "text")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size).select("pos", "token", "text", "score", "freq", "rank")


def suggest_tree(df: DataFrame, compiler: Compiler, defs: Mapping) -> dict:
    out: dict = {}
    shared = defs.get("text")
    for name, spec in defs.items():
        if name == "text" or not isinstance(spec, Mapping):
            continue
        text, body = spec.get("text", shared), spec.get("term") or spec.get("phrase") or {}
        rows = term_suggestions(df, compiler, text, body).orderBy("pos", "rank").collect()
        entries, at = [], 0
        for pos, token in enumerate(compiler.terms(body["field"], text)):
            found = text.lower().find(token, at)
            at = max(at, found) + len(token) if found >= 0 else at
            options = [{"text": r.text, "score": r.score, "freq": r.freq} for r in rows if r.pos == pos]
            entries.append({"text": token, "offset": max(found, 0), "length": len(token), "options": options})
        out[name] = entries
    return out
