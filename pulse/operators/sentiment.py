"""Lexicon sentiment as a Spark job.

A post's score is the mean polarity of the lexicon words it contains; a
modifier (a negator such as ``not``, an intensifier such as ``very``) directly
before a hit multiplies that hit's polarity by its intensity, and each hit is
clamped to [-1, 1].  No hits, empty or null text -> 0.0.  The label uses the
unrounded score with strict thresholds; the stored score is rounded to 3 decimals.

Words are runs of Unicode letters and apostrophes, in lower case.  A term that a
lexicon lists more than once has the mean of its polarities.

Two physical forms compute the same value for every row; the caller picks one:

* ``map`` (default): the lexicon becomes a literal two-level map (first letter, then
  word) and a single ``aggregate`` pass over each post's tokens scores it in place.
  No shuffle, no join back; the work is row-local and scales with the input.
* ``join``: the distinct texts are exploded to tokens, joined with the lexicon
  table, averaged per text, and joined back by text.  For lexicons that should
  stay a table.
"""

from __future__ import annotations

import csv
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Fixed values of the scorer (label contract).
POSITIVE_ABOVE = 0.1          # score > 0.1  -> positive
NEGATIVE_BELOW = -0.1         # score < -0.1 -> negative
SCORE_DECIMALS = 3
TOKEN_SEPARATORS = r"[^\p{L}']+"   # after lower(): anything but letters and apostrophe

LEXICON_SCHEMA = StructType([StructField("term", StringType(), False),
                             StructField("polarity", DoubleType(), False)])

#: term, polarity, intensity: words have a polarity, modifiers an intensity.
LEXICON_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "data", "lexicon.csv")


def _column(name: str) -> dict[str, float]:
    with open(LEXICON_PATH, newline="", encoding="utf-8") as fh:
        return {row["term"]: float(row[name]) for row in csv.DictReader(fh) if row[name]}


def default_lexicon() -> dict[str, float]:
    return _column("polarity")


def default_modifiers() -> dict[str, float]:
    return _column("intensity")


def lexicon_frame(spark: SparkSession, lexicon: dict[str, float] | None = None) -> DataFrame:
    items = sorted((default_lexicon() if lexicon is None else lexicon).items())
    return spark.createDataFrame(items, LEXICON_SCHEMA)


def tokens(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.split(F.trim(F.regexp_replace(F.lower(t), TOKEN_SEPARATORS, " ")), " ")


def label(score) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return (F.when(s > POSITIVE_ABOVE, F.lit("positive"))
            .when(s < NEGATIVE_BELOW, F.lit("negative"))
            .otherwise(F.lit("neutral")))


def _literal_map(d: dict[str, float]) -> Column:
    """first letter -> word -> value: a lookup compares with few keys, however many words there are."""
    if not d:
        return F.create_map().cast("map<string,map<string,double>>")
    by_letter: dict[str, list[str]] = {}
    for k in sorted(d):
        by_letter.setdefault(k[:1], []).append(k)
    inner = [F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.lit(float(d[k])) for k in ks]))
             for ks in by_letter.values()]
    return F.map_from_arrays(F.array(*[F.lit(k) for k in by_letter]), F.array(*inner))


def _lookup(words: Column, word: Column) -> Column:
    return F.try_element_at(F.try_element_at(words, F.substring(word, 1, 1)), word)


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def raw_score_inline(text, lexicon: dict[str, float],
                     modifiers: dict[str, float] | None = None) -> Column:
    """Unrounded score as one expression (the ``map`` form)."""
    lex = _literal_map(lexicon)
    mods = _literal_map(default_modifiers() if modifiers is None else modifiers)
    # Pass 1: look each token up once.  Pass 2: one fold carrying the previous token.
    looked_up = F.transform(tokens(text), lambda t: F.struct(
        t.alias("t"), _lookup(lex, t).alias("w")))
    start = F.struct(F.lit("").alias("prev"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(acc, x):
        factor = F.coalesce(_lookup(mods, acc["prev"]), F.lit(1.0))
        hit = x["w"].isNotNull()
        return F.struct(
            x["t"].alias("prev"),
            (acc["s"] + F.when(hit, _clamp(x["w"] * factor)).otherwise(F.lit(0.0))).alias("s"),
            (acc["n"] + F.when(hit, 1).otherwise(0)).alias("n"))

    mean = F.aggregate(looked_up, start, step,
                       lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]).otherwise(F.lit(0.0)))
    return F.coalesce(mean, F.lit(0.0))


def _one_polarity(lexicon: DataFrame) -> DataFrame:
    return (lexicon.filter(F.col("term").isNotNull() & F.col("polarity").isNotNull())
            .groupBy("term").agg(F.avg("polarity").alias("polarity")))


def _lexicon_dict(lexicon) -> dict[str, float]:
    """The lexicon as literals of the plan."""
    if lexicon is None:
        return default_lexicon()
    if isinstance(lexicon, dict):
        return lexicon
    return {r["term"]: float(r["polarity"]) for r in _one_polarity(lexicon).collect()}


def score_sentiment(df: DataFrame, text: str = "text", lexicon=None, modifiers=None,
                    method: str = "map", score_col: str = "sentiment_score",
                    label_col: str = "sentiment") -> DataFrame:
    """Add ``sentiment`` (label) and ``sentiment_score`` (rounded) columns.

    ``lexicon`` is a dict term -> polarity or a DataFrame(term, polarity), ``modifiers`` a
    dict term -> intensity.  ``method`` is ``map`` or ``join``; both give the same answer.
    """
    if method not in ("map", "join"):
        raise ValueError(f"method must be 'map' or 'join', got {method!r}")
    keep = [c for c in df.columns if c not in (label_col, score_col)]
    if method == "map":
        scored = df.select(*keep, raw_score_inline(text, _lexicon_dict(lexicon), modifiers).alias("_raw_score"))
    else:
        table = lexicon if isinstance(lexicon, DataFrame) else lexicon_frame(df.sparkSession, lexicon)
        scores = score_by_join(df.select(F.col(text).alias("_text")), table, modifiers)
        scored = df.select(*keep).join(scores, F.col(text) == F.col("_text"), "left").withColumn(
            "_raw_score", F.coalesce("_raw_score", F.lit(0.0)))
    return scored.select(*keep, label("_raw_score").alias(label_col),
                         F.round("_raw_score", SCORE_DECIMALS).alias(score_col))


def score_by_join(texts: DataFrame, lexicon: DataFrame, modifiers: dict[str, float] | None = None) -> DataFrame:
    """(_text, _raw_score) for the distinct ``_text`` values with at least one lexicon hit (the ``join`` form)."""
    mods = _literal_map(default_modifiers() if modifiers is None else modifiers)
    tok = tokens("_text")
    prev = F.concat(F.array(F.lit("")), F.slice(tok, 1, F.size(tok) - 1))
    pairs = F.zip_with(tok, prev, lambda t, p: F.struct(t.alias("term"), p.alias("_prev")))
    toks = (texts.filter(F.col("_text").isNotNull()).distinct()
            .select("_text", F.explode(pairs).alias("_p")).select("_text", "_p.term", "_p._prev"))
    hits = toks.join(_one_polarity(lexicon), "term")
    factor = F.coalesce(_lookup(mods, F.col("_prev")), F.lit(1.0))
    return hits.groupBy("_text").agg(F.avg(_clamp(F.col("polarity") * factor)).alias("_raw_score"))
