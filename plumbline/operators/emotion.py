"""Valence, arousal and dominance of texts by an injected scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import require

VAD_TYPE = "struct<valence: double, arousal: double, dominance: double>"
VadScorer = Callable[[Column], Column]


def surface_scorer(text: Column) -> Column:
    """The offline default, from the text's surface: valence is the share of vowels among letters, arousal that of capitals, dominance that of marks ! and ? per 100 characters, 1 at most."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    share = lambda keep: F.when(letters > 0, F.length(F.regexp_replace(text, keep, "")) / letters.cast("double")).otherwise(F.lit(0.0))
    marks = F.length(F.regexp_replace(text, r"[^!?]", "")) * 100.0 / F.greatest(F.length(text), F.lit(1))
    return F.struct(share("[^aeiouAEIOU]").alias("valence"), share("[^A-Z]").alias("arousal"), F.least(F.lit(1.0), marks).alias("dominance"))


def model_scorer(load: Callable[[], Callable[[list[str]], list[tuple[float, float, float]]]]) -> VadScorer:
    """A scorer from a model: ``load`` runs once a task and returns a function from texts to (valence, arousal, dominance)."""

    @F.pandas_udf(VAD_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield pd.DataFrame(model(batch.fillna("").tolist()), columns=["valence", "arousal", "dominance"])

    return lambda text: score(text)


def predict_vad(df: DataFrame, text_col: str = "text", scorer: VadScorer = surface_scorer) -> DataFrame:
    """df with valence, arousal and dominance: one row a text. A null text is scored as the empty one."""
    require(df.columns, text_col)
    kept = [c for c in df.columns if c not in ("valence", "arousal", "dominance")]
    return df.select(*kept, scorer(F.coalesce(F.col(text_col), F.lit(""))).alias("__vad")).select(*kept, "__vad.valence", "__vad.arousal", "__vad.dominance")
