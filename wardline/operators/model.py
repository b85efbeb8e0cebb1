"""The model scorer: any batch function from texts to injection probabilities.

``Scorer`` is what plugs in; :class:`Constant` is the stub, :class:`Onnx` loads a sequence classifier where
onnxruntime and a model are present.  Without a scorer the stage is absent from the plan and reports
``available = false``.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DeepPath
from .score import decision

RESULT = "struct<score:double,action:string,available:boolean,char_truncated:boolean>"


class Scorer(Protocol):
    name: str

    def load(self) -> Callable[[list[str]], list[float]]:
        """Called once for each worker process."""


@dataclass(frozen=True)
class Constant:
    score: float = 0.0
    name: str = "constant"

    def load(self):
        return lambda texts: [self.score] * len(texts)


@dataclass(frozen=True)
class Keywords:
    """A deterministic scorer for tests: the share of ``words`` that a text holds."""

    words: tuple[str, ...]
    name: str = "keywords"

    def load(self):
        return lambda texts: [sum(w in t.lower() for w in self.words) / max(1, len(self.words)) for t in texts]


def softmax_rows(logits) -> list[list[float]]:
    out = []
    for row in logits:
        e = np.exp(np.asarray(row, dtype=float) - max(row, default=0.0))
        out.append((e / e.sum()).tolist() if len(e) else [])
    return out


@dataclass(frozen=True)
class Onnx:
    """A directory with model_quantized.onnx (preferred) or model.onnx, and tokenizer.json."""

    path: str
    max_length: int = 512
    name: str = "onnx"

    def load(self):
        import onnxruntime
        from tokenizers import Tokenizer

        files = [f"{self.path}/model_quantized.onnx", f"{self.path}/model.onnx"]
        session = onnxruntime.InferenceSession(next(f for f in files if os.path.exists(f)), providers=["CPUExecutionProvider"])
        tokenizer = Tokenizer.from_file(f"{self.path}/tokenizer.json")
        tokenizer.enable_truncation(self.max_length)
        tokenizer.enable_padding()
        wanted = {i.name for i in session.get_inputs()}

        def predict(texts: list[str]) -> list[float]:
            got = tokenizer.encode_batch(texts)
            feed = {
                "input_ids": np.array([x.ids for x in got], dtype=np.int64),
                "attention_mask": np.array([x.attention_mask for x in got], dtype=np.int64),
                "token_type_ids": np.array([x.type_ids for x in got], dtype=np.int64),
            }
            logits = session.run(None, {k: v for k, v in feed.items() if k in wanted})[0]
            return [row[1] for row in softmax_rows(logits.tolist())]

        return predict


_LOADED: dict[object, Callable] = {}


def deep_scored(df: DataFrame, text: str, scorer: Scorer | None, settings: DeepPath = DeepPath(), only: Column | None = None) -> DataFrame:
    """Adds ``deep``: struct(score, action, available, char_truncated); null where ``only`` is false.

    Rows outside ``only``, and blank texts, reach the scorer as nulls and are skipped there.
    """
    if scorer is None:
        absent = F.struct(F.lit(0.0).alias("score"), F.lit("allow").alias("action"), F.lit(False).alias("available"), F.lit(False).alias("char_truncated"))
        return df.withColumn("deep", absent)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if scorer not in _LOADED:
            _LOADED[scorer] = scorer.load()
        out = pd.Series([None] * len(texts), dtype="float64")
        at = [i for i, t in enumerate(texts) if isinstance(t, str)]
        for k in range(0, len(at), 64):
            some = at[k : k + 64]
            out.iloc[some] = _LOADED[scorer]([texts.iloc[i] for i in some])
        return out

    asked = F.col(text).rlike(r"(?U)\S")
    asked = F.coalesce(asked if only is None else asked & only, F.lit(False))
    capped = F.left(F.col(text), F.lit(settings.max_chars))
    df = df.withColumn("_deep", run(F.when(asked, capped)))
    made = F.struct(
        F.col("_deep").alias("score"),
        decision(F.col("_deep"), settings.block_threshold, settings.warn_threshold).alias("action"),
        F.lit(True).alias("available"),
        (F.length(text) > settings.max_chars).alias("char_truncated"),
    )
    return df.withColumn("deep", F.when(asked, made)).drop("_deep")
