"""Model backends by feature: what to load, checked on the driver; loaded once a worker, keyed by the whole request.

No model is fetched by executors: a model must be installed there or be sent along by the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("lang", "ner", "sent")
_FACTORIES: dict[str, Callable[..., Any]] = {}


def register(name: str, factory: Callable[..., Any]) -> None:
    """Add a kind of model: a function from its options to what does the work (a function of one text)."""
    _FACTORIES[name] = factory


def check_pipeline(feature: str, info: dict[str, str] | None) -> dict[str, str]:
    """The request for a model pipeline, or an error that tells what is wrong with it."""
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature}")
    if info is None:
        info = {"task": "token-classification" if feature == "ner" else "text-classification", "model": "default"}
    if not isinstance(info, dict):
        raise TypeError("a pipeline is described by a dict")
    for key in ("task", "model"):
        if key not in info:
            raise KeyError(key)
    return dict(info)


_LOADED: dict[tuple, Any] = {}


def factory(name: str) -> Callable[..., Any]:
    """The function that makes a kind of model; unknown kinds are an error."""
    if name not in _FACTORIES:
        raise ValueError(f"no backend called {name}")
    return _FACTORIES[name]


def load(name: str, make: Callable[..., Any], **options: Any) -> Any:
    """This worker's model for exactly this request, made at the first call; a missing library is an error that names it."""
    key = (name, make.__module__, make.__qualname__, tuple(sorted((k, str(v)) for k, v in options.items())))
    if key not in _LOADED:
        try:
            _LOADED[key] = make(**options)
        except ImportError as e:
            raise RuntimeError(f"the library of the backend {name} isn't installed: {e}") from e
    return _LOADED[key]


def instance(name: str, **options: str) -> Any:
    return load(name, factory(name), **options)


def _spacy(model: str = "default", lang: str = "de") -> Callable[[str], list[str]]:
    """A sentence splitter: text to its sentences."""
    import spacy

    nlp = spacy.load(model if model != "default" else f"{lang}_core_news_md", exclude=["lemmatizer", "ner"])
    return lambda text: [s.text.strip() for s in nlp(text).sents]


def _transformers(task: str = "token-classification", model: str = "default", **options: str) -> Callable[[str], list[dict]]:
    """A recogniser: sentence to its entities as dicts with entity_group, word, start, end, score."""
    from transformers import pipeline

    recognise = pipeline(task, model=None if model == "default" else model, **({"aggregation_strategy": "simple"} | options))
    return lambda text: [{**e, "score": float(e["score"])} for e in recognise(text)]


register("spacy", _spacy)
register("transformers", _transformers)


def sentence_splitter(name: str = "spacy", **options: str):  # noqa: ANN201
    """A function from a column of texts to a column of their sentences by a model."""
    make = factory(name)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = load(name, make, **options)
        for texts in batches:
            yield pd.Series([None if t is None else [s for s in one(t) if s] for t in texts])

    return split


def recogniser(name: str = "transformers", info: dict[str, str] | None = None):  # noqa: ANN201
    """A function from a column of sentences to a column of entities by a model."""
    from quillveil.operators.entities import ENTITY

    make, options = factory(name), check_pipeline("ner", info)

    @F.pandas_udf(T.ArrayType(ENTITY))
    def recognise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = load(name, make, **options)
        keys = ("entity_group", "word", "start", "end", "score")
        for column in batches:
            yield pd.Series([None if ss is None else [{**{k: e[k] for k in keys}, "sent_idx": i} for i, s in enumerate(ss) if s for e in one(s)] for ss in column])

    return recognise
