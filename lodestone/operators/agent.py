"""Model-backed steps with models that can be put in, and offline defaults."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Cues by which the offline router tells questions apart.
CUES = {"compare": r"\b(compare|comparison|difference between|versus|vs)\b", "literature": r"\b(overview|survey|literature|review|papers?)\b"}
CRAG_THRESHOLD = 0.1


@dataclass
class LanguageModel:
    """A text model; generate never raises. Without an answer function it says that it is offline."""

    answer: Callable[[str], str] | None = None
    fallback: Callable[[str], str] | None = None

    def generate(self, prompt: str) -> str:
        for model in (self.answer, self.fallback):
            if model is None:
                continue
            try:
                return model(prompt)
            except Exception as e:  # the contract is an error text
                error = f"Error: {e}"
                if model is self.fallback or self.fallback is None:
                    return error
        return "Error: no model is configured"


def shared_words(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of the query's words that the text has."""
    out = []
    for q, t in zip(query, text, strict=True):
        words = set((q or "").lower().split())
        out.append(len(words & set((t or "").lower().split())) / len(words) if words else 0.0)
    return pd.Series(out, dtype=float)


def route(question: str, model: LanguageModel | None = None) -> str:
    """compare, literature or chat."""
    if model is not None:
        said = model.generate(f"Name the kind of this question, compare, literature or chat: {question}").strip().lower()
        return said if said in (*CUES, "chat") else "chat"
    return next((kind for kind, cue in CUES.items() if re.search(cue, question.lower())), "chat")


def extract_relations(chunks: DataFrame, extractor: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Triples (doc_id, source, relation, target) of (doc_id, text); none without an extractor, or where it fails."""

    @F.pandas_udf("array<struct<source:string,relation:string,target:string>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                found = extractor(t or "") if extractor else []
            except Exception:  # a model's failure is an empty answer
                found = []
            out.append([{k: str(x[k]) for k in ("source", "relation", "target")} for x in found if {"source", "relation", "target"} <= set(x)])
        return pd.Series(out)

    return chunks.select("doc_id", F.explode(run("text")).alias("t")).select("doc_id", "t.*")


def corrective_search(search: Callable[[str], DataFrame], rerank: Callable[[str, DataFrame], DataFrame], question: str, model: LanguageModel, threshold: float = CRAG_THRESHOLD) -> DataFrame:
    """Search and rerank; if the best score is poor, once more with a rewritten question."""
    first = rerank(question, search(question))
    top = first.agg(F.max("score")).first()[0]
    if top is not None and top > threshold:
        return first
    again = model.generate(f"Rewrite this search query: {question}").strip()
    return first if not again or again.startswith("Error") else rerank(again, search(again))


@dataclass
class Answer:
    answer: str
    citations: list = field(default_factory=list)


def generate_answer(question: str, context: str, model: LanguageModel) -> Answer:
    """An answer with citations from the context; a reply that is not JSON is the answer itself."""
    reply = model.generate(f"Answer from the context as JSON with answer and citations.\nContext:\n{context}\nQuestion: {question}")
    try:
        said = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip()))
        return Answer(str(said["answer"]), list(said.get("citations", [])))
    except (ValueError, KeyError, TypeError):
        return Answer(reply)


def smart_search(question: str, search: Callable[[str], DataFrame], rerank: Callable[[str, DataFrame], DataFrame], context_of: Callable[[DataFrame], str], model: LanguageModel) -> dict:
    """Route, corrective search of five, a context of 800 characters, answer."""
    kind = route(question, model if model.answer else None)
    hits = corrective_search(search, rerank, question, model).limit(5)
    return {"route": kind, "answer": generate_answer(question, context_of(hits)[:800], model).answer, "hits": hits}
