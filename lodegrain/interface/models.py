"""Models behind small interfaces, with deterministic offline stand-ins."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.functions import text as T

LanguageModel = Callable[[str, float], str | None]

EXPANSION = "Expand this search query with related terms, in one line of at most {terms} more words: {query}"
ANALYSIS = "Topic: {topic}\nSources:\n{corpus}\nAnswer in lines COVERED:, GAPS:, QUERIES: and CONFIDENCE: (LOW, MEDIUM or HIGH)."
QUERIES = "Write {n} web search queries, one a line, on: {topic}"


class Embedder(Protocol):
    """Embeds batches of texts; made once per task by a factory."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """Offline stand-in, not semantic: signed counts of code tokens by hash, scaled to length one; null for a text
    without tokens.  Tokens are cut in the JVM and counted in Arrow batches, each different one hashed once a batch."""

    @F.arrow_udf("array<float>")
    def count(tokens: pa.Array) -> pa.Array:
        words = tokens.flatten().dictionary_encode()
        code = np.array([zlib.crc32(t.encode()) for t in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
        row = np.repeat(np.arange(len(tokens)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        v = np.bincount(row * dim + code // 2 % dim, np.where(code % 2 == 0, 1.0, -1.0), len(tokens) * dim).reshape(-1, dim)
        size = np.sqrt((v * v).sum(1))
        begin = np.concatenate([[0], np.cumsum((size > 0) * dim)]).astype(np.int32)
        values = (v[size > 0] / size[size > 0, None]).astype(np.float32).ravel()
        return pa.ListArray.from_arrays(pa.array(begin), pa.array(values), mask=pa.array(size == 0))

    return count(T.code_tokens(text))


def embed_chunks(chunks: DataFrame, factory: Callable[[], Embedder] | None = None, column: str = "content") -> DataFrame:
    """Add ``embedding`` (null where the model fails, never a vector of zeros)."""
    body = T.embedding_input(T.preprocess_code(column, F.col("language")))
    if factory is None:
        return chunks.withColumn("embedding", hashed_vector(body))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for b in batches:
            try:
                yield pd.Series(model.embed(b.tolist()))
            except Exception:  # noqa: BLE001  texts are then tried one by one
                out = []
                for t in b:
                    try:
                        out.append(model.embed([t])[0])
                    except Exception:  # noqa: BLE001
                        out.append(None)
                yield pd.Series(out)

    return chunks.withColumn("embedding", run(body))


def expand_queries(queries: DataFrame, model: LanguageModel | None, max_terms: int = 8) -> DataFrame:
    """Add ``expanded`` to (query_id, query) rows, a stated set on the driver; short queries and failed calls stay."""
    if model is None:
        return queries.withColumn("expanded", F.col("query"))
    answers, known = [], {}
    for r in queries.select("query_id", "query").toLocalIterator():
        q = r["query"] or ""
        if len(q.split()) > 1 and len(q.strip()) > 3 and q not in known:
            known[q] = model(EXPANSION.format(terms=max_terms, query=q), 0.3)
        answers.append((r["query_id"], known.get(q)))
    kind = queries.schema["query_id"].dataType.simpleString()
    got = queries.sparkSession.createDataFrame(answers, f"query_id {kind}, _answer string")
    joined = queries.join(got, "query_id", "left")
    return joined.withColumn("expanded", F.when(F.col("_answer").isNotNull(), T.clean_expansion("_answer", "query", max_terms)).otherwise(F.col("query"))).drop("_answer")


class ChatModel:
    """A language model behind a chat service of the usual form (POST /v1/chat/completions); None where it fails.

    ``send`` posts a JSON text to a url and returns the answer's; another can be given for tests or other transports."""

    def __init__(self, base_url: str, model: str, key: str | None = None, seconds: float = 120, send: Callable[[str, str], str] | None = None):
        self.url, self.model, self.key, self.seconds = base_url.rstrip("/") + "/v1/chat/completions", model, key, seconds
        self.send = send or self._post

    def _post(self, url: str, body: str) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urlopen(Request(url, body.encode(), headers), timeout=self.seconds) as answer:  # noqa: S310
            return answer.read().decode()

    def __call__(self, prompt: str, temperature: float) -> str | None:
        asked = {"model": self.model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}
        try:
            return json.loads(self.send(self.url, json.dumps(asked)))["choices"][0]["message"]["content"]
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None


def first_working(models: Sequence[LanguageModel]) -> LanguageModel:
    """A chain of models: each prompt goes to the first that answers it."""

    def ask(prompt: str, temperature: float) -> str | None:
        return next((a for m in models if (a := m(prompt, temperature)) is not None), None)

    return ask


class RememberedModel:
    """A model whose answers are kept; beyond ``most`` the older half goes.  Failures are not kept."""

    def __init__(self, model: LanguageModel, most: int = 1000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, prompt: str, temperature: float) -> str | None:
        if (prompt, temperature) not in self.known:
            answer = self.model(prompt, temperature)
            if answer is None:
                return None
            self.known[prompt, temperature] = answer
            if len(self.known) > self.most:
                for k in list(self.known)[: len(self.known) - self.most // 2]:
                    del self.known[k]
        return self.known[prompt, temperature]
