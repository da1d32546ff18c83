"""Embedding and reranking by services over HTTP: requests, batch limits, retries and rate limits.

The wire is a function (``Transport``), so everything but the connection itself can be run without a network. A limiter
belongs to a task; it gets the task's share of the service's limits, so that all tasks together keep them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from marlstone.functions.helpers import backoff_seconds, retryable
from marlstone.operators.embedding import PROVIDERS
from marlstone.session import ship

#: (url, headers, body, seconds) -> (status, headers, body); a status of None stands for a connection that failed.
Transport = Callable[[str, dict[str, str], bytes, float], tuple[int | None, dict[str, str], bytes]]
#: Seconds of a rate that may be used at once.
BURST = 10.0


def over_http(url: str, headers: dict[str, str], body: bytes, seconds: float) -> tuple[int | None, dict[str, str], bytes]:
    from urllib import error, request

    try:
        with request.urlopen(request.Request(url, body, headers), timeout=seconds) as r:
            return r.status, dict(r.headers), r.read()
    except error.HTTPError as e:
        return e.code, dict(e.headers), e.read()
    except OSError as e:
        return None, {}, str(e).encode()


@dataclass
class Limiter:
    """Two buckets, of requests and of tokens, that refill with time and hold ten seconds' worth. A call takes from both or from none."""

    requests: float
    tokens: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _held: list[float] = field(default_factory=list)
    _at: float = 0.0

    def wait(self, tokens: int) -> float:
        """Wait until a request of so many tokens may go; gives the seconds waited. More than a full bucket waits for a full one."""
        rates = (self.requests / 60.0, self.tokens / 60.0)
        most = [max(1.0, rates[0] * BURST), max(1.0, rates[1] * BURST)]
        if not self._held:
            self._held, self._at = most[:], self.clock()
        need = (1.0, min(float(tokens), most[1]))
        waited = 0.0
        while True:
            now = self.clock()
            self._held = [min(m, h + r * (now - self._at)) for m, h, r in zip(most, self._held, rates)]
            self._at = now
            if all(h >= n - 1e-9 for h, n in zip(self._held, need)):
                self._held = [self._held[0] - 1.0, self._held[1] - tokens]
                return waited
            pause = max((n - h) / r for n, h, r in zip(need, self._held, rates) if h < n)
            self.sleep(pause)
            waited += pause


class ServiceError(Exception):
    pass


@dataclass
class Client:
    url: str
    key: str = ""
    transport: Transport = over_http
    limiter: Limiter | None = None
    attempts: int = 5
    seconds: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def post(self, path: str, body: dict, tokens: int) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        raw = json.dumps(body, ensure_ascii=False).encode()
        for attempt in range(self.attempts):
            if self.limiter:
                self.limiter.wait(tokens)
            status, answered, text = self.transport(f"{self.url.rstrip('/')}/{path}", headers, raw, self.seconds)
            if status is not None and 200 <= status < 300:
                return json.loads(text)
            if not retryable(status) or attempt + 1 == self.attempts:
                raise ServiceError(f"{status}: {text[:200].decode(errors='replace')}")
            after = next((v for k, v in answered.items() if k.lower() == "retry-after"), "")
            self.sleep(float(after) if after.replace(".", "", 1).isdigit() else backoff_seconds(attempt))
        raise ServiceError("no attempts")


def by_index(rows: list[dict], count: int, value: str) -> list:
    """Values in the order of the inputs, as a service may answer in any; each index must come once."""
    out: list = [None] * count
    for r in rows:
        i = r.get("index")
        if not isinstance(i, int) or not 0 <= i < count or out[i] is not None:
            raise ServiceError(f"answer with a wrong index: {i!r}")
        out[i] = r[value]
    if any(v is None for v in out):
        raise ServiceError("answer without all inputs")
    return out


class CompatibleProvider:
    """Embeddings of a service that speaks the widespread ``POST /embeddings`` form: model and a list of inputs."""

    remote = True

    def __init__(self, url: str, model: str, width: int, key: str = "", context: int = 8192, most_items: int = 256, most_tokens: int = 250_000, requests: float = 0, tokens: float = 0,
                 share: int = 1, transport: Transport = over_http, **client) -> None:
        limiter = Limiter(requests / share, tokens / share) if requests and tokens else None
        self.client = Client(url, key, transport, limiter, **client)
        self.model, self.width, self.context, self.most_items, self.most_tokens = model, width, context, most_items, most_tokens

    def body(self, texts: list[str]) -> dict:
        return {"model": self.model, "input": texts}

    def embed(self, texts: list[str]) -> np.ndarray:
        answer = self.client.post("embeddings", self.body(texts), sum(len(t.encode()) // 4 for t in texts))
        out = np.array(by_index(answer["data"], len(texts), "embedding"), dtype=np.float32).reshape(len(texts), -1)
        if texts and out.shape[1] != self.width:
            raise ServiceError(f"vectors of width {out.shape[1]}, wanted {self.width}")
        return out


class TypedProvider(CompatibleProvider):
    """A service that tells documents from queries and cuts long inputs; 100 texts and 96,000 tokens a batch."""

    def __init__(self, *args, kind: str = "document", most_items: int = 100, most_tokens: int = 96_000, **settings) -> None:
        super().__init__(*args, most_items=most_items, most_tokens=most_tokens, **settings)
        self.kind = kind

    def body(self, texts: list[str]) -> dict:
        return super().body(texts) | {"input_type": self.kind, "truncation": True}


PROVIDERS |= {"compatible": CompatibleProvider, "typed": TypedProvider}


def reranked(page: DataFrame, query: str, make: Callable[[], Client], model: str, text: str = "content", most: int = 1_000) -> DataFrame:
    """A page of results with ``relevance`` by a rerank service; null texts have none. A page has at most ``most`` rows, as services do."""
    if page.limit(most + 1).count() > most:
        raise ValueError(f"a page of more than {most} rows")
    schema = T.StructType([*page.schema.fields, T.StructField("relevance", T.DoubleType())])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [p for p in parts if len(p)]
        if not rows:
            return
        all_ = pd.concat(rows, ignore_index=True)
        at = [i for i, t in enumerate(all_[text]) if t is not None]
        scores: list[float | None] = [None] * len(all_)
        if at:
            texts = [all_[text].iloc[i] for i in at]
            answer = make().post("rerank", {"model": model, "query": query, "documents": texts}, sum(len(t.encode()) // 4 for t in [query, *texts]))
            for i, s in zip(at, by_index(answer["data"], len(at), "relevance_score")):
                scores[i] = float(s)
        yield all_.assign(relevance=pd.array(scores, dtype="Float64").astype(object))

    ship(page.sparkSession)
    return page.coalesce(1).mapInPandas(work, schema)
