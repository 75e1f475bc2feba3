"""Stages that wait for something: many documents of a batch at once, on an event loop in each Python worker."""

from __future__ import annotations

import asyncio
import json
import logging
import os
import random
import time
from collections.abc import Callable
from contextlib import contextmanager
from functools import partial
from typing import Any

from corpusflow.functions.document import Document
from corpusflow.plans.stage import Change, Stage, State, in_python

logger = logging.getLogger(__name__)


class AsyncFilter(Stage):
    """A stage written in Python with an asynchronous ``apply``; ``apply_batch`` runs those of a batch together."""

    def __init__(self, p: float = 1.0, skip_rejected: bool = True, *, use_batch: bool = True, **kwargs: Any) -> None:
        super().__init__(p, skip_rejected, use_batch=use_batch, **kwargs)

    async def apply(self, document: Document) -> Document:
        raise NotImplementedError

    async def apply_batch(self, batch: list[Document]) -> list[Document]:
        return list(await asyncio.gather(*map(self.apply, batch)))

    async def open(self) -> None:
        """Called on the worker's loop before the first batch of a partition."""

    async def close(self) -> None:
        """Called on the worker's loop after the last batch of a partition."""

    async def _guarded(self, documents: list[Document]) -> list[tuple[Document, str | None, int]]:
        """A batch, or where it fails its documents one by one."""
        began = time.perf_counter_ns()
        copies = [d.copy() for d in documents]
        try:
            done = list(await self.apply_batch(documents)) if self.use_batch else [await self.apply(d) for d in documents]
            if len(done) != len(documents):
                raise ValueError(f"apply_batch gave {len(done)} documents for {len(documents)}")
            return [(d, None, (time.perf_counter_ns() - began) // len(done)) for d in done]
        except Exception as e:
            if len(documents) == 1:
                logger.exception("a document failed")
                return [(copies[0], f"{type(e).__name__}: {e}", time.perf_counter_ns() - began)]
        alone = await asyncio.gather(*(self._guarded([d]) for d in copies))
        return [x for (x,) in alone]

    def plan(self, s: State) -> Change:
        """Batches of an Arrow batch run together; with use_batch of up to batch_size documents, else of one."""

        @contextmanager
        def opened():
            with asyncio.Runner() as runner:
                runner.run(self.open())
                try:
                    yield lambda docs: runner.run(together(docs))
                finally:
                    runner.run(self.close())

        async def together(docs: list[Document]) -> list[tuple[Document, str | None, int]]:
            size = self.batch_size if self.use_batch else 1
            parts = await asyncio.gather(*(self._guarded(docs[k : k + size]) for k in range(0, len(docs), size)))
            return [x for part in parts for x in part]

        return in_python(s, opened)


def _default_client(url: str, key: str, limit: int, timeout: float | None, connect_timeout: float) -> Any:
    try:
        from openai import AsyncOpenAI, Timeout
    except ImportError as e:
        raise ImportError("this stage needs the openai package, or a client of your own") from e
    return AsyncOpenAI(api_key=key, base_url=url, max_retries=0, timeout=Timeout(timeout, connect=connect_timeout))


def _one_message(document: Document) -> list[dict[str, str]]:
    return [{"role": "user", "content": document.text}]


class AsyncChatAPI(AsyncFilter):
    """Ask a chat model about each document; the answer goes into extras[output_key].

    client: a function of (url, key, most requests at once) that gives an object with
    ``chat.completions.create``; called in each worker.  The environment variables
    OPENAI_ENDPOINT_URL and OPENAI_API_KEY, where set, win over the arguments.  Failed
    requests are repeated, retry_count attempts in all, after random waits of up to
    5 seconds.  timeout: seconds for a whole attempt, connect_timeout: for the default
    client's connection.  check_alive: ask the endpoint for the model before each
    partition, so that a job against a dead one fails at once.
    """

    def __init__(
        self, model_id: str, *, output_key: str = "llm_output", max_concurrent_requests: int = 128, openai_endpoint_url: str | None = None, openai_api_key: str | None = None,
        message_generator: Callable[[Document], Any] = _one_message, retry_count: int = 5, api_kwargs: dict[str, Any] | None = None, client: Callable[[str, str, int], Any] | None = None, max_wait: float = 5.0,
        timeout: float | None = 600.0, connect_timeout: float = 10.0, check_alive: bool | None = None, fetch: Callable[[str], dict[str, Any]] | None = None, **kwargs: Any,
    ) -> None:
        super().__init__(**kwargs)
        self.model_id = model_id
        self.output_key = output_key
        self._limit = max_concurrent_requests
        self._url = os.environ.get("OPENAI_ENDPOINT_URL") or openai_endpoint_url or "https://api.openai.com/v1"
        self._key = os.environ.get("OPENAI_API_KEY") or openai_api_key or "sk-dummy"
        self._messages = message_generator
        self._attempts = retry_count
        self._api_kwargs = dict(api_kwargs or {})
        self._make = client or partial(_default_client, timeout=timeout, connect_timeout=connect_timeout)
        self._timeout = timeout
        self._check = check_alive if check_alive is not None else client is None
        self._fetch = fetch
        self._max_wait = max_wait
        self._client: Any = None
        self._gate: asyncio.Semaphore | None = None

    def __getstate__(self) -> dict[str, Any]:
        return vars(self) | {"_client": None, "_gate": None}

    async def open(self) -> None:
        if self._check:
            await asyncio.to_thread(check_api_alive, self._url, self.model_id, self._fetch)
        self._client, self._gate = self._make(self._url, self._key, self._limit), asyncio.Semaphore(self._limit)

    async def close(self) -> None:
        end = getattr(self._client, "close", None)
        if end is not None and asyncio.iscoroutine(done := end()):
            await done

    async def _ask(self, document: Document) -> Any:
        for attempt in range(1, self._attempts + 1):
            try:
                async with self._gate:
                    return await asyncio.wait_for(self._client.chat.completions.create(model=self.model_id, messages=self._messages(document), **self._api_kwargs), self._timeout)
            except Exception as e:
                if attempt == self._attempts:
                    raise
                logger.warning("attempt %d failed: %s", attempt, e)
                await asyncio.sleep(random.uniform(0, min(self._max_wait, 2.0 ** (attempt - 1))))
        raise ValueError("retry_count must be at least 1")

    async def apply(self, document: Document) -> Document:
        answer = await self._ask(document)
        if not answer.choices:
            raise RuntimeError("the answer has no choices")
        document.extras[self.output_key] = answer.choices[0].message.content
        return document


def check_api_alive(url: str, model_id: str, fetch: Callable[[str], dict[str, Any]] | None = None) -> None:
    """ValueError if the endpoint does not answer or has no such model."""

    def get(address: str) -> dict[str, Any]:
        from urllib.request import urlopen

        with urlopen(address, timeout=10) as r:
            return json.load(r)

    try:
        found = (fetch or get)(f"{url}/models")
    except OSError as e:
        raise ValueError(f"no answer from {url}/models") from e
    if model_id not in [m["id"] for m in found["data"]]:
        raise ValueError(f"{url} has no model {model_id}")
