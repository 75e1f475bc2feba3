"""What a stage is: a declaration that compiles to column expressions.

``Stage.plan`` gets the columns of the state and returns those that it changes.  The
pipeline adds the guard (rejected documents are skipped, a share p is sampled), the
reason of a rejection and the counters.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.document import Document, Token
from corpusflow.schema import EXTRAS, TOKENS

logger = logging.getLogger(__name__)


@dataclass
class State:
    """Columns of a document as a stage finds them."""

    text: Column
    is_rejected: Column
    extras: Column
    reject_reason: Column
    tokens: Column | None
    original: Column
    #: whether the stage is applied to this document (not skipped, and in the sample)
    go: Column | None = None

    @property
    def wanted(self) -> Column:
        """The text for functions in Python: null where the stage isn't applied, so that nothing is computed there."""
        return self.text if self.go is None else F.when(self.go, self.text)


@dataclass
class Change:
    """What a stage does: None leaves a column as it is.

    reject: true rejects (null counts as false).  new_extras: entries that are merged into
    extras (a null map: none).  reason: more entries for the reason of
    a rejection (JSON text).  error: not null where the stage failed.  ns: nanoseconds
    that the stage took in Python.
    """

    text: Column | None = None
    reject: Column | None = None
    extras: Column | None = None
    new_extras: Column | None = None
    tokens: Column | None = None
    reason: dict[str, Column] | None = None
    error: Column | None = None
    ns: Column | None = None


class Stage:
    """p: share of documents it is applied to, by a hash of doc_id; skip_rejected: leave rejected documents alone.

    use_batch, batch_size: stages written in Python get lists of up to so many documents
    (see Filter); others take columns, and only record them in reasons.
    """

    uses_tokens = False

    def __init__(self, p: float = 1.0, skip_rejected: bool = True, *, random_state: int | None = None, use_batch: bool = False, batch_size: int = 128) -> None:
        if not 0 <= p <= 1:
            raise ValueError("p must be in the range 0 to 1")
        self.name = type(self).__name__
        self.p = p
        self.skip_rejected = skip_rejected
        self.use_batch = use_batch
        self.batch_size = batch_size
        self._seed = random_state

    def plan(self, s: State) -> Change:
        raise NotImplementedError

    def params(self) -> dict[str, Any]:
        """Public attributes of plain types, in the order in which they were set."""
        return {k: v for k, v in vars(self).items() if not k.startswith("_") and (v is None or isinstance(v, (str, int, float, bool)))}

    def __call__(self, text: str) -> str:
        """The stage applied to one text; the text is returned even if it is rejected."""
        return self.apply(Document(text)).text

    def apply(self, document: Document) -> Document:
        """The stage applied to one document, for tests and exploration; it starts a Spark job."""
        from corpusflow.plans.pipeline import apply_one

        return apply_one([self], document)

    def shutdown(self) -> None:
        """Released when a pipeline that is used as a context manager ends."""

    def __enter__(self):
        return self

    def __exit__(self, *_: object) -> None:
        self.shutdown()


class GlobalStage(Stage):
    """A stage that looks at all documents together: it changes the DataFrame itself.

    ``verdicts`` gets the documents it may look at and returns doc_id, reject and
    optionally new extras entries (a map of JSON text, column ``new_extras``).
    """

    def verdicts(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError


class Filter(Stage):
    """A stage written in Python: override ``apply`` (one document), or ``apply_batch`` (a list) and set use_batch.

    It gets the documents that pass the guard only, with their tokens (if a stage of
    the pipeline makes any), extras and reasons.  With use_batch they come in lists of up to
    batch_size, cut from Arrow batches; if a list fails, its documents are
    tried one by one, so that only those that fail themselves have an error.  An error
    rejects the document or fails the job, as the pipeline's on_error says.
    """

    def apply(self, document: Document) -> Document:
        raise NotImplementedError

    def apply_batch(self, batch: list[Document]) -> list[Document]:
        return [self.apply(d) for d in batch]

    def _run(self, docs: list[Document]) -> list[tuple[Document, str | None, int]]:
        """(document, error, nanoseconds) of each."""
        if not self.use_batch:
            return [self._one(d, self.apply) for d in docs]
        out: list[tuple[Document, str | None, int]] = []
        for k in range(0, len(docs), self.batch_size):
            part = docs[k : k + self.batch_size]
            copies = [d.copy() for d in part]
            began = time.perf_counter_ns()
            try:
                done = list(self.apply_batch(part))
                if len(done) != len(part):
                    raise ValueError(f"apply_batch gave {len(done)} documents for {len(part)}")
                share = (time.perf_counter_ns() - began) // len(part)
                out += [(d, None, share) for d in done]
            except Exception:
                if len(part) > 1:
                    logger.exception("a batch failed; its documents are tried one by one")
                out += [self._one(d, lambda x: self.apply_batch([x])[0]) for d in copies]
        return out

    def _one(self, document: Document, apply: Callable[[Document], Document]) -> tuple[Document, str | None, int]:
        began = time.perf_counter_ns()
        try:
            document, error = apply(document), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            logger.exception("a document failed")
        return document, error, time.perf_counter_ns() - began

    def plan(self, s: State) -> Change:
        return in_python(s, lambda: nullcontext(self._run))


def _values(entries: Any) -> dict[str, Any]:
    items = entries.items() if isinstance(entries, dict) else (entries if entries is not None else ())
    return {k: json.loads(v) if v is not None else None for k, v in items}


Runner = Callable[[list[Document]], list[tuple[Document, str | None, int]]]


def in_python(s: State, opened: Callable[[], AbstractContextManager[Runner]]) -> Change:
    """The change by a function of lists of documents.  opened: makes a context for each partition, which gives the function."""
    tokens = [s.tokens] if s.tokens is not None else []
    schema = f"text string, is_rejected boolean, extras {EXTRAS}, error string, ns bigint" + (f", tokens {TOKENS}" if tokens else "")

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        with opened() as each:
            for go, texts, rejected, extras, reasons, originals, *rest in batches:
                out: dict[str, list] = {k: [None] * len(texts) for k in ("text", "is_rejected", "extras", "error", "ns", *(["tokens"] if rest else []))}
                at = [k for k, (g, t) in enumerate(zip(go, texts)) if g and t is not None]
                docs = []
                for k in at:
                    d = Document(texts[k], bool(rejected[k]), extras=_values(extras[k]), reject_reason=_values(reasons[k]))
                    d._original = originals[k]
                    if rest:
                        d.tokens = [Token(t["text"], t["is_rejected"], t["original"]) for t in (rest[0][k] if rest[0][k] is not None else ())]
                    docs.append(d)
                for k, (d, error, ns) in zip(at, each(docs) if docs else ()):
                    out["text"][k], out["is_rejected"][k], out["error"][k], out["ns"][k] = d.text, d.is_rejected, error, ns
                    out["extras"][k] = {n: json.dumps(v, ensure_ascii=False) for n, v in d.extras.items()}
                    if rest:
                        out["tokens"][k] = [{"text": t.text, "original": t.original, "is_rejected": t.is_rejected} for t in d.tokens]
                yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in out.items()}).astype({"ns": "Int64"})

    out = run(s.go if s.go is not None else F.lit(True), s.text, s.is_rejected, s.extras, s.reject_reason, s.original, *tokens)
    return Change(text=F.coalesce(out["text"], s.text), reject=out["is_rejected"], extras=F.coalesce(out["extras"], s.extras), tokens=F.coalesce(out["tokens"], s.tokens) if tokens else None, error=out["error"], ns=out["ns"])
