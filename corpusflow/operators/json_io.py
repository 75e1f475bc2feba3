"""Stages that read documents from JSON lines and write them as such."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from corpusflow.functions.text import json_map, json_object, json_quoted
from corpusflow.plans.stage import Change, Stage, State
from corpusflow.schema import EXTRAS


def parse(line: str, key: str, extra_keys: list[str] | None) -> tuple[str, dict[str, str], str | None]:
    """(text, new extras as JSON text, error) of one line.  The text is taken before extras are looked at."""
    text, extras = line, {}
    try:
        data = json.loads(line)
        text = str(data[key])
        nested = data.get("extras")
        if isinstance(nested, dict):
            extras.update(nested)
        for k in extra_keys or ():
            if k == "extras" and isinstance(nested, dict):
                extras.update(nested)
            elif k in data:
                extras[k] = data[k]
    except Exception as e:
        return text, {}, f"{type(e).__name__}: {e}"
    return text, {k: json.dumps(v, ensure_ascii=False) for k, v in extras.items()}, None


class JSONLoader(Stage):
    """Take the text from a key of a JSON object, and extras from its extras and further keys.

    ignore: reject what can't be parsed instead of failing.  native: use Spark's own
    parser (faster; for lines known to be well formed with string values).
    """

    def __init__(self, key: str = "text", ignore: bool = False, extra_keys: list[str] | None = None, *, native: bool = False, **kwargs: Any) -> None:
        super().__init__(**kwargs)
        self.key = key
        self.ignore = ignore
        self._extra_keys = list(extra_keys) if extra_keys is not None else None
        self._native = native

    def plan(self, s: State) -> Change:
        if self._native:
            text = F.from_json(s.text, "map<string,string>", {"allowSingleQuotes": "false"})[self.key]
            error = F.when(text.isNull(), F.lit("not a JSON object with that key"))
            return self._change(F.coalesce(text, s.text), None, error)
        key, extra_keys = self.key, self._extra_keys

        @F.pandas_udf(f"text string, extras {EXTRAS}, error string")
        def load(lines: pd.Series) -> pd.DataFrame:
            rows = [parse(x, key, extra_keys) if x is not None else (None, {}, "no text") for x in lines]
            return pd.DataFrame(rows, columns=["text", "extras", "error"])

        out = load(s.wanted)
        return self._change(out["text"], out["extras"], out["error"])

    def _change(self, text, extras, error) -> Change:
        if self.ignore:
            return Change(text=text, new_extras=extras, reject=error.isNotNull())
        return Change(text=text, new_extras=extras, error=error)


class JSONDumper(Stage):
    """Write the document as a JSON object; rejected documents, too, unless skip_rejected is set."""

    def __init__(self, dump_reason: bool = False, p: float = 1, skip_rejected: bool = False, export_extras: bool = False, **kwargs: Any) -> None:
        super().__init__(p, skip_rejected, **kwargs)
        self.dump_reason = dump_reason
        self.export_extras = export_extras

    def plan(self, s: State) -> Change:
        pairs = [("text", json_quoted(s.text))]
        if self.dump_reason:
            pairs += [("is_rejected", s.is_rejected.cast("string")), ("reason", json_map(s.reject_reason))]
        if self.export_extras:
            pairs.append(("extras", json_map(s.extras)))
        return Change(text=json_object(pairs))
