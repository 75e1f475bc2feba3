"""Pipelines: stages folded into one logical plan.

``Pipeline.transform`` only adds columns; nothing runs until an action does, and
the same plan serves batch and streaming DataFrames.  Rejection is a flag with a
reason: rows leave the data only in ``survivors``.

Counting rules (the contract of ``statistics``): a document that a stage turns from
kept to rejected counts as its input and discard; every other document, those
that were rejected before included, as its input and output; a document in which
the stage fails counts as an error only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.document import Document, Token
from corpusflow.functions.text import json_quoted_native, merged
from corpusflow.plans.stage import Change, GlobalStage, Stage, State
from corpusflow.plans.stats import COUNTERS, TIME, Statistics
from corpusflow.schema import EXTRAS, as_documents, empty_map
from corpusflow.sources.storage import written

_SCALE = 1 << 53
#: names of our own that no column of a user has
_OWN = "__corpusflow_"
_META = f"{_OWN}m_"


class Pipeline(Stage):
    """Stages in order; pipelines among them are flattened (their own p and skip_rejected are not used).

    random_state: seed of the sampling of stages that have none of their own.
    on_error: ``raise`` fails the job, ``reject`` rejects the document with the error as reason.
    """

    def __init__(self, stages: Sequence[Stage], random_state: int | None = None, on_error: str = "raise", **kwargs: Any) -> None:
        super().__init__(random_state=random_state, **kwargs)
        if on_error not in ("raise", "reject"):
            raise ValueError("on_error is raise or reject")
        self._on_error = on_error
        self.stages: list[Stage] = []
        self._add(stages)
        for k, s in enumerate(self.stages):
            s.name = f"{k}-{type(s).__name__}"

    def _add(self, stages: Iterable[Stage]) -> None:
        for s in stages:
            if isinstance(s, Pipeline):
                self._add(s.stages)
            elif isinstance(s, Stage):
                self.stages.append(s)
            else:
                raise TypeError(f"{s!r} is not a stage")

    @property
    def filters(self) -> list[Stage]:
        return self.stages

    # the plan

    def transform(self, df: DataFrame, *, metrics: bool = False, id_col: str | None = None) -> DataFrame:
        """df with the stages applied; metrics: keep the columns that ``statistics`` sums."""
        out = as_documents(df, id_col=id_col, tokens=any(s.uses_tokens for s in self.stages))
        if metrics:
            out = out.withColumn(f"{_META}in", _info(F.col("text"), F.col("is_rejected")))
        for k, stage in enumerate(self.stages):
            out = self._apply(out, k, stage, metrics)
        return out

    def _guard(self, df: DataFrame, k: int, stage: Stage) -> Column:
        go = F.lit(True)
        if stage.skip_rejected:
            go = go & ~F.col("is_rejected")
        if stage.p < 1:
            if "doc_id" not in df.columns:
                raise ValueError("sampling needs a doc_id (transform(..., id_col=...))")
            seed = stage._seed if stage._seed is not None else (self._seed or 0)
            u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k), F.lit(seed)), F.lit(_SCALE)) / F.lit(_SCALE)
            go = go & (u < F.lit(float(stage.p)))
        return go

    def _apply(self, df: DataFrame, k: int, stage: Stage, metrics: bool) -> DataFrame:
        cols = set(df.columns)
        go = self._guard(df, k, stage)
        if isinstance(stage, GlobalStage):
            if k and "doc_id" in cols:
                df = _held(df)
            df, change = self._global(df, stage, go)
        df = df.withColumn(f"{_OWN}go", go)
        go = F.col(f"{_OWN}go")
        if not isinstance(stage, GlobalStage):
            change = stage.plan(State(F.col("text"), F.col("is_rejected"), F.col("extras"), F.col("reject_reason"), F.col("tokens") if "tokens" in cols else None, F.col("original"), go))
        fresh: dict[str, Column] = {}
        if change.text is not None:
            fresh["text"] = change.text
        if change.reject is not None:
            fresh["reject"] = F.coalesce(change.reject, F.lit(False))
        if change.extras is not None:
            fresh["extras"] = change.extras
        if change.new_extras is not None:
            fresh["new_extras"] = F.coalesce(change.new_extras, empty_map())
        if change.tokens is not None:
            fresh["tokens"] = change.tokens
        if change.error is not None:
            fresh["error"] = F.when(go, change.error)
        if change.ns is not None:
            fresh["ns"] = change.ns
        df = df.withColumns({_OWN + n: c for n, c in fresh.items()})
        own = {n: F.col(_OWN + n) for n in fresh}
        failed = change.error is not None
        bad = own["error"].isNotNull() if failed else F.lit(False)
        if failed and self._on_error == "raise":
            go = F.when(bad, F.raise_error(F.concat(F.lit(f"{stage.name}: "), own["error"])).cast("boolean")).otherwise(go)
        done = go & ~bad
        new: dict[str, Column] = {}
        text = F.when(done, own["text"]).otherwise(F.col("text")) if change.text is not None else F.col("text")
        if change.text is not None:
            new["text"] = text
        rejected = F.col("is_rejected")
        if change.reject is not None or failed:
            rejects = own.get("reject", F.lit(False)) | bad
            rejected = rejected | (go & rejects)
            new["is_rejected"] = rejected
            turned = rejected & ~F.col("is_rejected")
            error = json_quoted_native(F.coalesce(own["error"], F.lit(""))) if failed else F.lit('""')
            new["reject_reason"] = F.when(turned & bad, F.create_map(F.lit("error"), error)).when(turned, _reason(stage, change)).otherwise(F.col("reject_reason"))
        if change.extras is not None:
            new["extras"] = F.when(done, own["extras"]).otherwise(F.col("extras"))
        if change.new_extras is not None:
            new["extras"] = F.when(done, merged(F.col("extras"), own["new_extras"])).otherwise(F.col("extras"))
        if change.tokens is not None:
            new["tokens"] = F.when(done, own["tokens"]).otherwise(F.col("tokens"))
        if metrics:
            new[f"{_META}{k}"] = F.struct(_info(F.col("text"), F.col("is_rejected")).alias("before"), _info(text, rejected).alias("after"), bad.alias("error"), F.coalesce(own.get("ns", F.lit(0)), F.lit(0)).cast("bigint").alias("ns"))
        return _settled(df, new)

    def _global(self, df: DataFrame, stage: GlobalStage, go: Column) -> tuple[DataFrame, Change]:
        if "doc_id" not in df.columns:
            raise ValueError(f"{stage.name} needs a doc_id (transform(..., id_col=...))")
        found = stage.verdicts(df.filter(go))
        more = "new_extras" in found.columns
        found = found.select(F.col("doc_id").alias(f"{_OWN}id"), F.col("reject").alias(f"{_OWN}v_reject"), *([F.col("new_extras").alias(f"{_OWN}v_extras")] if more else []))
        df = df.join(found, F.col("doc_id") == F.col(f"{_OWN}id"), "left")
        return df, Change(reject=F.col(f"{_OWN}v_reject"), new_extras=F.col(f"{_OWN}v_extras") if more else None)

    # results

    def survivors(self, df: DataFrame, *, id_col: str | None = None) -> DataFrame:
        """The documents that no stage rejects, with the columns of df (as changed) only."""
        out = self.transform(df, id_col=id_col).filter(~F.col("is_rejected"))
        return out.select(*df.columns)

    def statistics(self, df: DataFrame, *, id_col: str | None = None, time: bool = False) -> DataFrame:
        """A row for Total and one for each stage: one pass, one aggregation of counters.

        time: also cumulative_time_ns, what stages written in Python took in all tasks
        together.  Those of column expressions are fused by Spark, so they have no time
        of their own and count as 0.
        """
        return statistics_of(self.transform(df, metrics=True, id_col=id_col), [s.name for s in self.stages], (*COUNTERS, TIME) if time else COUNTERS)

    def get_statistics(self, df: DataFrame) -> list[Statistics]:
        rows = {r["name"]: r for r in self.statistics(df, time=True).collect()}  # as many rows as stages
        return [Statistics(**rows[n].asDict()) for n in ["Total", *[s.name for s in self.stages]]]

    def observed(self, df: DataFrame, *, id_col: str | None = None):
        """(transformed df, Observation): counters collected while another action runs, without a pass of their own."""
        from pyspark.sql import Observation

        out = self.transform(df, metrics=True, id_col=id_col)
        names = [s.name for s in self.stages]
        seen = Observation()
        kept = [c for c in out.columns if not c.startswith(_META)]
        return out.observe(seen, *_sums(names)).select(*kept), seen

    def observed_statistics(self, seen: dict[str, int]) -> list[Statistics]:
        """What an Observation of ``observed`` counted."""
        names = ["Total", *[s.name for s in self.stages]]
        return [Statistics(n, **{c: seen[f"{p}{c}"] for c in (*COUNTERS, TIME)}) for n, p in zip(names, ["t_", *[f"s{k}_" for k in range(len(self.stages))]])]

    def summary(self, format: str = "print") -> Any:  # noqa: A002
        rows = [{"name": s.name, "doc": (type(s).__doc__ or "").strip()} for s in self.stages]
        if format == "json":
            return rows
        for r in rows:
            print(f"{r['name']}: {r['doc'].splitlines()[0] if r['doc'] else ''}")
        return None

    def __call__(self, text: str) -> str:
        """The text after all stages, "" if it is rejected."""
        d = apply_one(self.stages, Document(text), self._on_error)
        return "" if d.is_rejected else d.text

    def apply(self, document: Document) -> Document:
        return apply_one(self.stages, document, self._on_error)

    def shutdown(self) -> None:
        for s in self.stages:
            s.shutdown()


def _held(df: DataFrame) -> DataFrame:
    """df stored: a stage that looks at all documents reads them several times, and what earlier stages do is done once.

    An original that the text still is isn't stored again.  Types that files can't have: df as it is.
    """
    if any(x in kind for _, kind in df.dtypes for x in ("void", "interval")):
        return df
    same, original = f"{_OWN}same", F.col("original")
    out = written(df.withColumns({same: original.eqNullSafe(F.col("text")), "original": F.when(~original.eqNullSafe(F.col("text")), original)}), "documents")
    return out.withColumn("original", F.when(F.col(same), F.col("text")).otherwise(original)).drop(same)


def _settled(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns, and without those of our own.

    The new columns come out of a generator of one row: Catalyst neither merges it with
    the projections of later stages nor pushes filters through it, both of which would
    copy the expressions of this stage into each place that uses its columns, stage
    after stage.  So each is computed once.
    """
    own = [c for c in df.columns if c.startswith(_OWN) and not c.startswith(_META)]
    if not new:
        return df.drop(*own)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in own and c not in new]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def _info(text: Column, rejected: Column) -> Column:
    return F.struct(rejected.alias("rejected"), F.octet_length(text).cast("bigint").alias("bytes"), F.length(text).cast("bigint").alias("chars"))


def _reason(stage: Stage, change: Change) -> Column:
    pairs: dict[str, Column] = {k: F.lit(json.dumps(v, ensure_ascii=False)) for k, v in stage.params().items()}
    pairs |= change.reason or {}
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]).cast(EXTRAS)


def _counter_sums(prefix: str, before: Column, after: Column, error: Column, ns: Column | None = None) -> list[Column]:
    gone = ~before["rejected"] & after["rejected"]
    ok = ~error

    def total(when: Column, value: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0).cast("bigint")).alias(f"{prefix}{name}")

    one = F.lit(1).cast("bigint")
    out = [total(ok, one, "input_num"), total(ok, before["bytes"], "input_bytes"), total(ok, before["chars"], "input_chars")]
    out += [total(ok & ~gone, one, "output_num"), total(ok & ~gone, after["bytes"], "output_bytes"), total(ok & ~gone, after["chars"], "output_chars")]
    out += [total(ok & gone, one, "discard_num")]
    for x in ("bytes", "chars"):
        out.append(total(ok, F.when(gone, -before[x]).otherwise(after[x] - before[x]), f"diff_{x}"))
    return [*out, total(error, one, "errors"), total(F.lit(True), ns if ns is not None else F.lit(0).cast("bigint"), TIME)]


def _sums(names: list[str]) -> list[Column]:
    last = F.struct(F.col("is_rejected").alias("rejected"), F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"))
    spent = sum((F.col(f"{_META}{k}")["ns"] for k in range(len(names))), F.lit(0).cast("bigint"))
    out = _counter_sums("t_", F.col(f"{_META}in"), last, F.lit(False), spent)
    for k in range(len(names)):
        m = F.col(f"{_META}{k}")
        out += _counter_sums(f"s{k}_", m["before"], m["after"], m["error"], m["ns"])
    return out


def statistics_of(df: DataFrame, names: list[str], counters: Sequence[str] = COUNTERS) -> DataFrame:
    wide = df.agg(*_sums(names))
    rows = [F.struct(F.lit(n).alias("name"), *[F.col(f"{p}{c}").alias(c) for c in counters]) for n, p in [("Total", "t_"), *[(n, f"s{k}_") for k, n in enumerate(names)]]]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def apply_one(stages: Sequence[Stage], document: Document, on_error: str = "raise") -> Document:
    """One document through stages, as a one-row DataFrame in the active session."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    schema = f"doc_id bigint, text string, original string, is_rejected boolean, reject_reason {EXTRAS}, extras {EXTRAS}, tokens array<struct<text:string,original:string,is_rejected:boolean>>"
    encode = lambda d: {k: json.dumps(v, ensure_ascii=False) for k, v in d.items()}
    row = (0, document.text, document.original, document.is_rejected, encode(document.reject_reason), encode(document.extras), [(t.text, t.original, t.is_rejected) for t in document.tokens])
    names = [s.name for s in stages]
    plan = Pipeline(stages, on_error=on_error)
    out = plan.transform(spark.createDataFrame([row], schema)).first()
    for s, n in zip(stages, names):
        s.name = n if isinstance(n, str) and "-" in n else s.name
    result = Document(out["text"], out["is_rejected"], [Token(t["text"], t["is_rejected"], t["original"]) for t in out["tokens"]], {k: json.loads(v) for k, v in (out["extras"] or {}).items()}, {k: json.loads(v) for k, v in (out["reject_reason"] or {}).items()})
    result._original = document.original
    return result


__all__ = ["Pipeline", "apply_one", "empty_map", "statistics_of"]
