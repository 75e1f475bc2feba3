"""A query for each stage over the whole of a table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow import operators as ops
from corpusflow.functions.symbols import special_class
from corpusflow.functions.taggers import RegexTagger
from corpusflow.functions.text import escaped
from corpusflow.operators import dedup
from corpusflow.operators.predicates import bbs_pattern, katakana_only
from corpusflow.operators.text import email_pattern, phone_pattern
from corpusflow.operators.tokens import seo_pattern
from corpusflow.plans.stats import COUNTERS, merge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: documents have no Japanese and no runs of dots: each gets an ending by its number (an expression that both engines read)
JA = (
    "concat(CASE doc_id % 4 WHEN 0 THEN 'カジノは楽しい。' WHEN 1 THEN 'カジノバーで。' ELSE '' END, text, "
    "CASE doc_id % 3 WHEN 0 THEN 'お問い合わせください。お問い合わせ' WHEN 1 THEN '投稿日: 2020年1月2日 広告 詳細はこちら' ELSE ' 無料' END)"
)
DOTS = "CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', concat('...', chr(10))) WHEN 1 THEN replace(text, '. ', concat('…', chr(10))) ELSE text END"
NG_EN = ("the", "copyright", "license", "free software")
NG_JA = ("無料", "楽しい", "カジノ", "バー")
ADS = ("広告", "無料", "詳細は", "click", "free")
HEADS = ("お問い合わせ", "カジノ", "the", "投稿")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def documents(spark: SparkSession, sf_dir: str, text: str = "text") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs if text == "text" else docs.withColumn("text", F.expr(text))


def rejects(name: str, stage: Callable[[], ops.Stage], sql: str | None, text: str = "text") -> None:
    """A query of doc_id and is_rejected; sql is a condition on the column text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.Pipeline([stage()]).transform(documents(spark, sf_dir, text)).select("doc_id", "is_rejected")

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"SELECT doc_id, coalesce({sql}, false) AS is_rejected FROM (SELECT doc_id, {text} AS text FROM documents)"


def texts(name: str, stages: Callable[[], list[ops.Stage]], sql: str | None, text: str = "text") -> None:
    """A query of doc_id and the rewritten text; sql is its expression."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ops.Pipeline(stages()).transform(documents(spark, sf_dir, text)).select("doc_id", "text")

    QUERIES[name] = run
    if sql is not None:
        SQL[name] = f"SELECT doc_id, {sql} AS text FROM (SELECT doc_id, {text} AS text FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(map(escaped, words))


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, {quoted(pattern)}))"


def _words_of(stage: ops.Stage) -> tuple[str, ...]:
    return tuple(stage._words)


SHORT = "len(list_filter(string_split(text, chr(10)), lambda x: length(x) <= 10)) / len(string_split(text, chr(10)))"
MASKED = f"regexp_replace(regexp_replace(text, {quoted(phone_pattern())}, '\\1XXXX', 'g'), {quoted(email_pattern())}, 'xxxx@yyy\\1', 'g')"
QUOTED = "CAST(to_json(text) AS VARCHAR)"
_KATA = "ァ-ヴー"
_plain = tuple(w for w in NG_JA if not katakana_only(w))
_kata = tuple(w for w in NG_JA if katakana_only(w))

# stages that reject
rejects("discard_all", ops.DiscardAll, "true")
rejects("discard_keyword", lambda: ops.DiscardContainingKeyword("license"), "contains(text, 'license')")
rejects("length_filter", lambda: ops.DocumentLengthFilter(200, 5000), "length(text) < 200 OR length(text) > 5000")
rejects("short_lines", ops.DiscardTooShortLines, f"{SHORT} > 0.5")
rejects("rare_kuten", ops.DiscardRareKuten, f"{_count('。')} < length(text) / 100", JA)
rejects("accept_japanese", ops.AcceptJapanese, "NOT regexp_matches(substr(text, 1, 50), '[ぁ-んァ-ン]')", JA)
rejects("bbs_comments", lambda: ops.DiscardBBSComments(1), f"{_count(bbs_pattern())} > 1", JA)
rejects("ads", lambda: ops.DiscardAds(words=ADS, max_allowed_num=1), f"{_count(_alternatives(ADS))} > 1", JA)
rejects("ads_default", lambda: ops.DiscardAds(max_allowed_num=0), f"{_count(_alternatives(_words_of(ops.DiscardAds())))} > 0", JA)
rejects("ellipsis", ops.DiscardTooManyEndingEllipsis, f"{_count('(?:[.]{3}|…)' + chr(10))} / greatest({_count(chr(10))}, 1) > 0.7", DOTS)
rejects("special_chars", lambda: ops.DiscardTooManySpecialToken(0.2), f"CASE WHEN length(text) = 0 THEN false ELSE (length(text) - length(regexp_replace(text, '[' || {quoted(special_class())} || ']+', '', 'g'))) / length(text) > 0.2 END")
rejects("run_length", lambda: ops.SingleCharacterRepetitionFilter(3), None)
SQL["run_length"] = """
SELECT doc_id, coalesce(bool_or(same), false) AS is_rejected FROM (
    SELECT doc_id, c[i] = c[i + 1] AND c[i] = c[i + 2] AS same FROM (SELECT doc_id, c, unnest(CASE WHEN len(c) > 2 THEN generate_series(1, len(c) - 2) ELSE [1] END) AS i FROM (SELECT doc_id, string_split(text, '') AS c FROM documents)))
GROUP BY doc_id"""
rejects("ng_en", lambda: ops.NgWordsFilterEn(words=NG_EN), f"regexp_matches(text, {quoted(f'(?i)(?:^| )(?:{_alternatives(NG_EN)})(?:[ ,.]|{chr(92)}n?$)')})")
rejects("ng_ja", lambda: ops.NgWordsFilterJa(words=NG_JA), f"regexp_matches(text, {quoted(_alternatives(NG_JA))})", JA)
rejects("ng_ja_unconfused", lambda: ops.NgWordsFilterJa(words=NG_JA, ignore_confused=True), f"regexp_matches(text, {quoted(f'{_alternatives(_plain)}|(?:^|[^{_KATA}])(?:{_alternatives(_kata)})(?:[^{_KATA}]|$)')})", JA)
for _name, _stage in (("adult_ja", ops.DiscardAdultContentJa), ("discrimination_ja", ops.DiscardDiscriminationContentJa), ("violence_ja", ops.DiscardViolenceContentJa)):
    rejects(_name, _stage, f"regexp_matches(text, {quoted(_alternatives(_words_of(_stage())))})", f"concat(text, CASE doc_id % 5 WHEN 0 THEN {quoted(_words_of(_stage())[1])} ELSE '' END)")
rejects("adult_en", ops.DiscardAdultContentEn, f"regexp_matches(text, {quoted(f'(?i)(?:^| )(?:{_alternatives(_words_of(ops.DiscardAdultContentEn()))})(?:[ ,.]|{chr(92)}n?$)')})", f"concat(text, CASE doc_id % 5 WHEN 0 THEN {quoted(' ' + _words_of(ops.DiscardAdultContentEn())[1])} ELSE '' END)")
rejects("char_repetition", lambda: ops.CharRepetitionRatioFilter(0.2), None)
SQL["char_repetition"] = """
WITH g AS (SELECT doc_id, substr(text, i, 5) AS gram, count(*) AS n FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 4)) AS i FROM documents WHERE length(text) >= 5) GROUP BY ALL),
s AS (SELECT doc_id, sum(n) AS total, least(CAST(floor(sqrt(count(*))) AS BIGINT), count(*) - count(*) FILTER (n = 1)) AS k FROM g GROUP BY doc_id),
r AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS rank FROM g),
t AS (SELECT s.doc_id, coalesce(sum(n) FILTER (rank <= k), 0) / any_value(total) AS ratio FROM s JOIN r USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, coalesce(ratio, 0.0) >= 0.2 AS is_rejected FROM documents LEFT JOIN t USING (doc_id)"""
rejects("word_repetition", lambda: ops.WordRepetitionRatioFilter(0.1, 7, 1_000_000_000, tagger=RegexTagger()), None)
SQL["word_repetition"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_0-9]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 6), ' ') AS gram, count(*) AS n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 7) GROUP BY ALL),
t AS (SELECT doc_id, coalesce(sum(n) FILTER (n > 1), 0) / sum(n) AS ratio FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(ratio, 0.0) >= 0.1 AS is_rejected FROM documents LEFT JOIN t USING (doc_id)"""
rejects("nouns", lambda: ops.DiscardTooManyNouns(0.5, tagger=RegexTagger(kind="名詞")), "len(regexp_extract_all(text, '[A-Za-z_0-9]+')) > 0")


def by_letters(found: list[str]) -> list[tuple[str, float]]:
    return [("ja" if any("ぁ" <= c <= "ん" for c in t) else "xx", 0.9) for t in found]


rejects("language", lambda: ops.AcceptJapaneseByFastText(predictor=by_letters), "NOT regexp_matches(text, '[ぁ-ん]')", JA)

# stages that rewrite
texts("append_tag", lambda: [ops.AppendTag("<tag>")], "text || '<tag>'")
texts("identity", lambda: [ops.Identity()], "text")
texts("apply_discard", lambda: [ops.DocumentLengthFilter(200, 5000), ops.ApplyDiscard(skip_rejected=False)], "CASE WHEN length(text) < 200 OR length(text) > 5000 THEN '' ELSE text END")
texts("normalize", lambda: [ops.DocumentNormalizer()], "text")  # NFKC leaves all these texts as they are; tests/ has others
texts("mask_pii", lambda: [ops.MaskPersonalInformation()], MASKED)
texts("json_dump", lambda: [ops.JSONDumper()], f"'{{\"text\": ' || {QUOTED} || '}}'")
texts("json_dump_reason", lambda: [ops.DocumentLengthFilter(200), ops.JSONDumper(dump_reason=True)],
      f"'{{\"text\": ' || {QUOTED} || ', \"is_rejected\": ' || CASE WHEN length(text) < 200 THEN 'true, \"reason\": {{\"name\": \"0-DocumentLengthFilter\", \"p\": 1.0, \"skip_rejected\": true, \"use_batch\": false, \"batch_size\": 128, \"min_doc_len\": 200, \"max_doc_len\": null}}' ELSE 'false, \"reason\": {{}}' END || '}}'")
texts("json_roundtrip", lambda: [ops.JSONDumper(), ops.JSONLoader()], "text")
texts("merge_tokens", lambda: [ops.SentenceTokenizer(), ops.MergeTokens()], "text", JA)
texts("blank_merged", lambda: [ops.BlankCharTokenizer(), ops.TokenAddTag(), ops.MergeTokens()], r"array_to_string(list_transform(list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x{85}\pZ]+'), lambda x: x <> ''), lambda x: x || '<sep>'), '')")
texts("seo_tokens", lambda: [ops.SentenceTokenizer(), ops.SEOTokenRemover(), ops.MergeTokens()],
      f"array_to_string(list_transform(regexp_extract_all(text, '[^。]*。|[^。]+'), lambda x: CASE WHEN length(x) / len(regexp_split_to_array(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '[ \\-・,]')) <= 5 THEN x ELSE regexp_replace(x, {quoted(seo_pattern())}, '') END), '')",
      "concat('★…━★longwords。', text, '★……★')")


@query("clean_basic", f"SELECT doc_id, '{{\"text\": ' || CAST(to_json(t) AS VARCHAR) || '}}' AS text FROM (SELECT doc_id, text, {MASKED} AS t FROM documents WHERE length(text) BETWEEN 50 AND 20000) WHERE {SHORT.replace('text', 't')} <= 0.5")
def clean_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.Pipeline([ops.DocumentNormalizer(), ops.DocumentLengthFilter(50, 20000), ops.MaskPersonalInformation(), ops.DiscardTooShortLines(), ops.JSONDumper(skip_rejected=True)]).survivors(documents(spark, sf_dir))


def _sentence_sql(select: str) -> str:
    return f"SELECT doc_id, {select} FROM (SELECT doc_id, CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '[^。]*。|[^。]+') END AS s FROM (SELECT doc_id, {JA} AS text FROM documents))"


@query("sentence_tokens", _sentence_sql("CAST(len(s) AS INTEGER) AS n, array_to_string(s, '|') AS tokens"))
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.Pipeline([ops.SentenceTokenizer()]).transform(documents(spark, sf_dir, JA))
    return out.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens.text", "|").alias("tokens"))


@query("blank_tokens", r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t-\r\x1c-\x20\x{85}\pZ]+'), lambda x: x <> '') AS t FROM documents)")
def blank_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.Pipeline([ops.BlankCharTokenizer()]).transform(documents(spark, sf_dir))
    return out.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens.text", "|").alias("tokens"))


_HIT = f"regexp_matches({{}}, '^(?:{_alternatives(HEADS)})')"


@query("header_footer", f"""
SELECT doc_id, array_to_string(list_transform(generate_series(1, len(s)), lambda i: CASE WHEN i <= CASE WHEN len(s) < 4 THEN 1 WHEN len(s) < 6 THEN 2 ELSE 3 END
    AND ({_HIT.format("s[i]")} OR {_HIT.format("s[len(s) + 1 - i]")}) THEN '1' ELSE '0' END), '') AS rejected
FROM ({_sentence_sql("s")})""")  # fmt: skip
def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.Pipeline([ops.SentenceTokenizer(), ops.HeaderFooterTagsRemover(words=HEADS)]).transform(documents(spark, sf_dir, JA))
    return out.select("doc_id", F.array_join(F.transform("tokens.is_rejected", lambda x: x.cast("int").cast("string")), "").alias("rejected"))


@query("json_load", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS text, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS extras FROM events")
def json_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("text"))
    out = ops.Pipeline([ops.JSONLoader("k", extra_keys=["k"])]).transform(events)
    return out.select("event_id", "text", F.concat(F.lit('{"k":'), F.element_at("extras", "k"), F.lit("}")).alias("extras"))


def _stats_stages() -> list[ops.Stage]:
    return [ops.DocumentLengthFilter(200, 5000), ops.MaskPersonalInformation(), ops.DiscardTooShortLines(), ops.AppendTag("<tag>")]


_LAYERS = (("0-DocumentLengthFilter", "b0", "c0", "false", "b0", "c0", "r0"), ("1-MaskPersonalInformation", "b0", "c0", "r0", "b1", "c1", "r0"), ("2-DiscardTooShortLines", "b1", "c1", "r0", "b1", "c1", "r1"), ("3-AppendTag", "b1", "c1", "r1", "b2", "c2", "r1"), ("Total", "b0", "c0", "false", "b2", "c2", "r1"))


def _stats_sql() -> str:
    def layer(name: str, b0: str, c0: str, before: str, b1: str, c1: str, after: str) -> str:
        gone = f"(NOT {before} AND {after})"
        s = lambda e: f"CAST(coalesce(sum({e}), 0) AS BIGINT)"
        out = [f"'{name}' AS name", "count(*) AS input_num", f"{s(b0)} AS input_bytes", f"{s(c0)} AS input_chars"]
        out += [f"{s(f'CASE WHEN {gone} THEN 0 ELSE {x} END')} AS output_{n}" for n, x in (("num", "1"), ("bytes", b1), ("chars", c1))]
        out += [f"{s(f'CASE WHEN {gone} THEN 1 ELSE 0 END')} AS discard_num"]
        out += [f"{s(f'CASE WHEN {gone} THEN -{x} ELSE {y} - {x} END')} AS diff_{n}" for n, x, y in (("bytes", b0, b1), ("chars", c0, c1))]
        return f"SELECT {', '.join(out)}, CAST(0 AS BIGINT) AS errors FROM p"

    return f"""
    WITH a AS (SELECT text, length(text) < 200 OR length(text) > 5000 AS r0 FROM documents),
    b AS (SELECT text, r0, CASE WHEN r0 THEN text ELSE {MASKED} END AS t FROM a),
    c AS (SELECT *, r0 OR {SHORT.replace("text", "t")} > 0.5 AS r1 FROM b),
    p AS (SELECT *, strlen(text) AS b0, length(text) AS c0, strlen(t) AS b1, length(t) AS c1, strlen(t) + CASE WHEN r1 THEN 0 ELSE 5 END AS b2, length(t) + CASE WHEN r1 THEN 0 ELSE 5 END AS c2 FROM c)
    {" UNION ALL ".join(layer(*x) for x in _LAYERS)}"""


@query("pipeline_stats", _stats_sql())
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.Pipeline(_stats_stages()).statistics(documents(spark, sf_dir))


@query("stats_merge", f"SELECT name, {', '.join(f'CAST(2 * {c} AS BIGINT) AS {c}' for c in COUNTERS)} FROM ({_stats_sql()})")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge(pipeline_stats(spark, sf_dir), pipeline_stats(spark, sf_dir))


@query("reject_reasons", f"SELECT doc_id, CASE WHEN length(text) < 200 OR length(text) > 5000 THEN '\"0-DocumentLengthFilter\"' WHEN {SHORT} > 0.5 THEN '\"1-DiscardTooShortLines\"' END AS name, CASE WHEN length(text) < 200 OR length(text) > 5000 THEN '200' END AS min_doc_len FROM documents")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.Pipeline([ops.DocumentLengthFilter(200, 5000), ops.DiscardTooShortLines()]).transform(documents(spark, sf_dir))
    return out.select("doc_id", F.element_at("reject_reason", "name").alias("name"), F.element_at("reject_reason", "min_doc_len").alias("min_doc_len"))


@query("matched_words", f"SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(_alternatives(NG_JA))}) THEN '\"' || regexp_extract(text, {quoted(_alternatives(NG_JA))}) || '\"' END AS word FROM (SELECT doc_id, {JA} AS text FROM documents)")
def matched_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.Pipeline([ops.NgWordsFilterJa(words=NG_JA)]).transform(documents(spark, sf_dir, JA))
    return out.select("doc_id", F.element_at("reject_reason", "matched_text").alias("word"))


# near duplicates: few permutations, so that SQL can follow
NUM_PERM, NEAR, N_GRAMS, SEED = 10, 0.5, 3, 42


def _lsh() -> ops.GenerateDedupLSH:
    return ops.GenerateDedupLSH(NUM_PERM, NEAR, dedup.non_alpha_num_splitter, N_GRAMS, SEED)


def _keys_sql() -> str:
    a, b = dedup.permutations(NUM_PERM, SEED)
    bands, rows = dedup.band_parameters(NEAR, NUM_PERM)
    perms = ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(zip(a, b)))
    return f"""
    perms(k, a, b) AS (VALUES {perms}),
    w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_0-9]+') AS w FROM documents),
    h AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(array_to_string(list_slice(w, i, i + {N_GRAMS - 1}), ' ')), 1, 8) AS BIGINT) AS h
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {N_GRAMS - 1})) AS i FROM w WHERE len(w) >= {N_GRAMS})),
    m AS (SELECT doc_id, k, min((CAST(a AS BIGINT) * h + b) % {dedup.PRIME}) AS v FROM h, perms GROUP BY doc_id, k),
    s AS (SELECT d.doc_id, p.k, coalesce(v, {dedup.PRIME}) AS v FROM (SELECT DISTINCT doc_id FROM documents) d CROSS JOIN perms p LEFT JOIN m ON m.doc_id = d.doc_id AND m.k = p.k WHERE p.k < {bands * rows}),
    keys AS (SELECT doc_id, k // {rows} AS pos, CAST(k // {rows} AS VARCHAR) || '+' || md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS key FROM s GROUP BY doc_id, k // {rows}),
    owners AS (SELECT key, min(doc_id) AS first FROM keys GROUP BY key),
    hits AS (SELECT doc_id, arg_max(first, pos) AS owner FROM keys JOIN owners USING (key) WHERE first < doc_id GROUP BY doc_id)"""


@query("minhash_keys", f"WITH {_keys_sql()} SELECT doc_id, '[' || string_agg('\"' || key || '\"', ', ' ORDER BY pos) || ']' AS keys FROM keys GROUP BY doc_id")
def minhash_keys(spark: SparkSession, sf_dir: str, lsh: Callable[[], ops.Stage] = _lsh) -> DataFrame:
    return ops.Pipeline([lsh()]).transform(documents(spark, sf_dir)).select("doc_id", F.element_at("extras", dedup.KEY).alias("keys"))


_DEDUP_SQL = f"WITH {_keys_sql()} SELECT doc_id, owner IS NOT NULL AS is_rejected FROM documents LEFT JOIN hits USING (doc_id)"


@query("dedup_inline", _DEDUP_SQL)
def dedup_inline(spark: SparkSession, sf_dir: str, lsh: Callable[[], ops.Stage] = _lsh) -> DataFrame:
    return ops.Pipeline([lsh(), ops.InlineDeduplicator()]).transform(documents(spark, sf_dir)).select("doc_id", "is_rejected")


@query("dedup_analyze", f"WITH {_keys_sql()} SELECT d.doc_id, owner IS NOT NULL AS is_rejected, CASE WHEN owner IS NOT NULL THEN CAST(to_json(o.text) AS VARCHAR) END AS similar_doc FROM documents d LEFT JOIN hits USING (doc_id) LEFT JOIN documents o ON o.doc_id = owner")
def dedup_analyze(spark: SparkSession, sf_dir: str, lsh: Callable[[], ops.Stage] = _lsh) -> DataFrame:
    out = ops.Pipeline([lsh(), ops.InlineDuplicateAnalyzer()]).transform(documents(spark, sf_dir))
    return out.select("doc_id", "is_rejected", F.element_at("extras", "similar_doc").alias("similar_doc"))


def _two_runs(spark: SparkSession, sf_dir: str, make: Callable[[str], ops.Stage], lsh: Callable[[], ops.Stage] = _lsh) -> DataFrame:
    """All documents against an empty state, then all again: the second run rejects every one."""
    from corpusflow.sources.storage import shared_dir, written
    import uuid

    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    keyed = written(ops.Pipeline([lsh()]).transform(documents(spark, sf_dir)).select("doc_id", "text", "extras"), "keyed")  # the keys of both runs
    runs = [ops.Pipeline([make(path)]).transform(keyed).select("doc_id", F.lit(k).alias("run"), "is_rejected") for k in (1, 2)]
    return runs[0].union(runs[1])


_TWO_SQL = f"WITH {_keys_sql()}, one AS (SELECT doc_id, owner IS NOT NULL AS is_rejected FROM documents LEFT JOIN hits USING (doc_id)) SELECT doc_id, CAST(1 AS INTEGER) AS run, is_rejected FROM one UNION ALL SELECT doc_id, CAST(2 AS INTEGER) AS run, true FROM one"


@query("dedup_incremental", _TWO_SQL)
def dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir, ops.KeyTableDeduplicator)


@query("dedup_bloom", _TWO_SQL)
def dedup_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir, lambda path: ops.BloomDeduplicator(path, 1_000_000_000))


# near duplicates with the operator's own splitter and number of permutations; of pairs at FULL_NEAR the bands catch 0.95
FULL_PERM, FULL_BANDS, FULL_NEAR = 500, 0.7, 0.8


def _full_lsh() -> ops.GenerateDedupLSH:
    return ops.GenerateDedupLSH(FULL_PERM, FULL_BANDS)


@query("minhash_keys_full")
def minhash_keys_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_keys(spark, sf_dir, _full_lsh)


@query("dedup_inline_full")
def dedup_inline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_inline(spark, sf_dir, _full_lsh)


@query("dedup_analyze_full")
def dedup_analyze_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_analyze(spark, sf_dir, _full_lsh)


@query("dedup_incremental_full")
def dedup_incremental_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_runs(spark, sf_dir, ops.KeyTableDeduplicator, _full_lsh)


@query("dedup_bloom_full")
def dedup_bloom_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands, _ = dedup.band_parameters(FULL_BANDS, FULL_PERM)
    return _two_runs(spark, sf_dir, lambda path: ops.BloomDeduplicator(path, 1_000_000_000, num_bands=bands), _full_lsh)


@query("user_filter", "SELECT doc_id, text || chr(33) || length(text) AS text FROM documents WHERE length(text) < 1000")
def user_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage written in Python by a user."""

    class AddLength(ops.Filter):
        def apply(self, document):
            document.text += f"!{len(document.text)}"
            return document

    return ops.Pipeline([ops.DocumentLengthFilter(max_doc_len=999), AddLength()]).survivors(documents(spark, sf_dir))


@query("user_batch", "SELECT doc_id, text || '!' || length(text) AS text FROM documents WHERE length(text) < 1000")
def user_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like user_filter, by lists of documents."""

    class AddLengths(ops.Filter):
        def apply_batch(self, batch):
            for d, n in zip(batch, [len(d.text) for d in batch]):
                d.text += f"!{n}"
            return batch

    return ops.Pipeline([ops.DocumentLengthFilter(max_doc_len=999), AddLengths(use_batch=True, batch_size=64)]).survivors(documents(spark, sf_dir))


@query("user_skip", "SELECT doc_id, length(text) > 999 AS is_rejected, CASE WHEN length(text) > 999 THEN '\"0-DocumentLengthFilter\"' END AS name FROM documents")
def user_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage in Python that fails on what an earlier stage has rejected: it never gets to see that."""

    class OnlyShort(ops.Filter):
        def apply(self, document):
            if len(document.text) > 999:
                raise ValueError("a rejected document")
            return document

    out = ops.Pipeline([ops.DocumentLengthFilter(max_doc_len=999), OnlyShort()]).transform(documents(spark, sf_dir))
    return out.select("doc_id", "is_rejected", F.element_at("reject_reason", "name").alias("name"))
