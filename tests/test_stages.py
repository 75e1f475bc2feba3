"""Stages on small vectors, pipelines' counting, and the SQL of each registered query."""

import asyncio
import hashlib
import json
from types import SimpleNamespace

import duckdb
import pytest

import corpusflow.queries as queries
from corpusflow import operators as ops
from corpusflow.functions.document import Document
from corpusflow.operators import dedup
from corpusflow.operators.asynchronous import check_api_alive
from corpusflow.plans.profile import load_profile
from corpusflow.plans.stats import Statistics, legacy_report
from corpusflow.sources.lines import split_lines
from corpusflow.streaming.streams import start, start_batches

SF = "/root/testdata/sf0.001"


def run(spark, stages, texts, **kwargs):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return ops.Pipeline(stages, **kwargs).transform(docs).orderBy("doc_id").collect()


VECTORS = [
    (lambda: ops.DocumentLengthFilter(2, 4), [("a", True), ("ab", False), ("abcd", False), ("abcde", True), ("👍👍", False)]),
    (lambda: ops.DiscardContainingKeyword(""), [("x", True)]),
    (lambda: ops.AcceptJapanese(3), [("abcあ", True), ("abあ", False), ("漢字ー", True)]),
    (lambda: ops.DiscardRareKuten(4), [("", False), ("あああ。", False), ("あああああああ。", True)]),
    (lambda: ops.NgWordsFilterJa(words=["カジノ", "賭け"], ignore_confused=True), [("カジノで", False) if False else ("カジノで", True), ("オカジノ", False), ("賭けカジノバー", True), ("ほうじ茶", False)]),
    (lambda: ops.NgWordsFilterEn(words=["bad", "two words"]), [("a BAD, one", True), ("bad", True), ("badly", False), ("x\nbad y", False), ("so bad\n", True), ("has two words.", True), ("bad!", False)]),
    (lambda: ops.SingleCharacterRepetitionFilter(3), [("aab", False), ("abbb", True), ("👍👍👍", True), ("a\n\n\n", True)]),
    (lambda: ops.DiscardTooManyEndingEllipsis(0.5), [("a...\nb…\n", True), ("a...\nb\n", False), ("a…", False)]),
    (lambda: ops.DiscardTooShortLines(0.5), [("short\nshort\nthis line is long enough", True), ("short\nthis line is long enough", False), ("", True)]),
    (lambda: ops.DiscardTooManySpecialToken(0.4), [("!!!ab", True), ("!!abc", False), ("", False), ("👍👍a", True)]),
    (lambda: ops.CharRepetitionRatioFilter(0.33, 5), [("abc", False), ("ababababababababab", True), ("the quick brown fox jumps over a dog", False)]),
    (lambda: ops.DiscardBBSComments(2), [("a-b-c", False), ("a-b-c-d", True), ("投稿 1話 質問", True)]),
    (lambda: ops.DiscardAll(p=0.0), [("x", False)]),
]


@pytest.mark.parametrize("k", range(len(VECTORS)))
def test_vectors(spark, k):
    make, cases = VECTORS[k]
    got = run(spark, [make()], [t for t, _ in cases] + [None])
    assert [r["is_rejected"] for r in got] == [bad for _, bad in cases] + [False]


def test_rewrites(spark):
    cases = ["ＡＢＣ１", "tel 06-1234-5678 or 090-1234-5678", "mail to a.b@c.example.co.jp now", "plain"]
    got = [r["text"] for r in run(spark, [ops.DocumentNormalizer(), ops.MaskPersonalInformation()], cases)]
    assert got == ["ABC1", "tel 06-1234-XXXX or 090-1234-XXXX", "mail to xxxx@yyy.jp now", "plain"]


def test_json(spark):
    lines = ['{"text": "a\\u001f", "extras": {"x": {"y": [1]}}, "url": "u"}', '{"text": 1.0}', "{", '{"text": null} x']
    got = run(spark, [ops.JSONLoader(ignore=True, extra_keys=["url"]), ops.JSONDumper(dump_reason=False, export_extras=True)], lines)
    assert got[0]["text"] == json.dumps({"text": "a\x1f", "extras": {"x": {"y": [1]}, "url": "u"}}, ensure_ascii=False)
    assert json.loads(got[1]["text"])["text"] == "1.0"
    assert [r["is_rejected"] for r in got] == [False, False, True, True]
    with pytest.raises(Exception, match="JSONDecodeError"):
        run(spark, [ops.JSONLoader()], ["{"])
    failed = run(spark, [ops.JSONLoader()], ["{"], on_error="reject")[0]
    assert failed["is_rejected"] and "JSONDecodeError" in failed["reject_reason"]["error"]


def test_tokens(spark):
    got = run(spark, [ops.SentenceTokenizer(), ops.HeaderFooterTagsRemover(words=["head"]), ops.TokenAddTag(), ops.MergeTokens()], ["head。b。c。d", "", "a。b。c。head"])
    assert [r["text"] for r in got] == ["b。<sep>c。<sep>d<sep>", "<sep>", "b。<sep>c。<sep>head<sep>"]

    class Short(ops.TokenFilter):
        def apply_token(self, token):
            token.is_rejected = len(token.text) < 3
            return token

    assert run(spark, [ops.BlankCharTokenizer(), Short(), ops.MergeTokens()], ["a bcd　ef ghi"])[0]["text"] == "bcdghi"


def test_counting(spark):
    stages = [ops.Identity(), ops.DiscardAll(), ops.AppendTag("<tag>"), ops.ApplyDiscard(skip_rejected=False)]
    docs = spark.createDataFrame([(1, "aé")], "doc_id bigint, text string")
    total, same, gone, tag, emptied = ops.Pipeline(stages).get_statistics(docs)
    assert (same.diff_bytes, gone.diff_bytes, gone.discard_num, tag.diff_bytes, tag.output_num) == (0, -3, 1, 0, 1)
    assert (total.input_num, total.discard_num, total.output_num, total.diff_chars) == (1, 1, 0, -2)
    assert Statistics.add(gone, gone).discard_num == 2
    with pytest.raises(ValueError):
        Statistics.add_list_of_stats([gone], [tag])
    assert legacy_report([total, gone])["total_info"]["processed_num"] == 1
    assert ops.Pipeline([ops.Pipeline([ops.Identity()]), ops.AppendTag("x")])("a") == "ax"
    assert ops.Pipeline([ops.DiscardAll()])("a") == ""


def test_sampling(spark):
    got = run(spark, [ops.DiscardAll(p=0.3)], ["t"] * 3000, random_state=1)
    assert 750 < sum(r["is_rejected"] for r in got) < 1050
    assert got == run(spark, [ops.DiscardAll(p=0.3)], ["t"] * 3000, random_state=1)


def test_first_seen_wins_as_one_by_one(spark):
    import random

    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefg ") for _ in range(200)) for _ in range(12)]
    texts = [t if rng.random() < 0.3 else t[:-5] + "".join(rng.choice("xyz") for _ in range(5)) for t in base for _ in range(4)]
    lsh = ops.GenerateDedupLSH(50, 0.8)
    seen, owner, want = set(), {}, []
    for t in texts:
        keys = lsh.keys(t)
        hit = [k for k in keys if k in seen]
        want.append((bool(hit), json.dumps(owner[hit[-1]]) if hit else None))
        for k in keys:
            seen.add(k)
            owner.setdefault(k, t)
    got = run(spark, [lsh, ops.InlineDuplicateAnalyzer()], texts)
    assert [(r["is_rejected"], r["extras"].get("similar_doc")) for r in got] == want
    assert [dedup.band_parameters(t, n) for t, n in ((0.5, 10), (0.5, 50), (0.8, 50), (0.8, 500))] == [(3, 3), (12, 4), (5, 10), (27, 18)]
    with pytest.raises(Exception, match="GenerateDedupLSH"):
        run(spark, [ops.InlineDeduplicator()], ["a"])


def test_full_queries_against_brute_force_jaccard(spark, tmp_path):
    import random

    rng = random.Random(6)
    texts = []
    for _ in range(60):
        base = "".join(rng.choice("abcdefghij ") for _ in range(400))
        texts += [base, "".join(rng.choice("xyz") if rng.random() < 0.015 else c for c in base)]
    grams = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    near = {k for k in range(1, len(texts), 2) if queries.FULL_NEAR <= jaccard(grams[k - 1], grams[k])}
    far = {k for k in range(len(texts)) if all(jaccard(grams[k], g) < 0.3 for g in grams[:k])}
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(near) >= 30 and len(far) >= 60
    for name in ("dedup_inline_full", "dedup_analyze_full", "dedup_incremental_full", "dedup_bloom_full"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        gone = {r["doc_id"] for r in rows if r["is_rejected"] and ("run" not in r or r["run"] == 1)}
        assert len(gone & near) >= 0.9 * len(near) and not gone & far
        assert all(r["is_rejected"] for r in rows if "run" in r and r["run"] == 2)
    keys = queries.QUERIES["minhash_keys_full"](spark, str(tmp_path)).collect()
    assert {len(json.loads(r["keys"])) for r in keys} == {41}


def test_chat(spark):
    class Client:
        def __init__(self, *_):
            self.calls = 0
            self.chat = SimpleNamespace(completions=self)

        async def create(self, model, messages, **_):
            self.calls += 1
            await asyncio.sleep(0)
            if messages[0]["content"] == "flaky" and self.calls % 2:
                raise OSError("busy")
            choices = [] if messages[0]["content"] == "mute" else [SimpleNamespace(message=SimpleNamespace(content=messages[0]["content"].upper()))]
            return SimpleNamespace(choices=choices)

    got = run(spark, [ops.AsyncChatAPI("m", client=Client, max_wait=0.01)], ["hello", "flaky", "mute"], on_error="reject")
    assert [r["extras"].get("llm_output") for r in got] == ['"HELLO"', '"FLAKY"', None]
    assert [r["is_rejected"] for r in got] == [False, False, True]
    check_api_alive("u", "m", lambda _: {"data": [{"id": "m"}]})
    with pytest.raises(ValueError):
        check_api_alive("u", "n", lambda _: {"data": [{"id": "m"}]})


def test_profile_and_command_line(spark, tmp_path, capsys):
    from corpusflow.cli import main

    profile = tmp_path / "cleaner_profile.py"
    profile.write_text("from corpusflow.operators import *\nFACTORY = lambda tag='<t>': Pipeline([JSONLoader(), AppendTag(tag), JSONDumper()])\n")
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"text": f"text-{k}"}) + "\n" for k in range(1, 101)) + "broken\n")
    assert main(["-p", str(profile), "-i", str(tmp_path / "in.jsonl"), "-o", str(tmp_path / "out"), "--args", "<x>", "--dump-stats", str(tmp_path / "stats")]) == 0
    assert (tmp_path / "out").read_text() == "".join(json.dumps({"text": f"text-{k}<x>"}) + "\n" for k in range(1, 101))
    assert json.loads((tmp_path / "stats").read_text())["total_info"]["processed_num"] == 101
    bad = tmp_path / "bad_profile.py"
    bad.write_text("FILTER = 1\n")
    with pytest.raises(TypeError):
        load_profile(bad)
    bad.write_text("")
    with pytest.raises(NotImplementedError):
        load_profile(bad)
    assert split_lines(b"a\r\nb\rc\xff\n") == ["a", "b", "c�"]


def test_batches_in_python(spark):
    class Batched(ops.Filter):
        def apply_batch(self, batch):
            if len(batch) > 1 and any("bad" in d.text for d in batch):
                raise ValueError("the batch")
            if "bad" in batch[0].text:
                raise ValueError("the document")
            for d in batch:
                d.extras["size"] = len(batch)
            return batch

    texts = [f"text {k}" for k in range(20)] + ["x" * 60, "bad one"]
    stages = [ops.DocumentLengthFilter(max_doc_len=50), Batched(use_batch=True, batch_size=4)]
    got = run(spark, stages, texts, on_error="reject")
    sizes = [r["extras"].get("size") for r in got]
    assert max(int(n) for n in sizes if n) > 1 and all(int(n) <= 4 for n in sizes if n)
    assert sizes[20] is None and [r["is_rejected"] for r in got] == [False] * 20 + [True, True]
    assert "the document" in got[21]["reject_reason"]["error"]
    stats = ops.Pipeline(stages, on_error="reject").get_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert stats[2].cumulative_time_ns > 0 and stats[2].errors == 1


def test_a_stage_is_computed_once(spark):
    plan = queries.QUERIES["clean_basic"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 2


def test_streams(spark, tmp_path):
    for part in (0, 1):
        spark.createDataFrame([(k + 10 * part, f"text number {k} of the stream") for k in range(3)], "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = lambda: spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    start(ops.Pipeline([ops.AppendTag("!")]), stream(), f"{tmp_path}/a", f"{tmp_path}/ca").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/a").filter("text like '%!'").count() == 6
    once = ops.Pipeline([ops.GenerateDedupLSH(10, 0.5), ops.KeyTableDeduplicator(f"file://{tmp_path}/keys", batch="0")])
    start_batches(once, stream(), f"{tmp_path}/b", f"{tmp_path}/cb").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/b").count() <= 3


def test_streams_need_a_key_table(spark, tmp_path):
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path))
    for stage in (ops.InlineDeduplicator, ops.InlineDuplicateAnalyzer):
        with pytest.raises(ValueError, match="key table"):
            start_batches(ops.Pipeline([ops.GenerateDedupLSH(10, 0.5), stage()]), stream, f"{tmp_path}/b", f"{tmp_path}/c")


def one_by_one(text, tokens, n, perms, seed, bands, rows):
    """Band keys as their definition says, n-gram by n-gram."""
    a, b = dedup.permutations(perms, seed)
    hashes = {int.from_bytes(hashlib.md5(" ".join(g).encode("utf-8", "surrogatepass")).digest()[:4], "big") for g in zip(*(tokens(text)[k:] for k in range(n)))}
    sig = [min(((x * h + y) % dedup.PRIME for h in hashes), default=dedup.PRIME) for x, y in zip(a, b)]
    return [f"{k}+{hashlib.md5(','.join(map(str, sig[k * rows : (k + 1) * rows])).encode()).hexdigest()}" for k in range(bands)]


@pytest.mark.parametrize("n", (1, 3, 5, 9))
@pytest.mark.parametrize("tokens", (list, dedup.non_alpha_num_splitter, str.split))
def test_keys_of_many(monkeypatch, tokens, n):
    """F2 to F10: keys of many texts at once, in chunks, are those of each; an n-gram that several texts have is hashed once."""
    plain = [f"the quick brown fox {k} jumps over the lazy dog" for k in range(8)] + ["", "a", "a b c d", "日本語のテキスト。" * 3, "👍👍👍👍👍👍é", "x" * 500, " \n\t "]
    if tokens is list:
        plain += ["a\ud800b c d e f", "".join(map(chr, range(256, 60_000, 97))), "".join(chr(0x10000 + 7 * k) for k in range(9_000))]
    lsh = ops.GenerateDedupLSH(20, 0.6, dedup.char_level_splitter if tokens is list else tokens, n)
    want = [one_by_one(t, tokens, n, 20, 42, lsh.num_bands, lsh.band_size) for t in plain]
    assert list(lsh.keys_of(plain)) == want == [lsh.keys(t) for t in plain]
    for size, rows in ((50, 3), (1_000, 1 << 10)):
        monkeypatch.setattr(dedup, "CHUNK", size)
        monkeypatch.setattr(dedup, "_ROWS", rows)
        assert list(lsh.keys_of(plain)) == want
    assert len(dedup._grams(["abcdef", "abcdef", "xabcde"], 5)[0]) == 3


def test_keys_are_made_once(spark):
    """F2 to F10: the texts are cut into tokens once, whatever reads the keys; the rows are those of the texts."""
    seen = spark.sparkContext.accumulator(0)

    def tokens(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([(k, f"one two three four five {k % 4}") for k in range(12)], "doc_id bigint, text string")
    tag = ops.AppendTag(" six")
    for stage, extras in ((ops.InlineDeduplicator(), 1), (ops.InlineDuplicateAnalyzer(), 2)):
        before = seen.value
        out = ops.Pipeline([tag, ops.GenerateDedupLSH(10, 0.5, tokens, 3), stage]).transform(docs).orderBy("doc_id").collect()
        assert seen.value - before == 12
        assert [r["is_rejected"] for r in out][4:] == [True] * 8 and out[0]["is_rejected"] is False
        assert out[5]["text"] == "one two three four five 1 six" and out[5]["original"] == "one two three four five 1" and len(out[5]["extras"]) == extras


def test_keys_are_made_once_for_two_runs(spark, tmp_path):
    """F3 to F6: both runs take the same keys."""
    seen = spark.sparkContext.accumulator(0)

    def tokens(text):
        seen.add(1)
        return text.split()

    rows = [(k, f"some words of document {k // 2}") for k in range(10)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for make in (ops.KeyTableDeduplicator, lambda path: ops.BloomDeduplicator(path, 1000)):
        before = seen.value
        out = {(r["doc_id"], r["run"]): r["is_rejected"] for r in queries._two_runs(spark, str(tmp_path), make, lambda: ops.GenerateDedupLSH(10, 0.5, tokens, 5)).collect()}
        assert seen.value - before == 10
        assert len(out) == 20 and all(out[k, 2] for k in range(10)) and [out[k, 1] for k in range(10)] == [False, True] * 5


def test_packed_keys(spark):
    """Keys are equal in half the bytes if and only if they are equal."""
    keys = ["0+" + "ab" * 16, "1+" + "ab" * 16, "10+" + "ab" * 16, "0+" + "AB" * 16, "0+" + "ab" * 16 + "\n", "00+" + "ab" * 16, "", "own", "\u0000" + "0" + "ab" * 8, "1+2"]
    out = [bytes(r["key"]) for r in dedup.packed(spark.createDataFrame([(k,) for k in keys], "key string")).collect()]
    assert len(set(out)) == len(keys) and len(out[0]) == 18


def test_one_document(spark):
    d = ops.DocumentLengthFilter(5).apply(Document("abc"))
    assert d.is_rejected and d.reject_reason["min_doc_len"] == 5 and d.original == "abc"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    form = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert form(got) == form(want)
