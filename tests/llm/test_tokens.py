import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm.common import staged_path
from gridloom.llm.packing import pack_by_mixture, round_robin
from gridloom.llm.queries import tokenizer_path
from gridloom.llm.token_files import read_metadata, read_tokens, token_digests, write_token_files
from gridloom.llm.tokens import ChunkEncoder

ODD = ["", "  ", "foo<|endoftext|>bar", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ İstanbul ǅ", "é x́ y z\x1cq w", "it's I'LL 12.3%% ²³ ½", "\r\n\x0b\x0c a\x85b", "straße ẞ Außü", "日本語 テスト🙂🙂", "a" * 100 + "é" * 60, "don't  'tis ''s", "x'", "'s", "'", "y'l", "'ll", "a'r", "'vex", "12'd3", "a×b", "'é", "d'été 're're's"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def ids(tok, text, end):
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_the_library(documents, plain):
    texts = ODD + [r["text"] for r in documents.collect()]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkEncoder(tokenizer_path()).encode(texts)] == want


def test_encoder_equals_the_library_on_random_texts(plain):
    rng = np.random.default_rng(4)
    letters = [*"abstrelvmd''''  \n\t01.,-éÀß", '"', "'s", "'re", "'ll", "×", "<|", "<", "|", "日", "\x1c", "\r"]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 40)))) for _ in range(5000)]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkEncoder(tokenizer_path()).encode(texts)] == want


def test_encoder_with_a_small_memory(documents, plain, monkeypatch):
    from gridloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 300)
    monkeypatch.setattr(tokens, "CACHE_IDS", 2000)
    encoder, texts = ChunkEncoder(tokenizer_path()), [r["text"] for r in documents.limit(60).collect()]
    for _ in range(2):
        for t in texts:
            assert encoder.encode([t])[0].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_a_file_that_cuts_otherwise_is_left_to_the_library(tmp_path):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"]["normalizers"][1]["content"] = "_"
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    want = [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(ODD, add_special_tokens=False)]
    assert not ChunkEncoder(str(path)).by_piece and [x.tolist() for x in ChunkEncoder(str(path)).encode(ODD)] == want


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(ODD, add_special_tokens=False)]
    assert [x.tolist() for x in ChunkEncoder(path).encode(ODD)] == want


def test_files_round_trip(spark, documents, plain):
    path = staged_path(spark, "t")
    write_token_files(documents, path, tokenizer_path())
    rows = sorted(token_digests(spark, path).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, d in zip(rows, sorted(documents.collect(), key=lambda r: r["doc_id"]), strict=True):
        x = ids(plain, d["text"], 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    meta = {r["doc_id"]: r["start"] for r in read_metadata(spark, path).collect()}
    assert meta == {r["doc_id"]: r["start"] for r in rows}
    one = read_tokens(spark, path, "doc_id = 5")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 1


def test_files_are_laid_out_as_set(spark, documents):
    import glob

    import pyarrow.parquet as pq

    path = staged_path(spark, "t")
    write_token_files(documents, path, tokenizer_path())
    f = pq.ParquetFile(sorted(glob.glob(path.removeprefix("file://") + "/*.parquet"))[0])
    columns = {f.metadata.row_group(0).column(k).path_in_schema: f.metadata.row_group(0).column(k) for k in range(f.metadata.num_columns)}
    tokens = next(v for k, v in columns.items() if k.startswith("tokens"))
    assert any("DICT" in e for e in tokens.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert tokens.compression == "ZSTD" and columns["doc_id"].has_column_index and tokens.has_offset_index


def test_files_of_odd_rows(spark, odd, none):
    path = staged_path(spark, "t")
    write_token_files(odd, path, tokenizer_path())
    rows = token_digests(spark, path).collect()
    assert len(rows) == odd.count() and sum(r["n_tokens"] == 1 for r in rows) == 4
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    path = staged_path(spark, "t")
    write_token_files(none, path, tokenizer_path())
    assert token_digests(spark, path).count() == 0


def test_round_robin_keeps_proportions():
    sizes = {"a": [300] * 60, "b": [500] * 12, "c": [1] * 3000}
    total = sum(map(sum, sizes.values()))
    share = {s: sum(x) / total for s, x in sizes.items()}
    taken, at = dict.fromkeys(sizes, 0), 0
    for s, _, _, n, pos in round_robin(sizes, share, {}, 0, 1000):
        assert pos == at
        taken[s] += n
        at += n
        assert all(abs(taken[k] - share[k] * at) <= 1501 for k in sizes)
    assert at == total


def packed(rows, docs, tok, window):
    """Every id lies in exactly one piece, and sequences have no gaps."""
    docs = sorted(((d["doc_id"] is None, d["doc_id"] or 0, d["text"] or "") for d in docs))
    assert sum(r["length"] for r in rows) == sum(len(ids(tok, t, 1)) for _, _, t in docs)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for k, spans in by_sequence.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == window or (k == max(by_sequence) and at <= window)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_documents(documents, plain, monkeypatch):
    from gridloom.llm import packing

    monkeypatch.setattr(packing, "SHARD_IDS", 12_000)
    monkeypatch.setattr(packing, "BLOCK_KEYS", 3)
    rows, docs = pack_by_mixture(documents, tokenizer_path()).collect(), documents.collect()
    packed(rows, docs, plain, 2048)
    text = {d["doc_id"]: ids(plain, d["text"], 1) for d in docs}
    ends = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        x = text[r["doc_id"]]
        assert r["start"] == ends.get(r["doc_id"], 0) and r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        ends[r["doc_id"]] = r["start"] + r["length"]
    assert ends == {k: len(x) for k, x in text.items()}
    # deficits carry over shards: at every place of the tape each source has had its share, but for what a shard's queues hold back
    total = sum(map(len, text.values()))
    whole, seen, at = {}, {}, 0
    for d in docs:
        whole[d["source"]] = whole.get(d["source"], 0) + len(text[d["doc_id"]])
    most = max(map(len, text.values()))
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        seen[r["source"]] = seen.get(r["source"], 0) + r["length"]
        at += r["length"]
        assert all(abs(seen.get(s, 0) - n / total * at) <= 12_000 + most for s, n in whole.items())
    assert seen == whole


def test_deficits_carry_over_shards(documents, monkeypatch):
    """Replayed over the whole tape, as if it were one queue run: a source that is owed nothing is served only where no
    source with ids left in the shard is owed anything."""
    from gridloom.llm import packing

    tables, staged = {}, packing.staged

    def kept(df, tag):
        tables[tag] = staged(df, tag)
        return tables[tag]

    monkeypatch.setattr(packing, "SHARD_IDS", 3_000)
    monkeypatch.setattr(packing, "staged", kept)
    rows = sorted(pack_by_mixture(documents, tokenizer_path()).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    counts = tables["pack-counts"].collect()
    left = {(r["shard"], r["source"]): r["n"] for r in counts}
    shards = sorted({r["shard"] for r in counts})
    assert len(shards) > 10
    whole = {}
    for (_, s), n in left.items():
        whole[s] = whole.get(s, 0) + n
    total, taken, at, k = sum(whole.values()), dict.fromkeys(whole, 0), 0, 0
    end = sum(left.get((shards[0], s), 0) for s in whole)
    for r in rows:
        if at == end:
            k += 1
            end += sum(left.get((shards[k], s), 0) for s in whole)
        earned = min((at // 2048 + 1) * 2048, end)
        owed = {s: n / total * earned - taken[s] for s, n in whole.items()}
        if owed[r["source"]] <= -1e-6:
            assert not [s for s in whole if owed[s] > 1e-6 and left.get((shards[k], s), 0)]
        taken[r["source"]] += r["length"]
        left[shards[k], r["source"]] -= r["length"]
        at += r["length"]
    assert at == total and k == len(shards) - 1 and not any(left.values())


def test_running_sums(spark):
    from gridloom.llm.packing import running

    rows = spark.createDataFrame([(k, s, k + 1) for k in range(10_000) for s in (None, "a")], "k long, s string, n long").repartition(3)
    got = {(r["k"], r["s"]): r["b"] for r in running(rows, "k", "n", "b", "s").collect()}
    assert got == {(k, s): k * (k + 1) // 2 for k in range(10_000) for s in (None, "a")}


def test_many_equal_rows_are_spread(spark, plain):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 20_000, "doc_id long, text string, source string").repartition(4)
    rows = pack_by_mixture(docs, tokenizer_path()).collect()
    packed(rows, docs.collect(), plain, 2048)
    path = staged_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_token_files(docs, path, tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = read_tokens(spark, path).groupBy("part").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) <= 10_000


def test_packing_odd_rows(odd, none, plain):
    rows = pack_by_mixture(odd, tokenizer_path(), window=64).collect()
    packed(rows, odd.collect(), plain, 64)
    assert pack_by_mixture(none, tokenizer_path()).count() == 0
