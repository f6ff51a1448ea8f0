"""WARC, chat formatting, packing and the pipeline: round trips, exact ids, edge cases."""

import hashlib
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as C
from bourse.llm import chat, packing, plans, tokens, warc
from bourse.session import checkpoint_dir, scratch_path
from tests.llm.conftest import SF


def block(texts):
    enc = [t.encode() for t in texts]
    return np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in enc])]).astype(np.int64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("<\\|im_end>\né日 a"), max_size=20), min_size=1, max_size=5))
def test_escape_round_trip(texts):
    data, off = chat.escape(*block(texts))
    out = [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)]
    assert all("<|" not in x for x in out) and [chat.unescape(x) for x in out] == texts
    assert [chat.unescape_role(chat.escape_role(x)) for x in texts] == texts
    assert all("\n" not in chat.escape_role(x) for x in texts)


def test_chat_digests_odd(spark):
    ctl = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", ctl), (1, 2, "assistant", None), (2, 0, None, "x\\<\\|y"),
            (None, 0, "assistant", "lost"), (3, None, "a\\n\nb<|", "é" * 70000), (1, 1, "assistant", ctl)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(mine), len(loss))
        assert g.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversation_digests(chat.format_turns(df.limit(0))).count() == 0


def test_assemble_is_concatenation():
    a, b = block(["x", "", "yz"]), block(["", "12", "3"])
    out, off, starts = chat.assemble([a, chat.constant(b"-", 3), b])
    assert [out[p:q].tobytes() for p, q in zip(off[:-1], off[1:], strict=True)] == [b"x-", b"-12", b"yz-3"]
    assert starts.tolist() == [[0, 2, 5], [1, 2, 7], [2, 3, 8]]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200), st.integers(4, 50))
def test_chunked_round_trip(text, size):
    data = text.encode()
    assert warc.unchunk(warc.chunked(data, size)) == data
    assert all(len(p) <= size and p.decode() for p in warc.pieces(data, size))
    for cut in range(len(warc.chunked(data, size)) - 3):
        assert warc.unchunk(warc.chunked(data, size)[:cut]) is None


def test_warc_round_trip_odd(spark):
    rows = [(5, "http://a/é x", "same"), (2, None, "same"), (2, None, "same"), (7, "u", None), (8, "u", ""), (None, "n", "same"),
            (9, "w", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n" * 4000), (10, "l", "é" * 50000), (11, "b", "0\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, row_id string").repartition(2)
    path = scratch_path(spark, "t-warc")
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    warc.write_archives(pages, path, segment_bytes=1000, chunk_bytes=300, records_per_file=3)
    assert warc.read_records(spark, path).where("kind = 'continuation'").count() > 100
    got = warc.read_pages(spark, path).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    for page, _, html in rows:
        for r in (r for r in got if r.page_id == page and r.record_type == "response"):
            assert r.payload.decode() in [(x[2] or "") for x in rows if x[0] == page]
        want = warc.digest((html or "").encode())
        assert any(r.page_id == page and r.payload_digest == want and r.payload_bytes == len((html or "").encode()) for r in got)
    same = [r for r in got if r.payload_digest == warc.digest(b"same")]
    assert [r.page_id for r in same if r.record_type == "response"] == [2]
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {2}
    assert {r.page_id for r in got if r.refers_to == 7} == {8}
    assert {r.target for r in got if r.page_id == 5} == {"http://a/é x"}


def test_broken_segments_are_told(spark):
    path = scratch_path(spark, "t-broken")
    big = "x" * 5000
    warc.write_archives(spark.createDataFrame([(1, "u", big), (2, "u", big + "y")], "page_id long, url string, html string"),
                        path, segment_bytes=1000)
    records = warc.read_records(spark, path).where("NOT (record_id LIKE 'urn:x-page:1:%' AND segment = 3)")
    got = {r.record_id.split(":")[2]: r.complete for r in warc.reassemble(records).collect()}
    assert got == {"1": False, "2": True}


def test_warc_empty(spark):
    path = scratch_path(spark, "t-none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_pages(spark, path).count() == 0


def test_runs_that_a_task_has_met_are_not_encoded_again():
    """150,000 different runs twice: each goes to the tokenizer once, and the ids stay the same."""
    tok, given_ = tokens.RunTokenizer(tokens.default_tokenizer()), []
    add = tok._add
    tok._add = lambda hashes, runs: (given_.extend(runs), add(hashes, runs))[1]
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:06d}") for i in range(150_000)]
    parts = [" ".join(names[a:a + 30_000]).encode() for a in range(0, len(names), 30_000)] * 2
    ids = [tok.block(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in parts]
    assert len(given_) == len(set(given_)) == len(names)
    assert all((a == b).all() for a, b in zip(ids[:5], ids[5:], strict=True))
    assert ids[3].tolist() == tok.whole.encode(parts[3].decode(), add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    return Tokenizer.from_file(path), tokens.RunTokenizer(path)


def test_every_covered_character(tok):
    whole, run = tok
    texts = [x for c in range(1, 0x300) for x in (chr(c), f"a{chr(c)}b{chr(c)}{chr(c)}C 1{chr(c)}'s")]
    texts += ["", "It's we're ''s 'tis", "<|endoftext|> x", "日本語 é", " 12 3a4 "]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in run.block(*block(texts))] == want
    assert [run.block(*block([t]))[0].tolist() for t in texts] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_ids_of_any_text(tok, texts):
    whole, run = tok
    assert [x.tolist() for x in run.block(*block(texts))] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def check_packing(docs, got, tok, capacity):
    whole = tok[0]
    want = []
    for r in docs.collect():
        ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(r.doc_id), k // capacity, k, len(ids[k:k + capacity]), zlib.crc32(ids[k:k + capacity].tobytes()))
                 for k in range(0, len(ids), capacity)]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, tok, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, bound = check_packing(docs, packing.pack_documents(docs), tok, 4096)
    assert n <= bound + 1
    check_packing(odd_docs, packing.pack_documents(odd_docs), tok, 4096)
    n, bound = check_packing(docs, packing.pack_documents(docs, capacity=512, shard_items=30, shard_bins=4, merge_shards=3),
                             tok, 512)
    assert n <= 1.05 * bound
    assert packing.pack_documents(no_docs).count() == 0
    ids = packing.pack_documents(odd_docs, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in ids)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_evolution_keeps_every_item(lengths):
    assign, bins = packing.evolve(lengths, [], 100, 1)
    fill = np.bincount(assign, weights=lengths)
    assert len(assign) == len(lengths) and len(fill) == bins and fill.max() <= 100
    again, better = packing.evolve(lengths, [assign, list(range(len(lengths)))], 100, 2)
    assert better <= bins and np.bincount(again, weights=lengths).max() <= 100


def test_pipeline_stages(spark, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, SF)
        path = f"{checkpoint_dir(spark)}/t-{name}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        if k < len(C.STAGES) - 1:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = spark.read.parquet(path)
    assert out.select("doc_id").distinct().count() == docs.count()
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, odd_docs, SF).columns == odd_docs.columns


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in plans.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in plans.QUERIES
