"""Token files, packing and the pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from scorelake.llm import packing, queries, token_files, toxicity
from scorelake.llm.tokens import encoder
from scorelake.session import scratch_path
from test_dedup import classes, fingerprint
from test_llm_text import contaminated

SMALL = "/root/testdata/sf0.001"
EDGES = [(7, None, "x"), (3, "", "x"), (5, "wort " * 40_000, "x"), (3, "Same id", "x"), (3, "Same id", "x"), (None, "no id", "x"), (9, "日本語 é  \x1f ok", "x")]


def le(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name, lower", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_remembered_pieces_change_no_id(spark, name, lower):
    rnd, codes = random.Random(5), encoder(name, lower)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    alphabet = "ab 'sSTtll\n\r\t 12²½ÀéßŒœŁ!?#   _-.İŉſ­\x1f<|endoftext|>"
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(0, 0x17F), rnd.randint(0x20, 0x7E), rnd.randint(0, 0x3000)])) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["hello <|endoftext|> world", "<|STARTOFTEXT|>", "a<|startoftext|><|endoftext|>", "日本<|endoftext|>"]
    fresh, plain = (Tokenizer.from_file(public_tokenizers.path(name)) for _ in range(2))  # as the library comes, and with the strings of special tokens as text
    plain.encode_special_tokens = True
    for text in texts:
        assert codes.ids(text) == le(fresh.encode(text, add_special_tokens=False).ids), ascii(text)
        assert encoder(name, lower, True).ids(text) == le(plain.encode(text, add_special_tokens=False).ids), ascii(text)


def expected_files(rows):
    whole, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(le(ids))))
        at += len(ids)
    return out


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(map(lambda r: tuple(r)[:4], queries.QUERIES["op5_token_files"](spark, SMALL).collect()))
    assert got == expected_files([(r.doc_id, r.text) for r in docs.collect()])
    edges = spark.createDataFrame(EDGES, "doc_id long, text string, start string").repartition(3)
    assert sorted(map(lambda r: tuple(r)[:4], token_files.token_documents(edges, length=8).collect()), key=lambda r: r[1]) == expected_files([r[:2] for r in EDGES])
    assert token_files.token_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_any_sequence_is_read_without_a_copy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    manifest = token_files.write_shards(docs, folder, length=16).collect()
    shard = max(manifest, key=lambda r: r.n_sequences)
    stream = np.concatenate(list(token_files._stretches(folder, shard.shard)))
    assert shard.n_sequences > 2 * token_files.BATCH and len(stream) == shard.n_tokens
    for number in (0, token_files.BATCH + 3, shard.n_sequences - 1):
        ids, mask = token_files.sequence(folder, shard.shard, number)
        assert len(ids) == 16 and np.array_equal(ids[mask], stream[number * 16:(number + 1) * 16]) and not ids.flags.owndata


def check_packing(rows, documents, length=packing.LENGTH):
    """Every id in one piece, gapless sequences, no padding but at powers of two."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for d, t in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length > 0 and r.ids_crc32 == zlib.crc32(le(part)) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for spans, full in [(sorted(v), len(ids[d])) for d, v in pieces.items()] + [(sorted(v), None) for v in sequences.values()]:
        at = 0
        for start, n in spans:
            assert start == at
            at += n
        assert at == full if full else at == length or at < length and at & (at - 1) == 0


def test_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_packing(queries.QUERIES["op10_packing"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    edges = [(1, None), (2, ""), (3, "wort " * 20_000), (4, "a b c"), (5, "é" * 700)] + [(10 + i, "same length of text " * 150) for i in range(30)]
    table = spark.createDataFrame([(*e, "s") for e in edges], "doc_id long, text string, offset string").repartition(3)
    check_packing(packing.pack(table, open_windows=4).collect(), edges)
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert sum(r.length for r in packing.pack(repeated).collect()) == 8
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sum_of_squares_choice():
    packer = packing.Packer(length=10)
    for doc, size in enumerate([6, 6, 4, 4, 3]):
        packer._place((doc, 0, size, bytes(4 * size)))
    # both sixes were filled by the fours, the three opened a window
    assert len(packer.rows) == 4 and packer.counts[3] == 1 and packer.open == 1
    for _ in range(5):
        packer._place((9, 0, 2, bytes(8)))
    assert (packer.counts**2).sum() <= 6


def stays(name, rows, spark):
    """doc_ids that a stage keeps of the rows (doc_id, text), by the operator's own brute force."""
    ids, texts = zip(*rows)
    if name == "toxicity":
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if not r.predicted}
    if name == "exact_dedup":
        first = {}
        for i, t in sorted(rows):
            first.setdefault(re.sub("[\x20\x09-\x0D]+", " ", t or ""), i)
        return set(first.values())
    if name == "simhash_dedup":
        return {i for i, least in zip(ids, classes([fingerprint(t) for t in texts], ids, 4)) if i == least}
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    return {r[0] for r in contaminated(rows, items) if not r[-1]}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, before = stage(spark, docs, SMALL), docs.collect()
        assert out.columns == docs.columns
        kept = out.collect()
        assert set(kept) <= set(before) and {r.doc_id for r in kept} == stays(name, [(r.doc_id, r.text) for r in before], spark), name
        docs = spark.createDataFrame(kept, docs.schema)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
