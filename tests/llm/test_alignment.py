"""Links between two vocabularies' tokens against a plain computation with the libraries' own objects."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scorelake.llm import alignment, queries

SMALL = "/root/testdata/sf0.001"
NONE = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_level():
    """Character of each byte in the first vocabulary's tokens."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in seen)}


def brute(texts, libraries):
    first, second = libraries
    back, rows, holding = byte_level(), [], Counter()
    for text in texts:
        rows.append(None)
        if not text:
            continue
        a, b = first.encode(" " + text, add_special_tokens=False), second.encode(text)
        raw_a = [bytes(back[c] for c in t) for t in a.tokens]
        raw_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        ends = [np.cumsum([len(t) for t in raw]).tolist() for raw in (raw_a, raw_b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [(defaultdict(list), i, e) for i, e in zip((a.ids, b), ends)]
        for held, ids, at in groups:
            for i, e in zip(ids, at):
                held[bisect.bisect_left(cuts, e)].append(i)
        left, right = groups[0][0], groups[1][0]
        links = Counter((x, y) for g in range(len(cuts)) for x in left[g] for y in right[g])
        said = ";".join(",".join(map(str, left[g])) + "|" + ",".join(map(str, right[g])) for g in range(len(cuts)))
        rows[-1] = (len(a.ids), len(b), len(cuts), links, hashlib.sha256(said.encode()).hexdigest())
        holding.update(links.keys())
    high = defaultdict(int)
    for (x, _), n in holding.items():
        high[x] = max(high[x], n)
    return [NONE if r is None else (
        *r[:3], sum(r[3].values()), sum(m for k, m in r[3].items() if holding[k] == high[k[0]]), sum(m * holding[k] for k, m in r[3].items()), r[4]) for r in rows]


def test_query_equals_brute_force(spark, libraries):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_token_alignment"](spark, SMALL).collect()}
    assert [got[r.doc_id] for r in docs] == brute([r.text for r in docs], libraries)


def test_strange_texts_equal_brute_force(spark, libraries):
    rnd = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", " \n", "\t", "é", "日本", "　", "▁", "<|endoftext|>", "</s>", "<0x41>", "12", "'s", "İ", "\xa0",
                "\x85", "\x1c", "᠎", "​", "xq", "ſ", "\0", ".", "😀", "é", "\xad"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(800)]
    texts += [None, "", "x" * 30_000, " ", " a", "\n", "same text", "same text", "a▁"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk int, path string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.token_links(docs, chunk=2000).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, libraries)
    assert got[texts.index("a▁")] == NONE


def test_edges(spark):
    assert alignment.token_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = alignment.token_links(spark.createDataFrame([(None, None), ("7", "a"), ("7", "a")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_a, r.n_links, r.count_sum) for r in rows) == [("", 0, 0, 0), ("7", 1, 1, 2), ("7", 1, 1, 2)]


def test_products_equal_dense_ones(monkeypatch):
    rng = np.random.default_rng(2)
    for limit in (1, 7, 1 << 20):
        monkeypatch.setattr(alignment, "PRODUCTS", limit)
        for _ in range(30):
            n, k, m = rng.integers(1, 9, 3)
            a, b = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))
            sparse = []
            for x in (a, b):
                row, column = np.nonzero(x)
                times = x[row, column]
                sparse.append(alignment.Rows.of(np.repeat(row, times), np.repeat(column, times), len(x)))
            got = alignment.product(*sparse)
            dense = np.zeros((n, m), int)
            dense[got.rows(), got.columns] = got.values
            assert (dense == a @ b).all()


def test_forgetting_changes_nothing(monkeypatch, libraries):
    monkeypatch.setattr(alignment, "STRETCHES", 5)
    links = alignment.Aligner(alignment.FIRST, alignment.SECOND)
    for text in ("one two three four", "two three five six seven", "one\ntwo nine ten"):
        batch = alignment.Batch(links, [text], 3)
        assert tuple(batch.numbers[0])[:3] == brute([text], libraries)[0][:3] and batch.digests[0] == brute([text], libraries)[0][6]
