import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from loam.llm import harmonic as H
from loam.llm import packing, queries


def test_packer_loses_nothing_and_pads_nothing():
    rng = random.Random(2)
    for _ in range(300):
        size = rng.choice([2048, 64, 10, 1])
        packer, power = H.Packer(size, rng.choice([64, 4, 1])), rng.choice([1, 3])
        docs, out = [], []
        for d in range(rng.randint(0, 60)):
            n = max(1, int(rng.random() ** power * size * rng.choice([1, 1, 0.5, 9])))
            docs.append(np.arange(n) + d * 100_003)
            out += list(packer.add((d, n), docs[-1]))
            assert packer.lacking < 2 * size
        out += list(packer.finish())
        parts = {}
        for pieces in out:
            n = sum(len(p[2]) for p in pieces)
            assert n == size or (n < size and n & (n - 1) == 0)
            for (d, tokens), start, ids in pieces:
                assert tokens == len(docs[d])
                parts.setdefault(d, []).append((start, ids))
        for d, ids in enumerate(docs):
            mine = sorted(parts[d], key=lambda p: p[0])
            assert [p[0] for p in mine] == np.cumsum([0] + [len(p[1]) for p in mine])[:-1].tolist()
            assert (np.concatenate([p[1] for p in mine]) == ids).all()


def test_a_class_closes_by_its_count():
    packer = H.Packer(100, 64)
    assert list(packer.add((1, 30), np.zeros(30))) == list(packer.add((2, 26), np.zeros(26))) == []
    assert len(packer.open[3]) == 2
    assert list(packer.add((3, 33), np.zeros(33))) == [] and packer.open[3] == [] and packer.lacking == 11
    (closed,) = packer.add((4, 11), np.zeros(11))  # the gap takes it whole
    assert [p[0][0] for p in closed] == [1, 2, 3, 4] and packer.lacking == 0


def check(rows, texts, tokenizer, size):
    """Every id of every row in exactly one piece, sequences gapless and without padding."""
    encoded = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)
    assert docs.keys() == encoded.keys()
    for d, pieces in docs.items():
        at = 0
        for start, n, crc, tokens in sorted(pieces):
            assert (start, tokens) == (at, len(encoded[d]))
            assert crc == zlib.crc32(np.array(encoded[d][at : at + n], "<u4").tobytes())
            at += n
        assert at == len(encoded[d])


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_round_trip(spark, tokenizer):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op13_harmonic_packing(spark, sf).collect(), texts, tokenizer, H.SIZE)


def test_odd_rows(spark, tokenizer):
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 30_000, 5: "é\U0001f600 " * 50, 6: "x" * 5000, None: "no id"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "1 as start", "2 as `a.b`")
    check(H.pack_documents(df.repartition(3), *queries.tokenizer()).collect(), texts, tokenizer, H.SIZE)
    assert len({r.sequence_id for r in H.pack_documents(df.unionAll(df), *queries.tokenizer(), size=8, keep_ids=True).collect()}) > 1000
    assert H.pack_documents(df.where("doc_id > 9"), *queries.tokenizer()).count() == 0
    with pytest.raises(ValueError):
        H.pack_documents(df, *queries.tokenizer(), size=0)


def test_rank_file_gives_the_ids_of_the_tokenizer_file(tokenizer):
    """On every text of the largest table of documents that is no check table."""
    enc, differ = packing.encoder(*queries.tokenizer()), 0
    for b in pq.ParquetFile("/root/testdata/sf0.1/documents.parquet").iter_batches(1000, columns=["text"]):
        texts = [t or "" for t in b.column(0).to_pylist()]
        for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            differ += packing.encode(t, enc) != e.ids
    assert differ == 0
