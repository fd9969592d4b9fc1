import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from amrspark.llm import tokens
from amrspark.llm.packing import pack_chunks
from amrspark.llm.queries import tokenizer_file
from amrspark.llm.token_files import read_tokens, write_tokens
from amrspark.llm.tokens import TokenCoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = [
    "blaKPC-2 confers resistance.\nIt spreads on plasmids, fast.", "a  b", " a", "a ", "a\n\nb", "\n", "",
    "a\tb \tc", "<|endoftext|> x <|endoftext|>y", "<|endof text|>", "é ́a", "e\n ́", "ΑΣ ΣΑΣ b",
    "it's 's 12 345!! ok", "　a b  c", "a\x1cb \x1c c", "x\x85y z", "  ", "a\rb \r c", "İ i̇ ß ﬁ ½", None,
    "'s\n's 's", "word " * 3000,
]


def direct(name, texts):
    t = Tokenizer.from_file(tokenizer_file(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def by_piece(coder, texts):
    return [ids[a:b].tolist() for _, ids, s in coder.encode(pa.array(texts, pa.string())) for a, b in zip(s[:-1], s[1:])]


@pytest.mark.parametrize("name", FILES)
def test_pieces_equal_whole_texts(name, monkeypatch):
    coder = TokenCoder(tokenizer_file(name))
    want = direct(name, TEXTS)
    assert by_piece(coder, TEXTS) == want
    assert by_piece(coder, TEXTS[::-1]) == want[::-1]
    assert by_piece(coder, TEXTS[:1]) == want[:1]
    monkeypatch.setattr(tokens, "_PIECES", 5)
    small = TokenCoder(tokenizer_file(name))
    assert [by_piece(small, [x])[0] for x in TEXTS] == want
    assert by_piece(small, TEXTS) == want


def test_file_round_trip(spark, tmp_path):
    rows = [(i * 7 % 23, x, "clash") for i, x in enumerate(TEXTS)] + [(4, "twice", ""), (4, "twice", ""), (None, "no id", "")]
    df = spark.createDataFrame(rows, "chunk_id int, text string, payload string").repartition(3)
    path = str(tmp_path / "file")
    write_tokens(df, tokenizer_file(FILES[0]), 0, path)
    got = read_tokens(spark, path).orderBy("start").collect()
    keys = [r.chunk_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted((str(i), ids + [0]) for (i, _, _), ids in zip(rows, direct(FILES[0], [r[1] for r in rows])))
    assert sorted((str(r.chunk_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    blocks = spark.read.parquet(path + "/blocks").orderBy("part", "block").collect()
    assert [k for b in blocks for k in b.chunk_ids] == keys
    assert all(zlib.crc32(b.payload) == b.checksum for b in blocks)


def test_empty_file_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(1, "text of a chunk " * 50)], "chunk_id int, text string")
    write_tokens(df.limit(0), tokenizer_file(FILES[0]), 0, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0
    write_tokens(df, tokenizer_file(FILES[0]), 0, str(tmp_path / "one"))
    blocks = spark.read.parquet(str(tmp_path / "one/blocks"))
    blocks.withColumn("checksum", blocks.checksum + 1).write.parquet(str(tmp_path / "bad/blocks"))
    spark.read.parquet(str(tmp_path / "one/table")).write.parquet(str(tmp_path / "bad/table"))
    with pytest.raises(Exception, match="damaged"):
        read_tokens(spark, str(tmp_path / "bad")).collect()


def check_packed(rows, ids_of, limits):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.chunk_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids_of)
    for key, parts in pieces.items():
        ids, at = np.array(ids_of[key], "<u4"), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert (r.start, r.chunk_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for parts in bins.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts)])[:-1].tolist()
        total = sum(r.length for r in parts)
        assert total <= limits[0] and total & (total - 1) == 0
        assert len(parts) <= limits[1] and sum(r.loss_tokens for r in parts) <= limits[2]


@pytest.mark.parametrize("limits", [(2048, 256, 2048), (64, 3, 64), (64, 5, 20)])
def test_packing_limits(spark, limits):
    rng = np.random.default_rng(4)
    rows = [(i, "gene " * int(n), "which drug " * int(m)) for i, (n, m) in enumerate(zip(rng.integers(0, 90, 300), rng.integers(0, 9, 300)))]
    rows += [(500, None, None), (501, "long " * 5000, ""), (502, "", "q")]
    df = spark.createDataFrame(rows, "chunk_id int, text string, gene_family string").repartition(2)
    got = pack_chunks(
        df, tokenizer_file(FILES[1]), 1, prompt="gene_family",
        max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], pool=16,
    ).collect()
    heads, tails = direct(FILES[1], [r[2] for r in rows]), direct(FILES[1], [r[1] for r in rows])
    check_packed(got, {r[0]: [*h, *t, 1] for r, h, t in zip(rows, heads, tails)}, limits)
    for r in got:
        free = max(0, len(heads[[x[0] for x in rows].index(r.chunk_id)]) - r.start)
        assert r.loss_tokens == r.length - min(r.length, free)


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, "a", 1), (7, "a", 1), (7, "a", 1)], "chunk_id int, text string, start int")
    got = pack_chunks(df, tokenizer_file(FILES[1]), 1, with_ids=True).collect()
    assert sum(r.length for r in got) == 6
    assert {tuple(r.ids) for r in got if r.length == 2} <= {(*direct(FILES[1], ["a"])[0], 1)}
    assert pack_chunks(df.limit(0), tokenizer_file(FILES[1]), 1).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        pack_chunks(df, tokenizer_file(FILES[1]), 1, max_tokens=100)
