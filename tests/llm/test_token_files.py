"""Token files: exact round trips of grammars, files and positions, against the tokenizer alone."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortweave.llm import repair, token_files, tokens

SCHEMA = "doc_id long, text string, part string, before long"


def sequences():
    r = np.random.default_rng(3)
    yield np.empty(0, np.uint32)
    yield np.zeros(1, np.uint32)
    for n in (2, 3, 1001):
        yield np.full(n, 7, np.uint32)
    yield r.integers(0, 4, 20_000).astype(np.uint32)
    yield r.zipf(1.3, 30_000).clip(0, 499).astype(np.uint32)
    yield np.tile(r.integers(0, 500, 37), 300).astype(np.uint32)
    yield np.tile([1, 1, 2, 1, 1, 1, 2, 2], 2000).astype(np.uint32)


@pytest.mark.parametrize("ids", list(sequences()))
@pytest.mark.parametrize("limits", [{}, {"max_rules": 5}, {"least": 2, "rounds": 30}, {"rounds": 0}])
def test_grammar_round_trip(ids, limits):
    g = repair.load(repair.dump(repair.compress(ids, 500, **limits)))
    assert (g.decode() == ids).all() and g.decode().size == ids.size
    assert len(g.rules) <= limits.get("max_rules", 15_000)
    for i, (a, b) in enumerate(g.rules):
        size = lambda s: 1 if s < 500 else g.lengths[s - 500]
        assert max(a, b) < 500 + i and g.lengths[i] == size(a) + size(b)
    r = random.Random(1)
    for _ in range(30):
        a, b = sorted(r.randint(0, ids.size + 3) for _ in range(2))
        assert (g.decode(a, b) == ids[a:b]).all()


def test_repeats_shrink_and_wide_symbols_fit():
    ids = np.tile(np.arange(40, dtype=np.uint32), 1000)
    g = repair.compress(ids, 500, rounds=60)
    assert g.symbols.size < ids.size / 10 and g.rules.size
    wide = repair.compress(ids + 70_000, 80_000)
    assert (repair.load(repair.dump(wide)).decode() == ids + 70_000).all()
    with pytest.raises(ValueError, match="whole"):
        repair.load(repair.dump(g)[:-1])


TEXTS = [
    None, "", " ", "  ", "a", " a ", "a  b", "a b", "a\n b", "a \nb", "a\tb c", "tab\t\tx  y   z", "don't he'll  'tis", "x" * 5000, "日本語 テキスト 。",
    "🙂 é b c d", "<|endoftext|> and <|endoftext|>x", "　a b\u0085 c\x1c d", "12,345.67 -- ###$$$ !", "the cat the cat the cat " * 3000,
]


def expected(rows, tok):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        out.append((doc_id, start, ids.size, zlib.crc32(ids.tobytes())))
        start += ids.size
    return out


@pytest.mark.parametrize("limits", [{}, {"shard_ids": 200, "block_ids": 64}])
def test_files_round_trip(spark, tmp_path, limits):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(TEXTS)] + [(None, "none")]
    docs = spark.createDataFrame([(i, t, "x", 4) for i, t in rows], SCHEMA)
    path = f"file://{tmp_path}/f"
    token_files.write_token_files(docs, path, **limits)
    got = sorted(map(tuple, token_files.document_sums(spark, path).collect()), key=lambda r: r[1])
    tok = Tokenizer.from_file(tokens.BYTE_BPE)
    want = expected(rows, tok)
    assert got == want
    flat = [i for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in tok.encode(t or "", add_special_tokens=False).ids + [0]]
    for a, b in ((0, 1), (150, 900), (len(flat) - 5, len(flat) + 9)):
        spans = sorted(token_files.read_span(spark, path, a, b).collect(), key=lambda r: r.start)
        assert spans[0].start == a and [i for r in spans for i in r.ids] == flat[a:b]


def test_repeats_and_empty(spark):
    rows = [(5, "same"), (5, "same"), (5, "other"), (2, None)]
    got = sorted(map(tuple, token_files.token_sums(spark.createDataFrame([(i, t, "x", 4) for i, t in rows], SCHEMA)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [2, 5, 5, 5] and got[0][1:3] == (0, 1)
    assert [r[1] for r in got[1:]] == [sum(x[2] for x in got[:k]) for k in (1, 2, 3)]
    assert token_files.token_sums(spark.createDataFrame([], SCHEMA)).collect() == []


def test_segments_encode_as_whole_texts():
    tok = Tokenizer.from_file(tokens.BYTE_BPE)
    r = random.Random(2)
    texts = ["".join(r.choices(["a", " ", " ", "\n", "'s", "é", ".", "7", " ", "\x1c", "the", "<|endoftext|>", "\t", "🙂"], k=r.randint(0, 40))) for _ in range(3000)]
    for keep in (0, 100, 10**6):
        coder = tokens.ByteBpe(keep=keep)
        for i in range(0, len(texts), 700):
            part = texts[i : i + 700]
            assert [np.frombuffer(x, np.uint32).tolist() for x in coder.encode(part)] == [tok.encode(t, add_special_tokens=False).ids for t in part]
        assert len(coder.spaced) <= keep
