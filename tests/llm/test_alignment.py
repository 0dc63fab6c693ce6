"""Tokenizer alignment against a plain Python version that encodes whole texts and compares their offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortweave.llm import alignment, tokens

SCHEMA = "doc_id long, text string, n long, links string, sid string"


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    tok = Tokenizer.from_file(tokens.BYTE_BPE)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.PIECE_BPE)
    table = byte_table()
    done, counts = [], Counter()
    for doc_id, text in rows:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        a_bytes = [bytes(table[c] for c in tok.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            done.append((doc_id, None, None, None, None))
            continue
        ends = [[sum(map(len, side[: k + 1])) for k in range(len(side))] for side in (a_bytes, b_bytes)] if len(whole) < 3000 else None
        if ends is None:
            ends = []
            for side in (a_bytes, b_bytes):
                total, own = 0, []
                for x in side:
                    total += len(x)
                    own.append(total)
                ends.append(own)
        at_a, at_b = dict(zip(ends[0], a)), dict(zip(ends[1], b))
        groups, links, part = [], [], ([], [])
        for e in sorted({*at_a, *at_b}):
            for side, at in zip(part, (at_a, at_b)):
                if e in at:
                    side.append(str(at[e]))
            if e in at_a and e in at_b:
                links.append((at_a[e], at_b[e]))
                groups.append(",".join(part[0]) + "|" + ",".join(part[1]))
                part = ([], [])
        counts.update(links)
        done.append((doc_id, len(a), len(b), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, n_a, n_b, links, text in done:
        if links is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            best = sum(counts[x] == most[x[1]] for x in links)
            out.append((doc_id, n_a, n_b, len(links), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def hostile():
    r = random.Random(5)
    pieces = ["the", "cat", "naïve", "éèê", " ", "  ", "\n", "\t", "'s", "12", "…", "🙂", "▂", " ", "　", "<|endoftext|>", "<s>", "<0x41>", "ﬁ", "x" * 40, "日本", ".", "\x1c", "\x85", "\0"]
    texts = ["".join(r.choices([*pieces, *" " * 12], k=r.randint(1, 40))) for _ in range(200)]
    texts += [None, "", " ", "  ", "\n", "a▁b", "▁", "z" * 4000, "word " * 5000, "same text here", "same text here", " x", "x ", "\0"]
    return [(i, t) for i, t in enumerate(texts)] + [(7, "same text here"), (None, "null id"), (None, None)]


@pytest.mark.parametrize("bucket_bytes", [32 << 20, 300])
def test_against_whole_texts(spark, bucket_bytes):
    rows = hostile()
    docs = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, alignment.align_tokenizers(docs, bucket_bytes=bucket_bytes).collect()), key=repr)
    assert got == brute(rows) and sum(r[6] for r in got) > 1000 and sum(r[7] == "" for r in got) >= 5


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "a▁")]], ids=["empty", "no text", "unspelled"])
def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, alignment.align_tokenizers(docs).collect()), key=repr) == brute(rows)


def test_cuts_join_in_the_partitions_of_texts(spark):
    tokens_ = spark.createDataFrame([(1, "x", 3, [1, 2, 1], [5, 1]), (2, "", 1, [], []), (3, "y", 1, [2], [5])], "sid long, segment string, n long, a array<int>, b array<int>")
    sizes = {"a": spark.createDataFrame([(1, 2), (2, 3)], "id int, len int"), "b": spark.createDataFrame([(5, 5), (1, 2)], "id int, len int")}
    with alignment.co_partitioned(spark):
        found = alignment.cuts(tokens_, sizes)
        assert sorted(map(tuple, found.collect())) == [(1, 0, 2, 5, 1, 0), (1, 1, 1, 1, 2, 1)]
        assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 2
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    (row,) = alignment.groups(tokens_, found).collect()
    assert (row.segment, row.n, row.groups, [tuple(x) for x in row.links]) == ("x", 3, "1,2|5;1|1", [(2, 5), (1, 1)])
    assert alignment._numbers("1,2|5;1|1,4,7") == (3, 4, 2)
