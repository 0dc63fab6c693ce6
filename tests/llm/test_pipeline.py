"""The pipeline's stages against plain Python, on repeated and null ids, empty tables and clashing names."""

import random
from collections import Counter

import pytest

import corpus_pipeline

SHARED = "a line that very many documents share"
CLASH = ("gone_id", "of", "new_text", "topic", "digest", "key", "row", "mix_topic", "class_id", "doc_id_2")
ITEM = "one two three four five six seven eight nine ten eleven"
TOXIC = "idiot scum worthless clown pathetic moron "
PLAIN = "some plain words here "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(100 + i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def docs_of(spark, rows, extra=()):
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    for c in extra:
        d = d.selectExpr("*", f"concat('{c}', coalesce(text, '')) AS {c}")
    return d


def run(spark, folder, stage, rows):
    return sorted((r.text or "" for r in getattr(corpus_pipeline, stage)(spark, docs_of(spark, rows), folder).collect()))


def say(r, n):
    return " ".join("".join(r.choices("abcdefghi", k=6)) for _ in range(n))


@pytest.mark.parametrize("same", [None, 7])
def test_each_row_has_its_own_result(spark, folder, same):
    r = random.Random(1)
    clean, bad = [say(r, 30) for _ in range(4)], TOXIC * 3
    leak = say(r, 3) + " " + ITEM
    known = [(100 + i, PLAIN * 9 + ("idiot scum worthless clown" if i % 4 == 0 else "")) for i in range(60)]
    assert run(spark, folder, "toxicity", [*known, *[(same, t) for t in [*clean, bad]]]) == sorted([*clean, *[PLAIN * 9] * 45])
    assert run(spark, folder, "benchmark_decontamination", [(same, t) for t in [*clean, leak]]) == sorted(clean)
    got = run(spark, folder, "line_dedup", [(same, f"{c}\n{SHARED}") for c in clean] + [(9, say(r, 4))])
    # rows without an id are documents of their own, rows that repeat an id are one
    assert sum(SHARED in t for t in got) == (1 if same is None else 4) and {t.split("\n")[0] for t in got} >= set(clean)
    assert run(spark, folder, "near_dedup", [(same, t) for t in [*clean, *clean, clean[0] + " tail"]]) in (sorted(clean), sorted([*clean[1:], clean[0] + " tail"]))
    drawn = run(spark, folder, "source_mixing", [(same, say(r, 20)) for _ in range(200)])
    assert 120 < len(drawn) < 190 and len(set(drawn)) == len(drawn)


def test_the_smallest_id_of_a_class_stays(spark, folder):
    rows = [(None, "same words in all of these texts"), (8, "same words in all of these texts"), (3, "same words in all of these texts"), (3, "same words in all of these texts")]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(spark, rows), folder).collect()] == [3]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_clashing_names_and_empty_tables(spark, folder, name):
    r = random.Random(2)
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(i, say(r, 20)) for i in range(6)] + [(6, None), (7, "")]
    docs = docs_of(spark, rows, CLASH)
    out = stage(spark, docs, folder)
    if name != "mixing":
        assert out.columns == docs.columns and {x.doc_id for x in out.collect()} == set(range(8))
    assert all(x.gone_id == "gone_id" + (dict(rows)[x.doc_id] or "") for x in out.collect())
    assert stage(spark, docs.limit(0), folder).count() == 0


def test_whole_run_against_plain_python(spark, folder):
    """Planted toxic texts, shared lines, near copies and a benchmark passage; the last stage only draws."""
    r = random.Random(3)
    base = [say(r, 60) for _ in range(30)]
    rows = [(i, f"{t}\n{SHARED}" if i < 5 else t) for i, t in enumerate(base)]
    rows += [(30 + i, base[10 + i] + " tail") for i in range(5)] + [(40, say(r, 20) + " " + ITEM), (41, TOXIC * 3), (42, None), (43, "")]
    rows += [(100 + i, f"{say(r, 30)} {TOXIC if i % 4 == 0 else ''}".strip()) for i in range(60)]
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    kept = [(i, t) for i, t in rows if TOXIC.split()[0] not in (t or "")]
    kept = [(i, "\n".join(x for x in t.split("\n") if x != SHARED or i == 4) if t else t) for i, t in kept]
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in kept for w in [(t or "").split()] if w}
    near = {b for b in bags for a in bags if a < b and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total()}
    want = {i: t for i, t in kept if i not in near and ITEM not in (t or "")}
    assert near == {30, 31, 32, 33, 34} and 4 in want and SHARED in want[4]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    got = {x.doc_id: x.text for x in docs.collect()}
    assert got == want
    out = {x.doc_id: x.text for x in corpus_pipeline.run(spark, folder).collect()}
    assert out.items() <= want.items() and len(out) > 0.5 * len(want)
